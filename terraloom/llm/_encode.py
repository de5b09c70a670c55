"""Token ids of whole texts by the tokenizers library, at a fraction of its time for byte-level BPE.

A byte-level BPE with the usual split never joins what stands before a white-space character
to what follows, if the character before it is not white space. Texts are cut there, each distinct piece of a
chunk is encoded once by the library, and the ids are put together again. Any other
tokenizer, or one that normalises or strips, encodes whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from . import _text as tx

_ASCII_SPACE = tx.byte_class(b"\x09\x0a\x0b\x0c\x0d\x20")
_VISIBLE = tx.byte_class(bytes(range(0x21, 0x7F)))
#: Lead bytes of two-byte characters none of which is white space.
_LEAD = tx.byte_class(bytes(range(0xC3, 0xE0)))
#: Pieces whose ids are remembered between chunks.
CACHE = 1_200_000


class Encoder:
    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
            and not spec.get("normalizer")
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
        )
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n, self.flat = np.zeros(0, tx.U), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each document's begin, with the end)."""
        raw = buf.tobytes()
        if not self.by_piece:
            flat, n = self._encoded([raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)])
            return flat, np.append(0, np.cumsum(n))
        cut = np.zeros(len(buf), bool)
        if len(buf):
            before = _VISIBLE[buf[:-1]]
            before[1:] |= (buf[1:-1] >= 0x80) & _LEAD[buf[:-2]]
            cut[1:] = _ASCII_SPACE[buf[1:]] & before
            cut[off[:-1][off[:-1] < off[1:]]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))[: len(start)]
        distinct, first, inverse = np.unique(tx.Rolling(buf)(start, end), return_index=True, return_inverse=True)
        self._learn(distinct, raw, start[first], end[first])
        place = np.searchsorted(self.known, distinct)[inverse]
        n = self.n[place].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.at[place].astype(np.int64) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.append(0, ends)[np.searchsorted(start, off)]

    def _learn(self, distinct: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> None:
        if len(self.known) > CACHE:
            self._forget()
        place = np.searchsorted(self.known, distinct)
        new = np.flatnonzero(self.known[np.minimum(place, len(self.known) - 1)] != distinct) if len(self.known) else np.arange(len(distinct))
        if not len(new):
            return
        flat, n = self._encoded([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        known = np.concatenate([self.known, distinct[new]])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, (len(self.flat) + np.cumsum(n) - n).astype(np.uint32)])[order]
        self.n = np.concatenate([self.n, n.astype(np.uint32)])[order]
        self.flat = np.concatenate([self.flat, flat])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """One for each Python worker."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path, plain_specials)
    return _encoders[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
