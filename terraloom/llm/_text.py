"""Vectorised kernels over UTF-8 bytes: words, rolling hashes, n-grams.

Texts come as Arrow batches. A chunk is a run of whole documents whose bytes lie one after
another, of about ``limit`` bytes; a longer document is a chunk by itself and is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
# Python workers live on between tasks: memory that a batch has used goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())
U = np.uint64


def _trimmer() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


_trim = _trimmer()


def trim() -> None:
    """Gives memory that a task has freed back to the system."""
    _trim(0)


#: The six separators of words, in ASCII order.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_codes(lower: bool) -> np.ndarray:
    codes = splitmix((np.arange(1, 257, dtype=U)) * U(0x9E3779B97F4A7C15))
    if lower:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


RAW, LOWER = _byte_codes(False), _byte_codes(True)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The second modulus, and a base of it.
PRIME = (1 << 31) - 1
_BASE31 = 0x2F0B4C47
_INVERSE31 = pow(_BASE31, -1, PRIME)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo the prime, or the prime itself for 0; in place."""
    for _ in range(2):
        high = x >> U(31)
        x &= U(PRIME)
        x += high
    return x


def _power(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    have = _powers.get((base, modulus))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        if modulus == 1 << 64:
            have = np.full(size, base, U)
            have[0] = 1
            have = np.cumprod(have, dtype=U)
        else:
            have = np.ones(1, U)
            while len(have) < size:
                have = np.concatenate([have, _folded(have * U(pow(base, len(have), modulus)))])
            have = have[:size].astype(np.uint32)
        if size <= 4 * CHUNK:
            _powers[base, modulus] = have
    return have[:n]


class Rolling:
    """Hashes of any byte ranges of a buffer, from prefix sums modulo 2**64 and modulo a prime.

    Sums modulo a power of 2 alone agree for some unlike strings whatever the base (those of Thue and Morse); the prime tells these apart.
    """

    def __init__(self, buf: np.ndarray, codes: np.ndarray = RAW):
        n = len(buf)
        self._buf, self._codes = buf, codes
        self.sums = np.zeros(n + 1, U)
        np.multiply(codes[buf], _power(_BASE, n), out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)
        self._back = _power(_INVERSE, n + 1)
        self._sums31: np.ndarray | None = None

    def quick(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Modulo 2**64 only: for choices, not for equality."""
        return splitmix((self.sums[end] - self.sums[start]) * self._back[start] + (end - start).astype(U))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums31 is None:
            n = len(self._buf)
            self._sums31 = np.zeros(n + 1, U)
            np.multiply((self._codes >> U(34))[self._buf], _power(_BASE31, n, PRIME), out=self._sums31[1:])
            _folded(self._sums31)
            np.cumsum(self._sums31, out=self._sums31)
            self._back31 = _power(_INVERSE31, n + 1, PRIME)
        second = _folded(_folded(self._sums31[end] - self._sums31[start]) * self._back31[start])
        second[second == PRIME] = 0
        second *= U(0x9E3779B97F4A7C15)
        second ^= self.quick(start, end)
        return splitmix(second)


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    #: number of the first word of each document, and the number of words at the end
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words: all but the separators.
WORD = ~byte_class(SPACES)


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray = WORD) -> Words:
    """Maximal runs of member bytes inside each document."""
    inside = member[buf]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    tails = off[1:][off[:-1] < off[1:]] - 1
    begin[heads] = inside[heads]
    stop[tails] = inside[tails]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(stop) + 1, np.searchsorted(start, off))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k neighbours of h, document borders included; len(h) - k + 1 of them."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(0xD1342543DE82EF95)
        out += h[j : j + n]
    return splitmix(out + U(k))


def within(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k neighbours lie within one document, by the runs' first members."""
    n = max(0, int(first[-1]) - k + 1)
    ok = np.ones(n, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values from first[i] to first[i + 1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null counts as empty."""
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole documents."""
    for batch in batches:
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
    trim()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
