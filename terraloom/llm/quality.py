"""Quality rules as a short-circuit cascade.

Base measures of a text, words being runs of bytes other than space, tab, \\n, \\v, \\f, \\r:
``n_words``; ``word_chars``, their code points; ``n_symbols``, characters of ``#*$%&|<>``;
``n_dup_lines``, \\n-split lines that hold a word and equal an earlier line; ``n_repeat_words``,
words inside 3-word windows found twice or more in the text, the first included.

A document is base-failed with fewer than 50 words or more than half of them repeated. The
others meet the rules of the cascade. Each rule looks only at the documents that all earlier rules
let through, so the order decides the cost and never the verdict: cost and rejections of every rule are measured
on at most ``sample_docs`` documents, and rules run by falling rejections per second. The sample is the first of those that a hash of the doc_id draws (one in ``DRAWN``, texts of up to
``SAMPLE_CHARS`` characters); the driver takes it from as few partitions as hold it, and nothing is exchanged.

Null texts count as empty: no words, base-failed. Any number of equal rows gives as many equal
results; no table is too empty. Other columns, of whatever name, are carried by ``keep`` and ignored by ``measure``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import small_batches

MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Documents on which cost and selectivity of the rules are estimated; they order the rules only.
SAMPLE_DOCS, DRAWN, SAMPLE_CHARS = 2000, 8, 20_000

#: The characters that count as symbols.
SYMBOLS = tx.byte_class(b"#*$%&|<>")
UPPER = tx.byte_class(bytes(range(ord("A"), ord("Z") + 1)))
LETTER = tx.byte_class(bytes(range(ord("A"), ord("Z") + 1)) + bytes(range(ord("a"), ord("z") + 1)) + bytes(range(0x80, 0x100)))
CONTINUED = np.zeros(256, bool)
CONTINUED[0x80:0xC0] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean"


class Texts(NamedTuple):
    """A chunk with the measures of its documents."""

    buf: np.ndarray
    off: np.ndarray
    words: tx.Words
    base: dict[str, np.ndarray]

    def of(self, docs: np.ndarray, member: np.ndarray) -> np.ndarray:
        """Bytes of a class in each of these documents, read from these documents only."""
        return np.array([np.count_nonzero(member[self.buf[self.off[d] : self.off[d + 1]]]) for d in docs], np.int64)

    def has(self, docs: np.ndarray, member: np.ndarray) -> np.ndarray:
        """How many words of each of these documents hold a byte of a class."""
        out = np.zeros(len(docs), np.int64)
        for k, d in enumerate(docs):
            lo, hi = self.words.first[d : d + 2]
            if lo < hi:
                at = int(self.off[d])
                marked = np.zeros(int(self.off[d + 1]) - at + 1, np.int64)
                np.cumsum(member[self.buf[at : self.off[d + 1]]], out=marked[1:])
                out[k] = np.count_nonzero(marked[self.words.end[lo:hi] - at] > marked[self.words.start[lo:hi] - at])
        return out


def symbols(t: Texts, docs: np.ndarray) -> np.ndarray:
    """At most 2 symbols in 10 words."""
    return 10 * t.base["n_symbols"][docs] <= 2 * t.base["n_words"][docs]


def duplicate_lines(t: Texts, docs: np.ndarray) -> np.ndarray:
    """Fewer repeated lines than a tenth of the words, so that most of the text is its own."""
    return 10 * t.base["n_dup_lines"][docs] <= t.base["n_words"][docs]


def word_length(t: Texts, docs: np.ndarray) -> np.ndarray:
    """2 to 20 code points in a word on average."""
    n, c = t.base["n_words"][docs], t.base["word_chars"][docs]
    return (2 * n <= c) & (c <= 20 * n)


def capitals(t: Texts, docs: np.ndarray) -> np.ndarray:
    """At most half of the text's letters are capitals A to Z."""
    return 2 * t.of(docs, UPPER) <= t.of(docs, LETTER)


def lettered(t: Texts, docs: np.ndarray) -> np.ndarray:
    """At least 6 in 10 words hold a letter."""
    return 10 * t.has(docs, LETTER) >= 6 * t.base["n_words"][docs]


RULES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {f.__name__: f for f in (symbols, duplicate_lines, word_length, capitals, lettered)}


def measured(buf: np.ndarray, off: np.ndarray) -> Texts:
    w, docs = tx.words(buf, off), len(off) - 1
    roll = tx.Rolling(buf)
    h = roll(w.start, w.end)
    base = {"n_words": np.diff(w.first)}

    code_points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~CONTINUED[buf], out=code_points[1:])
    base["word_chars"] = tx.sums(code_points[w.end] - code_points[w.start], w.first)
    del code_points
    base["n_symbols"] = np.diff(np.searchsorted(np.flatnonzero(SYMBOLS[buf]), off))

    ends = np.flatnonzero(buf == 10)
    start = np.union1d(off[:-1], ends + 1)
    start = start[start < len(buf)]
    stop = np.minimum(np.append(start[1:], len(buf)), np.append(ends, len(buf))[np.searchsorted(ends, start)])
    full = np.searchsorted(w.start, start) < np.searchsorted(w.start, stop)
    start, stop = start[full], stop[full]
    line_doc = np.searchsorted(off, start, "right") - 1
    line = tx.splitmix(roll(start, stop) ^ tx.splitmix(line_doc.astype(tx.U)))
    _, first = np.unique(line, return_index=True)
    base["n_dup_lines"] = np.bincount(line_doc, minlength=docs) - np.bincount(line_doc[first], minlength=docs)

    doc = w.doc
    three = tx.grams(h, 3)
    at = np.flatnonzero(tx.within(w.first, 3))
    _, inverse, count = np.unique(tx.splitmix(three[at] ^ tx.splitmix(doc[at].astype(tx.U))), return_inverse=True, return_counts=True)
    at = at[count[inverse] > 1]
    hit = np.zeros(len(h), bool)
    for j in range(3):
        hit[at + j] = True
    base["n_repeat_words"] = tx.sums(hit, w.first)
    return Texts(buf, off, w, base)


def base_failed(t: Texts) -> np.ndarray:
    n = t.base["n_words"]
    return (n < MIN_WORDS) | (100 * t.base["n_repeat_words"] > REPEAT_PERCENT * n)


def cascade(t: Texts, order: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept); a rule reads only what the rules before it have kept."""
    failed = base_failed(t)
    alive = np.flatnonzero(~failed)
    for name in order:
        if not len(alive):
            break
        alive = alive[RULES[name](t, alive)]
    kept = np.zeros(len(failed), bool)
    kept[alive] = True
    return failed, kept


def _trial(texts: list[str]) -> tuple[dict[str, int], dict[str, float]]:
    """Rejections and seconds of each rule on documents that are not base-failed."""
    rejected, spent = dict.fromkeys(RULES, 0), dict.fromkeys(RULES, 0.0)
    for _, buf, off in tx.chunks([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]):
        t = measured(buf, off)
        docs = np.flatnonzero(~base_failed(t))
        for name, rule in RULES.items():
            began = time.perf_counter()
            ok = rule(t, docs)
            spent[name] += time.perf_counter() - began
            rejected[name] += int(len(docs) - np.count_nonzero(ok))
    return rejected, spent


def plan_order(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[str]:
    """Rules by falling rejections per second, as found on at most ``sample_docs`` documents."""
    small_batches(docs.sparkSession)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0).where(F.length("text").between(1, SAMPLE_CHARS))
    rejected, spent = _trial([r.text for r in drawn.select("text").limit(sample_docs).collect()])
    return sorted(RULES, key=lambda name: -rejected[name] / (spent[name] + 1e-9))


def measure(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of ``docs``, in one scan without a shuffle."""
    order = plan_order(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in tx.chunks(batches):
            t = measured(buf, off)
            failed, kept = cascade(t, order)
            yield pa.RecordBatch.from_arrays([tx.column(rows, "doc_id"), *(pa.array(t.base[m].astype(np.int64)) for m in MEASURES), pa.array(failed), pa.array(kept)], ["doc_id", *MEASURES, "base_failed", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns as they were."""
    order = plan_order(docs, sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in tx.chunks(batches):
            yield rows.filter(pa.array(cascade(measured(buf, off), order)[1]))

    return docs.mapInArrow(run, docs.schema)
