"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A window is 13 words of a
benchmark item in a row; an item with fewer words, but not none, is one window. A document's
word is hit if it lies in an occurrence of a window.

Of every 9 neighbouring 5-word grams an item keeps the one of least hash, and so does a document. A shared span of 13
words holds the same 9 grams on both sides, so both keep the same one: no window is missed. Kept grams meet by
hash; each meeting is extended word by word to the windows around it. Items shorter than 13 words have windows too short for that
guarantee: their fingerprint is one gram of ``min(5, length)`` words, and all grams of a document are tried against it.

The benchmark is a query set against all documents: its items are dealt by hash to blocks of about half of ``BLOCK_BYTES`` of
text (all are one block if they fit it), and each block is broadcast, so what is broadcast doesn't grow and a larger benchmark takes more scans. Documents are never
shuffled with one block. Null texts have no words. Documents or items that repeat count each; an item_id is
a string for sorting; an item with a null item_id hits words like any other, but is left out of the lists, so of n_items and items_sha256 too. An empty benchmark hits nothing. Other columns are ignored, or carried by ``clean``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import small_batches

WINDOW, GRAM = 13, 5
#: Benchmark text in one broadcast.
BLOCK_BYTES = 16 << 20
WORD = ~tx.byte_class(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
WORD[ord("A") : ord("Z") + 1] = True

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, hit_start array<int>, hit_end array<int>"
Spans = list[tuple[int, int]]


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[tx.Words, np.ndarray]:
    w = tx.words(buf, off, WORD)
    return w, tx.Rolling(buf, tx.LOWER)(w.start, w.end)


def winnow(h: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Positions of the leftmost least value in each run of ``span`` neighbours; ok: which runs count, by their first."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    runs = np.flatnonzero(ok[:n])
    return np.unique(runs + view[runs].argmin(1))


class Fingerprints:
    """Of a block of items; item words lie one after another in ``words``."""

    def __init__(self, ids: list[str | None], texts: list[str]):
        buf, off = tx.text_bytes(pa.array(texts, pa.large_string()))
        w, self.words = _words(buf, off)
        self.ids, self.first = ids, w.first
        self.item = w.doc
        length = np.diff(w.first)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        long = np.repeat(length >= WINDOW, length)
        if long.any():
            at = winnow(tx.grams(self.words, GRAM), tx.within(w.first, WINDOW), WINDOW - GRAM + 1)
            self.tables[0] = self._table(at[long[at]], GRAM)
        for k in range(1, GRAM + 1):
            fits = (length == k) if k < GRAM else (length >= GRAM) & (length < WINDOW)
            if fits.any():
                self.tables[k] = self._table(w.first[:-1][fits], k)

    def _table(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        h = tx.grams(self.words, k)[at]
        order = np.argsort(h, kind="stable")
        return h[order], at[order]

    def hits(self, w: tx.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first word, word past the last) of each occurrence of a window in a chunk of documents."""
        found = []
        for k, (keys, places) in self.tables.items():
            g = tx.grams(h, k or GRAM)
            at = winnow(g, tx.within(w.first, WINDOW), WINDOW - GRAM + 1) if k == 0 else np.flatnonzero(tx.within(w.first, k))
            lo = np.searchsorted(keys, g[at])
            seen = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == g[at])
            lo = lo[seen]
            n = np.searchsorted(keys, g[at[seen]], "right") - lo
            mine = np.repeat(at[seen], n)
            theirs = places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append(self._extend(w, h, mine, theirs))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3

    def _extend(self, w: tx.Words, h: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item = self.item[theirs]
        doc = np.searchsorted(w.first, mine, "right") - 1
        size = np.minimum(WINDOW, self.first[item + 1] - self.first[item])

        def reach(step: int) -> np.ndarray:
            out, alive = np.zeros(len(mine), np.int64), np.ones(len(mine), bool)
            for j in range(0 if step > 0 else 1, WINDOW):
                a, b = mine + step * j, theirs + step * j
                alive &= (a >= w.first[doc]) & (a < w.first[doc + 1]) & (b >= self.first[item]) & (b < self.first[item + 1])
                live = np.flatnonzero(alive)
                alive[live] = h[a[live]] == self.words[b[live]]
                out += alive
            return out

        left, right = reach(-1), reach(1)
        ok = left + right >= size
        return item[ok], (mine - left)[ok], (mine + right)[ok]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > top[:-1])
    return start[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _rows(ids: pa.Array, n_words: np.ndarray, per: list[tuple[list[str], list[int], list[int]]]) -> pa.RecordBatch:
    n_hit = np.array([sum(e) - sum(s) for _, s, e in per], np.int64)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(n_words.astype(np.int64)),
            pa.array(n_hit),
            pa.array([len(x) for x, _, _ in per], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x, _, _ in per], pa.string()),
            pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
            pa.array([x for x, _, _ in per], pa.list_(pa.string())),
            pa.array([s for _, s, _ in per], pa.list_(pa.int32())),
            pa.array([e for _, _, e in per], pa.list_(pa.int32())),
        ],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "hit_start", "hit_end"],
    )


def _found(prints: Fingerprints, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[list[str], list[int], list[int]]]]:
    w, h = _words(buf, off)
    item, start, end = prints.hits(w, h)
    doc = np.searchsorted(w.first, start, "right") - 1
    per: list[tuple[list[str], list[int], list[int]]] = [([], [], [])] * (len(off) - 1)
    order = np.argsort(doc, kind="stable")
    edges = np.flatnonzero(np.diff(doc[order], prepend=-1, append=-1)) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        d = int(doc[own[0]])
        s, e = _merged(start[own], end[own])
        per[d] = (sorted({prints.ids[i] for i in item[own]} - {None}), (s - w.first[d]).tolist(), (e - w.first[d]).tolist())
    return np.diff(w.first), per


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    small_batches(benchmark.sparkSession)
    items = benchmark.selectExpr("cast(item_id as string) id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(2 * n)) == k) for k in range(2 * n)]


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated, and the items and merged spans of words behind them."""
    return _find(docs, _blocks(benchmark, block_bytes)).drop("text_hash")


def _find(docs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    spark, rows = docs.sparkSession, docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) text_hash")
    parts = []
    for block in blocks:
        got = block.collect()
        shared = spark.sparkContext.broadcast(([r.id for r in got], [r.text for r in got]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prints = Fingerprints(*shared.value)
            for own, buf, off in tx.chunks(batches):
                made = _rows(tx.column(own, "doc_id"), *_found(prints, buf, off))
                yield made.append_column("text_hash", tx.column(own, "text_hash"))

        parts.append(rows.mapInArrow(run, SCHEMA + ", text_hash long"))
    return parts[0] if len(parts) == 1 else _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Several blocks: items and spans of equal rows (doc_id and text) meet; rows without any are those of the first block."""
    found = parts[0].where("n_hit > 0")
    for p in parts[1:]:
        found = found.unionByName(p.where("n_hit > 0"))
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("item_ids", "hit_start", "hit_end")).alias("found"))
    base = parts[0].select("doc_id", "n_words", "text_hash")
    base = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "n_words", "text_hash", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per = []
            for found in tx.column(batch, "found").to_pylist():
                if not found:
                    per.append(([], [], []))
                    continue
                s, e = _merged(np.concatenate([f["hit_start"] for f in found]), np.concatenate([f["hit_end"] for f in found]))
                per.append((sorted({i for f in found for i in f["item_ids"]}), s.tolist(), e.tolist()))
            made = _rows(tx.column(batch, "doc_id"), tx.column(batch, "n_words").to_numpy(), per)
            yield made.append_column("text_hash", tx.column(batch, "text_hash"))

    return base.mapInArrow(run, SCHEMA + ", text_hash long")


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all their columns as they were."""
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:  # spans of all blocks count together; a verdict holds for equal rows (doc_id and text)
        dirty = _find(docs, blocks).where("contaminated").select("doc_id", "text_hash").distinct()
        return docs.join(dirty, docs["doc_id"].cast("long").eqNullSafe(dirty["doc_id"]) & (F.xxhash64(docs["text"]) == dirty["text_hash"]), "left_anti")
    got = blocks[0].collect()
    shared = docs.sparkSession.sparkContext.broadcast(([r.id for r in got], [r.text for r in got]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Fingerprints(*shared.value)
        for own, buf, off in tx.chunks(batches):
            n_words, per = _found(prints, buf, off)
            n_hit = np.array([sum(e) - sum(s) for _, s, e in per], np.int64)
            yield own.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(run, docs.schema)
