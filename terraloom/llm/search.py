"""Ranked lexical search of many items at once, as a blocked sparse matrix product.

Terms are maximal runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. With N documents that hold a term, L terms in all of them, n terms in one document, df
documents with a term and tf its occurrences in a document, a term weighs w = floor(1000 * ln((2N + 2) / (2df + 1))), and its impact on a document is the whole number
w * ((10**9 * tf) div (1000 * tf + 8 * m)) with m = 10 + (90 * n * N) div L. An item's scores are its row of the item-term matrix (1 for each term, or its multiplicity) times the term-document matrix of impacts, in 64-bit integers.

Items are packed into blocks of at most ``BLOCK_TERMS`` terms, and every block meets all documents in two passes: the first reads the texts, keeps the terms of the block as
the rows of small term-document matrices (one for each Arrow batch of documents) and saves these; sums of their row lengths are the df. The second multiplies:
an item's row is the merger of the rows of its terms, added into one dense row of a batch's documents (Gustavson), a bounded number of products at a time. Each task keeps the k best of each item over all
its batches, so what is exchanged is k rows for each item and task. The driver holds one block's terms and weights at a time and frees its broadcast.

Equal scores go by ascending doc_id, null last. Null and empty texts hold no term; documents without terms count nowhere, items without terms and items that no document shares a term with have no rows.
Every row of ``items`` is an item of its own, with ranks of its own, also if another row has the same item_id. Repeated document rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._store import Workspace
from .decontaminate import WORD

#: Terms of a block of items; a longer item is a block by itself.
BLOCK_TERMS = 1 << 18
#: Cells of the dense rows that are filled together, and products that are added at once.
CELLS, PRODUCTS = 1 << 20, 1 << 20
TOP = 10

_BLOCK = "docs array<long>, n array<long>, term array<int>, held array<int>, doc array<int>, tf array<int>"
_LISTS = ("docs", "n", "term", "held", "doc", "tf")


def _terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the number of the first term of each text."""
    words = tx.words(buf, off, WORD)
    return (tx.Rolling(buf, tx.LOWER)(words.start, words.end) if len(words.start) else np.zeros(0, tx.U)), words.first


def _counted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, times) of distinct pairs, by owner and hash."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    at = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return owner[at], hashes[at], np.diff(np.append(at, len(hashes)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _pack(items: DataFrame, store: Workspace, repeats: bool) -> DataFrame:
    """Blocks of items: rows (item numbers), ptr, hash and times of each item's terms; saved."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // (4 * BLOCK_TERMS)

    def block(rows: list[np.ndarray], n: list[np.ndarray], hashes: list[np.ndarray], times: list[np.ndarray]) -> pa.RecordBatch:
        flat = [np.concatenate(x) for x in (rows, n, hashes, times)]
        return pa.RecordBatch.from_pylist([{"rows": flat[0], "n": flat[1], "hash": flat[2].view(np.int64), "times": flat[3]}], pa.schema([(c, pa.list_(pa.int64())) for c in ("rows", "n", "hash", "times")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, buf, off in tx.chunks(batches, limit=4 * BLOCK_TERMS):
            hashes, first = _terms(buf, off)
            owner, hashes, times = _counted(hashes, np.repeat(np.arange(len(first) - 1), np.diff(first)))
            n = np.bincount(owner, minlength=len(first) - 1)
            if size and size + len(hashes) > BLOCK_TERMS:
                yield block(*zip(*held, strict=True))
                held, size = [], 0
            held.append((tx.column(rows, "item_no").to_numpy(), n, hashes, times if repeats else np.ones(len(times), np.int64)))
            size += len(hashes)
        if size:
            yield block(*zip(*held, strict=True))

    packed = items.repartition(parts).mapInArrow(run, "rows array<long>, n array<long>, hash array<long>, times array<long>")
    return store.save(packed.withColumn("block", F.monotonically_increasing_id()), "items")


def _index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The term-document matrix of each batch of documents, in rows of the vocabulary's terms: term, held (documents of each), doc (number in the batch) and tf, with doc_ids and n of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows, buf, off in tx.chunks(batches, limit=8 * tx.CHUNK):
            hashes, first = _terms(buf, off)
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            met = known[at] == hashes
            term, doc, tf = _counted(owner[met], at[met])
            new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
            out = {"docs": tx.column(rows, "doc_id"), "n": np.diff(first), "term": term[new], "held": np.diff(np.append(new, len(term))), "doc": doc, "tf": tf}
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), (x if isinstance(x, pa.Array) else pa.array(x)).cast(pa.int64() if c in ("docs", "n") else pa.int32())) for c, x in out.items()], list(out)
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, _BLOCK)


class _Best:
    """The k best (score, doc) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        parts = [np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null))]
        order = np.lexsort((parts[2], parts[3], -parts[1], parts[0]))
        parts = [x[order] for x in parts]
        at = np.flatnonzero(np.append(True, parts[0][1:] != parts[0][:-1])) if len(order) else np.zeros(0, np.int64)
        rank = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
        last = rank == self.k - 1
        self.floor[parts[0][last]] = parts[1][last]
        self.item, self.score, self.doc, self.null = (x[rank < self.k] for x in parts)


def _merge_rows(lo: int, hi: int, ptr: np.ndarray, slot: np.ndarray, times: np.ndarray, start: np.ndarray, held: np.ndarray, doc: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
    """Rows lo to hi of the product with one batch's matrix, dense; ``slot`` is the place of an item's term among the batch's rows, or -1."""
    at = np.arange(ptr[lo], ptr[hi])
    row = np.repeat(np.arange(hi - lo), np.diff(ptr[lo : hi + 1]))
    met = slot[at] >= 0
    at, row = at[met], row[met]
    out = np.zeros((hi - lo) * width, np.int64)
    many = held[slot[at]]
    ends = np.cumsum(many)
    p = 0
    while p < len(at):
        e = max(p + 1, int(np.searchsorted(ends, (ends[p - 1] if p else 0) + PRODUCTS, "right")))
        s, m = slot[at[p:e]], many[p:e]
        cells = _ranges(start[s], m)
        np.add.at(out, np.repeat(row[p:e] * width, m) + doc[cells], np.repeat(times[at[p:e]], m) * impact[cells])
        p = e
    return out.reshape(hi - lo, width)


def _multiply(index: DataFrame, ptr: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (row of the block), doc_id, score: the k best of each item in each task."""
    shared = index.sparkSession.sparkContext.broadcast((ptr, term, times, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ptr, term, times, weight = shared.value
        best = _Best(len(ptr) - 1, k)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n, own, held, doc, tf = (tx.column(batch, c)[r].values for c in _LISTS)
                null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                own, held, doc, tf = (x.to_numpy().astype(np.int64) for x in (own, held, doc, tf))
                if not len(own):
                    continue
                place = np.full(len(weight), -1, np.int64)
                place[own] = np.arange(len(own))
                m = 10 + 90 * n.to_numpy() * n_docs // n_terms
                impact = np.repeat(weight[own], held) * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                start, slot, width = np.cumsum(held) - held, place[term], len(ids)
                some = max(1, CELLS // width)
                for lo in range(0, len(ptr) - 1, some):
                    hi = min(lo + some, len(ptr) - 1)
                    scores = _merge_rows(lo, hi, ptr, slot, times, start, held, doc, impact, width)
                    least = best.floor[lo:hi].copy()
                    if width > k:
                        least = np.maximum(least, np.partition(scores, width - k, axis=1)[:, width - k])
                    row, at = np.nonzero(scores >= least[:, None])
                    if len(row):
                        best.add(row + lo, scores[row, at], ids[at], null[at])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def top(docs: DataFrame, items: DataFrame, k: int = TOP, repeats: bool = False) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of ``docs`` for each row of ``items``; ``repeats`` counts a term as often as an item says it."""
    spark = docs.sparkSession
    store = Workspace(spark, "search")
    numbered = store.save(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("item_no", F.monotonically_increasing_id()), "numbered")
    blocks = _pack(numbered.select("item_no", "text"), store, repeats)
    found = []
    for key in [r.block for r in blocks.select("block").collect()]:
        block = blocks.where(F.col("block") == key).first()
        ptr = np.append(0, np.cumsum(np.array(block.n, np.int64)))
        vocabulary, term = np.unique(np.array(block.hash, np.int64).view(tx.U), return_inverse=True)
        index = store.save(_index(docs, vocabulary), "index")
        total = index.agg(F.sum(F.size(F.filter("n", lambda x: x > 0))).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
        if not total.terms:
            continue
        rows = index.select(F.explode(F.arrays_zip("term", "held")).alias("x")).groupBy("x.term").agg(F.sum("x.held").alias("df")).toArrow()
        df = np.zeros(len(vocabulary), np.int64)
        df[rows["term"].to_numpy()] = rows["df"].to_numpy()
        weight = np.floor(1000 * np.log((2.0 * total.docs + 2) / (2.0 * df + 1))).astype(np.int64)
        cut = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = _multiply(index, ptr, term.astype(np.int64), np.array(block.times, np.int64), weight, total.docs, total.terms, k).withColumn("rank", F.row_number().over(cut)).where(F.col("rank") <= k)
        number = blocks.where(F.col("block") == key).select(F.posexplode("rows").alias("item", "item_no"))
        found.append(store.save(best.join(number, "item").select("item_no", "rank", "doc_id", "score"), "best"))
        store.drop(index)
    if not found:
        return numbered.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, found).join(numbered.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
