"""Token ids in binary shards, each with a minimal perfect hash index of its documents.

Documents go by ascending doc_id (null first; rows of one doc_id by a hash of their text) through a range
exchange, are encoded, closed by an end id, and packed into shards of about ``SHARD_IDS`` ids. A document
is never cut. A shard is one row of a Parquet table, so that executors need no folder but the shared one:

* ``part``, ``seq``: number of the range and of the shard in it; ascending doc_id order is (part, seq)
* ``start``: ids of the range before the shard; ``n_ids``; ``low``, ``high``: least and greatest doc_id
* ``doc_ids``: in stored order; rows of one doc_id are its occurrences 0, 1, ...; ``first``: the occurrence with which the shard begins
* ``width``: 2 or 4 bytes an id, little-endian; ``ids``: the payload
* ``index``: see ``Index``

``Index`` maps (doc_id, occurrence) to a place in the shard without holding any key: levels of bit
arrays in which a key's bit is set where it alone falls; the keys that collide go on to the next level. The number of set bits before a key's bit is its
slot, which holds a 32-bit fingerprint and the document's number. A foreign key meets a wrong fingerprint but for 1 in 2**32. ``get`` finds
the one shard by its range of doc_ids, which Parquet's statistics prune, and one place by the index.

Null and empty texts are stored as the end id alone. An empty table makes an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._encode import default_tokenizer, encoder
from ._store import Workspace

SHARD_IDS = 1 << 20
END_ID = 0
SCHEMA = "part int, seq int, start long, n_ids long, low long, high long, first long, doc_ids array<bigint>, width int, ids binary, index binary"
_LEVELS = 40


def key_of(doc_id: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    return tx.splitmix(tx.splitmix(doc_id.astype(np.int64).view(tx.U) + tx.U(0x9E3779B97F4A7C15)) ^ (occurrence.astype(tx.U) * tx.U(0xC2B2AE3D27D4EB4F)))


def _bit(keys: np.ndarray, salt: int, level: int, size: int) -> np.ndarray:
    mixed = tx.splitmix(keys ^ tx.splitmix(np.array([salt * 64 + level + 1], tx.U)))
    return (((mixed >> tx.U(32)) * tx.U(size)) >> tx.U(32)).astype(np.int64)


class Index:
    """Minimal perfect hash of distinct 64-bit keys, with a fingerprint and a value for each."""

    def __init__(self, salt: int, levels: list[np.ndarray], prints: np.ndarray, values: np.ndarray):
        self.salt, self.levels, self.prints, self.values = salt, levels, prints, values
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits) - bits)
            before += int(bits.sum())

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (tx.splitmix(keys + tx.U(0x632BE59BD9B4E019)) >> tx.U(32)).astype(np.uint32)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Index:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two documents of a shard have one key")
        for salt in range(1 << 20):
            left, levels = keys, []
            while len(left) and len(levels) < _LEVELS:
                size = max(64, 2 * len(left))
                at = _bit(left, salt, len(levels), size)
                bits = np.bincount(at, minlength=size) == 1
                levels.append(bits)
                left = left[~bits[at]]
            if not len(left):
                break
        out = cls(salt, levels, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        slot = out._slot(keys)
        out.prints[slot], out.values[slot] = cls._print(keys), values
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slot = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = _bit(keys[open_], self.salt, level, len(bits))
            hit = bits[at]
            slot[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return slot

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 for keys whose fingerprint isn't there."""
        slot = self._slot(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == self._print(keys[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.values[slot[ok]]
        return out

    def dump(self) -> bytes:
        head = np.array([self.salt, len(self.prints), len(self.levels), *map(len, self.levels)], "<u4")
        return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in self.levels), self.prints.astype("<u4").tobytes(), self.values.astype("<u4").tobytes()])

    @classmethod
    def load(cls, data: bytes) -> Index:
        salt, n, count = np.frombuffer(data, "<u4", 3).tolist()
        sizes = np.frombuffer(data, "<u4", count, 12).tolist()
        at, levels = 12 + 4 * count, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, -(-size // 8), at), count=size).astype(bool))
            at += -(-size // 8)
        return cls(salt, levels, np.frombuffer(data, "<u4", n, at), np.frombuffer(data, "<u4", n, at + 4 * n))


def _occurrences(ids: list[int | None], last: tuple[int | None, int]) -> tuple[np.ndarray, tuple[int | None, int]]:
    """Numbers equal neighbours from 0; last: the doc_id before and its number (-1: none)."""
    n = len(ids)
    same = np.array([False] + [ids[k] == ids[k - 1] for k in range(1, n)])
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    out = np.arange(n) - begin
    if last[1] >= 0 and ids[0] == last[0]:
        out[: n if same[1:].all() else int(np.flatnonzero(~same)[1])] += last[1] + 1
    return out, (ids[-1], int(out[-1]))


def write(docs: DataFrame, store: Workspace, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards and returns the table that reads them."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, seq, start, last = TaskContext.get().partitionId(), 0, 0, (None, -1)
        held: list[np.ndarray] = []
        lens: list[int] = []
        doc_ids: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, start, last, size
            occurrence, last = _occurrences(doc_ids, last)
            n = np.array(lens, np.int64)
            keys = key_of(np.array([0 if d is None else d for d in doc_ids], np.int64), occurrence + np.array([d is None for d in doc_ids]) * (1 << 40))
            index = Index.build(keys, np.arange(len(n)))
            known = [d for d in doc_ids if d is not None]
            out = {"part": part, "seq": seq, "start": start, "n_ids": size, "low": min(known, default=None), "high": max(known, default=None), "first": int(occurrence[0]), "doc_ids": doc_ids, "width": width, "ids": np.concatenate(held).astype(f"<u{width}").tobytes(), "index": n.astype("<u4").tobytes() + index.dump()}
            seq, start, size = seq + 1, start + size, 0
            batch = pa.RecordBatch.from_pylist([out], _ARROW)
            held.clear(), lens.clear(), doc_ids.clear()
            return batch

        for own, buf, off in tx.chunks(batches, limit=1 << 20):
            ids, at = encode(buf, off)
            for k, d in enumerate(tx.column(own, "doc_id").to_pylist()):
                held.append(np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
                lens.append(len(held[-1]))
                doc_ids.append(d)
                size += lens[-1]
                if size >= shard_ids:
                    yield shard()
        if doc_ids:
            yield shard()

    return store.save(ordered.mapInArrow(run, SCHEMA), "shards")


_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("index", pa.binary())])


class Shard:
    """A shard as read back."""

    def __init__(self, n_docs: int, width: int, ids: bytes, index: bytes):
        self.lens = np.frombuffer(index, "<u4", n_docs).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.lens))
        self.index = Index.load(index[4 * n_docs :])
        self.ids = np.frombuffer(ids, f"<u{width}")

    def find(self, doc_ids: list[int | None], occurrence: np.ndarray) -> np.ndarray:
        null = np.array([d is None for d in doc_ids], np.int64)
        return self.index(key_of(np.array([0 if d is None else d for d in doc_ids], np.int64), occurrence + null * (1 << 40)))

    def tokens(self, place: int) -> np.ndarray:
        return self.ids[self.at[place] : self.at[place + 1]]


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, occurrence, part, offset (in the part), n_tokens, ids_crc32, each found by its key in the shard's index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids = row["doc_ids"]
                shard = Shard(len(doc_ids), row["width"], row["ids"], row["index"])
                occurrence, _ = _occurrences(doc_ids, (doc_ids[0], row["first"] - 1))
                place = shard.find(doc_ids, occurrence)
                if (place < 0).any():
                    raise ValueError("a stored document is missing from its shard's index")
                tokens = [shard.tokens(p) for p in place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(occurrence, pa.int64()), pa.array([row["part"]] * len(place), pa.int32()), pa.array(row["start"] + shard.at[place]), pa.array([len(t) for t in tokens], pa.int64()), pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64())],
                    ["doc_id", "occurrence", "part", "offset", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "start", "first", "doc_ids", "width", "ids", "index").mapInArrow(run, "doc_id long, occurrence long, part int, offset long, n_tokens long, ids_crc32 long")


def starts(shards: DataFrame) -> DataFrame:
    """part and base: ids in all parts before it."""
    total = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return total.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digest(shards: DataFrame, occurrences: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, and which of its doc_id's it is if asked for."""
    rows, base = documents(shards), starts(shards)
    rows = rows.join(base, rows["part"] == base["of"])
    return rows.select("doc_id", *["occurrence"] * occurrences, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def get(shards: DataFrame, doc_id: int, occurrence: int = 0) -> np.ndarray | None:
    """The ids of one document, or None."""
    for row in shards.where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).select("doc_ids", "width", "ids", "index").toLocalIterator():
        shard = Shard(len(row["doc_ids"]), row["width"], bytes(row["ids"]), bytes(row["index"]))
        place = int(shard.find([doc_id], np.array([occurrence]))[0])
        if place >= 0:
            return shard.tokens(place)
    return None


def encode_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, occurrences: bool = False) -> DataFrame:
    """Writes ``docs`` and reads it back as ``digest``."""
    spark: SparkSession = docs.sparkSession
    return digest(write(docs, Workspace(spark, "tokens"), tokenizer, end_id, shard_ids), occurrences)
