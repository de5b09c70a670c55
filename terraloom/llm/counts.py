"""Token counts of documents in flat token files without an index, by separator scan.

A flat file is a stream of token ids in which an end-of-document id closes every document. It is read in blocks of
a fixed number of ids, cut without regard to documents. Each block is searched for the separator as one vector; that gives
its documents' lengths but for the first, which may have begun earlier, and the rest behind the last separator. A prefix scan over the
blocks of a file carries such rests on to the block in which the document closes: rests since the last block with a separator add up.

A document's count holds its separator. What follows a file's last separator is an open document: ``closed`` is false and the
count has no separator. Two separators in a row are an empty document of 1 id; files without ids have no documents.

``write_flat`` makes such files from a table of texts (null: empty) with a byte-level tokenizer whose special tokens, where a text spells them, are
ordinary text, so that only real separators carry the id. It also lists the doc_ids of each file in order; repeated and null doc_ids count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as tx
from ._encode import default_tokenizer, encoder
from ._store import Workspace

END_OF_TEXT = 50256
BLOCK_IDS = 1 << 20
FILE_SCHEMA = "file string, block long, width int, ids binary, doc_ids array<bigint>"
_ARROW = pa.schema([("file", pa.string()), ("block", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def write_flat(docs: DataFrame, store: Workspace, tokenizer: str | None = None, end_id: int = END_OF_TEXT, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One file per partition of ``docs``: rows with ``ids`` are its blocks, rows with ``doc_ids`` its documents in order."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, plain_specials=True)
        width = 2 if max(encode.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name, block, order = f"{TaskContext.get().partitionId():09d}", 0, 0
        rest = np.zeros(0, f"<u{width}")
        for own, buf, off in tx.chunks(batches, limit=1 << 20):
            ids, at = encode(buf, off)
            rest = np.concatenate([rest, np.insert(ids, at[1:], end_id).astype(rest.dtype)])
            yield pa.RecordBatch.from_pylist([{"file": name, "block": order, "doc_ids": tx.column(own, "doc_id").to_pylist()}], _ARROW)
            order += 1
            while len(rest) >= block_ids:
                yield pa.RecordBatch.from_pylist([{"file": name, "block": block, "width": width, "ids": rest[:block_ids].tobytes()}], _ARROW)
                block, rest = block + 1, rest[block_ids:]
        if len(rest):
            yield pa.RecordBatch.from_pylist([{"file": name, "block": block, "width": width, "ids": rest.tobytes()}], _ARROW)

    return store.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FILE_SCHEMA), "flat")


def read_flat(spark: SparkSession, path: str, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of raw files of little-endian ids, wherever Spark reads; a file is its path.

    Spark hands a whole file over as one value, so a file must be under 2 GB; larger ones have to be split at any multiple of the width.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(tx.column(batch, "path"), tx.column(batch, "content"), strict=True):
                data = memoryview(content.as_buffer())
                for k, at in enumerate(range(0, len(data), width * block_ids)):
                    yield pa.RecordBatch.from_pylist([{"file": name.as_py(), "block": k, "width": width, "ids": bytes(data[at : at + width * block_ids])}], _ARROW)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, FILE_SCHEMA)


def _scan(blocks: DataFrame, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, width, ids in zip(*(tx.column(batch, c) for c in ("file", "block", "width", "ids")), strict=True):
                stream = np.frombuffer(ids.as_buffer(), f"<u{width.as_py()}")
                at = np.flatnonzero(stream == end_id)
                lens = np.diff(at, prepend=-1)
                rest = len(stream) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()], pa.string()), pa.array([block.as_py()], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([rest], pa.int64()), pa.array([lens.tolist()], pa.list_(pa.int64()))], ["file", "block", "n_ends", "rest", "lens"])

    return blocks.where("ids is not null").select("file", "block", "width", "ids").mapInArrow(run, "file string, block long, n_ends long, rest long, lens array<bigint>")


def count(blocks: DataFrame, end_id: int = END_OF_TEXT) -> DataFrame:
    """file, ordinal (of the document in its file, from 0), n_tokens, closed.

    Windows hold a row of four numbers for each block of a file; the lengths of documents join it afterwards.
    """
    scanned = Workspace(blocks.sparkSession, "counts").save(_scan(blocks, end_id), "scan")
    found = scanned.drop("lens")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    # blocks of equal ordinal hold no separator until the last of them; the block that began the run leaves its own rest
    found = found.withColumn("run", F.coalesce(F.max(F.when(F.col("n_ends") > 0, F.col("block"))).over(before), F.lit(-1)))
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = found.where("n_ends > 0").select(F.col("file").alias("f"), F.col("block").alias("b"), F.col("rest").alias("opening"))
    found = found.join(opened, (F.col("file") == F.col("f")) & (F.col("run") == F.col("b")), "left").drop("f", "b")
    found = found.withColumn("carried", F.coalesce("opening", F.lit(0)) + F.coalesce(F.sum(F.when(F.col("n_ends") == 0, F.col("rest"))).over(since), F.lit(0)))
    lens = scanned.where("n_ends > 0").select(F.col("file").alias("lf"), F.col("block").alias("lb"), "lens")
    closed = found.where("n_ends > 0").join(lens, (F.col("file") == F.col("lf")) & (F.col("block") == F.col("lb"))).select("file", "ordinal", "carried", F.posexplode("lens").alias("k", "n"))
    closed = closed.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), F.when(F.col("k") == 0, F.col("n") + F.col("carried")).otherwise(F.col("n")).alias("n_tokens"), F.lit(True).alias("closed"))
    tail = found.groupBy("file").agg(F.max(F.struct("block", "n_ends", "rest", "ordinal", "carried")).alias("t"))
    tail = tail.select("file", (F.col("t.ordinal") + F.col("t.n_ends")).alias("ordinal"), F.when(F.col("t.n_ends") > 0, F.col("t.rest")).otherwise(F.col("t.rest") + F.col("t.carried")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail.where("n_tokens > 0"))


def listed(blocks: DataFrame) -> DataFrame:
    """file, ordinal, doc_id of each document that ``write_flat`` wrote."""
    lists = blocks.where("doc_ids is not null").select("file", "block", "doc_ids")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lists = lists.withColumn("first", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0)))
    return lists.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).cast("long").alias("ordinal"), "doc_id")


def count_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_OF_TEXT, block_ids: int = BLOCK_IDS) -> DataFrame:
    """doc_id, n_tokens (with the separator) of every row of ``docs``, counted in flat files of its tokens."""
    blocks = write_flat(docs, Workspace(docs.sparkSession, "flat"), tokenizer, end_id, block_ids)
    return listed(blocks).join(count(blocks, end_id), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "n_tokens")
