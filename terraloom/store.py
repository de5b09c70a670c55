"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_DIR = "spark.checkpoint.dir"
#: Bytes in an Arrow batch, where the session sets none: a Python worker holds a few batches at a time, however long the rows are.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local master that has none."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {_DIR} to a folder that the driver and all executors share")
    spark.conf.set(_DIR, "file://" + tempfile.mkdtemp(prefix="terraloom-"))
    return spark.conf.get(_DIR)


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches for this session unless it has a bound of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as the session shuffles to, four for each core at least.

    What takes long for each of its few bytes would otherwise stay in the one or two tasks that its bytes ask for. Keys go by a hash of theirs: a shuffle by the keys
    themselves would be left out after a sum by them, whose few tasks stay.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), F.xxhash64(*keys))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as tables of whole groups; a group that goes on in the next batch waits for it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(key)
        begun = pc.index(ids, ids[-1]).as_py()  # where the last group begins
        if held and (begun or held[-1].column(key)[-1] != ids[0]):
            if begun:
                held.append(batch.slice(0, begun))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        elif begun:
            yield pa.Table.from_batches([batch.slice(0, begun)]).combine_chunks()
        held.append(batch.slice(begun))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


#: Rows of results that go back to Spark at once.
OUT_ROWS = 2000


def by_group(rows: DataFrame, key: str, make: Callable[[list[dict]], list[tuple]], out: str) -> DataFrame:
    """``key`` and the columns ``out`` (DDL): the rows, without the key, that ``make`` returns for the rows of each group.

    As a grouped function, but that groups come sorted, very many in an Arrow batch: a call for each group costs a hundredth of one of its own. One group is held at a time.
    """
    kind = rows.schema[key].dataType
    schema = StructType().add(key, kind)
    for field in StructType.fromDDL(out).fields:
        schema.add(field)
    names, arrow = schema.names, to_arrow_schema(schema)

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in made], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        made: list[tuple] = []
        for b in batches:
            for row in b.to_pylist():
                if held and row[key] != held[0][key]:
                    made += [(held[0][key], *r) for r in make(held)]
                    held = []
                    if len(made) >= OUT_ROWS:
                        yield batch(made)
                        made = []
                held.append(row)
        if held:
            made += [(held[0][key], *r) for r in make(held)]
        if made:
            yield batch(made)

    return spread(rows, key).sortWithinPartitions(key).mapInArrow(run, schema)


def measured_broadcasts(spark: SparkSession) -> None:
    """Lets joins of this session broadcast what a shuffle has measured, never what file sizes promise.

    Saved tables and keys that shapes are made from are many times larger in memory than in their compressed files, and the driver holds whatever is broadcast.
    A table of few keys is broadcast as well, though most of its shuffle is empty: as a sorted join all rows of one key would be read by one task.
    """
    spark.conf.set("spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin", "0")
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Files of exchanges go once the action that they were written for has ended; else they stay until the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Workspace:
    """Tables of one call of an operator, under a name of their own.

    ``save`` cuts the lineage: what it returns reads files that survive lost executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: list[DataFrame] = []
        small_batches(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        with tidy(self.spark):
            df.write.option("compression", codec).parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._stored_at = path
        self._saved.append(saved)
        return saved

    def mark(self) -> int:
        """For ``drop_since``."""
        return len(self._saved)

    def drop_since(self, mark: int, *kept: DataFrame) -> None:
        """Deletes what was saved since the mark but for the tables to be kept, from which alone all that comes later must be made."""
        gone = [t for t in self._saved[mark:] if all(t._stored_at != k._stored_at for k in kept)]
        self._saved[mark:] = list(kept)
        self.drop(*gone)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes saved tables; call it once whatever was made from them is saved as well."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
