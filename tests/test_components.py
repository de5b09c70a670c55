"""Components and rings: few tables for what is told at once, and joins that broadcast a table of one key."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from terraloom.operators import network
from terraloom.operators.components import components
from terraloom.store import Workspace, measured_broadcasts


def test_stars_need_no_round(spark):
    store = Workspace(spark, "stars")
    links = spark.range(1, 50).select(F.col("id").alias("a"), (F.col("id") % 3 * -1 - 1).alias("b"))
    got = {r.node: r.root for r in components(links, store).collect()}
    assert got == {k: -(k % 3) - 1 for k in range(1, 50)}
    assert store._n == 1


def test_components_as_one_by_one(spark):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000), (3000, 3001), (3001, 3000)]
    home = {k: k for pair in links for k in pair}
    for _ in home:
        for a, b in links:
            home[a] = home[b] = min(home[a], home[b])
    got = [(x.node, x.root) for x in components(spark.createDataFrame(links, "a long, b long"), Workspace(spark, "links")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {k: v for k, v in home.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "links")).collect() == []


def test_places_in_a_ring_take_no_rounds(spark):
    """A ring of 1024 sides: the table to begin with and eleven or twelve of doubling, none to count places."""
    store = Workspace(spark, "ring")
    follows = spark.range(1024).select(((F.col("id") * 5) % 1024).alias("e"), (((F.col("id") + 1) * 5) % 1024).alias("f"))
    got = {r.e: (r.ring, r.place) for r in network.ring_of(follows, store).collect()}
    assert got == {k * 5 % 1024: (0, k) for k in range(1024)}
    assert store._n <= 13


def test_one_key_is_broadcast(spark):
    conf = {"spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        measured_broadcasts(spark)
        frame = spark.range(1000).groupBy(F.when(F.col("id") >= 0, 0).alias("g")).agg(F.max("id").alias("m"))
        rows = spark.range(100000).select(F.when(F.col("id") >= 0, 0).alias("k"), "id").join(frame, F.col("k") == F.col("g"))
        assert len(rows.collect()) == 100000
        plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
