"""Connected components of links, by alternating large and small stars.

Each round hangs neighbours on their least neighbour; the edges end as stars around the least node of every component. Every step is a sum by
key and a join on it; sums are tables of their own before the join, so a node with very many links is split by the engine like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.store import Workspace, tidy


def _stars(edges: DataFrame) -> bool:
    """Whether every node that hangs on another hangs on one alone, which hangs on none: a round more would change nothing."""
    ends = edges.select("u", "v", F.lit(False).alias("held")).unionByName(edges.select(F.col("v").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("held")))
    node = ends.groupBy("u").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("held").alias("held"))
    with tidy(edges.sparkSession):
        return node.where("lo <> hi or lo is not null and held").isEmpty()


def components(links: DataFrame, store: Workspace) -> DataFrame:
    """node, root of every node that has a link to another; ``links`` has two long columns. Root is the component's least node."""
    a, b = links.columns
    edges = store.save(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("of")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        large = store.save(large, "large")
        store.drop(least)
        least = store.save(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of"), "least")
        near = large.join(least, F.col("u") == F.col("of"))
        small = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v")))
        small = store.save(small.distinct(), "small")
        store.drop(edges, large, least)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
