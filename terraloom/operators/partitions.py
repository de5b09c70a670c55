"""Partitions as polygons: every cell of the grid goes to the region of its nearest dense cell, and the borders of these regions are traced.

A side between two cells of unlike regions is a border of both. Sides that go on straight are merged, each run finds the one that follows it at its end (turning towards its own region where two of its cells meet at a corner only), and rings
come out of these pointers by doubling (``network.ring_of``). Holes are put into the shells around them. No region, row of cells or ring's surroundings is held in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.operators import density, network, overlay
from terraloom.store import Workspace


def labelled(regions: DataFrame, store: Workspace, cell: float = 150.0, margin: int = 1) -> DataFrame:
    """cx, cy, region of all cells of the rectangle of dense cells and ``margin`` cells around it; ``regions`` come from ``density.partition_cells``."""
    spark = regions.sparkSession
    regions = store.save(regions.select("cx", "cy", "region"), "regions")
    ends = regions.agg(F.min("cx").alias("x1"), F.min("cy").alias("y1"), F.max("cx").alias("x2"), F.max("cy").alias("y2")).first()
    if ends.x1 is None:
        return regions
    rows = spark.range(ends.y1 - margin, ends.y2 + margin + 1).withColumnRenamed("id", "cy")
    grid = rows.select(F.explode(F.sequence(F.lit(ends.x1 - margin), F.lit(ends.x2 + margin))).alias("cx"), "cy")
    grid = store.save(grid.withColumn("n", F.col("cy") * F.lit(1 << 31) + F.col("cx")), "grid")
    points = grid.select("n", ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"))
    return grid.join(density.nearest_region(points, regions, "n", store, cell), "n").select("cx", "cy", "region")


#: Where a cell's bottom, right, top and left sides begin, seen from its lower left corner, and how they run (0 east, 1 north, 2 west, 3 south).
_SIDES = ((0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3))


def border_runs(cells: DataFrame) -> DataFrame:
    """region, way, x1, y1, x2, y2 (in cells): straight stretches of the regions' borders with the region on the left."""
    side = lambda x, y, way: F.struct((F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y"), F.lit(way).alias("way"))
    s = cells.select("region", F.explode(F.array(*(side(*d) for d in _SIDES))).alias("s")).select("region", "s.*")
    # the same side from both cells: its lower left end, and whether it lies flat
    s = s.withColumns({"sx": F.col("x") - F.when(F.col("way") == 2, 1).otherwise(0), "sy": F.col("y") - F.when(F.col("way") == 3, 1).otherwise(0), "flat": F.col("way") % 2 == 0})
    both = s.groupBy("sx", "sy", "flat").agg(F.min(F.struct("region", "x", "y", "way")).alias("a"), F.max(F.struct("region", "x", "y", "way")).alias("b"), F.count("*").alias("n"))
    both = both.where("n = 1 or a.region <> b.region")
    one = both.select(F.explode(F.when(F.col("n") == 1, F.array("a")).otherwise(F.array("a", "b"))).alias("e"), "sx", "sy", "flat").select("e.region", "e.way", F.when(F.col("flat"), F.col("sy")).otherwise(F.col("sx")).alias("line"), F.when(F.col("flat"), F.col("sx")).otherwise(F.col("sy")).alias("k"))
    along = Window.partitionBy("region", "way", "line").orderBy("k")
    runs = one.withColumn("run", F.col("k") - F.row_number().over(along)).groupBy("region", "way", "line", "run").agg(F.min("k").alias("lo"), (F.max("k") + 1).alias("hi"))
    forth = F.col("way") < 2
    begin, end = F.when(forth, F.col("lo")).otherwise(F.col("hi")), F.when(forth, F.col("hi")).otherwise(F.col("lo"))
    flat = F.col("way") % 2 == 0
    at = lambda k, x: F.when(flat == F.lit(x), k).otherwise(F.col("line"))
    return runs.select("region", "way", at(begin, True).alias("x1"), at(begin, False).alias("y1"), at(end, True).alias("x2"), at(end, False).alias("y2"))


def polygons(cells: DataFrame, store: Workspace, cell: float = 150.0) -> DataFrame:
    """region, ring, shape, bounds and name of the parts of each region of labelled ``cells``; together they fill the rectangle without gaps. Names count from PART_1 on by their lower left corners."""
    runs = store.save(border_runs(cells).withColumn("e", F.monotonically_increasing_id()), "runs")
    after = runs.select("region", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("way").alias("__way"), F.col("e").alias("f"))
    # left first, then right; straight on it would be one run
    follows = runs.join(after, ["region", "x2", "y2"]).groupBy("e").agg(F.min_by("f", F.pmod(F.col("way") + 1 - F.col("__way"), F.lit(4))).alias("f"))
    walked = runs.join(network.ring_of(store.save(follows, "follows"), store), "e")
    start = F.struct("place", g.point(F.col("x1") * cell, F.col("y1") * cell).alias("p"))
    line = F.transform(F.array_sort(F.collect_list(start)), lambda s: s["p"])
    rings = walked.groupBy("region", "ring").agg(line.alias("line")).withColumn("line", F.concat("line", F.slice("line", 1, 1)))
    shaped = network.nested(rings.withColumn("area", g.ring_area(F.col("line"))), "region", store, tile=20 * cell)
    return overlay.named(shaped.withColumn("bounds", g.bounds(F.col("shape.shell"))), "PART_", store)


def border_lines(cells: DataFrame, cell: float = 150.0) -> DataFrame:
    """region, line, bounds: the straight stretches of borders between two regions, each once for either, as lines."""
    low, high = (lambda c: F.least(f"{c}1", f"{c}2") * cell), (lambda c: F.greatest(f"{c}1", f"{c}2") * cell)
    span = F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))
    return border_runs(cells).select("region", F.array(g.point(F.col("x1") * cell, F.col("y1") * cell), g.point(F.col("x2") * cell, F.col("y2") * cell)).alias("line"), span.alias("bounds"))
