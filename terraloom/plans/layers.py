"""Layers for tests and queries, derived from the table ``orders``: settlements of 60 boxes each, with partitions, blocks, roads, land use and two outlines.

``WITH`` is the same in DuckDB's SQL, for the oracles. Coordinates are whole metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.store import Workspace, spread

#: Functions of buildings by the last digit of their number.
CODES = ["31001_1000"] * 6 + ["31001_2050", "31001_2723", "31001_2463", "31001_3021"]
#: Land use by class number.
USES = ["AX_IndustrieUndGewerbeflaeche", "AX_Wohnbauflaeche", "AX_FlaecheGemischterNutzung", "AX_Wald"]


def _shaped(df: DataFrame) -> DataFrame:
    """Adds shape, bounds and is_box to a table of boxes."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    d = lambda c: F.col(c).cast("double").alias(c)
    return df.withColumns({"shape": g.box(x1, y1, x2, y2), "bounds": F.struct(d("x1"), d("y1"), d("x2"), d("y2")), "is_box": F.lit(True)})


def turned(layer: DataFrame) -> DataFrame:
    """A layer of polygons by a turn and a stretch, (x, y) to (4x - 3y, 3x + 4y): 25 times the areas, 5 times the lengths, and no side along an axis."""
    ring = lambda r: F.transform(r, lambda p: F.struct((4 * p["x"] - 3 * p["y"]).alias("x"), (3 * p["x"] + 4 * p["y"]).alias("y")))
    layer = layer.withColumn("shape", g.polygon(ring(F.col("shape.shell")), F.transform("shape.holes", ring)))
    return _saved(layer.withColumn("bounds", g.bounds(F.col("shape.shell"))).withColumn("is_box", F.lit(False)))


def _saved(layer: DataFrame) -> DataFrame:
    """A table of its own: else conditions on bounds repeat all that they are made of, several times for each row, in the few tasks that read the keys."""
    return Workspace(layer.sparkSession, "turned").save(layer, "layer")


def turned_lines(lines: DataFrame) -> DataFrame:
    line = F.transform("line", lambda p: F.struct((4 * p["x"] - 3 * p["y"]).alias("x"), (3 * p["x"] + 4 * p["y"]).alias("y")))
    return _saved(lines.withColumn("line", line).withColumn("bounds", g.bounds(F.col("line"))))


def corners(layer: DataFrame) -> DataFrame:
    """Of boxes, L shapes along their lower and left sides, a third of either side wide: their centroids lie at the bend or outside."""
    x1, y1, x2, y2 = (F.col(f"bounds.{c}") for c in ("x1", "y1", "x2", "y2"))
    x3, y3 = x1 + (x2 - x1) / 4, y1 + (y2 - y1) / 4
    rim = F.array(g.point(x1, y1), g.point(x2, y1), g.point(x2, y3), g.point(x3, y3), g.point(x3, y2), g.point(x1, y2), g.point(x1, y1))
    return layer.withColumn("shape", g.polygon(rim)).withColumn("is_box", F.lit(False))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the few bytes of their numbers would stay in one task, and all that is made of them
    s = spread(orders(spark, sf_dir).select(F.expr("k div 60").alias("s")).distinct(), "s")
    return s.select("s", F.expr("(s % 40) * 1500").alias("ox"), F.expr("(s div 40) * 1500").alias("oy"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, s, fkt and the box; column 2 of a settlement touches column 3 and column 7 overlaps column 8 by 2 m."""
    p = spread(orders(spark, sf_dir), "k").withColumns({"s": F.expr("k div 60"), "i": F.expr("k % 60")}).withColumn("c", F.expr("i % 10"))
    p = p.withColumns(
        {
            "x1": F.expr("(s % 40) * 1500 + c * 30 + (k * 7919) % 8"),
            "y1": F.expr("(s div 40) * 1500 + (i div 10) * 30 + (k * 104729) % 8"),
            "nx1": F.expr("(s % 40) * 1500 + (c + 1) * 30 + ((k + 1) * 7919) % 8"),
            "w": F.expr("6 + (k * 31) % 12 + CASE WHEN c < 5 AND s % 2 = 0 THEN 6 ELSE 0 END"),
            "h": F.expr("6 + (k * 17) % 10 + CASE WHEN c < 5 AND s % 2 = 0 THEN 4 ELSE 0 END"),
        }
    )
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("k") % 10 + 1).cast("int"))
    x2 = F.expr("CASE c WHEN 2 THEN nx1 WHEN 7 THEN nx1 + 2 ELSE x1 + w END")
    return _shaped(p.select(F.col("k").alias("fid"), "s", "x1", "y1", x2.alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), code.alias("fkt")))


def hamlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buildings, but that four settlements in five are of sheds alone."""
    return buildings(spark, sf_dir).withColumn("fkt", F.when(F.col("s") % 5 == 0, F.col("fkt")).otherwise("31001_2463"))


def partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(settlements(spark, sf_dir).selectExpr("concat('PART_', s) name", "s", "ox - 600 x1", "oy - 600 y1", "ox + 900 x2", "oy + 900 y2"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = settlements(spark, sf_dir).withColumn("b", F.explode(F.array(*map(F.lit, range(4)))))
    return _shaped(b.selectExpr("s * 4 + b bid", "s", "ox - 3 + 150 * (b % 2) x1", "oy - 3 + 90 * (b div 2) y1", "ox + 147 + 150 * (b % 2) x2", "oy + 87 + 90 * (b div 2) y2"))


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, s, ends, len and bounds: the 12 edges of the lattice of blocks, a spur of 40 m and one of 80 m."""
    r = settlements(spark, sf_dir).withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(13)))).withColumns({"i": F.expr("CASE WHEN e < 6 THEN e % 2 ELSE (e - 6) div 2 END"), "j": F.expr("CASE WHEN e < 6 THEN e div 2 ELSE (e - 6) % 2 END")})
    r = r.selectExpr(
        "s * 14 + e rid",
        "s",
        "CASE WHEN e < 12 THEN ox - 3 + 150 * i WHEN e = 12 THEN ox + 297 ELSE ox - 3 END x1",
        "CASE WHEN e < 12 THEN oy - 3 + 90 * j WHEN e = 12 THEN oy - 3 ELSE oy + 177 END y1",
        "CASE WHEN e < 6 THEN ox - 3 + 150 * (i + 1) WHEN e < 12 THEN ox - 3 + 150 * i WHEN e = 12 THEN ox + 337 ELSE ox - 83 END x2",
        "CASE WHEN e < 6 THEN oy - 3 + 90 * j WHEN e < 12 THEN oy - 3 + 90 * (j + 1) WHEN e = 12 THEN oy - 3 ELSE oy + 177 END y2",
    )
    d = lambda c: c.cast("double")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    span = F.struct(d(F.least(x1, x2)).alias("x1"), d(F.least(y1, y2)).alias("y1"), d(F.greatest(x1, x2)).alias("x2"), d(F.greatest(y1, y2)).alias("y2"))
    return r.withColumns({"len": (F.abs(x2 - x1) + F.abs(y2 - y1)).cast("long"), "line": F.array(g.point(x1, y1), g.point(x2, y2)), "bounds": span})


def crossing_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s and line of the roads and of two slanting ones through each settlement, which cross the others between their ends: no lattice."""
    s = settlements(spark, sf_dir)
    slant = lambda *ends: s.select("s", F.array(g.point(F.expr(ends[0]), F.expr(ends[1])), g.point(F.expr(ends[2]), F.expr(ends[3]))).alias("line"))
    first = slant("ox - 3", "oy - 3", "ox + 297", "oy + 177")
    return roads(spark, sf_dir).select("s", "line").unionByName(first).unionByName(slant("ox - 3", "oy + 10 + s % 30", "ox + 297", "oy + 150 - s % 20"))


def landuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.element_at(F.array(*map(F.lit, USES)), ((F.col("s") + F.col("bid")) % 4 + 1).cast("int"))
    return _shaped(blocks(spark, sf_dir).select("bid", "s", use.alias("objart_txt"), "x1", "y1", (F.col("x2") - 10).alias("x2"), "y2"))


def computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The computed outline."""
    return _shaped(settlements(spark, sf_dir).where("s % 7 <> 0").selectExpr("s fid", "s", "ox - 3 x1", "oy - 3 y1", "ox + 297 x2", "oy + 177 y2"))


def expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expert's outline."""
    return _shaped(settlements(spark, sf_dir).where("s % 11 <> 0").selectExpr("s fid", "s", "ox + 20 + (s % 3) * 60 x1", "oy - 3 y1", "ox + 330 x2", "oy + 177 y2"))


WITH = """WITH RECURSIVE settlements AS (SELECT DISTINCT o_orderkey // 60 AS s, ((o_orderkey // 60) % 40) * 1500 AS ox, ((o_orderkey // 60) // 40) * 1500 AS oy FROM orders),
k0 AS (SELECT o_orderkey AS k, o_orderkey // 60 AS s, o_orderkey % 60 AS i FROM orders),
p0 AS (SELECT k, s, i % 10 AS c, (s % 40) * 1500 + (i % 10) * 30 + (k * 7919) % 8 AS x1, (s // 40) * 1500 + (i // 10) * 30 + (k * 104729) % 8 AS y1,
 (s % 40) * 1500 + (i % 10 + 1) * 30 + ((k + 1) * 7919) % 8 AS nx1, 6 + (k * 31) % 12 + CASE WHEN i % 10 < 5 AND s % 2 = 0 THEN 6 ELSE 0 END AS w,
 6 + (k * 17) % 10 + CASE WHEN i % 10 < 5 AND s % 2 = 0 THEN 4 ELSE 0 END AS h,
 CASE WHEN k % 10 <= 5 THEN '31001_1000' WHEN k % 10 = 6 THEN '31001_2050' WHEN k % 10 = 7 THEN '31001_2723' WHEN k % 10 = 8 THEN '31001_2463' ELSE '31001_3021' END AS fkt FROM k0),
buildings AS (SELECT k AS fid, s, x1, y1, CASE c WHEN 2 THEN nx1 WHEN 7 THEN nx1 + 2 ELSE x1 + w END AS x2, y1 + h AS y2, fkt FROM p0),
hamlets AS (SELECT * REPLACE (CASE WHEN s % 5 = 0 THEN fkt ELSE '31001_2463' END AS fkt) FROM buildings),
partitions AS (SELECT 'PART_' || s AS name, s, ox - 600 AS x1, oy - 600 AS y1, ox + 900 AS x2, oy + 900 AS y2 FROM settlements),
blocks AS (SELECT s * 4 + b AS bid, s, ox - 3 + 150 * (b % 2) AS x1, oy - 3 + 90 * (b // 2) AS y1, ox + 147 + 150 * (b % 2) AS x2, oy + 87 + 90 * (b // 2) AS y2 FROM settlements, (SELECT unnest([0, 1, 2, 3]) AS b)),
r0 AS (SELECT s, ox, oy, e, CASE WHEN e < 6 THEN e % 2 ELSE (e - 6) // 2 END AS i, CASE WHEN e < 6 THEN e // 2 ELSE (e - 6) % 2 END AS j FROM settlements, (SELECT unnest(range(14)) AS e)),
r1 AS (SELECT s * 14 + e AS rid, s, CASE WHEN e < 12 THEN ox - 3 + 150 * i WHEN e = 12 THEN ox + 297 ELSE ox - 3 END AS x1, CASE WHEN e < 12 THEN oy - 3 + 90 * j WHEN e = 12 THEN oy - 3 ELSE oy + 177 END AS y1,
 CASE WHEN e < 6 THEN ox - 3 + 150 * (i + 1) WHEN e < 12 THEN ox - 3 + 150 * i WHEN e = 12 THEN ox + 337 ELSE ox - 83 END AS x2, CASE WHEN e < 6 THEN oy - 3 + 90 * j WHEN e < 12 THEN oy - 3 + 90 * (j + 1) WHEN e = 12 THEN oy - 3 ELSE oy + 177 END AS y2 FROM r0),
roads AS (SELECT *, abs(x2 - x1) + abs(y2 - y1) AS len FROM r1),
crossing AS (SELECT s, x1, y1, x2, y2 FROM roads UNION ALL SELECT s, ox - 3, oy - 3, ox + 297, oy + 177 FROM settlements UNION ALL SELECT s, ox - 3, oy + 10 + s % 30, ox + 297, oy + 150 - s % 20 FROM settlements),
landuse AS (SELECT bid, s, CASE (s + bid) % 4 WHEN 0 THEN 'AX_IndustrieUndGewerbeflaeche' WHEN 1 THEN 'AX_Wohnbauflaeche' WHEN 2 THEN 'AX_FlaecheGemischterNutzung' ELSE 'AX_Wald' END AS objart_txt, x1, y1, x2 - 10 AS x2, y2 FROM blocks),
ugb AS (SELECT s AS fid, s, ox - 3 AS x1, oy - 3 AS y1, ox + 297 AS x2, oy + 177 AS y2 FROM settlements WHERE s % 7 <> 0),
ibs AS (SELECT s AS fid, s, ox + 20 + (s % 3) * 60 AS x1, oy - 3 AS y1, ox + 330 AS x2, oy + 177 AS y2 FROM settlements WHERE s % 11 <> 0)
"""
