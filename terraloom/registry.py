"""Registered queries of the engine on the derived layers, and DuckDB SQL with the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.operators import classify, coverage, density, graph, joints, network, overlay, partitions, refine, roads, selection, triangulation
from terraloom.operators import spatial_join as sj
from terraloom.plans import delineation, layers
from terraloom.sources import layers as io
from terraloom.store import Workspace, measured_broadcasts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_KEYS = ["fid", "bounds", "shape", "is_box"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            measured_broadcasts(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = layers.WITH + sql
        return run

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_blocks(spark, sf_dir)


# ---- measures and filters


@query("SELECT fid, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area, CAST(2 * (x2 - x1 + y2 - y1) AS DOUBLE) AS perimeter FROM buildings")
def building_area_perimeter(spark, sf_dir):
    return layers.buildings(spark, sf_dir).select("fid", g.area(F.col("shape")).alias("area"), g.perimeter(F.col("shape")).alias("perimeter"))


@query("SELECT fid, round(2 * (x2 - x1 + y2 - y1) / (2 * sqrt(pi() * (x2 - x1) * (y2 - y1))), 6) AS shp_idx FROM buildings WHERE 2 * (x2 - x1 + y2 - y1) / (2 * sqrt(pi() * (x2 - x1) * (y2 - y1))) >= 1.13")
def roundness_filter(spark, sf_dir):
    return selection.not_round(layers.buildings(spark, sf_dir), 1.13).select("fid", F.round("shp_idx", 6).alias("shp_idx"))


_IN = ", ".join(f"'{c}'" for c in delineation.POSITIVE)


@query(f"SELECT fid, fkt FROM buildings WHERE fkt IN ({_IN})")
def function_code_filter_pos(spark, sf_dir):
    return selection.with_codes(layers.buildings(spark, sf_dir), delineation.POSITIVE).select("fid", "fkt")


_NOT = ", ".join(f"'{c}'" for c in delineation.NEGATIVE)


@query(f"SELECT fid, fkt FROM buildings WHERE fkt IN ({_NOT})")
def function_code_filter_neg(spark, sf_dir):
    return selection.with_codes(layers.buildings(spark, sf_dir), delineation.NEGATIVE).select("fid", "fkt")


@query("SELECT fid, CAST((x1 + x2) / 2.0 AS DOUBLE) AS x, CAST((y1 + y2) / 2.0 AS DOUBLE) AS y FROM buildings")
def inner_points(spark, sf_dir):
    return density.centres(layers.buildings(spark, sf_dir), "fid").select("fid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT fid, CAST(side AS INTEGER) AS side, CAST(CASE side WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x2 ELSE x1 END AS DOUBLE) AS x1, CAST(CASE side WHEN 0 THEN y1 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y2 END AS DOUBLE) AS y1, CAST(CASE side WHEN 0 THEN x2 WHEN 1 THEN x2 WHEN 2 THEN x1 ELSE x1 END AS DOUBLE) AS x2, CAST(CASE side WHEN 0 THEN y1 WHEN 1 THEN y2 WHEN 2 THEN y2 ELSE y1 END AS DOUBLE) AS y2 FROM buildings, (SELECT unnest([0, 1, 2, 3]) AS side)")
def building_sides(spark, sf_dir):
    s = layers.buildings(spark, sf_dir).select("fid", F.posexplode(g.segments(F.col("shape.shell"))).alias("side", "s"))
    return s.select("fid", "side", "s.x1", "s.y1", "s.x2", "s.y2")


# ---- spatial joins


@query("SELECT name, CAST(nb AS BIGINT) AS n_buildings, CAST(nr AS BIGINT) AS n_roads FROM (SELECT p.name, count(*) AS nb FROM partitions p JOIN buildings b ON b.x1 <= p.x2 AND b.x2 >= p.x1 AND b.y1 <= p.y2 AND b.y2 >= p.y1 GROUP BY p.name) JOIN (SELECT p.name, count(*) AS nr FROM partitions p JOIN roads r ON least(r.x1, r.x2) <= p.x2 AND greatest(r.x1, r.x2) >= p.x1 AND least(r.y1, r.y2) <= p.y2 AND greatest(r.y1, r.y2) >= p.y1 GROUP BY p.name) USING (name) WHERE nb >= 10 AND nr >= 5")
def select_by_partition(spark, sf_dir):
    parts = layers.partitions(spark, sf_dir)
    return delineation.guarded(delineation.assigned(parts, layers.buildings(spark, sf_dir), "fid"), delineation.assigned(parts, layers.roads(spark, sf_dir), "rid"))


@query("SELECT DISTINCT k.bid FROM blocks k JOIN buildings b ON b.x1 >= k.x1 AND b.x2 <= k.x2 AND b.y1 >= k.y1 AND b.y2 <= k.y2")
def block_contains_building(spark, sf_dir):
    b = layers.blocks(spark, sf_dir)
    met = sj.refine(sj.pairs(sj.slim(b, "bid"), sj.slim(layers.buildings(spark, sf_dir), "fid")), "contains")
    return sj.semi(b, met, "bid").select("bid")


@query("SELECT k.bid FROM blocks k WHERE NOT EXISTS (SELECT 1 FROM buildings b WHERE b.fkt = '31001_2463' AND b.x1 >= k.x1 AND b.x2 <= k.x2 AND b.y1 >= k.y1 AND b.y2 <= k.y2)")
def drop_empty_blocks(spark, sf_dir):
    b = layers.blocks(spark, sf_dir)
    some = layers.buildings(spark, sf_dir).where("fkt = '31001_2463'")
    return sj.anti(b, sj.refine(sj.pairs(sj.slim(b, "bid"), sj.slim(some)), "contains"), "bid").select("bid")


@query("SELECT b.fid, k.bid FROM buildings b JOIN blocks k ON b.x1 >= k.x1 AND b.x2 <= k.x2 AND b.y1 >= k.y1 AND b.y2 <= k.y2")
def building_within_block(spark, sf_dir):
    met = sj.pairs(sj.slim(layers.buildings(spark, sf_dir), "fid"), sj.slim(layers.blocks(spark, sf_dir), "bid"))
    return sj.refine(met, "within").select("a.fid", "b.bid")


@query("SELECT k.bid, CAST(count(b.fid) AS BIGINT) AS join_count, min(b.fid) AS join_first FROM blocks k LEFT JOIN buildings b ON b.x1 <= k.x2 AND b.x2 >= k.x1 AND b.y1 <= k.y2 AND b.y2 >= k.y1 GROUP BY k.bid")
def block_building_counts(spark, sf_dir):
    b = layers.blocks(spark, sf_dir)
    met = sj.refine(sj.pairs(sj.slim(b, "bid"), sj.slim(layers.buildings(spark, sf_dir), "fid")))
    return sj.counted(b, met, "bid", "fid").select("bid", "join_count", "join_first")


# ---- coverage

_PIECES = """, piece AS (SELECT k.bid, b.fid, greatest(b.x1, k.x1) AS x1, greatest(b.y1, k.y1) AS y1, least(b.x2, k.x2) AS x2, least(b.y2, k.y2) AS y2 FROM blocks k JOIN buildings b ON b.x1 < k.x2 AND b.x2 > k.x1 AND b.y1 < k.y2 AND b.y2 > k.y1),
twice AS (SELECT a.bid, sum((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS area FROM piece a JOIN piece b ON a.bid = b.bid AND a.fid < b.fid AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY a.bid),
once AS (SELECT bid, sum((x2 - x1) * (y2 - y1)) AS area FROM piece GROUP BY bid),
covered AS (SELECT k.*, CAST((k.x2 - k.x1) * (k.y2 - k.y1) AS DOUBLE) AS shape_area, CAST(coalesce(once.area, 0) - coalesce(twice.area, 0) AS DOUBLE) AS built, CAST(coalesce(once.area, 0) - coalesce(twice.area, 0) AS DOUBLE) / CAST((k.x2 - k.x1) * (k.y2 - k.y1) AS DOUBLE) * 100 AS overlap FROM blocks k LEFT JOIN once USING (bid) LEFT JOIN twice USING (bid))
"""


@query(_PIECES + "SELECT bid, shape_area, built, round(overlap, 6) AS overlap FROM covered")
def block_coverage(spark, sf_dir):
    c = coverage.coverage(layers.blocks(spark, sf_dir), layers.buildings(spark, sf_dir), "bid")
    return c.select("bid", "shape_area", "built", F.round("overlap", 6).alias("overlap"))


@query(_PIECES + "SELECT bid, shape_area, built, round(overlap, 6) AS overlap FROM covered WHERE overlap > 18")
def dense_blocks(spark, sf_dir):
    c = coverage.dense(layers.blocks(spark, sf_dir), layers.buildings(spark, sf_dir), "bid")
    return c.select("bid", "shape_area", "built", F.round("overlap", 6).alias("overlap"))


@query(_PIECES + "SELECT b.fid FROM buildings b WHERE NOT EXISTS (SELECT 1 FROM covered k WHERE k.overlap > 18 AND b.x1 <= k.x2 AND b.x2 >= k.x1 AND b.y1 <= k.y2 AND b.y2 >= k.y1)")
def buildings_outside_dense_blocks(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    dense = coverage.dense(layers.blocks(spark, sf_dir), b, "bid")
    return sj.anti(b, sj.refine(sj.pairs(sj.slim(b, "fid"), sj.slim(dense))), "fid").select("fid")


@query(_PIECES + ", met AS (SELECT k.bid FROM blocks k JOIN buildings b ON b.x1 <= k.x2 AND b.x2 >= k.x1 AND b.y1 <= k.y2 AND b.y2 >= k.y1 GROUP BY k.bid HAVING count(*) > 14) SELECT CAST(count(*) AS BIGINT) AS n_inner, round(sum(overlap) / count(*), 6) AS mean_overlap FROM covered SEMI JOIN met USING (bid)")
def mean_inner_block_coverage(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    inner = coverage.inner_zones(layers.blocks(spark, sf_dir), b, "bid", more_than=14)
    return coverage.mean_coverage(inner, b, "bid").select("n_inner", F.round("mean_overlap", 6).alias("mean_overlap"))


def _corner_houses(spark, sf_dir):
    """A square zone for each settlement, of 136 to 146 m, and houses beyond its corners, in every third settlement one in its middle too."""
    z = layers.settlements(spark, sf_dir).selectExpr("s", "ox", "oy", "136 + (s * 37) % 101 / 10D w")
    zones = layers._shaped(z.selectExpr("s", "ox x1", "oy y1", "ox + w x2", "oy + w y2"))
    at = F.explode(F.expr("concat(array(struct(-4D x, -4D y), struct(-4D x, w y), struct(w x, -4D y), struct(w x, w y)), CASE WHEN s % 3 = 0 THEN array(struct(w / 2 - 2 x, w / 2 - 2 y)) ELSE array() END)"))
    houses = z.select("ox", "oy", at.alias("at")).selectExpr("ox + at.x x1", "oy + at.y y1", "ox + at.x + 4 x2", "oy + at.y + 4 y2")
    return zones, layers._shaped(houses)


@query(", zone AS (SELECT s, 136 + (s * 37) % 101 / 10.0 AS w FROM settlements), inner_ AS (SELECT s FROM zone WHERE s % 3 = 0 OR w / sqrt(2) < 100) SELECT s, t.turned FROM inner_ CROSS JOIN (VALUES (FALSE), (TRUE)) t(turned)")
def inner_zones_to_the_gap(spark, sf_dir):
    """Zones without a point 100 m or further from all houses, as they lie and turned; the others have a gap in their middle, some centimetres to some ten metres wide."""
    zones, houses = _corner_houses(spark, sf_dir)
    plain = coverage.inner_zones(zones, houses, "s", more_than=3)
    turned = coverage.inner_zones(layers.turned(zones), layers.turned(houses), "s", distance=500.0, more_than=3)
    return plain.select("s", F.lit(False).alias("turned")).unionByName(turned.select("s", F.lit(True).alias("turned")))


@query(_PIECES + ", met AS (SELECT k.bid, count(*) AS n FROM blocks k JOIN buildings b ON b.x1 <= k.x2 AND b.x2 >= k.x1 AND b.y1 <= k.y2 AND b.y2 >= k.y1 GROUP BY k.bid) SELECT bid, shape_area, n AS join_count, round(overlap, 6) AS overlap FROM covered JOIN met USING (bid) WHERE n >= 16 AND shape_area >= 10000 OR overlap > 25 AND shape_area >= 10000 AND built >= 3500")
def patch_remove(spark, sf_dir):
    kept = selection.patches_kept(layers.blocks(spark, sf_dir), layers.buildings(spark, sf_dir), "bid", 25.0, 16, 10000.0, 3500.0)
    return kept.select("bid", "shape_area", "join_count", F.round("overlap", 6).alias("overlap"))


# ---- density and partitions

_CELL = "SELECT DISTINCT unnest(range(CAST(floor((x - {r}) / {c}) AS BIGINT) - 1, CAST(floor((x + {r}) / {c}) AS BIGINT) + 2)) AS cx, fid, x, y FROM pt"
_POINTS = ", pt AS (SELECT fid, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y FROM buildings {w})"


def _cells(c: int, r: int, w: str = "") -> str:
    return (
        _POINTS.format(w=w)
        + f", cx AS ({_CELL.format(c=c, r=r)}), cxy AS (SELECT *, unnest(range(CAST(floor((y - {r}) / {c}) AS BIGINT) - 1, CAST(floor((y + {r}) / {c}) AS BIGINT) + 2)) AS cy FROM cx),"
        + f" dense AS (SELECT cx, cy, count(*) AS n FROM cxy WHERE pow((cx + 0.5) * {c} - x, 2) + pow((cy + 0.5) * {c} - y, 2) <= {r * r} GROUP BY cx, cy)"
    )


@query(_cells(50, 100) + " SELECT cx, cy, CAST(n AS BIGINT) AS n, round(n / (pi() * 10000) * 1e6, 6) AS per_km2 FROM dense WHERE n / (pi() * 10000) >= 8.2e-5")
def point_density_cells(spark, sf_dir):
    cells = density.dense_cells(density.centres(layers.buildings(spark, sf_dir)), 50.0, 100.0, 8.2e-5)
    return cells.select("cx", "cy", "n", F.round(F.col("density") * 1e6, 6).alias("per_km2"))


_HALF = math.sqrt(2 * 50 * 50) / 2


@query(
    _cells(50, 100, f"WHERE fkt IN ({_IN})").replace("FROM buildings", "FROM hamlets")
    + f" SELECT b.fid FROM hamlets b WHERE b.fkt IN ({_NOT}) AND NOT EXISTS (SELECT 1 FROM dense d WHERE n / (pi() * 10000) >= 8.2e-5 AND pow(greatest(b.x1 - (cx + 0.5) * 50, 0, (cx + 0.5) * 50 - b.x2), 2) + pow(greatest(b.y1 - (cy + 0.5) * 50, 0, (cy + 0.5) * 50 - b.y2), 2) <= {_HALF * _HALF!r})"
)
def residential_zone_negatives(spark, sf_dir):
    b = layers.hamlets(spark, sf_dir)
    homes = selection.with_codes(b, delineation.POSITIVE)
    cells = density.dense_cells(density.centres(homes), 50.0, 100.0, 8.2e-5)
    return density.outside_dense(selection.with_codes(b, delineation.NEGATIVE), cells, "fid").select("fid")


@query(
    _cells(150, 300)
    + ", d AS (SELECT cx, cy, (cy + 1073741824) * 2147483648 + cx + 1073741824 AS cell FROM dense WHERE n / (pi() * 90000) >= 1e-5), link AS (SELECT a.cell AS u, b.cell AS v FROM d a JOIN d b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),"
    " walk AS (SELECT cell, cell AS root FROM d UNION SELECT link.v, walk.root FROM walk JOIN link ON link.u = walk.cell AND walk.root < link.v) SELECT cx, cy, region FROM d JOIN (SELECT cell, CAST(min(root) AS BIGINT) AS region FROM walk GROUP BY cell) USING (cell)"
)
def partition_cells(spark, sf_dir):
    return density.partition_cells(density.centres(layers.buildings(spark, sf_dir)), Workspace(spark, "partitions"))


_REGIONS = (
    _cells(150, 300)
    + ", d AS (SELECT cx, cy, (cy + 1073741824) * 2147483648 + cx + 1073741824 AS cell FROM dense WHERE n / (pi() * 90000) >= 1e-5), link AS (SELECT a.cell AS u, b.cell AS v FROM d a JOIN d b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),"
    " walk AS (SELECT cell, cell AS root FROM d UNION SELECT link.v, walk.root FROM walk JOIN link ON link.u = walk.cell AND walk.root < link.v), regions AS (SELECT cx, cy, CAST(root AS BIGINT) AS region FROM d JOIN (SELECT cell, min(root) AS root FROM walk GROUP BY cell) USING (cell))"
)


@query(
    _REGIONS
    + ", far AS (SELECT fid + 10000000 * k AS fid, x + 20000 * k AS x, y FROM pt, (SELECT unnest([0, 1]) AS k)), met AS (SELECT fid, region, sqrt(pow(x - (cx + 0.5) * 150, 2) + pow(y - (cy + 0.5) * 150, 2)) AS d FROM far, regions)"
    " SELECT fid, region FROM met QUALIFY row_number() OVER (PARTITION BY fid ORDER BY d, region) = 1"
)
def nearest_partition(spark, sf_dir):
    """Of the buildings, and of points 20 km to the east of each, some of which lie far from any dense cell."""
    store = Workspace(spark, "partitions")
    points = density.centres(layers.buildings(spark, sf_dir), "fid")
    far = points.unionByName(points.select((F.col("fid") + 10000000).alias("fid"), (F.col("x") + 20000).alias("x"), "y"))
    return density.nearest_region(far, density.partition_cells(points, store), "fid", store)


#: The region of each cell by trying all dense ones, and the sides between unlike regions.
_LABELS = (
    _REGIONS
    + """, ends AS (SELECT min(cx) - 1 AS a, max(cx) + 1 AS b, min(cy) - 1 AS c, max(cy) + 1 AS d FROM regions),
grid AS (SELECT cx, unnest(range(c, d + 1)) AS cy FROM (SELECT unnest(range(a, b + 1)) AS cx, c, d FROM ends)),
label AS (SELECT g.cx, g.cy, min({'d': (g.cx - r.cx) * (g.cx - r.cx) + (g.cy - r.cy) * (g.cy - r.cy), 'region': region}).region AS region FROM grid g, regions r GROUP BY g.cx, g.cy),
side AS (SELECT l.region, way, CASE way WHEN 0 THEN l.cy WHEN 1 THEN l.cx + 1 WHEN 2 THEN l.cy + 1 ELSE l.cx END AS line, CASE WHEN way % 2 = 0 THEN l.cx ELSE l.cy END AS k
 FROM label l CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS way) LEFT JOIN label o ON o.cx = l.cx + CASE way WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AND o.cy = l.cy + CASE way WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END WHERE o.region IS DISTINCT FROM l.region)
"""
)


def _cells_of_regions(spark, sf_dir, store):
    dense = density.partition_cells(density.centres(layers.buildings(spark, sf_dir)), store)
    return store.save(partitions.labelled(dense, store), "labelled")


@query(_LABELS + "SELECT region, CAST(22500 * n AS DOUBLE) AS area, CAST(150 * sides AS DOUBLE) AS perimeter FROM (SELECT region, count(*) AS n FROM label GROUP BY region) JOIN (SELECT region, count(*) AS sides FROM side GROUP BY region) USING (region)")
def partition_polygons(spark, sf_dir):
    store = Workspace(spark, "partitions")
    made = partitions.polygons(_cells_of_regions(spark, sf_dir, store), store)
    return made.groupBy("region").agg(F.round(F.sum(g.area(F.col("shape"))), 3).alias("area"), F.round(F.sum(g.perimeter(F.col("shape"))), 3).alias("perimeter"))


@query(
    _LABELS
    + ", run AS (SELECT region, way, line, min(k) AS lo, max(k) + 1 AS hi FROM (SELECT *, k - row_number() OVER (PARTITION BY region, way, line ORDER BY k) AS island FROM side) GROUP BY region, way, line, island)"
    " SELECT CAST(count(*) AS BIGINT) AS n_conflicts FROM run WHERE EXISTS (SELECT 1 FROM ibs i WHERE CASE WHEN way % 2 = 0 THEN lo ELSE line END * 150 <= i.x2 + 600 AND CASE WHEN way % 2 = 0 THEN hi ELSE line END * 150 >= i.x1 - 600 AND CASE WHEN way % 2 = 0 THEN line ELSE lo END * 150 <= i.y2 + 600 AND CASE WHEN way % 2 = 0 THEN line ELSE hi END * 150 >= i.y1 - 600)"
)
def partition_conflicts(spark, sf_dir):
    """Border lines of partitions that meet an expert's outline with 600 m around it; some do and some don't."""
    store = Workspace(spark, "partitions")
    lines = partitions.border_lines(_cells_of_regions(spark, sf_dir, store))
    wide = layers._shaped(layers.expert(spark, sf_dir).selectExpr("fid", "bounds.x1 - 600 x1", "bounds.y1 - 600 y1", "bounds.x2 + 600 x2", "bounds.y2 + 600 y2"))
    return coverage.conflicts(lines.withColumn("rid", F.xxhash64("region", "line")), wide)


_TOUCH = ", hit AS (SELECT a.fid AS u, b.fid AS v FROM buildings a JOIN buildings b ON a.s = b.s AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1 AND a.fid <> b.fid), walk AS (SELECT fid, fid AS root FROM buildings UNION SELECT hit.v, walk.root FROM walk JOIN hit ON hit.u = walk.fid AND walk.root < hit.v), comp AS (SELECT fid, min(root) AS component FROM walk GROUP BY fid)"


@query(_TOUCH + " SELECT fid, component FROM comp")
def touching_components(spark, sf_dir):
    return selection.touching(layers.buildings(spark, sf_dir), "fid", Workspace(spark, "touching"))


@query(
    _TOUCH
    + ", own AS (SELECT b.*, component, (b.x2 - b.x1) * (b.y2 - b.y1) AS area FROM buildings b JOIN comp USING (fid)), both_ AS (SELECT a.component, sum((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS area FROM own a JOIN own b ON a.component = b.component AND a.fid < b.fid AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY 1),"
    " total AS (SELECT component, sum(own.area) - coalesce(max(both_.area), 0) AS area FROM own LEFT JOIN both_ USING (component) GROUP BY component) SELECT fid, CAST(total.area AS DOUBLE) AS dissolved_area FROM own JOIN total USING (component) WHERE total.area >= 56.8 AND own.area >= 35"
)
def small_feature_removal(spark, sf_dir):
    return selection.without_small(layers.buildings(spark, sf_dir), "fid", Workspace(spark, "small")).select("fid", "dissolved_area")


@query(_PIECES + "SELECT b.fid FROM buildings b WHERE (b.x2 - b.x1) * (b.y2 - b.y1) >= 300 AND NOT EXISTS (SELECT 1 FROM covered k WHERE k.overlap > 22 AND b.x1 <= k.x2 AND b.x2 >= k.x1 AND b.y1 <= k.y2 AND b.y2 >= k.y1)")
def large_single_buildings(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    return selection.large_single(b, coverage.dense(layers.blocks(spark, sf_dir), b, "bid", 22.0), "fid").select("fid")


# ---- roads


@query("SELECT x, y, CAST(count(*) AS BIGINT) AS degree FROM (SELECT CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y FROM roads UNION ALL SELECT CAST(x2 AS DOUBLE), CAST(y2 AS DOUBLE) FROM roads) GROUP BY x, y")
def road_endpoint_degree(spark, sf_dir):
    return roads.end_degrees(layers.roads(spark, sf_dir))


@query("SELECT rid, CAST(len AS DOUBLE) AS length FROM roads WHERE rid % 14 = 12")
def dead_end_roads(spark, sf_dir):
    return roads.dead_ends(layers.roads(spark, sf_dir)).select("rid", "length")


@query(
    ", corner AS (SELECT fid, CAST(v AS INTEGER) AS vertex, CASE v WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x2 ELSE x1 END AS x, CASE v WHEN 0 THEN y1 WHEN 1 THEN y1 ELSE y2 END AS y, s FROM buildings, (SELECT unnest([0, 1, 2, 3]) AS v)),"
    " near AS (SELECT fid, vertex, rid, least(greatest(x, least(x1, x2)), greatest(x1, x2)) AS nx, least(greatest(y, least(y1, y2)), greatest(y1, y2)) AS ny, sqrt(pow(x - least(greatest(x, least(x1, x2)), greatest(x1, x2)), 2) + pow(y - least(greatest(y, least(y1, y2)), greatest(y1, y2)), 2)) AS d FROM corner JOIN roads ON corner.s = roads.s)"
    " SELECT fid, vertex, rid, CAST(nx AS DOUBLE) AS near_x, CAST(ny AS DOUBLE) AS near_y, round(d, 6) AS distance FROM near WHERE d < 70 QUALIFY row_number() OVER (PARTITION BY fid, vertex ORDER BY d, rid) = 1"
)
def nearest_road(spark, sf_dir):
    n = roads.nearest_road(layers.buildings(spark, sf_dir), layers.roads(spark, sf_dir), "fid")
    return n.select("fid", "vertex", "rid", F.round("near_x", 6).alias("near_x"), F.round("near_y", 6).alias("near_y"), F.round("distance", 6).alias("distance"))


@query("SELECT bid, 200.0::DOUBLE AS perimeter, CAST(CASE WHEN bid % 2 = 0 THEN 180 ELSE 90 END AS DOUBLE) AS touching, CAST(CASE WHEN bid % 2 = 0 THEN 90 ELSE 45 END AS DOUBLE) AS leng_per FROM blocks")
def gap_contact_ratio(spark, sf_dir):
    strips = layers._shaped(layers.blocks(spark, sf_dir).select("bid", (F.col("x2") - 10).alias("x1"), "y1", "x2", "y2"))
    return roads.contact(strips, layers.landuse(spark, sf_dir), "bid").select("bid", F.round("perimeter", 6).alias("perimeter"), F.round("touching", 6).alias("touching"), F.round("leng_per", 6).alias("leng_per"))


@query("SELECT bid FROM blocks WHERE bid % 2 = 0")
def gap_select(spark, sf_dir):
    strips = layers._shaped(layers.blocks(spark, sf_dir).select("bid", (F.col("x2") - 10).alias("x1"), "y1", "x2", "y2"))
    return roads.gaps_kept(strips, layers.landuse(spark, sf_dir), "bid").select("bid")


# ---- graph


#: For each two buildings of a settlement, from where to where the centres of circles through both lie that hold no third one (see ``triangulation.edges``).
_EDGES = """, pt AS (SELECT fid, s, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM buildings),
third AS (SELECT a.s, a.fid AS u, b.fid AS v, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS d2, (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) AS side, pow(p.x - (a.x + b.x) / 2, 2) + pow(p.y - (a.y + b.y) / 2, 2) AS m2
 FROM pt a JOIN pt b ON a.s = b.s AND a.fid < b.fid LEFT JOIN pt p ON p.s = a.s AND p.fid <> a.fid AND p.fid <> b.fid),
room AS (SELECT s, u, v, any_value(d2) AS d2, max(CASE WHEN side < 0 THEN (m2 - d2 / 4) * sqrt(d2) / (2 * side) END) AS lo, min(CASE WHEN side > 0 THEN (m2 - d2 / 4) * sqrt(d2) / (2 * side) END) AS hi, coalesce(bool_or(side = 0 AND m2 < d2 / 4), FALSE) AS blocked FROM third GROUP BY s, u, v),
edge AS (SELECT * FROM room WHERE NOT blocked AND coalesce(hi - lo > 1e-3, TRUE))
"""


@query(_EDGES + "SELECT s, u, v FROM edge")
def delaunay_edges(spark, sf_dir):
    """The edges that every Delaunay triangulation of a settlement's points has."""
    return triangulation.unmistakable(graph.delaunay_edges(layers.buildings(spark, sf_dir), "s", Workspace(spark, "delaunay"))).select("s", "u", "v")


@query(_EDGES + "SELECT u, v FROM edge WHERE d2 / 4 + pow(CASE WHEN lo > 0 THEN lo WHEN hi < 0 THEN hi ELSE 0 END, 2) < 3600")
def delaunay_whole_layer(spark, sf_dir):
    """All settlements as one group, in tiles; edges with an empty circle of a radius under 60 m, which none but points of their settlement can fill."""
    b = layers.buildings(spark, sf_dir).withColumn("group", F.lit(0))
    found = triangulation.unmistakable(graph.delaunay_edges(b, "group", Workspace(spark, "delaunay")))
    c = density.centres(b, "fid")
    ends = found.join(c.select(F.col("fid").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(c.select(F.col("fid").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    centre = F.when(F.col("lo") > 0, F.col("lo")).when(F.col("hi") < 0, F.col("hi")).otherwise(0.0)
    return ends.where((F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2)) / 4 + centre * centre < 3600).select("u", "v")


@query(
    ", pt AS (SELECT fid, s, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM buildings), turn AS (SELECT a.s, a.fid AS u, b.fid AS v, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) AS side, (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) AS between_"
    " FROM pt a JOIN pt b ON a.s = b.s AND a.fid <> b.fid JOIN pt p ON p.s = a.s AND p.fid <> a.fid AND p.fid <> b.fid),"
    " rim AS (SELECT s, u, v, any_value(ax * b_y - bx * ay) AS twice, coalesce(bool_or(side = 0 AND between_ < 0), FALSE) AS over FROM turn GROUP BY s, u, v HAVING min(side) >= 0 AND max(side) > 0),"
    " n AS (SELECT s, count(*) AS n FROM pt GROUP BY s), h AS (SELECT s, count(DISTINCT u) AS h FROM rim GROUP BY s)"
    " SELECT s, CAST(2 * n - 2 - h AS BIGINT) AS n_triangles, round(sum(twice) / 2, 3) AS area FROM rim JOIN n USING (s) JOIN h USING (s) WHERE NOT over GROUP BY s, n, h"
)
def delaunay_triangles(spark, sf_dir):
    """How many triangles each settlement has and what they cover: those of any triangulation that fills the hull."""
    store = Workspace(spark, "delaunay")
    p = store.save(density.centres(layers.buildings(spark, sf_dir), "s", "fid").withColumnRenamed("fid", "id"), "centres")
    at = lambda n: p.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    t = triangulation.triangles(p, "s", store).join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    area = F.abs(F.expr("(bx - ax) * (cy - ay) - (by - ay) * (cx - ax)")) / 2
    return t.groupBy("s").agg(F.count("*").alias("n_triangles"), F.round(F.sum(area), 3).alias("area"))


_PAIRS = "a.s = b.s AND a.fid < b.fid AND a.x1 - 10 <= b.x2 AND a.x2 + 10 >= b.x1 AND a.y1 - 10 <= b.y2 AND a.y2 + 10 >= b.y1"


@query(f", c AS (SELECT fid, CASE v WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x2 ELSE x1 END AS x, CASE v WHEN 0 THEN y1 WHEN 1 THEN y1 ELSE y2 END AS y FROM buildings, (SELECT unnest([0, 1, 2, 3]) AS v)), e AS (SELECT a.fid AS u, b.fid AS v FROM buildings a JOIN buildings b ON {_PAIRS}) SELECT u, v, greatest(1, round(sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))), 6)) AS w FROM e JOIN c p ON p.fid = u JOIN c q ON q.fid = v GROUP BY u, v")
def edge_min_vertex_distance(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    near = sj.pairs(b.select("fid", "bounds"), b.select("fid", "bounds"), reach=10.0).where("a.fid < b.fid").select(F.col("a.fid").alias("u"), F.col("b.fid").alias("v"))
    return graph.edge_weights(near, b).select("u", "v", F.round("w", 6).alias("w"))


def _parting_roads(spark, sf_dir):
    every = layers.roads(spark, sf_dir)
    short = roads.dead_ends(every).select(F.col("rid").alias("short"))
    return every.join(short, F.col("rid") == F.col("short"), "left_anti")


#: An edge is in the forest if lighter ones don't join its ends already.
_FOREST = (
    _EDGES
    + """, corner AS (SELECT fid, CASE v WHEN 0 THEN x1 WHEN 1 THEN x2 WHEN 2 THEN x2 ELSE x1 END AS x, CASE v WHEN 0 THEN y1 WHEN 1 THEN y1 ELSE y2 END AS y FROM buildings, (SELECT unnest([0, 1, 2, 3]) AS v)),
line AS (SELECT e.s, u, v, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM edge e JOIN pt a ON a.fid = u JOIN pt b ON b.fid = v),
crossed AS (SELECT DISTINCT u, v FROM line l JOIN roads r ON l.s = r.s AND rid % 14 <> 12 AND least(px, qx) <= greatest(x1, x2) AND greatest(px, qx) >= least(x1, x2) AND least(py, qy) <= greatest(y1, y2) AND greatest(py, qy) >= least(y1, y2)
 AND ((qx - px) * (y1 - py) - (qy - py) * (x1 - px)) * ((qx - px) * (y2 - py) - (qy - py) * (x2 - px)) <= 0 AND ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) * ((x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1)) <= 0),
weighed AS (SELECT e.s, u, v, greatest(1, sqrt(min(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)))) AS w FROM (SELECT s, u, v FROM edge ANTI JOIN crossed USING (u, v)) e JOIN corner p ON p.fid = u JOIN corner q ON q.fid = v GROUP BY e.s, u, v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY w, u, v) AS o FROM weighed),
reached AS (SELECT s, o, u AS node FROM ranked UNION SELECT r.s, r.o, CASE WHEN f.u = r.node THEN f.v ELSE f.u END FROM reached r JOIN ranked f ON f.s = r.s AND f.o < r.o AND (f.u = r.node OR f.v = r.node)),
forest AS (SELECT s, u, v, w FROM ranked e WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.s = e.s AND r.o = e.o AND r.node = e.v))
"""
)


@query(_FOREST + "SELECT s, u, v, round(w, 6) AS w FROM forest")
def minimum_spanning_forest(spark, sf_dir):
    """Over the edges that every triangulation has."""
    made = graph.spanning_forests(layers.buildings(spark, sf_dir), _parting_roads(spark, sf_dir), "s", Workspace(spark, "forest"), every=False)
    return made.select("s", "u", "v", F.round("w", 6).alias("w"))


@query("SELECT fid, CAST(CASE WHEN y2 - y1 > x2 - x1 THEN 90 ELSE 0 END AS DOUBLE) AS direction FROM buildings")
def main_angle(spark, sf_dir):
    return graph.main_directions(layers.buildings(spark, sf_dir), "fid")


@query("SELECT fid, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS box_area FROM buildings")
def main_angle_rectangle(spark, sf_dir):
    return graph.main_boxes(layers.buildings(spark, sf_dir), "fid").select("fid", F.round("box_area", 6).alias("box_area"))


@query()
def mst_clusters(spark, sf_dir):
    c = graph.building_clusters(layers.buildings(spark, sf_dir), _parting_roads(spark, sf_dir), "s")
    return c.select("s", "cluster", F.size("members").alias("n_members"), F.round(g.area(F.col("shape")), 6).alias("area"))


@query(
    f", e AS (SELECT a.fid AS u, b.fid AS v, CAST((a.x2 - a.x1) * (a.y2 - a.y1) AS DOUBLE) AS ua, CAST((b.x2 - b.x1) * (b.y2 - b.y1) AS DOUBLE) AS va, CASE WHEN a.y2 - a.y1 > a.x2 - a.x1 THEN 0 ELSE 1 END AS ut, CASE WHEN b.y2 - b.y1 > b.x2 - b.x1 THEN 0 ELSE 1 END AS vt FROM buildings a JOIN buildings b ON {_PAIRS})"
    " SELECT u, v, round(1 - least(ua, va) / greatest(ua, va), 6) AS by_area, CAST(abs(ut - vt) AS DOUBLE) AS by_turn FROM e"
)
def edge_dissimilarity(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    near = sj.pairs(b.select("fid", "bounds"), b.select("fid", "bounds"), reach=10.0).where("a.fid < b.fid").select(F.col("a.fid").alias("u"), F.col("b.fid").alias("v"))
    return graph.dissimilarity(near, b).select("u", "v", F.round("by_area", 6).alias("by_area"), F.round("by_turn", 6).alias("by_turn"))


@query("SELECT fid, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS box_area FROM buildings")
def least_bounding_box(spark, sf_dir):
    return graph.least_boxes(layers.buildings(spark, sf_dir), "fid").select("fid", F.round("box_area", 6).alias("box_area"))


#: L shapes of turned buildings: sides run at 36.87 and 126.87 degrees, which round to 36.9 and 126.9, and the rectangle lies that much askew.
_ASKEW = "radians(36.9 - degrees(atan2(3, 4)))"


@query("SELECT fid, CAST(CASE WHEN y2 - y1 > x2 - x1 THEN 126.9 ELSE 36.9 END AS DOUBLE) AS direction FROM buildings")
def main_angle_of_corners(spark, sf_dir):
    return graph.main_directions(layers.turned(layers.corners(layers.buildings(spark, sf_dir))), "fid")


@query(f"SELECT fid, round(25 * ((x2 - x1) * cos({_ASKEW}) + (y2 - y1) / 4.0 * sin({_ASKEW})) * ((y2 - y1) * cos({_ASKEW}) + (x2 - x1) * sin({_ASKEW})), 4) AS box_area FROM buildings")
def main_rectangle_of_corners(spark, sf_dir):
    return graph.main_boxes(layers.turned(layers.corners(layers.buildings(spark, sf_dir))), "fid").select("fid", F.round("box_area", 4).alias("box_area"))


@query("SELECT fid, CAST(25 * (x2 - x1) * (y2 - y1) AS DOUBLE) AS box_area FROM buildings")
def least_box_of_corners(spark, sf_dir):
    return graph.least_boxes(layers.turned(layers.corners(layers.buildings(spark, sf_dir))), "fid").select("fid", F.round("box_area").alias("box_area"))


# ---- overlays


@query()
def sparse_blocks(spark, sf_dir):
    few = layers.buildings(spark, sf_dir).where("fkt <> '31001_1000'")
    return coverage.sparse_zones(layers.blocks(spark, sf_dir), few, "bid", 60.0).select("bid", F.round("share", 3).alias("share"))


@query("SELECT CAST(count(DISTINCT rid) AS BIGINT) AS n_conflicts FROM roads r JOIN ibs i ON least(r.x1, r.x2) <= i.x2 AND greatest(r.x1, r.x2) >= i.x1 AND least(r.y1, r.y2) <= i.y2 AND greatest(r.y1, r.y2) >= i.y1")
def line_conflicts(spark, sf_dir):
    return coverage.conflicts(layers.roads(spark, sf_dir), layers.expert(spark, sf_dir))


@query("SELECT s, CAST(4 AS BIGINT) AS n_faces, CAST(54000 AS DOUBLE) AS area, CAST(13500 AS DOUBLE) AS least FROM settlements")
def polygonize_blocks(spark, sf_dir):
    faces = refine.measured(refine.grouped_lines(layers.roads(spark, sf_dir), "s"))
    return faces.groupBy("s").agg(F.count("*").alias("n_faces"), F.round(F.sum("shape_area"), 6).alias("area"), F.round(F.min("shape_area"), 6).alias("least"))


@query(
    """, line AS (SELECT *, row_number() OVER () AS i FROM crossing),
hit AS (SELECT a.s, a.i, a.x1 + k * (a.x2 - a.x1) AS x, a.y1 + k * (a.y2 - a.y1) AS y FROM (SELECT a, b, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / turn AS k, ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / turn AS m
 FROM (SELECT a, b, CAST((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS DOUBLE) AS turn FROM line a JOIN line b ON a.s = b.s AND a.i <> b.i) WHERE turn <> 0) WHERE k BETWEEN 0 AND 1 AND m BETWEEN 0 AND 1),
on_ AS (SELECT DISTINCT s, i, round(x, 3) AS x, round(y, 3) AS y FROM (SELECT * FROM hit UNION ALL SELECT s, i, x1, y1 FROM line UNION ALL SELECT s, i, x2, y2 FROM line)),
e AS (SELECT s, sum(n - 1) AS e FROM (SELECT s, i, count(*) AS n FROM on_ GROUP BY s, i) GROUP BY s), v AS (SELECT s, count(*) AS v FROM (SELECT DISTINCT s, x, y FROM on_) GROUP BY s)
SELECT s, CAST(e - v + 1 AS BIGINT) AS n_faces, area FROM e JOIN v USING (s) JOIN (SELECT s, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM blocks GROUP BY s) USING (s)"""
)
def network_faces(spark, sf_dir):
    """All settlements' roads, slanting ones too, as one network: by Euler's formula, faces are sides less nodes plus one for each part."""
    made = network.faces(layers.crossing_roads(spark, sf_dir).withColumn("group", F.lit(0)), "group", Workspace(spark, "network"))
    b = g.bounds(F.col("shape.shell"))
    s = (F.floor((b["y1"] + 3) / 1500) * 40 + F.floor((b["x1"] + 3) / 1500)).cast("long")
    return made.select(s.alias("s"), g.area(F.col("shape")).alias("area")).groupBy("s").agg(F.count("*").alias("n_faces"), F.round(F.sum("area"), 3).alias("area"))


def _pierced(spark, sf_dir):
    """The settlements' rectangles with a hole of 3,600 and one of 10,560 square metres."""
    s = layers.settlements(spark, sf_dir)
    hole = lambda x, y, w, h: g.box(F.col("ox") + x, F.col("oy") + y, F.col("ox") + x + w, F.col("oy") + y + h)["shell"]
    outer = g.box(F.col("ox") - 3, F.col("oy") - 3, F.col("ox") + 297, F.col("oy") + 177)["shell"]
    return s.select("s", g.polygon(outer, F.array(hole(10, 10, 60, 60), hole(150, 60, 120, 88))).alias("shape"))


@query("SELECT s, CAST(54000 - 10560 AS DOUBLE) AS area, CAST(1 AS INTEGER) AS n_holes FROM settlements")
def hole_close(spark, sf_dir):
    closed = refine.grouped(_pierced(spark, sf_dir), "s", refine.holes_closed)
    return closed.select("s", F.round(g.area(F.col("shape")), 6).alias("area"), F.size("shape.holes").alias("n_holes"))


@query("SELECT s, CAST(54000 - 10 * 180 AS DOUBLE) AS area FROM settlements")
def dissolved_landuse(spark, sf_dir):
    """Land of the four blocks with the strip between them: touching parts join into one, the strips at the right edge stay out."""
    strip = layers._shaped(layers.blocks(spark, sf_dir).where("bid % 2 = 0").select("bid", "s", (F.col("x2") - 10).alias("x1"), "y1", "x2", "y2"))
    whole = layers.landuse(spark, sf_dir).select("s", "shape").unionByName(strip.select("s", "shape"))
    joined = refine.grouped(whole, "s", refine.plane.dissolved)
    return joined.groupBy("s").agg(F.round(F.sum(g.area(F.col("shape"))), 6).alias("area"))


@query()
def gap_close(spark, sf_dir):
    closed = refine.grouped_with(layers.landuse(spark, sf_dir), layers.blocks(spark, sf_dir), "s", lambda a, b: refine.gaps_closed(a, b))
    return closed.select("s", "part", F.round(g.area(F.col("shape")), 3).alias("area"))


@query()
def edge_catch(spark, sf_dir):
    b, z = layers.buildings(spark, sf_dir), layers.blocks(spark, sf_dir)
    return refine.caught(b, _parting_roads(spark, sf_dir), z, "s").select("s", "part", F.round(g.area(F.col("shape")), 3).alias("area"))


def _areas_of_joined(outlines: DataFrame, lines: DataFrame, store: Workspace, distance: float = refine.JOINT) -> DataFrame:
    return joints.joined(outlines.select("name", "part", "shape"), lines, store, distance).select("name", "part", F.round(g.area(F.col("shape")), 3).alias("area"))


@query("SELECT min(concat('PART_', s, '_', bid)) AS name, 0 AS part, CAST(sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM blocks GROUP BY s")
def gap_fix(spark, sf_dir):
    """Blocks of a settlement lie border on border; together they are one outline."""
    halves = layers._shaped(layers.blocks(spark, sf_dir).selectExpr("concat('PART_', s, '_', bid) name", "0 part", "x1", "y1", "x2", "y2", "s"))
    return _areas_of_joined(halves, layers.roads(spark, sf_dir), Workspace(spark, "gap-fix"))


def _parted(spark, sf_dir):
    """Two outlines of each settlement with a gap of up to 180 m in between, and the roads, of which every fourth settlement lacks those on the lower edge."""
    s = layers.settlements(spark, sf_dir).selectExpr("s", "ox", "oy", "5 + (s * 53) % 176 gap")
    left = s.selectExpr("concat('PART_', s, '_a') name", "0 part", "ox - 3 x1", "oy - 3 y1", "ox + 90 x2", "oy + 177 y2")
    right = s.selectExpr("concat('PART_', s, '_b') name", "0 part", "ox + 90 + gap x1", "oy - 3 y1", "ox + 297 x2", "oy + 177 y2")
    return layers._shaped(left.unionByName(right)), layers.roads(spark, sf_dir).where("s % 4 <> 0 OR rid % 14 > 1")


@query(""", gap AS (SELECT s, turned, 5 + (s * 53) % 176 AS gap, s % 4 = 0 AS open, gap > 140 AND NOT turned AS far FROM settlements CROSS JOIN (VALUES (FALSE), (TRUE)) t(turned)),
outline AS (SELECT concat('PART_', s, '_a') AS name, 0 AS part, CASE WHEN gap > 70 THEN 93 * 180 WHEN open THEN 300 * 180 - gap * 90 ELSE 300 * 180 END AS area, turned FROM gap
UNION ALL SELECT concat('PART_', s, CASE WHEN far THEN '_b' ELSE '_a' END), CASE WHEN far THEN 0 ELSE 1 END, (207 - gap) * 180, turned FROM gap WHERE gap > 70)
SELECT name, part, CAST(area * CASE WHEN turned THEN 25 ELSE 1 END AS DOUBLE) AS area, turned FROM outline""")
def joints_between_outlines(spark, sf_dir):
    """Gaps of 70 m or less are filled where roads close them, as they lie and turned; wider ones stay, and outlines whose bounds come within 140 m share a name."""
    outlines, lines = _parted(spark, sf_dir)
    plain = _areas_of_joined(outlines, lines, Workspace(spark, "joints"))
    turned = _areas_of_joined(layers.turned(outlines), layers.turned_lines(lines), Workspace(spark, "joints"), 5 * refine.JOINT)
    return plain.withColumn("turned", F.lit(False)).unionByName(turned.withColumn("turned", F.lit(True)))


# ---- overlays as tables, on shapes that don't lie along the axes

#: Boxes of a settlement on the grid of their own coordinates: cells that any of them covers, and what neighbouring ones share.
_GRID = """, xs AS (SELECT s, x AS x1, lead(x) OVER (PARTITION BY s ORDER BY x) AS x2 FROM (SELECT s, x1 AS x FROM box UNION SELECT s, x2 FROM box)), ys AS (SELECT s, y AS y1, lead(y) OVER (PARTITION BY s ORDER BY y) AS y2 FROM (SELECT s, y1 AS y FROM box UNION SELECT s, y2 FROM box)),
cell AS (SELECT s, x1, y1, x2, y2 FROM xs JOIN ys USING (s) WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND EXISTS (SELECT 1 FROM box b WHERE b.s = xs.s AND b.x1 <= xs.x1 AND b.x2 >= xs.x2 AND b.y1 <= ys.y1 AND b.y2 >= ys.y2)),
shared AS (SELECT a.s, sum(CASE WHEN a.x2 = b.x1 AND a.y1 = b.y1 THEN a.y2 - a.y1 ELSE a.x2 - a.x1 END) AS len FROM cell a JOIN cell b ON a.s = b.s AND (a.x2 = b.x1 AND a.y1 = b.y1 OR a.y2 = b.y1 AND a.x1 = b.x1) GROUP BY a.s),
total AS (SELECT s, sum((x2 - x1) * (y2 - y1)) AS area, sum(2 * (x2 - x1 + y2 - y1)) AS len FROM cell GROUP BY s)
"""

_SHAPE = ["bounds", "shape", "is_box"]


@query("SELECT b.fid, CAST(25 * sum((least(b.x2, k.x2) - greatest(b.x1, k.x1)) * (least(b.y2, k.y2) - greatest(b.y1, k.y1))) AS DOUBLE) AS area FROM buildings b JOIN blocks k ON b.x1 < k.x2 AND b.x2 > k.x1 AND b.y1 < k.y2 AND b.y2 > k.y1 GROUP BY b.fid")
def clip_turned(spark, sf_dir):
    made = overlay.clip(layers.turned(layers.buildings(spark, sf_dir)), layers.turned(layers.blocks(spark, sf_dir)), "fid")
    return made.groupBy("fid").agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"))


@query(_PIECES + "SELECT bid, 25 * (shape_area - built) AS area FROM covered")
def erase_turned(spark, sf_dir):
    made = overlay.erase(layers.turned(layers.blocks(spark, sf_dir)), layers.turned(layers.buildings(spark, sf_dir)), "bid")
    return made.groupBy("bid").agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"))


#: The rectangle of the western half of each row of settlements, as one shape, and buildings cut at it.
_LANDS = """, land AS (SELECT oy // 1500 AS land, min(ox) - 10 AS x1, min(oy) - 10 AS y1, CAST(floor((min(ox) + max(ox)) / 2) AS BIGINT) + 95 AS x2, max(oy) + 200 AS y2 FROM settlements GROUP BY oy // 1500),
box AS (SELECT land AS s, greatest(b.x1, l.x1) AS x1, greatest(b.y1, l.y1) AS y1, least(b.x2, l.x2) AS x2, least(b.y2, l.y2) AS y2 FROM buildings b JOIN land l ON b.x1 < l.x2 AND b.x2 > l.x1 AND b.y1 < l.y2 AND b.y2 > l.y1)"""


def _lands(spark, sf_dir):
    s = layers.settlements(spark, sf_dir).groupBy(F.expr("oy div 1500").alias("land")).agg(F.min("ox").alias("w"), F.max("ox").alias("e"), F.min("oy").alias("lo"), F.max("oy").alias("hi"))
    return layers.turned(layers._shaped(s.selectExpr("land", "w - 10 x1", "lo - 10 y1", "(w + e) div 2 + 95 x2", "hi + 200 y2")))


@query(_LANDS + _GRID + "SELECT s AS land, CAST(25 * area AS DOUBLE) AS area, CAST(5 * (total.len - 2 * coalesce(shared.len, 0)) AS DOUBLE) AS perimeter FROM total LEFT JOIN shared USING (s)")
def lands_clipped(spark, sf_dir):
    """Few large shapes, clipped by all buildings: what is built up, those that overlap counted once."""
    made = overlay.cut_out(_lands(spark, sf_dir), layers.turned(layers.buildings(spark, sf_dir)), "land", Workspace(spark, "lands"))
    return made.groupBy("land").agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"), F.round(F.sum(g.perimeter(F.col("shape"))), 1).alias("perimeter"))


@query(_LANDS + _GRID + "SELECT s AS land, CAST(25 * ((x2 - x1) * (y2 - y1) - area) AS DOUBLE) AS area FROM total JOIN land ON land = s")
def lands_erased(spark, sf_dir):
    """The same large shapes without all buildings: shapes of very many holes."""
    made = overlay.cut_out(_lands(spark, sf_dir), layers.turned(layers.buildings(spark, sf_dir)), "land", Workspace(spark, "lands"), inside=False)
    return made.groupBy("land").agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"))


@query("SELECT b.fid, k.bid FROM buildings b JOIN blocks k ON b.x1 >= k.x1 AND b.x2 <= k.x2 AND b.y1 >= k.y1 AND b.y2 <= k.y2")
def within_turned(spark, sf_dir):
    met = sj.pairs(layers.turned(layers.buildings(spark, sf_dir)).select(_KEYS), layers.turned(layers.blocks(spark, sf_dir)).select("bid", *_SHAPE), tile=1000.0)
    return sj.refine(met, "within").select("a.fid", "b.bid")


@query("SELECT a.fid AS u, b.fid AS v FROM buildings a JOIN buildings b ON a.s = b.s AND a.fid < b.fid AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1")
def touching_turned(spark, sf_dir):
    b = layers.turned(layers.buildings(spark, sf_dir)).select(_KEYS)
    return sj.refine(sj.pairs(b, b).where("a.fid < b.fid")).select(F.col("a.fid").alias("u"), F.col("b.fid").alias("v"))


@query(
    "SELECT r.rid, i.fid AS zone, CAST(5 * (least(greatest(r.x1, r.x2), i.x2) - greatest(least(r.x1, r.x2), i.x1) + least(greatest(r.y1, r.y2), i.y2) - greatest(least(r.y1, r.y2), i.y1)) AS DOUBLE) AS length FROM roads r JOIN ibs i"
    " ON least(r.x1, r.x2) <= i.x2 AND greatest(r.x1, r.x2) >= i.x1 AND least(r.y1, r.y2) <= i.y2 AND greatest(r.y1, r.y2) >= i.y1 WHERE least(greatest(r.x1, r.x2), i.x2) - greatest(least(r.x1, r.x2), i.x1) + least(greatest(r.y1, r.y2), i.y2) - greatest(least(r.y1, r.y2), i.y1) > 0"
)
def roads_within_outlines(spark, sf_dir):
    zones = layers.turned(layers.expert(spark, sf_dir)).select(F.col("fid").alias("zone"), *_SHAPE)
    made = overlay.lines_within(layers.turned_lines(layers.roads(spark, sf_dir)), zones, "rid", "zone")
    return made.groupBy("rid", "zone").agg(F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("length"))


@query("SELECT bid, round((x2 - x1) * (y2 - y1) + 2 * (x2 - x1 + y2 - y1) * 18 + 16 * 324 * sin(pi() / 16)) AS area FROM blocks")
def buffer_round(spark, sf_dir):
    made = overlay.buffered(layers.blocks(spark, sf_dir), "bid", 18.0)
    return made.groupBy("bid").agg(F.round(F.sum(g.area(F.col("shape")))).alias("area"))


@query("SELECT rid, CAST(5 * len * 2 * 10 AS DOUBLE) AS area FROM roads")
def buffer_flat(spark, sf_dir):
    made = overlay.buffered_lines(layers.turned_lines(layers.roads(spark, sf_dir)), "rid", 10.0)
    return made.groupBy("rid").agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"))


#: Lines along the axes, turned like the layers: where a line is met by others, between its ends.
_PIECES_OF_LINES = """, every AS (SELECT s, rid, x1, y1, x2, y2 FROM roads UNION ALL SELECT s, -s - 1, ox - 3, oy + 42, ox + 297, oy + 42 FROM settlements),
span AS (SELECT s, rid, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2, CASE WHEN y1 = y2 THEN x2 - x1 ELSE y2 - y1 END AS len FROM every),
met AS (SELECT DISTINCT a.rid, greatest(a.x1, b.x1) AS x, greatest(a.y1, b.y1) AS y FROM span a JOIN span b ON a.s = b.s AND a.rid <> b.rid AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1
 WHERE (greatest(a.x1, b.x1), greatest(a.y1, b.y1)) NOT IN ((a.x1, a.y1), (a.x2, a.y2))),
cuts AS (SELECT rid, count(*) AS n FROM met GROUP BY rid)
"""


@query(_PIECES_OF_LINES + "SELECT s, CAST(sum(1 + coalesce(n, 0)) AS BIGINT) AS n_pieces, CAST(5 * sum(abs(len)) AS DOUBLE) AS length FROM span LEFT JOIN cuts USING (rid) GROUP BY s")
def noded_roads(spark, sf_dir):
    """The roads with one more across the three upright ones of each settlement: three are cut in two, and the new one, which begins and ends on the outer two, comes in two pieces."""
    r = layers.roads(spark, sf_dir).select("s", "line")
    across = layers.settlements(spark, sf_dir).select("s", F.array(g.point(F.col("ox") - 3, F.col("oy") + 42), g.point(F.col("ox") + 297, F.col("oy") + 42)).alias("line"))
    cut = overlay.noded_lines(layers.turned_lines(r.unionByName(across)), "s")
    return cut.groupBy("s").agg(F.count("*").alias("n_pieces"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 3).alias("length"))


@query(_TOUCH + ", own AS (SELECT b.*, component, (b.x2 - b.x1) * (b.y2 - b.y1) AS area FROM buildings b JOIN comp USING (fid)), both_ AS (SELECT a.component, sum((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS area FROM own a JOIN own b ON a.component = b.component AND a.fid < b.fid AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY 1) SELECT component, CAST(25 * (sum(own.area) - coalesce(max(both_.area), 0)) AS DOUBLE) AS area FROM own LEFT JOIN both_ USING (component) GROUP BY component")
def dissolved_single_parts(spark, sf_dir):
    made = overlay.dissolved_parts(layers.turned(layers.buildings(spark, sf_dir)), "fid", Workspace(spark, "dissolved"))
    return made.select("component", F.round(g.area(F.col("shape")), 1).alias("area"))


@query("SELECT s, CAST(count(*) AS BIGINT) AS n_parts, CAST(25 * sum((x2 - x1) * (y2 - y1)) AS DOUBLE) AS area FROM (SELECT s, x1, y1, x2 - 30 AS x2, y2 - 30 AS y2 FROM blocks) GROUP BY s")
def multipart_blocks(spark, sf_dir):
    apart = layers._shaped(layers.blocks(spark, sf_dir).selectExpr("bid", "s", "x1", "y1", "x2 - 30 x2", "y2 - 30 y2"))
    parts = overlay.single_parts(overlay.multiparts(layers.turned(apart), "s"))
    return parts.groupBy("s").agg(F.count("*").alias("n_parts"), F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"))


@query("SELECT bid, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area, TRUE AS counter_clockwise FROM blocks")
def repaired_shapes(spark, sf_dir):
    """Blocks whose rings are open and run clockwise, with a hole of no area, and a shape of no area for each."""
    b = layers.blocks(spark, sf_dir)
    back = F.slice(F.reverse("shape.shell"), 1, 4)
    flat = F.array(F.slice("shape.shell", 1, 2))
    broken = b.select("bid", g.polygon(back, flat).alias("shape")).unionByName(b.select((-F.col("bid") - 1).alias("bid"), g.polygon(F.concat(F.slice("shape.shell", 1, 2), F.slice("shape.shell", 1, 1))).alias("shape")))
    return overlay.repaired(broken).select("bid", g.area(F.col("shape")).alias("area"), (g.ring_area(F.col("shape.shell")) > 0).alias("counter_clockwise"))


@query(
    ", box AS (SELECT s, least(x1, x2) - CASE WHEN x1 = x2 THEN 2 ELSE 0 END AS x1, least(y1, y2) - CASE WHEN y1 = y2 THEN 2 ELSE 0 END AS y1, greatest(x1, x2) + CASE WHEN x1 = x2 THEN 2 ELSE 0 END AS x2, greatest(y1, y2) + CASE WHEN y1 = y2 THEN 2 ELSE 0 END AS y2 FROM roads UNION ALL SELECT s, x1 - 2, y1 + 5, x2, y1 + 9 FROM buildings)"
    + _GRID
    + "SELECT s, CAST(25 * area AS DOUBLE) AS area, CAST(5 * (total.len - 2 * shared.len) AS DOUBLE) AS perimeter FROM total JOIN shared USING (s)"
)
def buffers_dissolved(spark, sf_dir):
    """Roads and a line through each building, with flat buffers, dissolved over the whole layer."""
    store = Workspace(spark, "buffers")
    across = layers.buildings(spark, sf_dir).select((-F.col("fid") - 1).alias("rid"), F.array(g.point(F.col("x1") - 2, F.col("y1") + 7), g.point(F.col("x2"), F.col("y1") + 7)).alias("line"))
    lines = layers.turned_lines(layers.roads(spark, sf_dir).select("rid", "line").unionByName(across))
    made = overlay.buffers_dissolved(overlay.buffered_lines(lines, "rid", 10.0), store)
    p = F.col("shape.shell")[0]
    s = (F.floor(((4 * p["y"] - 3 * p["x"]) / 25 + 100) / 1500) * 40 + F.floor(((4 * p["x"] + 3 * p["y"]) / 25 + 100) / 1500)).cast("long")
    return made.groupBy(s.alias("s")).agg(F.round(F.sum(g.area(F.col("shape"))), 1).alias("area"), F.round(F.sum(g.perimeter(F.col("shape"))), 1).alias("perimeter"))


@query("SELECT fid, CAST(2 AS BIGINT) AS n_parts, 25 * (x2 - x1) * (y2 - y1) / 2.0 AS area FROM buildings")
def bow_ties_repaired(spark, sf_dir):
    """Buildings whose ring runs along the diagonals: two triangles that meet in a point."""
    b = layers.turned(layers.buildings(spark, sf_dir))
    p = F.col("shape.shell")
    crossed = b.select("fid", g.polygon(F.array(p[0], p[2], p[1], p[3], p[0])).alias("shape"))
    return overlay.repaired_parts(crossed, "fid").groupBy("fid").agg(F.count("*").alias("n_parts"), F.round(F.sum(g.area(F.col("shape"))), 6).alias("area"))


@query("SELECT fid FROM buildings WHERE fkt = '31001_2463'")
def identical_shapes(spark, sf_dir):
    """Buildings that are identical to one of those of a function, whose rings begin elsewhere and run the other way, or that are moved."""
    b = layers.turned(layers.buildings(spark, sf_dir))
    moved = b.where("fkt = '31001_2050'").withColumn("shape", g.polygon(F.transform("shape.shell", lambda p: F.struct((p["x"] + 0.5).alias("x"), p["y"].alias("y")))))
    other = b.where("fkt = '31001_2463'").withColumn("shape", g.polygon(F.reverse(F.concat(F.slice("shape.shell", 3, 3), F.slice("shape.shell", 2, 2)))))
    return overlay.identical(b, other.select("shape").unionByName(moved.select("shape"))).select("fid")


@query("SELECT b.fid, coalesce(min(k.bid), -1) AS match FROM buildings b LEFT JOIN blocks k ON b.x1 >= k.x1 AND b.x2 <= k.x2 AND b.y1 >= k.y1 AND b.y2 <= k.y2 GROUP BY b.fid")
def one_block_each(spark, sf_dir):
    """One match, within, all kept."""
    b = layers.buildings(spark, sf_dir)
    met = sj.refine(sj.pairs(b.select(_KEYS), layers.blocks(spark, sf_dir).select("bid", *_SHAPE)), "within")
    return sj.one_match(b, met, "fid", "bid").select("fid", F.coalesce("match", F.lit(-1)).alias("match"))


@query("SELECT r.rid, min(i.fid) AS match FROM roads r JOIN ibs i ON least(r.x1, r.x2) <= i.x2 AND greatest(r.x1, r.x2) >= i.x1 AND least(r.y1, r.y2) <= i.y2 AND greatest(r.y1, r.y2) >= i.y1 GROUP BY r.rid")
def one_outline_each(spark, sf_dir):
    """One match, intersecting, those without one left out."""
    r = layers.roads(spark, sf_dir)
    return sj.one_match(r, sj.pairs(r.select("rid", "bounds"), layers.expert(spark, sf_dir).select("fid", "bounds")), "rid", "fid", False).select("rid", "match")


@query(f", e AS (SELECT a.fid AS u, b.fid AS v, sqrt(pow((a.x1 + a.x2 - b.x1 - b.x2) / 2.0, 2) + pow((a.y1 + a.y2 - b.y1 - b.y2) / 2.0, 2)) AS d FROM buildings a JOIN buildings b ON {_PAIRS}) SELECT u, v, round(d, 6) AS length FROM e")
def lines_between_centres(spark, sf_dir):
    b = layers.buildings(spark, sf_dir)
    near = sj.pairs(b.select("fid", "bounds"), b.select("fid", "bounds"), reach=10.0).where("a.fid < b.fid").select(F.col("a.fid").alias("u"), F.col("b.fid").alias("v"))
    c = density.centres(b, "fid")
    ends = near.join(c.select(F.col("fid").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), "u").join(c.select(F.col("fid").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2")), "v")
    return overlay.lines_from(ends, "x1", "y1", "x2", "y2").select("u", "v", F.round(g.length(F.col("line")), 6).alias("length"))


@query("SELECT bid, 'Block_' || row_number() OVER (ORDER BY x1, y1, bid) AS name FROM blocks")
def named_blocks(spark, sf_dir):
    return overlay.named(layers.blocks(spark, sf_dir), "Block_", Workspace(spark, "names")).select("bid", "name")


@query("SELECT fid, TRUE AS inside FROM buildings")
def inner_points_of_corners(spark, sf_dir):
    """L shapes: whether their points lie in either arm."""
    b = layers.corners(layers.buildings(spark, sf_dir))
    p = density.centres(b, "fid", "bounds")
    low = (F.col("x") - F.col("bounds.x1") < (F.col("bounds.x2") - F.col("bounds.x1")) / 4) | (F.col("y") - F.col("bounds.y1") < (F.col("bounds.y2") - F.col("bounds.y1")) / 4)
    return p.select("fid", (low & (F.col("x") > F.col("bounds.x1")) & (F.col("y") > F.col("bounds.y1"))).alias("inside"))


@query("SELECT fid, 25 * (x2 - x1) * (y2 - y1) * 7 / 16.0 AS area, CAST(5 * 2 * (x2 - x1 + y2 - y1) AS DOUBLE) AS perimeter FROM buildings")
def measures_of_corners(spark, sf_dir):
    b = layers.turned(layers.corners(layers.buildings(spark, sf_dir)))
    return b.select("fid", F.round(g.area(F.col("shape")), 6).alias("area"), F.round(g.perimeter(F.col("shape")), 6).alias("perimeter"))


@query("SELECT s, CAST(n AS INTEGER) AS part, CAST(25 * CASE n WHEN 0 THEN 3600 ELSE 10560 END AS DOUBLE) AS area, TRUE AS is_hole FROM settlements, (SELECT unnest([0, 1]) AS n)")
def holes_of_outlines(spark, sf_dir):
    """Patches where the computed outline covers two holes of the expert's."""
    store = Workspace(spark, "holes")
    full = layers._shaped(layers.settlements(spark, sf_dir).selectExpr("s fid", "ox - 3 x1", "oy - 3 y1", "ox + 297 x2", "oy + 177 y2"))
    pierced = _pierced(spark, sf_dir).select(F.col("s").alias("fid"), "shape", g.bounds(F.col("shape.shell")).alias("bounds"), F.lit(False).alias("is_box"))
    made = store.save(classify.difference_patches(layers.turned(full), layers.turned(pierced), store), "patches")
    return made.select(F.col("source").alias("s"), F.when(F.col("shape_area") < 25 * 5000, 0).otherwise(1).alias("part"), F.round("shape_area", 1).alias("area"), "is_hole")


# ---- error classes

_DIFF = """, pos AS (SELECT 'POS_' || u.fid || '_0' AS pid, 'POS' AS sign, u.fid AS source, u.x1, u.y1, CASE WHEN i.fid IS NULL THEN u.x2 ELSE i.x1 END AS x2, u.y2, i.fid IS NULL AS body FROM ugb u LEFT JOIN ibs i USING (fid)),
neg AS (SELECT 'NEG_' || i.fid || '_0' AS pid, 'NEG' AS sign, i.fid AS source, CASE WHEN u.fid IS NULL THEN i.x1 ELSE u.x2 END AS x1, i.y1, i.x2, i.y2, u.fid IS NULL AS body FROM ibs i LEFT JOIN ugb u USING (fid)),
patch AS (SELECT *, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS shape_area FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)),
cut AS (SELECT p.pid, b.fid, greatest(b.x1, p.x1) AS x1, greatest(b.y1, p.y1) AS y1, least(b.x2, p.x2) AS x2, least(b.y2, p.y2) AS y2 FROM patch p JOIN buildings b ON b.x1 < p.x2 AND b.x2 > p.x1 AND b.y1 < p.y2 AND b.y2 > p.y1),
both_ AS (SELECT a.pid, sum((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS area FROM cut a JOIN cut b ON a.pid = b.pid AND a.fid < b.fid AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1 GROUP BY a.pid),
one AS (SELECT pid, sum((x2 - x1) * (y2 - y1)) AS area FROM cut GROUP BY pid),
land AS (SELECT p.pid, CAST(sum(CASE WHEN l.objart_txt = 'AX_IndustrieUndGewerbeflaeche' THEN a ELSE 0 END) AS DOUBLE) AS ind, CAST(sum(CASE WHEN l.objart_txt IN ('AX_Wohnbauflaeche', 'AX_FlaecheGemischterNutzung') THEN a ELSE 0 END) AS DOUBLE) AS res FROM patch p, LATERAL (SELECT l.objart_txt, (least(l.x2, p.x2) - greatest(l.x1, p.x1)) * (least(l.y2, p.y2) - greatest(l.y1, p.y1)) AS a FROM landuse l WHERE l.x1 < p.x2 AND l.x2 > p.x1 AND l.y1 < p.y2 AND l.y2 > p.y1) l GROUP BY p.pid),
rated AS (SELECT p.*, CAST(coalesce(one.area, 0) - coalesce(both_.area, 0) AS DOUBLE) / shape_area * 100 AS overlap, coalesce(ind, 0) / shape_area * 100 AS ind_ratio, coalesce(res, 0) / shape_area * 100 AS res_ratio FROM patch p LEFT JOIN one USING (pid) LEFT JOIN both_ USING (pid) LEFT JOIN land USING (pid)),
classed AS (SELECT *, CASE WHEN shape_area > 10000 AND overlap > 15 AND ind_ratio >= 50 THEN 'IndCom' WHEN shape_area > 10000 AND overlap > 15 AND res_ratio >= 50 THEN 'Resid' WHEN body THEN 'SettBody' WHEN overlap <= 3 AND shape_area > 10000 THEN 'LargeEmptyAreas' WHEN overlap > 15 THEN 'BdgEdge' WHEN overlap <= 3 THEN 'EmptyAreas' ELSE 'LowDensBdgGrp' END AS error_class FROM rated WHERE shape_area >= 250)
"""


def _patches(spark, sf_dir):
    store = Workspace(spark, "patches")
    return store.save(classify.difference_patches(layers.computed(spark, sf_dir), layers.expert(spark, sf_dir), store), "patches")


def _classified(spark, sf_dir):
    return classify.classified(_patches(spark, sf_dir), layers.buildings(spark, sf_dir), layers.landuse(spark, sf_dir))


@query(_DIFF + "SELECT pid, sign, shape_area, CAST(2 * (x2 - x1 + y2 - y1) AS DOUBLE) AS shape_len FROM patch")
def symdiff_patches(spark, sf_dir):
    return _patches(spark, sf_dir).select("pid", "sign", F.round("shape_area", 6).alias("shape_area"), F.round("shape_len", 6).alias("shape_len"))


@query(_DIFF + "SELECT pid, sign, 25 * shape_area AS shape_area, CAST(10 * (x2 - x1 + y2 - y1) AS DOUBLE) AS shape_len FROM patch")
def symdiff_turned(spark, sf_dir):
    store = Workspace(spark, "patches")
    made = store.save(classify.difference_patches(layers.turned(layers.computed(spark, sf_dir)), layers.turned(layers.expert(spark, sf_dir)), store), "patches")
    return made.select("pid", "sign", F.round("shape_area", 1).alias("shape_area"), F.round("shape_len", 3).alias("shape_len"))


@query(_DIFF + "SELECT pid, round(overlap, 6) AS overlap FROM rated")
def patch_overlap(spark, sf_dir):
    return coverage.coverage(_patches(spark, sf_dir), layers.buildings(spark, sf_dir), "pid").select("pid", F.round("overlap", 6).alias("overlap"))


@query(_DIFF + "SELECT pid, round(ind_ratio, 6) AS ind_ratio FROM rated")
def landuse_ratio_indcom(spark, sf_dir):
    return classify.land_share(_patches(spark, sf_dir), layers.landuse(spark, sf_dir), classify.INDUSTRIAL, "ind_ratio").select("pid", F.round("ind_ratio", 6).alias("ind_ratio"))


@query(_DIFF + "SELECT pid, round(res_ratio, 6) AS res_ratio FROM rated")
def landuse_ratio_resid(spark, sf_dir):
    return classify.land_share(_patches(spark, sf_dir), layers.landuse(spark, sf_dir), classify.RESIDENTIAL, "res_ratio").select("pid", F.round("res_ratio", 6).alias("res_ratio"))


@query(_DIFF + "SELECT pid, sign FROM patch WHERE body")
def settlement_body(spark, sf_dir):
    return _patches(spark, sf_dir).where("body").select("pid", "sign")


@query(_DIFF + "SELECT pid, sign, error_class FROM classed")
def error_class_cascade(spark, sf_dir):
    return _classified(spark, sf_dir).select("pid", "sign", "error_class")


@query(
    ", moved AS (SELECT fid, s, x1 + CASE WHEN s % 2 = 0 THEN 1000000 ELSE 0 END AS x1, y1, x2 + CASE WHEN s % 2 = 0 THEN 1000000 ELSE 0 END AS x2, y2 FROM buildings),"
    " patch AS (SELECT 'POS_' || s || '_' || n AS pid, ox + CASE n WHEN 0 THEN 10 ELSE 150 END AS x1, oy + CASE n WHEN 0 THEN 10 ELSE 60 END AS y1, ox + CASE n WHEN 0 THEN 70 ELSE 270 END AS x2, oy + CASE n WHEN 0 THEN 70 ELSE 148 END AS y2, CAST(CASE n WHEN 0 THEN 3600 ELSE 10560 END AS DOUBLE) AS shape_area FROM settlements, (SELECT unnest([0, 1]) AS n)), "
    + _DIFF[_DIFF.index("cut AS") : _DIFF.index("classed AS")].rstrip(", \n").replace("JOIN buildings b", "JOIN moved b")
    + " SELECT pid, CASE WHEN shape_area > 10000 AND overlap > 15 AND ind_ratio >= 50 THEN 'IndCom' WHEN shape_area > 10000 AND overlap > 15 AND res_ratio >= 50 THEN 'Resid' WHEN overlap < 3 THEN 'Holes' WHEN overlap > 15 THEN 'BdgEdge' ELSE 'LowDensBdgGrp' END AS error_class FROM rated"
)
def holes_classed(spark, sf_dir):
    """Holes of the expert's outlines that the computed ones cover, in settlements of which every other one has lost its buildings: those without are of class Holes."""
    store = Workspace(spark, "holes")
    full = layers._shaped(layers.settlements(spark, sf_dir).selectExpr("s fid", "ox - 3 x1", "oy - 3 y1", "ox + 297 x2", "oy + 177 y2"))
    pierced = _pierced(spark, sf_dir).select(F.col("s").alias("fid"), "shape", g.bounds(F.col("shape.shell")).alias("bounds"), F.lit(False).alias("is_box"))
    made = store.save(classify.difference_patches(full, pierced, store), "patches")
    away = F.when(F.col("s") % 2 == 0, 1000000).otherwise(0)
    moved = layers._shaped(layers.buildings(spark, sf_dir).select("fid", "s", (F.col("x1") + away).alias("x1"), "y1", (F.col("x2") + away).alias("x2"), "y2"))
    return classify.classified(made, moved, layers.landuse(spark, sf_dir)).select("pid", "error_class")


@query(
    _DIFF
    + ", total AS (SELECT sign, count(*) AS n, sum(shape_area) AS area FROM patch GROUP BY sign), known AS (SELECT sign, error_class, count(*) AS n, sum(shape_area) AS area FROM classed GROUP BY sign, error_class),"
    " line AS (SELECT sign, 'All' AS error_class, n, area FROM total UNION ALL SELECT * FROM known UNION ALL SELECT sign, 'Unclassified', t.n - coalesce(k.n, 0), t.area - coalesce(k.area, 0) FROM total t LEFT JOIN (SELECT sign, sum(n) AS n, sum(area) AS area FROM known GROUP BY sign) k USING (sign))"
    " SELECT line.sign, error_class, CAST(line.n AS BIGINT) AS frequency, CAST(round(line.area / 10000) AS BIGINT) AS area_ha, round(line.area / total.area * 100, 1) AS share_pct FROM line JOIN total USING (sign)"
)
def error_report(spark, sf_dir):
    store = Workspace(spark, "report")
    patches = _patches(spark, sf_dir)
    return classify.report(patches, store.save(classify.classified(patches, layers.buildings(spark, sf_dir), layers.landuse(spark, sf_dir)).select("sign", "error_class", "shape_area"), "classes"))


# ---- results


@query("SELECT s, CAST(x1 AS DOUBLE) AS x1, 'computed' AS origin FROM ugb UNION ALL SELECT s, CAST(x1 AS DOUBLE), 'expert' FROM ibs")
def merge_partition_results(spark, sf_dir):
    parts = [layers.computed(spark, sf_dir).withColumn("origin", F.lit("computed")), layers.expert(spark, sf_dir).withColumn("origin", F.lit("expert"))]
    return io.merged(parts).select("s", F.col("bounds.x1").alias("x1"), "origin")


@query()
def delineation_full(spark, sf_dir):
    made = delineation.delineate(layers.buildings(spark, sf_dir), layers.roads(spark, sf_dir), layers.partitions(spark, sf_dir))
    return made.select("name", "part", F.round("shape_area", 3).alias("area"))
