"""What joins carry and whom they pair."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.operators import overlay, roads
from terraloom.operators import spatial_join as sj
from terraloom.plans import layers
from terraloom.store import Workspace

SF = "/root/testdata/sf0.001"


def test_no_tile_of_a_shape_is_missing():
    r = random.Random(3)
    tile = lambda x, y: plane.Polygon(plane.as_ring([(x, y), (x + 100.0, y), (x + 100.0, y + 100.0), (x, y + 100.0)]), [])
    for _ in range(20):
        rim = [(round(r.uniform(20, 900) * math.cos(a), 3), round(r.uniform(20, 900) * math.sin(a), 3)) for a in sorted(r.uniform(0, 6.283) for _ in range(r.randint(3, 9)))]
        p = plane.Polygon(plane.as_ring(rim), [])
        met = set(map(tuple, sj._raster(plane.edges([p]), 100.0).tolist()))
        assert {(x, y) for x in range(-10, 10) for y in range(-10, 10) if plane.intersects(p, tile(100.0 * x, 100.0 * y))} <= met


def test_a_slanting_shape_is_cut_by_what_it_meets_only(spark, monkeypatch):
    """A strip along a diagonal and boxes all over its bounds: the overlay sees those near the strip."""
    seen = []
    own = overlay.network.combined
    monkeypatch.setattr(overlay.network, "combined", lambda one, two, *rest: seen.append(two.count()) or own(one, two, *rest))
    corners = [(0, 0), (20000, 20000), (19900, 20000), (-100, 0), (0, 0)]
    strip = spark.createDataFrame([(1, {"shell": [{"x": float(x), "y": float(y)} for x, y in corners], "holes": []})], f"k long, shape {g.POLYGON}").withColumn("bounds", g.bounds(F.col("shape.shell")))
    at = spark.range(400).selectExpr("id % 20 * 1000 + 400 x1", "id div 20 * 1000 + 400 y1").selectExpr("x1", "y1", "x1 + 20 x2", "y1 + 20 y2")
    made = overlay.cut_out(strip, layers._shaped(at), "k", Workspace(spark, "strip"))
    assert made.count() == 20 and seen[0] < 100


def test_joins_of_boxes_carry_no_shape_and_still_meet_others(spark):
    b = layers.blocks(spark, SF)
    assert sj.slim(b, "bid").where("shape is not null").isEmpty()
    bent = layers.corners(b)
    whole = sj.refine(sj.pairs(b.select("bid", "bounds", "shape", "is_box"), bent.select("bid", "bounds", "shape", "is_box"))).select("a.bid", F.col("b.bid").alias("c"))
    slim = sj.refine(sj.pairs(sj.slim(b, "bid"), sj.slim(bent, "bid"))).select("a.bid", F.col("b.bid").alias("c"))
    assert sorted(whole.collect()) == sorted(slim.collect()) and not slim.isEmpty()


def test_corners_keep_their_numbers_wherever_a_ring_begins(spark):
    b = layers.buildings(spark, SF).where("fid < 60")
    lines = layers.roads(spark, SF)
    back = b.withColumn("shape", g.polygon(F.reverse("shape.shell")))
    got = [{(r.fid, r.vertex): (r.rid, r.distance) for r in roads.nearest_road(x, lines, "fid").collect()} for x in (b, back)]
    assert got[0] and got[1] == {(f, (4 - v) % 4): found for (f, v), found in got[0].items()}


def test_a_shape_alone_is_no_overlay(spark, monkeypatch):
    asked = []
    own = overlay.network.united
    monkeypatch.setattr(overlay.network, "united", lambda rows, *rest: asked.append(rows.count()) or own(rows, *rest))
    boxes = layers._shaped(spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 5, 15, 15), (3, 100, 0, 110, 10)], "fid long, x1 long, y1 long, x2 long, y2 long"))
    made = {r.component: r.a for r in overlay.dissolved_parts(boxes, "fid", Workspace(spark, "alone")).select("component", g.area(F.col("shape")).alias("a")).collect()}
    assert made == {1: 175.0, 3: 100.0} and asked == [2]
