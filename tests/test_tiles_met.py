"""Long slanting sides and large shapes take part in the tiles that they meet, not in those of their bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.operators import network
from terraloom.operators import spatial_join as sj
from terraloom.store import Workspace


def test_a_slanting_side_passes_few_tiles_and_misses_none(spark):
    r = np.random.default_rng(2)
    ends = [*map(tuple, (r.random((40, 4)) * 5000 - 2500).tolist()), (0.0, 0.0, 0.0, 5000.0), (250.0, 500.0, -750.0, 500.0), (0.0, 0.0, 100_000.0, 90_000.0), (10.0, 0.0, 260.0, 1e-9)]
    rows = spark.createDataFrame([(n, *map(float, e)) for n, e in enumerate(ends)], "n long, x1 double, y1 double, x2 double, y2 double")
    met: dict[int, set] = {}
    for t in sj.tiles_of_sides(rows, 250.0, "n").collect():
        met.setdefault(t.n, set()).add((t.tx, t.ty))
    for n, (x1, y1, x2, y2) in enumerate(ends):
        k = np.linspace(0, 1, 5000)
        on = np.floor(np.stack([x1 + k * (x2 - x1), y1 + k * (y2 - y1)], 1) / 250).astype(int)
        assert set(map(tuple, on.tolist())) <= met[n]
    assert len(met[42]) < 1000  # of 144,000 within its bounds


def test_a_large_shape_holds_its_pieces_by_its_own_tiles(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (40_000.0, 30_000.0), (39_400.0, 30_800.0), (-600.0, 800.0), (0.0, 0.0)])], "fid long, ring array<struct<x:double,y:double>>")
    layer = rows.select("fid", g.polygon(F.col("ring")).alias("shape"), g.bounds(F.col("ring")).alias("bounds"))
    assert sj.tiles_covered(layer, 250.0).count() < 2000  # of 20,000 within its bounds


def test_a_hole_in_a_slanting_strip_stays_a_hole(spark):
    strip = [(0.0, 0.0), (4000.0, 3000.0), (3400.0, 3800.0), (-600.0, 800.0), (0.0, 0.0)]
    hole = [(2000.0, 2000.0), (2100.0, 2000.0), (2100.0, 2100.0), (2000.0, 2100.0), (2000.0, 2000.0)]
    layer = lambda ring: spark.createDataFrame([(0, 1, ring)], "k long, fid long, ring array<struct<x:double,y:double>>").select("k", "fid", g.polygon(F.col("ring")).alias("shape"), g.bounds(F.col("ring")).alias("bounds"))
    made = network.combined(layer(strip), layer(hole), "k", "fid", "difference", Workspace(spark, "strip")).collect()
    assert [len(r["shape"]["holes"]) for r in made] == [1]
    assert plane.area(plane.as_polygon(made[0]["shape"])) == 5_000_000 - 10_000
