"""Nearest regions by the pyramid and polygons of regions, against brute force on small grids."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from terraloom.functions import plane
from terraloom.operators import density, partitions
from terraloom.store import Workspace


def test_nearest_of_any_point(spark):
    r = random.Random(3)
    spots = {(r.randrange(-20, 20), r.randrange(-20, 20)): r.randrange(6) for _ in range(40)} | {(900, -700): 7, (901, -700): 8}
    points = [(k, r.uniform(-6000, 6000), r.uniform(-6000, 6000)) for k in range(150)] + [(1000 + k, r.uniform(-1e6, 1e6), r.uniform(-1e6, 1e6)) for k in range(50)] + [(2000, 150.0, 150.0), (2001, 0.0, 0.0)]
    regions = spark.createDataFrame([(x, y, n) for (x, y), n in spots.items()], "cx long, cy long, region long").repartition(3)
    got = density.nearest_region(spark.createDataFrame(points, "k long, x double, y double"), regions, "k", Workspace(spark, "nearest")).collect()
    want = {k: min((((x - (cx + 0.5) * 150) ** 2 + (y - (cy + 0.5) * 150) ** 2) ** 0.5, n) for (cx, cy), n in spots.items())[1] for k, x, y in points}
    assert {r.k: r.region for r in got} == want and len(got) == len(points)
    none = density.nearest_region(spark.createDataFrame(points, "k long, x double, y double"), regions.where("false"), "k", Workspace(spark, "nearest"))
    assert {r.region for r in none.collect()} == {None} and none.count() == len(points)


def shape_of(cells):
    """(area, perimeter) in cells."""
    sides = sum((x + dx, y + dy) not in cells for x, y in cells for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    return len(cells), sides


def parts_of(cells):
    cells, parts = set(cells), []
    while cells:
        part, edge = set(), [cells.pop()]
        while edge:
            x, y = edge.pop()
            part.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in cells:
                    cells.discard(n)
                    edge.append(n)
        parts.append(part)
    return parts


def test_polygons_fill_the_rectangle(spark):
    """Random regions, full of corners that touch, holes and parts: each part is one polygon with its own area and borders, and every cell lies in that of its region alone."""
    r = random.Random(4)
    label = {(x, y): r.randrange(3) for x in range(-5, 9) for y in range(-3, 8)}
    label |= {(x, y): 5 for x in range(20, 27) for y in range(7)} | {(x, y): 6 for x in range(22, 25) for y in range(2, 5)} | {(23, 3): 5}
    cells = spark.createDataFrame([(x, y, n) for (x, y), n in label.items()], "cx long, cy long, region long").repartition(4)
    got = partitions.polygons(cells, Workspace(spark, "polygons"), cell=10.0).collect()
    want = Counter((n, *shape_of(part)) for n in set(label.values()) for part in parts_of(c for c, m in label.items() if m == n))
    polygons = [(r.region, plane.as_polygon(r["shape"].asDict(recursive=True))) for r in got]
    assert Counter((n, round(plane.area(p) / 100), round(plane.perimeter(p) / 10)) for n, p in polygons) == want
    for (x, y), n in label.items():
        assert [m for m, p in polygons if plane.holds(p, 10 * x + 5, 10 * y + 5)] == [n]
    assert sorted(r.name for r in got) == sorted(f"PART_{k + 1}" for k in range(len(got)))


def test_all_cells_get_a_label(spark):
    regions = spark.createDataFrame([(0, 0, 1), (1, 0, 1), (6, 4, 2)], "cx long, cy long, region long")
    store = Workspace(spark, "labels")
    got = {(r.cx, r.cy): r.region for r in partitions.labelled(regions, store, margin=2).collect()}
    assert set(got) == {(x, y) for x in range(-2, 9) for y in range(-2, 7)}
    assert all(n == min(((x - cx) ** 2 + (y - cy) ** 2, m) for cx, cy, m in ((0, 0, 1), (1, 0, 1), (6, 4, 2)))[1] for (x, y), n in got.items())
    assert partitions.labelled(regions.where("false"), store).count() == 0
    lines = partitions.border_lines(spark.createDataFrame([(x, y, n) for (x, y), n in got.items()], "cx long, cy long, region long"))
    assert lines.select("line").where(F.size("line") != 2).isEmpty() and lines.where("region = 1").count() >= 4


def test_points_of_a_square_find_their_cells_together(spark):
    import numpy as np

    from terraloom.operators import density
    from terraloom.store import Workspace

    r = np.random.default_rng(5)
    cells = np.unique(np.concatenate([r.integers(-40, 40, (60, 2)), r.integers(900, 910, (30, 2))]), axis=0)
    regions = [(int(x), int(y), int(x % 5)) for x, y in cells]
    points = np.concatenate([r.random((200, 2)) * 30_000 - 15_000, (r.integers(-60, 60, (200, 2)) + 0.5) * 150, r.random((30, 2)) * 150_000])
    rows = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "k long, x double, y double")
    store = Workspace(spark, "squares")
    found = {f.k: f.region for f in density.nearest_region(rows, spark.createDataFrame(regions, "cx long, cy long, region long"), "k", store).collect()}
    for k, (x, y) in enumerate(points.tolist()):
        near = min((np.sqrt((x - (cx + 0.5) * 150) ** 2 + (y - (cy + 0.5) * 150) ** 2), g) for cx, cy, g in regions)
        assert found[k] == near[1]
    # before, a row for each point and block: 49 for each of 430 points
    import os

    front = next(f for f in sorted(os.listdir(store.root.removeprefix("file:"))) if f.endswith("front"))
    assert spark.read.parquet(f"{store.root}/{front}").count() < 2000


def test_density_counts_centres_within_the_radius(spark):
    import numpy as np

    from terraloom.operators import density

    r = np.random.default_rng(6)
    points = np.concatenate([r.random((60, 2)) * 1000 - 500, r.integers(-10, 10, (60, 2)) * 25.0])
    rows = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    found = {(c.cx, c.cy): c.n for c in density.point_density(rows, 50.0, 100.0).collect()}
    want: dict = {}
    for x, y in points.tolist():
        for cx in range(-20, 20):
            for cy in range(-20, 20):
                if ((cx + 0.5) * 50 - x) ** 2 + ((cy + 0.5) * 50 - y) ** 2 <= 10_000:
                    want[cx, cy] = want.get((cx, cy), 0) + 1
    assert found == want
