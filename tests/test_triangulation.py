"""Triangulation by tiles and forests by rounds, against what one process makes of the same points."""

from __future__ import annotations

import random

import numpy as np
import pytest

from terraloom.functions import plane
from terraloom.operators import forest, graph, triangulation
from terraloom.store import Workspace


def point_sets():
    r = np.random.default_rng(5)
    n = 300
    t = r.random(n) * 2 * np.pi
    spots = r.random((5, 2)) * 20_000
    yield "even", r.random((n, 2)) * 1000
    yield "lattice", np.stack(np.meshgrid(np.arange(17), np.arange(17)), -1).reshape(-1, 2) * 30.0
    yield "clusters", spots[r.integers(0, 5, n)] + r.normal(size=(n, 2)) * 50
    yield "ring", np.stack([np.cos(t), np.sin(t)], 1) * 1000
    yield "far one", np.concatenate([r.random((n, 2)) * 100, [[90_000.0, 70_000.0]]])
    yield "three", np.array([[0, 0], [5, 1], [2, 9.0]])
    yield "line", np.stack([np.arange(40) * 7.0, np.arange(40) * 3.0], 1)
    yield "two", np.array([[0, 0], [5, 1.0]])


@pytest.mark.parametrize("kind", ["even", "lattice", "ring"])
def test_no_point_in_a_circle(kind):
    p = np.round(dict(point_sets())[kind], 3)
    t = np.array(plane.delaunay(list(map(tuple, p.tolist()))))
    o, r, _ = plane.circles(p, t)
    for c, radius, corners in zip(o, r, t, strict=True):
        others = np.delete(np.hypot(*(p - c).T), corners)
        assert (others > radius - 1e-3).all()
    hull = abs(plane.signed_area(plane.hull(list(map(tuple, p.tolist())))))
    a, b, c = p[t[:, 0]], p[t[:, 1]], p[t[:, 2]]
    covered = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])).sum() / 2
    assert covered == pytest.approx(hull, rel=1e-6)


def test_many_points_take_no_quadratic_time():
    import time

    r = np.random.default_rng(1)
    spent = []
    for n in (2000, 16_000):
        p = plane.shaken(r.random((n, 2)) * 5000)
        began = time.process_time()
        assert len(plane.triangulated(p)) == 2 * n - 2
        spent.append(time.process_time() - began)
    assert spent[1] < 24 * spent[0]


def test_tiles_agree_with_one_process(spark):
    rows, want = [], {}
    for k, (kind, p) in enumerate(point_sets()):
        own = [(kind, 1000 * k + i, float(x), float(y)) for i, (x, y) in enumerate(np.round(p, 3))]
        want[kind] = {tuple(sorted(own[i][1] for i in t)) for t in plane.delaunay([(x, y) for _, _, x, y in own])}
        rows += own + [(kind, own[0][1] + 900, own[0][2], own[0][3])]  # a point twice
    points = spark.createDataFrame(rows, "part string, id long, x double, y double").repartition(3)
    got = triangulation.triangles(points, "part", Workspace(spark, "tiles"), per_cell=2).collect()
    found = {}
    for r in got:
        found.setdefault(r.part, []).append((r.a, r.b, r.c))
    for kind, triangles in want.items():
        assert sorted(found.get(kind, [])) == sorted(triangles), kind
    assert triangulation.triangles(points.where("false"), "part", Workspace(spark, "tiles")).collect() == []


def test_edges_say_where_empty_circles_lie(spark):
    square = [("q", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (30.0, 5.0)])]
    points = spark.createDataFrame(square, "part string, id long, x double, y double")
    found = triangulation.triangles(points, "part", Workspace(spark, "edges"))
    sides = triangulation.edges(found, points, "part")
    rows = {(r.u, r.v): (r.lo, r.hi) for r in sides.collect()}
    diagonal = (0, 2) if (0, 2) in rows else (1, 3)
    assert rows[diagonal][0] == pytest.approx(rows[diagonal][1]) == pytest.approx(0)
    assert rows[0, 1] == (None, pytest.approx(5)) and (1, 2) in rows
    assert {(r.u, r.v) for r in triangulation.unmistakable(sides).collect()} == set(rows) - {diagonal}


def test_forest_is_that_of_rising_weights(spark):
    r = random.Random(2)
    edges = [(r.randrange(60) + 100 * g, r.randrange(60) + 100 * g, float(r.randrange(5))) for g in range(3) for _ in range(200)] + [(7, 7, 0.0), (500, 501, 1.0), (501, 500, 0.5)]
    got = forest.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double").repartition(3), Workspace(spark, "forest"))
    least = {}
    for u, v, w in edges:
        if u != v:
            k = (min(u, v), max(u, v))
            least[k] = min(w, least.get(k, w))
    assert sorted((x.w, x.u, x.v) for x in got.collect()) == sorted(plane.spanning_forest([(w, u, v) for (u, v), w in least.items()]))
    long = [(k, k + 1, 1.0) for k in range(300)]
    assert forest.spanning_forest(spark.createDataFrame(long, "u long, v long, w double"), Workspace(spark, "forest")).count() == 300
    none = spark.createDataFrame([], "u long, v long, w double")
    assert forest.spanning_forest(none, Workspace(spark, "forest")).collect() == []


def slow_clusters(buildings, tree, least):
    """The rule, with every test on all members anew."""
    shape = {b.fid: b.shape for b in buildings}
    groups, of = [], {}

    def dense(members):
        parts = [shape[m] for m in members]
        return sum(map(plane.area, parts)) / plane.area(graph.main_box(parts)) * 100 > least

    for _, u, v in sorted(tree):
        home, other = (u, v) if u in of else (v, u)
        if home in of:
            grown = groups[of[home]] + [other] * (other not in groups[of[home]])
            if dense(grown):
                groups[of[home]], of[other] = grown, of[home]
                continue
        if dense([u, v]):
            groups.append([u, v])
            of[u] = of[v] = len(groups) - 1
    return [sorted(set(m)) for m in groups]


@pytest.mark.parametrize("least", [18.0, 30.0, 55.0])
def test_clusters_follow_the_rule(least):
    r = random.Random(11)
    buildings = []
    for k in range(120):
        x, y, w, h, t = r.uniform(0, 400), r.uniform(0, 400), r.uniform(8, 25), r.uniform(8, 25), r.choice([0, 0.3, 0.31, 1.2])
        c, s = np.cos(t), np.sin(t)
        ring = [(x + a * c - b * s, y + a * s + b * c) for a, b in ((0, 0), (w, 0), (w, h), (0, h))]
        buildings.append(graph.Building(k, plane.Polygon(plane.as_ring([tuple(map(float, p)) for p in ring]), [])))
    tree = graph.forest(buildings, np.zeros((0, 4)))
    got = graph.clusters(buildings, tree, least)
    assert got == slow_clusters(buildings, tree, least) and len(got) > 3
