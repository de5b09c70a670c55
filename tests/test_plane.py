"""The planar kernel on small figures and invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from terraloom.functions import plane
from terraloom.functions.plane import Polygon
from terraloom.operators import graph, refine


def box(x1, y1, x2, y2, *holes):
    return Polygon(plane.as_ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2)]), [plane.as_ring([(h[0], h[1]), (h[0], h[3]), (h[2], h[3]), (h[2], h[1])]) for h in holes])


def turned(p, t=math.atan2(3, 4)):
    c, s = math.cos(t), math.sin(t)
    go = lambda r: plane.as_ring([(x * c - y * s, x * s + y * c) for x, y in r])
    return Polygon(go(p.shell), [go(h) for h in p.holes])


def total(shapes):
    return sum(map(plane.area, shapes))


def test_lattice_has_four_faces():
    lines = [(0, y, 20, y) for y in (0, 10, 20)] + [(x, 0, x, 20) for x in (0, 10, 20)] + [(10, 15, 30, 15), (25, 0, 25, 3)]
    faces = plane.faces(plane.noded(np.array(lines, float)))
    assert sorted(round(plane.area(f)) for f in faces) == [50, 50, 100, 100, 100]


def test_measures():
    p = box(0, 0, 10, 10, (2, 2, 5, 5))
    assert plane.area(p) == 91 and plane.perimeter(p) == 52
    assert plane.holds(p, *plane.inside_point(p))
    l_shape = Polygon(plane.as_ring([(0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10)]), [])
    assert plane.area(l_shape) == 36 and plane.holds(l_shape, *plane.inside_point(l_shape))
    assert plane.repaired(Polygon([(0, 0), (1, 1), (2, 2)], [])) is None
    assert plane.signed_area(plane.repaired(Polygon(l_shape.shell[::-1], [])).shell) > 0


@pytest.mark.parametrize("seed", range(12))
def test_overlay_invariants(seed):
    r = random.Random(seed)
    make = lambda: [turned(box(x, y, x + r.randint(3, 30), y + r.randint(3, 30)), r.choice([0, math.atan2(3, 4), 0.3])) for x, y in [(r.randint(0, 50), r.randint(0, 50)) for _ in range(4)]]
    a, b = plane.dissolved(make()), plane.dissolved(make())
    both, one = plane.intersection(a, b), plane.dissolved(a + b)
    assert total(one) == pytest.approx(total(a) + total(b) - total(both), abs=0.5)
    only_a, only_b = plane.symmetric_difference(a, b)
    assert total(only_a) + total(only_b) == pytest.approx(total(a) + total(b) - 2 * total(both), abs=0.5)
    assert total(plane.difference(a, b)) == pytest.approx(total(a) - total(both), abs=0.5)


def test_touching_boxes_dissolve_to_one_with_a_hole():
    ring = [box(0, 0, 30, 10), box(0, 20, 30, 30), box(0, 10, 10, 20), box(20, 10, 30, 20)]
    (p,) = plane.dissolved(ring)
    assert plane.area(p) == 800 and len(p.holes) == 1 and len(p.shell) == 5
    assert total(refine.holes_closed(ring, 101)) == 900 and total(refine.holes_closed(ring, 100)) == 800


def test_relations():
    a = box(0, 0, 10, 10)
    assert plane.intersects(a, box(10, 0, 20, 10)) and not plane.intersects(a, box(10.1, 0, 20, 10))
    assert plane.intersects(a, box(2, 2, 3, 3)) and plane.contains(a, box(0, 0, 3, 3)) and not plane.contains(a, box(8, 8, 12, 9))
    assert not plane.contains(box(0, 0, 10, 10, (2, 2, 8, 8)), box(3, 3, 4, 4))


def test_buffer_and_closing():
    grown = plane.buffered([box(0, 0, 100, 50)], 10)
    assert total(grown) == pytest.approx(100 * 50 + 300 * 10 + math.pi * 100, rel=0.01)
    made = refine.gaps_closed([box(0, 0, 100, 100), box(100, 0, 200, 30), box(120, 30, 200, 100)], [], least=50)
    assert total(made) == pytest.approx(20000, rel=0.02)


def test_triangulation():
    lattice = [(float(x), float(y)) for x in range(4) for y in range(4)]
    triangles = plane.delaunay(lattice)
    assert len(triangles) == 18
    assert plane.delaunay([(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]) == []
    r = random.Random(2)
    points = [(r.random() * 100, r.random() * 100) for _ in range(30)]
    for t in plane.delaunay(points):
        a, b, c = (np.array(points[k]) for k in t)
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [b @ b - a @ a, c @ c - a @ a])
        assert all(np.linalg.norm(np.array(p) - m) >= np.linalg.norm(a - m) - 1e-6 for k, p in enumerate(points) if k not in t)


def test_spanning_forest_is_least():
    r = random.Random(4)
    edges = [(float(r.randint(1, 9)), u, v) for u in range(6) for v in range(u + 1, 6) if r.random() < 0.7] + [(1.0, 10, 11)]
    forest = plane.spanning_forest(edges)
    nodes = {n for _, u, v in edges for n in (u, v)}

    def parts(chosen):
        root = {n: n for n in nodes}
        for _, u, v in chosen:
            a, b = root[u], root[v]
            root = {n: a if x == b else x for n, x in root.items()}
        return len(set(root.values()))

    assert len(forest) == len(nodes) - parts(edges) and parts(forest) == parts(edges)
    import itertools

    least = min(sum(e[0] for e in c) for c in itertools.combinations(edges, len(forest)) if parts(c) == parts(edges))
    assert sum(e[0] for e in forest) == least


def test_main_direction():
    p = turned(box(0, 0, 40, 10))
    turn = plane.main_direction(plane.edges([p]))
    assert turn == pytest.approx(36.9, abs=0.11)
    assert plane.area(plane.turned_box(p.shell, turn)) == pytest.approx(400, rel=0.02)
    assert plane.area(plane.least_box(p.shell)) == pytest.approx(400, rel=0.001)


def test_clusters():
    close = [graph.Building(k, box(12 * k, 0, 12 * k + 10, 10)) for k in range(4)]
    far = [graph.Building(9, box(400, 0, 410, 10))]
    tree = [(graph.weight(a.shape, b.shape), a.fid, b.fid) for a, b in zip(close, close[1:] + far)]
    assert graph.clusters(close + far, tree, 50.0) == [[0, 1, 2, 3]]


def test_gap_contact():
    gap = box(10, 0, 20, 10)
    assert refine.contact(gap, [box(0, 0, 10, 10), box(20, 0, 30, 10)]) == pytest.approx(50)
    assert refine.contact(gap, [box(0, 0, 9, 10)]) == 0


def test_edges_caught():
    cluster, zone = box(10, 10, 60, 40), [box(0, 0, 100, 50)]
    roads = np.array([(0, 0, 100, 0), (100, 0, 100, 50), (100, 50, 0, 50), (0, 50, 0, 0)], float)
    grown = refine.edges_caught(cluster, zone, roads, [box(20, 20, 30, 30)])
    assert total(grown) >= plane.area(cluster)
    assert refine.edges_caught(cluster, zone, roads + 500, [box(20, 20, 30, 30)]) == []


def test_convex_shapes_are_decided_as_all_others():
    """Against the arrangement, on turned boxes that lie within, beside, across and border on border."""
    r = random.Random(12)
    turn = lambda x, y, w, h: plane.Polygon(plane.as_ring([(float(4 * p - 3 * q), float(3 * p + 4 * q)) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]), [])
    area = lambda parts: round(sum(map(plane.area, parts)), 3)
    for _ in range(60):
        a = turn(r.randrange(0, 40, 5), r.randrange(0, 40, 5), r.randrange(5, 20, 5), r.randrange(5, 20, 5))
        b = [turn(r.randrange(0, 40, 5), r.randrange(0, 40, 5), r.randrange(5, 40, 5), r.randrange(5, 40, 5)) for _ in range(r.randrange(1, 4))]
        both = plane.overlay([a], b)
        assert area(plane.intersection([a], b)) == area([f.shape for f in both if f.a and f.b])
        assert area(plane.difference([a], b)) == area([f.shape for f in both if f.a and not f.b])
        assert plane.contains(b[0], a) == (area([f.shape for f in plane.overlay([b[0]], [a]) if f.b and not f.a]) == 0)
        met = plane.meets
        assert plane.intersects(a, b[0]) == (any(met(s, plane.edges([b[0]])).any() for s in plane.edges([a])) or plane.holds(a, *b[0].shell[0]) or plane.holds(b[0], *a.shell[0]))
