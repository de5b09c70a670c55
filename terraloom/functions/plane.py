"""Planar arrangements in numpy: noding, faces, overlay, dissolve, buffer, triangulation.

One kernel serves all overlays: segments are cut where they meet, faces are walked, and each face is owned by the inputs that hold a point inside it. Coordinates are
rounded to a millimetre after each cut, so that what meets meets in one point. It runs on the shapes of one group, inside grouped functions.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

GRID = 1e-3
Ring = list[tuple[float, float]]


class Polygon(NamedTuple):
    shell: Ring
    holes: list[Ring]


def snapped(x: float) -> float:
    return round(x / GRID) * GRID


def as_ring(points) -> Ring:
    """From dicts, rows or pairs; closed, without repeated neighbours."""
    out: Ring = []
    for p in points:
        q = (snapped(float(p["x"])), snapped(float(p["y"]))) if not isinstance(p, tuple) else (snapped(p[0]), snapped(p[1]))
        q = (round(q[0], 6), round(q[1], 6))
        if not out or out[-1] != q:
            out.append(q)
    if out and out[0] != out[-1]:
        out.append(out[0])
    return out


def as_polygon(shape) -> Polygon:
    return Polygon(as_ring(shape["shell"]), [as_ring(h) for h in (shape["holes"] if shape["holes"] is not None else [])])


def as_struct(p: Polygon) -> dict:
    points = lambda ring: [{"x": x, "y": y} for x, y in ring]
    return {"shell": points(p.shell), "holes": [points(h) for h in p.holes]}


def signed_area(ring: Ring) -> float:
    if len(ring) < 3:
        return 0.0
    ox, oy = ring[0]
    return sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True)) / 2


def area(p: Polygon) -> float:
    return abs(signed_area(p.shell)) - sum(abs(signed_area(h)) for h in p.holes)


def perimeter(p: Polygon) -> float:
    return sum(math.dist(a, b) for r in (p.shell, *p.holes) for a, b in zip(r[:-1], r[1:], strict=True))


def repaired(p: Polygon) -> Polygon | None:
    """Closed rings, shell counter-clockwise and holes clockwise; None without area."""
    shell = as_ring(p.shell)
    if abs(signed_area(shell)) < GRID * GRID:
        return None
    turn = lambda r, positive: r if (signed_area(r) > 0) == positive else r[::-1]
    return Polygon(turn(shell, True), [turn(h, False) for h in map(as_ring, p.holes) if abs(signed_area(h)) >= GRID * GRID])


def winding(ring: Ring, x: float, y: float) -> int:
    """How often a ring runs around a point, counter-clockwise."""
    turns = 0
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            turns += 1 if y2 > y1 else -1
    return turns


def simple_parts(p: Polygon) -> list[Polygon]:
    """Single parts whose rings don't cross themselves: all that the shell winds around, whichever way, and no hole does."""
    kept = []
    for f in faces(noded(edges([p]))):
        x, y = inside_point(f)
        if winding(p.shell, x, y) and not any(winding(h, x, y) for h in p.holes):
            kept.append(f)
    return sorted(joined(kept), key=lambda q: min(q.shell)) if kept else []


def edges(polygons: list[Polygon]) -> np.ndarray:
    """(x1, y1, x2, y2) of all rings."""
    out = [(*a, *b) for p in polygons for r in (p.shell, *p.holes) for a, b in zip(r[:-1], r[1:], strict=True)]
    return np.array(out, float).reshape(-1, 4)


def noded(lines: np.ndarray) -> np.ndarray:
    """Distinct pieces (lesser end first) of segments cut wherever two of them meet."""
    lines = lines[(lines[:, 0] != lines[:, 2]) | (lines[:, 1] != lines[:, 3])] if len(lines) else lines.reshape(0, 4)
    if not len(lines):
        return lines
    low, high = np.minimum(lines[:, :2], lines[:, 2:]) - GRID, np.maximum(lines[:, :2], lines[:, 2:]) + GRID
    order = np.argsort(low[:, 0], kind="stable")
    lines, low, high = lines[order], low[order], high[order]
    last = np.searchsorted(low[:, 0], high[:, 0], "right")
    many = last - np.arange(len(lines)) - 1
    i = np.repeat(np.arange(len(lines)), many)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    near = (low[j, 1] <= high[i, 1]) & (high[j, 1] >= low[i, 1])
    i, j = i[near], j[near]
    pair, at = _meetings(lines[i], lines[j])
    of = np.concatenate([np.arange(len(lines)), np.arange(len(lines)), i[pair], j[pair]])
    points = np.concatenate([lines[:, :2], lines[:, 2:], at, at])
    points = np.round(np.round(points / GRID) * GRID, 6)
    along = ((points - lines[of, :2]) * (lines[of, 2:] - lines[of, :2])).sum(1)
    order = np.lexsort((along, of))
    of, points = of[order], points[order]
    keep = (of[1:] == of[:-1]) & (points[1:] != points[:-1]).any(1)
    a, b = points[:-1][keep], points[1:][keep]
    turn = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    return np.unique(np.where(turn[:, None], np.concatenate([b, a], 1), np.concatenate([a, b], 1)), axis=0)


def _meetings(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, point) in which segments s[k] and t[k] meet: ends that lie on the other one, or else a crossing."""
    found, points = [], []
    any_end = np.zeros(len(s), bool)
    for a, b in ((s, t), (t, s)):
        d = b[:, 2:] - b[:, :2]
        square = (d * d).sum(1)
        for end in (a[:, :2], a[:, 2:]):
            r = end - b[:, :2]
            k = (r * d).sum(1) / square
            on = (k >= -1e-9) & (k <= 1 + 1e-9) & (np.abs(r[:, 0] * d[:, 1] - r[:, 1] * d[:, 0]) <= GRID * np.sqrt(square))
            any_end |= on
            found.append(np.flatnonzero(on))
            points.append(end[on])
    p, q, r = s[:, 2:] - s[:, :2], t[:, 2:] - t[:, :2], t[:, :2] - s[:, :2]
    cross = p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        k = (r[:, 0] * q[:, 1] - r[:, 1] * q[:, 0]) / cross
        m = (r[:, 0] * p[:, 1] - r[:, 1] * p[:, 0]) / cross
    inner = ~any_end & (cross != 0) & (k >= 0) & (k <= 1) & (m >= 0) & (m <= 1)
    found.append(np.flatnonzero(inner))
    points.append(s[inner, :2] + k[inner, None] * p[inner])
    return np.concatenate(found), np.concatenate(points)


def meets(one: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Which lines a segment meets."""
    out = np.zeros(len(lines), bool)
    if len(lines):
        near = np.flatnonzero(
            (np.maximum(lines[:, 0], lines[:, 2]) + GRID >= min(one[0], one[2]))
            & (np.minimum(lines[:, 0], lines[:, 2]) - GRID <= max(one[0], one[2]))
            & (np.maximum(lines[:, 1], lines[:, 3]) + GRID >= min(one[1], one[3]))
            & (np.minimum(lines[:, 1], lines[:, 3]) - GRID <= max(one[1], one[3]))
        )
        if len(near):
            out[near[_meetings(np.repeat(one[None], len(near), 0), lines[near])[0]]] = True
    return out


def faces(lines: np.ndarray) -> list[Polygon]:
    """Bounded faces of noded segments; dangling ones bound nothing."""
    ends: dict[tuple[float, float], set] = {}
    for x1, y1, x2, y2 in lines.tolist():
        ends.setdefault((x1, y1), set()).add((x2, y2))
        ends.setdefault((x2, y2), set()).add((x1, y1))
    loose = [p for p, q in ends.items() if len(q) == 1]
    while loose:
        p = loose.pop()
        for q in ends.pop(p, ()):
            ends[q].discard(p)
            if len(ends[q]) == 1:
                loose.append(q)
            elif not ends[q]:
                ends.pop(q)
    around = {p: sorted(q, key=lambda o, p=p: math.atan2(o[1] - p[1], o[0] - p[0])) for p, q in ends.items()}
    seen, outer, inner = set(), [], []
    for p, q in [(p, q) for p in around for q in around[p]]:
        if (p, q) in seen:
            continue
        ring, a, b = [p], p, q
        while (a, b) not in seen:
            seen.add((a, b))
            ring.append(b)
            turn = around[b]
            a, b = b, turn[turn.index(a) - 1]  # the next one clockwise: the face lies on the left
        size = signed_area(ring)
        (outer if size > 0 else inner).append(ring) if abs(size) >= GRID * GRID else None
    out = [Polygon(r, []) for r in outer]
    # a clockwise walk is the rim of a part from outside: a hole of the least face around it
    for hole in inner:
        holds = [k for k, p in enumerate(out) if _rim_inside(hole, p.shell)]
        if holds:
            out[min(holds, key=lambda k: signed_area(out[k].shell))].holes.append(hole)
    return out


def _rim_inside(hole: Ring, shell: Ring) -> bool:
    if abs(signed_area(hole)) >= signed_area(shell) - GRID * GRID:
        return False
    corners = set(shell)
    free = [p for p in hole if p not in corners]
    return bool(free) and covers(shell, *free[0])


def covers(ring: Ring, x: float, y: float) -> bool:
    """Whether a point lies in a ring; its border isn't told apart."""
    inside = False
    x1, y1 = ring[0]
    for x2, y2 in ring[1:]:
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
        x1, y1 = x2, y2
    return inside


def holds(p: Polygon, x: float, y: float) -> bool:
    return covers(p.shell, x, y) and not any(covers(h, x, y) for h in p.holes)


def inside_point(p: Polygon) -> tuple[float, float]:
    """In the middle of the widest stretch of some level between corners."""
    levels = sorted({y for r in (p.shell, *p.holes) for _, y in r})
    gap = max(zip(levels[:-1], levels[1:], strict=True), key=lambda g: g[1] - g[0])
    y = (gap[0] + gap[1]) / 2
    xs = []
    for r in (p.shell, *p.holes):
        for (x1, y1), (x2, y2) in zip(r[:-1], r[1:], strict=True):
            if (y1 > y) != (y2 > y):
                xs.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
    xs.sort()
    a, b = max(zip(xs[::2], xs[1::2], strict=True), key=lambda s: s[1] - s[0])
    return (a + b) / 2, y


def _convex(p: Polygon) -> bool:
    """Whether a shape is a convex ring, which runs counter-clockwise, without holes."""
    r = p.shell
    if p.holes or len(r) < 4:
        return False
    turns = [(r[k + 1][0] - r[k][0]) * (b[1] - r[k + 1][1]) - (r[k + 1][1] - r[k][1]) * (b[0] - r[k + 1][0]) for k, b in enumerate([*r[2:], r[1]])]
    # rings that run round more than once turn left as well
    return min(turns) > 0 and sum(math.atan2(t, (r[k + 1][0] - r[k][0]) * (b[0] - r[k + 1][0]) + (r[k + 1][1] - r[k][1]) * (b[1] - r[k + 1][1])) for k, (t, b) in enumerate(zip(turns, [*r[2:], r[1]], strict=True))) < 3 * math.pi


def _sides_of(convex: Polygon, p: Polygon) -> tuple[bool, float]:
    """Whether a shape lies in a convex one, and how far beyond the furthest of its sides all corners of the shape lie (negative: they lie beyond none)."""
    within, apart = True, -math.inf
    for (x1, y1), (x2, y2) in zip(convex.shell[:-1], convex.shell[1:], strict=True):
        dx, dy = x2 - x1, y2 - y1
        left = [dx * (y - y1) - dy * (x - x1) for x, y in p.shell]
        within = within and min(left) >= 0
        apart = max(apart, -max(left) / math.hypot(dx, dy))
    return within, apart


def _partners(p: Polygon, others: list[Polygon]) -> tuple[bool, list[Polygon]]:
    """Whether a shape lies in a convex one of the others, and those others that don't lie wholly beyond a side of it or have it beyond one of theirs."""
    own, met = _convex(p), []
    for o in others:
        if _convex(o):
            within, apart = _sides_of(o, p)
            if within:
                return True, [o]
            if apart >= 0:
                continue
        if own and _sides_of(p, o)[1] >= 0:
            continue
        met.append(o)
    return False, met


class Face(NamedTuple):
    shape: Polygon
    a: frozenset
    b: frozenset


def overlay(a: list[Polygon], b: list[Polygon]) -> list[Face]:
    """Faces of both layers together with the numbers of the shapes that own them; unowned ones are left out."""
    boxes = [[_box(p) for p in layer] for layer in (a, b)]
    out = []
    for f in faces(noded(edges(a + b))):
        x, y = inside_point(f)
        own = [frozenset(k for k, (p, (x1, y1, x2, y2)) in enumerate(zip(layer, box, strict=True)) if x1 <= x <= x2 and y1 <= y <= y2 and holds(p, x, y)) for layer, box in zip((a, b), boxes, strict=True)]
        if own[0] or own[1]:
            out.append(Face(f, own[0], own[1]))
    return out


def _box(p: Polygon) -> tuple[float, float, float, float]:
    xs, ys = zip(*p.shell, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def joined(parts: list[Polygon]) -> list[Polygon]:
    """Faces with their common borders taken away: single parts."""
    rim: dict[tuple, int] = {}
    for x1, y1, x2, y2 in edges(parts).tolist():
        key = (min((x1, y1), (x2, y2)), max((x1, y1), (x2, y2)))
        rim[key] = rim.get(key, 0) + 1
    lines = np.array([(*p, *q) for (p, q), n in rim.items() if n % 2], float).reshape(-1, 4)
    points = [inside_point(p) for p in parts]
    return [_straight(f) for f in faces(lines) if any(holds(f, *p) for p in points)]


def _straight(p: Polygon) -> Polygon:
    """Without corners on a straight line."""

    def thin(r: Ring) -> Ring:
        n = len(r) - 1
        keep = [r[k] for k in range(n) if abs((r[k][0] - r[k - 1 if k else n - 1][0]) * (r[k + 1][1] - r[k][1]) - (r[k][1] - r[k - 1 if k else n - 1][1]) * (r[k + 1][0] - r[k][0])) > GRID * GRID]
        return [*keep, keep[0]] if len(keep) > 2 else r

    return Polygon(thin(p.shell), [thin(h) for h in p.holes])


def dissolved(shapes: list[Polygon]) -> list[Polygon]:
    """The union as single parts."""
    return joined([f.shape for f in overlay(shapes, [])]) if shapes else []


def intersection(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    if len(a) == 1 and _convex(a[0]):
        within, b = _partners(a[0], b)
        if within or not b:
            return a if within else []
    return joined([f.shape for f in overlay(a, b) if f.a and f.b])


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    if len(a) == 1 and _convex(a[0]):
        within, b = _partners(a[0], b)
        if within or not b:
            return [] if within else a
    return joined([f.shape for f in overlay(a, b) if f.a and not f.b])


def symmetric_difference(a: list[Polygon], b: list[Polygon]) -> tuple[list[Polygon], list[Polygon]]:
    """(only in a, only in b)"""
    every = overlay(a, b)
    return joined([f.shape for f in every if f.a and not f.b]), joined([f.shape for f in every if f.b and not f.a])


def buffered(shapes: list[Polygon], distance: float, quadrant: int = 4) -> list[Polygon]:
    """All points within a distance, as single parts; arcs have ``quadrant`` chords in a right angle."""
    parts = [repaired(p) for p in shapes]
    out = [p for p in parts if p]
    for side in edges(out).tolist():
        out += buffered_side(side, distance, quadrant)
    return dissolved(out)


def buffered_side(side, distance: float, quadrant: int = 4) -> list[Polygon]:
    """All points within a distance of a segment."""
    x1, y1, x2, y2 = side
    along = math.atan2(y2 - y1, x2 - x1)
    arc = [along + math.pi / 2 + math.pi * k / (2 * quadrant) for k in range(2 * quadrant + 1)]
    ring = [(x1 + distance * math.cos(t), y1 + distance * math.sin(t)) for t in arc] + [(x2 - distance * math.cos(t), y2 - distance * math.sin(t)) for t in arc]
    return [Polygon(as_ring(ring), [])]


def canonical(ring: Ring) -> tuple:
    """A closed ring in millimetres from its least corner on, counter-clockwise."""
    r = as_ring(ring)[:-1]
    if signed_area([*r, r[0]]) < 0:
        r = r[::-1]
    r = [(round(x * 1000), round(y * 1000)) for x, y in r]
    k = r.index(min(r))
    return tuple(r[k:] + r[:k])


def intersects(a: Polygon, b: Polygon) -> bool:
    """Closed: a common point of the borders is enough."""
    p, q = _box(a), _box(b)
    if p[0] > q[2] + GRID or q[0] > p[2] + GRID or p[1] > q[3] + GRID or q[1] > p[3] + GRID:
        return False
    if _convex(a) and _convex(b):
        (within, apart), (around, beyond) = _sides_of(a, b), _sides_of(b, a)
        if within or around:
            return True
        if max(apart, beyond) > 2 * GRID:
            return False
    s, t = edges([a]), edges([b])
    return any(meets(x, t).any() for x in s) or holds(a, *b.shell[0]) or holds(b, *a.shell[0])


def contains(a: Polygon, b: Polygon) -> bool:
    """Whether b lies in a; borders may touch."""
    if area(b) >= GRID and _convex(a):
        within, apart = _sides_of(a, b)
        if within or apart >= 0:
            return within
    return area(b) > 0 and sum(area(f.shape) for f in overlay([a], [b]) if f.b and not f.a) < GRID


def hull(points: list[tuple[float, float]]) -> Ring:
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(some):
        out = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(points), half(points[::-1])
    return low[:-1] + high[:-1] + low[:1]


def turned_box(points: list[tuple[float, float]], degrees: float) -> Polygon:
    """The rectangle along a direction that holds all points."""
    t = math.radians(degrees)
    c, s = math.cos(t), math.sin(t)
    u, v = zip(*((x * c + y * s, -x * s + y * c) for x, y in points), strict=True)
    corners = [(min(u), min(v)), (max(u), min(v)), (max(u), max(v)), (min(u), max(v))]
    return Polygon(as_ring([(a * c - b * s, a * s + b * c) for a, b in corners]), [])


def least_box(points: list[tuple[float, float]]) -> Polygon:
    """The rectangle of least area, which lies along a side of the hull."""
    rim = hull(points)
    turns = {math.degrees(math.atan2(b[1] - a[1], b[0] - a[0])) % 90 for a, b in zip(rim[:-1], rim[1:], strict=True)}
    return min((turned_box(points, t) for t in sorted(turns)), key=area)


def directions(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction in tenths of a degree from 0 to 1799, length) of undirected segments."""
    turn = np.round(np.degrees(np.arctan2(lines[:, 3] - lines[:, 1], lines[:, 2] - lines[:, 0])) % 180 * 10).astype(np.int64) % 1800
    return turn, np.hypot(lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1])


def main_of(turn: np.ndarray, long: np.ndarray, gap: float = 10.0) -> float:
    """Of distinct directions (tenths of a degree, rising) and their lengths: neighbours under ``gap`` degrees apart are grouped; in the group of greatest length, the direction of most."""
    group = np.cumsum(np.append(False, np.diff(turn) >= gap * 10))
    best = int(np.round(np.bincount(group, long), 6).argmax())
    own = np.flatnonzero(group == best)
    return float(turn[own[int(np.round(long[own], 6).argmax())]]) / 10


def main_direction(lines: np.ndarray, gap: float = 10.0) -> float:
    """Of undirected segments: directions are grouped where neighbours lie under ``gap`` degrees apart; in the group of greatest length, that of most."""
    turn, inverse = np.unique(directions(lines)[0], return_inverse=True)
    return main_of(turn, np.bincount(inverse, directions(lines)[1]), gap)


#: Points move by up to this far, by a hash of their place, so that no four lie on one circle; triangles lower than ``FLAT`` are those of points on a line.
SHIFT, FLAT = 1e-6, 1e-4


def shaken(p: np.ndarray) -> np.ndarray:
    """Points in general position: each moved a little, the same wherever and with whatever others it comes."""
    key = np.round(p / GRID).astype(np.int64).view(np.uint64)
    h = key[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ key[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    for _ in range(2):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    both = np.stack([h & np.uint64(0xFFFFF), (h >> np.uint64(20)) & np.uint64(0xFFFFF)], 1).astype(float)
    return p + (both / (1 << 20) - 0.5) * 2 * SHIFT


def _along_curve(p: np.ndarray) -> np.ndarray:
    """An order in which neighbours lie near each other: bits of both coordinates in turn."""
    span = max(float(np.ptp(p, axis=0).max()), GRID)
    q = ((p - p.min(0)) / span * 65535).astype(np.uint64)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        q = (q | (q << np.uint64(shift))) & np.uint64(mask)
    return np.argsort(q[:, 0] | (q[:, 1] << np.uint64(1)), kind="stable")


def triangulated(points: np.ndarray) -> np.ndarray:
    """The triangles (counter-clockwise) of distinct points in general position, and with -1 as one corner the sides of the hull.

    Points come in along a space-filling curve; a walk from the last triangle finds the one that holds the next point, and the triangles around it whose circles hold the point are
    replaced. A corner at infinity stands beyond each side of the hull, so that no far helper points bend it.
    """
    if len(points) < 3:
        return np.zeros((0, 3), np.int64)
    order = _along_curve(points).tolist()
    local = points - points.mean(0)
    x, y = local[:, 0].tolist(), local[:, 1].tolist()

    def turn(a: int, b: int, c: int) -> float:
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    a, b = order[:2]
    third = next((k for k in order[2:] if turn(a, b, k) != 0), None)
    if third is None:
        return np.zeros((0, 3), np.int64)
    if turn(a, b, third) < 0:
        a, b = b, a
    # corners, and the neighbour across from each
    tri = [[a, b, third], [b, a, -1], [third, b, -1], [a, third, -1]]
    near = [[2, 3, 1], [3, 2, 0], [1, 3, 0], [2, 1, 0]]
    free: list[int] = []
    last = 0

    def holds(t: int, px: float, py: float) -> bool:
        u, v, w = tri[t]
        if u < 0 or v < 0 or w < 0:
            if u < 0:
                u, v = v, w
            elif v < 0:
                u, v = w, u
            return (x[v] - x[u]) * (py - y[u]) - (y[v] - y[u]) * (px - x[u]) > 0
        ax, ay, bx, by, cx, cy = x[u] - px, y[u] - py, x[v] - px, y[v] - py, x[w] - px, y[w] - py
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    for k in order:
        if k in (a, b, third):
            continue
        px, py = x[k], y[k]
        t, steps = last, 0
        while True:
            u, v, w = tri[t]
            if u < 0 or v < 0 or w < 0:
                break
            if (x[w] - x[v]) * (py - y[v]) - (y[w] - y[v]) * (px - x[v]) < 0:
                t = near[t][0]
            elif (x[u] - x[w]) * (py - y[w]) - (y[u] - y[w]) * (px - x[w]) < 0:
                t = near[t][1]
            elif (x[v] - x[u]) * (py - y[u]) - (y[v] - y[u]) * (px - x[u]) < 0:
                t = near[t][2]
            else:
                break
            steps += 1
            if steps > 3 * len(tri):  # rounding may lead in a circle
                break
        if not holds(t, px, py):
            t = next((s for s in range(len(tri)) if tri[s] is not None and holds(s, px, py)), -1)
            if t < 0:
                continue
        bad, stack, rim = {t}, [t], []
        while stack:
            t = stack.pop()
            own, beside = tri[t], near[t]
            for i in range(3):
                n = beside[i]
                if n in bad:
                    continue
                if holds(n, px, py):
                    bad.add(n)
                    stack.append(n)
                else:
                    rim.append((own[i - 2], own[i - 1], n, t))
        rim = [r for r in rim if r[2] not in bad]
        starts, ends, made = {}, {}, []
        for u, v, outside, inside in rim:
            if free:
                s = free.pop()
            else:
                s = len(tri)
                tri.append(None)
                near.append(None)
            tri[s], near[s] = [u, v, k], [-1, -1, outside]
            other = near[outside]
            other[other.index(inside)] = s
            starts[u], ends[v] = s, s
            made.append(s)
        for s in made:
            u, v, _ = tri[s]
            near[s][0], near[s][1] = starts[v], ends[u]
        for t in bad:
            tri[t] = None
            free.append(t)
        last = made[-1]
    return np.array([t for t in tri if t is not None], np.int64).reshape(-1, 3)


def circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, radii, heights over the longest side) of triangles."""
    a = p[tri[:, 0]]
    b, c = p[tri[:, 1]] - a, p[tri[:, 2]] - a
    twice = b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]
    b2, c2 = (b * b).sum(1), (c * c).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        o = np.stack([c[:, 1] * b2 - b[:, 1] * c2, b[:, 0] * c2 - c[:, 0] * b2], 1) / (2 * twice)[:, None]
    longest = np.sqrt(np.maximum(np.maximum(b2, c2), ((b - c) ** 2).sum(1)))
    return a + o, np.hypot(o[:, 0], o[:, 1]), np.abs(twice) / longest


def delaunay(points: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles; of points on one circle those that a slight move of each decides, the same everywhere. A repeated point counts once, at its first place, and a straight line has none."""
    if len(points) < 3:
        return []
    p = np.array(points, float)
    _, first = np.unique(np.round(p / GRID).astype(np.int64), axis=0, return_index=True)
    first.sort()
    moved = shaken(p[first])
    tri = triangulated(moved)
    tri = tri[(tri >= 0).all(1)]
    tri = tri[circles(moved, tri)[2] >= FLAT]
    return sorted(map(tuple, np.sort(first[tri], axis=1).tolist()))


def spanning_forest(weighted: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Edges of a minimum spanning forest, by weight and then ends."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for w, u, v in sorted(weighted):
        a, b = top(u), top(v)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((w, u, v))
    return out
