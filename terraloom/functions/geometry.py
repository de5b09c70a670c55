"""Geometry as columns: points, rings, polygons and lines, measured by built-in functions.

A point is ``struct<x, y>``, a ring or line an array of points (rings are closed: the first point is the last one too) and a polygon ``struct<shell, holes>``. All in
one projected system of metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"struct<shell:{RING},holes:array<{RING}>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A rectangle along the axes, counter-clockwise."""
    shell = F.array(point(x1, y1), point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1))
    return polygon(shell)


def polygon(shell: Column, holes: Column | None = None) -> Column:
    empty = F.array().cast(f"array<{RING}>")
    return F.struct(shell.alias("shell"), (empty if holes is None else holes).alias("holes"))


def once(value: Column, make) -> Column:
    """What ``make`` says of a value that is worked out once: else each mention of a derived column repeats all that it is made of, for every side of a ring."""
    return F.transform(F.array(value), make)[0]


def segments(line: Column) -> Column:
    """array<struct<x1, y1, x2, y2>> of neighbouring points."""
    n = F.size(line)
    ends = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return F.when(n > 1, ends).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def _total(values: Column, each) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + each(v))


def ring_area(ring: Column) -> Column:
    """Signed; counter-clockwise rings are positive. Coordinates are taken from the first point on, for small figures far from the origin."""

    def signed(ring: Column) -> Column:
        ox, oy = ring[0]["x"], ring[0]["y"]
        return _total(segments(ring), lambda s: (s["x1"] - ox) * (s["y2"] - oy) - (s["x2"] - ox) * (s["y1"] - oy)) / 2

    return once(ring, signed)


def area(shape: Column) -> Column:
    """Of a polygon: shell less holes."""
    return once(shape, lambda s: F.abs(ring_area(s["shell"])) - _total(s["holes"], lambda h: F.abs(ring_area(h))))


def length(line: Column) -> Column:
    return _total(once(line, segments), lambda s: F.sqrt((s["x2"] - s["x1"]) * (s["x2"] - s["x1"]) + (s["y2"] - s["y1"]) * (s["y2"] - s["y1"])))


def perimeter(shape: Column) -> Column:
    return once(shape, lambda s: length(s["shell"]) + _total(s["holes"], length))


def bounds(line: Column) -> Column:
    xs, ys = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def is_box(shape: Column) -> Column:
    """Whether a polygon is the rectangle of its bounds."""
    b = bounds(shape["shell"])
    return (F.size(shape["holes"]) == 0) & (F.abs(ring_area(shape["shell"])) == (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))


def centroid(shape: Column) -> Column:
    """Of the shell; inside it if that is convex."""
    ring = shape["shell"]
    ox, oy = ring[0]["x"], ring[0]["y"]
    cross = lambda s: (s["x1"] - ox) * (s["y2"] - oy) - (s["x2"] - ox) * (s["y1"] - oy)
    six = 6 * ring_area(ring)
    return point(ox + _total(segments(ring), lambda s: (s["x1"] + s["x2"] - 2 * ox) * cross(s)) / six, oy + _total(segments(ring), lambda s: (s["y1"] + s["y2"] - 2 * oy) * cross(s)) / six)


def _canonical_ring(ring: Column) -> Column:
    corners = F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda p: F.struct(F.round(p["x"] * 1000).cast("long").alias("x"), F.round(p["y"] * 1000).cast("long").alias("y")))
    corners = F.when(ring_area(ring) < 0, F.reverse(corners)).otherwise(corners)
    first = F.array_position(corners, F.array_min(corners)).cast("int")
    return F.concat(F.slice(corners, first, F.size(corners)), F.slice(corners, F.lit(1), first - 1))


def canonical(shape: Column) -> Column:
    """The rings of a polygon in millimetres, each from its least corner on and counter-clockwise, holes in order: equal for identical shapes."""
    return F.struct(_canonical_ring(shape["shell"]).alias("shell"), F.array_sort(F.transform(shape["holes"], _canonical_ring)).alias("holes"))


def roundness(shape: Column) -> Column:
    """Perimeter over that of a circle of equal area; a circle has 1."""
    return perimeter(shape) / (2 * F.sqrt(F.lit(math.pi) * area(shape)))


def direction(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Of an undirected segment, in degrees from 0 up to but not including 180."""
    turn = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.pmod(F.when(turn < 0, turn + 180).otherwise(turn), F.lit(180.0))


def foot(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """struct<x, y, distance> of the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square)))
    x, y = x1 + t * dx, y1 + t * dy
    return F.struct(x.alias("x"), y.alias("y"), F.sqrt((px - x) * (px - x) + (py - y) * (py - y)).alias("distance"))


def segments_meet(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column, sx: Column, sy: Column) -> Column:
    """Whether segments pq and rs, whose bounds meet, have a point in common, ends included."""
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (turn(px, py, qx, qy, rx, ry) * turn(px, py, qx, qy, sx, sy) <= 0) & (turn(rx, ry, sx, sy, px, py) * turn(rx, ry, sx, sy, qx, qy) <= 0)


def ring_covers(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring, by the sides that a ray to the right crosses; its border isn't told apart."""
    crossed = lambda s: ((s["y1"] > y) != (s["y2"] > y)) & F.coalesce(x < s["x1"] + F.try_divide((y - s["y1"]) * (s["x2"] - s["x1"]), s["y2"] - s["y1"]), F.lit(False))
    return F.aggregate(segments(ring), F.lit(False), lambda inside, s: inside != crossed(s))


def covers(shape: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon and in none of its holes."""
    return ring_covers(shape["shell"], x, y) & ~F.exists(shape["holes"], lambda h: ring_covers(h, x, y))


def box_distance(px: Column, py: Column, b: Column) -> Column:
    """From a point to the bounds b, 0 inside."""
    dx = F.greatest(b["x1"] - px, F.lit(0.0), px - b["x2"])
    dy = F.greatest(b["y1"] - py, F.lit(0.0), py - b["y2"])
    return F.sqrt(dx * dx + dy * dy)


def least_vertex_distance(a: Column, b: Column) -> Column:
    """Between any two vertices of two rings."""
    return F.sqrt(F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))))))


def shared_length(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Length on which two segments lie on one another."""
    dx, dy = a["x2"] - a["x1"], a["y2"] - a["y1"]
    long = F.sqrt(dx * dx + dy * dy)
    off = lambda x, y: F.abs((x - a["x1"]) * dy - (y - a["y1"]) * dx) / long
    along = lambda x, y: ((x - a["x1"]) * dx + (y - a["y1"]) * dy) / long
    t1, t2 = along(b["x1"], b["y1"]), along(b["x2"], b["y2"])
    shared = F.least(F.greatest(t1, t2), long) - F.greatest(F.least(t1, t2), F.lit(0.0))
    return F.when((long > 0) & (off(b["x1"], b["y1"]) <= tolerance) & (off(b["x2"], b["y2"]) <= tolerance) & (shared > 0), shared).otherwise(0.0)
