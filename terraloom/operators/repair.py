"""Repair of rings that cross or touch themselves, for the shapes of an Arrow batch at once.

The same parts as of ``plane.simple_parts``: sides are cut where they meet, a piece is part of the outline if the winding numbers on its two sides say so, and the outline is chained to rings as in ``network``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from terraloom.functions import plane
from terraloom.operators import network

#: Corners of a shape that is cut together with others, all pairs of its sides at once; those of more go one by one, along a sweep.
SIDES = 128
#: Pairs of sides or pieces that are held at once.
PAIRS = 1 << 19

_POINT = pa.struct([pa.field("x", pa.float64()), pa.field("y", pa.float64())])


def _sides(shapes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the shape, number of the ring in it (0: the shell) and ends of all sides, on the grid, by shape."""
    shell, holes = shapes.flatten()
    inner = holes.flatten()
    n = len(shapes)
    of = [np.arange(n), np.repeat(np.arange(n), np.diff(holes.offsets.to_numpy()))]
    ring = [np.zeros(n, np.int64), np.arange(len(of[1])) - np.searchsorted(of[1], of[1]) + 1]
    out = []
    for o, r, lists in zip(of, ring, (shell, inner), strict=True):
        offsets = lists.offsets.to_numpy().astype(np.int64)
        size = np.diff(offsets)
        flat = lists.values
        p = np.stack([c.to_numpy()[offsets[0] : offsets[-1]] for c in flat.flatten()], 1) if len(size) else np.zeros((0, 2))
        p = np.round(np.round(p / plane.GRID) * plane.GRID, 6)
        after = np.arange(len(p)) + 1
        some = size > 0
        after[(offsets[1:] - offsets[0])[some] - 1] = (offsets[:-1] - offsets[0])[some]
        out.append((np.repeat(o, size), np.repeat(r, size), np.concatenate([p, p[after]], 1)))
    of_, ring_, side = (np.concatenate(c) for c in zip(*out, strict=True))
    long = (side[:, :2] != side[:, 2:]).any(1)
    order = np.flatnonzero(long)[np.argsort(of_[long], kind="stable")]
    return of_[order], ring_[order], side[order]


def _both(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, j) with j from first[k] on and before last[k], some at a time."""
    many = last - first
    chunk = (np.cumsum(many) - many) // PAIRS
    cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else [], len(many)).astype(np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        m = many[a:b]
        yield np.repeat(np.arange(a, b), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[a:b], m)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by columns, the first one first, and the number of each row's run of equal ones, in that order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.cumsum(new)


def _outlines(of: np.ndarray, ring: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the shape and ends of the pieces that bound what its shell winds around and no hole does, with that on their left."""
    ends = np.searchsorted(of, of, "right")
    low, high = np.minimum(side[:, :2], side[:, 2:]) - plane.GRID, np.maximum(side[:, :2], side[:, 2:]) + plane.GRID
    cut, at = [np.arange(len(side))] * 2, [side[:, :2], side[:, 2:]]
    for i, j in _both(np.arange(len(side)) + 1, ends):
        near = ((low[j] <= high[i]) & (high[j] >= low[i])).all(1)
        i, j = i[near], j[near]
        turned = low[j, 0] < low[i, 0]  # as in ``plane.noded``: which side is cut by which decides on the last millimetre
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        pair, points = plane._meetings(side[i], side[j])
        cut, at = [*cut, i[pair], j[pair]], [*at, points, points]
    cut_, points = np.concatenate(cut), np.concatenate(at)
    points = np.round(np.round(points / plane.GRID) * plane.GRID, 6) + 0.0
    along = ((points - side[cut_, :2]) * (side[cut_, 2:] - side[cut_, :2])).sum(1)
    order = np.lexsort((along, cut_))
    cut_, points = cut_[order], points[order]
    keep = (cut_[1:] == cut_[:-1]) & (points[1:] != points[:-1]).any(1)
    a, b, cut_ = points[:-1][keep], points[1:][keep], cut_[:-1][keep]
    back = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1]))
    p = np.where(back[:, None], np.concatenate([b, a], 1), np.concatenate([a, b], 1))
    # how often, less how often the other way, each ring passes each piece
    order, run = _runs(of[cut_], *p.T, ring[cut_])
    if not len(order):
        return of[:0], side[:0]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    times = np.bincount(run, np.where(back, -1, 1)[order])
    p, of_, ring_ = p[order[first]], of[cut_[order[first]]], ring[cut_[order[first]]]
    new = np.append(True, (of_[1:] != of_[:-1]) | (p[1:] != p[:-1]).any(1))
    piece = np.cumsum(new) - 1
    q, whose = p[new], of_[new]
    # winding numbers of a shape's rings at each of its pieces: right beside it on the side with greater x, or above it if it lies flat
    rings = np.maximum.reduceat(ring_, np.flatnonzero(np.append(True, of_[1:] != of_[:-1])))[np.cumsum(np.append(True, whose[1:] != whose[:-1])) - 1] + 1
    base = np.cumsum(rings) - rings
    x, y = (q[:, 0] + q[:, 2]) / 2, (q[:, 1] + q[:, 3]) / 2
    beside = np.zeros(rings.sum())
    for i, j in _both(np.searchsorted(of_, whose), np.searchsorted(of_, whose, "right")):
        met = ((p[j, 1] > y[i]) != (p[j, 3] > y[i])) & (piece[j] != i)
        i, j = i[met], j[met]
        met = x[i] < p[j, 0] + (y[i] - p[j, 1]) * (p[j, 2] - p[j, 0]) / (p[j, 3] - p[j, 1])
        i, j = i[met], j[met]
        np.add.at(beside, base[i] + ring_[j], np.where(p[j, 3] > p[j, 1], times[j], -times[j]))
    own = np.zeros(len(beside))
    own[base[piece] + ring_] = times
    is_left = np.repeat(q[:, 3] <= q[:, 1], rings)
    holds = lambda w: (w[base] != 0) & (np.add.reduceat(w != 0, base) == (w[base] != 0))
    left, right = holds(beside + np.where(is_left, 0, own)), holds(beside - np.where(is_left, own, 0))
    rim = left != right
    q, left = q[rim], left[rim]
    return whose[rim], np.where(left[:, None], q, q[:, [2, 3, 0, 1]])


def _uneven(of: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Shapes with a node that pieces don't enter and leave by turns: rounding has made pieces cross beside a node."""
    x1, y1, x2, y2 = edges.T
    out = np.repeat([False, True], len(of))
    turn = np.concatenate([np.arctan2(y1 - y2, x1 - x2), np.arctan2(y2 - y1, x2 - x1)])
    shape, x, y = np.tile(of, 2), np.concatenate([x2, x1]), np.concatenate([y2, y1])
    order = np.lexsort((out, turn, y, x, shape))
    shape, x, y, turn, out = (c[order] for c in (shape, x, y, turn, out))
    new = np.append(True, (shape[1:] != shape[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(out)) - 1
    wrong = ~new & ((out == np.roll(out, 1)) | (turn == np.roll(turn, 1)))
    wrong[first] = out[first] == out[last]
    return np.unique(shape[wrong])


def _parts(shapes: pa.StructArray) -> tuple[np.ndarray, pa.ListArray, list[list], np.ndarray]:
    """Number of the shape, shell and holes (of few) of the parts of shapes, which come by shape and least corner, and the shapes that are left out as they need the kernel."""
    of, edges = _outlines(*_sides(shapes))
    left_out = _uneven(of, edges) if len(of) else of
    if len(left_out):
        kept = ~np.isin(of, left_out)
        of, edges = of[kept], edges[kept]
    n = len(of)
    every = pa.array(np.ones(n, bool))
    table = pa.table({"__t": of, "key": of, "e": np.arange(n), "x1": edges[:, 0], "y1": edges[:, 1], "x2": edges[:, 2], "y2": edges[:, 3], "starts": every, "ends": every})
    made = network._closed(network._chains(table, "key").select(["key", "least", "points"]).rename_columns(["key", "ring", "points"]), "key", False)
    of, line, area = made.column("key").to_numpy(), made.column("line"), made.column("area").to_numpy()
    size = np.diff(line.offsets.to_numpy())
    flat = np.stack([c.to_numpy() for c in line.values.flatten()], 1) if len(line) else np.zeros((0, 2))
    ring = np.repeat(np.arange(len(size)), size)
    least = flat[np.lexsort((flat[:, 1], flat[:, 0], ring))[np.cumsum(size) - size]]
    order = np.lexsort((least[:, 1], least[:, 0], of))
    shells = order[area[order] > 0]
    holes: list[list] = [[] for _ in shells]
    rims = np.flatnonzero(area < 0)
    if len(rims):
        corners = lambda k: [(p["x"], p["y"]) for p in line[int(k)].as_py()]
        for k in rims.tolist():
            first, last = np.searchsorted(of[shells], of[k]), np.searchsorted(of[shells], of[k], "right")
            around = [j for j in range(first, last) if plane._rim_inside(corners(k), corners(shells[j]))]
            if around:
                holes[min(around, key=lambda j: area[shells[j]])].append(line[k].as_py())
    return of[shells], line.take(pa.array(shells)), holes, left_out


def simple_parts(batch: pa.RecordBatch, key: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """key, part, shape of the parts of a batch's shapes (key, shape)."""
    shapes = batch.column("shape")
    shell, holes = shapes.flatten()
    points = np.diff(shell.offsets.to_numpy()) + np.diff(holes.flatten().offsets.to_numpy()[holes.offsets.to_numpy() - holes.offsets[0].as_py()])
    few = points <= SIDES
    at = np.flatnonzero(few)
    if len(at):
        of, lines, inner, left_out = _parts(shapes.take(pa.array(at)))
        few[at[left_out]] = False
        polygons = pa.StructArray.from_arrays([lines, pa.array(inner, pa.list_(pa.list_(_POINT)))], ["shell", "holes"])
        yield _rows(batch.column(key).take(pa.array(at[of])), np.arange(len(of)) - np.searchsorted(of, of), polygons, schema)
    for k in np.flatnonzero(~few).tolist():
        made = [plane.as_struct(p) for p in plane.simple_parts(plane.as_polygon(shapes[k].as_py()))]
        yield _rows(batch.column(key).take(pa.array(np.full(len(made), k))), np.arange(len(made)), pa.array(made, pa.struct([pa.field("shell", pa.list_(_POINT)), pa.field("holes", pa.list_(pa.list_(_POINT)))])), schema)


def _rows(keys: pa.Array, part: np.ndarray, polygons: pa.StructArray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((keys, pa.array(part), polygons), schema, strict=True)], schema=schema)
