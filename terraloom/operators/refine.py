"""Refinement of outlines: blocks from lines, holes, gaps, edges caught by blocks.

Functions on lists of polygons work on one group; their DataFrame forms run them for each group of a key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.functions.plane import Polygon
from terraloom.operators import graph
from terraloom.store import by_group

HOLE, GAP, CLOSING, SLIVER, CONTACT, SNAP, JOINT, GROWTH = 10000.0, 4900.0, 30.0, 400.0, 70.0, 70.0, 70.0, 3.0


def polygonized(lines: np.ndarray) -> list[Polygon]:
    """Faces bounded by lines, cut where they meet."""
    return plane.faces(plane.noded(lines))


def holes_closed(shapes: list[Polygon], below: float = HOLE) -> list[Polygon]:
    """The union without holes under ``below``, those between shapes too."""
    return [Polygon(p.shell, [h for h in p.holes if abs(plane.signed_area(h)) >= below]) for p in plane.dissolved(shapes)]


def contact(gap: Polygon, shapes: list[Polygon]) -> float:
    """The percentage of a gap's perimeter that lies on the borders of shapes."""
    rim = plane.edges(shapes)
    own = plane.noded(np.vstack([plane.edges([gap]), rim]))
    sides = plane.edges([gap])
    touching = 0.0
    for x1, y1, x2, y2 in own.tolist():
        x, y = (x1 + x2) / 2, (y1 + y2) / 2
        if _on(x, y, sides) and _on(x, y, rim):
            touching += float(np.hypot(x2 - x1, y2 - y1))
    return 100 * touching / plane.perimeter(gap)


def _on(x: float, y: float, lines: np.ndarray) -> bool:
    dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
    t = np.clip(((x - lines[:, 0]) * dx + (y - lines[:, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
    return bool((np.hypot(lines[:, 0] + t * dx - x, lines[:, 1] + t * dy - y) <= 2 * plane.GRID).any())


def gaps_closed(shapes: list[Polygon], zone: list[Polygon], below: float = GAP, distance: float = CLOSING, least: float = CONTACT, sliver: float = SLIVER, holes_below: float = HOLE) -> list[Polygon]:
    """Fills small parts of blocks that the outline leaves out and that lie on it for most of their border, then what closing by ``distance`` fills.

    A gap without any contact is dropped.
    """
    shapes = holes_closed(shapes, holes_below)
    left = [p for part in plane.symmetric_difference(zone, shapes) for p in part if plane.area(p) < below]
    shapes = plane.dissolved(shapes + [p for p in left if contact(p, shapes) >= least])
    closed = _shrunk(plane.buffered(shapes, distance), distance)
    extra = [p for p in plane.difference(closed, shapes) if plane.area(p) >= sliver]
    shapes = plane.dissolved(shapes + [p for p in extra if contact(p, shapes) >= least])
    return holes_closed(shapes, holes_below)


def _shrunk(shapes: list[Polygon], distance: float) -> list[Polygon]:
    """All points of shapes further than ``distance`` from their outside."""
    if not shapes:
        return []
    x1, y1 = min(plane._box(p)[0] for p in shapes) - 2 * distance, min(plane._box(p)[1] for p in shapes) - 2 * distance
    x2, y2 = max(plane._box(p)[2] for p in shapes) + 2 * distance, max(plane._box(p)[3] for p in shapes) + 2 * distance
    frame = Polygon(plane.as_ring([(x1, y1), (x2, y1), (x2, y2), (x1, y2)]), [])
    outside = plane.buffered(plane.difference([frame], shapes), distance)
    return plane.difference(shapes, outside)


def edges_caught(cluster: Polygon, zone: list[Polygon], roads: np.ndarray, buildings: list[Polygon], reach: float = SNAP, growth: float = GROWTH) -> list[Polygon]:
    """Grows a cluster's outline to roads closer than ``reach`` to its corners, within blocks that hold buildings; pieces of ``growth`` times its size or more are left out.

    A cluster without a road near enough gives nothing.
    """
    near = [b for b in zone if plane.intersects(b, cluster)]
    hit = np.zeros(len(roads), bool)
    for side in plane.edges(near):
        hit |= plane.meets(side, roads)
    lines = roads[hit]
    if not len(lines):
        return []
    links, used = [], set()
    for x, y in cluster.shell[:-1]:
        dx, dy = lines[:, 2] - lines[:, 0], lines[:, 3] - lines[:, 1]
        t = np.clip(((x - lines[:, 0]) * dx + (y - lines[:, 1]) * dy) / np.maximum(dx * dx + dy * dy, 1e-12), 0, 1)
        fx, fy = lines[:, 0] + t * dx, lines[:, 1] + t * dy
        k = int(np.hypot(fx - x, fy - y).argmin())
        if np.hypot(fx[k] - x, fy[k] - y) < reach:
            links.append((x, y, float(fx[k]), float(fy[k])))
            used.add(k)
    if not links:
        return []
    parts = polygonized(np.vstack([plane.edges([cluster]), np.array(links), lines[sorted(used)]]))
    parts = [p for p in parts if any(plane.intersects(p, b) for b in buildings)]
    held = [b for b in near if any(plane.intersects(b, x) for x in buildings)]
    pieces = plane.intersection(parts, held) if parts and held else []
    return [p for p in pieces if plane.area(p) < growth * plane.area(cluster)]


# ---- for each group of a key

OUT = f"part int, shape {g.POLYGON}"


def parts(made: list[Polygon]) -> list[tuple]:
    """Rows of ``OUT``."""
    return [(k, plane.as_struct(p)) for k, p in enumerate(sorted(made, key=lambda p: min(p.shell)))]


def sides_of(rows: list[dict]) -> np.ndarray:
    return np.array([(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows], float).reshape(-1, 4)


def grouped(layer: DataFrame, key: str, make: Callable[[list[Polygon]], list[Polygon]]) -> DataFrame:
    """key, part, shape: what a function makes of the shapes of each group."""
    return by_group(layer.select(key, "shape"), key, lambda rows: parts(make([plane.as_polygon(r["shape"]) for r in rows])), OUT)


def grouped_with(layer: DataFrame, other: DataFrame, key: str, make: Callable[[list[Polygon], list[Polygon]], list[Polygon]]) -> DataFrame:
    """As ``grouped``, with the shapes of a second layer."""
    both = layer.select(key, F.lit(True).alias("first"), "shape").unionByName(other.select(key, F.lit(False).alias("first"), "shape"))

    def run(rows: list[dict]) -> list[tuple]:
        one, two = ([plane.as_polygon(r["shape"]) for r in rows if r["first"] == first] for first in (True, False))
        return parts(make(one, two)) if one else []

    return by_group(both, key, run, OUT)


def grouped_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, part, shape: the faces of each group's lines."""
    s = lines.select(key, F.explode(g.segments(F.col("line"))).alias("side")).select(key, "side.*")
    return by_group(s, key, lambda rows: parts(polygonized(sides_of(rows))), OUT)


def measured(shapes: DataFrame) -> DataFrame:
    """Adds bounds, is_box, shape_area and shape_len."""
    return shapes.withColumns({"bounds": g.bounds(F.col("shape.shell")), "is_box": g.is_box(F.col("shape")), "shape_area": g.area(F.col("shape")), "shape_len": g.perimeter(F.col("shape"))})


def caught(buildings: DataFrame, roads: DataFrame, zone: DataFrame, key: str, least: float = 18.0) -> DataFrame:
    """key, part, shape: clusters of each group, grown to their roads within its blocks."""
    shapes = buildings.select(key, F.lit("b").alias("kind"), "fid", "shape").unionByName(zone.select(key, F.lit("z").alias("kind"), F.lit(0).cast("long").alias("fid"), "shape"))
    lines = roads.select(key, F.lit("r").alias("kind"), F.explode(g.segments(F.col("line"))).alias("side")).select(key, "kind", "side.*")

    def run(rows: list[dict]) -> list[tuple]:
        kind = {k: [r for r in rows if r["kind"] == k] for k in "bzr"}
        b = sorted((graph.Building(r["fid"], plane.as_polygon(r["shape"])) for r in kind["b"]), key=lambda x: x.fid)
        blocks_, road = [plane.as_polygon(r["shape"]) for r in kind["z"]], sides_of(kind["r"])
        shape = {x.fid: x.shape for x in b}
        made = []
        for members in graph.clusters(b, graph.forest(b, road), least) if b else []:
            made += edges_caught(graph.main_box([shape[m] for m in members]), blocks_, road, [x.shape for x in b])
        return parts(plane.dissolved(made))

    return by_group(shapes.unionByName(lines, allowMissingColumns=True), key, run, OUT)
