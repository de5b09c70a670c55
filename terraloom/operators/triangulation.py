"""Delaunay triangulation of point layers by tiles with a halo.

Points of a group lie in square cells of some ``per_cell`` points, and ``SIDE`` by ``SIDE`` cells make a tile. A tile triangulates its own points with those of the ring of cells around it. A triangle stands if its circle
lies within what the tile has seen; tiles with others come again. In later rounds a tile gets the corners of the group's hull, a few outermost points of a coarse grid (so that circles are no wider than the gaps between points), and
the cells that its open circles meet: circles go down a pyramid of occupied cells, each level being a join on cells, and only cells whose own bounds reach into a circle are followed. A tile is done once no open circle meets a cell
that it lacks. Each triangle comes from the tile of its least point.

Work is n log n in each tile and nothing holds a whole group; a round costs as many joins as the pyramid has levels, and only unfinished tiles take part. A place of more than ``per_cell`` points in one cell is a
larger tile, not a wrong one. Points move by a micrometre by a hash of their place (``plane.shaken``), so tiles agree where more than three lie on one circle. Points of one place count once, under
their least id; groups on a straight line have no triangle.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import plane
from terraloom.store import Workspace

PER_CELL, SIDE = 64, 4
#: Cells that a tile asks for in one round, and coarse cells along the longer side of a group.
ASKED, COARSE = 64, 12
#: A circle meets what reaches further into it than this.
TOUCH = 1e-5
_TILE = ["g", "tx", "ty"]
_CIRCLE = "tx long, ty long, a long, b long, c long, ox double, oy double, r double, sure boolean, own boolean"


def _frame(spots: DataFrame, per_cell: int) -> DataFrame:
    """g, gx, gy, cell, columns, rows and shift (from cells to the coarse grid) of each group."""
    f = spots.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("gx"), F.min("y").alias("gy"), F.max("x").alias("hx"), F.max("y").alias("hy"))
    wide, high, share = F.col("hx") - F.col("gx"), F.col("hy") - F.col("gy"), F.lit(float(per_cell)) / F.col("n")
    f = f.withColumn("cell", F.greatest(F.sqrt(wide * high * share), F.greatest(wide, high) * share, F.lit(1.0)))
    f = f.withColumns({"columns": F.floor(wide / F.col("cell")) + 1, "rows": F.floor(high / F.col("cell")) + 1})
    shift = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("columns", "rows") / F.lit(float(COARSE))))).cast("int")
    return f.select("g", "gx", "gy", "cell", "columns", "rows", shift.alias("shift"))


def _pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """g, level, cx, cy and the bounds of the points of every occupied cell of each level."""
    up = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long").alias(c)
    up = up.select("g", "level", at("cx"), at("cy"), "x1", "y1", "x2", "y2")
    return up.groupBy("g", "level", "cx", "cy").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def _outermost(spots: DataFrame) -> DataFrame:
    """g, id, x, y: the outermost points of each coarse cell and the corners of each group's hull; a number that does not grow with the group, but for the hull."""
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("shift"))).cast("long")
    point = F.struct("id", "x", "y")
    extremes = [f(point, c).alias(f"e{k}") for k, (f, c) in enumerate(((F.min_by, "x"), (F.max_by, "x"), (F.min_by, "y"), (F.max_by, "y")))]
    few = spots.groupBy("g", at("cx").alias("ux"), at("cy").alias("uy")).agg(*extremes).select("g", F.explode(F.array("e0", "e1", "e2", "e3")).alias("p")).select("g", "p.*")

    def rim(rows: pd.DataFrame) -> pd.DataFrame:
        on = {(x, y) for x, y in plane.hull(list(zip(rows["x"], rows["y"], strict=True)))}
        return rows[[q in on for q in zip(rows["x"], rows["y"], strict=True)]]

    part = spots.groupBy("g", F.floor(F.col("cx") / 8).alias("ux"), F.floor(F.col("cy") / 8).alias("uy"))
    corners = part.applyInPandas(lambda rows: rim(rows[["g", "id", "x", "y"]]), "g long, id long, x double, y double")
    corners = corners.groupBy("g").applyInPandas(rim, "g long, id long, x double, y double")
    return few.unionByName(corners).distinct()


def _local(rows: pa.Table) -> pa.Table:
    """The triangles at a tile's own points, with their circles and whether these lie within what it has seen; a row without corners says that the tile may end at own points for want of others."""
    first = {c: rows.column(c)[0].as_py() for c in (*_TILE, "gx", "gy", "cell", "columns", "rows", "outer")}
    ids, own, p = rows.column("id").to_numpy(), rows.column("own").to_numpy(), np.stack([rows.column("x").to_numpy(), rows.column("y").to_numpy()], 1)
    order = np.lexsort((~own, ids))
    order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
    ids, own, p = ids[order], own[order], plane.shaken(p[order])
    tri = plane.triangulated(p)
    # how far the ring reaches; beyond the group's own bounds nothing lies
    lo = np.array([first["tx"], first["ty"]]) * SIDE - 1
    hi = lo + SIDE + 2
    frame, cell = np.array([first["gx"], first["gy"]]), first["cell"]
    low = np.where(lo <= 0, -np.inf, frame + lo * cell)
    high = np.where(hi >= np.array([first["columns"], first["rows"]]), np.inf, frame + hi * cell)
    whole = bool(np.isinf(low).all() and np.isinf(high).all())
    ghosts = tri[(tri < 0).any(1)]
    tri = tri[(tri >= 0).all(1)]
    tri = tri[own[tri].any(1)]
    o, r, height = plane.circles(p, tri) if len(tri) else (np.zeros((0, 2)), np.zeros(0), np.zeros(0))
    sure = np.full(len(tri), whole) | ((o - r[:, None] >= low) & (o + r[:, None] <= high)).all(1)
    named = np.sort(ids[tri], axis=1) if len(tri) else np.zeros((0, 3), np.int64)
    mine = np.isin(named[:, 0], ids[own]) & (height >= plane.FLAT)
    keep = mine | ~sure & np.isfinite(r)
    bare = (len(tri) == 0 or any(own[t[t >= 0]].any() for t in ghosts)) and not whole and not first["outer"]
    n = int(keep.sum()) + bare
    column = lambda x, kind, none=None: pa.array([*x[keep].tolist(), none] if bare else x[keep], kind)
    out = {c: pa.array([first[c]] * n, pa.int64()) for c in _TILE} | {c: column(named[:, k], pa.int64()) for k, c in enumerate("abc")}
    out |= {"ox": column(o[:, 0], pa.float64()), "oy": column(o[:, 1], pa.float64()), "r": column(r, pa.float64()), "sure": column(sure, pa.bool_(), False), "own": column(mine, pa.bool_(), False)}
    return pa.table(out)


def _reaches(into: str = "r") -> Column:
    dx = F.greatest(F.col("x1") - F.col("ox"), F.lit(0.0), F.col("ox") - F.col("x2"))
    dy = F.greatest(F.col("y1") - F.col("oy"), F.lit(0.0), F.col("oy") - F.col("y2"))
    return F.sqrt(dx * dx + dy * dy) < F.col(into) - TOUCH


def _lacking(open_: DataFrame, frame: DataFrame, pyramid: DataFrame, have: DataFrame, levels: int, store: Workspace) -> DataFrame:
    """g, tx, ty, cx, cy: occupied cells that open circles meet and their tiles lack, the nearest ``ASKED`` of each tile."""
    circle = open_.select(*_TILE, "ox", "oy", "r").join(frame, "g")
    side = lambda c, g, n, sign: F.least(F.greatest(F.floor((F.col(c) + sign * F.col("r") - F.col(g)) / F.col("cell")), F.lit(0)), F.col(n) - 1).cast("long")
    circle = circle.withColumns({"c1": side("ox", "gx", "columns", -1), "c2": side("ox", "gx", "columns", 1), "r1": side("oy", "gy", "rows", -1), "r2": side("oy", "gy", "rows", 1)})
    span = F.greatest(F.col("c2") - F.col("c1"), F.col("r2") - F.col("r1"))
    circle = circle.withColumn("start", F.least(F.lit(levels), F.ceil(F.log2(F.greatest(span, F.lit(1)) / F.lit(3.0))).cast("int"))).withColumn("start", F.greatest("start", F.lit(0)))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("start"))).cast("long")
    began = circle.withColumn("cx", F.explode(F.sequence(at("c1"), at("c2")))).withColumn("cy", F.explode(F.sequence(at("r1"), at("r2"))))
    began = store.save(began.select(*_TILE, "ox", "oy", "r", "start", "cx", "cy"), "circles")
    top = began.agg(F.max("start")).first()[0]
    front = None
    for level in range(top or 0, -1, -1):
        here = began.where(F.col("start") == level).drop("start")
        front = here if front is None else front.unionByName(here)
        known = pyramid.where(F.col("level") == level).drop("level")
        front = front.join(known, ["g", "cx", "cy"]).where(_reaches()).drop("x1", "y1", "x2", "y2")
        if level:
            child = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
            front = front.withColumn("cx", child("cx")).withColumn("cy", child("cy"))
            if level % 3 == 0:
                front = store.save(front, "front")
    x, y = F.col("cx") - (F.col("tx") + 0.5) * SIDE + 0.5, F.col("cy") - (F.col("ty") + 0.5) * SIDE + 0.5
    met = front.select(*_TILE, "cx", "cy").distinct()
    met = met.where((F.abs(x) > SIDE / 2 + 1) | (F.abs(y) > SIDE / 2 + 1)).join(have, [*_TILE, "cx", "cy"], "left_anti")
    # the nearest ones, of which a tile never has more than its circles meet
    ranked = met.groupBy(*_TILE).agg(F.slice(F.array_sort(F.collect_list(F.struct((x * x + y * y).alias("d"), "cx", "cy"))), 1, ASKED).alias("near"))
    return ranked.select(*_TILE, F.explode("near").alias("n")).select(*_TILE, "n.cx", "n.cy")


def triangles(points: DataFrame, key: str, store: Workspace, per_cell: int = PER_CELL) -> DataFrame:
    """key, a, b, c (ids, rising) and ox, oy, r (circle) of each group's Delaunay triangles; ``points`` have key, id (long), x and y."""
    kind = dict(points.dtypes)[key]
    place = [F.round(F.col(c) / plane.GRID).cast("long") for c in ("x", "y")]
    once = points.groupBy(F.col(key).alias("k"), place[0].alias("mx"), place[1].alias("my")).agg(F.min("id").alias("id"))
    once = once.select(F.xxhash64("k").alias("g"), "k", "id", (F.col("mx") * plane.GRID).alias("x"), (F.col("my") * plane.GRID).alias("y"))
    once = store.save(once, "points")
    names = once.select("g", "k").distinct()
    frame = store.save(_frame(once, per_cell), "frame")
    cell = lambda c, g: F.floor((F.col(c) - F.col(g)) / F.col("cell")).cast("long")
    spots = store.save(once.drop("k").join(frame, "g").withColumns({"cx": cell("x", "gx"), "cy": cell("y", "gy")}), "cells")

    near = lambda c: F.explode(F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor((F.col(c) + d) / SIDE).cast("long"))))
    home = (F.floor(F.col("cx") / SIDE) == F.col("tx")) & (F.floor(F.col("cy") / SIDE) == F.col("ty"))
    ring = spots.withColumn("tx", near("cx")).withColumn("ty", near("cy")).withColumn("own", home)
    columns = [*_TILE, "id", "x", "y", "own", "gx", "gy", "cell", "columns", "rows"]
    own_tiles = spots.select("g", F.floor(F.col("cx") / SIDE).cast("long").alias("tx"), F.floor(F.col("cy") / SIDE).cast("long").alias("ty")).distinct()
    ring = ring.select(*columns).join(own_tiles, _TILE, "left_semi")

    made = store.save(ring.withColumn("outer", F.lit(False)).groupBy(*_TILE).applyInArrow(_local, f"g long, {_CIRCLE}"), "triangles")
    left = store.save(made.where("not sure").select(*_TILE).distinct(), "open")
    done = made.where("own").join(left, _TILE, "left_anti")
    if not left.isEmpty():
        most = frame.agg(F.max(F.greatest("columns", "rows"))).first()[0]
        levels = max(0, math.ceil(math.log2(most)))
        cells = spots.groupBy("g", "cx", "cy").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
        pyramid = store.save(_pyramid(cells, levels), "pyramid")
        outer = store.save(_outermost(spots), "outermost")
        have = store.save(own_tiles.where("false").select(*_TILE, F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy")), "have")
        while True:
            ringed = ring.join(left, _TILE, "left_semi")
            far = left.join(outer, "g").join(frame, "g").withColumn("own", F.lit(False)).select(*columns)
            asked = have.join(spots, ["g", "cx", "cy"]).withColumn("own", F.lit(False)).select(*columns)
            every = ringed.unionByName(far).unionByName(asked).withColumn("outer", F.lit(True))
            made = store.save(every.groupBy(*_TILE).applyInArrow(_local, f"g long, {_CIRCLE}"), "triangles")
            more = store.save(_lacking(made.where("not sure"), frame, pyramid, have, levels, store), "lacking")
            left = store.save(more.select(*_TILE).distinct(), "open")
            done = done.unionByName(made.where("own").join(left, _TILE, "left_anti"))
            if left.isEmpty():
                break
            have = store.save(have.join(left, _TILE, "left_semi").unionByName(more), "have")
    out = done.join(names, "g")
    return out.select(F.col("k").cast(kind).alias(key), "a", "b", "c", "ox", "oy", "r")


def edges(found: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """key, u, v (u < v) and lo, hi of the distinct sides of triangles.

    The centres of all circles through u and v with no point inside lie on the line midway between them, from lo to hi metres to the left of the middle, seen from u; null is without end. Where lo
    and hi are equal, more points lie on the one circle, and another triangulation may do without the edge.
    """
    at = lambda n: points.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    rows = found.join(at("a"), "a").join(at("b"), "b").join(at("c"), "c")
    corner = lambda u, v, w: F.struct(*(F.col(f"{n}{c}").alias(f"{m}{c}") for n, m in ((u, "u"), (v, "v"), (w, "w")) for c in ("", "x", "y")))
    s = rows.select(key, F.explode(F.array(corner("a", "b", "c"), corner("b", "c", "a"), corner("a", "c", "b"))).alias("__e")).select(key, "__e.*")
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    mx, my = F.col("wx") - (F.col("ux") + F.col("vx")) / 2, F.col("wy") - (F.col("uy") + F.col("vy")) / 2
    side, square = dx * (F.col("wy") - F.col("uy")) - dy * (F.col("wx") - F.col("ux")), dx * dx + dy * dy
    along = (mx * mx + my * my - square / 4) * F.sqrt(square) / (2 * side)
    return s.groupBy(key, "u", "v").agg(F.max(F.when(side < 0, along)).alias("lo"), F.min(F.when(side > 0, along)).alias("hi"))


def unmistakable(sides: DataFrame, apart: float = 1e-3) -> DataFrame:
    """Those edges that every Delaunay triangulation has: ``lo`` and ``hi`` further apart than rounding."""
    return sides.where(F.coalesce(F.col("hi") - F.col("lo") > apart, F.lit(True)))
