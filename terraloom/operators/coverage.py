"""Built-up share of blocks and patches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.operators import reach
from terraloom.operators import spatial_join as sj
from terraloom.store import by_group, spread


def box_union_area(b: np.ndarray) -> float:
    """Of boxes (x1, y1, x2, y2), by compressed coordinates."""
    if len(b) < 2:
        return float(((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])).sum())
    apart = (b[:, None, 2] <= b[None, :, 0]) | (b[None, :, 2] <= b[:, None, 0]) | (b[:, None, 3] <= b[None, :, 1]) | (b[None, :, 3] <= b[:, None, 1])
    np.fill_diagonal(apart, True)
    if apart.all():
        return float(((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])).sum())
    xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
    cover = np.zeros((len(xs), len(ys)), np.int32)
    i1, j1, i2, j2 = np.searchsorted(xs, b[:, 0]), np.searchsorted(ys, b[:, 1]), np.searchsorted(xs, b[:, 2]), np.searchsorted(ys, b[:, 3])
    for at, sign in (((i1, j1), 1), ((i2, j2), 1), ((i1, j2), -1), ((i2, j1), -1)):
        np.add.at(cover, at, sign)
    cover = cover.cumsum(0).cumsum(1)[:-1, :-1]
    return float((np.diff(xs)[:, None] * np.diff(ys)[None, :])[cover > 0].sum())


def built_area(zones: DataFrame, buildings: DataFrame, key: str, tile: float = sj.TILE) -> DataFrame:
    """``key`` and ``built``: the area of each zone that buildings cover, those that overlap counted once.

    Zones are cut at tiles, and areas of the pieces added up, so that no zone of very many buildings is one task.
    """
    a = sj._tiles(sj.slim(zones, key), tile, 0.0)
    b = sj._tiles(sj.slim(buildings), tile, 0.0).select(F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.col("bounds").alias("bb"), F.col("shape").alias("bs"), F.col("is_box").alias("bx"))
    p, q = F.col("bounds"), F.col("bb")
    part = F.struct(
        F.greatest(p["x1"], q["x1"], F.col("tx") * F.lit(tile)).alias("x1"),
        F.greatest(p["y1"], q["y1"], F.col("ty") * F.lit(tile)).alias("y1"),
        F.least(p["x2"], q["x2"], (F.col("tx") + 1) * F.lit(tile)).alias("x2"),
        F.least(p["y2"], q["y2"], (F.col("ty") + 1) * F.lit(tile)).alias("y2"),
    )
    met = a.join(b, (F.col("tx") == F.col("ux")) & (F.col("ty") == F.col("uy"))).withColumn("part", part).where("part.x1 < part.x2 and part.y1 < part.y2")
    both = F.col("is_box") & F.col("bx")
    whole = lambda shape, bounds: F.coalesce(F.col(shape), g.box(*(bounds[c] for c in ("x1", "y1", "x2", "y2"))))
    met = met.select(key, "tx", "ty", "part.x1", "part.y1", "part.x2", "part.y2", both.alias("plain"), F.when(~both, whole("shape", p)).alias("shape"), F.when(~both, whole("bs", q)).alias("bs"))

    return union_areas(met, (key, "tx", "ty"), _piece).groupBy(key).agg(F.sum("area").alias("built"))


def union_areas(pieces: DataFrame, keys: tuple[str, ...], shapes: Callable[[SimpleNamespace], list[plane.Polygon]]) -> DataFrame:
    """The keys and ``area``, what the pieces of a group cover together: boxes (x1, y1, x2, y2) where ``plain``, or else what ``shapes`` makes of a row.

    Groups come sorted, many in a batch: boxes that meet no other one of their group are just added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_starts(table, keys))[-1]) if table.num_rows else 0
            if last:
                yield _areas(table.slice(0, last), keys, shapes)
                held = table.slice(last).to_batches()
        if sum(b.num_rows for b in held):
            yield _areas(pa.Table.from_batches(held).combine_chunks(), keys, shapes)

    kinds = dict(pieces.dtypes)
    rows = spread(pieces, *keys).sortWithinPartitions(*keys, "x1")
    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", area double")


def _starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """Which rows begin a group."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _areas(table: pa.Table, keys: tuple[str, ...], shapes: Callable[[SimpleNamespace], list[plane.Polygon]]) -> pa.RecordBatch:
    first = np.flatnonzero(_starts(table, keys))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, table.num_rows)))
    box = np.stack([table.column(c).to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")], 1)
    plain = np.asarray(table.column("plain").to_numpy(), bool)
    area = np.bincount(group, (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]), len(first))
    crossed = np.zeros(len(first), bool)
    step, open_ = 1, np.arange(len(group))
    while len(open_):  # boxes of a group rise by x1
        open_ = open_[open_ + step < len(group)]
        j = open_ + step
        near = (group[j] == group[open_]) & (box[j, 0] < box[open_, 2])
        open_, j = open_[near], j[near]
        crossed[group[open_[(box[j, 1] < box[open_, 3]) & (box[open_, 1] < box[j, 3])]]] = True
        step += 1
    shaped = np.zeros(len(first), bool)
    shaped[group[~plain]] = True
    ends = np.append(first[1:], table.num_rows)
    for k in np.flatnonzero(crossed & ~shaped):
        area[k] = box_union_area(box[first[k] : ends[k]])
    for k in np.flatnonzero(shaped):
        rows = [SimpleNamespace(**r) for r in table.slice(first[k], ends[k] - first[k]).to_pylist()]
        area[k] = sum(map(plane.area, plane.dissolved([p for r in rows for p in shapes(r)])))
    return pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(pa.array(first)) for k in keys), pa.array(area)], [*keys, "area"])


def _piece(row: SimpleNamespace) -> list[plane.Polygon]:
    cut = plane.Polygon(plane.as_ring([(row.x1, row.y1), (row.x2, row.y1), (row.x2, row.y2), (row.x1, row.y2)]), [])
    if row.plain:
        return [cut]
    inner = plane.intersection([plane.as_polygon(row.shape)], [plane.as_polygon(row.bs)])
    return plane.intersection(inner, [cut])


def coverage(zones: DataFrame, buildings: DataFrame, key: str) -> DataFrame:
    """Zones with ``shape_area``, ``built`` and ``overlap``, the built share in percent; zones without buildings have 0."""
    built = built_area(zones, buildings, key).withColumnRenamed(key, "__z")
    out = zones.join(built, F.col(key) == F.col("__z"), "left").drop("__z")
    out = out.withColumn("shape_area", g.area(F.col("shape"))).withColumn("built", F.coalesce("built", F.lit(0.0)))
    return out.withColumn("overlap", F.coalesce(F.try_divide(F.col("built"), F.col("shape_area")) * 100, F.lit(0.0)))


def dense(zones: DataFrame, buildings: DataFrame, key: str, least: float = 18.0) -> DataFrame:
    """Zones of which over ``least`` percent are built up."""
    return coverage(zones, buildings, key).where(F.col("overlap") > least)


def inner_zones(zones: DataFrame, buildings: DataFrame, key: str, distance: float = 100.0, more_than: int = 20) -> DataFrame:
    """Zones that meet more than ``more_than`` buildings and whose every point lies under ``distance`` from one, as ``reach`` decides it.

    Such a zone doesn't meet the outline of the buildings' buffer.
    """
    met = sj.refine(sj.pairs(sj.slim(zones, key), sj.slim(buildings)))
    met = sj.counted(zones, met, key).where(F.col("join_count") > more_than)
    bare = reach.with_bare(met, buildings, key, distance).withColumnRenamed(key, "__bare")
    return met.join(bare, F.col(key) == F.col("__bare"), "left_anti")


def mean_coverage(inner: DataFrame, buildings: DataFrame, key: str, more_than: int = 5, fallback: float = 0.0, by: str | None = None) -> DataFrame:
    """``n_inner`` and ``mean_overlap``, the sum of shares over the number of inner zones, in one row or one for each ``by``; with ``more_than`` of them or fewer, the fallback."""
    c = coverage(inner, buildings, key)
    n = F.count("*")
    return (c.groupBy(by) if by else c).agg(n.alias("n_inner"), F.when(n > more_than, F.sum("overlap") / n).otherwise(F.lit(fallback)).alias("mean_overlap"))


def sparse_zones(zones: DataFrame, buildings: DataFrame, key: str, below: float, reach: float = 18.0) -> DataFrame:
    """Zones of which rectangles around their buildings, grown by ``reach``, cover under ``below`` percent, with that ``share``."""
    part = zones.select(key, "bounds", "shape", "is_box")
    met = sj.pairs(part, buildings.select("bounds", F.col("shape").alias("shape"), "is_box"), reach=reach)
    rows = met.select(F.col(f"a.{key}").alias(key), F.col("a.shape").alias("zone"), F.col("b.shape").alias("shape"))

    def share(group: list[dict]) -> list[tuple]:
        zone = plane.as_polygon(group[0]["zone"])
        boxes = [plane.least_box(plane.as_ring(r["shape"]["shell"])) for r in group]
        covered = plane.intersection([zone], plane.buffered(boxes, reach, 2))
        return [(100 * sum(map(plane.area, covered)) / plane.area(zone),)]

    found = by_group(rows, key, share, "share double").withColumnRenamed(key, "__z")
    every = zones.join(found, F.col(key) == F.col("__z"), "left").drop("__z").withColumn("share", F.coalesce("share", F.lit(0.0)))
    return every.where(F.col("share") < below)


def conflicts(lines: DataFrame, outlines: DataFrame) -> DataFrame:
    """One row: ``n_conflicts``, how many lines (rid, line, bounds) run through or touch outlines."""
    flat = lines.select("rid", F.explode(g.segments(F.col("line"))).alias("side"))
    shape = g.polygon(F.array(g.point(F.col("side.x1"), F.col("side.y1")), g.point(F.col("side.x2"), F.col("side.y2")), g.point(F.col("side.x1"), F.col("side.y1"))))
    flat = flat.select("rid", shape.alias("shape")).select("rid", "shape", g.bounds(F.col("shape.shell")).alias("bounds"))
    # a segment along an axis is its own bounds
    flat = flat.withColumn("is_box", (F.col("bounds.x1") == F.col("bounds.x2")) | (F.col("bounds.y1") == F.col("bounds.y2")))
    met = sj.refine(sj.pairs(flat, outlines.select("bounds", "shape", "is_box")))
    return met.agg(F.countDistinct("a.rid").alias("n_conflicts"))
