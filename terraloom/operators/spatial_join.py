"""Joins of layers by place, through tiles.

A layer is a DataFrame with a key and ``bounds`` (struct x1, y1, x2, y2). Both layers are dealt to the square tiles that their bounds meet, tiles are
joined by equality, and a pair is kept only in the tile that holds the lower left corner of what its bounds share, so that no pair comes twice and none has to be
sorted out by ``distinct``. Tiles are plain join keys: a crowded tile is split by the engine like any skewed key.

Bounds decide alone for boxes. For other shapes ``refine`` tests the pairs of which either isn't a box in Python, on whole shapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane

TILE = 250.0


def _tiles(layer: DataFrame, tile: float, reach: float) -> DataFrame:
    b = F.col("bounds")
    low = lambda v: F.floor((v - reach) / tile)
    high = lambda v: F.floor((v + reach) / tile)
    # outer: else these are made twice, first in the few tasks that read the keys, to filter empty ones
    wide = layer.withColumn("tx", F.explode_outer(F.sequence(low(b["x1"]), high(b["x2"]))))
    return wide.withColumn("ty", F.explode_outer(F.sequence(low(b["y1"]), high(b["y2"]))))


def tiles_met(layer: DataFrame, key: str, tile: float) -> DataFrame:
    """key, tx, ty: the tiles that each shape itself meets, far fewer than those of its bounds if it is long and slanting; no tile that it meets is missing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                met = _raster(plane.edges([plane.as_polygon(batch.column("shape")[k].as_py())]), tile)
                n = pa.array(np.zeros(len(met), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(k, 1).take(n), pa.array(met[:, 0]), pa.array(met[:, 1])], [key, "tx", "ty"])

    return layer.select(key, "shape").mapInArrow(run, f"{key} {dict(layer.dtypes)[key]}, tx long, ty long")


def _raster(sides: np.ndarray, tile: float) -> np.ndarray:
    """Tiles that sides of a shape pass or come within a millimetre of, and those whose middle lies inside."""
    met: set[tuple[int, int]] = set()
    crossed: dict[int, list[float]] = {}
    for x1, y1, x2, y2 in sides.tolist():
        if y1 > y2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        slope = (x2 - x1) / (y2 - y1) if y2 > y1 else 0.0
        for ty in range(int(np.floor((y1 - plane.GRID) / tile)), int(np.floor((y2 + plane.GRID) / tile)) + 1):
            a, b = max(y1, ty * tile - plane.GRID), min(y2, (ty + 1) * tile + plane.GRID)
            ends = sorted((x1 + (a - y1) * slope, x1 + (b - y1) * slope)) if y2 > y1 else sorted((x1, x2))
            met.update((tx, ty) for tx in range(int(np.floor((ends[0] - 2 * plane.GRID) / tile)), int(np.floor((ends[1] + 2 * plane.GRID) / tile)) + 1))
            middle = (ty + 0.5) * tile
            if y1 <= middle < y2:
                crossed.setdefault(ty, []).append(x1 + (middle - y1) * slope)
    for ty, at in crossed.items():
        at.sort()
        for a, b in zip(at[::2], at[1::2], strict=False):
            met.update((tx, ty) for tx in range(int(np.ceil(a / tile - 0.5)), int(np.floor(b / tile - 0.5)) + 1))
    return np.array(sorted(met), np.int64).reshape(-1, 2)


def tiles_of_sides(sides: DataFrame, tile: float, *keep: str) -> DataFrame:
    """tx, ty and the columns kept: the tiles that each side (x1, y1, x2, y2) passes or comes within a millimetre of, where its bounds meet the square of their number if it is long and slanting."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = sides.withColumn("ty", F.explode(F.sequence(F.floor((low - plane.GRID) / tile), F.floor((high + plane.GRID) / tile))))
    a, b = F.greatest(low, F.col("ty") * tile - plane.GRID), F.least(high, (F.col("ty") + 1) * tile + plane.GRID)
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))))
    ends = [F.coalesce(at(a), F.col("x1")), F.coalesce(at(b), F.col("x2"))]
    across = F.sequence(F.floor((F.least(*ends) - 2 * plane.GRID) / tile), F.floor((F.greatest(*ends) + 2 * plane.GRID) / tile))
    return rows.withColumn("tx", F.explode(across)).select("tx", "ty", *keep)


#: Tiles of a shape's bounds from which on the shape itself is asked which of them it meets.
FEW_TILES = 16


def tiles_covered(layer: DataFrame, tile: float) -> DataFrame:
    """The layer (shape, bounds) with tx, ty for each tile that a shape meets, and some more that its bounds meet if these are few."""

    @F.pandas_udf("array<struct<tx:bigint,ty:bigint>>")
    def met(shells: pd.Series, holes: pd.Series) -> pd.Series:
        return pd.Series([[{"tx": tx, "ty": ty} for tx, ty in _raster(plane.edges([_polygon(s, h)]), tile).tolist()] for s, h in zip(shells, holes, strict=True)])

    b = F.col("bounds")
    n = (F.floor(b["x2"] / tile) - F.floor(b["x1"] / tile) + 1) * (F.floor(b["y2"] / tile) - F.floor(b["y1"] / tile) + 1)
    many = layer.where(n > FEW_TILES).withColumn("__t", F.explode(met(F.col("shape.shell"), F.col("shape.holes"))))
    return _tiles(layer.where(n <= FEW_TILES), tile, 0.0).unionByName(many.select(*layer.columns, "__t.tx", "__t.ty"))


def pairs(left: DataFrame, right: DataFrame, tile: float = TILE, reach: float = 0.0, strict: bool = False) -> DataFrame:
    """All pairs whose bounds meet, or come within ``reach`` on both axes; columns come back as structs ``a`` and ``b``. strict: bounds must share an area."""
    a = _tiles(left, tile, reach).select("tx", "ty", F.struct(*left.columns).alias("a"))
    b = _tiles(right, tile, 0.0).select(F.col("tx").alias("ux"), F.col("ty").alias("uy"), F.struct(*right.columns).alias("b"))
    p, q = F.col("a.bounds"), F.col("b.bounds")
    if strict:
        meet = (p["x1"] < q["x2"]) & (p["x2"] > q["x1"]) & (p["y1"] < q["y2"]) & (p["y2"] > q["y1"])
    else:
        meet = (p["x1"] - reach <= q["x2"]) & (p["x2"] + reach >= q["x1"]) & (p["y1"] - reach <= q["y2"]) & (p["y2"] + reach >= q["y1"])
    home = (F.col("tx") == F.floor(F.greatest(p["x1"] - reach, q["x1"]) / tile)) & (F.col("ty") == F.floor(F.greatest(p["y1"] - reach, q["y1"]) / tile))
    return a.join(b, (F.col("tx") == F.col("ux")) & (F.col("ty") == F.col("uy")) & meet & home).select("a", "b")


def slim(layer: DataFrame, *keep: str) -> DataFrame:
    """The columns kept, bounds, is_box and shape, null for boxes, which bounds tell: what joins for ``refine`` carry."""
    return layer.select(*keep, "bounds", F.when(~F.col("is_box"), F.col("shape")).alias("shape"), "is_box")


def refine(found: DataFrame, relation: str = "intersects") -> DataFrame:
    """Of pairs that have ``shape`` and ``is_box`` on both sides, those whose shapes are in the relation: intersects, contains (a holds b) or within."""
    p, q = F.col("a.bounds"), F.col("b.bounds")
    inside = lambda i, o: (i["x1"] >= o["x1"]) & (i["x2"] <= o["x2"]) & (i["y1"] >= o["y1"]) & (i["y2"] <= o["y2"])
    by_bounds = {"intersects": F.lit(True), "contains": inside(q, p), "within": inside(p, q)}[relation]

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        rule = {"intersects": plane.intersects, "contains": plane.contains, "within": lambda x, y: plane.contains(y, x)}[relation]
        for batch in batches:
            yield pd.Series([a is None or rule(_polygon(a, b), _polygon(c, d)) for a, b, c, d in zip(*batch, strict=True)], dtype="boolean")

    return found.where(by_bounds).where(test(*_shapes()))


def _shapes() -> list[Column]:
    """Shells and holes of both sides, null where both are boxes, which bounds decide; boxes of ``slim`` layers are made from their bounds."""
    plain = F.col("a.is_box") & F.col("b.is_box")
    whole = lambda s: F.coalesce(F.col(f"{s}.shape"), g.box(*(F.col(f"{s}.bounds.{c}") for c in ("x1", "y1", "x2", "y2"))))
    return [F.when(~plain, whole(s)[c]) for s in "ab" for c in ("shell", "holes")]


def _polygon(shell, holes) -> plane.Polygon:
    return plane.as_polygon({"shell": shell, "holes": holes})


def semi(left: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows of the left layer with a partner among ``found`` pairs."""
    return left.join(found.select(F.col(f"a.{key}").alias("__k")), F.col(key) == F.col("__k"), "left_semi")


def anti(left: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return left.join(found.select(F.col(f"a.{key}").alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def counted(left: DataFrame, found: DataFrame, key: str, first: str | None = None) -> DataFrame:
    """The left layer with ``join_count`` and, if asked, the least ``first`` of the partners as ``join_first``."""
    more = [F.min(f"b.{first}").alias("join_first")] if first else []
    n = found.groupBy(F.col(f"a.{key}").alias("__k")).agg(F.count("*").alias("n"), *more)
    out = left.join(n, F.col(key) == F.col("__k"), "left").withColumn("join_count", F.coalesce("n", F.lit(0).cast("long")))
    return out.drop("__k", "n")


def one_match(left: DataFrame, found: DataFrame, key: str, other: str, keep_all: bool = True) -> DataFrame:
    """The left layer with ``match``, the least ``other`` of its partners: one row for each; rows without a partner stay with null, or go."""
    least = found.groupBy(F.col(f"a.{key}").alias("__k")).agg(F.min(f"b.{other}").alias("match"))
    return left.join(least, F.col(key) == F.col("__k"), "left" if keep_all else "inner").drop("__k")


def shared_box_area(a: Column, b: Column) -> Column:
    """Area that two bounds share."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)
