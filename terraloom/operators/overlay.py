"""Overlays of layers as tables: clip, erase, buffer, lines within zones, noded lines, single and multiple parts, repair, identical shapes, names.

Pairs of shapes meet through tiles (``spatial_join``); each pair, or each shape with its partners, is one call of the planar kernel. What columns can say is said in columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from terraloom.functions import geometry as g
from terraloom.functions import plane
from terraloom.operators import network, refine, repair
from terraloom.operators import spatial_join as sj
from terraloom.operators.selection import touching
from terraloom.store import Workspace, by_group

_SIDE = "struct<x1:double,y1:double,x2:double,y2:double>"


def _with_partners(left: DataFrame, right: DataFrame, key: str, make: Callable[[list[plane.Polygon], list[plane.Polygon]], list[plane.Polygon]]) -> DataFrame:
    """key, part, shape: what ``make`` makes of each left shape and the right ones that share an area with its bounds; shapes without any don't come."""
    met = sj.pairs(left.select(key, "bounds", "shape"), right.select("bounds", "shape"), strict=True)
    rows = met.select(F.col(f"a.{key}").alias(key), F.col("a.shape").alias("shape"), F.col("b.shape").alias("other"))
    return by_group(rows, key, lambda group: refine.parts(make([plane.as_polygon(group[0]["shape"])], [plane.as_polygon(r["other"]) for r in group])), refine.OUT)


def clip(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, part, shape of what lies within any of the right shapes; the rest goes."""
    return _with_partners(left, right, key, plane.intersection)


def erase(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, part, shape of what lies in none of the right shapes; shapes without a partner stay whole."""
    cut = _with_partners(left, right, key, plane.difference)
    met = sj.pairs(left.select(key, "bounds"), right.select("bounds"), strict=True)
    whole = sj.anti(left, met, key).select(key, F.lit(0).alias("part"), "shape")
    return cut.unionByName(whole)


def cut_out(left: DataFrame, right: DataFrame, key: str, store: Workspace, inside: bool = True, tile: float = sj.TILE) -> DataFrame:
    """key, part, shape as of ``clip``, or of ``erase`` if not ``inside``, for left shapes with any number of partners: no task holds a shape with all of them (``network.combined``).

    Right shapes (bounds, shape) need no key; each takes part once for every left shape of which a tile that it meets holds a part.
    """
    rows = store.save(right.select("bounds", "shape").withColumn("__n", F.monotonically_increasing_id()), "right")
    # by tiles of the left shapes themselves: the bounds of a long slanting shape meet many times what it meets
    here = sj._tiles(rows.select("__n", "bounds"), 4 * tile, 0.0).select("tx", "ty", "__n")
    ids = sj.tiles_met(left, key, 4 * tile).join(here, ["tx", "ty"]).select(key, "__n").distinct()
    met = ids.join(rows, "__n").select(key, "__n", "shape", "bounds")
    own = left.select(key, F.lit(-1).cast("long").alias("__n"), "shape", "bounds")
    made = network.combined(own, met, key, "__n", "intersection" if inside else "difference", store, tile)
    first = Window.partitionBy(key).orderBy(F.element_at("shape.shell", 1), "ring")
    return made.select(key, (F.row_number().over(first) - 1).alias("part"), "shape")


def sides(lines: DataFrame, *keep: str) -> DataFrame:
    """One row for each segment of ``line``: the columns kept, side (struct) and bounds."""
    s = lines.select(*keep, F.explode(g.segments(F.col("line"))).alias("side"))
    low, high = (lambda c: F.least(f"side.{c}1", f"side.{c}2")), (lambda c: F.greatest(f"side.{c}1", f"side.{c}2"))
    return s.select(*keep, "side", F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2")).alias("bounds"))


def lines_within(lines: DataFrame, zones: DataFrame, key: str, zone: str) -> DataFrame:
    """key, zone, x1, y1, x2, y2 of the pieces of lines that lie in a zone or on its border."""
    met = sj.pairs(sides(lines, key), zones.select(zone, "bounds", "shape"))

    @F.pandas_udf(f"array<{_SIDE}>")
    def pieces(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, shells: pd.Series, holes: pd.Series) -> pd.Series:
        out = []
        for *side, shell, inner in zip(x1, y1, x2, y2, shells, holes, strict=True):
            p = plane.as_polygon({"shell": shell, "holes": inner})
            rim = plane.edges([p])
            own = np.array([side], float)
            cut = plane.noded(np.vstack([own, rim]))
            middle = (cut[:, :2] + cut[:, 2:]) / 2
            on = [refine._on(x, y, own) and (plane.holds(p, x, y) or refine._on(x, y, rim)) for x, y in middle]
            out.append([dict(zip(("x1", "y1", "x2", "y2"), c, strict=True)) for c in cut[np.array(on, bool)].tolist()])
        return pd.Series(out)

    s = F.col("a.side")
    found = met.select(F.col(f"a.{key}").alias(key), F.col(f"b.{zone}").alias(zone), F.explode(pieces(s["x1"], s["y1"], s["x2"], s["y2"], F.col("b.shape.shell"), F.col("b.shape.holes"))).alias("piece"))
    return found.select(key, zone, "piece.*")


def buffered(layer: DataFrame, key: str, distance: float, quadrant: int = 8) -> DataFrame:
    """key, part, shape: all that lies within a distance of each polygon (``shape``); round, with ``quadrant`` chords in a right angle."""
    return refine.grouped(layer, key, lambda shapes: plane.buffered(shapes, distance, quadrant))


def buffered_lines(lines: DataFrame, key: str, distance: float, flat: bool = True, quadrant: int = 8) -> DataFrame:
    """key, part, shape around each line (``line``): with flat ends, that is without what lies beyond them, or with round ones.

    A straight line's flat buffer is a rectangle, made of columns; others are unions for each line.
    """

    def around(rows: list[dict]) -> list[tuple]:
        shapes = []
        for x1, y1, x2, y2 in refine.sides_of(rows).tolist():
            if (x1, y1) == (x2, y2):
                continue
            if not flat:
                shapes += plane.buffered_side((x1, y1, x2, y2), distance, quadrant)
                continue
            long = float(np.hypot(x2 - x1, y2 - y1))
            dx, dy = (y1 - y2) / long * distance, (x2 - x1) / long * distance
            shapes.append(plane.Polygon(plane.as_ring([(x1 - dx, y1 - dy), (x2 - dx, y2 - dy), (x2 + dx, y2 + dy), (x1 + dx, y1 + dy)]), []))
        return refine.parts(plane.dissolved(shapes) if len(shapes) != 1 else shapes)

    if not flat:
        return by_group(sides(lines, key).select(key, "side.*"), key, around, refine.OUT)
    bent = lines.join(lines.groupBy(F.col(key).alias("__k")).agg(F.sum(F.size("line")).alias("__n")), F.col(key) == F.col("__k"))
    one = bent.where("__n = 2").select(key, "line").where("line[0] <> line[1]")
    a, b = F.col("line")[0], F.col("line")[1]
    long = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    dx, dy = (a["y"] - b["y"]) / long * distance, (b["x"] - a["x"]) / long * distance
    corner = lambda p, sign: g.point(F.round(p["x"] + sign * dx, 3), F.round(p["y"] + sign * dy, 3))
    plain = one.select(key, F.lit(0).alias("part"), g.polygon(F.array(corner(a, -1), corner(b, -1), corner(b, 1), corner(a, 1), corner(a, -1))).alias("shape"))
    return plain.unionByName(by_group(sides(bent.where("__n > 2").select(key, "line"), key).select(key, "side.*"), key, around, refine.OUT))


def noded_lines(lines: DataFrame, key: str) -> DataFrame:
    """key, x1, y1, x2, y2 of the distinct pieces of each group's lines, cut wherever two meet."""

    return by_group(sides(lines, key).select(key, "side.*"), key, lambda rows: list(map(tuple, plane.noded(refine.sides_of(rows)).tolist())), "x1 double, y1 double, x2 double, y2 double")


def dissolved_parts(layer: DataFrame, key: str, store: Workspace) -> DataFrame:
    """component, part, shape: the union of all shapes as single parts; no task holds a component (``network.united``), and a shape that meets no other stays as it is."""
    parts = store.save(touching(layer, key, store).withColumnRenamed(key, "__n"), "components")
    several = parts.where("component <> __n").select("component").distinct()
    rows = layer.join(parts, F.col(key) == F.col("__n")).select("component", "__n", "shape", "bounds")
    made = network.united(rows.join(several, "component", "left_semi"), "component", "__n", store)
    first = Window.partitionBy("component").orderBy(F.element_at("shape.shell", 1), "ring")
    made = made.select("component", (F.row_number().over(first) - 1).alias("part"), "shape")
    return made.unionByName(rows.join(several, "component", "left_anti").select("component", F.lit(0).alias("part"), "shape"))


def buffers_dissolved(buffers: DataFrame, store: Workspace, *by: str) -> DataFrame:
    """part and shape (and the columns ``by``, a union for each): the union of all buffers (``shape``) of a layer, as single parts, whatever hangs together."""
    rows = buffers.select(F.xxhash64(*by).alias("__g") if by else F.lit(0).cast("long").alias("__g"), *by, "shape", g.bounds(F.col("shape.shell")).alias("bounds"))
    rows = store.save(rows.withColumn("__n", F.monotonically_increasing_id()), "buffers")
    made = network.united(rows, "__g", "__n", store).select("__g", F.col("ring").alias("part"), "shape")
    return made.join(rows.select("__g", *by).distinct(), "__g").drop("__g") if by else made.drop("__g")


def multiparts(layer: DataFrame, key: str) -> DataFrame:
    """key and parts, the union of each group's shapes as one row of several polygons."""
    made = refine.grouped(layer, key, plane.dissolved)
    return made.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "shape"))), lambda p: p["shape"]).alias("parts"))


def single_parts(layer: DataFrame) -> DataFrame:
    """One row for each polygon of ``parts``, as part and shape beside the other columns."""
    return layer.select(*[c for c in layer.columns if c != "parts"], F.posexplode("parts").alias("part", "shape"))


def repaired(layer: DataFrame) -> DataFrame:
    """Closed rings, shells counter-clockwise and holes clockwise; shapes and holes without area go."""

    def closed(ring: Column) -> Column:
        return F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))

    def turned(ring: Column, sign: int) -> Column:
        return g.once(ring, lambda r: F.when(g.ring_area(r) * sign < 0, F.reverse(r)).otherwise(r))

    rows = layer.where("size(shape.shell) >= 3").withColumn("__s", closed(F.col("shape.shell"))).withColumn("__h", F.transform("shape.holes", closed))
    rows = rows.where(F.abs(g.ring_area(F.col("__s"))) > 0).withColumn("__h", F.filter("__h", lambda h: F.abs(g.ring_area(h)) > 0))
    return rows.withColumn("shape", g.polygon(turned(F.col("__s"), 1), F.transform("__h", lambda h: turned(h, -1)))).drop("__s", "__h")


def repaired_parts(layer: DataFrame, key: str) -> DataFrame:
    """key, part, shape: ``repaired`` shapes cut where their own rings cross or touch themselves; what a shell winds around stays, in single parts, and what holes wind around goes."""

    # rings of figures of eight have no area of their own
    closed = lambda ring: F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    rows = layer.where("size(shape.shell) >= 3").select(key, g.polygon(closed(F.col("shape.shell")), F.transform(F.coalesce("shape.holes", F.array().cast(f"array<{g.RING}>")), closed)).alias("shape"))
    schema = StructType().add(key, layer.schema[key].dataType)
    for field in StructType.fromDDL(refine.OUT).fields:
        schema.add(field)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from repair.simple_parts(batch, key, arrow)

    return rows.mapInArrow(run, schema)


def identical(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows whose shape is that of a right one, wherever its rings begin and whichever way they run; to the millimetre."""
    own = right.select(g.canonical(F.col("shape")).alias("__c")).select(F.xxhash64("__c").alias("__h"), "__c")
    rows = left.withColumn("__d", g.canonical(F.col("shape")))
    return rows.join(own, (F.xxhash64("__d") == F.col("__h")) & (F.col("__d") == F.col("__c")), "left_semi").drop("__d")


def lines_from(table: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Adds ``line``, from one point to another."""
    return table.withColumn("line", F.array(g.point(F.col(x1), F.col(y1)), g.point(F.col(x2), F.col(y2))))


def named(layer: DataFrame, prefix: str, store: Workspace) -> DataFrame:
    """Adds ``name``: the prefix and a number from 1 by the lower left corner of ``bounds`` and then the shape.

    Rows are numbered within ranges, and ranges by the counts before them, so that no task sorts all of them.
    """
    order = ["__x", "__y", "__t"]
    rows = layer.withColumns({"__x": F.col("bounds.x1"), "__y": F.col("bounds.y1"), "__t": F.xxhash64("shape")})
    ranged = store.save(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("n")).select("__q", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    out = ranged.withColumn("__n", own).join(base, F.col("__p") == F.col("__q"))
    return out.withColumn("name", F.concat(F.lit(prefix), (F.col("base") + F.col("__n")).cast("string"))).drop(*order, "__p", "__q", "__n", "base")
