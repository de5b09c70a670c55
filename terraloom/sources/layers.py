"""Layers in and out: Parquet, shapefiles and GeoJSON, checked on the way."""

from __future__ import annotations

import logging
import struct
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.functions import geometry as g
from terraloom.functions import plane

log = logging.getLogger("terraloom")
#: Columns that a building layer must not bring along.
RESERVED = ("NAME", "Join_Count")


def check(layer: DataFrame, kind: str, needs: tuple[str, ...] = ()) -> DataFrame:
    """Raises unless a layer is of the kind (polygon or line) and has the columns it needs."""
    column = {"polygon": "shape", "line": "line"}[kind]
    if column not in layer.columns:
        raise TypeError(f"not a layer of {kind}s: it has no column {column}")
    missing = [c for c in needs if c not in layer.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return layer


def prepared(layer: DataFrame) -> DataFrame:
    """Polygons with bounds and is_box, without reserved columns and without shapes of no area."""
    check(layer, "polygon")
    layer = layer.drop(*RESERVED).withColumn("bounds", g.bounds(F.col("shape.shell"))).withColumn("is_box", g.is_box(F.col("shape")))
    return layer.where(g.area(F.col("shape")) > 0)


def same_system(one: int, other: int) -> bool:
    """Whether two layers have one reference system; a difference is worth a warning, not an error."""
    return one == other


def inspected(layers: dict[str, DataFrame | None], kinds: dict[str, str], epsg: dict[str, int], wanted: int, names: str = "parts") -> list[str]:
    """Raises for a layer that is missing or of another kind, and returns and logs warnings: of other reference systems, and of partitions without names."""
    warnings = []
    for name, kind in kinds.items():
        if layers.get(name) is None:
            raise FileNotFoundError(f"there is no layer {name}")
        check(layers[name], kind)
        if name in epsg and not same_system(epsg[name], wanted):
            warnings.append(f"{name} has reference system {epsg[name]}, not {wanted}")
    if names in layers and "name" not in [c.lower() for c in layers[names].columns]:
        warnings.append(f"{names} has no column of names")
    for text in warnings:
        log.warning(text)
    return warnings


def logged_to(level: str, path: str | None = None) -> logging.Logger:
    """The engine's log from a level of the parameter file on (Debug, Info, Warning, Error), to standard output and, if asked for, to a file of the driver."""
    log.setLevel(level.upper())
    log.handlers.clear()
    for handler in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write(layer: DataFrame, path: str, by: str | None = None) -> None:
    """As Parquet, in one folder for each value of ``by``; only the folders that come are replaced."""
    out = layer.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (out.partitionBy(by) if by else out).parquet(path)


def write_counted(layer: DataFrame, path: str, by: str, attempts: int = 2) -> int:
    """As ``write``; the rows of the values that came are counted again as stored, and written once more where they don't add up. Returns their number."""
    expected = {r[by]: r.n for r in layer.groupBy(by).agg(F.count("*").alias("n")).toLocalIterator()}
    for _ in range(attempts):
        write(layer, path, by)
        stored = read(layer.sparkSession, path).groupBy(by).agg(F.count("*").alias("n"))
        if {r[by]: r.n for r in stored.toLocalIterator() if r[by] in expected} == expected:
            return sum(expected.values())
        log.warning("counts of %s don't add up", path)
    raise OSError(f"what is stored under {path} is not what was written")


def merged(parts: list[DataFrame]) -> DataFrame:
    """All rows of layers by column name; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def geojson(shape: Column) -> Column:
    """A polygon's GeoJSON text."""
    ring = lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(ring(shape["shell"])), F.transform(shape["holes"], ring)).alias("coordinates")))


def single_parts(rings: list[plane.Ring]) -> list[plane.Polygon]:
    """Polygons from rings: clockwise ones are shells, the others holes of the shell that holds them."""
    shells = [plane.Polygon(r[::-1], []) for r in rings if plane.signed_area(r) < 0]
    for hole in (r for r in rings if plane.signed_area(r) > 0):
        home = [s for s in shells if plane.covers(s.shell, *hole[0])]
        if home:
            min(home, key=plane.area).holes.append(hole[::-1])
    return shells


def parse_shapefile(data: bytes) -> list[tuple[int, int, list[plane.Ring]]]:
    """(record number, kind, parts) of the records of a .shp file with points (1), lines (3) or polygons (5)."""
    at, out = 100, []
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0]
        if kind == 1:
            out.append((number, kind, [[struct.unpack("<2d", body[4:20])]]))
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            first = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            pairs = list(zip(xy[::2], xy[1::2], strict=True))
            out.append((number, kind, [pairs[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]))
    return out


def parse_dbf(data: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """Records of a .dbf file as texts."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        place, row = head + k * size + 1, {}
        for name, width in fields:
            row[name] = data[place : place + width].decode(encoding, "replace").strip()
            place += width
        out.append(row)
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """path, fid, part, shape (polygons, one row for each single part), line, attributes of all .shp files under a path, with the .dbf beside each if there is one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    files = files.select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.regexp_extract("path", r"(shp|dbf)$", 1).alias("kind"), "content")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(rows["kind"], rows["content"], strict=True))
        texts = parse_dbf(by["dbf"]) if "dbf" in by else []
        out = []
        for k, (_, kind, parts) in enumerate(parse_shapefile(by.get("shp", b""))):
            fields = texts[k] if k < len(texts) else {}
            if kind == 5:
                for n, p in enumerate(single_parts(parts)):
                    out.append((rows["stem"].iloc[0], k, n, plane.as_struct(p), None, fields))
            else:
                for n, line in enumerate(parts):
                    out.append((rows["stem"].iloc[0], k, n, None, [{"x": x, "y": y} for x, y in line], fields))
        return pd.DataFrame(out, columns=["stem", "fid", "part", "shape", "line", "attributes"])

    return files.groupBy("stem").applyInPandas(run, f"stem string, fid long, part int, shape {g.POLYGON}, line {g.RING}, attributes map<string,string>")

