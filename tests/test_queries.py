"""Every registered query of the engine against its SQL on small tables, and the sources."""

from __future__ import annotations

import struct
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from terraloom import registry
from terraloom.functions import geometry as g
from terraloom.plans import delineation, layers
from terraloom.sources import layers as io
from terraloom.sources import text
from terraloom.store import Workspace, by_group, spread

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, db, name):
    got, expected = registry.QUERIES[name](spark, DATA).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ["erase_turned", "clip_turned", "roads_within_outlines", "nearest_road"])
def test_nothing_is_broadcast_by_the_size_of_files(spark, name):
    """Tables here are so small that file sizes alone would make all joins broadcasts."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shapes_are_made_once(spark):
    """Conditions on bounds don't make turned shapes again, below the shuffle that deals the keys."""
    plan = registry.within_turned(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


def test_queries_without_sql_are_few():
    assert set(registry.QUERIES) - set(registry.ORACLES) <= {"mst_clusters", "sparse_blocks", "gap_close", "edge_catch", "delineation_full"}


def test_forest_spans_what_the_edges_join(spark):
    made = registry.minimum_spanning_forest(spark, DATA).toPandas()
    assert (made.w >= 1).all()
    for _, group in made.groupby("s"):
        root = {}
        for u, v in zip(group.u, group.v):
            a, b = (root.setdefault(n, n) for n in (u, v))
            assert a != b, "a circle"
            root = {n: a if x == b else x for n, x in root.items()}


def test_triangulations_join_all_buildings(spark):
    made = registry.delaunay_edges(spark, DATA).toPandas()
    for _, group in made.groupby("s"):
        n = len(set(group.u) | set(group.v))
        assert n == 60 and n - 1 <= len(group) <= 3 * n - 6


def test_other_queries_give_rows(spark):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, DATA).count() > 0, name


def test_classes_part_the_patches(spark):
    made = registry.error_class_cascade(spark, DATA)
    assert made.where("error_class is null").count() == 0
    report = registry.error_report(spark, DATA).toPandas()
    for _, group in report.groupby("sign"):
        n = group.set_index("error_class").frequency
        assert n["All"] == n.drop("All").sum()


PARAMETERS = ["01 a (%):18", "02 b(%):0", "03 c:56.8", "04 d:20", "05 e:10000", "06 f:10000", "07 g:4900", "08 h (default value = -1):-1", "09 i:-1", "10 j:#", "11 k:Warning", "12 l:25833", "13 m:D:\\a", "14 n:True"]


def test_parameters(spark, tmp_path):
    p = text.parse_parameters(PARAMETERS)
    assert p == delineation.Parameters()._replace(workspace="D:\\a") and p.reset
    assert text.parse_parameters(PARAMETERS[:9] + ["10 j:A, B", *PARAMETERS[10:]]).partitions == ("A", "B")
    with pytest.raises(ValueError):
        text.parse_parameters(PARAMETERS[:5])
    (tmp_path / "p.txt").write_text("\n".join(PARAMETERS))
    assert text.read_parameters(spark, str(tmp_path / "p.txt")) == p


def test_codes(spark, tmp_path):
    lines = ["#Filter positive", "31001_1000, house", "31001_1010", "", "#Filter negative", "31001_2720, barn", "31001_2720, barn", "#End", "x"]
    assert text.parse_codes(lines) == (["31001_1000", "31001_1010"], ["31001_2720"])
    (tmp_path / "c.txt").write_text("\n".join(lines))
    assert text.read_codes(spark, str(tmp_path / "c.txt")).count() == 3


def shapefile(rings):
    records = b""
    for n, parts in enumerate(rings):
        points = [p for r in parts for p in r]
        first, at = [], 0
        for r in parts:
            first.append(at)
            at += len(r)
        body = struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *first) + b"".join(struct.pack("<2d", *p) for p in points)
        records += struct.pack(">ii", n + 1, len(body) // 2) + body
    return b"\0" * 100 + records


def dbf(names):
    head = struct.pack("<B3BIHH20x", 3, 1, 1, 1, len(names), 32 + 32 + 1, 1 + 10)
    return head + b"fkt".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10]) + b"\0" * 15 + b"\r" + b"".join(b" " + n.encode().ljust(10) for n in names)


def test_shapefiles(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]
    other = [(x + 100, y) for x, y in square]
    (tmp_path / "hu.shp").write_bytes(shapefile([[square, hole], [square, other]]))
    (tmp_path / "hu.dbf").write_bytes(dbf(["31001_1000", "31001_2463"]))
    layer = io.read_shapefiles(spark, str(tmp_path))
    got = sorted((r.fid, r.part, r.area, r.attributes["fkt"]) for r in layer.select("fid", "part", g.area(F.col("shape")).alias("area"), "attributes").collect())
    assert got == [(0, 0, 96.0, "31001_1000"), (1, 0, 100.0, "31001_2463"), (1, 1, 100.0, "31001_2463")]
    assert io.prepared(layer.withColumn("NAME", F.lit("x"))).columns[-2:] == ["bounds", "is_box"]
    assert layer.select(io.geojson(F.col("shape"))).first()[0].startswith('{"type":"Polygon","coordinates":[[[')


def test_layers_out_and_in(spark, tmp_path):
    layer = layers.blocks(spark, DATA).withColumn("name", F.concat(F.lit("PART_"), F.col("s")))
    io.write(layer, str(tmp_path / "out"), by="name")
    io.write(layer.where("s = 3"), str(tmp_path / "out"), by="name")
    assert io.read(spark, str(tmp_path / "out")).count() == layer.count()
    with pytest.raises(TypeError):
        io.check(layer.drop("shape"), "polygon")
    with pytest.raises(ValueError):
        io.check(layer, "polygon", ("fkt",))
    assert io.same_system(25833, 25833) and not io.same_system(25832, 25833)
    assert io.write_counted(layer.where("s < 3"), str(tmp_path / "out"), "name") == 12
    assert io.read(spark, str(tmp_path / "out")).count() == layer.count()


def test_checks_and_log(spark, tmp_path):
    log = io.logged_to("Warning", str(tmp_path / "log.txt"))
    log.info("not this")
    parts, b = layers.partitions(spark, DATA), layers.buildings(spark, DATA)
    kinds = {"buildings": "polygon", "parts": "polygon"}
    assert io.inspected({"buildings": b, "parts": parts}, kinds, {"buildings": 25833}, 25833) == []
    found = io.inspected({"buildings": b, "parts": parts.drop("name")}, kinds, {"buildings": 25832}, 25833)
    assert len(found) == 2 and "25832" in found[0] and "names" in found[1]
    assert (tmp_path / "log.txt").read_text().count("WARNING") == 2 and "not this" not in (tmp_path / "log.txt").read_text()
    with pytest.raises(FileNotFoundError):
        io.inspected({"parts": parts}, kinds, {}, 25833)
    with pytest.raises(TypeError):
        io.inspected({"buildings": layers.roads(spark, DATA).drop("shape"), "parts": parts}, kinds, {}, 25833)
    io.logged_to("Error")


def test_outlines_by_hand(spark):
    """One settlement of two dense blocks of 100 by 100, between roads; a lone shed far from them; a tank; too few homes elsewhere."""

    def boxes(rows):
        df = spark.createDataFrame(rows, "fid long, x1 double, y1 double, x2 double, y2 double, fkt string")
        return layers._shaped(df)

    homes = [(100 * b + 10 * i + j, 100.0 * b + 10 + 20 * i, 10.0 + 20 * j, 100.0 * b + 24 + 20 * i, 22.0 + 20 * j, "31001_1000") for b in range(2) for i in range(4) for j in range(4)]
    lone = [(900, 420.0, 420.0, 428.0, 430.0, "31001_2463")]
    few = [(1000 + k, 2000.0 + 30 * k, 2000.0, 2020.0 + 30 * k, 2012.0, "31001_2463") for k in range(12)]
    buildings = boxes(homes + lone + few)
    lines = [(1, 0, 0, 200, 0), (2, 0, 100, 200, 100), (3, 0, 0, 0, 100), (4, 100, 0, 100, 100), (5, 200, 0, 200, 100), (6, 200, 50, 240, 50)]
    lines += [(10 + k, 2000 + 60 * k, 1990, 2060 + 60 * k, 1990) for k in range(6)]
    df = spark.createDataFrame([(r, float(a), float(b), float(c), float(d)) for r, a, b, c, d in lines], "rid long, x1 double, y1 double, x2 double, y2 double")
    low, high = (lambda c: F.least(f"{c}1", f"{c}2")), (lambda c: F.greatest(f"{c}1", f"{c}2"))
    roads = df.withColumns({"line": F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2"))), "bounds": F.struct(low("x").alias("x1"), low("y").alias("y1"), high("x").alias("x2"), high("y").alias("y2"))})
    parts = layers._shaped(spark.createDataFrame([("A", -500.0, -500.0, 1000.0, 1000.0), ("B", 1500.0, 1500.0, 3000.0, 3000.0)], "name string, x1 double, y1 double, x2 double, y2 double"))
    got = delineation.delineate(buildings, roads, parts).collect()
    # both blocks are built up by 16 * 14 * 12 / 10000 = 26.9 %; B has no homes; the shed is too small to stay
    assert [(r.name, round(r.shape_area, 3)) for r in got] == [("A", 20000.0)]

    # an auxiliary line parts a strip without a building from the second block: it is no block of its own, and its contact is too short to be filled as a gap
    strip = spark.createDataFrame([(90, 192.0, -20.0, 192.0, 120.0)], "rid long, x1 double, y1 double, x2 double, y2 double")
    strip = strip.withColumns({"line": F.array(g.point(F.col("x1"), F.col("y1")), g.point(F.col("x2"), F.col("y2"))), "bounds": F.struct("x1", "y1", "x2", "y2")})
    got = delineation.delineate(buildings, roads, parts, strip).collect()
    assert [(r.name, round(r.shape_area, 3)) for r in got] == [("A", 19200.0)]


def test_faces_of_roads_are_those_of_one_process(spark):
    """Faces within each partition's outline, which is a line of the network like roads; what lies outside is left out."""
    parts = layers._shaped(spark.createDataFrame([("A", 0.0, 0.0, 100.0, 100.0), ("B", 100.0, 0.0, 200.0, 100.0)], "name string, x1 double, y1 double, x2 double, y2 double"))
    ends = [("A", 30, -10, 30, 110), ("A", -10, 40, 150, 70), ("A", 110, 110, 140, 110), ("A", 110, 110, 140, 140), ("A", 140, 110, 140, 140), ("B", 90, 20, 210, 20), ("B", 150, 50, 160, 60)]
    lines = spark.createDataFrame([(n, [{"x": float(a), "y": float(b)}, {"x": float(c), "y": float(d)}]) for n, a, b, c, d in ends], "name string, line array<struct<x:double,y:double>>")
    got = delineation.road_faces(parts, lines, Workspace(spark, "faces")).withColumn("area", g.area(F.col("shape"))).collect()
    assert sorted((r.name, r.part) for r in got) == [("A", 0), ("A", 1), ("A", 2), ("A", 3), ("B", 0), ("B", 1)]
    assert sum(r.area for r in got if r.name == "A") == pytest.approx(10_000, abs=0.1) and sorted(round(r.area) for r in got if r.name == "B") == [2000, 8000]


def test_groups_come_in_batches_over_many_tasks(spark):
    """Groups, one without a key among them, get one call each with all their rows, and what is small in bytes is still dealt over many tasks."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 7 = 0 THEN NULL ELSE id % 7 END AS k", "id")
    made = by_group(rows, "k", lambda group: [(len(group), sum(r["id"] for r in group))], "n int, total long")
    want = rows.groupBy("k").agg(F.count("*").cast("int").alias("n"), F.sum("id").alias("total"))
    assert sorted(map(repr, made.collect())) == sorted(map(repr, want.collect()))
    assert spread(rows, "id").rdd.getNumPartitions() == 16
    summed = rows.groupBy("k").agg(F.max("id").alias("id"))
    assert by_group(summed, "k", lambda group: [(1,)], "n int").rdd.getNumPartitions() == 16
    assert layers.buildings(spark, DATA).rdd.getNumPartitions() == 16
