from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest

from terraloom.functions import plane
from terraloom.operators import repair

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
SHAPE = pa.struct([("shell", pa.list_(POINT)), ("holes", pa.list_(pa.list_(POINT)))])
OUT = pa.schema([("k", pa.int64()), ("part", pa.int32()), ("shape", SHAPE)])


def parts(shapes: list[plane.Polygon]) -> dict[int, list[plane.Polygon]]:
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(shapes))), pa.array([plane.as_struct(p) for p in shapes], SHAPE)], ["k", "shape"])
    out: dict[int, list[plane.Polygon]] = {}
    for made in repair.simple_parts(batch, "k", OUT):
        for row in made.to_pylist():
            own = out.setdefault(row["k"], [])
            assert row["part"] == len(own)
            own.append(plane.as_polygon(row["shape"]))
    return out


def forms(made: list[plane.Polygon]) -> list[tuple]:
    assert [min(p.shell) for p in made] == sorted(min(p.shell) for p in made)
    return sorted((plane.canonical(p.shell), sorted(map(plane.canonical, p.holes))) for p in made)


def tangles(n: int, corners: int, step: float, seed: int) -> list[plane.Polygon]:
    r = np.random.default_rng(seed)
    ring = lambda k: plane.as_ring([tuple(map(float, p)) for p in r.integers(0, 12, (k, 2)) * step])
    return [plane.Polygon(ring(corners), [ring(4) for _ in range(r.integers(0, 3))]) for _ in range(n)]


@pytest.mark.parametrize("corners, step, limit", [(4, 1.0, 128), (5, 1.0, 128), (7, 0.37, 128), (12, 2.003, 128), (7, 1.0, 12)])
def test_a_batch_has_the_parts_of_single_shapes(monkeypatch, corners, step, limit):
    monkeypatch.setattr(repair, "SIDES", limit)
    monkeypatch.setattr(repair, "PAIRS", 500)
    shapes = [*tangles(250, corners, step, corners), plane.Polygon([(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)], [])]
    made = parts(shapes)
    for k, p in enumerate(shapes):
        assert forms(made.get(k, [])) == forms(plane.simple_parts(p))


def test_many_shapes_take_little_time_each():
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(20_000)), pa.array([plane.as_struct(plane.Polygon(bow, []))] * 20_000, SHAPE)], ["k", "shape"])
    began = time.process_time()
    assert sum(made.num_rows for made in repair.simple_parts(batch, "k", OUT)) == 40_000
    assert time.process_time() - began < 8  # one by one: over 30
