"""The pipeline's rows against a brute-force version, and the queries' SQL."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from terraloom.llm import mixing
from terraloom.llm.oracles import ORACLES
from terraloom.llm.queries import QUERIES

from .test_operators import SPACE, brute_classes, brute_digest, brute_hits, brute_quality

DATA = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, lines, _, failed = brute_quality(text)
    if failed:
        return False
    raw = text.encode()
    capitals, letters = len(re.findall(rb"[A-Z]", raw)), len(re.findall(rb"[A-Za-z\x80-\xff]", raw))
    lettered = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in SPACE.findall(text))
    return 10 * symbols <= 2 * n and 10 * lines <= n and 2 * n <= chars <= 20 * n and 2 * capitals <= letters and 10 * lettered >= 6 * n


def test_pipeline_matches_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [r for r in rows if passes(r[1])]
    first = {d for d, _, c in brute_classes(rows) if d == c}
    rows = [r for r in rows if r[0] in first]
    dirty = {h[0] for h in brute_hits(rows, items) if h[5]}
    rows = [r for r in rows if r[0] not in dirty]
    assert dirty
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    copies = {r.doc_id: r.copies for r in mix.collect()}
    rows = [r for r in rows for _ in range(copies[r[0]])]
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()) == sorted(brute_digest(rows))


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mixture":
            assert docs.count() < before, name
            before = docs.count()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got, expected = QUERIES[name](spark, DATA), db.execute(ORACLES[name])
    columns, names = sorted(got.columns), [d[0] for d in expected.description]
    assert columns == sorted(names)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(tuple(r[names.index(c)] for c in columns) for r in expected.fetchall())


def test_queries_without_sql_cover_all_documents(spark):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert sorted(r.doc_id for r in QUERIES[name](spark, DATA).select("doc_id").collect()) == ids, name
