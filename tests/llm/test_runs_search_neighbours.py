"""Periodic runs and lexical search against brute force, the neighbour classifier against its definition and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraloom.llm import _text as tx
from terraloom.llm import neighbours, periods, queries, search

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, source string, runs string, score string, label string, item_no int, term int"


def table(spark, rows):
    """(doc_id, text) with further columns whose names clash with those of operators."""
    return spark.createDataFrame([(d, t, "s", "x", "x", "x", 1, 1) for d, t in rows], SCHEMA).repartition(3)


# ---- periodic runs


def runs_of(w, shortest=6, times=4):
    """(start, length, period) by trying every lag at every word."""
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed, many):
    r = random.Random(seed)
    for _ in range(many):
        n, kinds = r.choice([0, 1, 5, 6, 7, 30, 200, 900]), r.choice([1, 2, 3, 10, 60])
        w = [f"w{r.randrange(kinds)}" for _ in range(n)]
        for _ in range(r.randrange(4)):
            if n > 12:
                s, p = r.randrange(n), r.randrange(1, 14)
                for i in range(s + p, min(n, s + p * r.randrange(2, 9))):
                    w[i] = w[i - p]
        yield w


@pytest.mark.parametrize(("shortest", "times"), [(6, 4), (2, 2), (9, 3)])
def test_runs_match_brute_force(shortest, times):
    docs = list(repetitive(times, 150))
    buf, off = tx.text_bytes(pa.array([" ".join(w) for w in docs]))
    words = tx.words(buf, off)
    got = periods.find(tx.Rolling(buf)(words.start, words.end), words.first, shortest, times)
    assert got == [(d, *x) for d, w in enumerate(docs) for x in runs_of(w, shortest, times)]


def test_heavy_and_light_counts_agree():
    """Words counted by spectra give what pairs of places give."""
    r = np.random.default_rng(3)
    ids = r.integers(0, 3, 500).astype(tx.U)
    total, base, reach = periods.lag_counts(ids, np.array([0, 300, 500]), 4)
    for d, (s, e) in enumerate(((0, 300), (300, 500))):
        w = ids[s:e]
        assert [int(np.count_nonzero(w[q:] == w[: len(w) - q])) for q in range(1, reach[d] + 1)] == total[base[d] + 1 : base[d] + reach[d] + 1].tolist()


def test_texts_without_any_lag_to_scan():
    for ids, first in (([], [0]), ([], [0, 0]), (range(50), [0, 50]), ([1, 2, 1, 2, 3], [0, 5])):
        assert periods.find(np.array(ids, tx.U), np.array(first)) == []


def test_a_long_text_of_one_word_is_scanned_once():
    ids = np.zeros(400_000, tx.U)
    assert periods.find(ids, np.array([0, len(ids)])) == [(0, 0, 400_000, 1)]


def test_operator_and_query_of_runs(spark, tmp_path):
    texts = [" ".join(w) for w in repetitive(9, 60)]
    rows = [*enumerate(texts), (5, texts[5]), (5, texts[5]), (900, None), (901, ""), (902, " \t\n\x0b"), (None, "a b " * 9), (903, "é日 x y " * 5000), (904, "A a " * 8)]
    docs = table(spark, rows)
    got = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periods.runs(docs).collect())
    want = Counter()
    for d, t in rows:
        w = WORDS.findall(t or "")
        found = runs_of(w) if len(w) < 2000 else [(0, len(w), 2)]
        want[d, len(w), tuple(found), collapsed(w, found)] += 1
    assert got == want

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for d, t in rows:
        w, h = WORDS.findall(t or ""), None if d is None else zlib.crc32(str(d).encode())
        n, planted = len(w), False
        if h is not None and h % 10 == 0 and n:
            g, planted = h // 10, True
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_of(w) if n < 2000 or planted else [(0, n, 2)]
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, found))]
        want[d, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest] += 1
    assert Counter(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect())) == want
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, t in rows if d is not None and t)
    assert periods.runs(table(spark, [])).collect() == []


# ---- lexical search


def terms_of(text):
    return TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best_of(docs, item, k=10, repeats=False):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    total, df = sum(sum(c.values()) for _, c in held), Counter(x for _, c in held for x in c)
    asked = Counter(terms_of(item))
    found = []
    for d, c in held:
        m = 10 + 90 * sum(c.values()) * len(held) // total
        score = 0
        for x, times in asked.items():
            if c[x]:
                w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[x] + 1)))
                score += (times if repeats else 1) * w * (10**9 * c[x] // (1000 * c[x] + 8 * m))
        if score > 0:
            found.append((-score, d is None, d or 0))
    return [(rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]


@pytest.fixture(scope="module")
def searched():
    r = random.Random(4)
    prose = [" ".join(r.choice("abcdeé") + str(min(r.randrange(40), r.randrange(40))) for _ in range(r.choice([1, 5, 60, 400]))) for _ in range(150)]
    docs = [*enumerate(prose), (7, prose[7]), *((1000 - k, prose[3]) for k in range(40)), (None, prose[3]), (None, "A1 b2"), (2000, None), (2001, ""), (2002, "--- ...\n"), (2003, "A1-a1_B2 " * 20_000)]
    items = [(k, " ".join(r.choice("ABCDEé") + str(r.randrange(40)) for _ in range(r.choice([1, 4, 30])))) for k in range(25)]
    items += [(3, items[3][1]), (3, "a1 a1 a1 b2"), (None, "c3, d4"), (90, None), (91, ""), (92, "nowhere"), (93, "?!")]
    return docs, items


@pytest.mark.parametrize("repeats", [False, True])
def test_search_matches_brute_force(spark, searched, monkeypatch, repeats):
    docs, items = searched
    monkeypatch.setattr(search, "CELLS", 64)
    monkeypatch.setattr(search, "PRODUCTS", 50)
    if repeats:  # several blocks of items
        monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item_no int, rank int").repartition(3)
    got = Counter(map(tuple, search.top(table(spark, docs), asked, repeats=repeats).select("item_id", "rank", "doc_id", "score").collect()))
    assert got == Counter((i, *x) for i, t in items for x in best_of(docs, t, repeats=repeats))


def test_search_without_documents_or_items(spark, searched):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for docs, asked in (([], items), ([(1, None), (2, "--")], items), ([(1, "a b")], items.where("false"))):
        found = search.top(table(spark, docs), asked)
        assert found.collect() == [] and dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


# ---- quality by neighbours


def labelled(seed, many):
    r = random.Random(seed)
    for d in range(many):
        good = r.random() < 0.8
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 120))]
        text = " ".join(w).capitalize() + "." if good else r.choice([" ".join(w).upper() + "!!", " ".join(x + r.choice(["###", "$$$"]) for x in w), " ".join(x for x in w[:9] for _ in range(9))])
        yield d, text, int(good)


@pytest.fixture(scope="module")
def quality_rows():
    rows = [(d, t, y) for d, t, y in labelled(1, 400)]
    return [(d, t) for d, t, _ in rows] + [(500, None), (501, ""), (None, rows[0][1]), (3, rows[3][1]), (502, "word " * 60_000)], [(d, y) for d, _, y in rows]


def test_votes_follow_the_definition(spark, quality_rows):
    docs, labels = quality_rows
    labels = [x for x in labels if x[0] % 3] + [(7, 1 - dict(labels)[7]), (7, 1 - dict(labels)[7]), (None, 1), (9999, 0), (8, None)]
    known = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("label", F.lit("x"))
    data = table(spark, docs)
    model = neighbours.fit(data, known, sample=50, dimensions=8)
    by = {d: int(np.mean([y for e, y in labels if e == d and y is not None]) > 0.5) for d, _ in docs if d is not None and any(e == d and y is not None for e, y in labels)}
    assert len(model.vectors) == 100 and by[7] == 1 - dict(quality_rows[1])[7]
    assert model.prior == pytest.approx(sum(by.values()) / len(by))
    # idf over all rows
    seen = np.count_nonzero(np.concatenate([neighbours.terms(*tx.text_bytes(pa.array([t], pa.string()))) for _, t in docs]), axis=0)
    assert np.allclose(model.idf, np.log((len(docs) + 1) / (seen + 1)) + 1)
    # a score is the weighted vote of the nearest vectors
    got = {}
    for r in neighbours.score(data, model, neighbours=5).collect():
        got.setdefault(r.doc_id, set()).add((r.score, r.predicted))
    for d, t in docs:
        counts = neighbours.terms(*tx.text_bytes(pa.array([t], pa.string())))[0]
        share = counts / max(counts.sum(), 1)
        v = (np.log(1 + 1000 * share) * model.idf) @ model.space
        v = v / max(np.linalg.norm(v), 1e-12) if counts.any() else v * 0
        near = sorted(((float(v @ s), i) for i, s in enumerate(model.vectors)), reverse=True)[:5]
        w = [(max(c, 0) ** 4 * model.stands_for[i], model.labels[i]) for c, i in near]
        want = (sum(a * b for a, b in w) + 1e-3 * model.prior) / (sum(a for a, _ in w) + 1e-3)
        assert any(abs(s - want) < 1e-6 and p == (s >= 0.5) for s, p in got[d]), d
    assert sum(len(x) for x in got.values()) <= len(docs)


def test_space_spans_the_greatest_singular_vectors():
    rows = np.random.default_rng(0).standard_normal((60, 40)) * np.linspace(5, 0.1, 40)
    space = neighbours.directions(rows, 5, rounds=80)
    _, _, right = np.linalg.svd(rows)
    assert np.allclose(np.abs(space.T @ right[:5].T), np.eye(5), atol=1e-3)


def test_held_out_labels_are_found(spark, quality_rows, tmp_path):
    docs, labels = quality_rows
    table(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = queries.op13_quality_classifier(spark, str(tmp_path)).collect()
    truth = dict(labels)
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean(held) > 0.97


def test_held_out_labels_change_nothing(spark, quality_rows, tmp_path):
    docs, labels = quality_rows
    scores = []
    for k in (0, 1):
        at = tmp_path / str(k)
        table(spark, docs).write.parquet(str(at / "documents.parquet"))
        flipped = [(d, 1 - y if k and zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
        spark.createDataFrame(flipped, "doc_id long, quality int").write.parquet(str(at / "labels.parquet"))
        scores.append(sorted((r.doc_id or -1, round(r.score, 9)) for r in queries.op13_quality_classifier(spark, str(at)).collect()))
    assert scores[0] == scores[1]


def test_classifier_with_few_labels_or_documents(spark, quality_rows):
    docs, labels = quality_rows
    data, known = table(spark, docs[:20]), spark.createDataFrame(labels, "doc_id long, quality int")
    assert {r.score for r in neighbours.score(data, neighbours.fit(data, known.where("false"))).collect()} == {0.5}
    one = neighbours.score(data, neighbours.fit(data, known.where("quality = 1"))).collect()
    assert all(r.score == pytest.approx(1) and r.predicted == 1 for r in one)
    none = table(spark, [])
    assert neighbours.score(none, neighbours.fit(none, known)).collect() == []
