"""Operators of ``llm`` against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import _text as tx
from terraloom.llm import binary, counts, decontaminate, language_model, licenses, mixing, neardup, pii, quality, repeats
from terraloom.llm._encode import default_tokenizer, encoder
from terraloom.llm._store import Workspace

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, slot int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def table(spark, rows):
    """(doc_id, text, source) with further columns whose names clash with those of operators."""
    return spark.createDataFrame([(d, t, None, s, None, None, "x", None) for d, t, s in rows], SCHEMA).repartition(3)


def prose(seed, n, words=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefghij") + str(r.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, passages, lines, odd characters, very short and rather long texts, nulls, a repeated row."""
    r = random.Random(1)
    base, passage = prose(1, 120), prose(2, 90)
    rows = [(0, None, None), (1, "", "a"), (2, " \t\n", "a"), (3, "one", "b"), (4, "ONE", "b"), (5, "two words", "b"), (6, base, "a"), (7, base, "c"), (8, base.upper(), "a")]
    for k in range(12):
        words = base.split()
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(len(words))] = f"edit{k}{r.randrange(99)}"
        rows.append((10 + k, " ".join(words), "a"))
    rows += [(30 + k, f"{prose(100 + k, 40)}\n{passage}\n{prose(200 + k, 60)}", r.choice("abc")) for k in range(8)]
    rows += [(50 + k, prose(300 + k, r.randrange(1, 300)), r.choice("abc")) for k in range(25)]
    rows += [(80, "x " * 300 + "\n" + "line of text here\n" * 9, "b"), (81, "é ü 日本 <|endoftext|> ! " * 40, None), (82, prose(5, 9000, 90000), "c"), (83, "ab" * 3000, "c"), (6, base, "a")]
    return rows


# ---- kernels


def test_words_and_hashes_match_python():
    texts = ["", "  a b\x0bc ", " é x", "A a"]
    buf, off = tx.text_bytes(__import__("pyarrow").array(texts))
    w = tx.words(buf, off)
    assert [bytes(buf[a:b]).decode() for a, b in zip(w.start, w.end)] == [x for t in texts for x in SPACE.findall(t)]
    low = tx.Rolling(buf, tx.LOWER)(w.start, w.end)
    assert low[-1] == low[-2] and low[0] == low[-1]


def test_within_marks_runs_that_cross_documents():
    first = np.array([0, 2, 2, 5])
    assert tx.within(first, 2).tolist() == [True, False, True, True]
    assert tx.within(first, 6).tolist() == []


# ---- 1


def shingles(text):
    w = SPACE.findall(lowered(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_classes(rows):
    sets = [(d, shingles(t)) for d, t, _ in rows]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return sorted((d, len(s), top(d)) for d, s in sets)


def test_classes_match_all_pairs(spark, corpus):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(table(spark, corpus)).collect())
    assert got == brute_classes(corpus)


def test_near_the_threshold(spark):
    rows = []
    for k in range(40):
        words = prose(7, 60).split()
        words[-(k // 2 + 1) :] = [f"new{k}{i}" for i in range(k // 2 + 1)]
        rows.append((k, " ".join(words), "a"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(table(spark, rows)).collect())
    assert got == brute_classes(rows)


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_agree_modulo_a_power_of_two_differ(spark, monkeypatch):
    """Strings of Thue and Morse: sums modulo 2**64 agree for them whatever the base."""
    for n in (1024, 2048, 4096):
        one = thue_morse(n)
        two = one.translate(str.maketrans("ab", "ba"))
        buf, off = tx.text_bytes(__import__("pyarrow").array([one, two]))
        roll = tx.Rolling(buf)
        assert len(set(roll.quick(off[:-1], off[1:]).tolist())) == 1 and len(set(roll(off[:-1], off[1:]).tolist())) == 2
        g, first = neardup.shingle_sets(buf, off)
        assert g[first[0]] != g[first[1]]
        lines = f"{one}\n{two}\n" + "word " * 60
        buf, off = tx.text_bytes(__import__("pyarrow").array([lines]))
        assert quality.measured(buf, off).base["n_dup_lines"].tolist() == [0]
        _, h = decontaminate._words(buf, off)
        assert h[0] != h[1]
        encode = encoder(default_tokenizer())
        buf, off = tx.text_bytes(__import__("pyarrow").array([f"x {one} {two}"]))
        assert encode(buf, off)[0].tolist() == encode.tokenizer.encode(f"x {one} {two}", add_special_tokens=False).ids


def test_rows_meet_whatever_a_flush_passes(monkeypatch):
    """Keys of several rows are live, in a slot or passed by it; counts and hashes hold where no row was passed."""
    import pyarrow as pa

    from terraloom.llm import _buckets

    r = np.random.default_rng(3)
    keys, a = r.integers(0, 60, 500).astype(tx.U) * tx.U(0x9E3779B97F4A7C15), r.integers(0, 40, 500)
    want = {(k & (1 << 40) - 1, x) for k, x in zip(keys.tolist(), a.tolist())}
    many = Counter(k for k, _ in want)
    for crowd in (1, 3, 1000):
        monkeypatch.setattr(_buckets, "CROWD", crowd)
        sent = [row for turn in range(5) for batch in _buckets._send([(keys[turn::5], a[turn::5], a[turn::5] * 2)], 4, turn) for row in batch.to_pylist()]
        got = pa.Table.from_batches([b for slot in range(4) for b in _buckets._meet([x for x in sent if x["slot"] == slot])]).to_pylist()
        assert {(g["key"] & (1 << 40) - 1, g["a"]) for g in got} == {(k, x) for k, x in want if many[k] > 1}
        assert all(g["k"] in (0, many[g["key"] & (1 << 40) - 1]) and g["b"] == 2 * g["a"] for g in got)
        if crowd == 1000:
            assert len(got) == len({(g["key"], g["a"]) for g in got}) and sum(g["x"] is not None for g in got) == len({g["key"] for g in got})


def test_squares_alone_find_all_links(spark, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "SQUARE", 4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(table(spark, corpus)).collect())
    assert got == brute_classes(corpus)


def test_links_of_documents_alone_in_their_partitions(spark):
    rows = []
    for k in range(20):
        words = prose(700 + k, 64).split()
        # 60 and 46 shingles, 46 of them common: the first goes to the next band as well, the second to one only
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(words[:50]), "a")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(d, t) for d, t, _ in rows], len(rows)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.classes(docs).collect())
    assert got == brute_classes(rows)


def test_a_document_alone_leads_in_each_band():
    buf, off = tx.text_bytes(__import__("pyarrow").array([prose(1, 64)]))
    doc, key, above, n = neardup.blocks(*neardup.shingle_sets(buf, off))
    row = neardup.leading(doc, key, above, n, np.zeros(neardup.COUNTERS))
    assert np.bincount(above[row]).tolist() == [n[0] // 4 + 1, n[0] // 7 + 1]


def test_classes_of_nothing(spark):
    assert neardup.classes(table(spark, [])).count() == 0
    r = neardup.classes(table(spark, [(None, "a b", "a"), (1, "a b", "a")])).collect()
    assert sorted((x.doc_id is None, x.component_id) for x in r) == [(False, 1), (True, None)]


def test_hamming_distance_is_a_lower_bound():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 1 << 62, 80).astype(tx.U)) for _ in range(2))
        b = np.unique(np.concatenate([a[:60], b[:30]]))
        apart = int(np.bitwise_count(neardup.sketch(a, 256) ^ neardup.sketch(b, 256)).sum())
        assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
        half = neardup.sketch(a, 256)
        assert (half[:2] ^ half[2:] == neardup.sketch(a, 128)).all()


def test_sizes_of_rows_without_an_id(spark):
    got = neardup.classes(table(spark, [(None, "a b c d e f g", "a"), (None, "A b", "a"), (None, " ", "a"), (None, None, "a"), (1, "a b c d e f g", "a")])).collect()
    assert Counter(map(tuple, got)) == Counter([(None, 3, None), (None, 1, None), (None, 0, None), (None, 0, None), (1, 3, 1)])


def test_distinct_documents_with_clashing_columns(spark, corpus):
    docs = table(spark, corpus)
    for name in ("gone_id", "other_id", "several_id", "rows", "component_id", "node"):
        docs = docs.withColumn(name, F.lit(5))
    assert Counter(r.doc_id for r in neardup.distinct_documents(docs).collect()) == Counter(r.doc_id for r in neardup.distinct_documents(table(spark, corpus)).collect())


def test_one_of_each_class_stays(spark, corpus):
    got = neardup.distinct_documents(table(spark, corpus))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in got.collect()) == sorted({d for d, _, c in brute_classes(corpus) if d == c})


# ---- 2


def test_scores(spark, corpus):
    got = {(r.doc_id, r.n_tokens): r for r in language_model.score(table(spark, corpus)).collect()}
    tokens = {}
    train = Counter()
    for d, t, _ in corpus:
        w = [*SPACE.findall(lowered(t)), None]
        tokens[d, len(w)] = w
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(w)
    n, v = sum(train.values()), len(train)
    assert len(got) == len(tokens)
    for key, w in tokens.items():
        r = got[key]
        assert r.held_out == (zlib.crc32(str(key[0]).encode()) % 7 == 2)
        assert r.train_tokens == n and r.n_known == sum(train[x] > 0 for x in w)
        assert r.base_score == pytest.approx(sum(np.log10((train[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r.score < 0


def test_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in language_model.perplexity(language_model.score(docs)).collect():
        assert r.perplexity < r.base_perplexity


def test_seating():
    """Tables of every dish, moved by every customer, hold all customers; small restaurants are seated as often as the model says."""
    r = np.random.default_rng(0)
    context, token = np.divmod(np.arange(200), 20)
    n = r.poisson(1.0, 200)
    n[:3] = (700, 256, 257)
    name = tx.splitmix(np.arange(200).astype(tx.U))
    m = language_model.Restaurants(context, token, n, np.full(20, 0.05), np.ones(10, np.int64), name)
    for _ in range(4):
        m.sweep()
        sizes = [np.bincount(m.table[b : b + k]) for b, k in zip(m.base, m.n)]
        assert all(x.sum() == k and np.count_nonzero(x) == m.t[d] for x, k, d in zip(sizes, m.n, m.dish))
        assert (m.t[n == 1] == 1).all() and (m.t[n == 0] == 0).all()
    # one dish of two customers each: at two tables in proportion to (s + d) * parent against 1 - d
    k = 20_000
    m = language_model.Restaurants(np.arange(k), np.zeros(k, np.int64), np.full(k, 2), np.array([0.3]), np.ones(k, np.int64), tx.splitmix(np.arange(k).astype(tx.U)))
    d = language_model.DISCOUNT
    new, old = (1 + d) * 0.3, 1 - d
    for _ in range(3):
        m.sweep()
        assert np.mean(m.t == 2) == pytest.approx(new / (new + old), abs=0.015)


def test_probabilities_add_up():
    """Of the parent over all V + 1 tokens, rare ones and an unknown one among them; of a context's dishes and the parent's weight."""
    r = np.random.default_rng(1)
    count, rare = r.integers(5, 60, 40), np.array([1, 2, 2, 3, 1])
    for some in (rare, rare[:0]):
        n, v = int(count.sum() + some.sum()), 40 + len(some)
        none = np.zeros(0, np.int64)
        known = language_model.Known(n, v, np.sort(r.integers(1, 1 << 60, 40).astype(tx.U)), count, 0.1, none, none, none.astype(tx.U), none, 1)
        customers = np.stack([np.append(r.integers(1, 30, 40), len(some)) for _ in range(language_model.SAMPLES)])
        p = language_model._parent(known, 0.4, customers, np.zeros((language_model.SAMPLES, 0), np.int64))
        for k in range(language_model.SAMPLES):
            assert p.frequent[k].sum() + (p.least[k] + p.each[k] * some).sum() + p.least[k] == pytest.approx(1)
    context, token = np.divmod(np.arange(90), 9)
    n = r.poisson(2.0, 90)
    m = language_model.Restaurants(context, token, n, np.full(9, 0.1), np.ones(10, np.int64), tx.splitmix(np.arange(90).astype(tx.U)))
    (t, *_), (tables, *_) = m.sampled()
    d, st = language_model.DISCOUNT, language_model.STRENGTH
    mine = np.bincount(context, np.maximum(n - d * t, 0)) + st + d * tables
    assert np.allclose(mine / (st + np.bincount(context, n)), 1)
    steps = language_model._steps(np.array([1.0, 0.25, 3e-14, 0.0]))
    assert language_model._from_steps(steps.tobytes()) == pytest.approx([1.0, 0.25, 3e-14, 0.0], rel=1e-5)


def test_scores_depend_on_no_layout(spark, corpus, monkeypatch):
    """Partitions, buckets, parts of frequent contexts by the same share: one score."""
    monkeypatch.setattr(language_model, "SHARE", 60)
    one = language_model.score(table(spark, corpus)).collect()
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 300)
    two = language_model.score(table(spark, corpus).repartition(7)).collect()
    by = lambda rows: sorted((r.doc_id, r.n_tokens, round(r.score, 4)) for r in rows)
    assert by(one) == by(two)


def brute_model(docs, discount, burn, samples, seed):
    """Probability of a token after another, averaged over Gibbs sweeps of the whole hierarchy, a customer at a time: contexts, and the parent of their tables."""
    r, d, st = random.Random(seed), language_model.DISCOUNT, language_model.STRENGTH
    pairs = [p for w in docs for p in zip([None, *w], [*w, None])]
    v = len({w for _, w in pairs})
    contexts, customers, tables = {}, Counter(u for u, _ in pairs), Counter()
    parent, total = {}, [0, 0]

    def up(w):
        sizes = parent.get(w, [])
        return (sum(sizes) - discount * len(sizes) + (st + discount * total[1]) / (v + 1)) / (st + total[0])

    def down(u, w):
        sizes = contexts.get((u, w), [])
        return (sum(sizes) - d * len(sizes) + (st + d * tables[u]) * up(w)) / (st + customers[u])

    def sit(sizes, off, new):
        """Whether a table is opened."""
        at = r.random() * (new + sum(sizes) - off * len(sizes)) - new
        if at < 0 or not sizes:
            sizes.append(1)
            return True
        for k, x in enumerate(sizes):
            at -= x - off
            if at < 0 or k == len(sizes) - 1:
                sizes[k] += 1
                return False

    def leave(sizes):
        """Whether a table is given up."""
        k = r.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    def enter(u, w):
        if sit(contexts.setdefault((u, w), []), d, (st + d * tables[u]) * up(w)):
            tables[u] += 1
            total[1] += sit(parent.setdefault(w, []), discount, (st + discount * total[1]) / (v + 1))
            total[0] += 1

    for u, w in pairs:
        enter(u, w)
    found = []
    for k in range(burn + samples):
        for u, w in pairs:
            if leave(contexts[u, w]):
                tables[u] -= 1
                total[1] -= leave(parent[w])
                total[0] -= 1
            enter(u, w)
        if k >= burn:
            found.append({"contexts": {p: list(x) for p, x in contexts.items()}, "p": {w: up(w) for w in {w for _, w in pairs}}, "none": up("none at all"), "tables": dict(tables)})

    def probability(u, w):
        return np.mean([(sum(x := f["contexts"].get((u, w), [])) - d * len(x) + (st + d * f["tables"].get(u, 0)) * f["p"].get(w, f["none"])) / (st + customers[u]) for f in found])

    return probability


def test_scores_are_those_of_a_plain_gibbs_sampler(spark, monkeypatch):
    """Words of one context only, however frequent, are unlikely after others: contexts are seated against the parent, the parent by its own sweeps."""
    monkeypatch.setattr(language_model, "BURN", 14)
    monkeypatch.setattr(language_model, "SAMPLES", 4)
    r = random.Random(4)
    train = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 7 != 2][:400]
    held = [d for d in range(4000) if zlib.crc32(str(d).encode()) % 7 == 2][:60]
    texts = [[w for _ in range(6) for i in [r.randrange(30)] for w in (f"san{i}", f"francisco{i}", f"common{r.randrange(12)}", f"rare{r.randrange(4000)}")] for _ in train]
    tests = [[f"rare{5000 + i}", f"francisco{i % 30}"] for i in range(30)] + [[f"common{i % 12}", f"common{(i + 1) % 12}", f"san{i % 30}", f"francisco{i % 30}"] for i in range(30)]
    docs = [(d, " ".join(w), "a") for d, w in zip(train, texts)] + [(d, " ".join(w), "a") for d, w in zip(held, tests)]
    got = {x.doc_id: x.score for x in language_model.score(table(spark, docs)).collect()}
    count = Counter(w for x in texts for w in [*x, None])
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    p = brute_model(texts, min(0.95, max(0.05, once / (once + 2 * twice))), 12, 12, 1)
    for some in (slice(0, 30), slice(30, 60)):
        mine = [got[d] for d in held[some]]
        want = [sum(np.log10(p(u, w)) for u, w in zip([None, *x], [*x, None])) for x in tests[some]]
        assert np.mean(mine) == pytest.approx(np.mean(want), abs=0.06)


def test_scores_depend_on_no_limit(spark, corpus, monkeypatch):
    """Whether contexts are divided, and how many slots the parent has: one score."""
    by = lambda: sorted((r.doc_id, r.n_tokens, round(r.score, 4)) for r in language_model.score(table(spark, corpus)).collect())
    one = by()
    monkeypatch.setattr(language_model, "SHARE", 40)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 100)
    assert by() == one


def test_tables_go_on():
    """Customers of a restaurant that is taken up again keep their tables; some leave, others come, and a sweep seats them all."""
    r = np.random.default_rng(3)
    n, zeros = r.poisson(4.0, 300) + 1, np.zeros(300, np.int64)
    n[:4] = (900, 300, 2, 1)
    name, ones = tx.splitmix(np.arange(300).astype(tx.U)), np.ones(1, np.int64)
    m = language_model.Restaurants(zeros, zeros, n, np.full(1, 0.01), ones, name)
    again = language_model.Restaurants(zeros, zeros, n, np.full(1, 0.01), ones, name, held=(n, m.t, m.labels()), turn=1)
    sizes = lambda m, b, k: sorted(np.unique(m.table[b : b + k], return_counts=True)[1])
    assert (again.t == m.t).all() and all(sizes(m, b, k) == sizes(again, b, k) for b, k in zip(m.base, m.n))
    more = np.maximum(1, n + r.integers(-3, 4, 300))
    more[:4] = (1, 700, 1, 600)
    m = language_model.Restaurants(zeros, zeros, more, np.full(1, 0.01), ones, name, held=(n, m.t, m.labels()), turn=1)
    m.sweep()
    assert (m.table >= 0).all() and (m.t[more == 1] == 1).all()
    assert all(np.bincount(m.table[b : b + k]).sum() == k and len(set(m.table[b : b + k])) == m.t[d] for b, k, d in zip(m.base, m.n, m.dish))


def test_no_training_documents(spark):
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = language_model.score(table(spark, [(held, "a b", "a")])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)
    assert language_model.score(table(spark, [])).count() == 0


# ---- 3


def brute_quality(text):
    text = text or ""
    w = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(three)
    hit = {i + j for i, t in enumerate(three) if many[t] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_quality_measures(spark, corpus):
    got = sorted(tuple(r)[:7] for r in quality.measure(table(spark, corpus)).collect())
    assert got == sorted((d, *brute_quality(t)) for d, t, _ in corpus)


def test_verdict_does_not_depend_on_the_order(spark):
    rows = [(k, t, "a") for k, t in enumerate([prose(k, 80) for k in range(5)] + [prose(9, 80).upper(), " # ".join(prose(8, 80).split()), " ".join("1234567890" + str(k) for k in range(99))])]
    buf, off = tx.text_bytes(__import__("pyarrow").array([t for _, t, _ in rows]))
    t = quality.measured(buf, off)
    some = list(quality.RULES)
    verdicts = {tuple(quality.cascade(t, some[k:] + some[:k])[1]) for k in range(len(some))}
    assert verdicts == {(True,) * 5 + (False,) * 3}
    kept = quality.keep(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4] and len(kept.columns) == 8
    assert quality.keep(table(spark, [])).count() == 0 and quality.measure(table(spark, [])).count() == 0


def test_clean_documents_stay_and_poor_ones_go(spark):
    d = "/root/testdata/sf0.01"
    r = quality.measure(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    bad = r.where("quality = 1 and not kept and not base_failed or quality = 0 and kept").count()
    assert bad == 0


# ---- 4

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = WORDS.findall(lowered(t))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    out = []
    for d, t, _ in rows:
        w = WORDS.findall(lowered(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(corpus):
    text = {d: t for d, t, _ in corpus}
    cut = lambda d, a, b: " ".join(text[d].split()[a:b])
    return [(1, cut(6, 10, 50)), (2, cut(31, 30, 70)), (3, cut(50, 0, 13)), (4, "one"), (5, "two WORDS!"), (6, cut(52, 3, 10)), (7, None), (8, " . "), (9, cut(6, 10, 50)), (10, prose(77, 40)), (11, cut(82, 100, 112)), (12, "x " * 20)]


def test_hits_match_all_windows(spark, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for size in (decontaminate.BLOCK_BYTES, 400):
        got = sorted(tuple(r) for r in decontaminate.find(table(spark, corpus), bench, size).select(columns).collect())
        assert got == brute_hits(corpus, items)
    clean = sorted(r.doc_id for r in decontaminate.clean(table(spark, corpus), bench).collect())
    assert clean == sorted(r[0] for r in brute_hits(corpus, items) if not r[5])


def test_items_without_an_id_hit(spark, corpus, items):
    named, none = items[:3], [(None, t) for _, t in items[3:]]
    bench = spark.createDataFrame(named + none, "item_id long, text string")
    everything, listed = brute_hits(corpus, items), brute_hits(corpus, named)
    # hits of all items, lists of those with an id
    expected = [(*a[:3], *b[3:5], a[5]) for a, b in zip(everything, listed, strict=True)]
    for size in (decontaminate.BLOCK_BYTES, 400):
        got = decontaminate.find(table(spark, corpus), bench, size).drop("item_ids", "hit_start", "hit_end").collect()
        assert sorted(map(tuple, got)) == sorted(expected)
        clean = decontaminate.clean(table(spark, corpus), bench, size).collect()
        assert sorted(r.doc_id for r in clean) == sorted(r[0] for r in expected if not r[5])


def test_items_without_an_id_hit_in_sql_too(spark, corpus, items):
    import duckdb

    from terraloom.llm.oracles import ORACLES

    asked = [*items, (None, prose(2, 90)), (None, items[0][1])]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.execute("create table benchmark (item_id varchar, text varchar)")
    db.executemany("insert into documents values (?, ?)", [(d, t) for d, t, _ in corpus])
    db.executemany("insert into benchmark values (?, ?)", [(None if i is None else str(i), t) for i, t in asked])
    benchmark = spark.createDataFrame([(None if i is None else str(i), t) for i, t in asked], "item_id string, text string")
    got = decontaminate.find(table(spark, corpus), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert Counter(map(tuple, got)) == Counter(db.execute(ORACLES["op4_decontamination"]).fetchall())


def test_clean_judges_rows_by_their_own_text(spark, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    text = {d: t for d, t, _ in corpus}
    rows = [*corpus, (6, prose(901, 60), "a"), (None, text[6], "a"), (None, prose(902, 60), "a"), (None, None, "a")]
    hit = {t for (d, t, _) in rows if brute_hits([(0, t, None)], items)[0][5]}
    clean = sorted((repr(d), repr(t)) for d, t, _ in rows if t not in hit)
    for size in (decontaminate.BLOCK_BYTES, 400):
        got = decontaminate.clean(table(spark, rows), bench, size).collect()
        assert sorted((repr(r.doc_id), repr(r.text)) for r in got) == clean


def test_empty_benchmark_hits_nothing(spark, corpus):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(table(spark, corpus), bench).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.find(table(spark, []), bench).count() == 0


# ---- 5 and 8


def ids_of(text, special=False):
    t = encoder(default_tokenizer(), special).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [False, True])
def test_encoding_by_pieces_is_that_of_whole_texts(corpus, special):
    texts = [t or "" for _, t, _ in corpus] + ["a  b\n\n c", " lead", "trail ", "don't we'll", " wide　space x", "tab\tand\x0bvt\x1cfs \x85 nel", "mixed nbsp é ", "<|endoftext|> a<|endoftext|>"]
    buf, off = tx.text_bytes(__import__("pyarrow").array(texts))
    ids, at = encoder(default_tokenizer(), special)(buf, off)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == ids_of(t, special)


def brute_digest(rows):
    out, start = [], 0
    for d, t in sorted(((d, t or "") for d, t, _ in rows), key=lambda r: r[0]):
        ids = [*ids_of(t), 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_shards(spark, corpus):
    for size in (300, binary.SHARD_IDS):
        shards = binary.write(table(spark, corpus), Workspace(spark, "test"), shard_ids=size)
        assert sorted(map(tuple, binary.digest(shards).collect())) == sorted(brute_digest(corpus))
    for d, t, _ in corpus:
        assert binary.get(shards, d).tolist() == [*ids_of(t), 0]
    assert binary.get(shards, 6, 1) is not None and binary.get(shards, 6, 2) is None and binary.get(shards, 999) is None
    assert binary.encode_table(table(spark, [])).count() == 0


def test_many_rows_of_one_doc_id(spark):
    rows = [(7, f"text number {k}", "a") for k in range(50)] + [(None, "nobody", "a")]
    got = binary.encode_table(table(spark, rows), shard_ids=40, occurrences=True)
    assert sorted((r.doc_id is None, r.occurrence) for r in got.collect()) == [(False, k) for k in range(50)] + [(True, 0)]


def test_index_is_minimal_and_perfect():
    keys = tx.splitmix(np.arange(5000, dtype=tx.U))
    index = binary.Index.load(binary.Index.build(keys, np.arange(5000)).dump())
    assert (index(keys) == np.arange(5000)).all() and len(index.prints) == 5000
    assert (index(tx.splitmix(np.arange(5000, 60000, dtype=tx.U))) >= 0).sum() <= 1


def test_token_counts(spark, corpus):
    expected = sorted((d, len(ids_of(t, True)) + 1) for d, t, _ in corpus)
    for size in (64, counts.BLOCK_IDS):
        got = counts.count_table(table(spark, corpus), block_ids=size)
        assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == expected


def test_counts_of_raw_files(spark, tmp_path):
    end = counts.END_OF_TEXT
    streams = {"a.bin": [1, 2, end, end, 3, end, 4, 5], "b.bin": [9] * 50 + [end], "c.bin": [], "d.bin": [end], "e.bin": [7, 7]}
    for name, ids in streams.items():
        np.array(ids, "<u2").tofile(tmp_path / name)
    for size in (1, 3, 1000):
        got = counts.count(counts.read_flat(spark, str(tmp_path), block_ids=size)).collect()
        found = sorted((r.file[-5:], r.ordinal, r.n_tokens, r.closed) for r in got)
        assert found == [("a.bin", 0, 3, True), ("a.bin", 1, 1, True), ("a.bin", 2, 2, True), ("a.bin", 3, 2, False), ("b.bin", 0, 51, True), ("d.bin", 0, 1, True), ("e.bin", 0, 2, False)]


# ---- 6


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 300, None: 5, "z": 0}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, open_, want = sum(sizes.values()), set(sizes), {}
    while True:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix(spark, corpus):
    rows = corpus + [(1000 + k, prose(k, 20 + k % 50), "abc"[k % 3]) for k in range(600)]
    docs = table(spark, rows)
    one, two = (sorted(map(tuple, mixing.mix(d).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == len(rows)
    size = {d: len(SPACE.findall(t or "")) for d, t, _ in rows}
    taken, target, longest = Counter(), {}, Counter()
    for doc_id, source, n, _, goal, copies, words in one:
        assert n == size[doc_id] and 0 <= copies <= 3 and words == copies * n
        taken[source] += words
        target[source] = goal
        longest[source] = max(longest[source], n)
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= longest[s]
    copies = Counter()
    for doc_id, source, _, _, _, c, _ in one:
        copies[doc_id, source] += c
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +copies


def inclusions(sizes, rest, factor):
    """The chance of each document, by taking those that reach 1 for certain until none does."""
    certain = set()
    while True:
        left = rest - sum(sizes[k] for k in certain)
        scale = left / sum(f * n for k, (f, n) in enumerate(zip(factor, sizes, strict=True)) if k not in certain)
        more = {k for k, f in enumerate(factor) if k not in certain and scale * f >= 1}
        if not more:
            return [1.0 if k in certain else scale * f for k, f in enumerate(factor)]
        certain |= more


@pytest.mark.parametrize("squares", [False, True])
def test_draws_follow_the_inclusion(spark, squares):
    """In 400 sources of equal documents, each is drawn as often as its chance says, within the error of so many draws; with squares of sizes as factors some are certain."""
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 40, 60, 90, 150]
    factor = [float(n * n) if squares else 2 * n / (n + sum(sizes) / len(sizes)) for n in sizes]
    rows = [(100 * s + k, " ".join(["w"] * n), f"s{s:03d}") for s in range(400) for k, n in enumerate(sizes)]
    got = mixing.mix(table(spark, rows), inclusion=F.col("mix_size").cast("double") * F.col("mix_size") if squares else None).collect()
    certain = 0
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        whole = int(target // sum(sizes))
        drawn, sources = Counter(), len({r.source for r in own})
        for r in own:
            drawn[r.size] += r.copies - whole
        chance = inclusions(sizes, target - whole * sum(sizes), factor)
        certain += sum(q == 1 for q in chance)
        for n, q in zip(sizes, chance, strict=True):
            # the draw ends near the rest, not on it: some hundredths beside the error of a count
            assert q < 1 or drawn[n] == sources
            assert abs(drawn[n] / sources - q) < 4 * (q * (1 - q) / sources) ** 0.5 + 0.08, (target, n, q)
    assert (certain > 0) == squares


@pytest.mark.parametrize("who", [7, None])
def test_a_draw_that_ends_among_equal_rows(spark, who):
    """As many of a hundred equal rows are taken as fit, and the mix is the same in other partitions."""
    rows = [(who, "w " * 10, "a")] * 100 + [(1000 + k, "v " * 50, "b") for k in range(100)] + [(k, "u " * 40, "c") for k in range(100)]
    plan = {r.source: r.target for r in mixing.mix(table(spark, rows)).collect()}
    assert plan["a"] % 1000 not in (0.0,)
    seen = []
    for n in (1, 9):
        docs = table(spark, rows).repartition(n)
        got = mixing.mix(docs).collect()
        for source in "abc":
            taken = sum(r.taken for r in got if r.source == source)
            assert abs(taken - plan[source]) <= max(r.size for r in got if r.source == source)
        seen.append(Counter((r.doc_id, r.source, r.copies) for r in got))
        copies = Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect())
        want = Counter()
        for r in got:
            want[r.doc_id, r.source] += r.copies
        assert copies == +want
    assert seen[0] == seen[1]


def test_mix_matches_sql_on_repeated_and_null_ids(spark, corpus):
    import duckdb

    from terraloom.llm.oracles import ORACLES

    rows = [*corpus, *[(7, "w " * 10, "a")] * 30, *[(None, "t " * 9, "c")] * 20, (None, "other words", "c"), (None, None, None), (7, "w w", "a")]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    key = lambda r: tuple(None if x is None else round(x, 6) for x in r)
    got = mixing.mix(table(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert Counter(map(key, got)) == Counter(map(key, db.execute(ORACLES["op6_mixing"]).fetchall()))


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [(1, None, None), (2, "", None)])).collect()] == [0, 0]


# ---- 7


def covered(x, starts, size):
    mark = np.zeros(len(x) + 1, int)
    for i in starts:
        mark[i] += 1
        mark[i + size] -= 1
    return np.cumsum(mark)[: len(x)] > 0


def brute_removed(rows):
    data = [(t or "").encode() for _, t, _ in rows]
    many = Counter(x[i : i + 400] for x in data for i in range(len(x) - 399))
    holders = Counter(g for x in data for g in {x[i : i + 240] for i in range(len(x) - 239)})
    out = []
    for (d, _, _), x in zip(rows, data):
        gone = covered(x, [i for i in range(len(x) - 399) if many[x[i : i + 400]] > 1], 400)
        kept = bytes(b for b, g in zip(x, gone) if not g)
        shared = covered(x, [i for i in range(len(x) - 239) if holders[x[i : i + 240]] > 1], 240)
        passages = 0
        for run in re.finditer(b"1+", bytes(b"01"[int(s)] for s in shared)):
            words = sum(w.start() >= run.start() and w.end() <= run.end() for w in re.finditer(rb"[^\x20\x09-\x0D]+", x))
            passages += words if words > 50 else 0
        out.append((d, len(x), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), passages))
    return sorted(out)


def got_removed(spark, rows):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in repeats.removed(table(spark, rows)).collect())


def overlapping(seed):
    """Texts that share pieces of a long one, shifted and cut at many places."""
    r = random.Random(seed)
    source = prose(seed, 600, 50)
    rows = []
    for k in range(24):
        a = r.randrange(len(source) - 900)
        piece = source[a : a + r.randrange(300, 900)]
        rows.append((k, prose(seed + k, 20) + piece + prose(seed - k, r.randrange(30)), "a"))
    return rows


def periodic(seed):
    """Runs of short periods, alone, among others, cut at many places, and a paragraph that one text repeats."""
    r = random.Random(seed)
    paragraph = prose(seed + 7, 60)
    rows = [(0, "a" * 2500, "a"), (1, "a" * 400, "a"), (2, "a" * 399, "a"), (3, "b" * 450, "a"), (4, prose(4, 30) + " " + "ab" * 700, "a"), (5, "ab" * 180 + prose(5, 90), "a")]
    rows += [(6, " ".join([paragraph] * 9), "a"), (7, paragraph + prose(8, 30) + "Retionly " * 90, "a"), (8, "Retionly " * 40 + prose(9, 80), "a"), (9, ("x" * 100 + "y" * 150) * 8, "a")]
    return rows + [(20 + k, prose(50 + k, r.randrange(20)) + "Retionly " * r.randrange(10, 80) + paragraph[: r.randrange(len(paragraph))] + "a" * r.randrange(500), "a") for k in range(12)]


@pytest.mark.parametrize("hot", [3, repeats.HOT])
def test_removed_matches_all_strings(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus + [(d + 1000 * k, t, s) for k, more in enumerate((overlapping(5), overlapping(6), periodic(3)), 1) for d, t, s in more]
    assert got_removed(spark, rows) == brute_removed(rows)


def test_a_text_of_one_letter_is_removed():
    """Anchors at every byte come down to two for each context."""
    buf = np.full(1 << 21, ord("a"), np.uint8)
    off = np.array([0, len(buf)])
    roll = tx.Rolling(buf)
    at = repeats.anchors(roll, off)
    two = repeats.representatives(roll, off, at, np.zeros(len(at), np.int64))
    assert len(at) > 2_000_000 and len(two) < 1500
    code = repeats._contexts_hash(roll, off, at[two], np.zeros(len(two), np.int64))
    codes, n = np.unique(code, return_counts=True)
    _, first, last = repeats._places(buf, codes[n > 1])
    assert len(first) == 1 and last[0] - first[0] > len(buf) - 1200


def test_repeat_groups_hold_equal_strings_that_differ_around(spark):
    rows = overlapping(8)
    text = {}
    for _, t, _ in rows:
        buf, off = tx.text_bytes(__import__("pyarrow").array([t]))
        text[tuple(repeats._digests(buf, off)[:, 0].tolist())] = t.encode()
    groups = {}
    for r in repeats.groups(table(spark, rows)).collect():
        groups.setdefault((r.repeat, r.n_bytes), []).append((text[r.h1, r.h2], r.start))
    assert groups
    for (_, n), places in groups.items():
        assert n >= 400 and len(places) > 1 and len({t[a : a + n] for t, a in places}) == 1


def test_removed_of_nothing(spark):
    assert repeats.removed(table(spark, [])).count() == 0


# ---- 9

PRIVATE = [
    (1, "Write to anna.b@mail7.example.com or ANNA.B@MAIL7.EXAMPLE.COM, call +1 (555) 123-4567.", "a"),
    (2, "Host 152.143.123.131### and card 4111111111111111, SSN 123-45-6789.", "a"),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: hunter2hunter', "a"),
    (4, "Mrs. Anna Weber met Mr Otto Weber. Госпожа Анна Иванова too.", "a"),
    (5, "anna.b@mail7.example.com again", "a"),
    (6, None, "a"),
    (7, "", "a"),
    (8, "nothing private here, 12 of 345 words", "a"),
    (8, "nothing private here, 12 of 345 words", "a"),
]


def test_surrogates(spark):
    got = {r.doc_id: r for r in pii.surrogates(table(spark, PRIVATE)).collect()}
    text = {d: got[d].text for d in got}
    assert text[6] is None and text[7] == "" and text[8] == PRIVATE[-1][1] and got[8].n_entities == 0
    leaks = ["anna.b", "ANNA.B", "123-4567", "152.143.123.131", "4111111111111111", "123-45-6789", "24be6443", "hunter2", "Weber", "Анна", "Иванова", "Otto"]
    assert not [x for x in leaks if any(x in (t or "") for t in text.values())]
    mails = re.findall(r"[\w.]+@[\w.]+\.com", text[1], re.I)
    assert len(mails) == 2 and mails[0] == mails[1].lower() and mails[1].isupper() and mails[0] in text[5]
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}\.", text[1])
    card = re.search(r"\b\d{16}\b", text[2])[0]
    digits = [int(c) for c in reversed(card)]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Host (\d{1,3}\.){3}\d{1,3}### ", text[2]) and re.search(r'token = "[0-9a-f]{40}"', text[3])
    one, two = re.match(r"Mrs\. \w+ (\w+) met Mr \w+ (\w+)\. Госпожа [А-Яа-я]+на [А-Яа-я]+ too\.$", text[4]).groups()
    assert one == two
    other = {r.doc_id: r.text for r in pii.surrogates(table(spark, PRIVATE), key="another").collect()}
    assert other[1] != text[1]


def test_colliding_surrogates_are_told_apart(spark, monkeypatch):
    staged = pii._staged
    monkeypatch.setattr(pii, "_staged", lambda units, key: staged(units, key).withColumn("made", F.when((F.col("kind") == "ssn") & (F.col("attempt") == 0), "000000000").otherwise(F.col("made"))))
    rows = [(k, f"SSN 123-45-{6000 + k} and 123-45-6000", "a") for k in range(6)]
    got = pii.surrogates(table(spark, rows)).collect()
    pairs = {r.doc_id: re.findall(r"\d{3}-\d{2}-\d{4}", r.text) for r in got}
    assert len({p[0] for p in pairs.values()}) == 6 and {p[1] for p in pairs.values()} == {pairs[0][0]}


def test_more_names_than_three_syllables_make(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])
    names = [f"{a}{b}rt" for a in "ABCDE" for b in "aeio"]
    got = {r.doc_id: r.text for r in pii.surrogates(table(spark, [(k, f"Mr {n} and Mr {n}", "a") for k, n in enumerate(names)])).collect()}
    pairs = [re.fullmatch(r"Mr (\w+) and Mr (\w+)", t).groups() for t in got.values()]
    assert len(set(pairs)) == len(names) and all(a == b for a, b in pairs)


def test_shortened_addresses(spark):
    one = ["2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:DB8:0::0:1", "[2001:db8::1]:80", "2001:db8::1%eth0."]
    other = ["fe80::1", "2001:db81::", "::ffff:c000:221", "fdab::cafe", "2001:db8:1:2:3:4:5::", "1:2:3:4:5:6:7:abcd"]
    plain = ["std::vector", "x[1::2]", "x[::-1]", "at 12:30:45", "dead::beef", "a :: b", "1:2:3:4:5:6:7:8:9::abc"]
    got = {r.doc_id: r for r in pii.surrogates(table(spark, [(k, t, "a") for k, t in enumerate(one + other + plain)])).collect()}
    address = r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}"
    made = [re.search(address, got[k].text, re.I)[0].lower() for k in range(len(one + other))]
    assert len(set(made[: len(one)])) == 1 and len(set(made)) == 1 + len(other) and got[2].text.isupper()
    assert got[3].text == f"[{made[0]}]:80" and got[4].text == f"{made[0]}%eth0." and all(got[k].n_ip == 1 for k in range(len(made)))
    assert [got[k].text for k in range(len(made), len(got))] == plain
    assert "192.0.2.1" not in pii.surrogates(table(spark, [(1, "::ffff:192.0.2.1", "a")])).first().text


def test_surrogates_of_nothing(spark):
    assert pii.surrogates(table(spark, [])).count() == 0


# ---- 10


def test_licences(spark, corpus):
    rows = [r for r in corpus if r[0] < 60] + [
        (900, prose(1, 30) + "\nThis work is licensed under the GNU General Public License, version 2.\n" + prose(2, 70), "a"),
        (901, "RELEASED UNDER THE MIT LICENSE. " + prose(3, 60), "a"),
        (902, "Licensed under CC BY-NC 4.0.", "a"),
        (903, prose(4, 500) + " Licensed under the Apache License, Version 2.0. " + prose(5, 500), "a"),
        (904, "Licensed under the Zorblax License.", "a"),
    ]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert [got[d].best_family for d in range(900, 905)] == ["gpl", "mit", "cc-by-nc", "apache", None]
    assert got[904].n_unknown == 1 and not [d for d, r in got.items() if d < 900 and r.n_license]
    assert licenses.scan(table(spark, [])).count() == 0


def test_held_out_accuracy():
    texts = [prose(k, 200) for k in range(40)]
    model = licenses.train(texts, seed=3)
    right = 0
    cases = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    for k, (f, t) in enumerate(cases):
        buf, off = tx.text_bytes(__import__("pyarrow").array([f"{prose(900 + k, 8)} {t} {prose(950 + k, 6)}"]))
        p = licenses.paragraphs(buf, off)
        _, prob = licenses.probabilities(p, model)
        right += any(licenses.FAMILIES[int(q[: licenses.NONE].argmax())] == f and q[licenses.NONE] < 0.5 for q in prob)
    assert right >= 0.9 * len(cases)
