"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A text's terms are runs of three byte classes (capital, small, digit, lead and continuation bytes beyond ASCII, space, line end, and groups of signs; 16 classes, so 4,096 terms), its words in
``WORD_TERMS`` hashed bins (A-Z in lower case), and how many words equal the word one to four before. A term that makes up a share f of the text's terms weighs log(1 + 1000 f) times log((N + 1) / (df + 1)) + 1, N and df being
counted over all documents. The ``DIMENSIONS`` directions of greatest weight (singular vectors, by subspace iteration) of the labelled sample span the space. Whole texts are read, none is cut.

For every document the cosines with all vectors of the sample are computed, block by block, exactly. Its ``NEIGHBOURS`` nearest vote with their labels, each with the power ``SHARPNESS`` of its cosine (0 if negative) and by how many
labelled documents of its label it stands for; the score is the share of label 1, drawn slightly to the share among all labelled documents, which is the score of a text without terms or without any similar
one. Without labels every score is 0.5; with one label only, that label.

The sample, the only part that is bounded, has at most ``SAMPLE`` documents of each label, those of least hash of the doc_id; vectors and directions (about 5 MB) are all that is broadcast. Labels that contradict each other go by majority, label 0 if even; those other than
0 and 1 and those without a document are ignored. Of several rows of one labelled doc_id the greatest text is taken. Every row of ``docs`` gives one row, repeated ones equal rows; null texts count as empty. Only texts enter a score: not the doc_id, the language, the source or any other column.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import Workspace

#: Labelled documents of each label in the sample, at most.
SAMPLE = 2048
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 15, 4
WORD_TERMS, BACK = 1024, 4
TERMS = 4096 + WORD_TERMS + BACK
#: Weight of the share among all labelled documents beside the votes.
PULL = 1e-3


def _classes() -> np.ndarray:
    """The class of each byte: 0 for none (before a text), 1 for signs not named."""
    out = np.ones(256, np.int64)
    groups = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0xC0, 0x100), range(0x80, 0xC0), b" \t\r", b"\n", b".", b",;:", b"!?", b"|", b"#*$%&<>", b"'\"`", b"()[]{}"]
    for k, members in enumerate(groups, 2):
        out[list(members)] = k
    return out


CLASSES = _classes()


def terms(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often each text has each term."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float64)
    if not len(buf):
        return out
    doc = np.repeat(np.arange(n), np.diff(off))
    kind = CLASSES[buf]
    code, place = doc * 4096 + kind * 256, np.arange(len(buf)) - off[doc]
    for back, factor in ((1, 16), (2, 1)):
        code[back:] += np.where(place[back:] >= back, kind[:-back] * factor, 0)
    out[:, :4096] = np.bincount(code, minlength=n * 4096).reshape(n, 4096)
    words = tx.words(buf, off)
    if len(words.start):
        owner = words.doc
        h = tx.Rolling(buf, tx.LOWER).quick(words.start, words.end)
        out[:, 4096 : 4096 + WORD_TERMS] = np.bincount(owner * WORD_TERMS + (h % tx.U(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
        for back in range(1, BACK + 1):
            same = (h[back:] == h[:-back]) & (owner[back:] == owner[:-back])
            out[:, 4096 + WORD_TERMS + back - 1] = np.bincount(owner[back:][same], minlength=n)
    return out


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Term weights by share and rarity, of length 1, or 0 without terms."""
    out = np.log1p(counts * (1000 / np.maximum(counts.sum(1, keepdims=True), 1))) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def directions(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """The k right singular vectors of greatest singular value, by subspace iteration from a fixed start; fewer if there are fewer rows."""
    k = min(k, len(rows))
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((rows.shape[1], min(k + 16, *rows.shape))))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return basis @ turn[:k].T


class Model(NamedTuple):
    idf: np.ndarray
    #: terms x dimensions
    space: np.ndarray
    #: sample x dimensions, each of length 1
    vectors: np.ndarray
    labels: np.ndarray
    #: labelled documents that each of the sample stands for
    stands_for: np.ndarray
    #: the share of label 1 among labelled documents
    prior: float


def placed(weights: np.ndarray, space: np.ndarray) -> np.ndarray:
    out = weights @ space
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def votes(model: Model, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The score of each row of term counts."""
    if not len(model.vectors):
        return np.full(len(counts), model.prior)
    cosines = placed(weighed(counts, model.idf), model.space) @ model.vectors.T
    k = min(neighbours, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.clip(np.take_along_axis(cosines, near, 1), 0, 1) ** SHARPNESS * model.stands_for[near]
    return (np.sum(weight * model.labels[near], 1) + PULL * model.prior) / (weight.sum(1) + PULL)


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _rarity(docs: DataFrame) -> np.ndarray:
    """idf of each term over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, np.int64)
        for rows, buf, off in tx.chunks(batches):
            seen[:TERMS] += np.count_nonzero(terms(buf, off), axis=0)
            seen[TERMS] += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.list_(pa.int64()))], ["seen"])

    per_term = docs.select("text").mapInArrow(count, "seen array<long>").select(F.posexplode("seen").alias("term", "n")).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(TERMS + 1)
    df[per_term["term"].to_numpy()] = per_term["n"].to_numpy()
    return np.log((df[TERMS] + 1) / (df[:TERMS] + 1)) + 1


def _sampled(docs: DataFrame, labels: DataFrame, sample: int, store: Workspace) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, label and term counts (term, n) of the sample, and how many documents have each label."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") > 0.5).cast("int").alias("label"))
    there = docs.where("doc_id is not null").select("doc_id").distinct()
    known = store.save(known.join(there, "doc_id"), "labelled")
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = None
    for label in sorted(totals):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        return None, totals
    # at most two samples of ids
    drawn = store.save(drawn, "drawn")
    texts = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in tx.chunks(batches):
            counts = terms(buf, off)
            at, term = np.nonzero(counts)
            edge = np.searchsorted(at, np.arange(rows.num_rows + 1)).astype(np.int32)
            listed = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x)) for x in (term.astype(np.int32), counts[at, term].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([tx.column(rows, "doc_id"), tx.column(rows, "label"), *listed], ["doc_id", "label", "term", "n"])

    return texts.mapInArrow(count, "doc_id long, label int, term array<int>, n array<long>"), totals


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Model:
    """The model of ``docs`` (doc_id, text) and all of ``labels`` (doc_id, quality)."""
    store = Workspace(docs.sparkSession, "neighbours")
    docs = _own(docs)
    drawn, totals = _sampled(docs, labels, sample, store)
    if drawn is None:
        return Model(np.zeros(TERMS), np.zeros((TERMS, 0)), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.5)
    idf = _rarity(docs)
    rows = drawn.toArrow().sort_by("doc_id")
    counts = np.zeros((len(rows), TERMS), np.float32)
    lists = rows["term"].combine_chunks()
    counts[np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy())), lists.values.to_numpy()] = rows["n"].combine_chunks().values.to_numpy()
    weights = weighed(counts, idf.astype(np.float32))
    space = directions(weights, dimensions).astype(np.float64)
    label = rows["label"].to_numpy().astype(np.float64)
    drawn_of = {k: np.count_nonzero(label == k) for k in totals}
    return Model(idf, space, placed(weights.astype(np.float64), space), label, np.array([totals[int(k)] / drawn_of[int(k)] for k in label]), totals.get(1, 0) / sum(totals.values()))


def score(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on) of every row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in tx.chunks(batches):
            found = votes(shared.value, terms(buf, off), neighbours)
            yield pa.RecordBatch.from_arrays([tx.column(rows, "doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _own(docs).mapInArrow(run, "doc_id long, score double, predicted int")
