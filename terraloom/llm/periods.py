"""Periodic runs of words: a phrase said over and over, found by heavy/light lag counting.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least ``max(min_length, exponent * q)`` words, that
no neighbouring word extends keeping period q. For each lag q up to n / exponent the words that agree with the word q further on are counted, exactly:

* light words of a text, which occur f times with f * f at most n * log2(n), by the differences of all pairs of their places that lie in reach;
* heavy words by autocorrelation: the squared spectra of their indicator vectors are added up and transformed back once, rounded to whole numbers;
* words that occur fewer than ``exponent`` times are in no run and are left out.

A run of period q gives at least ``max(min_length, exponent * q) - q`` matches, so only lags with as many are scanned for islands of matches. Lags are taken in rising order and what known
runs explain is taken off first: a run of length L and period p gives L - q matches at each multiple q of p, and no pair of words lies in two runs whose periods divide its distance, so the rest is
exact as well and a text of one repeated word is scanned once. An island at lag q is a run unless an earlier lag had the same stretch.

Null, empty and blank texts have no words and no runs. Every row gives one row, repeated ones equal rows; no documents give no rows. Texts are read whole, one or more in a chunk, and no
document meets another: nothing is exchanged and a lost task is done again from its input alone. Work on one text of n words is within n * sqrt(n * log n) for the counts. Columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import small_batches

MIN_LENGTH, EXPONENT = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: Lags that wait to be added up.
_HELD = 1 << 20


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    n = np.maximum(end - start, 0)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _light(place: np.ndarray, group: np.ndarray, doc: np.ndarray, reach: np.ndarray, base: np.ndarray, total: np.ndarray) -> None:
    """Adds the differences of places of one group, up to the reach of its document; places rise within a group."""
    alive, held, size = np.arange(len(place)), [], 0
    k = 0
    while len(alive):
        k += 1
        alive = alive[alive + k < len(place)]
        alive = alive[group[alive + k] == group[alive]]
        lag = place[alive + k] - place[alive]
        near = lag <= reach[doc[alive]]
        alive, lag = alive[near], lag[near]
        held.append(base[doc[alive]] + lag)
        size += len(lag)
        if size >= _HELD or not len(alive):
            total += np.bincount(np.concatenate(held), minlength=len(total))
            held, size = [], 0


def _heavy(places: list[np.ndarray], n: int, reach: int) -> np.ndarray:
    """Matches at lags 0 to reach of several words' places in a text of n words."""
    size = 1 << int(n + reach).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        x = np.zeros(size)
        x[at] = 1
        f = np.fft.rfft(x)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: reach + 1]).astype(np.int64)


def lag_counts(ids: np.ndarray, first: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, base, reach): matches of document d at lag q stand at base[d] + q, for q up to reach[d]; words in no run left out."""
    n = np.diff(first)
    reach = n // exponent
    base = np.cumsum(reach + 1) - (reach + 1)
    total = np.zeros(int((reach + 1).sum()), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids, doc))  # stable: places rise
    at = np.flatnonzero(np.append(True, (ids[order][1:] != ids[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(ids) else np.zeros(0, np.int64)
    often = np.diff(np.append(at, len(ids)))
    words = n[doc[order[at]]]
    heavy = (often >= exponent) & (often.astype(np.float64) ** 2 > words * np.log2(words + 1))
    light = np.repeat((often >= exponent) & ~heavy, often)
    group = np.repeat(np.arange(len(at)), often)
    _light(order[light], group[light], doc[order[light]], reach, base, total)
    by: dict[int, list[np.ndarray]] = {}
    for g in np.flatnonzero(heavy):
        own = order[at[g] : at[g] + often[g]]
        d = int(doc[own[0]])
        by.setdefault(d, []).append(own - first[d])
    for d, places in by.items():
        total[base[d] : base[d] + reach[d] + 1] += _heavy(places, int(n[d]), int(reach[d]))
    return total, base, reach


def find(ids: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs, sorted; ``ids`` are equal for equal words and ``first`` has where each document begins."""
    if exponent < 2:
        raise ValueError("a run has its period twice at least")
    left, base, reach = lag_counts(ids, first, exponent)
    lag = np.arange(len(left)) - np.repeat(base, reach + 1)
    need = np.maximum(min_length, exponent * lag) - lag
    open_ = np.flatnonzero((lag > 0) & (left >= need))
    owner = np.searchsorted(base, open_, "right") - 1
    order = np.argsort(lag[open_], kind="stable")
    open_, owner = open_[order], owner[order]
    cut = np.append(0, np.flatnonzero(np.diff(lag[open_])) + 1) if len(open_) else np.zeros(0, np.int64)
    found: dict[tuple[int, int, int], int] = {}
    for p, e in zip(cut, np.append(cut, len(open_))[1:], strict=True):
        # what runs of smaller periods do not explain
        still = left[open_[p:e]] >= need[open_[p:e]]
        docs, q = owner[p:e][still], int(lag[open_[p]])
        if not len(docs):
            continue
        at = _ranges(first[docs], first[docs + 1] - q)
        at = at[ids[at] == ids[at + q]]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1))
        length = np.diff(np.append(begin, len(at))) + q
        for s, n in zip(at[begin[length >= max(min_length, exponent * q)]].tolist(), length[length >= max(min_length, exponent * q)].tolist(), strict=True):
            d = int(np.searchsorted(first, s, "right")) - 1
            key = (d, s - int(first[d]), n)
            if key not in found:
                found[key] = q
                most = min(int(reach[d]), n - 1)
                left[base[d] + q : base[d] + most + 1 : q] -= n - np.arange(q, most + 1, q)
    return sorted((d, s, n, q) for (d, s, n), q in found.items())


def _joined(buf: np.ndarray, words: tx.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    start, end = words.start[kept], words.end[kept]
    many = tx.sums(kept.astype(np.int64), words.first)
    out = np.full(int((end - start).sum()) + len(start), ord(" "), np.uint8)
    to = np.cumsum(end - start + 1) - (end - start + 1)
    out[_ranges(to, to + end - start)] = buf[_ranges(start, end)]
    last = np.cumsum(many)
    stop = np.append(to, len(out))[last]
    # the space behind a document's last word goes
    space = np.zeros(len(out), bool)
    space[stop[many > 0] - 1] = True
    off = np.append(0, stop - np.cumsum(many > 0)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(many), pa.py_buffer(off), pa.py_buffer(out[~space]))


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period; by start, then period) and collapsed of each row of ``docs``.

    ``collapsed`` are the words that no run repeats, joined by one space: a run keeps its first period.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in tx.chunks(batches):
            words = tx.words(buf, off)
            ids = tx.Rolling(buf)(words.start, words.end) if len(words.start) else np.zeros(0, tx.U)
            kept = np.ones(len(ids), bool)
            got = find(ids, words.first, min_length, exponent)
            for d, s, n, q in got:
                kept[words.first[d] + s + q : words.first[d] + s + n] = False
            d, s, n, q = np.array(got, np.int64).reshape(-1, 4).T
            edge = pa.array(np.searchsorted(d, np.arange(rows.num_rows + 1)).astype(np.int32))
            each = pa.StructArray.from_arrays([pa.array(s), pa.array(n), pa.array(q)], fields=list(_RUN))
            yield pa.RecordBatch.from_arrays(
                [tx.column(rows, "doc_id"), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(edge, each), _joined(buf, words, kept).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _longest(part: str) -> Column:
    """Of the run of greatest length, then least start, then least period."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return best[part] if part == "length" else -best[part]


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of the rows of ``runs``."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = found.withColumns({part: _longest(part) for part in ("start", "length", "period")}).withColumn("n_runs", F.size("runs").cast("long"))
    return rows.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
