"""Licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a line; lines of over 32 words are read in windows of 32 words that overlap by 16, so that any statement of up to 16 words lies whole in one. Words are runs of
digits, letters and non-ASCII characters, A-Z in lower case. A window's features are those of its words and word pairs that occur in any statement below; a multinomial logistic regression
over them gives probabilities of the families, of an unknown licence and of no licence.

It is trained on statements made from the templates below, cut, thinned and set between words of the corpus; on statements of the same kind with other
names, which make the unknown class; and on at most ``SAMPLE_DOCS`` documents, as text without licence where it has nothing in common with a template. A fifth is held back:
on it one temperature is chosen for all probabilities, by least log loss. A window with a licence (probability of none under a half) belongs to the most
probable family if that, unknown set aside, reaches a half and a template of the family confirms it: ``CONFIRM`` of the template's word pairs stand in the window or of the
window's in the template. Otherwise its licence is unknown.

Null, empty and blank texts have no licence. Every row gives one row, repeated ones equal rows. Without any document there are no rows and the model is trained on templates
alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._store import small_batches
from .decontaminate import WORD

WINDOW, STEP = 32, 16
#: Documents from which text without licence is drawn, the bound of the training sample.
SAMPLE_DOCS = 400
#: Longer texts are left out of the sample.
SAMPLE_CHARS = 50_000
EPOCHS = 60
CONFIRM = 0.6

#: Statements by which texts name their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": ("licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License version 3", "SPDX License Identifier AGPL 3.0"),
    "apache": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License", "released under the Apache 2.0 license", "SPDX License Identifier Apache 2.0"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "licensed under the BSD 3 Clause License", "released under the BSD license", "SPDX License Identifier BSD 3 Clause"),
    "cc-by": ("Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License", "available under the CC BY license"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "available under the CC BY-NC license"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "available under the CC BY-SA license"),
    "cc0": ("dedicated to the public domain under CC0 1.0", "released under the CC0 1.0 Universal public domain dedication", "Licensed under CC0"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation", "released under the GNU GPL version 2", "SPDX License Identifier GPL 3.0"),
    "isc": ("Permission to use, copy, modify, and or distribute this software for any purpose", "released under the ISC License"),
    "lgpl": ("licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License version 2.1", "SPDX License Identifier LGPL 2.1"),
    "mit": ("Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX License Identifier MIT"),
    "mpl": ("subject to the terms of the Mozilla Public License, version 2.0", "licensed under the Mozilla Public License 2.0", "SPDX License Identifier MPL 2.0"),
    "proprietary": ("All rights reserved", "may not be reproduced without the prior written permission of the publisher", "Copyright all rights reserved no part of this work may be reproduced"),
    "public-domain": ("This is free and unencumbered software released into the public domain", "This work is in the public domain"),
}
#: Statements of a licence by an open name.
OPEN_FORMS = ("licensed under the {} license", "released under the {} license version 2", "this work is licensed under the {} public license", "available under {} terms", "distributed under the terms of the {} license agreement", "SPDX License Identifier {}")
FAMILIES = tuple(sorted(TEMPLATES))
NONE, UNKNOWN = len(FAMILIES), len(FAMILIES) + 1
CLASSES = len(FAMILIES) + 2

SCHEMA = "doc_id long, n_windows long, n_license long, families string, best_family string, confidence double, n_unknown long"


class Paragraphs(NamedTuple):
    h: np.ndarray
    #: document, first word and word past the last of each window
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def paragraphs(buf: np.ndarray, off: np.ndarray) -> Paragraphs:
    w = tx.words(buf, off, WORD)
    h = tx.Rolling(buf, tx.LOWER)(w.start, w.end)
    line = np.union1d(w.first[:-1], np.searchsorted(w.start, np.flatnonzero(buf == 10)))
    line = np.append(line[line < len(h)], len(h))
    n = np.diff(line)
    windows = 1 + np.maximum(0, -(-(n - WINDOW) // STEP))
    at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    begin, stop = np.repeat(line[:-1], windows), np.repeat(line[1:], windows)
    start = np.maximum(begin, np.minimum(begin + at * STEP, stop - WINDOW))
    end = np.minimum(stop, start + WINDOW)
    return Paragraphs(h, np.searchsorted(w.first, start, "right") - 1, start, end)


def _features(h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the vocabulary of words, and of pairs of a word and its next; its length for others."""
    out = []
    for x in (tx.splitmix(h), tx.grams(h, 2)):
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        out.append(np.where(vocabulary[at] == x, at, len(vocabulary)))
    return out[0], out[1]


def _hashes(text: str) -> np.ndarray:
    buf, off = tx.text_bytes(pa.array([text], pa.large_string()))
    w = tx.words(buf, off, WORD)
    return tx.Rolling(buf, tx.LOWER)(w.start, w.end)


PAIRS = {f: tuple(frozenset(tx.grams(_hashes(t), 2).tolist()) for t in texts) for f, texts in TEMPLATES.items()}


_STATEMENTS = [_hashes(t) for texts in TEMPLATES.values() for t in texts] + [_hashes(part) for form in OPEN_FORMS for part in form.split("{}")]
VOCABULARY = np.unique(np.concatenate([x for h in _STATEMENTS for x in (tx.splitmix(h), tx.grams(h, 2))]))


def confirmed(family: str, h: np.ndarray) -> bool:
    """Whether a template of the family and these words hold enough of each other's pairs."""
    own = set(tx.grams(h, 2).tolist())
    return any(len(own & t) >= CONFIRM * min(len(t), max(1, len(own))) for t in PAIRS[family])


class Model(NamedTuple):
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _logits(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return weights[rows].sum(1) + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(_softmax(logits)[np.arange(len(y)), y] + 1e-12).mean())


def train(texts: list[str], seed: int = 7) -> Model:
    """From the templates and a bounded sample of texts."""
    random = np.random.default_rng(seed)
    buf, off = tx.text_bytes(pa.array(texts, pa.large_string()))
    p = paragraphs(buf, off)
    known = set().union(*(t for ts in PAIRS.values() for t in ts))
    plain = [p.h[a:b] for a, b in zip(p.start, p.end, strict=True) if b - a >= 3 and not known & set(tx.grams(p.h[a:b], 2).tolist())]
    plain = [plain[k] for k in random.permutation(len(plain))[:4000]]
    filler = np.concatenate(plain) if plain else _hashes("lorem ipsum dolor sit amet")

    def drawn(n: int) -> np.ndarray:
        return filler[random.integers(0, len(filler), n)]

    rows: list[np.ndarray] = []
    y: list[int] = []

    def add(h: np.ndarray, label: int) -> None:
        room = max(0, WINDOW - len(h))
        before = int(random.integers(0, room + 1)) if random.random() < 0.7 else 0
        after = int(random.integers(0, room - before + 1)) if random.random() < 0.7 else 0
        rows.append(np.concatenate([drawn(before), h, drawn(after)])[:WINDOW])
        y.append(label)

    for label, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            h = _hashes(text)
            for _ in range(40):
                keep = random.random(len(h)) > (0.1 if len(h) > 8 else 0.0)
                add(h[keep], label)
    for _ in range(600):
        form = OPEN_FORMS[int(random.integers(len(OPEN_FORMS)))]
        ahead, behind = form.split("{}")
        add(np.concatenate([_hashes(ahead), drawn(int(random.integers(1, 3))), _hashes(behind)]), UNKNOWN)
    for h in plain:
        rows.append(h)
        y.append(NONE)

    none = len(VOCABULARY)
    table = np.full((len(rows), 2 * WINDOW), none)
    for k, h in enumerate(rows):
        one, two = _features(h, VOCABULARY)
        table[k, : len(one)] = one
        table[k, WINDOW : WINDOW + len(two)] = two
    labels = np.array(y)
    order = random.permutation(len(rows))
    fit, held = order[len(order) // 5 :], order[: len(order) // 5]
    weights, bias = np.zeros((none + 1, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    power = np.full((none + 1, CLASSES), 1e-8, np.float32)
    for _ in range(EPOCHS):
        for at in range(0, len(fit), 1024):
            k = fit[at : at + 1024]
            error = _softmax(_logits(table[k], weights, bias))
            error[np.arange(len(k)), labels[k]] -= 1
            error /= len(k)
            flat = table[k].ravel()
            by = np.argsort(flat, kind="stable")
            at_slot = np.flatnonzero(np.diff(flat[by], prepend=-1))
            touched = flat[by][at_slot]
            g = np.add.reduceat(error[by // (2 * WINDOW)], at_slot)
            g, touched = g[touched < none], touched[touched < none]
            g += 1e-5 * weights[touched]
            power[touched] += g * g
            weights[touched] -= 0.2 * g / np.sqrt(power[touched])
            bias -= 0.2 * error.sum(0)
    logits = _logits(table[held], weights, bias)
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0, 4.0), key=lambda t: _loss(logits / t, labels[held]))
    return Model(weights, bias, temperature)


def probabilities(p: Paragraphs, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of windows with any feature, their class probabilities); all others have no licence."""
    one, two = _features(p.h, VOCABULARY)
    two = np.append(two, len(VOCABULARY))[: len(one)]
    seen = np.append(0, np.cumsum((one < len(VOCABULARY)).astype(np.int64)))
    some = np.flatnonzero(seen[p.end] > seen[p.start])
    out = np.empty((len(some), CLASSES), np.float32)
    for at in range(0, len(some), 1 << 12):
        own = some[at : at + (1 << 12)]
        place = p.start[own][:, None] + np.arange(WINDOW)
        inside = place < p.end[own][:, None]
        a = np.where(inside, one[np.minimum(place, len(one) - 1)], len(VOCABULARY))
        inside &= place + 1 < p.end[own][:, None]
        b = np.where(inside, two[np.minimum(place, len(two) - 1)], len(VOCABULARY))
        out[at : at + len(own)] = _softmax(_logits(np.concatenate([a, b], 1), model.weights, model.bias) / model.temperature)
    return some, out


def scan(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row of ``docs``: windows read, windows with a licence, families (sorted, comma-joined), the most certain one with its probability, windows of unknown licence."""
    small_batches(docs.sparkSession)
    # those of least hash, so that neither files nor partitions decide; about four times as many pass the bound, however many there are, and eight times is the most that the driver takes
    some = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 53)).alias("h"))
    bound = int((1 << 53) * min(1.0, 4 * sample_docs / max(1, docs.count())))
    drawn = some.where(F.col("h") < bound).limit(8 * sample_docs).collect()
    texts = [r.text for r in sorted(drawn, key=lambda r: (r.h, r.text))[:sample_docs]]
    model = docs.sparkSession.sparkContext.broadcast(train(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, off in tx.chunks(batches):
            p = paragraphs(buf, off)
            n = len(off) - 1
            windows, prob = probabilities(p, model.value)
            families: list[set[str]] = [set() for _ in range(n)]
            best: list[tuple[float, str | None]] = [(0.0, None)] * n
            licensed, unknown = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row in np.flatnonzero(prob[:, NONE] < 0.5).tolist():
                k = int(windows[row])
                d = int(p.doc[k])
                licensed[d] += 1
                own_p = prob[row, :NONE] / max(1e-9, float(prob[row, :NONE].sum()))
                f = int(own_p.argmax())
                if own_p[f] >= 0.5 and confirmed(FAMILIES[f], p.h[p.start[k] : p.end[k]]):
                    families[d].add(FAMILIES[f])
                    best[d] = max(best[d], (round(float(own_p[f]), 4), FAMILIES[f]), key=lambda x: (x[0], x[1] or ""))
                else:
                    unknown[d] += 1
            yield pa.RecordBatch.from_arrays(
                [tx.column(own, "doc_id"), pa.array(np.bincount(p.doc, minlength=n)), pa.array(licensed), pa.array([",".join(sorted(f)) for f in families], pa.string()), pa.array([b for _, b in best], pa.string()), pa.array([c if b else None for c, b in best], pa.float64()), pa.array(unknown)],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
