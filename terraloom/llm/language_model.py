"""Language-model scores from a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Tokens are words in lower case (A-Z) and one end for each document; a document begins after an end. Documents whose crc32(doc_id as text) mod 7 is not 2
are training documents. All documents are scored. The model has three levels:

* a restaurant for each context, the token before: its customers are the training tokens that follow
* one parent restaurant shared by all contexts: each of their tables is a customer of it
* the even distribution over the V training tokens and one more

A restaurant of discount d and strength s with c customers at t tables, of which c(w) at t(w) tables eat w, gives w the probability
(c(w) - d t(w) + (s + d t) parent(w)) / (s + c).

**Seating.** Each dish of a context starts with one table. Then rounds follow: the parent is seated from the tables of all contexts, every context is told the parent's probability of each of its tokens, and its
customers are seated against it: in the first round one after another, afterwards by a Gibbs sweep, in which each of them leaves its table and sits down again: at a table of size k in proportion to k - d, at a new one in
proportion to (s + d t) parent(w). The parent's customers stay at their tables from round to round: where a token has lost tables among the contexts, as many of its customers, drawn evenly, leave for good; where it has won some, as many come; and all of them move
in a Gibbs sweep of the parent, new tables in proportion to (s + d t) / (V + 1). ``BURN`` sweeps are thrown away; the probabilities after each of ``SAMPLES`` more, from the contexts and the parent then seated from them, are
averaged; log10 of the averages add up over a text.

Dishes move side by side in a sweep, each against the others' tables after the last one, and contexts against the parent of the last round. Dishes of more than ``BLOCKS`` customers move a 256th of them at a time. Draws come from hashes of context, token, customer and
round, so no score depends on partitions, buckets, parts or reruns.

**Sums over all contexts.** A bucket holds the restaurants of about ``BUCKET_TOKENS`` training tokens, so their number grows with the corpus and every restaurant fits a task. A context of more than ``SHARE`` customers is
divided by the token that follows; before each sweep its parts are told the tables of all of them. The parent is divided by token into slots, whose number grows with the buckets; each token's customers are the sum over all buckets, each
slot is told the tables of all. No token is treated unlike others for being rare. Only the contexts that are divided, one for ``SHARE`` training tokens at most, are known to all tasks.

Documents are packed into chunks of token numbers; a chunk sends each bucket its distinct pairs of tokens with their counts, which the bucket keeps as numbers of its own pairs, and gets back the probability of
each at the end. Word counts for the base score come in a like way. Inside a bucket contexts are told apart by 40 bits of their
hash beside the bucket, tokens everywhere by 64; log10 of what is sent back comes in steps of 2**-19.

base_score adds log10((c + 1) / (N + V + 1)) over the tokens. Null and empty texts are an end alone. A null doc_id counts as the text "". Repeated
rows count each. Without training documents N and V are 0 and all probabilities 1 for the one unknown token. Other columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as tx
from ._buckets import from_low40, long, low40, runs, short
from ._store import Workspace

FOLDS, HELD_FOLD = 7, 2
BUCKET_TOKENS, SHARE = 1 << 20, 1 << 18
BURN, SAMPLES, BLOCKS = 1, 2, 256
DISCOUNT, STRENGTH = 0.75, 1.0
#: Bytes of text in a chunk.
CHUNK_BYTES = 6 << 20
#: Steps in which log10 of a number is sent, in three bytes; the last number stands for 0.
STEPS, NOTHING = 1 << 19, (1 << 24) - 1
_END = tx.splitmix(np.array([0x3C6EF372FE94F82B], tx.U))[0]
_LOW = tx.U((1 << 40) - 1)

_TOKENS = "chunk long, doc_ids array<bigint>, lens binary, held binary, n_words long, end long, tokens binary, words binary"


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, sorted, and the place of each; only distinct ones are sorted."""
    met = pa.array(x).dictionary_encode()
    values = met.dictionary.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return values[order], rank[met.indices.to_numpy()]


class Chunk(NamedTuple):
    chunk: int
    doc_ids: list
    #: tokens of each document with its end, and whether it is held out
    lens: np.ndarray
    held: np.ndarray
    #: how many distinct tokens there are, the number of the end, and the number of every token
    n_words: int
    end: int
    tokens: np.ndarray
    #: mixed hashes of distinct tokens, sorted
    words: np.ndarray

    @property
    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lens)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (context number * n_words + token number), sorted, and the place of each token's pair."""
        before = np.append(self.end, self.tokens[:-1])  # documents end with the end
        return np.unique(before * self.n_words + self.tokens, return_inverse=True)


def _held(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_FOLD


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2**32 in four planes of bytes, which pack well if most are small."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 4, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _packed(docs: DataFrame, store: Workspace) -> DataFrame:
    """Chunks; words are stored by how frequent they are in the chunk, and tokens as numbers of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for own, buf, off in tx.chunks(batches, limit=CHUNK_BYTES):
            w = tx.words(buf, off)
            h = tx.splitmix(tx.Rolling(buf, tx.LOWER)(w.start, w.end) + tx.U(17))
            words, tokens = _distinct(np.insert(h, w.first[1:], _END))
            order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order), dtype="<u4")
            ids = tx.column(own, "doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([(np.diff(w.first) + 1).astype("<u4").tobytes()], pa.binary()),
                    pa.array([np.array([_held(d) for d in ids], bool).tobytes()], pa.binary()),
                    pa.array([len(words)], pa.int64()),
                    pa.array([int(np.searchsorted(words, _END))], pa.int64()),
                    pa.array([_planes(rank[tokens])], pa.binary()),
                    pa.array([words[order].tobytes()], pa.binary()),
                ],
                [c.split()[0] for c in _TOKENS.split(", ")],
            )
            number += 1

    return store.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TOKENS), "chunks")


def _loaded(row: dict) -> Chunk:
    lens = np.frombuffer(row["lens"], "<u4").astype(np.int64)
    words = np.frombuffer(row["words"], tx.U)
    order = np.argsort(words)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Chunk(row["chunk"], row["doc_ids"], lens, np.frombuffer(row["held"], bool), row["n_words"], row["end"], place[_from_planes(row["tokens"], int(lens.sum()))], words[order])


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    """Rises with the mixed hash, so sorted tokens are sorted by slot."""
    return (((h >> tx.U(32)) * tx.U(slots)) >> tx.U(32)).astype(np.int64)


def _cut(slot: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers in a sorted vector."""
    at = np.flatnonzero(np.diff(slot, prepend=-1, append=-1)) if len(slot) else []
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield int(slot[a]), slice(int(a), int(b))


def _by(rows: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows of one key."""
    at, held = None, []
    for batch in rows:
        for row in batch.to_pylist():
            if held and row[key] != at:
                yield held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield held


# ---- word counts

_REPLY = "chunk long, kind int, slot long, data binary"


def _replies(chunk: list, kind: list, slot: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(kind, pa.int32()), pa.array(slot, pa.int64()), pa.array(data, pa.binary())], ["chunk", "kind", "slot", "data"])


def _counted(chunks: DataFrame, slots: int, store: Workspace) -> DataFrame:
    """Replies of kind 1 with the training count of each distinct token of a chunk; and, of kind -1, by slot: N, V, tokens that come once and twice; -2: training tokens with their counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _loaded(row)
                n = np.bincount(c.tokens[c.training], minlength=c.n_words)
                out = [(s, c.words[at].tobytes(), short(n[at])) for s, at in _cut(_slot(c.words, slots))]
                yield pa.RecordBatch.from_arrays([pa.array([c.chunk] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["chunk", "slot", "words", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "slot"):
            sizes = [len(r["words"]) // 8 for r in rows]
            words, inverse = np.unique(np.frombuffer(b"".join(r["words"] for r in rows), tx.U), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([long(r["n"], k) for r, k in zip(rows, sizes, strict=True)]), len(words)).astype("<i8")
            each = np.split(n[inverse], np.cumsum(sizes)[:-1])
            some = n > 0
            extra = [np.array([n.sum(), np.count_nonzero(some), np.count_nonzero(n == 1), np.count_nonzero(n == 2)], "<i8").tobytes(), words[some].tobytes() + n[some].tobytes()]
            yield _replies([r["chunk"] for r in rows] + [0, 0], [1] * len(rows) + [-1, -2], [rows[0]["slot"]] * (len(rows) + 2), [*(np.uint32(len(e)).tobytes() + short(e) for e in each), *extra])

    asked = chunks.mapInArrow(ask, "chunk long, slot long, words binary, n binary")
    return store.save(asked.repartition("slot").sortWithinPartitions("slot", "chunk").mapInArrow(answer, _REPLY), "words")


class Known(NamedTuple):
    """What all tasks know of the corpus."""

    n: int
    v: int
    #: tokens of more than ``SHARE``, sorted, and their training counts; the discount of the parent
    tokens: np.ndarray
    count: np.ndarray
    discount: float
    #: contexts that are divided (places among these tokens), into how many parts, and the parts as 40 bits, sorted, with the place in ``divided``
    divided: np.ndarray
    parts: np.ndarray
    part: np.ndarray
    part_of: np.ndarray
    buckets: int

    def place(self, words: np.ndarray, among: np.ndarray) -> np.ndarray:
        """Places of words in a sorted array; -1 for others."""
        if not len(among):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(among, words), len(among) - 1)
        return np.where(among[at] == words, at, -1)


def _parts(context: np.ndarray, number: np.ndarray) -> np.ndarray:
    return tx.splitmix(context + (number + 1).astype(tx.U))


def _known(words: DataFrame) -> Known:
    """The discount of the parent is from the numbers of tokens that come once and twice."""
    totals = np.sum([np.zeros(4, np.int64), *(np.frombuffer(r.data, "<i8") for r in words.where("kind = -1").select("data").toLocalIterator())], 0)
    n, v, once, twice = (int(x) for x in totals)
    share = SHARE

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                token, count = np.frombuffer(data.as_buffer(), "<i8").reshape(2, -1)
                some = count > share
                yield pa.RecordBatch.from_arrays([pa.array([token[some].tobytes()], pa.binary()), pa.array([count[some].tobytes()], pa.binary())], ["token", "count"])

    found = words.where("kind = -2").select("data").mapInArrow(frequent, "token binary, count binary").collect()
    tokens, count = np.frombuffer(b"".join(r.token for r in found), tx.U), np.frombuffer(b"".join(r["count"] for r in found), "<i8")
    order = np.argsort(tokens)
    tokens, count = tokens[order], count[order]
    divided, parts = np.arange(len(tokens)), -(-count // share)
    of = np.repeat(divided, parts)
    part = _parts(tokens[of], np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) & _LOW
    order = np.argsort(part)
    return Known(n, v, tokens, count, min(0.95, max(0.05, once / max(1, once + 2 * twice))), divided, parts, part[order], of[order], max(1, -(-n // BUCKET_TOKENS)))


# ---- restaurants


def _dealt(c: Chunk, pair: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """(context, place among the distinct pairs) of the distinct pairs of a chunk, by bucket, 40 bits of the context and token; a divided context comes as its parts."""
    context, token = c.words[pair // c.n_words], c.words[pair % c.n_words]
    if len(known.divided):
        at = known.place(context, known.tokens[known.divided])
        some = np.flatnonzero(at >= 0)
        context[some] = _parts(context[some], (tx.splitmix(token[some]) % known.parts[at[some]].astype(tx.U)).astype(np.int64))
    order = np.argsort((_slot(context, known.buckets).astype(tx.U) << tx.U(40)) | (context & _LOW), kind="stable")
    return context[order], order


class Restaurants:
    """Of one bucket: dishes are distinct (context, token) pairs; those of several customers have tables that move."""

    def __init__(self, context: np.ndarray, token: np.ndarray, n: np.ndarray, parent: np.ndarray, parts: np.ndarray, name: np.ndarray, strength: float = STRENGTH, discount: float = DISCOUNT, elsewhere: np.ndarray | None = None, held: tuple | None = None, turn: int = 0):
        """parent: of each token; parts: one for each context (tables count so many times for the others); name: 64 bits of each dish; elsewhere: tables of each context in other buckets.

        held: (customers, tables and ``labels()`` of then): who sat keeps the table, more customers stand until a sweep, customers too many have left. Without it all are seated.
        """
        self.context, self.parts, self.strength, self.discount, self.turn = context, parts, strength, discount, turn
        self.elsewhere = np.zeros(len(parts)) if elsewhere is None else elsewhere
        self.t = (n > 0).astype(np.int64)
        self.dish = self._dishes(n)
        self.n = n[self.dish]
        self.base = np.cumsum(self.n) - self.n
        self.mass = parent[token[self.dish]]
        self.name = name[self.dish]
        self.table = np.zeros(int(self.n.sum()), np.int64)
        self.size = np.zeros(0, np.int64)
        self.next = 0
        self._salts: dict[tuple[int, int], np.ndarray] = {}
        self.tables = np.bincount(context, self.t, len(parts))
        if held is None:
            self._sweep(True)
        else:
            self._resume(*held, name)

    @staticmethod
    def _dishes(n: np.ndarray) -> np.ndarray:
        """Dishes of several customers, the largest first."""
        own = np.flatnonzero(n > 1)
        return own[np.argsort(-n[own], kind="stable")]

    def labels(self) -> np.ndarray:
        """The table of each customer, numbered from 0 within the dish."""
        dish = np.full(self.next, -1)
        dish[self.table] = np.repeat(np.arange(len(self.n)), self.n)
        ids = np.flatnonzero(dish >= 0)
        order = ids[np.argsort(dish[ids], kind="stable")]
        t = self.t[self.dish]
        label = np.empty(self.next, np.int64)
        label[order] = np.arange(len(order)) - np.repeat(np.cumsum(t) - t, t)
        return label[self.table]

    def _resume(self, n: np.ndarray, t: np.ndarray, labels: np.ndarray, name: np.ndarray) -> None:
        """From customers and tables of all dishes, and labels of those of several customers, in their order then."""
        was, now = self._dishes(n), np.zeros(len(n), np.int64)
        now[self.dish] = self.n
        offset, start = np.cumsum(t[was], dtype=np.int64) - t[was], np.cumsum(n[was]) - n[was]
        table = labels + np.repeat(offset, n[was])
        self.next = int(t[was].sum())
        if len(was) == len(self.dish) and (was == self.dish).all() and (n[was] == self.n).all():  # the same customers
            self.table = table
            self.t[was] = t[was]
        else:
            stays = np.repeat(now[was] > 1, n[was])
            stays[self._leaving(was, n, now, start, name)] = False
            alone = np.flatnonzero((n == 1) & (now > 1))
            dish = np.append(np.repeat(was, n[was])[stays], alone)
            table = np.append(table[stays], self.next + np.arange(len(alone)))
            self.next += len(alone)
            # customers of a dish come one after another
            place = np.arange(len(dish)) - np.repeat((at := runs(dish))[:-1], np.diff(at))
            first = np.zeros(len(n), np.int64)
            first[self.dish] = self.base
            self.table[:] = -1
            self.table[first[dish] + place] = table
            of = np.full(self.next, -1)
            of[table] = dish
            self.t[self.dish] = np.bincount(of[of >= 0], minlength=len(n))[self.dish]
        self.size = np.bincount(table, minlength=self.next)
        self.tables = np.bincount(self.context, self.t, len(self.parts))

    def _leaving(self, was: np.ndarray, n: np.ndarray, now: np.ndarray, start: np.ndarray, name: np.ndarray) -> np.ndarray:
        """Whom to take from the dishes that go on with fewer: places among all customers, drawn evenly, drawn again where somebody is drawn twice."""
        some = np.flatnonzero((now[was] < n[was]) & (now[was] > 1))
        left, gone, use = (n[was] - now[was])[some], np.zeros(int(n[was].sum()), bool), 0
        while len(some):
            who = np.repeat(some, left)
            nth = np.arange(len(who)) - np.repeat(np.cumsum(left) - left, left)
            draw = tx.splitmix(name[was[who]] + nth.astype(tx.U) * tx.U(0x9E3779B97F4A7C15) + tx.splitmix(np.array([(1 << 63) + self.turn * 4096 + use], tx.U)))
            at = start[who] + ((draw >> tx.U(11)).astype(np.float64) * 2.0**-53 * n[was[who]]).astype(np.int64)
            at = np.unique(at[~gone[at]])
            gone[at] = True
            left = left - np.bincount(np.searchsorted(start, at, "right") - 1, minlength=len(was))[some]
            some, left = some[left > 0], left[left > 0]
            use += 1
        return np.flatnonzero(gone)

    def _even(self, dish: np.ndarray, place: np.ndarray, use: int) -> np.ndarray:
        """In [0, 1), from the dish, the customer, the sweep and what it is used for."""
        salt = self._salts.get((self.turn, use))
        if salt is None:
            salt = self._salts[self.turn, use] = tx.splitmix(np.array([self.turn * 4096 + use + 1], tx.U))
        x = place.astype(tx.U)
        x *= tx.U(0x9E3779B97F4A7C15)
        x += self.name[dish]
        x += salt
        return (tx.splitmix(x) >> tx.U(11)).astype(np.float64) * 2.0**-53

    def sweep(self) -> None:
        self._sweep(False)

    def _sweep(self, first: bool) -> None:
        d, t = self.discount, self.t[self.dish] if not first else np.zeros(len(self.dish), np.int64)
        others = (self.tables * self.parts + self.elsewhere)[self.context[self.dish]] - (t if not first else 1)
        self.size = np.concatenate([self.size, np.zeros(len(self.table), np.int64)])
        full, rest = np.divmod(self.n, BLOCKS)
        if first:
            sitting = np.zeros(len(self.n), np.int64)
        else:
            sitting = self.n - np.bincount(np.repeat(np.arange(len(self.n)), self.n)[self.table < 0], minlength=len(self.n))
        for j in range(min(BLOCKS, int(self.n.max(initial=0)))):
            m = int(np.searchsorted(-self.n, -j))  # dishes of more than j customers
            many = (self.n[:m] - j + BLOCKS - 1) // BLOCKS
            dish = np.repeat(np.arange(m), many)
            place = j + BLOCKS * (np.arange(len(dish)) - np.repeat(np.cumsum(many) - many, many))
            at = self.base[dish] + place
            if not first:
                sat = np.flatnonzero(self.table[at] >= 0)
                left = self.table[at[sat]]
                np.subtract.at(self.size, left, 1)
                gone = np.flatnonzero(self.size[left] == 0)
                _, one = np.unique(left[gone], return_index=True)
                np.subtract.at(t, dish[sat[gone[one]]], 1)
                sitting[:m] -= np.bincount(dish[sat], minlength=m)
            seated = sitting[:m]
            new = (self.strength + d * np.maximum(others[:m] + t[:m], 0)) * self.mass[:m]
            opens = self._even(dish, place, 0) * (new + np.maximum(seated - d * t[:m], 0))[dish] < new[dish]
            opens |= (seated == 0)[dish]
            if first:
                opens &= (seated > 0)[dish] | (place == 0)
            fresh = np.flatnonzero(opens)
            chosen = np.empty(len(dish), np.int64)
            chosen[fresh] = self.next + np.arange(len(fresh))
            self.next += len(fresh)
            if first and j == 0:  # the first customers of a large dish sit at one table
                chosen = np.repeat(chosen[place == 0], many)
            else:
                self._sit(dish, place, np.flatnonzero(~opens), j, first, seated, full, rest, chosen)
            self.table[at] = chosen
            np.add.at(self.size, chosen, 1)
            np.add.at(t, dish[fresh], 1)
            sitting[:m] += many
        self.t[self.dish] = t
        self.tables = np.bincount(self.context, self.t, len(self.parts))
        self.turn += 1

    def _sit(self, dish, place, open_, j: int, first: bool, seated, full, rest, chosen) -> None:
        """Tables in proportion to their size less the discount: that of any seated customer, drawn again with the discount's share of one."""
        use = 1
        while len(open_):
            own = dish[open_]
            if first:  # seated are the customers of the blocks before this one
                a = (self._even(own, place[open_], use) * seated[own]).astype(np.int64)
                longer = np.minimum(j, rest[own])
                inside = a < longer * (full[own] + 1)
                block = np.where(inside, a // (full[own] + 1), longer + (a - longer * (full[own] + 1)) // np.maximum(full[own], 1))
                row = np.where(inside, a % (full[own] + 1), (a - longer * (full[own] + 1)) % np.maximum(full[own], 1))
                other = row * BLOCKS + block
                ok = np.ones(len(own), bool)
            else:
                other = (self._even(own, place[open_], use) * self.n[own]).astype(np.int64)
                ok = other % BLOCKS != j
            table = self.table[self.base[own] + other]
            size = self.size[table]
            ok &= (table >= 0) & (self._even(own, place[open_], use + 1) * size < size - self.discount)
            chosen[open_[ok]] = table[ok]
            open_ = open_[~ok]
            use += 2

    def sampled(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Tables of each dish, and of each context, after every sweep that counts, while the parent stays."""
        dishes, contexts = [], []
        for k in range(BURN + SAMPLES):
            self.sweep()
            if k >= BURN:
                dishes.append(self.t.copy())
                contexts.append(self.tables.copy())
        return dishes, contexts


def _steps(p: np.ndarray) -> np.ndarray:
    """log10 in steps, three bytes each."""
    with np.errstate(divide="ignore"):
        x = np.where(p > 1e-31, np.round(-np.log10(np.clip(p, 1e-300, 1.0)) * STEPS), NOTHING).astype("<u4")
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4)[:, :3])


def _from_steps(data: bytes) -> np.ndarray:
    x = np.zeros((len(data) // 3, 4), np.uint8)
    x[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    x = x.view("<u4").ravel()
    return np.where(x == NOTHING, 0.0, 10.0 ** (x / -STEPS))


# ---- rounds

#: kind: SEATS: the restaurants of a bucket or the parent's of a slot; ASKED: customers and tables of tokens; PAIRS: which pairs of a bucket a chunk has; TOTAL: tables; PARTS: tables of parts of divided contexts
_MESSAGE = "slot long, kind int, part long, a binary, b binary"
SEATS, ASKED, PAIRS, TOTAL, PARTS = range(5)


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _MESSAGE.split(", ")])


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as the greatest asks."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _frozen(arrays: dict[str, np.ndarray]) -> bytes:
    """As one value, numbers in planes of bytes."""
    out = io.BytesIO()
    np.savez(out, **{f"{x.dtype.str} {name}": np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T) for name, x in arrays.items()})
    return len(out.getvalue()).to_bytes(8, "little") + pa.compress(out.getvalue(), "zstd", asbytes=True)


def _thawed(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))) as arrays:
        return {key.split()[1]: np.ascontiguousarray(x.T).view(key.split()[0]).ravel() for key, x in arrays.items()}


def _own_rows(rows: DataFrame) -> DataFrame:
    return rows.repartition("slot").sortWithinPartitions("slot", "kind", "part")


class Bucket:
    """The restaurants of a bucket: contexts, tokens and the distinct pairs of them by context and token, those of held out documents among them."""

    def __init__(self, data: dict[str, np.ndarray], known: Known):
        self.data, self.known = data, known
        self.contexts, self.tokens, self.n = data["contexts"], data["tokens"], data["n"].astype(np.int64)
        self.context = np.repeat(np.arange(len(self.contexts)), data["followers"])
        self.token = data["token"].astype(np.int64)
        self.t = data["t"].astype(np.int64)
        of = known.place(self.contexts, known.part)
        self.whole = np.where(of >= 0, known.part_of[of], -1) if len(known.part) else of

    @property
    def tables(self) -> np.ndarray:
        return np.bincount(self.context, self.t, len(self.contexts))

    def elsewhere(self, whole: np.ndarray) -> np.ndarray:
        """Tables of each context in other parts, from those of all parts."""
        return np.where(self.whole >= 0, whole[self.whole] - self.tables, 0) if len(whole) else np.zeros(len(self.contexts))

    def mass(self, rows: list[dict], slots: int, of: Callable) -> np.ndarray:
        """The parent's probability of each token, from what its slots say."""
        sizes = [at.stop - at.start for _, at in _cut(_slot(self.tokens, slots))]
        c, t = (np.concatenate([long(r[x], k) for r, k in zip(rows, sizes, strict=True)]) for x in "ab")
        return of(c, t)

    def probabilities(self, mass: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Of each pair."""
        tables, customers = self.tables + self.elsewhere(whole), np.bincount(self.context, self.n, len(self.contexts))
        if len(self.known.divided):
            customers = np.where(self.whole >= 0, self.known.count[self.known.divided[self.whole]], customers)
        own = np.maximum(self.n - DISCOUNT * self.t, 0) + (STRENGTH + DISCOUNT * tables)[self.context] * mass[self.token]
        return own / (STRENGTH + customers)[self.context]

    def sweep(self, turn: int, mass: np.ndarray, whole: np.ndarray) -> None:
        """Seats all customers in the first turn, then moves each of them once."""
        # a part draws as the whole context would
        origin = np.where(self.whole >= 0, self.known.tokens[self.known.divided[self.whole]] & _LOW, self.contexts) if len(self.known.divided) else self.contexts
        name = tx.splitmix(origin[self.context] * tx.U(0xD1342543DE82EF95) + self.tokens[self.token])
        held = (self.n, self.t, self.data["labels"]) if turn else None
        seated = Restaurants(self.context, self.token, self.n, mass, np.ones(len(self.contexts), np.int64), name, elsewhere=self.elsewhere(whole), held=held, turn=turn)
        if turn:
            seated.sweep()
        self.t = seated.t
        self.data |= {"t": _small(seated.t), "labels": _small(seated.labels())}

    def rows(self, slot: int) -> list[tuple]:
        cut = np.flatnonzero(self.whole >= 0)
        parts = np.stack([self.whole[cut], self.tables[cut].astype(np.int64)]).astype("<i8")
        return [(slot, SEATS, 0, _frozen(self.data), b""), (slot, TOTAL, 0, np.int64(self.t.sum()).tobytes(), b""), *([(slot, PARTS, 0, parts.tobytes(), b"")] if len(cut) else [])]


def _buckets(chunks: DataFrame, known, store: Workspace) -> DataFrame:
    """Restaurants of all buckets, a table for each dish, and which pairs of them each chunk has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _loaded(row)
                pair, inverse = c.pairs()
                n = np.bincount(inverse, c.training, len(pair)).astype(np.int64)
                context, place = _dealt(c, pair, known.value)
                out = []
                for s, at in _cut(_slot(context, known.value.buckets)):
                    new = np.flatnonzero(np.append(True, context[at][1:] != context[at][:-1]))
                    token = c.words[pair[place[at]] % c.n_words]
                    out.append((c.chunk, s, low40(context[at][new]), short(np.diff(np.append(new, len(token)))), token.tobytes(), short(n[place[at]])))
                columns = list(zip(*out, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[2:])], ["chunk", "slot", "u", "followers", "w", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "slot"):
            slot, sizes = rows[0]["slot"], [len(r["w"]) // 8 for r in rows]
            each = [from_low40(r["u"]) for r in rows]
            contexts, where = np.unique(np.concatenate(each), return_inverse=True)
            where = np.split(where, np.cumsum([len(e) for e in each])[:-1])
            u = np.concatenate([np.repeat(x, long(r["followers"], len(x))) for x, r in zip(where, rows, strict=True)])
            n = np.concatenate([long(r["n"], m) for r, m in zip(rows, sizes, strict=True)])
            tokens, w = _distinct(np.frombuffer(b"".join(r["w"] for r in rows), tx.U))
            pair, inverse = np.unique(u * len(tokens) + w, return_inverse=True)
            del u, w
            n = np.bincount(inverse, n, len(pair)).astype(np.int64)
            data = {"contexts": contexts, "tokens": tokens, "followers": _small(np.bincount(pair // len(tokens))), "token": _small(pair % len(tokens)), "n": _small(n), "t": (n > 0).astype(np.uint8)}
            out = Bucket(data, known.value).rows(slot)
            for r, mine in zip(rows, np.split(inverse, np.cumsum(sizes)[:-1]), strict=True):
                out.append((slot, PAIRS, r["chunk"], _planes(np.diff(mine, prepend=0)), len(mine).to_bytes(8, "little")))
            yield _messages(out)

    asked = chunks.mapInArrow(ask, "chunk long, slot long, u binary, followers binary, w binary, n binary")
    return store.save(asked.repartition("slot").sortWithinPartitions("slot", "chunk").mapInArrow(merge, _MESSAGE), "buckets", "uncompressed")


class Parent(NamedTuple):
    """The parent restaurant of each sample."""

    #: probability of each frequent token; of others for each customer, and whatever their customers
    frequent: np.ndarray
    each: np.ndarray
    least: np.ndarray
    #: weight of the parent in each divided context
    weight: np.ndarray


def _tables_of(name: np.ndarray, c: np.ndarray, v: int, discount: float, elsewhere: float, held: tuple | None = None, turn: int = 0) -> Restaurants:
    """The parent's tables for some of its tokens of c customers each, as they come or after a sweep from those held; elsewhere: tables of its other tokens."""
    one = np.zeros(len(c), np.int64)
    m = Restaurants(one, one, c, np.full(1, 1 / (v + 1)), np.ones(1, np.int64), name, discount=discount, elsewhere=np.array([elsewhere]), held=held, turn=turn)
    if turn:
        m.sweep()
    return m


def _mass(c: np.ndarray, t: np.ndarray, customers: int, tables: int, v: int, discount: float) -> np.ndarray:
    """The parent's probability of tokens of c customers at t tables each, from customers and tables of all."""
    return (c - discount * t + (STRENGTH + discount * tables) / (v + 1)) / (STRENGTH + customers)


def _parent(known: Known, discount: float, customers: np.ndarray, tables: np.ndarray) -> Parent:
    """The parent where all tokens but rare ones are in one place; rare ones have the last of the customers, at a table each at most."""
    rare = max(0, known.v - len(known.tokens))
    frequent, each, least = [], [], []
    for c in customers:
        behind = min(rare, int(c[-1]))
        t = _tables_of(known.tokens, c[:-1], known.v, discount, behind).t
        of = lambda c_, t_: _mass(c_, t_, int(c.sum()), int(t.sum()) + behind, known.v, discount)  # noqa: B023, E731
        frequent.append(of(c[:-1], t))
        least.append(float(of(0, 0)))
        each.append((float(of(int(c[-1]), behind)) - least[-1]) / max(1, known.n - int(known.count.sum())))
    return Parent(np.array(frequent).reshape(len(customers), -1), np.array(each), np.array(least), (STRENGTH + DISCOUNT * tables) / (STRENGTH + known.count[known.divided]))


class Totals(NamedTuple):
    #: the parent's customers and tables, and the tables of each divided context
    customers: int
    tables: int
    whole: np.ndarray


def _sums(buckets: DataFrame, parents: DataFrame, known: Known) -> Totals:
    """A number from each bucket and slot; parts of divided contexts are no more than ``SHARE`` goes into the training tokens."""
    out = {}
    whole = np.zeros(len(known.divided))
    for name, rows in (("customers", buckets), ("tables", parents)):
        found = rows.where(F.col("kind").isin(TOTAL, PARTS)).select("kind", "a").collect()
        out[name] = sum(int.from_bytes(r.a, "little") for r in found if r.kind == TOTAL)
        for r in found:
            if r.kind == PARTS:
                np.add.at(whole, *np.frombuffer(r.a, "<i8").reshape(2, -1))
    return Totals(out["customers"], out["tables"], whole)


def _parents(buckets: DataFrame, before: DataFrame | None, slots: int, elsewhere: int, turn: int, known, store: Workspace) -> DataFrame:
    """The parent by slots of tokens, seated from the tables of all buckets; what each bucket has to know of its tokens. elsewhere: its tables in all slots before."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = _thawed(row["a"])
                c = np.bincount(data["token"], data["t"], len(data["tokens"])).astype(np.int64)
                yield _messages([(s, ASKED, row["slot"], data["tokens"][at].tobytes(), short(c[at])) for s, at in _cut(_slot(data["tokens"], slots))])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, discount = known.value.v, known.value.discount
        for rows in _by(batches, "slot"):
            slot, held = rows[0]["slot"], None
            if rows[0]["kind"] == SEATS:
                held = _thawed(rows[0]["a"])
                rows = rows[1:]
            sizes = [len(r["a"]) // 8 for r in rows]
            tokens, inverse = _distinct(np.frombuffer(b"".join(r["a"] for r in rows), tx.U))
            c = np.bincount(inverse, np.concatenate([long(r["b"], k) for r, k in zip(rows, sizes, strict=True)]), len(tokens)).astype(np.int64)
            # of as many tables as there were tokens or tables in all slots, those of this one
            own = np.count_nonzero(c) if held is None else held["t"].sum()
            m = _tables_of(tx.splitmix(tokens), c, v, discount, elsewhere - int(own), held and (held["c"].astype(np.int64), held["t"], held["labels"]), turn)
            data = {"c": _small(c), "t": _small(m.t), "labels": _small(m.labels())}
            both = [np.split(x[inverse], np.cumsum(sizes)[:-1]) for x in (c, m.t)]
            yield _messages([(slot, SEATS, 0, _frozen(data), b""), (slot, TOTAL, 0, np.int64(m.t.sum()).tobytes(), b""), *((r["part"], ASKED, slot, short(x), short(y)) for r, x, y in zip(rows, *both, strict=True))])

    asked = buckets.where(F.col("kind") == SEATS).mapInArrow(ask, _MESSAGE)
    if before is not None:
        asked = asked.unionByName(before.where(F.col("kind") == SEATS))
    return store.save(_own_rows(asked).mapInArrow(answer, _MESSAGE), "parents")


def _told(rows: list[dict], known: Known, slots: int, totals: Totals) -> tuple[Bucket, np.ndarray, list[dict]]:
    """A bucket, the parent's probability of its tokens, and its rows of other kinds."""
    b = Bucket(_thawed(rows[0]["a"]), known)
    mass = b.mass([r for r in rows if r["kind"] == ASKED], slots, lambda c, t: _mass(c, t, totals.customers, totals.tables, known.v, known.discount))
    return b, mass, [r for r in rows if r["kind"] == PAIRS]


def _round(buckets: DataFrame, parents: DataFrame, slots: int, totals: Totals, turn: int, known, store: Workspace) -> DataFrame:
    """Customers of all buckets seated against the parent; probabilities so far are added up after the sweeps that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "slot"):
            b, mass, _ = _told(rows, known.value, slots, totals)
            if turn > BURN + 1:
                b.data["p"] = (b.probabilities(mass, totals.whole) + b.data.get("p", 0)).astype(np.float32)
            b.sweep(turn, mass, totals.whole)
            if turn == BURN + SAMPLES:
                del b.data["labels"]
            yield _messages(b.rows(rows[0]["slot"]))

    rows = buckets.where(F.col("kind") == SEATS).unionByName(parents.where(F.col("kind") == ASKED))
    return store.save(_own_rows(rows).mapInArrow(run, _MESSAGE), "buckets", "uncompressed")


def _answered(buckets: DataFrame, parents: DataFrame, pairs: DataFrame, slots: int, totals: Totals, known) -> DataFrame:
    """Replies of kind 2: the averaged probability of each distinct pair of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "slot"):
            b, mass, asked = _told(rows, known.value, slots, totals)
            data = _steps((b.probabilities(mass, totals.whole) + b.data.get("p", 0)) / SAMPLES)
            each = [data[np.cumsum(_from_planes(r["a"], int.from_bytes(r["b"], "little")), dtype=np.uint32)].tobytes() for r in asked]
            yield _replies([r["part"] for r in asked], [2] * len(asked), [rows[0]["slot"]] * len(asked), each)

    rows = buckets.where(F.col("kind") == SEATS).unionByName(parents.where(F.col("kind") == ASKED)).unionByName(pairs.where(F.col("kind") == PAIRS))
    return _own_rows(rows).mapInArrow(run, _REPLY)


@contextmanager
def _tidy(spark) -> Iterator[None]:
    """Files of exchanges go once what was made from them is saved."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    spark = docs.sparkSession
    store = Workspace(spark, "language-model")
    with _tidy(spark):
        chunks = _packed(docs, store)
        words = _counted(chunks, max(4, -(-chunks.count() // 2)), store)
        known = _known(words)
        n, v, slots = known.n, known.v, max(1, known.buckets // 4)
        shared = spark.sparkContext.broadcast(known)
        buckets = _buckets(chunks, shared, store)
        pairs = store.save(buckets.where(F.col("kind") == PAIRS), "pairs")
        parents = _parents(buckets, None, slots, v, 0, shared, store)
        for turn in range(1 + BURN + SAMPLES):
            totals = _sums(buckets, parents, known)
            swept = _round(buckets, parents, slots, totals, turn, shared, store)
            seated = _parents(swept, parents, slots, totals.tables, turn + 1, shared, store)
            store.drop(parents, buckets)
            buckets, parents = swept, seated
        answers = store.save(_answered(buckets, parents, pairs, slots, _sums(buckets, parents, known), shared), "answers")
        store.drop(parents, buckets, pairs)

    replies = answers.unionByName(words.where("kind = 1"))
    columns = [c.split(" ") for c in _TOKENS.split(", ")[1:]]
    every = chunks.withColumns({"kind": F.lit(0), "slot": F.lit(0).cast("long"), "data": F.lit(None).cast("binary")})
    every = every.unionByName(replies.withColumns({c: F.lit(None).cast(t) for c, t in columns})).repartition("chunk").sortWithinPartitions("chunk", "kind", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by(batches, "chunk"):
            c = _loaded(rows[0])
            count = np.concatenate([long(r["data"][4:], int(np.frombuffer(r["data"], "<u4", 1)[0])) for r in rows if r["kind"] == 1])
            pair, inverse = c.pairs()
            p = np.empty(len(pair))
            p[_dealt(c, pair, shared.value)[1]] = np.minimum(_from_steps(b"".join(r["data"] for r in rows if r["kind"] == 2)), 1.0)
            first = np.append(0, np.cumsum(c.lens))
            known_tokens = count[c.tokens]
            base = np.log10((known_tokens + 1) / (n + v + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.doc_ids, pa.int64()), pa.array(c.held), pa.array(c.lens), pa.array(tx.sums(known_tokens > 0, first)), pa.array([n] * len(c.lens), pa.int64()), pa.array(np.add.reduceat(base, first[:-1])), pa.array(np.add.reduceat(np.log10(p)[inverse], first[:-1]))],
                [x.split()[0] for x in SCORES.split(", ")],
            )

    return every.mapInArrow(run, SCORES)


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity and base_perplexity a token over all documents on either side."""
    ten = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), ten("score").alias("perplexity"), ten("base_score").alias("base_perplexity"))
