"""Repeated byte strings by common-prefix intervals of an enhanced suffix array.

A byte is removed if a string of ``LENGTH`` = 400 bytes that covers it also starts anywhere else, in this or another document. Strings never
cross documents and are judged on the input. A passage is a run of bytes each covered by a string of ``SPAN`` = 240 bytes or more that another document holds as well, if
more than ``PASSAGE_WORDS`` = 50 whole words (runs of bytes other than space, tab, \\n, \\v, \\f, \\r) lie in it; passages are counted, not removed.

**Suffixes.** Of every 121 neighbouring positions the one whose 16 bytes hash least is an anchor (the leftmost of equals), so each 240-byte
string holds an anchor in its first 121 positions, the same one wherever it occurs. Only anchors whose next 120 bytes are those of another
anchor can lie in a repeat. For these the context is fetched: 400 bytes on the right and 120 on the left.

**Tree.** Anchors of equal 120 bytes are sorted by what follows: a suffix array with the common prefixes of neighbours. A scan with a stack yields its
common-prefix intervals: all anchors that share their first l bytes, and no more. Each interval is tested for diversity on the left: its anchors sorted by what stands before them fall into nested classes of equal left extension. A
class that shares k bytes on the left is a repeat of k + l bytes that can be extended on neither side, and the class holds all its occurrences. ``groups`` returns those
of 400 bytes or more; contexts end after 120 and 400 bytes, so a longer repeat comes as overlapping ones. ``removed`` keeps for each
anchor the furthest reach of any such class on either side. Anchors of equal contexts are one leaf, and reach to the ends of it.

**Runs.** In a text of a short period every period has an anchor, up to one at each byte. Of anchors of equal contexts within one text two are exchanged at first, and one later, which carries the
runs of places of all of them; what it reaches holds for all.

**Crowded anchors.** A passage that very many documents quote gives very many anchors of equal 120 bytes. More than ``HOT`` are not sorted in one task but divided by where the repeated string can begin: it begins 0
to 120 bytes before the anchor, and all strings that begin lo to hi bytes before it hold hi bytes more on the right than lo leaves, so anchors are dealt by a hash of the lo bytes before and the (400 - hi) after them. Those that
also agree in hi bytes before and (400 - lo) after cover all that lies between, and one of them stands for all; the others go on to
either half of lo to hi while there are more than ``HOT``, seven times at most; then a hash of the whole string decides. Sums of tasks are exchanged, never a crowded anchor.

Equal texts are one text from the start; a text of 400 bytes or more that has a copy is covered whole. Null and empty texts have no bytes and
lose none; shorter texts lose none. Rows that repeat count as copies, and as other documents. Other columns are ignored. No rows: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _buckets, _text as tx
from ._store import Workspace

LENGTH, SPAN, PASSAGE_WORDS = 400, 240, 50
#: Positions from which an anchor is taken; bytes that anchors share at least; bytes by which an anchor is chosen.
WINDOW, SHARED, GRAM = SPAN // 2 + 1, SPAN // 2, 16
BEFORE = WINDOW - 1
#: Rows of one key that are sorted together.
HOT = 1 << 13
_SEGMENT = 1 << 20
#: Anchors whose contexts are sorted together, whole groups at least.
BLOCK = 1 << 14
#: Contexts in a batch.
_CONTEXTS = 1 << 12
#: What a span shows: a string of ``LENGTH`` bytes that starts elsewhere too; one of ``SPAN`` bytes in another document.
ANY, CROSS = 1, 2


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` neighbours."""
    n = len(x) - width + 1
    whole = -(-len(x) // width) * width
    table = np.full(whole, np.iinfo(x.dtype).max, x.dtype)
    table[: len(x)] = x
    table = table.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(roll: tx.Rolling, off: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all documents."""
    size = int(off[-1])
    valid = np.zeros(size + 1, np.int8)
    long = np.flatnonzero(np.diff(off) >= SPAN)
    if not len(long):
        return np.zeros(0, np.int64)
    valid[off[long]] += 1
    valid[off[long + 1] - SPAN + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    picked = np.zeros(size, bool)
    for at in range(0, size - SPAN + 1, _SEGMENT):
        to = min(size - GRAM + 1, at + _SEGMENT + WINDOW - 1)
        pos = np.arange(at, to)
        code = (roll.quick(pos, pos + GRAM) & ~tx.U((1 << 24) - 1)) | (pos - at).astype(tx.U)
        low = _least(code, WINDOW)
        low = low[valid[at : at + len(low)]]
        picked[(low & tx.U((1 << 24) - 1)).astype(np.int64) + at] = True
    return np.flatnonzero(picked)


def _contexts_hash(roll: tx.Rolling, off: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    first, last = np.maximum(off[doc], at - BEFORE), np.minimum(off[doc + 1], at + LENGTH)
    return roll(first, last) + tx.splitmix((at - first).astype(tx.U) + tx.U(1))


def _two_of_each(code: np.ndarray) -> np.ndarray:
    """Places of the first two of equal numbers."""
    order = np.argsort(code, kind="stable")
    run = _buckets.runs(code[order])
    place = np.arange(len(order)) - np.repeat(run[:-1], np.diff(run))
    return np.sort(order[place < 2])


def representatives(roll: tx.Rolling, off: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of anchors, two at most of each context in one text."""
    kept, codes = [], []
    for k in range(0, len(at), _SEGMENT):
        some = slice(k, k + _SEGMENT)
        code = _contexts_hash(roll, off, at[some], doc[some]) ^ tx.splitmix(doc[some].astype(tx.U))
        two = _two_of_each(code)
        kept.append(two + k)
        codes.append(code[two])
    if not kept:
        return np.zeros(0, np.int64)
    return np.concatenate(kept)[_two_of_each(np.concatenate(codes))]


def _digests(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """128 bits for each text, as two rows of 64-bit words."""
    raw = buf.tobytes()
    data = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
    return np.frombuffer(data, np.int64).reshape(-1, 2).T


def _profile(docs: DataFrame, store: Workspace) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, off in tx.chunks(batches):
            h = _digests(buf, off)
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.diff(off))], ["h1", "h2", "n"])

    rows = docs.select("text").mapInArrow(run, "h1 long, h2 long, n long")
    return store.save(rows.where(f"n >= {SPAN}").groupBy("h1", "h2", "n").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")


def _live(docs: DataFrame) -> DataFrame:
    """key, a (digest of the text), b (position) of anchors that share their key with another."""

    def emit(batches: Iterator[pa.RecordBatch]) -> _buckets.Emit:
        seen: set[int] = set()
        for _, buf, off in tx.chunks(batches):
            if not (np.diff(off) >= SPAN).any():
                continue
            h1 = _digests(buf, off)[0]
            roll = tx.Rolling(buf)
            at = anchors(roll, off)
            doc = np.searchsorted(off, at, "right") - 1
            new = np.zeros(len(h1), bool)
            for k, h in enumerate(h1.tolist()):
                if h not in seen:
                    seen.add(h)
                    new[k] = True
            if not new.all():
                at, doc = at[new[doc]], doc[new[doc]]
            two = representatives(roll, off, at, doc)
            at, doc = at[two], doc[two]
            yield roll(at, at + SHARED), h1[doc], at - off[doc]

    return _buckets.live(docs.select("text"), emit)


def _runs(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of places by code, those less than ``SPAN`` apart made one."""
    order = np.lexsort((first, code))
    code, first, last = code[order], first[order], last[order]
    new = np.append(True, (code[1:] != code[:-1]) | (first[1:] - last[:-1] >= SPAN))[: len(code)]
    return code[new], first[new], last[np.append(new[1:], True)[: len(code)]]


def _places(text: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, first, last) of the runs of a text's anchors whose contexts have these codes."""
    off = np.array([0, len(text)])
    roll = tx.Rolling(text)
    at = anchors(roll, off)
    held = [(np.zeros(0, tx.U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(at), _SEGMENT):
        some = at[k : k + _SEGMENT]
        code = _contexts_hash(roll, off, some, np.zeros(len(some), np.int64))
        own = np.isin(code, codes)
        held.append(_runs(code[own], some[own], some[own]))
    return _runs(*(np.concatenate(x) for x in zip(*held, strict=True)))


_CONTEXT = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int64()), ("more", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])


def _contexts(docs: DataFrame, live: DataFrame, every: bool) -> DataFrame:
    """key, h1, h2, at, more, before (reversed), after of live anchors.

    One anchor for each context of a text, with the runs of all that have it as pairs of places in ``more``, where there are several; or with ``every`` the first and last of each run.
    """
    wanted = _buckets.members(live.select("a").distinct())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for own, buf, off in tx.chunks(batches):
            h = _digests(buf, off)
            pick = np.flatnonzero(_buckets.held(wanted.value, h[0]) & (np.diff(off) >= SPAN))
            pick = np.array([k for k in pick if h[0][k] not in seen and not seen.add(int(h[0][k]))], np.int64)
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(h[0][pick]), pa.array(h[1][pick]), tx.column(own, "text").take(pa.array(pick)).cast(pa.binary())], ["h1", "h2", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h1, h2, text, keys, places in zip(*(tx.column(batch, c) for c in ("h1", "h2", "text", "keys", "places")), strict=True):
                h1, h2, data = h1.as_py(), h2.as_py(), text.as_buffer()
                raw = memoryview(data)
                found: dict[tuple[bytes, bytes], tuple[int, int]] = {}
                twice: set[int] = set()
                for p, k in sorted(zip(places.values.to_pylist(), keys.values.to_pylist(), strict=True)):
                    first = found.setdefault((bytes(raw[max(0, p - BEFORE) : p])[::-1], bytes(raw[p : p + LENGTH])), (p, k))[0]
                    if first != p:
                        twice.add(first)
                more: dict[int, np.ndarray] = {}
                if twice:
                    buf, at = np.frombuffer(data, np.uint8), np.array(sorted(twice), np.int64)
                    codes = _contexts_hash(tx.Rolling(buf), np.array([0, len(buf)]), at, np.zeros(len(at), np.int64))
                    code, first, last = _places(buf, codes)
                    for p, c in zip(at.tolist(), codes, strict=True):
                        a, b = np.searchsorted(code, c), np.searchsorted(code, c, "right")
                        more[p] = np.stack([first[a:b], last[a:b]], 1)
                own = []
                for (before, after), (p, k) in found.items():
                    if every:
                        own += [(k, h1, h2, x, None, before, after) for x in (np.unique(more[p]).tolist() if p in more else [p])]
                    else:
                        own.append((k, h1, h2, p, more[p].tobytes() if p in more else None, before, after))
                for at in range(0, len(own), _CONTEXTS):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*own[at : at + _CONTEXTS], strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)

    rows = docs.select("text").mapInArrow(texts, "h1 long, h2 long, text binary").dropDuplicates(["h1", "h2"])
    places = live.groupBy(F.col("a").alias("of")).agg(F.collect_list("key").alias("keys"), F.collect_list("b").alias("places"))
    return rows.join(places, F.col("h1") == F.col("of")).mapInArrow(cut, "key long, h1 long, h2 long, at long, more binary, before binary, after binary")


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bytes, filled up with 0, and their lengths."""
    _, offsets, data = column.cast(pa.large_binary()).buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    n = np.diff(off)
    out = np.zeros((len(n), width), np.uint8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out[np.arange(width) < n[:, None]] = raw[off[0] : off[-1]]
    return out, n


def _common(table: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of common prefixes of rows i and j."""
    out = np.zeros(len(i), np.int64)
    for at in range(0, len(i), 1 << 13):
        a, b = i[at : at + (1 << 13)], j[at : at + (1 << 13)]
        differ = table[a] != table[b]
        first = differ.argmax(1)
        out[at : at + (1 << 13)] = np.where(differ[np.arange(len(a)), first], first, table.shape[1])
    return np.minimum(out, np.minimum(n[i], n[j]))


def _as_strings(*parts: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(np.concatenate(parts, 1))
    return rows.view(f"S{rows.shape[1]}").ravel()


def _big_endian(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype(f">u{width}")).view(np.uint8).reshape(-1, width)


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(l, first, last) of every common-prefix interval with l >= least; common[k] is that of rows k and k + 1, -1 between groups."""
    stack: list[tuple[int, int]] = []
    for k, value in enumerate([*common.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > value:
            l, first = stack.pop()
            yield l, first, k
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append((value, first))


def _nearest(shared: np.ndarray, text: np.ndarray, several: np.ndarray) -> np.ndarray:
    """What each of a sorted run shares at most with one of another text; shared[k] is common to k and k + 1."""
    left, right = np.append(-1, shared), np.append(shared, -1)
    same = np.flatnonzero((text[1:] == text[:-1]) & ~several[1:] & ~several[:-1])
    for k in same:
        left[k + 1] = min(shared[k], left[k])
    for k in same[::-1]:
        right[k] = min(shared[k], right[k + 1])
    return np.maximum(left, right)


class Block:
    """Whole groups of anchors with their contexts: the leaves of their trees are the distinct contexts of each group, in the order of what follows."""

    def __init__(self, table: pa.Table):
        flat = lambda name: table.column(name).combine_chunks()
        join = lambda c: c if not isinstance(c, pa.ChunkedArray) else pa.concat_arrays(c.chunks)
        key, text = flat("key").to_numpy(), flat("h1").to_numpy()
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        after, n_after = _matrix(join(flat("after")), LENGTH)
        before, n_before = _matrix(join(flat("before")), BEFORE)
        names = _as_strings(_big_endian(group, 4), after, _big_endian(n_after, 2), before, _big_endian(n_before, 2))
        #: rows in the order of the suffix array, and the leaf of each
        self.rows = np.argsort(names, kind="stable")
        sorted_ = names[self.rows]
        at = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])), len(sorted_))
        del names, sorted_
        self.leaf = np.repeat(np.arange(len(at) - 1), np.diff(at))
        one = self.rows[at[:-1]]
        self.group, self.text = group[one], text[one]
        self.after, self.n_after, self.before, self.n_before = after[one], n_after[one], before[one], n_before[one]
        texts = text[self.rows]
        known = np.zeros(len(texts), bool) if "multi" not in table.column_names else np.asarray(table.column("multi").to_numpy(), bool)[self.rows]
        more = (table.column("more").is_valid().to_numpy() if "more" in table.column_names else np.zeros(len(texts), bool))[self.rows]
        #: leaves of several places, and of several texts; a row may stand for several
        self.twice = (np.diff(at) > 1) | np.bitwise_or.reduceat(known | more, at[:-1])
        self.several = (np.minimum.reduceat(texts, at[:-1]) != np.maximum.reduceat(texts, at[:-1])) | np.bitwise_or.reduceat(known, at[:-1])
        i = np.arange(len(one) - 1)
        alike = self.group[:-1] == self.group[1:]
        self.right = np.where(alike, _common(self.after, self.n_after, i, i + 1), -1)
        self.left = np.where(alike, _common(self.before, self.n_before, i, i + 1), -1)
        self.rank = np.empty(len(one), np.int64)
        self.rank[np.argsort(_as_strings(_big_endian(self.group, 4), self.before), kind="stable")] = np.arange(len(one))

    def reach(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For ``ANY`` and ``CROSS``, how far any class of enough bytes reaches to the left and right of each row's anchor; -1: none."""
        n = len(self.group)
        whole = self.n_before + self.n_after
        out = {}
        for kind, want, ok in ((ANY, LENGTH, self.twice), (CROSS, SPAN, self.several)):
            ok = ok & (whole >= want)
            out[kind] = (np.where(ok, self.n_before, -1), np.where(ok, self.n_after, -1))

        def put(kind: int, own: np.ndarray, l: np.ndarray | int, k: np.ndarray) -> None:
            ok = (k >= 0) & (k + l >= (LENGTH if kind == ANY else SPAN))
            left, right = out[kind]
            own, k = own[ok], k[ok]
            left[own] = np.maximum(left[own], k)
            right[own] = np.maximum(right[own], l if np.isscalar(l) else l[ok])

        # groups of two leaves, all at once
        first = _buckets.runs(self.group)
        size = np.diff(first)
        i = first[:-1][size == 2]
        other = self.several[i] | self.several[i + 1] | (self.text[i] != self.text[i + 1])
        for own in (i, i + 1):
            put(ANY, own, self.right[i], self.left[i])
            put(CROSS, own[other], self.right[i][other], self.left[i][other])
        # the others through their intervals
        many = np.flatnonzero(np.repeat(size > 2, size))
        right = self.right[many[:-1]] if len(many) else np.zeros(0, np.int64)
        right = np.where(self.group[many[:-1]] == self.group[many[1:]], right, -1) if len(many) else right
        for l, a, b in intervals(right, SHARED):
            own = many[a : b + 1]
            own = own[np.argsort(self.rank[own])]
            shared = _common(self.before, self.n_before, own[:-1], own[1:])
            put(ANY, own, l, np.maximum(np.append(shared, -1), np.append(-1, shared)))
            put(CROSS, own, l, _nearest(shared, self.text[own], self.several[own]))
        return {kind: (left[self.leaf], right[self.leaf]) for kind, (left, right) in out.items()}

    def repeats(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bytes before the anchor, bytes from it on, members) of each maximal repeat of enough bytes; members are places in ``rows``."""
        same = self.leaf[1:] == self.leaf[:-1]
        common = np.where(same, self.n_after[self.leaf[:-1]], np.append(self.right, -1)[self.leaf[:-1]])
        for l, first, last in intervals(common, SHARED):
            own = np.arange(first, last + 1)
            own = own[np.argsort(self.rank[self.leaf[own]], kind="stable")]
            shared = _common(self.before, self.n_before, self.leaf[own[:-1]], self.leaf[own[1:]])
            for k, a, b in intervals(shared, max(0, length - l)):
                members = own[a : b + 1]
                inner = common[members.min() : members.max()]
                if int(inner.min()) == l:  # else they share more on the right, and an inner interval has them
                    yield k, l, members


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield table.slice(0, whole)
            held, size = table.slice(whole).to_batches(), len(key) - whole
    if size:
        yield pa.Table.from_batches(held)


_SPAN = "h1 long, h2 long, start long, stop long, kind int"


def _span_rows(table: pa.Table | pa.RecordBatch, rows: np.ndarray, left: np.ndarray, right: np.ndarray, kind: int) -> pa.RecordBatch:
    """Spans around the places that these rows stand for."""
    some = table.take(pa.array(rows))
    h1, h2, at = (some.column(c).to_numpy() for c in ("h1", "h2", "at"))
    first, last = at, at
    row = np.arange(len(at))
    more = some.column("more")
    if more.null_count < len(more):
        pairs = [np.frombuffer(m, np.int64).reshape(-1, 2) if m is not None else [[a, a]] for m, a in zip(more.to_pylist(), at.tolist(), strict=True)]
        row = np.repeat(row, [len(p) for p in pairs])
        first, last = np.concatenate(pairs).T if len(pairs) else (at, at)
    return pa.RecordBatch.from_arrays([pa.array(h1[row]), pa.array(h2[row]), pa.array(first - left[row]), pa.array(last + right[row]), pa.array(np.full(len(row), kind, np.int32))], ["h1", "h2", "start", "stop", "kind"])


def _spans(rows: DataFrame) -> DataFrame:
    """Spans of anchors that share ``key``: by ``want``, where rows have one, or of both kinds."""
    asked = "want" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table)
            for kind, (left, right) in block.reach().items():
                ok = right >= 0
                if asked:
                    ok &= (table.column("want").to_numpy()[block.rows] == (LENGTH if kind == ANY else SPAN)) & ~np.asarray(table.column("multi").to_numpy(), bool)[block.rows]
                yield _span_rows(table, block.rows[ok], left[ok], right[ok], kind)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _SPAN)


def _agreed(rows: DataFrame) -> DataFrame:
    """Spans of rows that agree with others in all that their node asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, lo, hi = (tx.column(batch, c).to_numpy() for c in ("want", "lo", "hi"))
            before, after = (pa.compute.binary_length(tx.column(batch, c)).to_numpy() for c in ("before", "after"))
            left, right = np.minimum(hi, before), np.minimum(want - lo, after)
            for kind, length in ((ANY, LENGTH), (CROSS, SPAN)):
                own = np.flatnonzero(want == length)
                yield _span_rows(batch, own, left[own], right[own], kind)

    return rows.mapInArrow(run, _SPAN)


_GROUP = "repeat long, h1 long, h2 long, start long, n_bytes long"


def _listed(rows: DataFrame, length: int) -> DataFrame:
    """Occurrences of the repeats of anchors that share ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            block = Block(table)
            h1, h2, at, key = (table.column(c).to_numpy()[block.rows] for c in ("h1", "h2", "at", "key"))
            for turn, (k, l, own) in enumerate(block.repeats(length)):
                number = int(tx.splitmix(np.array([key[own[0]]], np.int64).view(tx.U) + tx.U(turn))[0] >> tx.U(1))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(own), pa.int64()), pa.array(h1[own]), pa.array(h2[own]), pa.array(at[own] - k), pa.array([k + l] * len(own), pa.int64())], ["repeat", "h1", "h2", "start", "n_bytes"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, _GROUP)


# ---- crowded anchors

_NODE = "key long, want int, lo int, hi int, whole long, multi boolean, h1 long, h2 long, at long, more binary, before binary, after binary"


def _word(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _halves(rows: DataFrame, wants: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of either half of their range of beginnings; with ``wants``, of the whole range for strings of these lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                before, after = r["before"], r["after"]
                middle = (r.get("lo", 0) + r.get("hi", 0)) // 2
                ranges = [(w, 0, BEFORE) for w in wants] if wants else [(r["want"], r["lo"], middle), (r["want"], middle + 1, r["hi"])] if r["lo"] < r["hi"] else []
                for want, lo, hi in ranges:
                    if max(lo, want - len(after)) > min(hi, len(before)):
                        continue
                    head = np.array([want, lo, hi], "<u4").tobytes()
                    out.append({"key": _word(head, before[:lo], after[: want - hi]), "want": want, "lo": lo, "hi": hi, "whole": _word(head[:4], np.array([min(hi, len(before))], "<u4").tobytes(), before[:hi], after[: want - lo]), "multi": bool(r.get("multi")), **{c: r[c] for c in ("h1", "h2", "at", "more", "before", "after")}})
            for k in range(0, len(out), _CONTEXTS):
                yield pa.RecordBatch.from_pylist(out[k : k + _CONTEXTS], _NODE_ARROW)

    return rows.mapInArrow(run, _NODE)


_NODE_ARROW = pa.schema([("key", pa.int64()), ("want", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("whole", pa.int64()), ("multi", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int64()), ("more", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])


def _divided(rows: DataFrame, store: Workspace, hot: int, wants: tuple[int, ...], every: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """(members of classes that agree in all their node asks for, rows of nodes that are no longer crowded); with ``every``, no row stands for others."""
    agreed, calm = [], []
    state = store.save(_halves(rows, wants), "nodes")
    first = F.struct("h1", "at")
    while True:
        classes = state.groupBy("key", "whole").agg(F.sum(F.when(F.col("more").isNull(), 1).otherwise(2)).alias("c"), F.min("h1").alias("a"), F.max("h1").alias("b"), F.max("multi").alias("m"), F.min(first).alias("rep"), F.first("want").alias("want"))
        classes = store.save(classes.withColumn("ok", F.when(F.col("want") == LENGTH, (F.col("c") > 1) | F.col("m")).otherwise((F.col("a") < F.col("b")) | F.col("m"))), "classes")
        left = F.sum("c" if every else F.when(F.col("ok"), 1).otherwise(F.col("c")))
        nodes = classes.groupBy("key").agg(F.count("*").alias("kinds"), left.alias("rows_left"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("m").alias("m"), F.first("want").alias("want"))
        nodes = store.save(nodes.where((F.col("kinds") > 1) & ((F.col("want") == LENGTH) | (F.col("a") < F.col("b")) | F.col("m"))).select(F.col("key").alias("of"), "rows_left"), "crowds")
        named = classes.where("ok").select(F.col("key").alias("k"), F.col("whole").alias("w"), "rep", "ok")
        member = store.save(state.join(named, (F.col("key") == F.col("k")) & (F.col("whole") == F.col("w")), "left").drop("k", "w").withColumn("ok", F.coalesce("ok", F.lit(False))), "members")
        agreed.append(member.where("ok and not multi"))
        rest = member if every else member.where(~F.col("ok") | (first == F.col("rep"))).withColumn("multi", F.col("ok"))
        rest = store.save(rest.join(nodes, F.col("key") == F.col("of")).drop("of", "rep", "ok"), "rest")
        calm.append(rest.where(F.col("rows_left") <= hot).drop("rows_left"))
        crowded = rest.where((F.col("rows_left") > hot) & (F.col("lo") < F.col("hi")))
        store.drop(state, classes, nodes)
        if crowded.isEmpty():
            return agreed, calm
        state = store.save(_halves(crowded.drop("rows_left")), "nodes")


def _split(docs: DataFrame, store: Workspace, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of anchors by key, and of those whose keys are crowded."""
    live = store.save(_live(docs).select("key", "a", "b").distinct(), "live")
    crowded = store.save(live.groupBy("key").count().where(F.col("count") > HOT).select("key"), "crowded")
    if crowded.isEmpty():
        return _contexts(docs, live, every), None
    shared = _buckets.members(crowded)

    def part(held: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_buckets.held(shared.value, batch.column(0).to_numpy()) == held))

        return live.select("key", "a", "b").mapInArrow(run, "key long, a long, b long")

    return _contexts(docs, part(False), every), store.save(_contexts(docs, part(True), every), "contexts")


def groups(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """repeat (number), h1, h2 (of the text), start, n_bytes of every occurrence of every maximal repeat among different texts and places.

    Of occurrences in a run of short period the first and the last are listed. Repeats of crowded anchors may come in overlapping pieces of ``LENGTH`` bytes or more.
    """
    if length < LENGTH:
        raise ValueError(f"repeats of under {LENGTH} bytes need other contexts")
    store = Workspace(docs.sparkSession, "repeats")
    cold, hot = _split(docs.select("text"), store, True)
    out = _listed(cold, length)
    if hot is None:
        return out
    agreed, calm = _divided(hot, store, HOT, (LENGTH,), True)
    for rows in calm:
        out = out.unionByName(_listed(rows, length))
    before, after = F.least("hi", F.length("before")), F.least(F.col("want") - F.col("lo"), F.length("after"))
    for rows in agreed:
        out = out.unionByName(rows.select(F.expr("xxhash64(key, whole) & 9223372036854775807").alias("repeat"), "h1", "h2", (F.col("at") - before).alias("start"), (before + after).cast("long").alias("n_bytes")).where(F.col("n_bytes") >= length))
    return out


def _found(docs: DataFrame, store: Workspace) -> DataFrame:
    """h1, h2, start, stop, kind of all spans of repeats."""
    cold, hot = _split(docs, store, False)
    out = _spans(cold)
    if hot is not None:
        agreed, calm = _divided(hot, store, HOT, (LENGTH, SPAN), False)
        for rows in calm:
            out = out.unionByName(_spans(rows))
        for rows in agreed:
            out = out.unionByName(_agreed(rows))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _whole_words(raw: bytes, a: int, b: int) -> int:
    """Words that lie in a range of a text."""
    part = raw[a:b]
    n = len(part.split())
    if n and a and not raw[a - 1 : a].isspace() and not part[:1].isspace():
        n -= 1
    if n and b < len(raw) and not raw[b : b + 1].isspace() and not part[-1:].isspace():
        n -= 1
    return n


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words of its passages) and spans (of bytes) of every row of ``docs``."""
    store = Workspace(docs.sparkSession, "repeats")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    copies = _profile(rows, store)
    whole = copies.select("h1", "h2", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"), F.when(F.col("n") >= LENGTH, ANY | CROSS).otherwise(CROSS).alias("kind"))
    found = _found(rows, store).unionByName(whole)
    found = store.save(found.groupBy(F.col("h1").alias("s1"), F.col("h2").alias("s2")).agg(*(F.collect_list(c).alias(c) for c in ("start", "stop", "kind"))), "spans")
    held = _buckets.members(found.select("s1"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long, spans array<struct<start:long,stop:long>>"

    def result(doc_id: pa.Array, kept: list[bytes], n: list[int], spans: list[list[tuple[int, int]]], words: list[int]) -> pa.RecordBatch:
        lost = [sum(b - a for a, b in s) for s in spans]
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(words, pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "spans"],
        )

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, off in tx.chunks(batches):
            pick = np.flatnonzero(~_buckets.held(held.value, _digests(buf, off)[0]))
            raw = buf.tobytes()
            kept = [raw[off[k] : off[k + 1]] for k in pick]
            yield result(tx.column(own, "doc_id").take(pa.array(pick)), kept, [len(k) for k in kept], [[] for _ in kept], [0] * len(kept))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, off in tx.chunks(batches):
            h = _digests(buf, off)
            pick = np.flatnonzero(_buckets.held(held.value, h[0]))
            if len(pick):
                yield pa.RecordBatch.from_arrays([pa.array(h[0][pick]), pa.array(h[1][pick]), *(tx.column(own, c).take(pa.array(pick)) for c in ("doc_id", "text"))], ["h1", "h2", "doc_id", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, spans, words = [], [], [], []
            for text, *found in zip(*(tx.column(batch, c).to_pylist() for c in ("text", "start", "stop", "kind")), strict=True):
                raw = (text or "").encode()
                found = list(zip(*(x or [] for x in found), strict=True))
                own = _merged([(a, b) for a, b, kind in found if kind & ANY])
                edges = [0, *(x for s in own for x in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                n.append(len(raw))
                spans.append(own)
                lengths = [_whole_words(raw, a, b) for a, b in _merged([(a, b) for a, b, kind in found if kind & CROSS])]
                words.append(sum(k for k in lengths if k > PASSAGE_WORDS))
            yield result(tx.column(batch, "doc_id"), kept, n, spans, words)

    rest = rows.mapInArrow(touched, "h1 long, h2 long, doc_id long, text string")
    rest = rest.join(found, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")), "left").select("doc_id", "text", "start", "stop", "kind")
    return rows.mapInArrow(clear, schema).unionByName(rest.mapInArrow(cut, schema))
