"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct 5-word shingles, words in lower case (A-Z); with fewer words, the whole sequence is the one
shingle. Two documents link when 100 * intersection >= 75 * union, which is to say that their symmetric difference is at most (|A| + |B|) / 7.

**Sketch.** Every shingle flips one bit of a bit vector, the one its hash names. The Hamming distance of two sketches is at most the symmetric difference
of the sets: common shingles cancel and every other one flips one bit. A vector of 2**64 bits is cut into blocks of 4; nearly all bits are 0, so a block is kept as the XOR of a code
for each bit that is set, and an empty block not at all. Narrow vectors, kept whole, refute pairs later.

**Pigeonhole.** Of two documents that link, the larger has at most a quarter of its shingles for itself and the smaller a seventh: from 7 * intersection >= 3 * (a + b). So at
most as many of its blocks differ from the other's. Put a document's blocks in an order that all documents share, and one more than that number of first blocks
of each hold a common one: before the first common block stand only blocks that differ. The order puts
blocks that many documents share last, by a count over all documents in a table of fixed size, so that a passage that many documents
quote brings them together only where they consist of little else.

**Bands.** A band holds sizes from 4**j to 4**(j+1). A document whose partner may stand in the next band, and is then the larger, sends the blocks of a smaller one there as well.

**Verify.** Documents of equal sets are one node from the start. Nodes that share a block are compared with one leader of the block first, on whole sets; linked ones become
one component. Only blocks whose nodes are still in several components are compared further: first with another leader, then every node outside the block's largest component
with every node of another component, in bounded squares on sketches, and on whole sets where the Hamming distance allows a link. Pairs within one component
are never made, as they can't change it; all others that could link are tested, so none is lost.

Null, empty and blank texts have no shingles, link with nothing and are their own component. Rows that share a doc_id are one
document: its links are those of all its rows. A null doc_id links with nothing and has a null component.
Other columns are ignored by ``classes`` and carried by ``distinct_documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.operators.components import components

from . import _buckets
from . import _text as tx
from ._store import Workspace

SHINGLE = 5
#: Bytes in the table of block counts.
COUNTERS = 1 << 23
#: A sketch has 2**SKETCH times as many bits as the least size of its band, and 64 at least; from band ``WIDE`` on twice as many as the set's size or more, which tell as much.
SKETCH, WIDE = 4, 5
#: Rounds of comparison with one leader of each block.
ROUNDS = 2
#: Nodes on a side of a square; nodes of a block in which partners of like size are looked for before sketches are sent.
SQUARE, FEW = 4096, 64


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all documents, sorted within each; where each document's begin, with the end)."""
    w = tx.words(buf, off)
    h = tx.Rolling(buf, tx.LOWER)(w.start, w.end)
    n = np.diff(w.first)
    full = np.flatnonzero(tx.within(w.first, SHINGLE))
    parts, docs = [tx.grams(h, SHINGLE)[full]], [np.searchsorted(w.first, full, "right") - 1]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n == k)
        parts.append(tx.grams(h, k)[w.first[short]])
        docs.append(short)
    g, d = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(g)
    order = order[np.argsort(d[order].astype(np.uint16 if len(n) < 1 << 16 else np.int64), kind="stable")]
    g, d = g[order], d[order]
    new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]))[: len(g)]
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(n) + 1))


def signatures(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set; 0 for empty ones."""
    out = np.zeros((2, len(first) - 1), tx.U)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[0, full] = np.bitwise_xor.reduceat(tx.splitmix(g), first[full])
        out[1, full] = np.add.reduceat(tx.splitmix(g + tx.U(0xA0761D6478BD642F)), first[full])
    return out[0], out[1]


def allowed(n: np.ndarray, above: np.ndarray | int = 0) -> np.ndarray:
    """The most shingles of a document of n that one it links with may lack; above: with one that is no smaller."""
    return np.where(above, n // 7, n // 4)


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(4 ** np.arange(1, 31), n, "right")


def blocks(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, whether in the band above its own) of every non-empty block of every document in every band that it takes part in; sizes of documents."""
    n = np.diff(first)
    j = band(n)
    out = []
    for up in (0, 1):
        takes = (n > 0) if not up else (n > 0) & (4 * n // 3 >= 4 ** (j + 1))
        rows = np.flatnonzero(np.repeat(takes, n))
        if not len(rows):
            continue
        doc = np.repeat(np.arange(len(n)), n)[rows]
        x, level = g[rows], (j + up)[doc]
        cell = x >> tx.U(2)  # rises with the sorted hashes; the lowest bits choose the bit in it
        at = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (doc[1:] != doc[:-1])))
        inside = np.bitwise_xor.reduceat(tx.splitmix((x & tx.U(3)) + tx.U(1)), at)
        key = tx.splitmix(inside ^ tx.splitmix(cell[at] ^ (level[at].astype(tx.U) << tx.U(58))))
        out.append((doc[at], key, np.full(len(at), up)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, tx.U), np.zeros(0, np.int64), n
    doc, key, above = (np.concatenate(x) for x in zip(*out, strict=True))
    return doc, key, above, n


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> tx.U(64 - 23)).astype(np.int64)


def leading(doc: np.ndarray, key: np.ndarray, above: np.ndarray, n: np.ndarray, load: np.ndarray) -> np.ndarray:
    """Rows of the first ``allowed + 1`` blocks of each document and band, blocks of few documents first."""
    group = doc * 2 + above
    rank = (load[_slot(key)].astype(tx.U) << tx.U(40)) | (key >> tx.U(24))
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(group[order].astype(np.uint16 if len(n) < 1 << 15 else np.int64), kind="stable")]
    at = _buckets.runs(group[order])
    have = np.diff(at)
    head = order[at[:-1]]
    wanted = allowed(n[doc[head]], above[head]) + 1
    if (have < wanted).any():
        raise ValueError("a document has too few blocks for the pigeonhole")
    place = np.arange(len(order)) - np.repeat(at[:-1], have)
    return order[place < np.repeat(wanted, have)]


def _profile(docs: DataFrame, store: Workspace) -> DataFrame:
    """doc_id, n, s1, s2 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, off in tx.chunks(batches):
            g, first = shingle_sets(buf, off)
            s1, s2 = signatures(g, first)
            yield pa.RecordBatch.from_arrays([tx.column(own, "doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], ["doc_id", "n", "s1", "s2"])

    return store.save(docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long"), "profile")


def _load(docs: DataFrame) -> np.ndarray:
    """How many documents hold the blocks of each slot, in eighths of a power of two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(COUNTERS, np.uint8)
        for _, buf, off in tx.chunks(batches):
            _, key, _, _ = blocks(*shingle_sets(buf, off))
            at, n = np.unique(_slot(key), return_counts=True)
            total[at] = np.minimum(255, total[at] + n)
        yield total

    return _buckets.combined(docs, count, COUNTERS, total="u4", finish=lambda x: np.minimum(255, 8 * np.log2(1 + x.astype(np.float64))))


def _live(docs: DataFrame, load: np.ndarray) -> DataFrame:
    """key, node (hash of a set), n of leading blocks that several sets have, and k, x, y as ``_buckets.live`` has them."""
    shared = docs.sparkSession.sparkContext.broadcast(load)

    def emit(batches: Iterator[pa.RecordBatch]) -> _buckets.Emit:
        for _, buf, off in tx.chunks(batches):
            g, first = shingle_sets(buf, off)
            s1, _ = signatures(g, first)
            _, once = np.unique(s1, return_index=True)
            doc, key, above, n = blocks(g, first)
            if not len(doc):
                continue
            row = leading(doc, key, above, n, shared.value)
            row = row[np.isin(doc[row], once)]
            yield key[row], s1.view(np.int64)[doc[row]], n[doc[row]]

    return _buckets.live(docs, emit).select("key", F.col("a").alias("node"), F.col("b").alias("n"), "k", "x", "y")


def _blocks_once(live: DataFrame, store: Workspace) -> DataFrame:
    """Without blocks of one node, of the very same nodes as another, or all of whose nodes have one and the same larger block as their largest.

    The nodes of most blocks have been counted where they met. Rows of crowded ones are dealt by key and node, and counted by key from sums of each task, so that no task has a block
    to itself. What is joined by key is a table of its own: a join of plain exchanges can be split where a key is crowded.
    """
    met = store.save(live, "met")
    known = met.where("x is not null").select("key", "k", "x", "y")
    crowd = store.save(met.where("k = 0").groupBy("key", "node").agg(F.min("n").alias("n")), "crowd")
    mixed = F.xxhash64("node")
    crowded = crowd.groupBy("key").agg(F.count("*").alias("k"), F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64(mixed, F.lit(1))).alias("y")).where("k > 1")
    one = store.save(known.unionByName(crowded).groupBy("k", "x", "y").agg(F.min("key").alias("of")).select("of", F.col("k").alias("size")), "one")
    rows = met.where("k > 0").select("key", "node", "n").unionByName(crowd)
    rows = store.save(rows.join(one, F.col("key") == F.col("of")).select("key", "node", "n", F.col("size").alias("k")), "blocks")
    store.drop(met, crowd, one)
    top = rows.groupBy(F.col("node").alias("own")).agg(F.max(F.struct("k", "key")).alias("top")).select("own", F.col("top.key").alias("largest"))
    inner = rows.join(top, F.col("node") == F.col("own")).groupBy(F.col("key").alias("of")).agg(F.min("largest").alias("lo"), F.max("largest").alias("hi")).where("lo = hi and lo <> of").select("of")
    out = store.save(rows.join(store.save(inner, "inner"), F.col("key") == F.col("of"), "left_anti").select("key", "node", "n"), "live")
    store.drop(rows)
    return out


def sketch(g: np.ndarray, width: int) -> np.ndarray:
    """Parities of ``width`` bits, a power of 2, as 64-bit words. The sketch of half the width is the XOR of its halves."""
    return np.packbits(np.bincount((g & tx.U(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").view(tx.U)


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set of n."""
    j = band(n)
    return 1 << np.where(j < WIDE, np.maximum(6, 2 * j + SKETCH), 1 + np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def _of(docs: DataFrame, wanted: DataFrame, make: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` makes of doc_ids, shingles and their borders, for the documents of the column ``wanted`` and a few others."""
    shared = _buckets.members(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, buf, off in tx.chunks(batches):
            ids = tx.column(own, "doc_id")
            pick = np.flatnonzero(_buckets.held(shared.value, ids.to_numpy()))
            if len(pick):
                parts = [buf[off[k] : off[k + 1]] for k in pick]
                yield make(ids.take(pa.array(pick)), *shingle_sets(np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))))

    return docs.mapInArrow(run, schema)


def _drawn(docs: DataFrame, wanted: DataFrame, store: Workspace) -> DataFrame:
    """node, rep (a document that has the set), n, sketch of the documents of the column."""

    def make(ids: pa.Array, g: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        n = np.diff(first)
        out = [sketch(g[a:b], w).tobytes() for a, b, w in zip(first[:-1], first[1:], widths(n).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(signatures(g, first)[0].view(np.int64)), ids, pa.array(n), pa.array(out, pa.binary())], ["node", "rep", "n", "sketch"])

    return store.save(_of(docs, wanted, make, "node long, rep long, n long, sketch binary").where("n > 0").dropDuplicates(["node"]), "sketches")


def _whole(docs: DataFrame, wanted: DataFrame, store: Workspace) -> DataFrame:
    """node, more (the other half of a set's signature), hashes (sorted 64-bit words) of the documents of the column, and of a few others; each set once."""

    def make(ids: pa.Array, g: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        s1, s2 = signatures(g, first)
        return pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([g[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["node", "more", "hashes"])

    return store.save(_of(docs, wanted, make, "node long, more long, hashes binary").where("length(hashes) > 0").dropDuplicates(["node", "more"]), "whole")


def _may_link(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link; only sketches are moved."""
    left = drawn.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = drawn.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na").select("a", "b", (F.col("na") + F.col("nb")).alias("size"), "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for size, x, y in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                x, y = np.frombuffer(x.as_buffer(), tx.U), np.frombuffer(y.as_buffer(), tx.U)
                width = min(len(x), len(y))
                ok.append(7 * int(np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(dtype=np.int64)) <= size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while len(words) > width:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def links(pairs: DataFrame, docs: DataFrame, drawn: DataFrame, store: Workspace) -> DataFrame:
    """The pairs (a, b) whose sets link, with the other halves p and q of their signatures; whole sets of these nodes alone are made, and moved once each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
    some = _whole(docs, drawn.select("node", "rep").join(nodes, F.col("node") == F.col("of"), "left_semi").select("rep"), store)
    left = some.select(F.col("node").alias("a"), F.col("more").alias("p"), F.col("hashes").alias("ha"))
    right = some.select(F.col("node").alias("b"), F.col("more").alias("q"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                x, y = np.frombuffer(x.as_buffer(), tx.U), np.frombuffer(y.as_buffer(), tx.U)
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                ok.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "p", "q"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long, p long, q long")


def _unsettled(live: DataFrame, roots: DataFrame | None, store: Workspace) -> DataFrame:
    """key, node, n, c (component) of blocks whose nodes are in several components."""
    rows = live.select("key", "node", "n")
    if roots is None:
        return rows.withColumn("c", F.col("node"))
    roots = roots.select(F.col("node").alias("of"), "root")
    rows = store.save(rows.join(roots, F.col("node") == F.col("of"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("c")), "placed")
    mixed = store.save(rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(F.col("key").alias("of")), "mixed")
    out = store.save(rows.join(mixed, F.col("key") == F.col("of"), "left_semi"), "rest")
    store.drop(rows, mixed)
    return out


def _with_leader(rows: DataFrame, turn: int, store: Workspace) -> DataFrame:
    """(a, b): the nodes of each block with its leader of this round, if their components differ.

    Blocks of like nodes mostly have one leader in the first round, so few pairs come of them; in later ones each block has its own.
    """
    first = F.struct(F.xxhash64("node", *[F.col("key")] * (turn > 0), F.lit(turn)).alias("h"), F.col("node").alias("leader"), F.col("c").alias("lc"), F.col("n").alias("ln"))
    lead = store.save(rows.groupBy("key").agg(F.min(first).alias("l")).select(F.col("key").alias("of"), "l.leader", "l.lc", "l.ln"), "leaders")
    pairs = rows.join(lead, F.col("key") == F.col("of")).where("c <> lc and 4 * n >= 3 * ln and 4 * ln >= 3 * n")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _with_partner(rows: DataFrame) -> DataFrame:
    """Of rows (key, node, n, c) those that have one of like size and another component in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, ("key",)):
            group, n, c = _groups(table, ("key",)), _numbers(table, "n"), _numbers(table, "c")
            has = np.zeros(len(n), bool)
            for i, j in _like(group, n):
                ok = c[i] != c[j]
                has[i[ok]] = has[j[ok]] = True
            yield from table.filter(pa.array(has)).to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, rows.schema)


def _squares(rows: DataFrame, drawn: DataFrame, store: Workspace) -> DataFrame:
    """(a, b) of all nodes of different components that share a block and whose sketches allow a link.

    A block of more than ``SQUARE`` nodes is cut: its nodes outside its largest component meet all its nodes in squares of about ``SQUARE`` by ``SQUARE``.
    """
    size = rows.groupBy("key", "c").agg(F.count("*").alias("k"))
    size = size.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all"))
    size = store.save(size.select(F.col("key").alias("of"), F.col("top.c").alias("main"), "all", F.ceil(F.col("all") / SQUARE).alias("wide"), F.ceil((F.col("all") - F.col("top.k")) / SQUARE).alias("high")), "sizes")
    rows = rows.join(size, F.col("key") == F.col("of")).drop("of")
    few = _with_partner(rows.where(F.col("all") <= FEW).select("key", "node", "n", "c"))
    rows = rows.where(F.col("all") > FEW)
    columns = ["key", "y", "x", "side", "node", "n", "c"]
    zero = F.lit(0).cast("long")
    small = rows.where("wide = 1").select("key", "node", "n", "c").unionByName(few).select("key", zero.alias("y"), zero.alias("x"), F.lit(0).alias("side"), "node", "n", "c")
    large = rows.where("wide > 1")
    place = lambda many: F.pmod(F.xxhash64("node"), F.col(many))
    left = large.where("c <> main").select("key", place("high").alias("y"), F.explode(F.sequence(zero, F.col("wide") - 1)).alias("x"), F.lit(1).alias("side"), "node", "n", "c")
    right = large.select("key", F.explode(F.sequence(zero, F.col("high") - 1)).alias("y"), place("wide").alias("x"), F.lit(2).alias("side"), "node", "n", "c")
    dealt = small.select(columns).unionByName(left.select(columns)).unionByName(right.select(columns))
    dealt = dealt.join(drawn.select(F.col("node").alias("r"), "sketch"), F.col("node") == F.col("r")).drop("r")
    dealt = dealt.repartition("key", "y", "x").sortWithinPartitions("key", "y", "x", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_blocks(batches, ("key", "y", "x")):
            yield from _close(table, _groups(table, ("key", "y", "x")))

    return dealt.mapInArrow(run, "a long, b long").distinct()


#: Rows of squares that are compared together, whole squares at least.
SQUARE_ROWS = 1 << 14
#: Pairs, and words of sketches, that are compared at once.
_PAIRS, _WORDS = 1 << 17, 1 << 18


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _groups(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Numbers runs of rows that agree in these columns."""
    new = np.zeros(table.num_rows, bool)
    for name in names:
        v = _numbers(table, name)
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _whole_blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of about ``SQUARE_ROWS`` rows that hold whole runs."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= SQUARE_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            group = _groups(table, names)
            whole = int(np.searchsorted(group, int(group[-1])))
            if whole:
                yield table.slice(0, whole)
            held = table.slice(whole).to_batches()
            size = table.num_rows - whole
    if size:
        yield pa.Table.from_batches(held).combine_chunks()
    tx.trim()


def _like(group: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group whose sizes allow a link, by how far apart they stand; the rows of a group rise by size."""
    step = 1
    open_ = np.arange(len(n))  # rows with a partner ``step`` rows on of like size
    while True:
        open_ = open_[open_ + step < len(n)]
        j = open_ + step
        ok = (group[j] == group[open_]) & (3 * n[j] <= 4 * n[open_])
        open_, j = open_[ok], j[ok]
        if not len(open_):
            return
        yield open_, j
        step += 1


def _close(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    node, n, c, side = (_numbers(table, k) for k in ("node", "n", "c", "side"))
    one = table.column("sketch").combine_chunks()
    sketches = Sketches(node, one.chunk(0) if isinstance(one, pa.ChunkedArray) else one)
    held: list[np.ndarray] = []
    size = 0
    for i, j in _like(group, n):
        ok = (c[i] != c[j]) & ((side[i] != side[j]) | (side[i] == 0))
        if ok.any():
            held.append(np.stack([i[ok], j[ok]]))
            size += int(ok.sum())
        if size >= _PAIRS:
            yield _near(np.concatenate(held, 1), sketches, n)
            held, size = [], 0
    if size:
        yield _near(np.concatenate(held, 1), sketches, n)


class Sketches:
    """Of the distinct nodes of some rows, as one table of words for each width."""

    def __init__(self, node: np.ndarray, column: pa.Array):
        self.nodes, row, self.of = np.unique(node, return_index=True, return_inverse=True)
        column = column.cast(pa.large_binary()).take(pa.array(row))
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64, len(row) + 1, column.offset * 8)
        self.width = np.diff(off) // 8
        self.row = np.zeros(len(row), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        words = np.frombuffer(data, np.uint8)
        for w in np.unique(self.width):
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            table = self.tables[int(w)] = np.empty((len(own), int(w)), tx.U)
            for at in range(0, len(own), 256):
                table[at : at + 256] = words[off[own[at : at + 256]][:, None] + np.arange(8 * w)].view(tx.U)

    def get(self, node: np.ndarray, width: int) -> np.ndarray:
        """Sketches of these nodes, folded to a width that none of them is below."""
        out = np.zeros((len(node), width), tx.U)
        for w, table in self.tables.items():
            own = np.flatnonzero(self.width[node] == w)
            if len(own):
                part = table[self.row[node[own]]]
                while part.shape[1] > width:
                    part = part[:, : part.shape[1] // 2] ^ part[:, part.shape[1] // 2 :]
                out[own] = part
        return out


def _near(pairs: np.ndarray, sketches: Sketches, n: np.ndarray) -> pa.RecordBatch:
    i, j = sketches.of[pairs[0]], sketches.of[pairs[1]]
    i, j = np.minimum(i, j), np.maximum(i, j)
    _, first = np.unique(i * len(sketches.nodes) + j, return_index=True)
    i, j, bound = i[first], j[first], (n[pairs[0]] + n[pairs[1]])[first]
    width = np.minimum(sketches.width[i], sketches.width[j])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for at in range(0, len(own), max(1, _WORDS // int(w))):
            k = own[at : at + max(1, _WORDS // int(w))]
            apart = np.bitwise_count(sketches.get(i[k], int(w)) ^ sketches.get(j[k], int(w))).sum(1, dtype=np.int64)
            k = k[7 * apart <= bound[k]]
            a.append(sketches.nodes[i[k]])
            b.append(sketches.nodes[j[k]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    store = Workspace(docs.sparkSession, "neardup")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = every.where("doc_id is not null")
    profile = _profile(rows, store)
    sets_once = profile.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")).select(F.col("n").alias("rn"), F.col("s1").alias("r1"), F.col("s2").alias("r2"), "rep")
    member = profile.join(sets_once, (F.col("n") == F.col("rn")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")), "left").select("doc_id", "n", "s1", "s2", "rep")
    member = store.save(member, "member")
    store.drop(profile)

    live = _blocks_once(_live(rows.select("text"), _load(rows)), store)
    rest = _unsettled(live, None, store)
    wanted = member.where("doc_id = rep").join(live.select(F.col("node").alias("r")).distinct(), F.col("s1") == F.col("r"), "left_semi").select("rep")
    drawn = _drawn(rows, wanted, store)
    found: list[DataFrame] = []
    for turn in range(ROUNDS + 1):
        pairs = store.save(_may_link(_with_leader(rest, turn, store), drawn) if turn < ROUNDS else _squares(rest, drawn, store), "pairs")
        if pairs.isEmpty():
            continue
        new = store.save(links(pairs, rows, drawn, store).distinct(), "new")
        store.drop(pairs)
        if new.isEmpty():
            continue
        found.append(new)
        if turn < ROUNDS:
            left = _unsettled(rest, components(_union(found).select("a", "b"), store), store)
            store.drop(*[rest] * hasattr(rest, "_stored_at"))
            rest = left
            if rest.isEmpty():
                break

    # from sets to documents; a doc_id of several texts links with whatever these link with
    several = member.where("n > 0").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("of"), "lo")
    edges = [member.join(several, F.col("doc_id") == F.col("of")).where("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v"))]
    if found:
        home = member.where("doc_id = rep").select("rep", "s1", "s2").distinct()
        one, two = (home.select(F.col("rep").alias(r), F.col("s1").alias(f"{r}1"), F.col("s2").alias(f"{r}2")) for r in "uv")
        met = _union(found).join(one, (F.col("a") == F.col("u1")) & (F.col("p") == F.col("u2"))).join(two, (F.col("b") == F.col("v1")) & (F.col("q") == F.col("v2")))
        edges.append(met.select("u", "v"))
    roots = components(_union(edges), store)
    store.drop(live, drawn, *found)
    out = member.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))
    return out.unionByName(_unnamed(every.where("doc_id is null")))


def _unnamed(rows: DataFrame) -> DataFrame:
    """Rows without a doc_id: the size of each one's set; nothing links with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in tx.chunks(batches):
            _, first = shingle_sets(buf, off)
            yield pa.RecordBatch.from_arrays([tx.column(batch, "doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.nulls(batch.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class, that of the least doc_id, all columns as they were; rows without a doc_id stay.

    Only rows that a filter of fixed size can't clear, those that go and a few others, are exchanged.
    """
    spark = docs.sparkSession
    store = Workspace(spark, "distinct")
    known = store.save(classes(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "classes")
    other = "other_id"  # a name that no column of the documents has
    while other in {c.lower() for c in docs.columns}:
        other += "_"
    gone = known.where("doc_id <> component_id").select(F.col("doc_id").alias(other))
    several = known.where("doc_id = component_id and rows > 1").select(F.col("doc_id").alias(other))
    shared = _buckets.members(gone.union(several))

    def part(doubtful: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = tx.column(batch, "doc_id").cast(pa.int64())
                hit = _buckets.held(shared.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit if doubtful else ~hit))

        return docs.mapInArrow(run, docs.schema)

    rest = part(True).join(gone, F.col("doc_id").cast("long") == F.col(other), "left_anti")
    out = part(False)
    if not several.isEmpty():
        twice = rest.join(several, F.col("doc_id").cast("long") == F.col(other), "left_semi").dropDuplicates(["doc_id"])
        rest = rest.join(several, F.col("doc_id").cast("long") == F.col(other), "left_anti").unionByName(twice)
    return out.unionByName(rest)
