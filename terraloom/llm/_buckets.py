"""Which (key, a, b) rows share their key with a row of another (a, b), with one exchange of packed rows.

Rows leave a task as binary columns, one row per slot of the key space, sorted by key: 40 bits of the key beside its slot, 64 of a, as many as it takes of b. Equal rows
are sent once. A key that comes up with more than ``CROWD`` (a, b) within a flush is sent once; its rows are known to be live and pass through
beside it, dealt out evenly. So a key that holds a third of all rows costs its reducer ``CROWD`` rows per flush of a task at most. Keys that agree in slot and 40 bits count as one: what
follows tests every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text as tx

#: Rows that a task gathers before it sends them; rows of one key that it sends to the key's slot.
FLUSH, CROWD = 1 << 18, 8
_ARROW = pa.schema([("slot", pa.int32()), ("live", pa.bool_()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("many", pa.binary())])
SCHEMA = "slot int, live boolean, keys binary, a binary, b binary, many binary"
Emit = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
_LOW = tx.U((1 << 40) - 1)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, with the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def short(x: np.ndarray) -> bytes:
    """Unsigned numbers in 1, 2, 4 or 8 bytes each, as the greatest asks."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def long(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def low40(x: np.ndarray) -> bytes:
    """The lowest 40 bits of each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_low40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _packed(slot: int, live: bool, keys: np.ndarray, a: np.ndarray, b: np.ndarray, many: np.ndarray) -> dict:
    """keys: with the slot in a live row, without it in others."""
    return {"slot": slot, "live": live, "keys": keys.astype("<u8").tobytes() if live else low40(keys), "a": a.astype("<i8").tobytes(), "b": short(b), "many": np.packbits(many).tobytes()}


def _send(held: list[tuple[np.ndarray, ...]], slots: int, turn: int) -> Iterator[pa.RecordBatch]:
    keys, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    # the highest 24 bits choose the slot, the lowest 40 tell keys apart in it
    keys = (((keys >> tx.U(40)) * tx.U(slots) >> tx.U(24)) << tx.U(40)) | (keys & _LOW)
    order = np.lexsort((b, a, keys))
    keys, a, b = keys[order], a[order], b[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    keys, a, b = keys[new], a[new], b[new]
    at = runs(keys)
    n = np.diff(at)
    many = np.repeat(n > CROWD, n)
    rows = []
    if many.any():
        k, x, y = keys[many], a[many], b[many]
        for p in range(0, len(k), 1 << 16):
            rows.append(_packed((turn * 7919 + p) % slots, True, k[p : p + (1 << 16)], x[p : p + (1 << 16)], y[p : p + (1 << 16)], np.zeros(0, bool)))
    one = ~many
    one[at[:-1]] = True
    keys, a, b, many = keys[one], a[one], b[one], many[one]
    edge = np.searchsorted(keys >> tx.U(40), np.arange(slots + 1).astype(tx.U))
    rows += [_packed(s, False, keys[p:q], a[p:q], b[p:q], many[p:q]) for s, (p, q) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if p < q]
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_pylist(rows[k : k + 64], _ARROW)


LIVE = "key long, a long, b long, k long, x long, y long"


def _batch(keys: np.ndarray, a: np.ndarray, b: np.ndarray, k: np.ndarray | None = None, x: np.ndarray | None = None, y: np.ndarray | None = None, first: np.ndarray | None = None) -> pa.RecordBatch:
    if k is None:
        k, x, y, first = np.zeros(len(keys), np.int64), np.zeros(len(keys), tx.U), np.zeros(len(keys), tx.U), np.zeros(len(keys), bool)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(b), pa.array(k), pa.array(x.view(np.int64), mask=~first), pa.array(y.view(np.int64), mask=~first)], ["key", "a", "b", "k", "x", "y"])


def _meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    sent = [r for r in rows if not r["live"]]
    if sent:
        sizes = [len(r["a"]) // 8 for r in sent]
        keys = from_low40(b"".join(r["keys"] for r in sent)) | tx.U(sent[0]["slot"] << 40)
        a = np.frombuffer(b"".join(r["a"] for r in sent), "<i8")
        b = np.concatenate([long(r["b"], k) for r, k in zip(sent, sizes, strict=True)])
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8), count=k) for r, k in zip(sent, sizes, strict=True)]).astype(bool)
        order = np.lexsort((many, b, a, keys))
        keys, a, b, many = keys[order], a[order], b[order], many[order]
        at = runs(keys)
        n = np.diff(at)
        # several (a, b), or one that another flush has met with others
        crowded = np.bitwise_or.reduceat(many, at[:-1])
        differ = (a[at[:-1]] != a[at[1:] - 1]) | (b[at[:-1]] != b[at[1:] - 1])
        new = np.append(True, (keys[1:] != keys[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        out = np.repeat(differ | (crowded & (n > 1)), n) & ~many & new
        if out.any():
            crowded = np.repeat(crowded, n)[out]
            keys, a, b = keys[out], a[out], b[out]
            at = runs(keys)
            n = np.diff(at)
            mixed = tx.splitmix(a.view(tx.U))
            x, y = np.bitwise_xor.reduceat(mixed, at[:-1]), np.add.reduceat(tx.splitmix(mixed + tx.U(0xA0761D6478BD642F)), at[:-1])
            first = np.zeros(len(keys), bool)
            first[at[:-1]] = True
            yield _batch(keys, a, b, np.where(crowded, 0, np.repeat(n, n)), np.repeat(x, n), np.repeat(y, n), first & ~crowded)
    for r in rows:
        if r["live"]:
            yield _batch(np.frombuffer(r["keys"], tx.U), np.frombuffer(r["a"], "<i8"), long(r["b"], len(r["a"]) // 8))


def live(docs: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Emit]) -> DataFrame:
    """key, a, b (long) of the emitted rows whose key is emitted with another (a, b) as well.

    Rows of a crowded key have k = 0 and may come several times. Of others, k is how many there are, and the first row of a key has x and y, 128 bits of a hash of all its a.
    """
    slots = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for part in emit(batches):
            held.append(part)
            size += len(part[0])
            if size >= FLUSH:
                yield from _send(held, slots, turn)
                held, size, turn = [], 0, turn + 1
        if size:
            yield from _send(held, slots, turn)
        del held
        tx.trim()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["slot"] != slot and rows:
                    yield from _meet(rows)
                    rows = []
                slot = r["slot"]
                rows.append(r)
        if rows:
            yield from _meet(rows)
        del rows
        tx.trim()

    packed = docs.mapInArrow(run, SCHEMA)
    return packed.repartition("slot").sortWithinPartitions("slot").mapInArrow(meet, LIVE)


def combined(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, join: Callable = np.add, total: str = "u1", finish: Callable = lambda x: x, slots: int = 64) -> np.ndarray:
    """The arrays of ``size`` bytes that tasks make, joined element by element as ``total`` on the executors, a part in each slot, and finished there as bytes.

    ``size`` is fixed, whatever the input; tasks send their arrays compressed.
    """
    width = size // slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in make(batches):
            for s in range(slots):
                yield pa.RecordBatch.from_pydict({"slot": pa.array([s], pa.int32()), "data": pa.array([pa.compress(made[s * width : (s + 1) * width].tobytes(), "zstd", asbytes=True)], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, None
        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(pa.decompress(data.as_buffer(), width, "zstd"), np.uint8).astype(total)
                if s != slot and held is not None:
                    yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "data": pa.array([finish(held).astype("u1").tobytes()], pa.binary())})
                held = part if s != slot else join(held, part)
                slot = s
        if held is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "data": pa.array([finish(held).astype("u1").tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    dealt = docs.mapInArrow(run, "slot int, data binary").repartition("slot").sortWithinPartitions("slot")
    for r in dealt.mapInArrow(merge, "slot int, data binary").collect():
        out[r.slot * width : (r.slot + 1) * width] = np.frombuffer(r.data, np.uint8)
    return out


#: Bits of a table that tells which 64-bit ids are meant.
FILTER_BITS = 1 << 23


#: Bits by which an id is told.
_MARKS = 4


def _places(ids: np.ndarray) -> Iterator[np.ndarray]:
    mixed = tx.splitmix(ids.view(tx.U))
    for k in range(_MARKS):
        yield ((mixed >> tx.U(10 * k)) % tx.U(FILTER_BITS)).astype(np.int64)


def members(ids: DataFrame):
    """A broadcast table of fixed size that holds the ids of the one column, and passes a few others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield bits

    return ids.sparkSession.sparkContext.broadcast(combined(ids, mark, FILTER_BITS // 8, np.bitwise_or))


def held(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _places(ids):
        out &= ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def kept(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose 64-bit ``column`` is among the ids, and a few others; without an exchange of rows."""
    shared, place = members(ids), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held(shared.value, batch.column(place).to_numpy())))

    return rows.mapInArrow(run, rows.schema)
