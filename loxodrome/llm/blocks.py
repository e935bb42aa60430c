"""Block exchange: corpus-wide lookups that move packed arrays, not rows.

Documents are dealt by hash into blocks of a few megabytes of text.  A block *asks*: it
sends each hash range (*bucket*) one row that holds the sorted, distinct keys
that any of its documents has.  A bucket *answers* each block in the order of
the keys asked, so an answer needs no keys.  A key that a third of all
documents hold is therefore at most one entry per block, whatever its count,
and no group of documents ever meets in one task.

Blocks depend on the rows alone, so a lost executor's tasks can be run again
anywhere and give the same asks and answers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASK = "bkt int, blk int, phase int, keys binary, vals binary"
ANSWER = "blk int, bkt int, phase int, body binary"
_ASK_ARROW = pa.schema([("bkt", pa.int32()), ("blk", pa.int32()), ("phase", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary())])
_ANSWER_ARROW = pa.schema([("blk", pa.int32()), ("bkt", pa.int32()), ("phase", pa.int32()), ("body", pa.binary())])


#: Bytes of text in a block, which one Python worker holds, and bytes whose keys share a bucket.
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20


class Deal(NamedTuple):
    """How many blocks documents go to, and how many buckets their keys."""

    blocks: int
    buckets: int


def deal(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, grow: bool = True) -> Deal:
    """Sized by the bytes of all texts; a small table still gets a block per core.

    An ask is a row per block and bucket, so beyond a gigabyte both grow with the
    square root of the table, to 16 times their size at most: at 100 TB a row
    still carries several keys, and a worker holds 64 MB of text.
    """
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    cores = df.sparkSession.sparkContext.defaultParallelism
    factor = min(16.0, max(1.0, math.sqrt(size / (1 << 30)))) if grow else 1.0
    least = min(cores, size >> 16)
    return Deal(*(max(1, math.ceil(size / (b * factor)), least) for b in (block_bytes, BUCKET_BYTES)))


def power_of_two(buckets: int, most: int) -> int:
    """The largest power of two that is neither above ``buckets`` nor ``most``: its ranges never cut what shares log2(most) high bits."""
    return 1 << (min(buckets, most).bit_length() - 1)


def into_blocks(df: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Add ``blk``, from the values of ``keys``; rows with null ids spread by the other keys."""
    return df.withColumn("blk", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(blocks)).cast("int"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection), so that high bits make even buckets."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of the sorted ``keys`` begins; one more entry ends the last."""
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def ask_rows(blk: int, phase: int, keys: np.ndarray, buckets: int, vals: Callable[[int, int], bytes] | None = None, pack: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> pa.Table:
    """Rows of ASK for sorted ``keys``; ``vals(i, j)`` packs what goes with keys i to j, ``pack`` the keys."""
    cut = bounds(keys, buckets)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return pa.table(
        [
            pa.array(some.astype(np.int32)),
            pa.array(np.full(len(some), blk, np.int32)),
            pa.array(np.full(len(some), phase, np.int32)),
            pa.array([pack(keys[cut[b] : cut[b + 1]]) for b in some], pa.binary()),
            pa.array([vals(cut[b], cut[b + 1]) if vals else b"" for b in some], pa.binary()),
        ],
        schema=_ASK_ARROW,
    )


def no_asks() -> pa.Table:
    return _ASK_ARROW.empty_table()


def no_answers() -> pa.Table:
    return _ANSWER_ARROW.empty_table()


def whole(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint64)


def asked(table: pa.Table, unpack: Callable[[bytes], np.ndarray] = whole) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of one bucket's asks, in order of block: blocks, all keys joined, and the block's place of each key."""
    table = table.sort_by("blk")
    parts = [unpack(x) for x in table["keys"].to_pylist()]
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return table["blk"].to_pylist(), keys, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def answer_rows(bkt: int, phase: int, blocks: Iterable[int], bodies: Iterable[bytes]) -> pa.Table:
    blocks, bodies = list(blocks), list(bodies)
    n = len(blocks)
    return pa.table(
        [pa.array(blocks, pa.int32()), pa.array([bkt] * n, pa.int32()), pa.array([phase] * n, pa.int32()), pa.array(bodies, pa.binary())],
        schema=_ANSWER_ARROW,
    )


def answer_bits(bkt: int, phase: int, blocks: list[int], place: np.ndarray, flags: np.ndarray) -> pa.Table:
    """One bit per key asked."""
    cut = np.searchsorted(place, np.arange(len(blocks) + 1))
    return answer_rows(bkt, phase, blocks, (np.packbits(flags[cut[i] : cut[i + 1]]).tobytes() for i in range(len(blocks))))


def read_bits(answers: pa.Table, phase: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits that answer ``ask_rows(..., keys, buckets)``, in the order of ``keys``."""
    out = np.zeros(len(keys), bool)
    cut = bounds(keys, buckets)
    for b, p, body in zip(*(answers[c].to_pylist() for c in ("bkt", "phase", "body")), strict=True):
        if p == phase:
            n = cut[b + 1] - cut[b]
            out[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool)
    return out


def read_values(answers: pa.Table, phase: int, keys: np.ndarray, buckets: int, dtype: type) -> np.ndarray:
    """As read_bits, for answers that hold one number per key."""
    out = np.zeros(len(keys), dtype)
    cut = bounds(keys, buckets)
    for b, p, body in zip(*(answers[c].to_pylist() for c in ("bkt", "phase", "body")), strict=True):
        if p == phase:
            out[cut[b] : cut[b + 1]] = np.frombuffer(body, dtype)
    return out


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.diff(np.concatenate([start, [len(sorted_keys)]]))


def elsewhere(bkt: int, table: pa.Table, *, phase: int, unpack: Callable[[bytes], np.ndarray] = whole) -> pa.Table:
    """Answer: does another block have the key too?"""
    blocks, keys, place = asked(table, unpack)
    order = np.argsort(keys, kind="stable")
    _, length = runs(keys[order])
    flags = np.zeros(len(keys), bool)
    flags[order] = np.repeat(length > 1, length)
    return answer_bits(bkt, phase, blocks, place, flags)


def ask(blocked: DataFrame, make: Callable[[int, pa.Table, pa.Table | None], pa.Table], answers: DataFrame | None = None) -> DataFrame:
    """Rows of ASK from each block's documents, and the answers so far."""
    return over_blocks(blocked, make, ASK, answers)


def over_blocks(blocked: DataFrame, make: Callable[[int, pa.Table, pa.Table | None], pa.Table], schema: str | object, answers: DataFrame | None = None) -> DataFrame:
    """Apply ``make(blk, documents, answers)`` to each block."""
    if answers is None:

        def alone(key, table):  # noqa: ANN001, ANN202
            return make(key[0].as_py(), table, None)

        return blocked.groupBy("blk").applyInArrow(alone, schema)

    def both(key, left, right):  # noqa: ANN001, ANN202
        return make(key[0].as_py(), left, right)

    return blocked.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(both, schema)


def answer(asks: DataFrame, make: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Rows of ANSWER from each bucket's asks."""

    def of(key, table):  # noqa: ANN001, ANN202
        return make(key[0].as_py(), table)

    return asks.groupBy("bkt").applyInArrow(of, ANSWER)


def _bundles(batches: Iterable[pa.RecordBatch], *, lower: str | None) -> Iterable[pa.RecordBatch]:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))
    for batch in batches:
        blk = batch.column("blk").to_numpy()
        rest = pa.table(batch).drop_columns(["blk"])
        if lower:
            rest = rest.set_column(rest.schema.get_field_index(lower), lower, pc.ascii_lower(rest[lower]))
        order = np.argsort(blk, kind="stable")
        start, length = runs(blk[order])
        for i, n in zip(start, length, strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest.schema, options=options) as out:
                out.write_table(rest.take(pa.array(order[i : i + n])))
            yield pa.RecordBatch.from_arrays([pa.array([blk[order[i]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blk", "bundle"])


def bundled(blocked: DataFrame, lower: str | None = None) -> DataFrame:
    """blk, bundle: the rows of ``into_blocks``, those of one batch and block compressed together, so that less text moves; column ``lower`` with A-Z in lower case."""
    return blocked.mapInArrow(partial(_bundles, lower=lower), "blk int, bundle binary")


def over_bundles(bundles: DataFrame, make: Callable[[int, pa.Table, pa.Table | None], pa.Table], schema: str | object, answers: DataFrame | None = None) -> DataFrame:
    """As over_blocks, of bundled rows."""

    def open_(blk: int, table: pa.Table, found: pa.Table | None) -> pa.Table:
        return make(blk, pa.concat_tables(pa.ipc.open_stream(b).read_all() for b in table["bundle"].to_pylist()), found)

    return over_blocks(bundles, open_, schema, answers)
