"""Bloom filters of bounded size over 64-bit keys: what passes may be a key, what doesn't isn't."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import mix

#: Bits for each key, and at most; beyond, more passes that is no key.
BITS_EACH, MOST_BITS = 8, 1 << 28
_CHUNK = 1 << 16


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for i in (1, 2, 3):
        yield mix(keys + np.uint64(i)) & np.uint64(bits - 1)


def _set_bits(batches: Iterator[pa.RecordBatch], *, bits: int) -> Iterator[pa.RecordBatch]:
    out = np.zeros(bits // 8, np.uint8)
    for batch in batches:
        for at in _places(batch.column("key").to_numpy().view(np.uint64), bits):
            np.bitwise_or.at(out, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
    for i in range(0, len(out), _CHUNK):
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([out[i : i + _CHUNK].tobytes()], pa.binary())], names=["at", "bits"])


def passes(body: bytes, keys: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(body, np.uint8)
    out = np.ones(len(keys), bool)
    for at in _places(keys, len(bits) * 8):
        out &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def bloom(rows: DataFrame) -> bytes:
    """A filter of column key; one task reads the keys, and holds no more than the filter's bits."""
    bits = min(MOST_BITS, max(_CHUNK * 8, 1 << (BITS_EACH * rows.count()).bit_length()))
    table = rows.select("key").coalesce(1).mapInArrow(partial(_set_bits, bits=bits), "at long, bits binary").toArrow().sort_by("at")
    return b"".join(table["bits"].to_pylist()) or bytes(bits // 8)
