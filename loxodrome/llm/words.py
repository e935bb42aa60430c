"""Words of many texts at once, as Arrow and numpy arrays."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: glibc's M_MMAP_THRESHOLD and M_TRIM_THRESHOLD: by themselves they grow to 32 MB and more.
_MMAP, _TRIM = -3, -1


def give_back() -> None:
    """Large arrays go back to the system as they are freed, so a worker that waits for its next task holds little of an executor's memory."""
    if sys.platform == "linux":
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # another C library
            libc = ctypes.CDLL(None)
            libc.mallopt(_MMAP, 1 << 20)
            libc.mallopt(_TRIM, 1 << 20)


give_back()


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array of strings; null texts become empty ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(column.cast(pa.string()), "")


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows to about ``size`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` in order, and where each text's begin (one more entry ends the last)."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    seen = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), seen[at]


def coded_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """As split_words, the words as codes of distinct ones."""
    words, at = split_words(texts)
    return words.dictionary_encode(), at


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """A 64-bit xxHash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit xxHash of each word; each distinct word is hashed once."""
    coded = words.dictionary_encode()
    return hashes_of(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out
