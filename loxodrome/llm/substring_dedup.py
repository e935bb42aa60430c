"""Substring dedup by seed and extend on winnowed anchors.

A window of ``window`` words has ``window - seed + 1`` seeds (runs of ``seed``
words); the seed with the least hash, the leftmost of equals, is its anchor.
Equal windows have equal anchors at the same offset, so joining documents on
anchors misses no repeat (winnowing).

1. Seed: each block asks which of its anchors another block has too.
2. Extend: around a shared anchor every window that it anchors is compared,
   which extends the match both ways as far as the threshold needs; asked is
   whether a document with a smaller id has the window.  Adjacent matched
   windows join to maximal repeats.
3. Each block covers the words of the matched windows.

Windows are compared by 64-bit hashes on top of equal anchor hashes.  No pairs
of documents are made: a passage in a third of all documents is one entry per
block (see ``blocks``).

Defined results: null text counts as no words and is kept as null; a null id
is greater than any other and rows with the same id never remove each other's
words; repeated rows are handled each on its own and get the same result;
texts of fewer than ``window`` words lose nothing; other columns pass through;
an empty table gives an empty one; ids are whole numbers (others are refused).  A
text of any length is handled whole, by one task.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks as B
from .words import sliding_min, split_words, text_array, word_hashes

_LAST = np.iinfo(np.int64).max
OUT = ("n_words", "n_removed", "kept_text", "spans")


def _ids(docs: pa.Table) -> np.ndarray:
    return docs["_id"].combine_chunks().cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


class _Windows:
    """Windows of a block's documents, in ascending order of id."""

    def __init__(self, docs: pa.Table, window: int, seed: int) -> None:
        docs = docs.append_column("_rank", pa.array(_ids(docs))).sort_by("_rank")
        self.docs, self.ids = docs, docs["_rank"].combine_chunks().to_numpy()
        self.words, self.at = split_words(text_array(docs["_text"]))
        x = word_hashes(self.words)
        n = len(x)
        width = window - seed + 1
        end = np.repeat(self.at[1:], np.diff(self.at))  # of the document that has the word
        self.start = np.flatnonzero(np.arange(n) + window <= end)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.at))[self.start]
        if not len(self.start):
            self.hash = self.anchor = np.zeros(0, np.uint64)
            return
        self.anchor = sliding_min(B.mix(_folded(x, seed)), width)[self.start]
        self.hash = B.mix(_folded(x, window))[self.start]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.anchor, return_inverse=True)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct window hashes, the place of each window's among them, the least id that has each."""
        order = np.argsort(self.hash, kind="stable")  # ids ascend, so a run's first has its least
        first, length = B.runs(self.hash[order])
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), length)
        return self.hash[order[first]], place, self.ids[self.doc[order[first]]] if len(order) else np.zeros(0, np.int64)


def _folded(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in their order."""
    out = np.full(len(x) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ x[i : len(x) - n + 1 + i]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return out


def _seed(blk: int, docs: pa.Table, _: None, *, window: int, seed: int, buckets: int) -> pa.Table:
    return B.ask_rows(blk, 1, _Windows(docs, window, seed).anchors()[0], buckets)


def _extended(w: _Windows, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of the windows at shared anchors with least ids; place and least id of every window."""
    anchors, of = w.anchors()
    shared = B.read_bits(answers, 1, anchors, buckets)[of] if len(anchors) else np.zeros(0, bool)
    keys, place, least = w.least()
    asked = np.zeros(len(keys), bool)
    asked[place[shared]] = True
    return keys, place, least, asked


def _packed_ids(ids: np.ndarray, i: int, j: int) -> bytes:
    """Ids as a table of the distinct ones and their places in it."""
    table, place = np.unique(ids[i:j], return_inverse=True)
    kind = np.uint16 if len(table) <= 1 << 16 else np.uint32
    return np.int64(len(table)).tobytes() + table.tobytes() + place.astype(kind).tobytes()


def _unpacked_ids(body: bytes) -> np.ndarray:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    return np.frombuffer(body, np.int64, n, 8)[np.frombuffer(body, np.uint16 if n <= 1 << 16 else np.uint32, -1, 8 + 8 * n)]


def _extend(blk: int, docs: pa.Table, answers: pa.Table, *, window: int, seed: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return B.no_asks()
    keys, _, least, asked = _extended(_Windows(docs, window, seed), answers, buckets)
    ids = least[asked]
    return B.ask_rows(blk, 2, keys[asked], buckets, lambda i, j: _packed_ids(ids, i, j))


def _earlier(bkt: int, table: pa.Table) -> pa.Table:
    """Answer: does another block have the window under a smaller id?"""
    table = table.sort_by("blk")
    blks, keys, place = B.asked(table)
    least = np.concatenate([_unpacked_ids(x) for x in table["vals"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    start, length = B.runs(keys[order])
    flags = np.zeros(len(keys), bool)
    flags[order] = np.repeat(np.minimum.reduceat(least[order], start), length) < least[order]
    return B.answer_bits(bkt, 2, blks, place, flags)


def _cover(blk: int, docs: pa.Table, answers: pa.Table, *, window: int, seed: int, buckets: int, out: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return out.empty_table()
    w = _Windows(docs, window, seed)
    keys, place, least, asked = _extended(w, answers, buckets)
    earlier = np.zeros(len(keys), bool)
    earlier[asked] = B.read_bits(answers, 2, keys[asked], buckets)
    hit = w.start[earlier[place] | (least[place] < w.ids[w.doc])]
    change = np.zeros(len(w.words) + 1, np.int64)
    change[hit] += 1
    change[hit + window] -= 1
    gone = np.cumsum(change[:-1]) > 0
    lost = np.concatenate([[0], np.cumsum(gone)])
    n_removed = lost[w.at[1:]] - lost[w.at[:-1]]
    kept = pa.ListArray.from_arrays(pa.array(w.at - lost[w.at], pa.int32()), w.words.filter(pa.array(~gone)))
    null = w.docs["_text"].combine_chunks().is_null()
    texts = pc.if_else(null, pa.scalar(None, pa.string()), pc.binary_join(kept, " "))
    edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
    spans: list[list[dict]] = [[] for _ in range(len(null))]
    for i in np.flatnonzero(n_removed):
        lo, hi = w.at[i], w.at[i + 1]
        inner = edge[np.searchsorted(edge, lo, "right") : np.searchsorted(edge, hi, "left")]
        marks = [lo, *inner, hi]
        spans[i] = [{"start": int(a - lo), "end": int(b - lo)} for a, b in zip(marks[:-1], marks[1:], strict=True) if gone[a]]
    new = {"n_words": np.diff(w.at), "n_removed": n_removed, "kept_text": texts, "spans": spans}
    return pa.table([new[f.name] if f.name == "kept_text" else pa.array(new[f.name], f.type) if f.name in new else w.docs[f.name].combine_chunks().cast(f.type) for f in out], schema=out)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, seed: int = 5) -> DataFrame:
    """Remove each word in a window of ``window`` words that a document with a smaller id has too.

    Returns the columns of ``docs`` but the text (those that bear the names
    below are replaced), and n_words, n_removed (long), kept_text (remaining
    words joined by one space), spans (removed runs as [start, end) in words).
    """
    if not 1 <= seed <= window:
        raise ValueError("seed must be between 1 and window")
    others = [c for c in docs.columns if c not in (id_col, text_col, *OUT)]
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError("ids must be whole numbers")
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    blocks, buckets = B.deal(plain, "_text")
    blocked = B.into_blocks(plain, blocks, "_id", "_text")
    given = {"window": window, "seed": seed, "buckets": buckets}
    one = B.answer(B.ask(blocked, partial(_seed, **given)), partial(B.elsewhere, phase=1))
    two = B.answer(B.ask(blocked, partial(_extend, **given), one), _earlier)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(span))]
    schema = T.StructType([f for f in plain.schema if f.name != "_text"] + new)
    found = B.over_blocks(blocked, partial(_cover, **given, out=to_arrow_schema(schema)), schema, one.unionByName(two))
    return found.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)], *OUT)
