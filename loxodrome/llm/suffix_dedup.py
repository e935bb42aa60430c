"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, most significant digit
first, and leave the sort as soon as their group has one member; groups that
stay equal through the last digit are exactly the repeated windows.

The suffixes sorted are those that start at a *token*: at the white space
before a word, at a character of three bytes or more, and at every byte that
none of these follows within half the length.  A window belongs to the first of
them inside it, so equal windows belong to tokens at the same offset, and the
suffix of that token is a known part of the window.  The passes:

1. First digit: from the token on, what all of its windows have in common (over
   half the length).  Most suffixes leave here.
2. Second digit: the token's *run*, all bytes of all its windows.  Where the run
   is found twice, every window of it is, and needs no further digit.
3. Among groups of equal first digit, those that hold a run found once are
   picked out; all other groups are finished.
4. Last digit: each whole window of these groups.

A digit is ordered by a 64-bit hash of its bytes.  Blocks send each distinct
suffix that is still tied once (see ``blocks``); passes 1 and 3 only decide who
stays in the sort, so they send 32 bits beside the bucket's, and one that stays
by chance leaves in the next pass.  A passage in every document is one entry a
block in every pass, in whatever context it stands.

Defined results: null text counts as no bytes and is kept as null; texts
shorter than ``length`` lose nothing; repeated rows are repeats of each other,
whatever their ids; ids may be null and of any type; other columns pass through;
an empty table gives an empty one.  A text of any length is worked on whole, by
one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks as B
from .words import text_array

OUT = ("n_bytes", "n_removed", "n_spans", "kept", "spans")
_BASE = 0xD1342543DE82EF95
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL = B.mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: Bytes that are worked on at once; a longer document is worked on alone.
_STRETCH = 1 << 20


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, _STRETCH + 1)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x, dtype=np.uint64))
        return cls.up, cls.down


def _starts_token(data: np.ndarray) -> np.ndarray:
    """Bytes at which a token starts, by this byte and the next alone."""
    space = _SPACE[data]
    out = data >= 0xE0
    out[:-1] |= space[:-1] & ~space[1:]
    return out


class _Stretch:
    """Windows of neighbouring documents, grouped into runs that belong to one token."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int, length: int) -> None:
        self.at, self.first, self.length = at, first, length
        n, half = len(data), length // 2
        up, self.down = _Powers.get(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_SYMBOL[data] * up[:n], out=self.prefix[1:])
        room = at[1:] - at[:-1] - length + 1
        some = np.flatnonzero(room > 0)
        if not len(some):
            self.low = self.high = np.zeros(0, np.int64)
            self.digit = np.zeros(0, np.uint64)
            return
        start = np.repeat(at[some] - np.concatenate([[0], np.cumsum(room[some])[:-1]]), room[some]) + np.arange(room[some].sum())
        marks = _starts_token(data)
        places = np.append(np.flatnonzero(marks), n + length)
        token = places[(np.cumsum(marks) - marks)[start]]
        token = np.where(token - start < half, token, start)
        new = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        self.low, self.high = start[new], start[np.concatenate([new[1:], [len(token)]]) - 1]
        self.digit = self.hashes(token[new], token[new] + length - half + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return B.mix((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))

    def run_hashes(self) -> np.ndarray:
        return self.hashes(self.low, self.high + self.length)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of these runs, and their hashes."""
        n = self.high[runs] - self.low[runs] + 1
        start = np.repeat(self.low[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(runs) else np.zeros(0, np.int64)
        return start, self.hashes(start, start + self.length)


def _stretches(texts: pa.Array, length: int) -> Iterator[_Stretch]:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STRETCH, "right")) - 1)
        yield _Stretch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, length)
        i = j


class _Block:
    """One block's passes so far."""

    def __init__(self, docs: pa.Table, length: int, buckets: int) -> None:
        self.buckets, self.length = buckets, length
        self.texts = text_array(docs["_text"])
        self.parts = list(_stretches(self.texts, length))
        self.part = np.repeat(np.arange(len(self.parts)), [len(s.low) for s in self.parts])
        self.keys, self.of, places = np.unique(np.concatenate([s.digit for s in self.parts] or [np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        self.twice = places > 1

    def second(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tied runs; their distinct second digits, the first run of each, each run's place among them, how often each occurs."""
        tied = np.flatnonzero((self.twice | B.read_bits(answers, 1, self.keys, self.buckets))[self.of])
        digits = np.concatenate([s.run_hashes() for s in self.parts] or [np.zeros(0, np.uint64)])[tied]
        return tied, *np.unique(digits, return_index=True, return_inverse=True, return_counts=True)

    def third(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs found twice; runs found once; runs found twice of which this block is the first to have one, each once."""
        tied, keys, first, place, _ = self.second(answers)
        twice, mine = _two_bits(answers, keys, self.buckets)
        return tied[twice[place]], tied[~twice[place]], tied[first[twice & mine]]

    def last(self, answers: pa.Table) -> tuple[np.ndarray, tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """Runs found twice; windows of the runs found once and of those brought to meet them; their keys and counts."""
        sure, once, mine = self.third(answers)
        keys, of = _digits_of(self, once, mine)
        windows = self.windows(np.concatenate([once, mine[B.read_bits(answers, 3, keys, self.buckets)[of]]]))
        return sure, windows, *np.unique(windows[2], return_inverse=True, return_counts=True)

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of these runs: part, start, hash."""
        first = np.searchsorted(self.part, np.arange(len(self.parts)))
        out = [(i, *self.parts[i].windows(mine - first[i])) for i, mine in ((i, runs[self.part[runs] == i]) for i in np.unique(self.part[runs]))]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.repeat([i for i, _, _ in out], [len(s) for _, s, _ in out]), np.concatenate([s for _, s, _ in out]), np.concatenate([h for _, _, h in out])


def _digits_of(block: _Block, once: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct first digits of these runs, and the place among them of each of ``mine``."""
    keys = np.unique(block.keys[block.of[np.concatenate([once, mine])]])
    return keys, np.searchsorted(keys, block.keys[block.of[mine]])


def _short(keys: np.ndarray) -> bytes:
    return keys.astype(np.uint32).tobytes()


def _long(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint32)


def _first_pass(blk: int, docs: pa.Table, _: None, *, length: int, buckets: int) -> pa.Table:
    return B.ask_rows(blk, 1, _Block(docs, length, buckets).keys, buckets, pack=_short)


def _second_pass(blk: int, docs: pa.Table, answers: pa.Table, *, length: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return B.no_asks()
    _, keys, _, _, count = _Block(docs, length, buckets).second(answers)
    return B.ask_rows(blk, 2, keys, buckets, lambda i, j: np.packbits(count[i:j] > 1).tobytes())


def _flags(table: pa.Table, place: np.ndarray, blocks: int) -> np.ndarray:
    """The bit sent with each key, in order of block."""
    sizes = np.bincount(place, minlength=blocks)
    parts = [np.unpackbits(np.frombuffer(v, np.uint8), count=n) for v, n in zip(table.sort_by("blk")["vals"].to_pylist(), sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _second_answer(bkt: int, table: pa.Table) -> pa.Table:
    """Two bits a run: is it found twice?  Is this the first block that has it?"""
    blks, keys, place = B.asked(table)
    local = _flags(table, place, len(blks))
    order = np.argsort(keys, kind="stable")
    start, length = B.runs(keys[order])
    flags = np.zeros((2, len(keys)), bool)
    flags[0, order] = np.repeat((length > 1) | np.logical_or.reduceat(local[order], start), length)
    flags[1, order[start]] = True
    cut = np.searchsorted(place, np.arange(len(blks) + 1))
    return B.answer_rows(bkt, 2, blks, (np.packbits(flags[:, cut[i] : cut[i + 1]].ravel()).tobytes() for i in range(len(blks))))


def _two_bits(answers: pa.Table, keys: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros((2, len(keys)), bool)
    cut = B.bounds(keys, buckets)
    for b, p, body in zip(*(answers[c].to_pylist() for c in ("bkt", "phase", "body")), strict=True):
        if p == 2:
            n = cut[b + 1] - cut[b]
            out[:, cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=2 * n).reshape(2, n)
    return out


def _third_pass(blk: int, docs: pa.Table, answers: pa.Table, *, length: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return B.no_asks()
    block = _Block(docs, length, buckets)
    _, once, mine = block.third(answers)
    keys, _ = _digits_of(block, once, mine)
    open_ = np.isin(keys, block.keys[block.of[once]])
    return B.ask_rows(blk, 3, keys, buckets, lambda i, j: np.packbits(open_[i:j]).tobytes(), _short)


def _third_answer(bkt: int, table: pa.Table) -> pa.Table:
    """One bit a group: does any block have a run of it that is found once?"""
    blks, keys, place = B.asked(table, _long)
    return B.answer_bits(bkt, 3, blks, place, np.isin(keys, keys[_flags(table, place, len(blks))]))


def _last_pass(blk: int, docs: pa.Table, answers: pa.Table, *, length: int, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return B.no_asks()
    return B.ask_rows(blk, 4, _Block(docs, length, buckets).last(answers)[2], buckets)


def _cover(blk: int, docs: pa.Table, answers: pa.Table, *, length: int, buckets: int, out: pa.Schema) -> pa.Table:
    if not docs.num_rows:
        return out.empty_table()
    block = _Block(docs, length, buckets)
    sure, (part, start, _), keys, of, count = block.last(answers)
    hit = ((count > 1) | B.read_bits(answers, 4, keys, buckets))[of]
    first = np.searchsorted(block.part, np.arange(len(block.parts)))
    new: dict[str, list] = {k: [] for k in OUT}
    null = docs["_text"].combine_chunks().is_null().to_pylist()
    raw = [x.encode() for x in block.texts.to_pylist()]
    for i, s in enumerate(block.parts):
        change = np.zeros(s.at[-1] + 1, np.int32)
        mine = sure[block.part[sure] == i] - first[i]
        np.add.at(change, s.low[mine], 1)
        np.add.at(change, s.high[mine] + length, -1)
        mine = start[hit & (part == i)]
        np.add.at(change, mine, 1)
        np.add.at(change, mine + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        for d in range(len(s.at) - 1):
            lo, hi = s.at[d], s.at[d + 1]
            text = raw[s.first + d]
            marks = [lo, *edge[np.searchsorted(edge, lo, "right") : np.searchsorted(edge, hi, "left")], hi]
            spans = [(int(a - lo), int(b - lo)) for a, b in zip(marks[:-1], marks[1:], strict=True) if a < b and gone[a]]
            kept = b"".join(text[int(a - lo) : int(b - lo)] for a, b in zip(marks[:-1], marks[1:], strict=True) if a < b and not gone[a]) if spans else text
            for k, v in zip(OUT, (len(text), len(text) - len(kept), len(spans), None if null[s.first + d] else kept, [{"start": a, "end": b} for a, b in spans]), strict=True):
                new[k].append(v)
    return pa.table([pa.array(new[f.name], f.type) if f.name in new else docs[f.name].combine_chunks().cast(f.type) for f in out], schema=out)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts anywhere else.

    Returns the columns of ``docs`` but the text (those that bear the names
    below are replaced), and n_bytes, n_removed, n_spans (long; maximal removed
    runs), kept (binary: what is left may not be whole UTF-8 characters), spans
    ([start, end) in bytes).
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    others = [c for c in docs.columns if c not in (id_col, text_col, *OUT)]
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(others)])
    blocks, buckets = B.deal(plain, "_text")
    blocked = B.into_blocks(plain, blocks, "_id", "_text")
    given = {"length": length, "buckets": buckets}
    one = B.answer(B.ask(blocked, partial(_first_pass, **given)), partial(B.elsewhere, phase=1, unpack=_long))
    two = one.unionByName(B.answer(B.ask(blocked, partial(_second_pass, **given), one), _second_answer))
    three = two.unionByName(B.answer(B.ask(blocked, partial(_third_pass, **given), two), _third_answer))
    four = three.unionByName(B.answer(B.ask(blocked, partial(_last_pass, **given), three), partial(B.elsewhere, phase=4)))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    new = [T.StructField(k, T.LongType()) for k in OUT[:3]] + [T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(span))]
    schema = T.StructType([f for f in plain.schema if f.name != "_text"] + new)
    found = B.over_blocks(blocked, partial(_cover, **given, out=to_arrow_schema(schema)), schema, four)
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(others)], *OUT)
