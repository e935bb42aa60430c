"""Packing token sequences by first-fit decreasing over a tournament tree.

Documents are dealt at random (by hash) into groups of a few megabytes, and each
group is packed alone in one task, from text to pieces, so a text moves once.

A document is its token ids and an end id.  Whole sequences are cut off its
front; what is left goes, longest first, into the first open sequence that has
room, found in a tournament tree whose nodes hold the larger capacity of their
two sides.  Then sequences that have room are filled up with cuts of what lies
in the emptiest ones, and the group's last one is cut at powers of two, which
need no padding.

Defined results: null text counts as empty and is one end id; repeated rows
are packed each for itself; ids may be null.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .words import split_words, text_array

#: Texts of a group, and words whose ids a worker remembers.
GROUP_BYTES = 8 << 20
_REMEMBERED = 300_000


class WordTokens:
    """Ids of whole texts from ids of words.

    For tokenizers that drop white space and never join what it separates:
    then each distinct word is tokenized once.  A word's closing punctuation is
    taken off if a letter or digit of ASCII stands before it, and ASCII is put
    in lower case where ``lower`` says that the tokenizer does so itself.
    """

    def __init__(self, path: str, lower: bool) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            cut = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1))
            data = ids.tobytes()
            out += [data[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        return out

    def _of(self, words: pa.Array) -> list[bytes]:
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [w for w in names if w not in self.known]
        fresh = dict(zip(new, self._encode(new), strict=True))
        ids = [fresh[w] if w in fresh else self.known[w] for w in names]
        if len(self.known) < _REMEMBERED:
            self.known |= fresh
        return [ids[i] for i in coded.indices.to_pylist()]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin."""
        words, at = split_words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), at
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        plain = pc.invert(pc.match_substring(distinct, "<"))  # special tokens stay as they are
        if self.lower:
            distinct = pc.if_else(plain, pc.ascii_lower(distinct), distinct)
        stem = pc.ascii_rtrim(distinct, characters=".,;:!?")
        parts = pc.and_(plain, pc.match_substring_regex(stem, "[a-zA-Z0-9]$"))
        stem = pc.if_else(parts, stem, distinct)
        size = pc.binary_length(stem).to_numpy()
        whole = pc.binary_length(distinct).to_numpy()
        tail_at = np.flatnonzero(size < whole)
        tails = [w.encode()[n:].decode() for w, n in zip(distinct.take(pa.array(tail_at)).to_pylist(), size[tail_at], strict=True)]
        ids = self._of(stem)
        for i, tail in zip(tail_at.tolist(), self._of(pa.array(tails, pa.string())), strict=True):
            ids[i] += tail
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        index = coded.indices.to_numpy()
        n = count[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(begin[index] - upto[:-1], n) + np.arange(upto[-1])], upto[at]


class Tournament:
    """Capacities of bins; the first with room for a size is found in log2(bins) steps."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin that has it; its number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return found


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length); every id of every item is in exactly one."""
    full = [[(i, s, capacity)] for i, n in enumerate(lengths) for s in range(0, n - capacity + 1, capacity)]
    rest = sorted(((n % capacity, i) for i, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1]))
    tree = Tournament(max(1, len(rest)), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for size, i in rest:
        b = tree.place(size)
        if b == len(bins):
            bins.append([])
        bins[b].append((i, lengths[i] - size, size))
    used = [sum(x[2] for x in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-used[b], b))
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i], order[j]
        if used[to] == capacity:
            i += 1
        elif not bins[source]:
            j -= 1
        else:
            item, start, size = bins[source].pop()
            take = min(size, capacity - used[to])
            bins[to].append((item, start, take))
            if take < size:
                bins[source].append((item, start + take, size - take))
            used[to] += take
            used[source] -= take
    out = full
    for b in order[: i + 1]:
        out += [bins[b]] if used[b] == capacity else _powers(bins[b], used[b])
    return out


def _powers(pieces: list[tuple[int, int, int]], used: int) -> list[list[tuple[int, int, int]]]:
    """One sequence for each power of two in the number of ids."""
    out, left = [], list(reversed(pieces))
    for bit in reversed(range(used.bit_length())):
        if used >> bit & 1:
            need, here = 1 << bit, []
            while need:
                item, start, size = left.pop()
                take = min(size, need)
                here.append((item, start, take))
                if take < size:
                    left.append((item, start + take, size - take))
                need -= take
            out.append(here)
    return out


_TOKENS: dict[tuple[str, bool], WordTokens] = {}
_OUT = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]


def _pack_group(group: int, docs: pa.Table, _: None, *, path: str, lower: bool, capacity: int, end: int, with_ids: bool) -> pa.Table:
    if (path, lower) not in _TOKENS:
        _TOKENS[path, lower] = WordTokens(path, lower)
    tokens = _TOKENS[path, lower]
    docs = docs.sort_by([("_id", "ascending"), ("_text", "ascending")])
    flat, at = tokens.tokens(text_array(docs["_text"]))
    lengths = np.diff(at) + 1
    new: dict[str, list] = {k: [] for k, _ in _OUT}
    rows: list[int] = []
    for number, sequence in enumerate(pack(lengths.tolist(), capacity)):
        offset = 0
        for row, start, size in sequence:
            piece = flat[at[row] + start : min(at[row] + start + size, at[row + 1])]
            if len(piece) < size:
                piece = np.append(piece, np.uint32(end))
            rows.append(row)
            values = (start, size, zlib.crc32(piece.astype("<u4").tobytes()), int(lengths[row]), (group << 32) + number, offset, piece.astype(np.int32) if with_ids else None)
            for (k, _), v in zip(_OUT, values, strict=True):
                new[k].append(v)
            offset += size
    return pa.table([docs["_id"].take(pa.array(rows, pa.int64())), *[pa.array(new[k], t) for k, t in _OUT]], names=["_id", *new])


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 1, lower: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (null unless asked for).

    ``tokenizer`` is the path of a tokenizers file, readable on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    groups = B.deal(plain, "_text", GROUP_BYTES, grow=False).blocks
    given = {"path": tokenizer, "lower": lower, "capacity": capacity, "end": end, "with_ids": with_ids}
    schema = f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return B.over_blocks(B.into_blocks(plain, groups, "_id", "_text"), partial(_pack_group, **given), schema).withColumnRenamed("_id", id_col)
