"""Language-model scores by prediction by partial matching (PPM).

The trie holds, for every context of up to five bytes in the training texts,
how often each byte or the end followed.  A symbol is coded in the longest
context that was seen; one that never followed it there costs an escape, and is
then looked for in the context shortened by its oldest byte, leaving out all
symbols of the longer one (exclusion).  Escapes are of method D: of a context's
symbols left, each counts twice its count less one, and the escape once for
each distinct symbol.  Below the empty context all symbols left are equally
likely.  The chances of all symbols sum to one after any context.

The trie is sharded by a context's last two bytes; where these hold more than
twice a shard's even part of all symbols, by its last three, and so on up to
five, so no frequent pair of bytes fills a shard.  Contexts shorter than their
shard's are counted beforehand and go to every task: at most 4,096 of each length
(``LEAST_SHARE``), of at most 256 counts each, and the 65,536 counts of contexts
of one byte.  Each block sends
its distinct 6-grams with their counts in training texts, and gets the logarithm
of each one's chance back (see ``blocks``); words are counted in the same way
for the base score.

Defined results: null text is scored as an empty one; a null id is not held
out; ids may be of any type; repeated rows stay rows and are learnt from as often
as they stand; without training texts every symbol has the same chance; an
empty table gives an empty one.  A text of any length is scored whole, by one
task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .ngrams import BYTE_END, BYTE_START, LOWER, find, grams, merged, stretches, symbols
from .words import split_words, text_array, word_hashes

ORDER = 6
BLOCK_BYTES = 8 << 20
#: The least share of all symbols at which a context is split by one byte more.
LEAST_SHARE = 1 / 4096
_ALPHABET = 255  # all bytes, and the end for one of the two that UTF-8 never uses
_END_WORD = B.mix(np.array([1], np.uint64))[0]


def _u(x: int) -> np.uint64:
    return np.uint64(x)


class Nodes(NamedTuple):
    """Contexts too frequent for one shard, by length from 2, and counts in training texts of all that are shorter than their shard's."""

    hot: dict[int, np.ndarray]
    pairs: np.ndarray
    counts: dict[int, tuple[np.ndarray, np.ndarray]]

    def is_hot(self, contexts: np.ndarray, length: int) -> np.ndarray:
        return find(self.hot[length], contexts) >= 0 if length in self.hot else np.zeros(len(contexts), bool)


def _newest_first(six: np.ndarray) -> np.ndarray:
    """Of oldest-first 6-grams: the context's bytes from the last on, then the symbol; 48 bits."""
    out = six & _u(255)
    for i in range(1, 6):
        out |= ((six >> _u(8 * i)) & _u(255)) << _u(48 - 8 * i)
    return out


def _keys(six: np.ndarray, nodes: Nodes) -> np.ndarray:
    """16 bits that tell the shard, and the 6-gram."""
    x = _newest_first(six)
    node = x >> _u(32)
    deeper = nodes.is_hot(node, 2)
    for length in (3, 4, 5):
        if not deeper.any():
            break
        node[deeper] = x[deeper] >> _u(48 - 8 * length) | _u(length << 56)
        deeper = deeper & nodes.is_hot(node & _u((1 << 56) - 1), length)
    return B.mix(node) >> _u(48) << _u(48) | x


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


class Trie:
    """Counts of one shard, by context length 5 to 2, and of all contexts that are shorter than their shard's."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, nodes: Nodes) -> None:
        """``keys``: 48 bits, sorted."""
        self.pairs = nodes.pairs
        self.single = self.pairs.sum(axis=0)
        self.pair = {5: (keys, counts)}
        for o in (4, 3, 2):
            k, c = self.pair[o + 1]
            mine = ~nodes.is_hot(k >> _u(16), o)
            given = nodes.counts.get(o, (k[:0], c[:0]))
            self.pair[o] = merged([(k[mine] >> _u(16)) << _u(8) | k[mine] & _u(255), given[0]], [c[mine], given[1]])
        self.context, self.total, self.kinds, self.above = {}, {}, {}, {}
        for o in (5, 4, 3, 2):
            k, c = self.pair[o]
            self.context[o], of = np.unique(k >> _u(8), return_inverse=True)
            size = len(self.context[o])
            self.total[o], self.kinds[o] = np.bincount(of, c, size), np.bincount(of, minlength=size).astype(float)
            if o > 2:
                shorter = self.pair[o - 1]
                mass = shorter[1][find(shorter[0], (k >> _u(16)) << _u(8) | k & _u(255))]
            else:
                mass = self.pairs[(k >> _u(16)).astype(np.int64), (k & _u(255)).astype(np.int64)]
            self.above[o] = np.bincount(of, mass, size)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Of the chance of each 6-gram's symbol."""
        symbol = (keys & _u(255)).astype(np.int64)
        n = len(keys)
        out, done = np.ones(n), np.zeros(n, bool)
        less, fewer = np.zeros(n), np.zeros(n)

        def at(present: np.ndarray, count: np.ndarray, total: np.ndarray, kinds: np.ndarray, above: np.ndarray) -> None:
            room, new = 2 * (total - less), kinds - fewer
            here = present & ~done
            hit = here & (count > 0)
            out[hit] *= (2 * count[hit] - 1) / room[hit]
            miss = here & (count == 0) & (room > 0)
            out[miss] *= new[miss] / room[miss]
            done[hit] = True
            less[here], fewer[here] = above[here], kinds[here]

        for o in (5, 4, 3, 2):
            context = keys >> _u(8 * (6 - o))
            place = find(self.context[o], context)
            found = find(self.pair[o][0], context << _u(8) | keys & _u(255))
            if len(self.context[o]):
                at(place >= 0, np.where(found < 0, 0, self.pair[o][1][found]), self.total[o][place], self.kinds[o][place], self.above[o][place])
        last = (keys >> _u(40)).astype(np.int64)
        kinds = (self.pairs > 0).sum(axis=1).astype(float)
        above = (self.pairs > 0) @ self.single
        at(kinds[last] > 0, self.pairs[last, symbol], self.pairs.sum(axis=1)[last].astype(float), kinds[last], above[last].astype(float))
        seen = float((self.single > 0).sum())
        at(np.full(n, seen > 0), self.single[symbol], np.full(n, float(self.single.sum())), np.full(n, seen), np.zeros(n))
        out[~done] /= max(1.0, _ALPHABET - seen)
        return np.log10(out)


def _six(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, at in stretches(texts):
        yield first, *grams(*symbols(data, at, LOWER, BYTE_START, BYTE_END, ORDER), ORDER, 8)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each two neighbouring symbols, in all texts and in training texts."""
    for batch in batches:
        learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        n, learnt = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for first, data, at in stretches(text_array(batch.column("_text"))):
            x, wide = symbols(data, at, LOWER, BYTE_START, BYTE_END, 2)
            two = x[:-1].astype(np.uint16) << 8 | x[1:]
            inside = np.ones(len(two), bool)
            inside[wide[1:-1] - 1] = False
            known = inside & np.repeat(learn[first : first + len(at) - 1], np.diff(wide))[1:]
            n += np.bincount(two[inside], minlength=1 << 16)
            learnt += np.bincount(two[known], minlength=1 << 16)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), np.int32)), *[pa.array(c) for c in (some, n[some], learnt[some])]], names=["kind", "key", "n", "learnt"])


def _count_contexts(batches: Iterator[pa.RecordBatch], *, length: int, hot: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """What follows the hot contexts of a length (kind 0) and what stands before them (1): in all texts, and in training texts."""
    pair = np.zeros(1 << 16, bool)
    pair[hot[2].astype(np.int64)] = True
    for batch in batches:
        learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for first, six, at in _six(text_array(batch.column("_text"))):
            mine = np.flatnonzero(pair[((six >> _u(8)) & _u(255)) << _u(8) | (six >> _u(16)) & _u(255)])
            x = _newest_first(six[mine])
            for longer in range(3, length + 1):
                some = find(hot[longer], x >> _u(48 - 8 * longer)) >= 0
                mine, x = mine[some], x[some]
            weight = learn[first + np.searchsorted(at, mine, "right") - 1]
            for kind, key in enumerate((x >> _u(48 - 8 * length) << _u(8) | x & _u(255), x >> _u(40 - 8 * length))):
                distinct, of = np.unique(key, return_inverse=True)
                columns = [np.full(len(distinct), kind, np.int32), distinct.astype(np.int64), np.bincount(of, minlength=len(distinct)), np.bincount(of, weight, len(distinct)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "n", "learnt"])


def _counted(rows: DataFrame) -> tuple[np.ndarray, ...]:
    table = rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt")).toArrow().sort_by("key")
    return tuple(table[c].combine_chunks().to_numpy() for c in ("kind", "key", "n", "learnt"))


def frequent_contexts(plain: DataFrame, share: float) -> Nodes:
    """From rows (_text, held_out).  What comes to the driver is bounded: 65,536 pairs, then for each length 512 counts of each context that is split."""
    schema = "kind int, key long, n long, learnt long"
    _, key, n, learnt = _counted(plain.mapInArrow(_count_pairs, schema))
    pairs = np.zeros((256, 256), np.int64)
    pairs[key >> 8, key & 255] = learnt
    total, texts = n.sum(), n[(key & 255) == BYTE_END].sum()
    # A context's last byte is a pair's second symbol; all texts begin after two starts.
    context, often = np.append((key & 255) << 8 | key >> 8, BYTE_START << 8 | BYTE_START), np.append(np.where((key & 255) == BYTE_END, 0, n), texts)
    hot, counts = {2: np.sort(context[often > total * share]).astype(np.uint64)}, {}
    for length in (2, 3, 4):
        if not len(hot[length]):
            del hot[length]
            break
        kind, key, n, learnt = _counted(plain.mapInArrow(partial(_count_contexts, length=length, hot=hot), schema))
        mine = (kind == 0) & (learnt > 0)
        counts[length] = key[mine].astype(np.uint64), learnt[mine]
        if length < 4:
            hot[length + 1] = key[(kind == 1) & (n > total * share)].astype(np.uint64)
    return Nodes(hot, pairs, counts)


class _Block:
    """Distinct 6-grams and words of a block, with their counts in training texts."""

    def __init__(self, docs: pa.Table, nodes: Nodes) -> None:
        self.texts = text_array(docs["_text"])
        self.learn = ~docs["held_out"].combine_chunks().to_numpy(zero_copy_only=False)
        self.parts, counts = [], []
        for first, six, at in _six(self.texts):
            key, of = np.unique(six, return_inverse=True)
            counts.append(np.bincount(of, np.repeat(self.learn[first : first + len(at) - 1], np.diff(at)), len(key)))
            self.parts.append((first, key, of.astype(np.int32), at))
        key, count = merged([k for _, k, _, _ in self.parts], counts)
        key = _keys(key, nodes)
        order = np.argsort(key)
        self.keys, self.counts = key[order], count[order]
        words, self.at = split_words(pc.ascii_lower(self.texts))
        self.hashes = word_hashes(words)
        self.words, of = np.unique(np.append(B.mix(self.hashes), _END_WORD), return_inverse=True)
        self.of, self.end = of[:-1], of[-1]
        self.word_counts = np.bincount(self.of, np.repeat(self.learn, np.diff(self.at)), len(self.words)).astype(np.int64)
        self.word_counts[self.end] += self.learn.sum()


def _ask(blk: int, docs: pa.Table, _: None, *, buckets: int, nodes: Nodes) -> pa.Table:
    x = _Block(docs, nodes)
    six = B.ask_rows(blk, 1, x.keys, buckets, lambda i, j: x.counts[i:j].astype(np.uint32).tobytes(), _pack)
    return pa.concat_tables([six, B.ask_rows(blk, 2, x.words, buckets, lambda i, j: x.word_counts[i:j].astype(np.uint32).tobytes())])


def _of_phase(table: pa.Table, phase: int) -> pa.Table:
    return table.filter(pc.equal(table["phase"], phase)).sort_by("blk")


def _counts(table: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(x, np.uint32) for x in table["vals"].to_pylist()]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def _answer(bkt: int, table: pa.Table, *, nodes: Nodes) -> pa.Table:
    """Base-10 logarithms of chances (phase 1) and counts (phase 2), for each key asked."""
    out = []
    six, words = _of_phase(table, 1), _of_phase(table, 2)
    for phase, rows in ((1, six), (2, words)):
        blks, keys, place = B.asked(rows, _unpack) if phase == 1 else B.asked(rows)
        distinct, of = np.unique(keys, return_inverse=True)
        total = np.bincount(of, _counts(rows), len(distinct)).astype(np.int64)
        if phase == 1:
            known = total > 0
            values = Trie(distinct[known], total[known], nodes).log10(distinct).astype(np.float32)[of]
        else:
            values = total[of]
        edge = np.searchsorted(place, np.arange(len(blks) + 1))
        out.append(B.answer_rows(bkt, phase, blks, (values[edge[i] : edge[i + 1]].tobytes() for i in range(len(blks)))))
    return pa.concat_tables(out)


def _vocabulary(bkt: int, table: pa.Table) -> pa.Table:
    rows = _of_phase(table, 2)
    _, keys, _ = B.asked(rows)
    counts = _counts(rows)
    return pa.table([pa.array([len(np.unique(keys[counts > 0]))], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["v", "n"])


def _score(blk: int, docs: pa.Table, answers: pa.Table, *, buckets: int, nodes: Nodes) -> pa.Table:
    x = _Block(docs, nodes)
    log10 = B.read_values(answers, 1, x.keys, buckets, np.float32)
    counts = B.read_values(answers, 2, x.words, buckets, np.int64)
    rows = len(x.texts)
    score = np.zeros(rows)
    for first, key, of, at in x.parts:
        score[first : first + len(at) - 1] = np.add.reduceat(log10[find(x.keys, _keys(key, nodes))].astype(np.float64)[of], at[:-1])
    known = np.concatenate([[0], np.cumsum(counts[x.of] > 0)])
    mass = np.concatenate([[0.0], np.cumsum(np.log10(counts[x.of] + 0.5))])
    end = counts[x.end]
    return pa.table(
        [docs["_id"].combine_chunks(), docs["held_out"].combine_chunks(), pa.array(np.diff(x.at) + 1), pa.array(known[x.at[1:]] - known[x.at[:-1]] + int(end > 0)), pa.array(mass[x.at[1:]] - mass[x.at[:-1]] + np.log10(end + 0.5)), pa.array(score)],
        names=["_id", "held_out", "n_tokens", "n_known", "mass", "score"],
    )


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, share: float | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (base-10 logarithms).

    Learns from the rows whose crc32 of the id's text modulo ``folds`` is not ``fold``.
    Contexts of more than ``share`` of all symbols are split (none: twice a shard's part).
    """
    kind = dict(docs.dtypes)[id_col]
    held = F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), held.alias("held_out"))
    blocks, buckets = B.deal(plain, "_text", BLOCK_BYTES)
    buckets = B.power_of_two(buckets, 1 << 16)
    nodes = frequent_contexts(plain.select("_text", "held_out"), max(LEAST_SHARE, 2 / buckets) if share is None else share)
    blocked = B.into_blocks(plain, blocks, "_id", "_text")
    asks = B.ask(blocked, partial(_ask, buckets=buckets, nodes=nodes))
    answers = B.answer(asks, partial(_answer, nodes=nodes))
    sizes = asks.groupBy("bkt").applyInArrow(lambda key, table: _vocabulary(key[0].as_py(), table), "v long, n long").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    scored = B.over_blocks(blocked, partial(_score, buckets=buckets, nodes=nodes), f"_id {kind}, held_out boolean, n_tokens long, n_known long, mass double, score double", answers)
    base = F.col("mass") - F.col("n_tokens") * F.log10(F.col("n") + 0.5 * (F.col("v") + 1))
    return scored.join(F.broadcast(sizes)).select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.col("n").alias("train_tokens"), base.alias("base_score"), "score")
