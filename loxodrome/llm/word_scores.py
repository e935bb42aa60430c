"""Texts scored by interpolated modified Kneser-Ney models of words, in passes over hash ranges.

Texts fall into two halves.  The training texts of each half make its model, which
scores the texts of the other half, so no text is scored by a model that has seen
it.  Words and trigrams are those of ``word_ngrams``.

Texts are cut once into blocks, kept as codes of words.  What a block asks for, it
sends as sorted hashes to hash ranges (*buckets*), which sum what all blocks sent and
answer each block in the order asked with whole numbers that serve both fit and
lookup.  Trigrams go, in passes over the buckets, under the hash of their first two
words; answers are the trigram's count and its context's counts.  Of each distinct
trigram of a half's model, one training block that has it becomes the *owner*, so a
bigram's number of distinct words before it is the sum of the owned trigrams that
blocks count: bigrams go with that number alone, in passes too.  A bigram has one
owner again, so words go once a block, each with what the owned bigrams add to it:
how many words stand before it, and what it leaves as a context.

Discounts follow from counts of counts, six numbers a bucket.  A pass's shuffles are
dropped as it ends; answers are small, for most n-grams are rare.  A frequent word,
pair or trigram is one entry a block, whatever its count.

Words are 48-bit hashes.  Contexts of a bucket meet by 40 bits and their next words
by 24, bigrams by 40.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import partial, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loxodrome.plans.lineage import remove, shared_folder, tidy

from .blocks import mix, runs
from .ngrams import discounts
from .word_ngrams import END, START, key
from .words import coded_words, hashes_of, pieces, text_array

#: Text of a block, that is cut to words at once, in a block at most; text whose n-grams share a bucket.
BLOCK_BYTES, PIECE_BYTES, MOST_BYTES, BUCKET_BYTES = 36 << 20, 7 << 20, 64 << 20, 12 << 20
#: Over buckets of trigrams, of bigrams, of words; parts of the blocks that meet their answers at once.
PASSES, PAIR_PASSES, WORD_PASSES, SLICES = 4, 3, 3, 6
_WORD, _PAIR, _TRIPLE, _MINE, _OWN, _SUMS = 1, 2, 3, 5, 6, 9  # what a row holds
_BLOCK = "blk long, half boolean, body binary, docs binary"
_ASK = "bkt int, blk long, half boolean, body binary"
_ANSWER = pa.schema([("role", pa.int32()), ("bkt", pa.int32()), ("blk", pa.int64()), ("body", pa.binary())])
_ANSWER_SQL = "role int, bkt int, blk long, body binary"
_LOW = [np.uint64((1 << n) - 1) for n in (24, 32, 40, 48)]
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers by planes of equal bytes, each array compressed."""
    out = [np.array([len(arrays), *(x for a in arrays for x in (len(a), a.itemsize))], "<i8").tobytes()]
    bodies = [pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), "zstd", asbytes=True) if len(a) else b"" for a in arrays]
    return b"".join([*out, np.array([len(b) for b in bodies], "<i8").tobytes(), *bodies])


def unpack(body: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(body, "<i8", 1)[0])
    head = np.frombuffer(body, "<i8", 1 + 3 * n)
    sizes, lengths, at, out = head[1 : 1 + 2 * n].reshape(n, 2), head[1 + 2 * n :], 8 * (1 + 3 * n), []
    for (count, width), length in zip(sizes.tolist(), lengths.tolist(), strict=True):
        kind = np.dtype(f"<u{width}")
        raw = np.frombuffer(pa.decompress(body[at : at + length], count * width, "zstd"), np.uint8) if count else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(width, count).T).view(kind).ravel())
        at += length
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """What np.cumsum makes the sorted keys of; it has fewer bytes."""
    return np.diff(keys, prepend=np.uint64(0))


def tokens(texts: pa.Array, coded: tuple[pa.DictionaryArray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words, START and END first; each word's place among these; words of each text, of which ``coded`` are the ``coded_words``."""
    words, at = coded or coded_words(texts)
    lower = pc.ascii_lower(words.dictionary).dictionary_encode()
    hashes = np.concatenate([np.array([START, END], np.uint64), hashes_of(lower.dictionary) & _LOW[3]])
    return hashes, (lower.indices.to_numpy().astype(np.uint32) + np.uint32(2))[words.indices.to_numpy()], np.diff(at)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Of a sorted array."""
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def together(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of several lots of texts as one."""
    words = _distinct(np.sort(np.concatenate([hashes[2:] for hashes, *_ in parts])))
    codes = [np.append(np.arange(2), np.searchsorted(words, hashes[2:]) + 2).astype(np.uint32)[of] for hashes, of, _ in parts]
    return np.append(parts[0][0][:2], words), np.concatenate(codes), np.concatenate([n for *_, n in parts])


def chosen(hashes: np.ndarray, codes: np.ndarray, n: np.ndarray, mine: np.ndarray, train: np.ndarray) -> bytes:
    """The tokens of some of the texts, codes by frequency, and which of these texts make a model."""
    codes = codes[np.repeat(mine, n)]
    count = np.bincount(codes, minlength=len(hashes))
    used = np.flatnonzero(count)
    used = used[np.lexsort((hashes[used], -count[used]))]
    place = np.zeros(len(hashes), np.uint32)
    place[used] = np.arange(2, len(used) + 2)
    return pack(steps(np.append(hashes[:2], hashes[used])), place[codes], n[mine].astype(np.uint32), train[mine].astype(np.uint8))


class Coded(NamedTuple):
    """Hashes of a block's words; u, v, w: places among these of each word and end, and of the two before; where each text's begin; whether it makes a model, by place."""

    hashes: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    at: np.ndarray
    train: np.ndarray


def coded(hashes: np.ndarray, codes: np.ndarray, n: np.ndarray, train: np.ndarray | None = None) -> Coded:
    n = n.astype(np.int64)
    wide, begins = np.concatenate([[0], np.cumsum(n + 3)]), np.concatenate([[0], np.cumsum(n + 1)])
    x, ends = np.zeros(wide[-1], np.uint32), np.ones(wide[-1], bool)
    ends[wide[:-1]] = ends[wide[:-1] + 1] = False
    inner = ends.copy()
    inner[wide[1:] - 1] = False
    x[inner] = codes
    x[wide[1:] - 1] = 1
    train = np.ones(len(n), bool) if train is None else train.astype(bool)
    return Coded(hashes, x[:-2][ends[2:]], x[:-1][ends[1:]], x[ends], begins, np.repeat(train, n + 1))


def decode(body: bytes) -> Coded:
    hashes, *others = unpack(body)
    return coded(np.cumsum(hashes), *others)


def like_halves(c: Coded) -> np.ndarray:
    """A half for each text, by a bit of the least hash of its trigrams: two texts that share a part of all their trigrams share it that often at least, so near copies seldom teach each other's model."""
    h = c.hashes
    least = np.minimum.reduceat(key(h[c.u], h[c.v], h[c.w]), c.at[:-1]) if len(c.at) > 1 else np.zeros(0, np.uint64)
    return (mix(least) & np.uint64(1)) == 0


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)


def _parts(keys: np.ndarray, buckets: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket from low to high that has some of the keys, and their places."""
    of = _bucket(keys, buckets)
    mine = np.flatnonzero((of >= low) & (of < high))
    mine = mine[np.argsort(of[mine], kind="stable")]
    start, length = runs(of[mine])
    for s, n in zip(start, length, strict=True):
        yield int(of[mine[s]]), mine[s : s + n]


def triples(c: Coded, buckets: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By bucket of the first two words: places, distinct keys, each place's key."""
    first, second = c.hashes * _FACTOR, mix(c.hashes)
    context = mix(first[c.u] + second[c.v])
    for b, at in _parts(context, buckets, low, high):
        yield b, at, *np.unique((context[at] & _LOW[2]) << np.uint64(24) | c.hashes[c.w[at]] & _LOW[0], return_inverse=True)


def pairs(c: Coded, buckets: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By bucket of the last two words: places, distinct keys, each place's key."""
    first, second = mix(~c.hashes), c.hashes * _FACTOR
    both = mix(second[c.w] + first[c.v])
    for b, at in _parts(both, buckets, low, high):
        yield b, at, *np.unique(both[at] & _LOW[2], return_inverse=True)


def word_parts(c: Coded, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """By bucket: places of words, by hash."""
    for b, at in _parts(mix(c.hashes), buckets, 0, buckets):
        yield b, at[np.argsort(c.hashes[at])]


def _put(held: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
    """A block of each half, of lots of texts: their tokens, halves, whether they make a model, their other columns."""
    words, docs = together([x[0] for x in held]), pa.concat_tables([x[3] for x in held])
    half, train = (np.concatenate([x[k] for x in held]) for k in (1, 2))
    for h in (False, True):
        mine = half == h
        if mine.any():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs.filter(pa.array(mine)).combine_chunks())
            row = [pa.array([number + h]), pa.array([h]), pa.array([chosen(*words, mine, train)], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["blk", "half", "body", "docs"])


def _block(batches: Iterator[pa.RecordBatch], *, others: int, size: int, look: Callable | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held, upto = TaskContext.get().partitionId() << 32, [], 0
    for batch in pieces(batches, "_text", min(size, PIECE_BYTES)):
        texts = text_array(batch.column("_text"))
        spelt = coded_words(texts)
        more = look(texts, spelt) if look else {}
        train = pc.fill_null(batch.column("_train"), False).to_numpy(zero_copy_only=False) & more.pop("_train", True)
        words = tokens(texts, spelt)
        half = batch.column("_half").to_numpy(zero_copy_only=False) if "_half" in batch.schema.names else like_halves(coded(*words))
        docs = pa.table([*[batch.column(f"_c{i}") for i in range(others)], *[pa.array(x) for x in more.values()]], names=[*[f"_c{i}" for i in range(others)], *more])
        amount = pc.sum(pc.binary_length(texts)).as_py() or 0
        if held and upto + amount > size:
            yield from _put(held, number)
            number, held, upto = number + 2, [], 0
        held.append((words, half, train, docs))
        upto += amount
    if held:
        yield from _put(held, number)


def _rows(blk: int, half: bool, found: list[tuple[int, bytes]]) -> pa.Table:
    n = len(found)
    arrays = [pa.array([x[0] for x in found], pa.int32()), pa.array([blk] * n, pa.int64()), pa.array([half] * n, pa.bool_()), pa.array([x[1] for x in found], pa.binary())]
    return pa.table(arrays, names=["bkt", "blk", "half", "body"])


def _each(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


def _ask_triples(batches: Iterator[pa.RecordBatch], *, buckets: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for blk, half, body in _each(batches, "blk", "half", "body"):
        c = decode(body)
        found = [(b, pack(steps(keys), np.bincount(of[c.train[at]], minlength=len(keys)).astype(np.uint32))) for b, at, keys, of in triples(c, buckets, low, high)]
        yield from _rows(blk, half, found).to_batches()


def _of_block(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r, b): x for r, b, x in zip(*(answers[k].to_pylist() for k in ("role", "bkt", "body")), strict=True)}


def _owned(block: pa.Table, answers: pa.Table, *, buckets: int) -> pa.Table:
    """The block with a mark at one place of each trigram that it owns."""
    c, found = decode(block["body"][0].as_py()), _of_block(answers)
    own = np.zeros(len(c.w), bool)
    for b, at, keys, of in triples(c, buckets, 0, buckets):
        place = np.empty(len(keys), np.int64)
        place[of] = at
        own[place[_marks(found[_OWN, b], len(keys))]] = True
    return block.append_column("own", pa.array([pack(np.packbits(own))], pa.binary()))


def _marks(body: bytes, n: int) -> np.ndarray:
    return np.unpackbits(unpack(body)[0], count=n).astype(bool)


def _ask_pairs(batches: Iterator[pa.RecordBatch], *, buckets: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    for blk, half, body, marks in _each(batches, "blk", "half", "body", "own"):
        c = decode(body)
        own = _marks(marks, len(c.w))
        found = [(b, pack(steps(keys), np.bincount(of[own[at]], minlength=len(keys)).astype(np.uint32))) for b, at, keys, of in pairs(c, buckets, low, high)]
        yield from _rows(blk, half, found).to_batches()


def _ask_words(block: pa.Table, answers: pa.Table, *, buckets: int, word_buckets: int) -> pa.Table:
    """The words, and what the bigrams that the block owns add to each."""
    c, found = decode(block["body"][0].as_py()), _of_block(answers)
    own = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for b, at, keys, of in pairs(c, buckets, 0, buckets):
        (n,) = unpack(found[_MINE, b])
        place = np.empty(len(keys), np.int64)
        place[of] = at
        own.append((place[n > 0], n[n > 0].astype(np.int64)))
    place, n = (np.concatenate(x) for x in zip(*own, strict=True))
    figures = np.zeros((5, len(c.hashes)), np.int64)
    np.add.at(figures[1], c.v[place], n)
    for k, words in ((0, c.w[place]), (2, c.v[place[n == 1]]), (3, c.v[place[n == 2]]), (4, c.v[place[n > 2]])):
        figures[k] = np.bincount(words, minlength=len(c.hashes))
    return _rows(block["blk"][0].as_py(), block["half"][0].as_py(), [(b, pack(steps(c.hashes[at]), *unpack(_small(*figures[:, at])))) for b, at in word_parts(c, word_buckets)])


class _Answers:
    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, bytes]] = []

    def sums(self, order: int, half: bool, n: np.ndarray) -> None:
        """n1 to n4, kinds and total of positive counts."""
        values = [*np.bincount(np.minimum(n, 5), minlength=6)[1:5], np.count_nonzero(n), n.sum()]
        self.rows.append((_SUMS, order, int(half), np.array(values, "<i8").tobytes()))

    def table(self) -> pa.Table:
        return pa.table([pa.array([x[i] for x in self.rows], _ANSWER.types[i]) for i in range(4)], schema=_ANSWER)


def _by_context(n: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Total, and numbers of ones, twos and more, of each stretch of the counts."""
    return [np.add.reduceat(x.astype(np.int64), start) for x in (n, n == 1, n == 2, n > 2)]


def _small(*arrays: np.ndarray) -> bytes:
    if any(len(a) and a.max() > 0xFFFFFFFF for a in arrays):
        return pack(*[a.astype(np.uint64) for a in arrays])
    return pack(*[a.astype(np.uint32) for a in arrays])


def _gather(table: pa.Table) -> tuple[list[tuple[int, bool]], list[list[np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """Blocks and their halves, by block; what each sent; all distinct keys, the place there of each key sent, where each block's begin."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("blk", "half", "body")), strict=True))
    bodies = [unpack(x[2]) for x in rows]
    edge = np.concatenate([[0], np.cumsum([len(x[0]) for x in bodies])])
    keys, of = np.unique(np.concatenate([np.cumsum(x[0]) for x in bodies]), return_inverse=True)
    return [x[:2] for x in rows], bodies, keys, of, edge


def _counted(blocks: list[tuple[int, bool]], bodies: list[list[np.ndarray]], of: np.ndarray, edge: np.ndarray, half: bool, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what blocks of the half sent; the first block that sent more than 0, by its place."""
    n, owner = np.zeros(keys, np.int64), np.full(keys, -1, np.int32)
    for i in reversed(range(len(blocks))):
        if blocks[i][1] == half:
            mine = of[edge[i] : edge[i + 1]]
            n[mine] += bodies[i][1]
            owner[mine[bodies[i][1] > 0]] = i
    return n, owner


def _sum_triples(bkt: int, table: pa.Table) -> pa.Table:
    out = _Answers()
    blocks, bodies, keys, of, edge = _gather(table)
    start, length = runs(keys >> np.uint64(24))
    context = np.repeat(np.arange(len(start)), length)
    for half in (False, True):
        n, owner = _counted(blocks, bodies, of, edge, half, len(keys))
        total, *few = _by_context(n, start)
        sums = [total - few[0] - 2 * few[1] - 3 * few[2], *few]  # the rest of the total, most often 0
        out.sums(3, half, n)
        for i, (blk, h) in enumerate(blocks):
            mine = of[edge[i] : edge[i + 1]]
            if h != half:
                some = _distinct(context[mine])
                out.rows.append((_TRIPLE, bkt, blk, _small(n[mine], *[x[some] for x in sums])))
            else:
                out.rows.append((_OWN, bkt, blk, pack(np.packbits(owner[mine] == i))))
    return out.table()


def _sum_pairs(bkt: int, table: pa.Table) -> pa.Table:
    out = _Answers()
    blocks, bodies, keys, of, edge = _gather(table)
    for half in (False, True):
        n, owner = _counted(blocks, bodies, of, edge, half, len(keys))
        out.sums(2, half, n)
        for i, (blk, h) in enumerate(blocks):
            mine = of[edge[i] : edge[i + 1]]
            out.rows.append((_PAIR, bkt, blk, _small(n[mine])) if h != half else (_MINE, bkt, blk, _small(np.where(owner[mine] == i, n[mine], 0))))
    return out.table()


def _sum_words(bkt: int, table: pa.Table) -> pa.Table:
    out = _Answers()
    blocks, bodies, keys, of, edge = _gather(table)
    for half in (False, True):
        sums = np.zeros((5, len(keys)), np.int64)
        for i, (_, h) in enumerate(blocks):
            if h == half:
                for k in range(5):
                    np.add.at(sums[k], of[edge[i] : edge[i + 1]], bodies[i][k + 1].astype(np.int64))
        out.sums(1, half, sums[0])
        out.rows += [(_WORD, bkt, blk, _small(*sums[:, of[edge[i] : edge[i + 1]]])) for i, (blk, h) in enumerate(blocks) if h != half]
    return out.table()


class Fit(NamedTuple):
    """Of a half: what is taken from counts 0, 1, 2, 3 and more by order from 1, all bigrams, the chance of a word never seen; 1 where there are no texts."""

    cuts: tuple[np.ndarray, np.ndarray, np.ndarray]
    total: int
    unknown: float


def fits(rows: list[tuple[int, int, bytes]]) -> dict[bool, Fit]:
    """From rows of _SUMS: order, half, body."""
    sums = np.zeros((2, 4, 6), np.int64)
    for order, half, body in rows:
        sums[half, order] += np.frombuffer(body, "<i8")
    out = {}
    for half in (False, True):
        cuts = tuple(discounts(*sums[int(half), order, :4].tolist()) for order in (1, 2, 3))
        n1, n2, _, _, kinds, total = sums[int(half), 1].tolist()
        left = cuts[0][1] * n1 + cuts[0][2] * n2 + cuts[0][3] * (kinds - n1 - n2)
        out[half] = Fit(cuts, total, left / total / (kinds + 1) if total else 1.0)
    return out


def _share(n: np.ndarray, cut: np.ndarray, total: np.ndarray) -> np.ndarray:
    return (n - cut[np.minimum(n, 3)]) / np.maximum(total, 1)


def _rest(sums: list[np.ndarray], cut: np.ndarray) -> np.ndarray:
    total, n1, n2, n3 = sums
    return np.where(total > 0, (cut[1] * n1 + cut[2] * n2 + cut[3] * n3) / np.maximum(total, 1), 1.0)


def _bits(c: Coded, answers: dict[tuple[int, int], bytes], fit: Fit, buckets: int, word_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text, and those of the lowest order alone."""
    if fit.unknown == 1:
        return np.zeros(len(c.at) - 1), np.zeros(len(c.at) - 1)
    find_ = lambda role, b: [x.astype(np.int64) for x in unpack(answers[role, b])]
    word = np.zeros((5, len(c.hashes)), np.int64)
    for b, at in word_parts(c, word_buckets):
        word[:, at] = find_(_WORD, b)
    p1 = _share(word[0], fit.cuts[0], fit.total) + fit.unknown
    rest = _rest(list(word[1:]), fit.cuts[1])
    p = np.zeros(len(c.w))
    for b, at, _, of in pairs(c, buckets, 0, buckets):
        (n,) = find_(_PAIR, b)
        p[at] = _share(n[of], fit.cuts[1], word[1, c.v[at]]) + rest[c.v[at]] * p1[c.w[at]]
    for b, at, keys, of in triples(c, buckets, 0, buckets):
        n, more, *few = find_(_TRIPLE, b)
        _, length = runs(keys >> np.uint64(24))
        total = more + few[0] + 2 * few[1] + 3 * few[2]
        context = np.repeat(np.arange(len(total)), length)
        p[at] = _share(n, fit.cuts[2], total[context])[of] + _rest([total, *few], fit.cuts[2])[context][of] * p[at]
    return np.add.reduceat(-np.log2(p), c.at[:-1]), np.add.reduceat(-np.log2(p1)[c.w], c.at[:-1])


def _score(block: pa.Table, answers: pa.Table, *, fits: dict[bool, Fit], buckets: int, word_buckets: int) -> pa.Table:
    c, fit = decode(block["body"][0].as_py()), fits[not block["half"][0].as_py()]
    found = _of_block(answers)
    docs = pa.ipc.open_stream(block["docs"][0].as_py()).read_all()
    n = len(docs)
    return pa.table([*docs.columns, pa.array(np.full(n, fit.unknown < 1)), pa.array(np.diff(c.at)), *map(pa.array, _bits(c, found, fit, buckets, word_buckets))], names=[*docs.column_names, "known", "n_tokens", "bits", "word_bits"])


def cross_scored(rows: DataFrame, size: DataFrame, look: Callable | None = None, extra: str = "") -> DataFrame:
    """Columns of ``rows`` other than _text, _half, _train; those that ``look(texts)`` finds (types in ``extra``); known, n_tokens, bits, word_bits.

    ``_half``, if there is such a column, tells a row's half (else ``like_halves``) and ``_train`` (and ``look``'s _train) whether its
    text makes a model.  bits are the text's, word_bits those of the model's lowest
    order, 0 where ``known`` is false: the other half has no training text.  ``size`` has the texts alone, to choose sizes by.
    The result is a table in the shared folder.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/words-{uuid.uuid4().hex}"
    names = [x for x in rows.columns if x not in ("_text", "_half", "_train")]
    amount = size.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    grow = min(16.0, max(1.0, (amount / (1 << 30)) ** 0.5))
    buckets = max(PASSES, math.ceil(amount / (BUCKET_BYTES * grow)))
    word_buckets = max(WORD_PASSES, buckets // 4)
    types = ", ".join(f"{c} {rows.schema[n].dataType.simpleString()}" for c, n in ((f"_c{i}", n) for i, n in enumerate(names)))
    plain = rows.select(*[c for c in ("_text", "_half", "_train") if c in rows.columns], *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)])
    part = F.pmod(F.col("blk") + F.shiftright("blk", 32), F.lit(SLICES)).cast("int")

    def keep(df: DataFrame, name: str, *by: str) -> DataFrame:
        with tidy(spark):
            df.write.partitionBy(*by).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def all_of(tables: Iterator[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, tables)

    def passes(many: int, ranges: int) -> Iterator[tuple[int, int, int]]:
        return ((i, i * ranges // many, (i + 1) * ranges // many) for i in range(many))

    blocks = keep(plain.mapInArrow(partial(_block, others=len(names), size=int(min(BLOCK_BYTES * grow, max(BLOCK_BYTES, MOST_BYTES))), look=look), _BLOCK).withColumn("part", part), "blocks", "part")

    def answered(asks: DataFrame, sums: Callable, name: str) -> DataFrame:
        return keep(asks.groupBy("bkt").applyInArrow(lambda key, table: sums(key[0].as_py(), table), _ANSWER_SQL), name)

    def met(some: DataFrame, answers: DataFrame, roles: tuple[int, ...], i: int, made: Callable, schema: str) -> DataFrame:
        mine = answers.where((part == i) & F.col("role").isin(*roles))
        return some.groupBy("blk").cogroup(mine.groupBy("blk")).applyInArrow(lambda key, block, found: made(block, found), schema)

    coded = blocks.select("blk", "half", "body")
    found = all_of([answered(coded.mapInArrow(partial(_ask_triples, buckets=buckets, low=low, high=high), _ASK), _sum_triples, f"triples-{i}") for i, low, high in passes(PASSES, buckets)])
    owned = []
    for i in range(SLICES):
        owned.append(keep(met(blocks.where(F.col("part") == i).drop("part"), found, (_OWN,), i, partial(_owned, buckets=buckets), f"{_BLOCK}, own binary"), f"owned-{i}"))
        remove(spark, f"{folder}/blocks/part={i}")
    coded = all_of(owned).select("blk", "half", "body", "own")
    twos = all_of([answered(coded.mapInArrow(partial(_ask_pairs, buckets=buckets, low=low, high=high), _ASK), _sum_pairs, f"pairs-{i}") for i, low, high in passes(PAIR_PASSES, buckets)])
    asks = all_of([keep(met(x.select("blk", "half", "body"), twos, (_MINE,), i, partial(_ask_words, buckets=buckets, word_buckets=word_buckets), _ASK), f"asks-{i}") for i, x in enumerate(owned)])
    ones = all_of([answered(asks.where(f"bkt >= {low} AND bkt < {high}"), _sum_words, f"words-{i}") for i, low, high in passes(WORD_PASSES, word_buckets)])
    for i in range(SLICES):
        remove(spark, f"{folder}/asks-{i}")
    found = found.union(twos).union(ones)
    known = fits([(r.bkt, r.blk, r.body) for r in found.where(F.col("role") == _SUMS).select("bkt", "blk", "body").collect()])
    schema = ", ".join(x for x in (types, extra, "known boolean, n_tokens long, bits double, word_bits double") if x)
    score = partial(_score, fits=known, buckets=buckets, word_buckets=word_buckets)
    scored = []
    for i, x in enumerate(owned):
        scored.append(keep(met(x.select("blk", "half", "body", "docs"), found, (_WORD, _PAIR, _TRIPLE), i, score, schema), f"scored-{i}"))
        remove(spark, f"{folder}/owned-{i}")
    for name, many in (("blocks", None), ("triples", PASSES), ("pairs", PAIR_PASSES), ("words", WORD_PASSES)):
        for i in range(many or 1):
            remove(spark, f"{folder}/{name}-{i}" if many else f"{folder}/{name}")
    out = all_of(scored)
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *out.columns[len(names) :])
