"""SimHash near-duplicates by tiled exact comparison.

A fingerprint holds, for each of 64 bits of the shingles' XXH64 values (or of
words derived from them, for wider ones), whether over half of them set it.
Equal fingerprints are one class.  Classes are compared exactly, tile against
tile, with numpy's exclusive-or and bit counts; rows are ordered by population
count, and tile pairs whose counts differ beyond the radius are skipped.

Tiles are cut inside buckets, so that work follows the number of classes:

* radius up to 2 on 64 bits: of three bands of the bits one is equal, and of
  three bands of the others one is, so two fingerprints that link meet in one of
  nine buckets (about 35 equal bits).  No link is missed.
* wider: buckets of equal minimum hash of the shingles under each of
  ``keys`` permutations.  Texts whose shingle sets overlap by a share s miss
  each other with probability (1-s)**keys (below 3e-6 for 0.8 and 8), however
  large the table or a bucket is.

With ``share`` (two whole numbers, a fraction) fingerprints only name candidates:
a link also needs that the sets of shingles overlap by that share (Jaccard, of 32
bits of each shingle's hash: sets of a thousand share one by chance once in 4,000
pairs), and a class is of equal sets (by all 64).  Candidates are
checked in rounds, each row's nearest first; what is already linked is not
checked again, and everything else is.  Where fingerprints meet, pairs go that
can't overlap so far: each set marks its hashes in ``_MARKS`` bits, and a hash whose
bit the other set lacks is not in it.

A bucket of more than ``split`` rows goes to several tasks, by pairs of tiles,
which together compare all that one task would.
A task returns a spanning forest of its links, never all pairs.

Defined results: null text counts as empty; no words give fingerprint zero and
no minimum, so such texts are one class; a null id is kept as a row and is never
a component's name, which is null if no id is known; ids may be of any type that
has an order; repeated rows stay rows; an empty table gives an empty one.  A text
of any length is sketched whole, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.operators.components import connected_components
from loxodrome.plans.lineage import cut, written

from .blocks import mix
from .filters import bloom, passes
from .words import pieces, split_words, text_array

_CHUNK = 1 << 15
_TILE = 1024
#: Bits that show what a set lacks.
_MARKS = 1024


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle, and where each text's begin."""
    words, at = split_words(pc.ascii_lower(texts))
    count = np.diff(at)
    spans = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    begins = np.concatenate([[0], np.cumsum(spans)])
    if not len(words):
        return np.zeros(0, np.uint64), begins
    joined = b" ".join(words.cast(pa.binary()).to_pylist())
    end = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    first = np.repeat(at[:-1] - begins[:-1], spans) + np.arange(begins[-1])
    last = np.minimum(first + size, np.repeat(at[1:], spans)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first)), begins


def _majority(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Fingerprint of each text's hashes."""
    n = np.diff(begins)
    counts = np.zeros((len(n), 64), np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        hi = min(lo + _CHUNK, len(hashes))
        i, j = np.searchsorted(begins, lo, "right") - 1, np.searchsorted(begins, hi, "left")
        some = np.flatnonzero(n[i:j]) + i
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts[some] += np.add.reduceat(bits, np.maximum(begins[some] - lo, 0), axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def _sets(hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    order = np.lexsort((hashes, text))
    x, text = hashes[order], text[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return x[new], np.searchsorted(text[new], np.arange(len(begins)))


def _marks(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of bits for each set of hashes: those that its hashes' low bits number."""
    out = np.zeros((len(at) - 1, _MARKS // 8), np.uint8)
    place = (x & np.uint64(_MARKS - 1)).astype(np.int64)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(at) - 1), np.diff(at)), place >> 3), (1 << (place & 7)).astype(np.uint8))
    return out


def _sketch(batches: Iterator[pa.RecordBatch], *, size: int, words: int, keys: int, sets: bool) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text", 1 << 20):
        texts = text_array(batch.column("_text"))
        hashes, begins = shingle_hashes(texts, size)
        print_ = [_majority(hashes if not i else mix(hashes + np.uint64(i)), begins) for i in range(words)]
        some = np.flatnonzero(np.diff(begins))
        least = np.zeros((len(texts), keys), np.uint64)
        for k in range(keys if len(some) else 0):
            least[some, k] = np.minimum.reduceat(mix(hashes ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)), begins[some])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel().view(np.int64)), m).cast(pa.list_(pa.int64())) if m else pa.array([[]] * len(texts), pa.list_(pa.int64())) for x, m in ((np.stack(print_, axis=1), words), (least, keys))]
        digest = np.zeros(len(texts), np.uint64)
        distinct, marks = np.zeros(len(texts), np.int64), [None] * len(texts)
        if sets:
            x, at = _sets(hashes, begins)
            distinct, marks = np.diff(at), [m.tobytes() for m in _marks(x, at)]
            if len(some):
                digest[some] = np.add.reduceat(mix(x), at[:-1][some])
        columns = [batch.column("_id"), batch.column("_key"), *lists, pa.array(np.diff(begins)), pa.array(digest.view(np.int64)), pa.array(distinct), pa.array(marks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "_key", "print", "least", "n_shingles", "_set", "_n", "_marks"])


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1, keys: int = 0, sets: bool = False) -> DataFrame:
    """_id, _key, print (array of ``words`` longs), least (minimum hashes), n_shingles, and if ``sets`` _set (a hash of the set of shingles), _n (its size) and _marks of each row."""
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), row_key(id_col, text_col).alias("_key"))
    return plain.mapInArrow(partial(_sketch, size=size, words=words, keys=keys, sets=sets), f"_id {dict(docs.dtypes)[id_col]}, _key long, print array<long>, least array<long>, n_shingles long, _set long, _n long, _marks binary")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _bands(print_: Column) -> Column:
    """Nine buckets, by two of three bands of bits, each as (number, bits)."""
    edges = (0, 22, 43, 64)
    out = []
    for b in range(3):
        rest = [i for i in range(64) if not edges[b] <= i < edges[b + 1]]
        for s in range(3):
            mine = set(range(edges[b], edges[b + 1])) | set(rest[len(rest) * s // 3 : len(rest) * (s + 1) // 3])
            mask = sum(1 << i for i in mine)
            out.append(F.struct(F.lit(len(out)).alias("no"), print_[0].bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*out)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the least one it is linked to through any links; roots are left out."""
    if not len(a):
        return a, b
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (deeper := new[new]).tolist() != new.tolist():
            new = deeper
        new = new[label]
        if (new == label).all():
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]
        label = new


def _tile_links(prints: np.ndarray, radius: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of one bucket, as a forest; with ``side``, only those between the two sides."""
    counts = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    prints, counts = prints[order], counts[order]
    side = side[order] if side is not None else None
    found_a, found_b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(prints), _TILE):
        left, a_parts, b_parts = prints[i : i + _TILE], [found_a], [found_b]
        for j in range(i, len(prints), _TILE):
            if counts[j] - counts[min(i + _TILE, len(prints)) - 1] > radius:
                break
            right = prints[j : j + _TILE]
            far = np.zeros((len(left), len(right)), np.uint16)
            for w in range(prints.shape[1]):
                far += np.bitwise_count(left[:, w, None] ^ right[None, :, w])
            near = far <= radius
            if side is not None:
                near &= side[i : i + _TILE, None] != side[None, j : j + _TILE]
            p, q = np.nonzero(near)
            keep = p + i < q + j
            a, b = _forest(p[keep] + i, q[keep] + j)
            a_parts.append(a)
            b_parts.append(b)
        found_a, found_b = _forest(np.concatenate(a_parts), np.concatenate(b_parts))
    return order[found_a], order[found_b]


def _compare(batches: Iterator[pa.RecordBatch], *, words: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links among rows of equal (bucket, pair); rows come in order of these."""

    def links(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key = _codes(table)
        cls = table["cls"].to_numpy()
        prints = table["print"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
        side = table["side"].to_numpy()
        start, length = _groups(key)
        a_parts, b_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.repeat(length <= 32, length)
        for shift in range(1, min(32, int(length.max(initial=1)))):
            i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
            if not len(i):
                break
            far = np.bitwise_count(prints[i] ^ prints[i + shift]).sum(axis=1, dtype=np.int64)
            near = (far <= radius) & ((side[i] < 0) | (side[i] != side[i + shift]))
            a_parts.append(cls[i[near]])
            b_parts.append(cls[i[near] + shift])
        for s, n in zip(start[length > 32], length[length > 32], strict=True):
            mine = slice(s, s + n)
            two = side[s] >= 0
            a, b = _tile_links(prints[mine], radius, side[mine] if two else None)
            a_parts.append(cls[mine][a])
            b_parts.append(cls[mine][b])
        a, b = _forest(np.concatenate(a_parts), np.concatenate(b_parts))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for table in _whole(batches):
        yield links(table)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with a group."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        start, _ = _groups(_codes(table))
        rest = table.slice(start[-1])
        if start[-1]:
            yield table.slice(0, start[-1])
    if rest is not None:
        yield rest


#: Groups of up to this many rows are compared by shifting whole tables.
_SMALL = 32


def _may_overlap(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether sets of n and m hashes with marks x and y may overlap by the share."""
    both = np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
    return both * share[1] >= share[0] * (n + m - both)


def _possible(batches: Iterator[pa.RecordBatch], *, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets may overlap by the share: those whose sizes and marks allow it."""
    for batch in batches:
        n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _MARKS // 8) for c in ("xa", "xb"))
        yield batch.select(["a", "b"]).filter(pa.array(_may_overlap(n, m, x, y, share)))


def _candidates(batches: Iterator[pa.RecordBatch], *, words: int, radius: int, share: tuple[int, int], since: int, upto: int) -> Iterator[pa.RecordBatch]:
    """Pairs within the radius that have different labels and whose sizes and marks allow the share; a null pair if more of them follow.

    Of small groups all such pairs, and whether one is a row's nearest later one; in
    large ones of each row's later ones, nearest first, numbers ``since`` to ``upto``.
    """
    for table in _whole(batches):
        table = table.combine_chunks()
        cls, label, side, n_of = (table[c].to_numpy() for c in ("cls", "label", "side", "_n"))
        marks = np.frombuffer(b"".join(table["_marks"].to_pylist()), np.uint8).reshape(-1, _MARKS // 8)
        prints = table["print"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words)
        key = _codes(table)
        start, length = _groups(key)
        small = np.repeat(length <= _SMALL, length)
        a_parts, b_parts, first, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)], False
        found = []
        for shift in range(1, min(_SMALL, int(length.max(initial=1)))):
            i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
            far = np.bitwise_count(prints[i] ^ prints[i + shift]).sum(axis=1, dtype=np.int64)
            good = (far <= radius) & ((side[i] < 0) | (side[i] != side[i + shift])) & (label[i] != label[i + shift])
            i, far = i[good], far[good]
            good = _may_overlap(n_of[i], n_of[i + shift], marks[i], marks[i + shift], share)
            found.append((i[good], far[good], np.full(good.sum(), shift)))
        if found:
            i, far, shift = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((shift, far, i))
            i, shift = i[order], shift[order]
            a_parts.append(cls[i])
            b_parts.append(cls[i + shift])
            first.append(np.append(True, i[1:] != i[:-1])[: len(i)])
        for s, n in zip(start[length > _SMALL], length[length > _SMALL], strict=True):
            for i in range(s, s + n, _TILE // 4):
                j = min(i + _TILE // 4, s + n)
                far = np.zeros((j - i, s + n - i), np.uint16)
                for w in range(words):
                    far += np.bitwise_count(prints[i:j, w, None] ^ prints[None, i : s + n, w])
                near = (far <= radius) & (np.arange(s + n - i)[None, :] > np.arange(j - i)[:, None])
                if side[s] >= 0:
                    near &= side[i:j, None] != side[None, i : s + n]
                order = np.argsort(np.where(near, far, np.uint16(65535)), axis=1, kind="stable")
                other = np.take_along_axis(near & (label[i:j, None] != label[None, i : s + n]), order, axis=1)
                more = more or bool(other[:, upto:].any())
                p, q = np.nonzero(other[:, since:upto])
                p, q = i + p, i + order[p, q + since]
                good = _may_overlap(n_of[p], n_of[q], marks[p], marks[q], share)
                p, q = p[good], q[good]
                a_parts.append(cls[p])
                b_parts.append(cls[q])
                first.append(np.ones(len(p), bool))
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(first))], names=["a", "b", "first"])
        if more:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([True])], names=["a", "b", "first"])


def _set_of(batches: Iterator[pa.RecordBatch], *, size: int, wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    """The sets of shingles of the texts whose key may be wanted."""
    for batch in batches:
        mine = passes(wanted.value, batch.column("_key").to_numpy().view(np.uint64))
        for part in pieces([batch.filter(pa.array(mine))], "_text", 1 << 20):
            hashes, begins = shingle_hashes(text_array(part.column("_text")), size)
            x, at = _sets(hashes >> np.uint64(32), begins)
            x = x.astype(np.uint32)
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["_key", "hashes"])


def _overlap(batches: Iterator[pa.RecordBatch], *, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets overlap by the share."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both * share[1] >= share[0] * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _codes(table: pa.Table) -> np.ndarray:
    """Running number of the (no, bits, pair) group; equal ones are neighbours."""
    columns = [table[c].to_numpy() for c in ("no", "bits", "pair")]
    new = np.zeros(table.num_rows, bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(1, np.int64)
    return start, np.diff(np.concatenate([start, [len(key)]]))


def _dealt(classes: DataFrame, words: int, radius: int, split: int, *also: str) -> DataFrame:
    """cls, print, no, bits, n, pair, side and (of wide fingerprints) ``also`` of the classes in each bucket of n, by pairs of tiles if it is large: what meets doesn't depend on ``split``."""
    banded = words == 1 and radius <= 2
    buckets = _bands(F.col("print")) if banded else F.transform("least", lambda x, i: F.struct(i.alias("no"), x.alias("bits")))
    carried = ["cls", "print"] if words == 1 else ["cls"]
    keyed = classes.select(*carried, F.explode(buckets).alias("k")).select(*carried, "k.no", "k.bits")
    if words > 1:
        keyed = keyed.distinct()  # rows of one print may share a minimum
    size = keyed.groupBy("no", "bits").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(size, ["no", "bits"])
    if words > 1:
        met = met.join(classes.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("print", *also)]), "cls")  # a class has one
    tiles = F.when(F.col("n") > split, F.ceil(F.col("n") / split).cast("int"))
    own = F.pmod(F.xxhash64("cls"), F.col("t")).cast("int")
    return (
        met.withColumn("t", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("t") - 1), F.array(F.lit(-1)))))
        .withColumn("pair", F.coalesce(F.least("own", "other") * F.col("t") + F.greatest("own", "other"), F.lit(-1)))
        .withColumn("side", F.when(F.col("own") != F.col("other"), F.col("own")).otherwise(F.lit(-1)))
        .select("cls", "print", "no", "bits", "n", "pair", "side", *also)
    )


def _together(keyed: DataFrame) -> DataFrame:
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "no", "bits", "pair").sortWithinPartitions("no", "bits", "pair", "cls")


def near_classes(classes: DataFrame, *, words: int, radius: int, split: int = 16384) -> DataFrame:
    """(node, component) of linked classes, from cls, print and least."""
    together = _together(_dealt(classes, words, radius, split))
    return connected_components(together.mapInArrow(partial(_compare, words=words, radius=radius), "a long, b long"))


def _labelled(rows: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the component of a class, itself if it has no link."""
    own = label.select(F.col("node").alias(column), F.col("component").alias(name))
    return rows.join(own, column, "left").withColumn(name, F.coalesce(name, column))


def checked_classes(classes: DataFrame, texts: DataFrame, *, size: int, words: int, radius: int, share: tuple[int, int], split: int = 16384) -> DataFrame:
    """As near_classes, of links whose sets of shingles overlap by ``share``; classes also have _key, under which ``texts`` has their _text, _n and _marks.

    A text's set is made where the text is read, if its key passes a Bloom filter
    of the candidates', so texts don't move.  Small buckets are compared once, and
    their pairs kept; only large ones are read again.
    """
    dealt = _dealt(classes, words, radius, split, "_n", "_marks")
    given = {"words": words, "radius": radius, "share": share}

    def candidates(rows: DataFrame, since: int, upto: int) -> DataFrame:
        found = _together(rows).mapInArrow(partial(_candidates, **given, since=since, upto=upto), "a long, b long, first boolean")
        return cut(found.groupBy("a", "b").agg(F.max("first").alias("first")))

    found = candidates(dealt.withColumn("label", F.col("cls")), 0, 1)
    pairs, rest = found.where("a IS NOT NULL AND first"), found.where("a IS NOT NULL AND NOT first")
    links = label = large = None
    since, upto = 0, 1
    while True:
        pairs = cut(pairs.select("a", "b"))
        needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "_key"), "cls"))
        wanted = texts.sparkSession.sparkContext.broadcast(bloom(needed.select(F.col("_key").alias("key"))))
        sets = texts.select("_key", "_text").mapInArrow(partial(_set_of, size=size, wanted=wanted), "_key long, hashes binary")
        sets = written(sets.dropDuplicates(["_key"]).join(needed, "_key").select("cls", "hashes"))
        both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
        good = both.select("a", "b", "x", "y").mapInArrow(partial(_overlap, share=share), "a long, b long")
        links = cut(good if links is None else links.union(good))
        label = cut(connected_components(links))
        more = not found.where("a IS NULL").isEmpty()
        if not more and (rest is None or rest.isEmpty()):
            return label
        pairs = None
        if more:
            if large is None:
                large = written(dealt.where(F.col("n") > _SMALL))
            since, upto = upto, upto * 8
            found = candidates(_labelled(large, label, "cls", "label"), since, upto)
            pairs = found.where("a IS NOT NULL").select("a", "b")
        if rest is not None:
            pairs = rest.select("a", "b") if pairs is None else pairs.union(rest.select("a", "b")).distinct()
            pairs, rest = _labelled(_labelled(pairs, label, "a", "la"), label, "b", "lb").where("la <> lb"), None
        if not more:
            found = found.where("a IS NULL")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, words: int = 1, radius: int = 2, keys: int = 0, share: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, _key, print, n_shingles, component (a class), component_id (smallest id reachable through links, itself included) of each row."""
    if (words > 1 or radius > 2) and not keys:
        raise ValueError("wide or far fingerprints need keys")
    rows = cut(sketches(docs, id_col=id_col, text_col=text_col, size=size, words=words, keys=keys, sets=share is not None))
    marks = [F.first("_n").alias("_n"), F.first("_marks").alias("_marks")] if share else []
    classes = rows.groupBy("print", "_set").agg(F.min("_id").alias("least_id"), F.min("least").alias("least"), F.min("_key").alias("_key"), *marks)
    # A class is named by its fingerprint, or by a hash of a wide one.
    name = F.col("print")[0] if words == 1 and not share else F.xxhash64("print", "_set") if share else F.xxhash64("print")
    classes = classes.withColumn("cls", name)
    if share:
        classes = cut(classes)
        texts = docs.select(row_key(id_col, text_col).alias("_key"), F.col(f"`{text_col}`").alias("_text"))
        linked = checked_classes(classes, texts, size=size, words=words, radius=radius, share=share)
    else:
        # Rows of one wide fingerprint may have different shingles, and lie in all of their buckets.
        shown = rows.select("print", "_set", "least").distinct().withColumn("cls", name) if keys else classes
        linked = near_classes(shown.select("cls", "print", "least"), words=words, radius=radius)
    joined = classes.select("cls", "print", "_set", "least_id").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = joined.join(named, "component").select("print", "_set", "component", "component_id")
    return rows.join(of_class, ["print", "_set"]).select(F.col("_id").alias(id_col), "_key", "print", "n_shingles", "component", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **given: object) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays (null last), of repeated rows one."""
    found = cut(near_groups(docs, id_col=id_col, text_col=text_col, **given).select(id_col, "_key", "component"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), "_key")).alias("x")
    stay = cut(found.groupBy("component").agg(first).select(F.col("x._key").alias("_key"), F.col("x.id").alias("_stay")))
    keyed = docs.select(F.struct("*").alias("_row"), row_key(id_col, text_col).alias("_key"), F.col(f"`{id_col}`").alias("_own"))
    # Only rows of a key that goes, or that several have, meet what is known of them; the others stay, and their texts don't move.
    rows = found.groupBy("_key").agg(F.count("*").alias("n")).join(stay.select("_key").distinct().withColumn("_stays", F.lit(True)), "_key", "left")
    open_ = cut(rows.where("n > 1 OR _stays IS NULL").select(F.col("_key").alias("key")))
    doubtful = docs.sparkSession.sparkContext.broadcast(bloom(open_))
    schema = keyed.schema
    alone, others = (keyed.mapInArrow(partial(_passing, doubtful=doubtful, wanted=w), schema) for w in (False, True))
    kept = others.join(stay, "_key").where(F.col("_own").eqNullSafe(F.col("_stay")))  # a key is of one component
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_own", F.col("_row")[text_col]))
    kept = kept.withColumn("_again", again).where("_again = 1").select("_row")
    return alone.select("_row").union(kept).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def _passing(batches: Iterator[pa.RecordBatch], *, doubtful: Broadcast, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose key passes the filter, or those whose key doesn't."""
    for batch in batches:
        yield batch.filter(pa.array(passes(doubtful.value, batch.column("_key").to_numpy().view(np.uint64)) == wanted))
