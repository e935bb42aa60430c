"""Symbols, n-grams of symbols, and interpolated modified Kneser-Ney over sorted arrays.

Texts are read as bytes, A-Z in lower case, in 64 classes, so an n-gram is one
integer of 6n bits, oldest symbol first, and there are at most 64**n of them.
Each text is followed by an end symbol and stands after start symbols.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BITS = 6
SYMBOLS = 1 << BITS
END, START = 30, 31


def _classes() -> np.ndarray:
    """Letters 0-25, digits 26, space 27, newline 28, control 29, end 30, start 31, eleven marks, other marks, 20 for bytes beyond ASCII."""
    out = np.full(256, 29, np.uint8)
    marks = b".,;:!?'\"-()"
    for b in range(33, 127):
        out[b] = 43
    for i, b in enumerate(marks):
        out[b] = 32 + i
    for i in range(26):
        out[65 + i] = out[97 + i] = i
    out[48:58], out[32], out[10] = 26, 27, 28
    out[128:192] = 44 + (np.arange(64) & 15)
    out[192:256] = 60 + (np.arange(64) & 3)
    return out


CLASSES = _classes()
#: Bytes as they are, but A-Z in lower case; END and START are bytes that UTF-8 never uses.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
BYTE_END, BYTE_START = 255, 254


def stretches(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, bytes, and where each text's begin, for neighbouring texts of about ``size`` bytes."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def symbols(data: np.ndarray, at: np.ndarray, table: np.ndarray, start: int, end: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each after order-1 starts and followed by an end; where each text's begin."""
    n = len(at) - 1
    wide = at + np.arange(n + 1) * order
    out = np.full(wide[-1], start, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n) * order + order - 1, np.diff(at))] = table[data]
    out[wide[1:] - 1] = end
    return out, wide


def grams(x: np.ndarray, at: np.ndarray, order: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram that ends at a byte or an end, and where each text's begin; one more than the text has bytes."""
    n = len(x) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for i in range(order):
        key <<= np.uint64(bits)
        key |= x[i : i + n]
    size = np.diff(at) - order + 1
    upto = np.concatenate([[0], np.cumsum(size)])
    return key[np.arange(upto[-1]) + np.repeat(np.arange(len(size)) * (order - 1), size)], upto


def class_grams(texts: pa.Array, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, at in stretches(texts):
        yield first, *grams(*symbols(data, at, CLASSES, START, END, order), order)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among the sorted keys; -1 if it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, place, -1)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """By count 0, 1, 2, 3 and more, from the numbers of n-grams with counts 1 to 4; plain ones where these are too few."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


class Level(NamedTuple):
    """One order's n-grams with their discounted shares of their contexts, and what each context leaves to the order below; both sorted."""

    keys: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    rest: np.ndarray

    def mixed(self, wanted: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of each wanted n-gram, given the lower order's; a context never seen leaves that as it is."""
        context, place = find(self.contexts, (wanted >> np.uint64(BITS)).astype(self.contexts.dtype)), find(self.keys, wanted.astype(self.keys.dtype))
        rest = np.where(context < 0, 1.0, self.rest[context] if len(self.rest) else 1.0)
        return rest * lower + np.where(place < 0, 0.0, self.share[place] if len(self.share) else 0.0)


class KneserNey(NamedTuple):
    """Interpolated modified Kneser-Ney, by order from 1."""

    levels: tuple[Level, ...]

    def probabilities(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), 1 / SYMBOLS)
        for n, level in enumerate(self.levels, 1):
            out = level.mixed(wanted & np.uint64((1 << BITS * n) - 1), out)
        return out

    def nbytes(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)


def discounted(n: Column, cuts: np.ndarray) -> Column:
    """What modified Kneser-Ney takes from a count."""
    return F.when(n == 1, F.lit(float(cuts[1]))).when(n == 2, F.lit(float(cuts[2]))).otherwise(F.lit(float(cuts[3])))


def discounts_of(tables: dict[int, DataFrame]) -> tuple[dict[int, np.ndarray], dict[int, Row]]:
    """Discounts by order, and each order's n1 to n4, kinds and total, from tables with a count n."""
    found = None
    for order, table in tables.items():
        row = table.agg(F.lit(order).alias("order"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count("*").alias("kinds"), F.sum("n").alias("total"))
        found = row if found is None else found.union(row)
    known = {r["order"]: r for r in found.collect()}  # a row an order
    return {o: discounts(*[r[f"n{i}"] for i in (1, 2, 3, 4)]) for o, r in known.items()}, known


def fit(order: int, counted: DataFrame) -> KneserNey:
    """From all n-grams (gram, n); of 64**order at most, 8 bytes each come to the driver."""
    tables = {order: counted}
    for n in range(order - 1, 0, -1):
        tables[n] = tables[n + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    cuts, _ = discounts_of(tables)
    levels = []
    for n in range(1, order + 1):
        rows = tables[n].select("gram", "n", F.shiftright("gram", BITS).alias("context"), discounted(F.col("n"), cuts[n]).alias("cut"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("all"))
        shares = rows.join(sums, "context").select(F.col("gram").cast("int").alias("key"), ((F.col("n") - F.col("cut")) / F.col("total")).cast("float").alias("value"))
        rests = sums.select(F.col("context").cast("int").alias("key"), (F.col("all") / F.col("total")).cast("float").alias("value"))
        levels.append(Level(*_sorted(shares), *_sorted(rests)))
    return KneserNey(tuple(levels))


def _sorted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toArrow()
    keys, values = (table[c].combine_chunks().to_numpy() for c in ("key", "value"))
    order = np.argsort(keys)
    return keys[order].astype(np.uint32), values[order]
