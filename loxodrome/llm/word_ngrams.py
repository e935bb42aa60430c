"""Hashed n-grams of words, and an interpolated modified Kneser-Ney model of them as tables.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, each a 64-bit hash.  A
text stands after two start words and is followed by an end word.  Trigrams are
counted; bigrams and words count their distinct predecessors.  What a lookup
needs is an n-gram's discounted share of its context, and what a context leaves
to the shorter one; each is one number under a hash.  A word never seen has a
share of the uniform distribution over all words and itself.
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
from pyspark.sql.window import Window

from loxodrome.plans.lineage import written

from .blocks import mix
from .ngrams import discounted, discounts_of
from .words import split_words, text_array, word_hashes

START, END = np.uint64(1), np.uint64(2)


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """First text, and neighbouring texts of about ``size`` bytes; a longer text comes alone."""
    upto = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)]) if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + size, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def word_trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """u, v, w of every word and end of the texts, and where each text's begin."""
    words, at = split_words(pc.ascii_lower(texts))
    n = np.diff(at)
    wide = np.concatenate([[0], np.cumsum(n + 3)])
    x = np.full(wide[-1], START, np.uint64)
    x[np.arange(len(words)) + np.repeat(wide[:-1] + 2 - at[:-1], n)] = word_hashes(words)
    x[wide[1:] - 1] = END
    begins = np.concatenate([[0], np.cumsum(n + 1)])
    place = np.arange(begins[-1]) + np.repeat(wide[:-1] + 2 - begins[:-1], n + 1)
    return x[place - 2], x[place - 1], x[place], begins


def key(*words: np.ndarray) -> np.ndarray:
    """One 64-bit hash of an n-gram, oldest word first."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(text_array(batch.column("_text")), 4 << 20):
            u, v, w, _ = word_trigrams(texts)
            order = np.lexsort((w, v, u))
            u, v, w = u[order], v[order], w[order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
            n = np.diff(np.append(np.flatnonzero(new), len(u)))
            yield pa.RecordBatch.from_arrays([pa.array(x[new].view(np.int64)) for x in (u, v, w)] + [pa.array(n)], names=["u", "v", "w", "n"])


class Model(NamedTuple):
    """rows: words, key, rest, value: of an n-gram its share, or (where rest) what it leaves as a context; unknown: chance of a word never seen."""

    rows: DataFrame
    unknown: float


def _keyed(batches: Iterator[pa.RecordBatch], *, words: str, rest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = key(*[batch.column(c).to_numpy().view(np.uint64) for c in words])
        columns = [np.full(len(out), len(words), np.int32), out.view(np.int64), np.full(len(out), rest)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], batch.column("value")], names=["words", "key", "rest", "value"])


def train(texts: DataFrame) -> Model:
    """From column _text.  Three counts and three numbers of each order come to the driver, no n-gram does."""
    three = written(texts.select("_text").mapInArrow(_count, "u long, v long, w long, n long").groupBy("u", "v", "w").agg(F.sum("n").alias("n")))
    two = written(three.groupBy("v", "w").agg(F.count("*").alias("n")))
    one = written(two.groupBy("w").agg(F.count("*").alias("n")))
    cuts, known = discounts_of({3: three, 2: two, 1: one})
    kinds, total = known[1]["kinds"], known[1]["total"] or 0
    unknown = float(one.agg(F.sum(discounted(F.col("n"), cuts[1]))).first()[0] or 0.0) / total / (kinds + 1) if total else 1.0
    parts = [(one.select("w", ((F.col("n") - discounted(F.col("n"), cuts[1])) / F.lit(float(total or 1)) + F.lit(unknown)).alias("value")), "w", False)]
    for table, context, order in ((three, "uv", 3), (two, "v", 2)):
        all_ = Window.partitionBy(*context)
        off = discounted(F.col("n"), cuts[order])
        share = (F.col("n") - off) / F.sum("n").over(all_)
        parts.append((table.select(*context, "w", share.alias("value")), f"{context}w", False))
        parts.append((table.groupBy(*context).agg((F.sum(off) / F.sum("n")).alias("value")), context, True))
    rows = None
    for part, words, rest in parts:
        own = part.withColumn("value", F.col("value").cast("float")).mapInArrow(partial(_keyed, words=words, rest=rest), "words int, key long, rest boolean, value float")
        rows = own if rows is None else rows.union(own)
    return Model(written(rows), unknown)
