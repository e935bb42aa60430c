"""Quality rules: plain counts, and perplexity bands of a Kneser-Ney model.

With ``model="words"``, as the query and the pipeline ask, the model is one of words: interpolated modified Kneser-Ney over trigrams
of words, from all texts that pass the plain rules.  Texts fall into two halves by
their least trigram, so copies share one, and near copies nearly always; each half's
model scores the other half (see ``word_scores``), and a text's perplexity is that of
its words and end.  Where the
other half has no text that passes the plain rules, these alone decide.

With ``model="classes"`` (the default) it is one of symbols: Spark counts the 4-grams of 64 symbol
classes of all texts that pass the plain rules, at most 64**4 = 16.8 million sums
whatever the corpus, and turns them into the discounted shares of interpolated
modified Kneser-Ney.  These are kept in sorted arrays, 8 bytes an n-gram, which go
to every executor once as a broadcast variable; their size is checked against that
bound (``MODEL_BYTES``).  A text's perplexity is that of its bytes and end.

Per language, the band is the middle half of the logarithm of perplexity, widened on
both sides by ``widen`` times its width (at least ``least`` bits a byte, six times as
much a word); texts outside it are rejected.  Of the word model, the upper edge is that of the whole model and the lower
one that of its lowest order alone: a passage that other texts have too lowers the
former, so texts would go for being near copies of each other, all of them.

Each text is measured once: rows with their figures are written to the shared
folder, from which bands and result are read.  Quantiles are exact over
thousandths of a bit, so reruns agree.

Defined results: null text has no words and fails the plain rules; a null
language is one of its own; a language all of whose texts fail keeps none;
repeated rows stay rows; an empty table gives an empty one.  A text of any length
is measured whole, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.plans.lineage import cut, written

from .blocks import mix, runs
from .ngrams import SYMBOLS, KneserNey, class_grams, fit
from .word_scores import cross_scored
from .words import coded_words, pieces, text_array

ORDER = 4
#: Keys and shares of all orders, and of all contexts.
MODEL_BYTES = 8 * sum(SYMBOLS**n + SYMBOLS ** (n - 1) for n in range(1, ORDER + 1))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_STEP = 1000  # parts of a bit
_WORD_BYTES = 6  # of a word and the space after it: ``least`` is in bits a byte


def _per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    some, out = at[1:] > at[:-1], np.zeros(len(at) - 1, np.int64)
    if some.any():
        out[some] = np.add.reduceat(marks, at[:-1][some], dtype=np.int64)
    return out


def _repeats(words: pa.DictionaryArray, at: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows found twice or more in it."""
    x = mix(np.arange(1, len(words.dictionary) + 1, dtype=np.uint64))[words.indices.to_numpy()]
    end = np.repeat(at[1:], np.diff(at))
    start = np.flatnonzero(np.arange(len(x)) + 3 <= end)
    if not len(start):
        return np.zeros(len(at) - 1, np.int64)
    text = np.searchsorted(at, start, "right").astype(np.uint64)
    key = mix(mix(x + _FACTORS[0])[start] + x[start + 1] * _FACTORS[1] + (x[start + 2] + text) * _FACTORS[2])
    order = np.argsort(key)
    _, length = runs(key[order])
    hit = start[order[np.repeat(length > 1, length)]]
    change = np.zeros(len(x) + 3, np.int64)
    change[hit] += 1
    change[hit + 3] -= 1
    return _per_text(np.cumsum(change[: len(x)]) > 0, at)


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier one."""
    lists = pc.split_pattern(texts, "\n")
    text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    coded = lists.flatten().dictionary_encode()
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    line = coded.indices.to_numpy()
    some = full[line] if len(line) else np.zeros(0, bool)
    pairs = np.unique(text[some].astype(np.int64) << 32 | line[some])
    return np.bincount(text[some], minlength=len(texts)) - np.bincount(pairs >> 32, minlength=len(texts))


def plain_counts(texts: pa.Array, coded: tuple[pa.DictionaryArray, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """``coded``: the texts' ``coded_words``, if they are at hand."""
    words, at = coded or coded_words(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    chars = ((data & 0xC0) != 0x80) & ~_SPACE[data]
    found = {"n_words": np.diff(at), "word_chars": _per_text(chars, offsets), "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": _dup_lines(texts), "n_repeat_words": _repeats(words, at)}
    failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    return found | {"base_failed": failed}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        texts = text_array(batch.column("_text"))
        texts = texts.filter(pa.array(~plain_counts(texts)["base_failed"]))
        parts = [np.unique(keys, return_counts=True) for _, keys, _ in class_grams(texts, ORDER)]
        if parts:
            keys, of = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(np.bincount(of, np.concatenate([c for _, c in parts])).astype(np.int64))], names=["gram", "n"])


def _measure(batches: Iterator[pa.RecordBatch], *, model: Broadcast, others: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "_text"):
        texts = text_array(batch.column("_text"))
        found = plain_counts(texts)
        bits = np.zeros(len(texts))
        for first, keys, at in class_grams(texts, ORDER):
            distinct, of = np.unique(keys, return_inverse=True)
            cost = -np.log2(model.value.probabilities(distinct))[of]
            bits[first : first + len(at) - 1] = np.add.reduceat(cost, at[:-1]) / np.diff(at)
        arrays = [*[batch.column(f"_c{i}") for i in range(others)], *[pa.array(found[k].astype(np.int64)) for k in _COUNTS], pa.array(found["base_failed"]), pa.array(bits)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*[f"_c{i}" for i in range(others)], *_COUNTS, "base_failed", "bits"])


def train(docs: DataFrame, text_col: str = "text") -> KneserNey:
    """The model of all texts that pass the plain rules."""
    counted = docs.select(F.col(f"`{text_col}`").alias("_text")).mapInArrow(_train, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return fit(ORDER, cut(counted))


def measure(docs: DataFrame, model: KneserNey, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``docs``, plain counts, base_failed, bits (per byte)."""
    if model.nbytes() > MODEL_BYTES:
        raise ValueError("the model is larger than its order allows")
    plain = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    schema = ", ".join([*[f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema.fields[1:])], *[f"{c} long" for c in _COUNTS], "base_failed boolean, bits double"])
    return plain.mapInArrow(partial(_measure, model=docs.sparkSession.sparkContext.broadcast(model), others=len(columns)), schema)


def bands(measured: DataFrame, lang: str, widen: float, least: float) -> DataFrame:
    """_lang, low, high: where bits may lie; from histograms of those that pass the plain rules."""
    step = F.floor(F.col("bits") * _STEP)
    sums = measured.where("NOT base_failed").groupBy(F.col(lang).alias("_lang"), step.alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("_lang")
    upto = sums.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    quarter = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bin"))).alias(f"q{q}") for q in (1, 3)]
    reach = F.greatest((F.col("q3") - F.col("q1")) * F.lit(widen), F.lit(least * _STEP))
    return upto.groupBy("_lang").agg(*quarter).select("_lang", ((F.col("q1") - reach) / _STEP).alias("low"), ((F.col("q3") + 1 + reach) / _STEP).alias("high"))


def join_bounds(rows: DataFrame, small: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """``rows`` with the line of ``small`` for their key (null too): sent to every task if it is checked to be short, else joined by a shuffle that AQE can split."""
    small = cut(small)
    short = F.broadcast(small) if small.count() <= most else small
    return rows.join(short, F.col(key).eqNullSafe(F.col("_lang")), "left")


def _look(texts: pa.Array, coded: tuple[pa.DictionaryArray, np.ndarray]) -> dict[str, np.ndarray]:
    found = plain_counts(texts, coded)
    return {k: found[k].astype(np.int64) for k in _COUNTS} | {"base_failed": found["base_failed"], "_train": ~found["base_failed"]}


def measure_words(docs: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """As measure, by word models of the other half, and word_bits, of the models' lowest order; both are per word, null where that half has no model."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(text.alias("_text"), F.lit(True).alias("_train"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    scored = cross_scored(rows, rows, _look, ", ".join([*[f"{c} long" for c in _COUNTS], "base_failed boolean"]))
    return scored.withColumns({c: F.when(F.col("known"), F.col(c) / F.col("n_tokens")) for c in ("bits", "word_bits")}).drop("known", "n_tokens")


def quality_rules(docs: DataFrame, *, columns: list[str] | None = None, text_col: str = "text", lang_col: str = "lang", widen: float = 1.5, least: float = 0.09, model: str = "classes") -> DataFrame:
    """``columns`` of ``docs`` (all, if none are named; those that bear a name below are replaced), the counts, base_failed, bits, low, high, kept."""
    names = [c for c in columns or docs.columns if c not in (*_COUNTS, "base_failed", "bits", "low", "high", "kept")]
    if model == "words":
        figures = measure_words(docs, [lang_col, *names], text_col)
        known = figures.where("bits IS NOT NULL")
        low = bands(known.withColumn("bits", F.col("word_bits")), "_c0", widen, least * _WORD_BYTES).select(F.col("_lang").alias("_low_lang"), "low")
        limits = bands(known, "_c0", widen, least * _WORD_BYTES).select("_lang", "high").join(low, F.col("_lang").eqNullSafe(F.col("_low_lang"))).select("_lang", "low", "high")
        inside = F.col("bits").isNull() | F.coalesce((F.col("word_bits") >= F.col("low")) & (F.col("bits") <= F.col("high")), F.lit(False))
    else:
        figures = written(measure(docs, train(docs, text_col), [lang_col, *names], text_col))
        limits = bands(figures, "_c0", widen, least)
        inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(False))
    joined = join_bounds(figures, limits, "_c0")
    return joined.select(*[F.col(f"_c{i + 1}").alias(c) for i, c in enumerate(names)], *_COUNTS, "base_failed", "bits", "low", "high", (~F.col("base_failed") & inside).alias("kept"))
