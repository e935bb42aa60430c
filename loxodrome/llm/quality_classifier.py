"""Quality by perplexity under a Kneser-Ney model of trusted text.

The model is interpolated modified Kneser-Ney over trigrams of words (see
``word_ngrams``), counted from trusted texts only.  A document is kept if its
perplexity is at most its language's threshold: the quantile ``level`` of all
trusted texts of the language that are not in the fit.

Nothing is sampled.  Texts fall into two halves by hash, so copies share one; all
trusted texts of a half make its model, which scores the other half (see
``word_scores``).  So every text is scored once, by a model that has not seen it,
and every trusted text counts in a model and in the thresholds.

Only if a caller names ``most``, one model is fitted on a bounded sample instead: of
the trusted texts whose hash is even, the ``most`` first by hash of id.  Its tables
stay sharded by the n-grams' hashes.  Each block of documents asks for what it needs
of its distinct n-grams and gets a number for each back (see ``blocks``).  N-grams
that the model does not have are not asked for: a Bloom filter of those it has, of
at most ``filters.MOST_BITS`` bits, goes to every task; what it lets through by
chance is answered as an n-gram never seen.  Keys move as 48 bits beside the
bucket's, so an n-gram takes the number of another with a chance of about (n-grams
of a bucket / 2**48).  Texts move once, compressed.  Quantiles are exact over
thousandths of a bit.

Defined results: null text is scored as an empty one; a language without trusted
texts outside the fit takes the threshold of all languages, and nothing is kept
where there is none at all; a model of no texts gives every word the same chance,
and of two halves, what such a model scores is neither kept nor in a threshold;
ids may be of any type (trusted ids are cast to it); a null id is never trusted;
repeated rows stay rows; an empty table gives an empty one.  A text of any length
is scored whole, by one task.
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
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from loxodrome.plans.lineage import cut

from . import blocks as B
from .filters import bloom, passes
from .ngrams import find
from .quality_rules import join_bounds
from .word_ngrams import Model, key, slices, train, word_trigrams
from .word_scores import cross_scored
from .words import text_array

BLOCK_BYTES = 6 << 20
_LOW = np.uint64((1 << 48) - 1)
_STEP = 1000


def _pack(keys: np.ndarray) -> bytes:
    """The low 48 bits; the bucket tells some of the others."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(body: bytes) -> np.ndarray:
    out = np.zeros((len(body) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(body, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _block_keys(texts: pa.Array, known: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and bigrams, and distinct trigrams, that are to be asked for."""
    short, long_ = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, part in slices(texts):
        u, v, w, _ = word_trigrams(part)
        for out, keys in ((short, key(np.unique(np.append(v, w)))), (short, np.unique(np.append(key(u, v), key(v, w)))), (long_, np.unique(key(u, v, w)))):
            out.append(keys[passes(known.value, keys)])
    return np.unique(np.concatenate(short)), np.unique(np.concatenate(long_))


def _ask(blk: int, docs: pa.Table, _: None, *, buckets: int, known: Broadcast) -> pa.Table:
    short, long_ = _block_keys(text_array(docs["_text"]), known)
    return pa.concat_tables([B.ask_rows(blk, 1, short, buckets, pack=_pack), B.ask_rows(blk, 2, long_, buckets, pack=_pack)])


def _answer(asks: pa.Table, shard: pa.Table) -> pa.Table:
    """Shares of all keys asked, and after these, in phase 1, what they leave as contexts; NaN where the model has none."""
    out = [B.no_answers()]
    tables = []
    for rest in (False, True):
        mine = shard.filter(pc.equal(shard["rest"], rest))
        keys = mine["key"].combine_chunks().to_numpy().view(np.uint64) & _LOW
        order = np.argsort(keys)
        tables.append((keys[order], np.append(mine["value"].combine_chunks().to_numpy()[order], np.float32("nan")).astype(np.float32)))
    for phase in (1, 2):
        blks, keys, place = B.asked(asks.filter(pc.equal(asks["phase"], phase)), _unpack)
        values = [x[find(k, keys)] for k, x in tables[: 3 - phase]]  # place -1 is the last
        edge = np.searchsorted(place, np.arange(len(blks) + 1))
        if blks:
            out.append(B.answer_rows(asks["bkt"][0].as_py(), phase, blks, (b"".join(x[edge[i] : edge[i + 1]].tobytes() for x in values) for i in range(len(blks)))))
    return pa.concat_tables(out)


def _read(answers: pa.Table, phase: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """A row of numbers for each that an answer holds of a key, and a NaN at the end of each."""
    out = np.full((3 - phase, len(keys) + 1), np.float32("nan"))
    edge = B.bounds(keys, buckets)
    for b, p, body in zip(*(answers[c].to_pylist() for c in ("bkt", "phase", "body")), strict=True):
        if p == phase:
            out[:, edge[b] : edge[b + 1]] = np.frombuffer(body, np.float32).reshape(3 - phase, -1)
    return out


def _score(blk: int, docs: pa.Table, answers: pa.Table, *, buckets: int, known: Broadcast, unknown: float, kind: pa.DataType) -> pa.Table:
    texts = text_array(docs["_text"])
    short, long_ = _block_keys(texts, known)
    (share, rest), (share3,) = _read(answers, 1, short, buckets), _read(answers, 2, long_, buckets)

    def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        distinct, of = np.unique(wanted, return_inverse=True)
        found = values[find(keys, distinct)].astype(np.float64)
        return np.where(np.isnan(found), default, found)[of]

    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, part in slices(texts):
        u, v, w, at = word_trigrams(part)
        p = look(short, share, key(w), unknown)
        p = look(short, share, key(v, w), 0.0) + look(short, rest, key(v), 1.0) * p
        p = look(long_, share3, key(u, v, w), 0.0) + look(short, rest, key(u, v), 1.0) * p
        total[first : first + len(part)] = np.add.reduceat(-np.log2(p), at[:-1])
        n[first : first + len(part)] = np.diff(at)
    return pa.table([docs["_id"].combine_chunks().cast(kind), docs["_lang"].combine_chunks(), docs["_half"].combine_chunks(), pa.array(n), pa.array(total)], names=["_id", "_lang", "_half", "n_tokens", "bits"])


def score(plain: DataFrame, model: Model) -> DataFrame:
    """_id, _lang, _half, n_tokens, bits of each row of _id, _text, _lang, _half."""
    blocks, buckets = B.deal(plain, "_text", BLOCK_BYTES)
    known = plain.sparkSession.sparkContext.broadcast(bloom(model.rows))
    bundles = B.bundled(B.into_blocks(plain.select("_id", "_text", "_lang", "_half"), blocks, "_id", "_text"), "_text")
    asks = B.over_bundles(bundles, partial(_ask, buckets=buckets, known=known), B.ASK)
    shards = model.rows.mapInArrow(partial(_deal, buckets=buckets), "bkt int, key long, rest boolean, value float")
    answers = asks.groupBy("bkt").cogroup(shards.groupBy("bkt")).applyInArrow(lambda left, right: _answer(left, right), B.ANSWER)
    field = plain.schema["_id"].dataType
    given = {"buckets": buckets, "known": known, "unknown": model.unknown, "kind": to_arrow_type(field)}
    return B.over_bundles(bundles, partial(_score, **given), f"_id {field.simpleString()}, _lang string, _half boolean, n_tokens long, bits double", answers)


def _deal(batches: Iterator[pa.RecordBatch], *, buckets: int) -> Iterator[pa.RecordBatch]:
    """A model's rows with their bucket, by the same ranges of keys as asks."""
    cuts = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    for batch in batches:
        of = np.searchsorted(cuts, batch.column("key").to_numpy().view(np.uint64), "right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(of), *[batch.column(c) for c in ("key", "rest", "value")]], names=["bkt", "key", "rest", "value"])


def thresholds(scored: DataFrame, level: float) -> DataFrame:
    """_lang, limit, from rows of trusted texts: by language, and under a true every for all languages."""
    of = scored.select("_lang", F.floor(F.col("bits") / F.col("n_tokens") * _STEP).alias("bin")).groupBy("_lang", "bin").agg(F.count("*").alias("n"))
    both = of.select(F.lit(False).alias("every"), "_lang", "bin", "n").union(of.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(True), F.lit(None).cast("string"), "bin", "n"))
    w = Window.partitionBy("every", "_lang")
    upto = both.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    at = F.min(F.when(F.col("upto") >= F.col("all") * level, F.col("bin")))
    return upto.groupBy("every", "_lang").agg(((at + 1) / _STEP).alias("limit"))


def _sampled(plain: DataFrame, ids: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows scored by a model of the first ``most`` trusted ids of even texts, and those of trusted texts outside it."""
    halves = plain.where("_half").select("_id").join(ids, "_id", "left_semi").distinct()
    fit = cut(halves.orderBy(F.xxhash64("_id"), "_id").limit(most))
    fitted = plain.where("_half").join(F.broadcast(fit), "_id", "left_semi")  # at most ``most`` ids
    scored = cut(score(plain, train(fitted)).withColumn("_known", F.lit(True)))
    return scored, scored.join(ids, "_id", "left_semi").join(F.broadcast(fit.withColumn("_half", F.lit(True))), ["_id", "_half"], "left_anti")


def _marked(plain: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with _train, true where ``ids`` has the id.  Only rows that a Bloom filter of the ids lets through, these and a few more, move to be joined."""
    known = bloom(ids.select(F.xxhash64("_id").alias("key")))
    sent = plain.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(passes(sent.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    key = may(F.xxhash64("_id"))
    return plain.where(key).join(ids.withColumn("_train", F.lit(True)), "_id", "left").unionByName(plain.where(~key).withColumn("_train", F.lit(None).cast("boolean")))


def _crossed(plain: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of each half scored by a model of all trusted texts of the other, and those of trusted texts."""
    rows = _marked(plain, ids)
    scored = cross_scored(rows.withColumn("_trusted", F.col("_train")), plain.select("_text")).withColumnRenamed("known", "_known").drop("word_bits")
    return scored, scored.where("_known AND _trusted")


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", level: float = 0.99, most: int | None = None) -> DataFrame:
    """doc_id, n_tokens (words and an end), log10_prob, perplexity (per token), threshold, kept; ``trusted`` has the ids of trusted texts in its first column."""
    kind = docs.schema[id_col].dataType
    half = F.pmod(F.xxhash64(f"`{text_col}`"), F.lit(2)) == 0
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang"), half.alias("_half"))
    ids = cut(trusted.select(F.col(f"`{trusted.columns[0]}`").try_cast(kind).alias("_id")).where("_id IS NOT NULL").distinct())
    scored, unseen = _crossed(plain, ids) if most is None else _sampled(plain, ids, most)
    limits = cut(thresholds(unseen, level))
    every = limits.where("every").select(F.col("limit").alias("any"))
    joined = join_bounds(scored.withColumn("_l", F.col("_lang")).drop("_lang"), limits.where("NOT every").select("_lang", "limit"), "_l").join(F.broadcast(every), how="left")  # one row
    limit = F.coalesce("limit", "any")
    rate = F.col("bits") / F.col("n_tokens")
    return joined.select(F.col("_id").alias(id_col), "n_tokens", (-F.col("bits") * F.log10(F.lit(2.0))).alias("log10_prob"), F.pow(F.lit(2.0), rate).alias("perplexity"), F.pow(F.lit(2.0), limit).alias("threshold"), F.coalesce(F.col("_known") & (rate <= limit), F.lit(False)).alias("kept"))
