"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a hash; a source's rows below its threshold are taken once more
than the others.  Sizes are summed by source and hash bucket; only the bucket
in which the budget ends is refined, twice, so three small histograms find the
nested threshold and no row is sorted.  A row is taken whole or not at all each
time, so the words taken differ from the target by less than one row's size.

Targets: the sources share ``share`` times all sizes by weight.  A target stops
at ``most`` times its source's size, and what is cut off is shared again by
weight among the others, which ends at min(most * size, level * weight).

Defined results: null text has size 0; a null source is one source, the last;
the hash is of the id, or of the text where the id is null, so rows that repeat
an id are taken together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loxodrome.plans.lineage import cut

#: Hash bits of a level; three levels make nine hexadecimal digits.
_BITS = 12
OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weights(keyed: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """_k, source_size, target, base, budget of each source."""
    total = keyed.groupBy("_k").agg(F.sum("_size").alias("source_size"))
    every = Window.orderBy("_k")  # one row a source
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = total.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "_k")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - (F.sum("most").over(order) - F.col("most"))) / (F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w"))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "_k", "level"))
    ranked = ranked.withColumn("target", F.least("most", F.coalesce(F.min(fits).over(everything)["level"] * F.col("w"), "most")))
    base = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    return ranked.select("_k", "source_size", "target", base.alias("base"), (F.col("target") - base * F.col("source_size")).alias("budget"))


def _crossing(rows: DataFrame, bucket: Column, budgets: DataFrame) -> DataFrame:
    """_k, bucket in which the budget ends, what is below it, what is in it."""
    sums = rows.groupBy("_k", bucket.alias("bucket")).agg(F.sum("_size").alias("inside"))
    sums = sums.withColumn("upto", F.sum("inside").over(Window.partitionBy("_k").orderBy("bucket")))
    over = sums.join(budgets.select("_k", "budget"), "_k").where("upto > budget")
    first = over.groupBy("_k").agg(F.min(F.struct("bucket", "upto", "inside")).alias("x"))
    return first.select("_k", F.col("x.bucket").alias("bucket"), (F.col("x.upto") - F.col("x.inside")).alias("below"), F.col("x.inside").alias("inside"))


def salted(rows: DataFrame, small: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with one line a source, which stands once for each salt: a large source meets it in many tasks."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts).cast("long"))).join(many, ["_k", "_salt"], how).drop("_salt")


def thresholds(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """_k, source_size, target, base, limit: rows with a hash below limit are taken once more."""
    budgets = cut(_weights(rows, weights, share, most))
    limit, left = None, budgets
    for level in range(3):
        shift = 2 * _BITS - level * _BITS
        inner = rows if level == 0 else salted(rows, limit.select("_k", "bucket")).where(F.shiftright("_h", shift + _BITS) == F.col("bucket")).drop("bucket")
        limit = cut(_crossing(inner, F.shiftright("_h", shift), left))
        left = left.join(limit.select("_k", "below"), "_k").select("_k", (F.col("budget") - F.col("below")).alias("budget"))
    last = limit.select("_k", "bucket", "inside").join(left, "_k")
    nearer = F.col("inside") - F.col("budget") < F.col("budget")
    last = last.select("_k", (F.col("bucket") + nearer.cast("long")).alias("limit"))
    return budgets.drop("budget").join(last, "_k", "left").withColumn("limit", F.coalesce("limit", F.lit(0)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """The columns of ``docs`` (those named as below are replaced), and size, source_size, target, copies (times the mix takes the row), taken."""
    key = F.when(F.col(f"`{source_col}`").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(f"`{source_col}`").cast("string")))
    text = F.col(f"`{text_col}`")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("~"), F.coalesce(text, F.lit(""))))), 1, 9), 16, 10).cast("long")
    marked = docs.select(F.struct("*").alias("_row"), key.alias("_k"), hashed.alias("_h"), word_count(text).alias("_size"))
    found = thresholds(cut(marked.select("_k", "_h", "_size")), weights, share, most)
    copies = F.col("base") + (F.col("_h") < F.col("limit")).cast("long")
    joined = salted(marked, found).withColumn("copies", copies)
    return joined.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in OUT], F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"))
