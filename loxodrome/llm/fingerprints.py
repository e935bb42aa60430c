"""Canonical exact digests, with DataFrame functions only.

A text is brought to one form: Unicode NFKC, full case
folding, NFKC again, runs of white space to one space, ends trimmed.  Its digest
is two XXH64 values of that form under different seeds, 128 bits.  Rows are
grouped by digest and form, which compares the bytes inside equal buckets; if a
bucket ever holds two forms, their fingerprints get a part of their SHA-256.

The likeness of two fingerprints is that of exact digests: 1 if the forms are
equal, else 0.

Rows meet their digest's group in a join.  A digest of more than a thousandth of
all rows (there are at most a thousand such) meets its rows in as many tasks as
there are shuffle partitions, so a text that a third of all rows repeat fills
none.  Ranges of neighbouring ids are sized by bytes of text; rows without an id
are ranged by the first bytes of their texts.

Defined results: null text counts as empty; ids are numbers (others are
refused); rows follow each other by descending id (null last), then descending
text, repeated rows each for itself; a table of one row follows itself; an empty
table gives an empty one.  A text of any length is handled whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loxodrome.plans.lineage import cut

#: White space beyond ASCII, as in Unicode's White_Space.
_SPACE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _icu(name: str, method: str, text: Column) -> Column:
    """A function of the ICU library that Spark itself ships."""
    return F.java_method(F.lit(f"com.ibm.icu.{name}"), F.lit(method), text, F.lit(True))


def _compose(text: Column) -> Column:
    """NFKC."""
    return _icu("text.Normalizer", "compose", text)


def canonical(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    folded = _compose(_icu("lang.UCharacter", "foldCase", _compose(whole)))
    one_case = F.when(whole.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(whole))
    return F.btrim(F.regexp_replace(one_case, _SPACE, " "))


def digest(form: Column) -> Column:
    halves = (F.xxhash64(form), F.xxhash64(F.lit("wide"), form))
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def digest_groups(forms: DataFrame) -> DataFrame:
    """_digest, n_rows, n_forms of rows (_digest, _form); grouping by the form compares bytes."""
    return forms.groupBy("_digest", "_form").agg(F.count("*").alias("n")).groupBy("_digest").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms"))


def with_group(rows: DataFrame, found: DataFrame, *, part: int = 1000) -> DataFrame:
    """``rows`` (with _digest) and n_rows, n_forms of their digest; ``found`` has one line a digest."""
    found = cut(found)
    total = found.agg(F.sum("n_rows")).first()[0] or 0
    frequent = F.broadcast(cut(found.where(F.col("n_rows") * part > total).select("_digest", F.lit(True).alias("_many"))))  # fewer than ``part`` rows
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(salts)).cast("int")
    mine = rows.join(frequent, "_digest", "left").withColumn("_salt", F.when(F.col("_many"), salt).otherwise(0)).drop("_many")
    every = F.when(F.col("_many"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return mine.join(found.join(frequent, "_digest", "left").withColumn("_salt", F.explode(every)).drop("_many"), ["_digest", "_salt"]).drop("_salt")


def fingerprints(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, and fingerprint, n_copies (rows with the same form); columns of these names are replaced."""
    formed = docs.select(F.struct("*").alias("_row"), canonical(F.col(f"`{text_col}`")).alias("_form"))
    formed = formed.withColumn("_digest", digest(F.col("_form")))
    found = digest_groups(formed.select("_digest", "_form"))
    named = F.when(F.col("n_forms") > 1, F.concat("_digest", F.lit("-"), F.substring(F.sha2("_form", 256), 1, 16))).otherwise(F.col("_digest"))
    return with_group(formed, found).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("fingerprint", "n_copies")], named.alias("fingerprint"), F.col("n_rows").alias("n_copies"))


def _rank(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above the value, by a search in two steps; the cuts are one constant of the plan."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    fine = [cuts[i : i + step] for i in range(0, len(cuts), step)]

    def upto(array: Column) -> Column:
        return F.size(F.filter(array, lambda x: x <= value))

    heads = F.from_json(F.lit(json.dumps([part[0] for part in fine])), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps(fine)), "array<array<bigint>>")
    part = upto(heads)
    return F.when(part == 0, 0).otherwise((part - 1) * step + upto(F.element_at(parts, F.greatest(part, F.lit(1)))))


def _cuts(rows: DataFrame, value: Column, parts: int) -> list[int]:
    """At most parts - 1 numbers that cut the rows into about equal parts."""
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted({int(x) for x in found or []})


def range_count(bytes_: int, least: int, each: int = 32 << 20, most: int = 100_000) -> int:
    """Ranges of about ``each`` bytes; ``least`` if that makes more."""
    return min(most, max(least, -(-bytes_ // each)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """_id, _text, and _next: the text of the next row by descending id; after the last, the first's.

    Rows are dealt once, into ranges of ids; a range's last row gets the first
    text of the next range.  What is broadcast has one row a range.
    """
    lone = docs.where("_id IS NULL")
    without = lone.count()
    # Seven bytes make a number that is in order of the texts.
    head = F.coalesce(F.conv(F.hex(F.rpad(F.substring(F.col("_text").cast("binary"), 1, 7), 7, F.lit(b"\x00"))), 16, 10).cast("long"), F.lit(0).cast("long"))
    null_cuts = _cuts(lone, head, parts) if without > 10_000 else []
    whole = F.floor("_id").cast("long")
    ids = _rank(whole, _cuts(docs, whole, parts))
    ranged = docs.withColumn("_range", F.when(F.col("_id").isNull(), _rank(head, null_cuts) - (len(null_cuts) + 1)).otherwise(ids))
    heads = cut(ranged.groupBy("_range").agg(F.max("_id").alias("_head")))
    every = Window.orderBy(F.desc("_range"))  # one row a range
    after = heads.select("_range", F.coalesce(F.lead("_range").over(every), F.max("_range").over(Window.partitionBy())).alias("_after"))
    firsts = ranged.join(F.broadcast(heads), "_range").where(F.col("_id").eqNullSafe(F.col("_head"))).groupBy(F.col("_range").alias("_after")).agg(F.max("_text").alias("_first"))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last("_id"), F.desc("_text"))
    led = ranged.withColumn("_lead", F.lead("_text").over(order))
    return led.join(after.join(firsts, "_after").select("_range", "_first"), "_range", "left").select("_id", "_text", F.coalesce("_lead", "_first").alias("_next"))


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, whose second half is the beginning of the next row's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_copies.
    """
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        raise ValueError("ids must be numbers")
    plain = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    size = plain.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = range_count(size, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = digest_groups(plain.select(canonical(F.col("_text")).alias("_form")).select(digest(F.col("_form")).alias("_digest"), "_form"))
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(plain, parts).withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half)))
    formed = pairs.select("_id", n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(f"_form{c}") for c in ("_text", "_edited", "_next")])
    lines = formed.select(
        F.col("_id"), "n_chars", "edited_sha256", digest(F.col("_form_text")).alias("_digest"), digest(F.col("_form_edited")).alias("_edited_digest"),
        *[(F.col("_form_text") == F.col(f"_form{c}")).cast("double").alias(f"near{c}") for c in ("_edited", "_next")], F.substring(F.sha2("_form_text", 256), 1, 16).alias("_more"),
    )
    named = F.when(F.col("n_forms") > 1, F.concat("_digest", F.lit("-"), "_more")).otherwise(F.col("_digest"))
    edited = F.when(F.col("near_edited") == 1, named).otherwise(F.col("_edited_digest"))
    return with_group(lines, found).select(F.col("_id").alias(id_col), "n_chars", "edited_sha256", named.alias("fingerprint"), edited.alias("edited_fingerprint"), "near_edited", "near_next", F.col("n_rows").alias("n_copies"))
