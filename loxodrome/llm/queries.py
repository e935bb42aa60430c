"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import compare_edits
from .license_scan import scan_licenses
from .lm_scoring import score_texts
from .mixing import mix
from .packing import pack_documents
from .quality_classifier import classify
from .quality_rules import quality_rules
from .simhash import near_groups
from .substring_dedup import dedup_substrings
from .suffix_dedup import remove_repeats


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1).drop("ids")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return classify(documents(spark, sf_dir), trusted)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir), size=3, words=1, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("print")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir).select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, most=2)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), columns=["doc_id"], model="words")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
earliest AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM win JOIN earliest USING (k) WHERE m < doc_id), (SELECT unnest(range(13)) AS j)),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || coalesce(text, ''))), 1, 9) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][i % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS most FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(w) OVER () - sum(w) OVER o + w) AS level, most / w AS ratio
    FROM w WINDOW o AS (ORDER BY most / w, source NULLS LAST)),
t AS (SELECT *, least(most, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * w, most)) AS target FROM l),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(d.size) OVER (PARTITION BY d.source, h) AS inside FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source AS s, min(h) AS h0 FROM c WHERE upto > budget GROUP BY source)
SELECT doc_id, size, source_size, target, size * (base + CASE WHEN h < h0 OR (h = h0 AND upto - budget < budget - (upto - inside)) THEN 1 ELSE 0 END) AS taken
FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_simhash": op9_simhash,
    "op10_quality_rules": op10_quality_rules,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op5_mixing": OP5_SQL,
}
