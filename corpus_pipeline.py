"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's docs.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loxodrome.llm.mixing import mix
from loxodrome.llm.packing import pack_documents
from loxodrome.llm.quality_rules import quality_rules
from loxodrome.llm.simhash import one_of_each
from loxodrome.llm.substring_dedup import dedup_substrings
from loxodrome.plans.lineage import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the quality rules reject go."""
    return quality_rules(docs.select(*COLUMNS), model="words").where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 on shingles of five words: one document of each group stays.

    A link needs shingle sets that overlap by 0.8 (Jaccard).  Candidates are
    fingerprints of 256 bits of which 64 may differ: sets that overlap by 0.8
    differ in 39 on average, with a deviation of 6 to 7.
    """
    return one_of_each(docs.select(*COLUMNS), size=5, words=4, radius=64, keys=8, share=(4, 5)).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: passages of 13 words or more that an earlier document has go; a document that loses all its words goes."""
    found = dedup_substrings(docs.select(*COLUMNS), window=13).where("n_removed < n_words OR n_words = 0")
    return found.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as the mix takes it."""
    found = mix(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, most=2).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end=1).drop("ids")


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Perplexities, fingerprints and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``.  A stage's table is removed once the next one's is written; the last one's stays for the result."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return docs
