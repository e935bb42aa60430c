"""Columns that bear the operators' own names pass through, or are replaced where the docstring says so."""

from pyspark.sql import functions as F

from loxodrome.llm.fingerprints import compare_edits, fingerprints
from loxodrome.llm.license_scan import scan_licenses
from loxodrome.llm.lm_scoring import score_texts
from loxodrome.llm.mixing import mix
from loxodrome.llm.packing import pack_documents
from loxodrome.llm.quality_classifier import classify
from loxodrome.llm.quality_rules import quality_rules
from loxodrome.llm.simhash import near_groups, one_of_each
from loxodrome.llm.substring_dedup import dedup_substrings
from loxodrome.llm.suffix_dedup import remove_repeats

NAMES = ("_row", "_k", "_h", "_size", "_salt", "_key", "_own", "_stay", "_id", "_text", "_form", "_digest", "blk", "kept", "n_words", "print", "least", "copies", "bits", "_c0", "_lang", "held_out", "value", "base", "limit", "target")


def test_clashing_names(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b c " * 30, "en", "s"), (2, "d e f " * 30, "fr", None), (1, "a b c " * 30, "en", "s")], "doc_id int, text string, lang string, source string")
    docs = docs.withColumns({n: F.lit(f"own {n}") for n in NAMES})
    for made in (fingerprints(docs), mix(docs), quality_rules(docs), dedup_substrings(docs), remove_repeats(docs), one_of_each(docs, size=5, words=4, radius=48, keys=8)):
        rows = made.collect()
        passed = [n for n in NAMES if n in made.columns]
        assert rows and len(set(made.columns)) == len(made.columns) and {r.doc_id for r in rows} == {1, 2}
        assert all(r[n] == f"own {n}" for r in rows for n in passed if n not in ("kept", "n_words", "copies", "bits", "target"))
    assert near_groups(docs).count() == scan_licenses(docs).count() == score_texts(docs).count() == compare_edits(docs).count() == classify(docs, docs.select("doc_id")).count() == 3
    assert pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() >= 3
