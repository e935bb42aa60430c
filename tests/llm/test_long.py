"""Texts of megabytes: longer than any slice, stretch or batch that the operators work in."""

import random
import zlib

from loxodrome.llm.fingerprints import compare_edits
from loxodrome.llm.license_scan import scan_licenses
from loxodrome.llm.lm_scoring import score_texts
from loxodrome.llm.mixing import mix
from loxodrome.llm.packing import pack_documents
from loxodrome.llm.quality_classifier import classify
from loxodrome.llm.quality_rules import quality_rules
from loxodrome.llm.simhash import near_groups
from loxodrome.llm.substring_dedup import dedup_substrings
from loxodrome.llm.suffix_dedup import remove_repeats

from .helpers import SCHEMA


def test_texts_of_megabytes(spark):
    import public_tokenizers

    r = random.Random(3)
    words = [f"{r.choice('bdfgklm')}{r.choice('aeiou')}{r.randrange(50_000)}" for _ in range(300_000)]
    long, n = " ".join(words), len(words)
    assert len(long) > 2 << 20
    rows = [(1, long, "en", "a", len(long)), (2, long.upper(), "en", "b", len(long)), (3, "the mit license", "en", "a", 15), (4, long, "en", "a", len(long)), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)

    def found(df, *columns):
        return {x.doc_id: tuple(x[c] for c in columns) if len(columns) > 1 else x[columns[0]] for x in df.collect()}

    assert found(dedup_substrings(docs), "n_words", "n_removed") == {1: (n, 0), 2: (n, 0), 3: (3, 0), 4: (n, n), 5: (0, 0)}
    scored = found(score_texts(docs), "n_tokens", "held_out")
    assert scored == {d: (k + 1, zlib.crc32(str(d).encode()) % 5 == 1) for d, k in ((1, n), (2, n), (3, 3), (4, n), (5, 0))}
    assert found(scan_licenses(docs), "n_words", "base_labels") == {1: (n, ""), 2: (n, ""), 3: (3, "mit"), 4: (n, ""), 5: (0, "")}
    prints = found(compare_edits(docs), "fingerprint", "n_chars")
    assert prints[1] == prints[2] == prints[4] and prints[1][1] == len(long) and prints[5][1] == 0
    assert found(mix(docs), "size") == {1: n, 2: n, 3: 3, 4: n, 5: 0}
    pieces = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {d: sum(p.length for p in pieces if p.doc_id == d) for d in range(1, 6)} == {p.doc_id: p.doc_tokens for p in pieces}
    removed = found(remove_repeats(docs), "n_removed")
    assert removed == {1: len(long), 2: 0, 3: 0, 4: len(long), 5: 0}
    assert found(classify(docs, docs.select("doc_id")), "n_tokens") == {1: n + 1, 2: n + 1, 3: 4, 4: n + 1, 5: 1}
    assert found(near_groups(docs), "component_id") == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}
    assert found(quality_rules(docs, columns=["doc_id"]), "n_words", "base_failed") == {1: (n, False), 2: (n, False), 3: (3, True), 4: (n, False), 5: (0, True)}
