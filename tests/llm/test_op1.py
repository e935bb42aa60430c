import hashlib

import pytest

from loxodrome.llm.substring_dedup import dedup_substrings

from .helpers import SCHEMA, corpus, words


def brute(rows, n=13):
    big = 1 << 62
    first = {}
    for d, text, *_ in rows:
        w = words(text)
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (big if d is None else d):
                gone[i : i + n] = [True] * n
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for window, seed in ((13, 5), (4, 2), (3, 3), (5, 1)):
        got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256((r.kept_text or "").encode()).hexdigest()) for r in dedup_substrings(docs, window=window, seed=seed).collect()]
        assert sorted(got, key=str) == brute(rows, window)


def test_spans_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, "z a b c d y a b c", 8, "y")], "doc_id int, text string, n_words int, _id string")
    got = {r.doc_id: r for r in dedup_substrings(docs, window=3, seed=2).collect()}
    assert got[2].kept_text == "z y" and got[2]._id == "y" and got[2].n_words == 9
    assert [tuple(s) for s in got[2].spans] == [(1, 5), (6, 9)] and got[1].spans == []


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(ValueError):
        dedup_substrings(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))
