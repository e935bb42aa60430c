import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from loxodrome.llm.fingerprints import canonical, compare_edits, digest_groups, fingerprints, range_count, with_group, with_next

from .helpers import SCHEMA, corpus


def form(text):
    t = unicodedata.normalize("NFKC", text or "")
    t = unicodedata.normalize("NFKC", t.casefold())
    return re.sub(r"\s+", " ", t).strip(" ")


def test_canonical_form(spark):
    same = ["Café  au\nlait", "café au lait", " CAFÉ AU　LAIT ", "ｃａｆé au lait", "ﬁ", "FI", "Straße", "STRASSE", "㎏", "kg", "é" * 3, ""]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(same)], "i int, t string").orderBy("i").select(canonical(F.col("t"))).collect()]
    assert got == [form(t) for t in same]
    assert len(set(got[:4])) == 1 and got[4] == got[5] and got[6] == got[7] and got[8] == got[9]


def check(spark, rows):
    got = compare_edits(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    order = sorted(rows, key=lambda r: r[1] or "", reverse=True)
    order.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want, prints = [], {}
    for i, (d, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        h = len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), float(form(edited) == form(text)), float(form(after) == form(text))))
        prints.setdefault((d, len(text)), set()).add(form(text))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str)
    byprint = {}
    for r in got:
        assert len(r.fingerprint) == 32
        byprint.setdefault(r.fingerprint, set()).update(prints[r.doc_id, r.n_chars])
    assert len(byprint) == len({form(r[1]) for r in rows}) or any(len(v) > 1 for v in prints.values())


def test_matches_brute_force(spark):
    check(spark, corpus())
    check(spark, [(i, f"text {i // 2}", None, None, 0) for i in range(40)])
    check(spark, [(7, "One Row", None, None, 0)])


def test_groups(spark):
    rows = [(1, "A b"), (2, "a  B"), (3, "c"), (4, None), (5, ""), (5, "")]
    got = {r.doc_id: (r.fingerprint, r.n_copies) for r in fingerprints(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1] == got[2] and got[1][1] == 2 and got[3][1] == 1 and got[4] == got[5] and got[4][1] == 3


def test_empty_table(spark):
    assert compare_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_frequent_digests_meet_their_rows_in_many_tasks(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"d{i}", "f", i) for i in range(600)], "_digest string, _form string, n int").repartition(4)
    found = digest_groups(rows.select("_digest", "_form"))
    got = with_group(rows.drop("_form"), found, part=4)
    assert sorted((r.n, r.n_rows, r.n_forms) for r in got.collect()) == [(i, 400 if i % 3 else 1, 1) for i in range(600)]


def test_rows_without_ids_are_ranged_by_their_texts(spark):
    texts = [f"{chr(97 + i % 26)}{'é' * (i % 4)} {i}" for i in range(12_000)] + ["", "", "\x00"]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(5, "five"), (-7, "seven"), (5, "a")], "_id long, _text string")
    got = {(r["_id"], r["_text"]): r["_next"] for r in with_next(docs, 6).collect()}
    order = ["five", "a", "seven", *sorted(texts, key=str.encode, reverse=True)]
    ids = {"five": 5, "a": 5, "seven": -7}
    assert all(got[ids.get(t), t] == order[i + 1] for i, t in enumerate(order[:-2]) if t)


def test_ranges_follow_bytes():
    assert range_count(0, 8) == 8 and range_count(1 << 40, 8) == 32768 and range_count(1 << 50, 8) == 100_000


def test_ids_must_be_numbers(spark):
    with pytest.raises(ValueError):
        compare_edits(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
