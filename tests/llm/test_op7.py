import random
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loxodrome.llm import blocks as B
from loxodrome.llm import suffix_dedup
from loxodrome.llm.suffix_dedup import remove_repeats

from .helpers import SCHEMA, corpus


def brute(rows, n):
    count = {}
    for _, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - n + 1):
            count[b[i : i + n]] = count.get(b[i : i + n], 0) + 1
    out = []
    for d, text, *_ in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def check(spark, rows, n):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) for r in remove_repeats(docs, length=n).collect()]
    assert sorted(got, key=str) == brute(rows, n)


def test_matches_brute_force(spark):
    for n in (200, 40, 7, 2):
        check(spark, corpus(seed=n), n)


def test_periodic_and_mixed_contexts(spark):
    r = random.Random(1)
    parts = ["".join(r.choice("ab") for _ in range(50)) for _ in range(6)]
    rows = [(i, "".join(r.choice(parts)[r.randrange(20) :] for _ in range(r.randrange(8))), None, None, 0) for i in range(150)]
    rows += [(900, "ab" * 300, None, None, 0), (901, "a" * 120, None, None, 0), (902, "a" * 10, None, None, 0)]
    for n in (30, 64):
        check(spark, rows, n)


def test_hot_passage_in_varying_contexts(spark):
    r = random.Random(2)

    def letters(n):
        return "".join(r.choice("abcdefgh   ") for _ in range(n))

    passage = letters(90)
    rows = [(i, letters(r.randrange(70)) + passage + letters(r.randrange(70)), None, None, 0) for i in range(120)]
    check(spark, rows, 60)
    check(spark, rows, 61)


def test_tokens_without_white_space(spark):
    r = random.Random(3)
    wide = "".join(r.choice("漢字仮名交文章漢漢") for _ in range(300))
    code = "".join(r.choice("0123456789abcdef") for _ in range(400))
    rows = [(i, r.choice([wide, code, " a \n\t  b" * 20])[r.randrange(60) :] + r.choice(["", " x", "é", "漢"]) + code[: r.randrange(300)], None, None, 0) for i in range(60)]
    for n in (50, 3, 120):
        check(spark, rows, n)


def test_a_hot_passage_is_one_entry_a_block_in_every_pass():
    """No key is sent once a document, and the runs that reach out of the passage spread over all buckets."""
    r = random.Random(4)
    passage = "".join(r.choice("abcdef ") for _ in range(260))
    texts = ["".join(r.choice("ghijkl ") for _ in range(300)) + passage + "".join(r.choice("mnopqr ") for _ in range(300)) for _ in range(600)]
    docs = [pa.table({"_text": texts[i::3]}) for i in range(3)]
    answers = [B.no_answers() for _ in docs]
    passes = [
        (suffix_dedup._first_pass, partial(B.elsewhere, phase=1, unpack=suffix_dedup._long), suffix_dedup._long),
        (suffix_dedup._second_pass, suffix_dedup._second_answer, B.whole),
        (suffix_dedup._third_pass, suffix_dedup._third_answer, suffix_dedup._long),
    ]
    for ask, answer, unpack in passes:
        asks = pa.concat_tables([ask(i, d, a, length=200, buckets=16) for i, (d, a) in enumerate(zip(docs, answers, strict=True))])
        load = []
        for b in range(16):
            mine = asks.filter(pc.equal(asks["bkt"], b))
            _, keys, _ = B.asked(mine, unpack)
            load.append(len(keys))
            assert np.unique(keys, return_counts=True)[1].max(initial=0) <= len(docs)
            got = answer(b, mine)
            answers = [pa.concat_tables([a, got.filter(pc.equal(got["blk"], i))]) for i, a in enumerate(answers)]
        assert max(load) <= 2 * np.mean(load) + 16


def test_long_text_in_its_own_stretch(spark, monkeypatch):
    check(spark, [(1, "abc" * 400_000 + "xyz" * 9, None, None, 0), (2, "q" + "abc" * 5, None, None, 0)], 14)
    assert suffix_dedup._STRETCH < 1_200_000


def test_empty_table_and_other_columns(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    got = remove_repeats(spark.createDataFrame([(1, "aaaa", "x")], "doc_id long, text string, _text string"), length=2).first()
    assert (got["_text"], got.n_removed, [tuple(s) for s in got.spans]) == ("x", 4, [(0, 4)])


def test_ids_of_any_type(spark):
    rows = [("a", "x" * 30), ("b", "y" + "x" * 30), (None, None)]
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), length=20).collect()}
    assert got == {"a": 30, "b": 30, None: 0}
