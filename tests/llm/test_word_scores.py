"""Word models of the other half, against dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from loxodrome.llm import word_ngrams, word_scores
from loxodrome.llm.blocks import mix
from loxodrome.llm.quality_rules import measure_words
from loxodrome.llm.quality_rules import quality_rules as rules

from .helpers import SCHEMA, words
from .test_lm import SlowWords, base, lower, quality_rows, trigrams


def half(text):
    h = [np.array([xxhash.xxh64_intdigest(x) % 2**48], np.uint64) for x in words(lower((text or "").encode()).decode())]
    x = [np.array([1], np.uint64)] * 2 + h + [np.array([2], np.uint64)]
    return int(mix(min(word_ngrams.key(*x[i : i + 3]) for i in range(len(x) - 2)))[0]) % 2 == 0


def test_arrays_come_back():
    arrays = [np.arange(7, dtype=np.uint64) << np.uint64(50), np.zeros(0, np.uint32), np.array([1, 2, 1], np.uint32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, word_scores.unpack(word_scores.pack(*arrays)), strict=True))
    c = word_scores.coded(*word_scores.tokens(pa.array(["a B", "", "b"])))
    assert c.w.tolist() == [2, 3, 1, 1, 3, 1] and c.v.tolist() == [0, 2, 3, 0, 0, 3] and c.u.tolist() == [0, 0, 2, 0, 0, 0] and c.at.tolist() == [0, 3, 4, 6]


def test_rules_match_dictionaries_of_words(spark, monkeypatch):
    """Counts come together from several blocks and buckets, copies and null texts included."""
    monkeypatch.setattr(word_scores, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(word_scores, "BUCKET_BYTES", 10_000)
    rows = quality_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    models = {h: SlowWords([t or "" for _, t, *_ in rows if half(t) == h and not base(t)[-1]]) for h in (True, False)}
    lowest = lambda m, t: (lambda g: sum(-math.log2(m.p(x[2:])) for x in g) / len(g))(trigrams(t))
    want = sorted(((d, lang, *base(t), models[not half(t)].bits(t), lowest(models[not half(t)], t)) for d, t, lang, *_ in rows), key=str)
    got = sorted((tuple(r) for r in measure_words(docs, ["doc_id", "lang"]).collect()), key=str)
    assert [x[:8] for x in got] == [x[:8] for x in want]
    assert np.allclose([x[8:] for x in got], [x[8:] for x in want], rtol=1e-9)
    edge = {}
    for lang in {x[1] for x in want}:
        for i in (8, 9):
            bins = sorted(math.floor(x[i] * 1000) for x in got if x[1] == lang and not x[7])
            q1, q3 = bins[math.ceil(len(bins) / 4) - 1], bins[math.ceil(len(bins) * 3 / 4) - 1]
            reach = max(0.5 * (q3 - q1), 60)
            edge[lang, i] = ((q1 - reach) / 1000, (q3 + 1 + reach) / 1000)
    kept = [not x[7] and x[8] <= edge[x[1], 8][1] and x[9] >= edge[x[1], 9][0] for x in got]
    assert {k for k, x in zip(kept, got, strict=True) if not x[7]} == {True, False}
    found = rules(docs, columns=["doc_id", "lang"], widen=0.5, least=0.01, model="words").collect()
    assert sorted(((r.doc_id, r.lang, r.n_words, r.kept) for r in found), key=str) == sorted(((x[0], x[1], x[2], k) for x, k in zip(got, kept, strict=True)), key=str)


def test_shuffled_words_are_rejected(spark):
    """Of the same symbols in other order; classes of symbols don't tell them."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(1000)]
    follow = {w: r.sample(vocabulary, 4) for w in vocabulary}

    def text():
        out = [r.choice(vocabulary)]
        while len(out) < 150:
            out.append(r.choice(follow[out[-1]]))
        return out

    good = [text() for _ in range(120)]
    salad = [r.sample(x, len(x)) for x in (text() for _ in range(6))]
    rows = [(i, " ".join(x), "en", "a", 1) for i, x in enumerate([*good, *salad])]
    assert not any(base(t)[-1] for _, t, *_ in rows)
    got = {x.doc_id: x.kept for x in rules(spark.createDataFrame(rows, SCHEMA), columns=["doc_id"], model="words").collect()}
    assert [got[i] for i in range(120, 126)] == [False] * 6 and Counter(got[i] for i in range(120))[True] > 110


def test_without_a_model_plain_rules_decide(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (2, text, "en", "a", 1), (3, "x", "en", "a", 1)], SCHEMA)
    got = {r.doc_id: (r.kept, r.bits if r.doc_id < 3 else None) for r in rules(docs, columns=["doc_id"], model="words").collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None)}
    assert rules(spark.createDataFrame([], SCHEMA), model="words").collect() == []


def test_owners_count_each_ngram_once():
    """A trigram that several blocks have adds one word before its bigram, by one block; what blocks ask for takes few bytes a word."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(r.choices(vocabulary, [1 / (i + 1) for i in range(3000)], k=300)) for _ in range(400)]
    blocks = []
    for number, some in enumerate((texts[:250], texts[150:], texts[:50])):
        words_ = word_scores.tokens(pa.array(some))
        body = word_scores.chosen(*words_, np.ones(len(some), bool), np.arange(len(some)) != 0)
        blocks.append(pa.RecordBatch.from_arrays([pa.array([number]), pa.array([number == 2]), pa.array([body], pa.binary()), pa.array([b""], pa.binary())], names=["blk", "half", "body", "docs"]))
    run = lambda table, sums: pa.concat_tables([sums(b, table.filter(pa.compute.equal(table["bkt"], b))) for b in range(4)])
    asks = pa.Table.from_batches(list(word_scores._ask_triples(iter(blocks), buckets=4, low=0, high=4)))
    answers = run(asks, word_scores._sum_triples)
    of = lambda found, role, blk: found.filter(pa.compute.and_(pa.compute.equal(found["role"], role), pa.compute.equal(found["blk"], blk)))
    owned = [word_scores._owned(pa.Table.from_batches([b]), of(answers, word_scores._OWN, i), buckets=4).combine_chunks() for i, b in enumerate(blocks)]
    pairs = pa.Table.from_batches(list(word_scores._ask_pairs(iter([x.to_batches()[0] for x in owned]), buckets=4, low=0, high=4)))
    twos = run(pairs, word_scores._sum_pairs)
    taught = {tuple(x) for t in [*texts[1:250], *texts[151:]] for x in trigrams(t)}
    left, before = Counter(x[1:] for x in taught), Counter(w for _, w in {x[1:] for x in taught})
    mine = np.concatenate([word_scores.unpack(b)[0] for i in (0, 1) for b in of(twos, word_scores._MINE, i)["body"].to_pylist()])
    assert sorted(mine[mine > 0].tolist()) == sorted(left.values())
    words_ = pa.concat_tables([word_scores._ask_words(x, of(twos, word_scores._MINE, i), buckets=4, word_buckets=1) for i, x in enumerate(owned)])
    ones = [word_scores.unpack(b) for b, h in zip(words_["body"].to_pylist(), words_["half"].to_pylist(), strict=True) if not h]
    found = Counter()
    for steps, n, *_ in ones:
        found.update(dict(zip(np.cumsum(steps).tolist(), n.tolist(), strict=True)))
    assert sorted(n for n in found.values() if n) == sorted(before.values())
    tokens = sum(len(words(t)) + 1 for t in [*texts[:250], *texts[150:], *texts[:50]])
    assert (asks.nbytes + pairs.nbytes) / tokens < 9  # 8.1; 11.3 while words before bigrams went one by one, and words of each bucket


def test_only_what_may_be_trusted_is_joined(spark):
    from loxodrome.llm.quality_classifier import _marked

    docs = spark.createDataFrame([(i if i % 100 else None, f"t{i}") for i in range(2000)], "_id long, _text string")
    ids = spark.createDataFrame([(i,) for i in (*range(1, 40), 5000)], "_id long")
    marked = _marked(docs, ids)
    assert sorted((r._text, bool(r._train)) for r in marked.collect()) == sorted((f"t{i}", 0 < i < 40) for i in range(2000))
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "may(" in plan
