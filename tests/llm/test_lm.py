"""Operators 2, 8 and 10 against dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loxodrome.llm import blocks as B
from loxodrome.llm import filters, lm_scoring, ngrams, quality_rules
from loxodrome.llm.lm_scoring import score_texts
from loxodrome.llm.quality_classifier import classify
from loxodrome.llm.quality_rules import plain_counts
from loxodrome.llm.quality_rules import quality_rules as rules

from .helpers import SCHEMA, corpus, words


def lower(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


# --- Kneser-Ney


def contexts(text, order):
    x = [ngrams.START] * (order - 1) + [int(ngrams.CLASSES[b]) for b in text.encode()] + [ngrams.END]
    return [tuple(x[i : i + order]) for i in range(len(x) - order + 1)]


class Slow:
    def __init__(self, texts, order):
        self.counts = {order: Counter(g for t in texts for g in contexts(t, order))}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.order = order
        self.cut = {}
        for n, c in self.counts.items():
            m = Counter(c.values())
            self.cut[n] = ngrams.discounts(m[1], m[2], m[3], m[4])
        self.by = {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            for g, k in c.items():
                self.by[n][g[:-1]].append(k)

    def p(self, gram):
        if not gram:
            return 1 / ngrams.SYMBOLS
        n, below = len(gram), self.p(gram[1:])
        own = self.by[n].get(gram[:-1])
        if not own:
            return below
        c, total = self.counts[n].get(gram, 0), sum(own)
        return (c - self.cut[n][min(c, 3)]) / total + sum(self.cut[n][min(k, 3)] for k in own) / total * below

    def bits(self, text):
        g = contexts(text or "", self.order)
        return sum(-math.log2(self.p(x)) for x in g) / len(g)


def test_model_matches_dictionaries_and_sums_to_one(spark):
    texts = [t or "" for _, t, *_ in corpus()][:30]
    slow = Slow(texts, 4)
    keys = np.concatenate([k for _, k, _ in ngrams.class_grams(pa.array(texts), 4)])
    counted = spark.createDataFrame([(int(k), int(n)) for k, n in zip(*np.unique(keys, return_counts=True))], "gram long, n long")
    model = ngrams.fit(4, counted)
    assert model.nbytes() < quality_rules.MODEL_BYTES < 150 << 20
    wanted = [*slow.counts[4]][:200] + [(1, 2, 3, 4), (27, 0, 1, 63)]
    packed = np.array([((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in wanted], np.uint64)
    assert np.allclose(model.probabilities(packed), [slow.p(g) for g in wanted])
    for g in wanted[::20]:
        every = (packed[wanted.index(g)] >> np.uint64(6) << np.uint64(6)) + np.arange(64, dtype=np.uint64)
        assert abs(model.probabilities(every).sum() - 1) < 1e-6


# --- operator 10


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def quality_rows():
    rows = corpus(n=120)
    return rows + [(7000 + i, "a\nb \n\na\nb \n \n#*x|" * (i + 1) + " tail & <more> % $ " * i, "en", "a", 1) for i in range(20)] + [(8001, " ".join(f"q{i}!z{7 * i}?" for i in range(90)), "en", "a", 1)]


def test_plain_counts():
    texts = [t or "" for _, t, *_ in quality_rows()]
    got = plain_counts(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert list(zip(*[got[k].tolist() for k in names])) == [base(t) for t in texts]


def test_rules_match_dictionaries(spark):
    rows = quality_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rules(docs, columns=["doc_id"], widen=1.0, least=0.05).collect()
    model = Slow([t or "" for _, t, *_ in rows if not base(t)[-1]], quality_rules.ORDER)
    figures = [(d, lang, base(t), model.bits(t)) for d, t, lang, *_ in rows]
    band = {}
    for lang in {x[1] for x in figures}:
        bins = sorted(math.floor(x[3] * 1000) for x in figures if x[1] == lang and not x[2][-1])
        if bins:
            q1, q3 = bins[math.ceil(len(bins) / 4) - 1], bins[math.ceil(len(bins) * 3 / 4) - 1]
            reach = max((q3 - q1) * 1.0, 50)
            band[lang] = ((q1 - reach) / 1000, (q3 + 1 + reach) / 1000)
    want = sorted(((d, *b, bool(not b[-1] and lang in band and band[lang][0] <= bits <= band[lang][1])) for d, lang, b, bits in figures), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=str) == want
    assert any(x[-1] for x in want) and any(not x[-1] and not x[-2] for x in want)
    whole = rules(docs, widen=1.0, least=0.05).where("kept").select(*docs.columns).collect()
    assert sorted((r.doc_id for r in whole), key=str) == sorted((x[0] for x in want if x[-1]), key=str)


def test_bands_reject_what_lies_off_the_middle_half(spark, monkeypatch):
    bits = [*(2 + i / 1000 for i in range(101)), 1.88, 2.22]  # the middle half is 0.05 wide
    figures = spark.createDataFrame([("en", i, 60, 300, 0, 0, 0, False, b) for i, b in enumerate(bits)], "_c0 string, _c1 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bits double")
    monkeypatch.setattr(quality_rules, "train", lambda *_: None)
    monkeypatch.setattr(quality_rules, "measure", lambda *_: figures)
    got = rules(spark.createDataFrame([], SCHEMA), columns=["doc_id"]).collect()
    assert {r.doc_id for r in got if not r.kept} == {101, 102} and len(got) == len(bits)


# --- operator 8


def trigrams(text):
    x = ["<s>", "<s>", *words(lower((text or "").encode()).decode()), "</s>"]
    return [tuple(x[i : i + 3]) for i in range(len(x) - 2)]


class SlowWords:
    """Interpolated modified Kneser-Ney of word trigrams, by dictionaries."""

    def __init__(self, texts):
        self.counts = {3: Counter(g for t in texts for g in trigrams(t))}
        for n in (2, 1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.cut, self.by = {}, {n: defaultdict(list) for n in self.counts}
        for n, c in self.counts.items():
            m = Counter(c.values())
            self.cut[n] = ngrams.discounts(m[1], m[2], m[3], m[4])
            for g, k in c.items():
                self.by[n][g[:-1]].append(k)

    def p(self, gram):
        if not gram:
            return 1 / (len(self.counts[1]) + 1)
        n, below = len(gram), self.p(gram[1:])
        own = self.by[n].get(gram[:-1])
        if not own:
            return below
        c, total = self.counts[n].get(gram, 0), sum(own)
        return (c - self.cut[n][min(c, 3)]) / total + sum(self.cut[n][min(k, 3)] for k in own) / total * below

    def bits(self, text):
        g = trigrams(text)
        return sum(-math.log2(self.p(x)) for x in g) / len(g)


def classified(spark, rows, trusted, level, most):
    """By dictionaries: (id, bits a token, limit) of each row."""
    docs = spark.createDataFrame(rows, SCHEMA)
    even = {r.doc_id: r.even for r in docs.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("even")).collect()}
    ids = spark.createDataFrame([(x,) for x in trusted], "doc_id long")
    order = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    fit = [i for i in order if even.get(i)][:most]
    text = {d: t for d, t, *_ in rows}
    model = SlowWords([text[i] for i in fit])
    bins = defaultdict(list)
    for d, t, lang, *_ in rows:
        if d in trusted and d not in fit:
            for key in (lang, "every"):
                bins[key].append(math.floor(model.bits(t) * 1000))
    limit = {k: (sorted(x)[math.ceil(len(x) * level) - 1] + 1) / 1000 for k, x in bins.items()}
    return [(d, model.bits(t), limit.get(lang, limit.get("every"))) for d, t, lang, *_ in rows], fit


def test_classifier_matches_dictionaries(spark):
    r = random.Random(4)
    kinds = {"en": "abcdefgh", "fr": "mnopqrst", "de": "uvwxyz", None: "ij"}
    vocabulary = {k: ["".join(r.choice(v) for _ in range(r.randint(2, 5))) for _ in range(40)] for k, v in kinds.items()}
    text = lambda lang: " ".join(r.choice(vocabulary[lang]) for _ in range(r.choice([0, 1, 5, 40, 90])))
    rows = [(i, text(lang), lang, "a", 1) for i, lang in enumerate(["en"] * 60 + ["fr"] * 30 + ["de"] * 6 + [None] * 4)]
    rows += [(200 + i, rows[7][1], "en", "a", 1) for i in range(3)] + [(300, None, "en", "a", 1), (None, "ab \tcd", "fr", "a", 1), (301, " ".join(vocabulary["en"] * 200), "en", "a", 1)]
    trusted = [i for i in range(90) if i % 3] + [200, 300]  # none of the third language
    want, fit = classified(spark, rows, trusted, 0.9, 20)
    assert len(fit) == 20
    got = classify(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(str(x),) for x in [*trusted, "none"]], "id string"), level=0.9, most=20).collect()
    a, b = sorted(want, key=lambda x: (str(x[0]), x[1])), sorted(((x.doc_id, math.log2(x.perplexity), math.log2(x.threshold), x) for x in got), key=lambda x: (str(x[0]), x[1]))
    assert [x[0] for x in a] == [x[0] for x in b]
    assert np.allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-5)
    assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=0.0011)
    assert all(x[3].kept == (x[1] <= x[2] + 1e-9) for x in b) and {x[3].kept for x in b} == {True, False}
    assert all(abs(x.log10_prob / x.n_tokens + math.log10(x.perplexity)) < 1e-6 for x in got)


def test_all_trusted_texts_are_in_a_model_and_in_a_threshold(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdef") for _ in range(r.randint(2, 4))) for _ in range(30)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 8, 30]))), "en" if i % 3 else "fr", "a", 1) for i in range(80)] + [(100, None, "en", "a", 1)]
    rows += [(101, rows[4][1], "en", "a", 1), (102, rows[5][1], "fr", "a", 1)]
    trusted = [*range(0, 60), 101]
    docs = spark.createDataFrame(rows, SCHEMA)
    half = {x.doc_id: x.half for x in docs.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(2)) == 0).alias("half")).collect()}
    models = {h: SlowWords([t for d, t, *_ in rows if d in trusted and half[d] == h]) for h in (True, False)}
    bits = {d: models[not half[d]].bits(t) for d, t, *_ in rows}
    limit = {}
    for lang in ("en", "fr"):
        own = sorted(math.floor(bits[d] * 1000) for d, _, x, *_ in rows if x == lang and d in trusted)
        limit[lang] = (own[math.ceil(len(own) * 0.9) - 1] + 1) / 1000
    got = {x.doc_id: x for x in classify(docs.repartition(3), spark.createDataFrame([(x,) for x in trusted], "id long"), level=0.9).collect()}
    assert len(got) == len(rows) and {x.kept for x in got.values()} == {True, False}
    for d, _, lang, *_ in rows:
        assert abs(math.log2(got[d].perplexity) - bits[d]) < 1e-4 * max(bits[d], 1) and abs(math.log2(got[d].threshold) - limit[lang]) < 0.0011


def test_a_model_without_texts_and_ids_of_text(spark):
    docs = spark.createDataFrame([("a", "x y", "en"), (None, None, None)], "doc_id string, text string, lang string")
    assert [x.kept for x in classify(docs, spark.createDataFrame([], "doc_id long")).collect()] == [False, False]
    same = spark.createDataFrame([(f"d{i}", "x y z", "en") for i in range(6)], "doc_id string, text string, lang string")
    assert len(classify(same, same.select("doc_id")).collect()) == 6


def test_the_filter_holds_all_it_was_given(spark):
    keys = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = spark.createDataFrame([(2 + i % 2, int(k)) for i, k in enumerate(keys.view(np.int64))], "words int, key long")
    body = filters.bloom(rows)
    assert filters.passes(body, keys).all()
    assert filters.passes(body, keys + np.uint64(12345)).mean() < 0.1


# --- operator 2


class SlowTrie:
    def __init__(self, texts):
        self.seen = {o: defaultdict(Counter) for o in range(6)}
        for t in texts:
            x = bytes([254] * 5) + lower(t.encode()) + bytes([255])
            for i in range(5, len(x)):
                for o in range(6):
                    self.seen[o][x[i - o : i]][x[i]] += 1

    def p(self, context, symbol):
        chance, out = 1.0, set()
        for o in range(5, -1, -1):
            c = self.seen[o].get(context[5 - o :])
            if c is None:
                continue
            left = {s: n for s, n in c.items() if s not in out}
            room = 2 * sum(left.values())
            if symbol in left:
                return chance * (2 * left[symbol] - 1) / room
            if room:
                chance *= len(left) / room
            out |= set(c)
        return chance / (255 - len(out))

    def log10(self, text):
        x = bytes([254] * 5) + lower((text or "").encode()) + bytes([255])
        return sum(math.log10(self.p(x[i - 5 : i], x[i])) for i in range(5, len(x)))


def test_scores_match_dictionaries(spark):
    rows = corpus(n=60)
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, *_ in rows]
    learn = [t or "" for (_, t, *_), h in zip(rows, held) if not h]
    trie = SlowTrie(learn)
    count = Counter(x for t in learn for x in [*words(lower(t.encode()).decode()), "\n"])
    total, kinds = sum(count.values()), len(count)
    want = []
    for (d, t, *_), h in zip(rows, held):
        tokens = [*words(lower((t or "").encode()).decode()), "\n"]
        want.append((d, h, len(tokens), sum(count[x] > 0 for x in tokens), total, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens), trie.log10(t)))
    for share in (1 / 256, 1 / 40, None):  # contexts of up to three bytes are split, of up to two, none
        got = score_texts(spark.createDataFrame(rows, SCHEMA).repartition(3), share=share).collect()
        a, b = sorted(want, key=lambda x: (str(x[0]), x[5])), sorted(map(tuple, got), key=lambda x: (str(x[0]), x[5]))
        assert [x[:5] for x in a] == [x[:5] for x in b]
        assert np.allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-5)


def test_a_frequent_pair_of_bytes_is_split(spark):
    """Half of all places follow one pair of bytes; no shard of 64 gets more than a few times the mean."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcdefghijklmnopqrstuvwxyz0123456789") + "e " for _ in range(800)) for _ in range(40)]
    plain = spark.createDataFrame([(i, t, i % 5 == 0) for i, t in enumerate(texts)], "_id long, _text string, held_out boolean")
    for share, fits in ((1 / 256, True), (1.0, False)):
        nodes = lm_scoring.frequent_contexts(plain.select("_text", "held_out"), share)
        keys = lm_scoring._Block(pa.table({"_text": texts, "held_out": [i % 5 == 0 for i in range(40)]}), nodes).keys
        load = np.diff(B.bounds(keys, 64))
        assert (load.max() < 5 * load.mean()) == fits


def test_chances_sum_to_one():
    texts = ["abracadabra", "abrasive", "bra"]
    slow = SlowTrie(texts)
    for context in (b"abrac", b"xxabr", b"\xfe\xfe\xfe\xfe\xfe", b"zzzzz"):
        assert abs(sum(slow.p(context, s) for s in range(256) if s != 254) - 1) < 1e-9
    assert lm_scoring._ALPHABET == 255


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert score_texts(empty).collect() == []
    assert rules(empty, columns=["doc_id"]).collect() == []
    assert rules(empty).collect() == []
    assert classify(empty, empty.select("doc_id")).collect() == []
