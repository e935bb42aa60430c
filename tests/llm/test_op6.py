import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loxodrome.llm.packing import Tournament, WordTokens, pack, pack_documents

from .helpers import SCHEMA, corpus

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokens():
    return WordTokens(PATH, True)


def awkward():
    r = random.Random(3)
    pieces = ["It's", "don'T,", "end.", "...", "a.b,", "x!?", "É,", "ſ.", "İ", "ΣΑΣ.", "<|endoftext|>", "<|ENDOFTEXT|>,", "a<|endoftext|>.", "\xa0", " b", "é", "9,", "9.5", "'s.", "CAN'T'VE", "ﬁ", "漢字,", "👍🏽!", "\x1c", "\x85", "_a_;", "½."]
    return ["".join(r.choice([*pieces, " ", "\n", "\t "]) for _ in range(r.randrange(30))) for _ in range(300)]


def test_word_tokens_match_whole_texts(tokens):
    texts = [*awkward(), *[t or "" for _, t, *_ in corpus()]]
    flat, at = tokens.tokens(pa.array(texts))
    for i, text in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tournament_is_first_fit():
    r = random.Random(1)
    tree, plain = Tournament(50, 20), [20] * 50
    for _ in range(50):
        size = r.randrange(1, 21)
        want = next(i for i, x in enumerate(plain) if x >= size)
        plain[want] -= size
        assert tree.place(size) == want


def test_pack_keeps_every_id_and_pads_nothing():
    r = random.Random(2)
    for capacity in (1, 8, 64):
        for _ in range(40):
            lengths = [r.randrange(1, 3 * capacity + 2) for _ in range(r.randrange(0, 30))]
            out = pack(lengths, capacity)
            seen = defaultdict(list)
            for sequence in out:
                n = sum(x[2] for x in sequence)
                assert 0 < n <= capacity and (n == capacity or n & (n - 1) == 0)
                for i, s, k in sequence:
                    seen[i] += range(s, s + k)
            assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(lengths))


def test_documents(spark, tokens):
    rows = corpus() + [(9000 + i, t, None, None, 0) for i, t in enumerate(awkward())]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, capacity=64, with_ids=True).collect()
    docs = defaultdict(list)
    for d, text, *_ in rows:
        docs[d].append([*tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens, tuple(r.ids)))
    for x in sequences.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    for d, texts in docs.items():
        assert sum(x[1] for x in pieces[d]) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for x in sorted(pieces[d]) for i in x[3]] == texts[0] and all(x[2] == len(texts[0]) for x in pieces[d])


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []
