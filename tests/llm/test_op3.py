import random
import re
import time

import pyarrow as pa

from loxodrome.llm.license_scan import PHRASES, Scanner, SuffixAutomaton, chains, default_templates, scan_licenses

from .helpers import SCHEMA, corpus

TEMPLATES = default_templates()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def rows():
    r = random.Random(4)
    out = corpus()
    for i in range(60):
        words = [r.choice(["the", "of", "mit", "License,", "general PUBLIC", "license", "apache", "software", "é1"]) for _ in range(r.randrange(40))]
        if i % 3 == 0:
            words.insert(r.randrange(len(words) + 1), r.choice(TEMPLATES)[1].upper())
        out.append((5000 + i, r.choice([" ", "\n", "-", "/"]).join(words), None, None, 0))
    return out


def test_base_matches_brute_force(spark):
    given = rows()
    got = scan_licenses(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((x[0], *base(x[1])) for x in given), key=str)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert all(r.score == 1 for r in got if r.doc_id and r.doc_id >= 5000 and (r.doc_id - 5000) % 3 == 0)


def test_statistics_match_brute_force():
    r = random.Random(8)
    for _ in range(60):
        sequences = [[r.randrange(3) for _ in range(r.randrange(1, 9))] for _ in range(3)]
        text = [r.randrange(4) for _ in range(20)]
        automaton = SuffixAutomaton(sequences)
        for i, (state, n) in enumerate(automaton.statistics(text)):
            fits = [(len(s), k) for k in range(1, i + 2) for s in [text[i + 1 - k : i + 1]] if any(s == q[j : j + k] for q in sequences for j in range(len(q)))]
            assert n == max([k for _, k in fits], default=0)
            if n:
                run = text[i + 1 - n : i + 1]
                assert automaton.ends[state] == {(x, j + n) for x, q in enumerate(sequences) for j in range(len(q)) if run == q[j : j + n]}
            longest = {}
            for x, q in enumerate(sequences):
                for e in range(1, len(q) + 1):
                    k = max(k for k in range(min(e, i + 1) + 1) if q[e - k : e] == text[i + 1 - k : i + 1])
                    if k >= 2:
                        longest[x, e] = k
            assert {(x, e): k for x, e, k in automaton.shorter(state, n, 2)} == longest


def test_edited_notice_is_chained():
    scanner = Scanner(TEMPLATES, PHRASES, 4, 0.8, 8)
    notice = TEMPLATES[0][1].split()
    edited = " ".join(["foo", *notice[:12], "oops", *notice[13:30], "x", "y", *notice[31:], "bar"])
    found = scanner.scan(pa.array([edited, " ".join(notice[:60]), ""]))
    assert found["labels"] == ["mit", "", ""] and 0.9 < found["score"][0] < 1 and 0.3 < found["score"][1] < 0.5
    mine = [x for x in found["spans"][0] if x["label"] == "mit"]
    assert [(x["start"], x["end"]) for x in mine] == [(1, len(edited.split()) - 1)]


def test_every_notice_has_a_span():
    scanner = Scanner(TEMPLATES, PHRASES, 4, 0.8, 8)
    notice, other = TEMPLATES[0][1], TEMPLATES[1][1]
    found = scanner.scan(pa.array([f"{notice} a b c {other} {notice} d"]))
    n, m = len(notice.split()), len(other.split())
    spans = [(x["label"], x["start"], x["end"]) for x in found["spans"][0] if x["share"] >= 0.8]
    assert spans == [("mit", 0, n), ("apache", n + 3, n + 3 + m), ("mit", n + 3 + m, 2 * n + 3 + m)]


def test_a_shorter_match_of_another_template_is_kept():
    scanner = Scanner([("a", "one two three four five six"), ("b", "x two three four five y z")], {}, 3, 0.5, 2)
    found = scanner.scan(pa.array(["one two three four five six"]))
    assert found["labels"] == ["a,b"] and [x["label"] for x in found["spans"][0]] == ["a", "b"]


def test_short_templates_and_long_texts():
    assert Scanner([("a", "one two")], {}, 4, 0.5, 2).scan(pa.array(["one two three", None]).fill_null(""))["labels"] == ["", ""]
    scanner = Scanner(TEMPLATES, PHRASES, 4, 0.8, 8)
    seconds = []
    for n in (100, 800):
        began = time.process_time()
        found = scanner.scan(pa.array([f"{TEMPLATES[2][1]} " * n]))
        seconds.append(time.process_time() - began)
        assert sum(x["label"] == "gpl" for x in found["spans"][0]) == n
    assert seconds[1] < 30 * seconds[0]  # 8 times the text


def test_chains_are_collinear():
    assert chains([(0, 0, 4), (9, 5, 4), (5, 20, 5), (100, 9, 9)], 8) == [(9, [(0, 0, 4), (5, 20, 5)]), (9, [(100, 9, 9)]), (4, [(9, 5, 4)])]
    assert chains([], 8) == []


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
