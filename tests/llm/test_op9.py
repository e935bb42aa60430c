import random

import xxhash

from loxodrome.llm import simhash
from loxodrome.llm.simhash import near_groups

from .helpers import SCHEMA, corpus, words


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, size=3):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=2):
    prints = [fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    best = {}
    for (d, *_), g in zip(rows, label):
        if d is not None:
            best[g] = min(best.get(g, d), d)
    return sorted(((d, f"{p:016x}", best.get(g)) for (d, *_), p, g in zip(rows, prints, label)), key=str)


def near_rows():
    r = random.Random(2)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(250)) for _ in range(4)]
    rows = []
    for i in range(160):
        w = base[i % 4].split()
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.choice(["X", "y", f"n{i}"])
        rows.append((1000 - i, " ".join(w), None, None, 0))
    return rows


def got(spark, rows, **given):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(((r.doc_id, f"{r.print[0] & (1 << 64) - 1:016x}", r.component_id) for r in near_groups(docs, **given).collect()), key=str)


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus() + near_rows()
    assert got(spark, rows) == brute(rows)


def test_large_bucket_in_tiles_and_pairs(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = simhash.sketches(docs).selectExpr("print[0] cls", "print", "least").distinct()
    whole = {(x.node, x.component) for x in simhash.near_classes(classes, words=1, radius=2).collect()}
    split = {(x.node, x.component) for x in simhash.near_classes(classes, words=1, radius=2, split=5).collect()}
    assert whole == split and whole


def test_tiles_match_plain_comparison(monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "_TILE", 7)
    x = np.random.default_rng(1).integers(0, 1 << 12, (300, 1)).astype(np.uint64)
    a, b = simhash._tile_links(x, 2, None)
    far = np.bitwise_count(x[:, 0][:, None] ^ x[:, 0][None, :])
    p, q = np.nonzero(far <= 2)
    assert set(zip(*simhash._forest(p, q))) == set(zip(*simhash._forest(a, b)))


def test_wide_prints_catch_near_copies(spark):
    rows = near_rows()
    found = near_groups(spark.createDataFrame(rows, SCHEMA), size=5, words=4, radius=48, keys=8).collect()
    assert len({r.component_id for r in found}) == 4 and len(found) == len(rows)


def test_links_need_the_share(spark, monkeypatch):
    r = random.Random(8)
    base = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(6)]
    rows = [(i, " ".join(w), None, None, 0) for i, w in enumerate(base)]
    for i in range(90):
        w = list(base[i % 6])
        for k in range(r.randrange(12)):
            w[r.randrange(len(w))] = f"n{i}_{k}"
        rows.append((100 + i, " ".join(w), None, None, 0))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t, *_ in rows]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = list(range(len(rows)))
    while any(label[i] != label[j] for i, j in close):
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    want = {rows[i][0]: min(rows[k][0] for k in range(len(rows)) if label[k] == label[i]) for i in range(len(rows))}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    given = {"size": 5, "words": 4, "radius": 64, "keys": 8}
    found = near_groups(docs, share=(4, 5), **given).collect()
    assert {x.doc_id: x.component_id for x in found} == want and 6 < len(set(want.values())) < len(rows)
    assert len({x.component_id for x in near_groups(docs, **given).collect()}) < len(set(want.values()))


def test_a_large_bucket_of_one_minimum_is_cut(spark):
    """All texts share one minimum, and pairs their others; the cut buckets link the same ones."""
    r = random.Random(9)
    rows = []
    for i in range(30):
        own = [r.randrange(1 << 60) for _ in range(7)]
        bits = [r.randrange(-(1 << 63), 1 << 63) for _ in range(4)]
        rows += [(2 * i, bits, [5, *own]), (2 * i + 1, [bits[0] ^ 6, *bits[1:]], [5, *own[:-1], 7 + i])]
    classes = spark.createDataFrame(rows, "cls long, print array<long>, least array<long>")
    whole, cut_ = ({(x.node, x.component) for x in simhash.near_classes(classes, words=4, radius=48, split=n).collect()} for n in (16384, 8))
    assert whole == cut_ == {(i, i - i % 2) for i in range(60)}


def test_one_common_minimum_links_in_a_large_bucket(spark):
    """Pairs whose only common minimum is one that all texts share: they link, whatever a bucket's size is cut at."""
    r = random.Random(10)
    rows = []
    for i in range(30):
        bits = [r.randrange(-(1 << 63), 1 << 63) for _ in range(4)]
        rows += [(2 * i + k, [bits[0] ^ k, *bits[1:]], [5, *[r.randrange(1 << 60) for _ in range(7)]]) for k in (0, 1)]
    classes = spark.createDataFrame(rows, "cls long, print array<long>, least array<long>")
    whole, dealt = ({(x.node, x.component) for x in simhash.near_classes(classes, words=4, radius=48, split=n).collect()} for n in (16384, 8))
    assert whole == dealt == {(i, i - i % 2) for i in range(60)}


def test_marks_lose_no_pair():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 62, int(n)).astype(np.uint64)) for n in r.integers(1, 900, 40)]
    sets += [np.unique(np.append(x[: int(len(x) * f)], r.integers(0, 1 << 62, int(len(x) * (1 - f))).astype(np.uint64))) for x in sets for f in (0.7, 0.9, 0.95)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    marks = [m.tobytes() for m in simhash._marks(np.concatenate(sets), at)]
    a, b = np.triu_indices(len(sets), 1)
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(np.diff(at)[i]) for i in (a, b)], *[pa.array([marks[j] for j in i]) for i in (a, b)]], names=["a", "b", "na", "nb", "xa", "xb"])
    left = {(i, j) for o in simhash._possible([batch], share=(4, 5)) for i, j in zip(*(o[c].to_pylist() for c in "ab"))}
    both = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    near = {(i, j) for i, j, n in zip(a.tolist(), b.tolist(), both) if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n)}
    assert near and near <= left and len(left) < len(a) / 4


def test_rows_of_one_print_keep_all_their_buckets(spark, monkeypatch):
    """Rows of one fingerprint but different shingles: each one's buckets count."""
    sketch = [(1, 1, [0, 0, 0, 0], [1, 1], 9, 0), (2, 2, [0, 0, 0, 0], [2, 2], 9, 0), (3, 3, [1, 0, 0, 0], [2, 9], 9, 0), (4, 4, [2, 0, 0, 0], [1, 8], 9, 0)]
    frame = spark.createDataFrame(sketch, "_id long, _key long, print array<long>, least array<long>, n_shingles long, _set long")
    monkeypatch.setattr(simhash, "sketches", lambda *_, **__: frame)
    found = near_groups(spark.createDataFrame([], SCHEMA), words=4, radius=8, keys=2).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_ids_of_text(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([("b", text), ("a", text), (None, "other words here")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_groups(docs).collect()} == {("a", "a"), ("b", "a"), (None, None)}


def test_empty_table(spark):
    assert got(spark, []) == []


def test_majority_over_chunks(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    counts = r.integers(0, 30, 50)
    counts[[0, 7, 49]] = 0, 200, 0
    begins = np.concatenate([[0], np.cumsum(counts)])
    hashes = r.integers(0, 1 << 63, begins[-1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    want = []
    for a, b in zip(begins[:-1], begins[1:]):
        mine = [int(x) for x in hashes[a:b]]
        want.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in mine) > len(mine)))
    for chunk in (1, 7, 64, 1 << 15):
        monkeypatch.setattr(simhash, "_CHUNK", chunk)
        assert simhash._majority(hashes, begins).tolist() == want


def test_candidates_are_only_pairs_that_may_overlap():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 - 5 * i], r.integers(0, 1 << 63, 5 * i, dtype=np.uint64)])) for i in range(12)] * 4
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    marks = [m.tobytes() for m in simhash._marks(np.concatenate(sets), at)]
    for n in (12, 48):  # a small group, and a large one
        batch = pa.table({
            "cls": np.arange(n), "print": pa.array([[0]] * n, pa.list_(pa.int64())), "no": np.zeros(n, np.int32), "bits": np.zeros(n, np.int64), "pair": np.full(n, -1, np.int32), "side": np.full(n, -1, np.int32),
            "label": np.arange(n), "_n": [len(x) for x in sets[:n]], "_marks": pa.array(marks[:n], pa.binary()),
        }).combine_chunks().to_batches()
        found = {(a, b) for o in simhash._candidates(batch, words=1, radius=0, share=(4, 5), since=0, upto=n) for a, b in zip(*(o[c].to_pylist() for c in "ab")) if a is not None}
        all_ = {(i, j) for i in range(n) for j in range(i + 1, n)}
        close = {(i, j) for i, j in all_ if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
        assert close <= found < all_


def test_texts_that_surely_stay_do_not_move(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(80)) for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(30, texts[3], "en"), (31, texts[4] + " more", "fr"), (5, texts[5], "en"), (None, texts[6], None), (None, "alone " * 9, None), (40, None, "de")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=5, words=4, radius=64, keys=8, share=(4, 5))
    want = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "alone " * 9, None), (40, None, "de")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    first = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    union = next(i for i, line in enumerate(first) if "Union" in line)
    depth = first[union].index("Union")
    side = [line for line in first[union + 1 :] if len(line) > depth]
    second = next(i for i, line in enumerate(side) if line[depth : depth + 3] == "+- ")
    assert not any("Join" in line or "Window" in line for line in side[:second]) and any("Join" in line for line in side[second:])
