from loxodrome.llm.mixing import mix

from .helpers import SCHEMA, corpus, words


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(spark, rows):
    got = mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == sorted((x[0], x[1]) for x in rows if x[0] is not None) or any(x[1] is None for x in rows)
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    want = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        biggest = max((r.size for r in mine), default=0)
        assert all(r.size == len(words(r.text)) and r.source_size == sizes[s] and r.taken <= 2 * r.size and abs(r.target - want[s]) < 1e-6 for r in mine)
        same = {}
        for r in mine:
            same[r.doc_id] = same.get(r.doc_id, 0) + r.size
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(biggest, max(same.values()))
    return sorted((str(r.doc_id), str(r.text), r.taken) for r in got)


def test_targets_and_reruns(spark):
    rows = corpus(n=80)
    assert check(spark, rows) == check(spark, list(reversed(rows)))


def test_many_sources_and_one_large(spark):
    rows = [(i, "a " * (i % 9), "en", f"s{i % 7}" if i % 3 else "big", i) for i in range(900)] + [(5000, "x y", None, "zero", 0), (5001, None, None, "zz empty", 0)]
    check(spark, rows)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns(spark):
    got = mix(spark.createDataFrame([(1, "a b", "s", 99, 7)], "doc_id long, text string, source string, size long, target int")).first()
    assert (got["size"], got.target, got.taken) == (2, 3.0, 2)
