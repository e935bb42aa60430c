import random

import corpus_pipeline

from .helpers import SCHEMA, corpus, words


def documents():
    r = random.Random(6)
    vocab = ["".join(r.choice("aeiou") + r.choice("bdfgklmnprst") for _ in range(r.randint(1, 4))) for _ in range(1500)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(i, text(r.randrange(80, 400)), r.choice(["en", "fr"]), r.choice(["a", "b", "c"]), 0) for i in range(120)]
    passage = text(70)
    rows += [(200 + i, f"{text(150)} {passage} {text(150)}", "en", "a", 0) for i in range(5)]
    rows += [(300 + i, rows[i][1], "en", "b", 0) for i in range(10)]
    for i in range(10):
        w = words(rows[20 + i][1])
        w[len(w) // 2] = "changed"
        rows.append((400 + i, " ".join(w), "fr", "c", 0))
    rows += [(500 + i, "x1#$ " * 5, "en", "a", 0) for i in range(3)]
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        if name != "packing":
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in spark.read.parquet(str(tmp_path / "documents.parquet")).schema]
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    ids = {n: sorted(r.doc_id for r in x) for n, x in seen.items() if n != "packing"}
    assert set(ids["quality rules"]) == {d for d, *_ in rows if d < 500}
    assert ids["SimHash near-dedup"] == sorted({d for d, *_ in rows if d < 300})
    assert [r.text for r in seen["substring dedup"] if passage in r.text] == [next(t for d, t, *_ in rows if d == 200)]
    assert all(len(r.text) == r.n_chars for r in seen["substring dedup"]) and len(ids["substring dedup"]) == 125
    assert set(ids["mixing"]) <= set(ids["substring dedup"]) and max(ids["mixing"].count(d) for d in ids["mixing"]) <= 2
    sizes = {}
    for r in seen["packing"]:
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert max(sizes.values()) <= 2048 and {r.doc_id for r in seen["packing"]} == set(ids["mixing"])


def test_run_on_awkward_rows(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
