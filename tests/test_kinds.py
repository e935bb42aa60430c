"""Records alike in all that is compared: classified once, and all there in the results."""

from pyspark.sql import functions as F

from loxodrome.operators import chains, matching, vectors


def view(spark, source, step, n):
    rows = spark.range(n).select("id", (F.col("id") % step * 20.0).alias("x"), F.lit(0.0).alias("y"))
    k = F.col("id") % step
    phones = F.when(k % 2 == 0, F.array(F.lit("+81 3-1234-5678"))).otherwise(F.array())
    return matching.comparison_view(source, rows, source_id=F.concat(F.lit(source), F.col("id").cast("string")), name=F.concat(F.lit("N"), (k % 3).cast("string")), x=F.col("x"), y=F.col("y"), phones=phones, ascii_only=True)


def test_kinds_match_single_records(spark, monkeypatch):
    left, right = view(spark, "a", 5, 25), view(spark, "b", 7, 16)
    columns = ["left_id", "right_id", "distance_m", "phone_evidence", "status", "reasons"]
    plain = matching.classify_pairs(matching.candidate_pairs(left, right, 50))
    seen, real = [], matching.candidate_pairs
    monkeypatch.setattr(matching, "candidate_pairs", lambda a, b, *rest, **given: seen.append((a.count(), b.count())) or real(a, b, *rest, **given))
    pairs, *members = matching.classified_kinds(left, right, 50)
    assert seen == [(5, 7)]
    assert sorted(matching.spread(pairs, *members).select(columns).collect()) == sorted(plain.select(columns).collect())
    assert sorted(matching.unmatched_of_kinds(left, right, pairs, *members).collect()) == sorted(matching.unmatched_records(left, right, plain).collect())
    found = chains.compare_providers({"a": left, "b": right}, 50)
    assert sorted(found["pairs"].select(columns).collect()) == sorted(plain.select(columns).collect())
    assert sorted(tuple(r)[1:] for r in found["radii"].collect()) == sorted(map(tuple, matching.by_radius(plain, [15.0, 25.0, 50.0]).collect()))
    assert found["summary"].first().candidates == plain.count()


def test_silhouettes_of_many_labellings_are_those_of_each(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 4 if i else 9, [float(i % 5), float(i * i % 7)]) for i in range(40)], "vec_id long, a long, b long, embedding array<double>")
    both = {(r.labelling, r.vec_id): (r.label, r.silhouette) for r in vectors.silhouettes_of(rows, ["a", "b"], tile=11).collect()}
    assert len(both) == 80 and both["b", 0] == (9, None)
    for label in "ab":
        for r in vectors.silhouettes(rows, label).collect():
            c, s = both[label, r.vec_id]
            assert c == r[label] and (s == r.silhouette or abs(s - r.silhouette) < 1e-9)
