import random

from loxodrome.operators.components import connected_components


def test_chain_stars_and_ties(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (7, 3), (5, 5), (None, 4)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {(x.node, x.component) for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in list(parent)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_links_are_closed_as_many_are(spark, monkeypatch):
    from loxodrome.operators import components as C

    r = random.Random(12)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(None, 3), (7, None), (-5, 2**62), (9, 9)]
    links = spark.createDataFrame(pairs, "a long, b long")
    few = {tuple(x) for x in C.connected_components(links).collect()}
    assert "MapInArrow" in C.connected_components(links)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(C, "FEW", -1)
    assert {tuple(x) for x in C.connected_components(links).collect()} == few and (40, 0) in few and (2**62, -5) in few
    assert C.connected_components(links.where("a = b")).count() == 0
