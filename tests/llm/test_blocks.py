import numpy as np
import pyarrow as pa

from loxodrome.llm import blocks as B


def test_answers_stand_in_the_order_of_the_asks():
    r = np.random.default_rng(1)
    sets = [np.unique(B.mix(r.integers(0, 400, 200).astype(np.uint64))) for _ in range(5)]
    for buckets in (1, 3, 64):
        asks = pa.concat_tables([B.ask_rows(i, 1, k, buckets) for i, k in enumerate(sets)])
        answers = pa.concat_tables([B.elsewhere(int(b), asks.filter(pa.compute.equal(asks["bkt"], b)), phase=1) for b in set(asks["bkt"].to_pylist())])
        for i, k in enumerate(sets):
            own = answers.filter(pa.compute.equal(answers["blk"], i))
            others = np.concatenate([x for j, x in enumerate(sets) if j != i])
            assert (B.read_bits(own, 1, k, buckets) == np.isin(k, others)).all()


def test_bounds_follow_the_high_bits():
    keys = np.array([0, 1, 1 << 62, 1 << 63, (1 << 64) - 1], np.uint64)
    assert B.bounds(keys, 4).tolist() == [0, 2, 3, 4, 5]
    assert B.power_of_two(37, 64) == 32 and B.power_of_two(1000, 64) == 64 and B.power_of_two(1, 64) == 1


def test_deal_grows_with_the_root(spark):
    tiny = spark.createDataFrame([("x" * 100,), (None,)], "t string")
    assert B.deal(tiny, "t") == B.Deal(1, 1)
    assert B.deal(spark.createDataFrame([], "t string"), "t") == B.Deal(1, 1)
