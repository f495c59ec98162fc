import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.operators import packing
from sievewright.operators.packing import compose, next_fit, pack, pack_in_buckets, summary, with_singletons

SIZES = st.lists(st.integers(0, 12), max_size=40)


@given(SIZES, st.integers(12, 30), st.lists(st.integers(0, 40), max_size=4))
@settings(max_examples=200, deadline=None)
def test_blocks_give_what_one_pass_gives(sizes, limit, cuts):
    cuts = sorted({0, len(sizes), *[min(c, len(sizes)) for c in cuts]})
    blocks = [sizes[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]
    got = []
    for block, (carried, group) in zip(blocks, compose([summary(b, limit) for b in blocks], limit)):
        got += next_fit(block, limit, carried, group)[0]
    assert got == next_fit(sizes, limit, -1, 0)[0]


@given(SIZES, st.integers(12, 30))
@settings(max_examples=200, deadline=None)
def test_next_fit_is_maximal_and_within_the_limit(sizes, limit):
    groups = next_fit(sizes, limit, -1, 0)[0]
    assert groups == sorted(groups)
    for g in set(groups):
        inside = [s for s, x in zip(sizes, groups) if x == g]
        assert sum(inside) <= limit
        after = [s for s, x in zip(sizes, groups) if x == g + 1]
        assert not after or sum(inside) + after[0] > limit


CASES = [([], [], []), ([10], [[10]], []), ([11], [], [11]), ([4, 6, 1], [[4, 6], [1]], []), ([6, 5, 4, 6], [[6], [5, 4], [6]], []), ([3, 20, 3], [[3, 3]], [20]), ([0, 10, 0], [[0, 10, 0]], [])]


def test_stated_cases(spark):
    for sizes, groups, large in CASES:
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
        rows = pack(df, ["id"], F.col("size"), 10, 3).orderBy("id").collect()
        got: dict = {}
        for r in rows:
            if not r["is_large"]:
                got.setdefault(r["group_id"], []).append(r["size"])
        assert list(got.values()) == groups
        assert [r["size"] for r in rows if r["is_large"]] == large


def test_nulls_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (1, 5, 2), (1, 5, 3), (2, 99, 4)], "id long, size int, group_id int")
    rows = pack(df, ["id"], F.col("size"), 10).collect()
    assert len(rows) == 4 and sum(r["is_large"] for r in rows) == 1
    alone = with_singletons(pack(df, ["id"], F.col("size"), 10), ["id"]).where("is_large").first()
    assert alone["group_id"] < 0
    assert pack_in_buckets(df, "id", ["id"], F.col("size"), 10, 2).count() == 4


def test_blocks_put_together_in_levels(spark, monkeypatch):
    """However the order is cut and its summaries are put together, the groups are those of one pass."""
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(8)
    for limit, top in ((10, 10), (50, 9)):
        sizes = [rng.choice([0, 0, rng.randint(0, top), rng.randint(0, limit)]) for _ in range(300)]
        want = packing.next_fit(sizes, limit, -1)[0]
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, size int")
        for blocks in (2, 40):
            got = packing.pack(df, ["id"], F.col("size"), limit, blocks).orderBy("id").collect()
            assert [r["group_id"] for r in got] == want, (limit, blocks)


def test_summary_of_two_blocks_in_a_row():
    rng = random.Random(3)
    for _ in range(300):
        limit = rng.randint(1, 30)
        one, two = ([rng.randint(0, limit) for _ in range(rng.randint(0, 12))] for _ in range(2))
        both = packing.then(packing.summary(one, limit), packing.summary(two, limit), limit)
        for carried in range(limit + 1):
            assert packing.follow(both, carried, limit) == packing.follow(packing.summary(one + two, limit), carried, limit)
            assert len(both[0]) <= limit + 2
