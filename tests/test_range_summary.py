"""Counts in ranges without pairs, against brute force."""

import random

from pyspark.sql import functions as F

from siltstone.operators import joins


def test_range_summary(spark):
    rnd = random.Random(3)
    points = [(rnd.choice("ab"), rnd.choice([None, float("nan"), round(rnd.uniform(-20, 20), 1)])) for _ in range(150)]
    ranges = [(rnd.choice("abc"), i, lo := rnd.randrange(-25, 25), lo + rnd.randrange(-2, 12)) for i in range(80)]
    ranges += [(k, i + 100, lo, hi) for k, i, lo, hi in ranges[:20]] + [("a", 900, None, 3), (None, 901, 0, 9)]
    p = spark.createDataFrame([*points, (None, 1.0)], "k string, x double")
    r = spark.createDataFrame(ranges, "k string, id int, lo int, hi int")
    want = {}
    for k, i, lo, hi in ranges:
        held = [x for q, x in points if lo is not None and k is not None and q == k and x is not None and lo <= x <= hi]
        if held:
            want[i] = (len(held), min(held), max(held))
    got = joins.range_summary(p, F.col("x"), r, F.col("lo"), F.col("hi"), ["k"]).collect()
    assert {x.id: (x.n, x.least, x.greatest) for x in got} == want and len(got) == len(want) > 40


def test_overlap_counts(spark):
    rnd = random.Random(4)
    some = lambda n: [(i, lo := rnd.randrange(0, 60), lo + rnd.randrange(-2, 20)) for i in range(n)]
    a, b = some(70), [*some(60), (500, 1000, 1001)]
    da, db = spark.createDataFrame([*a, (99, None, 4)], "ia int, la int, ha int"), spark.createDataFrame([*b, *[(i + 200, lo, hi) for i, lo, hi in b[:9]]], "ib int, lb int, hb int")
    got = {x.ib: x.n for x in joins.overlap_counts(da, F.col("la"), F.col("ha"), db, F.col("lb"), F.col("hb")).collect()}
    count = lambda lo, hi: sum(1 for _, x, y in a if x <= y and lo <= hi and x <= hi and lo <= y)
    want = {i: count(lo, hi) for i, lo, hi in b} | {i + 200: count(lo, hi) for i, lo, hi in b[:9]}
    assert got == {i: n for i, n in want.items() if n}


def test_no_pairs_are_made(spark):
    """400,000,000 pairs either way: counted, not listed."""
    many = spark.range(20_000)
    (x,) = joins.range_summary(many, F.col("id") % 7, many, F.lit(0), F.lit(6)).groupBy("n", "least", "greatest").count().collect()
    assert tuple(x) == (20_000, 0, 6, 20_000)
    (x,) = joins.overlap_counts(many, F.lit(0), F.lit(5), many, F.lit(5), F.lit(9)).groupBy("n").count().collect()
    assert tuple(x) == (20_000, 20_000)
