import random

from pyspark.sql import functions as F

from siltstone.operators.merging import drop_shadowed, first_mode
from siltstone.operators.ranking import budget_counter, chunks, islands, place_in_group, running, slices


def test_hot_group_is_cut_and_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 3 + ["a", None]), rnd.randrange(500), i, rnd.choice([None, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one slice
    cut = slices(df, ["k"], ["at", "id"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert cut.filter("k = 'hot'").select("_slice").distinct().count() > 1
    got = {r.id: (r.s, r.m) for r in running(running(cut, ["k"], ["at", "id"], F.col("v"), "s"), ["k"], ["at", "id"], F.col("v"), "m", "max", own=False).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "a", None):
        total, most = 0, None
        for k, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            total += v or 0
            assert got[i] == (total, most)
            most = max((x for x in (most, v) if x is not None), default=None)


def test_places_chunks_budgets(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)] + [(None, i) for i in range(100, 107)], "k string, id int")
    assert {(r.id, r.at) for r in place_in_group(df, ["k"], [F.desc("id")], "at").collect()} == {(i, 99 - i) for i in range(100)} | {(i, 106 - i) for i in range(100, 107)}
    assert {(r.id, r.chunk) for r in chunks(df, ["k"], ["id"], 8).collect()} == {(i, i // 8) for i in range(100)} | {(i, 0) for i in range(100, 107)}
    granted = {r.id for r in budget_counter(df, ["k"], ["id"], F.col("id") % 2 == 0, 3).collect() if r.granted}
    assert granted == {0, 2, 4, 100, 102, 104}
    assert place_in_group(df.limit(0), ["k"], ["id"], "at").count() == 0


def test_islands_with_repeats(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 4, 20), ("a", 8, 9), ("a", 21, 22), ("a", 40, 41), ("a", None, 3)], "k string, lo int, hi int")
    assert sorted(tuple(r) for r in islands(df, ["k"], F.col("lo"), F.col("hi"), F.lit(0)).collect()) == [("a", 1, 20, 4), ("a", 21, 22, 1), ("a", 40, 41, 1)]


def test_null_keys_shadow_and_modes(spark):
    df = spark.createDataFrame([(None, 0), (None, 3), ("a", 0), ("b", None)], "k string, v int")
    assert sorted(((r.k or ""), r.v) for r in drop_shadowed(df, ["k"], F.col("v") > 0).collect() if r.v is not None) == [("", 3), ("a", 0)]
    one, two = df.filter("v = 3"), df
    got = {(r.k, r.v, r["mode"]) for r in first_mode([("one", one), ("two", two)], ["k"]).collect()}
    assert got == {(None, 3, "one"), ("a", 0, "two"), ("b", None, "two")}
