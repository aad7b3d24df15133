import random

from siltstone.llm.topn import top_n

SCHEMA = "g string, h string, item string, s double, _score int, place string"


def run(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(g, "h", i, s, 1, "p") for g, i, s in rows], SCHEMA)
    out = [tuple(r) for r in top_n(df, ["g", "h"], "item", "s", n, **kw).collect()]
    assert len(out) == len(set(out))
    return {(r[0], r[2], r[4]) for r in out}


def brute(rows, n=3):
    out, groups = set(), {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, i))
    for g, items in groups.items():
        out |= {(g, i, p + 1) for p, (_, i) in enumerate(sorted(items)[:n])}
    return out


def test_ties_nulls_infinity(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "3", 1.0), ("a", "1", 1.0), ("a", "2", 1.0), ("a", "10", 1.0), ("b", "1", nan), ("b", "2", None), ("c", "1", inf), ("c", "2", -inf), ("c", None, 3.0), (None, "1", 2.0), ("d", "x" * 500_000, 0.0), ("d", "", 0.0)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_all_equal(spark):
    assert run(spark, []) == set()
    rows = [("hot", f"{i:05d}", 7.0) for i in range(4000)]
    assert run(spark, rows) == brute(rows)


def test_random_with_crowded_group(spark):
    rnd = random.Random(5)
    rows = list({(f"g{rnd.randrange(300)}" if rnd.random() < 0.6 else "hot", f"i{k}", round(rnd.random() * 20) / 10) for k in range(3000)})
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, 1) == brute(rows, 1)
    assert run(spark, rows, 40, cuts=(0.01, 0.02, 0.9)) == brute(rows, 40)
