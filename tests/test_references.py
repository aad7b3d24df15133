import random
from datetime import datetime, timedelta

from siltstone.operators.references import RANGE, and_not, bitmaps, coverage, orphan_references

REFS = "k string, row int, at timestamp_ntz, code string, period int, reason string"
ITEMS = "k string, born timestamp_ntz, died timestamp_ntz, code int"


def run(spark, refs, items):
    r = spark.createDataFrame([(k, i, t, "c", 1, "old") for i, (k, t) in enumerate(refs)], REFS)
    p = spark.createDataFrame([(k, b, d, 3) for k, b, d in items], ITEMS)
    out = orphan_references(r, p, ["k"], "at", "born", "died").collect()
    assert len({x.row for x in out}) == len(out)
    return {(x.row, x.reason) for x in out}


def brute(refs, items):
    out = set()
    for i, (k, t) in enumerate(refs):
        own = [x for x in items if k is not None and x[0] == k]
        if k is None or (t is None and own):
            continue
        if any(b and b <= t and (d is None or d > t) for _, b, d in own):
            continue
        out.add((i, "missing" if not own else "late" if not any(b and b <= t for _, b, _ in own) else "deleted"))
    return out


D = lambda n, h=0: datetime(2024, 1, 1) + timedelta(days=n, hours=h)


def test_reasons_and_borders(spark):
    items = [("a", D(10), D(50)), ("a", D(80), None), ("b", D(5), D(5)), ("c", None, None)]
    refs = [("a", D(9)), ("a", D(10)), ("a", D(49, 23)), ("a", D(50)), ("a", D(79)), ("a", D(80)), ("b", D(5)), ("b", D(6)), ("c", D(1)), ("x", D(1)), (None, D(1)), ("x", None), ("a", None)]
    assert run(spark, refs, items) == brute(refs, items)


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("a", D(1))], []) == {(0, "missing")}
    assert run(spark, [], [("a", D(1), None)]) == set()
    assert run(spark, [("a", None)], [("b", D(1), None)]) == {(0, "missing")}


def test_random_with_hot_key(spark):
    rnd = random.Random(3)
    key = lambda: "hot" if rnd.random() < 0.35 else f"k{rnd.randrange(200)}"
    items = []
    for _ in range(900):
        b = D(rnd.randrange(400), rnd.randrange(24))
        items.append((key(), b, b + timedelta(hours=rnd.randrange(-5, 900)) if rnd.random() < 0.7 else None))
    items = [x for x in items if x[0] != "hot" or x[2]]
    refs = [(key(), D(rnd.randrange(400), rnd.randrange(24))) for _ in range(2000)]
    assert run(spark, refs + refs[:5], items + items[:50]) == brute(refs + refs[:5], items)


def test_bitmaps_against_sets(spark):
    rnd = random.Random(5)
    code = lambda: rnd.choice([0, 3 << 33, RANGE]) + rnd.randrange(rnd.choice([5, RANGE]))
    refs = {(code(), rnd.randrange(-1, 6)) for _ in range(12_000)} | {(c, 2) for c in range(RANGE)}
    spans = [(code(), b, b + rnd.randrange(4)) for b in [rnd.randrange(6) for _ in range(9_000)]]
    spans += [(5, -12, 10**6), (6, 2, 2), (6, 2, 3)]
    want = {(c, p) for c, p in refs if p < 0} | ({(c, p) for c, p in refs} - {(c, m) for c, b, t in spans for m in range(b, min(t, 9) + 1)})
    r = spark.createDataFrame(sorted(refs) * 2, "code bigint, period int").repartition(3)
    s = spark.createDataFrame(spans, "code bigint, `from` int, till int").repartition(3)
    got = [tuple(x) for x in and_not(bitmaps(r), coverage(s)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_far_dates_cost_nothing(spark):
    items = [(f"k{i}", D(0), None) for i in range(400)]
    refs = [("k1", datetime(1, 1, 1)), ("k2", datetime(9999, 12, 30)), ("k3", D(5))]
    assert run(spark, refs, items) == brute(refs, items) == {(0, "late")}
