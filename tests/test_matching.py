"""Matching against walks that take one pair after the other."""

import random

from siltstone.operators.evaluation import artifact_score, detailed_match, greedy_assign, match_scores, sink_family, staged_match
from pyspark.sql import functions as F


def walk(pairs):
    used_l, used_r, out = set(), set(), set()
    for k, a, b, s in sorted(set(pairs), key=lambda p: (p[3], p[1], p[2]), reverse=True):
        if (k, a) not in used_l and (k, b) not in used_r:
            used_l.add((k, a))
            used_r.add((k, b))
            out.add((k, a, b, s))
    return out


def test_greedy_equals_the_walk(spark):
    rnd = random.Random(3)
    pairs = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b"]), rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(4))) for _ in range(400)]
    pairs = list({p[:3]: p for p in pairs}.values())
    df = spark.createDataFrame(pairs + pairs[:20], "k string, a int, b int, s double")
    got = [tuple(r) for r in greedy_assign(df, ["k"], "a", "b", "s").collect()]
    assert len(got) == len(set(got)) and set(got) == walk(pairs)


def test_greedy_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 1, 2.0), (None, 1, 2, 1.0), ("a", None, 1, 9.0), ("a", 1, None, 9.0), ("a", 1, 1, None), ("a", 2, 2, float("nan")), ("a", 3, 3, -1.0)], "k string, a int, b int, s double")
    assert [tuple(r) for r in greedy_assign(df, ["k"], "a", "b", "s").collect()] == [(None, 1, 1, 2.0)]
    assert greedy_assign(df.limit(0), ["k"], "a", "b", "s").count() == 0


def staged_walk(gts, preds):
    tests = [("address", lambda a, b: a[2] is not None and a[2] == b[2]), ("near", lambda a, b: a[2] is not None and b[2] is not None and abs(a[2] - b[2]) <= 16), ("function", lambda a, b: bool(a[3]) and bool(b[3]) and (a[3] in b[3] or b[3] in a[3])), ("label", lambda a, b: a[2] is None and not a[3])]
    used_g, used_p, out = set(), set(), set()
    for how, ok in tests:
        for a in sorted(gts, key=lambda x: x[1]):
            for b in sorted(preds, key=lambda x: x[1]):
                if a[:2] not in used_g and b[:2] not in used_p and a[0] == b[0] and ok(a, b):
                    used_g.add(a[:2])
                    used_p.add(b[:2])
                    out.add((a[0], a[1], b[1], how))
    return out


def test_stages_equal_the_walk(spark):
    rnd = random.Random(7)
    row = lambda i: (rnd.choice(["a", "b", None]), i, rnd.choice([None, *range(0, 400, 9)]), rnd.choice([None, "", "f", "fun", "g", "main"]))
    gts, preds = [row(i) for i in range(120)], [row(i) for i in range(120)]
    sch = "k string, {0} bigint, address bigint, function_name string, other int"
    g = spark.createDataFrame([(*r, 1) for r in gts], sch.format("gt_row"))
    p = spark.createDataFrame([(*r, 1) for r in preds], sch.format("pred_row"))
    got = [tuple(r) for r in staged_match(g, p, ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == staged_walk(gts, preds)
    assert staged_match(g.limit(0), p, ["k"]).count() == 0


def test_family_credit_and_scores(spark):
    g = spark.createDataFrame([("s", 1, "COPY_SINK", 100, "f"), ("s", 2, "STORE_SINK", 200, "g"), ("s", 3, "FUNC_PTR", None, "h"), ("t", 4, "MMIO_READ", 1, "i")], "k string, gt_id bigint, label string, address bigint, function_name string")
    p = spark.createDataFrame([("s", 1, "COPY_SINK", 100, "f"), ("s", 2, "LOOP_WRITE_SINK", 210, "x"), ("s", 3, "FUNC_PTR_SINK", 5, "hh"), ("s", 4, "MMIO_READ", 1, "i")], "k string, pred_id bigint, label string, address bigint, function_name string")
    m = detailed_match(g, p, ["k"])
    assert sorted(tuple(r) for r in m.collect()) == [("s", 1, 1, "address", 1.0), ("s", 2, 2, "near_family", 0.5), ("s", 3, 3, "function_family", 0.5)]
    sc = {r.k: (r.tp, r.fp, r.fn, round(r.weighted_precision, 3), round(r.weighted_recall, 3)) for r in match_scores(g, p, m, ["k"]).collect()}
    assert sc == {"s": (1, 3, 2, 0.5, 0.667), "t": (0, 0, 1, 0.0, 0.0)}
    fam = spark.createDataFrame([("MEMSET_SINK", "MEMORY_WRITE"), ("X", "X"), (None, None)], "l string, w string").select(sink_family(F.col("l")), "w").collect()
    assert all(r[0] == r[1] for r in fam)
    pairs = spark.createDataFrame([(1, True, False), (2, False, False), (3, True, True), (4, None, None)], "i int, a boolean, veto boolean")
    assert [r.score for r in artifact_score(pairs, [(F.col("a"), 0.7)], [F.col("veto")]).orderBy("i").collect()] == [0.7, -1.0, -1.0, -1.0]
