import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm.packing import pack_violations, best_fit_runs, pack
from siltstone.llm.tokens import RANKS, token_counts
from siltstone.operators.ranking import running_total


def expand(plan):
    bins, seen = {}, {}
    for size, rank, n, first, per in plan:
        for k in range(n):
            bins.setdefault(first + k // per, []).append(size)
            seen.setdefault(size, []).append(rank + k)
    return bins, seen


@pytest.mark.parametrize("seed", range(6))
def test_runs_hold_and_are_complete(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([7, 100, 2048])
    sizes = {rnd.randint(0, capacity): rnd.randint(1, 60) for _ in range(50)}
    bins, seen = expand(best_fit_runs(list(sizes), list(sizes.values()), capacity))
    assert all(sum(b) <= capacity for b in bins.values())
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in sizes.items()}
    assert sorted(bins) == list(range(len(bins)))
    # Never worse than first fit decreasing by more than a few percent.
    gaps = []
    for s in sorted((s for s, n in sizes.items() for _ in range(n) if s), reverse=True):
        for i, g in enumerate(gaps):
            if g >= s:
                gaps[i] -= s
                break
        else:
            gaps.append(capacity - s)
    assert len(bins) <= len(gaps) * 1.03 + 1


def run(spark, items, capacities):
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in items], "doc_id bigint, n_tokens bigint, container string, _size int")
    return pack(df, "doc_id", "n_tokens", capacities).collect()


def check(items, rows, capacities):
    for name, c in capacities.items():
        own = [r for r in rows if r.container == name]
        load = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.piece_size
        assert all(v <= c for v in load.values())
        pieces = {}
        for r in own:
            pieces.setdefault(r.doc_id, []).append((r.piece_no, r.piece_from, r.piece_size))
        assert set(pieces) == {i for i, _ in items}
        for i, n in items:
            n = max(n or 0, 0)
            p = sorted(pieces[i])
            assert len(p) == max(1, -(-n // c)) and sum(x[2] for x in p) == n and [x[1] for x in p] == [k * c for k in range(len(p))]
        total = sum(max(n or 0, 0) for _, n in items)
        assert len(load) <= total / c * 1.1 + 2


def test_pack_all_sizes(spark):
    rnd = random.Random(1)
    items = [(i, int(rnd.paretovariate(0.9) * 40)) for i in range(1500)] + [(10_000, 0), (10_001, 0), (10_002, None), (10_003, -5), (10_004, 1_000_000), (None, 17)] + [(20_000 + i, 33) for i in range(900)]
    caps = {"small": 512, "large": 8192, "one": 1}
    rows = run(spark, [x for x in items if (x[1] or 0) < 100_000], {"one": 1})
    caps.pop("one")
    check(items, run(spark, items, caps), caps)
    check([x for x in items if (x[1] or 0) < 100_000], rows, {"one": 1})


def test_pack_empty(spark):
    assert run(spark, [], {"small": 512}) == []
    assert [(r.container_id, r.piece_size) for r in run(spark, [(1, 0), (2, 0)], {"small": 5})] == [("shared-0", 0)] * 2
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], {"bad": 0})


def test_token_counts(spark):
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    from siltstone.llm.tokens import PATTERN

    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "int main(void) { return 0; }", "固件 图像", "a" * 200_000, " " * 50_000 + "x", "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.n_tokens for r in token_counts(df, ["id"]).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_running_total(spark):
    rows = [("hot" if i % 3 == 0 else f"g{i % 5}", i, i % 7) for i in range(1000)] + [(None, 5000, 3)]
    df = spark.createDataFrame(rows, "g string, i bigint, n int").withColumn("slice", F.pmod(F.xxhash64("i"), F.lit(8)))
    out = running_total(df.fillna("none", ["g"]), ["g"], F.col("n"), ["i"], F.col("slice")).collect()
    groups = {}
    for r in sorted(out, key=lambda r: (r.g, r.slice, r.i)):
        assert r.before == groups.get(r.g, 0)
        groups[r.g] = r.before + r.n


def test_violations_are_seen(spark):
    counted = spark.createDataFrame([(1, 5), (2, 25), (3, 4), (4, 0), (5, None), (6, 3)], "doc_id bigint, n_tokens bigint")
    good = pack(counted, "doc_id", "n_tokens", {"c": 10})
    assert pack_violations(good, counted, {"c": 10}).count() == 0
    bad = [("c", 10, "x", 1, 0, 0, 5), ("c", 10, "x", 2, 0, 0, 25), ("c", 10, "y", 3, 0, 0, 2), ("c", 10, "y", 3, 1, 2, 2), ("c", 10, "z", 4, 0, 0, 0), ("c", 10, "z", 5, 0, 0, 0), ("c", 10, "z", 6, 0, 0, 2)]
    packed = spark.createDataFrame(bad[:6] + bad[6:], "container string, capacity bigint, container_id string, doc_id bigint, piece_no bigint, piece_from bigint, piece_size bigint")
    assert sorted((r.id, r.problem) for r in pack_violations(packed, counted, {"c": 10}).collect()) == [("3", "cut"), ("6", "lost"), ("x", "overfull")]
    assert {(r.id, r.problem) for r in pack_violations(packed.filter("doc_id < 3"), counted, {"c": 10}).collect()} == {("x", "overfull"), ("3", "missing"), ("4", "missing"), ("5", "missing"), ("6", "missing")}
