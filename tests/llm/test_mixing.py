import random

import numpy as np
import pytest

from siltstone.llm.mixing import mix_violations, Target, mix, mix_shares, permuted, token_blocks

SCHEMA = "doc_id bigint, source string, n_tokens bigint, block_no string, _start int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation_is_one_to_one(n):
    for key in (0, 5, 10**12):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    if n > 100:
        assert list(permuted(np.arange(n), np.full(n, n), np.full(n, 1))) != list(permuted(np.arange(n), np.full(n, n), np.full(n, 2)))


def test_blocks_cover_every_token_once(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("abb"), rnd.randrange(0, 300)) for i in range(400)] + [(1000, "a", 100_000), (1001, "a", 0), (1002, "b", None)]
    got = token_blocks(frame(spark, rows), "source", "doc_id", "n_tokens", 64).collect()
    blocks, docs = {}, {}
    for r in got:
        blocks[r.source, r.block_no] = blocks.get((r.source, r.block_no), 0) + r.n
        docs.setdefault(r.doc_id, []).append((r.item_from, r.n))
    for s in "ab":
        own = sorted(b for b in blocks if b[0] == s)
        assert [b[1] for b in own] == list(range(len(own))) and all(blocks[b] == 64 for b in own[:-1])
    for i, _, n in rows:
        at = 0
        for start, k in sorted(docs.get(i, [])):
            assert start == at
            at += k
        assert at == (n or 0)


def test_mix_keeps_caps_and_nears_shares(spark):
    rows = [(i, "big", 500) for i in range(3000)] + [(10_000 + i, "mid", 300) for i in range(1500)] + [(20_000 + i, "small", 200) for i in range(150)] + [(30_000, "unwanted", 900), (30_001, None, 900), (30_002, "big", None)]
    targets = [Target("big", 0.5, 1), Target("mid", 0.3, 2), Target("small", 0.1, 4), Target("absent", 0.1, 3)]
    df = mix(frame(spark, rows), "source", "doc_id", "n_tokens", targets, block=64)
    got = df.collect()
    uses, slots = {}, set()
    for r in got:
        uses.setdefault((r.source, r.block_no), set()).add((r.shard, r.slot))
        slots.add((r.shard, r.slot, r.source, r.block_no, r.repeat_no))
    assert len({s[:2] for s in slots}) == len(slots)  # a slot holds one block
    caps = {t.source: t.max_repeats for t in targets}
    assert all(len(u) <= caps[k[0]] for k, u in uses.items())
    assert {k[0] for k in uses} == {"big", "mid", "small"}
    shares = {r.source: r for r in mix_shares(df, targets).collect()}
    assert shares["absent"].tokens == 0 and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    for s, want in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(shares[s].actual_share - want) < 0.03
    assert shares["small"].most_repeats == 4
    again = mix(frame(spark, rows), "source", "doc_id", "n_tokens", targets, block=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert len(df.filter("repeat_no = 0").select("source", "block_no").distinct().collect()) == len({k for k in uses if any(True for _ in uses[k])} & {(r.source, r.block_no) for r in got if r.repeat_no == 0})


def test_nothing_to_mix(spark):
    assert mix(frame(spark, []), "source", "doc_id", "n_tokens", [Target("a", 1.0, 1)]).count() == 0
    assert mix(frame(spark, [(1, "a", 5)]), "source", "doc_id", "n_tokens", []).count() == 0
    assert mix(frame(spark, [(1, "a", 0), (2, None, 5)]), "source", "doc_id", "n_tokens", [Target("a", 1.0, 1)]).count() == 0
    assert [tuple(r) for r in mix_shares(mix(frame(spark, []), "source", "doc_id", "n_tokens", [Target("a", 1.0, 1)]), [Target("a", 1.0, 1)]).collect()] == [("a", 1.0, 0.0, 0, 0)]


def test_repeated_rows_count_once(spark):
    one = mix(frame(spark, [(1, "a", 200)] * 5 + [(2, "a", 100)]), "source", "doc_id", "n_tokens", [Target("a", 1.0, 1)], block=50)
    assert sum(r.n for r in one.collect()) == 300


def test_violations_are_seen(spark):
    counted = spark.createDataFrame([(1, 100), (2, 30)], "doc_id bigint, n_tokens bigint")
    rows = [(0, 0, "a", 0, 0, 1, 0, 50), (0, 1, "a", 0, 1, 1, 0, 50), (0, 2, "a", 1, 0, 1, 60, 50), (0, 2, "b", 0, 0, 2, 0, 10), (0, 3, "c", 0, 0, 2, 0, 10), (0, 4, "b", 1, 0, 2, 0, 30), (0, 4, "b", 1, 0, 2, 0, 30)]
    mixed = spark.createDataFrame(rows, "shard bigint, slot bigint, source string, block_no bigint, repeat_no bigint, doc_id bigint, item_from bigint, n bigint")
    got = {tuple(r) for r in mix_violations(mixed, counted, [Target("a", 0.5, 1), Target("b", 0.5, 2)], "doc_id", "n_tokens", 50).collect()}
    assert got == {("a", "capped"), ("a", "slot"), ("a", "beyond"), ("b", "long"), ("c", "unwanted"), ("c", "capped")}
