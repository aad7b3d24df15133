import random

import numpy as np
import pytest

from siltstone.llm.spans import Sketch, _gram_hash, _sliding_min, repeated_runs, shared_share, shared_span_classes, shared_span_pairs, sketch_for

SCHEMA = "doc_id bigint, text string, id string, h int, place string"
SMALL = Sketch(4, 16)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], SCHEMA)


def brute(texts, span):
    where = {}
    for i, t in texts:
        for k in range(len(t or "") - span + 1):
            where.setdefault(t[k : k + span], set()).add(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if None not in (a, b) and a < b}
    cover = {}
    for i, t in texts:
        hit = [False] * len(t or "")
        for k in range(len(t or "") - span + 1):
            if len(where[t[k : k + span]] - {None}) > 1:
                hit[k : k + span] = [True] * span
        cover[i] = max(cover.get(i, 0), sum(hit))
    return pairs, cover


def check(spark, texts, span, sketch=SMALL, broadcast=1 << 20):
    pairs, cover = brute(texts, span)
    got = [tuple(r) for r in shared_span_pairs(frame(spark, texts), span=span, sketch=sketch, broadcast=broadcast).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    share = {r.doc_id: r.shared_chars for r in shared_share(frame(spark, texts), span=span, sketch=sketch, broadcast=broadcast).collect()}
    assert share == {i: c for i, c in cover.items() if i is not None and dict(texts)[i] is not None}


def test_random_quotes(spark):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdef \n{}();é固") for _ in range(n))
    quotes = [text(n) for n in (19, 20, 21, 40, 200)]
    texts = []
    for i in range(120):
        parts = [text(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(quotes), text(rnd.randrange(0, 40))]
        texts.append((i, "".join(parts)))
    texts += [(500, texts[3][1]), (501, texts[3][1]), (502, ""), (503, "short"), (504, None), (505, "ab" * 300), (506, "ba" * 200), (507, "a" * 400), (508, "a" * 20), (509, "a" * 19)]
    check(spark, texts, 20)
    check(spark, texts, 20, broadcast=0)  # the sketch stays cut by hash
    check(spark, texts, 20, sketch=None)
    copies = {r.doc_id: (r.class_id, r.copies) for r in shared_span_classes(frame(spark, texts), span=20, sketch=SMALL).collect()}
    assert copies[500] == copies[501] == (3, 3) and 503 not in copies and copies[507] == (507, 1)


@pytest.mark.parametrize("shared", [199, 200, 201])
def test_border_of_200(spark, shared):
    rnd = random.Random(shared)
    text = lambda n: "".join(chr(rnd.randrange(97, 123)) for _ in range(n))
    q = text(shared)
    texts = [(1, text(300) + "1" + q + "1" + text(50)), (2, q + "2" + text(10)), (3, text(777) + "3" + q), (4, text(400))]
    got = {tuple(r) for r in shared_span_pairs(frame(spark, texts), sketch=SMALL).collect()}
    assert got == ({(1, 2), (1, 3), (2, 3)} if shared >= 200 else set())


def test_saturated_sketch_loses_nothing(spark):
    rnd = random.Random(9)
    words = ["alpha ", "beta ", "gamma ", "delta\n"]
    texts = [(i, "".join(rnd.choice(words) for _ in range(60))) for i in range(60)]
    check(spark, texts, 20, Sketch(1, 4, 1))


def test_stock_line_case_space_and_repeats(spark):
    line = "This stock line stands in every text and is longer than the span asked for."
    texts = [(i, f"{chr(97 + i % 26)}{i}" + line + f"{i}") for i in range(60)] + [(100, line.upper()), (101, line.replace(" ", "  "))]
    check(spark, texts + texts[:5], 30)


def test_empty_null_id_and_long(spark):
    assert shared_span_pairs(frame(spark, []), sketch=SMALL).count() == 0 and shared_share(frame(spark, []), sketch=SMALL).count() == 0
    rnd = random.Random(8)
    long = "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(400_000))
    texts = [(1, long), (2, "x" + long[399_000:399_300]), (None, long), (3, "\U0001f600" * 250), (4, "\U0001f600" * 230 + "y")]
    assert {tuple(r) for r in shared_span_pairs(frame(spark, texts), sketch=SMALL).collect()} == {(1, 2), (3, 4)}


def test_hashes_follow_content():
    a = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in (1, 2, 3, 7, 100, 101, 200):
            h = _gram_hash(np.r_[a, a], k)
            assert len(h) == 1000 - k + 1 and (h[: 500 - k + 1] == h[500 : 1000 - k + 1]).all() and len(np.unique(h[:400])) == 400
    for w in (1, 2, 3, 100):
        assert (_sliding_min(a, w) == [a[i : i + w].min() for i in range(500 - w + 1)]).all()


def test_sketch_grows_with_the_input(spark):
    rnd = random.Random(1)
    alone = lambda n: [(i, "".join(chr(rnd.randrange(97, 123)) for _ in range(2000))) for i in range(n)]
    passed = []
    for n in (50, 500):
        docs = frame(spark, alone(n)).selectExpr("doc_id AS id", "text")
        sketch = sketch_for(docs, 200, 1)
        assert sketch.merged_bytes <= 3 << 18
        passed.append(repeated_runs(docs, 200, Sketch(sketch.segments, 13 if n == 50 else 16), True).count() / n)
    assert sketch_for(docs.limit(0), 200) == Sketch(1, 18)
    assert max(passed) < 2  # of about thirty-five runs a text
