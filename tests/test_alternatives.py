import json
import random

from siltstone.operators.drift import TAGS, appearing_types

SCHEMA = "feed string, file_no int, row_no int, raw string"


def read(spark, rows):
    df = spark.createDataFrame([(f, n, i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, (f, n, r) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in appearing_types(df).collect())


def test_minority_and_nested_types(spark):
    rows = [("f", 1, {"a": 1, "o": {"p": "x", "l": [1]}}), ("f", 3, {"a": 1, "o": {"p": "x", "l": [1, "s"]}}), ("f", 3, {"a": 2}), ("f", 3, {"a": "late", "o": {"p": None}})]
    rows += [("f", 7, {"a": "x", "o": {"p": {"q": 1}}}), ("f", 7, {"a": [True]}), ("f", 8, "{"), ("f", 9, None), ("g", 1, {"a": "x"}), ("g", 2, "[1]")]
    assert read(spark, rows) == [("f", "a", "array", 7, 1, "number,text"), ("f", "a", "text", 3, 1, "number"), ("f", "o/l/*", "text", 3, 1, "number"), ("f", "o/p", "object", 7, 1, "text")]
    assert read(spark, []) == []


def test_random_against_brute_force(spark):
    rnd = random.Random(2)
    value = lambda: rnd.choice([1, 2.5, "x", True, None, {"k": rnd.choice([1, "y"])}, [1, "z"]])
    rows = [(rnd.choice("fg"), rnd.randrange(9), {"a": value(), "b": {"c": value()}}) for _ in range(60)]
    seen = {}

    def walk(at, path, v):
        tag = {bool: "boolean", str: "text", dict: "object", list: "array"}.get(type(v), "number")
        if v is None:
            return
        if path:
            n = seen.setdefault((at[0], path), {}).setdefault(tag, {})
            n[at[1]] = n.get(at[1], 0) + 1
        for k, x in v.items() if isinstance(v, dict) else (("*", x) for x in v) if isinstance(v, list) else ():
            walk(at, f"{path}/{k}".strip("/"), x)

    for f, n, r in rows:
        walk((f, n), "", r)
    want = []
    for (f, path), tags in seen.items():
        first = sorted((min(n), -n[min(n)], TAGS.index(t), t) for t, n in tags.items())
        want += [(f, path, t, n, -c, ",".join(x[3] for x in first[:i])) for i, (n, c, _, t) in enumerate(first) if i]
    assert read(spark, rows) == sorted(want) and want
