import json

from siltstone.operators.drift import fields_of, infer_union, records, refused_rows, schema_changes, steady_names, steady_table

SCHEMA = "feed string, file_no int, row_no int, raw string, field string, _v int"


def frame(spark, files):
    """files: {(feed, no): [record or text]}"""
    rows = [(f, n, i, r if isinstance(r, (str, type(None))) else json.dumps(r), "x", 1) for (f, n), rs in files.items() for i, r in enumerate(rs)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    rows = [tuple(r) for r in schema_changes(frame(spark, files), "id").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_added_removed_renamed_retyped(spark):
    a = [{"id": i, "old": f"v{i}", "gone": 1, "n": 1, "same": None} for i in range(10)]
    b = [{"id": i, "new": f"v{i}" if i else "other", "more": [1], "n": "1", "same": None} for i in range(10)]
    want = {("f", 3, "renamed", "old", "new"), ("f", 3, "removed", "gone", ""), ("f", 3, "added", "", "more"), ("f", 3, "type_changed", "n", "n")}
    assert changes(spark, {("f", 1): a, ("f", 3): b}) == want
    b[1]["new"] = "other too"  # eight tenths
    got = changes(spark, {("f", 1): a, ("f", 3): b})
    assert ("f", 3, "removed", "old", "") in got and ("f", 3, "added", "", "new") in got and len(got) == 5


def test_majority_case_and_gaps(spark):
    a = [{"id": i, "A": 1 if i < 6 else "x"} for i in range(10)]
    b = [{"id": i, "A": 1 if i < 4 else "x", "a": 2} for i in range(10)]
    assert changes(spark, {("f", 2): a, ("f", 7): b, ("g", 1): b}) == {("f", 7, "type_changed", "A", "A"), ("f", 7, "added", "", "a")}


def test_damaged_null_empty_repeated(spark):
    assert changes(spark, {}) == set()
    a, b = [{"id": 1, "x": 1}, "{", None, "", "[1]", "5"], [{"id": 1, "x": 1}, {"id": 1, "x": None}]
    assert changes(spark, {("f", 1): a, ("f", 2): ["{broken"], ("f", 3): b}) == set()
    df = frame(spark, {("f", 1): [{"id": 1, "x": 1}], ("f", 2): [{"id": 1, "x": "a"}, {"id": 2, "x": 1}, {"id": 3, "x": 1}]})
    again = df.filter("file_no = 2 AND row_no = 0")
    assert schema_changes(df.unionByName(again).unionByName(again).unionByName(again), "id").count() == 0


def test_rename_without_proof(spark):
    assert changes(spark, {("f", 1): [{"o": 1}], ("f", 2): [{"n": 1}]}) == {("f", 2, "removed", "o", ""), ("f", 2, "added", "", "n")}
    two = changes(spark, {("f", 1): [{"id": 1, "o": "v"}], ("f", 2): [{"id": 1, "m": "v", "n": "v"}]})
    assert two == {("f", 2, "renamed", "o", "m"), ("f", 2, "added", "", "n")}


def test_hot_id(spark):
    a, b = [{"id": "hot", "o": "v", "i": i} for i in range(400)], [{"id": "hot", "n": "v", "i": i} for i in range(400)]
    assert changes(spark, {("f", 1): a, ("f", 2): b}) == {("f", 2, "renamed", "o", "n")}


def test_steady_table(spark):
    long = "y" * 500_000
    files = {("f", 1): [{"id": "1", "s": 1}], ("f", 2): [{"id": "1", "t": 1, "extra": {"k": 1}}], ("f", 3): [{"id": "1", "u": "1"}, {"id": "2", "u": long}, {}]}
    files[("f", 2)][0]["t"] = 1
    df = frame(spark, files)
    ch = schema_changes(df, "id")
    assert {(r.field, r.steady) for r in steady_names(ch).collect()} == {("s", "s"), ("t", "s")}
    rows = {(r.file_no, r.row_no): r for r in steady_table(df, "id", ["id", "s"], ch).collect()}
    assert len(rows) == 5
    assert (rows[1, 0].s, rows[1, 0].s_number, rows[1, 0].s_type) == ("1", 1.0, "number") and rows[2, 0].s == "1"
    assert rows[2, 0]._other == {"extra": '{"k":1}'} and rows[3, 1]._other == {"u": long} and rows[3, 2].id is None


def test_union_keeps_all_types(spark):
    df = frame(spark, {("f", 1): [{"a": 1}, {"a": "x"}, {"a": [1]}, {"a": {"b": 1}}, {"a": True}, {"a": None}, {"a": 2.5}]})
    r = infer_union(fields_of(records(df), []), []).collect()
    assert [tuple(x) for x in r] == [("a", 1, 2, 1, 1, 1, "number")]


def test_odd_records_are_kept(spark):
    deep = '{"a":' + "[" * 5000 + "]" * 5000 + ',"b":1}'
    texts = ['{"a":1,"a":"x"}', deep, '{"a":1} x', '{"a":1}}', '{"a":1}{"b":2}', '{"a":1},{"b":2}', "[1]", "", None, ' {"a":{"a":1,"a":2}}\n']
    df = spark.createDataFrame([("f", 1, i, t) for i, t in enumerate(texts)], "feed string, file_no int, row_no int, raw string")
    got = {(r.row_no, r.field): r.tag for r in fields_of(records(df), ["row_no"]).collect()}
    assert got == {(0, "a"): "text", (1, "a"): "array", (1, "b"): "number", (9, "a"): "object"}
    assert [tuple(r) for r in refused_rows(df, ["feed", "file_no"]).collect()] == [("f", 1, 7)]
