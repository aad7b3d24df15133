import json

from siltstone.operators.drift import schema_changes, steady_names, steady_table


def test_field_that_comes_back_beside_its_successor(spark):
    files = {1: {"id": "1", "a": "v", "x": "w"}, 2: {"id": "1", "b": "v", "y": "w"}, 3: {"id": "1", "b": "v", "a": 5, "y": "w", "x": "n"}, 4: {"id": "1", "a": 7, "x": "m"}, 5: {"id": "1", "b": "back", "a": 8}}
    df = spark.createDataFrame([("f", n, 0, json.dumps(r)) for n, r in files.items()], "feed string, file_no int, row_no int, raw string")
    changes = schema_changes(df, "id")
    names = {(r.field, r.from_file, r.till_file, r.steady) for r in steady_names(changes).collect()}
    assert ("a", 3, None, "a@3") in names and ("b", 2, 3, "a") in names
    rows = {r.file_no: r for r in steady_table(df, "id", ["id", "a"], changes).collect()}
    assert [(rows[n].a, rows[n].a_number, rows[n].a_type) for n in range(1, 6)] == [("v", None, "text"), ("v", None, "text"), ("v", None, "text"), (None, None, None), ("back", None, "text")]
    assert rows[3]._other == {"x": "w", "x@3": "n", "a@3": "5"} and rows[4]._other == {"a@3": "7", "x@3": "m"} and rows[5]._other == {"a@3": "8"}


def test_names_passed_on_within_a_file(spark):
    changes = spark.createDataFrame([("f", 2, "renamed", "a", "b"), ("f", 2, "renamed", "b", "c"), ("f", 3, "removed", "c", ""), ("f", 4, "added", "", "c")], "feed string, file_no int, change_kind string, old_field string, new_field string")
    got = {(r.field, r.from_file, r.till_file, r.steady) for r in steady_names(changes).collect()}
    assert got == {("a", None, 1, "a"), ("b", None, 1, "b"), ("b", 2, None, "a"), ("c", 2, 2, "b"), ("c", 4, None, "b")}
