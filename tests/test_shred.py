import json

from siltstone.functions.jsontext import Number, _deep, parse, unwrapped, write
from siltstone.operators.shred import Entity, Shape, child_rows, entity_table, open_table, shred

SHAPE = {"doc": Shape(lists=frozenset({"doc", "doc/*/sites", "doc/*/names"}), plain_lists=frozenset({"doc/*/names"}), open_parts=frozenset({"doc/*/facts"}))}
ENTITIES = [Entity("node", "doc", "id"), Entity("site", "doc/*/sites", "fn"), Entity("name", "doc/*/names", bare=True), Entity("fact", "doc/*/facts", open_part=True)]


def rows(spark, docs):
    df = spark.createDataFrame([(str(i), d, 5, "x") for i, d in enumerate(docs)], "rid string, doc string, node int, path string")
    return sorted(tuple(r) for r in child_rows(shred(df, "rid", SHAPE), ENTITIES).collect())


def test_nesting_positions_and_keys(spark):
    doc = [None, {"id": "a", "sites": [{"fn": "f"}, None, {"x": 1}], "names": ["n", None, 3], "facts": {"p": {"q": [1, {"r": True}, None]}, "s": None}}, {}]
    assert rows(spark, [json.dumps(doc)]) == sorted([
        ("0", "node", 0, 1, "a"), ("0", "node", 0, 2, ""), ("0", "site", 1, 0, "f"), ("0", "site", 1, 2, ""),
        ("0", "name", 1, 0, "n"), ("0", "name", 1, 2, "3"), ("0", "fact", 1, 0, "p.q.0"), ("0", "fact", 1, 0, "p.q.1.r"),
    ])


def test_bare_elements_and_wrapped_text(spark):
    inner = {"id": "a", "sites": json.dumps({"fn": "f"}), "names": "solo", "facts": json.dumps({"k": 1.50})}
    want = sorted([("0", "node", 0, 0, "a"), ("0", "site", 0, 0, "f"), ("0", "name", 0, 0, "solo"), ("0", "fact", 0, 0, "k")])
    for doc in (inner, [inner], [json.dumps(inner)]):
        assert rows(spark, [json.dumps(doc)]) == want
    assert rows(spark, [json.dumps(json.dumps([inner]))]) == want
    assert rows(spark, [json.dumps({"names": json.dumps(["x", None, "y"])})]) == [("0", "name", 0, 0, "x"), ("0", "name", 0, 2, "y"), ("0", "node", 0, 0, "")]


def test_invalid_null_empty(spark):
    assert rows(spark, [None, "", "{", "[1,", "NaN", "[NaN]", "null", "[]", "{}x", "[" * 100_000, "[1]" * 2]) == []
    assert rows(spark, []) == []
    assert rows(spark, ["{}"]) == [("0", "node", 0, 0, "")]


def test_repeats_and_redelivery(spark):
    df = spark.createDataFrame([("a", '[{"id":"1"}]'), ("a", '[{"id":"1"}]'), ("a", '[{"id":"1"},{"id":"2"}]'), (None, '[{"id":"3"}]')], "rid string, doc string")
    got = sorted((str(r[0]), *r[1:]) for r in child_rows(shred(df, "rid", SHAPE), ENTITIES).collect())
    assert got == [("None", "node", 0, 0, "3"), ("a", "node", 0, 0, "1"), ("a", "node", 0, 1, "2")]


def test_large_document_and_odd_text(spark):
    n = 120_000
    doc = [{"id": f"o{i}", "names": ["\ud800x", "é"]} for i in range(n)]
    got = child_rows(shred(spark.createDataFrame([("big", json.dumps(doc))], "rid string, doc string"), "rid", SHAPE), ENTITIES)
    assert got.groupBy("child_table").count().orderBy("child_table").collect() == [("name", 2 * n), ("node", n)]


def test_entity_table(spark):
    df = spark.createDataFrame([("a", '[{"id":"1","c":0.50,"sites":[{"fn":"f","at":"0x1"}]},{"id":null}]')], "rid string, doc string")
    adj = shred(df, "rid", SHAPE)
    assert [tuple(r)[2:] for r in entity_table(adj, "doc", ["id", "c"]).orderBy("child_no").collect()] == [(0, 0, "1", "0.50"), (0, 1, None, None)]
    assert [tuple(r)[2:] for r in entity_table(adj, "doc/*/sites", ["fn", "at"]).collect()] == [(0, 0, "f", "0x1")]


def test_adjacency_rebuilds_document(spark):
    doc = {"a": [1, {"b": "x"}], "c": {"d": None, "e": True}}
    df = spark.createDataFrame([("r", json.dumps(doc))], "rid string, doc string")
    nodes = {r.node: r for r in shred(df, "rid", {"doc": Shape()}).collect()}

    def build(n):
        r = nodes[n]
        kids = sorted((k for k in nodes.values() if k.parent == n), key=lambda k: k.ordinal)
        if r.kind == "object":
            return {k.label: build(k.node) for k in kids}
        if r.kind == "array":
            return [build(k.node) for k in kids]
        return None if r.kind == "null" else r.scalar == "true" if r.kind == "boolean" else int(r.scalar) if r.kind == "number" else r.scalar

    assert build(0) == doc


def test_unwrapped():
    assert unwrapped('"[1]"') == ["1"] and unwrapped("[x") == "[x" and unwrapped('"x"') == '"x"' and unwrapped(5) == 5
    assert parse("[1] ")[0] and not parse("[Infinity]")[0]


def test_any_depth(spark):
    deep = 100_000
    text = '[{"id":"a","facts":' + '{"k":' * deep + "1" + "}" * deep + "}]"
    df = spark.createDataFrame([("r", text)], "rid string, doc string")
    got = open_table(shred(df, "rid", SHAPE), "doc/*/facts").collect()
    assert [(len(r.trail), r.value) for r in got] == [(2 * deep - 1, "1")]
    assert rows(spark, [text])[1] == ("0", "node", 0, 0, "a")
    lists = spark.createDataFrame([("r", "[" * 20_000 + "]" * 20_000)], "rid string, doc string")
    got = shred(lists, "rid", {"doc": Shape()})
    assert got.count() == 20_000 and got.filter("length(path) > 500").count() == 0


def test_parser_agrees_with_the_standard_one():
    texts = ['{"a":1,"a":{"b":[1.50,-2e3,"\\u00e9",true,null]}}', "[ ]", '{ "x" : [ { } , "" ] }', '"s"', "5"]
    for t in texts:
        assert _deep(t) == parse(t)[1] and parse(write(_deep(t)))[1] == _deep(t)
    assert _deep("1.50") == Number("1.50") and _deep('{"a":1,"a":2}') == {"a": "2"}
    for t in ("", "[1,]", '{"a"}', '{"a":}', "{,}", "[1 2]", "1 2", '{"a":1,}', "]", '{"a":1]', "tru", "01", "[01]"):
        try:
            _deep(t)
            raise AssertionError(t)
        except ValueError:
            pass


def test_repeated_names_and_clashing_labels(spark):
    df = spark.createDataFrame([("r", '[{"id":"a","id":"b","*":{"id":"x"}}]')], "rid string, doc string")
    assert [r.child_key for r in child_rows(shred(df, "rid", SHAPE), ENTITIES[:1]).collect()] == ["b"]
