"""Address resolution on small texts."""

from pyspark.sql import functions as F

from siltstone.operators import code, resolve


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_bases_and_offsets(spark):
    text = "base = 0x20000000;\nbase = 0x40011000;\nbase = x + 0x40020000 + y;\n*(uint *)(base + 0x14) = v;\n*(uint *)(other + 4) = v;"
    df = spark.createDataFrame([("f", text), ("g", "*(uint *)(base + 0x14) = v;"), ("n", None)], "k string, t string")
    b = resolve.base_assignments(df, ["k"], "t")
    assert rows(b) == [("f", "base", 0x40020000)]
    symbols = spark.createDataFrame([("other", 0x20000100)], "symbol string, address bigint")
    found = resolve.resolved_accesses(code.memory_accesses(df, ["k"], "t"), ["k"], b, symbols)
    got = rows(found.select("k", "line_no", "kind", "base_provenance", "target_addr").fillna(0))
    assert got == [("f", 3, "store", "INTRA_RESOLVED", 0x40020014), ("f", 4, "store", "GLOBAL_PTR", 0x20000100), ("g", 0, "store", "UNKNOWN", 0)]
    masks = spark.createDataFrame([("f", "a = x & 0xfffffff0;\nb = (y & 3) + 0xe000e100;\nc == 0x40000000;")], "k string, t string")
    assert rows(resolve.base_assignments(masks, ["k"], "t")) == [("f", "b", 0xE000E100)]


def test_types_and_fields(spark):
    df = spark.createDataFrame([("f", "void init(USART_TypeDef *u, int n) { u->CR1 = 1; u->CR1 |= 2; w->X = 0; }\np = (USART_TypeDef *)0x40013800; q = (Other *)0x40000000; r = (USART_TypeDef *)0x20000000;")], "k string, t string")
    known = spark.createDataFrame([("USART_TypeDef", "CR1", 12)], "type string, field string, offset int")
    b = resolve.typed_bases(df, ["k"], "t", known)
    f = resolve.field_accesses(df, ["k"], "t")
    assert rows(b) == [("f", "USART_TypeDef", 0x40013800)] and rows(f) == [("f", "u", "USART_TypeDef", "CR1", 2)]
    assert [r.target for r in resolve.struct_targets(f, b, known, ["k"]).collect()] == [0x4001380C]


def test_derefs_and_bindings(spark):
    df = spark.createDataFrame([("b", "callee", "*(uint *)(param_1 + 0x10) = 1; x = *(byte *)(*(int *)(param_2 + 4) + 8);")], "k string, function_name string, t string")
    d = resolve.parameter_derefs(df, ["k", "function_name"], "t")
    assert rows(d.select("param", F.coalesce("struct_offset", F.lit(-1)), "offset", "type")) == [(1, -1, 16, "uint"), (2, 4, 8, "byte")]
    calls = spark.createDataFrame([("b", "a", "callee", ["(uint *)0x40011000", "&DAT_20000100"]), ("b", "z", "callee", ["x", "0x20000100"]), ("b", "mid", "callee", ["param_1", "0"]), ("b", "top", "mid", ["0x40020000"])], "k string, caller string, callee string, args array<string>")
    words = spark.createDataFrame([("b", 0x20000104, 0x40030000)], "k string, address bigint, value bigint")
    got = rows(resolve.bind_parameters(d, calls, ["k"], words).select("caller", "param", "target"))
    assert got == [("a", 1, 0x40011010), ("a", 2, 0x40030008), ("z", 2, 0x40030008)]
    up = resolve.forwarded_calls(calls, ["k"])
    assert rows(up) == [("b", "top", "callee", ["0x40020000", "0"])]
    assert rows(resolve.bind_parameters(d, up, ["k"]).select("caller", "target")) == [("top", 0x40020010)]


def test_argument_kinds(spark):
    cases = [("16", "constant", 16), ("(uint)0x10", "constant", 16), ('"fmt"', "literal", None), ("&DAT_20000010", "address", 0x20000010), ("param_2", "parameter", None), ("local_18", "stack", None), ("a + b", "unknown", None), (None, "unknown", None)]
    df = spark.createDataFrame(cases, "a string, k string, v bigint").select(resolve.argument_kind(F.col("a")), "k", resolve.argument_value(F.col("a")), "v")
    assert all(r[0] == r[1] and r[2] == r[3] for r in df.collect())


def test_signatures_calls_clamps(spark):
    t = "void f(uint8_t *dst, int n, char **s)\n{ if (n > 64) { n = 64; } m = min(m, cap); if (n > 64) { n = 65; } (*cb)(x); (*t->fn)(y); (*tab[i])(z); (**(code **)(p + 4))(q); }"
    df = spark.createDataFrame([("k", t)], "k string, t string")
    assert rows(resolve.pointer_parameters(df, ["k"], "t")) == [("k", "f", "dst"), ("k", "f", "s")]
    assert rows(code.clamps(df, ["k"], "t").select("variable", "clamp")) == [("m", "m = min(m, cap)"), ("n", "if (n > 64) { n = 64"), ("n", "if (n > 64) { n = 65")]
    assert sorted(r.shape for r in resolve.indirect_calls(df, ["k"], "t").collect()) == ["cast", "field", "name", "table"]


def test_formats_facts_decodings(spark):
    calls = spark.createDataFrame([("f", "printf", ['"%d"', "x"]), ("f", "printf", ["s"]), ("g", "printf", ['"a"'])], "function_name string, callee string, args array<string>")
    assert rows(resolve.constant_formats(calls, {"printf": 0})) == [("f", "printf", False, 2), ("g", "printf", True, 1)]
    m = spark.createDataFrame([("p", {"a": "1", "b": " ", "c": "x"})], "k string, m map<string,string>")
    assert rows(resolve.unpivot_facts(m, ["k"], "m", ["a", "b", "z"])) == [("p", "a", "1")]
    d = spark.createDataFrame([("aGVsbG8=",), ("68656c6c6f",), ("a%20b",), ("zz!",), (None,)], "t string").select(resolve.decodings(F.col("t")))
    assert [r[0] for r in d.collect()] == [{"base64": "hello"}, {"hex": "hello"}, {"url": "a b"}, {}, {}]
    b = spark.createDataFrame([(bytearray(b"\x00\x01hello\x00ab\x00world!"),)], "b binary").select(resolve.printable(F.col("b")))
    assert b.first()[0] == ["hello", "world!"]


def test_few_types_are_many_tasks_work(spark):
    uses = spark.range(3000).selectExpr("id", "CAST(id % 2 AS INT) AS type", "'f' AS field")
    bases = spark.range(100).selectExpr("CAST(id % 2 AS INT) AS type", "id * 16 AS base")
    offsets = spark.createDataFrame([(0, "f", 1), (1, "f", 2), (2, "f", 3)], "type int, field string, offset int")
    got = resolve.struct_targets(uses, bases.unionByName(bases), offsets, [], rows_a_task=10_000)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 15 and sum(sizes) == 3000 * 50 and max(sizes) < 12_000
    assert got.filter("target <> base + 1 + type OR (base / 16) % 2 <> type").isEmpty()
