"""Small fixtures for the operators that work below the queries."""

import random

from pyspark.sql import functions as F

from siltstone.functions import firmware as fw
from siltstone.operators import code, evaluation, graph, joins, merging, objects, ranking
from siltstone.plans import mining


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- joins -----------------------------------------------------------------------------------------------------------


def test_point_in_range_borders(spark):
    p = spark.createDataFrame([(0,), (9,), (10,), (19,), (20,), (31,), (None,)], "x int")
    r = spark.createDataFrame([(1, 10, 19), (2, 0, 100), (3, 20, 10), (4, None, 5), (5, 31, 31)], "id int, lo int, hi int")
    got = rows(joins.point_in_range(p, F.col("x"), r, F.col("lo"), F.col("hi"), 8).select("x", "id"))
    assert got == sorted([(x, 2) for x in (0, 9, 10, 19, 20, 31)] + [(10, 1), (19, 1), (31, 5)])


def test_range_overlap_once(spark):
    rnd = random.Random(1)
    mk = lambda n: [(i, (lo := rnd.randrange(200)), lo + rnd.randrange(-2, 60)) for i in range(n)]
    a, b = mk(60), mk(60)
    da, db = spark.createDataFrame(a, "ia int, la int, ha int"), spark.createDataFrame(b, "ib int, lb int, hb int")
    got = rows(joins.range_overlap(da, F.col("la"), F.col("ha"), db, F.col("lb"), F.col("hb"), 16).select("ia", "ib"))
    assert got == sorted((i, j) for i, x, y in a for j, v, w in b if x <= y and v <= w and x <= w and v <= y)


def test_near_and_replace(spark):
    a, b = spark.createDataFrame([(-3.0,), (0.0,), (15.9,), (16.0,), (None,)], "x double"), spark.createDataFrame([(0.0,), (32.0,), (None,)], "y double")
    assert rows(joins.near(a, F.col("x"), b, F.col("y"), 16)) == [(-3.0, 0.0), (0.0, 0.0), (15.9, 0.0), (16.0, 0.0), (16.0, 32.0)]
    t, k = spark.createDataFrame([(1,), (2,), (None,)], "a int"), spark.createDataFrame([(2, 20)], "k int, v int")
    assert {r[0] for r in joins.left_replace(t, "a", k, "k", "v").collect()} == {1, 20, None}


# -- ranking ---------------------------------------------------------------------------------------------------------


def test_islands_gap_border(spark):
    df = spark.createDataFrame([("a", 0, 9), ("a", 41, 50), ("a", 84, 90), ("a", 85, 86), ("b", 5, 100), ("b", 6, 7), ("b", 120, 121), ("c", None, 1)], "k string, lo int, hi int")
    assert rows(ranking.islands(df, ["k"], F.col("lo"), F.col("hi"), F.lit(0x20))) == [("a", 0, 50, 2), ("a", 84, 90, 2), ("b", 5, 121, 3)]


def test_budgets_and_batches(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 4, 9, 1, 0])] + [("b", 0, 50)], "k string, i int, c int")
    assert rows(ranking.budget_suffix(df, ["k"], [F.desc("i")], F.col("c"), 10).select("k", "i")) == [("a", 2), ("a", 3), ("a", 4)]
    got = rows(ranking.ordered_batches(df, ["k"], "i", "c", 2, 10).select("k", "i", "batch"))
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0)]


def test_diverse_fill_with_null_bucket(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else "x", 100 - i) for i in range(12)], "i int, b string, s int")
    got = {r.i: r.phase for r in ranking.diverse_fill(df, ["b"], [F.desc("s"), "i"], 5, 0.2).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3}


# -- graphs ----------------------------------------------------------------------------------------------------------


def test_calls_and_search(spark):
    fn = spark.createDataFrame([("x", "main", "int main() { parse(a, b); helper (1); unknown(); }"), ("x", "parse", "parse(p) { helper(2); }"), ("x", "helper", ""), ("y", "parse", None)], "bin string, name string, code string")
    edges = graph.call_edges(fn, ["bin"], "name", "code")
    assert rows(edges) == [("x", "main", "helper"), ("x", "main", "parse"), ("x", "parse", "helper")]
    assert rows(graph.fan_in(edges, ["bin"])) == [("x", "helper", 2), ("x", "parse", 1)]
    assert rows(graph.unique_callers(edges, ["bin"])) == [("x", "parse", "main")]


def test_bfs_with_circle(spark):
    e = spark.createDataFrame([("b", 1, 2), ("b", 2, 3), ("b", 3, 1), ("b", 3, 4), ("c", 1, 9), ("b", None, 1)], "k string, a int, b int")
    s = spark.createDataFrame([("b", 1), ("c", 5)], "k string, s int")
    assert rows(graph.bounded_bfs(e, "a", "b", s, "s", 3, ["k"])) == [("b", 1, 1, 0), ("b", 1, 2, 1), ("b", 1, 3, 2), ("b", 1, 4, 3), ("c", 5, 5, 0)]


def test_best_first_order_and_budget(spark):
    e = spark.createDataFrame([("b", "s", "a", 0.9, False), ("b", "s", "g", 0.5, True), ("b", "a", "g", 0.9, True), ("b", "g", "h", 1.0, True), ("b", "a", "s", 1.0, False)], "k string, x string, y string, w double, goal boolean")
    s = spark.createDataFrame([("b", "s"), ("z", "q")], "k string, st string")
    got = graph.best_first(e, ["k"], "x", "y", "w", s, "st", F.col("goal"), 3, 50, 5).collect()
    assert [(r.goal, r.path, round(r.score, 4)) for r in got] == [("g", ["s", "a", "g"], 0.81), ("g", ["s", "g"], 0.5)]
    assert graph.best_first(e, ["k"], "x", "y", "w", s, "st", F.col("goal"), 3, 2, 5).count() == 0


# -- evaluation ------------------------------------------------------------------------------------------------------


def test_greedy_ties_and_negatives(spark):
    p = spark.createDataFrame([("k", 1, 1, 0.5), ("k", 1, 2, 0.9), ("k", 2, 2, 0.9), ("k", 2, 1, 0.1), ("k", 3, 3, -1.0), ("k", 4, 4, None)], "k string, g int, p int, s double")
    assert rows(evaluation.greedy_assign(p, ["k"], "g", "p", "s").select("g", "p")) == [(1, 1), (2, 2)]
    assert rows(evaluation.mutual_best(p, ["k"], "g", "p", "s").select("g", "p")) == [(1, 2)]


def test_staged_match(spark):
    g = spark.createDataFrame([("l", 1, 100, "f"), ("l", 2, 200, "g"), ("l", 3, None, "parse"), ("l", 4, None, None), ("m", 1, 5, "z")], "label string, gt_row bigint, address bigint, function_name string")
    p = spark.createDataFrame([("l", 1, 216, "q"), ("l", 2, 100, "zz"), ("l", 3, 999, "my_parse_fn"), ("l", 4, 1, "other"), ("n", 1, 5, "z")], "label string, pred_row bigint, address bigint, function_name string")
    assert rows(evaluation.staged_match(g, p, ["label"])) == [("l", 1, 2, "address"), ("l", 2, 1, "near"), ("l", 3, 3, "function"), ("l", 4, 4, "label")]


def test_rule_verdict(spark):
    df = spark.createDataFrame([(1, "A", True, True), (2, "A", False, None), (3, "A", None, True), (4, "B", True, True), (5, None, True, True)], "i int, label string, x boolean, y boolean")
    out = evaluation.rule_verdict(df, ["i"], [("A", "1", True, F.col("x")), ("A", "2", False, F.col("y"))], "label")
    assert rows(out.select("i", "verdict", "satisfied")) == [(1, "VERIFIED", 2), (2, "REJECTED", 0), (3, "PARTIAL", 1), (4, "UNKNOWN", 0), (5, "UNKNOWN", 0)]


# -- merging and objects ---------------------------------------------------------------------------------------------


def test_upsert_and_unions(spark):
    b = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, n int, s string")
    c = spark.createDataFrame([("a", None, "z"), (None, 5, None), ("new", 7, "q")], "k string, n int, s string")
    assert set(map(tuple, merging.upsert(b, c, ["k"]).collect())) == {("a", 1, "z"), (None, 5, "y"), ("new", 7, "q")}
    u = merging.union_of_sets([spark.createDataFrame([("a", ["x"], 1, None)], "k string, t array<string>, n int, f boolean"), spark.createDataFrame([("a", ["y", "x"], 3, True), ("b", None, None, None)], "k string, t array<string>, n int, f boolean")], ["k"], ["t"], ["n"], ["f"])
    assert rows(u.filter("k = 'a'")) == [("a", ["x", "y"], 3, True)]
    d = spark.createDataFrame([("l", 0), ("l", 5), ("l", 5), ("m", 0)], "k string, a int")
    assert rows(merging.drop_shadowed(d, ["k"], F.col("a") != 0)) == [("l", 5), ("m", 0)]


def test_cascade_and_peers(spark):
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert rows(merging.first_mode([("exact", one), ("near", two)], ["k"])) == [("a", 1, "exact"), ("b", 3, "near")]
    t = spark.createDataFrame([("p1", "unknown", ["s"]), ("p2", "arm", ["s"]), ("p3", None, ["t"]), ("p4", "m0", ["s", "t"]), ("p5", "unknown", None)], "k string, arch string, ids array<string>")
    assert rows(merging.fill_from_peer(t, "k", F.col("ids"), "arch", "unknown").select("k", "arch")) == [("p1", "arm"), ("p2", "arm"), ("p3", "m0"), ("p4", "m0"), ("p5", "unknown")]
    pl = spark.createDataFrame([("a", "x", "s"), ("b", "x", "u"), ("c", "x", "s"), ("d", None, "u")], "k string, l string, kind string")
    assert rows(merging.peer_links(pl, "k", "l", "kind")) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    w = spark.createDataFrame([([" a", "old", "zz", None, "A"],)], "v array<string>").select(merging.whitelist(F.col("v"), {"OLD": "B"}, ["A", "B"]))
    assert w.first()[0] == ["A", "B"]


ACC = "binary_id string, seq bigint, address bigint, kind string, width int, target_addr bigint, base_provenance string, in_isr boolean, function_name string"


def accesses(spark):
    a = [
        ("b", 1, 16, "load", 4, 0x40011004, "CONST", False, "f"), ("b", 2, 20, "load", 4, 0x40011004, "CONST", False, "f"), ("b", 3, 24, "store", 4, 0x40011008, "CONST", False, "g"),
        ("b", 4, 28, "load", 4, 0x40020000, "CONST", True, "isr"), ("b", 5, 32, "store", 4, 0x20000010, "CONST", True, "isr"), ("b", 6, 36, "load", 4, 0x200000F0, "CONST", False, "main"),
        ("b", 7, 40, "store", 4, None, "ARG", False, "h"), ("b", 8, 44, "store", 4, None, "UNKNOWN", False, "h"), ("b", 9, 48, "load", 4, None, "ARG", False, "h"),
        *[("b", 10 + i, 52 + i, "store", 4, 0x40026000 + 4 * i, "GLOBAL_PTR", False, "dma_init") for i in range(5)],
    ]
    return spark.createDataFrame(a, ACC)


def test_objects(spark):
    sym = spark.createDataFrame([("b", "g_ring", 0x20000004), ("b", "g_other", 0x20004000), ("b", "code", 0x08000000)], "binary_id string, symbol string, address bigint")
    o = objects.sram_objects(accesses(spark), sym)
    got = {r.object_id: (r.producer_contexts, r.consumer_contexts, r.members, r.addr_lo, r.addr_hi) for r in o.collect()}
    assert got == {"obj_sram_20000000": (["ISR"], ["MAIN"], ["g_ring"], 0x20000000, 0x200000FF), "obj_sram_20004000": ([], [], ["g_other"], 0x20004000, 0x200040FF)}
    assert [(r.src_context, r.dst_context, r.place) for r in objects.context_edges(o, F.lit(0.5), 3).collect()] == [("ISR", "MAIN", 1)]
    both = spark.createDataFrame([("b", "o", ["len", "buf"], 1), ("b", "p", ["buf2"], 2)], "binary_id string, object_id string, members array<string>, x int")
    assert rows(objects.split_by_members(both, F.col("m") == "len").select("object_id", "members", "x")) == [("o_ctrl", ["len"], 1), ("o_data", ["buf"], 1), ("p", ["buf2"], 2)]
    acc = spark.createDataFrame([("b", 0, 3), ("b", 4, 7), ("b", 100, 103)], "k string, lo int, hi int")
    assert rows(objects.covered_slices(acc, ["k"], F.col("lo"), F.col("hi")).select("lo", "hi", "coverage")) == [(0, 7, 12 / 104), (100, 103, 12 / 104)]


def test_mining(spark):
    a = accesses(spark)
    assert rows(mining.register_reads(a).select("function_name", "address", F.round("confidence", 3))) == [("f", 0x40011004, 0.65)]
    assert rows(mining.register_reads(a, True).select("function_name", "label")) == [("isr", "ISR_MMIO_READ")]
    assert rows(mining.isr_filled_buffers(a).select("function_name", "address")) == [("isr", 0x20000000)]
    assert rows(mining.dma_buffers(a).select("function_name", "address")) == [("dma_init", 0x40026000)]
    stores = rows(mining.store_sinks(a).select("function_name", "address", "confidence"))
    assert [s[:2] for s in stores] == [("h", 40)]  # stores that configure peripherals are no sinks
    assert rows(mining.config_sites(a).select("function_name", "cluster", "n", "pointer_like")) == [("dma_init", 0x40026000, 5, True)]
    calls = spark.createDataFrame([("b", "f", "memcpy", 5, ["d", "s", "n"]), ("b", "f", "memcpy", 3, ["d", "s", "16"]), ("b", "g", "memcpy", 1, ["d", "s", "len"]), ("b", "memcpy", "memcpy", 0, [])], "binary_id string, function_name string, callee string, at int, args array<string>")
    got = {r.function_name: (r.address, round(r.confidence, 3)) for r in mining.copy_sinks(calls, {"memcpy": 2}).collect()}
    assert got == {"f": (3, 0.55), "g": (1, 0.7)}
    f = spark.createDataFrame([
        ("b", "fill", 64, "void fill(char *d, int n) { for (i = 0; i < n; i++) { d[i] = 0; } }"), ("b", "mv", 65, "void mv(void) { while (n--) { *p++ = *q++; } }"), ("b", "gets_n", 66, "for (i = 0; i < n - 1; i++) { b[i] = c; } b[n - 1] = 0;"),
        ("b", "par", 67, "void par(T *t) { t->x = 1; }"), ("b", "say", 68, "void say(char *m) { printf(m); printf(\"ok\"); memset(b, 0, n); }"), ("b", "hop", 69, "void hop(int i) { (*tab[i])(1); }"), ("b", "cpy", 70, "void cpy(void) { do { *param_1 = *param_2; param_1++; param_3--; } while (param_3 != 0); }"), ("b", "__lib", 71, "for (i = 0; i < n; i++) { d[i] = 0; }"),
    ], "binary_id string, function_name string, function_address bigint, code string")
    assert rows(mining.loop_sinks(f).select("function_name", "label", "bound")) == [("cpy", "COPY_SINK", "0"), ("fill", "LOOP_WRITE_SINK", "n"), ("mv", "COPY_SINK", "n")]
    index = mining.access_index(f)
    assert rows(mining.parameter_store_sinks(f, mining.store_sinks(index, f)).select("function_name", "base")) == [("cpy", "param_1"), ("par", "t")]
    sites = mining.call_sites(f, ["printf", "memset"])
    assert rows(mining.format_sinks(sites).select("function_name", "format_arg")) == [("say", "m")] and rows(mining.fill_sinks(sites).select("function_name", "length_expr")) == [("say", "n")]
    assert rows(mining.pointer_call_sinks(f).select("function_name", "shape")) == [("hop", "table")]
    assert rows(mining.copying_functions(f).select("function_name", "acts_as")) == [("cpy", "strcpy")]
    waits = spark.createDataFrame([("b", "w", 1, "while ((*(uint *)0x40011000 & 8) == 0) { } x = *(uint *)0x40011004;"), ("b", "v", 2, "while (w() & 1) { } y = *(uint *)0x40011008;")], f.schema)
    assert rows(mining.polled(mining.access_index(waits), waits).select("function_name", "target_addr", "direct")) == [("v", 0x40011008, False), ("w", 0x40011000, True)]
    p = mining.packs(mining.dma_buffers(a)).first().pack_id
    assert p.startswith("DMA_BACKED_BUFFER@dma_init-0x40026000-") and len(p.rsplit("-", 1)[1]) == 6


# -- code and scalars --------------------------------------------------------------------------------------------------


def test_text_columns(spark):
    t = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('noise {"b": 2} tail',), ("[1]",), ("no",), (None,)], "t string")
    assert [r[0] for r in t.select(code.json_payload(F.col("t"))).collect()] == ['{"a": 1}\n', '{"b": 2}', "[1]", None, None]
    assert spark.range(1).select(code.fenced_blocks(F.lit("a\n```c\nx;\n```\n```\ny\n```"))).first()[0] == ["x;\n", "y\n"]
    names = spark.createDataFrame([("RxParseHTTPFrame_v2",), ("",), (None,)], "n string").select(fw.name_tokens(F.col("n")), fw.slug(F.col("n")), fw.function_address(F.lit("FUN_08001234")))
    assert [tuple(r)[:2] for r in names.collect()] == [(["rx", "parse", "httpframe", "v2"], "rxparsehttpframe_v2"), ([], ""), (None, None)]
    pairs = [("a->b", "A.b", True), ("len", "pkt_len", True), ("x_y_z", "q_w", False), (None, "a", False)]
    got = spark.createDataFrame(pairs, "a string, b string, w boolean").select(fw.compatible(F.col("a"), F.col("b")), "w").collect()
    assert all(r[0] == r[1] for r in got)


def test_scalar_borders(spark):
    n = spark.createDataFrame([(0, 0), (-5, 0), (1, 1), (2, 2), (3, 4), (1024, 1024), (1025, 2048)], "n bigint, w bigint")
    assert all(r[0] == r[1] for r in n.select(fw.next_power_of_two(F.col("n")), "w").collect())
    b = spark.createDataFrame([(0x42000000, 0x40000000), (0x42000000 + 32 * 7 + 12, 0x40000004), (0x40000008, 0x40000008)], "a bigint, w bigint")
    assert all(r[0] == r[1] for r in b.select(fw.canonical_bitband(F.col("a")), "w").collect())
    p = spark.createDataFrame([(0.125, 12), (0.135, 14), (2.0, 100), (-1.0, 0)], "x double, w int")
    assert all(r[0] == r[1] for r in p.select(fw.percent(F.col("x")), "w").collect())
