"""Roots, checks and obligations on small fixtures."""

from pyspark.sql import functions as F

from siltstone.operators import checks, roots
from siltstone.plans import obligations

SINK = "binary_id string, function_name string, pack_id string, label string, facts map<string,string>, args array<string>, extra int"
FUN = "binary_id string, function_name string, code string"


def test_canonical_and_paths(spark):
    cases = [("(uint)p->len", "p.len"), ("( a + b )", "a+b"), ("*(void **)(x)", "*(x)"), ("(char *)Buf", "buf"), ("", None), (None, None)]
    df = spark.createDataFrame(cases, "e string, want string")
    assert [r for r in df.select(roots.canonical(F.col("e")).alias("got"), "want").collect() if r.got != r.want] == []
    a = spark.createDataFrame([("pkt->hdr.len",), ("buf[i]",), ("0x40011000",), (None,)], "e string").select(roots.aliases(F.col("e")).alias("a"), roots.path_of(F.col("e")).alias("p")).collect()
    assert {"pkt->hdr.len", "pkt.hdr.len", "pkt", "len", "hdr.len", "pkt.hdr", "pkt.hdr.tot_len"} <= set(a[0].a) and a[0].p.path_kind == "member_path" and a[0].p.path_leaf == "len"
    assert a[1].p.path_kind == "indexed_path" and a[1].p.path_leaf == "buf" and a[2].p.path_kind == "literal_addr"
    fam = spark.createDataFrame([("length", "length"), ("src_data", "pointer"), ("dispatch", "dispatch"), (None, "unknown")], "k string, w string")
    assert all(r[0] == r[1] for r in fam.select(roots.family(F.col("k")), "w").collect())


def test_roots_from_facts_arguments_and_text(spark):
    sinks = spark.createDataFrame([
        ("b", "f", "p1", "COPY_SINK", {"len_expr": " n ", "other": "x"}, ["d", "s", "m"], 1), ("b", "f", "p2", "COPY_SINK", {}, ["d", "s"], 1), ("b", "f", "p3", "STORE_SINK", {"target_addr": "0x20"}, None, 1),
        ("b", "g", "p4", "STORE_SINK", None, None, 1), ("b", "g", "p5", "LOOP_WRITE_SINK", {}, [], 1), ("b", "g", "p6", "FORMAT_STRING_SINK", {}, [], 1), ("b", "g", "p7", "OTHER", {}, ["a"], 1), ("b", "g", "p8", "FUNC_PTR_SINK", {}, [], 1),
    ], SINK)
    funs = spark.createDataFrame([("b", "f", "void f(void) { memcpy(dst, src, count); }"), ("b", "g", "void g(T *t) { for (i = 0; i < lim; i++) { t->x = 1; } printf(msg); (*tab[k])(1); }"), ("b", "n", None)], FUN)
    got = {}
    for r in roots.sink_roots(sinks, funs).collect():
        got.setdefault(r.pack_id, set()).add((r.role, r.kind, r.expr, r.root_source))
    assert got["p1"] == {("primary", "length", "n", "facts"), ("secondary", "dst_ptr", "d", "call_args"), ("secondary", "src_ptr", "s", "call_args")}
    assert got["p2"] == {("primary", "length", "count", "text"), ("secondary", "dst_ptr", "d", "call_args"), ("secondary", "src_ptr", "s", "call_args")}
    assert ("primary", "target_addr", "0x20", "facts") in got["p3"]
    assert got["p4"] == {("primary", "dst_ptr", "t", "text")} and got["p5"] == {("primary", "index_or_bound", "lim", "text")}
    assert got["p6"] == {("primary", "format_arg", "msg", "text")} and got["p8"] == {("primary", "dispatch", "k", "text")} and "p7" not in got
    assert roots.sink_roots(sinks.limit(0), funs).count() == 0


def test_checks(spark):
    code = "void f(char *d, int len) { char buf[64]; if (len > max_len) { return; } if (len < sizeof(buf)) { memcpy(buf, d, len); } idx = min(idx, limit); if (x < y) { } if (ptr < end) { } while (z < len) { } }"
    funs = spark.createDataFrame([("b", "f", code), ("b", "c", "void c(void) { f(p, 16); }"), ("b", "e", "")], FUN)
    sch = "binary_id string, function_name string, pack_id string, root string, kind string, facts map<string,string>"
    r = spark.createDataFrame([("b", "f", "p1", "len", "length", {"len_is_constant": "true", "input_derived": "True"}), ("b", "f", "p2", "idx", "index_or_bound", {}), ("b", "f", "p3", "ptr", "dst_ptr", {}), ("b", "e", "p4", "q", "format_arg", {}), ("b", "e", "p5", "q", "dst_ptr", None), ("b", "e", "p6", None, "length", {"has_bounds_guard": "false"})], sch)
    got = {}
    for x in checks.all_checks(r, funs).collect():
        got.setdefault(x.pack_id, []).append((x.place, x.expr, x.strength, x.source))
    p1 = {x[1:] for x in got["p1"]}
    assert {("len_is_constant", "effective", "facts"), ("input_derived", "weak", "facts"), ("len > max_len", "effective", "compare"), ("len < sizeof(buf)", "effective", "compare"), ("len bounded_by buf[64]", "effective", "array"), ("caller_constant_bound", "effective", "caller")} <= p1
    assert not any("z < len" in x[0] for x in p1)  # there the root is the bound
    assert ("idx = min(idx, limit)", "effective", "clamp") in {x[1:] for x in got["p2"]}
    assert ("ptr < end", "weak", "compare") in {x[1:] for x in got["p3"]}
    assert got["p4"] == [(0, "format_arg_non_literal", "absent", "kind")] and got["p5"] == [(0, "dst_extent_guard", "unknown", "kind")] and got["p6"] == [(0, "bounds_guard", "absent", "facts")]
    s = {x.pack_id: x.strength for x in checks.strength(checks.all_checks(r, funs)).collect()}
    assert s["p1"] == "effective" and s["p4"] == "absent" and s["p5"] == "unknown"
    assert checks.all_checks(r, funs, most=1).count() == 6


def test_obligations(spark):
    rows = [
        ("a", "MMIO_READ", 0x40011000, {"addr_expr": "CONST(0x40011000)"}, "VERIFIED"), ("b", "MMIO_READ", 0x08000000, {}, "REJECTED"), ("c", "ISR_MMIO_READ", 0xE000E100, {"in_isr": "true"}, "VERIFIED"),
        ("d", "ISR_FILLED_BUFFER", 1, {"isr_write_count": "2", "non_isr_read_count": "0"}, "REJECTED"), ("e", "DMA_BACKED_BUFFER", 1, {"config_write_count": "3", "has_pointer_like_write": "True"}, "VERIFIED"),
        ("f", "COPY_SINK", 1, {"callee": "memcpy"}, "VERIFIED"), ("g", "COPY_SINK", 1, {"promoted_from": "LOOP_WRITE_SINK", "in_loop": "true", "store_expr": "d[i]", "loop_bound": "n"}, "VERIFIED"), ("h", "STORE_SINK", 1, {"provenance": "CONST"}, "REJECTED"),
        ("i", "FORMAT_STRING_SINK", 1, {"format_func": "printf", "format_arg_is_variable": "false"}, "REJECTED"), ("j", "FUNC_PTR_SINK", 1, {"indirect_call_pattern": "cast"}, "VERIFIED"), ("k", "NOTHING", 1, None, "UNKNOWN"), ("l", "LOOP_WRITE_SINK", None, None, "REJECTED"),
    ]
    df = spark.createDataFrame(rows, "id string, label string, address bigint, facts map<string,string>, want string")
    got = {r.id: r.verdict for r in obligations.verdicts(df, ["id"]).collect()}
    assert got == {r[0]: r[4] for r in rows}
    ob = {(r.id, r.obligation): (r.required, r.satisfied) for r in obligations.obligations(df, ["id"], assume_resolved=False).collect()}
    assert ob["a", "O_MMIO_1"] == (True, True) and ob["b", "O_MMIO_1"] == (True, False) and ob["f", "O_COPY_3"] == (False, False) and ("k", "x") not in ob
    assert len(obligations.rules()) == 25


def test_only_texts_of_sinks_are_read(spark, monkeypatch):
    """Loops cut off at the end of a text give their roots and checks; texts without a sink aren't handed to the readers."""
    from siltstone.plans import mining

    cut = "if (n < MAX_LEN) { } for (i = 0; i < n; i++) { a[i] ="
    rows = [("b", "f", 1, cut), ("b", "g", 2, "x = 1;"), ("b", "h", 3, "memcpy(a, b, c);")]
    funs = spark.createDataFrame(rows, "binary_id string, function_name string, function_address int, code string")
    found = mining.packs(mining.loop_sinks(funs)).collect()
    assert [(r.function_name, r.bound) for r in found] == [("f", "n")]
    sinks = spark.createDataFrame([("b", "f", "p", "LOOP_WRITE_SINK", {}, [], 1)], SINK)
    read = []
    for name in ("loops", "pointer_stores", "call_arguments", "clamps", "array_extents"):
        real = getattr(roots.text, name)
        monkeypatch.setattr(roots.text, name, lambda df, *a, _real=real, **k: read.append(df.count()) or _real(df, *a, **k))
    (root,) = roots.sink_roots(sinks, funs).filter("place = 0").collect()
    assert (root.expr, root.root_source) == ("n", "text") and set(read) == {1}
    read.clear()
    own = sinks.withColumns({"root": F.lit("n"), "kind": F.lit("index_or_bound")})
    assert [(r.expr, r.strength) for r in checks.text_checks(own, funs).collect()] == [("n < MAX_LEN", "effective")] and set(read) == {1}
