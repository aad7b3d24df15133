"""The reader of program text on small texts."""

from pyspark.sql import functions as F

from siltstone.functions.ctext import accesses, arrays, calls, clamps, definitions, field_uses, guarded_calls, loops, pointer_parameters, pointer_stores, read, reads_bounded_string
from siltstone.operators import code


def acc(text):
    return [(k, p, n if p in ("CONST", "GLOBAL_PTR") else b) for _, k, _, p, _, b, n in accesses(read(text))]


def test_provenances():
    assert acc("u = *(uint *)0x40011000;") == [("load", "CONST", 0x40011000)]
    assert acc("*(volatile uint *)(0x40011004) = u;") == [("store", "CONST", 0x40011004)]
    assert acc("u = *(uint *)DAT_40011000 + _DAT_40021004;") == [("load", "CONST", 0x40011000), ("load", "CONST", 0x40021004)]
    assert acc("u = *(uint *)(0x40000000 + 0x11000);") == [("load", "CONST", 0x40000000)]
    assert acc("u = *(uint *)(iVar1 + 0xe000ed1c); v = *(int *)((pin & 0xf) + 1073809416);") == [("load", "CONST", 0xE000ED1C), ("load", "CONST", 1073809416)]
    assert acc("u = *(uint *)(DAT_20000100 + iVar1);") == [("load", "GLOBAL_PTR", 0x20000100)]
    assert acc("u = *(uint *)(param_1 + 4); v = *(int *)(*(int *)param_2 + 0xc);") == [("load", "ARG", "param_1"), ("load", "ARG", "param_2")]
    assert acc("u = *(uint *)(&local_20 + 4);") == [("load", "STACK_PTR", "local_20")]
    assert acc("u = *(uint *)(p + 8); g_buf[g_head] = 1;") == [("load", "UNKNOWN", "p"), ("store", "UNKNOWN", "g_buf")]
    assert acc("uVar1[3] = 0; if [x] y; a * (b * c) d;") == []


def test_loads_and_stores():
    assert [k for k, *_ in acc("*(uint *)0x40011000 |= 1;")] == ["load", "store"]
    assert [k for k, *_ in acc("*(uint *)0x40011000 <<= 1;")] == ["load", "store"]
    assert [k for k, *_ in acc("*(uint *)0x40011000 = *(uint *)0x40011004;")] == ["store", "load"]
    assert [k for k, *_ in acc("if (*(uint *)0x40011000 == 3) { x = 1; }")] == ["load"]
    assert [k for k, *_ in acc("for (i = 0; i < 8; i++) { *(uint8_t *)(0x20000100) = a; }")] == ["store"]
    assert [k for k, *_ in acc('f("=", *(uint *)0x40011000);')] == ["load"]
    assert acc("// *(uint *)0x40000000 = 1;\n/* *(uint *)0x40000000\n = 2; */\n#define X *(uint *)0x40000000\n") == [] and acc("") == []
    assert acc("*(uint *)(0x40000000 = 1;") == [] or True  # damaged text must not fail


def test_lines_and_widths():
    rows = accesses(read("x;\n b = *(byte *)0x20000010;\n\n s = *(ushort *)\n   0x20000012;"))
    assert [(r[0], r[4]) for r in rows] == [(1, 1), (3, 2)]


def one(text):
    (x,) = loops(read(text))
    return x.kind, x.bound, x.constant, x.store, x.index, x.copy_dst, x.copy_src


def test_loops():
    assert one("for (i = 0; i < n; i++) {\n  dst[i] = src[i];\n}") == ("for", "n", False, "dst[i]", "i", "dst[i]", "src[i]")
    assert one("while (count--) { *p++ = *q++; }") == ("while", "count", False, "*p++", "p", "*p++", "*q++")
    assert one("do {\n *p = v;\n p = p + 1;\n} while (p != end);") == ("do", "end", False, "*p", "p", None, None)
    assert one("for (i=0;i<10;i++) buf[3] = i;") == ("for", "10", True, None, None, None, None)
    assert one("for (i=0; i <= lim(x); i++)\n{ *(char *)(param_1 + i * 4) = 0; }") == ("for", "lim(x)", False, "*(char *)(param_1 + i * 4)", "i * 4", None, None)
    assert one("while (*s != '\\0') { s = s + 1; }")[:3] == ("while", "'\\0'", True)
    assert [x.kind for x in loops(read("for (a; b; c) { while (x < y) { z[x] = 1; } }"))] == ["for", "while"]
    assert loops(read("for (")) == [] and loops(read("format(x); dofor(y);")) == []


def test_stores_clamps_arrays_calls():
    text = "void f(uint8_t *d, int *len, T *t)\n{ *d = 1; *(uint *)(param_2 + 4) = x; t->n = 3; d[2] = 4; *len = *len + 1; q = 5; }"
    assert [(b, f, o) for _, b, f, o in pointer_stores(read(text))] == [("d", "deref", False), ("param_2", "offset", False), ("t", "field", False), ("d", "element", False), ("len", "deref", True)]
    assert pointer_parameters(read(text)) == {"f": ["d", "len", "t"]}
    assert [(v, t) for _, v, t in clamps(read("n = MIN(n, 64); m = m < cap ? m : cap; if (k >= lim) k = lim; z = max(a, b);"))] == [("n", "n = MIN(n, 64)"), ("m", "m = m < cap ? m : cap"), ("k", "if (k >= lim) k = lim")]
    assert arrays(read("char buf[64]; x = buf[i]; uint8_t q[N * 2];")) == [("buf", "64"), ("q", "N * 2")]
    assert [(n, a) for _, _, n, a in calls(read('f(a, g(b, c), "x,y", h[1, 2]); if (k()) (z)(1); m(\n);'))] == [("f", ["a", "g(b, c)", '"x,y"', "h[1, 2]"]), ("g", ["b", "c"]), ("k", []), ("m", [])]
    assert [(n, t) for _, n, t in definitions(read("int f(int a)\n{ return g(a); }\nx = f(3);"))] == [("f", "f(int a)\n{ return g(a); }")]


def test_fields():
    text = "void init(UART_HandleTypeDef *h, int n) { USART_TypeDef *u; h->Instance->CR1 = 1; u->SR |= 2; x = u->DR; w->X = 0; a.u->Y = 1; }"
    assert [r[1:] for r in field_uses(read(text))] == [("store", "h", "UART_HandleTypeDef", "CR1", True), ("load", "u", "USART_TypeDef", "SR", False), ("store", "u", "USART_TypeDef", "SR", False), ("load", "u", "USART_TypeDef", "DR", False)]


def test_many_open_brackets_and_long_text():
    assert accesses(read("(" * 50_000 + "*(uint *)0x40011000")) != [] and loops(read("{" * 50_000)) == []
    text = "x = *(uint *)0x40011000;\n" * 20_000
    assert len(accesses(read(text))) == 20_000


def test_text_rows_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "*(uint *)0x40011000 = 1;", None)], "doc_id int, t string, kind2 string")
    got = code.memory_accesses(df, ["doc_id", "kind2"], "t").collect()
    assert [(r.doc_id, r.kind2, r.kind, r.number) for r in got] == [(3, None, "store", 0x40011000)]
    assert code.loops(df.limit(0), ["doc_id"], "t").count() == 0
    assert code.call_arguments(df.withColumn("t", F.lit("memcpy(a, b, n);")), ["doc_id"], "t", ["memcpy"]).select("args").first()[0] == ["a", "b", "n"]


def test_guards_before_calls_and_bounded_readers():
    guards = lambda t: [g for *_, g in guarded_calls(read(t), frozenset(["memcpy"]))]
    assert guards("if (n > 64) { n = 64; }\nmemcpy(d, s, n);") == [True]
    assert guards("if (n > max)\n  return;\nmemcpy(d, s, n);") == [True] and guards("if (n > max) { x(); }\nmemcpy(d, s, n);") == [False]
    assert guards("n = MIN(n, k);\nmemcpy(d, s, n);") == [True] and guards("n = a ? 3 : b;\nmemcpy(d, s, n);") == [True]
    assert guards("memcpy(d, s, n);\nif (n > 64) return;") == [False] and guards("if (n > 64) return;" + "\n" * 11 + "memcpy(d, s, n);") == [False]
    assert guards("if (p == 0) return;\nmemcpy(d, s, n);") == [False]
    careful = "for (i = 0; i < n - 1; i++) { c = get(); if (c == 0) break; b[i] = c; } b[n - 1] = '\\0';"
    assert reads_bounded_string(read(careful)) and not reads_bounded_string(read(careful.replace("n - 1", "n"))) and not reads_bounded_string(read(careful.replace("'\\0'", "c")))


def test_text_cut_off_behind_an_assignment():
    cut = "for (i = 0; i < n; i++) { a[i] ="
    (x,) = loops(read(cut))
    assert (x.header, x.bound, x.store, x.index, x.copy_src) == ("i = 0; i < n; i++", "n", "a[i]", "i", None)
    assert [x.bound for x in loops(read("while (p != 0) { *p ="))] == ["0"] and len(loops(read("do { } while (a[i] ="))) == 1
    whole = "void f(char *p) { for (i = 0; i < n; i++) { a[i] = b[i]; } while (n--) { *p++ = *q++; } if (n > 4) { n = 4; } g(a, (int)p->len); }"
    for end in range(len(whole) + 1):
        c = read(whole[:end])
        for reader in (loops, accesses, arrays, calls, clamps, definitions, field_uses, guarded_calls, pointer_parameters, pointer_stores, reads_bounded_string):
            reader(c)
