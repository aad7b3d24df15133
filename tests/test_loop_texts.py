"""Only texts that can hold a loop are read for loops, and none that holds one is left out."""

import itertools

from siltstone.functions import ctext
from siltstone.operators import code, roots


def test_texts_read_for_loops():  # F9
    between = ["", " ", "\n\t", "/* a\nb */", " // for\n", "\n#if X\n", "\xa0"]
    heads = ["for%s(i = 0; i < n; i++) { a[i] =", "while%s(n--) ;", "do%s{ x = 1; } while (x)", "x = 0x1while%s(y) { *p = 0; }"]
    for head, gap in itertools.product(heads, between):
        whole = head % gap
        for lo, hi in itertools.combinations(range(len(whole) + 1), 2):
            assert code._LOOP.search(whole[lo:hi]) or not ctext.loops(ctext.read(whole[lo:hi])), whole[lo:hi]
    assert not any(code._LOOP.search(t) for t in ("", "window (for the docs)", "what to do", "format(x); while y", "before { }"))


def test_texts_read_for_careful_readers():  # F5
    for bound in ("n - 1", "n-1", "n -\n\t1", "n - /* one */ 1", "n + -1", "-1"):
        whole = "for (i = 0; i < %s; i++) { b[i] = c; } b[n - 1] = 0;" % bound
        for hi in range(len(whole) + 1):
            assert code._LESS_ONE.search(whole[:hi]) or not ctext.reads_bounded_string(ctext.read(whole[:hi])), whole[:hi]
    assert not any(code._LESS_ONE.search(t) for t in ("", "1", "for (i = 0; i < 10; i++) { a[i - 4] = 1; }"))


def test_finds_reads_loops_once(spark):  # F4
    whole = "f(T *p) { for (i = 0; i < n; i++) { a[i] = b[i]; }\nwhile (k > m) { x = 1; } p->f = 1; *q = 2; a[1] += 3; memcpy(d, s, len); printf(x); (*cb[i])(1); }"
    rows = [("b", str(i), whole[:i]) for i in range(len(whole) + 1)] + [("b", "none", None), ("b", "blank", "")]
    functions = spark.createDataFrame(rows, "binary_id string, function_name string, code string")
    keys = ["binary_id", "function_name"]
    found = roots.finds(functions, keys)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # calls, loops, stores
    of = {}
    for r in found.collect():
        of.setdefault(r.function_name, {})[r.find] = r.expr
    assert of[str(len(whole))] == {"loop_bound": "n", "copy_length": "len", "copy_dst": "d", "copy_src": "s", "format": "x", "store_base": "p", "called_pointer": "i"}
    assert not {"none", "blank", "0"} & set(of)
    for _, name, text in rows[:-2]:
        c = ctext.read(text)
        bounds = sorted((x.line, x.bound) for x in ctext.loops(c) if x.bound)
        copies = sorted((x.line, x.bound) for x in ctext.loops(c) if x.bound and x.copy_src)
        lengths = [a[2] for _, _, _, a in ctext.calls(c, frozenset(["memcpy"])) if len(a) > 2] + [b for _, b in copies]
        assert of.get(name, {}).get("loop_bound") == (bounds[0][1] if bounds else None)
        assert of.get(name, {}).get("copy_length") == next(iter(lengths), None)
        assert ("store_base" in of.get(name, {})) == any(form in ("field", "deref") for _, _, form, _ in ctext.pointer_stores(c))
