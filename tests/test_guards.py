"""Comparisons in conditions against a reading of every character, on calls, casts, masks, arrows and shifts."""

import random

from siltstone.operators import code

FIXED = [
    ("if (off < push_window(cnt)) {", [("if", "off", "<", "push_window(cnt)")]),
    ("if (rem < *(uint32_t *)(param_2 + 0xcc))", [("if", "rem", "<", "*(uint32_t *)(param_2 + 0xcc)")]),
    ("if (need < (ptr & 0x9) << 9) return;", [("if", "need", "<", "(ptr & 0x9) << 9")]),
    ("if (need < packet->head)", [("if", "need", "<", "packet->head")]),
    ("if (p->n >> 2 >= f(a, b->c) << 1)", [("if", "p->n >> 2", ">=", "f(a, b->c) << 1")]),
    ("  while(*p != ')') { x; }", [("while", "*p", "!=", "')'")]),
    ("for (i = f(0); i <= g(n); i++) {", [("for", "i", "<=", "g(n)")]),
    ("if (a < b && (c == d || !(e > f->g)))", [("if", "a", "<", "b"), ("if", "c", "==", "d"), ("if", "e", "<=", "f->g")]),
    ("while (n = f(), n < g[k] - 1)", [("while", "n", "<", "g[k] - 1")]), ("if (a < b] c) d;", [("if", "a", "<", "b] c")]),
    ("if (x) y = a < b;", []), ("if (p->q << 3)", []), ("if (a < f(b\n)) c;", [("if", "a", "<", "f(b\n)")]), ("if (a < f(b; c)) d;", []), ("notif (a < b)", []), ("if (a < b", []), ("for (;;)", []),
]


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted((r.i, r.keyword, r.left, r.operator, r.right) for r in code.guards(df, "i", "t").collect())


def test_fixture(spark):
    want = sorted((i, *row) for i, (_, rows) in enumerate(FIXED) for row in rows)
    assert read(spark, [t for t, _ in FIXED] + [None, ""]) == want


def brute(text):
    """One comparison of one condition: by counting brackets and looking at every pair of neighbours."""
    start = text.index("(") + 1
    depth, i, found = 0, start, None
    while not (depth == 0 and text[i] == ")"):
        two = text[i : i + 2]
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0 and two in ("->", "<<", ">>"):
            i += 2
            continue
        if depth == 0 and (two in ("<=", ">=", "==", "!=") or text[i] in "<>"):
            found = (i, two if two in ("<=", ">=", "==", "!=") else text[i])
            i += len(found[1])
            continue
        i += 1
    return ("if", text[start : found[0]].strip(), found[1], text[found[0] + len(found[1]) : i].strip())


def test_random_operands_against_brute_force(spark):
    rnd = random.Random(5)
    forms = ["n", "0x1f", "p->len", "g.n", "f(a, b->c)", "*(uint16_t *)(p + 4)", "(n & 7) << 2", "s->x >> 1", "f(g(h->i), (j < k))", "(uint)n", "a[i]", "!n", "-1"]
    texts = [f"  if ({rnd.choice(forms)} {rnd.choice(['<', '<=', '>', '>=', '==', '!='])} {rnd.choice(forms)}) {{ x(y < z); }}" for _ in range(400)]
    assert read(spark, texts) == sorted((i, *brute(t)) for i, t in enumerate(texts))
