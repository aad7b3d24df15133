"""Roots of sinks: the expressions that decide where and how much a sink writes, and what is known of an expression.

A sink comes with facts (a map of texts) and, if it is a call, with callee and arguments. A table of rules says for each
label which facts, arguments or finds in the text give which root; the finds come from the reader of program text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import code as text
from siltstone.operators import resolve


@dataclass(frozen=True)
class Rule:
    """One root of a label: its role and kind, the facts that may hold it, the argument it may be, and which find in the
    text may stand in for it."""

    label: str
    role: str
    kind: str
    facts: Sequence[str] = ()
    argument: int | None = None
    find: str | None = None


# Facts and arguments by label, in order of preference.
RULES = [
    Rule("COPY_SINK", "primary", "length", ("len_expr", "length_expr", "len", "size_expr", "bound_expr"), 2, "copy_length"),
    Rule("COPY_SINK", "secondary", "dst_ptr", ("dst_expr", "dst", "target_expr", "dst_arg", "store_expr"), 0, "copy_dst"),
    Rule("COPY_SINK", "secondary", "src_ptr", ("src_expr", "src", "source_expr", "src_arg"), 1, "copy_src"),
    Rule("MEMSET_SINK", "primary", "length", ("len_expr", "length_expr", "len", "size_expr"), 2, "fill_length"),
    Rule("MEMSET_SINK", "secondary", "dst_ptr", ("dst_expr", "dst", "target_expr"), 0, "fill_dst"),
    Rule("STORE_SINK", "primary", "dst_ptr", ("dst_expr", "store_expr", "target_expr", "ptr_expr"), 0, "store_base"),
    Rule("STORE_SINK", "primary", "target_addr", ("target_addr",)),
    Rule("LOOP_WRITE_SINK", "primary", "index_or_bound", ("loop_bound", "bound_expr", "index_expr", "idx_expr"), 2, "loop_bound"),
    Rule("LOOP_WRITE_SINK", "secondary", "dst_ptr", ("store_expr", "dst_expr", "target_expr")),
    Rule("FUNC_PTR_SINK", "primary", "dispatch", ("dispatch_index", "index_expr", "target_ptr", "func_ptr_expr"), 0, "called_pointer"),
    Rule("FORMAT_STRING_SINK", "primary", "format_arg", ("format_arg_expr", "format_arg", "fmt_arg", "format_expr"), None, "format"),
]
# Which argument is what in calls found in text.
COPIES = ["memcpy", "memmove", "strncpy", "strcpy", "sprintf", "snprintf", "vsprintf", "vsnprintf"]
FORMATS = {"printf": 0, "syslog": 0, "sprintf": 1, "snprintf": 1, "vsprintf": 1, "vsnprintf": 1, "fprintf": 1}
LENGTH_NAMES = ["tot_len", "len", "payload_len", "data_len", "uip_len"]


def clean(expr: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(expr), r"\s+", " "), F.lit(""))


def canonical(expr: Column) -> Column:
    """An expression without casts, outer parentheses and white space, arrows as dots, in lower case."""
    bare = F.replace(expr, F.lit("->"), F.lit("."))
    bare = F.regexp_replace(bare, r"\(\s*(?:const\s+[^()]*|(?:unsigned\s+|struct\s+)?\w+\s*\*+|u?int(?:8|16|32|64)?(?:_t)?|size_t|u?long|byte|u?char)\s*\)\s*", "")
    bare = F.regexp_replace(bare, r"^\((.*)\)$", "$1")
    return F.nullif(F.lower(F.regexp_replace(bare, r"\s+", "")), F.lit(""))


def family(kind: Column) -> Column:
    """The family roots of one kind compete in."""
    low = F.lower(kind)
    return F.when(low.isin("length", "index_or_bound"), "length").when(low.isin("src_ptr", "src_data", "dst_ptr", "target_addr"), "pointer").otherwise(F.coalesce(F.nullif(low, F.lit("")), F.lit("unknown")))


def segments(expr: Column) -> Column:
    """The parts of a path in canonical form, cut at dots and brackets."""
    return F.filter(F.split(canonical(expr), r"[.\[\]]+"), lambda s: s != "")


def aliases(expr: Column) -> Column:
    """Other writings of an expression, each once: canonical, without a leading cast, its pointer, ends and pairs of its
    path, and for lengths of packets the other names such a field has."""
    seg = segments(expr)
    n = F.size(seg)
    peeled = F.regexp_replace(expr, r"^\(\s*[^()]*\)\s*", "")
    pointer = F.regexp_extract(expr, r"^\s*([A-Za-z_]\w*)\s*(?:->|\[|\.)", 1)
    pairs = F.array(F.when(n > 1, F.array_join(F.slice(seg, 1, 2), ".")), F.when(n > 1, F.array_join(F.slice(seg, F.greatest(n - 1, F.lit(1)), 2), ".")))
    named = F.filter(seg, lambda s: ~s.rlike("^[0-9]+$"))
    base = F.regexp_extract(canonical(expr), r"^(.*)\.(?:" + "|".join(LENGTH_NAMES) + ")$", 1)
    lengths = F.when(base != "", F.transform(F.array(*[F.lit(x) for x in LENGTH_NAMES]), lambda x: F.concat(base, F.lit("."), x)))
    parts = [F.array(F.trim(expr), canonical(expr), peeled, canonical(peeled), pointer), pairs, named, F.coalesce(lengths, F.array().cast("array<string>"))]
    return F.array_distinct(F.filter(F.concat(*parts), lambda a: a.isNotNull() & (a != "")))


def path_of(expr: Column) -> Column:
    """A struct of what an expression's path is: kind (literal_addr, call_or_cast, indexed_path, member_path, symbol, expr),
    tokens, base, leaf, depth, has_index and the number added to it."""
    c, seg = canonical(expr), segments(expr)
    tokens = F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z_]\w*)"), 1))
    indexed = expr.contains("[") & expr.contains("]")
    kind = F.when(c.rlike("^0x[0-9a-f]+$"), "literal_addr").when(expr.contains("(") & expr.contains(")"), "call_or_cast").when(indexed, "indexed_path").when(c.contains("."), "member_path").when(F.size(tokens) > 0, "symbol").otherwise("expr")
    n = F.size(seg)
    leaf = F.when(indexed & (n > 1), F.get(seg, n - 2)).otherwise(F.get(seg, n - 1))
    return F.struct(kind.alias("path_kind"), tokens.alias("tokens"), F.get(seg, F.lit(0)).alias("path_base"), leaf.alias("path_leaf"), n.alias("path_depth"), indexed.alias("has_index"), F.nullif(F.regexp_extract(expr, r"\+\s*(0[xX][0-9a-fA-F]+|[0-9]+)", 1), F.lit("")).alias("offset"))


def finds(functions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, find, expr): what the text of each function (keys, code) shows, the first of its kind: the operands of
    copying, filling and printing calls, bounds of loops, the pointer most stored through, the pointer called."""
    calls = text.call_arguments(functions, keys, "code", [*COPIES, "memset", *FORMATS])
    arg = lambda i: F.get("args", F.lit(i))
    copy, n = F.col("callee").isin(COPIES), F.size("args")
    fmt = F.coalesce(*[F.when(F.col("callee") == c, arg(i)) for c, i in FORMATS.items()])
    one = lambda name, when, e: F.struct(F.lit(name).alias("find"), F.when(when, e).alias("expr"))
    listed = [
        one("copy_length", copy & (n >= 3), arg(2)), one("copy_dst", copy & (n >= 2), arg(0)), one("copy_src", copy & (n >= 2), arg(1)),
        one("fill_length", (F.col("callee") == "memset") & (n >= 3), arg(2)), one("fill_dst", (F.col("callee") == "memset") & (n >= 3), arg(0)),
        one("format", ~F.coalesce(F.trim(fmt).startswith('"'), F.lit(True)), fmt),
    ]
    from_calls = calls.select(*keys, F.col("at").alias("at"), F.explode(F.array(*listed)).alias("f")).select(*keys, "at", "f.*")
    bounds = F.array(F.struct(F.col("line_no").alias("at"), F.lit("loop_bound").alias("find")), F.struct(F.when(F.col("copy_src").isNotNull(), F.col("line_no") + 10**6).alias("at"), F.lit("copy_length").alias("find")))
    from_loops = text.loops(functions, keys, "code").filter("bound IS NOT NULL").select(*keys, F.explode(bounds).alias("f"), F.col("bound").alias("expr")).select(*keys, "f.*", "expr").filter("at IS NOT NULL")
    weight = F.when(F.col("form") == "field", 2).when(F.col("form") == "deref", 1).otherwise(0)
    stores = text.pointer_stores(functions, keys, "code").groupBy(*keys, "base").agg(F.sum(weight).alias("w")).filter("w > 0")
    store = stores.groupBy(*keys).agg(F.min_by("base", F.struct(-F.col("w"), F.col("base"))).alias("expr")).select(*keys, F.lit(0).alias("at"), F.lit("store_base").alias("find"), "expr")
    called = resolve.indirect_calls(functions, keys, "code").select(*keys, F.lit(0).alias("at"), F.lit("called_pointer").alias("find"), pointer_index(F.col("m")).alias("expr"))
    every = reduce(DataFrame.unionByName, [from_calls, from_loops, store, called]).withColumn("expr", clean(F.col("expr"))).filter("expr IS NOT NULL")
    return every.groupBy(*keys, "find").agg(F.min_by("expr", F.struct("at", "expr")).alias("expr"))


def pointer_index(matched: Column) -> Column:
    """Of the text of a call through a pointer what chooses the target: the index in brackets or multiplied by a word's
    size, else the pointer's expression."""
    inside = F.nullif(F.regexp_extract(matched, r"\[([^\]]+)\]", 1), F.lit(""))
    scaled = F.nullif(F.regexp_extract(matched, r"\+\s*(?:\(\w+\))?\s*\(?(\w+)\)?\s*(?:\*\s*(?:4|0x4)|<<\s*2)", 1), F.lit(""))
    pointer = F.nullif(F.regexp_extract(matched, r"\(\*+\s*([A-Za-z_][\w.>-]*)", 1), F.lit(""))
    return F.coalesce(inside, scaled, pointer)


def sink_roots(sinks: DataFrame, functions: DataFrame | None = None, keys: Sequence[str] = ("binary_id", "function_name"), sink: str = "pack_id") -> DataFrame:
    """Rows (sink, label, role, kind, expr, canonical, family, root_source, place) of the roots of ``sinks`` (keys, sink,
    label, facts map<string,string>, args array<string>).

    A rule's first non-blank fact gives the root (``facts``), else the argument (``call_args``). What the text of the
    function shows is added (``text``) where a primary root of that kind is missing, and all of it where no root is.
    A sink of an unknown label, or without any root, has no row; of roots alike in role, canonical form and kind one stays.
    """
    entries = []
    for i, r in enumerate(RULES):
        fact = F.coalesce(*[clean(F.element_at("facts", F.lit(k))) for k in r.facts], F.lit(None).cast("string"))
        arg = clean(F.get("args", F.lit(r.argument))) if r.argument is not None else F.lit(None).cast("string")
        entries.append(F.when(F.col("label") == r.label, F.struct(F.lit(i).alias("rule"), F.lit(r.role).alias("role"), F.lit(r.kind).alias("kind"), F.coalesce(fact, arg).alias("expr"), F.when(fact.isNotNull(), "facts").otherwise("call_args").alias("root_source"), F.lit(r.find).cast("string").alias("find"))))
    listed = sinks.select(*keys, sink, "label", F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select(*keys, sink, "label", "e.*")
    given = listed.filter("expr IS NOT NULL")
    # An address found beside a pointer adds nothing.
    pointed = given.filter("kind = 'dst_ptr' AND role = 'primary'").select(sink).distinct().withColumn("_p", F.lit(True))
    given = given.join(pointed, sink, "left").filter(~((F.col("kind") == "target_addr") & F.coalesce("_p", F.lit(False)))).drop("_p")
    out = given.drop("find")
    if functions is not None:
        lacking = listed.filter("expr IS NULL AND find IS NOT NULL").drop("expr", "root_source")
        # Only the texts of functions whose sinks lack something are read.
        shown = finds(functions.join(lacking.select(*keys).distinct(), list(keys), "left_semi"), keys)
        lacking = lacking.join(shown, [*keys, "find"])
        any_root = given.select(sink).distinct().withColumn("_has", F.lit(True))
        primary = given.filter("role = 'primary'").select(sink, "kind").distinct().withColumn("_main", F.lit(True))
        added = lacking.join(any_root, sink, "left").join(primary, [sink, "kind"], "left").filter("_has IS NULL OR (role = 'primary' AND _main IS NULL)")
        out = out.unionByName(added.select(*keys, sink, "label", "rule", "role", "kind", "expr", F.lit("text").alias("root_source")))
    out = out.withColumn("canonical", F.coalesce(canonical(F.col("expr")), F.lower("expr")))
    best = out.groupBy(sink, "label", "role", "canonical", "kind").agg(F.min(F.struct("rule", "expr", "root_source")).alias("b"))
    order = Window.partitionBy(sink).orderBy((F.col("role") != "primary").cast("int"), "b.rule", "canonical")
    return best.select(sink, "label", "role", "kind", F.col("b.expr").alias("expr"), "canonical", family(F.col("kind")).alias("family"), F.col("b.root_source").alias("root_source"), (F.row_number().over(order) - 1).alias("place"))
