"""Checks that keep a sink's root in bounds: read from facts and program text, weighed and summed up."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import code as text
from siltstone.operators.roots import aliases

# Words that tell a capacity, a state, or a length.
CAPACITY = ["max", "bound", "limit", "size", "sizeof", "capacity", "tailroom", "headroom", "count", "slots", "remaining", "avail", "available", "space", "room", "need", "free"]
STATE = ["ready", "valid", "enabled", "flag", "done", "status", "head", "tail"]
BOUND_KINDS = ["length", "index_or_bound", "dispatch", "dst_ptr"]
# From the most protective on.
STRENGTHS = ["effective", "weak", "absent", "unknown"]


def identifiers(expr: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(expr, F.lit(r"\b([A-Za-z_]\w*)"), 1), F.lower))


def holds_any(expr: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(expr).rlike("|".join(words)), F.lit(False))


def _row(expr: Column | str, strength: Column | str, source: str) -> Column:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(c(expr).alias("expr"), c(strength).alias("strength"), F.lit(source).alias("source"))


def fact_checks(roots: DataFrame, sink: str = "pack_id") -> DataFrame:
    """Rows (sink, expr, strength, source) of what the ``facts`` of a sink say about its guards."""
    fact = lambda k: F.lower(F.element_at("facts", F.lit(k)))
    rows = [
        F.when(fact("has_bounds_guard") == "true", _row(F.coalesce(F.element_at("facts", F.lit("guard_expr")), F.lit("bounds_guard")), "effective", "facts")).when(fact("has_bounds_guard") == "false", _row("bounds_guard", "absent", "facts")),
        F.when(fact("len_is_constant") == "true", _row("len_is_constant", "effective", "facts")),
        F.when(fact("format_arg_is_variable") == "true", _row("format_arg_non_literal", "absent", "facts")),
        F.when((fact("param_store_heuristic") == "true") & (fact("has_unresolved_target") == "true"), _row("param_store_without_explicit_guard", "weak", "facts")),
        F.when(fact("input_derived") == "true", _row("input_derived", "weak", "facts")),
    ]
    return roots.select(sink, F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("c")).select(sink, "c.*").distinct()


def text_checks(roots: DataFrame, functions: DataFrame, keys: Sequence[str] = ("binary_id", "function_name"), sink: str = "pack_id") -> DataFrame:
    """Rows (sink, expr, strength, source) of the checks that the function's text makes on the root (``roots``: keys, sink,
    root, kind): values clamped to a capacity, comparisons with a declared array, comparisons with anything else.

    A comparison counts if it names the root in one of its writings and something beside it, and doesn't use the root as
    the bound; it is effective where the other side tells a capacity, weak where it doesn't or the root is a pointer.
    """
    own = roots.filter(F.col("kind").isin(BOUND_KINDS) & F.col("root").isNotNull()).select(*keys, sink, "root", "kind", F.transform(aliases(F.col("root")), F.lower).alias("_names"))
    functions = functions.join(own.select(*keys).distinct(), list(keys), "left_semi")  # no other text is read
    weak_pointer = lambda strong: F.when(F.col("kind") == "dst_ptr", "weak").when(strong, "effective").otherwise("weak")

    clamped = own.join(text.clamps(functions, keys, "code"), list(keys)).filter(F.array_contains("_names", F.lower("variable")) & holds_any(F.col("clamp"), CAPACITY))
    clamped = clamped.select(sink, F.col("clamp").alias("expr"), F.lit("effective").alias("strength"), F.lit("clamp").alias("source"))

    one = functions.withColumn("_key", F.struct(*keys)).select("_key", "code")
    compared = text.guards(one, "_key", "code").select(*[F.col(f"_key.{k}").alias(k) for k in keys], "left", "operator", "right").filter(F.col("operator").isin("<", "<=", ">", ">="))
    both = own.join(compared, list(keys)).withColumn("_l", identifiers(F.col("left"))).withColumn("_r", identifiers(F.col("right")))
    names = F.col("_names")
    in_left, in_right = F.arrays_overlap("_l", names), F.arrays_overlap("_r", names)
    upward = F.col("operator").isin("<", "<=")
    whole = F.concat_ws(" ", "left", "operator", "right")
    others = F.array_except(F.array_union("_l", "_r"), names)
    capacity = F.arrays_overlap(others, F.array(*[F.lit(w) for w in CAPACITY])) | F.lower(whole).contains("sizeof(") | holds_any(F.array_join(others, " "), CAPACITY)
    as_bound = F.when(upward, in_right & ~in_left).otherwise(in_left & ~in_right)
    extents = text.array_extents(functions, keys, "code").withColumn("_n", F.lower("name"))
    other = F.lower(F.regexp_replace(F.when(in_left, F.col("right")).otherwise(F.col("left")), r"\s+", ""))
    arrays = both.withColumn("_other", other).filter(in_left | in_right).join(extents, list(keys)).filter((F.col("_other") == F.col("_n")) | (F.col("_other") == F.concat(F.lit("sizeof("), F.col("_n"), F.lit(")"))) | (F.col("_other") == F.lower(F.regexp_replace("extent", r"\s+", ""))))
    arrays = arrays.select(sink, F.concat("root", F.lit(" bounded_by "), "name", F.lit("["), "extent", F.lit("]")).alias("expr"), F.lit("effective").alias("strength"), F.lit("array").alias("source"))
    generic = both.filter((in_left | in_right) & (~as_bound | capacity) & ((F.size(others) > 0) | F.lower(whole).contains("sizeof(")))
    generic = generic.select(sink, whole.alias("expr"), weak_pointer(capacity).alias("strength"), F.lit("compare").alias("source"))
    return reduce(DataFrame.unionByName, [clamped, arrays, generic]).distinct()


def caller_checks(roots: DataFrame, functions: DataFrame, sink: str = "pack_id") -> DataFrame:
    """Rows (sink, expr, strength, source): a bound visible where other functions of the binary call the sink's, as a constant
    argument behind the first or an expression that tells a capacity."""
    calls = text.call_arguments(functions.select("binary_id", F.col("function_name").alias("caller"), "code"), ["binary_id", "caller"], "code")
    asked = roots.filter(F.col("kind").isin("length", "index_or_bound", "dst_ptr")).select("binary_id", F.col("function_name").alias("callee"), sink, "kind")
    hit = asked.join(calls.filter("caller <> callee"), ["binary_id", "callee"])
    constant = F.exists(F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))), lambda a: F.lower(a).contains("sizeof(") | F.trim(a).rlike("^(?:0[xX][0-9a-fA-F]+|[0-9]+)[uUlL]*$"))
    told = holds_any(F.array_join("args", ", "), [r"min\(", r"max\(", "clamp", r"sizeof\(", "capacity", "bound", "limit", "tailroom"])
    expr = F.when(constant, "caller_constant_bound").when(told, "caller_bound_expr")
    return hit.select(sink, expr.alias("expr"), F.when(F.col("kind") == "dst_ptr", "weak").otherwise("effective").alias("strength"), F.lit("caller").alias("source")).filter("expr IS NOT NULL").distinct()


def all_checks(roots: DataFrame, functions: DataFrame, sink: str = "pack_id", most: int | None = None) -> DataFrame:
    """Rows (sink, expr, strength, source, place) of every check of ``roots`` (binary_id, function_name, sink, root, kind,
    facts), the most protective first, all of them or ``most``. A sink without any has the one that its kind lacks."""
    found = reduce(DataFrame.unionByName, [fact_checks(roots, sink), text_checks(roots, functions, sink=sink), caller_checks(roots, functions, sink)]).distinct()
    lack = (
        F.when(F.col("kind") == "format_arg", _row("format_arg_non_literal", "absent", "kind")).when(F.col("kind") == "dispatch", _row("dispatch_index_guard", "absent", "kind"))
        .when(F.col("kind") == "dst_ptr", _row("dst_extent_guard", "unknown", "kind")).otherwise(_row("bounds_guard", "absent", "kind"))
    )
    missing = roots.select(sink, lack.alias("c")).distinct().join(found.select(sink).distinct(), sink, "left_anti").select(sink, "c.*")
    rank = F.coalesce(*[F.when(F.col("strength") == s, F.lit(i)) for i, s in enumerate(STRENGTHS)], F.lit(len(STRENGTHS)))
    rows = found.unionByName(missing).groupBy(sink).agg(F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "expr", "strength", "source"))).alias("all"))
    listed = rows.select(sink, F.posexplode("all").alias("place", "c")).select(sink, "c.expr", "c.strength", "c.source", "place")
    return listed if most is None else listed.filter(F.col("place") < most)


def strength(checks: DataFrame, sink: str = "pack_id") -> DataFrame:
    """Rows (sink, strength): effective if any check but one on a state is, else absent, weak or unknown, the first of these
    that some check has."""
    states = holds_any(F.col("expr"), STATE)
    has = lambda s: F.bool_or(F.col("strength") == s)
    verdict = F.when(F.bool_or((F.col("strength") == "effective") & ~states), "effective").when(has("absent"), "absent").when(has("weak"), "weak").when(has("unknown"), "unknown").otherwise("effective")
    return checks.groupBy(sink).agg(verdict.alias("strength"))
