"""Addresses behind names: base variables, typed structures, parameters bound at call sites.

Extraction is built-in regular expressions over one text column; resolution is equi-joins on (key, name).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ctext
from siltstone.functions.firmware import is_peripheral
from siltstone.operators.code import text_rows
from siltstone.functions.ctext import WIDTHS
from siltstone.session import broadcast_if_small, materialize

_HEX = lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("bigint")


def _matches(df: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("no", "m"))


def number(c: Column) -> Column:
    """A decimal or 0x number as bigint, null where it is neither."""
    return F.when(c.rlike("^0[xX][0-9a-fA-F]{1,8}$"), _HEX(c)).when(c.rlike("^[0-9]{1,10}$"), c.cast("bigint"))


def width(c: Column) -> Column:
    """Bytes of a type name, 4 for unknown ones."""
    return F.coalesce(*[F.when(c == t, F.lit(n)) for t, n in WIDTHS.items()], F.lit(4))


def is_mask(value: Column, text: Column, before: Column) -> Column:
    """Whether a 32-bit constant is a mask and no address: ones, then at least four zeros, and an ``&`` in ``before``, the
    text in front of it."""
    low = value.bitwiseXOR(F.lit(0xFFFFFFFF))
    shape = (value >= 0xFFFF0000) & (low >= 15) & (low.bitwiseAND(low + 1) == 0)
    return shape & F.right(before, F.lit(40)).contains("&")


def base_assignments(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, var, value): the last peripheral address literal each variable is assigned; masks don't count."""
    pattern = r"([A-Za-z_][A-Za-z0-9_]*)\s*=(?!=)([^;=\n]*)0[xX]([0-9a-fA-F]{8})(?![0-9a-fA-F])[^;\n]*;"
    part = lambda i: F.regexp_extract("m", pattern, i)
    rows = _matches(df, keys, text, pattern).select(*keys, "no", part(1).alias("var"), _HEX(part(3)).alias("value"), part(2).alias("_before"))
    rows = rows.filter(is_peripheral(F.col("value")) & ~is_mask(F.col("value"), F.col("_before"), F.col("_before")))
    return rows.groupBy(*keys, "var").agg(F.max_by("value", "no").alias("value"))


def resolved_accesses(accesses: DataFrame, keys: Sequence[str], bases: DataFrame, symbols: DataFrame | None = None, symbol_keys: Sequence[str] = ()) -> DataFrame:
    """Accesses with ``target_addr``: the number of constants and data labels; base + offset below 0x1000 where the base
    variable was assigned an address (INTRA_RESOLVED); the address of a symbol (``symbols``: symbol_keys, symbol, address)
    whose element or neighbourhood is accessed (GLOBAL_PTR). Elements of names that are no symbols are left out."""
    b = bases.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("var").alias("_var"), F.col("value").alias("_value"))
    same = F.col("base") == F.col("_var")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    out = accesses.join(b, same, "left").drop("_var", *[f"_b{i}" for i in range(len(keys))])
    intra = (F.col("shape") == "pointer") & F.col("_value").isNotNull() & F.col("number").between(0, 0xFFF)
    known = F.col("base_provenance").isin("CONST", "GLOBAL_PTR")
    if symbols is None:
        address = F.lit(None).cast("bigint")
    else:
        names = symbols.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(symbol_keys)], F.col("symbol").alias("_symbol")).agg(F.min("address").alias("_address"))
        named = F.col("base") == F.col("_symbol")
        for i, k in enumerate(symbol_keys):
            named = named & F.col(k).eqNullSafe(F.col(f"_s{i}"))
        out = out.join(names, named, "left").drop("_symbol", *[f"_s{i}" for i in range(len(symbol_keys))])
        address = F.when(F.col("shape").isin("element", "pointer"), F.col("_address"))
    target = F.when(known, F.col("number")).when(intra, F.col("_value") + F.col("number")).otherwise(address)
    provenance = F.when(intra, "INTRA_RESOLVED").when(~known & address.isNotNull(), "GLOBAL_PTR").otherwise(F.col("base_provenance"))
    out = out.withColumn("target_addr", target).withColumn("base_provenance", provenance)
    return out.filter((F.col("shape") != "element") | F.col("target_addr").isNotNull()).drop("_value", "_address")


def typed_bases(df: DataFrame, keys: Sequence[str], text: str, known: DataFrame) -> DataFrame:
    """Distinct rows (keys, type, base) of casts ``(Type *)0xADDRESS`` whose type ``known`` (a column ``type``) has."""
    pattern = r"\(([A-Za-z_][A-Za-z0-9_]*) \*\)0x([0-9a-fA-F]{8})"
    rows = _matches(df, keys, text, pattern).select(*keys, F.regexp_extract("m", pattern, 1).alias("type"), _HEX(F.regexp_extract("m", pattern, 2)).alias("base"))
    return rows.filter(is_peripheral(F.col("base"))).join(known.select("type").distinct(), "type", "left_semi").select(*keys, "type", "base").distinct()


def field_accesses(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, var, type, field, n): uses ``var->field`` of variables declared as ``Type *var`` in the same text."""
    declared, used = r"([A-Za-z_][A-Za-z0-9_]*) \*([A-Za-z_][A-Za-z0-9_]*)[,;)]", r"([A-Za-z_][A-Za-z0-9_]*)->([A-Za-z_][A-Za-z0-9_]*)"
    d = _matches(df, keys, text, declared).select(*keys, F.regexp_extract("m", declared, 2).alias("var"), F.regexp_extract("m", declared, 1).alias("type"), "no").groupBy(*keys, "var").agg(F.min_by("type", "no").alias("type"))
    u = _matches(df, keys, text, used).groupBy(*keys, F.regexp_extract("m", used, 1).alias("var"), F.regexp_extract("m", used, 2).alias("field")).agg(F.count("*").alias("n"))
    return u.join(d, [*keys, "var"]).select(*keys, "var", "type", "field", "n")


def field_uses(df: DataFrame, keys: Sequence[str], text: str, handles: DataFrame | None = None) -> DataFrame:
    """Rows (keys, line_no, kind, var, type, field): loads and stores of ``var->field`` and, by way of a handle whose type
    ``handles`` (handle_type, type) knows, of ``var->Instance->field``. Suffixes that tell conflicting copies of a type
    apart are taken off."""

    def rows(t: str) -> list[tuple]:
        return ctext.field_uses(ctext.read(t)) if "->" in t else []

    used = text_rows(df, keys, text, "line_no int, kind string, var string, type string, field string, by_handle boolean", rows)
    used = used.withColumn("type", plain_type(F.col("type")))
    if handles is None:
        return used.filter("NOT by_handle").drop("by_handle")
    known = handles.select(F.col("handle_type").alias("_h"), F.col("type").alias("_of")).distinct()
    both = used.join(known, F.col("by_handle") & (F.col("type") == F.col("_h")), "left").filter("NOT by_handle OR _of IS NOT NULL")
    return both.withColumn("type", F.coalesce("_of", "type")).drop("_h", "_of", "by_handle")


def plain_type(name: Column) -> Column:
    """A type's name without the suffix that tells conflicting copies apart."""
    return F.regexp_replace(name, "_conflict[0-9]*$", "")


def struct_targets(fields: DataFrame, bases: DataFrame, offsets: DataFrame, keys: Sequence[str], rows_a_task: int = 5_000_000) -> DataFrame:
    """Field uses with the address of every base of their type: type and field give the offset. ``offsets`` is a catalogue
    (type, field, offset), unique by type and field.

    Types are few, and each may have many uses and many bases, so a shuffle by type would leave the work to a few tasks.
    Uses and bases are written first and counted by type; bases that are small are broadcast, and the uses are dealt out
    to so many tasks that each gives about ``rows_a_task`` rows. Other bases meet their uses in a join that AQE splits.
    """
    known = materialize(fields.join(offsets.select("type", "field", "offset"), ["type", "field"]), "uses")
    own = materialize(bases.select(*keys, "type", "base").distinct(), "bases")
    sizes = [df.groupBy(*keys, "type").agg(F.count("*").cast("double").alias(n)) for df, n in ((known, "_uses"), (own, "_bases"))]
    rows = sizes[0].join(sizes[1], [*keys, "type"]).agg(F.sum(F.col("_uses") * F.col("_bases"))).first()[0] or 0
    dealt = known.repartition(math.ceil(rows / rows_a_task)) if rows > rows_a_task else known
    return dealt.join(broadcast_if_small(own, 32 * (1 + len(keys))), [*keys, "type"]).withColumn("target", F.col("base") + F.col("offset"))


def field_at(df: DataFrame, offsets: DataFrame, type_of: str, offset_of: str) -> DataFrame:
    """``df`` with ``field``: the first field by name that a type has at an offset, null where it has none."""
    names = offsets.groupBy(F.col("type").alias("_t"), F.col("offset").alias("_o")).agg(F.min("field").alias("field"))
    return df.join(names, (F.col(type_of) == F.col("_t")) & (F.col(offset_of) == F.col("_o")), "left").drop("_t", "_o")


def parameter_derefs(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, param, struct_offset, offset, type): ``*(T *)(param_N + off)``, and the same through one more pointer,
    ``*(T *)(*(U *)(param_N + a) + b)``, which has a struct_offset."""
    double = r"\*\(([A-Za-z0-9_]+) \*\)\(\*\([A-Za-z0-9_]+ \*\)\(param_([0-9]+) \+ (0x[0-9a-fA-F]+|[0-9]+)\) \+ (0x[0-9a-fA-F]+|[0-9]+)\)"
    single = r"\*\(([A-Za-z0-9_]+) \*\)\(param_([0-9]+) \+ (0x[0-9a-fA-F]+|[0-9]+)\)"
    part = lambda p, i: F.regexp_extract("m", p, i)
    two = _matches(df, keys, text, double).select(*keys, part(double, 2).cast("int").alias("param"), number(part(double, 3)).alias("struct_offset"), number(part(double, 4)).alias("offset"), part(double, 1).alias("type"))
    # What a double dereference has claimed is taken out before single ones are looked for.
    left = df.withColumn(text, F.regexp_replace(text, double, "_"))
    one = _matches(left, keys, text, single).select(*keys, part(single, 2).cast("int").alias("param"), F.lit(None).cast("bigint").alias("struct_offset"), number(part(single, 3)).alias("offset"), part(single, 1).alias("type"))
    return two.unionByName(one)


def argument_kind(arg: Column) -> Column:
    """constant, literal, address, parameter, stack or unknown, after casts are peeled off."""
    bare = F.regexp_replace(F.trim(arg), r"^(?:\([A-Za-z0-9_ ]+\**\)[ ]*)+", "")
    return (
        F.when(bare.rlike("^(0[xX][0-9a-fA-F]+|[0-9]+)$"), "constant").when(bare.startswith('"'), "literal")
        .when(bare.rlike("^&?_?DAT_[0-9a-fA-F]{8}$") | bare.rlike("^&g_"), "address").when(bare.rlike("^param_[0-9]+$"), "parameter")
        .when(bare.rlike("^&?(local|auStack|acStack|stack)_?[A-Za-z0-9]*$"), "stack").otherwise("unknown")
    )


def argument_value(arg: Column) -> Column:
    """The number an argument stands for: a constant, or the address in a data name."""
    bare = F.regexp_replace(F.trim(arg), r"^(?:\([A-Za-z0-9_ ]+\**\)[ ]*)+", "")
    data = F.regexp_extract(bare, "^&?_?DAT_([0-9a-fA-F]{8})$", 1)
    return F.coalesce(number(bare), F.when(data != "", _HEX(data)))


def bind_parameters(derefs: DataFrame, calls: DataFrame, keys: Sequence[str], words: DataFrame | None = None) -> DataFrame:
    """Dereferences of a callee's parameter given an address by its callers: rows with ``caller`` and ``target``.

    ``derefs`` has function_name, param (from 1), struct_offset, offset; ``calls`` has caller, callee, args. A double
    dereference reads the word at argument + struct_offset from ``words`` (keys, address, value). Rows are added to
    those known; peripheral targets only.
    """
    args = calls.select(*keys, "caller", F.col("callee").alias("function_name"), F.posexplode("args").alias("_i", "arg")).withColumn("param", F.col("_i") + 1).withColumn("_value", argument_value(F.col("arg"))).filter("_value IS NOT NULL").drop("_i")
    bound = derefs.join(args, [*keys, "function_name", "param"])
    one = bound.filter("struct_offset IS NULL").withColumn("target", F.col("_value") + F.col("offset"))
    if words is not None:
        w = words.select(*keys, F.col("address").alias("_slot"), F.col("value").alias("_word"))
        two = bound.filter("struct_offset IS NOT NULL").withColumn("_slot", F.col("_value") + F.col("struct_offset")).join(w, [*keys, "_slot"]).withColumn("target", F.col("_word") + F.col("offset")).drop("_slot", "_word")
        one = one.unionByName(two)
    return one.drop("_value", "arg").filter(is_peripheral(F.col("target"))).distinct()


def forwarded_calls(calls: DataFrame, keys: Sequence[str], most: int | None = None) -> DataFrame:
    """Calls as seen from one caller further up: an argument that is the caller's own parameter is replaced by what its
    callers pass; of the callers all count, or the first ``most`` by name."""
    up = calls.select(*keys, F.col("caller").alias("_up"), F.col("callee").alias("caller"), F.col("args").alias("_up_args"))
    both = calls.join(up, [*keys, "caller"]).filter(F.exists("args", lambda a: argument_kind(a) == "parameter"))
    place = lambda a: F.regexp_extract(a, "param_([0-9]+)", 1)
    passed = F.transform("args", lambda a: F.when(argument_kind(a) == "parameter", F.get(F.col("_up_args"), F.coalesce(F.try_to_number(F.nullif(place(a), F.lit("")), F.lit("999")).cast("int"), F.lit(1)) - 1)).otherwise(a))
    from siltstone.operators.ranking import top_k

    kept = both if most is None else top_k(both, [*keys, "caller", "callee"], ["_up"], most)
    return kept.select(*keys, F.col("_up").alias("caller"), "callee", passed.alias("args"))


def pointer_parameters(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, function_name, param): pointer parameters of the function definitions in a text."""
    head = r"(?:void|int|uint|char|byte|bool|uint8_t|uint16_t|uint32_t) ([A-Za-z_][A-Za-z0-9_]*)\(([^()\n]*)\)\n?\{"
    heads = _matches(df, keys, text, head).select(*keys, F.regexp_extract("m", head, 1).alias("function_name"), F.explode(F.split(F.regexp_extract("m", head, 2), ",")).alias("p"))
    return heads.select(*keys, "function_name", F.regexp_extract("p", r"\*+[ ]*([A-Za-z_][A-Za-z0-9_]*)[ ]*$", 1).alias("param")).filter("param <> ''").distinct()


def indirect_calls(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, shape, m): calls through pointers: by cast, by table or by field, the first shape that fits a place."""
    shapes = [("cast", r"\(\*\*?\([^()\n]*\*\*?\)[^;\n]*?\)\([^;\n]*\)"), ("field", r"\(\*[A-Za-z_][A-Za-z0-9_]*->[A-Za-z0-9_]+\)\("), ("table", r"\(\*[A-Za-z_][A-Za-z0-9_]*\[[^\]\n]+\]\)\("), ("name", r"\(\*[A-Za-z_][A-Za-z0-9_]*\)\(")]
    out = None
    for name, p in shapes:
        part = _matches(df, keys, text, p).select(*keys, F.lit(name).alias("shape"), "m")
        out = part if out is None else out.unionByName(part)
    return out


def constant_formats(calls: DataFrame, formats: dict[str, int]) -> DataFrame:
    """Per caller and printing function whether every call passes a literal at the format's place."""
    at = F.coalesce(*[F.when(F.col("callee") == f, F.lit(i)) for f, i in formats.items()])
    own = calls.filter(F.col("callee").isin(list(formats)))
    return own.groupBy("function_name", "callee").agg(F.bool_and(F.coalesce(argument_kind(F.get("args", at)) == "literal", F.lit(False))).alias("all_constant"), F.count("*").alias("calls"))


def unpivot_facts(df: DataFrame, keys: Sequence[str], facts: str, names: Sequence[str]) -> DataFrame:
    """Rows (keys, fact, value): the non-blank entries among ``names`` of a map column."""
    each = F.array(*[F.struct(F.lit(n).alias("fact"), F.element_at(F.col(facts), F.lit(n)).alias("value")) for n in names])
    return df.select(*keys, F.explode(each).alias("f")).select(*keys, "f.*").filter("value IS NOT NULL AND trim(value) <> ''")


def printable(content: Column, least: int = 4) -> Column:
    """Runs of at least ``least`` printable ASCII characters in binary content."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[ -~]{{{least},}}"), 0)


def decodings(text: Column) -> Column:
    """A map of the decodings of a text that give printable ASCII: base64, hex, url."""
    ok = lambda c: F.when(c.rlike(r"^[ -~\t\r\n]+$"), c)
    tried = {"base64": F.when(text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (text != ""), F.decode(F.unbase64(text), "ISO-8859-1")), "hex": F.when(text.rlike("^([0-9a-fA-F]{2})+$"), F.decode(F.unhex(text), "ISO-8859-1")), "url": F.when(text.contains("%"), F.try_url_decode(text))}
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), ok(c).alias("v")) for n, c in tried.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
