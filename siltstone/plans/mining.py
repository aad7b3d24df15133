"""Candidate mining over access facts and program text, as plans of filters, one aggregation per grain and equi-joins.

Facts come as ``accesses`` (binary_id, seq, address, kind, width, target_addr, base_provenance, in_isr, function_name)
and ``functions`` (binary_id, function_name, function_address, code), unique by binary and name. Weights are parameters
of :func:`siltstone.functions.firmware.score`. No plan cuts off rows unless asked to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.firmware import cluster, content_id, function_address, is_peripheral, score
from siltstone.operators import code as text
from siltstone.operators import graph, joins, resolve
from siltstone.operators.ranking import first_wins, top_k, top_k_then_global

# Provenances by which an address counts as known, and their order of preference for stores.
KNOWN = ["CONST", "GLOBAL_PTR", "FLASH_CONST_PTR", "INTRA_RESOLVED", "STRUCT_RESOLVED"]
OPEN = ["ARG", "UNKNOWN", "GLOBAL_PTR"]
# Beginnings of the names of runtime functions, and whole names.
LIBRARY_PREFIXES = ["__", "_printf", "_vfprintf", "_vfiprintf", "_svfiprintf", "_dtoa", "_malloc", "_free", "_realloc", "_calloc", "_sbrk", "_locale", "_ctype", "_str", "_mem", "_puts", "_fputs", "_putc", "_fflush", "_fclose", "_fopen", "net_buf_"]
LIBRARY_NAMES = ["memcpy", "memmove", "memset", "strcpy", "strncpy", "strcat", "strncat", "sprintf", "snprintf"]
# The place of the length among the arguments of copying functions (-1: they take none), of filling
# functions, and the place of the format among those of printing functions.
COPY_LENGTH = {"memcpy": 2, "memmove": 2, "__aeabi_memcpy": 2, "__aeabi_memcpy4": 2, "__aeabi_memcpy8": 2, "bcopy": 2, "strncpy": 2, "strlcpy": 2, "snprintf": 1, "vsnprintf": 1, "strncat": 2, "strcpy": -1, "sprintf": -1, "vsprintf": -1, "strcat": -1}
FILL_LENGTH = {"memset": 2, "bzero": 1, "explicit_bzero": 1, "__aeabi_memset": 1, "__aeabi_memclr": 1, "__aeabi_memclr4": 1}
FORMAT_PLACE = {"printf": 0, "fprintf": 1, "sprintf": 1, "snprintf": 2, "vprintf": 0, "vfprintf": 1, "vsprintf": 1, "vsnprintf": 2, "syslog": 1}
SCALAR_NAMES = ["ptr", "len", "length", "idx", "index", "off", "offset", "count", "cursor", "pos", "position"]


def _sram(c: str) -> Column:
    return F.coalesce(F.col(c).between(0x20000000, 0x3FFFFFFF), F.lit(False))


def _out(df: DataFrame, label: str, address: str | Column, confidence: Column, *extra: str) -> DataFrame:
    return df.select("binary_id", F.lit(label).alias("label"), "function_name", (F.col(address) if isinstance(address, str) else address).alias("address"), confidence.alias("confidence"), *extra)


def access_index(functions: DataFrame, symbols: DataFrame | None = None, handlers: DataFrame | None = None, pointers: DataFrame | None = None, offsets: DataFrame | None = None, handles: DataFrame | None = None) -> DataFrame:
    """All accesses of ``functions`` with target and provenance, the input of the plans below.

    ``symbols`` (binary_id, symbol, address) resolves named globals; ``pointers`` (binary_id, address, value) puts the
    pointed-at register in place of a constant in flash; ``offsets`` (type, field, offset) and ``handles`` (handle_type,
    type) add the fields of typed registers at every base of their type in the binary; functions at an address in
    ``handlers`` (binary_id, address) run in interrupts.
    """
    keys = ["binary_id", "function_name"]
    found = text.memory_accesses(functions, [*keys, "function_address"], "code")
    found = resolve.resolved_accesses(found, keys, resolve.base_assignments(functions, keys, "code"), symbols, ["binary_id"] if symbols is not None else [])
    out = found.select(*keys, "function_address", "seq", "line_no", "kind", "width", "target_addr", "base_provenance")
    if pointers is not None:
        p = pointers.select("binary_id", F.col("address").alias("target_addr"), F.col("value").alias("_value")).distinct()
        hit = F.col("_value").isNotNull()
        out = out.join(p, ["binary_id", "target_addr"], "left").withColumn("target_addr", F.when(hit & (F.col("base_provenance") == "CONST"), F.col("_value")).otherwise(F.col("target_addr"))).withColumn("base_provenance", F.when(hit & (F.col("base_provenance") == "CONST"), "FLASH_CONST_PTR").otherwise(F.col("base_provenance"))).select(*out.columns)
    if offsets is not None:
        used = resolve.field_uses(functions, [*keys, "function_address"], "code", handles)
        bases = resolve.typed_bases(functions, ["binary_id"], "code", offsets)
        targets = resolve.struct_targets(used, bases, offsets, ["binary_id"])
        out = out.unionByName(targets.select(*keys, "function_address", F.lit(-1).alias("seq"), "line_no", "kind", F.lit(4).alias("width"), F.col("target").alias("target_addr"), F.lit("STRUCT_RESOLVED").alias("base_provenance")))
    if handlers is None:
        out = out.withColumn("in_isr", F.lit(False))
    else:
        isr = handlers.select("binary_id", F.col("address").alias("function_address")).distinct().withColumn("in_isr", F.lit(True))
        out = out.join(isr, ["binary_id", "function_address"], "left").withColumn("in_isr", F.coalesce("in_isr", F.lit(False)))
    return out.withColumn("address", F.col("function_address"))


# -- gates -------------------------------------------------------------------------------------------------------------


def is_library(name: Column) -> Column:
    """Whether a function's name is that of runtime code; generated names never are."""
    pattern = "^(?:" + "|".join(LIBRARY_PREFIXES) + ")"
    return F.coalesce(~name.startswith("FUN_") & (name.rlike(pattern) | name.isin(LIBRARY_NAMES)), F.lit(False))


def line_count(code: Column) -> Column:
    return F.size(F.split(code, "\n"))


def candidates_of(functions: DataFrame, most_callers: int, most_lines: int) -> DataFrame:
    """Functions that aren't runtime code, have fewer than ``most_callers`` callers and at most ``most_lines`` lines."""
    callers = graph.fan_in(graph.call_edges(functions, ["binary_id"], "function_name", "code"), ["binary_id"])
    joined = functions.join(callers.withColumnRenamed("callee", "function_name"), ["binary_id", "function_name"], "left")
    return joined.filter(~is_library(F.col("function_name")) & (F.coalesce("callers", F.lit(0)) < most_callers) & (line_count(F.coalesce("code", F.lit(""))) <= most_lines))


def polled(accesses: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows (binary_id, function_name, target_addr, direct): registers a function reads in a loop's condition beside an
    ``&``, itself or (direct false) by calling a function that reads registers."""
    conditions = text.loops(functions, ["binary_id", "function_name"], "code").filter(F.col("loop_kind").isin("while", "do", "for") & F.col("header").contains("&")).select("binary_id", "function_name", "header").distinct()
    reads = accesses.filter((F.col("kind") == "load") & is_peripheral(F.col("target_addr"))).select("binary_id", "function_name", "target_addr").distinct()
    literals = F.transform(F.regexp_extract_all("header", F.lit("0[xX]([0-9a-fA-F]{1,8})(?![0-9a-fA-F])"), 1), lambda h: F.conv(h, 16, 10).cast("bigint"))
    named = conditions.select("binary_id", "function_name", F.explode(literals).alias("target_addr")).distinct().join(reads, ["binary_id", "function_name", "target_addr"], "left_semi").withColumn("direct", F.lit(True))
    called = conditions.select("binary_id", "function_name", F.explode(text.names_before_parenthesis(F.col("header"))).alias("_callee")).distinct()
    readers = reads.select("binary_id", F.col("function_name").alias("_callee")).distinct()
    indirect = called.join(readers, ["binary_id", "_callee"], "left_semi").select("binary_id", "function_name").distinct().join(reads, ["binary_id", "function_name"]).withColumn("direct", F.lit(False))
    both = named.unionByName(indirect)
    return both.groupBy("binary_id", "function_name", "target_addr").agg(F.bool_or("direct").alias("direct"))


def copying_functions(functions: DataFrame) -> DataFrame:
    """Rows (binary_id, function_name, acts_as): functions of at most 80 lines that copy or fill byte by byte under another
    name, told by their loops: a copy with a test for zero or with two parameters is a strcpy, with three a memcpy, a store
    of the second parameter a memset."""
    loops = text.loops(functions.filter(line_count(F.col("code")) <= 80), ["binary_id", "function_name"], "code")
    of = loops.groupBy("binary_id", "function_name").agg(F.bool_or(F.col("copy_src").isNotNull()).alias("copies"), F.bool_or(F.col("copy_src").isNull() & F.col("store_expr").isNotNull() & F.col("body").rlike(r"=\s*(?:\([^)]*\)\s*)?param_2\b")).alias("fills"), F.bool_or(F.col("header").rlike(r"(?:!=|==)\s*(?:0|'\\0')") | F.col("body").rlike(r"(?:!=|==)\s*(?:0\b|'\\0')")).alias("zero"))
    n = functions.select("binary_id", "function_name", F.size(F.array_distinct(F.regexp_extract_all("code", F.lit(r"param_(\d+)"), 1))).alias("n"))
    act = F.when(F.col("copies") & F.col("zero") & (F.col("n") >= 2), "strcpy").when(F.col("copies") & ~F.col("fills") & (F.col("n") == 2), "strcpy").when(F.col("copies") & (F.col("n") >= 3), "memcpy").when(F.col("fills") & (F.col("n") >= 2), "memset")
    return of.join(n, ["binary_id", "function_name"]).withColumn("acts_as", act).filter("acts_as IS NOT NULL").select("binary_id", "function_name", "acts_as")


# -- sources -------------------------------------------------------------------------------------------------------------


def known_reads(accesses: DataFrame, in_isr: bool = False) -> DataFrame:
    """Loads whose address is known, outside or within interrupts."""
    return accesses.filter((F.col("kind") == "load") & F.col("base_provenance").isin(KNOWN) & F.col("target_addr").isNotNull() & (F.col("in_isr") == in_isr))


def register_reads(accesses: DataFrame, in_isr: bool = False, registers: DataFrame | None = None, polls: DataFrame | None = None) -> DataFrame:
    """Peripheral reads, one per function and register, scored by what their 4 KB cluster shows.

    ``registers`` (address, name, class) lowers the score of status and control registers, exactly or by the nearest of
    the cluster; ``polls`` (see :func:`polled`) that of registers only waited on.
    """
    reads = known_reads(accesses, in_isr).filter(is_peripheral(F.col("target_addr")))
    onto = accesses.filter(is_peripheral(F.col("target_addr")))
    ctx = onto.groupBy("binary_id", cluster(F.col("target_addr"), 12).alias("cluster")).agg(F.countDistinct("function_name").alias("functions"), F.bool_or(F.col("kind") == "store").alias("written"), F.bool_or(F.col("kind") == "load").alias("read"), F.count_if(F.col("kind") == "load").alias("loads"))
    own = onto.groupBy("binary_id", "target_addr").agg(F.bool_or(F.col("kind") == "store").alias("own_written"))
    first = first_wins(reads, ["binary_id", "function_name", "target_addr"], ["seq"]).withColumn("cluster", cluster(F.col("target_addr"), 12)).join(ctx, ["binary_id", "cluster"]).join(own, ["binary_id", "target_addr"])
    if in_isr:
        return _out(first, "ISR_MMIO_READ", "target_addr", F.lit(0.7))
    terms = [(F.col("own_written"), 0.2), (~F.col("own_written") & F.col("written"), 0.05), (F.col("functions") > 1, 0.1), (F.col("loads") >= 3, 0.1)]
    if registers is not None:
        first = joins.exact_else_cluster(first, "target_addr", registers, "address", "class", 0xFFFFF000).drop("match")
        terms += [(F.col("class") == "STATUS", -0.2), (F.col("class") == "CONTROL", -0.15)]
        if polls is not None:
            first = first.join(polls, ["binary_id", "function_name", "target_addr"], "left")
            waits = F.coalesce(F.col("class"), F.lit("UNKNOWN")).isin("STATUS", "UNKNOWN")
            terms += [(waits & F.col("direct"), -0.15), (waits & ~F.col("direct"), -0.1)]
    elif polls is not None:
        first = first.join(polls, ["binary_id", "function_name", "target_addr"], "left")
        terms += [(F.col("direct"), -0.15), (~F.col("direct"), -0.1)]
    return _out(first, "MMIO_READ", "target_addr", score(0.5, terms, 0.0, 1.0))


def isr_filled_buffers(accesses: DataFrame) -> DataFrame:
    """SRAM clusters that interrupts write and other code reads: one aggregation, not two joined ones."""
    c = accesses.filter(_sram("target_addr")).groupBy("binary_id", cluster(F.col("target_addr"), 8).alias("address"))
    both = c.agg(F.count_if(F.col("in_isr") & (F.col("kind") == "store")).alias("w"), F.count_if(~F.col("in_isr") & (F.col("kind") == "load")).alias("r"), F.min_by(F.when(F.col("in_isr"), F.col("function_name")), F.when(F.col("in_isr"), F.col("seq"))).alias("function_name"))
    return _out(both.filter("w > 0 AND r > 0"), "ISR_FILLED_BUFFER", "address", score(0.6, [(F.col("w") > 1, 0.1), (F.col("r") > 1, 0.1)], 0.0, 0.9))


def config_sites(accesses: DataFrame, least: int = 3) -> DataFrame:
    """Functions that write one peripheral cluster at least ``least`` times: how often, and whether a pointer-like value is
    among it."""
    sites = accesses.filter((F.col("kind") == "store") & is_peripheral(F.col("target_addr"))).groupBy("binary_id", "function_name", cluster(F.col("target_addr"), 12).alias("cluster"))
    return sites.agg(F.count("*").alias("n"), F.bool_or(F.col("base_provenance").isin("GLOBAL_PTR", "CONST")).alias("pointer_like")).filter(F.col("n") >= least)


def buffer_clusters(sites: DataFrame, accesses: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (binary_id, function_name, cluster, own, readers, place): the SRAM clusters a configuring function touches, by
    how often it does and how many other functions read them."""
    sram = accesses.filter(_sram("target_addr")).withColumn("buffer", cluster(F.col("target_addr"), 8))
    own = sites.select("binary_id", "function_name").distinct().join(sram, ["binary_id", "function_name"]).groupBy("binary_id", "function_name", "buffer").agg(F.count("*").alias("own"))
    read = sram.filter("kind = 'load' AND NOT in_isr").select("binary_id", "buffer", F.col("function_name").alias("_reader")).distinct()
    wide = own.join(read, ["binary_id", "buffer"], "left").groupBy("binary_id", "function_name", "buffer", "own").agg(F.count_if(F.col("_reader").isNotNull() & (F.col("_reader") != F.col("function_name"))).alias("readers"))
    ranked = top_k(wide, ["binary_id", "function_name"], [F.desc("own"), F.desc("readers"), "buffer"], most if most is not None else 2**31 - 1)
    return ranked.withColumnRenamed("buffer", "cluster")


def dma_buffers(accesses: DataFrame, least: int = 3) -> DataFrame:
    """Functions that configure a peripheral with a pointer-like value among it, at the first buffer they touch, else at the
    peripheral's cluster."""
    sites = config_sites(accesses, least).filter("pointer_like")
    best = buffer_clusters(sites, accesses, 1).select("binary_id", "function_name", F.col("cluster").alias("_buffer"), "readers")
    rows = sites.join(best, ["binary_id", "function_name"], "left")
    return _out(rows, "DMA_BACKED_BUFFER", F.coalesce("_buffer", "cluster"), score(0.45, [(F.col("n") >= 5, 0.15), (F.col("readers") > 0, 0.1)], 0.0, 0.9))


# -- sinks ---------------------------------------------------------------------------------------------------------------


def store_sinks(accesses: DataFrame, functions: DataFrame | None = None, per_function: int | None = None, total: int | None = None) -> DataFrame:
    """Stores through pointers of open origin outside peripherals and flash: the best provenance per function, then, if
    asked for, the best of the binary. With ``functions`` runtime code, functions of four or more callers and those of over
    140 lines are left out; without it runtime code is."""
    rank = F.coalesce(*[F.when(F.col("base_provenance") == p, F.lit(i)) for i, p in enumerate(OPEN)], F.lit(len(OPEN)))
    target = F.col("target_addr")
    fixed = F.coalesce(is_peripheral(target) | target.between(0, 0x1FFFFFFF), F.lit(False))
    rows = accesses.filter((F.col("kind") == "store") & F.col("base_provenance").isin(OPEN) & ~fixed & ~is_library(F.col("function_name"))).withColumn("_rank", rank)
    if functions is not None:
        rows = rows.join(candidates_of(functions, 4, 140).select("binary_id", "function_name"), ["binary_id", "function_name"], "left_semi")
    best = rows.groupBy("binary_id", "function_name").agg(F.min(F.struct("_rank", "seq", "address", "target_addr")).alias("b"), F.count("*").alias("n"))
    confidence = score(0.25, [(F.col("b._rank") == 0, 0.15), (F.col("b._rank") == 1, 0.1), (F.col("b.target_addr").isNull(), 0.1), (F.col("n") >= 3, 0.05)], 0.0, 0.7)
    scored = best.select("binary_id", "function_name", F.col("b.address").alias("address"), confidence.alias("confidence"))
    if per_function is not None:
        scored = top_k(scored, ["binary_id", "function_name"], [F.desc("confidence"), "address"], per_function).drop("place")
    if total is not None:
        scored = top_k(scored, ["binary_id"], [F.desc("confidence"), "function_name"], total).drop("place")
    return _out(scored, "STORE_SINK", "address", F.col("confidence"))


def parameter_store_sinks(functions: DataFrame, found: DataFrame) -> DataFrame:
    """Functions not among ``found`` that store through a pointer parameter. Runtime code, functions of four or more callers
    and those of over 80 lines are left out, as are those that only move on places and lengths kept behind pointers."""
    keys = ["binary_id", "function_name"]
    stores = text.pointer_stores(candidates_of(functions, 4, 80), [*keys, "function_address"], "code").filter("is_parameter AND NOT own_update AND form <> 'element'")
    named = stores.groupBy(*keys, "function_address").agg(F.bool_or(F.col("base").startswith("param_") | ~F.lower("base").isin(SCALAR_NAMES)).alias("_real"), F.min_by("base", F.struct((~F.col("base").startswith("param_")).alias("a"), "line_no")).alias("base"))
    rows = named.filter("_real").join(found.select(*keys).distinct(), keys, "left_anti")
    return _out(rows, "STORE_SINK", F.coalesce("function_address", function_address(F.col("function_name"))), F.lit(0.45), "base")


def loop_sinks(functions: DataFrame) -> DataFrame:
    """The first loop of each function that stores to a computed place; a loop that moves elements is a copy. Runtime code
    and bounded string readers are left out."""
    keys = ["binary_id", "function_name"]
    own = functions.filter(~is_library(F.col("function_name")))
    rows = text.loops(own, [*keys, "function_address"], "code").filter("store_expr IS NOT NULL").join(text.bounded_readers(own, keys, "code"), keys, "left_anti")
    first = first_wins(rows, keys, ["line_no", "header"])
    copies = F.col("copy_src").isNotNull()
    base = score(0.3, [(F.col("bound").isNotNull() & ~F.col("bound_is_constant"), 0.2), (F.col("index_expr") != "", 0.05)], 0.0, 0.8)
    out = first.withColumn("label", F.when(copies, "COPY_SINK").otherwise("LOOP_WRITE_SINK")).withColumn("confidence", F.when(copies, F.greatest(base, F.lit(0.5))).otherwise(base))
    return out.select("binary_id", "label", "function_name", F.coalesce("function_address", function_address(F.col("function_name"))).alias("address"), "confidence", "loop_kind", "store_expr", "index_expr", "bound", "bound_is_constant", "copy_dst", "copy_src")


def call_sites(functions: DataFrame, callees: Sequence[str]) -> DataFrame:
    """Calls of ``callees`` in functions that aren't those themselves: binary_id, function_name, at, line_no, callee, args,
    has_guard."""
    return text.guarded_calls(functions, ["binary_id", "function_name"], "code", callees).filter("function_name <> callee")


def _length(callees: dict[str, int]) -> tuple[Column, Column]:
    """The length argument of a call, and whether it is constant."""
    place = F.coalesce(*[F.when(F.col("callee") == c, F.lit(i)) for c, i in callees.items() if i >= 0], F.lit(-1))
    length = F.when(place >= 0, F.get("args", place))
    return length, F.coalesce(length.rlike(r"^\s*(?:\([^()]*\)\s*)*(?:0x[0-9a-fA-F]+|[0-9]+|sizeof\b.*)[uUlL]*\s*$"), F.lit(False))


def copy_sinks(calls: DataFrame, callees: dict[str, int] | None = None, label: str = "COPY_SINK") -> DataFrame:
    """The first call of each copying function in each function (``calls``: binary_id, function_name, callee, at, args and,
    if known, has_guard). ``callees`` gives the place of the length argument, -1 where there is none. Runtime code is left
    out."""
    callees = COPY_LENGTH if callees is None else callees
    length, constant = _length(callees)
    if "has_guard" not in calls.columns:
        calls = calls.withColumn("has_guard", F.lit(False))
    first = first_wins(calls.filter(F.col("callee").isin(list(callees)) & (F.col("function_name") != F.col("callee")) & ~is_library(F.col("function_name"))), ["binary_id", "function_name", "callee"], ["at"])
    rows = first.withColumn("length_expr", length).withColumn("length_is_constant", constant).withColumn("dst_kind", resolve.argument_kind(F.get("args", F.lit(0))))
    unbounded = F.col("callee").isin([c for c, i in callees.items() if i < 0])
    confidence = score(0.45, [(unbounded, 0.25), (~unbounded & ~F.col("length_is_constant"), 0.15), (~F.col("has_guard"), 0.1), (F.col("dst_kind") == "parameter", 0.05), (F.col("dst_kind") == "stack", 0.03)], 0.0, 0.95)
    return _out(rows, label, "at", confidence, "callee", "args", "length_expr", "length_is_constant", "has_guard", "dst_kind")


def fill_sinks(calls: DataFrame) -> DataFrame:
    """The first call of each filling function in each function, scored like copies but from lower."""
    length, constant = _length(FILL_LENGTH)
    first = first_wins(calls.filter(F.col("callee").isin(list(FILL_LENGTH)) & ~is_library(F.col("function_name"))), ["binary_id", "function_name", "callee"], ["at"])
    rows = first.withColumn("length_expr", length).withColumn("length_is_constant", constant).withColumn("dst_kind", resolve.argument_kind(F.get("args", F.lit(0))))
    confidence = score(0.4, [(~F.col("length_is_constant"), 0.2), (~F.col("has_guard"), 0.1), (F.col("dst_kind").isin("parameter", "unknown"), 0.1), (F.col("callee") != "memset", -0.1)], 0.1, 0.95)
    return _out(rows, "MEMSET_SINK", "at", confidence, "callee", "args", "length_expr", "length_is_constant", "has_guard", "dst_kind")


def format_sinks(calls: DataFrame) -> DataFrame:
    """Functions that call a printing function with a format that isn't a literal, at the first such call."""
    place = F.coalesce(*[F.when(F.col("callee") == c, F.lit(i)) for c, i in FORMAT_PLACE.items()])
    rows = calls.filter(F.col("callee").isin(list(FORMAT_PLACE)) & ~is_library(F.col("function_name"))).withColumn("format_arg", F.get("args", place)).filter("format_arg IS NOT NULL AND NOT startswith(trim(format_arg), '\"')")
    return _out(first_wins(rows, ["binary_id", "function_name", "callee"], ["at"]), "FORMAT_STRING_SINK", "at", score(0.5, [(resolve.argument_kind(F.col("format_arg")) == "parameter", 0.2)], 0.0, 0.9), "callee", "format_arg")


def pointer_call_sinks(functions: DataFrame) -> DataFrame:
    """Functions of fewer than five callers and at most 180 lines that call through a pointer; the first call of the first
    shape by weight: table by cast, field, table, name."""
    own = candidates_of(functions, 5, 180)
    found = resolve.indirect_calls(own, ["binary_id", "function_name", "function_address"], "code")
    weight = F.coalesce(*[F.when(F.col("shape") == s, F.lit(i)) for i, s in enumerate(("cast", "table", "field", "name"))])
    best = found.groupBy("binary_id", "function_name", "function_address").agg(F.min(F.struct(weight.alias("w"), "m", "shape")).alias("b"))
    rows = best.select("binary_id", "function_name", "function_address", F.col("b.shape").alias("shape"), F.col("b.m").alias("matched"))
    confidence = score(0.45, [(F.col("shape") == "cast", 0.2), (F.col("shape") == "table", 0.15), (F.col("matched").contains("param_"), 0.1)], 0.0, 0.85)
    return _out(rows, "FUNC_PTR_SINK", F.coalesce("function_address", function_address(F.col("function_name"))), confidence, "shape", "matched")


def best_symbols(symbols: DataFrame, name: str, keys: Sequence[str] = (), wanted: Column | None = None) -> DataFrame:
    """Of each ``name`` (and ``keys``) the symbol to call it by: one that is exactly ``wanted`` if any is, then the lowest
    address, then the least of the other columns."""
    rest = [c for c in symbols.columns if c not in (name, "address", *keys)]
    exact = F.lit(0) if wanted is None else F.when(wanted, 0).otherwise(1)
    best = symbols.filter(F.col("address").isNotNull()).groupBy(*keys, name).agg(F.min(F.struct(exact.alias("_x"), "address", *rest)).alias("b"))
    return best.select(*keys, name, "b.address", *[f"b.{c}" for c in rest])


def packs(candidates: DataFrame) -> DataFrame:
    """Candidates with a stable id made of label, function, address and a content hash."""
    digest = content_id(F.col("binary_id"), F.col("label"), F.col("function_name"), F.col("address"))
    return candidates.withColumn("pack_id", F.concat(F.col("label"), F.lit("@"), F.col("function_name"), F.format_string("-0x%08x-", F.col("address")), digest))


def budgeted(candidates: DataFrame, per_label: int) -> DataFrame:
    """The best candidates per label."""
    return top_k(candidates, ["label"], [F.desc("confidence"), "address", "binary_id", "function_name"], per_label)


def best_overall(candidates: DataFrame, per_function: int, total: int) -> DataFrame:
    return top_k_then_global(candidates, ["binary_id", "function_name"], [F.desc("confidence"), "address", "label"], per_function, total)
