"""What a proposed label has to prove: rules as data over the facts of a proposal, and the verdict they give.

``facts`` is a map of texts. A fact that is absent, blank, ``false``, ``0`` or an empty list counts as not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.firmware import is_peripheral
from siltstone.operators.evaluation import rule_verdict

# What an expression of a resolved address says.
RESOLVED = "CONST|INTERPROCEDURAL|FLASH_CONST_PTR|STRUCT_RESOLVED|INTRA_RESOLVED"


def _raw(name: str) -> Column:
    return F.element_at("facts", F.lit(name))


def _has(name: str) -> Column:
    value = F.lower(F.trim(_raw(name)))
    return F.coalesce(~value.isin("", "false", "0", "[]", "none", "null"), F.lit(False))


def _number(name: str) -> Column:
    return F.coalesce(F.expr(f"try_cast(element_at(facts, '{name}') AS bigint)"), F.lit(0))


def _variable(name: str) -> Column:
    """Said to be no constant; silence means constant."""
    return F.coalesce(F.lower(_raw(name)) == "false", F.lit(False))


def rules(assume_resolved: bool = True) -> list[tuple[str, str, bool, Column]]:
    """(label, id, required, condition) of all obligations. With ``assume_resolved`` a register read that says nothing of its
    address's origin passes, since whoever proposed it has resolved it."""
    origin = F.coalesce(_raw("addr_expr").rlike(RESOLVED), F.lit(False)) | F.lit(assume_resolved)
    ranged = (F.coalesce(_raw("segment_of_base") == "PERIPHERAL_RANGE", F.lit(False))) | is_peripheral(F.col("address"))
    promoted = F.coalesce(_raw("promoted_from").startswith("LOOP_WRITE_SINK"), F.lit(False)) & _has("in_loop") & _has("store_expr")
    looped = _has("in_loop") & _has("store_expr") & (_has("len_expr") | _has("loop_bound") | _has("index_expr") | _has("src_expr"))
    called = _has("args") | _has("call_found") | _has("callee")
    unguarded = _variable("len_is_constant") & ~_has("has_bounds_guard")
    return [
        *[(label, id_, True, c) for label in ("MMIO_READ", "ISR_MMIO_READ") for id_, c in (("O_MMIO_1", origin), ("O_MMIO_2", ranged))],
        ("MMIO_READ", "O_MMIO_3", False, _has("has_read_modify_write")),
        ("MMIO_READ", "O_MMIO_4", False, _has("multi_function_cluster")),
        ("ISR_MMIO_READ", "O_ISR_1", True, _has("in_isr")),
        ("ISR_FILLED_BUFFER", "O_BUF_1", True, _number("isr_write_count") > 0),
        ("ISR_FILLED_BUFFER", "O_BUF_2", True, _number("non_isr_read_count") > 0),
        ("DMA_BACKED_BUFFER", "O_DMA_1", True, _number("config_write_count") >= 3),
        ("DMA_BACKED_BUFFER", "O_DMA_2", True, _has("has_pointer_like_write")),
        ("COPY_SINK", "O_COPY_1", True, _has("callee") | promoted),
        ("COPY_SINK", "O_COPY_2", True, called | looped),
        ("COPY_SINK", "O_COPY_3", False, unguarded),
        ("MEMSET_SINK", "O_MEMSET_1", True, _has("callee")),
        ("MEMSET_SINK", "O_MEMSET_2", True, called),
        ("MEMSET_SINK", "O_MEMSET_3", False, unguarded),
        ("STORE_SINK", "O_STORE_1", True, F.coalesce(_raw("provenance").isin("ARG", "GLOBAL_PTR", "UNKNOWN"), F.lit(False))),
        ("STORE_SINK", "O_STORE_2", False, _has("has_unresolved_target") | _has("target_addr")),
        ("LOOP_WRITE_SINK", "O_LOOP_1", True, _has("in_loop")),
        ("LOOP_WRITE_SINK", "O_LOOP_2", False, _variable("bound_is_constant")),
        ("FORMAT_STRING_SINK", "O_FMT_1", True, _has("format_func") | _has("fallback_pattern")),
        ("FORMAT_STRING_SINK", "O_FMT_2", True, _has("format_arg_is_variable")),
        ("FUNC_PTR_SINK", "O_FPTR_1", True, _has("indirect_call_pattern")),
        ("FUNC_PTR_SINK", "O_FPTR_2", False, _has("input_derived") | F.coalesce(_raw("matched_text").contains("param_"), F.lit(False))),
    ]


def obligations(proposals: DataFrame, keys: list[str], assume_resolved: bool = True) -> DataFrame:
    """Rows (keys, label, obligation, required, satisfied): what each of ``proposals`` (keys, label, address, facts) has to
    prove and whether its facts do."""
    every = F.array(*[F.struct(F.lit(lb).alias("of"), F.lit(i).alias("obligation"), F.lit(req).alias("required"), F.coalesce(ok, F.lit(False)).alias("satisfied")) for lb, i, req, ok in rules(assume_resolved)])
    rows = proposals.select(*keys, "label", F.explode(F.filter(every, lambda o: o["of"] == F.col("label"))).alias("o"))
    return rows.select(*keys, "label", "o.obligation", "o.required", "o.satisfied")


def verdicts(proposals: DataFrame, keys: list[str], assume_resolved: bool = True) -> DataFrame:
    """Rows (keys, label, verdict, satisfied): VERIFIED if all that is required holds, REJECTED if any of it fails, UNKNOWN
    for labels without obligations."""
    return rule_verdict(proposals, keys, [(lb, i, req, F.coalesce(ok, F.lit(False))) for lb, i, req, ok in rules(assume_resolved)], "label")
