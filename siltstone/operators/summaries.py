"""Grouped summaries: clusters of addresses, histograms, micro-averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Columns precision, recall, f1."""
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1")]


def cluster_context(df: DataFrame, address: Column, mask: int, function: str, is_load: Column) -> DataFrame:
    """Per address cluster: distinct functions, loads, stores, whether any store, functions in order."""
    return df.groupBy(address.bitwiseAND(F.lit(mask)).alias("cluster")).agg(
        F.countDistinct(function).alias("n_functions"),
        F.count_if(is_load).alias("loads"),
        F.count_if(~is_load).alias("stores"),
        F.bool_or(~is_load).alias("has_store"),
        F.array_sort(F.collect_set(F.when(~is_load, F.col(function)))).alias("writers"),
    )


def access_kinds(df: DataFrame, keys: Sequence[str], is_load: Column) -> DataFrame:
    """Per key ``load``, ``store`` or ``both``."""
    some = F.when(F.bool_or(is_load) & F.bool_or(~is_load), "both").when(F.bool_or(is_load), "load").otherwise("store")
    return df.groupBy(*keys).agg(some.alias("kind"))


def histogram(df: DataFrame, column: str, unknown: str = "unknown", by: Sequence[str] = ()) -> DataFrame:
    """Counts per value as text, null counted as ``unknown``."""
    return df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def micro_average(df: DataFrame, by: Sequence[str], tp: str, fp: str, fn: str) -> DataFrame:
    """Summed counts and rates per value of each of ``by`` and in total, in one pass of grouping sets.

    ``level`` names the grouping; rates come from sums, not from averaged rates.
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    base = df.select(*keys, tp, fp, fn)
    grouped = base.groupingSets([[F.col(c)] for c in by] + [[]], *[F.col(c) for c in by]).agg(*[F.sum(x).alias(x) for x in (tp, fp, fn)], F.grouping_id(*by).alias("_g"))
    level, value = F.lit("total"), F.lit("all")
    for i, c in enumerate(by):
        only = (2 ** len(by) - 1) & ~(1 << (len(by) - 1 - i))
        level, value = F.when(F.col("_g") == only, c).otherwise(level), F.when(F.col("_g") == only, F.col(c)).otherwise(value)
    return grouped.select(level.alias("level"), value.alias("value"), tp, fp, fn, *rates(F.col(tp), F.col(fp), F.col(fn)))


def status_pivot(df: DataFrame, by: str, status: str, values: Sequence[str]) -> DataFrame:
    """A row per ``by``, a column of counts per status among ``values``."""
    return df.groupBy(by).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v}") for v in values])


def strongest(df: DataFrame, keys: Sequence[str], strength: str, order: Sequence[str], at: str) -> DataFrame:
    """Per key the strongest value after ``order`` (strongest first); the earliest ``at`` on a tie."""
    rank = F.coalesce(*[F.when(F.col(strength) == v, F.lit(len(order) - i)) for i, v in enumerate(order)], F.lit(0))
    best = F.max(F.struct(rank.alias("r"), (-F.col(at)).alias("a"), F.col(strength).alias("v"), F.col(at).alias("t")))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(strength), F.col("b.t").alias(at))


def share_gate(df: DataFrame, group: str, flag: Column, least: float) -> DataFrame:
    """The flagged rows of groups in which at least the share ``least`` of all rows is flagged, with that ``ratio``; null is
    a group."""
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    share = rows.groupBy(F.col(group).alias("_g")).agg(F.avg(F.when(F.col("_flag"), 1.0).otherwise(0.0)).alias("ratio"))
    return rows.filter("_flag").join(share, F.col(group).eqNullSafe(F.col("_g"))).filter(F.col("ratio") >= least).drop("_flag", "_g")


def repeated_keys(df: DataFrame, keys: Sequence[str], versions: str) -> DataFrame:
    """Keys that come with more than one different ``versions``; keys with a null last part don't count."""
    return df.filter(F.col(keys[-1]).isNotNull()).select(*keys, versions).distinct().groupBy(*keys).count().filter("count > 1").select(*keys)


def dangling(df: DataFrame, columns: Sequence[str], parents: DataFrame) -> DataFrame:
    """Different rows of ``df`` whose ``columns`` no row of ``parents`` has."""
    return df.distinct().join(parents.select(*columns).distinct(), list(columns), "left_anti")
