"""Ranking, budgets and sequences: the operators whose natural form is a window.

Every order given to these functions should end in a unique column, else ties fall as the engine reads them. A window
over a whole group would put it into one task; what runs along a group is therefore computed in slices: the rows are
range-partitioned by group and order, each slice is folded by itself, and the folds of the slices before it, one row
per group and slice, are brought in by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` with ``_slice``, which numbers stretches of each group in order. A group of a third of all rows fills a
    third of the slices. Written out, since a second run could cut elsewhere."""
    return materialize(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_slice", F.spark_partition_id()), "slices")


def running(sliced: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, name: str, how: str = "sum", own: bool = True, slice_by: str = "_slice") -> DataFrame:
    """``sliced`` with ``name``: sum or maximum (``how``) of ``value`` over the group's rows so far, the row itself
    included if ``own``. Null values count for nothing; null keys are a group; a sum over no row is 0, a maximum null.

    ``slice_by`` numbers slices that follow each other in ``order``; a hash will do where any order is good.
    """
    fold = F.sum if how == "sum" else F.max
    rows = sliced.withColumn("_value", value)
    folds = rows.groupBy(*keys, slice_by).agg(fold("_value").alias("_fold"))
    before = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = folds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(slice_by).alias("_s"), fold("_fold").over(before).alias("_offset"))
    within = Window.partitionBy(*keys, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    same = F.col(slice_by) == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = rows.withColumn("_own", fold("_value").over(within)).join(offsets, same, "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("_offset", zero) + F.coalesce("_own", zero) if how == "sum" else F.greatest("_offset", "_own")
    return both.withColumn(name, total).drop("_value", "_own", "_s", "_offset", *[f"_k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, group: Sequence[str], value: Column, order: Sequence[str], slice_by: Column, name: str = "before") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the group's earlier rows, in the order of (slice_by, order)."""
    return running(df.withColumn("_slice", slice_by), group, order, value.cast("bigint"), name, own=False).drop("_slice")


def place_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in its group, from 0."""
    return running(slices(df, keys, order), keys, order, F.lit(1), name, own=False).drop("_slice")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per ``keys``; null keys are equal to each other."""
    return top_k(df, keys, order, 1).drop("place")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows per group with their ``place``. Tasks keep ``k`` rows per group before they shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def top_k_then_global(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, total: int) -> DataFrame:
    """The ``total`` best of each group's ``k`` best."""
    return top_k(df, keys, order, k).drop("place").orderBy(*order).limit(total)


def ranked(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """The ``k`` best rows with a 1-based ``place``; the limit comes first, so one task ranks ``k`` rows only."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def islands(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, gap: Column) -> DataFrame:
    """Ranges coalesced when they start at most ``gap`` behind the furthest end so far: (keys, lo, hi, pieces).

    Rows without lo or hi join no island.
    """
    order = ["_lo", "_hi"]
    rows = df.select(*keys, lo.alias("_lo"), hi.alias("_hi")).filter("_lo IS NOT NULL AND _hi IS NOT NULL")
    rows = running(slices(rows, keys, order), keys, order, F.col("_hi"), "_reach", "max", own=False)
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach") + gap), 1).otherwise(0))
    rows = running(rows, keys, [*order, F.desc("_new")], F.col("_new"), "_island")
    return rows.groupBy(*keys, "_island").agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.count("*").alias("pieces")).drop("_island")


def budget_suffix(df: DataFrame, keys: Sequence[str], latest_first: Sequence[Column | str], cost: Column, budget: int) -> DataFrame:
    """The longest run of latest rows whose costs, never negative, stay within ``budget``, with their sum ``spent``."""
    rows = running(slices(df, keys, latest_first), keys, latest_first, cost, "spent").drop("_slice")
    return rows.filter(F.col("spent") <= budget)


def budget_counter(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], wants: Column, budget: int) -> DataFrame:
    """``granted``: rows that want something get it in order while ``budget`` lasts."""
    rows = running(slices(df.withColumn("_wants", wants), keys, order), keys, order, F.when(F.col("_wants"), 1).otherwise(0), "_used")
    return rows.withColumn("granted", F.col("_wants") & (F.col("_used") <= budget)).drop("_wants", "_used", "_slice")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int) -> DataFrame:
    """``chunk``: batches of ``size`` rows in order."""
    return place_in_group(df, keys, order, "_at").withColumn("chunk", F.expr(f"_at div {size}")).drop("_at")


def ordered_batches(df: DataFrame, keys: Sequence[str], order: str, cost: str, max_rows: int, max_cost: int) -> DataFrame:
    """``batch``: rows in order, a new batch once it would hold over ``max_rows`` rows or ``max_cost``.

    Where a batch begins depends on every row before it, so each group is folded in order; groups should be cut so
    that one fits a task. A row over ``max_cost`` is a batch of its own.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys, order, cost).schema) + ", batch int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, rows, spent, got = 0, 0, 0, []
        for c in pdf[cost].fillna(0):
            if rows and (rows >= max_rows or spent + c > max_cost):
                batch, rows, spent = batch + 1, 0, 0
            rows, spent = rows + 1, spent + c
            got.append(batch)
        return pdf.assign(batch=got)

    return df.select(*keys, order, cost).groupBy(*keys).applyInPandas(fold, schema)


def scope_quotas(df: DataFrame, scope: str, order: Sequence[Column | str], quotas: dict[str, int], total: int) -> DataFrame:
    """Up to a quota per scope, then the places left up to ``total`` by the overall order, with ``phase`` 1 or 2.

    If the quotas alone exceed ``total``, the best by overall order stay. Scopes without quota only take part in the
    second phase.
    """
    quota = F.coalesce(*[F.when(F.col(scope) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    own = df.withColumn("_at", F.row_number().over(Window.partitionBy(scope).orderBy(*order)))
    # Within a scope only the first ``total`` rows can ever be taken; the rest goes before anything is sorted as a whole.
    own = own.filter(F.col("_at") <= total).withColumn("phase", F.when(F.col("_at") <= quota, 1).otherwise(2)).drop("_at")
    return own.orderBy("phase", *order).limit(total)


def alternating_shards(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], shards: int = 2) -> DataFrame:
    """``shard``: the rows of each group dealt out in turn."""
    return place_in_group(df, keys, order, "_at").withColumn("shard", (F.col("_at") % shards).cast("int")).drop("_at")


def diverse_fill(df: DataFrame, bucket: Sequence[str], order: Sequence[Column | str], size: int, by_rank: float = 0.9) -> DataFrame:
    """``size`` rows: the share ``by_rank`` of them the best, then the best of each bucket not yet seen, then the
    next best; ``phase`` 1, 2 or 3 tells which. Rows are distinct and ``order`` is total; null is a bucket."""
    head = int(size * by_rank)
    order_all = Window.orderBy(*order)
    best = df.orderBy(*order).limit(head)
    seen = best.select(*[F.col(b).alias(f"_{b}") for b in bucket]).distinct()
    # Only the best ``size`` rows of a bucket can be taken at all: the others go before any global order.
    own = df.withColumn("_at", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).filter(F.col("_at") <= size)
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in bucket]
    new = own.join(seen, same, "left_anti").filter("_at = 1").drop("_at").withColumn("phase", F.lit(2))
    new = new.orderBy(*order).limit(size - head)
    rest = own.drop("_at").orderBy(*order).limit(2 * size).withColumn("_place", F.row_number().over(order_all)).filter(F.col("_place") > head).drop("_place").withColumn("phase", F.lit(3))
    # A row that is the first of a new bucket may be among the next best as well; its earlier phase counts.
    late = new.unionByName(rest).groupBy(*df.columns).agg(F.min("phase").alias("phase"))
    return best.withColumn("phase", F.lit(1)).unionByName(late.orderBy("phase", *order).limit(size - head))
