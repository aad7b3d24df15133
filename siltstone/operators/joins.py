"""Joins on ranges, distances and shared clusters, all reduced to equi-joins that Catalyst can distribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import running, slices


def point_in_range(points: DataFrame, at: Column, ranges: DataFrame, lo: Column, hi: Column, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every point with every range that holds it, both ends included.

    Ranges are listed once per bucket of ``width`` that they touch and points have one bucket, so the join is an
    equi-join on (keys, bucket) with the exact test behind it. ``width`` should be near the usual range: far
    smaller repeats ranges, far larger crowds buckets. Null points and ends match nothing; a range whose end is
    before its start is empty.
    """
    p = points.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width)).filter("_at IS NOT NULL")
    r = ranges.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    return p.join(r, [*keys, "_bucket"]).filter("_at BETWEEN _lo AND _hi").drop("_at", "_lo", "_hi", "_bucket")


def range_overlap(a: DataFrame, a_lo: Column, a_hi: Column, b: DataFrame, b_lo: Column, b_hi: Column, width: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair of ranges that share a point, once, although it may share many buckets: it is kept in the bucket
    where the later of the two begins."""

    def listed(df: DataFrame, lo: Column, hi: Column, s: str) -> DataFrame:
        df = df.withColumn(f"_lo{s}", lo).withColumn(f"_hi{s}", hi).filter(f"_lo{s} <= _hi{s}")
        return df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"_lo{s}") / width), F.floor(F.col(f"_hi{s}") / width))))

    both = listed(a, a_lo, a_hi, "a").join(listed(b, b_lo, b_hi, "b"), [*keys, "_bucket"])
    first = F.col("_bucket") == F.floor(F.greatest("_loa", "_lob") / width)
    return both.filter(first & (F.col("_loa") <= F.col("_hib")) & (F.col("_lob") <= F.col("_hia"))).drop("_loa", "_hia", "_lob", "_hib", "_bucket")


def _swept(points: DataFrame, counts: Sequence[str], ranges: DataFrame, lo: Column, hi: Column, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ranges with their ends ``_lo`` and ``_hi``, and in slices all points (keys, _x, counts), ``_side`` 1, with the ends of
    the different ranges: beginnings sort in front of the points they equal (0), ends behind them (2)."""
    r = ranges.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi")
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("_side"), F.col(c).alias("_x")) for s, c in ((0, "_lo"), (2, "_hi"))]))
    marks = r.select(*keys, "_lo", "_hi").distinct().select(*keys, "_lo", "_hi", ends.alias("_e")).select(*keys, "_lo", "_hi", "_e.*")
    rows = points.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    return r, slices(rows.select(*keys, "_x", "_side", *counts, "_lo", "_hi"), keys, ["_x", "_side"])


def range_summary(points: DataFrame, at: Column, ranges: DataFrame, lo: Column, hi: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Every range that holds a point, both ends included, with how many it holds (``n``), the least and the greatest.

    What :func:`point_in_range` and a grouping by range would give, without the pairs: different points and ends are sorted
    together once, and a range's count is what was counted at its end less what was at its start. ``at`` is a number.
    """
    p = points.select(*keys, at.alias("_x")).filter("_x IS NOT NULL").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    r, rows = _swept(p, ["_n"], ranges, lo, hi, keys)
    here = F.when(F.col("_side") == 1, F.col("_x"))
    rows = running(rows, keys, ["_x", "_side"], F.col("_n"), "_count")
    rows = running(rows, keys, ["_x", "_side"], here, "_last", "max")
    back = rows.withColumn("_back", -F.col("_slice"))
    rows = running(back, keys, [F.desc("_x"), F.desc("_side")], F.when(~F.isnan("_x"), -here), "_next", "max", slice_by="_back")  # NaN is the greatest with either sign
    start, end = F.col("_side") == 0, F.col("_side") == 2
    n = F.max(F.when(end, F.col("_count"))) - F.max(F.when(start, F.col("_count")))
    greatest = F.max(F.when(end, F.col("_last")))
    found = rows.filter("_side <> 1").groupBy(*keys, "_lo", "_hi").agg(n.alias("n"), F.coalesce(F.max(F.when(start, -F.col("_next"))), greatest).alias("least"), greatest.alias("greatest"))
    return r.join(found.filter("n > 0"), [*keys, "_lo", "_hi"]).drop("_lo", "_hi")


def overlap_counts(a: DataFrame, a_lo: Column, a_hi: Column, b: DataFrame, b_lo: Column, b_hi: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Every range of ``b`` that shares a point with one of ``a``, with how many of these there are (``n``).

    What :func:`range_overlap` and a grouping by the ranges of ``b`` would give, without the pairs: of the ranges that begin
    by the end of ``b`` those don't count that end before its start.
    """
    own = a.withColumn("_l", a_lo).withColumn("_h", a_hi).filter("_l <= _h")
    ends = F.explode(F.array(*[F.struct(F.col(c).alias("_x"), F.lit(x).alias("_begun"), F.lit(1 - x).alias("_ended")) for c, x in (("_l", 1), ("_h", 0))]))
    p = own.select(*keys, ends.alias("_e")).select(*keys, "_e.*").groupBy(*keys, "_x").agg(F.sum("_begun").alias("_begun"), F.sum("_ended").alias("_ended"))
    r, rows = _swept(p, ["_begun", "_ended"], b, b_lo, b_hi, keys)
    rows = running(running(rows, keys, ["_x", "_side"], F.col("_begun"), "_b"), keys, ["_x", "_side"], F.col("_ended"), "_e")
    n = F.max(F.when(F.col("_side") == 2, F.col("_b"))) - F.max(F.when(F.col("_side") == 0, F.col("_e")))
    found = rows.filter("_side <> 1").groupBy(*keys, "_lo", "_hi").agg(n.alias("n"))
    return r.join(found.filter("n > 0"), [*keys, "_lo", "_hi"]).drop("_lo", "_hi")


def near(a: DataFrame, a_at: Column, b: DataFrame, b_at: Column, tolerance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Every pair whose values lie within ``tolerance``; one side is listed in its bucket and both neighbours."""
    left = a.withColumn("_a", a_at).filter("_a IS NOT NULL").withColumn("_bucket", F.floor(F.col("_a") / tolerance))
    right = b.withColumn("_b", b_at).filter("_b IS NOT NULL")
    at = F.floor(F.col("_b") / tolerance)
    right = right.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    return left.join(right, [*keys, "_bucket"]).filter(F.abs(F.col("_a") - F.col("_b")) <= tolerance).drop("_a", "_b", "_bucket")


def left_replace(df: DataFrame, column: str, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """``column`` replaced by ``value`` where ``lookup`` has it as ``key``, which should be unique there."""
    found = lookup.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return df.join(found, F.col(column) == F.col("_k"), "left").withColumn(column, F.coalesce("_v", column)).drop("_k", "_v")


def shared_clusters(df: DataFrame, cluster: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Clusters with rows of both kinds, and how many of each; one aggregation instead of two joined ones."""
    return df.groupBy(*cluster).agg(F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second")).filter("n_first > 0 AND n_second > 0")


def exact_else_cluster(df: DataFrame, at: str, lookup: DataFrame, key: str, value: str, mask: int) -> DataFrame:
    """``value`` of the exact key, else of the least key in the same cluster (``mask`` clears the low bits)."""
    exact = lookup.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_exact"))
    cluster = lookup.groupBy(F.col(key).bitwiseAND(F.lit(mask)).alias("_c")).agg(F.min_by(value, key).alias("_near"))
    out = df.join(exact, F.col(at) == F.col("_k"), "left").join(cluster, F.col(at).bitwiseAND(F.lit(mask)) == F.col("_c"), "left")
    return out.withColumn(value, F.coalesce("_exact", "_near")).withColumn("match", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "cluster").otherwise("none")).drop("_k", "_c", "_exact", "_near")


def token_hits(a: DataFrame, a_id: str, a_tokens: Column, b: DataFrame, b_id: str, b_tokens: Column, k: int = 3) -> DataFrame:
    """For each row of ``a`` the ``k`` rows of ``b`` that share most different tokens: (a_id, b_id, shared, place)."""
    left = a.select(F.col(a_id), F.explode(F.array_distinct(a_tokens)).alias("_t"))
    right = b.select(F.col(b_id), F.explode(F.array_distinct(b_tokens)).alias("_t"))
    hits = left.join(right, "_t").groupBy(a_id, b_id).agg(F.count("*").alias("shared"))
    w = Window.partitionBy(a_id).orderBy(F.desc("shared"), b_id)
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def override(base: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """All rows of ``external``, and those of ``base`` whose key it lacks, with ``origin``."""
    rest = base.join(external.select(key), key, "left_anti").withColumn("origin", F.lit("base"))
    return external.withColumn("origin", F.lit("external")).unionByName(rest, allowMissingColumns=True)


def members(df: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` some row of ``others`` has as ``key``."""
    return df.join(others.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_semi")


def strangers(df: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` no row of ``others`` has as ``key``; a null is nobody's key."""
    return df.join(others.select(F.col(key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
