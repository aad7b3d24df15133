"""Memory objects out of accesses: address clusters as vertices, producer and consumer contexts as edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.firmware import cluster, hex_address
from siltstone.operators.ranking import islands



def sram_objects(accesses: DataFrame, symbols: DataFrame, bits: int = 8, sites: int | None = None) -> DataFrame:
    """A row per binary and cluster of SRAM that is accessed or has a symbol.

    ``accesses``: binary_id, seq, target_addr, kind, function_name, in_isr. ``symbols``: binary_id, symbol, address.
    An object's range is its cluster. Contexts and functions are sets; sites are all of them, or the first ``sites`` of
    each kind by seq, cut before the aggregation gathers them.
    """
    sram = lambda c: F.col(c).between(0x20000000, 0x3FFFFFFF)
    a = accesses.filter(sram("target_addr")).withColumn("cluster", cluster(F.col("target_addr"), bits)).withColumn("context", F.when(F.col("in_isr"), "ISR").otherwise("MAIN"))
    store, load = F.col("kind") == "store", F.col("kind") == "load"
    site = F.struct("seq", "function_name", "context", "target_addr")
    if sites is not None:
        a = a.withColumn("_at", F.row_number().over(Window.partitionBy("binary_id", "cluster", "kind").orderBy("seq")))
        site = F.when(F.col("_at") <= sites, site)
    uses = a.groupBy("binary_id", "cluster").agg(
        F.array_sort(F.collect_set(F.when(store, F.col("context")))).alias("producer_contexts"),
        F.array_sort(F.collect_set(F.when(load, F.col("context")))).alias("consumer_contexts"),
        F.array_sort(F.collect_list(F.when(store, site))).alias("writer_sites"),
        F.array_sort(F.collect_list(F.when(load, site))).alias("reader_sites"),
        F.countDistinct(F.when(store, F.col("function_name"))).alias("writers"),
        F.countDistinct(F.when(load, F.col("function_name"))).alias("readers"),
    )
    names = symbols.filter(sram("address")).groupBy("binary_id", cluster(F.col("address"), bits).alias("cluster")).agg(F.array_sort(F.collect_set("symbol")).alias("members"))
    both = uses.join(names, ["binary_id", "cluster"], "full_outer")
    ident = F.concat(F.lit("obj_sram_"), F.substring(hex_address(F.col("cluster")), 3, 8))
    return both.select("binary_id", ident.alias("object_id"), F.col("cluster").alias("addr_lo"), (F.col("cluster") + (1 << bits) - 1).alias("addr_hi"), *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("producer_contexts", "consumer_contexts", "writer_sites", "reader_sites", "members")], F.coalesce("writers", F.lit(0)).alias("writers"), F.coalesce("readers", F.lit(0)).alias("readers"))


def context_edges(objects: DataFrame, quality: Column, k: int) -> DataFrame:
    """The ``k`` best edges per object from a producer to another consumer context through it.

    Contexts of one object are a handful of fixed names, so exploding both lists is bounded.
    """
    rows = objects.withColumn("score", quality).select("binary_id", "object_id", "score", F.explode("producer_contexts").alias("src_context"), "consumer_contexts").select("binary_id", "object_id", "score", "src_context", F.explode("consumer_contexts").alias("dst_context")).filter("src_context <> dst_context")
    w = Window.partitionBy("binary_id", "object_id").orderBy(F.desc("score"), "src_context", "dst_context")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def covered_slices(accesses: DataFrame, keys: Sequence[str], lo: Column, hi: Column, gap: int = 0x20) -> DataFrame:
    """Islands of accessed bytes and, per key, which share of the whole extent they cover."""
    found = islands(accesses, keys, lo, hi, F.lit(gap))
    whole = found.groupBy(*keys).agg((F.sum(F.col("hi") - F.col("lo") + 1) / (F.max("hi") - F.min("lo") + 1)).alias("coverage"))
    return found.join(whole, list(keys))


def split_by_members(objects: DataFrame, is_control: Column) -> DataFrame:
    """Objects with both control and payload members become two rows, ``_ctrl`` and ``_data``; the others stay.

    ``is_control`` is a boolean column over ``m``, a member's name.
    """
    marked = objects.select("binary_id", "object_id", F.explode_outer("members").alias("m")).withColumn("_c", is_control)
    parts = marked.groupBy("binary_id", "object_id").agg(F.sort_array(F.collect_set(F.when(F.col("_c"), F.col("m")))).alias("_ctrl"), F.sort_array(F.collect_set(F.when(~F.col("_c"), F.col("m")))).alias("_data"))
    both = objects.join(parts, ["binary_id", "object_id"])
    two = (F.size("_ctrl") > 0) & (F.size("_data") > 0)
    pieces = F.when(two, F.array(F.struct(F.lit("_ctrl").alias("s"), F.col("_ctrl").alias("m")), F.struct(F.lit("_data").alias("s"), F.col("_data").alias("m")))).otherwise(F.array(F.struct(F.lit("").alias("s"), F.col("members").alias("m"))))
    out = both.withColumn("_p", F.explode(pieces))
    return out.select("binary_id", F.concat("object_id", "_p.s").alias("object_id"), F.col("_p.m").alias("members"), *[c for c in objects.columns if c not in ("binary_id", "object_id", "members")])


def object_affinity(members_a: Column, members_b: Column, lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """How well two objects agree: half by shared members, half by overlapping ranges; -1 if by neither."""
    shared, least = F.size(F.array_intersect(members_a, members_b)), F.least(F.size(members_a), F.size(members_b))
    share = F.when(least > 0, shared / least).otherwise(F.lit(0.0))
    overlap = F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b) + 1, F.lit(0)) / F.greatest(F.least(hi_a - lo_a, hi_b - lo_b) + 1, F.lit(1))
    total = 0.5 * share + 0.5 * F.coalesce(overlap, F.lit(0.0))
    return F.when(total > 0, total).otherwise(F.lit(-1.0))
