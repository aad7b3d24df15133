"""Filling containers of fixed capacity with items, by bulk-synchronous best fit.

Items and gaps are sorted by size. In a round every item is matched with its successor among the gaps, the smallest
that holds it; items that want the same gap are told apart by their rank; gaps shrink by what they took and the
round repeats until nothing is left. Items of one size are interchangeable, and so are containers with one gap, so
the sweeps run on runs of equal size: (size, how many) against (gap, which containers). There are never more sizes
than the capacity, so this table is small however many items there are. The items themselves stay distributed: they
are ranked within their size, and the rank finds the run and with it the container.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ranking import running_total
from siltstone.session import materialize

#: Items to a slice of one size: the commonest size is ranked by as many tasks as it fills slices.
SLICE = 50_000
BLOCK = 8192
PLAN = "container string, size bigint, rank_from bigint, n bigint, bin_from bigint, per_bin bigint"


def best_fit_runs(sizes: Sequence[int], counts: Sequence[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, rank_from, n, bin_from, per_bin): the items of that size ranked from ``rank_from`` on go, ``per_bin``
    at a time, into the containers from ``bin_from`` on. Sizes are at most the capacity."""
    plan: list[tuple[int, int, int, int, int]] = []
    pending = [[s, 0, c] for s, c in sorted(zip(sizes, counts, strict=True), reverse=True) if s > 0 and c > 0]
    empty = sum(c for s, c in zip(sizes, counts, strict=True) if s == 0)
    gaps: list[tuple[int, int, int]] = []  # gap, first container, how many
    bins = 0
    for item in pending:
        if 2 * item[0] > capacity:  # no two of these fit together
            plan.append((item[0], 0, item[2], bins, 1))
            gaps.append((capacity - item[0], bins, item[2]))
            bins += item[2]
            item[2] = 0
    pending = [x for x in pending if x[2]]
    while pending:
        gaps = sorted((g for g in gaps if g[0] >= pending[-1][0]), reverse=True)
        open_gaps: list[tuple[int, int, int]] = []  # those large enough, the smallest on top
        shrunk: list[tuple[int, int, int]] = []
        at, matched = 0, False
        for item in pending:
            size = item[0]
            while at < len(gaps) and gaps[at][0] >= size:
                open_gaps.append(gaps[at])
                at += 1
            while item[2] and open_gaps:
                gap, first, n = open_gaps.pop()
                fit = gap // size  # items of this size in one such gap
                take = min(n, item[2] // fit)
                if take:
                    per = fit
                else:
                    take, per = 1, item[2]
                plan.append((size, item[1], take * per, first, per))
                item[1] += take * per
                item[2] -= take * per
                shrunk.append((gap - per * size, first, take))
                if n > take:
                    open_gaps.append((gap, first + take, n - take))
                matched = True
        gaps = open_gaps + gaps[at:] + shrunk
        pending = [x for x in pending if x[2]]
        if pending and not matched:
            new = max(1, -(-sum(s * c for s, _, c in pending) // capacity))
            gaps.append((capacity, bins, new))
            bins += new
    if empty:
        plan.append((0, 0, empty, 0, empty))
    return plan


def pack(items: DataFrame, item: str, size: str, capacities: dict[str, int], slices: int = 64) -> DataFrame:
    """Rows (container, capacity, container_id, item, piece_no, piece_from, piece_size): every item's place in containers
    of each of ``capacities`` (name and size; a parameter, not data).

    An item longer than the capacity is cut into full containers of its own and a last piece that is placed like
    any other; shorter ones are never split. Sizes that are null or negative count as 0, and items of size 0 go to
    the first shared container. Rows repeated in full count once; an item without id is placed too; no items, no
    containers. Capacities must be positive. Items of one size are ranked in ``slices`` parts.
    """
    if any(c <= 0 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    base = items.select(F.col(item).alias("_item"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"))
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities.items()])
    each = base.select("_item", "_size", F.explode(kinds).alias("k")).select("_item", "_size", "k.*").withColumn("_full", F.expr("_size div capacity"))
    rest = F.expr("_size % capacity")
    whole = each.filter("_full > 0").select("container", "capacity", "_item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece_no"))
    whole = whole.select("container", "capacity", F.format_string("own-%s-%d", F.coalesce(F.col("_item").cast("string"), F.lit("null")), "piece_no").alias("container_id"), "_item", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("piece_from"), F.col("capacity").alias("piece_size"))

    last = each.filter("_size = 0 OR _size % capacity > 0").select("container", "capacity", "_item", F.col("_full").alias("piece_no"), (F.col("_full") * F.col("capacity")).alias("piece_from"), rest.alias("size"))
    runs = last.groupBy("container", "capacity", "size").agg(F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = best_fit_runs(pdf["size"].tolist(), pdf["n"].tolist(), int(pdf["capacity"].iloc[0]))
        out = pd.DataFrame(rows, columns=["size", "rank_from", "n", "bin_from", "per_bin"], dtype="int64")
        out.insert(0, "container", pdf["container"].iloc[0])
        return out

    placed = runs.groupBy("container").applyInPandas(plan, PLAN)
    first, end = F.expr(f"rank_from div {BLOCK}"), F.expr(f"(rank_from + n - 1) div {BLOCK}")
    placed = placed.withColumn("_block", F.explode(F.sequence(first, end)))
    ranked = running_total(last, ["container", "size"], F.lit(1), ["_item", "piece_no"], F.pmod(F.xxhash64("_item"), F.lit(slices)), "_rank").withColumn("_block", F.expr(f"_rank div {BLOCK}"))
    shared = ranked.join(placed, ["container", "size", "_block"]).filter("_rank >= rank_from AND _rank < rank_from + n")
    bin_no = F.expr("bin_from + (_rank - rank_from) div per_bin")
    shared = shared.select("container", "capacity", F.format_string("shared-%d", bin_no).alias("container_id"), "_item", "piece_no", "piece_from", F.col("size").alias("piece_size"))
    return whole.unionByName(shared).withColumnRenamed("_item", item)


def pack_tokens(counted: DataFrame, capacities: dict[str, int], item: str = "doc_id") -> DataFrame:
    """:func:`pack` over token counts, which are written out since two branches read them."""
    counted = materialize(counted.distinct(), "tokens")
    return pack(counted, item, "n_tokens", capacities, max(64, counted.count() // SLICE))


def pack_violations(packed: DataFrame, counted: DataFrame, capacities: dict[str, int], item: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Rows (container, id, problem) of everything a packing must not do: a container filled beyond its capacity
    (``overfull``), an item not covered by its pieces exactly once (``lost`` or ``covered_twice``), one cut though it fits
    (``cut``), one without any place (``missing``)."""
    full = packed.groupBy("container", "capacity", F.col("container_id").alias("id")).agg(F.sum("piece_size").alias("n")).filter("n > capacity").select("container", "id", F.lit("overfull").alias("problem"))
    ends = packed.groupBy("container", "capacity", item).agg(F.sum("piece_size").alias("n"), F.count("*").alias("pieces"), F.countDistinct("piece_no").alias("numbers"), F.max(F.col("piece_from") + F.col("piece_size")).alias("end"))
    sizes = counted.select(item, F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")).distinct()
    # A row per item and container kind; the kinds are a parameter.
    kinds = F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("bigint").alias("capacity")) for n, c in capacities.items()])
    every = sizes.select(item, "_size", F.explode(kinds).alias("k")).select(item, "_size", "k.*")
    both = every.join(ends, ["container", "capacity", item], "left")
    problem = (
        F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("_size"), "lost").when((F.col("n") > F.col("_size")) | (F.col("pieces") > F.col("numbers")) | (F.col("end") > F.col("_size")), "covered_twice")
        .when((F.col("_size") <= F.col("capacity")) & (F.col("pieces") > 1), "cut")
    )
    return full.unionByName(both.select("container", F.col(item).cast("string").alias("id"), problem.alias("problem")).filter("problem IS NOT NULL"))
