"""Top N items within every group, by descending score bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Shares of the items that lie above each cut between bands; the top bands are small, so most groups fill early.
CUTS = (0.05, 0.2, 0.5)


def top_n(df: DataFrame, group: Sequence[str], item: str, score: str, n: int = 3, cuts: Sequence[float] = CUTS) -> DataFrame:
    """Rows (group, item, score, place): the ``n`` items of highest score per group, ties by item ascending as text.

    ``df`` has one row per group and item. Items are cut into bands at quantiles of the score over all rows (equal
    scores always share a band) and written by band. Bands are then processed from the top: groups already filled
    are anti-joined away, the rest of the band is ranked exactly, and each group takes as many as it still lacks.
    Ranking keeps at most ``n`` rows per group in each task before it shuffles, so neither a crowded group nor a
    mass of equal scores meets in one task. Items whose score is null or NaN, and rows with a null group part or
    item, don't compete; an infinite score does; an empty table gives no row.
    """
    rows = df.select(*group, F.col(item).alias("_item"), F.col(score).cast("double").alias("_score")).filter(F.col("_score").isNotNull() & ~F.isnan("_score")).dropna(subset=[*group, "_item"])
    staged = materialize(rows, "scored")
    bounds = staged.agg(F.percentile_approx("_score", [1 - c for c in cuts], 10_000)).first()[0] or []
    # A band's number is how many cuts lie above the score: 0 is the top band.
    band = reduce(lambda a, b: a + (F.col("_score") < F.lit(float(b))).cast("int"), bounds, F.lit(0))
    banded = materialize(staged.withColumn("_band", band), "bands", ["_band"])
    order = Window.partitionBy(*group).orderBy(F.desc("_score"), "_item")
    done: DataFrame | None = None
    for b in range(len(bounds) + 1):
        part = banded.filter(F.col("_band") == b).drop("_band")
        if done is None:
            ranked = part.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
        else:
            have = done.groupBy(*group).agg(F.count("*").cast("int").alias("_have"))
            part = part.join(have.filter(F.col("_have") >= n), list(group), "left_anti")
            ranked = part.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
            ranked = ranked.join(have, list(group), "left").withColumn("place", F.col("_rank") + F.coalesce("_have", F.lit(0))).filter(F.col("place") <= n).drop("_rank", "_have")
        ranked = materialize(ranked, f"band{b}")
        done = ranked if done is None else done.unionByName(ranked)
    return done.select(*group, F.col("_item").alias(item), F.col("_score").alias(score), F.col("place").cast("int").alias("place"))
