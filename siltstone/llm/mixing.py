"""Mixing sources to target weights.

Each source's tokens form one stream, cut into blocks of fixed length. Output shards draw from a multinomial how many
blocks of each source they hold; the draws number the source's slots, a pseudorandom permutation of the block indices
turns slots into blocks, and the blocks are joined by index. A permutation visits every block once before any is
repeated, so repeats are even and their cap is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import running_total
from siltstone.session import materialize

SLICES = 1024
SHARD_BLOCKS = 1024


@dataclass(frozen=True)
class Target:
    """What share of the mix a source shall have, and how often its blocks may come at most."""

    source: str
    share: float
    max_repeats: int


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``index`` (from 0 to n-1) sent to another place below ``n``; for each ``key`` and ``n`` a bijection.

    A four-round Feistel network over the least even number of bits that holds ``n``; places beyond ``n`` are sent
    on until they fall below it.
    """
    index, n, key = (np.asarray(x, np.uint64).copy() for x in (index, n, key))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(np.float64), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = index[todo] >> half[todo], index[todo] & mask[todo]
            for r in range(4):
                x = (right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03)).astype(np.uint64)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask[todo])
            index[todo] = (left << half[todo]) | right
            todo = todo[index[todo] >= n[todo]]
    return index.astype(np.int64)


def token_blocks(docs: DataFrame, source: str, item: str, size: str, block: int) -> DataFrame:
    """Rows (source, block_no, item, item_from, n): which part of which item lies in which block of its source.

    Items are laid end to end in a fixed order that depends on their ids only; the last block of a source may be
    shorter. A source of a third of all items is laid out in ``SLICES`` parts at once.
    """
    laid = running_total(docs.filter(F.col(size) > 0), [source], F.col(size), [item, size], F.pmod(F.xxhash64(item), F.lit(SLICES)), "_start")
    first, end = F.expr(f"_start div {block}"), F.expr(f"(_start + {size} - 1) div {block}")
    cut = laid.withColumn("block_no", F.explode(F.sequence(first, end)))
    item_from = F.greatest(F.col("block_no") * block - F.col("_start"), F.lit(0))
    till = F.least((F.col("block_no") + 1) * block - F.col("_start"), F.col(size))
    return cut.select(source, "block_no", item, item_from.alias("item_from"), (till - item_from).alias("n"))


def mix(docs: DataFrame, source: str, item: str, size: str, targets: Sequence[Target], block: int = 512, seed: int = 17) -> DataFrame:
    """Rows (shard, slot, source, block_no, repeat_no, item, item_from, n): the mix, block by block.

    The mix is as long as the caps allow: the source whose blocks times ``max_repeats`` is least against its share
    sets the length. Sources without items or targets stay out, and the shares of the others are scaled up to 1
    between them. Draws vary around the shares; where one would exceed a source's cap, the slots beyond it stay
    empty, so the cap holds exactly. Targets are parameters (some sources), never data. Items repeated in full
    count once; null sources and items without size aren't in the mix; if nothing can be mixed there are no rows.
    """
    wanted = {t.source: t for t in targets if t.share > 0 and t.max_repeats > 0}
    own = docs.select(F.col(source).alias("source"), F.col(item).alias(item), F.col(size).alias("_size")).distinct().filter(F.col("source").isin(list(wanted)))
    own = materialize(own, "items")  # read by both branches of the running total
    pieces = materialize(token_blocks(own, "source", item, "_size", block), "blocks")
    # One row per wanted source.
    blocks = {r[0]: r[1] for r in pieces.groupBy("source").agg(F.max("block_no") + 1).collect()}
    total_share = sum(wanted[s].share for s in blocks)
    names = sorted(blocks)
    shares = [wanted[s].share / total_share for s in names]
    total = min((int(blocks[s] * wanted[s].max_repeats / q) for s, q in zip(names, shares, strict=True)), default=0)
    shards = -(-total // SHARD_BLOCKS)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shard in pdf["id"]:
                length = min(SHARD_BLOCKS, total - shard * SHARD_BLOCKS)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(length, shares)
                rows += [(shard, i, int(c), int(b), int(length)) for i, (c, b) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)) if c]
            yield pd.DataFrame(rows, columns=["shard", "source_no", "count", "slot_from", "length"])

    drawn = pieces.sparkSession.range(shards).mapInPandas(draw, "shard bigint, source_no int, count bigint, slot_from bigint, length bigint")
    drawn = running_total(drawn, ["source_no"], F.col("count"), ["shard"], F.expr("shard div 4096"), "_before")
    caps = F.element_at(F.array(*[F.lit(blocks[s]).cast("bigint") for s in names]), F.col("source_no") + 1) if names else F.lit(0)
    most = F.element_at(F.array(*[F.lit(wanted[s].max_repeats).cast("bigint") for s in names]), F.col("source_no") + 1) if names else F.lit(0)
    name = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("source_no") + 1) if names else F.lit("")
    slots = drawn.select("shard", "length", "source_no", name.alias("source"), caps.alias("blocks"), most.alias("most"), "slot_from", "_before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("count") - 1)).alias("k"))
    slots = slots.withColumn("_i", F.col("_before") + F.col("k")).filter(F.col("_i") < F.col("blocks") * F.col("most")).withColumn("repeat_no", F.expr("_i div blocks"))

    @F.pandas_udf("bigint")
    def shuffled(i: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n.to_numpy(), key.to_numpy() + seed))

    slots = slots.select(
        "shard", shuffled(F.col("slot_from") + F.col("k"), "length", F.col("shard") * 2).alias("slot"), "source",
        shuffled(F.expr("_i % blocks"), "blocks", (F.col("repeat_no") * 64 + F.col("source_no")) * 2 + 1).alias("block_no"), "repeat_no",
    )
    return slots.join(pieces, ["source", "block_no"]).select("shard", "slot", "source", "block_no", "repeat_no", item, "item_from", "n")


def mix_shares(mixed: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Rows (source, target_share, actual_share, tokens, most_repeats): what the mix reached, for every target."""
    got = mixed.groupBy("source").agg(F.sum("n").alias("tokens"), (F.max("repeat_no") + 1).alias("most_repeats"))
    want = mixed.sparkSession.createDataFrame([(t.source, float(t.share)) for t in targets], "source string, target_share double")
    both = want.join(got, "source", "left")
    both = both.withColumn("_all", F.sum("tokens").over(Window.partitionBy()))  # as many rows as there are targets
    return both.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


def mix_violations(mixed: DataFrame, sizes: DataFrame, targets: Sequence[Target], item: str, size: str, block: int = 512) -> DataFrame:
    """Rows (source, problem) of everything a mix must not do: a block used more often than its source may be (``capped``),
    a slot that holds two blocks (``slot``), a block longer than ``block`` (``long``), a part beyond its item's end
    (``beyond``), a source without target (``unwanted``)."""
    caps = F.coalesce(*[F.when(F.col("source") == t.source, F.lit(t.max_repeats)) for t in targets], F.lit(0))
    used = mixed.select("shard", "slot", "source", "block_no").distinct()
    say = lambda df, problem: df.select("source", F.lit(problem).alias("problem")).distinct()
    capped = used.groupBy("source", "block_no").count().filter(F.col("count") > caps)
    slots = used.groupBy("shard", "slot").agg(F.count("*").alias("count"), F.min("source").alias("source")).filter("count > 1")
    long = mixed.groupBy("shard", "slot", "source", "block_no").agg(F.sum("n").alias("n")).filter(F.col("n") > block)
    ends = mixed.groupBy("source", item).agg(F.max(F.col("item_from") + F.col("n")).alias("end")).join(sizes.groupBy(item).agg(F.max(size).alias("_size")), item).filter("end > _size")
    return say(capped, "capped").unionByName(say(slots, "slot")).unionByName(say(long, "long")).unionByName(say(ends, "beyond")).unionByName(say(mixed.filter(caps == 0), "unwanted"))
