"""Set operations, upserts and cascades: keeping one row per key out of several relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import broadcast_if_small, materialize


def distinct_rows(df: DataFrame) -> DataFrame:
    """Every row once. Only a hash of each row is shuffled; rows whose hash comes more than once, usually few, are
    then compared in full. Equal hashes of unlike rows cost work but lose nothing."""
    keyed = df.withColumn("_row_hash", F.xxhash64(*df.columns))
    again = materialize(keyed.groupBy("_row_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_row_hash"), "again")
    hint = broadcast_if_small(again, 24)
    once = keyed.join(hint, "_row_hash", "left_anti").drop("_row_hash")
    return once.unionByName(keyed.join(hint, "_row_hash", "left_semi").drop("_row_hash").distinct())


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with every non-null value of ``changes`` put over it by ``keys``, and with the rows only ``changes`` has.

    ``keys`` are unique on both sides; a null key part is a key. Columns are those of ``base``.
    """
    b, c = base.alias("b"), changes.alias("c")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    have = set(changes.columns)
    pick = [F.coalesce(f"c.{x}", f"b.{x}").alias(x) if x in have else F.col(f"b.{x}").alias(x) for x in base.columns]
    return b.join(c, on, "full_outer").select(*pick)


def union_of_sets(frames: Sequence[DataFrame], keys: Sequence[str], sets: Sequence[str], greatest: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """One row per key over all ``frames``: array columns united and sorted, numbers at their greatest, flags or-ed."""
    all_rows = frames[0]
    for f in frames[1:]:
        all_rows = all_rows.unionByName(f, allowMissingColumns=True)
    aggs = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(s)))).alias(s) for s in sets]
    aggs += [F.max(g).alias(g) for g in greatest] + [F.coalesce(F.bool_or(g), F.lit(False)).alias(g) for g in flags]
    return all_rows.groupBy(*keys).agg(*aggs)


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All rows of all ``frames`` with the name of theirs in ``tag``. Columns only some have are null elsewhere; a column
    that has unlike types is text."""
    kinds: dict[str, set[str]] = {}
    for f in frames.values():
        for c in f.schema:
            kinds.setdefault(c.name, set()).add(c.dataType.simpleString())
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    parts = [f.select(F.lit(name).alias(tag), *[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in f.columns if c != tag]) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ordered_union(a: Column, b: Column) -> Column:
    """The elements of ``a``, then those of ``b`` that it lacks, each once; null lists are empty."""
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(empty(a), empty(b)))


def drop_shadowed(df: DataFrame, keys: Sequence[str], strong: Column) -> DataFrame:
    """Distinct rows; where a key has strong rows, its others go."""
    rows = df.distinct().withColumn("_strong", F.coalesce(strong, F.lit(False)))
    held = rows.filter("_strong").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return rows.filter("_strong").unionByName(rows.filter("NOT _strong").join(held, same, "left_anti")).drop("_strong")


def first_mode(candidates: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Candidates of the first mode that has any, per key, with ``mode``: a cascade of lookups as one pass.

    All modes are brought together and the least rank per key found by one aggregation, so no mode waits for the one
    before it and a key with very many candidates sends one row per task.
    """
    out = None
    for i, (name, df) in enumerate(candidates):
        part = df.withColumn("mode", F.lit(name)).withColumn("_rank", F.lit(i))
        out = part if out is None else out.unionByName(part)
    least = out.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_rank").alias("_least"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return out.join(least, same & (F.col("_rank") == F.col("_least"))).drop("_rank", "_least", *[f"_k{i}" for i in range(len(keys))])


def prefer(primary: DataFrame, fallback: DataFrame, key: str, fallback_key: str, value: str, df: DataFrame) -> DataFrame:
    """``value`` from ``primary`` by ``key``, else from ``fallback`` by ``fallback_key``; both are unique by key."""
    p = primary.select(F.col(key), F.col(value).alias("_p"))
    q = fallback.select(F.col(fallback_key), F.col(value).alias("_q"))
    return df.join(p, key, "left").join(q, fallback_key, "left").withColumn(value, F.coalesce("_p", "_q")).drop("_p", "_q")


def fill_from_peer(df: DataFrame, key: str, peers: Column, value: str, unknown: str) -> DataFrame:
    """``value`` where it is ``unknown`` or null taken from the first row, by ``key``, that shares a peer id and knows."""
    listed = df.select(key, value, F.explode_outer(peers).alias("_peer"))
    known = listed.filter(F.col(value).isNotNull() & (F.col(value) != unknown) & F.col("_peer").isNotNull()).groupBy("_peer").agg(F.min(F.struct(F.col(key), F.col(value))).alias("_best"))
    open_rows = listed.filter(F.col(value).isNull() | (F.col(value) == unknown)).join(known, "_peer").groupBy(key).agg(F.min("_best").alias("_best"))
    return df.join(open_rows.select(key, F.col(f"_best.{value}").alias("_found")), key, "left").withColumn(value, F.coalesce("_found", value)).drop("_found")


def peer_links(df: DataFrame, key: str, link: str, kind: str) -> DataFrame:
    """Rows (left, right): keys of unlike ``kind`` that share ``link``, in both directions, by one grouping per link.

    A link joins the keys of one kind with those of another; links shared by very many keys make as many rows.
    """
    a = df.select(F.col(key).alias("left"), F.col(link).alias("_l"), F.col(kind).alias("_k")).dropna(subset=["_l"])
    b = df.select(F.col(key).alias("right"), F.col(link).alias("_l"), F.col(kind).alias("_m")).dropna(subset=["_l"])
    return a.join(b, "_l").filter("_k <> _m AND left <> right").select("left", "right").distinct()


def whitelist(values: Column, aliases: dict[str, str], allowed: Sequence[str]) -> Column:
    """Upper case, aliases resolved, unknown ones dropped, each once in order."""
    named = F.transform(values, lambda v: F.coalesce(*[F.when(F.upper(F.trim(v)) == a, F.lit(b)) for a, b in aliases.items()], F.upper(F.trim(v))))
    return F.array_distinct(F.filter(named, lambda v: v.isin(list(allowed))))
