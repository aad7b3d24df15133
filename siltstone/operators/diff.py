"""Differences between two copies of a dataset.

Both copies are reduced to the latest row of each key, put into one tagged frame, range-partitioned on the key (the
union makes the split points shared), sorted within partitions and read once by a two-pointer merge that looks only
at neighbouring rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("only_first", "only_second", "changed")
OUT = "record_key string, field_name string, diff_kind string"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key, that of the greatest ``order``; null ``order`` is earliest, ties go to the greatest values.

    The aggregation combines on the map side, so a key that holds a third of all rows sends one row per task.
    """
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(v) for v in values])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{v}").alias(v) for v in values])


def _merge(fields: Sequence[str], children: bool):
    """The merge of one sorted partition: rows (key, sub, side, field...), the two copies of a key adjacent.

    With ``children`` a ``_sub`` is ``.`` and the child's own key, and names the rows of that child.
    """
    names = ["_key", "_sub", "_side", *fields]

    def changed(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Where a new key, and where a new (key, sub), begins."""
        one = np.ones(1, bool)
        k = pc.not_equal(t["_key"].slice(1), t["_key"].slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        s = pc.not_equal(t["_sub"].slice(1), t["_sub"].slice(0, len(t) - 1)).to_numpy(zero_copy_only=False)
        return np.r_[one, k], np.r_[one, k | s]

    def compare(t: pa.Table) -> pa.Table:
        """All differences among whole keys."""
        new_key, new_sub = changed(t)
        starts = np.flatnonzero(new_key)
        side = t["_side"].to_numpy()
        in_copies = np.bitwise_or.reduceat(1 << side, starts)
        key_no = np.cumsum(new_key) - 1
        subs = np.flatnonzero(new_sub)
        size = np.diff(np.r_[subs, len(t)])
        own = pc.utf8_slice_codeunits(t["_sub"], 1).to_numpy(zero_copy_only=False) if children else None
        both = in_copies[key_no[subs]] == 3
        rows, labels, kinds = [starts[in_copies != 3]], [np.full((in_copies != 3).sum(), "*", object)], [in_copies[in_copies != 3] - 1]
        one_sided = subs[both & (size == 1)]
        rows.append(one_sided)
        labels.append(own[one_sided] if children else np.full(len(one_sided), "*", object))
        kinds.append(side[one_sided].astype(np.int64))
        pair = subs[both & (size == 2)]
        for f in fields:
            a, b = t[f].take(pa.array(pair)), t[f].take(pa.array(pair + 1))
            unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
            at = pair[unlike]
            rows.append(at)
            labels.append(own[at] + f".{f}" if children else np.full(len(at), f, object))
            kinds.append(np.full(len(at), 2))
        at = np.concatenate(rows)
        return pa.table({
            "record_key": t["_key"].take(pa.array(at)).cast(pa.string()),
            "field_name": pa.array(np.concatenate(labels), pa.string()),
            "diff_kind": pa.array(KINDS).take(pa.array(np.concatenate(kinds).astype(np.int64))),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[pa.Table] = []  # the rows of the key that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]).select(names)
            if carry and carry[-1]["_key"][-1].as_py() == t["_key"][0].as_py() == t["_key"][-1].as_py():
                carry.append(t)  # still the same key
                continue
            t = pa.concat_tables([*carry, t]).combine_chunks()
            last = int(np.flatnonzero(changed(t)[0])[-1])
            carry = [t.slice(last)]
            if last:
                yield from compare(t.slice(0, last)).combine_chunks().to_batches()
        if carry:
            yield from compare(pa.concat_tables(carry).combine_chunks()).combine_chunks().to_batches()

    return run


def diff_copies(
    first: DataFrame,
    second: DataFrame,
    key: Column,
    order: str,
    fields: dict[str, tuple[Column, Column]] | None = None,
    children: str | None = None,
    child_key: str = "",
    child_fields: dict[str, Column] | None = None,
    key_columns: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(record_key, field_name, diff_kind)``: every key only one copy has, and every field that differs.

    ``key`` builds the record key from ``key_columns``. ``fields`` names the compared fields and gives the
    normalised value in the first and in the second copy. Alternatively ``children`` names an array of structs that
    is compared as a set keyed by ``child_key``, its ``child_fields`` given as columns over ``_c``; a child in one
    copy only is reported under its own key, a differing child field under ``<own key>.<field>``. Children without
    key are one child whose key is empty.

    Null keys are a key of their own part by part (written as an empty string), null and blank values are equal, a
    row repeated in full counts once, columns not named are ignored whatever they are called, and two empty copies
    give no row. Each (key, field, kind) comes once.
    """
    fields = fields or {}
    child_fields = child_fields or {}

    def side(df: DataFrame, no: int) -> DataFrame:
        if children is None:
            t = df.select(key.alias("_key"), F.col(order).alias("_order"), *[both[no].alias(n) for n, both in fields.items()])
            t = latest_per_key(t, ["_key"], "_order", list(fields))
            return t.select("_key", F.lit("").alias("_sub"), F.lit(no).alias("_side"), *[_null_blank(F.col(n)).alias(n) for n in fields])
        t = latest_per_key(df.select(key.alias("_key"), F.col(order).alias("_order"), F.col(children).alias("_list")), ["_key"], "_order", ["_list"])
        record = F.struct(F.lit("").alias("_sub"), *[F.lit(None).cast("string").alias(n) for n in child_fields])
        kept = F.filter("_list", lambda c: c.isNotNull())
        inner = F.array_distinct(F.transform(kept, lambda c: F.struct(F.concat(F.lit("."), F.coalesce(c[child_key], F.lit(""))).alias("_sub"), *[_null_blank(f(c)).alias(n) for n, f in child_fields.items()])))
        # Equal child keys with unlike values: the least counts, so that order and repetition mean nothing.
        ordered = F.array_sort(inner)
        inner = F.filter(ordered, lambda c, i: (i == 0) | (F.get(ordered, i - 1)["_sub"] != c["_sub"]))
        rows = F.concat(F.array(record), F.coalesce(inner, F.array().cast(f"array<struct<_sub:string,{','.join(f'`{n}`:string' for n in child_fields)}>>")))
        t = t.select("_key", F.posexplode(rows).alias("_no", "_r")).select("_key", "_r.*", F.lit(no).alias("_side"))
        return t.select("_key", "_sub", "_side", *child_fields)

    tagged = side(first, 0).unionByName(side(second, 1))
    names = list(child_fields if children else fields)
    ordered = tagged.repartitionByRange("_key").sortWithinPartitions("_key", "_sub", "_side", *names)
    return ordered.mapInArrow(_merge(names, children is not None), OUT)


def _null_blank(c: Column) -> Column:
    c = c.cast("string")
    return F.when(F.trim(c) != "", c)
