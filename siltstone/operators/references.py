"""References to records that do not exist.

Keys are encoded as integers, a run of which is a key range. References become compressed bitmaps per key range
and month, parents bitmaps of the months they hold in full, kept by where they begin and how far they reach. Reference
AND-NOT parent leaves the few references that no parent covers for the whole month, those without any parent among
them; their bits are decoded and checked exactly against the parents' times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

FAR = "timestamp_ntz'9999-12-31 00:00:00'"
RANGE_BITS = 15
RANGE = 1 << RANGE_BITS
_NEVER = np.iinfo(np.int32).min
_HELD = 1 << 20
_CONTAINER = "range bigint, period int, kind int, places binary, tills binary"


def encode_keys(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """A dictionary of all keys in ``frames``: the key columns and ``code``, a bigint.

    The keys of each partition are numbered from 0 on, the partition's number in the bits above 33, so that codes lie
    close together and no step sees all keys at once. Written out, since a second run could number otherwise.
    """
    every = frames[0].select(*keys)
    for f in frames[1:]:
        every = every.unionByName(f.select(*keys))
    return materialize(every.distinct().withColumn("code", F.monotonically_increasing_id()), "dictionary")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of many batches at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= _HELD:
            yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]
            held, rows = [], 0
    if rows:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def _packed(low: np.ndarray) -> bytes:
    """A container: different sorted places within a key range, as they are while few, else a bit for every place."""
    if 16 * len(low) < RANGE:
        return low.astype("<u2").tobytes()
    bits = np.zeros(RANGE, bool)
    bits[low] = True
    return np.packbits(bits).tobytes()


def _places(blob: bytes) -> np.ndarray:
    if len(blob) < RANGE // 8:
        return np.frombuffer(blob, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)))


def bitmaps(coded: DataFrame) -> DataFrame:
    """Rows (range, period, kind 1, places, tills null): of ``coded`` (code, period) the set of codes per key range and
    period, as compressed containers, built in each task before anything is shuffled."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, period in _keys(batches):
            order = np.lexsort((code, period, code >> RANGE_BITS))
            code, period = code[order], period[order]
            new = np.r_[True, (code[1:] != code[:-1]) | (period[1:] != period[:-1])]
            code, period = code[new], period[new]
            no = code >> RANGE_BITS
            starts = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (period[1:] != period[:-1])])
            low = code & (RANGE - 1)
            places = [_packed(x) for x in np.split(low, starts[1:])]
            yield from _batches(no[starts], period[starts], 1, places, [None] * len(starts))

    return coded.select("code", "period").mapInArrow(build, _CONTAINER)


def coverage(spans: DataFrame) -> DataFrame:
    """Rows (range, period, kind 0, places, tills): of ``spans`` (code, from, till) the codes whose cover begins in a
    period and how far it reaches, per key range. A span costs one place however long it is."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, begin, till in _keys(batches):
            order = np.lexsort((-till, code, begin, code >> RANGE_BITS))
            code, begin, till = code[order], begin[order], till[order]
            new = np.r_[True, (code[1:] != code[:-1]) | (begin[1:] != begin[:-1])]  # the longest of each begin
            code, begin, till = code[new], begin[new], till[new]
            no = code >> RANGE_BITS
            starts = np.flatnonzero(np.r_[True, (no[1:] != no[:-1]) | (begin[1:] != begin[:-1])])
            low = (code & (RANGE - 1)).astype("<u2")
            places = [x.tobytes() for x in np.split(low, starts[1:])]
            tills = [x.tobytes() for x in np.split(till.astype("<i4"), starts[1:])]
            yield from _batches(no[starts], begin[starts], 0, places, tills)

    return spans.select("code", "from", "till").mapInArrow(build, _CONTAINER)


def _batches(no: np.ndarray, period: np.ndarray, kind: int, places: list[bytes], tills: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(no), 2_000):
        c = slice(i, i + 2_000)
        n = len(no[c])
        yield pa.RecordBatch.from_arrays([pa.array(no[c].astype(np.int64)), pa.array(period[c].astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(places[c], pa.binary()), pa.array(tills[c], pa.binary())], ["range", "period", "kind", "places", "tills"])


def and_not(references: DataFrame, covers: DataFrame) -> DataFrame:
    """Rows (code, period): the decoded bits of reference AND-NOT parent.

    The containers of one key range meet, in the order of their periods. What parents reach is one number per place:
    the parents' bitmap of a period has the places whose number is not before it, so only periods that references
    touch cost anything, and no more than one range's numbers are held at a time.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        reach = np.full(RANGE, _NEVER, np.int32)
        refs = np.zeros(RANGE, bool)
        found: list[tuple[np.ndarray, int]] = []
        n = 0

        def close() -> None:
            nonlocal n
            left = np.flatnonzero(refs & ~(reach >= at[1]))
            if len(left):
                found.append(((at[0] << RANGE_BITS) + left, at[1]))
                n += len(left)
            refs[:] = False

        def out() -> pa.RecordBatch:
            nonlocal n
            codes = np.concatenate([c for c, _ in found])
            periods = np.repeat(np.array([p for _, p in found], np.int32), [len(c) for c, _ in found])
            found.clear()
            n = 0
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(periods)], ["code", "period"])

        touched = False
        for b in batches:
            for no, period, kind, places, tills in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (no, period):
                    if touched:
                        close()
                        touched = False
                    if at is None or at[0] != no:
                        reach[:] = _NEVER
                    at = (no, period)
                if kind:
                    refs[_places(places)] = True
                    touched = True
                else:
                    low = np.frombuffer(places, "<u2")
                    reach[low] = np.maximum(reach[low], np.frombuffer(tills, "<i4"))
                if n >= _HELD:
                    yield out()
        if touched:
            close()
        if found:
            yield out()

    both = references.unionByName(covers).repartition("range").sortWithinPartitions("range", "period", "kind")
    return both.mapInArrow(sweep, "code bigint, period int")


def _month(c: Column | str) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def orphan_references(refs: DataFrame, parents: DataFrame, keys: Sequence[str], at: str, born: str, died: str) -> DataFrame:
    """``refs`` whose key no row of ``parents`` holds at the reference's time, with a ``reason``.

    A parent row holds from ``born`` on until before ``died`` (null: for ever). Reasons: missing (no parent row of
    that key at all), late (all were born after the reference), deleted (else). Rows of ``refs`` repeated in full
    count once; a null key part refers to nothing and gives no row; a parent whose ``born`` is null never holds and
    counts as late; a reference without time gives a row only if no parent has its key, as missing. All columns of
    ``refs`` are kept but one named ``reason``; those of ``parents`` not named here aren't read.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    names = [c for c in refs.columns if c != "reason"]
    rest = [c for c in refs.columns if c not in (*keys, at, "reason")]
    # The caller's columns travel as one struct, so that none can clash with those made here; the keys themselves
    # leave with the dictionary and come back with the few rows found.
    refs = refs.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(at).cast("timestamp_ntz").alias("_at"), F.struct(*rest, F.lit(0).alias("_")).alias("_row")).dropna(subset=own)
    parents = parents.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(born).cast("timestamp_ntz").alias("_born"), F.coalesce(F.col(died).cast("timestamp_ntz"), F.expr(FAR)).alias("_died")).dropna(subset=own)
    dictionary = encode_keys([refs, parents], own)
    coded = materialize(refs.join(dictionary, own).select("code", "_at", F.coalesce(_month("_at"), F.lit(-1)).alias("period"), "_row"), "references")
    held = materialize(parents.join(dictionary, own).select("code", "_born", "_died").distinct(), "parents")

    # Months a parent holds from first to last moment: those after its birth and before its end.
    spans = held.filter("_born IS NOT NULL").select("code", (_month("_born") + 1).alias("from"), (_month("_died") - 1).alias("till")).filter("from <= till")
    open_refs = materialize(and_not(bitmaps(coded), coverage(spans)), "open")
    suspects = coded.join(open_refs, ["code", "period"], "left_semi").distinct()

    # Exact check. A reference holds if the latest end among parents born until then is later. Cut into hours, so that
    # a key with very many rows is spread; what earlier hours hold is carried as one maximum per hour.
    hour = lambda c: F.datediff(c, F.lit("1970-01-01")) * 24 + F.hour(c)
    relevant = held.join(open_refs.select("code").distinct(), "code", "left_semi")
    births = relevant.filter("_born IS NOT NULL").groupBy("code", hour("_born").alias("_hour"), "_born").agg(F.max("_died").alias("_end"))
    times = suspects.filter("_at IS NOT NULL").select("code", hour("_at").alias("_hour"), "_at").distinct()
    moments = births.select("code", "_hour", F.col("_born").alias("_t"), F.lit(0).alias("_kind"), "_end").unionByName(times.select("code", "_hour", F.col("_at").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp_ntz").alias("_end")))
    within = Window.partitionBy("code", "_hour").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    moments = moments.withColumn("_same_hour", F.max("_end").over(within)).filter("_kind = 1")
    hours = births.groupBy("code", "_hour").agg(F.max("_end").alias("_end"))
    hours = hours.unionByName(times.select("code", "_hour", F.lit(None).cast("timestamp_ntz").alias("_end"))).groupBy("code", "_hour").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy("code").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("_earlier", F.max("_end").over(before)).select("code", "_hour", "_earlier")
    verdict = moments.join(hours, ["code", "_hour"]).select("code", F.col("_t").alias("_at"), F.greatest("_same_hour", "_earlier").alias("_latest"))

    known = relevant.groupBy("code").agg(F.min("_born").alias("_first"), F.lit(True).alias("_known"))
    lost = suspects.join(verdict, ["code", "_at"], "left").join(known, "code", "left")
    lost = lost.filter(F.col("_latest").isNull() | (F.col("_latest") <= F.col("_at"))).filter("_at IS NOT NULL OR _known IS NULL")
    reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_first").isNull() | (F.col("_first") > F.col("_at")), "late").otherwise("deleted")
    lost = lost.withColumn("reason", reason).join(dictionary, "code")

    values = {k: F.col(o) for k, o in zip(keys, own, strict=True)} | {at: F.col("_at")} | {c: F.col("_row")[c] for c in rest}
    return lost.select(*[values[k].alias(k) for k in names], "reason")
