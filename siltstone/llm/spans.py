"""Long exact spans shared between records.

Every window of 200 code points has an anchor: the least hash among its shorter grams, which depends on the window's
content only, so equal windows have equal anchors, and neighbours mostly share theirs. A run is a stretch of
neighbouring windows with one anchor. A first pass counts anchors in count-min sketches, one per task, and merges
them. An estimate is never too low, so a window repeated in another document always keeps an estimate of two or more.
A second pass sends on only the runs so estimated and groups them exactly; windows are looked at one by one only where
a shared stretch can begin.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import broadcast_if_small, materialize

_BASE = 0x100000001B3
_CHUNK = 2_000_000
FAN_IN = 32
SALTS = 8
#: Counters per expected anchor and row: one anchor in a hundred is then taken for repeated by chance.
COUNTERS = 4
#: Up to this size the merged sketch is broadcast; a larger one stays cut by hash and meets the runs there.
BROADCAST = 96 << 20


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch in ``segments``, each of ``rows`` times 2**``width_log2`` counters that stop at 2.

    A hash gives an anchor its segment, further ones its counters in it, so that a segment answers for its anchors
    alone. Merged, a counter is the one bit "two or more".
    """

    segments: int
    width_log2: int
    rows: int = 3

    @property
    def size(self) -> int:
        """Counters of a segment."""
        return self.rows << self.width_log2

    @property
    def merged_bytes(self) -> int:
        return self.segments * self.size // 8


def sketch_for(docs: DataFrame, span: int, counters: int = COUNTERS) -> Sketch:
    """A sketch sized by the windows of ``docs`` (id, text), so that its share of chance hits is the same at any size.
    Of ``k`` neighbouring grams one in (k + 1) / 2 is the least of some window, each text has one at least."""
    many, texts = docs.agg(F.sum(F.greatest(F.char_length("text") - span + 1, F.lit(0)).cast("bigint")), F.count("*")).first()
    grams = span - (span + 1) // 2 + 1
    need = max(1, (2 * (many or 0) // (grams + 1) + texts) * counters)
    width = min(24, max(18, (need // 4096).bit_length()))
    return Sketch(-(-need // (1 << width)), width)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hash(points: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of each run of ``k`` code points, put together from runs of powers of two."""
    out, off, run, length = None, 0, points, 1
    while True:
        if k & length:
            part = run[off:]
            out = part if out is None else out[: len(part)] * np.uint64(pow(_BASE, length, 1 << 64)) + part
            off += length
        if length * 2 > k:
            break
        run = run[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + run[length:]
        length *= 2
    return out[: len(points) - k + 1]


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    length = 1
    m = a
    while length * 2 <= w:
        m = np.minimum(m[:-length], m[length:])
        length *= 2
    return m if length == w else np.minimum(m[: len(a) - w + 1], m[w - length : w - length + len(a) - w + 1])


def _laid_out(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts end to end; of the windows within one text: its number, place, and start."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    many = np.maximum(lengths - span + 1, 0)
    text_no = np.repeat(np.arange(len(texts)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return points, text_no, place, starts[text_no] + place


def _hashes(points: np.ndarray, span: int, anchors: bool, whole: bool) -> tuple[np.ndarray | None, np.ndarray | None]:
    """By start: the anchor and the hash of each window, also of those across texts, which nobody asks for."""
    with np.errstate(over="ignore"):
        mixed = _mix(points.astype(np.uint64), 0x9E3779B97F4A7C15)
        gram = (span + 1) // 2
        least = _sliding_min(_mix(_gram_hash(mixed, gram), 7), span - gram + 1) if anchors else None
        return least, _mix(_gram_hash(mixed, span), 11) if whole else None


def _run_starts(text_no: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text_no[1:] != text_no[:-1])]) if len(anchor) else np.zeros(0, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of at least ``span`` code points, about ``_CHUNK`` code points at a time."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            if t is None or len(t) < span:
                continue
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= _CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _counters(anchor: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, list[np.ndarray]]:
    """The segment of each anchor and its counter in every row of that segment."""
    with np.errstate(over="ignore"):
        segment = (_mix(anchor, 0x2545F491) % np.uint64(sketch.segments)).astype(np.int64)
        own = [(_mix(anchor, 0x51ED270B * (r + 1)) >> np.uint64(64 - sketch.width_log2)).astype(np.int64) for r in range(sketch.rows)]
    return segment, [c + (r << sketch.width_log2) for r, c in enumerate(own)]


def _pack(places: np.ndarray) -> bytes:
    return zlib.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes(), 1)


def _places(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), np.uint32), dtype=np.int64)


_PARTIAL = pa.schema([("segment", pa.int32()), ("salt", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_PARTIAL_SQL = "segment int, salt int, once binary, more binary"


def repeated_anchors(docs: DataFrame, span: int, sketch: Sketch) -> DataFrame:
    """Rows (segment, more): the merged sketch of all anchors, per segment the counters that reached 2.

    Each task counts the different anchors of each of its texts and sends, by segment, the counters it touched;
    segments are merged in two steps by streams that hold one segment's counters at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % FAN_IN
        got: list[np.ndarray] = []
        held = 0

        def partial() -> Iterator[pa.RecordBatch]:
            place, n = np.unique(np.concatenate(got), return_counts=True)
            got.clear()
            segment = place // sketch.size
            cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            ends = np.r_[cuts[1:], len(place)]
            for k in range(0, len(cuts), 512):
                rows = []
                for lo, hi in zip(cuts[k : k + 512], ends[k : k + 512], strict=True):
                    p, c = place[lo:hi] - segment[lo] * sketch.size, n[lo:hi]
                    rows.append((int(segment[lo]), salt, _pack(p[c == 1]), _pack(p[c > 1])))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PARTIAL, strict=True)], schema=_PARTIAL)

        for _, texts in _chunks(batches, span):
            points, text_no, _, at = _laid_out(texts, span)
            anchor = _hashes(points, span, True, False)[0][at]
            first = _run_starts(text_no, anchor)
            a, t = anchor[first], text_no[first]
            order = np.lexsort((t, a))
            a, t = a[order], t[order]
            a = a[np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])]]  # once per text
            segment, own = _counters(a, sketch)
            got += [segment * sketch.size + c for c in own]
            held += len(a)
            if held >= 8 * _CHUNK:
                yield from partial()
                held = 0
        if got:
            yield from partial()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, counter = None, np.zeros(sketch.size, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([0], pa.int32()), pa.array([_pack(np.flatnonzero(counter == 1))]), pa.array([_pack(np.flatnonzero(counter > 1))])], schema=_PARTIAL)

        for b in batches:
            for s, once, more in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if s != segment:
                    if segment is not None:
                        yield done()
                    segment = s
                    counter[:] = 0
                counter[_places(once.as_py())] += 1
                counter[_places(more.as_py())] = 2
                np.minimum(counter, 2, out=counter)
        if segment is not None:
            yield done()

    partial = docs.mapInArrow(count, _PARTIAL_SQL)
    partial = partial.repartition("segment", "salt").sortWithinPartitions("segment").mapInArrow(merge, _PARTIAL_SQL)
    merged = partial.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, _PARTIAL_SQL)
    return materialize(merged.select("segment", "more"), "sketch")


_RUN = "anchor bigint, id bigint, s0 int, s1 int, before bigint, content bigint"


def _runs(docs: DataFrame, span: int, sketch: Sketch, every_place: bool, keep, with_segment: bool) -> DataFrame:
    """Rows (anchor, id, s0, s1, before, content): the runs of all texts whose anchor ``keep`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, span):
            points, text_no, place, at = _laid_out(texts, span)
            least, full = _hashes(points, span, True, True)
            anchor = least[at]
            first = _run_starts(text_no, anchor)
            last = np.r_[first[1:], len(anchor)] - 1
            if keep is not None:
                taken = keep(anchor[first])
                first, last = first[taken], last[taken]
            s0, s1 = place[first], place[last]
            before = np.where(s0 > 0, full[np.maximum(at[first] - 1, 0)], np.uint64(0))
            with np.errstate(over="ignore"):
                content = _mix(full[at[first]] * np.uint64(3) + full[at[last]] * np.uint64(5), 13) + (s1 - s0).astype(np.uint64)
            # Both ends and the length tell a run's content only while its ends overlap.
            long = s1 - s0 >= span
            content[long] = _mix(content[long] + np.array(ids, np.int64)[text_no[first]][long].view(np.uint64) * np.uint64(_BASE) + s0[long].astype(np.uint64), 17)
            columns = {"anchor": anchor[first].view(np.int64), "id": np.array(ids, np.int64)[text_no[first]], "s0": s0.astype(np.int32), "s1": s1.astype(np.int32), "before": before.view(np.int64), "content": content.view(np.int64)}
            if with_segment:
                columns["segment"] = _counters(anchor[first], sketch)[0].astype(np.int32)
            out = pa.table(columns)
            if out.num_rows and not every_place:
                order = np.lexsort((s0, content, before, anchor[first], text_no[first]))
                t, k, p = text_no[first][order], content[order], before[order]
                once = order[np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])]]
                out = out.take(pa.array(np.sort(once)))
            yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, _RUN + (", segment int" if with_segment else ""))


def repeated_runs(docs: DataFrame, span: int, sketch: Sketch, every_place: bool, broadcast: int = BROADCAST) -> DataFrame:
    """Rows (anchor, id, s0, s1, before, content): the runs whose anchor is estimated repeated.

    The run's windows start from s0 to s1; ``before`` is the hash of the window before the run (0 where it opens its
    text), ``content`` one of all its windows. Without ``every_place`` runs that a text repeats come once. A merged
    sketch of at most ``broadcast`` bytes goes to every worker; of a larger one each segment meets the runs of its
    anchors, salted, so that an anchor of very many texts is several tasks' work.
    """
    merged = repeated_anchors(docs, span, sketch)
    if sketch.merged_bytes <= broadcast:
        bits = np.zeros(sketch.merged_bytes + 8, np.uint8)
        for segment, more in merged.toLocalIterator():  # a row per segment, of the size just checked
            at = _places(more) + segment * sketch.size
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        sent = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

        def keep(anchor: np.ndarray) -> np.ndarray:
            table = np.frombuffer(sent.value, np.uint8)
            segment, own = _counters(anchor, sketch)
            hit = np.ones(len(anchor), bool)
            for c in own:
                b = segment * sketch.size + c
                hit &= (table[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
            return hit

        return _runs(docs, span, sketch, every_place, keep, False)

    runs = _runs(docs, span, sketch, every_place, None, True).withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int"))
    nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _RUN.split(", ")]
    parts = merged.select(*nothing, "segment", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("kind"), "more")
    both = parts.unionByName(runs.withColumn("kind", F.lit(1)).withColumn("more", F.lit(None).cast("binary")))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits = None, np.zeros(sketch.size, bool)
        for b in batches:
            segment, salt, kind = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("segment", "salt", "kind"))
            anchor = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (segment[1:] != segment[:-1]) | (salt[1:] != salt[:-1])])
            taken = []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(segment)], strict=True):
                if at != (segment[lo], salt[lo]):
                    at = (segment[lo], salt[lo])
                    bits[:] = False
                if kind[lo] == 0:
                    bits[_places(b.column(b.schema.get_field_index("more"))[lo].as_py())] = True
                    lo += 1
                if lo < hi:
                    hit = np.ones(hi - lo, bool)
                    for c in _counters(anchor[lo:hi], sketch)[1]:
                        hit &= bits[c]
                    taken.append(lo + np.flatnonzero(hit))
            if taken:
                yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays(b.columns[:6], names=b.schema.names[:6]).take(pa.array(np.concatenate(taken))))

    cut = both.select(*[c.split()[0] for c in _RUN.split(", ")], "segment", "salt", "kind", "more").repartition("segment", "salt").sortWithinPartitions("segment", "salt", "kind")
    return cut.mapInArrow(sift, _RUN)


def run_pieces(docs: DataFrame, runs: DataFrame, span: int) -> DataFrame:
    """Rows (id, s0, lead, piece): the text that the windows of ``runs`` (id, s0, s1) cover, and the code point before it
    (-1 at the text's start). The only join with the texts; the list of runs is broadcast while it is small."""
    listed = materialize(runs.groupBy("id").agg(F.collect_set(F.struct("s0", "s1")).alias("runs"), F.count("*").alias("n")), "runs")
    row_bytes = 48 + 8 * (listed.agg(F.avg("n")).first()[0] or 0)
    joined = docs.join(broadcast_if_small(listed, int(row_bytes)), "id").select("id", "text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["id", "s0", "lead", "piece"])

        for b in batches:
            for i, text, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                t = text.as_py()
                for r in own.as_py():
                    piece = t[r["s0"] : r["s1"] + span]
                    if len(piece) < span:  # of another text with this id
                        continue
                    rows.append((i, r["s0"], ord(t[r["s0"] - 1]) if r["s0"] else -1, piece))
                    size += len(piece)
                    if size >= _CHUNK:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return joined.mapInArrow(cut, "id bigint, s0 int, lead int, piece string")


def piece_windows(pieces: DataFrame, span: int, every_place: bool) -> DataFrame:
    """Rows (h, id, place, before, s0) of the windows in pieces: hash, place in the text and the code point before (-1 at
    the text's start). Without ``every_place`` one row per text, window and code point before it in each batch."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, offset, lead = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            texts = b.column(3).to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(_CHUNK, int(sizes[-1]), _CHUNK)), len(texts)]) if texts else []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield from _piece_rows(ids[i:j], texts[i:j], lead[i:j], offset[i:j], span, every_place)

    return pieces.select("id", "s0", "lead", "piece").mapInArrow(expand, "h bigint, id bigint, place int, before int, s0 int")


def _piece_rows(ids: np.ndarray, pieces: list[str], lead: np.ndarray, offset: np.ndarray, span: int, every_place: bool) -> Iterator[pa.RecordBatch]:
    points, no, place, at = _laid_out(pieces, span)
    full = _hashes(points, span, False, True)[1][at]
    before = np.where(place > 0, points[np.maximum(at - 1, 0)].astype(np.int64), lead[no])
    own, start = ids[no], offset[no]
    where = place + start
    if not every_place:
        order = np.lexsort((where, before, full, own))
        t, f, p = own[order], full[order], before[order]
        once = order[np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (p[1:] != p[:-1])]] if len(order) else order
        own, full, where, before, start = own[once], full[once], where[once], before[once], start[once]
    for i in range(0, len(full), 200_000):
        c = slice(i, i + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(full[c].view(np.int64)), pa.array(own[c]), pa.array(where[c].astype(np.int32)), pa.array(before[c].astype(np.int32)), pa.array(start[c].astype(np.int32))], ["h", "id", "place", "before", "s0"])


def text_classes(docs: DataFrame, item: str, text: str, span: int) -> DataFrame:
    """Rows (id, class_id): texts of at least ``span`` code points by exact content, named by their least id."""
    ids = docs.select(F.col(item).cast("bigint").alias("id"), F.sha2(text, 256).alias("_sha"), F.col(text).alias("_text")).filter(F.char_length("_text") >= span).dropna(subset=["id"]).select("id", "_sha").distinct()
    ids = materialize(ids, "texts")
    least = ids.groupBy("_sha").agg(F.min("id").alias("class_id"))
    return ids.join(least, "_sha").select("id", "class_id")


def _representatives(docs: DataFrame, classes: DataFrame, item: str, text: str, span: int) -> DataFrame:
    """One text per class. The ids of the others are broadcast while they are few; the texts then aren't shuffled."""
    spare = broadcast_if_small(materialize(classes.filter("id <> class_id").select("id").distinct(), "spare"), 16)
    texts = docs.select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull() & (F.char_length("text") >= span))
    return texts.join(spare, "id", "left_anti")


def class_pairs(docs: DataFrame, classes: DataFrame, item: str, text: str, span: int, sketch: Sketch | None, broadcast: int) -> DataFrame:
    """Rows (ca, cb): classes of exact copies whose texts share a long span, each pair in one direction only."""
    reps = _representatives(docs, classes, item, text, span)
    runs = materialize(repeated_runs(reps, span, sketch or sketch_for(reps, span), False, broadcast), "repeated")
    opening = runs.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("before").alias("p"), F.max("before").alias("q"), F.min("s0").alias("s")).filter("a <> b AND (p <> q OR s = 0)").select("anchor")
    pieces = materialize(run_pieces(reps, runs.join(opening, "anchor", "left_semi"), span), "pieces")
    windows = materialize(piece_windows(pieces, span, False), "windows")
    starts = windows.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("before").alias("p"), F.max("before").alias("q")).filter("a <> b AND (p <> q OR p = -1)").select("h")
    found = windows.join(starts, "h", "left_semi").select("id", "s0", "place", "before").distinct()
    exact = found.join(pieces.select("id", "s0", "piece"), ["id", "s0"]).select("id", "before", F.expr(f"substring(piece, place - s0 + 1, {span})").alias("window")).filter(F.char_length("window") == span).distinct()
    exact = materialize(exact.withColumn("h", F.xxhash64("window")), "starts")
    x, y = exact.alias("x"), exact.alias("y")
    unlike = (F.col("x.before") != F.col("y.before")) | (F.col("x.before") == -1)
    return x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.window") == F.col("y.window")) & (F.col("x.id") < F.col("y.id")) & unlike).select(F.col("x.id").alias("ca"), F.col("y.id").alias("cb")).distinct()


def shared_span_pairs(docs: DataFrame, item: str = "doc_id", text: str = "text", span: int = 200, sketch: Sketch | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """Rows (doc_id_a, doc_id_b), a < b: documents that share ``span`` or more consecutive code points.

    Exact copies are one text until the pairs are found. Of a stretch two texts share, only the first window makes
    their pair. That window lies in a run before which the texts differ or one of them starts, so runs whose anchor
    has the same window before it in every text are left to the run before; of the rest the windows are listed, and
    again only those count that occur in two texts with unlike code points before them. What remains is compared by
    its text, not its hash.

    Null texts and those shorter than ``span`` share nothing; documents without id can't be named and give no row;
    repetition within a document is no pair, nor are rows repeated in full; one id with several texts pairs by any of
    them; other columns aren't read. ``sketch`` is sized by the texts unless given. Pairs grow with the square of the
    texts that quote one passage; ``shared_span_classes`` tells the same without them.
    """
    classes = materialize(text_classes(docs, item, text, span), "classes")
    pairs = class_pairs(docs, classes, item, text, span, sketch, broadcast)
    members = classes.select(F.col("class_id").alias("ca"), F.col("id").alias("ia"))
    partners = classes.select(F.col("class_id").alias("cb"), F.col("id").alias("ib"))
    across = pairs.join(members, "ca").join(partners, "cb").select("ia", "ib")
    copied = classes.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class_id").alias("ca"))
    copies = members.join(copied, "ca", "left_semi")
    within = copies.join(partners, F.col("ca") == F.col("cb")).filter("ia < ib").select("ia", "ib")
    both = across.unionByName(within).filter("ia <> ib")
    return both.select(F.least("ia", "ib").alias("doc_id_a"), F.greatest("ia", "ib").alias("doc_id_b")).distinct()


def shared_span_classes(docs: DataFrame, item: str = "doc_id", text: str = "text", span: int = 200, sketch: Sketch | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """Rows (doc_id, class_id, copies, links): of every text of ``span`` or more code points its class of exact copies,
    how many documents are in it, and how many other classes share a long span with it."""
    classes = materialize(text_classes(docs, item, text, span), "classes")
    pairs = class_pairs(docs, classes, item, text, span, sketch, broadcast)
    ends = pairs.select(F.explode(F.array("ca", "cb")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("copies"))
    out = classes.join(sizes, "class_id").join(ends, "class_id", "left")
    return out.select(F.col("id").alias("doc_id"), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(docs: DataFrame, item: str = "doc_id", text: str = "text", span: int = 200, sketch: Sketch | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """Rows (doc_id, class_id, n_chars, shared_chars): how much of each text stands elsewhere too.

    A code point counts if a window of ``span`` around it also occurs in another document; exact copies are shared
    in full. Every document with a text has a row, also those that share nothing; class_id is the least id of its
    exact copies, its own for texts shorter than ``span``. Windows are compared by a 64-bit hash here.
    """
    classes = materialize(text_classes(docs, item, text, span), "classes")
    reps = _representatives(docs, classes, item, text, span)
    runs = materialize(repeated_runs(reps, span, sketch or sketch_for(reps, span), True, broadcast), "repeated")
    two = lambda df, key: df.groupBy(*key).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select(*key)
    # A run that another text repeats as a whole is shared from end to end. Windows are listed for anchors that are
    # repeated and have a run of which that can't be said; for these anchors all runs are needed.
    whole = two(runs, ["anchor", "content"])
    shared_runs = runs.join(whole, ["anchor", "content"], "left_semi").select("id", "s0", "s1")
    loose = runs.join(whole, ["anchor", "content"], "left_anti").select("anchor").distinct()
    partly = runs.join(two(runs, ["anchor"]).join(loose, "anchor", "left_semi"), "anchor", "left_semi")
    windows = materialize(piece_windows(run_pieces(reps, partly, span), span, True), "windows")
    hits = windows.join(two(windows, ["h"]), "h", "left_semi").select("id", F.col("place").alias("s0"), F.col("place").alias("s1"))
    before = Window.partitionBy("id").orderBy("s0", "s1").rowsBetween(Window.unboundedPreceding, -1)
    stretch = shared_runs.unionByName(hits).distinct().withColumn("_end", F.col("s1") + span)
    fresh = F.col("_end") - F.greatest(F.col("s0"), F.coalesce(F.max("_end").over(before), F.lit(0)))
    covered = stretch.withColumn("_fresh", F.greatest(fresh, F.lit(0))).groupBy("id").agg(F.sum("_fresh").alias("covered"))
    copied = classes.groupBy("class_id").agg(F.count("*").alias("_n"))
    by_class = classes.join(copied, "class_id").join(covered.withColumnRenamed("id", "class_id"), "class_id", "left")
    sizes = docs.select(F.col(item).cast("bigint").alias("id"), F.char_length(text).alias("n_chars")).dropna().groupBy("id").agg(F.max("n_chars").alias("n_chars"))
    shared = F.when(F.col("_n") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return sizes.join(by_class, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), "n_chars", shared.cast("bigint").alias("shared_chars"))
