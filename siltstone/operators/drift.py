"""Schemas that drift between the files of a feed: tagged-union inference, steady columns and a change report.

Every file's schema is a set of (field, tag, count) rows, a tag being one of text, number, boolean, array, object:
the union of the types seen, none of them dropped. Such schemas are fused by adding counts, so inference is one
aggregation that combines on the map side. Everything after it works on schema rows, not records, except the
comparison of values that tells a rename from a removal beside an addition.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.jsontext import mended, object_of, opens_object
from siltstone.operators.merging import distinct_rows
from siltstone.operators.shred import Shape, shred
from siltstone.session import broadcast_if_small, materialize

TAGS = ("text", "number", "boolean", "array", "object")
RENAME_SHARE = 0.9


def _tag(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (
        F.when(s == "VOID", None).when(s == "STRING", "text").when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")
    )


def records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` without repeated rows and without rows whose ``raw`` isn't a JSON object, parsed into ``_v``.

    Of names that one object repeats, the last counts. Objects that repeat names or are nested deeper than the
    engine's parser goes are put right first, see :func:`siltstone.functions.jsontext.mended`. ``raw`` itself is left
    out; ``refused_rows`` counts what isn't taken.
    """
    found = distinct_rows(df).withColumn("_v", object_of(F.col(raw)))
    # Parsed once and written as variants; only text that the engine's parser refuses is kept beside them.
    found = materialize(found.withColumn(raw, F.when(F.col("_v").isNull() & opens_object(F.col(raw)), F.col(raw))), "records")
    odd = found.filter(F.col("_v").isNull() & F.col(raw).isNotNull()).withColumn("_v", F.try_parse_json(mended(F.col(raw), F.col("_v")))).filter(F.col("_v").isNotNull())
    odd = materialize(odd, "odd")
    good = found.filter(F.col("_v").isNotNull())
    return (good if odd.isEmpty() else good.unionByName(odd)).drop(raw)


def refused_rows(df: DataFrame, by: Sequence[str], raw: str = "raw") -> DataFrame:
    """Rows (by, rows): how many different rows of each file hold no JSON object, those without text included."""
    all_rows = distinct_rows(df).withColumn("_v", object_of(F.col(raw)))
    bad = all_rows.filter(F.col("_v").isNull()).filter(mended(F.col(raw), F.col("_v")).isNull())
    return bad.groupBy(*by).agg(F.count("*").alias("rows"))


def fields_of(recs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row per top-level value: the ``keep`` columns, field, tag (null for a null value), value (a variant).

    A record without any value gives one row whose field is null.
    """
    exploded = recs.select(*keep, "_v").lateralJoin(recs.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()))
    return exploded.select(*keep, F.col("key").alias("field"), _tag(F.col("value")).alias("tag"), F.col("value"))


def infer_union(fields: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fused schema per ``by`` and field: a count per tag, and the tag of most values.

    Equal counts go to the tag named first in ``TAGS``.
    """
    return with_main_tag(_tag_counts(fields.filter("tag IS NOT NULL"), by))


def _tag_counts(fields: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    one = F.lit(1) if weight is None else weight
    return fields.groupBy(*by, "field").agg(*[F.sum(F.when(F.col("tag") == t, one).otherwise(0)).alias(f"n_{t}") for t in TAGS])


def shape_counts(recs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tag counts per ``by`` and field, also of fields without any value. Records shrink to their different shapes
    first, combined on the map side; only one record of each shape is taken apart and counts for all of them."""
    shape = F.regexp_replace(F.schema_of_variant("_v"), r"DECIMAL\([0-9]+,[0-9]+\)", "DOUBLE")
    shapes = recs.groupBy(*by, shape.alias("_shape")).agg(F.count("*").alias("_n"), F.first("_v").alias("_v"))
    fields = fields_of(shapes, [*by, "_n"])
    return _tag_counts(fields, by, F.col("_n"))


def path_counts(df: DataFrame, by: Sequence[str], raw: str = "raw") -> DataFrame:
    """Rows (by, path, tag, n): the non-null values of each type at every path below the record, labels joined by
    ``/``, ``*`` for an element of a list. Rows left out are those that ``records`` leaves out."""
    text = F.when(opens_object(F.col(raw)), F.col(raw))
    own = distinct_rows(df).select(*by, text.alias(raw), F.to_json(F.struct(*by)).alias("_by")).filter(F.col(raw).isNotNull())
    places = own.select("_by", *by).distinct()
    nodes = shred(own, "_by", {raw: Shape()}).filter((F.col("path") != raw) & (F.col("kind") != "null"))
    counts = nodes.groupBy("record_id", F.expr(f"substr(path, {len(raw) + 2})").alias("path"), F.col("kind").alias("tag")).agg(F.count("*").alias("n"))
    return counts.join(places, F.col("record_id") == F.col("_by")).select(*by, "path", "tag", "n")


def appearing_types(df: DataFrame, feed: str = "feed", file: str = "file_no", raw: str = "raw") -> DataFrame:
    """Rows (feed, path, tag, file, n, known): every type of a path beside its first, with the file it begins in, how
    many values it has there, and the types known before it, in the order they came.

    However few its values are. Types that begin in the same file follow each other by number of values, then in the
    order of ``TAGS``; a path is followed under its own name, also where it is renamed.
    """
    counts = path_counts(df, [feed, file], raw)
    begins = counts.groupBy(feed, "path", "tag").agg(F.min(F.struct(file, "n")).alias("b")).select(feed, "path", "tag", "b.*")
    place = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    order = Window.partitionBy(feed, "path").orderBy(file, F.desc("n"), place)
    known = F.array_join(F.collect_list("tag").over(order.rowsBetween(Window.unboundedPreceding, -1)), ",")
    return begins.withColumn("known", known).filter("known <> ''").select(feed, "path", "tag", file, "n", "known")


def with_main_tag(counts: DataFrame) -> DataFrame:
    """Counts per tag with ``main_tag``; without any value it is null."""
    most = F.greatest(*[F.col(f"n_{t}") for t in TAGS])
    main = F.when(most > 0, F.coalesce(*[F.when(F.col(f"n_{t}") == most, F.lit(t)) for t in TAGS]))
    return counts.withColumn("main_tag", main)


def _steps(counts: DataFrame, feed: str, file: str) -> DataFrame:
    """Schema rows with what the feed's files before and after hold: file_at (place of the file in its feed),
    next_file, in_before, in_after, tag_before. ``counts`` also has rows without any value, which make a file known."""
    schema = with_main_tag(counts)
    files = schema.select(feed, file).distinct()
    order = Window.partitionBy(feed).orderBy(file)
    files = files.select(feed, file, F.row_number().over(order).alias("file_at"), F.lead(file).over(order).alias("next_file"))
    own = Window.partitionBy(feed, "field").orderBy("file_at")
    s = schema.filter("main_tag IS NOT NULL").join(files, [feed, file])
    return s.select(
        "*",
        (F.coalesce(F.lag("file_at").over(own), F.lit(-1)) == F.col("file_at") - 1).alias("in_before"),
        (F.coalesce(F.lead("file_at").over(own), F.lit(-1)) == F.col("file_at") + 1).alias("in_after"),
        F.lag("main_tag").over(own).alias("tag_before"),
    )


def _one_to_one(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the possible renames in one file, the best first, each field once. The rows are pairs of field names."""
    pdf = pdf.sort_values(["share", "n", "old_field", "new_field"], ascending=[False, False, True, True])
    old: set[str] = set()
    new: set[str] = set()
    keep = []
    for o, n in zip(pdf["old_field"], pdf["new_field"], strict=True):
        keep.append(o not in old and n not in new)
        if keep[-1]:
            old.add(o)
            new.add(n)
    return pdf[keep]


def id_of(field: str) -> Column:
    """The text of a top-level field of the record ``_v``."""
    return F.try_variant_get("_v", f"$['{field}']", "string")


def schema_changes(df: DataFrame, id_field: str | Column, feed: str = "feed", file: str = "file_no", raw: str = "raw") -> DataFrame:
    """Rows (feed, file, change_kind, old_field, new_field): how each file differs from its feed's file before.

    A file has a field if a record holds a non-null top-level value under exactly that name. A field that went and
    one that came are a rename if, among pairs of records of equal ``id_field`` in the two files that hold both,
    at least nine tenths agree; where several pairings reach that, the best agreement goes first and each field is
    used once. Remaining fields are removed or added. A field in both files whose most frequent type differs is
    type_changed. ``id_field`` is the name of a field or a column over the record ``_v``. A row repeated in full counts once; rows that aren't JSON objects are left out, and a file of
    only such rows isn't there; records without ``id_field`` prove no rename; an empty table gives no row.
    """
    recs = records(df, raw)
    ident = id_of(id_field) if isinstance(id_field, str) else id_field
    # A row per field and file, small beside the records: what follows works on it.
    counts = materialize(shape_counts(recs, [feed, file]), "counts")
    schema = materialize(_steps(counts, feed, file), "schema")
    came = schema.filter(~F.col("in_before") & (F.col("file_at") > 1)).select(feed, F.col(file).alias("at_file"), F.col(file).alias("new_file"), "field", F.lit("came").alias("side"))
    went = schema.filter(~F.col("in_after") & F.col("next_file").isNotNull()).select(feed, F.col(file).alias("at_file"), F.col("next_file").alias("new_file"), "field", F.lit("went").alias("side"))
    typed = schema.filter(F.col("in_before") & (F.col("tag_before") != F.col("main_tag")))

    # Of the records only values of fields that went or came are read again, beside them the id. They are counted
    # before they meet, so that a frequent id costs a row per different value and no pairs.
    moves = materialize(came.unionByName(went), "moves").withColumnRenamed("at_file", file)
    touched = broadcast_if_small(materialize(moves.select(feed, file).distinct(), "touched"), 100)
    fields = fields_of(recs.join(touched, [feed, file], "left_semi").withColumn("_id", ident).filter("_id IS NOT NULL"), [feed, file, "_id"])
    values = fields.filter("tag IS NOT NULL").join(broadcast_if_small(moves, 160), [feed, file, "field"])
    values = materialize(values.groupBy(feed, F.col("new_file").alias(file), "side", "_id", "field", F.to_json("value").alias("value")).count(), "values")
    went, came = (x.select(feed, F.col("new_file").alias(file), "field") for x in (went, came))
    gone, new = (values.filter(F.col("side") == x).drop("side") for x in ("went", "came"))
    gone, new = (x.withColumnsRenamed({"field": f, "count": n}) for x, f, n in ((gone, "old_field", "n_old"), (new, "new_field", "n_new")))
    pair = [feed, file, "old_field", "new_field"]
    agree = gone.join(new, [feed, file, "_id", "value"]).groupBy(*pair).agg(F.sum(F.col("n_old") * F.col("n_new")).alias("agree"))
    per_id = lambda x, f, n: x.groupBy(feed, file, "_id", f).agg(F.sum(n).alias(n))
    both = per_id(gone, "old_field", "n_old").join(per_id(new, "new_field", "n_new"), [feed, file, "_id"]).groupBy(*pair).agg(F.sum(F.col("n_old") * F.col("n_new")).alias("n"))
    likely = agree.join(both, pair).filter(F.col("agree") >= RENAME_SHARE * F.col("n")).select(*pair, (F.col("agree") / F.col("n")).alias("share"), "n")
    # A pair whose two names come in no other pair of its file needs no choice.
    rivals = likely.withColumn("_o", F.count("*").over(Window.partitionBy(feed, file, "old_field"))).withColumn("_n", F.count("*").over(Window.partitionBy(feed, file, "new_field")))
    rivals = materialize(rivals, "likely")
    alone = rivals.filter("_o = 1 AND _n = 1").select(*pair)
    renamed = alone.unionByName(rivals.filter("_o > 1 OR _n > 1").drop("_o", "_n").groupBy(feed, file).applyInPandas(_one_to_one, likely.schema).select(*pair))

    out = lambda x, kind, old, new: x.select(feed, file, F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))
    field, blank = F.col("field"), F.lit("")
    # A field's fate is told by one grouping over the schema rows: those of a rename cancel the other two kinds.
    fate = (
        went.select(feed, file, "field", F.lit("removed").alias("kind"), blank.alias("other"))
        .unionByName(came.select(feed, file, "field", F.lit("added").alias("kind"), blank.alias("other")))
        .unionByName(renamed.select(feed, file, F.col("old_field").alias("field"), F.lit("removed").alias("kind"), F.col("new_field").alias("other")))
        .unionByName(renamed.select(feed, file, F.col("new_field").alias("field"), F.lit("added").alias("kind"), F.lit("\0").alias("other")))
        .groupBy(feed, file, "field", "kind").agg(F.max("other").alias("other"), F.count("*").alias("rows"))
    )
    fate = fate.filter((F.col("kind") == "removed") | (F.col("rows") == 1))
    shifted = (F.col("kind") == "removed") & (F.col("rows") == 2)
    moved = fate.select(
        feed, file,
        F.when(shifted, "renamed").otherwise(F.col("kind")).alias("change_kind"),
        F.when(F.col("kind") == "removed", field).otherwise(blank).alias("old_field"),
        F.when(shifted, F.col("other")).when(F.col("kind") == "added", field).otherwise(blank).alias("new_field"),
    )
    return moved.unionByName(out(typed, "type_changed", field, field))


def steady_names(changes: DataFrame, feed: str = "feed", file: str = "file_no") -> DataFrame:
    """Rows (feed, field, from_file, till_file, steady): the name under which the feed first knew each field.

    Works feed by feed on the change report, whose size depends on the schema and not on the records; from_file
    and till_file bound the files in which the name stands for that steady field. A field that comes while another
    holds its steady name gets one of its own: the name and the file it begins in. Names without a row stand for
    themselves.
    """

    def chains(pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        live: dict[str, tuple] = {}  # field: (steady, first file); a field not seen yet stands for itself from the start
        last: dict[str, str] = {}
        moved: set[str] = set()

        def end(name: str, f: int) -> str:
            steady, since = live.pop(name, (name, None))
            last[name] = steady
            if steady != name or name in moved:
                rows.append((name, since, f - 1, steady))
            return steady

        for f, part in pdf.sort_values([file, "old_field", "new_field"]).groupby(file, sort=True):
            kinds = {k: list(zip(p["old_field"], p["new_field"], strict=True)) for k, p in part.groupby("change_kind")}
            renamed, removed, added = (kinds.get(k, []) for k in ("renamed", "removed", "added"))
            # All that leave go first, so that names may pass from one field to the next within a file.
            moved.update(o for o, _ in renamed)
            steadies = [end(o, f) for o, _ in renamed]
            for o, _ in removed:
                end(o, f)
            live |= {n: (s, f) for (_, n), s in zip(renamed, steadies, strict=True)}
            for _, n in added:
                steady = last.get(n, n)
                if any(s == steady for s, _ in live.values()):
                    steady = f"{n}@{f}"
                live[n] = (steady, f)
        rows += [(n, since, None, s) for n, (s, since) in live.items() if s != n]
        out = pd.DataFrame([(pdf[feed].iloc[0], *r) for r in rows], columns=["feed", "field", "from_file", "till_file", "steady"])
        return out.astype({"from_file": "Int64", "till_file": "Int64"})

    return changes.filter("change_kind IN ('renamed', 'removed', 'added')").groupBy(feed).applyInPandas(chains, "feed string, field string, from_file bigint, till_file bigint, steady string")


def steady_table(df: DataFrame, id_field: str, columns: Sequence[str], changes: DataFrame, row_id: Sequence[str] = ("feed", "file_no", "row_no")) -> DataFrame:
    """All files as one table: ``row_id``, and for each of ``columns`` its typed branches.

    A column ``c`` gives ``c`` (canonical text: of text itself, of other types their JSON), ``c_number`` (numbers,
    and text that reads as one), ``c_type`` (the tag the record had). Values come in under the steady name of their
    field, whatever the file calls it; names that differ in case or underscores only from a steady one, or that
    aren't among ``columns``, are in ``_other``, a map of the rest, so nothing is dropped.
    """
    feed, file = row_id[0], row_id[1]
    recs = records(df)
    names = steady_names(changes).withColumnsRenamed({"feed": feed})
    fields = fields_of(recs, list(row_id))
    # The mapping has a row per rename, a part of the schema; AQE broadcasts it only where it proves small.
    mapped = fields.filter("field IS NULL OR tag IS NOT NULL").alias("f").join(
        names.alias("n"),
        (F.col(f"f.{feed}") == F.col(f"n.{feed}")) & (F.col("f.field") == F.col("n.field"))
        & (F.col(f"f.{file}") >= F.coalesce("n.from_file", F.lit(-(2**62)))) & (F.col(f"f.{file}") <= F.coalesce("n.till_file", F.lit(2**62))),
        "left",
    ).select(*[F.col(f"f.{c}").alias(c) for c in row_id], F.coalesce("n.steady", "f.field").alias("name"), "f.tag", F.col("f.value").alias("value"))
    text = F.when(F.col("tag") == "text", F.expr("try_variant_get(value, '$', 'string')")).otherwise(F.to_json("value"))
    mapped = mapped.select(*row_id, "name", "tag", text.alias("text"))
    aggs = []
    for c in columns:
        here = F.col("name") == c
        aggs += [F.max(F.when(here, F.col("text"))).alias(c), F.max(F.when(here & F.col("tag").isin("number", "text"), F.expr("try_cast(text AS double)"))).alias(f"{c}_number"), F.max(F.when(here, F.col("tag"))).alias(f"{c}_type")]
    others = ~F.col("name").isin(list(columns))
    rest = F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.when(others, F.struct("name", "text"))))))
    return mapped.groupBy(*row_id).agg(*aggs, rest.alias("_other"))
