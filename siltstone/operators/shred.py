"""Deeply nested JSON turned into an adjacency table and from there into related flat tables.

One pass over the text stores every value of a document as a row (node, parent, label, ordinal, scalar). The node
numbers let an object meet its scalar children in one grouping, which combines on the map side because a document's
rows leave the parser together; the grouped scalars are pivoted into entity columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.jsontext import Number, parse, unwrapped

ADJACENCY = "record_id string, doc string, doc_key string, node int, parent int, label string, ordinal int, kind string, path string, top int, trail string, scalar string"
_NAMES = [c.split()[0] for c in ADJACENCY.split(", ")]
_KINDS = pa.array(["object", "array", "text", "number", "boolean", "null"])
_OBJECT, _ARRAY, _TEXT, _NUMBER, _BOOLEAN, _NULL = range(6)
_ROWS, _CHARS = 50_000, 16_000_000
#: Paths up to this length are written out; of a longer one the outer part stands as its digest.
PATH = 400
_KNOWN_PATHS = 50_000


@dataclass(frozen=True)
class Shape:
    """What is known beforehand of a document's shape, as paths of labels joined by ``/`` (``*`` for an element).

    ``lists``: values that are lists even where a bare element or text stands in their place. ``plain_lists``: those
    of them whose elements are single values, taken as they are. ``open_parts``: values of any depth below which
    text may hold JSON.
    """

    lists: frozenset[str] = frozenset()
    plain_lists: frozenset[str] = frozenset()
    open_parts: frozenset[str] = frozenset()


class _Path:
    """A path met in the documents: what its shape says of it, its number in the batch, and the paths below it."""

    __slots__ = ("text", "no", "open", "listed", "loose", "outermost", "below")

    def __init__(self, text: str, shape: Shape, outermost: bool = False, loose: bool = False):
        self.text, self.no, self.below = text, -1, {}
        self.open, self.listed, self.loose, self.outermost = text in shape.open_parts, text in shape.lists, loose, outermost


class _Walker:
    """Takes documents of one column apart, without recursion."""

    def __init__(self, doc: str, shape: Shape):
        self.doc, self.shape = doc, shape
        self.forget()

    def forget(self) -> None:
        self.root, self.known = _Path(self.doc, self.shape), 0

    def below(self, path: _Path, label: str) -> _Path:
        text = f"{path.text}/{label}"
        if len(text) > PATH:
            text = f"#{hashlib.md5(path.text.encode('utf-8', 'replace')).hexdigest()}/{label}"
        element = label == "*"
        made = path.below[label] = _Path(text, self.shape, element and path is self.root, element and path.text not in self.shape.plain_lists)
        self.known += 1
        return made

    def rows(self, value: object) -> Iterator[list[tuple]]:
        """Rows (node, parent, label, ordinal, kind, path, top, trail, scalar) in document order, some at a time, so
        that a very large document needs no more memory than its parsed form."""
        node, out, chars = -1, [], 0
        stack = [(value, -1, "", 0, self.root, 0, None)]
        pop, push = stack.pop, stack.append
        while stack:
            v, parent, label, ordinal, path, top, trail = pop()
            inside = trail is not None or path.open
            kind = type(v)
            if kind is str and (inside or path.listed or path.loose):
                v = unwrapped(v)
                kind = type(v)
            if path.listed and not inside and v is not None and kind is not list:
                v, kind = [v], list
            node += 1
            if path.outermost:
                top = ordinal
            if kind is dict:
                out.append((node, parent, label, ordinal, _OBJECT, path, top, None, None))
                at = [path] * len(v) if inside else [path.below.get(k) or self.below(path, k) for k in v]
                for i, (k, x) in zip(range(len(v) - 1, -1, -1), reversed(v.items()), strict=True):
                    push((x, node, k, i, at[i], top, (trail, k) if inside else None))
            elif kind is list:
                out.append((node, parent, label, ordinal, _ARRAY, path, top, None, None))
                at = path if inside else path.below.get("*") or self.below(path, "*")
                for i in range(len(v) - 1, -1, -1):
                    push((v[i], node, "", i, at, top, (trail, str(i)) if inside else None))
            else:
                if v is None:
                    code, text = _NULL, None
                elif kind is bool:
                    code, text = _BOOLEAN, "true" if v else "false"
                else:
                    code, text = _NUMBER if kind is Number else _TEXT, str(v)
                    chars += len(text)
                if trail is not None:
                    steps = []
                    while trail is not None:
                        trail, own = trail
                        steps.append(own)
                    trail = ".".join(reversed(steps))
                    chars += len(trail)
                out.append((node, parent, label, ordinal, code, path, top, trail, text))
            if len(out) >= _ROWS or chars >= _CHARS:
                yield out
                out, chars = [], 0
        if out:
            yield out


def _strings(values: Sequence[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # unpaired surrogates can't be stored as UTF-8
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def shred(df: DataFrame, record_id: str, documents: Mapping[str, Shape]) -> DataFrame:
    """The adjacency table of the JSON columns ``documents`` of ``df``.

    A row per value: record_id, doc (the column), doc_key (of the text, so that deliveries of one record stay
    apart), node and parent (numbers within the document, -1 for the document's parent), label (name in its
    object, empty in a list), ordinal (place among its siblings from 0), kind (object, array, text, number,
    boolean, null), path (labels joined by ``/``; beyond ``PATH`` characters the outer part stands as ``#`` and its
    digest, and only the parents tell it in full), top (place of the element of the outermost list it lies in),
    trail (of single values below an open part: names and places joined by dots), scalar (text of a single value).

    Null columns and those that aren't valid JSON give no row, nor do ``NaN`` and ``Infinity``, which JSON lacks.
    Of names that one object repeats, the last counts. Numbers keep their digits as written. Values may be nested
    as deep as memory holds their document. Other columns of ``df`` aren't read.
    """
    names = list(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walkers = [_Walker(n, documents[n]) for n in names]
        waiting: list[tuple] = []
        owners: list[tuple[str | None, str, str, int]] = []  # record, column, key and number of the rows of one document

        def flush() -> pa.RecordBatch:
            node, parent, label, ordinal, kind, path, top, trail, scalar = zip(*waiting, strict=True)
            paths: list[_Path] = []
            at = np.empty(len(path), np.int32)
            for i, p in enumerate(path):
                if p.no < 0:
                    p.no = len(paths)
                    paths.append(p)
                at[i] = p.no
            texts = _strings([p.text for p in paths])
            for p in paths:
                p.no = -1
            own = pa.array(np.repeat(np.arange(len(owners), dtype=np.int32), [o[3] for o in owners]))
            ints = [pa.array(x, pa.int32()) for x in (node, parent, ordinal, top)]
            columns = [*[_strings([o[i] for o in owners]).take(own) for i in range(3)], ints[0], ints[1], _strings(label), ints[2], _KINDS.take(pa.array(kind, pa.int8())), texts.take(pa.array(at)), ints[3], _strings(trail), _strings(scalar)]
            waiting.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays(columns, _NAMES)

        chars = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for j, name in enumerate(names):
                for rid, text, key in zip(ids, batch.column(1 + j), batch.column(1 + len(names) + j), strict=True):
                    if (text := text.as_py()) is None:
                        continue
                    ok, value = parse(text)
                    if not ok:
                        continue
                    for rows in walkers[j].rows(unwrapped(value)):
                        waiting += rows
                        owners.append((rid, name, key.as_py(), len(rows)))
                        chars += len(text)
                        if len(waiting) >= _ROWS or chars >= _CHARS:
                            yield flush()
                            chars = 0
                    if walkers[j].known > _KNOWN_PATHS:
                        walkers[j].forget()
        if waiting:
            yield flush()

    own = df.select(F.col(record_id).cast("string").alias("record_id"), *[F.col(n).cast("string").alias(n) for n in names], *[F.hex(F.xxhash64(F.col(n))).alias(f"_key{i}") for i, n in enumerate(names)])
    return own.mapInArrow(run, ADJACENCY)


@dataclass(frozen=True)
class Entity:
    """A flat table within an adjacency table: the elements of the list at ``path``, keyed by ``key``.

    ``key`` names a scalar child; with ``bare`` an element that is a single value gives its own text, so it does
    without ``key``. ``open_part``: instead of elements, every non-null single value below ``path``, keyed by its
    trail.
    """

    name: str
    path: str
    key: str | None = None
    bare: bool = False
    open_part: bool = False


def _owner(entities: Sequence[Entity]) -> tuple[Column, Column]:
    """Of an adjacency row: is it an element itself, and does it hold a scalar of one."""
    element = F.col("path").isin([f"{e.path}/*" for e in entities if not e.open_part]) & (F.col("kind") != "null")
    keys = [f"{e.path}/*/{e.key}" for e in entities if e.key]
    return element, (F.col("path").isin(keys) if keys else F.lit(False)) & F.col("kind").isin("text", "number", "boolean")


def child_rows(adjacency: DataFrame, entities: Sequence[Entity]) -> DataFrame:
    """Rows (record_id, child_table, parent_no, child_no, child_key) of all ``entities``, each once.

    parent_no is the place of the outermost element around, 0 where the row is such an element itself; null
    elements keep their place but give no row; a missing key gives an empty text.
    """
    element, key_of = _owner(entities)
    deep = [e for e in entities if e.open_part]
    single = (F.col("path").isin([e.path for e in deep]) if deep else F.lit(False)) & F.col("trail").isNotNull() & F.col("kind").isin("text", "number", "boolean")
    own = element | single
    rows = adjacency.filter(own | key_of)
    # The entity's number travels through the shuffle, not its path.
    number = F.coalesce(*[F.when((F.col("path") == (e.path if e.open_part else f"{e.path}/*")), F.lit(i)) for i, e in enumerate(entities)])
    grouped = rows.withColumn("owner", F.when(own, F.col("node")).otherwise(F.col("parent"))).groupBy("record_id", "doc", "doc_key", "owner").agg(
        F.max(F.when(own, F.struct(number.alias("entity"), "top", "ordinal", (F.col("kind") == "object").alias("is_object"), F.coalesce("trail", "scalar").alias("text")))).alias("e"),
        F.max(F.when(~own, F.col("scalar"))).alias("key"),
    )
    pick = lambda of: F.element_at(F.array(*[F.lit(of(e)) for e in entities]), F.col("e.entity") + 1)
    is_open = pick(lambda e: e.open_part)
    own_text = is_open | (pick(lambda e: e.bare) & ~F.col("e.is_object"))
    inner = pick(lambda e: not e.open_part and "/*" in e.path) | is_open
    return grouped.filter("e IS NOT NULL").select(
        "record_id", pick(lambda e: e.name).alias("child_table"),
        F.when(inner, F.col("e.top")).otherwise(0).alias("parent_no"),
        F.when(is_open, 0).otherwise(F.col("e.ordinal")).alias("child_no"),
        F.coalesce(F.when(own_text, F.col("e.text")).otherwise(F.col("key")), F.lit("")).alias("child_key"),
    ).distinct()


def entity_table(adjacency: DataFrame, path: str, fields: Sequence[str], bare: str | None = None) -> DataFrame:
    """The elements of the list at ``path`` as a flat table: record_id, doc_key, parent_no, child_no, a text column
    per scalar field. Objects meet their scalar children in one grouping by node and are pivoted there. ``bare`` names
    the column that takes the text of an element which is a single value."""
    element = F.col("path") == f"{path}/*"
    scalar = F.col("path").isin([f"{path}/*/{f}" for f in fields]) if fields else F.lit(False)
    names = [*fields, *([bare] if bare and bare not in fields else [])]
    text = lambda f: F.when(F.col("path") == f"{path}/*/{f}", F.col("scalar")).when(element & F.lit(f == bare), F.col("scalar"))
    grouped = adjacency.filter((element & (F.col("kind") != "null")) | scalar).groupBy("record_id", "doc_key", F.when(element, F.col("node")).otherwise(F.col("parent")).alias("node")).agg(
        F.max(F.when(element, F.struct("top", "ordinal"))).alias("_e"),
        *[F.max(text(f)).alias(f) for f in names],
    )
    parent = F.lit(0) if path.count("/*") == 0 else F.col("_e.top")
    return grouped.filter("_e IS NOT NULL").select("record_id", "doc_key", parent.alias("parent_no"), F.col("_e.ordinal").alias("child_no"), *names)


def open_table(adjacency: DataFrame, path: str) -> DataFrame:
    """The single values below the open part at ``path``: record_id, doc_key, parent_no, trail, value."""
    single = (F.col("path") == path) & F.col("trail").isNotNull() & F.col("kind").isin("text", "number", "boolean")
    return adjacency.filter(single).select("record_id", "doc_key", F.col("top").alias("parent_no"), "trail", F.col("scalar").alias("value")).distinct()


def listed(adjacency: DataFrame, path: str, lists: Sequence[str]) -> DataFrame:
    """Of the elements of the outermost list at ``path`` their lists of single values: record_id, doc_key, child_no, an
    array column per list, in order."""
    inside = F.col("path").isin([f"{path}/*/{n}/*" for n in lists]) & (F.col("kind") != "null")
    values = lambda n: F.array_sort(F.collect_set(F.when(F.col("path") == f"{path}/*/{n}/*", F.struct("ordinal", "scalar"))))
    grouped = adjacency.filter(inside).groupBy("record_id", "doc_key", F.col("top").alias("child_no")).agg(*[values(n).alias(n) for n in lists])
    return grouped.select("record_id", "doc_key", "child_no", *[F.col(n)["scalar"].alias(n) for n in lists])
