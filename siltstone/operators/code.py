"""Facts read from program text: calls, memory accesses, loops, map files, fenced blocks.

Patterns that no later match depends on are built-in expressions; accesses, loops, stores, arguments and conditions,
whose brackets must balance, are read in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import ctext
from siltstone.functions.words import stripped

# Words before a parenthesis that are no calls.
KEYWORDS = ("if", "while", "for", "switch", "return", "sizeof", "else", "do")


def names_before_parenthesis(text: Column) -> Column:
    """The different names that stand directly before a parenthesis, keywords left out."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Za-z_]\w*)\("), 1)), F.array(*[F.lit(k) for k in KEYWORDS]))


def map_symbols(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, line_no, function_name, address, size): function sections of linker map text.

    Read are ``.text.name address size`` on one line, and a line that holds only the section name whose address
    follows on the next.
    """
    # The line that follows comes from the text itself, so no window is needed.
    section = r"^\s*\.text\.(\w+)\s+0x([0-9a-fA-F]+)\s+0x([0-9a-fA-F]+)"
    following = F.get(F.split(F.col(text), "\n"), F.col("line_no") + 1)
    rows = df.select(key, text, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    rows = rows.filter(F.col("line").contains(".text."))
    rest = F.when(F.col("line").rlike(section), F.col("line")).otherwise(F.concat(F.col("line"), F.lit(" "), F.coalesce(following, F.lit(""))))
    pick = lambda i: F.regexp_extract(rest, section, i)
    out = rows.select(key, "line_no", pick(1).alias("function_name"), F.conv(pick(2), 16, 10).cast("bigint").alias("address"), F.conv(pick(3), 16, 10).cast("bigint").alias("size"))
    return out.filter("function_name <> ''")


def fenced_blocks(text: Column) -> Column:
    """The contents of fenced code blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)


def json_payload(text: Column) -> Column:
    """The JSON in a reply: the whole text, else its first fenced block, else from the first brace to the last; null
    if none of these is valid."""
    whole = F.trim(text)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.trim(c).rlike(r"^[\[{]"), c)
    return F.coalesce(valid(whole), valid(fenced), valid(braces))


def literal_clusters(text: Column, low: int, high: int, bits: int) -> Column:
    """The different address clusters that hexadecimal literals of a text name between ``low`` and ``high``."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"0x([0-9a-fA-F]{5,8})(?![0-9a-fA-F])"), 1), lambda h: F.conv(h, 16, 10).cast("bigint"))
    inside = F.filter(numbers, lambda n: n.between(low, high))
    return F.array_sort(F.array_distinct(F.transform(inside, lambda n: n.bitwiseAND(F.lit(0xFFFFFFFF & ~((1 << bits) - 1))))))


def text_rows(df: DataFrame, keys: Sequence[str], text: str, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """The ``keys`` of ``df`` beside every row that ``rows`` reads from its text; null texts are empty."""
    own = df.select(*keys, text).schema
    kinds = [f"`{k}` {own[k].dataType.simpleString()}" for k in keys]
    names = [c.split()[0] for c in schema.split(", ")]
    types = [_ARROW[c.split()[1]] for c in schema.split(", ")]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            owner: list[int] = []
            for i, t in enumerate(b.column(n)):
                found = rows(t.as_py() or "")
                out += found
                owner += [i] * len(found)
                if len(out) > 50_000:
                    yield batch(b, owner, out)
                    out, owner = [], []
            if out:
                yield batch(b, owner, out)

    def batch(b: pa.RecordBatch, owner: list[int], out: list[tuple]) -> pa.RecordBatch:
        at = pa.array(owner, pa.int32())
        return pa.RecordBatch.from_arrays([*[b.column(i).take(at) for i in range(n)], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], [*keys, *names])

    return df.select(*keys, text).mapInArrow(run, ", ".join(kinds + [schema]))


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
# What may stand behind a loop's word: its bracket, or what the reader leaves out before it. Texts without are not read.
_LOOP = re.compile(r"(?:for|while)\s*[(/#]|do\s*[{/#]")
# A bound less one.
_LESS_ONE = re.compile(r"-[ \t\r\n\f\v]*1")
LOOP_SCHEMA = "line_no int, loop_kind string, header string, bound string, bound_is_constant boolean, store_expr string, index_expr string, copy_dst string, copy_src string, body string, last_line int, braced boolean"


def loops(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """A row per ``for``, ``while`` and ``do`` loop: its head and bound, the first store in its body whose place isn't a
    constant, the operands of its first copy of element to element, and the body."""

    def rows(t: str) -> list[tuple]:
        if not _LOOP.search(t):
            return []
        return [(x.line, x.kind, x.header, x.bound, x.constant, x.store, x.index, x.copy_dst, x.copy_src, x.body, x.last_line, x.braced) for x in ctext.loops(ctext.read(t))]

    return text_rows(df, keys, text, LOOP_SCHEMA, rows)


def pointer_stores(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, line_no, base, form, own_update, is_parameter): stores through named pointers, see
    :func:`siltstone.functions.ctext.pointer_stores`; a parameter is one declared with a star in the text, or generated."""

    def rows(t: str) -> list[tuple]:
        if "=" not in t or not ("*" in t or "->" in t or "[" in t):
            return []
        c = ctext.read(t)
        known = {p for ps in ctext.pointer_parameters(c).values() for p in ps}
        return [(*r, r[1] in known or r[1].startswith("param_")) for r in ctext.pointer_stores(c)]

    return text_rows(df, keys, text, "line_no int, base string, form string, own_update boolean, is_parameter boolean", rows)


def clamps(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, line_no, variable, clamp): values kept within a bound."""
    return text_rows(df, keys, text, "line_no int, variable string, clamp string", lambda t: ctext.clamps(ctext.read(t)) if "=" in t else [])


def array_extents(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, name, extent): arrays declared in the text."""
    return text_rows(df, keys, text, "name string, extent string", lambda t: ctext.arrays(ctext.read(t)) if "[" in t else [])


_CONDITION = re.compile(r"\b(if|while|for)[ \t]*\(")
# Longest first, so that arrows and shifts are never taken for comparisons.
_CONDITION_TOKEN = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|([(\[{])|([)\]}])|(->|<<=?|>>=?|::)|(==|!=|<=|>=|<|>)|(&&|\|\||[?:,;])""")
_NEGATED = {"<": ">=", ">=": "<", ">": "<=", "<=": ">", "==": "!=", "!=": "=="}


def _closing(text: str, start: int, stops: str = "{}") -> int:
    """The place of the parenthesis that closes the one before ``start``, -1 if one of ``stops`` or the end comes first."""
    depth = 1
    for m in _CONDITION_TOKEN.finditer(text, start):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth:
            return m.start()
        if m[0] in stops:
            return -1
    return -1


def comparisons(condition: str, negated: bool = False) -> list[tuple[str, str, str]]:
    """(left, operator, right) of a condition's comparisons: each term between logical operators is split at its
    outermost comparison operator; brackets around a whole term are opened, and a negation before them turns the operator."""
    marks, cuts, depth = [], [0], 0
    for m in _CONDITION_TOKEN.finditer(condition):
        depth += bool(m[2]) - bool(m[3])
        if depth == 0 and m[5]:
            marks.append((m.start(), m.end(), m[5]))
        elif depth == 0 and m[6]:
            cuts += [m.start(), m.end()]
    cuts.append(len(condition))
    found = []
    for lo, hi in zip(cuts[::2], cuts[1::2], strict=True):
        own = [x for x in marks if lo <= x[0] < hi]
        if own:
            # Equality binds less than order, and of equals the last is the outermost.
            at, end, operator = max(own, key=lambda x: (x[2] in ("==", "!="), x[0]))
            left, right = condition[lo:at].strip(), condition[end:hi].strip()
            if left and right:
                found.append((left, _NEGATED[operator] if negated else operator, right))
            continue
        term = condition[lo:hi].strip()
        inner = term.lstrip("! \t")
        if inner.startswith("(") and _closing(inner, 1) == len(inner) - 1:
            found += comparisons(inner[1:-1], negated ^ (term[: len(term) - len(inner)].count("!") % 2 == 1))
    return found


def guards(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, at, keyword, condition, left, operator, right) of the comparisons in ``if``, ``while`` and ``for``
    conditions whose parentheses balance before a block or statement ends; of a ``for`` the middle part counts."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, at int, keyword string, condition string, left string, operator string, right string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for m in _CONDITION.finditer(t or ""):
                    end = _closing(t, m.end(), "{}" if m[1] == "for" else "{};")
                    if end < 0:
                        continue
                    condition = t[m.end() : end]
                    if m[1] == "for":
                        parts = condition.split(";")
                        condition = parts[1] if len(parts) == 3 else ""
                    for row in comparisons(condition):
                        for c, v in zip(cols, (k, m.start(), m[1], condition, *row), strict=True):
                            c.append(v)
            types = [b.schema.field(0).type, pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "at", "keyword", "condition", "left", "operator", "right"])

    return df.select(key, text).mapInArrow(run, schema)


ACCESS_SCHEMA = "seq int, line_no int, kind string, shape string, base_provenance string, width int, base string, number bigint"


def memory_accesses(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, seq, line_no, kind, shape, base_provenance, width, base, number) of all accesses in program text, see
    :func:`siltstone.functions.ctext.accesses`; seq numbers a text's accesses in order."""

    def rows(t: str) -> list[tuple]:
        if "*" not in t and "DAT_" not in t and "[" not in t:
            return []
        return [(i, *r) for i, r in enumerate(ctext.accesses(ctext.read(t)))]

    return text_rows(df, keys, text, ACCESS_SCHEMA, rows)


def call_arguments(df: DataFrame, keys: Sequence[str], text: str, callees: Sequence[str] = ()) -> DataFrame:
    """Rows (keys, at, line_no, callee, args): every call of ``callees``, or of any name but a keyword, whose parentheses
    balance, with its arguments. A definition's head reads as a call of its own name."""
    names = frozenset(callees) or None
    return text_rows(df, keys, text, "at int, line_no int, callee string, args array<string>", lambda t: ctext.calls(ctext.read(t), names) if "(" in t and (names is None or any(n in t for n in names)) else [])


def definitions(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Rows (keys, line_no, function_name, code): the functions a text defines, each with its own text."""
    return text_rows(df, keys, text, "line_no int, function_name string, code string", lambda t: ctext.definitions(ctext.read(t)) if "{" in t else [])


def guarded_calls(df: DataFrame, keys: Sequence[str], text: str, callees: Sequence[str] = (), before: int = 10) -> DataFrame:
    """:func:`call_arguments` with ``has_guard``: whether one of the ``before`` lines in front keeps a value in bounds."""
    names = frozenset(callees) or None
    return text_rows(df, keys, text, "at int, line_no int, callee string, args array<string>, has_guard boolean", lambda t: ctext.guarded_calls(ctext.read(t), names, before) if "(" in t else [])


def bounded_readers(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """The ``keys`` of texts that read a string into a buffer with care, see
    :func:`siltstone.functions.ctext.reads_bounded_string`."""
    return text_rows(df, keys, text, "careful boolean", lambda t: [(True,)] if _LESS_ONE.search(t) and _LOOP.search(t) and ctext.reads_bounded_string(ctext.read(t)) else []).drop("careful")
