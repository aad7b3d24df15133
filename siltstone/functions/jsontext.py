"""JSON text of any depth: parsing without recursion, and columns that tell valid JSON from text that only begins so."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SPACE = " \t\r\n"
_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[{])|([\]}])|([,:])|(")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}
#: Levels below which a record handed to the engine's own parser carries a digest instead of the value.
LEVELS = 500


class Number(str):
    """A number kept as written."""


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


def _deep(text: str) -> object:
    """What ``json.loads`` gives, with a stack of its own; of repeated names the last counts."""
    at, stack, root, done = 0, [], None, False
    name: str | None = None
    want = "value"  # value, first (a value or the end), name, first_name, colon, or next (a comma or the end)
    while not done or at < len(text):
        m = _TOKEN.match(text, at)
        if done or not m:
            raise ValueError("not JSON")
        at = m.end()
        opened, closed, mark, quote, number, word = m.groups()
        if mark:
            if mark == ":" and want == "colon":
                want = "value"
            elif mark == "," and want == "next":
                want = "name" if isinstance(stack[-1][0], dict) else "value"
            else:
                raise ValueError("not JSON")
            continue
        if closed:
            if not stack or want not in ("next", "first", "first_name") or (closed == "}") != isinstance(stack[-1][0], dict):
                raise ValueError("not JSON")
            _, name = stack.pop()
            done, want = not stack, "next"
            continue
        if quote:
            value, at = json.decoder.scanstring(text, at, True)
            if want in ("name", "first_name"):
                name, want = value, "colon"
                continue
        elif number is not None:
            value = Number(number)
        else:
            value = ({} if opened == "{" else []) if opened else _WORDS[word]
        if want not in ("value", "first"):
            raise ValueError("not JSON")
        if not stack:
            root = value
        elif isinstance(stack[-1][0], dict):
            stack[-1][0][name] = value
        else:
            stack[-1][0].append(value)
        if opened:
            stack.append((value, name))
            want = "first_name" if opened == "{" else "first"
        else:
            done, want = not stack, "next"
    return root


def parse(text: str) -> tuple[bool, object]:
    """Whether ``text`` is valid JSON, and its value; numbers are kept as written, however deep they lie."""
    text = text.strip(_SPACE)
    try:
        return True, json.loads(text, parse_float=Number, parse_int=Number, parse_constant=_refuse)
    except RecursionError:
        try:
            return True, _deep(text)
        except ValueError:
            return False, None
    except ValueError:
        return False, None


def unwrapped(value: object) -> object:
    """Text that holds the JSON of a list or an object gives that list or object, however often it was wrapped."""
    seen = value
    while type(seen) is str and seen.lstrip(_SPACE)[:1] in ("[", "{", '"'):
        ok, inner = parse(seen)
        if not ok:
            break
        seen = inner
    return seen if isinstance(seen, (list, dict)) else value


def write(value: object, levels: int | None = None) -> str:
    """The JSON text of a parsed value, without recursion. Lists and objects that begin ``levels`` below the value
    stand as ``["#deep", digest of their text]``, which is equal for equal ones."""
    parts: list[str] = []
    todo: list[tuple[bool, object, int]] = [(True, value, 0)]
    while todo:
        is_value, v, depth = todo.pop()
        if not is_value:
            parts.append(v)
        elif isinstance(v, Number):
            parts.append(v)
        elif not isinstance(v, (list, dict)):
            parts.append(json.dumps(v))
        elif levels is not None and depth >= levels:
            parts.append(json.dumps(["#deep", hashlib.md5(write(v).encode()).hexdigest()]))
        else:
            named = isinstance(v, dict)
            items = [(f"{', ' if i else ''}{json.dumps(k)}: ", x) for i, (k, x) in enumerate(v.items())] if named else [(", " if i else "", x) for i, x in enumerate(v)]
            parts.append("{" if named else "[")
            todo.append((False, "}" if named else "]", 0))
            for lead, x in reversed(items):
                todo += [(True, x, depth + 1), (False, lead, 0)]
    return "".join(parts)


@F.pandas_udf(StringType())
def _mended(raw: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        ok, value = parse(t)
        return write(value, LEVELS) if ok and isinstance(value, dict) else None

    return raw.map(one)


def object_of(raw: Column) -> Column:
    """The variant of a text that is one JSON object and nothing else, with null for every other text.

    The engine's parser stops at the end of the first value; put into an object with a mark behind it, text that goes
    on there is told from text that ends. It refuses what repeats a name.
    """
    mark, own = "\\u0001end", "\\u0001own"
    framed = F.try_parse_json(F.concat(F.lit(f'{{"{own}":'), raw, F.lit(f',"{mark}":0}}')))
    whole = (F.try_variant_get(framed, "$['\u0001end']", "int") == 0) & opens_object(raw)
    return F.try_variant_get(F.when(whole, framed), "$['\u0001own']", "variant")


def opens_object(raw: Column) -> Column:
    return raw.rlike(r"^[ \t\r\n]*\{")


def mended(raw: Column, found: Column) -> Column:
    """Text that the engine's parser refuses although it is a JSON object, put so that it takes it: of repeated names
    the last counts, and what lies below ``LEVELS`` levels is a digest. Null where ``found`` isn't or text is no object."""
    return _mended(F.when(found.isNull() & opens_object(raw), raw))
