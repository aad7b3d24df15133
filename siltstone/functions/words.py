"""Column functions on 32-bit words, identifiers and text written in uneven ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character of any script.
SPACE = r"(?U)\s"


def stripped(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeezed(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, f"{SPACE}+", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def word32(c: Column) -> Column:
    """The 32-bit word a text means, as a bigint from 0 to 2**32-1.

    Understood are ``0x``/``0X`` and trailing-``h`` hexadecimal, ``0b`` binary, ``0o`` octal and decimal (also with
    ``.0`` behind it), each with an optional sign, outer spaces and ``_`` between digits. Null where the text is
    none of these. Negative and longer numbers are reduced modulo 2**32, however many digits they have.
    """
    known = F.regexp_extract(F.lower(stripped(c.cast("string"))), r"^[+-]?(?:0x[0-9a-f_]+|0b[01_]+|0o[0-7_]+|[0-9][0-9a-f_]*h|[0-9][0-9_]*(?:\.0*)?)$", 0)
    plain = F.regexp_replace(known, r"_|\.0*$|h$", "")

    # Bound once by way of a one-element list; inlined, the text expression would be repeated in every branch.
    bound = F.transform(F.array(F.struct(plain.alias("t"), known.endswith("h").alias("h"))), _word_of)
    return F.when(known != "", F.pmod(F.get(bound, F.lit(0)), F.lit(4294967296)))


def _word_of(t: Column) -> Column:
    body = F.regexp_replace(t["t"], "^[+-]", "")
    # The last digits of a power-of-two base are the word; decimal digits are reduced nine at a time.
    last = lambda base, digits, keep: F.conv(F.right(digits, F.lit(keep)), base, 10).cast("bigint")
    rest = F.substring(body, 3, 2**31 - 1)
    number = (
        F.when(t["h"], last(16, body, 8)).when(body.startswith("0x"), last(16, rest, 8))
        .when(body.startswith("0b"), last(2, rest, 32)).when(body.startswith("0o"), last(8, rest, 11))
        .when(F.length(body) <= 18, body.cast("bigint")).otherwise(_long_decimal(body))
    )
    return F.when(t["t"].startswith("-"), -number).otherwise(number)


def _long_decimal(digits: Column) -> Column:
    full = F.lpad(digits, (F.ceil(F.length(digits) / 9) * 9).cast("int"), F.lit("0"))
    groups = F.regexp_extract_all(full, F.lit("[0-9]{9}"), 0)
    return F.aggregate(groups, F.lit(0).cast("bigint"), lambda acc, g: F.pmod(acc * 10**9 + g.cast("bigint"), F.lit(4294967296)))


def norm_id(c: Column) -> Column:
    """Lower case without outer white space; null when nothing is left."""
    return blank_to_null(F.lower(stripped(c)))
