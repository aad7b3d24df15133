"""Column functions on addresses, identifiers and expressions of firmware code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The address regions of Cortex-M.
REGIONS = [("FLASH", 0x00000000, 0x1FFFFFFF), ("SRAM", 0x20000000, 0x3FFFFFFF), ("PERIPHERAL", 0x40000000, 0x5FFFFFFF), ("EXTERNAL", 0x60000000, 0xDFFFFFFF), ("SYSTEM", 0xE0000000, 0xFFFFFFFF)]


def region(address: Column) -> Column:
    """The region an address lies in; null outside 32 bits."""
    return F.coalesce(*[F.when(address.between(lo, hi), F.lit(n)) for n, lo, hi in REGIONS])


def is_peripheral(address: Column) -> Column:
    return F.coalesce(address.between(0x40000000, 0x5FFFFFFF) | (address >= 0xE0000000), F.lit(False))


def cluster(address: Column, bits: int) -> Column:
    """The address with its low ``bits`` cleared."""
    return address.bitwiseAND(F.lit(0xFFFFFFFF & ~((1 << bits) - 1)))


def canonical_bitband(address: Column) -> Column:
    """Peripheral bit-band aliases give the address of their word."""
    byte = F.shiftright(address - 0x42000000, 5) + 0x40000000
    return F.when(address.between(0x42000000, 0x43FFFFFF), byte.bitwiseAND(F.lit(~3))).otherwise(address)


def next_power_of_two(n: Column) -> Column:
    """The least power of two not below ``n``; 0 for numbers that aren't positive."""
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.regexp_replace(F.bin((n - 1).cast("bigint")), "^0$", ""))))


def permissions(flags: Column) -> Column:
    """``rwx`` text of segment flags (4, 2, 1)."""
    return F.concat(*[F.when(flags.bitwiseAND(F.lit(b)) != 0, F.lit(c)).otherwise(F.lit("-")) for b, c in ((4, "r"), (2, "w"), (1, "x"))])


def hex_address(address: Column) -> Column:
    return F.format_string("0x%08x", address)


def function_address(name: Column) -> Column:
    """The address in a generated name such as FUN_08001234."""
    digits = F.regexp_extract(name, "^FUN_([0-9a-fA-F]{4,8})$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))


def normalized_expr(expr: Column) -> Column:
    """Lower case, arrows as dots, no white space."""
    return F.regexp_replace(F.replace(F.lower(expr), F.lit("->"), F.lit(".")), r"\s+", "")


def name_tokens(name: Column) -> Column:
    """The different words of a name in their order, cut at underscores, case changes and non-word signs."""
    cut = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(cut)), " +"), lambda t: t != ""))


def compatible(a: Column, b: Column) -> Column:
    """Equal, one within the other, or at least half of the smaller token set shared."""
    x, y = normalized_expr(a), normalized_expr(b)
    s, t = name_tokens(a), name_tokens(b)
    shared = F.size(F.array_intersect(s, t))
    return F.coalesce((x == y) | x.contains(y) | y.contains(x) | ((shared > 0) & (2 * shared >= F.least(F.size(s), F.size(t)))), F.lit(False))


def content_id(*parts: Column, digits: int = 6) -> Column:
    """The first digits of the SHA-256 of the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, digits)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def score(base: float, terms: Sequence[tuple[Column, float]], low: float, high: float) -> Column:
    """``base`` plus the weight of every term that holds, kept between ``low`` and ``high``."""
    total = F.lit(base)
    for holds, weight in terms:
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def percent(x: Column) -> Column:
    """A share as a whole percentage, clamped, halves to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * 100).cast("int")


def band(x: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that ``x`` reaches."""
    return F.coalesce(*[F.when(x >= c, F.lit(n)) for c, n in cuts], F.lit(rest))


def decide(rules: Sequence[tuple[Column, str]], rest: str) -> Column:
    """The outcome of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(o)) for c, o in rules], F.lit(rest))


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The names of all rules that hold, in their order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in rules]), lambda r: r.isNotNull())
