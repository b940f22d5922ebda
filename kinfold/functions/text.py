"""Text expressions for manifests and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- fixed values: the characters that count as white space at the ends of a cell ---
WHITESPACE = "".join(chr(c) for c in (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
))


def strip(col: Column) -> Column:
    """Strip any Unicode white space on both ends (``trim`` alone leaves tabs and newlines)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | (path.contains(":/") & path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"))


def resolve_path(path: Column, root: str) -> Column:
    """Absolute path: relative ones hang below ``root``; ``.``, ``..`` and doubled slashes are collapsed.
    Links are not followed: object stores have none. Plain string tests keep tidy paths off the slow branch."""
    joined = F.when(is_absolute(path), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    after_scheme = F.locate(":/", joined) + 3
    untidy = (
        joined.contains("/.") | joined.endswith("/") | joined.startswith("//")
        | (F.call_function("locate", F.lit("//"), joined, after_scheme) > 0)
    )
    scheme = F.regexp_extract(joined, r"^([A-Za-z][A-Za-z0-9+.-]*:/{1,3}[^/]*|)", 1)
    below = F.substring(joined, F.length(scheme) + 1, F.length(joined))

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.array_append(kept, part))
        )

    kept = F.aggregate(F.split(below, "/"), F.array().cast("array<string>"), step)
    return F.when(untidy, F.concat(scheme, F.lit("/"), F.array_join(kept, "/"))).otherwise(joined)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot belongs to the name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed).try_cast("double")


def whole_number(text: Column) -> Column:
    """Text as a whole 64-bit number: ``3``, `` 3 `` and ``3.0`` give 3, anything else NULL."""
    trimmed, number = strip(text), _number(text)
    plain = F.when(trimmed.rlike("^[+-]?[0-9]+$"), trimmed).try_cast("bigint")
    return F.coalesce(plain, F.when(number == F.floor(number), number).try_cast("bigint"))


def is_fractional(text: Column) -> Column:
    """True for numeric text that is no whole 64-bit number, such as ``3.5``."""
    return _number(text).isNotNull() & whole_number(text).isNull()


def rounded_units(value: Column, digits: int) -> Column:
    """``value`` in units of 10**-digits as a whole number: the nearest one to the exact binary value, half to even.

    The middle between two units is compared exactly: the value is cut at 2**-26 into two parts whose products with the scale
    need no more than 53 bits (below that the value is too small to be near a middle)."""
    scale = 10**digits
    down = F.floor(value * scale)
    high = F.floor(value * F.lit(2.0**26)) / F.lit(2.0**26)
    over = (high * (2.0 * scale) - (down * 2 + 1)) + (value - high) * (2.0 * scale)
    return F.when(over > 0, down + 1).when(over < 0, down).otherwise(down + F.pmod(down, F.lit(2)))


def fixed_decimals(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded as in ``rounded_units``; undefined values print as ``nan``."""
    size = F.abs(value)
    units = rounded_units(size, digits)
    text = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.floor(units / 10**digits).cast("bigint").cast("string"), F.lit("."),
        F.lpad(F.pmod(units, F.lit(10**digits)).cast("bigint").cast("string"), digits, "0"),
    )
    return F.when(value.isNull() | F.isnan(value), F.lit("nan")).otherwise(text)


def value_with_interval(value: Column, low: Column, high: Column) -> Column:
    """``0.833 [0.60-1.00]``; no bracket without an interval. Undefined values print as ``nan``."""
    bracket = F.concat(F.lit(" ["), fixed_decimals(low, 2), F.lit("-"), fixed_decimals(high, 2), F.lit("]"))
    return F.concat(fixed_decimals(value, 3), F.when(low.isNotNull() & high.isNotNull(), bracket).otherwise(F.lit("")))
