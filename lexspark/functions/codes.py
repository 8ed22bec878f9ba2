"""Hierarchical codes: digits, prefixes and suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A dotted code inside a text, not part of a longer number.
DOTTED = r"(?<![0-9])([0-9]{2,4}(?:\.[0-9]{2,4}){1,4})(?![0-9])"


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\P{Nd}", "")


def normalize_code(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", ""), F.lit("."))


def digit_length(c: Column) -> Column:
    return F.length(digits_only(c))


def is_heading(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"^[0-9]{2}\.[0-9]{2}$")


def first_code(c: Column) -> Column:
    """The first dotted code in a text, or null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), DOTTED, 1), F.lit(""))


def code_of_cell(cell: Column, allow_heading: Column | bool) -> Column:
    """The code in a table cell: all but digits and dots goes first, so "12.50 kg" holds one."""
    only = F.regexp_replace(F.coalesce(cell, F.lit("")), "[^0-9.]", "")
    bare = F.when(F.lit(allow_heading) if isinstance(allow_heading, bool) else allow_heading, F.when(only.rlike("^[0-9]{4}$"), only))
    return F.coalesce(first_code(only), bare)


def ancestors(digits: Column) -> Column:
    """All proper prefixes of two digits or more, longest first."""
    n = F.length(digits)
    return F.when(n > 2, F.transform(F.sequence(n - 1, F.lit(2), F.lit(-1)), lambda k: F.substring(digits, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def ancestor_levels(digits: Column, levels: tuple[int, ...] = (8, 6, 4, 2)) -> Column:
    """Prefixes at these lengths, where the code is longer and has four digits at least."""
    cut = F.transform(F.filter(F.array(*map(F.lit, levels)), lambda k: (F.length(digits) > k) & (F.length(digits) >= 4)), lambda k: F.substring(digits, F.lit(1), k))
    return cut


def suffix_value(cell: Column) -> Column:
    """Two digits of a statistical suffix; one digit is padded, other lengths don't count."""
    d = digits_only(cell)
    return F.when(F.length(d).isin(1, 2), F.lpad(d, 2, "0"))


def with_suffix(base8: Column, suffix: Column) -> Column:
    return F.when(base8.isNotNull() & suffix.isNotNull(), F.concat(base8, suffix))


def national_country(code: Column, country: Column) -> Column:
    """Only codes of more than eight digits belong to a country."""
    return F.when(digit_length(code) > 8, F.coalesce(country, F.lit(""))).otherwise("")
