"""Numeric columns: strict parsing of text cells and half-up rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import SPACE_CLASS, trimmed

DECIMAL_SHAPE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def strict_number(cell: Column) -> Column:
    """A decimal numeral as DOUBLE, else NULL; a blank cell counts as zero.

    The shape is tested first because a cast alone would also take ``4d`` or ``inf``.
    A numeral beyond the range of DOUBLE is infinite; every caller has an upper bound.
    """
    plain = trimmed(cell)
    return F.when(plain.rlike(DECIMAL_SHAPE), plain.try_cast("double")).when(plain == "", 0.0)


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Nearest value, ties towards plus infinity (``-2.5`` gives ``-2``)."""
    if digits == 0:
        return F.floor(value + 0.5)
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


_STARS = (1, 2, 3, 4, 5)


def exact_stars(value: Column) -> Column:
    """A number that is whole stars 1..5, else NULL; ``4.0`` passes, ``3.5`` does not."""
    return F.when(value.isin(*map(float, _STARS)), value.cast("int"))


def whole_stars(value: Column) -> Column:
    """An average rating rounded half up to whole stars 1..5, else NULL."""
    return F.when(round_half_up(value).isin(*_STARS), round_half_up(value).cast("int"))


def star_rating(cell: Column) -> Column:
    """Whole stars 1..5 of a text cell, else NULL."""
    return exact_stars(strict_number(cell))


def rounded_rating(cell: Column) -> Column:
    """Whole stars of a text cell holding an average rating, else NULL."""
    return whole_stars(strict_number(cell))


def amount(cell: Column) -> Column:
    """A price, percentage or count with its decoration stripped; NULL if unreadable."""
    bare = F.regexp_replace(trimmed(cell), f"[₹,%]|{SPACE_CLASS}", "")
    value = F.when(bare.rlike(DECIMAL_SHAPE), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def without_percent(cell: Column) -> Column:
    """The number of a cell that may end in a percent sign."""
    return strict_number(F.regexp_replace(trimmed(cell), "%$", ""))


def valid_discount(cell: Column, value: Column) -> Column:
    """The parsed ``value`` of a discount cell if it lies within 0..100, else NULL."""
    return F.when((trimmed(cell) != "") & value.between(0, 100), value)


def discount(cell: Column) -> Column:
    """A discount within 0..100, optional percent sign; NULL otherwise."""
    return valid_discount(cell, without_percent(cell))


def mean_to_tenth(total: Column, rows: Column) -> Column:
    """Mean to one decimal; zero where there are no rows."""
    return F.when(rows > 0, round_half_up(total / rows, 1)).otherwise(F.lit(0.0))


def share_percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage of ``whole``."""
    return round_half_up(part / whole * 100).cast("int")


def one_decimal(value: Column) -> Column:
    """Text with exactly one decimal, without grouping separators."""
    return F.format_string("%.1f", value)
