"""Category paths: ``Home|Lighting|Lamps`` belongs to Home and is a Lamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import single_spaced


def category_path(cell: Column) -> Column:
    """Non-blank segments, outermost first."""
    segments = F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), single_spaced)
    return F.filter(segments, lambda s: s != "")


def top_category(cell: Column) -> Column:
    """Outermost segment: the grouping key; empty if there is none."""
    return F.coalesce(F.try_element_at(category_path(cell), F.lit(1)), F.lit(""))


def leaf_category(cell: Column) -> Column:
    """Innermost segment: what the product is; empty if there is none."""
    return F.coalesce(F.try_element_at(category_path(cell), F.lit(-1)), F.lit(""))
