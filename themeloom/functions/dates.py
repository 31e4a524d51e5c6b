"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import trimmed


def strict_date(cell: Column) -> Column:
    """``YYYY-MM-DD`` naming a real calendar day as DATE, else NULL."""
    plain = trimmed(cell)
    shaped = F.when(plain.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), plain)
    return F.try_to_date(shaped, "yyyy-MM-dd")


def short_date(day: Column) -> Column:
    """Label such as ``Mar 4, 2026``."""
    return F.date_format(day, "MMM d, yyyy")
