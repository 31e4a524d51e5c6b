"""Parameters: vocabulary, row unit, date window, limits and prices."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame


class InputError(ValueError):
    """A file or table that cannot become a dataset."""


class SelectionError(ValueError):
    """A scope or window that cannot be analysed."""


class TagError(ValueError):
    """Tag data that fails a gate."""


@dataclass(frozen=True)
class Unit:
    """What one analysed row is, and how much support a finding needs."""

    one: str
    many: str
    product_level: bool
    min_evidence: int


REVIEW = Unit("review", "reviews", False, 2)
PRODUCT_RECORD = Unit("product record", "product records", True, 1)


@dataclass(frozen=True)
class Theme:
    """A theme of the rule engine; mentioned when any keyword occurs."""

    key: str
    label: str
    keywords: tuple[str, ...]
    recommendation: str


def vocabulary_from(table: DataFrame) -> tuple[Theme, ...]:
    """Vocabulary table (theme_key, label, keywords, recommendation) as a parameter.

    Every theme is taken, those without keywords too; NULL keywords count as none. The
    vocabulary becomes part of the plan, so it is a table somebody wrote, not one derived
    from the rows.
    """
    rows = table.select("theme_key", "label", "keywords", "recommendation").orderBy("theme_key").collect()
    return tuple(Theme(r.theme_key, r.label, tuple(r.keywords or ()), r.recommendation) for r in rows)


@dataclass(frozen=True)
class DateWindow:
    """Inclusive date range."""

    start: date
    end: date

    def __post_init__(self) -> None:
        if self.start > self.end:
            raise SelectionError("the window ends before it starts")


@dataclass(frozen=True)
class BatchLimits:
    """Most rows and text bytes one tagging batch may carry."""

    max_rows: int = 12
    max_bytes: int = 16 * 1024


@dataclass(frozen=True)
class SampleLimits:
    """Most rows, text bytes and request bytes of a text sample."""

    max_rows: int = 12
    max_text_bytes: int = 200 * 1024
    max_request_bytes: int = 250 * 1024


@dataclass(frozen=True)
class LabelLimits:
    """Bounds of one label-grouping request and of the hierarchy."""

    max_labels: int = 300
    max_length: int = 120
    max_bytes: int = 64 * 1024
    max_levels: int = 3


@dataclass(frozen=True)
class CostModel:
    """Measured token rates and prices in USD per million tokens."""

    output_tokens_per_row: float = 100.0
    output_tokens_per_byte: float = 0.31
    input_usd: float = 5.0
    output_usd: float = 25.0
    careful_rows_per_batch: int = 3
    prompt_tokens: int = 760
    input_tokens_per_byte: float = 0.44
    output_tokens_per_tag: int = 61
    distinct_label_ratio: float = 0.5
    input_tokens_per_label: int = 6
    output_tokens_per_label: int = 3
    surviving_label_ratio: float = 0.6
    retry_share: float = 0.1


@dataclass(frozen=True)
class RunCeiling:
    """Most rows of a run, and the cost that needs a confirmation."""

    max_rows: int = 600
    confirm_above_usd: float = 0.5


DEMO_CEILING = RunCeiling(max_rows=60, confirm_above_usd=0.25)


@dataclass(frozen=True)
class Sizing:
    batches: BatchLimits = field(default_factory=BatchLimits)
    labels: LabelLimits = field(default_factory=LabelLimits)
    cost: CostModel = field(default_factory=CostModel)
    ceiling: RunCeiling = field(default_factory=RunCeiling)
