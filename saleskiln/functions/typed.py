"""Casts, flags and code lookups that never abort a job on one dirty row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DataType

from saleskiln.functions.text import ColumnOrName, as_column, clean_upper

# Age of majority, gender codes, stand-in for a metric that was not reported, and the
# text form of a batch time.
ADULT_AGE = 18
GENDER_CODES = {"MALE": "M", "FEMALE": "F", "OTHER": "O"}
METRIC_MISSING = "n/a"
BATCH_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def safe_cast(value: ColumnOrName, to: str | DataType) -> Column:
    """NULL where the text does not convert (a plain cast raises under ANSI mode)."""
    return as_column(value).try_cast(to)


def to_date_safe(value: ColumnOrName) -> Column:
    return safe_cast(value, "date")


def to_timestamp_safe(value: ColumnOrName) -> Column:
    return safe_cast(value, "timestamp")


def adult_flag(age: ColumnOrName) -> Column:
    """Three-valued: a comparison with NULL is already NULL."""
    return safe_cast(age, "int") >= ADULT_AGE


def code_map(value: ColumnOrName, codes: Mapping[str, str]) -> Column:
    """Code of a cleaned, upper-cased label; NULL for a label outside the table."""
    label = clean_upper(value)
    return reduce(
        lambda chain, pair: F.when(label == pair[0], pair[1]).otherwise(chain),
        codes.items(),
        F.lit(None).cast("string"),
    )


def metric_or_missing(metrics: ColumnOrName, name: str) -> Column:
    """Entry of a string map, or the missing marker."""
    return F.coalesce(F.element_at(as_column(metrics), F.lit(name)), F.lit(METRIC_MISSING))


def batch_time_text(moment: ColumnOrName | None = None) -> Column:
    """Fixed-width batch time, so comparing the text compares the time."""
    return F.date_format(F.current_timestamp() if moment is None else as_column(moment), BATCH_TIME_FORMAT)
