"""Row-quality rules measured in one pass, and the gate that applies them."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, functions as F

log = logging.getLogger(__name__)


class QualityError(ValueError):
    """A batch must not be published."""


def quality_metrics(key: str, checks: Mapping[str, Column] | None = None) -> list[Column]:
    """Aggregates of one report; ``checks`` count rows among those with a key."""
    has_key = F.col(key).isNotNull()
    total = F.count(F.lit(1))
    return [
        total.alias("total_rows"),
        F.count_if(~has_key).alias("null_keys"),
        F.try_divide(F.count_if(~has_key) * F.lit(100.0), total).alias("null_key_pct"),
        F.count_if(has_key).alias("valid_rows"),
        *[F.count_if(has_key & broken).alias(name) for name, broken in (checks or {}).items()],
    ]


def quality_report(df: DataFrame, key: str, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: rows, rows without key, their percentage, valid rows, and a count per check."""
    return df.agg(*quality_metrics(key, checks))


def drop_null_keys(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


def gate(df: DataFrame, key: str, observation: Observation, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows with a key; the report is filled by whichever job runs the plan, not by jobs of its own.

    Observed counts can come out too high after a lost executor (a repeated task counts again), so they
    serve the log and the emptiness rule, never a row count that is published.
    """
    return drop_null_keys(df.observe(observation, *quality_metrics(key, checks)), key)


def judge(report: Mapping[str, object], label: str) -> None:
    """Raise on an empty frame, warn about dropped rows and failed checks."""
    total = report.get("total_rows") or 0
    if not total:
        raise QualityError(f"{label}: no rows")
    if report["null_keys"]:
        log.warning("%s: dropped %s rows without key (%.2f%%)", label, report["null_keys"], report["null_key_pct"])
    known = {"total_rows", "null_keys", "null_key_pct", "valid_rows"}
    for name in report.keys() - known:
        if report[name]:
            log.warning("%s: %s = %s (rows kept)", label, name, report[name])
    log.info("%s: %s valid rows", label, report["valid_rows"])
