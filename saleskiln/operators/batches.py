"""Newest-batch selection over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from saleskiln.sources.schemas import BATCH_COLUMN


class EmptyTableError(ValueError):
    """A source table holds no batch at all."""


def newest_batch_time(df: DataFrame, column: str = BATCH_COLUMN) -> DataFrame:
    """One row, ``newest_batch``; NULL when there is none."""
    return df.agg(F.max(column).alias("newest_batch"))


def latest_batch(df: DataFrame, column: str = BATCH_COLUMN, batches: DataFrame | None = None) -> DataFrame:
    """Rows of the newest batch.

    The maximum is a scalar subquery of the same plan. On a table partitioned by ``column`` the filter
    prunes partitions at run time, so only the newest batch is read, and the subquery reads no data
    column. Where ``df`` is costly to derive, ``batches`` names a cheaper frame with the same batches.
    """
    newest = newest_batch_time(df if batches is None else batches, column)
    return df.filter(F.col(column) == newest.scalar())


def require_batch(df: DataFrame, label: str, column: str = BATCH_COLUMN) -> DataFrame:
    """``df`` itself, or ``EmptyTableError``; looks for a single row, it does not count."""
    if df.select(column).filter(F.col(column).isNotNull()).isEmpty():
        raise EmptyTableError(f"{label} holds no batch")
    return df
