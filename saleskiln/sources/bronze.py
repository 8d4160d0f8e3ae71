"""Bronze rows: raw text plus the metadata of the batch that brought it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.functions.text import ColumnOrName, as_column
from saleskiln.sources.schemas import BATCH_COLUMN


def as_raw_json(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Serialise whole rows to ``raw_json``; absent values are left out, as in the landed records."""
    kept = [F.col(name) for name in keep]
    return df.select(F.to_json(F.struct("*")).alias("raw_json"), *kept)


def with_batch(
    records: DataFrame,
    batch_time: Column | str,
    source: ColumnOrName,
    row_id_from: Sequence[str] | None = None,
) -> DataFrame:
    """Bronze frame of one batch.

    ``batch_time`` is data, fixed by the caller: the same batch replanned or retried keeps its stamp.
    It is one text per run, or a column where rows of several batches are loaded at once.
    ``row_id`` is a random UUID, or a digest of ``row_id_from`` and the batch where ids have to repeat.
    """
    stamp = F.lit(batch_time) if isinstance(batch_time, str) else batch_time
    row_id = (
        F.expr("uuid()")
        if row_id_from is None
        else F.sha2(F.concat_ws("|", *[F.col(name).cast("string") for name in row_id_from], stamp), 256)
    )
    return records.select(
        "raw_json",
        row_id.alias("row_id"),
        as_column(source).alias("source"),
        stamp.alias(BATCH_COLUMN),
    )
