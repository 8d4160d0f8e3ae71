"""Sales totals per dimension member."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: exact type in which money is summed. A double sum depends on the order of the partial
# sums, so two runs of one query could differ; six decimals hold cents times a two-digit rate.
MONEY = "decimal(24,6)"


def total_by_member(facts: DataFrame, dimension: DataFrame, on: str, describe: list[str], measure: str, total: str) -> DataFrame:
    """Sum ``measure`` per member of ``dimension`` and attach its descriptive columns.

    Facts are summed by the surrogate key before the join, so what meets the dimension is one row per
    member: a member with a large share of all facts arrives as a handful of partial sums. ``on`` is
    unique in the dimension, hence no second aggregation. An amount that does not fit, or is no number,
    fails the job instead of being left out.
    """
    amounts = facts.select(on, F.col(measure).alias("amount"), F.col(measure).try_cast(MONEY).alias("exact"))
    # each amount is converted once; whether one got lost is asked once per member, not per fact
    sums = amounts.groupBy(on).agg(F.sum("exact").cast("double").alias("sum"), (F.count("amount") - F.count("exact")).alias("lost"))
    message = F.concat(F.col("lost").cast("string"), F.lit(f" amounts of {measure} do not fit {MONEY}"))
    whole = F.when(F.col("lost") == 0, F.col("sum")).otherwise(F.raise_error(message).cast("double"))
    sums = sums.select(on, whole.alias(total))
    return dimension.select(on, *describe).join(sums, on, "inner").select(*describe, total)
