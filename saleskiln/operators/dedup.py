"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StringType,
    TimestampType,
)


def keep_latest(df: DataFrame, keys: Sequence[str], newest_first: str, tie_breakers: Sequence[str | Column] = ()) -> DataFrame:
    """The newest row of each key; ``tie_breakers`` (smallest first) make the choice repeatable.

    ``row_number() = 1`` is planned with a per-task limit in front of the exchange: a task ships at most
    one row per key, so a key that holds a large share of all rows does not gather in one task.
    """
    order = [F.col(newest_first).desc()]
    order += [F.col(each).asc() if isinstance(each, str) else each for each in tie_breakers]
    window = Window.partitionBy(*keys).orderBy(*order)
    rank = free_name(df, "rank")
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) == 1).drop(rank)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {name.lower() for name in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def reversed_order(column: Column, kind: DataType) -> Column:
    """A column that sorts the other way round, NULL last."""
    if isinstance(kind, (StringType, BinaryType)):
        # hexadecimal digits turned round; the mark at the end puts a text behind those it is the beginning of
        flipped = F.concat(F.translate(F.hex(column), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
    elif isinstance(kind, (FloatType, DoubleType)):
        flipped = F.struct(~F.isnan(column), -column)
    elif isinstance(kind, DecimalType):
        flipped = -column
    elif isinstance(kind, BooleanType):
        flipped = ~column
    elif isinstance(kind, IntegralType):
        flipped = F.bitwise_not(column)
    elif isinstance(kind, DateType):
        flipped = F.bitwise_not(F.unix_date(column))
    elif isinstance(kind, TimestampType):
        flipped = F.bitwise_not(F.unix_micros(column))
    else:
        raise TypeError(f"no reversed order for {kind.simpleString()}")
    return F.struct(column.isNull(), flipped)


def keep_latest_by_aggregate(df: DataFrame, keys: Sequence[str], newest_first: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """The rows of ``keep_latest``, by one aggregate instead of a sorted window: no sort in the plan, and each task sends
    one row per key.

    The row with the greatest order is kept; tie-breakers are turned round, as the smallest of them wins. Structs are
    aggregated as objects, in a hash map per task, if one of the aggregates asks for that, which the empty set beside
    it does. Spark gives the map up for sorted runs at ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold``
    keys, so this is for keys with many rows each; where most keys have one row, ``keep_latest`` does less.
    """
    order = F.struct(F.col(newest_first), *[reversed_order(F.col(name), df.schema[name].dataType) for name in tie_breakers])
    row, none = F.max_by(F.struct(*df.columns), order), F.collect_set(F.lit(None).cast("int"))
    kept = df.groupBy(*[F.col(key).alias(f"key_{k}") for k, key in enumerate(keys)]).agg(row.alias("row"), none.alias("none"))
    # an aggregate that nothing reads would be dropped from the plan
    return kept.filter(F.size("none") == 0).select("row.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count (partial counts before the exchange)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
