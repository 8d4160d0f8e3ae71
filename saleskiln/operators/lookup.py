"""Resolve natural keys against dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.operators.dedup import free_name


def lookup_key(lines: DataFrame, dimension: DataFrame, on: str, fetch: str) -> DataFrame:
    """``lines`` plus ``fetch`` of the matching dimension member, NULL where there is none.

    The dimension is narrowed to the two columns and has one row per ``on``. No broadcast hint: Spark
    broadcasts a dimension whose measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and
    otherwise shuffles both sides and splits hot keys of ``lines`` (adaptive skew join).
    """
    key = free_name(lines, "member")
    member = dimension.select(F.col(on).alias(key), F.col(fetch))
    return lines.join(member, lines[on] == member[key], "left").drop(key)


def resolved(lines: DataFrame, *fetched: str) -> DataFrame:
    """Only lines that found every member: with ``lookup_key`` this is an inner join in two steps."""
    kept = lines
    for name in fetched:
        kept = kept.filter(F.col(name).isNotNull())
    return kept


#: Bits of the bitmap of known keys, as a power of two (4 MB at every size of the dimension), and of one of its rows.
LOG_BITMAP, BLOCK = 25, 1 << 15


def likely_known(lines: DataFrame, dimension: DataFrame, on: str, keep: Column | None = None, log_bits: int = LOG_BITMAP) -> DataFrame:
    """``lines`` without most of those whose ``on`` is no key of ``dimension``; every line of a known member stays, and
    so does what ``keep`` says. Lines without a key go.

    For dimensions too large to broadcast: a bitmap of fixed size, one bit per hash of a key, is broadcast instead and
    drops lines ahead of the exchange of the lookup. A bit may be set by another key, so the lookup still decides. The
    denser the bitmap, the less it drops: with 2 ** 25 bits and three million members one unknown line in twelve stays.
    """
    place, block, marks = free_name(lines, "place"), free_name(lines, "block"), free_name(lines, "marks")
    bit = lambda key: F.pmod(F.xxhash64(F.col(key)), F.lit(1 << log_bits))
    keys = dimension.filter(F.col(on).isNotNull()).select(bit(on).alias(place))
    rows = keys.groupBy(F.floor(F.col(place) / BLOCK).alias(block)).agg(F.bitmap_construct_agg(F.col(place) % BLOCK).alias(marks))
    at = F.col(place) % BLOCK
    byte = F.conv(F.hex(F.substring(F.col(marks), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    placed = lines.withColumn(place, bit(on)).withColumn(block, F.floor(F.col(place) / BLOCK))
    known = F.col(on).isNotNull() & F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(rows), block, "left").filter(known if keep is None else known | keep).select(*lines.columns)
