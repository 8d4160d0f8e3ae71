"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate, and stay in one document only.

One aggregation gives every line (by hash) a HyperLogLog sketch of its sites; partial sketches are merged by it, so a
line that half of all documents carry is one small row per task. Lines whose estimate is near the threshold are counted
exactly. Column functions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saleskiln.llm.common import SPACES, Scratch, unused_name

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Registers of a sketch, as a power of two; its relative standard error, and how many of those count as near.
LOG_REGISTERS = 12
ERROR, NEAR = 1.04 / 2 ** (LOG_REGISTERS / 2), 5
WORD = "[^\\x20\\x09-\\x0D]"


def line_key(line: Column) -> Column:
    """Hash of a line without the white space around it."""
    return F.xxhash64(F.trim(line, F.lit(SPACES)))


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda l: l.rlike(WORD))


def exploded(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.explode(worded_lines(F.col(text))).alias("line")).withColumn("line", line_key(F.col("line")))


def spread_lines(docs: DataFrame, scratch: Scratch, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of the lines that at least ``min_sites`` sites carry, and how many do (an estimate well above it). Null
    sites count as none."""
    lines = exploded(docs, text, F.col(site).cast("string").alias("site"))
    sketches = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))
    margin = max(1.0, NEAR * ERROR * min_sites)
    about = F.hll_sketch_estimate("sketch").alias("sites")
    likely = scratch.write(sketches.where(F.col("n") >= min_sites).select("line", about).where(F.col("sites") >= min_sites - margin))
    near = likely.where(F.col("sites") <= min_sites + margin).select("line")
    # pairs of a line and a site are made distinct by task before anything meets
    pairs = lines.join(near, "line", "left_semi").where("site is not null").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    return scratch.write(likely.where(F.col("sites") > min_sites + margin).unionByName(exact))


def drop_spread_lines(docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, n_lines (lines with a word before) and n_removed.

    A line (white space around it ignored) that ``min_sites`` sites or more carry stays in the document with the
    smallest id that has it, and goes from all others. Lines without words stay. A text none of whose lines goes is
    unchanged, also a null one. Rows that share an id count as one document; rows without an id count for the spread
    and keep all their lines. Columns n_lines and n_removed are replaced, other columns stay.
    """
    scratch = Scratch(docs.sparkSession)
    spread = spread_lines(docs, scratch, text, site, min_sites).select("line")
    held = exploded(docs.where(F.col(doc_id).isNotNull()), text, F.col(doc_id).alias("id"))
    held = scratch.write(held.join(spread, "line", "left_semi").groupBy("line", "id").agg(F.lit(1).alias("one")).drop("one"))
    first = held.groupBy("line").agg(F.min("id").alias("first"))
    key, gone = unused_name(docs, "_id"), unused_name(docs, "_gone")
    others = held.join(first, "line").where("id > first").groupBy(F.col("id").alias(key)).agg(F.collect_list("line").alias(gone))
    out = docs.join(others, docs[doc_id] == others[key], "left").drop(key)
    stays = lambda l: ~l.rlike(WORD) | ~F.array_contains(F.col(gone), line_key(l))
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), stays), "\n")
    n_lines = F.size(worded_lines(F.col(text))).cast("bigint")
    counted = out.withColumn("n_lines", n_lines).withColumn(text, F.when(F.col(gone).isNotNull(), left).otherwise(F.col(text)))
    return counted.withColumn("n_removed", F.when(F.col(gone).isNotNull(), F.col("n_lines") - F.size(worded_lines(F.col(text)))).otherwise(0).cast("bigint")).drop(gone)
