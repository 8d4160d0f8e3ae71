"""Landed page files: one envelope ``{"<entity>": [...], "total": n, "skip": k}`` per API page.

The HTTP client that fetches the pages is not part of this library; it drops each response body into
a landing folder, and everything from there on is a distributed read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from saleskiln.functions.text import ColumnOrName, as_column

# Fixed value: where a landed file name states the offset of its page, as in "skip=200.json".
OFFSET_IN_NAME = r"skip[=_-](\d+)"


def read_pages(spark: SparkSession, location: str, one_page_per_line: bool = False) -> DataFrame:
    """Landed pages as ``body, page_source, name_offset``.

    A whole file per page is the layout of a small landing zone. A fetcher that lands much should
    append one page per line (``one_page_per_line=True``): such files split and avoid the listing cost
    of one object per hundred records.
    """
    files = spark.read.text(location, wholetext=not one_page_per_line, recursiveFileLookup=True)
    return files.select(
        F.col("value").alias("body"),
        F.col("_metadata.file_path").alias("page_source"),
        safe_offset(F.regexp_extract(F.col("_metadata.file_name"), OFFSET_IN_NAME, 1)).alias("name_offset"),
    )


def safe_offset(text: ColumnOrName) -> Column:
    return as_column(text).try_cast("bigint")


def open_pages(pages: DataFrame, entity: str) -> DataFrame:
    """Parse each envelope once: ``page_source, page_offset, page_total, records, record_count``.

    ``records`` is an array of record texts; it is NULL for a page without the entity's list (missing,
    null, or a body that is no JSON at all). Asking for ``array<string>`` hands every element back as
    compact JSON text, so no record schema is needed here.
    """
    envelope = f"total bigint, skip bigint, `{entity}` array<string>"
    named = pages if "name_offset" in pages.columns else pages.withColumn("name_offset", F.lit(None).cast("bigint"))
    return named.filter(F.length(F.trim("body")) > 0).select(
        "page_source",
        "name_offset",
        F.xxhash64("body").alias("page_digest"),
        F.inline(F.array(F.from_json("body", envelope))),
    ).select(
        "page_source",
        F.coalesce("skip", "name_offset").alias("page_offset"),
        "page_digest",
        F.col("total").alias("page_total"),
        F.col(entity).alias("records"),
    )


def usable_pages(opened: DataFrame, observation: Observation | None = None, strict: bool = False) -> DataFrame:
    """Pages in front of the first broken one.

    Paging stops at a page without its list, so whatever was landed behind that offset does not count.
    The cut-off is a one-row scalar subquery: it stays in the plan, nothing is collected.
    A page names its own offset, else its file does; where neither says, a good page counts, and a broken
    one cuts nothing off, but fails the job if ``strict``. Blank lines are no pages.
    ``observation`` picks up ``page_metrics`` of all pages on the way.
    """
    broken = opened.filter(F.col("records").isNull()).agg(F.min("page_offset").alias("cut"))
    seen = opened.observe(observation, *page_metrics()) if observation else opened
    if strict:
        unplaced = F.col("records").isNull() & F.col("page_offset").isNull()
        message = F.concat(F.lit("broken page of unknown offset in "), F.coalesce("page_source", F.lit("?")))
        seen = seen.filter(F.when(unplaced, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    before_cut = F.col("page_offset").isNull() | (F.col("page_offset") < F.coalesce(broken.scalar(), F.lit(2**63 - 1)))
    return seen.filter(F.col("records").isNotNull() & before_cut)


def page_records(pages: DataFrame, entity: str, observation: Observation | None = None, strict: bool = False) -> DataFrame:
    """One row per record of the usable pages: ``raw_json, page_source, page_offset, page_digest, position``."""
    return usable_pages(open_pages(pages, entity), observation, strict).select(
        "page_source",
        "page_offset",
        "page_digest",
        F.posexplode("records").alias("position", "raw_json"),
    )


def page_metrics() -> list[Column]:
    """Completeness of a landing: pages, broken pages, first broken offset, records held and announced."""
    broken = F.col("records").isNull()
    return [
        F.count(F.lit(1)).alias("pages"),
        F.count_if(broken).alias("broken_pages"),
        F.min(F.when(broken, F.col("page_offset"))).alias("first_broken_offset"),
        F.coalesce(F.sum(F.array_size("records").cast("bigint")), F.lit(0).cast("bigint")).alias("records_held"),
        F.max("page_total").alias("records_announced"),
    ]


def page_report(pages: DataFrame, entity: str) -> DataFrame:
    """One row of ``page_metrics``."""
    return open_pages(pages, entity).agg(*page_metrics())


# --- coverage of the announced range -------------------------------------------------------------

#: Records of a stretch of offsets that is swept by itself.
SWEEP_BLOCK = 1_000_000


def staged_pages(pages: DataFrame, entity: str, observation: Observation) -> DataFrame:
    """Parsed pages to be written once: ``page_id`` and the columns of ``open_pages`` and ``record_count``.

    ``observation`` gets the smallest offset of a broken page and the largest total: a minimum and a maximum, which
    a task that is run again cannot falsify. A broken page of unknown offset fails the job.
    """
    opened = open_pages(pages, entity)
    broken = F.col("records").isNull()
    seen = opened.observe(
        observation,
        F.min(F.when(broken, F.col("page_offset"))).alias("first_broken_offset"),
        F.max("page_total").alias("records_announced"),
    )
    message = F.concat(F.lit("broken page of unknown offset in "), F.coalesce("page_source", F.lit("?")))
    unplaced = F.when(broken & F.col("page_offset").isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return seen.filter(unplaced).select(
        F.monotonically_increasing_id().alias("page_id"), "*", F.array_size("records").cast("bigint").alias("record_count")
    )


def repeated_pages(staged: DataFrame) -> DataFrame:
    """``page_offset, page_id, stop, copies``: of the pages at one offset that which counts, the one with most records.

    Partial maxima are taken before the exchange, so a page landed a million times is one row per task.
    """
    placed = staged.filter(F.col("records").isNotNull() & F.col("page_offset").isNotNull())
    best = F.max(F.struct("record_count", "page_digest", "page_id"))
    grouped = placed.groupBy("page_offset").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    return grouped.select(
        "page_offset", F.col("best.page_id").alias("page_id"), (F.col("page_offset") + F.col("best.record_count")).alias("stop"), "copies"
    )


def swept(kept: DataFrame) -> DataFrame:
    """``kept`` (page_offset, stop, ...) with ``reached``: how far the pages at smaller offsets reach.

    The sweep runs by blocks of offsets; between them goes one number per block, so only as many rows as there are
    blocks meet in one task.
    """
    blocked = kept.withColumn("block", F.floor(F.col("page_offset") / SWEEP_BLOCK))
    before = Window.partitionBy("block").orderBy("page_offset").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.groupBy("block").agg(F.max("stop").alias("block_stop"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("block", F.max("block_stop").over(earlier).alias("carried"))
    inside = blocked.withColumn("inside", F.max("stop").over(before))
    reached = F.greatest(F.lit(0).cast("bigint"), F.col("inside"), F.col("carried"))
    return inside.join(carried, "block").withColumn("reached", reached).drop("block", "inside", "carried")


def coverage_findings(staged: DataFrame, announced: Column | int | None = None) -> DataFrame:
    """``kind, from_offset, to_offset, pages``: a gap that no page covers, an overlap of pages at different offsets,
    a page that landed more than once. ``announced`` (else the largest total) says where the last page should end."""
    kept = repeated_pages(staged)
    pages = swept(kept)
    none = F.lit(1).cast("bigint")
    gaps = pages.filter("page_offset > reached").select(F.lit("gap").alias("kind"), F.col("reached").alias("from_offset"), F.col("page_offset").alias("to_offset"), none.alias("pages"))
    overlaps = pages.filter("page_offset < reached and stop > page_offset").select(F.lit("overlap").alias("kind"), F.col("page_offset").alias("from_offset"), F.least("reached", "stop").alias("to_offset"), none.alias("pages"))
    repeats = kept.filter("copies > 1").select(F.lit("repeat").alias("kind"), F.col("page_offset").alias("from_offset"), F.col("stop").alias("to_offset"), F.col("copies").alias("pages"))
    total = staged.agg(F.max("page_total")).scalar() if announced is None else announced if isinstance(announced, Column) else F.lit(announced)
    tail = kept.agg(F.coalesce(F.max("stop"), F.lit(0)).cast("bigint").alias("reached")).select(F.lit("gap").alias("kind"), F.col("reached").alias("from_offset"), total.cast("bigint").alias("to_offset"), none.alias("pages"))
    return gaps.unionByName(overlaps).unionByName(repeats).unionByName(tail.filter("to_offset > from_offset"))


def coverage_report(staged: DataFrame, announced: int | None) -> DataFrame:
    """One row: records held once (overlaps and repeats taken off), missing, overlapping, and repeated pages.

    The sums of ``coverage_findings``, taken in one pass over the swept pages.
    """
    offset, stop, reached = F.col("page_offset"), F.col("stop"), F.col("reached")
    none = F.lit(0).cast("bigint")
    summed = lambda value: F.coalesce(F.sum(value), none).cast("bigint")
    found = swept(repeated_pages(staged)).agg(
        summed(F.greatest(offset - reached, none)).alias("between"),
        F.greatest(F.lit(announced).cast("bigint") - F.coalesce(F.max(stop), none), none).alias("behind"),
        summed(F.when((offset < reached) & (stop > offset), F.least(reached, stop) - offset)).alias("records_overlapping"),
        summed(F.col("copies") - 1).alias("repeated_pages"),
        summed(stop - offset).alias("records_placed"),
    )
    unplaced = staged.filter("records is not null and page_offset is null").agg(summed(F.col("record_count")).alias("records_unplaced"))
    missing = (F.col("between") + F.col("behind")).alias("records_missing")
    return found.select(missing, "records_overlapping", "repeated_pages", unplaced.scalar().alias("records_unplaced"), "records_placed")


def kept_records(staged: DataFrame, repeats: bool) -> DataFrame:
    """Records of staged good pages, those of a page that landed more than once only once."""
    good = staged.filter(F.col("records").isNotNull())
    if repeats:
        counts = repeated_pages(staged).select("page_id")
        good = good.filter(F.col("page_offset").isNull()).unionByName(good.join(counts, "page_id", "left_semi").select(*good.columns))
    return good.select("page_source", "page_offset", "page_digest", F.posexplode("records").alias("position", "raw_json"))
