"""Runs that write: ingest a batch, rebuild each table from the newest batch, or all of it in order."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce
from operator import or_
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from saleskiln.functions.keys import packed
from saleskiln.operators import (
    QualityError,
    UpsertRule,
    duplicate_keys,
    insert_all,
    judge,
    latest_batch,
    require_batch,
    upsert,
    upsert_small_batch,
)
from saleskiln.operators.parse import REJECT, REJECTED_TEXT
from saleskiln.plans import builds
from saleskiln.plans.contracts import DIM_CLIENT, DIM_PRODUCT, FT_SALE, SALES_BY_CLIENT, TableContract
from saleskiln.sources.bronze import with_batch
from saleskiln.sources.pages import coverage_report, kept_records, staged_pages
from saleskiln.sources.schemas import ENTITIES
from saleskiln.sources.tables import PART, Warehouse, dealt_by, with_packed, with_unpacked

log = logging.getLogger(__name__)

Touches = Callable[[DataFrame, DataFrame | None], None]
Result = TypeVar("Result")


def together(spark: SparkSession, steps: Iterable[Callable[[], Result]]) -> list[Result]:
    """Results of steps that do not need each other, in their order. Their jobs share the cluster, so that one small
    job does not wait for the last task of another. All have ended when the first error, if any, is raised."""
    wrapped = [inheritable_thread_target(spark)(step) for step in steps]
    if not wrapped:
        return []
    with ThreadPoolExecutor(len(wrapped)) as pool:
        started = [pool.submit(step) for step in wrapped]
    return [step.result() for step in started]


@dataclass(frozen=True)
class IngestResult:
    """What became of a landing: gaps are announced records that no page holds, and a page at an offset where
    another one landed is a repeated page, of which one is ingested."""

    entity: str
    rows_written: int
    first_broken_offset: int | None
    records_announced: int | None
    records_missing: int = 0
    records_overlapping: int = 0
    repeated_pages: int = 0

    @property
    def complete(self) -> bool:
        return (
            self.first_broken_offset is None
            and not self.records_missing
            and self.rows_written - self.records_overlapping == self.records_announced
        )


@dataclass(frozen=True)
class MergeResult:
    table: str
    rows_inserted: int
    rows_updated: int
    source_rows: int


def ingest(warehouse: Warehouse, entity: str, pages: DataFrame, batch_time: str) -> IngestResult:
    """Append all records of the landed ``pages`` as one bronze batch.

    The pages are parsed once, into staging; what lies behind the first broken one is left out, pages that landed
    repeatedly count once, and their offsets are swept for gaps and overlaps. Row ids are digests of page file,
    offset, page body, position and batch, so that a retried task writes the same ids and lines of one file never
    share one. A broken page of unknown offset fails the job before anything is written.
    """
    if entity not in ENTITIES:
        raise ValueError(f"unknown entity {entity!r}, expected one of {ENTITIES}")
    landing = Observation()
    staged_name = warehouse.stage(staged_pages(pages, entity, landing), f"{entity}_pages")
    try:
        staged = warehouse.spark.read.table(staged_name)
        cut, announced = landing.get["first_broken_offset"], landing.get["records_announced"]
        usable = staged if cut is None else staged.filter(F.col("page_offset").isNull() | (F.col("page_offset") < cut))
        seen = coverage_report(usable, announced).first()
        origin = ["page_source", "page_offset", "page_digest", "position"]
        before = warehouse.batch_rows(entity, batch_time) if warehouse.exists("bronze", entity) else 0
        records = kept_records(usable, repeats=seen.repeated_pages > 0)
        warehouse.append_batch(entity, with_batch(records, batch_time, "page_source", row_id_from=origin))
    finally:
        warehouse.drop_staged(staged_name)
    warehouse.free_exchanges()
    result = IngestResult(
        entity,
        warehouse.batch_rows(entity, batch_time) - before,
        cut,
        announced,
        # pages that name no offset may be anywhere, so what they hold may fill a gap
        max(seen.records_missing - seen.records_unplaced, 0),
        seen.records_overlapping,
        seen.repeated_pages,
    )
    if not result.complete:
        log.warning("%s: incomplete landing %s", entity, result)
    warehouse.log_run(
        step="ingest", table=f"bronze.{entity}", rows_written=result.rows_written, source_rows=announced, complete=result.complete, detail=batch_time
    )
    return result


def merge(
    warehouse: Warehouse,
    contract: TableContract,
    batch: DataFrame,
    observation: Observation | None = None,
    unique: bool = False,
    touches: Touches | None = None,
    detail: str | None = None,
) -> MergeResult:
    """Upsert ``batch`` into the contract's table.

    The batch plan runs once, into staging; its report is judged there, before the target is touched.
    Counts come from row counts of stored files, which also hold after repeated tasks: keys are unique
    and not NULL on both sides, hence rows after = rows before + inserted. ``unique=True`` says that
    the batch has one row per key and no NULL keys by construction, and saves the key check.
    ``touches`` sees the staged batch and the table before the upsert. Rows that the build marked as rejected go to
    the table of rejects. The result is also logged.
    """
    layer, table, rule = contract.layer, contract.table, contract.rule
    schema = contract.schema(warehouse.id_type)
    if warehouse.dealt:
        warehouse.replace_parts(layer, table)
    # without a table there is nothing to join with, and how many buckets it needs shows when the batch is stored
    buckets = warehouse.buckets_of(layer, table) if bucketed(warehouse, contract) else 0
    staged_name = warehouse.stage(batch, table, rule.keys[0], buckets)
    try:
        staged = warehouse.spark.read.table(staged_name)
        if observation is not None:
            judge(observation.get, f"{layer}.{table}")
        if REJECT in staged.columns:
            warehouse.store_rejects(f"{layer}.{table}", staged.filter(F.col(REJECT).isNotNull()))
            staged = staged.filter(F.col(REJECT).isNull()).drop(REJECT, REJECTED_TEXT)
        if not unique:
            check_keys(staged, contract)
        source_rows = staged.count()
        if touches and source_rows:
            touches(staged, warehouse.read(layer, table) if warehouse.exists(layer, table) else None)
        if warehouse.native_merge:
            warehouse.create_empty(layer, table, schema)
            result = merge_into(warehouse, contract, staged, source_rows)
        elif warehouse.dealt:
            result = merge_parts(warehouse, contract, staged, source_rows)
        else:
            result = merge_version(warehouse, contract, staged, staged_name, source_rows, buckets)
    finally:
        warehouse.drop_staged(staged_name)
    warehouse.free_exchanges()
    log.info("%s", result)
    warehouse.log_run(
        step="merge", table=result.table, rows_written=result.rows_inserted + result.rows_updated, source_rows=result.source_rows,
        rows_inserted=result.rows_inserted, rows_updated=result.rows_updated, complete=True, detail=detail,
    )
    return result


def bucketed(warehouse: Warehouse, contract: TableContract) -> bool:
    return contract.bucketed and warehouse.buckets > 0 and not warehouse.dealt and not warehouse.native_merge


def merge_version(
    warehouse: Warehouse, contract: TableContract, staged: DataFrame, staged_name: str, source_rows: int, buckets: int = 0
) -> MergeResult:
    """The upsert as a new version of the table, published once it is whole; ``buckets`` are those of the one before and of
    the staged batch, or 0."""
    layer, table, rule = contract.layer, contract.table, contract.rule
    if warehouse.exists(layer, table):
        target = warehouse.read(layer, table)
        rows_before = target.count()
    else:
        target, rows_before = warehouse.spark.createDataFrame([], contract.schema(warehouse.id_type)), 0
    small = source_rows <= warehouse.small_batch_rows and few_rows(warehouse, staged_name)
    hits = None
    try:
        if rows_before and not small and not bucketed(warehouse, contract):
            hits = warehouse.stage(hit_keys(target, staged, rule), f"{table}_hits")
        if hits and few_rows(warehouse, hits):
            merged = upsert_few_hits(target, staged, warehouse.spark.read.table(hits), rule)
        else:
            merged = merged_rows(warehouse, contract, target, rows_before, staged, small)
        wanted = 0
        if bucketed(warehouse, contract):
            held = warehouse.stored_bytes(warehouse.published(layer, table)) if buckets else 0
            wanted = warehouse.buckets_for(held + warehouse.stored_bytes(staged_name), buckets)
            if wanted != buckets:
                merged = dealt_by(merged, rule.keys[0], wanted)
        version = warehouse.write_version(layer, table, merged, rule.keys[0], wanted)
    finally:
        if hits:
            warehouse.drop_staged(hits)
    try:
        inserted = checked_growth(contract, warehouse.spark.read.table(version).count() - rows_before, source_rows)
        warehouse.publish(layer, table, version)
    except Exception:
        if warehouse.published(layer, table) != version:
            warehouse.drop_staged(version)
        raise
    warehouse.drop_old_versions(layer, table)
    return MergeResult(f"{layer}.{table}", inserted, source_rows - inserted, source_rows)


def merge_parts(warehouse: Warehouse, contract: TableContract, staged: DataFrame, source_rows: int) -> MergeResult:
    """The upsert of a dealt table: only the partitions with keys of the batch are read, merged and replaced.

    The merged partitions are stored before any is replaced. A job that fails in front of that leaves the table as
    it was; one that fails behind it leaves some partitions new, some old, and perhaps one of them gone, until the
    next upsert, which finds the stored rows and puts them in place first. ``Warehouse.replace_parts`` does so alone.
    """
    layer, table, rule = contract.layer, contract.table, contract.rule
    name = warehouse.create_parts(layer, table, contract.schema(warehouse.id_type))
    held = warehouse.touched_parts(name, staged, rule.keys[0]).drop(PART)
    rows_before = held.count()
    merged = upsert_packed(held, staged, rule).select(*held.columns, warehouse.part_of(rule.keys[0]).alias(PART))
    pending = warehouse.store_pending(layer, table, merged)
    try:
        inserted = checked_growth(contract, warehouse.spark.read.table(pending).count() - rows_before, source_rows)
    except Exception:
        warehouse.drop_staged(pending)
        raise
    warehouse.replace_parts(layer, table)
    return MergeResult(f"{layer}.{table}", inserted, source_rows - inserted, source_rows)


def checked_growth(contract: TableContract, inserted: int, source_rows: int) -> int:
    if not 0 <= inserted <= source_rows:
        raise QualityError(f"{contract.layer}.{contract.table}: {inserted} rows more from a batch of {source_rows}, not published")
    return inserted


def check_keys(staged: DataFrame, contract: TableContract) -> None:
    keys = list(contract.rule.keys)
    nulls = staged.filter(reduce(or_, [F.col(key).isNull() for key in keys])).count()
    if nulls:
        raise QualityError(f"{contract.table}: {nulls} rows with NULL in the key")
    repeated = duplicate_keys(staged, keys).count()
    if repeated:
        raise QualityError(f"{contract.table}: {repeated} keys occur more than once in the batch")


def merged_rows(
    warehouse: Warehouse,
    contract: TableContract,
    target: DataFrame,
    target_rows: int,
    staged: DataFrame,
    small: bool,
) -> DataFrame:
    """The cheapest plan for the upsert; ``small`` says that the staged batch may be broadcast.

    A bucketed target is joined bucket by bucket with a batch that was staged in the same buckets: nothing is
    shuffled, and because each task then holds exactly one bucket, the new version gets one file per bucket.
    That rules out the map-only rewrite, whose tasks would each write to all buckets.
    """
    in_buckets = bucketed(warehouse, contract)
    if target_rows == 0:
        return insert_all(target, staged, contract.rule)
    if small and not in_buckets:
        return upsert_small_batch(target, F.broadcast(staged), contract.rule).select(*target.columns)
    return upsert_packed(target, staged, contract.rule, contract.rule.keys if in_buckets else ())


def few_rows(warehouse: Warehouse, name: str) -> bool:
    """Whether a stored table may be broadcast; files come first, as rows are counted from them."""
    return warehouse.stored_bytes(name) <= warehouse.small_batch_bytes and warehouse.spark.read.table(name).count() <= warehouse.small_batch_rows


def hit_keys(target: DataFrame, staged: DataFrame, rule: UpsertRule) -> DataFrame:
    """Keys of the batch that the target has; nothing but keys goes through the exchange."""
    keys = list(rule.keys)
    return with_unpacked(with_packed(staged.select(keys)).join(with_packed(target.select(keys)), keys, "left_semi"))


def upsert_few_hits(target: DataFrame, staged: DataFrame, hits: DataFrame, rule: UpsertRule) -> DataFrame:
    """The upsert of a large batch that changes few rows of the target: those are broadcast, the others of both sides are
    written as they are, and no row goes through an exchange."""
    keys = list(rule.keys)
    changed = staged.join(F.broadcast(hits), keys, "left_semi").select(*staged.columns)
    added = staged.join(F.broadcast(hits), keys, "left_anti").select(*staged.columns)
    rewritten = upsert_small_batch(target, F.broadcast(changed), rule).select(*target.columns)
    return rewritten.unionByName(insert_all(target, added, rule))


def upsert_packed(target: DataFrame, staged: DataFrame, rule: UpsertRule, but: Sequence[str] = ()) -> DataFrame:
    """Columns of the target after ``upsert``, whose exchanges and sorts get the digests packed, other than those named:
    a key that both sides are bucketed on has to stay as it is."""
    rows = upsert(with_packed(target, but), with_packed(staged, but), rule)
    return with_unpacked(rows.select(*target.columns), but)


def merge_into(warehouse: Warehouse, contract: TableContract, staged: DataFrame, source_rows: int) -> MergeResult:
    """The same upsert as one MERGE of a format that supports it."""
    rule, name = contract.rule, warehouse.name(contract.layer, contract.table)
    before = warehouse.spark.read.table(name).count()
    source = {column: F.col(f"batch.{column}") for column in staged.columns}
    on_update = {column: source[column] for column in rule.updated_columns(staged.columns)}
    if rule.touch:
        on_update[rule.touch] = F.current_timestamp()
    condition = F.lit(True)
    for key in rule.keys:
        condition = condition & (F.col(f"{name}.{key}") == source[key])
    (
        staged.alias("batch")
        .mergeInto(name, condition)
        .whenMatched()
        .update(on_update)
        .whenNotMatched()
        .insert(source)
        .merge()
    )
    inserted = warehouse.spark.read.table(name).count() - before
    return MergeResult(f"{contract.layer}.{contract.table}", inserted, source_rows - inserted, source_rows)


def newest(warehouse: Warehouse, entity: str) -> DataFrame:
    """Newest batch of a bronze table; which one it is comes from the catalog, not from a scan of all history."""
    batches = require_batch(warehouse.batches(entity), f"bronze.{entity}")
    return latest_batch(warehouse.read("bronze", entity), batches=batches)


def renamed(warehouse: Warehouse) -> Touches:
    """Notes clients whose totals show another name now."""

    def note(staged: DataFrame, table: DataFrame | None) -> None:
        if table is None:
            return
        old = table.select("sk_client", *[F.col(name).alias(f"old_{name}") for name in builds.DESCRIBED])
        changed = reduce(or_, [~F.col(name).eqNullSafe(F.col(f"old_{name}")) for name in builds.DESCRIBED])
        warehouse.note_touched("clients", staged.join(old, "sk_client").filter(changed).select("sk_client"))

    return note


def sold_to(warehouse: Warehouse) -> Touches:
    """Notes the clients of a batch's lines, and those who had one of them before."""

    def note(staged: DataFrame, table: DataFrame | None) -> None:
        but = FT_SALE.rule.keys if bucketed(warehouse, FT_SALE) else ()
        lines = with_packed(staged.select("hash_id", "sk_client"), but)
        members = lines.select("sk_client")
        if table is not None:
            moved = with_packed(table.select("hash_id", "sk_client"), but).join(lines.withColumnRenamed("sk_client", "new"), "hash_id")
            members = members.unionByName(moved.filter(F.col("sk_client") != F.col("new")).select("sk_client"))
        warehouse.note_touched("clients", with_unpacked(members.distinct()))

    return note


def run_dim_client(warehouse: Warehouse) -> MergeResult:
    report = Observation()
    rows = builds.dim_client(newest(warehouse, "users"), warehouse.id_type, report, rejects=True)
    return merge(warehouse, DIM_CLIENT, rows, report, unique=True, touches=renamed(warehouse))


def run_dim_product(warehouse: Warehouse) -> MergeResult:
    report = Observation()
    rows = builds.dim_product(newest(warehouse, "products"), warehouse.id_type, report, rejects=True)
    return merge(warehouse, DIM_PRODUCT, rows, report, unique=True)


def run_ft_sale(warehouse: Warehouse) -> MergeResult:
    products, clients = warehouse.read("silver", "dim_product"), warehouse.read("silver", "dim_client")
    lines, members = Observation(), Observation()
    rows = builds.ft_sale(
        newest(warehouse, "carts"), products, clients, warehouse.id_type, lines, rejects=True, reduce_products=warehouse.reduces("dim_product"), members=members
    )
    result = merge(warehouse, FT_SALE, rows, unique=True, touches=sold_to(warehouse))
    log.info("silver.ft_sale: lines %s, members %s", lines.get, members.get)
    return result


def run_sales_by_client(warehouse: Warehouse, measure: str = builds.MEASURE) -> MergeResult:
    """Bring the totals up to date: those of the clients that batches touched since the last time, or all of them
    where there are none yet or where the last ones summed another measure.

    The touched clients are forgotten only after their totals are in place, so a failed run loses none.
    """
    # the surrogate only joins here, so it travels packed
    short = lambda rows: rows.withColumn("sk_client", packed("sk_client"))
    sales, clients = short(warehouse.read("silver", "ft_sale")), short(warehouse.read("silver", "dim_client"))
    touched = warehouse.touched("clients")
    known = warehouse.exists("gold", "sales_by_client") and touched is not None and last_measure(warehouse) == measure
    if known:
        members = short(touched).distinct()
        rows = builds.sales_by_client(builds.sales_of(sales, members), builds.sales_of(clients, members), measure)
        result = merge(warehouse, SALES_BY_CLIENT, rows, unique=True, detail=measure)
    else:
        report = Observation()
        rows = builds.sales_by_client(sales, clients, measure, report)
        result = merge(warehouse, SALES_BY_CLIENT, rows, report, unique=True, detail=measure)
    warehouse.forget_touched("clients")
    return result


def last_measure(warehouse: Warehouse) -> str | None:
    """What the totals sum, from the table of runs."""
    last = warehouse.newest_runs().filter((F.col("step") == "merge") & (F.col("table") == "gold.sales_by_client")).first()
    return last.detail if last else None


def run_all(
    warehouse: Warehouse, landed: Mapping[str, DataFrame], batch_time: str, allow_incomplete: bool = False
) -> list[IngestResult | MergeResult]:
    """Ingest ``landed`` (entity to pages), then dimensions, facts and totals, in that order; landings side by side.

    A landing that lacks records raises in front of the tables, which stay as they are, unless ``allow_incomplete``.
    What was ingested stays in bronze.
    """
    landings = together(
        warehouse.spark, (partial(ingest, warehouse, entity, landed[entity], batch_time) for entity in ENTITIES if entity in landed)
    )
    lacking = [result for result in landings if not result.complete]
    if lacking and not allow_incomplete:
        raise QualityError(f"incomplete landings, no table was refreshed: {lacking}")
    return landings + refresh(warehouse)


def refresh(warehouse: Warehouse) -> list[MergeResult]:
    """Bring every table up to the newest bronze batches; the dimensions side by side."""
    dimensions = together(warehouse.spark, (partial(step, warehouse) for step in (run_dim_client, run_dim_product)))
    return dimensions + [run_ft_sale(warehouse), run_sales_by_client(warehouse)]
