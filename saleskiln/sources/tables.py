"""Layer tables in the session catalog.

Bronze tables are appended to. Upserted tables are kept as immutable versions: each upsert writes a
new table and then moves the view that carries the public name, so readers see the old version or the
new one and a failed job leaves nothing behind the name. Where the configured format can MERGE by
itself (Delta, Iceberg and the like) the table is an ordinary one and versions are not used.

With ``partitions`` set, an upserted table is one table dealt by a hash of its key, and an upsert replaces only
the partitions its batch touches. Such a replacement is not atomic: readers may meet new and old partitions
side by side, and a failed job may leave them so. What was to be written is therefore stored first, and stays
until all of it is in place; the next upsert puts it in place before anything else.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from saleskiln.functions.keys import packed, unpacked
from saleskiln.sources.schemas import BATCH_COLUMN, BRONZE_DDL

CHECKPOINT_SETTING = "spark.checkpoint.dir"
LAYERS = ("bronze", "silver", "gold", "staging", "ops")
PART = "key_part"
#: Columns of digests, which travel packed.
DIGESTS = ("hash_id", "sk_client", "sk_product", "row_id")
#: Files of a bucket when its table is dealt anew, and how many times as large it may grow until then.
BUCKET_BYTES, BUCKET_GROWTH = 32 << 20, 4
#: Held while a table that several steps share is written: appends to one folder clean up behind each other, and how
#: partitions are overwritten is a setting of the session.
SHARED_WRITES = threading.RLock()
RUNS_DDL = (
    "logged_at timestamp, step string, table string, rows_written bigint, source_rows bigint, rows_inserted bigint, "
    "rows_updated bigint, complete boolean, detail string"
)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's setting, else the session's warehouse, which on a cluster
    must not be a folder of the driver's machine."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.conf.get("spark.sql.warehouse.dir")
    if named.startswith("file:") and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{named} is not shared by the executors; set {CHECKPOINT_SETTING}")
    return named.rstrip("/")


def parse_bytes(size: str) -> int:
    """Bytes of a Spark size such as 10485760b or 10MB."""
    number = size.rstrip("kmgtb")
    return int(number) << 10 * " kmgt".index((size[len(number) :] + " ")[0].replace("b", " "))


def with_packed(rows: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their digests packed, other than those named."""
    return rows.withColumns({name: packed(name) for name in digests_of(rows, but)})


def with_unpacked(rows: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    """The rows that ``with_packed`` was given."""
    return rows.withColumns({name: unpacked(name) for name in digests_of(rows, but)})


def digests_of(rows: DataFrame, but: Sequence[str] = ()) -> list[str]:
    return [name for name in DIGESTS if name in rows.columns and name not in but]


def dealt_by(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``rows`` in ``count`` parts as a table of so many buckets on ``key`` has them; digests travel packed."""
    short = with_packed(rows)
    return with_unpacked(short.repartition(count, unpacked(key) if key in digests_of(rows) else F.col(key)))


def compact(rows: DataFrame, fmt: str = "parquet") -> DataFrameWriter:
    """Writer of a format; parquet with zstd, which halves hexadecimal digests, where the default leaves them as they are."""
    writer = rows.write.format(fmt)
    return writer.option("compression", "zstd") if fmt == "parquet" else writer


def fresh_suffix() -> str:
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:6]}"


@dataclass(frozen=True)
class Warehouse:
    """Where the layers live: ``<prefix><layer>.<table>``, stored below ``root``.

    ``buckets`` is the smallest bucket count of bucketed contracts (0 = none); a table that outgrows it is dealt to a
    multiple of it. A staged batch within both ``small_batch_bytes`` (of files) and
    ``small_batch_rows`` is merged by broadcasting it. ``partitions`` (0 = none) deals upserted tables by their
    key, so that a batch rewrites only what it touches; it takes the place of versions and buckets.
    """

    spark: SparkSession
    root: str
    prefix: str = ""
    fmt: str = "parquet"
    native_merge: bool = False
    id_type: str = "bigint"
    buckets: int = 0
    small_batch_bytes: int = 16 << 20
    small_batch_rows: int = 500_000
    keep_versions: int = 2
    partitions: int = 0

    @classmethod
    def open(cls, spark: SparkSession, root: str, **options) -> Warehouse:
        warehouse = cls(spark, root.rstrip("/"), **options)
        for layer in LAYERS:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {warehouse.database(layer)} LOCATION '{warehouse.root}/{layer}'")
        return warehouse

    @classmethod
    def scratch(cls, spark: SparkSession, **options) -> Warehouse:
        """A warehouse of its own under the shared folder, for trial runs."""
        suffix = fresh_suffix()
        return cls.open(spark, f"{shared_folder(spark)}/kiln_{suffix}", prefix=f"kiln_{suffix}_", **options)

    @property
    def dealt(self) -> bool:
        """Whether upserted tables are dealt by key and replaced by partition."""
        return self.partitions > 0 and not self.native_merge

    def drop(self) -> None:
        """Remove the databases with all their tables; files beside them below ``root`` stay."""
        for layer in LAYERS:
            self.spark.sql(f"DROP DATABASE IF EXISTS {self.database(layer)} CASCADE")

    def drop_folder(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def database(self, layer: str) -> str:
        return f"{self.prefix}{layer}"

    def name(self, layer: str, table: str) -> str:
        return f"{self.database(layer)}.{table}"

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.read.table(self.name(layer, table))

    def exists(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(layer, table))

    def append_batch(self, table: str, batch: DataFrame) -> None:
        """Append a bronze frame, one partition per batch so that newest-batch reads prune the rest."""
        name = self.name("bronze", table)
        columns = StructType.fromDDL(BRONZE_DDL).fieldNames()
        writer = compact(batch.select(*columns), self.fmt).mode("append")
        writer.partitionBy(BATCH_COLUMN).saveAsTable(name)

    def batches(self, table: str) -> DataFrame:
        """Batch times of a bronze table, from the catalog's partitions: one row per batch, and no data file is opened.
        A format with its own MERGE keeps its own partition list, so there the column itself is read."""
        if self.native_merge:
            return self.read("bronze", table).select(BATCH_COLUMN)
        listed = self.spark.sql(f"SHOW PARTITIONS {self.name('bronze', table)}")
        value = F.regexp_replace(F.substring_index("partition", "=", -1), r"\+", "%2B")
        named = listed.filter(value != "__HIVE_DEFAULT_PARTITION__")
        return named.select(F.url_decode(value).alias(BATCH_COLUMN))

    def batch_rows(self, table: str, batch_time: str) -> int:
        """Rows stored of one batch; reads file footers of that partition only."""
        return self.read("bronze", table).filter(F.col(BATCH_COLUMN) == batch_time).count()

    def stage(self, batch: DataFrame, table: str, bucket_key: str | None = None, buckets: int | None = None) -> str:
        """Write a batch to the staging layer: its plan runs once, and lineage ends on shared storage.

        With ``bucket_key`` it is bucketed as the table is that it goes into (``buckets``, else as many as the warehouse
        has; 0 = not), one file per bucket, so that the join with that table needs no exchange on either side.
        """
        name = self.name("staging", f"{table}_{fresh_suffix()}")
        count = self.buckets if buckets is None else buckets
        if bucket_key and count:
            compact(dealt_by(batch, bucket_key, count)).bucketBy(count, bucket_key).sortBy(bucket_key).saveAsTable(name)
        else:
            compact(batch).saveAsTable(name)
        return name

    def buckets_of(self, layer: str, table: str) -> int:
        """Buckets of the published version; 0 without one."""
        version = self.published(layer, table)
        if not version:
            return 0
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {version}").filter("col_name = 'Num Buckets'").first()
        return int(described.data_type) if described else 0

    def buckets_for(self, size: int, now: int = 0) -> int:
        """Buckets for a table of ``size`` bytes that has ``now``: as it is while its buckets are small enough, else a multiple
        of ``buckets``. A bucket is sorted by one task, which a large one makes spill all of it."""
        if now and size <= now * BUCKET_BYTES * BUCKET_GROWTH:
            return now
        count = self.buckets
        while size > count * BUCKET_BYTES:
            count *= 2
        return max(count, now)

    def stored_bytes(self, name: str) -> int:
        """Size of a table's files, taken from the file system without reading them."""
        self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS NOSCAN")
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
        statistics = described.filter("col_name = 'Statistics'").first()
        return int(statistics.data_type.split()[0])

    def drop_staged(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def free_exchanges(self) -> None:
        """Have the files of finished exchanges removed: Spark does so when the driver's memory is swept, by itself only
        every half hour or as the heap fills, and until then those of all steps add up on the executors' disks."""
        self.spark._jvm.System.gc()

    def create_empty(self, layer: str, table: str, schema: StructType) -> None:
        """Create a table of a MERGE-capable format from its contract if it does not exist."""
        if not self.exists(layer, table):
            self.spark.createDataFrame([], schema).write.format(self.fmt).saveAsTable(self.name(layer, table))

    def write_version(self, layer: str, table: str, rows: DataFrame, bucket_key: str | None = None, buckets: int | None = None) -> str:
        """Store ``rows`` as a new version and return its table name; the public name still shows the old one."""
        version = self.name(layer, f"{table}__v{fresh_suffix()}")
        writer = compact(rows, self.fmt)
        count = self.buckets if buckets is None else buckets
        if bucket_key and count:
            writer = writer.bucketBy(count, bucket_key).sortBy(bucket_key)
        writer.saveAsTable(version)
        return version

    def publish(self, layer: str, table: str, version: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(layer, table)} AS SELECT * FROM {version}")

    def versions(self, layer: str, table: str) -> list[str]:
        """Version tables, oldest first."""
        found = self.spark.sql(f"SHOW TABLES IN {self.database(layer)} LIKE '{table}__v*'").collect()
        return sorted(self.name(layer, row.tableName) for row in found)

    def published(self, layer: str, table: str) -> str | None:
        """Version the public name shows, or None without one."""
        if not self.exists(layer, table):
            return None
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(layer, table)}").filter("col_name = 'View Text'").first()
        return described.data_type.rsplit(" ", 1)[-1].replace("`", "") if described else None

    def drop_old_versions(self, layer: str, table: str) -> list[str]:
        """Drop what is older than the published version, but for the newest ``keep_versions`` - 1 of those.

        Versions newer than the published one belong to a refused or a running upsert and are left alone.
        """
        published = self.published(layer, table)
        older = [version for version in self.versions(layer, table) if published and version < published]
        old = older[: len(older) - max(self.keep_versions - 1, 0)] if len(older) >= self.keep_versions else []
        for version in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {version}")
        return old

    # --- tables dealt by key ------------------------------------------------------------------------

    def parts_name(self, layer: str, table: str) -> str:
        return self.name(layer, f"{table}__parts")

    def part_of(self, key: str) -> Column:
        """Partition of a key; the hash is the one Spark shuffles by."""
        return F.pmod(F.hash(key), F.lit(self.partitions)).cast("int")

    def create_parts(self, layer: str, table: str, schema: StructType) -> str:
        """The dealt table behind a public name and the view without its partition column, made if need be."""
        name = self.parts_name(layer, table)
        if not self.spark.catalog.tableExists(name):
            empty = self.spark.createDataFrame([], StructType([*schema.fields, StructField(PART, IntegerType())]))
            empty.write.format("parquet").partitionBy(PART).saveAsTable(name)
        columns = ", ".join(f"`{column}`" for column in schema.fieldNames())
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(layer, table)} AS SELECT {columns} FROM {name}")
        return name

    def touched_parts(self, name: str, batch: DataFrame, key: str) -> DataFrame:
        """Rows of a dealt table in the partitions that ``batch`` has keys of. Which those are is a scalar subquery
        of at most ``partitions`` numbers, by which the scan is pruned at run time; nothing else is listed or read."""
        touched = batch.agg(F.collect_set(self.part_of(key)).alias("parts"))
        return self.spark.read.table(name).where(F.array_contains(touched.scalar(), F.col(PART)))

    def pending_name(self, layer: str, table: str) -> str:
        return self.name("ops", f"pending__{layer}__{table}")

    def store_pending(self, layer: str, table: str, rows: DataFrame) -> str:
        """Keep what is to replace partitions until it has; only a finished write gets the name."""
        name = self.pending_name(layer, table)
        compact(rows.hint("rebalance", PART)).saveAsTable(name)
        return name

    def replace_parts(self, layer: str, table: str) -> bool:
        """Put pending rows in place: their partitions are overwritten, others keep their files. May be repeated."""
        pending = self.pending_name(layer, table)
        if not self.spark.catalog.tableExists(pending):
            return False
        rows = self.spark.read.table(pending)
        self.overwrite_partitions(self.parts_name(layer, table), rows.hint("rebalance", PART))
        self.drop_staged(pending)
        return True

    # --- what runs leave for later ones ---------------------------------------------------------------

    def log_run(self, **entry) -> None:
        """Append one entry to the table of runs."""
        fields = StructType.fromDDL(RUNS_DDL)
        values = [F.current_timestamp() if f.name == "logged_at" else F.lit(entry.get(f.name)) for f in fields]
        row = self.spark.range(0, 1, 1, 1).select(*[value.cast(f.dataType).alias(f.name) for value, f in zip(values, fields)])
        name = self.name("ops", "runs")
        with SHARED_WRITES:
            if self.spark.catalog.tableExists(name):
                row.write.insertInto(name)
            else:
                row.write.format("parquet").saveAsTable(name)

    def newest_runs(self) -> DataFrame:
        """The newest entry of each step and table."""
        entry = F.max_by(F.struct("*"), "logged_at").alias("entry")
        return self.read("ops", "runs").groupBy("step", "table").agg(entry).select("entry.*")

    def store_rejects(self, table: str, rows: DataFrame) -> None:
        """Keep rejected records with their reason, row id and batch. Those of a batch that is built again replace the
        earlier ones, unless it has none now."""
        name = self.name("ops", "rejects")
        found = rows.select(
            "row_id", "reject_reason", F.col("rejected_text").alias("raw_json"), F.lit(table).alias("table"), F.col(BATCH_COLUMN).cast("string").alias("batch")
        )
        with SHARED_WRITES:
            if not self.spark.catalog.tableExists(name):
                found.write.format("parquet").partitionBy("table", "batch").saveAsTable(name)
            else:
                self.overwrite_partitions(name, found)

    def overwrite_partitions(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions of a table that ``rows`` has rows of, and no others."""
        mode = "spark.sql.sources.partitionOverwriteMode"
        with SHARED_WRITES:
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                rows.select(*self.spark.read.table(name).columns).write.insertInto(name, overwrite=True)
            finally:
                self.spark.conf.set(mode, before)

    def reduces(self, table: str) -> bool:
        """Whether a dimension is too large to be broadcast, so that a bitmap of its keys pays."""
        limit = self.spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()
        stored = self.published("silver", table) if not self.dealt else self.parts_name("silver", table)
        if self.native_merge or not stored or limit in ("-1", "-1b"):
            return not self.native_merge
        return self.stored_bytes(stored) > parse_bytes(limit)

    def note_touched(self, what: str, members: DataFrame) -> None:
        """Remember members whose totals have to be made anew."""
        compact(members).mode("append").saveAsTable(self.name("ops", f"touched_{what}"))

    def touched(self, what: str) -> DataFrame | None:
        name = self.name("ops", f"touched_{what}")
        return self.spark.read.table(name) if self.spark.catalog.tableExists(name) else None

    def forget_touched(self, what: str) -> None:
        self.drop_staged(self.name("ops", f"touched_{what}"))
