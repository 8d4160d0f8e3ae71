"""One query per operator. Each takes ``(spark, sf_dir)`` and returns a lazy frame of scalar columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from saleskiln import functions as K
from saleskiln.operators import (
    UpsertRule,
    drop_null_keys,
    duplicate_keys,
    explode_lines,
    keep_latest,
    keep_latest_by_aggregate,
    latest_batch,
    likely_known,
    lookup_key,
    merge_metrics,
    newest_batch_time,
    parse_records,
    project_fields,
    quality_report,
    resolved,
    total_by_member,
    upsert,
    upsert_small_batch,
)
from saleskiln.operators.parse import REJECT, REJECTED_TEXT
from saleskiln.plans import builds, runs
from saleskiln.plans.contracts import DIM_CLIENT, FT_SALE, TableContract
from saleskiln.sources.bronze import with_batch
from saleskiln.sources.pages import coverage_findings, page_records, page_report, read_pages, staged_pages
from saleskiln.sources.schemas import BATCH_COLUMN, prune, user_schema
from saleskiln.sources.tables import Warehouse
from workload import adapter
from workload.adapter import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ID = "bigint"


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# --- whole builds -------------------------------------------------------------------------------


def totals(spark: SparkSession, sf_dir: str, ungated: bool = False) -> DataFrame:
    """Totals per client; ``ungated`` ones also of clients whose id got lost, here every fiftieth."""
    users = adapter.raw_users(spark, sf_dir)
    products = builds.dim_product(adapter.raw_products(spark, sf_dir), ID, only=["product_id"])
    known = builds.dim_client(users, ID, only=["client_id"])
    named = builds.dim_client(users, ID, only=["client_id", "client_first_name", "client_last_name"])
    if ungated:
        named = named.withColumn("client_id", F.when(F.col("client_id") % 50 != 0, F.col("client_id")))
    sales = builds.ft_sale(adapter.raw_carts(spark, sf_dir, grouped=True), products, known, ID, row_ids=False)
    return builds.client_totals(sales, named) if ungated else builds.sales_by_client(sales, named)


@query
def sales_by_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw users, products and carts of several lines to totals per client, in one plan."""
    return totals(spark, sf_dir)


@query
def dim_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of the newest of two batches, in which some have two records."""
    newest = latest_batch(adapter.raw_users(spark, sf_dir, newest="balance >= 0", repeats=True))
    return plain(builds.dim_client(newest, ID))


@query
def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = latest_batch(adapter.raw_products(spark, sf_dir, newest="brand <> 'Brand#1'", repeats=True))
    return plain(builds.dim_product(newest, ID))


@query
def ft_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale facts of the newest of two batches; some clients and products are unknown."""
    newest = adapter.newest_carts(spark, sf_dir, newest="status <> 'F'")
    users = latest_batch(adapter.raw_users(spark, sf_dir, newest="balance >= 0"))
    parts = latest_batch(adapter.raw_products(spark, sf_dir, newest="brand <> 'Brand#1'"))
    clients = builds.dim_client(users, ID, only=["client_id"])
    products = builds.dim_product(parts, ID, only=["product_id"])
    return plain(builds.ft_sale(newest, products, clients, ID))


@query
def sale_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fact build leaves out: repeated lines, lines of unknown members."""
    users = latest_batch(adapter.raw_users(spark, sf_dir, newest="balance >= 0"))
    parts = latest_batch(adapter.raw_products(spark, sf_dir, newest="brand <> 'Brand#1'"))
    clients = builds.dim_client(users, ID, only=["client_id"])
    products = builds.dim_product(parts, ID, only=["product_id"])
    return builds.sale_audit(adapter.raw_carts(spark, sf_dir), products, clients, ID)


@query
def totals_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality report on the totals, in front of the gate."""
    return quality_report(totals(spark, sf_dir, ungated=True), "client_id")


def settled(warehouse: Warehouse, frame: DataFrame) -> DataFrame:
    """``frame`` stored by itself, so that the trial warehouse it comes from can go."""
    folder = f"{warehouse.root}/result"
    frame.write.parquet(folder)
    warehouse.drop()
    warehouse.drop_folder(f"{warehouse.root}/landing")
    return warehouse.spark.read.schema(frame.schema).parquet(folder)


def trial_rounds(spark: SparkSession, sf_dir: str, entities: tuple[str, ...]) -> list[tuple[str, dict[str, DataFrame]]]:
    """Records of two rounds: the first knows the clients with a balance and brings the carts with status F, the
    second all clients and the other carts."""
    users, products, carts = (
        adapter.user_fields(spark, sf_dir),
        adapter.product_fields(spark, sf_dir),
        adapter.cart_fields(spark, sf_dir, grouped=True),
    )
    rounds = [
        (adapter.OLD_BATCH_TIME, {"users": users.filter("balance >= 0"), "products": products, "carts": carts.filter("status = 'F'")}),
        (adapter.BATCH_TIME, {"users": users, "products": products, "carts": carts.filter("status <> 'F'")}),
    ]
    return [(time, {name: records[name] for name in entities}) for time, records in rounds]


def landed(warehouse: Warehouse, number: int, records: dict[str, DataFrame]) -> dict[str, DataFrame]:
    def pages(name: str) -> DataFrame:
        base = f"{warehouse.root}/landing/{number}/{name}"
        folder = adapter.land_pages(adapter.raw(records[name], name), name, base)
        warehouse.drop_folder(f"{base}/records")
        return read_pages(warehouse.spark, folder, one_page_per_line=True)

    return dict(zip(records, runs.together(warehouse.spark, [partial(pages, name) for name in records])))


@query
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of landed page files, ingest, upserts and totals in a warehouse of its own; the final totals.

    Lines of round one whose client was unknown then stay out.
    """
    warehouse = Warehouse.scratch(spark, id_type=ID)
    for number, (batch_time, records) in enumerate(trial_rounds(spark, sf_dir, ("users", "products", "carts"))):
        runs.run_all(warehouse, landed(warehouse, number, records), batch_time)
        warehouse.drop_folder(f"{warehouse.root}/landing/{number}")
    return settled(warehouse, warehouse.read("gold", "sales_by_client"))


@query
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two rounds of users leave in the table of runs."""
    warehouse = Warehouse.scratch(spark, id_type=ID)
    for number, (batch_time, records) in enumerate(trial_rounds(spark, sf_dir, ("users",))):
        runs.ingest(warehouse, "users", landed(warehouse, number, records)["users"], batch_time)
        runs.run_dim_client(warehouse)
    return settled(warehouse, warehouse.read("ops", "runs").drop("logged_at"))


def plain(df: DataFrame) -> DataFrame:
    """Batch time as date, so that the result does not depend on a session's time zone handling."""
    return df.withColumn(BATCH_COLUMN, F.to_date(BATCH_COLUMN))


# --- landing and bronze -------------------------------------------------------------------------


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of order records; those in the last fifth of the key range came without the list."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    last_key = orders.agg(F.max("o_orderkey")).scalar()
    offset = F.floor(F.col("o_orderkey") / 100) * 100
    # At most 100 records per page also where a key repeats: the block number bounds the group.
    block = F.floor(F.monotonically_increasing_id() / 100)
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("userId")))
    pages = (
        orders.select(offset.alias("page_offset"), block.alias("block"), record.alias("record"))
        .groupBy("page_offset", "block")
        .agg(F.collect_list("record").alias("records"))
    )
    good = F.concat(F.lit('{"carts": ['), F.concat_ws(", ", "records"), F.lit('], "total": '), (last_key + 1).cast("string"))
    tail = F.concat(F.lit(', "skip": '), F.col("page_offset").cast("string"), F.lit("}"))
    broken = F.col("page_offset") * 5 >= last_key * 4
    return pages.select(
        F.when(broken, F.concat(F.lit('{"message": "try later"'), tail)).otherwise(F.concat(good, tail)).alias("body"),
        F.concat(F.lit("landing/carts/skip="), F.col("page_offset").cast("string")).alias("page_source"),
    )


@query
def page_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the pages in front of the first broken page."""
    records = page_records(order_pages(spark, sf_dir), "carts")
    return records.select("raw_json", "page_source", "page_offset")


@query
def page_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = page_report(order_pages(spark, sf_dir), "carts")
    return report.select("first_broken_offset", "records_held", "records_announced")


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a hundred order records at most, with faults: every tenth is missing, every seventh landed before with
    fewer records, and some name an offset that lies 50 before their own."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    last_key = orders.agg(F.max("o_orderkey")).scalar()
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("userId")))
    pages = orders.select((F.floor(F.col("o_orderkey") / 100) * 100).alias("at"), record.alias("record")).groupBy("at").agg(F.collect_list("record").alias("records"))
    pages = pages.filter("at % 1000 <> 300").withColumn("named", F.expr("IF(at % 1100 = 200, at - 50, at)"))
    sizes = F.expr("explode(IF(at % 700 = 0, array(60, 100), array(100)))")
    texts = pages.select("named", "records", sizes.alias("size")).select("named", F.concat_ws(", ", F.slice("records", F.lit(1), F.col("size"))).alias("texts"))
    return texts.select(
        F.concat(F.lit('{"carts": ['), "texts", F.lit('], "total": '), (last_key + 1).cast("string"), F.lit(', "skip": '), F.col("named").cast("string"), F.lit("}")).alias("body"),
        F.concat(F.lit("landing/carts/skip="), F.col("named").cast("string")).alias("page_source"),
    )


@query
def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, overlaps and repeats among the offsets of a landing."""
    warehouse = Warehouse.scratch(spark)
    name = warehouse.stage(staged_pages(landed_pages(spark, sf_dir), "carts", Observation()), "pages")
    return settled(warehouse, coverage_findings(spark.read.table(name)))


@query
def landing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a faulty landing as they are ingested: those of a page that landed twice come once."""
    warehouse = Warehouse.scratch(spark)
    runs.ingest(warehouse, "carts", landed_pages(spark, sf_dir), adapter.BATCH_TIME)
    return settled(warehouse, warehouse.read("bronze", "carts").select("raw_json", "source"))


@query
def bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one bronze table, read back."""
    warehouse = Warehouse.scratch(spark)
    events = table(spark, sf_dir, "events").select(
        F.to_json(F.struct("event_id", "user_id", "event_type")).alias("raw_json"), "event_type"
    )
    for batch_time, part in (
        (adapter.OLD_BATCH_TIME, events.filter("event_type = 'purchase'")),
        (adapter.BATCH_TIME, events.filter("event_type <> 'purchase'")),
    ):
        warehouse.append_batch("carts", with_batch(part, batch_time, F.lit("events"), row_id_from=["raw_json"]))
    return settled(warehouse, warehouse.read("bronze", "carts"))


@query
def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text with batch metadata: repeatable ids, lineage, batch time."""
    products = table(spark, sf_dir, "part").select(
        F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))).alias("raw_json")
    )
    return with_batch(products, adapter.BATCH_TIME, F.lit("products"), row_id_from=["raw_json"])


@query
def batch_high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = table(spark, sf_dir, "events").select(K.batch_time_text("ts").alias(BATCH_COLUMN))
    return newest_batch_time(stamped)


@query
def latest_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return latest_batch(orders, "o_orderdate").withColumn("o_orderdate", F.to_date("o_orderdate"))


# --- parsing and projection ---------------------------------------------------------------------


@query
def parse_json_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return parse_records(events, StructType.fromDDL("k int"), text="props")


@query
def parse_json_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-off text, wrong types and overflows: NULL fields, no lost rows."""
    key = F.col("event_id")
    dirty = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"id": '), key.cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"id": "x", "user": '), F.col("user_id").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"id": 4294967296, "user": '), F.col("user_id").cast("string"), F.lit("}")))
        .when(F.col("event_type") == "signup", F.lit(None).cast("string"))
        .otherwise(F.to_json(F.struct(key.alias("id"), F.col("user_id").alias("user"), F.lit(1).alias("surplus"))))
    )
    events = table(spark, sf_dir, "events").select("event_id", dirty.alias("raw_json"))
    return parse_records(events, StructType.fromDDL("id int, user int"))


@query
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields two to four levels deep, parsed with a schema cut down to them."""
    fields = [
        ("client_id", "id", ID),
        ("city", "address.city", "same"),
        ("latitude", "address.coordinates.lat", "double"),
        ("office_city", "company.address.city", "upper"),
        ("office_longitude", "company.address.coordinates.lng", "double"),
    ]
    schema = prune(user_schema(ID), [path for _, path, _ in fields])
    users = adapter.raw_users(spark, sf_dir).select("raw_json")
    return project_fields(parse_records(users, schema), fields)


@query
def explode_cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cart texts with several lines each, and empty carts, to one row per line."""
    block = F.floor(F.monotonically_increasing_id() / 8192)
    filled = (
        table(spark, sf_dir, "lineitem")
        .select(F.col("l_orderkey").alias("id"), block.alias("block"), F.expr(adapter.LINE).alias("line"))
        .groupBy("id", "block")
        .agg(F.collect_list("line").alias("products"))
        .drop("block")
    )
    empty = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.array().cast(filled.schema["products"].dataType).alias("products")
    )
    carts = filled.unionByName(empty).select(F.to_json(F.struct("id", "products")).alias("raw_json"))
    schema = StructType.fromDDL("id bigint, products array<struct<id:bigint,quantity:int,price:double,discountedTotal:double>>")
    lines = explode_lines(parse_records(carts, schema), "products")
    fields = [
        ("cart_id", "id", "same"),
        ("product_id", "line.id", "same"),
        ("quantity", "line.quantity", "same"),
        ("unit_price", "line.price", "same"),
        ("net_amount", "line.discountedTotal", "same"),
    ]
    return project_fields(lines, fields)


# --- column functions ---------------------------------------------------------------------------


@query
def line_hash_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of two parts, and of the same with the first part NULL on some rows."""
    first = F.when(F.col("l_returnflag") != "R", F.col("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        K.hash_key("l_orderkey", "l_partkey").alias("hash_id"),
        K.hash_key(first, "l_partkey").alias("hash_with_null"),
    )


@query
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", K.surrogate_key("client", "s_suppkey").alias("sk_client"))


@query
def clean_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        K.clean_upper(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name_clean"),
        K.clean_upper(F.lower("p_type")).alias("type_clean"),
    )


@query
def clean_lower_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        K.clean_lower(F.concat(F.lit(" "), "p_brand", F.lit("  "))).alias("brand_lower"),
        K.trimmed(F.concat(F.lit(" \t"), "p_type", F.lit(" "))).alias("type_trimmed"),
    )


def phone_text() -> Column:
    key = F.col("c_custkey").cast("string")
    return (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("+"), key, F.lit(" (11) +"), F.substring("c_name", 10, 20)))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" +"), key, F.lit("-1")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit("+"), F.repeat(F.lit("1 "), 60), key))
        .when(F.col("c_mktsegment") == "FURNITURE", F.concat(F.repeat(F.lit("2-"), 60), key))
    )


@query
def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = table(spark, sf_dir, "customer").select("c_custkey", phone_text().alias("phone"))
    return phones.select("c_custkey", K.phone_digits("phone").alias("phone_clean"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a NULL key here and there and some malformed or missing addresses."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 97 != 0, key).alias("client_id"),
        F.when(key % 13 == 0, F.when(key % 2 == 0, "bad-mail").otherwise("a b@c.d"))
        .when(key % 7 != 0, F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")))
        .alias("client_email"),
    )


@query
def adult_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    ages = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 11 != 0, key % 90).alias("age"))
    return ages.select("c_custkey", K.adult_flag("age").alias("is_adult"))


@query
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"BUILDING": "B", "MACHINERY": "M", "HOUSEHOLD": "H"}
    label = F.concat(F.lit(" "), F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", K.code_map(label, codes).alias("segment_code"))


@query
def safe_date_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = F.concat_ws("-", F.year(day), F.month(day), F.dayofmonth(day))
    bad = F.col("o_orderpriority").startswith("1")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(bad, "not a date").otherwise(text).alias("day_text"),
        F.when(bad, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd 12:30:00")).alias("time_text"),
        F.when(bad, "x").otherwise(F.floor("o_totalprice").cast("string")).alias("number_text"),
    )
    return orders.select(
        "o_orderkey",
        K.to_date_safe("day_text").alias("day"),
        K.batch_time_text(K.to_timestamp_safe("time_text")).alias("moment"),
        K.safe_cast("number_text", "int").alias("whole_price"),
    )


@query
def email_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("client_id", "client_email", K.invalid_email("client_email").alias("is_invalid"))


# --- rows: quality, keys, lookups ---------------------------------------------------------------


@query
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(people(spark, sf_dir), "client_id", {"invalid_emails": K.invalid_email("client_email")})


@query
def null_key_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_null_keys(people(spark, sf_dir), "client_id")


@query
def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_suppkey"
    )
    latest = keep_latest(lines, ["l_orderkey", "l_partkey"], "l_shipdate", ["l_extendedprice", "l_quantity", "l_suppkey"])
    return latest.withColumn("l_shipdate", F.to_date("l_shipdate"))


@query
def latest_by_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest line of each part, of equal ones that of the smallest flag, supplier and order: many rows a key."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", "l_returnflag", "l_suppkey", "l_orderkey")
    return keep_latest_by_aggregate(lines, ["l_partkey"], "l_extendedprice", ["l_returnflag", "l_suppkey", "l_orderkey"])


@query
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query
def fact_dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with both surrogates; small parts and suppliers in the black are the known members."""
    parts = table(spark, sf_dir, "part").filter("p_size <= 40")
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal >= 0")
    products = parts.select(F.col("p_partkey").alias("product_id"), K.surrogate_key("product", "p_partkey").alias("sk_product"))
    clients = suppliers.select(F.col("s_suppkey").alias("client_id"), K.surrogate_key("client", "s_suppkey").alias("sk_client"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cart_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("client_id"),
        F.col("l_extendedprice").alias("unit_price"),
    )
    found = lookup_key(lookup_key(lines, products, "product_id", "sk_product"), clients, "client_id", "sk_client")
    return resolved(found, "sk_product", "sk_client")


@query
def reduced_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of the small parts, most of the others dropped by a bitmap of keys ahead of the lookup."""
    parts = table(spark, sf_dir, "part").filter("p_size <= 10")
    products = parts.select(F.col("p_partkey").alias("product_id"), K.surrogate_key("product", "p_partkey").alias("sk_product"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("unit_price")
    )
    return resolved(lookup_key(likely_known(lines, products, "product_id"), products, "product_id", "sk_product"), "sk_product")


@query
def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every raw customer record: used, or rejected for a reason, with its text."""
    key = F.col("c_custkey")
    whole = F.to_json(F.struct(F.when(key % 97 != 0, key).alias("id"), F.col("c_name").alias("firstName")))
    text = (
        F.when(key % 31 == 0, F.substring(whole, 1, 9))
        .when(key % 29 == 0, F.concat(F.lit('{"id":"x'), key.cast("string"), F.lit('","firstName":"y"}')))
        .when(key % 23 != 0, whole)
    )
    raw = table(spark, sf_dir, "customer").select(text.alias("raw_json"), key.cast("string").alias("origin"))
    rows = builds.dim_client(with_batch(raw, adapter.BATCH_TIME, "origin", row_id_from=["origin"]), ID, only=["client_id"], rejects=True)
    return rows.select("client_id", "row_id", REJECT, REJECTED_TEXT)


@query
def member_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per part of the known parts: sum of line prices, not times the quantity."""
    parts = table(spark, sf_dir, "part").filter("p_size <= 40").withColumnRenamed("p_partkey", "l_partkey")
    return total_by_member(
        table(spark, sf_dir, "lineitem"), parts, "l_partkey", ["p_name", "p_brand", "l_partkey"], "l_extendedprice", "total"
    )


# --- upsert -------------------------------------------------------------------------------------

RULE = UpsertRule(("client_id",), ("first_seen",), "updated_timestamp")


def upsert_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored clients (balance below 6000) and a batch (balance from 2000), with an overlap."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )
    target = customers.filter("balance < 6000").select(
        "*", F.lit("old").alias("first_seen"), F.lit(None).cast("timestamp").alias("updated_timestamp")
    )
    source = customers.filter("balance >= 2000").select(
        "client_id",
        F.upper("name").alias("name"),
        F.when(F.col("segment") != "BUILDING", F.col("segment")).alias("segment"),
        (F.col("balance") + 1).alias("balance"),
        F.lit("new").alias("first_seen"),
    )
    return target, source


def upsert_result(merged: DataFrame) -> DataFrame:
    return merged.withColumn("was_updated", F.col("updated_timestamp").isNotNull()).drop("updated_timestamp")


@query
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_result(upsert(*upsert_sides(spark, sf_dir), RULE))


@query
def upsert_small_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_result(upsert_small_batch(*upsert_sides(spark, sf_dir), RULE))


@query
def upsert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts by action, and lookups of a reported and an unreported metric."""
    counts = merge_metrics(upsert(*upsert_sides(spark, sf_dir), RULE))
    reported = F.create_map(F.lit("rows_inserted"), F.col("rows_inserted").cast("string"))
    return counts.withColumn("inserted_text", K.metric_or_missing(reported, "rows_inserted")).withColumn(
        "deleted_text", K.metric_or_missing(reported, "rows_deleted")
    )


CLIENTS = TableContract(
    "silver", "clients", "client_id bigint, name string, segment string, balance double, first_seen string, updated_timestamp timestamp", RULE
)


@query
def upsert_dealt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a table dealt by key, of which only the touched partitions are replaced."""
    warehouse = Warehouse.scratch(spark, partitions=16)
    target, source = upsert_sides(spark, sf_dir)
    runs.merge(warehouse, CLIENTS, target.drop("updated_timestamp"), unique=True)
    runs.merge(warehouse, CLIENTS, source, unique=True)
    return settled(warehouse, upsert_result(warehouse.read("silver", "clients")))


@query
def touched_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches of facts, each time of the touched clients only. The third batch brings some lines
    of the first again, dearer and sold to the next client."""
    warehouse = Warehouse.scratch(spark, id_type=ID, buckets=8)
    customers = table(spark, sf_dir, "customer")
    clients = customers.select(
        K.surrogate_key("client", "c_custkey").alias("sk_client"), F.col("c_custkey").alias("client_id"),
        F.col("c_mktsegment").alias("client_first_name"), F.col("c_name").alias("client_last_name"),
    )
    runs.merge(warehouse, DIM_CLIENT, clients, unique=True)
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    prices = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_extendedprice").alias("price"))
    lines = prices.join(owners, F.expr("o_orderkey = l_orderkey"))

    def facts(rows: DataFrame, owner: str, price: str) -> DataFrame:
        return rows.select(
            K.hash_key("l_orderkey", "l_partkey").alias("hash_id"), K.surrogate_key("client", F.expr(owner)).alias("sk_client"), F.expr(price).alias("unit_price")
        )

    again = facts(lines.filter("l_orderkey % 15 = 0"), "o_custkey + 1", "price + 1")
    batches = [facts(lines.filter(f"l_orderkey % 3 = {k}"), "o_custkey", "price") for k in range(3)]
    for batch in (batches[0], batches[1], batches[2].unionByName(again)):
        runs.merge(warehouse, FT_SALE, batch, unique=True, touches=runs.sold_to(warehouse))
        runs.run_sales_by_client(warehouse)
    return settled(warehouse, warehouse.read("gold", "sales_by_client"))
