"""Runs that write: landing files to gold, several batches, failures."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from saleskiln.operators import EmptyTableError, QualityError, latest_batch, upsert
from saleskiln.plans import runs
from saleskiln.plans.contracts import DIM_CLIENT, FT_SALE, SALES_BY_CLIENT
from saleskiln.sources.bronze import with_batch
from saleskiln.sources.pages import page_records, page_report, read_pages
from saleskiln.sources.schemas import BATCH_COLUMN, cart_schema, product_schema, user_schema
from saleskiln.sources.tables import Warehouse
from tests.test_operators import plan_text

FIRST, SECOND = "2024-01-01 06:00:00", "2024-01-02 06:00:00"


def user(key, **more):
    record = {
        "id": key,
        "firstName": f" ann {key} ",
        "lastName": "Lee",
        "age": 17 + (key or 0),
        "gender": "Female",
        "email": "A@B.c",
        "birthDate": "1996-5-30",
        "password": "hidden",
        "ssn": "000-11",
        "address": {"city": "rome", "coordinates": {"lat": 1.5, "lng": -2.5}},
        "company": {"name": "acme", "address": {"city": "oslo"}},
    }
    return record | more


def product(key, **more):
    return {"id": key, "title": f"thing {key}", "category": "toys", "price": 9.5, "stock": 3} | more


def cart(key, owner, *lines):
    products = [
        {"id": i, "price": price, "quantity": 2, "total": 2 * price, "discountedTotal": price} for i, price in lines
    ]
    return {"id": key, "userId": owner, "total": 10.0, "discountedTotal": 9.0, "products": products}


def land(folder, entity, records, per_page=2, total=None, broken_at=None):
    target = folder / entity
    target.mkdir(parents=True)
    for offset in range(0, max(len(records), 1), per_page):
        body = {entity: records[offset : offset + per_page], "total": len(records) if total is None else total, "skip": offset}
        if offset == broken_at:
            body = {"message": "not now"}
        (target / f"skip={offset}.json").write_text(json.dumps(body))
    return str(target)


def landing(spark, folder, users, products, carts):
    named = {"users": users, "products": products, "carts": carts}
    return {name: read_pages(spark, land(folder, name, records)) for name, records in named.items()}


@pytest.fixture
def warehouse(spark):
    return Warehouse.scratch(spark)


def gold(warehouse):
    return {row.client_id: row.total_carrinho for row in warehouse.read("gold", "sales_by_client").collect()}


# --- landing ------------------------------------------------------------------------------------


def test_pages_stop_at_the_first_broken_one(spark, tmp_path):
    carts = [cart(i, 1) for i in range(10)]
    pages = read_pages(spark, land(tmp_path, "carts", carts, broken_at=4))
    records = page_records(pages, "carts").collect()
    assert sorted(json.loads(row.raw_json)["id"] for row in records) == [0, 1, 2, 3]
    assert {row.page_offset for row in records} == {0, 2}
    assert all(row.page_source.endswith(f"skip={row.page_offset}.json") for row in records)
    report = page_report(pages, "carts").first()
    assert (report.pages, report.broken_pages, report.first_broken_offset) == (5, 1, 4)
    assert (report.records_held, report.records_announced) == (8, 10)


@pytest.mark.parametrize("body", ['{"carts": null, "skip": 2}', "<html>busy</html>", ""])
def test_null_list_and_other_bodies_are_broken_pages(spark, body):
    pages = spark.createDataFrame(
        [('{"carts": [{"id": 1, "x": 1.10}], "skip": 0, "total": 9}', "a", 0), (body, "b", 2)],
        "body string, page_source string, name_offset bigint",
    )
    assert [row.raw_json for row in page_records(pages, "carts").collect()] == ['{"id":1,"x":1.1}']


def test_one_page_per_line(spark, tmp_path):
    lines = [json.dumps({"carts": [cart(i, 1)], "total": 3, "skip": i}) for i in range(3)]
    (tmp_path / "all.jsonl").write_text("\n".join(lines))
    pages = read_pages(spark, str(tmp_path), one_page_per_line=True)
    assert sorted(row.page_offset for row in page_records(pages, "carts").collect()) == [0, 1, 2]


def test_ingest_appends_and_reports(spark, tmp_path, warehouse):
    path = land(tmp_path / "a", "carts", [cart(i, 1) for i in range(5)])
    first = runs.ingest(warehouse, "carts", read_pages(spark, path), FIRST)
    assert (first.rows_written, first.records_announced, first.complete) == (5, 5, True)
    again = runs.ingest(warehouse, "carts", read_pages(spark, land(tmp_path / "b", "carts", [cart(9, 1)], total=4)), SECOND)
    assert (again.rows_written, again.complete) == (1, False)
    stored = warehouse.read("bronze", "carts")
    assert stored.count() == 6
    assert stored.select("row_id").distinct().count() == 6
    assert dict(stored.dtypes)["ingestion_timestamp"] == "string"
    with pytest.raises(ValueError):
        runs.ingest(warehouse, "orders", read_pages(spark, path), FIRST)


def test_random_row_ids_are_uuids(spark):
    frame = with_batch(spark.createDataFrame([("{}",), ("{}",)], "raw_json string"), FIRST, F.lit("s"))
    ids = [row.row_id for row in frame.collect()]
    assert len(set(ids)) == 2 and all(len(each) == 36 for each in ids)


def test_newest_batch_read_prunes_partitions(spark, warehouse):
    for stamp in (FIRST, SECOND):
        frame = spark.range(3).select(F.to_json(F.struct("id")).alias("raw_json"))
        warehouse.append_batch("users", with_batch(frame, stamp, F.lit("s")))
    newest = latest_batch(warehouse.read("bronze", "users"))
    assert newest.count() == 3
    physical = plan_text(newest).split("== Physical Plan ==")[1]
    scan = [line for line in physical.splitlines() if "FileScan" in line][0]
    assert "PartitionFilters: [isnotnull(ingestion_timestamp" in scan and "Subquery" in scan


def test_newest_batch_comes_from_the_catalog(spark, warehouse):
    for stamp in (SECOND, "2023-12-31 23:59:59+01:00 %", FIRST):
        frame = spark.range(3).select(F.to_json(F.struct("id")).alias("raw_json"))
        warehouse.append_batch("users", with_batch(frame, stamp, F.lit("s")))
    assert {row[0] for row in warehouse.batches("users").collect()} == {FIRST, SECOND, "2023-12-31 23:59:59+01:00 %"}
    rows = runs.newest(warehouse, "users")
    assert [row[0] for row in rows.select("ingestion_timestamp").distinct().collect()] == [SECOND]
    assert plan_text(rows).split("== Physical Plan ==")[1].count("FileScan") == 1


def test_incomplete_landing_stops_the_run(spark, tmp_path, warehouse):
    landed = landing(spark, tmp_path / "a", [user(1)], [product(1)], [cart(1, 1, (1, 2.0))])
    landed["carts"] = read_pages(spark, land(tmp_path / "b", "carts", [cart(i, 1, (1, 2.0)) for i in range(4)], broken_at=2))
    with pytest.raises(QualityError, match="incomplete"):
        runs.run_all(warehouse, landed, FIRST)
    assert not warehouse.exists("silver", "ft_sale")
    runs.run_all(warehouse, landed, SECOND, allow_incomplete=True)
    assert gold(warehouse) == {1: 4.0}


# --- whole runs ---------------------------------------------------------------------------------


@pytest.mark.parametrize("buckets", [0, 4])
def test_two_batches_end_to_end(spark, tmp_path, buckets):
    warehouse = Warehouse.scratch(spark, buckets=buckets)
    users = [user(1), user(2), user(None), user(2, firstName="bob")]
    products = [product(1), product(2), product(None)]
    carts = [
        cart(10, 1, (1, 5.0), (2, 7.5), (1, 6.0)),
        cart(11, 2, (1, 5.0), (99, 1.0)),
        cart(12, 77, (1, 5.0)),
        cart(13, 1),
    ]
    results = runs.run_all(warehouse, landing(spark, tmp_path / "one", users, products, carts), FIRST)
    by_table = {r.table: r for r in results if isinstance(r, runs.MergeResult)}
    assert by_table["silver.dim_client"].rows_inserted == 2
    assert by_table["silver.dim_product"].rows_inserted == 2
    assert by_table["silver.ft_sale"].rows_inserted == 3
    assert gold(warehouse) == {1: 12.5, 2: 5.0}
    clients = warehouse.read("silver", "dim_client")
    assert clients.columns == DIM_CLIENT.schema().fieldNames()
    assert {row.client_id: row.is_adult for row in clients.collect()} == {1: True, 2: True}
    sales = warehouse.read("silver", "ft_sale")
    assert sales.columns == FT_SALE.schema().fieldNames()
    assert not {"client_id", "product_id"} & set(sales.columns)

    # The same landing again, as a new batch: nothing is inserted, values stay, updates are marked.
    repeat = runs.run_all(warehouse, landing(spark, tmp_path / "two", users, products, carts), SECOND)
    counts = {r.table: (r.rows_inserted, r.rows_updated) for r in repeat if isinstance(r, runs.MergeResult)}
    assert counts == {
        "silver.dim_client": (0, 2),
        "silver.dim_product": (0, 2),
        "silver.ft_sale": (0, 3),
        "gold.sales_by_client": (0, 2),
    }
    assert gold(warehouse) == {1: 12.5, 2: 5.0}
    row = warehouse.read("silver", "ft_sale").first()
    assert str(row.ingestion_timestamp) == FIRST and row.updated_timestamp is not None

    # A third batch changes one line, adds a cart, and does not mention the rest.
    carts = [cart(10, 1, (2, 1.0)), cart(14, 2, (2, 2.0))]
    runs.run_all(warehouse, landing(spark, tmp_path / "three", users[:2], products[:2], carts), "2024-01-03 06:00:00")
    assert gold(warehouse) == {1: 6.0, 2: 7.0}
    assert warehouse.read("silver", "ft_sale").count() == 4
    assert len(warehouse.versions("silver", "ft_sale")) == warehouse.keep_versions
    assert spark.sql(f"SHOW TABLES IN {warehouse.database('staging')}").count() == 0


def test_null_overwrites_on_update(spark, tmp_path, warehouse):
    runs.run_all(warehouse, {"users": read_pages(spark, land(tmp_path / "a", "users", [user(1)]))} | others(spark, tmp_path), FIRST)
    changed = user(1)
    del changed["lastName"]
    runs.ingest(warehouse, "users", read_pages(spark, land(tmp_path / "b", "users", [changed])), SECOND)
    runs.run_dim_client(warehouse)
    row = warehouse.read("silver", "dim_client").first()
    assert row.client_last_name is None and row.client_first_name == "ANN 1"


def others(spark, tmp_path):
    return {
        "products": read_pages(spark, land(tmp_path / "p", "products", [product(1)])),
        "carts": read_pages(spark, land(tmp_path / "c", "carts", [cart(1, 1, (1, 2.0))])),
    }


def test_measure_can_be_chosen(spark, tmp_path, warehouse):
    runs.run_all(warehouse, {"users": read_pages(spark, land(tmp_path / "a", "users", [user(1)]))} | others(spark, tmp_path), FIRST)
    runs.run_sales_by_client(warehouse, measure="gross_amount")
    assert gold(warehouse) == {1: 4.0}


# --- failures -----------------------------------------------------------------------------------


def bronze(spark, warehouse, entity, texts, stamp=FIRST):
    frame = spark.createDataFrame([(text,) for text in texts], "raw_json string")
    warehouse.append_batch(entity, with_batch(frame, stamp, F.lit("test")))


def test_bronze_without_a_batch_is_an_error(spark, warehouse):
    bronze(spark, warehouse, "users", [])
    with pytest.raises(EmptyTableError):
        runs.run_dim_client(warehouse)


def test_rows_without_key_never_reach_the_table(spark, warehouse):
    bronze(spark, warehouse, "users", ["{bad", None, json.dumps(user(3))])
    assert runs.run_dim_client(warehouse).rows_inserted == 1
    bronze(spark, warehouse, "products", ["{bad", json.dumps(product(None))], SECOND)
    assert runs.run_dim_product(warehouse).source_rows == 0


def test_rejected_records_are_kept_with_their_reason(spark, warehouse):
    texts = ["{bad", None, json.dumps(user(3)), json.dumps(user(None)), '{"id": "x", "firstName": "y"}', json.dumps(user(3, firstName="bob"))]
    bronze(spark, warehouse, "users", texts)
    for _ in range(2):
        assert runs.run_dim_client(warehouse).source_rows == 1
        found = warehouse.read("ops", "rejects").filter("table = 'silver.dim_client'").collect()
        assert sorted((r.reject_reason, r.raw_json) for r in found if r.raw_json) == [("no key", texts[3]), ("unreadable", texts[4]), ("unreadable", texts[0])]
        assert [r.reject_reason for r in found if not r.raw_json] == ["no text"]
    ids = {row.row_id for row in warehouse.read("bronze", "users").collect()}
    assert {r.row_id for r in found} < ids and len(ids) == len(texts) == len(found) + 2
    assert {r.batch for r in found} == {FIRST}


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_rejected_carts_do_not_hide_others(spark, warehouse, limit):
    bronze(spark, warehouse, "users", [json.dumps(user(1))])
    bronze(spark, warehouse, "products", [json.dumps(product(1))])
    carts = [json.dumps(cart(7, 1, (1, 2.0), (99, 1.0))), '{"id": 8, "products": [', json.dumps(cart(None, 1, (1, 5.0), (1, 6.0))), json.dumps(cart(9, 1))]
    bronze(spark, warehouse, "carts", carts)
    runs.run_dim_client(warehouse)
    runs.run_dim_product(warehouse)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        assert warehouse.reduces("dim_product") == (limit == "-1")
        assert runs.run_ft_sale(warehouse).rows_inserted == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.raw_json for r in warehouse.read("ops", "rejects").filter("table = 'silver.ft_sale'").collect()) == sorted(carts[1:3])


def test_empty_totals_are_refused_and_leave_the_table_alone(spark, tmp_path, warehouse):
    runs.run_all(warehouse, {"users": read_pages(spark, land(tmp_path / "a", "users", [user(1)]))} | others(spark, tmp_path), FIRST)
    before = warehouse.versions("gold", "sales_by_client")
    empty = warehouse.read("silver", "ft_sale").limit(0)
    version = warehouse.write_version("silver", "ft_sale", empty)
    warehouse.publish("silver", "ft_sale", version)
    with pytest.raises(QualityError):
        runs.run_sales_by_client(warehouse)
    assert warehouse.versions("gold", "sales_by_client") == before
    assert gold(warehouse) == {1: 2.0}
    assert spark.sql(f"SHOW TABLES IN {warehouse.database('staging')}").count() == 0


def test_repeated_and_null_keys_in_a_batch_are_refused(spark, warehouse):
    ddl = SALES_BY_CLIENT.schema()
    twice = spark.createDataFrame([(1, "A", "B", 1.0), (1, "C", "D", 2.0)], ddl)
    with pytest.raises(QualityError, match="more than once"):
        runs.merge(warehouse, SALES_BY_CLIENT, twice)
    with pytest.raises(QualityError, match="NULL"):
        runs.merge(warehouse, SALES_BY_CLIENT, spark.createDataFrame([(None, "A", "B", 1.0)], ddl))


def test_both_upsert_plans_give_the_same_table(spark):
    ddl = SALES_BY_CLIENT.schema()
    tables = []
    for limits in ({"small_batch_rows": 0}, {"small_batch_bytes": 1}, {}):
        warehouse = Warehouse.scratch(spark, **limits)
        runs.merge(warehouse, SALES_BY_CLIENT, spark.createDataFrame([(i, "A", "B", float(i)) for i in range(50)], ddl))
        batch = [(i, "A", "C", -float(i)) for i in range(40, 60)]
        result = runs.merge(warehouse, SALES_BY_CLIENT, spark.createDataFrame(batch, ddl))
        assert (result.rows_inserted, result.rows_updated) == (10, 10)
        tables.append(sorted(tuple(row) for row in warehouse.read("gold", "sales_by_client").collect()))
    assert tables[0] == tables[1] == tables[2] and len(tables[0]) == 60


def test_stored_bytes(spark, warehouse):
    small = warehouse.stage(spark.range(10).toDF("id"), "a")
    large = warehouse.stage(spark.range(100_000).toDF("id"), "b")
    assert 0 < warehouse.stored_bytes(small) < warehouse.stored_bytes(large)


def without_adaptive(spark, frame):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan_text(frame).split("== Physical Plan ==")[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_bucketed_upsert_shuffles_nothing(spark, tmp_path, monkeypatch):
    warehouse = Warehouse.scratch(spark, buckets=4)
    users = [user(i) for i in range(1, 9)]
    carts = [cart(i, 1 + i % 8, (1, 1.0)) for i in range(30)]
    runs.run_all(warehouse, landing(spark, tmp_path, users, [product(1)], carts), FIRST)
    plans = []
    merged_rows = runs.merged_rows
    monkeypatch.setattr(runs, "merged_rows", lambda *args: plans.append(without_adaptive(spark, rows := merged_rows(*args))) or rows)
    batch = warehouse.read("silver", "ft_sale").drop("updated_timestamp").limit(9).selectExpr("* except (hash_id)", "IF(cart_id < 3, hash_id, concat('new', hash_id)) AS hash_id")
    result = runs.merge(warehouse, FT_SALE, batch, unique=True)
    assert result.rows_inserted + result.rows_updated == 9 and warehouse.read("silver", "ft_sale").count() == 30 + result.rows_inserted
    assert len(plans) == 1 and "Exchange" not in plans[0] and plans[0].count("Bucketed: true") == 2
    files = spark.read.table(warehouse.versions("silver", "ft_sale")[-1]).inputFiles()
    assert len(files) <= 4


# --- tables dealt by key --------------------------------------------------------------------------


def files_by_part(spark, warehouse):
    found = {}
    for path in spark.read.table(warehouse.parts_name("gold", "sales_by_client")).inputFiles():
        part, name = path.split("key_part=")[1].split("/")
        found.setdefault(int(part), set()).add(name)
    return found


def totals_frame(spark, keys, value):
    return spark.createDataFrame([(k, "A", "B", value) for k in keys], SALES_BY_CLIENT.schema())


def test_upsert_of_a_dealt_table_leaves_other_partitions_alone(spark):
    warehouse = Warehouse.scratch(spark, partitions=16)
    first = runs.merge(warehouse, SALES_BY_CLIENT, totals_frame(spark, range(200), 1.0))
    assert (first.rows_inserted, first.rows_updated) == (200, 0)
    before = files_by_part(spark, warehouse)
    batch = totals_frame(spark, [3, 5, 1000], 2.0)
    touched = {row[0] for row in batch.select(warehouse.part_of("client_id")).collect()}
    result = runs.merge(warehouse, SALES_BY_CLIENT, batch)
    assert (result.rows_inserted, result.rows_updated, result.source_rows) == (1, 2, 3)
    after = files_by_part(spark, warehouse)
    assert len(before) == 16 and {part for part in before if before[part] != after[part]} == touched and len(touched) < 4
    assert gold(warehouse) == {k: 1.0 for k in range(200)} | {3: 2.0, 5: 2.0, 1000: 2.0}
    assert warehouse.read("gold", "sales_by_client").columns == SALES_BY_CLIENT.schema().fieldNames()


def test_reads_of_a_dealt_table_are_pruned_by_the_batch(spark):
    warehouse = Warehouse.scratch(spark, partitions=16)
    runs.merge(warehouse, SALES_BY_CLIENT, totals_frame(spark, range(200), 1.0))
    batch = totals_frame(spark, [3], 2.0)
    held = warehouse.touched_parts(warehouse.parts_name("gold", "sales_by_client"), batch, "client_id")
    scan = [line for line in plan_text(held).split("== Physical Plan ==")[1].splitlines() if "FileScan" in line][0]
    assert "PartitionFilters" in scan and "Subquery" in scan.split("PartitionFilters")[1]
    rows = held.collect()
    assert {row.key_part for row in rows} == {batch.select(warehouse.part_of("client_id")).first()[0]} and len(rows) < 40
    metrics = held._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in metrics


def test_a_replacement_that_broke_off_is_made_good_by_the_next_upsert(spark, monkeypatch):
    warehouse = Warehouse.scratch(spark, partitions=4)
    runs.merge(warehouse, SALES_BY_CLIENT, totals_frame(spark, range(40), 1.0))
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "replace_parts", lambda *args: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runs.merge_parts(warehouse, SALES_BY_CLIENT, totals_frame(spark, [1, 50], 2.0), 2)
    assert gold(warehouse) == {k: 1.0 for k in range(40)}
    runs.merge(warehouse, SALES_BY_CLIENT, totals_frame(spark, [2], 3.0))
    assert gold(warehouse) == {k: 1.0 for k in range(40)} | {1: 2.0, 50: 2.0, 2: 3.0}
    assert not warehouse.replace_parts("gold", "sales_by_client")


def test_dealt_tables_hold_the_same_as_versions(spark, tmp_path):
    users, products = [user(1), user(2)], [product(1), product(2)]
    stored = []
    for options in ({}, {"partitions": 3}):
        warehouse = Warehouse.scratch(spark, **options)
        folder = tmp_path / str(len(stored))
        runs.run_all(warehouse, landing(spark, folder / "one", users, products, [cart(10, 1, (1, 5.0), (2, 7.5)), cart(11, 2, (1, 5.0))]), FIRST)
        runs.run_all(warehouse, landing(spark, folder / "two", users[:1], products, [cart(10, 1, (2, 1.0)), cart(12, 2, (2, 2.0))]), SECOND)
        kept = [c for c in FT_SALE.schema().fieldNames() if c not in ("updated_timestamp", "row_id")]
        stored.append((gold(warehouse), sorted(map(tuple, warehouse.read("silver", "ft_sale").select(*kept).collect()))))
    assert stored[0] == stored[1] and stored[0][0] == {1: 6.0, 2: 7.0}


# --- totals of touched clients ------------------------------------------------------------------


def test_only_touched_clients_are_summed_again(spark, tmp_path, warehouse):
    users, products = [user(i) for i in (1, 2, 3)], [product(1), product(2)]
    carts = [cart(10 + i, i, (1, float(i))) for i in (1, 2, 3)]
    runs.run_all(warehouse, landing(spark, tmp_path / "one", users, products, carts), FIRST)
    assert warehouse.touched("clients") is None
    # the second batch moves cart 11 from client 1 to client 2 and gives client 3 another name
    more = [cart(11, 2, (1, 10.0))]
    renamed = [user(1), user(2), user(3, lastName="Ray")]
    results = runs.run_all(warehouse, landing(spark, tmp_path / "two", renamed, products, more), SECOND)
    assert [(r.rows_inserted, r.rows_updated) for r in results if getattr(r, "table", "") == "gold.sales_by_client"] == [(0, 2)]
    assert gold(warehouse) == {1: 1.0, 2: 12.0, 3: 3.0}
    names = {row.client_id: row.client_last_name for row in warehouse.read("gold", "sales_by_client").collect()}
    assert names == {1: "LEE", 2: "LEE", 3: "RAY"}
    # another measure is summed for everybody, and so is the first one after it
    runs.run_sales_by_client(warehouse, measure="gross_amount")
    assert gold(warehouse) == {1: 1.0, 2: 24.0, 3: 6.0}
    warehouse.note_touched("clients", warehouse.read("silver", "dim_client").filter("client_id = 3").select("sk_client"))
    assert runs.run_sales_by_client(warehouse).source_rows == 2
    assert gold(warehouse) == {1: 1.0, 2: 12.0, 3: 3.0}


def test_facts_of_other_clients_do_not_reach_the_sums(spark, tmp_path, warehouse):
    from saleskiln.plans import builds

    runs.run_all(warehouse, {"users": read_pages(spark, land(tmp_path / "a", "users", [user(1)]))} | others(spark, tmp_path), FIRST)
    members = warehouse.read("silver", "dim_client").select("sk_client").distinct()
    rows = builds.sales_by_client(builds.sales_of(warehouse.read("silver", "ft_sale"), members), warehouse.read("silver", "dim_client"))
    physical = without_adaptive(spark, rows)
    assert "LeftSemi" in physical and physical.index("HashAggregate") < physical.index("LeftSemi")


# --- coverage of landings -------------------------------------------------------------------------


def test_a_page_twice_and_one_missing_is_incomplete(spark, tmp_path, warehouse):
    path = land(tmp_path / "a", "carts", [cart(i, 1) for i in range(8)])
    (tmp_path / "a" / "carts" / "again.json").write_text((tmp_path / "a" / "carts" / "skip=2.json").read_text())
    (tmp_path / "a" / "carts" / "skip=4.json").unlink()
    result = runs.ingest(warehouse, "carts", read_pages(spark, path), FIRST)
    assert (result.rows_written, result.records_announced, result.records_missing, result.repeated_pages, result.complete) == (6, 8, 2, 1, False)
    stored = sorted(json.loads(row.raw_json)["id"] for row in warehouse.read("bronze", "carts").collect())
    assert stored == [0, 1, 2, 3, 6, 7]


def test_a_repeated_page_alone_is_complete_and_comes_once(spark, tmp_path, warehouse):
    path = land(tmp_path / "a", "carts", [cart(i, 1) for i in range(5)])
    for name in ("again", "and again"):
        (tmp_path / "a" / "carts" / f"{name}.json").write_text((tmp_path / "a" / "carts" / "skip=0.json").read_text())
    result = runs.ingest(warehouse, "carts", read_pages(spark, path), FIRST)
    assert (result.rows_written, result.repeated_pages, result.complete) == (5, 2, True)
    assert warehouse.newest_runs().select("step", "table", "rows_written", "complete").collect() == [("ingest", "bronze.carts", 5, True)]


def test_sweep_over_blocks_and_overlaps(spark, monkeypatch):
    from saleskiln.sources import pages as P

    monkeypatch.setattr(P, "SWEEP_BLOCK", 7)
    spans = [(0, 5), (5, 30), (10, 12), (28, 33), (40, 41), (41, 41), (55, 70), (55, 60)]
    rows = [(k, f"f{k}", start, 9, 80, ["r"] * (stop - start), stop - start) for k, (start, stop) in enumerate(spans)]
    rows += [(90, "no offset", None, 1, 80, ["r"], 1), (91, "broken", 99, 1, None, None, None)]
    staged = spark.createDataFrame(rows, "page_id bigint, page_source string, page_offset bigint, page_digest bigint, page_total bigint, records array<string>, record_count bigint")
    found = sorted(tuple(row) for row in P.coverage_findings(staged).collect())
    assert found == [("gap", 33, 40, 1), ("gap", 41, 55, 1), ("gap", 70, 80, 1), ("overlap", 10, 12, 1), ("overlap", 28, 30, 1), ("repeat", 55, 70, 2)]
    assert P.coverage_report(staged, 70).first().asDict() == {
        "records_missing": 21, "records_overlapping": 4, "repeated_pages": 1, "records_unplaced": 1, "records_placed": 53,
    }
    assert P.kept_records(staged, repeats=True).count() == 54
    assert P.coverage_findings(staged.limit(0)).count() == 0 and P.coverage_report(staged.limit(0), None).first().records_missing == 0


def test_the_report_sums_the_findings(spark, monkeypatch):
    import random

    from saleskiln.sources import pages as P

    monkeypatch.setattr(P, "SWEEP_BLOCK", 20)
    draw = random.Random(5)
    starts = [draw.randrange(150) for _ in range(40)]
    rows = [(k, f"f{k}", start, k, 170, ["r"] * n, n) for k, (start, n) in enumerate((s, draw.randrange(9)) for s in starts)]
    staged = spark.createDataFrame(rows, "page_id bigint, page_source string, page_offset bigint, page_digest bigint, page_total bigint, records array<string>, record_count bigint")
    found = P.coverage_findings(staged).collect()
    length = lambda kind: sum(row.to_offset - row.from_offset for row in found if row.kind == kind)
    report = P.coverage_report(staged, 170).first()
    assert (report.records_missing, report.records_overlapping) == (length("gap"), length("overlap")) and length("gap") > 0 < length("overlap")
    assert report.repeated_pages == sum(row.pages - 1 for row in found if row.kind == "repeat") == len(starts) - len(set(starts))


def test_steps_side_by_side_lose_no_entry_of_the_tables_they_share(spark, warehouse):
    def entry(number):
        warehouse.log_run(step="trial", table=f"t{number}", rows_written=number)
        rejects = spark.createDataFrame([(f"id{number}", "bad", "{}", FIRST)], "row_id string, reject_reason string, rejected_text string, batch_time string")
        warehouse.store_rejects(f"t{number}", rejects.withColumnRenamed("batch_time", BATCH_COLUMN))
        return number

    assert runs.together(spark, [lambda n=n: entry(n) for n in range(6)]) == list(range(6))
    assert sorted(row.rows_written for row in warehouse.read("ops", "runs").collect()) == list(range(6))
    assert sorted(row.row_id for row in warehouse.read("ops", "rejects").collect()) == [f"id{n}" for n in range(6)]
    assert runs.together(spark, []) == []


def test_a_failed_step_does_not_cut_the_others_short(spark):
    ended = []

    def fails():
        raise QualityError("one")

    with pytest.raises(QualityError, match="one"):
        runs.together(spark, [fails, lambda: ended.append(spark.range(10).count())])
    assert ended == [10]


def test_a_landing_is_parsed_once(spark, tmp_path, warehouse, monkeypatch):
    plans = []
    stage, append = Warehouse.stage, Warehouse.append_batch
    monkeypatch.setattr(Warehouse, "stage", lambda self, frame, *more: plans.append(plan_text(frame)) or stage(self, frame, *more))
    monkeypatch.setattr(Warehouse, "append_batch", lambda self, name, frame: plans.append(plan_text(frame)) or append(self, name, frame))
    pages = read_pages(spark, land(tmp_path, "carts", [cart(i, 1) for i in range(10)], broken_at=4))
    result = runs.ingest(warehouse, "carts", pages, FIRST)
    assert (result.rows_written, result.first_broken_offset, result.records_missing, result.complete) == (4, 4, 6, False)
    physical = [text.split("== Physical Plan ==")[1] for text in plans]
    assert [text.count("from_json") for text in physical] == [1, 0]


def test_native_merge_is_left_to_the_format(spark):
    """Plain parquet cannot MERGE: the request has to reach the engine and be refused there."""
    warehouse = Warehouse.scratch(spark, native_merge=True)
    rows = spark.createDataFrame([(1, "A", "B", 1.0)], SALES_BY_CLIENT.schema())
    with pytest.raises(PySparkException, match="MERGE"):
        runs.merge(warehouse, SALES_BY_CLIENT, rows)


def test_schemas_cover_the_raw_records():
    assert user_schema()["company"].dataType["address"].dataType["coordinates"].dataType["lat"].dataType.typeName() == "double"
    assert product_schema()["reviews"].dataType.elementType["rating"].dataType.typeName() == "integer"
    assert [len(s.fieldNames()) for s in (user_schema(), product_schema(), cart_schema("bigint"))] == [28, 22, 7]


def test_impossible_counts_are_not_published(spark, warehouse, monkeypatch):
    ddl = SALES_BY_CLIENT.schema()
    runs.merge(warehouse, SALES_BY_CLIENT, spark.createDataFrame([(1, "A", "B", 1.0)], ddl))
    monkeypatch.setattr(runs, "upsert_small_batch", lambda target, source, rule: target.union(target).union(target))
    with pytest.raises(QualityError, match="not published"):
        runs.merge(warehouse, SALES_BY_CLIENT, spark.createDataFrame([(1, "A", "B", 2.0)], ddl))
    assert gold(warehouse) == {1: 1.0}
