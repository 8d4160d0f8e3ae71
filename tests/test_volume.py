"""What goes through exchanges and to disk: digests packed, lines deduplicated ahead of the lookups, narrow rows dealt."""

from pyspark.sql import functions as F

from saleskiln.functions import hash_key, surrogate_key
from saleskiln.functions.keys import packed, unpacked
from saleskiln.operators import UpsertRule, upsert
from saleskiln.plans import builds, runs
from saleskiln.plans.contracts import TableContract
from saleskiln.sources import tables
from saleskiln.sources.tables import Warehouse
from tests.test_operators import plan_text
from workload import adapter


def test_packed_texts_come_back_and_keep_their_order(spark):
    digests = [f"{k * 2654435761 % 2**32:08x}" for k in range(50)]
    others = ["", "a", "abc\n", "ab\n", "AB", "0g", "é", "1e9-44", "ab" * 40, "f" * 63, None]
    frame = spark.createDataFrame([(text,) for text in digests + others], "t string").withColumn("p", packed("t"))
    rows = frame.select("t", "p", unpacked("p").alias("back")).collect()
    assert all(r.t == r.back for r in rows)
    assert [r.t for r in sorted(rows[:50], key=lambda r: bytes(r.p))] == sorted(digests) and len(rows[0].p) == 5


def carts(spark, id_type):
    quote = '"' if id_type == "string" else ""
    line = lambda product, price: f'{{"id":{"null" if product is None else f"{quote}{product}{quote}"},"price":{price},"quantity":1,"total":{price},"discountedTotal":1.0}}'
    cart = lambda key, user, *lines: f'{{"id":{"null" if key is None else f"{quote}{key}{quote}"},"userId":{quote}{user}{quote},"total":1.0,"discountedTotal":1.0,"products":[{",".join(lines)}]}}'
    texts = [
        cart(1, 1, line(1, 5.0), line(1, 3.0), line(2, 4.0), line(None, 2.0)), cart(1, 2, line(2, 4.0)), cart(2, 9, line(1, 1.0)),
        cart(3, 2, line(1, 7.0), line(8, 1.0)), cart(None, 1, line(1, 1.0)), cart(3, 2, line(1, 7.0)),
    ]
    rows = [(text, "2024-05-01 08:00:00", f"{k:064x}" if k else "by hand") for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, f"raw_json string, {builds.BATCH_COLUMN} string, row_id string")


def test_lines_are_deduplicated_ahead_of_the_lookups(spark):
    for id_type in ("bigint", "string"):
        products = spark.createDataFrame([(str(k), f"p{k}") for k in (1, 2)], "product_id string, sk_product string").withColumn("product_id", F.col("product_id").cast(id_type))
        clients = spark.createDataFrame([(str(k), f"{k:064x}") for k in (1, 2)], "client_id string, sk_client string").withColumn("client_id", F.col("client_id").cast(id_type))
        for rejects in (False, True):
            frame = builds.ft_sale(carts(spark, id_type), products, clients, id_type, rejects=rejects)
            physical = plan_text(frame).split("== Physical Plan ==")[1]
            # parents stand above their children
            assert 0 < physical.index("Join") < physical.index("Window")
            rows = frame.where("sk_product is not null").withColumn("again", hash_key("cart_id", F.substring("sk_product", 2, 1))).collect()
            assert all(r.hash_id == r.again for r in rows)
            found = sorted((int(r.cart_id), r.sk_product, r.sk_client, r.unit_price, r.row_id) for r in rows)
            one, two = f"{1:064x}", f"{2:064x}"
            assert found == [(1, "p1", one, 3.0, "by hand"), (1, "p2", one, 4.0, "by hand"), (3, "p1", two, 7.0, f"{3:064x}")]
            bare = builds.ft_sale(carts(spark, id_type), products, clients, id_type, row_ids=False)
            assert sorted(map(tuple, bare.drop("row_id").collect())) == sorted(map(tuple, frame.where("sk_product is not null").select(*bare.drop("row_id").columns).collect()))


def test_whole_lines_are_exchanged_once(spark):
    frames = {}
    for entity in ("product", "client"):
        rows = spark.range(1, 3).select(F.col("id").alias(f"{entity}_id"), surrogate_key(entity, "id").alias(f"sk_{entity}"))
        # the second member has a surrogate of another making
        frames[entity] = rows.withColumn(f"sk_{entity}", F.when(F.col(f"{entity}_id") == 1, F.col(f"sk_{entity}")).otherwise(f"{entity} 2"))
    set_to = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in set_to}
    for name, value in set_to.items():
        spark.conf.set(name, value)
    try:
        for rejects in (False, True):
            frame = builds.ft_sale(carts(spark, "bigint"), frames["product"], frames["client"], rejects=rejects)
            physical = plan_text(frame).split("== Physical Plan ==")[1]
            reused = [line for line in physical.splitlines() if "ReusedExchange" in line]
            assert len(reused) == 1 and "hashpartitioning(cart_id" in reused[0] and "cart_discounted_total" in reused[0]
            lookups = [line for line in physical.splitlines() if "hashpartitioning(product_id" in line or "hashpartitioning(client_id" in line]
            assert len(lookups) == 2
            one = {entity: rows.first()[f"sk_{entity}"] for entity, rows in frames.items()}
            found = sorted((r.cart_id, r.sk_product, r.sk_client, r.unit_price) for r in frame.where("sk_product is not null").collect())
            assert found == sorted([(1, one["product"], one["client"], 3.0), (1, "product 2", one["client"], 4.0), (3, one["product"], "client 2", 7.0)])
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_what_a_reader_can_work_out_travels_as_one_byte(spark):
    frame = spark.createDataFrame([("ab", "ab"), ("ab", "cd"), ("x", "x"), ("ab", None), (None, "ab"), ("", ""), (None, None)], "t string, k string")
    rows = frame.select("t", "k", packed("t", F.col("k")).alias("p")).select("*", unpacked("p", F.col("k")).alias("back")).collect()
    assert all(r.t == r.back for r in rows) and [len(r.p) for r in rows if r.t is not None] == [1, 2, 1, 2, 1]


def test_strings_joined_to_one_text_are_one_key(spark):
    text = '{"id":"%s","userId":"1","total":1.0,"products":[{"id":"%s","price":%s}]}'
    rows = [(text % parts, "2024-05-01 08:00:00", str(k)) for k, parts in enumerate([("a-b", "c", 2.0), ("a", "b-c", 1.0)])]
    bronze = spark.createDataFrame(rows, f"raw_json string, {builds.BATCH_COLUMN} string, row_id string")
    products = spark.createDataFrame([("c", "p1"), ("b-c", "p2")], "product_id string, sk_product string")
    clients = spark.createDataFrame([("1", "c1")], "client_id string, sk_client string")
    assert [r.sk_product for r in builds.ft_sale(bronze, products, clients, "string").collect()] == ["p2"]


def test_customers_are_dealt_before_their_records_are_made(spark, testdata):
    records = adapter.user_fields(spark, f"{testdata}/sf0.001")
    optimized = plan_text(records).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "RebalancePartitions" in optimized and optimized.index("named_struct") < optimized.index("RebalancePartitions")


def test_stored_digests_are_compressed(spark):
    warehouse = Warehouse.scratch(spark, buckets=2)
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("hash_id"), "id")
    try:
        for key in (None, "hash_id"):
            name = warehouse.stage(rows, "lines", key)
            stored = spark.read.table(name)
            assert all("zstd" in file for file in stored.inputFiles())
            assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
        assert len(stored.inputFiles()) == 2
        version = warehouse.write_version("silver", "lines", rows)
        assert warehouse.stored_bytes(version) < 2000 * 64
    finally:
        warehouse.drop()


FACTS = TableContract("silver", "facts", "hash_id string, sk_client string, n bigint, updated_timestamp timestamp", UpsertRule(("hash_id",), (), "updated_timestamp"), bucketed=True)


def facts(spark, start, stop, add=0):
    digest = lambda entity: F.sha2(F.concat(F.lit(entity), F.col("id").cast("string")), 256)
    return spark.range(start, stop).select(digest("h").alias("hash_id"), F.when(F.col("id") % 7 > 0, digest("c")).alias("sk_client"), (F.col("id") + add).alias("n"))


def test_large_batches_with_few_hits_are_not_exchanged(spark, monkeypatch):
    warehouse = Warehouse.scratch(spark, small_batch_rows=20)
    outer = []
    monkeypatch.setattr(runs, "upsert", lambda *args: outer.append(1) or upsert(*args))
    try:
        runs.merge(warehouse, FACTS, facts(spark, 0, 100), unique=True)
        few = runs.merge(warehouse, FACTS, facts(spark, 90, 200, 1000).unionByName(spark.createDataFrame([(None, "x", 1)], "hash_id string, sk_client string, n bigint")), unique=True)
        assert (few.rows_inserted, few.rows_updated, outer) == (101, 10, [])
        many = runs.merge(warehouse, FACTS, facts(spark, 50, 250, 5000), unique=True)
        assert (many.rows_inserted, many.rows_updated, outer) == (50, 150, [1])
        rows = warehouse.read("silver", "facts").where("hash_id is not null").orderBy("n").collect()
        assert [r.n for r in rows] == [*range(50), *range(5050, 5250)]
        assert [r.updated_timestamp is not None for r in rows] == [False] * 50 + [True] * 150 + [False] * 50
        expected = {r.hash_id: r.sk_client for r in facts(spark, 0, 250).collect()}
        assert {r.hash_id: r.sk_client for r in rows} == expected
        assert spark.sql(f"SHOW TABLES IN {warehouse.database('staging')}").count() == 0
    finally:
        warehouse.drop()


def test_digests_of_an_outer_merge_travel_packed(spark):
    target = facts(spark, 0, 10).withColumn("updated_timestamp", F.lit(None).cast("timestamp"))
    for but in ((), ("hash_id",)):
        merged = runs.upsert_packed(target, facts(spark, 5, 15, 100), FACTS.rule, but)
        optimized = plan_text(merged).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimized.index("unhex") > optimized.index("Join FullOuter")
        assert {(r.hash_id, r.n) for r in merged.collect()} == {(r.hash_id, r.n) for r in facts(spark, 0, 5).union(facts(spark, 5, 15, 100)).collect()}


def test_a_table_that_outgrows_its_buckets_gets_more(spark, monkeypatch):
    monkeypatch.setattr(tables, "BUCKET_BYTES", 1 << 11)
    warehouse = Warehouse.scratch(spark, buckets=2)
    try:
        counts = []
        for start, stop in ((0, 20), (10, 400), (390, 500), (0, 1500)):
            runs.merge(warehouse, FACTS, facts(spark, start, stop, start), unique=True)
            counts.append(warehouse.buckets_of("silver", "facts"))
            files = spark.read.table(warehouse.versions("silver", "facts")[-1]).inputFiles()
            assert len(files) <= counts[-1]
        assert counts[0] <= counts[1] <= counts[2] <= counts[3] and counts[0] < counts[3] and all(n % 2 == 0 for n in counts)
        rows = warehouse.read("silver", "facts").collect()
        assert len(rows) == 1500 and {r.n for r in rows} == set(range(1500))
    finally:
        warehouse.drop()
