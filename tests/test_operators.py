"""DataFrame operators on small frames, checked against plain Python where the result is not obvious."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from saleskiln.functions import invalid_email
from saleskiln.operators import (
    EmptyTableError,
    QualityError,
    UpsertRule,
    duplicate_keys,
    explode_lines,
    gate,
    insert_all,
    judge,
    keep_latest,
    latest_batch,
    lookup_key,
    merge_metrics,
    parse_records,
    project_fields,
    quality_report,
    require_batch,
    resolved,
    total_by_member,
    upsert,
    upsert_small_batch,
)
from saleskiln.plans.builds import needed
from saleskiln.plans.contracts import CLIENT_FIELDS, fields_for
from saleskiln.sources.schemas import cart_schema, product_schema, prune, user_schema


def plan_text(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    )


# --- parsing ------------------------------------------------------------------------------------

DIRTY = [
    ("broken", "{bad"),
    ("missing", None),
    ("empty", ""),
    ("wrong type", '{"id":"zz","age":30}'),
    ("overflow", '{"id":4294967296,"age":31}'),
    ("cut off", '{"id":5,"age":32'),
    ("list", '[{"id":1},{"id":2}]'),
    ("surplus", '{"id":6,"age":33,"nickname":"x","bank":{"iban":"I"}}'),
]


def test_dirty_records_keep_their_row(spark):
    frame = spark.createDataFrame(DIRTY, "label string, raw_json string")
    parsed = parse_records(frame, user_schema("int")).select("label", "id", "age").collect()
    got = {row.label: (row.id, row.age) for row in parsed}
    assert got == {
        "broken": (None, None),
        "missing": (None, None),
        "empty": (None, None),
        "wrong type": (None, 30),
        "overflow": (None, 31),
        "cut off": (None, None),
        "list": (None, None),
        "surplus": (6, 33),
    }


def test_narrow_schema_parses_the_same_values(spark):
    frame = spark.createDataFrame(DIRTY, "label string, raw_json string")
    columns = ["label", "id", "age", "email", "company.address.coordinates.lat"]
    narrow = prune(user_schema("int"), columns[1:])
    assert narrow.simpleString() == (
        "struct<id:int,age:int,email:string,company:struct<address:struct<coordinates:struct<lat:double>>>>"
    )
    full = parse_records(frame, user_schema("int")).select(*columns).collect()
    assert parse_records(frame, narrow).select(*columns).collect() == full


def test_prune_arrays_and_unknown_paths():
    assert prune(cart_schema("int"), ["id", "products.id", "products.price"]).simpleString() == (
        "struct<id:int,products:array<struct<id:int,price:double>>>"
    )
    assert prune(product_schema("bigint"), ["tags", "id"]).simpleString() == "struct<id:bigint,tags:array<string>>"
    with pytest.raises(ValueError):
        prune(cart_schema(), ["nothing"])


def test_unread_personal_fields_are_not_parsed():
    narrow = needed(user_schema("int"), fields_for(CLIENT_FIELDS, "int"))
    assert not {"password", "ssn", "bank", "crypto", "ip"} & set(narrow.fieldNames())


def test_records_are_parsed_once(spark):
    frame = spark.createDataFrame([('{"id":1,"products":[{"id":2}]}',)], "raw_json string")
    parsed = parse_records(frame, prune(cart_schema(), ["id", "products.id"])).filter("id IS NOT NULL")
    lines = explode_lines(parsed, "products").filter("line.id > 1")
    optimized = plan_text(lines).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("from_json") == 1
    assert lines.count() == 1


def test_explode_drops_carts_without_lines(spark):
    rows = ['{"id":1,"products":[]}', '{"id":2}', '{"id":3,"products":null}', '{"id":4,"products":[{"id":7},{"id":7},{"id":8}]}']
    frame = spark.createDataFrame([(row,) for row in rows], "raw_json string")
    lines = explode_lines(parse_records(frame, prune(cart_schema(), ["id", "products.id"])), "products")
    assert sorted((row.id, row.line.id) for row in lines.collect()) == [(4, 7), (4, 7), (4, 8)]


def test_project_fields_rules(spark):
    frame = spark.createDataFrame([(" ab ", "7", None)], "a string, b string, c string")
    fields = [("up", "a", "upper"), ("low", "a", "lower"), ("same", "a", "same"), ("n", "b", "int"), ("adult", "c", "adult")]
    assert project_fields(frame, fields).first()[:] == ("AB", "ab", " ab ", 7, None)


# --- batches ------------------------------------------------------------------------------------


def test_latest_batch_and_guard(spark):
    frame = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-02 00:00:00", 2)], "ingestion_timestamp string, v int")
    assert [row.v for row in latest_batch(frame).collect()] == [2]
    assert require_batch(frame, "t") is frame
    with pytest.raises(EmptyTableError):
        require_batch(frame.limit(0), "t")
    with pytest.raises(EmptyTableError):
        require_batch(frame.withColumn("ingestion_timestamp", F.lit(None).cast("string")), "t")


# --- dedup --------------------------------------------------------------------------------------


def test_keep_latest_against_python(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(4), rng.randrange(3), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k int, ts int, tie int, id int").repartition(5)
    got = sorted((r.id for r in keep_latest(frame, ["k"], "ts", ["tie", "id"]).collect()))
    best = {}
    for row in sorted(rows, key=lambda r: (-r[1], r[2], r[3])):
        best.setdefault(row[0], row[3])
    assert got == sorted(best.values())


def test_keep_latest_limits_before_the_exchange(spark):
    frame = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("ts"))
    text = plan_text(keep_latest(frame, ["k"], "ts"))
    assert "Partial" in text and "WindowGroupLimit" in text


def test_duplicate_keys(spark):
    frame = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(row) for row in duplicate_keys(frame, ["k"]).collect()] == [(1, 2)]


# --- lookups and totals -------------------------------------------------------------------------


def test_lookup_keeps_and_resolved_drops_unknown(spark):
    lines = spark.createDataFrame([(1, 10), (2, 99), (3, None)], "id int, product_id int")
    dim = spark.createDataFrame([(10, "a"), (None, "n")], "product_id int, sk_product string")
    found = lookup_key(lines, dim, "product_id", "sk_product")
    assert sorted((r.id, r.sk_product) for r in found.collect()) == [(1, "a"), (2, None), (3, None)]
    assert [r.id for r in resolved(found, "sk_product").collect()] == [1]


def test_totals_do_not_depend_on_partitioning(spark):
    facts = spark.range(1000).selectExpr("id % 3 AS sk", "0.1D + id AS price")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "sk bigint, name string")
    sums = []
    for parts in (1, 7):
        rows = total_by_member(facts.repartition(parts), dim, "sk", ["name"], "price", "total").collect()
        sums.append(sorted((r.name, r.total) for r in rows))
    assert sums[0] == sums[1] and [name for name, _ in sums[0]] == ["a", "b", "c"]
    assert sums[0][0][1] == pytest.approx(sum(0.1 + i for i in range(0, 1000, 3)))


# --- quality ------------------------------------------------------------------------------------

PEOPLE = [(1, "a@b.c"), (2, "bad"), (3, None), (None, "bad"), (None, None)]


def test_quality_report_and_gate_agree(spark):
    frame = spark.createDataFrame(PEOPLE, "k int, mail string")
    checks = {"invalid": invalid_email("mail")}
    report = quality_report(frame, "k", checks).first().asDict()
    assert report == {"total_rows": 5, "null_keys": 2, "null_key_pct": 40.0, "valid_rows": 3, "invalid": 1}
    seen = Observation()
    assert gate(frame, "k", seen, checks).count() == 3
    assert seen.get == report
    judge(seen.get, "people")


def test_empty_frame_is_rejected(spark):
    frame = spark.createDataFrame([], "k int")
    report = quality_report(frame, "k").first().asDict()
    assert report["null_key_pct"] is None
    with pytest.raises(QualityError):
        judge(report, "people")


# --- upsert -------------------------------------------------------------------------------------

RULE = UpsertRule(("k",), ("first_seen",), "touched")
TARGET_DDL = "k int, v string, first_seen string, touched timestamp, extra int"
SOURCE_DDL = "k int, v string, first_seen string"


def expected_upsert(target, source):
    new = {row[0]: row for row in source}
    rows = []
    for k, v, seen, touched, extra in target:
        if k in new and k is not None:
            rows.append((k, new[k][1], seen, True, extra, "updated"))
        else:
            rows.append((k, v, seen, touched is not None, extra, "kept"))
    known = {row[0] for row in target} - {None}
    rows += [(k, v, seen, False, None, "inserted") for k, v, seen in source if k not in known]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("plan", [upsert, upsert_small_batch])
def test_upsert_against_python(spark, plan):
    rng = random.Random(3)
    target = [(k, f"t{k}", "old", None, k * 10) for k in range(60)] + [(None, "t", "old", None, 0)]
    source = [(k, rng.choice([None, f"s{k}"]), "new") for k in rng.sample(range(100), 50)] + [(None, "s", "new")]
    merged = plan(spark.createDataFrame(target, TARGET_DDL), spark.createDataFrame(source, SOURCE_DDL), RULE)
    rows = [(r.k, r.v, r.first_seen, r.touched is not None, r.extra, r.merge_action) for r in merged.collect()]
    assert sorted(rows, key=repr) == expected_upsert(target, source)
    counts = merge_metrics(merged).first()
    assert counts.source_rows == len(source)
    assert counts.rows_inserted + counts.rows_updated + counts.rows_kept == len(rows)


@pytest.mark.parametrize("plan", [upsert, upsert_small_batch])
def test_upsert_twice_changes_no_rows(spark, plan):
    target = spark.createDataFrame([(1, "a", "old", None, 1)], TARGET_DDL)
    source = spark.createDataFrame([(1, "b", "new"), (2, "c", "new")], SOURCE_DDL)
    once = plan(target, source, RULE).drop("merge_action")
    twice = plan(once, source, RULE)
    counts = merge_metrics(twice).first()
    assert (counts.rows_inserted, counts.rows_updated, counts.rows_kept) == (0, 2, 0)
    kept = ["k", "v", "first_seen", "extra"]
    assert sorted(once.select(*kept).collect(), key=repr) == sorted(twice.select(*kept).collect(), key=repr)


def test_insert_all_has_the_target_shape(spark):
    target = spark.createDataFrame([], TARGET_DDL)
    source = spark.createDataFrame([(1, "b", "new")], SOURCE_DDL)
    assert insert_all(target, source, RULE).schema.simpleString() == target.schema.simpleString()
    assert insert_all(target, source, RULE).first()[:] == (1, "b", "new", None, None)


def test_every_upsert_form_keeps_the_stored_types(spark):
    target = spark.createDataFrame([(1, "a", "old", None, 1)], TARGET_DDL)
    wide = spark.createDataFrame([(1, 5, "new"), (2, 6, "new")], "k bigint, v int, first_seen string")
    for merged in (upsert(target, wide, RULE), upsert_small_batch(target, wide, RULE), insert_all(target, wide, RULE)):
        assert merged.drop("merge_action").dtypes == target.dtypes
    assert sorted((r.k, r.v) for r in upsert(target, wide, RULE).collect()) == [(1, "5"), (2, "6")]


def test_upsert_rejects_foreign_columns(spark):
    target = spark.createDataFrame([], TARGET_DDL)
    with pytest.raises(ValueError):
        upsert(target, spark.createDataFrame([], "k int, other int"), RULE)
    with pytest.raises(ValueError):
        upsert(target, spark.createDataFrame([], "v string"), RULE)


def test_small_batch_is_broadcast_to_the_target(spark):
    target = spark.range(1000).selectExpr("CAST(id AS INT) AS k", "'t' AS v", "'old' AS first_seen", "CAST(NULL AS TIMESTAMP) AS touched", "1 AS extra")
    source = spark.createDataFrame([(1, "b", "new")], SOURCE_DDL).hint("broadcast")
    physical = plan_text(upsert_small_batch(target, source, RULE)).split("== Physical Plan ==")[1]
    assert "LeftOuter, BuildRight" in physical and "FullOuter" not in physical


def test_surrogate_is_not_hashed_again_for_a_null_test(spark):
    from saleskiln.functions import surrogate_key

    dim = spark.range(5).select(F.col("id").alias("product_id"), surrogate_key("product", "id").alias("sk_product"))
    lines = spark.range(9).select((F.col("id") % 7).alias("product_id"))
    found = resolved(lookup_key(lines, dim, "product_id", "sk_product"), "sk_product")
    optimized = plan_text(found).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("sha2") == 1
    assert found.count() == 7
