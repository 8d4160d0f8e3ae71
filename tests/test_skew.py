"""A third of all lines on one order and part, a third of all orders on one client; six files per table."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from saleskiln.operators import keep_latest, keep_latest_by_aggregate, likely_known, lookup_key
from tests.test_oracles import TABLES, rows_of
from workload import adapter
from workload.oracles import ORACLES
from workload.queries import QUERIES

AFFECTED = [
    "sales_by_client",
    "ft_sale",
    "sale_audit",
    "explode_cart_lines",
    "line_hash_key",
    "dedup_keep_latest",
    "latest_by_aggregate",
    "repeated_keys",
    "fact_dimension_lookup",
    "member_totals",
    "page_guard",
]

# Tables with one hot key each; everything else is copied.
HOT = {
    "lineitem": "* REPLACE (CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey, "
    "CASE WHEN l_suppkey % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey)",
    "orders": "* REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 11 ELSE o_custkey END AS o_custkey)",
}


@pytest.fixture(scope="module")
def skewed(testdata, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    engine = duckdb.connect()
    for name in TABLES:
        columns = HOT.get(name, "*")
        source, target = f"{testdata}/sf0.001/{name}.parquet", folder / f"{name}.parquet"
        target.mkdir()
        engine.execute(f"CREATE TABLE {name} AS SELECT {columns} FROM '{source}'")
        for part in range(6):
            rows = f"SELECT * FROM {name} WHERE rowid % 6 = {part}"
            engine.execute(f"COPY ({rows}) TO '{target}/{part}.parquet' (FORMAT parquet)")
    return str(folder), engine


@pytest.mark.parametrize("name", AFFECTED)
def test_results_hold_with_hot_keys(spark, skewed, name):
    folder, engine = skewed
    expected = engine.execute(ORACLES[name])
    columns = [column[0] for column in expected.description]
    wanted = rows_of(columns, expected.fetchall())
    frame = QUERIES[name](spark, folder)
    assert rows_of(frame.columns, frame.collect()) == wanted


@pytest.fixture
def small_limits(spark):
    """Thresholds at which toy tables count as large and a hot partition as skewed."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in limits}
    for key, value in limits.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hot_order_is_split_in_the_cart_join(spark, skewed, small_limits):
    assert "skew=true" in final_plan(adapter.cart_fields(spark, skewed[0]))


def test_hot_product_is_split_in_the_lookup(spark, skewed, small_limits):
    lines = adapter.table(spark, skewed[0], "lineitem").repartition(6).withColumnRenamed("l_partkey", "product_id")
    products = adapter.table(spark, skewed[0], "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("sk_product"))
    assert "skew=true" in final_plan(lookup_key(lines, products, "product_id", "sk_product"))


def test_hot_key_ships_one_row_per_task_into_the_dedup(spark, skewed):
    lines = adapter.table(spark, skewed[0], "lineitem").repartition(6)
    frame = keep_latest(lines, ["l_orderkey", "l_partkey"], "l_shipdate", ["l_extendedprice", "l_suppkey"])
    distinct = lines.select("l_orderkey", "l_partkey").distinct().count()
    plan = frame._jdf.queryExecution()
    frame.collect()
    text = plan.executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
    assert frame.count() == distinct


def shuffled_rows(frame):
    """Rows written by the exchanges of the executed plan that carry lines."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, left = [], [plan]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            left.append(node.plan())
            continue
        if name == "Exchange":
            metric = node.metrics().get("shuffleRecordsWritten")
            found.append(metric.get().value() if metric.isDefined() else 0)
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return max(found, default=0)


def test_bitmap_drops_unknown_lines_in_front_of_the_exchange(spark, testdata, small_limits):
    lines = adapter.table(spark, f"{testdata}/sf0.001", "lineitem").withColumnRenamed("l_partkey", "product_id").withColumn("marks", F.lit(1))
    parts = adapter.table(spark, f"{testdata}/sf0.001", "part").filter("p_size <= 5")
    products = parts.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("sk_product"))
    plain = lookup_key(lines, products, "product_id", "sk_product").filter("sk_product is not null")
    reduced = lookup_key(likely_known(lines, products, "product_id"), products, "product_id", "sk_product").filter("sk_product is not null")
    before = shuffled_rows(lookup_key(lines, products, "product_id", "sk_product"))
    after = shuffled_rows(lookup_key(likely_known(lines, products, "product_id"), products, "product_id", "sk_product"))
    assert before == lines.count() and after < before / 4
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, reduced.collect()))
    dense = likely_known(lines, products, "product_id", log_bits=5)
    assert dense.count() > likely_known(lines, products, "product_id").count() >= plain.count()
    assert likely_known(lines, products.limit(0), "product_id").count() == 0
    assert likely_known(lines, products.limit(0), "product_id", keep=F.col("product_id") == 1).count() == lines.filter("product_id = 1").count()


def test_latest_by_aggregate_equals_the_window_and_sorts_nothing(spark, skewed):
    import datetime
    import random

    rng = random.Random(4)
    pick = lambda *values: rng.choice([None, *values])
    rows = [
        (pick(1, 2, 3), pick("2024-01-01", "2024-01-02"), pick("a", "ab", "", "é", "b"), pick(1.5, -2.0, float("nan"), float("inf")), pick(True, False),
         pick(datetime.date(2020, 1, 2), datetime.date(1950, 5, 5)), pick(-(2**63), 5, 2**63 - 1), k)
        for k in range(600)
    ]
    frame = spark.createDataFrame(rows, "k int, newest string, s string, d double, b boolean, day date, n bigint, row int").repartition(5)
    for ties in (["s", "d", "b", "day", "n", "row"], ["d", "row"], ["n", "b", "row"], ["day", "s", "row"]):
        by_window = sorted(repr(r) for r in keep_latest(frame, ["k"], "newest", ties).collect())
        aggregated = keep_latest_by_aggregate(frame, ["k"], "newest", ties)
        assert sorted(repr(r) for r in aggregated.collect()) == by_window and aggregated.columns == frame.columns
    plan = final_plan(aggregated)
    assert "ObjectHashAggregate" in plan and "Sort" not in plan and "Window" not in plan
    lines = adapter.table(spark, skewed[0], "lineitem").repartition(6)
    hot = keep_latest_by_aggregate(lines.select("l_orderkey", "l_extendedprice", "l_suppkey"), ["l_orderkey"], "l_extendedprice", ["l_suppkey"])
    assert shuffled_rows(hot) <= 6 * lines.select("l_orderkey").distinct().count()
