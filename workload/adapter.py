"""Given tables in the shape of raw user, product and cart records.

The derivations are plain arithmetic and text, so that the SQL side can repeat them. Everything is built
row by row; no group of lines is gathered, however many lines one order has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from saleskiln.operators import latest_batch
from saleskiln.sources.bronze import with_batch
from saleskiln.sources.schemas import BATCH_COLUMN

BATCH_TIME = "2024-05-01 08:00:00"
OLD_BATCH_TIME = "2024-04-30 08:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


USER_FIELDS = """
    IF(c_custkey % 97 <> 0, c_custkey, NULL) AS id,
    concat('  ', lower(c_mktsegment), ' ') AS firstName,
    c_name AS lastName,
    IF(c_custkey % 5 <> 0, concat('of ', n_name), NULL) AS maidenName,
    IF(c_custkey % 11 <> 0, CAST(c_custkey % 90 AS INT), NULL) AS age,
    element_at(array('male', ' Female ', 'other', 'unknown'), CAST(c_custkey % 4 + 1 AS INT)) AS gender,
    IF(c_custkey % 13 = 0, 'bad-mail', concat('User', c_custkey, '@Example.COM ')) AS email,
    concat(' user', c_custkey, copy, ' ') AS username,
    IF(c_custkey % 2 = 0, concat('+', c_custkey, ' (11) ', substring(c_name, 10, 20)), concat(' 0-', c_name)) AS phone,
    IF(c_custkey % 17 = 0, 'not a date',
       concat_ws('-', 1950 + c_custkey % 50, 1 + c_custkey % 12, 1 + c_custkey % 28)) AS birthDate,
    'secret' AS password,
    named_struct(
        'address', concat(c_custkey, ' main street '), 'city', n_name, 'state', r_name,
        'stateCode', concat(' ', substring(r_name, 1, 2), ' '), 'postalCode', concat(' 0', c_custkey, ' '),
        'coordinates', named_struct('lat', double(c_custkey % 180 - 90), 'lng', double(c_custkey % 360 - 180)),
        'country', concat(' country ', n_regionkey)) AS address,
    concat(' University of ', n_name) AS university,
    named_struct(
        'department', lower(c_mktsegment), 'name', concat(' acme ', c_nationkey), 'title', 'clerk',
        'address', named_struct(
            'address', concat(c_custkey, ' office park'), 'city', concat(lower(n_name), ' '), 'state', lower(r_name),
            'stateCode', concat(' ', substring(r_name, 1, 2), ' '), 'postalCode', concat('9', c_custkey),
            'coordinates', named_struct('lat', double(c_custkey % 90), 'lng', double(c_custkey % 45) * 0.5D),
            'country', lower(r_name))) AS company,
    IF(c_custkey % 3 = 0, ' Admin ', 'User') AS role
"""


def copies_of(key: str, repeats: bool) -> str:
    """Marks of the records of one key: every tenth key has a second one, if ``repeats``."""
    return f"explode(IF({key} % 10 = 0, array('', ' again'), array(''))) AS copy" if repeats else "'' AS copy"


def user_fields(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """One row per customer: the ``record`` a user has, and the balance that tells batches apart. With ``repeats``
    some customers have two records that differ."""
    # Records are many times as wide as what they are made of, and a file of one row group is one task, which would sort
    # all of them in the deduplication. Dealing the narrow rows bounds a task at every size.
    narrow = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    people = (
        narrow.hint("rebalance", "c_custkey")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .selectExpr("*", copies_of("c_custkey", repeats))
    )
    return people.selectExpr(f"struct({USER_FIELDS}) AS record", "c_acctbal AS balance")


def product_fields(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("*", copies_of("p_partkey", repeats)).selectExpr(
        """struct(p_partkey AS id, concat(' ', p_name, copy) AS title, p_type AS category, lower(p_brand) AS brand,
                  p_retailprice AS price, p_size AS stock) AS record""",
        "p_brand AS brand",
    )


LINE = """struct(l_partkey AS id, l_extendedprice AS price, CAST(l_quantity AS INT) AS quantity,
                 l_extendedprice AS total, l_extendedprice * (1 - l_discount) AS discountedTotal)"""


#: Lines that stand together in a file, of which those of one order become one cart record: the most lines it can have.
CART_BLOCK = 1 << 17


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``l_orderkey, products``: the lines of an order that stand in one stretch of the table. The stretch bounds the
    group, however many lines an order has; an order in several stretches is several records of one cart."""
    block = F.expr(f"monotonically_increasing_id() DIV {CART_BLOCK}")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", block.alias("block"), F.expr(LINE).alias("line"))
    return lines.groupBy("l_orderkey", "block").agg(F.collect_list("line").alias("products")).drop("block")


def cart_fields(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """One cart record per order line, or with ``grouped`` per group of an order's lines.

    Both tables grow with the data, hence the merge hint; and only an inner join lets adaptive execution split a hot
    order on the side of the lines. Orders without lines would vanish in the explode anyway.
    """
    orders = table(spark, sf_dir, "orders")
    # a line becomes an array behind the exchange, as its columns alone are narrower
    lines, products = (line_groups(spark, sf_dir), "products") if grouped else (table(spark, sf_dir, "lineitem"), f"array({LINE}) AS products")
    return orders.join(lines.hint("merge"), F.expr("o_orderkey = l_orderkey")).selectExpr(
        f"""struct(o_orderkey AS id, o_custkey AS userId, o_totalprice AS total, o_totalprice * 0.5D AS discountedTotal,
                  {products}) AS record""",
        "o_orderstatus AS status",
    )


def batch_of(newest: str | None) -> str:
    return f"IF({newest or 'true'}, '{BATCH_TIME}', '{OLD_BATCH_TIME}')"


def raw(records: DataFrame, source: str, newest: str | None = None) -> DataFrame:
    """Bronze rows with repeatable row ids: one batch, or two where ``newest`` tells the newer rows."""
    texts = records.selectExpr("to_json(record) AS raw_json", f"{batch_of(newest)} AS stamp")
    return with_batch(texts, F.col("stamp"), F.lit(source), row_id_from=["raw_json"])


def raw_users(spark: SparkSession, sf_dir: str, newest: str | None = None, repeats: bool = False) -> DataFrame:
    return raw(user_fields(spark, sf_dir, repeats), "users", newest)


def raw_products(spark: SparkSession, sf_dir: str, newest: str | None = None, repeats: bool = False) -> DataFrame:
    return raw(product_fields(spark, sf_dir, repeats), "products", newest)


def raw_carts(spark: SparkSession, sf_dir: str, newest: str | None = None, grouped: bool = False) -> DataFrame:
    return raw(cart_fields(spark, sf_dir, grouped), "carts", newest)


def newest_carts(spark: SparkSession, sf_dir: str, newest: str) -> DataFrame:
    """Cart records of the newest batch; the batches are read off the orders, ahead of the join."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS status")
    batches = orders.selectExpr(f"{batch_of(newest)} AS {BATCH_COLUMN}")
    return latest_batch(raw_carts(spark, sf_dir, newest), batches=batches)


def land_pages(records: DataFrame, entity: str, folder: str, per_page: int = 100) -> str:
    """Write ``records`` (``raw_json``) as pages of at most ``per_page`` whose offsets follow each other; the folder.

    The records are stored first: their numbers within a task, and how many each task has, must not change between
    the two reads that make offsets of them. Only one row per task meets in one place, and is broadcast.
    """
    spark = records.sparkSession
    numbered = records.selectExpr("raw_json", "monotonically_increasing_id() AS number")
    numbered.write.option("compression", "zstd").parquet(f"{folder}/records")
    stored = spark.read.parquet(f"{folder}/records").selectExpr("raw_json", "shiftright(number, 33) AS task", "number & 8589934591 AS place")
    sizes = stored.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    total = stored.agg(F.count(F.lit(1)).alias("total")).scalar()
    pages = (
        stored.join(F.broadcast(starts), "task")
        .selectExpr("raw_json", f"(start + place) DIV {per_page} AS page")
        .groupBy("page")
        .agg(F.concat_ws(",", F.collect_list("raw_json")).alias("texts"))
        .withColumn("total", total)
        .selectExpr(f"""concat('{{"{entity}":[', texts, '],"total":', total, ',"skip":', page * {per_page}, '}}') AS body""")
    )
    pages.write.option("compression", "gzip").text(f"{folder}/pages")
    return f"{folder}/pages"
