"""The stored tables as lazy frames: raw bronze rows in, table rows out. Nothing here runs a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.types import IntegralType, StructType

from saleskiln.functions import hash_key, invalid_email, surrogate_key
from saleskiln.functions.keys import KEY_SEPARATOR, packed, unpacked
from saleskiln.operators import (
    drop_null_keys,
    explode_lines,
    gate,
    keep_latest,
    likely_known,
    lookup_key,
    parse_or_reject,
    parse_records,
    project_fields,
    resolved,
    total_by_member,
)
from saleskiln.operators.dedup import free_name
from saleskiln.operators.parse import REJECT, REJECTED_TEXT, Field
from saleskiln.operators.quality import quality_metrics
from saleskiln.plans.contracts import CLIENT_FIELDS, PRODUCT_FIELDS, SALE_FIELDS, fields_for
from saleskiln.sources.schemas import BATCH_COLUMN, cart_schema, product_schema, prune, user_schema

BRONZE_ONLY = {"row_id", BATCH_COLUMN}
MEASURE = "unit_price"
#: What the totals show of a client.
DESCRIBED = ("client_id", "client_first_name", "client_last_name")


def needed(schema: StructType, fields: list[Field], item: str | None = None, array: str | None = None) -> StructType:
    """Raw schema cut down to the paths ``fields`` read; paths under ``item`` are elements of ``array``."""
    paths = [path for _, path, _ in fields if path not in BRONZE_ONLY]
    if item:
        paths = [f"{array}{path[len(item):]}" if path.startswith(f"{item}.") else path for path in paths]
    return prune(schema, paths)


def raw_columns(bronze: DataFrame) -> DataFrame:
    return bronze.select("raw_json", BATCH_COLUMN, "row_id")


def parsed(bronze: DataFrame, schema: StructType, fields: list[Field], rejects: bool) -> DataFrame:
    """Cleaned rows of a batch, one per raw record; with ``rejects`` also why a record cannot be used, and its text."""
    raw = raw_columns(bronze)
    if not rejects:
        return project_fields(parse_records(raw, needed(schema, fields)), fields)
    return project_fields(parse_or_reject(raw, needed(schema, fields), "id"), fields, [F.col(REJECT), F.col(REJECTED_TEXT)])


def client_rows(bronze: DataFrame, id_type: str = "bigint", only: Sequence[str] | None = None, rejects: bool = False) -> DataFrame:
    """Cleaned client rows of a batch, one per raw record.

    ``only`` names the columns a reader needs; the optimizer cannot prune fields of a JSON text, so
    naming them is what keeps the others from being parsed.
    """
    return parsed(bronze, user_schema(id_type), fields_for(CLIENT_FIELDS, id_type, only), rejects)


def product_rows(bronze: DataFrame, id_type: str = "bigint", only: Sequence[str] | None = None, rejects: bool = False) -> DataFrame:
    return parsed(bronze, product_schema(id_type), fields_for(PRODUCT_FIELDS, id_type, only), rejects)


def sale_rows(bronze: DataFrame, id_type: str = "bigint", rejects: bool = False) -> DataFrame:
    """Cleaned sale lines of a batch, one per cart and line, with their natural keys; a rejected cart is one line
    without a product."""
    fields = fields_for(SALE_FIELDS, id_type)
    schema, raw = needed(cart_schema(id_type), fields, "line", "products"), raw_columns(bronze)
    if not rejects:
        return project_fields(explode_lines(parse_records(raw, schema), "products", "line"), fields)
    carts = parse_or_reject(raw, schema, "id")
    lines = explode_lines(carts, "products", "line", keep=F.col(REJECT).isNotNull())
    return project_fields(lines, fields, [F.col(REJECT), F.col(REJECTED_TEXT)])


def lines_with_members(bronze: DataFrame, products: DataFrame, clients: DataFrame, id_type: str) -> DataFrame:
    """Every line, with its ``hash_id`` and the surrogates of its product and client where they are known.

    The digest comes last: it is four times as long as the ids it is made of, and the lookups may shuffle.
    """
    lines = lookup_key(sale_rows(bronze, id_type), products, "product_id", "sk_product")
    lines = lookup_key(lines, clients, "client_id", "sk_client")
    return lines.select(hash_key("cart_id", "product_id").alias("hash_id"), "*")


def dim_client(
    bronze: DataFrame,
    id_type: str = "bigint",
    observation: Observation | None = None,
    only: Sequence[str] | None = None,
    rejects: bool = False,
) -> DataFrame:
    """Client dimension rows: gate on the key, keep the newest row per client, add the surrogate.

    ``rejects`` keeps what the gate would drop, with its reason and text, as rows without a key.
    """
    checks = {"invalid_emails": invalid_email("client_email")} if observation else None
    return dimension(client_rows(bronze, id_type, only, rejects), "client_id", "client", observation, checks, rejects)


def dim_product(
    bronze: DataFrame,
    id_type: str = "bigint",
    observation: Observation | None = None,
    only: Sequence[str] | None = None,
    rejects: bool = False,
) -> DataFrame:
    return dimension(product_rows(bronze, id_type, only, rejects), "product_id", "product", observation, None, rejects)


def dimension(
    rows: DataFrame, key: str, entity: str, observation: Observation | None, checks: dict | None = None, rejects: bool = False
) -> DataFrame:
    if rejects:
        # rejected rows have no key; each is a key of its own, so that all of them stay
        seen = rows.observe(observation, *quality_metrics(key, checks)) if observation else rows
        latest = keep_latest_or_rejected(seen, [key], ["row_id"])
    else:
        keyed = gate(rows, key, observation, checks) if observation else drop_null_keys(rows, key)
        latest = keep_latest(keyed, [key], BATCH_COLUMN, ["row_id"])
    return latest.select(surrogate_key(entity, key).alias(f"sk_{entity}"), "*")


def keep_latest_or_rejected(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    own = free_name(rows, "own_key")
    marked = rows.withColumn(own, F.when(F.col(REJECT).isNotNull(), F.col("row_id")))
    return keep_latest(marked, [*keys, own], BATCH_COLUMN, ties).drop(own)


def surrogate_of(entity: str, ids: DataFrame, other: DataFrame) -> Column | None:
    """The surrogate that an id has by its definition, if the id is of one type in both frames, so that its text is too."""
    key = f"{entity}_id"
    return surrogate_key(entity, key) if ids.schema[key].dataType == other.schema[key].dataType else None


def with_surrogates(lines: DataFrame, products: DataFrame, clients: DataFrame) -> DataFrame:
    """``lines`` with ``sk_product`` and ``sk_client`` as ``packed`` by ``surrogate_of``."""
    found = lines
    for entity, members in (("product", products), ("client", clients)):
        key, surrogate = f"{entity}_id", f"sk_{entity}"
        short = packed(surrogate, surrogate_of(entity, members, lines))
        found = lookup_key(found, members.select(key, short.alias(surrogate)), key, surrogate)
    return found


def sale_lines_latest(
    bronze: DataFrame,
    products: DataFrame,
    clients: DataFrame,
    id_type: str = "bigint",
    observation: Observation | None = None,
    rejects: bool = False,
    reduce_products: bool = False,
    members: Observation | None = None,
    row_ids: bool = True,
) -> DataFrame:
    """Newest line per cart and product, with both surrogates ``packed`` by ``surrogate_of``, NULL where a member is
    unknown or there is no product; ``row_id`` is packed as well, and there is no ``hash_id`` yet.

    What goes through the exchanges decides what a fact load costs, so the deduplication is by the ids that the digest
    is made of, and comes ahead of the lookups: left joins on members that occur once change no line. Digests travel
    packed, and surrogates that follow from the id as one byte. Whole lines go through the exchange of the deduplication
    only: the lookups are of the ids alone, and what they find comes back to the lines, which are still dealt by their key.
    Both read the same exchange. Without ``row_ids`` the winners' ids are arbitrary: lines that are equal in all else differ
    in nothing but that. Such lines are for readers of few columns, and go through the lookups themselves.
    ``reduce_products`` drops lines of unknown products by a bitmap ahead of it all. That is safe for products, which
    are part of the key; a line of an unknown client may be the newest of its key and has to come along.
    ``observation`` counts the lines read, ``members`` the newest ones and their unknown members.
    """
    lines = sale_rows(bronze, id_type, rejects)
    if observation:
        lines = lines.observe(observation, F.count(F.lit(1)).alias("lines_read"), F.count_if(F.col("cart_id").isNull()).alias("lines_without_cart"))
    if reduce_products:
        lines = likely_known(lines, products, "product_id", keep=F.col(REJECT).isNotNull() if rejects else None)
    lines = lines.withColumn("row_id", packed("row_id"))
    ties = ["unit_price", "quantity", "net_amount", "gross_amount", "cart_total", "cart_discounted_total", "client_id", *(["row_id"] if row_ids else [])]
    whole = {"product_id", "cart_id"} <= {field.name for field in lines.schema if isinstance(field.dataType, IntegralType)}
    text, own = free_name(lines, "key_text"), free_name(lines, "own_key")
    if not whole:
        # as texts, different ids may be joined to the same text, which is one key
        lines = lines.withColumn(text, F.concat_ws(KEY_SEPARATOR, "cart_id", "product_id"))
    keys = ["cart_id", "product_id"] if whole else [text]
    if rejects:
        # rejected lines have no key; each is a key of its own, so that all of them stay
        lines = lines.withColumn(own, F.when(F.col(REJECT).isNotNull(), F.col("row_id")).otherwise(F.lit(b"")))
        keys = [*keys, own]
        # the order names every column: one that it left out would be pruned below the lookups, and the exchange be another
        ties += [REJECT, REJECTED_TEXT]
    else:
        # a digest skips NULLs, so lines of unknown carts would fuse into one
        lines = lines.filter(F.col("cart_id").isNotNull())
    latest = keep_latest(lines, keys, BATCH_COLUMN, ties)
    ids = [*keys, *[name for name in ("product_id", "client_id") if name not in keys]]
    found = with_surrogates(latest.select(*ids) if row_ids else latest, products, clients)
    if members or rejects:
        # counted with rejects in any case: the join below would send its null tests through to one reader of the exchange
        found = found.observe(
            members or Observation(),
            F.count(F.lit(1)).alias("lines_newest"),
            F.count_if(F.col("sk_product").isNull()).alias("lines_without_product"),
            F.count_if(F.col("sk_client").isNull()).alias("lines_without_client"),
        )
    if row_ids:
        found = latest.join(found.select(*keys, "sk_product", "sk_client"), keys, "left")
    return found.drop(text, own)


def ft_sale(
    bronze: DataFrame,
    products: DataFrame,
    clients: DataFrame,
    id_type: str = "bigint",
    observation: Observation | None = None,
    rejects: bool = False,
    reduce_products: bool = False,
    members: Observation | None = None,
    row_ids: bool = True,
) -> DataFrame:
    """Sale facts: lines of an unknown client or product are dropped, natural keys are not stored."""
    lines = sale_lines_latest(bronze, products, clients, id_type, observation, rejects, reduce_products, members, row_ids)
    if rejects:
        known = F.col("sk_product").isNotNull() & F.col("sk_client").isNotNull()
        lines = lines.filter(known | F.col(REJECT).isNotNull())
    else:
        lines = resolved(lines, "sk_product", "sk_client")
    surrogates = {
        f"sk_{entity}": unpacked(f"sk_{entity}", surrogate_of(entity, lines, frame)) for entity, frame in (("product", products), ("client", clients))
    }
    keyed = lines.select(hash_key("cart_id", "product_id").alias("hash_id"), "*").withColumns({"row_id": unpacked("row_id"), **surrogates})
    return keyed.drop("client_id", "product_id")


def sale_audit(bronze: DataFrame, products: DataFrame, clients: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row on what the fact build leaves out: repeated lines and lines of unknown members."""
    lines = lines_with_members(bronze, products, clients, id_type)
    per_key = lines.groupBy("hash_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("sk_product").isNull()).alias("no_product"),
        F.count_if(F.col("sk_client").isNull()).alias("no_client"),
    )
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("lines_read"),
        F.count(F.lit(1)).alias("lines_distinct"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("repeated_lines"),
        F.coalesce(F.sum("no_product"), F.lit(0)).cast("bigint").alias("lines_without_product"),
        F.coalesce(F.sum("no_client"), F.lit(0)).cast("bigint").alias("lines_without_client"),
    )


def sales_by_client(sales: DataFrame, clients: DataFrame, measure: str = MEASURE, observation: Observation | None = None) -> DataFrame:
    """Total per client. ``measure`` is summed as it is, not multiplied by the quantity."""
    totals = client_totals(sales, clients, measure)
    return gate(totals, "client_id", observation) if observation else drop_null_keys(totals, "client_id")


def client_totals(sales: DataFrame, clients: DataFrame, measure: str = MEASURE) -> DataFrame:
    """Totals in front of the gate: members without a client id are still there."""
    return total_by_member(sales, clients, "sk_client", list(DESCRIBED), measure, "total_carrinho")


def sales_of(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the clients in ``members`` (distinct ``sk_client``), reduced before anything is summed."""
    return rows.join(members, "sk_client", "left_semi")
