"""Stored tables: columns, keys and how an upsert treats them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql.types import StructType

from saleskiln.operators.parse import Field
from saleskiln.operators.upsert import UpsertRule
from saleskiln.sources.schemas import BATCH_COLUMN

TOUCHED = "updated_timestamp"

# Column names of the stored tables, the raw field each comes from and the rule that
# cleans it (a rule name of ``operators.parse.RULES``, or a type; "{id}" is the configured id type).
CLIENT_FIELDS: tuple[Field, ...] = (
    ("client_id", "id", "{id}"),
    ("client_first_name", "firstName", "upper"),
    ("client_last_name", "lastName", "upper"),
    ("client_maiden_name", "maidenName", "upper"),
    ("client_age", "age", "int"),
    ("is_adult", "age", "adult"),
    ("client_gender", "gender", "gender"),
    ("client_birthdate", "birthDate", "date"),
    ("client_email", "email", "lower"),
    ("client_username", "username", "trim"),
    ("client_phone", "phone", "trim"),
    ("client_phone_clean", "phone", "phone"),
    ("client_address", "address.address", "upper"),
    ("client_city", "address.city", "upper"),
    ("client_state", "address.state", "upper"),
    ("client_country", "address.country", "upper"),
    ("client_state_code", "address.stateCode", "trim"),
    ("client_postal_code", "address.postalCode", "trim"),
    ("client_latitude", "address.coordinates.lat", "double"),
    ("client_longitude", "address.coordinates.lng", "double"),
    ("university", "university", "upper"),
    ("company_department", "company.department", "upper"),
    ("company_name", "company.name", "upper"),
    ("company_title", "company.title", "upper"),
    ("company_address", "company.address.address", "upper"),
    ("company_city", "company.address.city", "upper"),
    ("company_state", "company.address.state", "upper"),
    ("company_state_code", "company.address.stateCode", "trim"),
    ("company_postal_code", "company.address.postalCode", "trim"),
    ("company_country", "company.address.country", "upper"),
    ("company_latitude", "company.address.coordinates.lat", "double"),
    ("company_longitude", "company.address.coordinates.lng", "double"),
    ("role", "role", "lower"),
    (BATCH_COLUMN, BATCH_COLUMN, "timestamp"),
    ("row_id", "row_id", "same"),
)

PRODUCT_FIELDS: tuple[Field, ...] = (
    ("product_id", "id", "{id}"),
    ("product_name", "title", "upper"),
    ("product_description", "description", "upper"),
    ("product_category", "category", "upper"),
    ("product_brand", "brand", "upper"),
    ("product_price", "price", "double"),
    ("product_stock", "stock", "int"),
    (BATCH_COLUMN, BATCH_COLUMN, "timestamp"),
    ("row_id", "row_id", "same"),
)

SALE_FIELDS: tuple[Field, ...] = (
    ("cart_id", "id", "{id}"),
    ("client_id", "userId", "{id}"),
    ("product_id", "line.id", "{id}"),
    ("quantity", "line.quantity", "same"),
    ("unit_price", "line.price", "same"),
    ("gross_amount", "line.total", "same"),
    ("net_amount", "line.discountedTotal", "same"),
    ("cart_total", "total", "same"),
    ("cart_discounted_total", "discountedTotal", "same"),
    (BATCH_COLUMN, BATCH_COLUMN, "timestamp"),
    ("row_id", "row_id", "same"),
)

CLIENT_DDL = f"""
    sk_client string, client_id {{id}}, client_first_name string, client_last_name string,
    client_maiden_name string, client_age int, is_adult boolean, client_gender string,
    client_birthdate date, client_email string, client_username string, client_phone string,
    client_phone_clean string, client_address string, client_city string, client_state string,
    client_country string, client_state_code string, client_postal_code string,
    client_latitude double, client_longitude double, university string, company_department string,
    company_name string, company_title string, company_address string, company_city string,
    company_state string, company_state_code string, company_postal_code string,
    company_country string, company_latitude double, company_longitude double, role string,
    {BATCH_COLUMN} timestamp, row_id string, {TOUCHED} timestamp
"""

PRODUCT_TABLE_DDL = f"""
    sk_product string, product_id {{id}}, product_name string, product_description string,
    product_category string, product_brand string, product_price double, product_stock int,
    {BATCH_COLUMN} timestamp, row_id string, {TOUCHED} timestamp
"""

SALE_DDL = f"""
    hash_id string, cart_id {{id}}, sk_product string, sk_client string, quantity int,
    unit_price double, gross_amount double, net_amount double, cart_total double,
    cart_discounted_total double, {BATCH_COLUMN} timestamp, row_id string, {TOUCHED} timestamp
"""

TOTALS_DDL = """
    client_id {id}, client_first_name string, client_last_name string, total_carrinho double
"""


@dataclass(frozen=True)
class TableContract:
    layer: str
    table: str
    ddl: str
    rule: UpsertRule
    # Keep versions of the table bucketed on the key. Worth it for a fact table, whose upsert otherwise
    # shuffles all of it; dimensions stay unbucketed so that lookups against them remain open to
    # adaptive skew handling.
    bucketed: bool = False

    def schema(self, id_type: str = "bigint") -> StructType:
        return StructType.fromDDL(self.ddl.format(id=id_type))


DIM_CLIENT = TableContract("silver", "dim_client", CLIENT_DDL, UpsertRule(("client_id",), (BATCH_COLUMN,), TOUCHED))
DIM_PRODUCT = TableContract(
    "silver", "dim_product", PRODUCT_TABLE_DDL, UpsertRule(("product_id",), (BATCH_COLUMN,), TOUCHED)
)
FT_SALE = TableContract("silver", "ft_sale", SALE_DDL, UpsertRule(("hash_id",), (BATCH_COLUMN,), TOUCHED), bucketed=True)
SALES_BY_CLIENT = TableContract("gold", "sales_by_client", TOTALS_DDL, UpsertRule(("client_id",)))


def fields_for(fields: tuple[Field, ...], id_type: str, only: Sequence[str] | None = None) -> list[Field]:
    """Fields with the id type filled in; ``only`` keeps the named columns and the bookkeeping ones."""
    kept = None if only is None else {*only, BATCH_COLUMN, "row_id"}
    return [(target, path, rule.format(id=id_type)) for target, path, rule in fields if kept is None or target in kept]
