"""Shapes of the raw records and of the bronze tables that hold them as text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import ArrayType, StructField, StructType

# Field names and types of the raw records, and the bronze columns.
POSTAL_DDL = (
    "struct<address:string,city:string,state:string,stateCode:string,postalCode:string,"
    "coordinates:struct<lat:double,lng:double>,country:string>"
)

USER_DDL = f"""
    id {{id}}, firstName string, lastName string, maidenName string, age int, gender string,
    email string, phone string, username string, password string, birthDate string, image string,
    bloodGroup string, height double, weight double, eyeColor string,
    hair struct<color:string,type:string>, ip string, address {POSTAL_DDL},
    macAddress string, university string,
    bank struct<cardExpire:string,cardNumber:string,cardType:string,currency:string,iban:string>,
    company struct<department:string,name:string,title:string,address:{POSTAL_DDL}>,
    ein string, ssn string, userAgent string,
    crypto struct<coin:string,wallet:string,network:string>, role string
"""

PRODUCT_DDL = """
    id {id}, title string, description string, category string, price double,
    discountPercentage double, rating double, stock int, tags array<string>, brand string,
    sku string, weight int, dimensions struct<width:double,height:double,depth:double>,
    warrantyInformation string, shippingInformation string, availabilityStatus string,
    reviews array<struct<rating:int,comment:string,date:string,reviewerName:string,reviewerEmail:string>>,
    returnPolicy string, minimumOrderQuantity int,
    meta struct<createdAt:string,updatedAt:string,barcode:string,qrCode:string>,
    images array<string>, thumbnail string
"""

CART_DDL = """
    id {id}, userId {id}, total double, discountedTotal double, totalProducts int, totalQuantity int,
    products array<struct<id:{id},title:string,price:double,quantity:int,total:double,
                          discountPercentage:double,discountedTotal:double,thumbnail:string>>
"""

BATCH_COLUMN = "ingestion_timestamp"
BRONZE_DDL = f"raw_json string, row_id string, source string, {BATCH_COLUMN} string"

# Entity name = name of the record list inside a landed page.
ENTITIES = ("users", "products", "carts")


def user_schema(id_type: str = "bigint") -> StructType:
    return StructType.fromDDL(USER_DDL.format(id=id_type))


def product_schema(id_type: str = "bigint") -> StructType:
    return StructType.fromDDL(PRODUCT_DDL.format(id=id_type))


def cart_schema(id_type: str = "bigint") -> StructType:
    return StructType.fromDDL(CART_DDL.format(id=id_type))


def prune(schema: StructType, paths: Iterable[str]) -> StructType:
    """The part of ``schema`` that holds the dotted ``paths``.

    JSON parsing only materialises the fields it is asked for, so a narrow schema saves work on every
    record. A path may stop at a struct or array to keep all of it, or go on into it.
    """
    wanted: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        wanted.setdefault(head, []).append(rest)
    unknown = wanted.keys() - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"not in the raw schema: {sorted(unknown)}")

    def narrow(field: StructField) -> StructField:
        inner = wanted[field.name]
        if "" in inner:
            return field
        if isinstance(field.dataType, ArrayType):
            item = prune(field.dataType.elementType, inner)
            return StructField(field.name, ArrayType(item, field.dataType.containsNull), field.nullable)
        return StructField(field.name, prune(field.dataType, inner), field.nullable)

    return StructType([narrow(field) for field in schema.fields if field.name in wanted])
