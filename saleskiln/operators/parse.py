"""Raw text to typed columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from saleskiln.functions import adult_flag, clean_lower, clean_upper, code_map, phone_digits, safe_cast, trimmed
from saleskiln.functions.typed import GENDER_CODES

Field = tuple[str, str, str]

RULES: dict[str, Callable[[Column], Column]] = {
    "same": lambda value: value,
    "upper": clean_upper,
    "lower": clean_lower,
    "trim": trimmed,
    "phone": phone_digits,
    "adult": adult_flag,
    "gender": lambda value: code_map(value, GENDER_CODES),
}


def parse_records(df: DataFrame, schema: StructType, text: str = "raw_json") -> DataFrame:
    """Replace ``text`` by the fields of its JSON document.

    Malformed text gives a row of NULLs and a field of the wrong type gives NULL for that field; the row
    stays. ``inline(array(...))`` is used in place of a struct column and ``data.*``: predicates on parsed
    fields do not move below a generator, whereas below a projection the optimizer copies the parser into
    each of them and every record would be parsed two or three times.
    """
    carried = [F.col(name) for name in df.columns if name != text]
    return df.select(*carried, F.inline(F.array(F.from_json(text, schema))))


#: Why a record was rejected, and its text; both NULL for a record that is used.
REJECT, REJECTED_TEXT = "reject_reason", "rejected_text"
CORRUPT = "_corrupt_record"


def parse_or_reject(df: DataFrame, schema: StructType, key: str, text: str = "raw_json") -> DataFrame:
    """``parse_records`` with ``reject_reason`` and ``rejected_text``, in the same pass.

    A record is rejected if its ``key`` is NULL: as ``unreadable`` where the parser refused the text or the type of a
    field, as ``no text`` where there is none, as ``no key`` else. A record with a key is used, also where another of
    its fields did not convert and is NULL.
    """
    carried = [F.col(name) for name in df.columns]
    flagged = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = df.select(*carried, F.inline(F.array(F.from_json(text, flagged, {"columnNameOfCorruptRecord": CORRUPT}))))
    reason = F.when(F.col(text).isNull(), "no text").when(F.col(CORRUPT).isNotNull(), "unreadable").otherwise("no key")
    out = parsed.withColumn(REJECT, F.when(F.col(key).isNull(), reason))
    return out.withColumn(REJECTED_TEXT, F.when(F.col(REJECT).isNotNull(), F.col(text))).drop(text, CORRUPT)


def project_fields(df: DataFrame, fields: Iterable[Field], extra: Sequence[Column] = ()) -> DataFrame:
    """Select ``(target, path, rule)`` fields; a rule is a name in ``RULES`` or a type to cast to."""
    chosen = [
        (RULES[rule](F.col(path)) if rule in RULES else safe_cast(F.col(path), rule)).alias(target)
        for target, path, rule in fields
    ]
    return df.select(*chosen, *extra)


def explode_lines(df: DataFrame, array: str, item: str = "line", keep: Column | None = None) -> DataFrame:
    """One row per element of ``array``; rows with a NULL or empty array disappear, but for those to ``keep``, which
    stay once without an item."""
    carried = [F.col(name) for name in df.columns if name != array]
    if keep is None:
        return df.select(*carried, F.explode(array).alias(item))
    kind = df.schema[array].dataType
    return df.select(*carried, F.explode(F.when(keep, F.array(F.lit(None).cast(kind.elementType))).otherwise(F.col(array))).alias(item))
