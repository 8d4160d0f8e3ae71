"""Hash keys: computed per row, so they need no shuffle, sequence or global ordering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from saleskiln.functions.text import ColumnOrName, as_column

# Separator and digest length of every hash key.
KEY_SEPARATOR = "-"
DIGEST_BITS = 256


def hash_key(*parts: ColumnOrName) -> Column:
    """Lower-case hex digest of the joined parts; NULL parts are skipped, not hashed as text.

    The digest is never NULL. ``coalesce`` tells the optimizer so; otherwise a join or filter on the key
    would compute the digest a second time per row for an inferred not-null test.
    """
    digest = F.sha2(F.concat_ws(KEY_SEPARATOR, *[as_column(part) for part in parts]), DIGEST_BITS)
    return F.coalesce(digest, F.lit(""))


def surrogate_key(entity: str, natural_key: ColumnOrName) -> Column:
    """Stable surrogate of one dimension member; NULL for a NULL natural key."""
    key = as_column(natural_key)
    return F.when(key.isNotNull(), hash_key(F.lit(entity), key))


def packed(text: ColumnOrName, known: Column | None = None) -> Column:
    """Digests in half their bytes, for the way through an exchange: an even number of lower-case hex digits as the bytes
    they stand for, any other text as it is; a first byte tells them apart. Texts of one kind keep their order.

    With ``known``, what a reader can work out again, a text that equals it is that first byte alone.
    """
    text = as_column(text)
    digits = F.concat(F.lit(b"\x01"), F.unhex(text))
    whole = (F.length(text) % 2 == 0) & text.rlike(r"\A[0-9a-f]*+\z")
    short = F.when(whole, digits).otherwise(F.concat(F.lit(b"\x00"), text.cast("binary")))
    return short if known is None else F.when(text == known, F.lit(b"\x02")).otherwise(short)


def unpacked(value: ColumnOrName, known: Column | None = None) -> Column:
    """The text that ``packed`` was given, with the same ``known``."""
    value = as_column(value)
    rest = F.substr(value, F.lit(2))
    text = F.when(F.substring(value, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
    return text if known is None else F.when(value == F.lit(b"\x02"), known).otherwise(text)
