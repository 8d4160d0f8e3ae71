"""Text standardisation as plain Column expressions (no UDFs, all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Pattern of a well-formed address, and what a phone number does not keep.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
NOT_DIAL_CHARACTER = r"(?!^\+)[^0-9]"

ColumnOrName = Column | str


def as_column(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trimmed(value: ColumnOrName) -> Column:
    """Strip blanks (only blanks: tabs and line breaks stay)."""
    return F.trim(as_column(value))


def clean_upper(value: ColumnOrName) -> Column:
    return trimmed(F.upper(as_column(value).cast("string")))


def clean_lower(value: ColumnOrName) -> Column:
    return trimmed(F.lower(as_column(value).cast("string")))


def phone_digits(value: ColumnOrName) -> Column:
    """Digits of a phone number; a ``+`` in the very first position survives.

    The prefix test sees the untrimmed text, so a blank before the ``+`` loses it. The whole text is read.
    """
    return F.regexp_replace(as_column(value), NOT_DIAL_CHARACTER, "")


def invalid_email(value: ColumnOrName) -> Column:
    """True for a present address that is malformed; false for a good or an absent one."""
    address = as_column(value)
    return address.isNotNull() & ~address.rlike(EMAIL_PATTERN)
