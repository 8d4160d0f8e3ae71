"""Column builders."""

from saleskiln.functions.keys import hash_key, surrogate_key
from saleskiln.functions.text import (
    EMAIL_PATTERN,
    clean_lower,
    clean_upper,
    invalid_email,
    phone_digits,
    trimmed,
)
from saleskiln.functions.typed import (
    GENDER_CODES,
    adult_flag,
    batch_time_text,
    code_map,
    metric_or_missing,
    safe_cast,
    to_date_safe,
    to_timestamp_safe,
)

__all__ = [
    "EMAIL_PATTERN",
    "GENDER_CODES",
    "adult_flag",
    "batch_time_text",
    "clean_lower",
    "clean_upper",
    "code_map",
    "hash_key",
    "invalid_email",
    "metric_or_missing",
    "phone_digits",
    "safe_cast",
    "surrogate_key",
    "to_date_safe",
    "to_timestamp_safe",
    "trimmed",
]
