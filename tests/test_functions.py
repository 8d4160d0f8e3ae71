"""Column builders on hand-written edge rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from saleskiln import functions as K
from saleskiln.functions.typed import GENDER_CODES


def values(spark, rows, column, ddl="v string"):
    frame = spark.createDataFrame([(row,) for row in rows], ddl)
    return [row[0] for row in frame.select(column).collect()]


def test_cleaning(spark):
    rows = ["  aB c ", "", None, "\tx "]
    assert values(spark, rows, K.clean_upper("v")) == ["AB C", "", None, "\tX"]
    assert values(spark, rows, K.clean_lower("v")) == ["ab c", "", None, "\tx"]
    assert values(spark, rows, K.trimmed("v")) == ["aB c", "", None, "\tx"]
    assert values(spark, [7, None], K.clean_upper("v"), "v int") == ["7", None]


@pytest.mark.parametrize(
    "phone, clean",
    [
        ("+55 (11) 9-1", "+551191"),
        (" +55 1", "551"),
        ("11-22", "1122"),
        ("+1+2", "+12"),
        ("++1", "+1"),
        ("+", "+"),
        ("", ""),
        (None, None),
        ("+" + "1 " * 60, "+" + "1" * 60),
        ("1 " * 60, "1" * 60),
    ],
)
def test_phone(spark, phone, clean):
    assert values(spark, [phone], K.phone_digits("v")) == [clean]


def test_email(spark):
    rows = ["a@b.c", "a b@c.d", "bad", "a@b", "@b.c", None]
    assert values(spark, rows, K.invalid_email("v")) == [False, True, True, True, True, False]


def test_hash_key(spark):
    frame = spark.createDataFrame([(1, 2), (None, 2)], "a int, b int")
    got = [row[0] for row in frame.select(K.hash_key("a", "b")).collect()]
    only_two = spark.range(1).select(F.sha2(F.lit("2"), 256)).first()[0]
    assert got == ["412a4789b02cad19bacb029f5c8ec8e9b115375d82b97df1d6b15997a8e70e01", only_two]


def test_surrogate_key(spark):
    got = values(spark, [1, None], K.surrogate_key("client", "v"), "v int")
    other = values(spark, [1], K.surrogate_key("product", "v"), "v int")
    assert len(got[0]) == 64 and got[1] is None and got[0] != other[0]


def test_adult_flag(spark):
    assert values(spark, [None, 17, 18], K.adult_flag("v"), "v int") == [None, False, True]
    assert values(spark, ["x", "30"], K.adult_flag("v")) == [None, True]


def test_code_map(spark):
    rows = [" male ", "Female", "OTHER", "x", None]
    assert values(spark, rows, K.code_map("v", GENDER_CODES)) == ["M", "F", "O", None, None]


def test_safe_casts(spark):
    days = values(spark, ["1996-5-30", "not a date", None], K.to_date_safe("v"))
    assert days == [datetime.date(1996, 5, 30), None, None]
    moments = values(spark, ["2024-05-01 08:00:00", "08:00 o'clock"], K.batch_time_text(K.to_timestamp_safe("v")))
    assert moments == ["2024-05-01 08:00:00", None]
    assert values(spark, ["12", "1.5x", None], K.safe_cast("v", "int")) == [12, None, None]


def test_metric_default(spark):
    frame = spark.sql("SELECT map('rows', '5') AS m")
    assert frame.select(K.metric_or_missing("m", "rows"), K.metric_or_missing("m", "none")).first()[:] == ("5", "n/a")


def test_batch_time_text_of_now(spark):
    text = spark.range(1).select(K.batch_time_text()).first()[0]
    datetime.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
