"""Column functions on micro-fixtures."""

import datetime as dt
import math

from pyspark.sql import functions as F

from faultline.constants import DEPTH_EDGES, DEPTH_LABELS, REGION_GROUPS
from faultline.functions.columns import (
    classify_by_keywords, cut, round_half_even, text_to_double_or_null, threshold_flag,
    to_timestamp_or_null,
)


def col_values(spark, values, schema, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_timestamp_or_null(spark):
    got = col_values(spark, ["2025-10-15 00:00:00", "not-a-date", "2025-10-15", None], "string",
                     lambda c: to_timestamp_or_null(c, ["yyyy-MM-dd HH:mm:ss"]))
    assert got == [dt.datetime(2025, 10, 15), None, None, None]


def test_text_to_double(spark):
    vals = ["010", " 10 ", "1e3", "inf", "5d", "1_000", "0x10", "1,000", "NaN", ""]
    got = col_values(spark, vals, "string", text_to_double_or_null)
    assert got[:3] == [10.0, 10.0, 1000.0]
    assert math.isinf(got[3]) and got[3] > 0
    assert got[4:] == [None] * 6


def test_threshold_flag(spark):
    assert col_values(spark, [3.9, 4.0, 4.1], "double", lambda c: threshold_flag(c, 4.0)) == [0, 1, 1]


def test_region_keywords(spark):
    vals = [None, "", "DAVAO ORIENTAL", "Cagayan De Oro City", "Masbate", "Aklan",
            "Quezon (Bukidnon)", "Samar", "Eastern Samar"]
    got = col_values(spark, vals, "string", lambda c: classify_by_keywords(c, REGION_GROUPS, "Unknown"))
    assert got == ["Unknown", "Unknown", "Mindanao", "Luzon", "Luzon", "Unknown", "Luzon", "Unknown", "Visayas"]


def test_weekday_monday_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 10, 13, 5, 0),)], "t timestamp_ntz")
    assert df.select(F.weekday("t")).first()[0] == 0


def test_depth_bands(spark):
    vals = [-1.0, 0.0, 10.0, 10.0001, 35.0, 70.0, 300.0, 301.0, float("inf")]
    got = col_values(spark, vals, "double", lambda c: cut(c, DEPTH_EDGES, DEPTH_LABELS))
    assert got == [None, None, "Shallow", "Intermediate", "Intermediate", "Deep", "Very Deep",
                   "Extremely Deep", "Extremely Deep"]


def test_round_half_even(spark):
    assert col_values(spark, [2.345, 2.675], "double", lambda c: round_half_even(c, 2)) == [2.35, 2.68]


def test_fixed_text_rounds_the_binary_value(spark):
    import random

    from faultline.functions.columns import fixed_text
    rng = random.Random(1)
    xs = [0.125, 2.675, 1.005, 1.115, 0.285, 0.0, 99.995, 0.375, 12.5, -2.675, 100.0, 1e-9, 33.335, 0.045, 0.995]
    xs += [rng.uniform(0, 100) for _ in range(300)] + [k / 1000 for k in range(0, 3000, 5)] + [k / 32 for k in range(100)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (2, 4):
        got = [r.t for r in df.select(fixed_text("x", d).alias("t")).collect()]
        assert got == [f"{x:.{d}f}" for x in xs]
