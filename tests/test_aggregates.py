"""Aggregates on micro-fixtures."""

from pyspark.sql import functions as F

from faultline.operators import aggregates as A


def test_modal_smallest_on_ties_and_default(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, None)], "g int, v string")
    got = {r.g: r.m for r in A.modal(df, "g", "v", "m").collect()}
    assert got == {1: "a", 2: "Unknown"}


def test_value_counts_and_top(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "v string")
    got = [(r["rank"], r.v, r.n) for r in A.top_values(df, "v", 10).collect()]
    assert got == [(1, "a", 2), (2, "b", 2), (3, "c", 1)]


def test_crosstab_zero_cells(spark):
    df = spark.createDataFrame([("x", 0), ("x", 1), ("y", 0)], "r string, f int")
    got = {r.r: (r.n0, r.n1) for r in A.crosstab(df, "r", "f", [0, 1], ["n0", "n1"]).collect()}
    assert got == {"x": (1, 1), "y": (1, 0)}


def test_zone_summary(spark):
    df = spark.createDataFrame([(-1,), (0,), (0,), (1,)], "Cluster int")
    r = A.zone_summary(df).first()
    assert (r.n_labels, r.n_zones, r.n_noise) == (3, 2, 1)


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(6)], "x double")
    got = [r.n for r in A.histogram(df, "x", 5).collect()]
    assert got == [1, 1, 1, 1, 2]


def test_histogram_matches_numpy(spark):
    import numpy as np
    vals = [1.0, 1.1, 1.7, 2.3, 2.9, 3.0, 4.4, 4.4, 5.9, 6.0, 1.3, 2.2]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.n for r in A.histogram(df, "x", 7).collect()]
    assert got == list(np.histogram(vals, bins=7)[0])


def test_impute_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in A.impute_mean(df, ["x"]).collect()) == [1.0, 2.0, 3.0]


def test_histogram_by_class_counts_add_up(spark):
    df = spark.range(100).select((F.col("id") / 10).alias("x"), (F.col("id") % 2).cast("int").alias("c"))
    h = A.histogram(df, "x", 30, by="c", by_values=[0, 1])
    assert h.count() == 60 and h.agg(F.sum("n")).first()[0] == 100
