"""Metrics (E1-E3), one-hot encoding and class weights (M1, M3)."""

from faultline.operators import features as M
from faultline.operators import metrics as E


def test_confusion_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "is_significant int, prediction int")
    got = {r.is_significant: (r.pred_0, r.pred_1) for r in E.confusion_matrix(df).collect()}
    assert got == {0: (2, 0), 1: (1, 0)}
    rep = {r.row: r for r in E.classification_report(df).collect()}
    assert (rep["1"].precision, rep["1"].recall, rep["1"].f1) == (0.0, 0.0, 0.0)
    assert abs(rep["accuracy"].f1 - 2 / 3) < 1e-12
    assert E.accuracy(df).first()["accuracy"] == 2 / 3


def test_one_hot_null_all_zero(spark):
    df = spark.createDataFrame([(1, "Luzon"), (2, None), (3, "Visayas")], "k int, Region string")
    got = {r.k: (r.Region_Luzon, r.Region_Visayas) for r in M.one_hot(df, "Region").collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_class_weight(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "is_significant int")
    got = sorted((r.is_significant, r.weight) for r in M.class_weight(df).collect())
    assert got == [(0, 1.0), (0, 1.0), (0, 1.0), (1, 3.0)]


def test_feature_columns_prefix():
    class D:
        columns = ["Latitude", "Longitude", "Depth_In_Km", "Hour", "DayOfWeek", "Month", "Region_Luzon",
                   "Region_Visayas", "Depth_Category"]
    assert M.feature_columns(D()) == ["Latitude", "Longitude", "Depth_In_Km", "Hour", "DayOfWeek", "Month",
                                      "Region_Luzon", "Region_Visayas"]
