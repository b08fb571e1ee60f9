"""Evaluation of binary predictions.

All of them start from one ``groupBy(label, prediction).count()``: a partial
hash aggregate that leaves at most k x k rows, whatever the table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cells(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, label: str = "is_significant", pred: str = "prediction",
                     classes: list[int] = (0, 1)) -> DataFrame:
    """Rows actual, one column per predicted class, zero cells kept."""
    spark: SparkSession = df.sparkSession
    cells = _cells(df, label, pred)
    wide = cells.groupBy(label).agg(*[
        F.coalesce(F.sum(F.when(F.col(pred) == c, F.col("n"))), F.lit(0)).cast("bigint").alias(f"pred_{c}")
        for c in classes])
    grid = spark.createDataFrame([(c,) for c in classes], f"{label} int")
    return (grid.join(wide, label, "left")
            .select(label, *[F.coalesce(F.col(f"pred_{c}"), F.lit(0)).cast("bigint").alias(f"pred_{c}")
                             for c in classes])
            .orderBy(label))


def confusion_cells(df: DataFrame, label: str = "is_significant", pred: str = "prediction",
                    classes: list[int] = (0, 1)) -> DataFrame:
    """Long form of the confusion matrix, one row per (actual, predicted) cell (V8)."""
    spark: SparkSession = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual int, predicted int")
    cells = _cells(df, label, pred).select(F.col(label).alias("actual"), F.col(pred).alias("predicted"), "n")
    return (grid.join(cells, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .orderBy("actual", "predicted"))


def _div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def classification_report(df: DataFrame, label: str = "is_significant", pred: str = "prediction",
                          classes: list[int] = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages.

    Zero division gives 0.  F1 is ``2 tp / (support + predicted)``.
    """
    cells = confusion_cells(df, label, pred, classes)
    per_class = (cells.groupBy(F.col("actual").alias("cls")).agg(
        F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum("n").alias("support"))
        .join(cells.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("predicted")), "cls"))
    per_class = per_class.select(
        F.col("cls").cast("string").alias("row"),
        _div(F.col("tp"), F.col("predicted")).alias("precision"),
        _div(F.col("tp"), F.col("support")).alias("recall"),
        _div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
        F.col("tp"))
    summary = per_class.agg(
        F.sum("support").alias("t"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    acc = summary.select(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), _div(F.col("tp"), F.col("t")).alias("f1"),
                         F.col("t").cast("bigint").alias("support"))
    macro = summary.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                           F.col("t").cast("bigint").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("row"), _div(F.col("wp"), F.col("t")).alias("precision"),
                              _div(F.col("wr"), F.col("t")).alias("recall"), _div(F.col("wf"), F.col("t")).alias("f1"),
                              F.col("t").cast("bigint").alias("support"))
    return per_class.drop("tp").unionByName(acc).unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, label: str = "is_significant", pred: str = "prediction") -> DataFrame:
    """Share of rows with ``label == prediction``."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))
