"""Chart data: the rows behind each published figure (V1-V9).

Drawing is left to the caller; these are DataFrames over all rows.  A caller that draws
fewer points samples them (:func:`faultline.operators.sampling.sample_exact`).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import aggregates as A
from faultline.operators import metrics as E
from faultline.operators.model import top_features
from faultline.session import materialize


def chart_magnitude(df: DataFrame, bins: int = 30) -> DataFrame:
    """Magnitude histogram (V1)."""
    return A.histogram(df, "Magnitude", bins)


def chart_regions(df: DataFrame) -> DataFrame:
    """Quakes per region, most first (V2)."""
    return A.value_counts(df, "Region").orderBy(F.col("n").desc(), "Region")


def chart_region_significance(df: DataFrame) -> DataFrame:
    """Region x significance counts for a stacked bar chart (V3)."""
    return A.crosstab(df, "Region", "is_significant", [0, 1], ["non_significant", "significant"])


def chart_map(df: DataFrame, colour: str = "Magnitude", key: str = "quake_id") -> DataFrame:
    """Map points (longitude, latitude) with a colour column (V4, V5).

    Coloured by zone only when there is more than one zone label; otherwise the
    colour column is NULL (plain points), as in the published figure.
    """
    if colour == "Cluster":
        n_labels = df.select("Cluster").distinct().limit(2).count()
        col = F.col("Cluster") if n_labels > 1 else F.lit(None).cast("int")
        return df.select(key, "Longitude", "Latitude", col.alias("Cluster"))
    return df.select(key, "Longitude", "Latitude", colour)


def chart_depth_magnitude(df: DataFrame, key: str = "quake_id") -> DataFrame:
    """Depth against magnitude points (V6)."""
    return df.select(key, "Depth_In_Km", "Magnitude")


def chart_magnitude_by_class(df: DataFrame, bins: int = 30) -> DataFrame:
    """Magnitude histogram stacked by significance, shared edges (V7)."""
    return A.histogram(df, "Magnitude", bins, by="is_significant", by_values=[0, 1])


def chart_confusion(pred: DataFrame, label: str = "is_significant", prediction: str = "prediction") -> DataFrame:
    """Confusion heat-map cells (V8)."""
    return E.confusion_cells(pred, label, prediction)


def chart_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    """Top-k importance bars (V9)."""
    return top_features(importance, k)


def map_tiles(df: DataFrame, label: str = "Cluster", zoom: int = 8, x: str = "Longitude", y: str = "Latitude") -> DataFrame:
    """Map tiles (V4-V6 for any number of rows): per zoom level 0..``zoom`` and tile ``n`` rows, the
    most frequent ``label`` (ties by the smaller one) and its ``label_n``.

    At zoom ``z`` the globe is cut into ``2^z`` columns by longitude and as many rows by
    latitude, from west and south.  Rows are counted per finest tile and label once, and all
    coarser levels are summed from those counts, so what follows is bounded by the tiles, not
    the rows.  Rows without coordinates are left out; a NULL label counts as a label of its
    own, after all others."""
    side = 1 << zoom

    def tile(c: str, span: float):
        t = F.floor((F.col(c) + F.lit(span / 2)) / F.lit(span) * F.lit(float(side))).cast("long")
        return F.least(F.greatest(t, F.lit(0)), F.lit(side - 1))

    inside = (F.abs(F.col(x)) < F.lit(math.inf)) & (F.abs(F.col(y)) < F.lit(math.inf))
    fine = materialize(df.where(inside).groupBy(tile(x, 360.0).alias("tx"), tile(y, 180.0).alias("ty"), F.col(label).alias("label"))
                       .agg(F.count(F.lit(1)).alias("n")), "tiles")
    up = f"cast({zoom} - zoom as int)"
    levels = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(zoom))).alias("zoom")).select(
        "zoom", F.expr(f"shiftright(tx, {up})").alias("tx"), F.expr(f"shiftright(ty, {up})").alias("ty"), "label", "n")
    by_label = levels.groupBy("zoom", "tx", "ty", "label").agg(F.sum("n").alias("n"))
    most = F.min(F.struct((-F.col("n")).alias("n"), F.col("label").isNull().alias("none"), F.col("label").alias("label")))
    return by_label.groupBy("zoom", "tx", "ty").agg(F.sum("n").alias("n"), most.alias("most")) \
        .select("zoom", "tx", "ty", "n", F.col("most.label").alias(label), (-F.col("most.n")).alias("label_n"))
