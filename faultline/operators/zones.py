"""Per-zone profile of a labelled catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import round_half_even
from faultline.operators.aggregates import modal


def zone_profile(df: DataFrame, label: str = "Cluster", digits: int = 2) -> DataFrame:
    """Magnitude count/mean/max, mean latitude and longitude, modal place per zone, rounded (A3).

    Hash aggregates keyed by the zone label and by (zone, place); the zone holding most
    rows is pre-combined in every task before the shuffle.
    """
    agg = df.groupBy(label).agg(
        F.count("Magnitude").alias("magnitude_count"),
        F.avg("Magnitude").alias("magnitude_mean"),
        F.max("Magnitude").alias("magnitude_max"),
        F.avg("Latitude").alias("latitude_mean"),
        F.avg("Longitude").alias("longitude_mean"),
    ).join(modal(df, label, "General_Location", "place_mode").withColumnRenamed(label, "_zone"),
           F.col(label).eqNullSafe(F.col("_zone")))
    return agg.select(
        label, "magnitude_count",
        *[round_half_even(c, digits).alias(c)
          for c in ["magnitude_mean", "magnitude_max", "latitude_mean", "longitude_mean"]],
        "place_mode",
    ).orderBy(label)
