"""The text report (R1) and the run summary (R2) as ordered rows.

Each section is a small DataFrame of ``(section, pos, line)`` built with
``format_string`` from bounded aggregates (totals, top-k, per-region rows);
the sections are unioned and numbered.  Nothing is formatted on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.columns import fixed_text
from faultline.operators import aggregates as A
from faultline.session import materialize

# The report's wording.
TITLE = "Philippine Earthquake Analysis - Summary Report"
RULE = "=" * 50
TOTAL_FMT = "Total Earthquakes Analyzed: %d"
SIGNIFICANT_FMT = "Significant Earthquakes (Magnitude ≥ 4.0): %d"
PERCENT_FMT = "Percentage of Significant Earthquakes: %s%%"
PLACES_TITLE = "Top 10 Provinces with Most Significant Earthquakes:"
PLACE_FMT = "%d. %s: %d quakes"
FEATURES_TITLE = "Top 5 Features for Predicting Significant Earthquakes:"
FEATURE_FMT = "%d. %s: %s"
REGIONS_TITLE = "Earthquake Distribution by Region:"
REGION_FMT = "%s: %d total quakes, %d significant quakes, %s%% significance rate"
ZONES_TITLE = "Clustering Results:"
ZONES_FMT = "Number of clusters identified: %d"
ZONES_NOTE = "Major seismic zones identified based on location patterns"


def _fixed(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(section, i, ln) for i, ln in enumerate(lines)],
                                 "section int, pos int, line string")


def _rows(df: DataFrame, section: int, pos, line) -> DataFrame:
    return df.select(F.lit(section).alias("section"), pos.cast("int").alias("pos"), line.alias("line"))


def report_lines(clean: DataFrame, zones: DataFrame | None = None, importance: DataFrame | None = None,
                 places: int = 10, features: int = 5) -> DataFrame:
    """Report rows ``(line_no, line)`` in the published order and wording.

    ``zones`` (rows with ``Cluster``) adds the clustering section; ``importance``
    (``feature, importance``) adds the feature section.
    """
    from faultline.operators.model import top_features

    spark = clean.sparkSession
    parts = [_fixed(spark, 0, [TITLE, RULE, ""])]
    # totals and regions are read by several lines: one scan of the catalogue for both
    regions = materialize(A.region_breakdown(clean), "report-regions")
    t = regions.agg(F.sum("Total_Quakes").alias("total"), F.sum("Significant_Quakes").alias("significant"))
    t = t.withColumn("pct", F.col("significant") / F.col("total") * F.lit(100.0))
    lines = F.array(F.format_string(TOTAL_FMT, "total"), F.format_string(SIGNIFICANT_FMT, "significant"),
                    F.format_string(PERCENT_FMT, fixed_text("pct")))
    parts.append(t.select(F.posexplode(lines).alias("pos", "line")).select(F.lit(1).alias("section"), "pos", "line"))
    parts.append(_fixed(spark, 2, ["", PLACES_TITLE]))
    top = A.top_values(clean.where("is_significant = 1"), "General_Location", places)
    parts.append(_rows(top, 3, F.col("rank"), F.format_string(PLACE_FMT, "rank", "General_Location", "n")))
    if importance is not None:
        parts.append(_fixed(spark, 4, ["", FEATURES_TITLE]))
        tf = top_features(importance, features)
        parts.append(_rows(tf, 5, F.col("rank"), F.format_string(FEATURE_FMT, "rank", "feature", fixed_text("importance", 4))))
    parts.append(_fixed(spark, 6, ["", REGIONS_TITLE]))
    rb = regions.withColumn("pos", F.row_number().over(Window.orderBy("Region")))
    parts.append(_rows(rb, 7, F.col("pos"), F.format_string(
        REGION_FMT, "Region", "Total_Quakes", "Significant_Quakes", fixed_text("Significance_Rate"))))
    if zones is not None:
        parts.append(_fixed(spark, 8, ["", ZONES_TITLE]))
        zs = A.zone_summary(zones)
        parts.append(_rows(zs, 9, F.lit(0), F.format_string(ZONES_FMT, "n_labels")))
        parts.append(_fixed(spark, 10, [ZONES_NOTE]))
    allp = reduce(DataFrame.unionByName, parts)
    return allp.select(F.row_number().over(Window.orderBy("section", "pos")).alias("line_no"), "line")


def run_summary(clean: DataFrame, accuracy: DataFrame | None = None, zones: DataFrame | None = None,
                importance: DataFrame | None = None, features: int = 5) -> DataFrame:
    """Run summary as ``(metric, value)`` text rows (R2); the feature list is computed."""
    from faultline.operators.model import top_features

    t = A.totals(clean)
    parts = [
        t.select(F.lit("total_earthquakes").alias("metric"), F.col("total").cast("string").alias("value")),
        t.select(F.lit("significant_earthquakes").alias("metric"), F.col("significant").cast("string").alias("value")),
    ]
    if accuracy is not None:
        parts.append(accuracy.select(F.lit("accuracy").alias("metric"),
                                     fixed_text("accuracy").alias("value")))
    if zones is not None:
        parts.append(A.zone_summary(zones).select(F.lit("clusters_identified").alias("metric"),
                                                  F.col("n_labels").cast("string").alias("value")))
    if importance is not None:
        tf = top_features(importance, features)
        parts.append(tf.agg(F.lit("top_features").alias("metric"),
                            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))),
                                                     lambda s: s["feature"]), ", ").alias("value")))
    return reduce(DataFrame.unionByName, parts)
