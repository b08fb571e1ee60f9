"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the driver's tables (the quake view is derived row by row
from ``events``), runs on all rows, and names its columns as the matching
statement in :mod:`faultline.plans.oracle` does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.constants import (
    DBSCAN_EPS, DBSCAN_MIN_SAMPLES, DEPTH_LABELS, GBT_PARAMS, QUERY_HIST_BINS,
    QUERY_SAMPLE_ROWS, QUERY_TIGHT_EPS, QUERY_TIGHT_MIN_SAMPLES, QUERY_ZOOM, REGION_DEFAULT, REGION_GROUPS, REGIONS,
)
from faultline.operators import aggregates as A
from faultline.operators import clean as C
from faultline.operators import features as M
from faultline.operators import metrics as E
from faultline.operators import model as ML
from faultline.operators import profile as P
from faultline.operators import rules as X
from faultline.operators import sampling as D
from faultline.operators import silhouette as S
from faultline.operators import spatial as Z
from faultline.operators.charts import (
    chart_depth_magnitude, chart_magnitude_by_class, chart_map, chart_region_significance, chart_regions, map_tiles,
)
from faultline.operators.report import report_lines, run_summary
from faultline.operators.zones import zone_profile
from faultline.session import materialize, tables_dir
from faultline.sources import sinks
from faultline.sources.catalog import (
    TIME_LAYOUTS, VIEW_CUTOFF, hot_view, mixed_time_view, precise_view, quake_view, quoted_view, read_catalog,
)

HIST_BINS = QUERY_HIST_BINS
#: Small trees: the view's classes differ by zone alone.
QUERY_VALIDATED = {"maxDepth": 2, "minInstancesPerNode": 20, "validationTol": 1e-4}
TIGHT_EPS, TIGHT_MIN = QUERY_TIGHT_EPS, QUERY_TIGHT_MIN_SAMPLES


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quake_view(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_catalog(quake_view(spark, sf_dir), cutoff=VIEW_CUTOFF)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def q_describe(spark, sf_dir):
    d = P.describe_numeric(raw(spark, sf_dir), ["Latitude", "Longitude", "Magnitude"])
    return d.select("column_name", "n", _r6("mean"), _r6("std"), "min",
                    _r6("p25"), _r6("p50"), _r6("p75"), "max")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_catalog": clean,
    "cleaning_audit": lambda s, d: C.cleaning_audit(raw(s, d), cutoff=VIEW_CUTOFF),
    "table_shape": lambda s, d: P.table_shape(clean(s, d)),
    "column_info": lambda s, d: P.column_info(clean(s, d)),
    "preview": lambda s, d: P.preview(clean(s, d), 5),
    "describe_numeric": q_describe,
    "region_classify": lambda s, d: clean(s, d).select("quake_id", "General_Location", "Region"),
    "region_breakdown": lambda s, d: A.region_breakdown(clean(s, d)),
    "time_features": lambda s, d: clean(s, d).select("quake_id", "Date_Time_PH", "Hour", "DayOfWeek", "Month"),
    "depth_bands": lambda s, d: clean(s, d).select("quake_id", "Depth_In_Km", "Depth_Category"),
    "totals": lambda s, d: A.totals(clean(s, d)),
    "top_places": lambda s, d: A.top_values(clean(s, d).where("is_significant = 1"), "General_Location", 10),
    "region_counts": lambda s, d: A.value_counts(clean(s, d), "Region"),
    "region_significance": lambda s, d: A.crosstab(clean(s, d), "Region", "is_significant", [0, 1],
                                                   ["non_significant", "significant"]),
    "magnitude_histogram": lambda s, d: A.histogram(clean(s, d), "Magnitude", HIST_BINS),
    "magnitude_histogram_by_class": lambda s, d: A.histogram(clean(s, d), "Magnitude", HIST_BINS,
                                                             by="is_significant", by_values=[0, 1]),
}



def clean_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean catalogue written once (shared checkpoint folder) for queries that read it several times."""
    return materialize(clean(spark, sf_dir), "clean")


def labelled(spark, sf_dir, eps=DBSCAN_EPS, min_samples=DBSCAN_MIN_SAMPLES, base=None):
    base = base if base is not None else clean_once(spark, sf_dir)
    return Z.dbscan(base, eps=eps, min_samples=min_samples)


def split(spark, sf_dir, base=None):
    return D.stratified_split(base if base is not None else clean_once(spark, sf_dir))


def rule_prediction(df: DataFrame) -> DataFrame:
    """Fixed baseline rule used to exercise the metric operators: Mindanao is predicted significant."""
    return df.withColumn("prediction", (F.col("Region") == "Mindanao").cast("int"))


def evaluated(spark, sf_dir):
    return materialize(rule_prediction(split(spark, sf_dir).where("is_test")), "evaluated")


def train_rows(spark, sf_dir):
    return split(spark, sf_dir).where("NOT is_test")


def q_zone_profile(spark, sf_dir):
    return zone_profile(labelled(spark, sf_dir))


def q_class_weight(spark, sf_dir):
    w = M.class_weight(train_rows(spark, sf_dir))
    return w.groupBy("is_significant").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")) \
        .orderBy("is_significant")


def q_report(spark, sf_dir):
    r = E.classification_report(evaluated(spark, sf_dir))
    return r.select("row", _r6("precision"), _r6("recall"), _r6("f1"), "support")


def q_accuracy(spark, sf_dir):
    return E.accuracy(evaluated(spark, sf_dir)).select(_r6("accuracy"), "n")


def q_nearest(spark, sf_dir):
    """Every event takes the zone of its nearest significant event."""
    base = clean_once(spark, sf_dir)
    lab = labelled(spark, sf_dir, base=base).where("is_significant = 1")
    return Z.nearest_label(base.select("quake_id", "Latitude", "Longitude"), lab).select("quake_id", "Cluster")


def q_nearest_hot(spark, sf_dir):
    """As nearest_label with regions as labels, a third of all events at one place."""
    hot = materialize(hot_view(clean(spark, sf_dir)), "hot")
    lab = hot.where("is_significant = 1")
    return Z.nearest_label(hot.select("quake_id", "Latitude", "Longitude"), lab, label="Region") \
        .select("quake_id", "Region")


def q_within_between(spark, sf_dir):
    """Per significant event, the other events within eps, a third of all events at one place."""
    hot = materialize(hot_view(clean(spark, sf_dir)), "hot")
    return Z.within_distance_between(hot.where("is_significant = 1"), hot.where("is_significant = 0"), eps=TIGHT_EPS)


def q_rule_table(spark, sf_dir):
    """Regions by a table of rules: the keyword lists, then every name of the catalogue as a rule of its own."""
    names = raw(spark, sf_dir).select(F.col("General_Location").alias("keyword")).distinct() \
        .select((F.lit(len(REGION_GROUPS)) + F.length("keyword")).alias("priority"),
                F.concat(F.lit("Place "), "keyword").alias("label"), "keyword")
    rules = X.rule_table(spark, REGION_GROUPS).unionByName(names)
    return X.classify_by_rules(raw(spark, sf_dir), "General_Location", rules, REGION_DEFAULT) \
        .select("quake_id", "General_Location", "Region")


def q_impute(spark, sf_dir):
    """Gaps of double columns and of an integral one."""
    r = raw(spark, sf_dir).withColumn("Depth", F.col("Depth_In_Km").try_cast("int"))
    out = A.impute_mean(r, ["Latitude", "Magnitude", "Depth"])
    return out.select("quake_id", *[_r6(c) for c in ("Latitude", "Magnitude", "Depth")])


def q_csv(spark, sf_dir):
    """The raw view through a CSV file and back, then coerced."""
    path = f"{tables_dir(spark)}/csv-{uuid.uuid4().hex}"
    quoted_view(raw(spark, sf_dir)).write.options(header=True, quote='"', escape='"').csv(path)
    return C.coerce(read_catalog(spark, path)).select(
        F.col("quake_id").cast("bigint").alias("quake_id"), "Date_Time_PH", "Latitude", "Longitude", "Depth_In_Km",
        "Magnitude", "Location", "General_Location")


def q_silhouette_sq(spark, sf_dir):
    return Z.silhouette_squared(labelled(spark, sf_dir)).select(_r6("silhouette_squared"), "n")


def q_silhouette_bounds(spark, sf_dir):
    """Bounds of the Euclidean silhouette, at most 0.02 apart."""
    return S.silhouette_bounds(labelled(spark, sf_dir), 0.02)


def q_silhouette_score(spark, sf_dir):
    """The Euclidean silhouette to a certified decimal (each further one costs about three times as much)."""
    return S.silhouette_score(labelled(spark, sf_dir), 1)


QUERIES.update({
    "silhouette_bounds": q_silhouette_bounds,
    "silhouette_score": q_silhouette_score,
    "dbscan_labels": lambda s, d: labelled(s, d).select("quake_id", "Cluster"),
    "dbscan_labels_tight": lambda s, d: labelled(s, d, TIGHT_EPS, TIGHT_MIN).select("quake_id", "Cluster"),
    "within_distance_counts": lambda s, d: Z.within_distance_counts(clean(s, d), eps=TIGHT_EPS),
    "zone_summary": lambda s, d: A.zone_summary(labelled(s, d)),
    "zone_profile": q_zone_profile,
    "sample_points": lambda s, d: D.sample_exact(clean_once(s, d), QUERY_SAMPLE_ROWS)
        .select("quake_id", "Longitude", "Latitude", "Magnitude"),
    "depth_magnitude_points": lambda s, d: chart_depth_magnitude(clean(s, d)),
    "region_by_rule_table": q_rule_table,
    "impute_mean": q_impute,
    "csv_round_trip": q_csv,
    "one_hot_depth": lambda s, d: M.one_hot(clean(s, d), "Depth_Category", values=DEPTH_LABELS).select(
        "quake_id", *[F.col(f"Depth_Category_{v}").alias("Depth_" + v.replace(" ", "_")) for v in DEPTH_LABELS]),
    "within_distance_precise": lambda s, d: Z.within_distance_counts(precise_view(clean(s, d)), eps=TIGHT_EPS),
    "within_distance_hot": lambda s, d: Z.within_distance_counts(hot_view(clean(s, d)), eps=TIGHT_EPS),
    "dbscan_precise": lambda s, d: Z.dbscan(materialize(precise_view(clean(s, d)), "precise"), eps=TIGHT_EPS,
                                            min_samples=TIGHT_MIN).select("quake_id", "Cluster"),
    "within_distance_between": q_within_between,
    "nearest_label_hot": q_nearest_hot,
    "split_assignment": lambda s, d: split(s, d).select("quake_id", "is_significant", "is_test"),
    "class_counts": lambda s, d: A.class_counts(train_rows(s, d)),
    "class_weight": q_class_weight,
    "one_hot_region": lambda s, d: M.one_hot(clean(s, d), "Region", values=REGIONS).select(
        "quake_id", "Region_Luzon", "Region_Mindanao", "Region_Unknown", "Region_Visayas"),
    "feature_table": lambda s, d: M.feature_table(clean_once(s, d))[0],
    "confusion_matrix": lambda s, d: E.confusion_matrix(evaluated(s, d)),
    "confusion_cells": lambda s, d: E.confusion_cells(evaluated(s, d)),
    "classification_report": q_report,
    "accuracy": q_accuracy,
    "nearest_label": q_nearest,
    "silhouette_squared": q_silhouette_sq,
})


def trained(spark, sf_dir):
    """The classifier of one data set, trained here: model, feature names, feature table."""
    sp = materialize(split(spark, sf_dir), "split")
    table, names = M.feature_table(sp)
    table = materialize(table.join(sp.select("quake_id", "is_test"), "quake_id"), "features")
    model = ML.train_classifier(M.class_weight(table.where("NOT is_test")), names)
    return model, names, table


def scored(model, table) -> DataFrame:
    return materialize(ML.predict(model, table.where("is_test"), ["quake_id", "is_significant"]), "predictions")


def q_predictions(spark, sf_dir):
    model, _, table = trained(spark, sf_dir)
    return scored(model, table)


def q_test_rows(spark, sf_dir):
    """What the classifier scores: keys and labels, whatever the trees say."""
    return q_predictions(spark, sf_dir).where("prediction IS NOT NULL AND probability IS NOT NULL") \
        .select("quake_id", "is_significant")


def q_model_checks(spark, sf_dir):
    """Facts of any right model, of its importances and of the summary made from it."""
    model, names, table = trained(spark, sf_dir)
    pred = scored(model, table)
    importance = materialize(ML.feature_importance(model, names), "importance")
    top = ML.top_features(importance, 10)
    order = Window.orderBy("rank")
    facts = [
        ("probabilities are in [0, 1]", pred.agg(F.bool_and(F.col("probability").between(0, 1)).alias("ok"))),
        ("prediction is probability above one half",
         pred.agg(F.bool_and(F.col("prediction") == (F.col("probability") > 0.5).cast("int")).alias("ok"))),
        ("importances sum to 1", importance.agg((F.abs(F.sum("importance") - 1) < 1e-9).alias("ok"))),
        ("importances are named in feature order",
         importance.agg((F.array_sort(F.collect_list("feature")) == F.array(*[F.lit(n) for n in sorted(names)])).alias("ok"))),
        ("top features descend", top.withColumn("next", F.lead("importance").over(order))
         .agg((F.bool_and(F.coalesce(F.col("next") <= F.col("importance"), F.lit(True)))
               & (F.count(F.lit(1)) == min(10, len(names)))).alias("ok"))),
        ("summary has its lines", run_summary(clean(spark, sf_dir), E.accuracy(pred), None, importance)
         .agg((F.array_sort(F.collect_list("metric")) == F.array(*[F.lit(m) for m in (
             "accuracy", "significant_earthquakes", "top_features", "total_earthquakes")])).alias("ok"))),
        ("report has its features", report_lines(clean(spark, sf_dir), importance=importance)
         .where(F.col("line").rlike(r"^[1-5]\. [A-Za-z_]+: 0\.[0-9]{4}$")).agg((F.count(F.lit(1)) == 5).alias("ok"))),
    ]
    out = None
    for name, df in facts:
        row = df.select(F.lit(name).alias("fact"), F.coalesce("ok", F.lit(False)).alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out


def q_model_learns(spark, sf_dir):
    """Facts of a classifier that has learned: validated training, stopped once its loss has settled."""
    sp = materialize(split(spark, sf_dir), "split")
    table, names = M.feature_table(sp)
    table = materialize(table.join(sp.select("quake_id", "is_test"), "quake_id"), "features")
    train = materialize(ML.validation_rows(M.class_weight(table.where("NOT is_test"))), "train")
    model = ML.train_classifier(train, names, validation="is_validation", **QUERY_VALIDATED)
    losses = ML.loss_series(model, train.where("is_validation")).orderBy("trees").collect()  # a row for each tree
    quality = ML.score_quality(scored(model, table)).first()
    facts = [("log loss on the test rows is below the base rate's", quality["log_loss"] < quality["base_log_loss"]),
             ("area under the curve is above one half", quality["auc"] > 0.5),
             ("validation loss doesn't rise with the trees", losses[-1]["loss"] <= losses[0]["loss"]),
             ("no trees once the loss has settled", 0 < len(losses) < GBT_PARAMS["maxIter"])]
    return spark.createDataFrame([(f, bool(v)) for f, v in facts], "fact string, holds boolean")


def q_top_features(spark, sf_dir):
    model, names, _ = trained(spark, sf_dir)
    return ML.top_features(ML.feature_importance(model, names), 10)


def q_model_report(spark, sf_dir):
    r = E.classification_report(q_predictions(spark, sf_dir))
    return r.select("row", _r6("precision"), _r6("recall"), _r6("f1"), "support")


def q_map_points(spark, sf_dir):
    return chart_map(labelled(spark, sf_dir), "Cluster")


def q_map_tiles(spark, sf_dir):
    return map_tiles(labelled(spark, sf_dir), "Cluster", QUERY_ZOOM)


def q_layout_vote(spark, sf_dir):
    """Candidate layouts of the event times, a third of which are written day first and a fifth month first."""
    return C.time_layout_vote(mixed_time_view(raw(spark, sf_dir)), "Date_Time_PH", list(TIME_LAYOUTS))


def q_summary_report(spark, sf_dir):
    base = clean_once(spark, sf_dir)
    return report_lines(base, labelled(spark, sf_dir, base=base))


def q_report_round_trip(spark, sf_dir):
    """The summary report committed as a text file and read back."""
    path = f"{tables_dir(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(q_summary_report(spark, sf_dir), path)
    return sinks.read_report(spark, path)


def q_chart_round_trip(spark, sf_dir):
    """Three charts committed, read back against their manifests, and stacked: ``chart, mark, n``."""
    base = clean_once(spark, sf_dir)
    paths = sinks.write_chart_data(
        {"regions": chart_regions(base), "region_significance": chart_region_significance(base),
         "magnitude_by_class": chart_magnitude_by_class(base, HIST_BINS)},
        f"{tables_dir(spark)}/charts-{uuid.uuid4().hex}")
    t = {name: sinks.read_committed(spark, path, verify=True) for name, path in paths.items()}
    marks = [t["regions"].select(F.lit("regions").alias("chart"), F.col("Region").alias("mark"), "n")]
    marks += [t["region_significance"].select(F.lit(c).alias("chart"), F.col("Region").alias("mark"), F.col(c).alias("n"))
              for c in ("non_significant", "significant")]
    marks.append(t["magnitude_by_class"].select(
        F.lit("magnitude_by_class").alias("chart"), F.concat_ws("/", "bin", "is_significant").alias("mark"), "n"))
    return reduce(DataFrame.unionByName, marks)


def q_summary_values(spark, sf_dir):
    """The lines of the run summary that no model decides: totals, the rule's accuracy, the zones."""
    base = clean_once(spark, sf_dir)
    return run_summary(base, E.accuracy(evaluated(spark, sf_dir)), labelled(spark, sf_dir, base=base))


def q_run_summary(spark, sf_dir):
    model, names, table = trained(spark, sf_dir)
    base = clean_once(spark, sf_dir)
    return run_summary(base, E.accuracy(scored(model, table)), labelled(spark, sf_dir, base=base),
                       ML.feature_importance(model, names))


QUERIES.update({
    "map_points": q_map_points,
    "map_tiles": q_map_tiles,
    "time_layout_vote": q_layout_vote,
    "summary_report": q_summary_report,
    "report_round_trip": q_report_round_trip,
    "chart_round_trip": q_chart_round_trip,
    "map_magnitude_points": lambda s, d: chart_map(clean(s, d), "Magnitude"),
    "run_summary_values": q_summary_values,
    "run_summary": q_run_summary,
    "model_predictions": q_predictions,
    "model_test_rows": q_test_rows,
    "model_checks": q_model_checks,
    "model_learns": q_model_learns,
    "top_features": q_top_features,
    "model_report": q_model_report,
})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
