"""End-to-end catalogue analysis with the three published parameter presets.

    python -m faultline.plans.analysis --input quakes.csv --out /shared/run1 --preset run
    python -m faultline.plans.analysis --events-dir /root/testdata/sf0.01 --out /tmp/x --preset full

Steps: clean (written once as Parquet) -> zones (DBSCAN on all rows) -> zone profile
and squared silhouette -> labels of the significant rows spread by nearest
neighbour -> stratified split, features, class weights ->
GBT -> evaluation -> chart data and report.  Every intermediate that is read
more than once is written to the output folder (a shared file system on a
cluster), which also cuts lineage: a lost executor recomputes one step.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from faultline.constants import DBSCAN_EPS, DBSCAN_MIN_SAMPLES, DEFAULT_CUTOFF, DEFAULT_TIME_FORMATS, PRESETS, TEST_FRACTION
from faultline.operators import aggregates as A
from faultline.operators import charts as V
from faultline.operators import features as M
from faultline.operators import metrics as E
from faultline.operators import model as ML
from faultline.operators import report as R
from faultline.operators import sampling as D
from faultline.operators import spatial as Z
from faultline.operators.clean import cleaning_audit, clean_catalog
from faultline.operators.profile import column_info, describe_numeric, numeric_columns, table_shape
from faultline.operators.zones import zone_profile
from faultline.sources.catalog import VIEW_CUTOFF, quake_view, read_catalog
from faultline.sources.sinks import write_chart_data, write_report


def _save(df: DataFrame, out: str, name: str) -> DataFrame:
    path = f"{out.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_analysis(spark: SparkSession, raw: DataFrame, out: str, preset: str = "run",
                 cutoff: str = DEFAULT_CUTOFF, formats: list[str] = DEFAULT_TIME_FORMATS,
                 eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES,
                 gbt_params: dict | None = None) -> dict[str, DataFrame]:
    """Run the whole analysis; returns the result tables (also written under ``out``)."""
    p = PRESETS[preset]
    res: dict[str, DataFrame] = {}
    res["raw_shape"] = table_shape(raw)
    res["raw_columns"] = column_info(raw)
    res["raw_describe"] = describe_numeric(raw, numeric_columns(raw))
    res["cleaning_audit"] = cleaning_audit(raw, cutoff, formats)

    clean = _save(clean_catalog(raw, cutoff, formats, depth_bands=p["depth_bands"]), out, "clean")
    res["clean"] = clean
    res["totals"] = A.totals(clean)
    res["region_breakdown"] = A.region_breakdown(clean)

    zones = _save(Z.dbscan(clean, eps=eps, min_samples=min_samples), out, "zones")
    res["zones"] = zones
    res["zone_summary"] = A.zone_summary(zones)
    res["zone_profile"] = zone_profile(zones)
    if p["silhouette"]:
        n_zones = res["zone_summary"].first()["n_zones"]
        if n_zones > 1:
            res["silhouette_squared"] = Z.silhouette_squared(zones)
    labelled = zones
    if p["spread_labels"]:
        labelled = _save(Z.nearest_label(clean, zones.where("is_significant = 1")),
                         out, "clean_labelled")
        res["clean_labelled"] = labelled

    split = _save(D.stratified_split(clean, test_fraction=TEST_FRACTION), out, "split")
    table, names = M.feature_table(split)
    table = _save(table.join(split.select("quake_id", "is_test"), "quake_id"), out, "features")
    train = M.class_weight(table.where("NOT is_test"))
    res["class_counts"] = A.class_counts(train)
    model = ML.train_classifier(train, names, **(gbt_params or {}))
    model.write().overwrite().save(f"{out.rstrip('/')}/model")
    pred = _save(ML.predict(model, table.where("is_test"), ["quake_id", "is_significant"]), out, "predictions")
    res["predictions"] = pred
    importance = ML.feature_importance(model, names)
    res["importance"] = importance
    res["confusion_matrix"] = E.confusion_matrix(pred)
    res["classification_report"] = E.classification_report(pred)
    res["accuracy"] = E.accuracy(pred)

    charts = {}
    if p["histogram_bins"]:
        charts["magnitude_histogram"] = V.chart_magnitude(clean, p["histogram_bins"])
    charts["region_significance"] = V.chart_region_significance(clean)
    charts["confusion"] = V.chart_confusion(pred)
    charts["importance"] = V.chart_importance(importance)
    if p["point_charts"]:
        charts["regions"] = V.chart_regions(clean)
        charts["map_magnitude"] = V.chart_map(clean, "Magnitude")
        charts["depth_magnitude"] = V.chart_depth_magnitude(clean)
        charts["magnitude_by_class"] = V.chart_magnitude_by_class(clean, p["histogram_bins"] or 30)
        charts["map_zones"] = V.chart_map(labelled, "Cluster")
    write_chart_data(charts, f"{out.rstrip('/')}/charts")
    res.update({f"chart_{k}": v for k, v in charts.items()})

    lines = R.report_lines(clean, zones if p["zone_section"] else None, importance)
    write_report(lines, f"{out.rstrip('/')}/report")
    res["report"] = lines
    res["run_summary"] = R.run_summary(clean, res["accuracy"], zones, importance)
    return res


def main(argv: list[str] | None = None) -> None:
    from faultline.session import get_spark

    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="catalogue path (CSV with header, or Parquet with --format parquet)")
    src.add_argument("--events-dir", help="derive the catalogue from <dir>/events.parquet")
    ap.add_argument("--format", default="csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--preset", default="run", choices=sorted(PRESETS))
    ap.add_argument("--cutoff", default=None)
    ap.add_argument("--time-format", action="append", help="layout of the event time; may be given several times")
    ap.add_argument("--single-line", action="store_true", help="no line breaks inside CSV fields: split large files")
    ap.add_argument("--shuffle-partitions", type=int, default=None)
    ap.add_argument("--checkpoint-dir", default=None, help="shared folder for intermediate tables")
    ap.add_argument("--trees", type=int, default=None)
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    spark = get_spark(a.master, shuffle_partitions=a.shuffle_partitions,
                      extra={"spark.checkpoint.dir": a.checkpoint_dir} if a.checkpoint_dir else None)
    if a.events_dir:
        raw, cutoff = quake_view(spark, a.events_dir), a.cutoff or VIEW_CUTOFF
    else:
        raw, cutoff = read_catalog(spark, a.input, a.format, multi_line=not a.single_line), a.cutoff or DEFAULT_CUTOFF
    res = run_analysis(spark, raw, a.out, a.preset, cutoff, a.time_format or DEFAULT_TIME_FORMATS,
                       gbt_params={"maxIter": a.trees} if a.trees else None)
    for row in res["report"].orderBy("line_no").collect():
        print(row.line)


if __name__ == "__main__":
    main()
