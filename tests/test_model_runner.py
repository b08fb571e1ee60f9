"""Classifier (M4-M6) properties and the end-to-end runner with a preset."""

import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import features as M
from faultline.operators import model as ML
from faultline.operators.clean import clean_catalog
from faultline.operators.sampling import stratified_split
from faultline.plans.analysis import run_analysis
from faultline.sources.catalog import VIEW_CUTOFF, quake_view


def test_model_properties(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    sp = stratified_split(clean)
    table, names = M.feature_table(sp)
    table = table.join(sp.select("quake_id", "is_test"), "quake_id")
    model = ML.train_classifier(M.class_weight(table.where("NOT is_test")), names, maxIter=3)
    pred = ML.predict(model, table.where("is_test"), ["quake_id", "is_significant"])
    assert {r.prediction for r in pred.select("prediction").distinct().collect()} <= {0, 1}
    assert pred.where((F.col("probability") < 0) | (F.col("probability") > 1)).count() == 0
    imp = ML.feature_importance(model, names)
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9
    top = [r.importance for r in ML.top_features(imp, 5).collect()]
    assert top == sorted(top, reverse=True) and len(top) == 5


def test_validated_training_and_quality(spark):
    """A learnable rule stops early and scores well; a label of chance doesn't."""
    rows = [(k, float(k % 50), float(k * 7919 % 101), int(k % 50 > 30), int(k * 104729 % 7 == 0)) for k in range(2000)]
    df = spark.createDataFrame(rows, "quake_id long, a double, b double, rule int, chance int")
    q = {}
    for label in ("rule", "chance"):
        train = ML.validation_rows(M.class_weight(df.withColumnRenamed(label, "is_significant")))
        assert {r[0]: r[1] for r in train.groupBy("is_significant").agg(F.avg(F.col("is_validation").cast("int"))).collect()} \
            == pytest.approx({0: 0.1, 1: 0.1}, abs=0.01)
        model = ML.train_classifier(train, ["a"], validation="is_validation", maxIter=30, maxDepth=2, stepSize=0.5)
        losses = [r.loss for r in ML.loss_series(model, train.where("is_validation")).orderBy("trees").collect()]
        assert len(losses) == model.stages[-1].getNumTrees <= 30
        q[label] = ML.score_quality(ML.predict(model, train, ["is_significant"])).first()
        if label == "rule":
            assert losses[-1] < losses[0]
    assert q["rule"].auc > 0.99 and q["rule"].log_loss < 0.2 < q["rule"].base_log_loss == pytest.approx(0.6931, abs=1e-4)
    assert q["chance"].log_loss > 0.6 and q["rule"].n == 2000


def test_runner_run_preset(spark, sf001, tmp_path):
    out = str(tmp_path / "res")
    res = run_analysis(spark, quake_view(spark, sf001), out, preset="run", cutoff=VIEW_CUTOFF,
                       gbt_params={"maxIter": 3})
    lines = [r.line for r in res["report"].orderBy("line_no").collect()]
    assert lines[0] == "Philippine Earthquake Analysis - Summary Report"
    assert "Total Earthquakes Analyzed: 810" in lines
    assert lines[-3] == "Clustering Results:"
    text = open(next((tmp_path / "res" / "report").glob("data-*/part-*"))).read()
    assert text.splitlines() == lines
    charts = set(os.listdir(tmp_path / "res" / "charts"))
    assert {"magnitude_histogram", "region_significance", "confusion", "importance", "regions",
            "map_magnitude", "depth_magnitude", "magnitude_by_class"} <= charts
    cells = res["chart_confusion"].agg(F.sum("n")).first()[0]
    assert cells == res["predictions"].count()
