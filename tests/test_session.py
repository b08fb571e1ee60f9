"""The shared folder on a cluster: a mounted share has the scheme ``file:`` too."""

import datetime
import os

import pytest
from pyspark.sql import Row

from faultline import session as S
from faultline.constants import GBT_PARAMS
from faultline.plans.registry import QUERIES


@pytest.fixture
def cluster(spark, monkeypatch):
    """The session as one of a standalone cluster, whose folders are mounted shares."""
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "spark://host:7077"), raising=False)
    monkeypatch.setattr(S, "_SHARED", set(), raising=False)
    return spark


def test_mounted_share_is_taken(cluster):
    folder = S.shared_dir(cluster)
    assert folder == cluster.conf.get("spark.checkpoint.dir")
    assert sorted(r.id for r in S.materialize(cluster.range(5)).collect()) == [0, 1, 2, 3, 4]
    assert not [f for f in os.listdir(folder) if f.startswith("shared-")]


def test_a_folder_is_tried_once(cluster, monkeypatch):
    S.shared_dir(cluster)
    monkeypatch.setattr(S, "_write_parts", lambda *a: pytest.fail("tried again"))
    S.shared_dir(cluster)


def test_folder_that_only_some_tasks_share_is_refused(cluster, monkeypatch):
    monkeypatch.setattr(S, "_write_parts", lambda s, path, n: s.range(0, n - 1, 1, n).write.parquet(path))
    with pytest.raises(ValueError, match="isn't shared"):
        S.materialize(cluster.range(1))


def test_queries_run_on_a_mounted_share(cluster, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    cluster.createDataFrame([Row(event_id=i, ts=start + datetime.timedelta(hours=i), user_id=i % 40) for i in range(300)]) \
        .write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["csv_round_trip"](cluster, str(tmp_path)).count() == 300
    assert QUERIES["region_by_rule_table"](cluster, str(tmp_path)).count() == 300
    assert {r.column_name for r in QUERIES["describe_numeric"](cluster, str(tmp_path)).collect()} == \
        {"Latitude", "Longitude", "Magnitude"}
    train = QUERIES["class_counts"](cluster, str(tmp_path)).agg({"n": "sum"}).first()[0]
    test = QUERIES["accuracy"](cluster, str(tmp_path)).first()["n"]
    assert train + test == QUERIES["clean_catalog"](cluster, str(tmp_path)).count()


def test_sinks_and_zones_run_on_a_mounted_share(cluster, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    cluster.createDataFrame([Row(event_id=i, ts=start + datetime.timedelta(hours=i), user_id=i % 40) for i in range(300)]) \
        .write.parquet(f"{tmp_path}/events.parquet")
    n = QUERIES["clean_catalog"](cluster, str(tmp_path)).count()
    charts = QUERIES["chart_round_trip"](cluster, str(tmp_path))
    assert charts.where("chart = 'regions'").agg({"n": "sum"}).first()[0] == n
    lines = [r.line_no for r in QUERIES["report_round_trip"](cluster, str(tmp_path)).orderBy("line_no").collect()]
    assert lines == list(range(1, len(lines) + 1)) and lines
    for name in ("dbscan_precise", "nearest_label_hot", "map_points", "feature_table"):
        assert QUERIES[name](cluster, str(tmp_path)).count() == n, name


@pytest.fixture(scope="module")
def quakes(spark, tmp_path_factory):
    """A folder with events, the number of its clean rows and of those held out for a test."""
    folder, start = str(tmp_path_factory.mktemp("quakes")), datetime.datetime(2024, 1, 1)
    spark.createDataFrame([Row(event_id=i, ts=start + datetime.timedelta(hours=i), user_id=i % 40) for i in range(300)]) \
        .write.parquet(f"{folder}/events.parquet")
    return folder, QUERIES["clean_catalog"](spark, folder).count(), QUERIES["split_assignment"](spark, folder).where("is_test").count()


@pytest.mark.parametrize("name, rows", [
    ("class_weight", lambda n, test: 2),
    ("classification_report", lambda n, test: 5),
    ("confusion_cells", lambda n, test: 4),
    ("confusion_matrix", lambda n, test: 2),
    ("dbscan_labels", lambda n, test: n),
    ("dbscan_labels_tight", lambda n, test: n),
    ("map_tiles", lambda n, test: None),
    ("model_checks", lambda n, test: 7),
    ("model_predictions", lambda n, test: test),
    ("model_learns", lambda n, test: 4),
    ("model_report", lambda n, test: 5),
    ("nearest_label", lambda n, test: n),
    ("model_test_rows", lambda n, test: test),
])
def test_query_runs_on_a_mounted_share(quakes, cluster, monkeypatch, name, rows):
    folder, n, test = quakes
    monkeypatch.setitem(GBT_PARAMS, "maxIter", 3)
    out = QUERIES[name](cluster, folder)
    if name == "map_tiles":
        assert out.where("zoom = 0").agg({"n": "sum"}).first()[0] == n
    else:
        assert out.count() == rows(n, test)
