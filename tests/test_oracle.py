"""Registered queries against their DuckDB SQL at sf0.001 (the driver's gate, in small)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FAST = ["clean_catalog", "cleaning_audit", "column_info", "describe_numeric", "region_breakdown", "top_places",
        "region_significance", "magnitude_histogram_by_class", "split_assignment", "class_weight", "feature_table",
        "classification_report", "sample_points", "within_distance_counts", "dbscan_labels_tight", "zone_profile", "impute_mean", "region_by_rule_table", "csv_round_trip", "one_hot_depth", "nearest_label",
        "nearest_label_hot", "within_distance_hot", "within_distance_between", "within_distance_precise", "dbscan_precise", "silhouette_squared", "silhouette_score",
        "map_points", "map_tiles", "time_layout_vote", "map_magnitude_points", "report_round_trip", "chart_round_trip", "run_summary_values"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def con(sf001):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf001}/events.parquet')")
    return c


def test_every_query_has_sql():
    from faultline.plans import oracle, registry
    missing = set(registry.queries()) - set(oracle.oracle_sql())
    assert missing == {"silhouette_bounds", "model_predictions", "top_features", "model_report", "run_summary"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf001, con, name):
    df = entry.queries()[name](spark, sf001)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, res.fetchall())


def test_silhouette_bounds_hold_the_exact_score(spark, sf001, con):
    b = entry.queries()["silhouette_bounds"](spark, sf001).first()
    exact, n = con.execute(entry.oracle_sql()["silhouette_score"].replace(", 1) AS silhouette", ", 9) AS silhouette")).fetchone()
    assert b.lower <= exact <= b.upper and b.upper - b.lower <= 0.02 + 1e-8 and b.n == n


def test_entry_smoke(spark):
    out = entry.entry(spark)
    assert out.columns == ["Region", "Total_Quakes", "Significant_Quakes", "Significance_Rate"]
    assert out.count() == 4
