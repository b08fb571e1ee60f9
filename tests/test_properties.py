"""Property tests."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.operators import aggregates as A
from faultline.operators import metrics as E
from faultline.operators import spatial as Z
from faultline.operators.clean import clean_catalog
from faultline.operators.sampling import stratified_split
from faultline.sources.catalog import VIEW_CUTOFF, quake_view

from .test_spatial import brute_dbscan


def test_totals_and_histogram_add_up(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    t = A.totals(clean).first()
    rb = A.region_breakdown(clean).agg(F.sum("Total_Quakes"), F.sum("Significant_Quakes")).first()
    assert (rb[0], rb[1]) == (t.total, t.significant)
    for bins in (7, 30, 50):
        assert A.histogram(clean, "Magnitude", bins).agg(F.sum("n")).first()[0] == t.total
    cross = A.crosstab(clean, "Region", "is_significant", [0, 1], ["a", "b"]).agg(F.sum("a"), F.sum("b")).first()
    assert cross[0] + cross[1] == t.total and cross[1] == t.significant


def test_confusion_cells_add_to_test_size(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    test = stratified_split(clean).where("is_test").withColumn("prediction", (F.col("Depth_In_Km") < 100).cast("int"))
    n = test.count()
    assert E.confusion_cells(test).agg(F.sum("n")).first()[0] == n
    assert n == -(-810 * 2 // 10)  # ceil(0.2 * 810)


def test_noise_has_no_core_within_eps(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    lab = Z.dbscan(clean, eps=0.055, min_samples=6).select("quake_id", "Latitude", "Longitude", "Cluster").collect()
    xy = np.array([(r.Latitude, r.Longitude) for r in lab])
    c = np.array([r.Cluster for r in lab])
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    core = (d2 <= 0.055 * 0.055).sum(1) >= 6
    noise = c == -1
    assert not core[noise].any()
    assert not ((d2[noise][:, core] <= 0.055 * 0.055).any())


points = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=60)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pts=points, min_samples=st.integers(1, 5))
def test_dbscan_random_grids(spark, pts, min_samples):
    rows = [(i, x / 10.0, y / 10.0) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, "quake_id long, Latitude double, Longitude double")
    got = {r.quake_id: r.Cluster for r in Z.dbscan(df, eps=0.25, min_samples=min_samples).collect()}
    want = brute_dbscan([r[0] for r in rows], [(r[1], r[2]) for r in rows], 0.25, min_samples)
    assert got == want
