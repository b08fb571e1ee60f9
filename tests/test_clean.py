"""Cleaning on the quake view at sf0.001 against the published fixture counts."""

from pyspark.sql import functions as F

from faultline.operators import aggregates as A
from faultline.operators import clean as C
from faultline.sources.catalog import VIEW_CUTOFF, quake_view


def test_drop_after_and_require(spark):
    df = spark.createDataFrame(
        [(1, "2025-10-15 00:00:00"), (2, "2025-10-15 00:00:01"), (3, None)], "k int, t string")
    df = df.withColumn("t", F.try_to_timestamp("t").cast("timestamp_ntz"))
    kept = [r.k for r in C.drop_after(df, "t", "2025-10-15 00:00:00").collect()]
    assert kept == [1]
    rows = spark.createDataFrame([(None, 1.0, 1.0, 1.0), (1.0, None, 1.0, 1.0), (1.0, 1.0, None, 1.0),
                                  (1.0, 1.0, 1.0, None), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    assert C.require(rows, ["a", "b", "c", "d"]).count() == 1


def test_clean_counts_sf0001(spark, sf001):
    clean = C.clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    t = A.totals(clean).first()
    assert (t.total, t.significant) == (810, 58)
    got = {r.Region: (r.Total_Quakes, r.Significant_Quakes) for r in A.region_breakdown(clean).collect()}
    assert got == {"Luzon": (391, 25), "Visayas": (162, 15), "Mindanao": (142, 6), "Unknown": (115, 12)}
    bands = {r.Depth_Category: r.n for r in clean.groupBy("Depth_Category").agg(F.count("*").alias("n")).collect()}
    assert bands == {"Shallow": 17, "Intermediate": 52, "Deep": 68, "Very Deep": 446,
                     "Extremely Deep": 225, None: 2}


def test_regions_by_name_equals_per_row(spark, sf001):
    raw = quake_view(spark, sf001)
    a = C.clean_catalog(raw, cutoff=VIEW_CUTOFF).select("quake_id", "Region")
    b = C.clean_catalog(raw, cutoff=VIEW_CUTOFF, regions_by_name=False).select("quake_id", "Region")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cleaning_audit(spark, sf001):
    got = {r.rule: r.n for r in C.cleaning_audit(quake_view(spark, sf001), cutoff=VIEW_CUTOFF).collect()}
    assert got["raw_rows"] == 1000
    assert got["bad_or_null_time"] == 35
    assert got["after_cutoff"] == 94
    assert got["latitude_null"] == 15
    assert got["magnitude_null"] == 13
    assert got["depth_not_number"] == 45
    assert got["clean_rows"] == 810


def test_csv_source_reads_as_pandas(spark, tmp_path):
    """Quotes, commas and line breaks inside fields, missing tokens, malformed numbers."""
    import pandas as pd

    from faultline.constants import RAW_COLUMNS
    from faultline.sources.catalog import read_catalog
    p = tmp_path / "cat.csv"
    p.write_text("Date_Time_PH,Latitude,Longitude,Depth_In_Km,Magnitude,Location,General_Location\n"
                 '2025-01-02 03:04:05,10.5,125.1,<001,4.2,"012 km ""N"" of X, Y",Cebu\n'
                 "2025-01-02 03:04:06,NA,125.1,12,3.1,x,\n"
                 '2025-01-03 03:04:07, 9.5 ,inf,12,3.1,"two\nlines \\ of ""text""",Davao Oriental\n'
                 "not a date,9.5,125.0,7,4.0,None,Leyte\n"
                 "2025-01-04 03:04:08,9.5,125.0,7,4.0,n/a,Leyte\n")
    raw = read_catalog(spark, str(p))
    assert all(t == "string" for c, t in raw.dtypes if c != "quake_id")
    got = C.coerce(raw).orderBy("quake_id").toPandas()
    want = pd.read_csv(p)
    want["Date_Time_PH"] = pd.to_datetime(want["Date_Time_PH"], errors="coerce")
    for c in ("Latitude", "Longitude", "Depth_In_Km", "Magnitude"):
        want[c] = pd.to_numeric(want[c], errors="coerce")
    for c in RAW_COLUMNS:
        for a, b in zip(got[c], want[c]):
            assert (pd.isna(a) and pd.isna(b)) or a == b, (c, a, b)
    clean = C.clean_catalog(raw, cutoff="2025-10-15 00:00:00").collect()
    assert [(r.General_Location, r.Region) for r in clean] == [("Leyte", "Visayas")]  # inf is no place
    audit = {r.rule: r.n for r in C.cleaning_audit(raw, cutoff="2025-10-15 00:00:00").collect()}
    assert audit["coordinate_not_finite"] == 1 and audit["clean_rows"] == 1
    single = read_catalog(spark, str(p), multi_line=False)
    assert single.columns == raw.columns


def test_other_time_formats(spark):
    raw = spark.createDataFrame([(1, "02/01/2025 03:04", "7.0", "125.0", "5", "4.5", None, "Leyte")],
                                "quake_id long, Date_Time_PH string, Latitude string, Longitude string, "
                                "Depth_In_Km string, Magnitude string, Location string, General_Location string")
    assert C.clean_catalog(raw).count() == 0
    row = C.clean_catalog(raw, formats=["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm"]).first()
    assert (row.Month, row.Hour) == (1, 3)
