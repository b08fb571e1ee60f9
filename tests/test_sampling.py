"""Exact sample and stratified split."""

from pyspark.sql import functions as F

from faultline.operators.sampling import sample_exact, stratified_split, split_sizes


def test_sample_cap_above_rows(spark):
    df = spark.range(50).withColumnRenamed("id", "quake_id")
    assert sample_exact(df, 100).count() == 50


def test_sample_exact_size_and_repeatable(spark):
    df = spark.range(5000).withColumnRenamed("id", "quake_id")
    a = sample_exact(df, 777)
    b = sample_exact(df.repartition(7), 777)
    assert a.count() == 777
    assert a.exceptAll(b).count() == 0


def test_sample_is_first_by_hash(spark):
    df = spark.range(2000).withColumnRenamed("id", "quake_id")
    h = F.md5(F.concat_ws("-", F.col("quake_id").cast("string"), F.lit("42")))
    want = {r[0] for r in df.orderBy(h, "quake_id").limit(300).collect()}
    got = {r[0] for r in sample_exact(df, 300).collect()}
    assert got == want


def test_split_sizes_fixture():
    assert split_sizes({0: 7432, 1: 657}, 0.2) == {0: 1487, 1: 131}


def test_stratified_split(spark):
    df = spark.range(3000).select(F.col("id").alias("quake_id"),
                                  (F.col("id") % 13 == 0).cast("int").alias("is_significant"))
    s = stratified_split(df)
    counts = {(r.is_significant, r.is_test): r.n
              for r in s.groupBy("is_significant", "is_test").agg(F.count("*").alias("n")).collect()}
    sizes = split_sizes({0: 3000 - 231, 1: 231}, 0.2)
    assert counts[(0, True)] == sizes[0] and counts[(1, True)] == sizes[1]
    assert sum(counts.values()) == 3000


def test_recursive_boundary_refinement(spark):
    from faultline.operators.sampling import take_first_k
    df = spark.range(20000).select(F.col("id").alias("quake_id"), (F.col("id") % 3).alias("g"))
    sizes = spark.createDataFrame([(0, 1234), (1, 0), (2, 99999)], "g long, k long")
    out = take_first_k(df, sizes, "quake_id", group="g", flag="sel", digits=1, max_edge=50)
    got = {r.g: r.n for r in out.where("sel").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1234, 2: 6666}
    h = F.md5(F.concat_ws("-", F.col("quake_id").cast("string"), F.lit("42")))
    want = {r[0] for r in df.where("g = 0").orderBy(h, "quake_id").limit(1234).collect()}
    assert {r[0] for r in out.where("sel AND g = 0").select("quake_id").collect()} == want
    assert out.count() == 20000
