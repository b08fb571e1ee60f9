"""Committed sinks (S3, S4): old or new result, never a mixture."""

import os

import pytest
from pyspark.sql import functions as F

from faultline.sources import sinks as K


def names(path):
    return sorted(n for n in os.listdir(path) if not n.startswith("."))


def rows(spark, path):
    return sorted(repr(tuple(r)) for r in K.read_committed(spark, path, verify=True).collect())


def reprs(data):
    return sorted(repr(tuple(r)) for r in data)


DATA = [(1, "a", 0.5, None), (2, None, float("nan"), [1, None]), (2, None, float("nan"), [1, None]), (None, "é\n", -0.0, [])]
SCHEMA = "k long, t string, `odd name.x` double, l array<int>"


def test_round_trip_and_rewrite(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame(DATA, SCHEMA)
    first = K.commit(df, path)
    assert first["rows"] == 4 and rows(spark, path) == reprs(df.collect())
    before = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in names(path)}
    assert K.commit(df.repartition(3, "t").orderBy(F.rand(1)), path) == first  # the same rows in another order
    assert {n: os.stat(f"{path}/{n}").st_mtime_ns for n in names(path)} == before
    second = K.commit(df.where("k = 1"), path)
    assert second["folder"] != first["folder"] and names(path) == [second["folder"], "manifest.json"]
    assert rows(spark, path) == reprs([(1, "a", 0.5, None)])


def test_checksum_sees_repeats_swaps_and_nulls(spark, tmp_path):
    def of(data, schema="a string, b string"):
        return K.commit(spark.createDataFrame(data, schema), str(tmp_path / "c"))["checksum"]

    sums = [of(d) for d in ([("x", "y")], [("y", "x")], [("x", "y")] * 2, [("x", "y")] * 3, [("x", None)], [(None, "x")],
                            [("", "x")], [("xy", "")], [])]
    assert len(set(sums)) == len(sums)


@pytest.mark.parametrize("step", ["write", "move", "manifest"])
def test_a_failed_write_leaves_the_old_result(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "r")
    K.commit(spark.createDataFrame([(1,)], "k long"), path)
    new = spark.createDataFrame([(2,), (3,)], "k long")
    if step == "write":
        new = new.withColumn("k", F.when(F.col("k") == 3, F.raise_error(F.lit("broken"))).otherwise(F.col("k")))
    else:
        real = K._put

        def broken(*a):
            if step == "manifest":
                raise OSError("broken")
            return real(*a)

        monkeypatch.setattr(K, "_put", broken)
        if step == "move":
            monkeypatch.setattr(K.json, "dumps", lambda *a, **k: (_ for _ in ()).throw(OSError("broken")))
    with pytest.raises(Exception, match="broken"):
        K.commit(new, path)
    monkeypatch.undo()
    assert rows(spark, path) == reprs([(1,)])
    assert not [n for n in names(path) if n.startswith("_staged-")]
    K.commit(spark.createDataFrame([(2,), (3,)], "k long"), path)
    assert rows(spark, path) == reprs([(2,), (3,)]) and len(names(path)) == 2


def test_damage_is_seen(spark, tmp_path):
    path = str(tmp_path / "r")
    with pytest.raises(K.NotCommitted):
        K.read_committed(spark, path)
    m = K.commit(spark.createDataFrame([(1,), (2,)], "k long"), path)
    spark.createDataFrame([(9,)], "k long").write.mode("append").parquet(f"{path}/{m['folder']}")
    with pytest.raises(K.NotCommitted):
        K.read_committed(spark, path, verify=True)


def test_report_lines_keep_order_and_blanks(spark, tmp_path):
    path = str(tmp_path / "report")
    lines = ["Title", "", "a ≥ b", "", "end", ""]
    df = spark.createDataFrame([(k + 1, t) for k, t in enumerate(lines)], "line_no int, line string").repartition(4)
    K.write_report(df, path)
    assert [tuple(r) for r in K.read_report(spark, path).orderBy("line_no").collect()] == list(enumerate(lines, 1))
