"""Sinks: the text report (S3) and chart-data tables (S4), committed as a whole.

A result is written to a folder of its own, named by its content, beside a manifest that
says how many rows it has and their checksum.  The manifest is then moved into place by one
rename, and only then are older results removed.  So a reader finds the old result or the
new one, a writer that fails leaves the old one, and writing the same result again changes
nothing.  The checksum doesn't depend on the order or the partitions of the rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
_MODULUS = (1 << 61) - 1


class NotCommitted(ValueError):
    """The folder holds no committed result, or one that isn't what its manifest says."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _row_hash(df: DataFrame) -> Column:
    """A number for each row, of its values in order of the columns."""
    cols = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}), F.lit(""))
            for c in df.columns]
    return F.xxhash64(*cols)


def _measures(df: DataFrame) -> dict[str, Column]:
    """Rows and checksum as aggregates: sums of row hashes, so order doesn't matter and repeats count."""
    h = _row_hash(df)
    return {"rows": F.count(F.lit(1)),
            "sum": F.coalesce(F.sum(F.pmod(h, F.lit(_MODULUS)).cast("decimal(38,0)")), F.lit(0)).cast("string"),
            "mixed": F.coalesce(F.sum(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(_MODULUS)).cast("decimal(38,0)")),
                                F.lit(0)).cast("string")}


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the committed result at ``path``; None without one."""
    p, fs = _fs(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(p.toString(), wholetext=True).collect()))


def _put(spark: SparkSession, path: str, content: dict) -> None:
    """Write the manifest beside its place and move it there over the old one."""
    jvm = spark.sparkContext._jvm
    fresh, fs = _fs(spark, f"{path}/_manifest-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    final, _ = _fs(spark, f"{path}/{MANIFEST}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, final, over)


def commit(df: DataFrame, path: str, fmt: str = "parquet", **options) -> dict:
    """Write ``df`` as the result at ``path``; returns its manifest.

    Rows are counted and summed up while they are written.  Of the old results only the
    committed one is kept until the new one is in place.  One writer at a time."""
    spark, path = df.sparkSession, path.rstrip("/")
    old = manifest(spark, path)
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    seen = Observation(f"commit-{uuid.uuid4().hex[:8]}")
    observed = df.observe(seen, *[c.alias(n) for n, c in _measures(df).items()])
    stage, fs = _fs(spark, staged)
    try:
        observed.write.format(fmt).options(**options).save(staged)
        got = seen.get
        new = {"rows": got["rows"], "checksum": f"{int(got['sum']):x}-{int(got['mixed']):x}", "format": fmt,
               "schema": df.schema.json()}
        new["folder"] = f"data-{uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(new, sort_keys=True)).hex}"
        if new == old:
            return old
        final, _ = _fs(spark, f"{path}/{new['folder']}")
        if fs.exists(final):  # left by a writer that ended before its manifest was in place
            fs.delete(final, True)
        if not fs.rename(stage, final):
            raise OSError(f"can't move {staged}")
        _put(spark, path, new)
    finally:
        fs.delete(stage, True)
    for f in fs.listStatus(_fs(spark, path)[0]):
        name = f.getPath().getName()
        if name.startswith(("data-", "_staged-", "_manifest-")) and name != new["folder"]:
            fs.delete(f.getPath(), True)
    return new


def read_committed(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """The committed result at ``path``; with ``verify`` its rows are held against the manifest first."""
    from pyspark.sql.types import StructType

    m = manifest(spark, path)
    if m is None:
        raise NotCommitted(f"{path} has no committed result")
    schema = StructType.fromJson(json.loads(m["schema"]))
    df = spark.read.format(m["format"]).schema(schema).load(f"{path.rstrip('/')}/{m['folder']}")
    if verify:
        got = df.agg(*[c.alias(n) for n, c in _measures(df).items()]).first()
        if got["rows"] != m["rows"] or f"{int(got['sum']):x}-{int(got['mixed']):x}" != m["checksum"]:
            raise NotCommitted(f"{path} isn't what its manifest says")
    return df


def write_report(lines: DataFrame, path: str) -> dict:
    """Commit report rows ``(line_no, line)`` as one text file, in line order (S3); returns the manifest.

    The report has a few dozen rows, so a single output partition is bounded."""
    one = lines.coalesce(1).sortWithinPartitions("line_no")
    return commit(one.select(F.col("line").alias("value")), path, "text", lineSep="\n")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A committed report as ``(line_no, line)``."""
    m = manifest(spark, path)
    if m is None:
        raise NotCommitted(f"{path} has no committed result")
    whole = spark.read.text(f"{path.rstrip('/')}/{m['folder']}", wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\n\z", ""), "\n")
    return whole.select(F.posexplode(lines).alias("n", "line")).select((F.col("n") + 1).cast("int").alias("line_no"), "line")


def write_chart_data(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Commit one Parquet data set per chart (S4); returns the path of each."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        commit(df, out[name])
    return out
