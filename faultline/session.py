"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

BASE_CONF = {
    # Event times are naive local wall-clock times; pin the session zone so that
    # parsing and field extraction never shift them.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Generated methods above 8000 bytes of bytecode are never JIT-compiled by
    # HotSpot; above this limit Spark splits the stage instead of running one
    # huge interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str | None = None, app: str = "faultline", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the library relies on.

    ``shuffle_partitions`` is left to the cluster's own setting unless given: size it to
    the data (about 128-256 MB of shuffle data per partition); AQE coalesces, it never adds.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("FAULTLINE_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a ``local[...]`` session, which is one process, takes a temporary
    folder; any other takes one under the session's warehouse, which Spark already shares
    between driver and executors.  A ``file:`` folder may be a mounted share: on a cluster it
    is refused only if files that tasks write there don't reach the driver.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            configured = f"{tempfile.gettempdir()}/faultline-shared"
        else:
            configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    configured = configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") and _is_local(spark, configured):
        tried = (spark.sparkContext.applicationId, configured)
        if tried not in _SHARED:
            if not _is_shared(spark, configured):
                raise ValueError(f"{configured} isn't shared by driver and executors; set spark.checkpoint.dir to a folder that is")
            _SHARED.add(tried)
    return configured


#: Applications and ``file:`` folders that were found to be shared.
_SHARED: set[tuple[str, str]] = set()


def _write_parts(spark: SparkSession, path: str, n: int) -> None:
    spark.range(0, n, 1, n).write.parquet(path)


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether the driver and the executors find what a task for each core writes to ``folder``."""
    n, path = spark.sparkContext.defaultParallelism, f"{folder}/shared-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    try:
        _write_parts(spark, path, n)
        return spark.read.schema("id long").parquet(path).count() == n
    finally:
        fs.delete(p, True)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _is_local(spark: SparkSession, path: str) -> bool:
    return _path(spark, path)[1].getUri().getScheme() == "file"


def tables_dir(spark: SparkSession) -> str:
    """This application's own folder under :func:`shared_dir`; removed when the driver ends."""
    base = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    p, fs = _path(spark, base)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return base


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the plan once (a reliable
    checkpoint runs it twice unless cached), and the files survive the loss of
    any executor.  :func:`drop_tables` removes it once nothing reads it any more;
    what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._faultline_path = path
    return out


def drop_tables(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_faultline_path", None)
        if path:
            p, fs = _path(t.sparkSession, path)
            fs.delete(p, True)


def materialize_observed(df: DataFrame, name: str, keep: list[str] | None = None, **metrics):
    """:func:`materialize` that also returns aggregate ``metrics`` (name -> Column)
    computed while writing, via ``DataFrame.observe`` (no extra job).  ``keep``
    projects the columns to write after the metrics are observed."""
    obs = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    observed = df.observe(obs, *[c.alias(k) for k, c in metrics.items()])
    if keep:
        observed = observed.select(*keep)
    out = materialize(observed, name)
    return out, obs.get
