"""Profiling of a catalogue."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import drop_tables, materialize

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def column_info(df: DataFrame) -> DataFrame:
    """Position, name, type and non-NULL count of each column.

    One scan with one ``count(c)`` per column, then the single row is unpivoted.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = ", ".join(
        f"{i}, '{f.name}', '{f.dataType.simpleString()}', c{i}" for i, f in enumerate(df.schema.fields))
    return counts.selectExpr(
        f"stack({len(df.columns)}, {rows}) AS (position, column_name, data_type, non_null)"
    ).select(F.col("position").cast("int"), "column_name", "data_type",
             F.col("non_null").cast("bigint"))


def preview(df: DataFrame, n: int = 5, by: str = "quake_id") -> DataFrame:
    """First ``n`` rows by key (P3): a top-k, each task keeps only its n smallest keys."""
    return df.orderBy(by).limit(n)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("quake_id",)) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
#: Accuracy of the sketch that brackets the quartiles, and how far the bracket reaches, in its errors.
SKETCH, REACH = 10_000, 2.0


def _bracketed(df: DataFrame, brackets: list[tuple[int, str, float, float]], cols: list[str]):
    """Counts of the distinct values inside each bracket ``(column number, quartile, low, high)``,
    as a table ``(b, x, c)``; and on the driver the values below each bracket and inside it.

    One scan: what lies below is counted on the way, only what lies inside is shuffled."""
    x = [F.col(c).cast("double") for c in cols]
    seen = Observation(f"brackets-{uuid.uuid4().hex[:8]}")
    below = [F.count_if(x[c] < F.lit(lo)).alias(f"b{k}") for k, (c, _, lo, _) in enumerate(brackets)]
    inside = [F.count_if(x[c].between(F.lit(lo), F.lit(hi))).alias(f"i{k}") for k, (c, _, lo, hi) in enumerate(brackets)]
    hit = [F.when(x[c].between(F.lit(lo), F.lit(hi)), F.struct(F.lit(k).alias("b"), x[c].alias("x")))
           for k, (c, _, lo, hi) in enumerate(brackets)]
    values = df.observe(seen, *below, *inside).select(F.explode(F.array_compact(F.array(*hit))).alias("v")).select("v.*")
    counts = materialize(values.groupBy("b", "x").agg(F.count(F.lit(1)).alias("c")), "quartile-counts")
    got = seen.get
    return counts, [(got[f"b{k}"], got[f"i{k}"]) for k in range(len(brackets))]


def _quartiles(df: DataFrame, cols: list[str], stats: dict[str, dict]) -> dict[tuple[int, str], float]:
    """Exact quartiles by linear interpolation: ``{(column number, name): value}``.

    ``stats``: per column ``n, min, max`` and ``around``, the sketch's values about
    ``REACH`` of its errors below and above each quartile.  Those bracket the ranks that a
    quartile needs; a bracket that turns out to miss them is opened to the column's ends.
    The few values inside are counted, spread by ranges and placed by running counts, so
    neither a column's values are shuffled nor does a task see a whole bracket."""
    todo = [(k, name, *stats[c]["around"][name]) for k, c in enumerate(cols) if stats[c]["n"] for name in QUARTILES]
    out: dict[tuple[int, str], float] = {}
    while todo:
        counts, sizes = _bracketed(df, todo, cols)
        ranks, missed = [], []
        for b, ((k, name, *_), (below, inside)) in enumerate(zip(todo, sizes, strict=True)):
            h = (stats[cols[k]]["n"] - 1) * QUARTILES[name]
            if below <= math.floor(h) and math.ceil(h) < below + inside:
                ranks.append((b, math.floor(h) - below, math.ceil(h) - below))
            else:
                missed.append((k, name, stats[cols[k]]["min"], stats[cols[k]]["max"]))
        if ranks:
            wanted = df.sparkSession.createDataFrame(ranks, "b int, lo long, hi long")  # a row for each bracket
            spread = materialize(counts.join(wanted, "b").repartitionByRange("b", "x")
                                 .withColumn("part", F.spark_partition_id()), "quartile-ranges")
            before = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
            parts = spread.groupBy("b", "part").agg(F.sum("c").alias("n")).select(
                "b", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
            upto = F.col("start") + F.sum("c").over(Window.partitionBy("b", "part").orderBy("x"))
            placed = spread.join(parts, ["b", "part"]).withColumn("upto", upto)

            def at(rank: str):
                return F.max(F.when((F.col(rank) >= F.col("upto") - F.col("c")) & (F.col(rank) < F.col("upto")), F.col("x")))

            for r in placed.groupBy("b").agg(at("lo").alias("lo"), at("hi").alias("hi")).collect():
                k, name = todo[r["b"]][:2]
                h = (stats[cols[k]]["n"] - 1) * QUARTILES[name]
                out[k, name] = r["lo"] + (r["hi"] - r["lo"]) * (h - math.floor(h))
            drop_tables(spread)
        drop_tables(counts)
        todo = missed
    return out


def describe_numeric(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                     accuracy: int = 100_000) -> DataFrame:
    """count, mean, sample std, min, quartiles (linear interpolation), max per column (P5).

    One scan computes the moments of every column and a sketch that brackets the quartiles,
    a second one counts below and inside the brackets (:func:`_quartiles`);
    ``approx=True`` takes the quartiles from a finer sketch instead.  A column without
    values has NULLs.
    """
    cols = cols or numeric_columns(df)
    aim = list(QUARTILES.values())
    if not approx:
        step = REACH / SKETCH
        aim, accuracy = [min(1.0, max(0.0, q + d)) for q in aim for d in (-step, step)], SKETCH
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.lit(c).alias("column_name"), F.count(x).cast("bigint").alias("n"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.percentile_approx(x, aim, accuracy).alias("q"),
            F.max(x).alias("max")).alias(f"s{i}"))
    stacked = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s")) \
        .select("s.*")
    if approx:
        quartiles = [F.col("q")[k].alias(n) for k, n in enumerate(QUARTILES)]
        return stacked.select("column_name", "n", "mean", "std", "min", *quartiles, "max")
    rows = {r["column_name"]: r.asDict() for r in stacked.collect()}  # a row for each column
    for r in rows.values():
        r["around"] = {name: r["q"][2 * k:2 * k + 2] for k, name in enumerate(QUARTILES)} if r["n"] else {}
    q = _quartiles(df, cols, rows)
    out = [(c, *[rows[c][m] for m in ("n", "mean", "std", "min")], *[q.get((k, name)) for name in QUARTILES], rows[c]["max"])
           for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        out, "column_name string, n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")
