"""Aggregations, top-k and histograms.

Every aggregate is a hash aggregate with a map-side partial step, so a hot key
(one region or place holding a third of all rows) is pre-combined in each task
before the shuffle and only one partial row per task and key crosses it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def totals(df: DataFrame, flag: str = "is_significant") -> DataFrame:
    """Row count, flagged count and flagged percent (A1)."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(flag).cast("bigint").alias("significant"),
        (F.avg(flag) * F.lit(100.0)).alias("pct"),
    )


def region_breakdown(df: DataFrame, key: str = "Region", flag: str = "is_significant") -> DataFrame:
    """Per-key count, flagged count and flagged rate in percent, key ascending."""
    return (df.groupBy(key)
            .agg(F.count(F.lit(1)).alias("Total_Quakes"),
                 F.sum(flag).cast("bigint").alias("Significant_Quakes"),
                 (F.avg(flag) * F.lit(100.0)).alias("Significance_Rate"))
            .orderBy(key))


def modal(df: DataFrame, by: str, col: str, name: str = "mode", default: str = "Unknown") -> DataFrame:
    """``(by, name)``: per group the most frequent non-NULL value, smallest on ties,
    ``default`` if there is none (A4).

    Values are counted per (group, value) first, so no task holds the values of a group.
    """
    counted = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("n"))
    order = F.when(F.col(col).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(col).alias("v")))
    return counted.groupBy(by).agg(F.coalesce(F.min(order)["v"], F.lit(default)).alias(name))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Counts per non-NULL value."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))


def top_values(df: DataFrame, col: str, k: int = 10, name: str = "n") -> DataFrame:
    """Top-k values by count, ties by value ascending, numbered 1..k (O1, O2).

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps its
    own k best rows, so only k rows per task reach the final merge.
    """
    top = value_counts(df, col, name).orderBy(F.col(name).desc(), F.col(col).asc()).limit(k)
    w = Window.orderBy(F.col(name).desc(), F.col(col).asc())
    return top.select(F.row_number().over(w).alias("rank"), col, name)


def crosstab(df: DataFrame, row: str, col: str, values: list, names: list[str]) -> DataFrame:
    """Counts of ``row`` x ``col`` as one column per value of ``col``, absent cells 0.

    A single hash aggregate of conditional counts: no pivot pre-aggregation, one
    shuffle.
    """
    return (df.groupBy(row)
            .agg(*[F.count_if(F.col(col) == F.lit(v)).alias(n) for v, n in zip(values, names)])
            .orderBy(row))


def class_counts(df: DataFrame, label: str = "is_significant") -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def zone_summary(df: DataFrame, label: str = "Cluster", noise: int = -1) -> DataFrame:
    """Distinct labels with noise, zones without noise, and noise rows.

    Counted per label first (partial aggregate), then over the few label rows.
    """
    per_label = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return per_label.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.count_if(F.col(label) != F.lit(noise)).alias("n_zones"),
        F.coalesce(F.sum(F.when(F.col(label) == F.lit(noise), F.col("n"))), F.lit(0))
        .cast("bigint").alias("n_noise"),
    )


def impute_mean(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric columns as DOUBLE with NULLs replaced by the column mean.

    The means come from one scalar subquery, evaluated once and inlined as a
    literal into the projection; no join and no trip through the driver.
    """
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means.getField(c)) for c in cols})


def _edge(i: Column, lo: float, hi: float, bins: int) -> Column:
    # Bin edges as NumPy's linspace makes them: i * step + lo, the last one exactly hi.
    step = (hi - lo) / float(bins)
    return F.when(i == F.lit(bins), F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))


def value_range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    """Global (min, max) of a column: one aggregate, a single row reaches the driver."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    return r["lo"], r["hi"]


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None,
              by_values: list | None = None) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed, empty bins kept.

    The range is one global aggregate (two numbers on the driver, like the split
    points of any bucketizer).  Each row's bin is computed in the scan stage
    (``floor`` then NumPy's one-step correction against the exact edges), counts
    are a partial hash aggregate, and the empty bins come from a ``bins``-row
    range joined to the (at most bins x classes) counts.
    """
    x = F.col(col)
    lo, hi = value_range(df, col)
    spark: SparkSession = df.sparkSession
    if lo is None:
        lo, hi = 0.0, 1.0
    elif lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    lo, hi = float(lo), float(hi)

    guess = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1))
    binned = df.where(x.isNotNull()).select(x, guess.alias("_g"), *([F.col(by)] if by else []))
    g = F.col("_g")
    binned = binned.withColumn("_d", F.when(x < _edge(g, lo, hi, bins), g - 1).otherwise(g))
    d = F.col("_d")
    binned = binned.withColumn(
        "bin", F.when((x >= _edge(d + 1, lo, hi, bins)) & (d != F.lit(bins - 1)), d + 1)
        .otherwise(d).cast("int"))

    keys = ["bin"] + ([by] if by else [])
    counted = binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = grid.withColumn(by, F.explode(F.array(*[F.lit(v) for v in by_values])))
    b = F.col("bin")
    return (grid.join(counted, keys, "left")
            .select(*keys,
                    _edge(b, lo, hi, bins).alias("lo"),
                    _edge(b + 1, lo, hi, bins).alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))
            .orderBy(*keys))
