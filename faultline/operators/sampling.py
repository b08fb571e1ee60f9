"""Exact-size seeded sample (D1) and stratified split.

Both take, per group, the ``k`` rows that come first in the repeatable order
``(md5('<key>-<seed>'), key)``.  No task sees a whole group: rows are counted
per (group, hash bucket), the bucket where each group's running count crosses
``k`` is found on that small count table, and only the rows of that one bucket
are ranked.  Buckets are prefixes of a uniform hash, so a group holding a third
of the table still spreads evenly over them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.constants import SEED
from faultline.functions.columns import md5_order

_G = "_grp"


def take_first_k(df: DataFrame, sizes: DataFrame, key: str, seed: int = SEED,
                 group: str | None = None, flag: str = "_selected", digits: int = 4,
                 max_edge: int = 1_000_000, _start: int = 0) -> DataFrame:
    """All rows of ``df`` with a boolean ``flag``: true for the first ``k`` rows of each group.

    ``sizes`` holds one row per group: ``(group, k)`` (or just ``k`` without a
    group).  Rows are counted per (group, bucket), a bucket being the next
    ``digits`` hex digits of the hash, so the count table has at most 16^digits
    rows per group.  Its running sum finds, per group, the boundary bucket; rows
    before it are in, rows after it out.  The boundary bucket's rows are ranked
    directly when there are at most ``max_edge`` of them, otherwise the same
    step recurses into them on the following digits.  Only the per-group cut
    rows (one per group) reach the driver.
    """
    if _start == 0:
        df = df.withColumns({_G: F.col(group) if group else F.lit(0), "_h": md5_order(key, seed)})
        sizes = sizes.withColumn(_G, F.lit(0)) if not group else sizes.withColumnRenamed(group, _G)
    spark = df.sparkSession
    hashed = df.withColumn("_b", F.conv(F.substring("_h", _start + 1, digits), 16, 10).cast("long"))

    per_bucket = hashed.groupBy(_G, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(_G).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = (per_bucket.withColumn("_cum", F.sum("_n").over(w))
           .withColumn("_tot", F.sum("_n").over(Window.partitionBy(_G)))
           .join(sizes.select(_G, "k"), _G)
           .withColumn("_before", F.col("_cum") - F.col("_n")))
    # Per group: the bucket where the running count reaches k (or "all in" when k >= the group).
    cut_rows = (cum.where(((F.col("_before") < F.col("k")) & (F.col("_cum") >= F.col("k")))
                          | ((F.col("_tot") <= F.col("k")) & (F.col("_cum") == F.col("_tot"))))
                .select(_G, F.when(F.col("_tot") <= F.col("k"), F.lit(16 ** digits)).otherwise(F.col("_b"))
                        .alias("_cut_b"),
                        (F.col("k") - F.col("_before")).alias("_need"), F.col("_n").alias("_edge_n"))
                .collect())
    gtype = df.schema[_G].dataType.simpleString()
    cuts = spark.createDataFrame([(r[_G], r["_cut_b"], r["_need"]) for r in cut_rows],
                                 f"{_G} {gtype}, _cut_b long, _need long")
    if group:
        tagged = hashed.join(cuts, _G, "left")
    else:  # one cut for all rows
        cut = cut_rows[0] if cut_rows else {"_cut_b": None, "_need": None}
        tagged = hashed.withColumns({c: F.lit(cut[c]).cast("long") for c in ("_cut_b", "_need")})
    side = (F.when(F.col("_cut_b").isNull(), F.lit("out"))
            .when(F.col("_b") < F.col("_cut_b"), F.lit("in"))
            .when(F.col("_b") > F.col("_cut_b"), F.lit("out"))
            .otherwise(F.lit("edge")))
    tagged = tagged.withColumn("_side", side)
    clear = tagged.where(F.col("_side") != "edge").withColumn(flag, F.col("_side") == "in")
    edge = tagged.where(F.col("_side") == "edge").drop("_b", "_cut_b", "_side")
    big = any(r["_edge_n"] > max_edge and r["_cut_b"] < 16 ** digits for r in cut_rows)
    if big and _start + 2 * digits <= 32:
        edge_sizes = cuts.select(_G, F.col("_need").alias("k"))
        ranked = take_first_k(edge.drop("_need"), edge_sizes, key, seed, group, flag, digits, max_edge,
                              _start=_start + digits)
    else:
        rank_w = Window.partitionBy(_G).orderBy("_h", key)
        ranked = edge.withColumn(flag, F.row_number().over(rank_w) <= F.col("_need")).drop("_need")
    out = clear.drop("_b", "_cut_b", "_need", "_side").unionByName(ranked)
    return out.drop(_G, "_h") if _start == 0 else out


def sample_exact(df: DataFrame, n: int, key: str = "quake_id", seed: int = SEED) -> DataFrame:
    """``min(n, rows)`` rows without replacement, the same rows on every run."""
    sizes = df.sparkSession.createDataFrame([(n,)], "k long")
    picked = take_first_k(df, sizes, key, seed, flag="_in_sample")
    return picked.where("_in_sample").drop("_in_sample")


def split_sizes(class_counts: dict, test_fraction: float) -> dict:
    """Test rows per class of a stratified split (largest remainder, ties by class).

    ``ceil(test_fraction * n)`` rows in test overall; the train share of each
    class is ``floor(n_c / n * n_train)`` plus one for the classes with the
    largest remainders, and the test share is the rest of the class.
    """
    n = sum(class_counts.values())
    n_test = math.ceil(test_fraction * n)
    n_train = n - n_test
    classes = sorted(class_counts)
    cont = {c: class_counts[c] / n * n_train for c in classes}
    train = {c: math.floor(cont[c]) for c in classes}
    need = n_train - sum(train.values())
    for c in sorted(classes, key=lambda c: (-(cont[c] - train[c]), c))[:need]:
        train[c] += 1
    return {c: class_counts[c] - train[c] for c in classes}


def stratified_split(df: DataFrame, label: str = "is_significant", test_fraction: float = 0.2,
                     key: str = "quake_id", seed: int = SEED, flag: str = "is_test") -> DataFrame:
    """All rows plus ``is_test``: exact class shares in test, repeatable row choice.

    Class counts are one small aggregate (a row per class reaches the driver).
    """
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = split_sizes(counts, test_fraction)
    spark = df.sparkSession
    label_type = df.schema[label].dataType.simpleString()
    size_df = spark.createDataFrame([(c, k) for c, k in sizes.items()], f"{label} {label_type}, k long")
    return take_first_k(df, size_df, key, seed, group=label, flag=flag)
