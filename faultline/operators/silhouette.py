"""Mean Euclidean silhouette with certified bounds.

The exact score compares every row with every other.  Here rows are taken cell by cell and
so are the labels they are compared with.  For a cell of ``w`` rows around their mean ``g``
with mean squared distance ``v`` to it, the mean distance from a place ``c`` lies between
``|c - g|`` and ``sqrt(|c - g|^2 + v)``; and all rows within ``r`` of ``c`` have mean
distances within ``r`` of that of ``c``.  Cells are split only where these bounds are too
wide, so the work follows the wished width, not the square of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import boxes as B
from faultline.operators.spatial import meet_sites, nearest_site, site_grid
from faultline.session import drop_tables, materialize, materialize_observed

#: Levels of four by four finer cells; the labels' first cells and the rows' first cells.
FINEST, LABEL_TOP, ROW_TOP = 12, 2, 4
#: Rounding of a mean squared distance, in parts of the squared extent.
_ROUND = 1e-14


def _score(a: Column, b: Column) -> Column:
    """``(b - a) / max(a, b)``, 0 where both are 0: rises with ``b`` and falls with ``a``."""
    return F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0))


def _moments() -> list[Column]:
    return [F.sum("w").alias("w"), F.sum("wx").alias("wx"), F.sum("wy").alias("wy"), F.sum("wq").alias("wq"),
            *B.merged_bounds()]


def _cells(fine: DataFrame, level: int) -> DataFrame:
    """``own, cx, cy, w, gx, gy, v`` and bounds of the cells of a level, summed from the finest."""
    by = 2 * (FINEST - level)
    cells = fine.groupBy("own", F.shiftright("cx", by).alias("cx"), F.shiftright("cy", by).alias("cy")).agg(*_moments())
    gx, gy = F.col("wx") / F.col("w"), F.col("wy") / F.col("w")
    one = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    spread = F.greatest(F.lit(0.0), F.col("wq") / F.col("w") - gx * gx - gy * gy) + F.lit(_ROUND)
    return cells.select("own", "cx", "cy", "w", F.when(one, F.col("x0")).otherwise(gx).alias("gx"),
                        F.when(one, F.col("y0")).otherwise(gy).alias("gy"),
                        F.when(one, F.lit(0.0)).otherwise(spread).alias("v"), *B.BOUNDS)


_ROW = ["own", "qcx", "qcy", "qx", "qy", "r", "rows", "n_own"]


def _targets(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Each row cell with its own label and every label that may be the nearest other: ``*_ROW, lab, n_lab``."""
    best = nearest_site(rows, centres, other_than=True)
    reach = F.sqrt("best.cost") + 2 * F.col("r")
    best = best.withColumn("best", F.struct((reach * reach * (1 + 1e-9)).alias("cost"), "best.rank", "best.pay"))
    side, fx, fy, top = site_grid(centres, 4.0)
    at = centres.withColumns({"cx": B.cell(F.col("sx"), side) - F.lit(fx), "cy": B.cell(F.col("sy"), side) - F.lit(fy)})
    near = B.d2(F.col("qx"), F.col("qy"), F.col("sx"), F.col("sy")) <= F.col("best.cost")
    other = meet_sites(best, _ROW, at.withColumn("extra", F.lit(0.0)), top, True, improve=False) \
        .where(near & (F.col("pay") != F.col("own"))).select(*_ROW, F.col("pay").alias("lab"), F.col("n_lab"))
    return other.unionByName(rows.select(*_ROW, F.col("own").alias("lab"), F.col("n_own").alias("n_lab")))


def _bounds_of_means(rows: DataFrame, fine: DataFrame, centres: DataFrame, part: float) -> DataFrame:
    """``(*_ROW, lab, lo, hi)``: bounds of the mean distance from the cell's centre to a label's rows.

    Each label's cells are met from coarse to fine; one whose bounds are within ``part`` of
    the larger of the two mean distances (bounded from below) is taken as it is."""
    targets = materialize(_targets(rows, centres), "silhouette-targets")
    d = F.sqrt(B.d2(F.col("qx"), F.col("qy"), F.col("gx"), F.col("gy")))
    share = F.col("w") / F.col("n_lab")

    def met(frontier: DataFrame, level: int, on: list[str]) -> DataFrame:
        by = {"ux": F.shiftright("cx", 2), "uy": F.shiftright("cy", 2)}
        cells = _cells(fine, level).withColumnRenamed("own", "lab").withColumns(by).drop(*B.BOUNDS)
        return frontier.join(cells, on).withColumns({"lo": share * d, "hi": share * F.sqrt(d * d + F.col("v"))})

    keep = [*_ROW, "lab", "n_lab"]
    first = materialize(met(targets, LABEL_TOP, ["lab"]).select(*keep, "lo", "hi", "cx", "cy", "w", "v"), "silhouette-met")
    by_label = first.groupBy("own", "qcx", "qcy", "lab").agg(F.sum("lo").alias("lo"))
    least = by_label.groupBy("own", "qcx", "qcy").agg(F.greatest(
        F.max(F.when(F.col("lab") == F.col("own"), F.col("lo"))),
        F.min(F.when(F.col("lab") != F.col("own"), F.col("lo")))).alias("m"))
    now = first.join(least, ["own", "qcx", "qcy"]).withColumn("tol", part * F.greatest(F.lit(0.0), F.col("m") - F.col("r")))
    taken, tables, level = [], [targets, first], LABEL_TOP
    while True:
        wide = (F.col("hi") - F.col("lo")) / share > F.col("tol")
        # a cell's rounding never keeps it open at the finest level
        now, seen = materialize_observed(
            now.select(*keep, "tol", "lo", "hi", F.col("cx").alias("ux"), F.col("cy").alias("uy"), wide.alias("wide")),
            "silhouette-level", open=F.count_if("wide"))
        tables.append(now)
        if not seen["open"] or level == FINEST:
            taken.append(now)
            break
        taken.append(now.where("NOT wide"))
        level += 1
        now = met(now.where("wide").drop("lo", "hi", "wide"), level, ["lab", "ux", "uy"])
    out = taken[0].select(*keep, "lo", "hi")
    for t in taken[1:]:
        out = out.unionByName(t.select(*keep, "lo", "hi"))
    sums = materialize(out.groupBy(*_ROW, "lab").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi")), "silhouette-means")
    drop_tables(*tables)
    return sums


def silhouette_bounds(df: DataFrame, width: float = 0.02, x: str = "Latitude", y: str = "Longitude",
                      label: str = "Cluster") -> DataFrame:
    """Certified bounds of the mean silhouette with Euclidean distances, on all rows, every
    label (noise too) a cluster: ``lower, upper, n``, with ``upper - lower <= width`` (Z2).

    Rows of a label of one row score 0, and all rows do if there is one label.  Rows without
    coordinates or label are left out; without rows the bounds are NULL.

    Rows of a label are taken in cells; a cell whose score bounds are wider than ``width``
    is split into sixteen, until it holds one place, and all ends as soon as the bounds of
    the mean are near enough.  Labels that can't be a cell's nearest other are left out by a
    search on their centres."""
    df = df.where((F.abs(F.col(x)) < F.lit(math.inf)) & (F.abs(F.col(y)) < F.lit(math.inf)) & F.col(label).isNotNull())
    pos, seen = materialize_observed(
        df.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(label).cast("long").alias("own"))
        .agg(F.count(F.lit(1)).alias("w")), "silhouette-positions",
        x0=F.min("x"), x1=F.max("x"), y0=F.min("y"), y1=F.max("y"), n=F.sum("w"),
        l0=F.min("own"), l1=F.max("own"))
    spark, n = df.sparkSession, seen["n"] or 0

    def result(lower, upper):
        return spark.createDataFrame([(lower, upper, n)], "lower double, upper double, n long")

    if not n:
        return result(None, None)
    extent = max(seen["x1"] - seen["x0"], seen["y1"] - seen["y0"])
    if seen["l0"] == seen["l1"] or not extent:
        return result(0.0, 0.0)

    # In units of the extent, from the corner: distances scale, the score doesn't change.
    px, py = (F.col("x") - F.lit(seen["x0"])) / F.lit(extent), (F.col("y") - F.lit(seen["y0"])) / F.lit(extent)
    last = 4 ** FINEST - 1

    def number(c: Column) -> Column:
        return F.least(F.floor(c * F.lit(float(last + 1))).cast("long"), F.lit(last))

    fine = materialize(pos.select("own", "w", px.alias("px"), py.alias("py"))
                       .groupBy("own", number(F.col("px")).alias("cx"), number(F.col("py")).alias("cy")).agg(
        F.sum(F.col("w") * F.col("px")).alias("wx"), F.sum(F.col("w") * F.col("py")).alias("wy"),
        F.sum(F.col("w") * (F.col("px") * F.col("px") + F.col("py") * F.col("py"))).alias("wq"),
        F.sum("w").alias("w"), *B.bounds()), "silhouette-fine")
    labels = _cells(fine, 0).select(F.col("gx").alias("sx"), F.col("gy").alias("sy"), F.col("v").alias("extra"),
                                    F.col("own").alias("rank"), F.col("own").alias("pay"), F.col("w").alias("n_lab"))
    labels = materialize(labels, "silhouette-centres")
    size = labels.select(F.col("pay").alias("own"), F.col("n_lab").alias("n_own"))

    def row_cells(level: int, of: DataFrame) -> DataFrame:
        r = F.sqrt(B.far2(F.col("gx"), F.col("gy"))) * (1 + 1e-12)
        return _cells(of, level).join(size, "own").select(
            "own", F.col("cx").alias("qcx"), F.col("cy").alias("qcy"), F.col("gx").alias("qx"), F.col("gy").alias("qy"),
            F.when(F.col("v") == 0, F.lit(0.0)).otherwise(r).alias("r"), F.col("w").alias("rows"), "n_own")

    level, of, lower, upper = ROW_TOP, fine, 0.0, 0.0
    while True:
        rows = materialize(row_cells(level, of), "silhouette-rows")
        alone = rows.where("n_own = 1").select(*_ROW, F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"))
        means = _bounds_of_means(rows.where("n_own > 1"), fine, labels, width / 8)
        own, r = F.col("lab") == F.col("own"), F.col("r")
        by_row = means.groupBy(*_ROW).agg(*[f(F.when(own if mine else ~own, F.col(c))).alias(name) for f, mine, c, name in (
            (F.max, True, "lo", "a0"), (F.max, True, "hi", "a1"), (F.min, False, "lo", "b0"), (F.min, False, "hi", "b1"))])
        but_itself = F.col("n_own") / (F.col("n_own") - 1)
        a0, a1 = (F.greatest(F.lit(0.0), (F.col("a0") - r) * but_itself), (F.col("a1") + r) * but_itself)
        b0, b1 = F.greatest(F.lit(0.0), F.col("b0") - r), F.col("b1") + r
        scored = by_row.select(*_ROW, _score(a1, b0).alias("s0"), _score(a0, b1).alias("s1")).unionByName(alone)
        wide = (F.col("s1") - F.col("s0") > F.lit(width)) & (F.col("r") > 0)
        scored, sums = materialize_observed(
            scored.withColumn("wide", wide), "silhouette-scored", low=F.sum(F.col("s0") * F.col("rows")),
            high=F.sum(F.col("s1") * F.col("rows")), done_low=F.sum(F.when(~F.col("wide"), F.col("s0") * F.col("rows"))),
            done_high=F.sum(F.when(~F.col("wide"), F.col("s1") * F.col("rows"))), open=F.count_if("wide"))
        drop_tables(rows, means)
        enough = (upper + sums["high"] - lower - sums["low"]) / n <= width
        if enough or not sums["open"] or level == FINEST:
            break
        lower, upper = lower + (sums["done_low"] or 0.0), upper + (sums["done_high"] or 0.0)
        by = 2 * (FINEST - level)
        again = scored.where("wide").select("own", F.col("qcx").alias("_qx"), F.col("qcy").alias("_qy"))
        of = of.withColumns({"_qx": F.shiftright("cx", by), "_qy": F.shiftright("cy", by)}) \
            .join(again, ["own", "_qx", "_qy"], "left_semi").drop("_qx", "_qy")
        level += 1
    slack = 1e-9
    drop_tables(pos, fine, labels)
    return result((lower + sums["low"]) / n - slack, (upper + sums["high"]) / n + slack)


def silhouette_score(df: DataFrame, digits: int = 2, x: str = "Latitude", y: str = "Longitude",
                     label: str = "Cluster") -> DataFrame:
    """The mean Euclidean silhouette rounded to ``digits``, from bounds that round alike: ``silhouette, n``."""
    width = 10.0 ** -digits
    while True:
        b = silhouette_bounds(df, width, x, y, label).first()
        if b["lower"] is None or round(b["lower"], digits) == round(b["upper"], digits) or width < 1e-7:
            value = None if b["lower"] is None else round((b["lower"] + b["upper"]) / 2, digits) + 0.0
            return df.sparkSession.createDataFrame([(value, b["n"])], "silhouette double, n long")
        width /= 8
