"""Spatial operators: within-distance join (J3), DBSCAN (Z1), nearest label (J1),
squared silhouette (Z3).

Distances are planar Euclidean on two columns, compared as
``dx*dx + dy*dy <= eps*eps`` everywhere (one formula, so ties behave the same in
every step).  Joins are equi-joins on cells of grids, decided by bounding boxes where
possible; what a box can't decide is split into finer cells and decided again
(:mod:`faultline.operators.boxes`).  Rows with equal coordinates are first collapsed into
one weighted position, so no join ever sees a repeated coordinate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.constants import DBSCAN_EPS, DBSCAN_MIN_SAMPLES
from faultline.operators import boxes as B
from faultline.operators.boxes import d2 as _d2
from faultline.operators.components import connected_components
from faultline.operators.tiles import sums_by_tile
from faultline.session import drop_tables, materialize, materialize_observed

_OFF = 1 << 30
_MUL = 1 << 31
#: A box of at most so many positions is compared position by position, not split; so is a
#: pair of boxes of at most so many pairs of positions.
LEAF, PAIR_LEAF = 32, 1 << 16
#: Splits after which cells of doubles can't get finer.
MAX_SPLITS = 48
#: Tables of at most so many boxes are broadcast.
BROADCAST_BOXES = 1 << 14


def _node(cx: Column, cy: Column) -> Column:
    # one BIGINT per grid cell (cell indices stay far below 2^30 in magnitude)
    return (cx + F.lit(_OFF)) * F.lit(_MUL) + (cy + F.lit(_OFF))


def positions(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Distinct finite coordinates with their row count ``w`` and smallest key ``kmin``."""
    return (df.where((F.abs(F.col(x)) < F.lit(math.inf)) & (F.abs(F.col(y)) < F.lit(math.inf)))
            .groupBy(F.col(x).alias("px"), F.col(y).alias("py"))
            .agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("kmin")))


def _attach(df: DataFrame, per_pos: DataFrame, x: str, y: str) -> DataFrame:
    """Join per-position results back to the rows on the exact coordinates.

    Broadcast or shuffled as the written table's size says; in a shuffle AQE splits
    the rows of a coordinate that many share."""
    return df.join(per_pos, (df[x] == per_pos["px"]) & (df[y] == per_pos["py"]), "left").drop("px", "py")


def _merge_within(probe: DataFrame, pos: DataFrame, eps: float, side: float, r: int, merge) -> DataFrame:
    """``(px, py, val)``: ``merge`` (``F.sum`` or ``F.min``) of ``val`` over the positions
    within ``eps`` of each probe that has one.

    ``probe`` holds ``px, py``, ``pos`` holds ``px, py, val``; cells of side ``side`` within
    ``r`` cells of a probe's own cover the circle.  A box wholly within ``eps`` gives its
    merged value, one beyond it nothing.  What the circle cuts is compared position by
    position if it holds at most ``LEAF`` of them, else its four quarters are met in the
    next round, so a dense cell costs what lies along the circle's edge."""
    eps2 = F.lit(eps * eps)
    here = [F.col("px"), F.col("py")]

    def cells(level: int) -> DataFrame:
        return pos.groupBy(B.cell(F.col("px"), side, level).alias("cx"), B.cell(F.col("py"), side, level).alias("cy")) \
            .agg(merge("val").alias("val"), F.count(F.lit(1)).alias("n"), *B.bounds())

    boxes, seen = materialize_observed(cells(0), "within-boxes", most=F.max("n"))
    met = B.around(probe.select("px", "py", B.cell(F.col("px"), side).alias("cx"), B.cell(F.col("py"), side).alias("cy")),
                   r).join(boxes, ["cx", "cy"])
    parts, level, dense = [], 0, (seen["most"] or 0) > LEAF
    while True:
        met = met.where(B.near2(*here) <= eps2).withColumn("whole", B.far2(*here) <= eps2)
        parts.append(met.where("whole").select("px", "py", "val"))
        cut = met.where("NOT whole")
        fine = level >= MAX_SPLITS
        few = cut if fine else cut.where(F.col("n") <= LEAF)
        other = pos.select(B.cell(F.col("px"), side, level).alias("cx"), B.cell(F.col("py"), side, level).alias("cy"),
                           F.col("px").alias("qx"), F.col("py").alias("qy"), "val")
        parts.append(few.select("px", "py", "cx", "cy").join(other, ["cx", "cy"])
                     .where(_d2(*here, F.col("qx"), F.col("qy")) <= eps2).select("px", "py", "val"))
        if not dense or fine:
            break
        many, seen = materialize_observed(cut.where(F.col("n") > LEAF).select(
            "px", "py", F.col("cx").alias("ux"), F.col("cy").alias("uy")), "within-cut", n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        level += 1
        quarters = cells(level).withColumns({"ux": F.shiftright("cx", 1), "uy": F.shiftright("cy", 1)})
        met = many.join(quarters, ["ux", "uy"]).drop("ux", "uy")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("px", "py").agg(merge("val").alias("val"))


def within_distance_between(a: DataFrame, b: DataFrame, x: str = "Latitude", y: str = "Longitude",
                            eps: float = DBSCAN_EPS, key: str = "quake_id", name: str = "n_within") -> DataFrame:
    """Per row of ``a``, the number of rows of ``b`` within ``eps`` (J3): ``key, n_within``.

    0 where there is none; NULL for a row without finite coordinates.  Rows of ``b``
    without finite coordinates are near nothing.  Positions are compared in tiles of the
    plane (:func:`sums_by_tile`); those too dense for a tile meet by boxes (:func:`_merge_within`)."""
    pos = materialize(positions(b, x, y, key).select("px", "py", F.col("w").alias("val")), "within-pos")
    probe = pos if a is b else materialize(positions(a, x, y, key).select("px", "py"), "within-probes")
    sums, dense = sums_by_tile(probe, pos, eps)
    counts, _ = materialize_observed(sums, "within-cut", keep=["px", "py", "val"], n=F.sum("cut"))
    if dense is not None:
        counts = counts.unionByName(materialize(_merge_within(dense, pos, eps, eps / 4, 4, F.sum), "within-counts"))
    drop_tables(pos, probe)
    found = _attach(a.select(key, x, y), counts, x, y)
    finite = (F.abs(F.col(x)) < F.lit(math.inf)) & (F.abs(F.col(y)) < F.lit(math.inf))
    return found.select(key, F.when(finite, F.coalesce("val", F.lit(0))).cast("bigint").alias(name))


def within_distance_counts(df: DataFrame, x: str = "Latitude", y: str = "Longitude", eps: float = DBSCAN_EPS,
                           key: str = "quake_id") -> DataFrame:
    """Per row, the number of rows within ``eps`` (itself included)."""
    return within_distance_between(df, df, x, y, eps, key)


def number_in_order(df: DataFrame, by: str, name: str) -> DataFrame:
    """``name``: 0, 1, 2, ... by ``by`` ascending, without sorting in one task: ranges are
    numbered each by itself, then shifted by the rows of the ranges before."""
    placed = materialize(
        df.repartitionByRange(by).sortWithinPartitions(by)
        .withColumns({"_range": F.spark_partition_id(),
                      "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(sizes, "_range").withColumn(name, F.col("_before") + F.col("_at")) \
        .drop("_range", "_at", "_before")


# ---------------------------------------------------------------------------
# DBSCAN
# ---------------------------------------------------------------------------

def _linked_pairs(pairs: DataFrame, core: DataFrame, side: float, eps: float) -> DataFrame | None:
    """The cell pairs ``(u, v)`` that have core positions within ``eps`` of each other; None if there are none.

    ``pairs``: ``u, v`` and both cells' numbers ``a_cx, a_cy, b_cx, b_cy``, boxes ``a_x0 ...
    b_y1`` and counts ``a_n, b_n``.  Both boxes of a pair are split together: quarters
    farther apart than ``eps`` go, quarters wholly within it (or whose corner positions are)
    link their pair, which then ends, and pairs of few positions are compared one by one,
    each side with only the positions that lie within ``eps`` of the other's box."""
    eps2 = F.lit(eps * eps)
    cols = ["cx", "cy", *B.BOUNDS, "n"]
    both = [f"{s}_{c}" for s in "ab" for c in cols]
    product = F.col("a_n").cast("double") * F.col("b_n")
    todo, level, linked = pairs.select("u", "v", *both), 0, []
    while True:
        few, open_ = materialize_observed(
            todo.withColumn("few", (product <= PAIR_LEAF) | F.lit(level >= MAX_SPLITS)), "dbscan-open",
            few=F.count_if("few"), many=F.count_if(~F.col("few")), compared=F.sum(F.when(F.col("few"), product)))
        if open_["few"]:
            at = core.select(B.cell(F.col("px"), side, level).alias("cx"), B.cell(F.col("py"), side, level).alias("cy"),
                             "px", "py")

            def facing(own: str, other: str, names: list[str], few=few, at=at) -> DataFrame:
                """Positions of one box of each pair that are within eps of the other."""
                p = few.where("few").withColumns({"cx": F.col(f"{own}_cx"), "cy": F.col(f"{own}_cy")})
                return p.join(at, ["cx", "cy"]).where(B.near2(F.col("px"), F.col("py"), f"{other}_") <= eps2).select(
                    "u", "v", *[F.col(f"{s}_{c}") for s in "ab" for c in ("cx", "cy")],
                    F.col("px").alias(names[0]), F.col("py").alias(names[1]))

            left, right = facing("a", "b", ["px", "py"]), facing("b", "a", ["qx", "qy"])
            same = [left[c] == right[c] for c in ("u", "v", "a_cx", "a_cy", "b_cx", "b_cy")]
            near = _d2(left["px"], left["py"], right["qx"], right["qy"]) <= eps2
            hit = same[0]
            for c in [*same[1:], near]:
                hit = hit & c
            linked.append(left.join(right, hit, "left_semi").select("u", "v"))
        if not open_["many"]:
            break
        level += 1
        quarters = core.groupBy(B.cell(F.col("px"), side, level).alias("cx"), B.cell(F.col("py"), side, level).alias("cy")) \
            .agg(*B.bounds(), F.count(F.lit(1)).alias("n"), F.min(F.struct("px", "py")).alias("at"))
        split = few.where("NOT few").select("u", "v", *[F.col(f"{s}_{c}").alias(f"{s}u{c[1]}")
                                                        for s in "ab" for c in ("cx", "cy")])
        for s in "ab":
            q = quarters.select(*[F.col(c).alias(f"{s}_{c}") for c in [*cols, "at"]],
                                F.shiftright("cx", 1).alias(f"{s}ux"), F.shiftright("cy", 1).alias(f"{s}uy"))
            split = split.join(q, [f"{s}ux", f"{s}uy"])
        sure = (B.span2("a_", "b_") <= eps2) | (
            _d2(F.col("a_at.px"), F.col("a_at.py"), F.col("b_at.px"), F.col("b_at.py")) <= eps2)
        split, found = materialize_observed(
            split.where(B.gap2("a_", "b_") <= eps2).select("u", "v", *both, sure.alias("sure")), "dbscan-split",
            sure=F.count_if("sure"))
        todo = split.where("NOT sure").drop("sure")
        if found["sure"]:
            done = materialize(split.where("sure").select("u", "v").distinct(), "dbscan-sure")
            linked.append(done)
            todo = todo.join(done, ["u", "v"], "left_anti")
    if not linked:
        return None
    out = linked[0]
    for d in linked[1:]:
        out = out.unionByName(d)
    return out.distinct()


def dbscan(df: DataFrame, key: str = "quake_id", x: str = "Latitude", y: str = "Longitude",
           eps: float = DBSCAN_EPS, min_samples: int = DBSCAN_MIN_SAMPLES, label: str = "Cluster") -> DataFrame:
    """DBSCAN labels for every row: zones 0..k-1, noise -1.

    Semantics: a row is core when at least ``min_samples`` rows (itself included)
    lie within ``eps``; zones are the connected groups of core rows; a non-core
    row within ``eps`` of a core row joins the lowest-numbered such zone; zones
    are numbered by their smallest core key.  This is the result of the
    classic sequential scan in key order, computed without any order.

    Plan: positions on a grid of side ``eps / (2 sqrt 2)`` (a cell's diagonal is
    eps/2, so a cell holding ``min_samples`` rows is core throughout and needs no
    join); sparse positions count neighbours by :func:`_merge_within`; the cell graph of
    core cells is decided by bounding boxes where possible, components of the sure edges
    are found first, and only undecided cell pairs that still cross components are split
    and tested (:func:`_linked_pairs`).
    """
    eps2 = F.lit(eps * eps)
    side = eps / (2 * math.sqrt(2))
    r = math.ceil(eps / side)

    pos = materialize(positions(df, x, y, key).withColumns(
        {"cx": B.cell(F.col("px"), side), "cy": B.cell(F.col("py"), side)}), "dbscan-positions")
    weighed = pos.join(pos.groupBy("cx", "cy").agg(F.sum("w").alias("cw")), ["cx", "cy"])

    # Neighbour counts of positions in sparse cells.
    nb_count = _merge_within(weighed.where(F.col("cw") < F.lit(min_samples)),
                             pos.select("px", "py", F.col("w").alias("val")), eps, side, r, F.sum)
    dense = (F.col("cw") >= F.lit(min_samples)) | (F.coalesce("val", F.lit(0)) >= F.lit(min_samples))
    marked = materialize(weighed.join(nb_count, ["px", "py"], "left").select(
        "px", "py", "kmin", "cx", "cy", _node(F.col("cx"), F.col("cy")).alias("node"), dense.alias("core")), "dbscan-core")
    core = marked.where("core")

    # Core cells with the bounding box of their core positions.
    cells = materialize(core.groupBy("node", "cx", "cy").agg(
        *B.bounds(), F.count(F.lit(1)).alias("n"), F.min("kmin").alias("kmin")), "dbscan-core-cells")
    met = ["cx", "cy", *B.BOUNDS, "n"]
    a = B.around(cells.select(F.col("node").alias("u"), *[F.col(c).alias("a_" + c) for c in met],
                              F.col("cx").alias("b_cx"), F.col("cy").alias("b_cy")), r, "b_cx", "b_cy")
    b = cells.select(F.col("node").alias("v"), *[F.col(c).alias("b_" + c) for c in met])
    pairs = a.join(b, ["b_cx", "b_cy"]).where("u < v").where(B.gap2("a_", "b_") <= eps2)
    pairs, seen = materialize_observed(pairs.withColumn("sure", B.span2("a_", "b_") <= eps2), "dbscan-pairs",
                                       open=F.count_if(~F.col("sure")))
    zone_of = connected_components(pairs.where("sure").select("u", "v"), local=True)

    # Undecided pairs whose cells are not yet in one component: split and test.
    if seen["open"]:
        crossing = pairs.where("NOT sure") \
            .join(zone_of.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left") \
            .join(zone_of.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left") \
            .where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).drop("cu", "cv", "sure")
        linked = _linked_pairs(crossing, core, side, eps)
        if linked is not None:
            stars = zone_of.select(F.col("node").alias("u"), F.col("component").alias("v"))
            zone_of = connected_components(stars.unionByName(linked), local=True)

    # Zone numbers: components in the order of their smallest core key.
    comp = cells.join(zone_of, "node", "left").select("node", "kmin", F.coalesce("component", "node").alias("comp"))
    zones = number_in_order(comp.groupBy("comp").agg(F.min("kmin").alias("ck")), "ck", "zone")
    cell_zone = materialize(comp.join(zones, "comp").select("node", F.col("zone").cast("int").alias("zone")),
                            "dbscan-zones")

    zoned = core.join(cell_zone, "node").select("px", "py", F.col("zone").alias("val"))
    # Border positions: the lowest zone among core positions within eps; without one they are noise.
    noncore = marked.where(~F.col("core")).select("px", "py")
    border = _merge_within(noncore, zoned, eps, side, r, F.min)
    rest = noncore.join(border, ["px", "py"], "left").select("px", "py", F.coalesce("val", F.lit(-1)).alias(label))
    pos_label = materialize(zoned.select("px", "py", F.col("val").alias(label)).unionByName(rest), "dbscan-labels")
    drop_tables(pos, marked, cells, pairs, cell_zone)
    return _attach(df, pos_label, x, y)


# ---------------------------------------------------------------------------
# Nearest sites
# ---------------------------------------------------------------------------

def site_grid(sites: DataFrame, per_cell: float) -> tuple[float, float, float, int]:
    """Side of the cells, the first cell's numbers, and the number of halvings by four that
    put all cells into one.

    The sites' own cells hold about ``per_cell`` sites where a typical site lives."""
    st = sites.agg(F.count(F.lit(1)).alias("n"), F.min("sx").alias("x0"), F.max("sx").alias("x1"),
                   F.min("sy").alias("y0"), F.max("sy").alias("y1")).first()
    wide, high = st["x1"] - st["x0"], st["y1"] - st["y0"]
    # on a line the cells follow its length; a single place takes any side
    side = math.sqrt(wide * high * per_cell / st["n"]) or max(wide, high) * per_cell / st["n"] or 1.0
    # Shrink the cells to the dense parts; sparse queries go down the pyramid.
    occ = sites.groupBy(B.cell(F.col("sx"), side).alias("cx"), B.cell(F.col("sy"), side).alias("cy")) \
        .agg(F.count(F.lit(1)).alias("c")).agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("p")).first()["p"]
    if occ > per_cell:
        side *= math.sqrt(per_cell / occ)
    # cell numbers must stay below 2^31
    reach = max(abs(v) for v in (st["x0"], st["x1"], st["y0"], st["y1"]))
    side = max(side, reach / (1 << 30), 1e-12)
    first = [math.floor(st[c] / side) for c in ("x0", "y0")]
    last = max(math.floor(st["x1"] / side) - first[0], math.floor(st["y1"] / side) - first[1])
    return side, *first, -(-last.bit_length() // 2)


def meet_sites(todo: DataFrame, keys: list[str], at: DataFrame, top: int, other_than: bool,
               improve: bool = True) -> DataFrame:
    """Rows ``(*keys, best, sx, sy, extra, rank, pay)`` of each query with the sites it must be compared with.

    Branch and bound on a pyramid of boxes, each level's cells four by four of the next:
    every box has a site of its own, whose cost bounds the best from above, and its nearest
    place bounds its sites' costs from below.  A query goes down only into boxes whose lower
    bound is at most its best cost so far; without ``improve`` that cost stays as given."""
    leaf, seen = materialize_observed(at.groupBy("cx", "cy").agg(
        *B.bounds("sx", "sy"), F.min("extra").alias("e0"),
        F.min(F.struct("pay", "rank", "sx", "sy", "extra")).alias("lo"),
        F.max(F.struct("pay", "rank", "sx", "sy", "extra")).alias("hi")), "nearest-boxes", n=F.count(F.lit(1)))
    here = [F.col("qx"), F.col("qy")]
    may_win = F.col("best").isNull() | (B.near2(*here) + F.col("e0") <= F.col("best.cost"))
    mine = F.lit(False)
    rep = F.col("lo")
    if other_than:
        mine = F.col("lo.pay").eqNullSafe(F.col("own"))
        rep = F.when(mine, F.col("hi")).otherwise(F.col("lo"))
        mine = mine & F.col("hi.pay").eqNullSafe(F.col("own"))
    cost = F.struct((_d2(*here, F.col("rep.sx"), F.col("rep.sy")) + F.col("rep.extra")).alias("cost"),
                    F.col("rep.rank").alias("rank"), F.col("rep.pay").alias("pay"))
    todo = todo.withColumns({"ux": F.lit(0).cast("long"), "uy": F.lit(0).cast("long")})
    for level in range(top - 1, -1, -1):
        by = 2 * level
        boxes = leaf.groupBy(F.shiftright("cx", by).alias("cx"), F.shiftright("cy", by).alias("cy")).agg(
            *B.merged_bounds(), F.min("e0").alias("e0"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
            if level else leaf
        boxes = boxes.withColumns({"ux": F.shiftright("cx", 2), "uy": F.shiftright("cy", 2)})
        if min(seen["n"], (1 << 2 * (top - level)) ** 2) <= BROADCAST_BOXES:
            boxes = F.broadcast(boxes)
        todo = todo.join(boxes, ["ux", "uy"]).where(may_win & ~mine).withColumn("rep", rep)
        if improve:
            best = F.least(F.col("best"), F.min(cost).over(Window.partitionBy(*keys)))
            todo = todo.withColumn("best", best).where(may_win)
        todo = todo \
            .select(*keys, "best", F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    return todo.join(at.withColumnsRenamed({"cx": "ux", "cy": "uy"}), ["ux", "uy"]).drop("ux", "uy")


def nearest_site(queries: DataFrame, sites: DataFrame, other_than: bool = False, per_cell: float = 4.0) -> DataFrame:
    """For each query ``(qx, qy[, own])`` the best site ``(sx, sy, extra, rank, pay)``: that of the
    smallest ``(distance^2 + extra, rank)``, as a struct ``best`` of ``(cost, rank, pay)``.

    With ``other_than`` sites whose ``pay`` equals the query's ``own`` don't count.  First
    every query meets the sites of the 3 x 3 cells around its own: a site outside them is
    farther than a cell's side, so a best cost of at most its square is final.  The other
    queries go down a pyramid of boxes (:func:`meet_sites`) with what they have found.
    Both tables hold distinct places, so a repeated coordinate costs nothing extra.
    Queries must be able to meet some site."""
    side, first_x, first_y, top = site_grid(sites, per_cell)

    def cells(x: str, y: str) -> dict[str, Column]:
        return {"cx": B.cell(F.col(x), side) - F.lit(first_x), "cy": B.cell(F.col(y), side) - F.lit(first_y)}

    keys = queries.columns
    at = sites.withColumns(cells("sx", "sy"))
    usable = F.col("sx").isNotNull()
    if other_than:
        usable = usable & ~F.col("pay").eqNullSafe(F.col("own"))
    cost = F.when(usable, F.struct((_d2(F.col("qx"), F.col("qy"), F.col("sx"), F.col("sy")) + F.col("extra")).alias("cost"),
                                   "rank", "pay"))
    home = queries.withColumns(cells("qx", "qy")).join(B.around(at, 1), ["cx", "cy"], "left") \
        .groupBy(*keys).agg(F.min(cost).alias("best"))
    done = F.coalesce(F.col("best.cost") <= F.lit(side * side), F.lit(False))
    home, m = materialize_observed(home.withColumn("ok", done), "nearest-home", open=F.count_if(~F.col("ok")))
    found = home.where("ok").drop("ok")
    if not m["open"]:
        return found
    met = meet_sites(home.where("NOT ok").drop("ok"), keys, at, top, other_than)
    return found.unionByName(met.groupBy(*keys).agg(F.min(F.least(F.col("best"), cost)).alias("best")))


def nearest_label(points: DataFrame, labelled: DataFrame, key: str = "quake_id", x: str = "Latitude",
                  y: str = "Longitude", label: str = "Cluster", per_cell: float = 4.0) -> DataFrame:
    """Each point takes the label of its nearest labelled point; ties by smaller key.

    Both sides are collapsed to distinct positions (a labelled one keeps the label of its
    smallest key), joined by :func:`nearest_site`, and the labels are joined back to the
    rows.  Points without finite coordinates, and all points if nothing is labelled, get NULL."""
    def finite(df: DataFrame) -> DataFrame:
        return df.where((F.abs(F.col(x)) < F.lit(math.inf)) & (F.abs(F.col(y)) < F.lit(math.inf)))

    sites = finite(labelled).groupBy(F.col(x).alias("sx"), F.col(y).alias("sy")) \
        .agg(F.min(F.struct(F.col(key).alias("rank"), F.col(label).alias("pay"))).alias("m")) \
        .select("sx", "sy", F.lit(0.0).alias("extra"), "m.rank", "m.pay")
    sites, m = materialize_observed(sites, "nearest-sites", n=F.count(F.lit(1)))
    if m["n"] == 0:
        return points.withColumn(label, F.lit(None).cast(labelled.schema[label].dataType))
    queries = finite(points).select(F.col(x).alias("qx"), F.col(y).alias("qy")).distinct()
    best = nearest_site(materialize(queries, "nearest-queries"), sites, per_cell=per_cell)
    best = best.select(F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("best.pay").alias(label))
    return _attach(points, best, x, y)


# ---------------------------------------------------------------------------
# Squared silhouette
# ---------------------------------------------------------------------------

def silhouette_squared(df: DataFrame, x: str = "Latitude", y: str = "Longitude",
                       label: str = "Cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distances, on all rows, every label (noise too)
    a cluster (Z3).

    The mean squared distance from p to a label is ``|p - c|^2 + v`` with the label's
    centre ``c`` and mean squared distance ``v`` to it, so the nearest other label is the
    nearest site of that cost: a grid search over the centres, not a table of rows x labels.
    Each distinct (position, label) is scored once with its weight.  Coordinates are centred
    on the global mean first to keep the cancellation small.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pos = materialize(df.groupBy(F.col(x).alias("x"), F.col(y).alias("y"), F.col(label).cast("long").alias("own"))
                      .agg(F.count(F.lit(1)).alias("w")), "silhouette-positions")
    w = F.col("w")
    mean = pos.agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("y") * w) / F.sum(w)).alias("y")).first()
    c = pos.select((F.col("x") - F.lit(mean["x"])).alias("qx"), (F.col("y") - F.lit(mean["y"])).alias("qy"), "own", "w")
    nrm = F.col("qx") * F.col("qx") + F.col("qy") * F.col("qy")
    stats = c.groupBy("own").agg(
        F.sum(w).alias("n"), (F.sum(F.col("qx") * w) / F.sum(w)).alias("sx"),
        (F.sum(F.col("qy") * w) / F.sum(w)).alias("sy"), (F.sum(nrm * w) / F.sum(w)).alias("q"))
    stats = stats.withColumn("extra", F.greatest(F.lit(0.0), F.col("q") - F.col("sx") * F.col("sx")
                                                 - F.col("sy") * F.col("sy")))
    stats, m = materialize_observed(stats, "silhouette-labels", n=F.count(F.lit(1)))
    if m["n"] < 2:  # no other label: every row scores 0
        return c.agg(F.when(F.sum(w) > 0, F.lit(0.0)).alias("silhouette_squared"),
                     F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("n"))
    sites = stats.select("sx", "sy", "extra", F.col("own").alias("rank"), F.col("own").alias("pay"))
    best = nearest_site(c, sites, other_than=True)
    own = _d2(F.col("qx"), F.col("qy"), F.col("sx"), F.col("sy")) + F.col("extra")
    scored = best.join(stats, "own").select("w", F.col("best.cost").alias("b"), F.when(
        F.col("n") > 1, own * F.col("n") / (F.col("n") - 1)).alias("a"))
    s = F.when(F.col("a").isNull() | (F.greatest("a", "b") <= 0), F.lit(0.0)) \
        .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return scored.agg((F.sum(s * w) / F.sum(w)).alias("silhouette_squared"), F.sum(w).cast("bigint").alias("n"))
