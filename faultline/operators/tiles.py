"""Sums over the places within a distance, tile by tile of the plane.

A tile is a square several times as wide as the distance; it gets its own places and those
within the distance of it, so that a place is sent a few times (2.25 on a tile of side
``4 eps``), not once for every box that its circle meets.  Inside a tile places are cut into
strips along x: a strip's sums give what the circle surely holds, and only what lies along
the circle's edge is compared place by place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators import boxes as B
from faultline.session import materialize

#: Side of a tile, in distances.
WIDE = 4
#: Most places that a tile may hold with those around it; tiles of more are cut into quarters.
MOST = 1 << 20
#: Cuts into quarters; on tiles of half a distance a place is sent 25 times.
CUTS = 3
#: Probes of a strip, and places on edges, that are compared at once.
_PROBES, _SLICE = 1 << 16, 1 << 18
#: So many pairs of a tile are compared all.
_FEW = 1 << 16


def _edge_sums(px, py, start, size, qx, qy, val, eps2: float) -> np.ndarray:
    """Per probe the sum of ``val`` over those of its ``size`` places from ``start`` on that are near."""
    out = np.zeros(len(px), np.int64)
    end = np.cumsum(size)
    lo = 0
    while lo < len(px):
        before = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, before + _SLICE, "right")))
        n = size[lo:hi]
        if end[hi - 1] > before:
            stop = np.cumsum(n)
            at = np.arange(stop[-1]) + np.repeat(start[lo:hi] - (stop - n), n)
            dx, dy = np.repeat(px[lo:hi], n) - qx[at], np.repeat(py[lo:hi], n) - qy[at]
            upto = np.concatenate(([0], np.cumsum(np.where(dx * dx + dy * dy <= eps2, val[at], 0))))
            out[lo:hi] = upto[stop] - upto[stop - n]
        lo = hi
    return out


def near_sums(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, val: np.ndarray,
              eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Per probe ``(px, py)`` the sum of ``val`` over the places ``(qx, qy)`` within ``eps``, and
    how many places were compared one by one for it.

    Strips hold equally many places, however dense they lie, so both the strips that a
    circle meets and the places that its edge cuts grow with the root of the places.  What a
    strip's sums decide keeps clear of the edge by far more than rounding; all else is
    decided by the distance's own formula."""
    eps2, m, n = eps * eps, len(px), len(qx)
    if m * n <= _FEW:
        dx, dy = px[:, None] - qx, py[:, None] - qy
        return np.where(dx * dx + dy * dy <= eps2, val, 0).sum(1), np.full(m, n, np.int64)
    each = int(np.sqrt(2 * n)) + 1
    order = np.argsort(qy, kind="stable")
    strip = np.empty(n, np.int64)
    strip[order] = np.arange(n) // each
    order = np.lexsort((qx, strip))
    qx, qy, val = qx[order], qy[order], val[order]
    total = np.concatenate(([0], np.cumsum(val)))
    first = np.arange(0, n, each)
    low, high = np.minimum.reduceat(qy, first), np.maximum.reduceat(qy, first)
    by_y = np.argsort(py, kind="stable")
    px, py = px[by_y], py[by_y]
    # the bounds of a place plus or minus a length are rounded by at most this
    slack = 4 * np.finfo(float).eps * (max(np.abs(px).max(), np.abs(qx).max()) + eps)
    far = eps * (1 + 1e-9)
    sums, cut = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for a, y0, y1 in zip(first, low, high):
        xs = qx[a:a + each]
        lo, hi = np.searchsorted(py, y0 - far, "left"), np.searchsorted(py, y1 + far, "right")
        for s in range(lo, hi, _PROBES):
            own = slice(s, min(s + _PROBES, hi))
            x, y = px[own], py[own]
            least = np.maximum(np.maximum(y0 - y, y - y1), 0)
            most = np.maximum(y1 - y, y - y0)
            outer = np.sqrt(np.maximum(eps2 * (1 + 1e-12) - least * least, 0)) * (1 + 1e-12) + slack
            inner = np.sqrt(np.maximum(eps2 * (1 - 1e-12) - most * most, 0)) * (1 - 1e-12) - slack
            left, right = a + np.searchsorted(xs, x - outer, "left"), a + np.searchsorted(xs, x + outer, "right")
            sure = inner > 0
            from_ = np.where(sure, a + np.searchsorted(xs, x - inner, "left"), right)
            to = np.where(sure, a + np.searchsorted(xs, x + inner, "right"), right)
            sums[own] += total[to] - total[from_] \
                + _edge_sums(x, y, left, from_ - left, qx, qy, val, eps2) + _edge_sums(x, y, to, right - to, qx, qy, val, eps2)
            cut[own] += from_ - left + right - to
    out, compared = np.empty(m, np.int64), np.empty(m, np.int64)
    out[by_y], compared[by_y] = sums, cut
    return out, compared


def _reach(c: str, side: Column, eps: float) -> list[Column]:
    """The first and the last tile along one axis that hold a place within ``eps`` of a coordinate."""
    far = F.lit(eps * (1 + 1e-9))  # more than the exact difference of coordinates whose rounded one is eps
    return [F.floor((F.col(c) - far) / side), F.floor((F.col(c) + far) / side)]


def _around(pos: DataFrame, side: Column, eps: float) -> DataFrame:
    """Each place for all tiles ``tx, ty`` that it may matter to."""
    return pos.withColumn("tx", F.explode(F.sequence(*_reach("px", side, eps)))) \
        .withColumn("ty", F.explode(F.sequence(*_reach("py", side, eps))))


def _levels(pos: DataFrame, eps: float) -> DataFrame | None:
    """``(bx, by, level)``: how often each tile of side ``WIDE * eps`` is cut into quarters so that
    none holds more than ``MOST`` places, NULL for more than ``CUTS`` times; tiles without a place
    near are left out.  None if no tile needs a cut."""
    cells = materialize(pos.groupBy(B.cell(F.col("px"), eps / 2).alias("cx"), B.cell(F.col("py"), eps / 2).alias("cy"))
                        .agg(F.min("px").alias("px"), F.min("py").alias("py"), F.count(F.lit(1)).alias("n")), "within-cells")
    held = _around(cells, F.lit(WIDE * eps), eps).groupBy("tx", "ty").agg(F.sum("n").alias("n"))
    if (held.agg(F.max("n").alias("n")).first()["n"] or 0) <= MOST:
        return None
    cells = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(CUTS))))
    held = _around(cells, F.lit(WIDE * eps) / F.expr("shiftleft(1, level)"), eps).groupBy("level", "tx", "ty") \
        .agg(F.sum("n").alias("n"))
    held = held.groupBy("level", F.expr("shiftright(tx, level)").alias("bx"), F.expr("shiftright(ty, level)").alias("by")) \
        .agg(F.max("n").alias("n"))
    return materialize(held.groupBy("bx", "by").agg(F.min(F.when(F.col("n") <= MOST, F.col("level"))).alias("level")), "within-levels")


def _own(side: Column, names: tuple[str, str]) -> dict[str, Column]:
    return {n: F.floor(F.col(c) / side) for n, c in zip(names, ("px", "py"))}


def sums_by_tile(probe: DataFrame, pos: DataFrame, eps: float) -> tuple[DataFrame, DataFrame | None]:
    """``(px, py, val, cut)``: the sum of ``val`` over the positions within ``eps`` of each probe, and
    how many were compared for it; and the probes that lie too dense for tiles, None if there are none.

    ``probe`` holds ``px, py``, ``pos`` holds ``px, py, val``, both distinct; they may be one table."""
    base = F.lit(WIDE * eps)
    levels = _levels(pos, eps)

    def known(df: DataFrame) -> DataFrame:
        return df.withColumn("level", F.lit(0)) if levels is None else df.join(levels.where("level IS NOT NULL"), ["bx", "by"])

    side = base / F.expr("shiftleft(1, level)")
    at = _around(pos, base, eps).withColumnsRenamed({"tx": "bx", "ty": "by"})
    if probe is not pos:
        at = at.join(probe.select(*[c.alias(n) for n, c in _own(base, ("bx", "by")).items()]).distinct(), ["bx", "by"], "left_semi")
    sent = known(at)
    for c, n in (("px", "x"), ("py", "y")):
        lo, hi = _reach(c, side, eps)
        start = F.expr(f"shiftleft(b{n}, level)")
        sent = sent.withColumn(f"t{n}", F.explode(F.sequence(
            F.greatest(lo, start), F.least(hi, start + F.expr("shiftleft(1, level) - 1")))))
    own = _own(side, ("tx", "ty"))
    if probe is pos:
        sent = sent.withColumn("mine", (F.col("tx") == own["tx"]) & (F.col("ty") == own["ty"]))
    else:  # a probe adds nothing to any sum
        sent = sent.withColumn("mine", F.lit(False)).unionByName(
            known(probe.withColumns(_own(base, ("bx", "by")))).withColumns({"val": F.lit(0).cast("bigint"), **own, "mine": F.lit(True)}))

    def run(tile):
        import pyarrow as pa
        x, y, val, mine = (tile.column(c).to_numpy() for c in ("px", "py", "val", "mine"))
        px, py = x[mine], y[mine]
        found = near_sums(px, py, x, y, val, eps) if len(px) else (np.zeros(0, np.int64),) * 2
        return pa.table({"px": px, "py": py, "val": found[0], "cut": found[1]})

    out = sent.select("level", "tx", "ty", "px", "py", "val", "mine").groupBy("level", "tx", "ty") \
        .applyInArrow(run, "px double, py double, val bigint, cut bigint")
    if levels is None:
        return out, None
    return out, probe.withColumns(_own(base, ("bx", "by"))).join(levels.where("level IS NULL"), ["bx", "by"]).select("px", "py")
