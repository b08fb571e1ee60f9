"""Cells of square grids and the bounding boxes of what lies in them.

A cell of side ``s`` holds four cells of side ``s / 2``, whose numbers are those of the
coarser one shifted by a bit (halving is exact in floating point, so a position's numbers
agree at all levels).  Bounds of distances use the differences that the distance itself
uses, so rounding never puts a position outside its box's bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = ["x0", "x1", "y0", "y1"]


def cell(c: Column, side: float, level: int = 0) -> Column:
    """Number of the cell of side ``side / 2^level`` that a coordinate lies in."""
    return F.floor(c / F.lit(side / 2 ** level)).cast("long")


def offsets(r: int) -> Column:
    """A row for each of the ``(2r + 1)^2`` cells around one, as steps ``ox, oy``."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("ox"), F.lit(j).alias("oy"))
                              for i in range(-r, r + 1) for j in range(-r, r + 1)]))


def around(df: DataFrame, r: int, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Each row for the cells around its own as well."""
    rest = [c for c in df.columns if c not in (cx, cy)]
    return df.select("*", offsets(r).alias("_o")).select(
        *rest, (F.col(cx) + F.col("_o.ox")).alias(cx), (F.col(cy) + F.col("_o.oy")).alias(cy))


def bounds(x: str = "px", y: str = "py") -> list[Column]:
    """The bounding box as aggregates."""
    return [F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")]


def merged_bounds() -> list[Column]:
    """The bounding box of boxes as aggregates."""
    return [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]


def d2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance."""
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy


def _box(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in BOUNDS]


def near2(x: Column, y: Column, prefix: str = "") -> Column:
    """Squared distance from a place to the nearest place of a box."""
    x0, x1, y0, y1 = _box(prefix)
    return d2(x, y, F.least(F.greatest(x, x0), x1), F.least(F.greatest(y, y0), y1))


def far2(x: Column, y: Column, prefix: str = "") -> Column:
    """Squared distance from a place to the farthest corner of a box."""
    x0, x1, y0, y1 = _box(prefix)
    return d2(x, y, F.when(x - x0 > x1 - x, x0).otherwise(x1), F.when(y - y0 > y1 - y, y0).otherwise(y1))


def gap2(a: str, b: str) -> Column:
    """Least squared distance of any two places of two boxes."""
    ax0, ax1, ay0, ay1 = _box(a)
    bx0, bx1, by0, by1 = _box(b)
    gx = F.greatest(ax0 - bx1, bx0 - ax1, F.lit(0.0))
    gy = F.greatest(ay0 - by1, by0 - ay1, F.lit(0.0))
    return gx * gx + gy * gy


def span2(a: str, b: str) -> Column:
    """Greatest squared distance of any two places of two boxes."""
    ax0, ax1, ay0, ay1 = _box(a)
    bx0, bx1, by0, by1 = _box(b)
    sx = F.greatest(ax1, bx1) - F.least(ax0, bx0)
    sy = F.greatest(ay1, by1) - F.least(ay0, by0)
    return sx * sx + sy * sy
