"""Column expressions: coercion, flags, keyword classification, bands, rounding.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation; none of them needs a Python worker.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A decimal number with optional sign, fraction and exponent, surrounded by
# optional white space; or an infinity.  Text that Spark's cast would still
# accept (Java suffixes such as ``5d``) is rejected by this guard.
NUMBER_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_timestamp_or_null(c, formats: list[str]) -> Column:
    """Text to a naive timestamp; text matching none of ``formats`` gives NULL."""
    c = _col(c)
    parsed = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    ts = parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)
    return ts.cast("timestamp_ntz")


def text_to_double_or_null(c) -> Column:
    """Text to DOUBLE; anything that is not a plain number becomes NULL, NaN too."""
    t = F.trim(_col(c))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def nan_to_null(c) -> Column:
    """NaN to NULL with a single reference to the input (no duplicated sub-expression)."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def threshold_flag(c, threshold: float) -> Column:
    """1 where ``c >= threshold``, else 0 (X1); NULL stays NULL."""
    return (_col(c) >= F.lit(threshold)).cast("int")


def classify_by_keywords(c, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """First-match-wins classification by substring keywords.

    ``groups`` is an ordered list of (label, keywords); a row takes the label of
    the first group with a keyword contained in the lower-cased text.  NULL and
    rows without a match take ``default``.
    """
    low = F.lower(_col(c))
    expr = None
    for label, words in groups:
        unique = list(dict.fromkeys(w.lower() for w in words))
        cond = reduce(lambda a, b: a | b, [low.contains(w) for w in unique])
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return F.when(low.isNull(), F.lit(default)).otherwise(expr.otherwise(F.lit(default)))


def cut(c, edges: list[float], labels: list[str]) -> Column:
    """Right-closed interval bins ``(edges[i], edges[i+1]] -> labels[i]``; else NULL."""
    c = _col(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (c > F.lit(lo)) & (c <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def round_half_even(c, digits: int = 2) -> Column:
    """``rint(x * 10^d) / 10^d``: the rounding of NumPy and pandas."""
    scale = float(10 ** digits)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def fixed_text(c, digits: int = 2) -> Column:
    """A DOUBLE as text with ``digits`` decimals, rounded from its exact binary value, halves
    to even (X13): 0.125 gives 0.12, 2.675 (which is a little less) 2.67.

    ``x * 10^d`` is split into its rounded product and the exact rest, so a half that only
    comes from the product's rounding is told from a real one.  Up to 6 digits and 10^9."""
    x = F.abs(_col(c))
    scale = F.lit(float(10 ** digits))
    top = x * F.lit(134217729.0)
    high = top - (top - x)
    product = x * scale
    rest = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("long")
    over = (product - whole - F.lit(0.5)) + rest
    n = F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)
    sign = F.when(_col(c) < 0, "-").otherwise("")
    base = 10 ** digits
    return F.concat(sign, F.floor(n / F.lit(base)).cast("string"), F.lit("."),
                    F.lpad((n % base).cast("string"), digits, "0"))


def md5_order(key, seed: int) -> Column:
    """Repeatable pseudo-random order key: ``md5('<key>-<seed>')``."""
    return F.md5(F.concat_ws("-", _col(key).cast("string"), F.lit(str(seed))))
