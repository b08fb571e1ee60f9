"""Feature preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.constants import FEATURE_COLUMNS, REGIONS
from faultline.operators.aggregates import impute_mean


#: Most values of a categorical column that one-hot encoding looks up by itself.
MAX_CATEGORIES = 1000


def category_values(df: DataFrame, col: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-NULL values of a categorical column; more than ``limit`` is an error,
    as each becomes a column."""
    values = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()]
    if len(values) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values")
    return sorted(values)


def one_hot(df: DataFrame, col: str, prefix: str | None = None, values: list | None = None,
            drop: bool = True) -> DataFrame:
    """0/1 column ``<prefix>_<value>`` per value, in sorted value order; NULL gives all 0 (M1)."""
    prefix = prefix or col
    values = values if values is not None else category_values(df, col)
    out = df.withColumns({f"{prefix}_{v}": F.col(col).eqNullSafe(F.lit(v)).cast("int") for v in values})
    return out.drop(col) if drop else out


def feature_columns(df: DataFrame, wanted: list[str] = FEATURE_COLUMNS,
                    expand: dict[str, str] | None = None) -> list[str]:
    """Feature names present in ``df``; a wanted categorical expands to its one-hot columns (X11).

    ``expand`` maps a wanted name to the prefix of its one-hot columns.
    """
    expand = expand if expand is not None else {"Region": "Region_"}
    names: list[str] = []
    for w in wanted:
        if w in expand:
            names.extend(c for c in df.columns if c.startswith(expand[w]))
        elif w in df.columns:
            names.append(w)
    return names


def feature_table(clean: DataFrame, key: str = "quake_id", label: str = "is_significant",
                  regions: list | None = REGIONS) -> tuple[DataFrame, list[str]]:
    """Key, label and features as DOUBLE with mean-imputed gaps.

    ``regions``: the values that get a column; None looks them up in the data."""
    encoded = one_hot(clean, "Region", "Region", regions, drop=False)
    names = feature_columns(encoded)
    table = impute_mean(encoded.select(key, label, *names), names)
    return table, names


def class_weight(train: DataFrame, label: str = "is_significant", weight: str = "weight") -> DataFrame:
    """Weight ``negatives / positives`` on positive rows and 1.0 elsewhere (M3).

    The ratio is a scalar subquery over the class counts: no join, no driver trip.
    """
    ratio = train.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("r")).scalar()
    return train.withColumn(weight, F.when(F.col(label) == 1, ratio).otherwise(F.lit(1.0)))
