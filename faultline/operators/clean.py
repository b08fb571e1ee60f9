"""Cleaning (C1-C6) and the derived columns of the clean catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.constants import (
    DEFAULT_CUTOFF, DEFAULT_TIME_FORMATS, DEPTH_EDGES, DEPTH_LABELS, NUMERIC_COLUMNS,
    REGION_DEFAULT, REGION_GROUPS, REQUIRED_COLUMNS, SIGNIFICANT_MAGNITUDE,
)
from faultline.functions.columns import (
    classify_by_keywords, cut, nan_to_null, text_to_double_or_null, threshold_flag,
    to_timestamp_or_null,
)
from faultline.operators.rules import classify_by_rules
from faultline.sources.catalog import null_tokens

COORDINATES = ["Latitude", "Longitude"]
TEXT_COLUMNS = ["Date_Time_PH", "Location", "General_Location"]


def coerce_double(df: DataFrame, name: str):
    """DOUBLE version of a column whatever its stored type."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return text_to_double_or_null(name)
    return nan_to_null(name)


def drop_after(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """Keep rows dated at or before ``cutoff``; NULL times drop."""
    return df.where(F.col(ts) <= F.lit(cutoff).cast("timestamp_ntz"))


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``cols`` (C4)."""
    return df.dropna(subset=cols)


def time_parts(df: DataFrame, ts: str = "Date_Time_PH") -> DataFrame:
    """Hour, day of week (Monday = 0) and month of the event time."""
    return df.withColumns({
        "Hour": F.hour(ts),
        "DayOfWeek": F.weekday(ts),
        "Month": F.month(ts),
    })


def time_layout_vote(raw: DataFrame, col: str, layouts: list[str]) -> DataFrame:
    """``layout, n_parsed, n_only, chosen``, one row per candidate (C1): how many texts of ``col``
    the layout parses, how many no other candidate does, and whether it is the one that
    parses most (ties: the earlier candidate).  All texts are counted in one scan."""
    col_of = {f"p{k}": F.try_to_timestamp(F.col(col), F.lit(x)).isNotNull() for k, x in enumerate(layouts)}
    parsed = null_tokens(raw.select(col), [col]).select([c.alias(n) for n, c in col_of.items()])
    hits = sum((F.col(n).cast("int") for n in col_of), F.lit(0))
    counts = parsed.withColumn("hits", hits).agg(
        *[F.count_if(n).alias(n) for n in col_of], *[F.count_if(F.col(n) & (F.col("hits") == 1)).alias(f"only_{n}") for n in col_of])
    rows = F.array(*[F.struct(F.lit(x).alias("layout"), F.col(f"p{k}").alias("n_parsed"), F.col(f"only_p{k}").alias("n_only"),
                              F.lit(k).alias("k")) for k, x in enumerate(layouts)])
    most = F.greatest(*[F.col(n) for n in col_of], F.lit(0))
    first = F.coalesce(*[F.when(F.col(n) == most, F.lit(k)) for k, n in enumerate(col_of)])
    return counts.select(F.explode(rows).alias("r"), first.alias("first")) \
        .select("r.layout", "r.n_parsed", "r.n_only", (F.col("first") == F.col("r.k")).alias("chosen"))


def best_time_layout(raw: DataFrame, col: str, layouts: list[str]) -> str:
    """The candidate that parses most texts of ``col`` (:func:`time_layout_vote`)."""
    return time_layout_vote(raw, col, layouts).where("chosen").first()["layout"]


def coerce(raw: DataFrame, formats: list[str] = DEFAULT_TIME_FORMATS) -> DataFrame:
    """Typed columns, before any row is dropped."""
    text = [c for c in TEXT_COLUMNS if c in raw.columns
            and isinstance(raw.schema[c].dataType, T.StringType)]
    df = null_tokens(raw, text)
    cols = {"Date_Time_PH": to_timestamp_or_null("Date_Time_PH", formats)}
    for c in NUMERIC_COLUMNS:
        cols[c] = coerce_double(raw, c)
    return df.withColumns(cols)


def place_regions(raw: DataFrame, col: str = "General_Location", region_groups=REGION_GROUPS,
                  default: str = REGION_DEFAULT) -> DataFrame:
    """Region of every distinct place name (X4 applied once per name, not once per row).

    A one-column scan (column pruning) and a distinct aggregate with map-side
    combine: the keyword test, ~140 substring searches, then runs on the few
    distinct names, however many rows repeat them.
    """
    names = null_tokens(raw.select(col), [col]).where(F.col(col).isNotNull()).distinct()
    return classify_by_rules(names, col, region_groups, default)


def add_regions(df: DataFrame, raw: DataFrame, col: str = "General_Location", region_groups=REGION_GROUPS,
                default: str = REGION_DEFAULT) -> DataFrame:
    """Attach ``Region`` by joining the distinct-name table; NULL names take ``default``.

    The join is lazy; Spark broadcasts the name table or shuffles both sides by its size.
    """
    out = df.join(place_regions(raw, col, region_groups, default), col, "left")
    return out.withColumn("Region", F.coalesce(F.col("Region"), F.lit(default)))


def drop_not_finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with an infinite coordinate, which no distance can use."""
    for c in cols:
        df = df.where(F.abs(F.col(c)) < F.lit(float("inf")))
    return df


def clean_catalog(raw: DataFrame, cutoff: str = DEFAULT_CUTOFF,
                  formats: list[str] = DEFAULT_TIME_FORMATS,
                  threshold: float = SIGNIFICANT_MAGNITUDE,
                  region_groups=REGION_GROUPS, depth_bands: bool = True,
                  regions_by_name: bool = True) -> DataFrame:
    """The clean catalogue: coerced, filtered, flagged, classified, with features.

    A narrow plan (scan, project, filter) fused into one code-generated stage;
    with ``regions_by_name`` the region comes from a join with the classified
    distinct names instead of a per-row keyword search.
    """
    df = coerce(raw, formats)
    df = drop_after(df, "Date_Time_PH", cutoff)
    df = drop_not_finite(require(df, REQUIRED_COLUMNS), COORDINATES)
    df = df.withColumn("is_significant", threshold_flag("Magnitude", threshold))
    if regions_by_name:
        cols = df.columns
        df = add_regions(df, raw, "General_Location", region_groups).select(*cols, "Region")
    else:
        df = df.withColumn("Region", classify_by_keywords("General_Location", region_groups, REGION_DEFAULT))
    df = time_parts(df)
    if depth_bands:
        df = df.withColumn("Depth_Category", cut("Depth_In_Km", DEPTH_EDGES, DEPTH_LABELS))
    return df


AUDIT_RULES = [
    "raw_rows", "bad_or_null_time", "after_cutoff", "latitude_null", "longitude_null",
    "magnitude_null", "depth_not_number", "location_null", "coordinate_not_finite", "clean_rows",
]


def cleaning_audit(raw: DataFrame, cutoff: str = DEFAULT_CUTOFF,
                   formats: list[str] = DEFAULT_TIME_FORMATS) -> DataFrame:
    """Rows lost per rule, each rule counted on the raw rows alone.

    One scan, one global aggregate (partial counts per task, a single-row final
    merge), then the row is turned into (rule, n) pairs.
    """
    df = coerce(raw, formats)
    ts = F.col("Date_Time_PH")
    cut_ts = F.lit(cutoff).cast("timestamp_ntz")
    keep = (ts <= cut_ts)
    for c in REQUIRED_COLUMNS:
        keep = keep & F.col(c).isNotNull()
    infinite = F.lit(False)
    for c in COORDINATES:
        infinite = infinite | F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False))
    keep = keep & ~infinite
    agg = df.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(ts.isNull()).alias("bad_or_null_time"),
        F.count_if(ts > cut_ts).alias("after_cutoff"),
        F.count_if(F.col("Latitude").isNull()).alias("latitude_null"),
        F.count_if(F.col("Longitude").isNull()).alias("longitude_null"),
        F.count_if(F.col("Magnitude").isNull()).alias("magnitude_null"),
        F.count_if(F.col("Depth_In_Km").isNull()).alias("depth_not_number"),
        F.count_if(F.col("General_Location").isNull()).alias("location_null"),
        F.count_if(infinite).alias("coordinate_not_finite"),
        F.count_if(keep).alias("clean_rows"),
    )
    pairs = ", ".join(f"'{r}', `{r}`" for r in AUDIT_RULES)
    return agg.selectExpr(f"stack({len(AUDIT_RULES)}, {pairs}) AS (rule, n)").select(
        "rule", F.col("n").cast("bigint").alias("n"))
