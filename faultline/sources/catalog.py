"""Catalogue sources: raw CSV/Parquet scans and the quake-shaped view of ``events``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.constants import NA_TOKENS

# Fixed values of the quake-shaped view over ``events``: place names picked by
# ``user_id % 20`` (entry 17 is an empty string).
VIEW_PLACES = [
    "Davao Occidental", "Surigao Del Sur", "DAVAO ORIENTAL", "Eastern Samar",
    "Occidental Mindoro", "Cagayan", "Cagayan De Oro City", "Batanes", "Masbate",
    "Southern Leyte", "Aklan", "Dinagat Islands", "Quezon (Bukidnon)", "La Union",
    "Romblon", "Negros Oriental", "Batangas", "", "Samar", "Zamboanga Del Norte",
]

# The view is dated in January 2024, so the default cutoff would drop nothing;
# queries over it use this cutoff instead.
VIEW_CUTOFF = "2024-01-28 00:00:00"


def read_catalog(spark: SparkSession, path: str, fmt: str = "csv", with_key: bool = True,
                 multi_line: bool = True) -> DataFrame:
    """Scan a raw catalogue.

    CSV is read with a header, an all-text schema (no inference pass over the data), and
    quoting as pandas has it: a quote inside a quoted field is doubled.  ``multi_line``
    allows line breaks inside quoted fields; Spark then reads each file in one task, so turn
    it off for large files that have none.  A file without ``quake_id`` gets one:
    ``monotonically_increasing_id`` is unique but depends on the input split, so store the
    keyed table once and read it back for repeatable runs.
    """
    if fmt == "csv":
        reader = spark.read.options(header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=multi_line)
        header = reader.option("enforceSchema", False).csv(path).columns  # reads only the header line
        schema = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        df = reader.schema(schema).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    if with_key and "quake_id" not in df.columns:
        df = df.withColumn("quake_id", F.monotonically_increasing_id())
    return df


def null_tokens(df: DataFrame, cols: list[str], tokens: list[str] = NA_TOKENS) -> DataFrame:
    """Map missing-value tokens in text columns to NULL."""
    tok = F.array(*[F.lit(t) for t in tokens])
    return df.withColumns({
        c: F.when(~F.array_contains(tok, F.col(c)), F.col(c)) for c in cols
    })


def quake_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quake catalogue derived row by row from the driver's ``events`` table.

    Integer arithmetic on the event key and user, then a single division, so that
    every engine produces the same values.  Numeric columns arrive as DOUBLE,
    depth and time as text (with malformed values), place names as text.  The
    ``event_id % n`` rules only decide which *values* are malformed or missing
    (as a real catalogue has them); every event becomes one catalogue row, and
    nothing here selects or drops rows.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    e = F.col("event_id")
    z = F.col("user_id") % 7

    def div100(c: Column) -> Column:
        return c / F.lit(100)

    lat = (F.when(e % 71 == 0, F.lit(None).cast("double"))
           .when(e % 97 == 0, div100(400 + (e * 7919) % 1700))
           .otherwise(div100(550 + z * 210 - F.when(z == 6, 140).otherwise(0) + (e * 37) % 61)))
    lon = (F.when(e % 97 == 0, div100(11700 + (e * 6151) % 1000))
           .otherwise(div100(11900 + F.least(z, F.lit(5)) * 110 + (e * 53) % 47)))
    depth = (F.when(e % 43 == 0, F.lit("-"))
             .when(e % 47 == 0, F.lit(None).cast("string"))
             .otherwise(((e * 11) % 420).cast("string")))
    mag = (F.when(e % 83 == 0, F.lit(None).cast("double"))
           .when((e * 7919) % 1000 < 20 + 20 * z, (40 + e % 25) / F.lit(10))
           .otherwise((10 + (e * 13) % 30) / F.lit(10)))
    when_ = (F.when(e % 53 == 0, F.lit("not-a-date"))
             .when(e % 61 == 0, F.lit(None).cast("string"))
             .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    places = F.array(*[F.lit(p) for p in VIEW_PLACES])
    place = F.when(e % 89 == 0, F.lit(None).cast("string")).otherwise(
        F.element_at(places, (F.col("user_id") % 20 + 1).cast("int")))
    return ev.select(
        e.alias("quake_id"),
        when_.alias("Date_Time_PH"),
        lat.alias("Latitude"),
        lon.alias("Longitude"),
        depth.alias("Depth_In_Km"),
        mag.alias("Magnitude"),
        F.lit(None).cast("string").alias("Location"),
        place.alias("General_Location"),
    )


def precise_view(quakes: DataFrame) -> DataFrame:
    """The clean view with coordinates of full precision: nearly every row a place of its own."""
    e = F.col("quake_id")
    return quakes.withColumns({
        "Latitude": F.col("Latitude") + (e * 7919 % 100_003) / F.lit(10_000_019.0),
        "Longitude": F.col("Longitude") + (e * 104_729 % 100_019) / F.lit(10_000_079.0),
    })


def hot_view(quakes: DataFrame) -> DataFrame:
    """The precise view with every third event at one place, as a network's default location."""
    p = precise_view(quakes)
    hot = F.col("quake_id") % 3 == 0
    return p.withColumns({"Latitude": F.when(hot, F.lit(9.25)).otherwise(F.col("Latitude")),
                          "Longitude": F.when(hot, F.lit(122.125)).otherwise(F.col("Longitude"))})


#: Layouts of event times and how DuckDB writes them.
TIME_LAYOUTS = {"dd/MM/yyyy HH:mm": "%d/%m/%Y %H:%M", "MM/dd/yyyy HH:mm": "%m/%d/%Y %H:%M",
                "yyyy-MM-dd HH:mm:ss": "%Y-%m-%d %H:%M:%S"}


def mixed_time_view(quakes: DataFrame) -> DataFrame:
    """The raw view with every third time written day first and every fifth of the others month first."""
    e, t = F.col("quake_id"), F.col("Date_Time_PH")
    day_first = F.regexp_replace(t, r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):\d+$", "$3/$2/$1 $4:$5")
    month_first = F.regexp_replace(t, r"^(\d+)-(\d+)-(\d+) (\d+):(\d+):\d+$", "$2/$3/$1 $4:$5")
    return quakes.withColumn("Date_Time_PH", F.when(e % 3 == 0, day_first).when(e % 5 == 0, month_first).otherwise(t))


def quoted_view(quakes: DataFrame) -> DataFrame:
    """The raw view with quotes, a comma and a line break in every location."""
    return quakes.withColumn("Location", F.concat(
        F.lit('012 km "N" of '), F.coalesce("General_Location", F.lit("?")), F.lit(", day 2\nfelt")))
