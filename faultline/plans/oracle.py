"""Independent DuckDB SQL for each registered query.

Each statement rebuilds the quake view from ``events``, cleans it and computes
the result with plain SQL (brute force where the Spark side is clever), so the
two engines share no code.  Column names and types follow the Spark results.
"""

from __future__ import annotations

from faultline.constants import (
    DBSCAN_EPS, DBSCAN_MIN_SAMPLES, DEPTH_EDGES, DEPTH_LABELS, NA_TOKENS, QUERY_HIST_BINS, QUERY_SAMPLE_ROWS,
    QUERY_TIGHT_EPS, QUERY_TIGHT_MIN_SAMPLES, QUERY_ZOOM, REGION_GROUPS, SEED,
)
from faultline.functions.columns import NUMBER_PATTERN
from faultline.sources.catalog import TIME_LAYOUTS, VIEW_CUTOFF, VIEW_PLACES


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _na(c: str) -> str:
    toks = ", ".join(_q(t) for t in NA_TOKENS)
    return f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END"


def _region(c: str) -> str:
    parts = [f"WHEN {c} IS NULL THEN 'Unknown'"]
    for label, words in REGION_GROUPS:
        conds = " OR ".join(f"contains(lower({c}), {_q(w)})" for w in dict.fromkeys(words))
        parts.append(f"WHEN {conds} THEN {_q(label)}")
    return "CASE " + " ".join(parts) + " ELSE 'Unknown' END"


def _depth_band(c: str) -> str:
    parts = []
    for lo, hi, label in zip(DEPTH_EDGES[:-1], DEPTH_EDGES[1:], DEPTH_LABELS):
        hi_s = "'infinity'::DOUBLE" if hi == float("inf") else repr(hi)
        parts.append(f"WHEN {c} > {lo!r} AND {c} <= {hi_s} THEN {_q(label)}")
    return "CASE " + " ".join(parts) + " END"


def _num(c: str) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), {_q(NUMBER_PATTERN)}) "
            f"THEN TRY_CAST(trim({c}) AS DOUBLE) END")


def _nan(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END"


PLACES = "[" + ", ".join(_q(p) for p in VIEW_PLACES) + "]"

QUAKES = f"""quakes AS (
  SELECT event_id AS quake_id,
    CASE WHEN event_id % 53 = 0 THEN 'not-a-date' WHEN event_id % 61 = 0 THEN NULL
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS Date_Time_PH,
    CASE WHEN event_id % 71 = 0 THEN NULL
         WHEN event_id % 97 = 0 THEN (400 + (event_id * 7919) % 1700) / 100
         ELSE (550 + (user_id % 7) * 210 - CASE WHEN user_id % 7 = 6 THEN 140 ELSE 0 END
               + (event_id * 37) % 61) / 100 END AS Latitude,
    CASE WHEN event_id % 97 = 0 THEN (11700 + (event_id * 6151) % 1000) / 100
         ELSE (11900 + least(user_id % 7, 5) * 110 + (event_id * 53) % 47) / 100 END AS Longitude,
    CASE WHEN event_id % 43 = 0 THEN '-' WHEN event_id % 47 = 0 THEN NULL
         ELSE CAST((event_id * 11) % 420 AS VARCHAR) END AS Depth_In_Km,
    CASE WHEN event_id % 83 = 0 THEN NULL
         WHEN (event_id * 7919) % 1000 < 20 + 20 * (user_id % 7) THEN (40 + event_id % 25) / 10
         ELSE (10 + (event_id * 13) % 30) / 10 END AS Magnitude,
    CAST(NULL AS VARCHAR) AS Location,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE ({PLACES})[user_id % 20 + 1] END AS General_Location
  FROM events)"""

COERCED = f"""coerced AS (
  SELECT quake_id,
    try_strptime({_na('Date_Time_PH')}, '%Y-%m-%d %H:%M:%S') AS Date_Time_PH,
    {_nan('Latitude')} AS Latitude,
    {_nan('Longitude')} AS Longitude,
    {_num('Depth_In_Km')} AS Depth_In_Km,
    {_nan('Magnitude')} AS Magnitude,
    {_na('Location')} AS Location,
    {_na('General_Location')} AS General_Location
  FROM quakes)"""


def _clean(cutoff: str) -> str:
    return f"""clean AS (
  SELECT *, CAST(Magnitude >= 4.0 AS INTEGER) AS is_significant,
    {_region('General_Location')} AS Region,
    CAST(hour(Date_Time_PH) AS INTEGER) AS Hour,
    CAST(isodow(Date_Time_PH) - 1 AS INTEGER) AS DayOfWeek,
    CAST(month(Date_Time_PH) AS INTEGER) AS Month,
    {_depth_band('Depth_In_Km')} AS Depth_Category
  FROM coerced
  WHERE Date_Time_PH <= TIMESTAMP '{cutoff}'
    AND Latitude IS NOT NULL AND Longitude IS NOT NULL
    AND Magnitude IS NOT NULL AND Depth_In_Km IS NOT NULL)"""


def with_clean(body: str, *extra_ctes: str, cutoff: str = VIEW_CUTOFF, recursive: bool = False) -> str:
    ctes = [QUAKES, COERCED, _clean(cutoff), *extra_ctes]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body


def md5_key(key: str, seed: int = SEED) -> str:
    return f"md5(concat_ws('-', CAST({key} AS VARCHAR), '{seed}'))"


CLEAN_COLUMNS = ("quake_id, Date_Time_PH, Latitude, Longitude, Depth_In_Km, Magnitude, Location, "
                 "General_Location, is_significant, Region, Hour, DayOfWeek, Month, Depth_Category")

HIST_BINS = QUERY_HIST_BINS


def _histogram(bins: int, by: str | None) -> str:
    by_sel = f", {by}" if by else ""
    grid = (f"SELECT CAST(b AS INTEGER) AS bin, v AS {by} FROM range({bins}) t(b), (VALUES (0), (1)) c(v)"
            if by else f"SELECT CAST(b AS INTEGER) AS bin FROM range({bins}) t(b)")
    edge = ("CASE WHEN {i} = {bins} THEN r.hi ELSE CAST({i} AS DOUBLE) * ((r.hi - r.lo) / {bins}.0) + r.lo END")

    def e(i: str) -> str:
        return edge.format(i=i, bins=bins)
    return with_clean(f"""
SELECT g.bin{', g.' + by if by else ''}, {e('g.bin')} AS lo, {e('g.bin + 1')} AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g CROSS JOIN r
LEFT JOIN counted c ON c.bin = g.bin{f' AND c.{by} = g.{by}' if by else ''}
ORDER BY 1{', 2' if by else ''}""",
        f"""r0 AS (SELECT min(Magnitude) AS lo0, max(Magnitude) AS hi0 FROM clean)""",
        f"""r AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                        CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM r0)""",
        f"""g0 AS (SELECT c.*, r.lo, r.hi,
             least(CAST(floor((Magnitude - r.lo) / (r.hi - r.lo) * {bins}.0) AS BIGINT), {bins - 1}) AS guess
           FROM clean c CROSS JOIN r)""",
        f"""g1 AS (SELECT *, CASE WHEN Magnitude < {e('guess').replace('r.', '')} THEN guess - 1 ELSE guess END AS down
           FROM g0)""",
        f"""g2 AS (SELECT *, CASE WHEN Magnitude >= {e('down + 1').replace('r.', '')} AND down <> {bins - 1}
                                THEN down + 1 ELSE down END AS bin FROM g1)""",
        f"""counted AS (SELECT CAST(bin AS INTEGER) AS bin{by_sel}, count(*) AS n FROM g2 GROUP BY ALL)""",
        f"""grid AS ({grid})""",
    )


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["clean_catalog"] = with_clean(f"SELECT {CLEAN_COLUMNS} FROM clean")
    q["cleaning_audit"] = with_clean(f"""
SELECT rule, n FROM (
  SELECT
    count(*) AS raw_rows,
    count(*) FILTER (WHERE Date_Time_PH IS NULL) AS bad_or_null_time,
    count(*) FILTER (WHERE Date_Time_PH > TIMESTAMP '{VIEW_CUTOFF}') AS after_cutoff,
    count(*) FILTER (WHERE Latitude IS NULL) AS latitude_null,
    count(*) FILTER (WHERE Longitude IS NULL) AS longitude_null,
    count(*) FILTER (WHERE Magnitude IS NULL) AS magnitude_null,
    count(*) FILTER (WHERE Depth_In_Km IS NULL) AS depth_not_number,
    count(*) FILTER (WHERE General_Location IS NULL) AS location_null,
    count(*) FILTER (WHERE isinf(Latitude) OR isinf(Longitude)) AS coordinate_not_finite,
    count(*) FILTER (WHERE Date_Time_PH <= TIMESTAMP '{VIEW_CUTOFF}' AND Latitude IS NOT NULL
                     AND Longitude IS NOT NULL AND Magnitude IS NOT NULL
                     AND Depth_In_Km IS NOT NULL) AS clean_rows
  FROM coerced
) UNPIVOT (n FOR rule IN (raw_rows, bad_or_null_time, after_cutoff, latitude_null, longitude_null,
                          magnitude_null, depth_not_number, location_null, coordinate_not_finite,
                          clean_rows))""")
    q["table_shape"] = with_clean("SELECT count(*) AS n_rows, CAST(14 AS BIGINT) AS n_cols FROM clean")
    types = [("quake_id", "bigint"), ("Date_Time_PH", "timestamp_ntz"), ("Latitude", "double"),
             ("Longitude", "double"), ("Depth_In_Km", "double"), ("Magnitude", "double"),
             ("Location", "string"), ("General_Location", "string"), ("is_significant", "int"),
             ("Region", "string"), ("Hour", "int"), ("DayOfWeek", "int"), ("Month", "int"),
             ("Depth_Category", "string")]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null FROM clean"
        for i, (c, t) in enumerate(types))
    q["column_info"] = with_clean(
        f"SELECT CAST(position AS INTEGER) AS position, column_name, data_type, "
        f"CAST(non_null AS BIGINT) AS non_null FROM ({rows})")
    q["preview"] = with_clean(f"SELECT {CLEAN_COLUMNS} FROM clean ORDER BY quake_id LIMIT 5")
    stats = " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max FROM quakes"""
                               for c in ["Latitude", "Longitude", "Magnitude"])
    q["describe_numeric"] = with_clean(stats)
    q["region_classify"] = with_clean("SELECT quake_id, General_Location, Region FROM clean")
    q["region_breakdown"] = with_clean("""
SELECT Region, count(*) AS Total_Quakes, CAST(sum(is_significant) AS BIGINT) AS Significant_Quakes,
       avg(is_significant) * 100.0 AS Significance_Rate
FROM clean GROUP BY Region ORDER BY Region""")
    q["time_features"] = with_clean("SELECT quake_id, Date_Time_PH, Hour, DayOfWeek, Month FROM clean")
    q["depth_bands"] = with_clean("SELECT quake_id, Depth_In_Km, Depth_Category FROM clean")
    q["totals"] = with_clean("""
SELECT count(*) AS total, CAST(sum(is_significant) AS BIGINT) AS significant,
       avg(is_significant) * 100.0 AS pct FROM clean""")
    q["top_places"] = with_clean("""
SELECT CAST(row_number() OVER (ORDER BY n DESC, General_Location) AS INTEGER) AS rank, General_Location, n
FROM (SELECT General_Location, count(*) AS n FROM clean
      WHERE is_significant = 1 AND General_Location IS NOT NULL GROUP BY General_Location)
ORDER BY n DESC, General_Location LIMIT 10""")
    q["region_counts"] = with_clean("SELECT Region, count(*) AS n FROM clean GROUP BY Region")
    q["region_significance"] = with_clean("""
SELECT Region, count(*) FILTER (WHERE is_significant = 0) AS non_significant,
       count(*) FILTER (WHERE is_significant = 1) AS significant
FROM clean GROUP BY Region ORDER BY Region""")
    q["magnitude_histogram"] = _histogram(HIST_BINS, None)
    q["magnitude_histogram_by_class"] = _histogram(HIST_BINS, "is_significant")
    q.update(spatial_sql())
    return q


# ---------------------------------------------------------------------------
# Sampling, split, features, metrics, spatial
# ---------------------------------------------------------------------------

TIGHT_EPS, TIGHT_MIN = QUERY_TIGHT_EPS, QUERY_TIGHT_MIN_SAMPLES


def _eps2(eps: float) -> str:
    return f"CAST('{eps * eps!r}' AS DOUBLE)"


def _d2(a: str, b: str) -> str:
    return f"({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)"


def dbscan_ctes(src: str, eps: float, min_samples: int, p: str) -> list[str]:
    """Brute-force DBSCAN: all pairs within eps, min-label propagation over core pairs."""
    return [
        f"{p}pts AS MATERIALIZED (SELECT quake_id AS k, Latitude AS x, Longitude AS y FROM {src})",
        f"{p}nb AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM {p}pts a JOIN {p}pts b "
        f"ON {_d2('a', 'b')} <= {_eps2(eps)})",
        f"{p}core AS MATERIALIZED (SELECT a AS k FROM {p}nb GROUP BY a HAVING count(*) >= {min_samples})",
        f"{p}cedge AS MATERIALIZED (SELECT a, b FROM {p}nb WHERE a <> b "
        f"AND a IN (SELECT k FROM {p}core) AND b IN (SELECT k FROM {p}core))",
        f"{p}cc(k, lbl) USING KEY (k) AS (SELECT k, k FROM {p}core UNION "
        f"SELECT e.a, min(c.lbl) FROM {p}cc c JOIN {p}cedge e ON e.b = c.k JOIN recurring.{p}cc r ON r.k = e.a "
        f"GROUP BY e.a HAVING min(c.lbl) < min(r.lbl))",
        f"{p}zone AS MATERIALIZED (SELECT k, CAST(dense_rank() OVER (ORDER BY lbl) - 1 AS INTEGER) AS zone "
        f"FROM {p}cc)",
        f"{p}border AS MATERIALIZED (SELECT n.a AS k, min(z.zone) AS zone FROM {p}nb n JOIN {p}zone z "
        f"ON n.b = z.k WHERE n.a NOT IN (SELECT k FROM {p}core) GROUP BY n.a)",
        f"{p}labels AS MATERIALIZED (SELECT p.k AS quake_id, CAST(coalesce(z.zone, b.zone, -1) AS INTEGER) "
        f"AS Cluster FROM {p}pts p LEFT JOIN {p}zone z ON z.k = p.k LEFT JOIN {p}border b ON b.k = p.k)",
    ]


def _sample(cap: int, name: str = "samp") -> str:
    return (f"{name} AS MATERIALIZED (SELECT * FROM clean "
            f"QUALIFY row_number() OVER (ORDER BY {md5_key('quake_id')}, quake_id) <= {cap})")


SPLIT = [
    "cc AS (SELECT is_significant AS c, count(*) AS n_c FROM clean GROUP BY 1)",
    "tot AS (SELECT sum(n_c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM cc)",
    "fl AS (SELECT c, n_c, n_c / n * (n - n_test) AS cont, floor(n_c / n * (n - n_test)) AS f, "
    "n - n_test AS n_train FROM cc, tot)",
    "rk AS (SELECT *, row_number() OVER (ORDER BY cont - f DESC, c) AS r, n_train - sum(f) OVER () AS need FROM fl)",
    "sizes AS (SELECT c, CAST(n_c - (f + CASE WHEN r <= need THEN 1 ELSE 0 END) AS BIGINT) AS k FROM rk)",
    f"split AS MATERIALIZED (SELECT cl.quake_id, cl.is_significant, "
    f"row_number() OVER (PARTITION BY cl.is_significant ORDER BY {md5_key('cl.quake_id')}, cl.quake_id) <= s.k "
    f"AS is_test FROM clean cl JOIN sizes s ON s.c = cl.is_significant)",
]

RULE = "CAST(Region = 'Mindanao' AS INTEGER)"
EVAL = (f"ev AS MATERIALIZED (SELECT cl.is_significant, {RULE} AS prediction FROM clean cl "
        f"JOIN split s USING (quake_id) WHERE s.is_test)")


def _silhouette_sql(points: str, labels: str, name: str) -> tuple[str, list[str]]:
    return f"""
SELECT round(avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0
                      WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS {name},
       count(*) AS n
FROM (SELECT d.k, max(CASE WHEN d.lab = d.own THEN d.ds / nullif(z.n - 1, 0) END) AS a,
             min(CASE WHEN d.lab <> d.own THEN d.ds / z.n END) AS b,
             max(CASE WHEN d.lab = d.own THEN z.n END) AS n_own
      FROM (SELECT a.k, a.lab AS own, b.lab, sum({_d2("a", "b")}) AS ds
            FROM sp a, sp b GROUP BY a.k, a.lab, b.lab) d
      JOIN (SELECT lab, count(*) AS n FROM sp GROUP BY lab) z ON z.lab = d.lab
      GROUP BY d.k)""", [
        f"sp AS MATERIALIZED (SELECT p.quake_id AS k, p.Latitude AS x, p.Longitude AS y, l.Cluster AS lab "
        f"FROM {points} p JOIN {labels} l USING (quake_id))"]


# The view's coordinates at full precision, and with every third event at one place.
PRECISE = """precise AS MATERIALIZED (
  SELECT * REPLACE (Latitude + (quake_id * 7919 % 100003) / 10000019.0 AS Latitude,
                    Longitude + (quake_id * 104729 % 100019) / 10000079.0 AS Longitude) FROM clean)"""
HOT = """hot AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN quake_id % 3 = 0 THEN 9.25 ELSE Latitude END AS Latitude,
                    CASE WHEN quake_id % 3 = 0 THEN 122.125 ELSE Longitude END AS Longitude) FROM precise)"""


def spatial_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["dbscan_labels"] = with_clean("SELECT quake_id, Cluster FROM labels",
                                    *dbscan_ctes("clean", DBSCAN_EPS, DBSCAN_MIN_SAMPLES, ""), recursive=True)
    q["dbscan_labels_tight"] = with_clean("SELECT quake_id, Cluster FROM labels",
                                          *dbscan_ctes("clean", TIGHT_EPS, TIGHT_MIN, ""), recursive=True)
    q["within_distance_counts"] = with_clean(f"""
SELECT a.quake_id, count(*) AS n_within FROM clean a JOIN clean b
ON (a.Latitude - b.Latitude) * (a.Latitude - b.Latitude) + (a.Longitude - b.Longitude) * (a.Longitude - b.Longitude)
   <= {_eps2(TIGHT_EPS)}
GROUP BY a.quake_id""")
    zl = dbscan_ctes("clean", DBSCAN_EPS, DBSCAN_MIN_SAMPLES, "")
    q["zone_summary"] = with_clean("""
SELECT count(DISTINCT Cluster) AS n_labels, count(DISTINCT Cluster) FILTER (WHERE Cluster <> -1) AS n_zones,
       count(*) FILTER (WHERE Cluster = -1) AS n_noise FROM labels""", *zl, recursive=True)
    q["zone_profile"] = with_clean("""
SELECT l.Cluster, count(c.Magnitude) AS magnitude_count, round_even(avg(c.Magnitude) * 100, 0) / 100 AS magnitude_mean,
       round_even(max(c.Magnitude) * 100, 0) / 100 AS magnitude_max,
       round_even(avg(c.Latitude) * 100, 0) / 100 AS latitude_mean,
       round_even(avg(c.Longitude) * 100, 0) / 100 AS longitude_mean,
       coalesce(max(m.General_Location), 'Unknown') AS place_mode
FROM clean c JOIN labels l USING (quake_id)
LEFT JOIN (SELECT Cluster, General_Location FROM (
             SELECT l2.Cluster, c2.General_Location, count(*) AS n FROM clean c2 JOIN labels l2 USING (quake_id)
             WHERE c2.General_Location IS NOT NULL GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY Cluster ORDER BY n DESC, General_Location) = 1) m
  ON m.Cluster = l.Cluster
GROUP BY l.Cluster ORDER BY l.Cluster""", *zl, recursive=True)
    q["sample_points"] = with_clean("SELECT quake_id, Longitude, Latitude, Magnitude FROM samp",
                                    _sample(QUERY_SAMPLE_ROWS))
    q["depth_magnitude_points"] = with_clean("SELECT quake_id, Depth_In_Km, Magnitude FROM clean")
    q["split_assignment"] = with_clean("SELECT quake_id, is_significant, is_test FROM split", *SPLIT)
    q["class_counts"] = with_clean(
        "SELECT is_significant, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1 ORDER BY 1", *SPLIT)
    q["class_weight"] = with_clean("""
SELECT is_significant, n,
       CASE WHEN is_significant = 1 THEN (SELECT count(*) FILTER (WHERE is_significant = 0)
                                                 / count(*) FILTER (WHERE is_significant = 1)
                                          FROM split WHERE NOT is_test) ELSE 1.0 END AS weight
FROM (SELECT is_significant, count(*) AS n FROM split WHERE NOT is_test GROUP BY 1) ORDER BY 1""", *SPLIT)
    onehot = ", ".join(f"CAST(Region = '{r}' AS INTEGER) AS Region_{r}"
                       for r in ["Luzon", "Mindanao", "Unknown", "Visayas"])
    q["one_hot_region"] = with_clean(f"SELECT quake_id, {onehot} FROM clean")
    q["feature_table"] = with_clean(
        f"SELECT quake_id, is_significant, Latitude, Longitude, Depth_In_Km, CAST(Hour AS DOUBLE) AS Hour, "
        f"CAST(DayOfWeek AS DOUBLE) AS DayOfWeek, CAST(Month AS DOUBLE) AS Month, {onehot.replace('INTEGER', 'DOUBLE')} "
        f"FROM clean")
    q["confusion_matrix"] = with_clean("""
SELECT g.c AS is_significant, count(*) FILTER (WHERE ev.prediction = 0) AS pred_0,
       count(*) FILTER (WHERE ev.prediction = 1) AS pred_1
FROM (VALUES (0), (1)) g(c) LEFT JOIN ev ON ev.is_significant = g.c GROUP BY g.c ORDER BY 1""", *SPLIT, EVAL)
    q["confusion_cells"] = with_clean("""
SELECT a AS actual, p AS predicted, count(ev.is_significant) AS n
FROM (VALUES (0), (1)) ga(a) CROSS JOIN (VALUES (0), (1)) gp(p)
LEFT JOIN ev ON ev.is_significant = a AND ev.prediction = p GROUP BY a, p ORDER BY 1, 2""", *SPLIT, EVAL)
    q["classification_report"] = with_clean("""
SELECT row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  SELECT CAST(c AS VARCHAR) AS row, CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END AS precision,
         CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END AS recall,
         CASE WHEN sup + pred = 0 THEN 0.0 ELSE 2 * tp / (sup + pred) END AS f1, sup AS support FROM pc
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(sup), sum(sup) FROM pc
  UNION ALL SELECT 'macro avg', avg(CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END),
                   avg(CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END),
                   avg(CASE WHEN sup + pred = 0 THEN 0.0 ELSE 2 * tp / (sup + pred) END), sum(sup) FROM pc
  UNION ALL SELECT 'weighted avg',
                   sum(CASE WHEN pred = 0 THEN 0.0 ELSE tp / pred END * sup) / sum(sup),
                   sum(CASE WHEN sup = 0 THEN 0.0 ELSE tp / sup END * sup) / sum(sup),
                   sum(CASE WHEN sup + pred = 0 THEN 0.0 ELSE 2 * tp / (sup + pred) END * sup) / sum(sup),
                   sum(sup) FROM pc)""", *SPLIT, EVAL,
        """pc AS (SELECT g.c, count(*) FILTER (WHERE ev.is_significant = g.c AND ev.prediction = g.c) AS tp,
                  count(*) FILTER (WHERE ev.is_significant = g.c) AS sup,
                  (SELECT count(*) FROM ev WHERE prediction = g.c) AS pred
           FROM (VALUES (0), (1)) g(c) LEFT JOIN ev ON true GROUP BY g.c)""")
    q["accuracy"] = with_clean(
        "SELECT round(avg(CAST(is_significant = prediction AS INTEGER)), 6) AS accuracy, count(*) AS n FROM ev",
        *SPLIT, EVAL)
    nearest = """
SELECT c.quake_id, (min((d2, l.k, l.lab)))[3] AS {name}
FROM {points} c CROSS JOIN sites l,
     LATERAL (SELECT (c.Latitude - l.x) * (c.Latitude - l.x) + (c.Longitude - l.y) * (c.Longitude - l.y) AS d2)
GROUP BY c.quake_id"""
    q["nearest_label"] = with_clean(
        nearest.format(name="Cluster", points="clean"), *zl,
        "sites AS MATERIALIZED (SELECT quake_id AS k, Latitude AS x, Longitude AS y, Cluster AS lab "
        "FROM clean JOIN labels USING (quake_id) WHERE is_significant = 1)", recursive=True)
    q["nearest_label_hot"] = with_clean(
        nearest.format(name="Region", points="hot"), PRECISE, HOT,
        "sites AS MATERIALIZED (SELECT quake_id AS k, Latitude AS x, Longitude AS y, Region AS lab "
        "FROM hot WHERE is_significant = 1)")
    q["map_points"] = with_clean(
        "SELECT c.quake_id, c.Longitude, c.Latitude, l.Cluster FROM clean c JOIN labels l USING (quake_id)",
        *zl, recursive=True)
    tile = f"CAST(least(greatest(floor(({{}} + {{}}) / {{}} * {2.0 ** QUERY_ZOOM}), 0), {2 ** QUERY_ZOOM - 1}) AS BIGINT)"
    q["map_tiles"] = with_clean(f"""
SELECT CAST(z AS INTEGER) AS zoom, tx, ty, CAST(sum(n) AS BIGINT) AS n, arg_max(Cluster, (n, -Cluster)) AS Cluster,
       max(n) AS label_n
FROM (SELECT z, tx >> ({QUERY_ZOOM} - z) AS tx, ty >> ({QUERY_ZOOM} - z) AS ty, Cluster, count(*) AS n
      FROM (SELECT {tile.format('c.Longitude', 180.0, 360.0)} AS tx, {tile.format('c.Latitude', 90.0, 180.0)} AS ty, l.Cluster
            FROM clean c JOIN labels l USING (quake_id)) p CROSS JOIN range({QUERY_ZOOM + 1}) g(z)
      GROUP BY ALL) GROUP BY z, tx, ty""", *zl, recursive=True)
    parsed = ", ".join(f"try_strptime(t, {_q(f)}) IS NOT NULL AS p{k}" for k, f in enumerate(TIME_LAYOUTS.values()))
    every = " + ".join(f"CAST(p{k} AS INTEGER)" for k in range(len(TIME_LAYOUTS)))
    votes = " UNION ALL ".join(f"SELECT {k} AS k, {_q(x)} AS layout, count(*) FILTER (WHERE p{k}) AS n_parsed, "
                               f"count(*) FILTER (WHERE p{k} AND {every} = 1) AS n_only FROM v"
                               for k, x in enumerate(TIME_LAYOUTS))
    q["time_layout_vote"] = with_clean(
        "SELECT layout, n_parsed, n_only, row_number() OVER (ORDER BY n_parsed DESC, k) = 1 AS chosen FROM votes",
        """mixed AS (SELECT CASE WHEN length(coalesce(Date_Time_PH, '')) <> 19 THEN Date_Time_PH
             WHEN quake_id % 3 = 0 THEN strftime(CAST(Date_Time_PH AS TIMESTAMP), '%d/%m/%Y %H:%M')
             WHEN quake_id % 5 = 0 THEN strftime(CAST(Date_Time_PH AS TIMESTAMP), '%m/%d/%Y %H:%M')
             ELSE Date_Time_PH END AS t FROM quakes)""",
        f"v AS (SELECT {parsed} FROM mixed)", f"votes AS ({votes})")
    within = """
SELECT a.quake_id, count(*) AS n_within FROM {points} a JOIN {points} b
ON (a.Latitude - b.Latitude) * (a.Latitude - b.Latitude) + (a.Longitude - b.Longitude) * (a.Longitude - b.Longitude)
   <= {eps2}
GROUP BY a.quake_id"""
    q["within_distance_precise"] = with_clean(within.format(points="precise", eps2=_eps2(TIGHT_EPS)), PRECISE)
    q["within_distance_hot"] = with_clean(within.format(points="hot", eps2=_eps2(TIGHT_EPS)), PRECISE, HOT)
    q["within_distance_between"] = with_clean(f"""
SELECT a.quake_id, count(b.quake_id) AS n_within FROM hot a LEFT JOIN hot b
ON b.is_significant = 0 AND (a.Latitude - b.Latitude) * (a.Latitude - b.Latitude)
   + (a.Longitude - b.Longitude) * (a.Longitude - b.Longitude) <= {_eps2(TIGHT_EPS)}
WHERE a.is_significant = 1 GROUP BY a.quake_id""", PRECISE, HOT)
    q["dbscan_precise"] = with_clean("SELECT quake_id, Cluster FROM labels", PRECISE,
                                     *dbscan_ctes("precise", TIGHT_EPS, TIGHT_MIN, ""), recursive=True)
    groups = ", ".join(f"({k}, {_q(label)}, {_q(w)})" for k, (label, words) in enumerate(REGION_GROUPS) for w in words)
    q["region_by_rule_table"] = with_clean("""
SELECT q.quake_id, q.General_Location, coalesce(m.Region, 'Unknown') AS Region
FROM quakes q LEFT JOIN (SELECT n.place, (min((r.priority, r.label)))[2] AS Region
  FROM names n JOIN rules r ON contains(lower(n.place), lower(r.keyword)) GROUP BY n.place) m
ON m.place = q.General_Location""",
        "names AS (SELECT DISTINCT General_Location AS place FROM quakes WHERE General_Location IS NOT NULL)",
        f"""rules AS (SELECT * FROM (VALUES {groups}) g(priority, label, keyword) UNION ALL
             SELECT {len(REGION_GROUPS)} + length(place), 'Place ' || place, place FROM names)""")
    q["impute_mean"] = with_clean("""
SELECT quake_id, round(coalesce(Latitude, avg(Latitude) OVER ()), 6) AS Latitude,
       round(coalesce(Magnitude, avg(Magnitude) OVER ()), 6) AS Magnitude,
       round(coalesce(CAST(d AS DOUBLE), avg(d) OVER ()), 6) AS Depth
FROM (SELECT *, TRY_CAST(Depth_In_Km AS INTEGER) AS d FROM quakes)""")
    q["csv_round_trip"] = with_clean("""
SELECT c.quake_id, c.Date_Time_PH, c.Latitude, c.Longitude, c.Depth_In_Km, c.Magnitude,
       '012 km "N" of ' || coalesce(q.General_Location, '?') || ', day 2' || chr(10) || 'felt' AS Location,
       c.General_Location
FROM coerced c JOIN quakes q USING (quake_id)""")
    bands = ", ".join(f"CAST(coalesce(Depth_Category = {_q(v)}, false) AS INTEGER) AS Depth_{v.replace(' ', '_')}"
                      for v in DEPTH_LABELS)
    q["one_hot_depth"] = with_clean(f"SELECT quake_id, {bands} FROM clean")
    q["model_test_rows"] = with_clean("SELECT quake_id, is_significant FROM split WHERE is_test", *SPLIT)
    facts = ["probabilities are in [0, 1]", "prediction is probability above one half", "importances sum to 1",
             "importances are named in feature order", "top features descend", "summary has its lines",
             "report has its features"]
    q["model_checks"] = "SELECT * FROM (VALUES " + ", ".join(f"({_q(f)}, true)" for f in facts) + ") t(fact, holds)"
    facts = ["log loss on the test rows is below the base rate's", "area under the curve is above one half",
             "validation loss doesn't rise with the trees", "no trees once the loss has settled"]
    q["model_learns"] = "SELECT * FROM (VALUES " + ", ".join(f"({_q(f)}, true)" for f in facts) + ") t(fact, holds)"
    q["summary_report"] = with_clean(REPORT_BODY, *zl, *REPORT_CTES, recursive=True)
    q["report_round_trip"] = q["summary_report"]
    histogram = _histogram(HIST_BINS, "is_significant")
    q["chart_round_trip"] = with_clean(f"""
SELECT 'regions' AS chart, Region AS mark, count(*) AS n FROM clean GROUP BY Region
UNION ALL SELECT 'non_significant', Region, count(*) FILTER (WHERE is_significant = 0) FROM clean GROUP BY Region
UNION ALL SELECT 'significant', Region, count(*) FILTER (WHERE is_significant = 1) FROM clean GROUP BY Region
UNION ALL SELECT 'magnitude_by_class', bin || '/' || is_significant, n FROM ({histogram})""")
    q["map_magnitude_points"] = with_clean("SELECT quake_id, Longitude, Latitude, Magnitude FROM clean")
    q["run_summary_values"] = with_clean("""
SELECT 'total_earthquakes' AS metric, CAST(count(*) AS VARCHAR) AS value FROM clean
UNION ALL SELECT 'significant_earthquakes', CAST(sum(is_significant) AS VARCHAR) FROM clean
UNION ALL SELECT 'accuracy', printf('%.2f', avg(CAST(is_significant = prediction AS INTEGER))) FROM ev
UNION ALL SELECT 'clusters_identified', CAST(count(DISTINCT Cluster) AS VARCHAR) FROM zlabels""",
        *SPLIT, EVAL, *dbscan_ctes("clean", DBSCAN_EPS, DBSCAN_MIN_SAMPLES, "z"), recursive=True)
    body, extra = _silhouette_sql("clean", "labels", "silhouette_squared")
    q["silhouette_squared"] = with_clean(body, *zl, *extra, recursive=True)
    q["silhouette_score"] = with_clean(
        body.replace(f"sum({_d2('a', 'b')})", f"sum(sqrt({_d2('a', 'b')}))").replace(", 6) AS silhouette_squared",
                                                                               ", 1) AS silhouette"),
        *zl, *extra, recursive=True)
    return q


REPORT_CTES = [
    "t AS (SELECT count(*) AS total, CAST(sum(is_significant) AS BIGINT) AS significant, "
    "avg(is_significant) * 100.0 AS pct FROM clean)",
    "top AS (SELECT row_number() OVER (ORDER BY n DESC, General_Location) AS rank, General_Location, n FROM "
    "(SELECT General_Location, count(*) AS n FROM clean WHERE is_significant = 1 AND General_Location IS NOT NULL "
    "GROUP BY 1) ORDER BY n DESC, General_Location LIMIT 10)",
    "rb AS (SELECT Region, count(*) AS tq, CAST(sum(is_significant) AS BIGINT) AS sq, "
    "avg(is_significant) * 100.0 AS rate, row_number() OVER (ORDER BY Region) AS pos FROM clean GROUP BY Region)",
    "zs AS (SELECT count(DISTINCT Cluster) AS n_labels FROM labels)",
    """lines AS (
      SELECT 0 AS section, 0 AS pos, 'Philippine Earthquake Analysis - Summary Report' AS line
      UNION ALL SELECT 0, 1, repeat('=', 50) UNION ALL SELECT 0, 2, ''
      UNION ALL SELECT 1, 0, printf('Total Earthquakes Analyzed: %d', total) FROM t
      UNION ALL SELECT 1, 1, printf('Significant Earthquakes (Magnitude ≥ 4.0): %d', significant) FROM t
      UNION ALL SELECT 1, 2, printf('Percentage of Significant Earthquakes: %.2f%%', pct) FROM t
      UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, 'Top 10 Provinces with Most Significant Earthquakes:'
      UNION ALL SELECT 3, rank, printf('%d. %s: %d quakes', rank, General_Location, n) FROM top
      UNION ALL SELECT 6, 0, '' UNION ALL SELECT 6, 1, 'Earthquake Distribution by Region:'
      UNION ALL SELECT 7, pos, printf('%s: %d total quakes, %d significant quakes, %.2f%% significance rate',
                                      Region, tq, sq, rate) FROM rb
      UNION ALL SELECT 8, 0, '' UNION ALL SELECT 8, 1, 'Clustering Results:'
      UNION ALL SELECT 9, 0, printf('Number of clusters identified: %d', n_labels) FROM zs
      UNION ALL SELECT 10, 0, 'Major seismic zones identified based on location patterns')""",
]
REPORT_BODY = "SELECT CAST(row_number() OVER (ORDER BY section, pos) AS INTEGER) AS line_no, line FROM lines"
