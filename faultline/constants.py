"""Fixed values and default parameters of the catalogue analysis.

Everything under "Fixed values" must equal what the original analysis uses, so
that the same input gives the same classification, bands and flags.  They are
stated once here, as plain text, in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Region keyword groups, tried in this order; the first group with a keyword
# that is a substring of the lower-cased place name wins.  Lists are kept
# exactly as published, duplicates included.
LUZON_KEYWORDS = [
    "bulacan", "pampanga", "bataan", "angeles", "baguio", "benguet", "tarlac",
    "nueva ecija", "zambales", "pangasinan", "la union", "ilocos", "abracan",
    "abra", "apayao", "benguet", "ifugao", "kalinga", "mountain province",
    "cagayan", "isabela", "nueva vizcaya", "quirino", "batanes", "basco",
    "rizon", "marinduque", "romblon", "quezon", "bicol", "albay", "camarines",
    "catanduanes", "masbate", "sorsogon", "aurora", "bataan", "bulacan",
    "nueva ecija", "pampanga", "tarlac", "zambales", "manila", "quezon city",
    "makati", "pasig", "mandaluyong", "san juan", "caloocan", "malabon",
    "navotas", "valenzuela", "marikina", "pasay", "paranaque", "muntinlupa",
    "las pinas", "makati", "taguig", "pateros", "cavite", "laguna", "batangas",
    "rizal", "cavite", "laguna", "batangas", "quezon", "marinduque",
]
VISAYAS_KEYWORDS = [
    "cebu", "cebu city", "negros", "negros oriental", "negros occidental",
    "bohol", "siquijor", "biliran", "leyte", "southern leyte", "western samar",
    "eastern samar", "northern samar", "samara", "iloilo", "capiz", "antique",
    "guimaras", "aclar", "palawan", "romblon", "mindoro", "marinduque",
    "panay", "masbate", "catanduanes", "sorsogon",
]
MINDANAO_KEYWORDS = [
    "davao", "davao del sur", "davao del norte", "davao oriental", "davao occidental",
    "cotabato", "north cotabato", "south cotabato", "sultan kudarat", "sarangani",
    "general santos", "butuan", "surigao", "surigao del norte", "surigao del sur",
    "agusan", "agusan del norte", "agusan del sur", "misamis", "misamis oriental",
    "misamis occidental", "camiguin", "zamboanga", "zamboanga del norte",
    "zamboanga del sur", "zamboanga sibugay", "lanao", "lanao del norte",
    "lanao del sur", "maguindanao", "cagayan de oro", "iligan", "marawi",
    "malaybalay", "valencia", "dipolog", "roxas", "bukidnon", "camiguin",
    "misamis", "tawi-tawi", "sulu", "basilan",
]
REGION_GROUPS = [
    ("Luzon", LUZON_KEYWORDS),
    ("Visayas", VISAYAS_KEYWORDS),
    ("Mindanao", MINDANAO_KEYWORDS),
]
REGION_DEFAULT = "Unknown"
REGIONS = ["Luzon", "Mindanao", "Unknown", "Visayas"]  # ascending, as grouped output is ordered

# Depth bands: right-closed intervals (0,10], (10,35], (35,70], (70,300], (300,inf].
DEPTH_EDGES = [0.0, 10.0, 35.0, 70.0, 300.0, float("inf")]
DEPTH_LABELS = ["Shallow", "Intermediate", "Deep", "Very Deep", "Extremely Deep"]

# Significance threshold on magnitude.
SIGNIFICANT_MAGNITUDE = 4.0

# Default cutoff: rows dated after this instant are dropped.
DEFAULT_CUTOFF = "2025-10-15 00:00:00"

# Text that a CSV reader takes as missing by default (the pandas default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Raw catalogue columns.
RAW_COLUMNS = [
    "Date_Time_PH", "Latitude", "Longitude", "Depth_In_Km", "Magnitude",
    "Location", "General_Location",
]
REQUIRED_COLUMNS = ["Latitude", "Longitude", "Magnitude", "Depth_In_Km"]
NUMERIC_COLUMNS = ["Latitude", "Longitude", "Depth_In_Km", "Magnitude"]

# Model features, in this order; "Region" expands to its one-hot columns.
FEATURE_COLUMNS = ["Latitude", "Longitude", "Depth_In_Km", "Hour", "DayOfWeek", "Month", "Region"]

# Timestamp layouts tried in order when parsing the event time.
DEFAULT_TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss"]

# Seed used for every sample and split.
SEED = 42

# ---------------------------------------------------------------------------
# Default parameters (the three published variants differ only in these)
# ---------------------------------------------------------------------------

DBSCAN_EPS = 0.5
DBSCAN_MIN_SAMPLES = 10
TEST_FRACTION = 0.2

GBT_PARAMS = dict(maxIter=100, maxDepth=6, stepSize=0.1, seed=SEED)

PRESETS = {
    # the published variants; all cluster and chart every row
    "full": dict(silhouette=True, spread_labels=True, depth_bands=True, histogram_bins=50, point_charts=True,
                 zone_section=False),
    "simple": dict(silhouette=True, spread_labels=False, depth_bands=True, histogram_bins=None, point_charts=False,
                   zone_section=True),
    "run": dict(silhouette=False, spread_labels=False, depth_bands=False, histogram_bins=30, point_charts=True,
                zone_section=True),
}

# Parameters of the registered check queries (the quake view over ``events``)
QUERY_SAMPLE_ROWS = 5_000         # rows of the sample operator's query
QUERY_ZOOM = 10                   # finest zoom level of the map tiles
QUERY_TIGHT_EPS = 0.055           # no distance on the view's 0.01 grid equals it (no float ties)
QUERY_TIGHT_MIN_SAMPLES = 20
QUERY_HIST_BINS = 30
