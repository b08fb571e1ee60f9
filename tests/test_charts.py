"""Map tiles (V4-V6) and the layout vote (C1) against plain counts."""

from collections import Counter, defaultdict

from faultline.operators import clean as C
from faultline.operators.charts import map_tiles


def test_tiles_match_plain_counts(spark):
    rows = [((k * 37 % 360) - 180.0, (k * 53 % 180) - 90.0, k % 7 if k % 11 else None) for k in range(900)]
    rows += [(180.0, 90.0, 1), (-180.0, -90.0, 2), (190.0, -95.0, 3), (None, 1.0, 1), (float("inf"), 1.0, 1), (0.0, float("nan"), 1)]
    got = {(r.zoom, r.tx, r.ty): (r.n, r.label, r.label_n) for r in
           map_tiles(spark.createDataFrame(rows, "Longitude double, Latitude double, label int"), "label", 5).collect()}
    tiles = defaultdict(Counter)
    for x, y, label in rows:
        if x is None or abs(x) == float("inf") or y != y:
            continue
        fx, fy = (min(31, max(0, int((v + s / 2) // (s / 32)))) for v, s in ((x, 360), (y, 180)))
        for z in range(6):
            tiles[z, fx >> (5 - z), fy >> (5 - z)][label] += 1
    want = {}
    for k, c in tiles.items():
        label, n = min(c.items(), key=lambda kv: (-kv[1], kv[0] is None, kv[0] or 0))
        want[k] = (sum(c.values()), label, n)
    assert got == want
    assert sum(n for (z, _, _), (n, _, _) in got.items() if z == 0) == 903


def test_layout_vote(spark):
    texts = ["2024-01-02 03:04", "13/02/2024 01:00", "02/13/2024 01:00", "02/03/2024 01:00", "14/03/2024 01:00", "x", None, "-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    layouts = ["MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm"]
    got = {r.layout: (r.n_parsed, r.n_only, r.chosen) for r in C.time_layout_vote(df, "t", layouts).collect()}
    assert got == {layouts[0]: (2, 1, False), layouts[1]: (3, 2, True), layouts[2]: (1, 1, False)}
    assert C.best_time_layout(df, "t", layouts) == layouts[1]
    assert C.best_time_layout(df.limit(0), "t", layouts) == layouts[0]
