"""DBSCAN, components, within-distance counts, nearest label and squared silhouette."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import boxes as B
from faultline.operators import components
from faultline.operators import spatial as Z
from faultline.operators import tiles
from faultline.operators.clean import clean_catalog
from faultline.sources.catalog import VIEW_CUTOFF, quake_view


def brute_dbscan(keys, xy, eps, min_samples):
    """Reference DBSCAN by the definition: scan in key order, clusters numbered in order."""
    order = np.argsort(keys)
    keys, xy = np.asarray(keys)[order], np.asarray(xy)[order]
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    nb = d2 <= eps * eps
    core = nb.sum(1) >= min_samples
    labels = np.full(len(keys), -1)
    zone = 0
    for i in range(len(keys)):
        if labels[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if labels[j] != -1:
                continue
            labels[j] = zone
            if core[j]:
                stack.extend(np.nonzero(nb[j] & (labels == -1))[0].tolist())
        zone += 1
    return dict(zip(keys.tolist(), labels.tolist()))


def pts(spark, rows):
    return spark.createDataFrame(rows, "quake_id long, Latitude double, Longitude double")


def labels_of(df):
    return {r.quake_id: r.Cluster for r in df.select("quake_id", "Cluster").collect()}


def test_inclusive_distance_one_zone(spark):
    rows = [(i, 0.0, 0.0) for i in range(10)] + [(10, 0.0, 0.5)]
    got = labels_of(Z.dbscan(pts(spark, rows), eps=0.5, min_samples=10))
    assert set(got.values()) == {0}


def test_min_samples_counts_itself(spark):
    nine = [(i, 0.0, 0.0) for i in range(9)]
    assert set(labels_of(Z.dbscan(pts(spark, nine), eps=0.5, min_samples=10)).values()) == {-1}
    ten = nine + [(9, 0.0, 0.0)]
    assert set(labels_of(Z.dbscan(pts(spark, ten), eps=0.5, min_samples=10)).values()) == {0}


def test_dbscan_matches_brute_force_with_borders(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    rows = clean.select("quake_id", "Latitude", "Longitude").collect()
    want = brute_dbscan([r[0] for r in rows], [(r[1], r[2]) for r in rows], 0.055, 6)
    got = labels_of(Z.dbscan(clean, eps=0.055, min_samples=6))
    assert got == want
    assert len(set(want.values())) > 10  # many zones, border points and noise are exercised


def test_dbscan_order_free(spark, sf001):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF).select("quake_id", "Latitude", "Longitude")
    a = labels_of(Z.dbscan(clean, eps=0.5, min_samples=10))
    b = labels_of(Z.dbscan(clean.repartition(5).orderBy(F.rand(7)), eps=0.5, min_samples=10))
    assert a == b
    assert len({v for v in a.values() if v >= 0}) == 6 and list(a.values()).count(-1) == 9


def test_within_distance_counts(spark):
    rng = np.random.default_rng(1)
    xy = np.round(rng.uniform(0, 1, (300, 2)), 2)
    df = pts(spark, [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)])
    got = {r.quake_id: r.n_within for r in Z.within_distance_counts(df, eps=0.1).collect()}
    d2 = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    want = dict(enumerate((d2 <= 0.1 * 0.1).sum(1).tolist()))
    assert got == want


def test_nearest_label_tie_smaller_key(spark):
    lab = spark.createDataFrame([(5, 0.0, 0.0, 1), (3, 0.0, 2.0, 2)],
                                "quake_id long, Latitude double, Longitude double, Cluster int")
    q = pts(spark, [(100, 0.0, 1.0), (101, 0.0, 0.1), (102, 50.0, 50.0)])
    got = labels_of(Z.nearest_label(q, lab))
    assert got == {100: 2, 101: 1, 102: 2}


def test_nearest_label_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    lab_xy = rng.uniform(0, 10, (200, 2))
    q_xy = np.vstack([rng.uniform(-5, 15, (400, 2)), [[100.0, 100.0]]])
    lab = spark.createDataFrame([(i, float(x), float(y), int(i % 7)) for i, (x, y) in enumerate(lab_xy)],
                                "quake_id long, Latitude double, Longitude double, Cluster int")
    q = pts(spark, [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate(q_xy)])
    got = labels_of(Z.nearest_label(q, lab))
    d2 = ((q_xy[:, None, :] - lab_xy[None, :, :]) ** 2).sum(-1)
    want = {1000 + i: int(np.argmin(row) % 7) for i, row in enumerate(d2)}
    assert got == want


def brute_silhouette(xy, lab):
    xy, lab = np.asarray(xy), np.asarray(lab)
    d = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(xy)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == other].mean() for other in set(lab.tolist()) - {lab[i]})
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def labelled_points(spark, xy, lab):
    return spark.createDataFrame([(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(xy, lab))],
                                 "quake_id long, Latitude double, Longitude double, Cluster int")


def test_silhouette_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(6, 1, (50, 2)), [[20.0, 20.0]], rng.normal(3, 4, (40, 2))])
    lab = [0] * 60 + [1] * 50 + [-1] + [2] * 40
    got = Z.silhouette_squared(labelled_points(spark, xy, lab)).first()
    assert abs(got["silhouette_squared"] - brute_silhouette(xy, lab)) < 1e-9 and got["n"] == len(lab)


def test_silhouette_of_one_label_and_of_none(spark):
    df = labelled_points(spark, [(0, 0), (1, 1)], [3, 3])
    assert tuple(Z.silhouette_squared(df).first()) == (0.0, 2)
    assert tuple(Z.silhouette_squared(df.limit(0)).first()) == (None, 0)
    pairs = labelled_points(spark, [(0, 0), (0, 0.01), (9, 9), (9, 9.01)], [0, 0, 1, 1])
    assert Z.silhouette_squared(pairs).first()["silhouette_squared"] > 0.99


def test_arched_path_converges_in_few_rounds(spark, monkeypatch):
    """Ids that rise and then fall along a path."""
    n = 2000
    ids = [*range(0, n, 2), *range(n - 1, 0, -2)]
    rounds = []
    write = components.materialize_observed
    monkeypatch.setattr(components, "materialize_observed", lambda *a, **k: rounds.append(a[1]) or write(*a, **k))
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == dict.fromkeys(range(1, n), 0)
    assert rounds.count("cc-edges") < 20


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (180, 2))] + [("n0", f"n{k}") for k in range(100, 160)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([*pairs, (None, "n1"), ("n7", "n7")], "src string, dst string")
    got = {r.node: r.component for r in components.connected_components(edges, "src", "dst").collect()}
    assert got == {x: find(x) for x in p if find(x) != x}
    assert components.connected_components(edges.limit(0), "src", "dst").count() == 0


def test_arched_chain_is_one_zone(spark):
    """A chain of cells whose numbers rise and fall, linked by sure and by tested pairs."""
    t = np.linspace(0, np.pi, 160)
    rows = [(i, float(4 * np.sin(a)), float(4 * np.cos(a))) for i, a in enumerate(t)]
    got = labels_of(Z.dbscan(pts(spark, rows), eps=0.1, min_samples=2))
    assert set(got.values()) == {0}


def hot_points(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, 1.5, 2.5) if i % 3 == 0 else (i, *map(float, rng.uniform(0, 4, 2))) for i in range(n)]


def test_nearest_label_on_a_hot_coordinate(spark, monkeypatch):
    """A third of both sides at one place: the join meets positions, not rows."""
    lab = [(i, x, y, i % 5) for i, x, y in hot_points(300, 1)]
    q = [(1000 + i, x, y) for i, x, y in hot_points(600, 2)]
    sizes = []
    write = Z.materialize_observed

    def watched(df, name, **k):
        sizes.append((name, df.count()))
        return write(df, name, **k)

    monkeypatch.setattr(Z, "materialize_observed", watched)
    got = labels_of(Z.nearest_label(pts(spark, q), labelled_points(spark, [r[1:3] for r in lab], [r[3] for r in lab])))
    xy = np.array([r[1:3] for r in lab])
    want = {i: lab[int(np.argmin(((xy - (x, y)) ** 2).sum(1)))][3] for i, x, y in q}
    assert got == want
    assert max(n for _, n in sizes) <= 401  # distinct positions


def test_nearest_label_on_one_meridian(spark, monkeypatch):
    rounds = []
    write = Z.materialize_observed
    monkeypatch.setattr(Z, "materialize_observed", lambda *a, **k: rounds.append(a[1]) or write(*a, **k))
    lab = labelled_points(spark, [(k / 100, 125.0) for k in range(400)], range(400))
    q = pts(spark, [(k, k / 50 + 0.001, 125.0 + (k % 3) / 10) for k in range(200)])
    got = labels_of(Z.nearest_label(q, lab))
    assert got == {k: min(399, 2 * k) for k in range(200)}
    assert rounds.count("nearest-home") == 1 and len(rounds) <= 3


def test_one_place_and_infinite_coordinates(spark):
    inf = float("inf")
    lab = labelled_points(spark, [(1.0, 1.0), (1.0, 1.0), (inf, 0.0)], [4, 5, 6])
    q = pts(spark, [(1, 50.0, -50.0), (2, inf, 0.0), (3, None, 1.0), (4, 1.0, 1.0)])
    assert labels_of(Z.nearest_label(q, lab)) == {1: 4, 2: None, 3: None, 4: 4}
    assert labels_of(Z.dbscan(q, eps=0.5, min_samples=1)) == {1: 0, 2: None, 3: None, 4: 1}
    assert labels_of(Z.nearest_label(q, lab.limit(0))) == {1: None, 2: None, 3: None, 4: None}


def test_written_steps_are_equi_joins(spark, monkeypatch):
    """The plan of every table written on the way, not only of the result."""
    plans = []

    def planned(module, name):
        write = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, **k: plans.append(
            df._jdf.queryExecution().executedPlan().toString()) or write(df, *a, **k))

    planned(Z, "materialize")
    planned(Z, "materialize_observed")
    planned(components, "materialize_observed")
    rng = np.random.default_rng(3)
    df = pts(spark, [(i, *map(float, rng.uniform(0, 3, 2))) for i in range(250)])
    lab = Z.dbscan(df, eps=0.25, min_samples=4)
    Z.within_distance_counts(df, eps=0.25).count()
    Z.nearest_label(df, lab).count()
    Z.silhouette_squared(lab).count()
    assert len(plans) > 12 and any("Join" in p for p in plans)
    assert not any(bad in p for p in plans for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"))


def watch_metrics(monkeypatch):
    """What each observed write says, by name."""
    seen = []
    write = Z.materialize_observed

    def watched(df, name, *a, **k):
        out = write(df, name, *a, **k)
        seen.append((name, out[1]))
        return out

    monkeypatch.setattr(Z, "materialize_observed", watched)
    return seen


@pytest.fixture()
def small_leaves(monkeypatch):
    """Boxes of two positions, so that every split is taken."""
    monkeypatch.setattr(Z, "LEAF", 2)
    monkeypatch.setattr(Z, "PAIR_LEAF", 4)


def test_far_queries_meet_few_sites_of_a_dense_cluster(spark):
    """Sixty degrees away, a query meets a bounded number of sites, however many there are."""
    rng = np.random.default_rng(4)
    for n in (1000, 16000):
        xy = rng.normal(0, 0.05, (n, 2))
        far = rng.uniform(-5, 5, (100, 2)) + [60, 60]
        sites = spark.createDataFrame([(float(x), float(y), 0.0, k, k) for k, (x, y) in enumerate(xy)],
                                      "sx double, sy double, extra double, rank int, pay int")
        queries = spark.createDataFrame([(float(x), float(y)) for x, y in far], "qx double, qy double")
        side, fx, fy, top = Z.site_grid(sites, 4.0)
        at = sites.withColumns({"cx": B.cell(F.col("sx"), side) - fx, "cy": B.cell(F.col("sy"), side) - fy})
        none = F.lit(None).cast("struct<cost:double,rank:int,pay:int>").alias("best")
        met = Z.meet_sites(queries.select("*", none), ["qx", "qy"], at, top, False).groupBy("qx", "qy").count().collect()
        assert len(met) == 100 and max(r["count"] for r in met) < 100
        got = {(r.qx, r.qy): r.best.pay for r in Z.nearest_site(queries, sites).collect()}
        d = ((far[:, None, :] - xy[None, :, :]) ** 2).sum(-1)
        assert got == {(float(x), float(y)): int(np.argmin(r)) for (x, y), r in zip(far, d)}


def test_nearest_of_mixed_densities_and_ties(spark):
    rng = np.random.default_rng(8)
    lab_xy = np.vstack([rng.normal(0, 0.01, (300, 2)), rng.uniform(-50, 50, (60, 2)), np.round(rng.uniform(5, 9, (200, 2)))])
    q_xy = np.vstack([rng.uniform(-60, 60, (300, 2)), np.round(rng.uniform(4, 10, (100, 2)) * 2) / 2, lab_xy[::9]])
    lab = labelled_points(spark, lab_xy, [k % 11 for k in range(len(lab_xy))])
    got = labels_of(Z.nearest_label(pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(q_xy)]), lab))
    d = ((q_xy[:, None, :] - lab_xy[None, :, :]) ** 2).sum(-1)
    assert got == {k: int(np.argmin(r) % 11) for k, r in enumerate(d)}


def test_silhouette_of_many_labels(spark):
    rng = np.random.default_rng(2)
    xy, lab = rng.uniform(0, 30, (400, 2)), rng.integers(0, 120, 400).tolist()
    got = Z.silhouette_squared(labelled_points(spark, xy, lab)).first()
    assert abs(got["silhouette_squared"] - brute_silhouette(xy, lab)) < 1e-9


@pytest.mark.parametrize("leaf", [2, 32])
def test_within_distance_between_two_tables(spark, monkeypatch, leaf):
    monkeypatch.setattr(Z, "LEAF", leaf)
    rng = np.random.default_rng(6)
    b = np.vstack([rng.normal(1, 0.02, (400, 2)), rng.uniform(0, 2, (150, 2)), np.tile([[1.5, 1.5]], (50, 1))])
    a = np.vstack([rng.uniform(-0.5, 2.5, (200, 2)), b[::20]])
    rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(a)] + [(900, None, 1.0), (901, float("inf"), 1.0)]
    got = {r.quake_id: r.n_within for r in Z.within_distance_between(
        pts(spark, rows), pts(spark, [(7, None, None), *((k, float(x), float(y)) for k, (x, y) in enumerate(b))]),
        eps=0.1).collect()}
    dx, dy = a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]
    want = dict(enumerate((dx * dx + dy * dy <= 0.1 * 0.1).sum(1).tolist()))
    assert got == {**want, 900: None, 901: None} and 0 in got.values()
    none = Z.within_distance_between(pts(spark, rows[:3]), pts(spark, rows[:0]), eps=0.1)
    assert [r.n_within for r in none.collect()] == [0, 0, 0]


def test_a_dense_cell_costs_what_the_edge_cuts(spark, monkeypatch):
    """Boxes met for each position grow with the circle's edge, not with the cell's content."""
    cut = []
    for n in (4000, 16000):
        seen = watch_metrics(monkeypatch)
        rng = np.random.default_rng(n)
        df = pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(0, 0.1, (n, 2)))])
        assert Z.within_distance_counts(df, eps=0.1).count() == n
        cut.append(sum(m["n"] for name, m in seen if name == "within-cut") / n)
        monkeypatch.undo()
    assert cut[1] < 2.5 * cut[0]  # four times the positions


def test_dbscan_by_splits_matches_brute_force(spark, sf001, small_leaves):
    clean = clean_catalog(quake_view(spark, sf001), cutoff=VIEW_CUTOFF)
    rows = clean.select("quake_id", "Latitude", "Longitude").collect()
    want = brute_dbscan([r[0] for r in rows], [(r[1], r[2]) for r in rows], 0.055, 6)
    assert labels_of(Z.dbscan(clean, eps=0.055, min_samples=6)) == want
    rng = np.random.default_rng(12)
    xy = np.vstack([rng.uniform(0, 3, (250, 2)), rng.normal(1, 0.05, (150, 2))])
    got = labels_of(Z.dbscan(pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(xy)]), eps=0.2, min_samples=3))
    assert got == brute_dbscan(list(range(len(xy))), xy, 0.2, 3)


def test_dense_unlinked_cells_compare_in_proportion(spark, monkeypatch):
    """Two dense cells whose boxes are near and whose points, in facing triangles, are just
    farther apart than eps: the compared pairs grow with the points."""
    eps, compared = 0.5, []
    for n in (6000, 50000):
        seen = watch_metrics(monkeypatch)
        rng = np.random.default_rng(n)
        a, b = rng.uniform(0, 0.17, (2, n, 2))
        a = np.where(a.sum(1, keepdims=True) > 0.17, 0.17 - a, a)
        b = np.where(b.sum(1, keepdims=True) < 0.17, 0.17 - b, b) + 0.3538
        df = pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(np.vstack([a, b]))])
        got = labels_of(Z.dbscan(df, eps=eps, min_samples=10))
        assert {got[0], got[n]} == {0, 1} and set(got.values()) == {0, 1}
        compared.append(sum(m["compared"] or 0 for name, m in seen if name == "dbscan-open") / n)
        assert any(name == "dbscan-split" for name, _ in seen)
        monkeypatch.undo()
    assert compared[1] < 4 * max(compared[0], 100)


def test_dense_linked_cells_end_early(spark):
    rng = np.random.default_rng(9)
    xy = np.vstack([rng.uniform(0, 0.17, (5000, 2)), rng.uniform(0, 0.17, (5000, 2)) + [0.5, 0]])
    got = labels_of(Z.dbscan(pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(xy)]), eps=0.5, min_samples=10))
    assert set(got.values()) == {0}


def test_local_stars_match_union_find(spark):
    rng = np.random.default_rng(21)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (700, 2))]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "u long, v long").repartition(6)
    plain = {r.node: r.component for r in components.connected_components(df).collect()}
    assert plain == {r.node: r.component for r in components.connected_components(df, local=True).collect()}
    assert components.connected_components(df.limit(0), local=True).count() == 0


def shuffled(df):
    """Records that the shuffles of a frame write when it is run."""
    df.collect()

    def of(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(of(below.apply(k)) for k in range(below.size()))

    return of(df._jdf.queryExecution().executedPlan())


def records_sent(spark, monkeypatch, xy):
    """Records that the steps of a count of neighbours shuffle, without broadcasts."""
    sent = []
    for name in ("materialize", "materialize_observed"):
        write = getattr(Z, name)
        monkeypatch.setattr(Z, name, lambda df, *a, write=write, **k: sent.append(shuffled(df)) or write(df, *a, **k))
    df = pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(xy)])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert Z.within_distance_counts(df, eps=0.1).count() == len(xy)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return sum(sent)


def test_within_distance_shuffles_a_position_a_few_times(spark, monkeypatch):
    """Not once for every box that its circle meets: disk grows with the rows."""
    xy = np.random.default_rng(5).uniform(0, 0.6, (8000, 2))
    assert records_sent(spark, monkeypatch, xy) < 8 * len(xy)


def test_within_distance_of_a_hot_place_in_cut_tiles(spark, monkeypatch):
    """A third of the rows at one place, and tiles that must be cut."""
    monkeypatch.setattr(tiles, "MOST", 4000)
    xy = np.random.default_rng(6).uniform(0, 0.6, (8000, 2))
    xy[::3] = [0.25, 0.125]
    assert records_sent(spark, monkeypatch, xy) < 8 * len(xy)


@pytest.mark.parametrize("most", [60, 400])
def test_within_distance_by_cut_tiles(spark, monkeypatch, most):
    """Tiles of several levels, and places too dense for any, in one table and between two."""
    monkeypatch.setattr(tiles, "MOST", most)
    rng = np.random.default_rng(7)
    b = np.vstack([rng.normal(1, 0.03, (500, 2)), rng.uniform(0, 2, (300, 2)), rng.uniform(-3, -2, (40, 2)), [[1e200, 0.0]]])
    a = np.vstack([rng.uniform(-0.5, 2.5, (150, 2)), b[::9], [[1e200, 0.0], [0.0, -1e200]]])
    frame = [pts(spark, [(k, float(x), float(y)) for k, (x, y) in enumerate(xy)]) for xy in (a, b)]

    def brute(p, q):
        with np.errstate(over="ignore"):
            dx, dy = p[:, None, 0] - q[None, :, 0], p[:, None, 1] - q[None, :, 1]
            return dict(enumerate((dx * dx + dy * dy <= 0.1 * 0.1).sum(1).tolist()))

    assert {r.quake_id: r.n_within for r in Z.within_distance_counts(frame[1], eps=0.1).collect()} == brute(b, b)
    assert {r.quake_id: r.n_within for r in Z.within_distance_between(*frame, eps=0.1).collect()} == brute(a, b)


@pytest.mark.parametrize("shift", [0.0, 122.0, -1e9])
def test_near_sums_match_brute_force(monkeypatch, shift):
    """Grids whose distances equal eps, lines, clusters an eps apart, and slices of a few places."""
    rng = np.random.default_rng(9)
    monkeypatch.setattr(tiles, "_FEW", 0)
    for few in (False, True):
        if few:
            monkeypatch.setattr(tiles, "_PROBES", 7)
            monkeypatch.setattr(tiles, "_SLICE", 11)
        for q in (rng.uniform(0, 1, (500, 2)), np.round(rng.uniform(0, 1, (400, 2)), 1), rng.uniform(0, 1e-7, (300, 2)),
                  np.column_stack([rng.uniform(0, 1, 300), np.full(300, 0.5)]), np.array([[0.5, 0.5]])):
            for p in (rng.uniform(0, 1, (200, 2)), q[::2] + [0.0, 0.25], q[::3] + [0.25, 0.0], q):
                p, places, val = p + shift, q + shift, rng.integers(1, 5, len(q))
                dx, dy = p[:, None, 0] - places[None, :, 0], p[:, None, 1] - places[None, :, 1]
                want = np.where(dx * dx + dy * dy <= 0.25 * 0.25, val, 0).sum(1)
                got, _ = tiles.near_sums(*p.T, *places.T, val, 0.25)
                assert got.tolist() == want.tolist()
