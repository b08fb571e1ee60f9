"""Certified silhouette bounds (Z2) against the exact score of all pairs."""

import numpy as np
import pytest

from faultline.operators import silhouette as S


def exact(xy, lab):
    xy, lab = np.asarray(xy, float), np.asarray(lab)
    d = np.sqrt(((xy[:, None, :] - xy[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(xy)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == other].mean() for other in set(lab.tolist()) - {lab[i]})
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def points(spark, xy, lab):
    return spark.createDataFrame([(float(x), float(y), None if c is None else int(c)) for (x, y), c in zip(xy, lab)],
                                 "Latitude double, Longitude double, Cluster int")


def cases():
    rng = np.random.default_rng(5)
    zones = np.vstack([rng.normal(0, 1, (60, 2)), rng.normal(6, 1, (50, 2)), [[20.0, 20.0]], rng.normal(3, 4, (40, 2))])
    yield "zones", zones, [0] * 60 + [1] * 50 + [7] + [-1] * 40
    yield "mixed", rng.uniform(0, 1, (200, 2)), rng.integers(0, 4, 200).tolist()
    yield "repeats", np.repeat(np.round(rng.uniform(0, 1, (20, 2)), 1), 9, axis=0), [k % 3 for k in range(180)]
    yield "many labels", rng.uniform(-9, 9, (150, 2)), rng.integers(0, 60, 150).tolist()
    yield "far", np.vstack([rng.normal(0, 1e-4, (80, 2)), rng.normal(50, 1e-3, (80, 2))]), [0] * 80 + [1] * 80


@pytest.mark.parametrize(("name", "xy", "lab"), list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_exact_score_lies_between(spark, name, xy, lab):
    want = exact(xy, lab)
    for width in (0.2, 0.01):
        b = S.silhouette_bounds(points(spark, xy, lab), width).first()
        assert b.lower <= want <= b.upper and b.n == len(lab)
        assert b.upper - b.lower <= width + 1e-8


def test_one_label_no_rows_one_place(spark):
    assert tuple(S.silhouette_bounds(points(spark, [(0, 0), (1, 1)], [3, 3])).first()) == (0.0, 0.0, 2)
    assert tuple(S.silhouette_bounds(points(spark, [(0, 0)], [1]).limit(0)).first()) == (None, None, 0)
    assert tuple(S.silhouette_bounds(points(spark, [(2, 2)] * 4, [0, 0, 1, 1])).first()) == (0.0, 0.0, 4)
    df = points(spark, [(0, 0), (0, 0.1), (9, 9), (float("inf"), 1), (9, 9.1), (1, 1)], [0, 0, 1, 1, 1, None])
    assert S.silhouette_score(df, 3).first().silhouette == round(exact([(0, 0), (0, 0.1), (9, 9), (9, 9.1)], [0, 0, 1, 1]), 3)


def test_work_follows_the_width_not_the_rows(spark, monkeypatch):
    """Sixteen times the rows meet about as many cells."""
    rows = []
    write = S.materialize_observed

    def watched(df, name, **k):
        out = write(df, name, **k)
        if name == "silhouette-level":
            rows[-1] += out[0].count()
        return out

    monkeypatch.setattr(S, "materialize_observed", watched)
    for n in (4000, 64000):
        rng = np.random.default_rng(n)
        xy = np.vstack([rng.normal(0, 1, (n, 2)), rng.normal(12, 1, (n, 2))])
        rows.append(0)
        b = S.silhouette_bounds(points(spark, xy, [0] * n + [1] * n), 0.2).first()
        assert 0.7 < b.lower <= b.upper < 1
    assert rows[1] < 4 * rows[0]
