"""Exact quartiles from brackets (P5) against NumPy."""

import numpy as np
import pytest

from faultline.operators import profile as P


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*cols.values(), strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)


def columns():
    rng = np.random.default_rng(1)
    n = 3001
    return {"normal": rng.normal(0, 1, n), "ties": rng.integers(0, 3, n), "heavy": rng.pareto(0.5, n),
            "one": np.full(n, 4.5), "gaps": [None if k % 5 else k / 7 for k in range(n)]}


def check(df, cols):
    got = {r.column_name: r for r in P.describe_numeric(df).collect()}
    for name, values in cols.items():
        v = np.array([x for x in values if x is not None], float)
        r = got[name]
        assert r.n == len(v) and (r.min, r.max) == (v.min(), v.max())
        assert [r.p25, r.p50, r.p75] == pytest.approx(np.quantile(v, [0.25, 0.5, 0.75]).tolist(), rel=1e-12)
        assert r.mean == pytest.approx(v.mean())


def test_matches_numpy_and_shuffles_only_brackets(spark, monkeypatch):
    cols = columns()
    inside = []
    write = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: inside.append((name, df.count())) or write(df, name))
    monkeypatch.setattr(P, "SKETCH", 200)
    check(frame(spark, **cols), cols)
    counts = [n for name, n in inside if name == "quartile-counts"]
    assert len(counts) == 1 and counts[0] < 0.2 * 3001  # three brackets of five columns


def test_a_bracket_that_misses_is_opened(spark, monkeypatch):
    cols = columns()
    real = P._bracketed
    calls = []

    def wrong(df, brackets, names):
        calls.append(len(brackets))
        return real(df, [(k, q, lo + 1e6, hi + 1e6) if len(calls) == 1 and q == "p50" else (k, q, lo, hi)
                         for k, q, lo, hi in brackets], names)

    monkeypatch.setattr(P, "_bracketed", wrong)
    check(frame(spark, **cols), cols)
    assert calls == [15, 5]


def test_small_and_empty_columns(spark):
    got = P.describe_numeric(frame(spark, a=[3, None], b=[None, None])).collect()
    assert [(r.n, r.p25, r.p75, r.std) for r in got] == [(1, 3.0, 3.0, None), (0, None, None, None)]
    two = P.describe_numeric(frame(spark, a=[1, 2])).first()
    assert (two.p25, two.p50, two.p75) == (1.25, 1.5, 1.75)
