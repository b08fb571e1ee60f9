"""Whitening against exact integers and numpy on the distinct vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import whitening as W
from faultline.llm.queries import op11_whitening


def ok(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(vectors, k=4):
    """Usable vectors -> {vector: (n, deviation)}, part of the variance, whitened up to sign."""
    dims = max(map(len, vectors))
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) + (0,) * (dims - len(v)) for v in vectors]
    fit = sorted(set(x))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    c = np.array(fit, float) - np.array([b / n for b in s])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    y = (np.array(x, float) - np.array([b / n for b in s])) @ u[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300))
    return n, dev, e[:k] / e.sum(), y


def check(rows, vectors, k=4):
    """``rows``: id -> list by component; ``vectors``: id -> vector."""
    ids = sorted(i for i, v in vectors.items() if ok(v))
    n, dev, part, y = brute([vectors[i] for i in ids], k)
    assert sorted(rows) == ids
    got = np.array([[r.whitened for r in rows[i]] for i in ids])
    for c in range(got.shape[1]):
        sign = np.sign(got[:, c] @ y[:, c])
        assert np.allclose(got[:, c], sign * y[:, c], atol=1e-9)
    for i, d in zip(ids, dev):
        assert [(r.component, r.n, r.deviation) for r in rows[i]] == [(c + 1, n, d) for c in range(got.shape[1])]
        assert np.allclose([r.explained for r in rows[i]], part, rtol=1e-9)
        assert all(0 <= r.identity_error < 1e-9 for r in rows[i])


def by_id(df, key="vec_id"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (repr(r[key]), r.component)):
        out.setdefault(r[key], []).append(r)
    return out


def frame(spark, vectors, extra=()):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 5) for i, v in vectors.items()]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, n int")


def test_query_matches_numpy(spark, sf001):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf001}/embeddings.parquet").collect()}
    check(by_id(op11_whitening(spark, sf001)), vectors)


@pytest.mark.parametrize("block", [1 << 19, 60])
def test_odd_rows_and_small_blocks(spark, monkeypatch, block):
    """Repeats, gaps, odd lengths; with blocks of 10 rows and one middle split for each two."""
    monkeypatch.setattr(W, "BLOCK_NUMBERS", block)
    monkeypatch.setattr(W, "MID_BLOCKS", 2)
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (150, 6)) * [5, 4, 3, 2, 1, 0.5] + 1000
    vectors = dict(enumerate(map(list, base)))
    vectors |= {200 + k: list(base[7]) for k in range(80)}  # many equal ones weigh once
    vectors |= {300: None, 301: [None] * 6, 302: [1.0, float("nan"), 0, 0, 0, 0], 303: [float("inf")] + [0.0] * 5,
                304: [-float("inf")] + [0.0] * 5, 305: [1000.0] * 3, 306: [-0.0] * 6, 307: [], 308: [1000.0] * 5 + [None]}
    df = W.whiten(frame(spark, vectors).repartition(5))
    assert df.columns == ["vec_id", "embedding", "n", "deviation", "component", "whitened", "explained", "identity_error"]
    check(by_id(df), vectors)


def test_fewer_dimensions_than_components_and_floor(spark):
    vectors = {k: [k * 0.0039, -k * k * 0.01] for k in range(1, 30)}
    rows = by_id(W.whiten(frame(spark, vectors)))
    assert {len(r) for r in rows.values()} == {2}
    check(rows, vectors, 2)


def test_no_variance(spark):
    one = by_id(W.whiten(frame(spark, {k: [1.0, 2.0] for k in range(3)})))
    assert all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 and r.n == 1
               for rows in one.values() for r in rows) and len(one) == 3
    line = by_id(W.whiten(frame(spark, {k: [k, 2.0 * k, 0.0] for k in range(9)})))
    for rows in line.values():
        assert rows[0].whitened is not None and rows[1].whitened is rows[2].whitened is None
        assert rows[0].explained == pytest.approx(1) and rows[0].identity_error < 1e-12


def test_beyond_long(spark):
    rows = by_id(W.whiten(frame(spark, {0: [3e38, 1.0], 1: [-3e38, 2.0], 2: [1e10, 5.0], 3: [0.0, 0.0]})))
    assert all(r.deviation is None and r.n == 4 and r.whitened is not None for r in [rows[0][0], rows[1][0]])
    rows = by_id(W.whiten(frame(spark, {0: [1e7, 1.0], 1: [0.0, 1.0]})))
    assert [rows[k][0].deviation for k in (0, 1)] == [(256 * 10**7) ** 2] * 2


def test_empty_and_null_ids(spark):
    for vectors in ({}, {1: None}, {1: [], 2: []}):
        df = W.whiten(frame(spark, vectors))
        assert df.count() == 0 and "whitened" in df.columns
    rows = [(None, [1.0, 2.0], 0), (None, [3.0, 1.0], 0), (None, [3.0, 1.0], 0), (4, [0.0, 9.0], 0)]
    got = W.whiten(frame(spark, {}, rows))
    assert got.count() == 8 and got.where(F.col("vec_id").isNull()).count() == 6
