"""SimHash near-dedup against brute force over all pairs."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from faultline.llm import simhash as S
from faultline.llm.queries import op8_simhash


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    g = [b" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, max_bits=4):
    p = {i: i for i in ids}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = find(ids[a]), find(ids[b])
                p[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_matches_brute_force(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    rows = {r.doc_id: r for r in op8_simhash(spark, sf001).collect()}
    ids, fps = [d.doc_id for d in docs], [brute_fp(d.text) for d in docs]
    assert {i: int(rows[i].fingerprint, 16) for i in ids} == dict(zip(ids, fps))
    assert all(len(r.fingerprint) == 16 for r in rows.values())
    assert {i: rows[i].component_id for i in ids} == brute_components(ids, fps)


@pytest.mark.parametrize("group_rows", [512, 3])
def test_links_connect_what_brute_force_connects(spark, group_rows):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(12):
            x = b
            for k in rng.integers(0, 64, rng.integers(1, 8)):
                x ^= 1 << int(k)
            fps.append(x)
    fps = sorted(set(fps) | {0, 1, (1 << 64) - 1, 1 << 63})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = S.hamming_links(df, len(fps), group_rows=group_rows).collect()
    p = {x: x for x in signed}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for r in links:
        p[max(find(r.u), find(r.v))] = min(find(r.u), find(r.v))
    expected = brute_components(fps, fps)
    groups = lambda f: {frozenset(k for k in fps if f(k) == f(x)) for x in fps}
    assert groups(lambda k: find(k - (1 << 64) if k >> 63 else k)) == groups(expected.get)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=30, unique=True), st.integers(0, 4))
def test_trie_finds_each_pair_once(values, budget):
    fps = np.sort(np.array(values, np.uint64))
    zero = np.zeros(len(fps), int)
    a, b = S.trie_links(fps, zero, zero, budget)
    got = sorted(tuple(sorted((int(fps[x]), int(fps[y])))) for x, y in zip(a, b))
    assert got == sorted((x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= budget)


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(5, text, 1), (3, text.upper(), 2), (3, text.upper(), 2), (None, text, 3), (9, None, 4), (8, "", 5),
            (7, "one two", None), (6, "École " * 4000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 8), (8, 8), (7, 7), (6, 6)], key=str)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]
    assert S.near_duplicates(docs.limit(0)).collect() == [] and S.keep_one(docs.limit(0)).collect() == []
    same = S.near_duplicates(docs.select("doc_id", "text", F.lit(1).alias("component_id")))
    assert same.count() == len(rows)


def test_keep_one_leaves_a_row_of_each_component(spark):
    """Null and shared ids: clean documents of different text stay, near copies go."""
    text = {k: " ".join(f"{k}{j}" for j in range(60)) for k in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"]), (None, text["c"]), (4, text["c"]),
            (1, text["d"]), (1, text["e"]), (2, text["f"]), (3, text["f"]), (3, text["g"]), (1, text["g"]), (5, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int")
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    want = [(None, text["a"]), (None, text["b"]), (4, text["c"]), (1, text["d"]), (1, text["e"]), (2, text["f"]),
            (1, text["g"]), (5, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    one = spark.createDataFrame([(None, text["a"], 0), (7, text["b"], 1), (7, text["a"], 2)], docs.schema)
    assert sorted((r.doc_id, r.row) for r in S.keep_one(one).collect()) == [(7, 1), (7, 2)]
