"""Line dedup against brute-force Jaccard similarity over all pairs of lines."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultline.llm import line_dedup as L
from faultline.llm.queries import op6_line_dedup

SPACE = " \t\n\v\f\r"


def shingles(x):
    return {x[k:k + 8] for k in range(len(x) - 7)} or {x.ljust(8, "\0")}


def brute(docs, threshold=0.8):
    """{(doc, line_no): place kept} for documents [(id, text)]."""
    places = {}
    for i, t in docs:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(SPACE):
                places.setdefault(x.strip(SPACE), []).append((i, k))
    lines = sorted(places)
    sets = [shingles(x) for x in lines]
    p = list(range(len(lines)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            short, long = sorted((len(sets[a]), len(sets[b])))
            if short >= threshold * long:
                n = len(sets[a] & sets[b])
                if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                    p[find(a)] = find(b)
    first = {}
    for k, x in enumerate(lines):
        first[find(k)] = min(first.get(find(k), places[x][0]), *places[x])
    return {q: first[find(k)] for k, x in enumerate(lines) for q in places[x]}


def test_query_matches_brute_force(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    want = brute(docs)
    rows = op6_line_dedup(spark, sf001).collect()
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in rows}
    assert got.keys() == want.keys() and len(rows) == len(got)
    wrong = [k for k in want if got[k] != want[k]]
    assert len(wrong) <= 0.001 * len(want), wrong[:5]
    assert all(r.kept == (got[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in rows)
    assert sum(want[k] != k for k in want) > 20


def near_copies(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    base = list(rng.choice(words, 60))
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 7)):
            w[k] = words[rng.integers(0, 300)]
        out.append(" ".join(w))
    return out


def test_cut_groups_lose_no_link(spark):
    """Blocks of four lines: groups are cut, and lines beyond their pivot's reach compared."""
    lines = near_copies(60, 1) + near_copies(30, 2)
    docs = [(k, f"{x}\nown line number {k * 7919} of this one") for k, x in enumerate(lines)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {(r._doc, r._line_no): tuple(r._first) for r in L.line_classes(df, block=1000).collect()}
    cut = {(r._doc, r._line_no): tuple(r._first) for r in L.line_classes(df, block=4).collect()}
    assert whole == cut
    want = brute(docs)
    assert sum(whole[k] != want[k] for k in want) <= 3  # the bands' recall


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab c", min_size=1, max_size=30), min_size=2, max_size=8, unique=True), st.sampled_from([0.5, 0.8]))
def test_pairs_are_exact(lines, threshold):
    few, L._FEW = L._FEW, len(lines) % 2 * 9  # both ways
    x, y = L.similar_pairs(lines, threshold)
    L._FEW = few
    want = [(a, b) for b in range(len(lines)) for a in range(b)
            if len(shingles(lines[a]) & shingles(lines[b])) >= threshold * len(shingles(lines[a]) | shingles(lines[b])) - 1e-9]
    assert sorted(zip(x.tolist(), y.tolist())) == sorted(want)


def test_pairs_in_slices(monkeypatch):
    lines = near_copies(12, 5)
    whole = [v.tolist() for v in L.similar_pairs(lines)]
    monkeypatch.setattr(L, "_SLICE", 500)
    monkeypatch.setattr(L, "_COLUMNS", 16)
    assert [v.tolist() for v in L.similar_pairs(lines)] == whole


def test_recall_of_the_bands():
    rng = np.random.default_rng(2)
    hit = total = 0
    for seed in range(60):
        a, b = near_copies(2, seed + 100)
        s = [shingles(x) for x in (a, b)]
        if a != b and len(s[0] & s[1]) >= 0.8 * len(s[0] | s[1]):
            total += 1
            sig = L.signatures([a, b])
            hit += bool((sig[0] == sig[1]).any())
    assert total > 10 and hit >= 0.95 * total
    assert len(set(L.signatures(["x" * 20 + str(rng.random()) for _ in range(50)])[:, 0])) > 1


def test_filter_has_no_misses(spark):
    v = spark.range(5000).select(F.xxhash64("id").alias("v"))
    f = L.bloom(v, 5000)
    assert f(np.array([r.v for r in v.collect()], np.int64)).all()
    other = np.random.default_rng(0).integers(-1 << 63, (1 << 63) - 1, 20_000)
    assert f(other).mean() < 0.05


def rows_collected(spark, monkeypatch):
    """Counts of the rows that the driver collects from now on."""
    got, kind = [], type(spark.range(0))
    for name in ("collect", "toPandas"):
        def counted(self, *a, read=getattr(kind, name)):
            out = read(self, *a)
            got.append(len(out))
            return out
        monkeypatch.setattr(kind, name, counted)
    return got


def test_filter_reaches_the_driver_packed(spark, monkeypatch):
    """Not as a row for each of its words, which filled the driver's memory."""
    v = spark.range(100_000).select(F.xxhash64("id").alias("v")).persist()
    values = np.array([r.v for r in v.collect()], np.int64)
    got = rows_collected(spark, monkeypatch)
    f = L.bloom(v, len(values))
    assert len(f.words) == 1 << 15 and f(values).all()
    assert sum(got) < 100
    assert not L.bloom(v.limit(0), 0).words.any()


def test_odd_rows(spark):
    long = "a line that stands in several documents and is long enough to be fuzzy, more or less."
    rows = [(5, f"{long}\n\nown five", 1), (3, f"x\n  {long} ", 2), (7, long + "!", 3), (8, None, 4), (9, "", 5), (10, " \n", 6),
            (3, f"x\n  {long} ", 2), (None, long, None), (11, "own\n" * 3, 7), (12, "é" * 100_000 + "\nlast", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _line_no int").withColumn("n_chars", F.lit(0))
    out = L.dedup_lines(docs, length_col="n_chars")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(5, "\nown five"), (3, f"x\n  {long} "), (3, f"x\n  {long} "), (8, None), (9, ""), (10, " \n"),
                          (None, long), (11, "own\n"), (12, "é" * 100_000 + "\nlast")], key=str)
    assert {r.doc_id: r.n_chars for r in out.collect()}[11] == 4
    assert L.dedup_lines(docs.limit(0)).collect() == []
    assert L.line_classes(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["_doc", "_line", "component", "members"])
def test_clashing_columns(spark, name):
    docs = spark.createDataFrame([(1, "one two three", 1), (2, "one two three", 2)], f"doc_id long, text string, {name} int")
    assert [r.doc_id for r in L.dedup_lines(docs).collect()] == [1]


def test_rows_that_share_an_id_lose_only_their_own_lines(spark):
    a, c = "the line that stands in another document as well.", "a clean line that stands nowhere else at all."
    rows = [(1, a), (2, f"{a}\nown line of the second row."), (2, f"{c}\n{a}"), (2, c + " It is here too.")]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.text for r in out.collect()) == sorted([a, "own line of the second row.", c, c + " It is here too."])


def test_filters_that_let_everything_through_change_nothing(spark, sf001, monkeypatch):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")

    def rows():
        return sorted(map(tuple, L.line_classes(docs).select("_doc", "_line_no", "_first", "_many").collect()))

    want = rows()
    monkeypatch.setattr(L.Filter, "__call__", lambda self, values: np.ones(len(values), bool))
    assert rows() == want
