"""Mixing: targets, blocks and schedule against a plain version of each."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing as MIX
from faultline.llm.queries import op13_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, share=1.5, epochs=2):
    """Shares by weight; stop, reshare, until none is above."""
    total, stopped = share * sum(sizes.values()), set()
    while True:
        rest = total - epochs * sum(sizes[s] for s in stopped)
        whole = sum(w for s, w in weights.items() if s not in stopped)
        target = {s: epochs * sizes[s] if s in stopped else weights[s] * rest / whole for s in sizes}
        above = {s for s in sizes if s not in stopped and target[s] > epochs * sizes[s]}
        if not above:
            return target
        stopped |= above


def brute_taken(rows, weights=(5, 2, 1), seed=13, epochs=2):
    """(id, text, source) rows -> a sorted list of (id, size, source size, target, taken)."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = brute_targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, epochs=epochs)
    out = []
    for s in order:
        mine = [(hashlib.md5(f"{seed}:{'' if i is None else i}:{t or ''}".encode()).hexdigest(),
                 i, len(WORD.findall(t or ""))) for i, t, x in rows if x == s]
        mine.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        quota, at = math.floor(target[s] + 0.5), 0
        for _, i, n in mine:
            taken = sum(max(0, min(n, quota - e * sizes[s] - at)) for e in range(epochs))
            out.append((i, n, sizes[s], target[s], taken))
            at += n
    return sorted(out, key=repr)


ROWS = [(k, " ".join(f"w{j}" for j in range(k * 7919 % 97)), f"s{k % 5}") for k in range(300)] \
    + [(300, "long " * 9000, "s0"), (301, None, "s1"), (302, "", "s2"), (303, " \t\n", None), (304, "a b c", None),
       (305, "tiny", "é"), (306, None, "empty"), (None, "no id", "s3"), (None, "no id", "s3"), (None, "other", "s3"),
       *[(307, "equal rows here", "s4")] * 50, (307, "equal rows not", "s4"), (308, "x y", ""), (309, "z z", "\U0001f600")]


@pytest.fixture()
def small(monkeypatch):
    """Buckets, stretches and steps so small that all of them are cut."""
    for name, value in (("BUCKET_ROWS", 8), ("STRETCH", 4), ("COPIES", 3)):
        monkeypatch.setattr(MIX, name, value)


def planned(spark, rows=ROWS, **kw):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    return MIX.plan_mix(docs.repartition(3), block_words=16, **kw)


def test_taken_matches_a_plain_scan(spark, small):
    got = MIX.taken_words(planned(spark)).select("id", "size", "source_size", "target", "taken").collect()
    want = brute_taken(ROWS)
    assert [r[:3] + r[4:] for r in sorted(map(tuple, got), key=repr)] == [r[:3] + r[4:] for r in want]
    for g, w in zip(sorted(map(tuple, got), key=repr), want, strict=True):
        assert g[3] == pytest.approx(w[3])


def test_every_slot_holds_one_block(spark, small):
    mix = planned(spark)
    slots = mix.slots.collect()
    sources = {r.number: r for r in mix.sources.collect()}
    turns = sorted((r.turn, r.number, r.block) for r in slots)
    assert len({t for t, _, _ in turns}) == len(turns) == sum(s.blocks for s in sources.values())
    nth = defaultdict(int)
    for _, s, k in turns:  # ranked in schedule order
        assert k == nth[s]
        nth[s] += 1
    assert dict(nth) == {s: r.blocks for s, r in sources.items() if r.blocks}
    held = defaultdict(list)
    for p in MIX.pieces(mix).collect():
        held[p.turn].append((p["at"], p.n_words, p.source))
    for t, s, k in turns:
        at = 0
        for a, n, source in sorted(held[t]):
            assert a == at and source == sources[s].source
            at += n
        assert at == min(16, sources[s].quota - 16 * k)


def test_turns_are_van_der_corput_points_over_the_stretches(spark):
    mix = planned(spark)
    sources = sorted((r.first_slot, r.blocks, r.number) for r in mix.sources.collect())
    n = sum(b for _, b, _ in sources)
    bits = (n - 1).bit_length()
    want = set()
    for i in range(1 << bits):
        j = int(format(i, f"0{bits}b")[::-1], 2)
        if j < n:
            want.add((i, next(s for first, b, s in sources if first <= j < first + b)))
    turns = sorted((r.turn, r.number) for r in mix.slots.collect())
    assert set(turns) == want
    # every prefix of the schedule has each source near its part
    parts, seen = {s: b / n for _, b, s in sources}, defaultdict(int)
    for done, (_, s) in enumerate(turns, 1):
        seen[s] += 1
        assert all(abs(seen[x] - p * done) <= bits + 1 for x, p in parts.items())


def test_reruns_agree_whatever_the_partitions(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    a, b = (sorted(map(repr, MIX.pieces(MIX.plan_mix(d, block_words=16)).collect()))
            for d in (docs.repartition(2), docs.repartition(7, F.rand(3))))
    assert a == b


def test_weights_by_table_and_shares(spark):
    w = spark.createDataFrame([("s0", 0.0), ("s1", 3.0), (None, 1.0), ("absent", 9.0)], "source string, weight double")
    mix = planned(spark, weights=w, share=0.5)
    rows = {r.source: r for r in mix.sources.collect()}
    assert rows["s0"].target == rows["s2"].target == 0 and rows["s1"].target == 2 * rows["s1"].source_size
    assert rows[None].target == 2 * rows[None].source_size  # above by weight, so both stop
    assert all(r.taken <= 2 * r.size for r in MIX.taken_words(mix).collect())
    once = planned(spark, weights=(1,), share=5.0, max_epochs=1)
    assert all(r.taken == r.size for r in MIX.taken_words(once).collect())


def test_empty_tables_and_query(spark, sf001):
    for rows in ([], [(1, None, None)], [(1, " ", "a"), (1, " ", "a")]):
        mix = planned(spark, rows)
        assert [r.taken for r in MIX.taken_words(mix).collect()] == [0] * len(rows)
        assert MIX.pieces(mix).count() == 0
    docs = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted(map(tuple, op13_mixing(spark, sf001).collect()), key=repr)
    want = brute_taken(docs)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    by_source = defaultdict(lambda: [0, 0.0])
    for (_, t, s), r in zip(sorted(docs, key=lambda d: repr(d[0])), sorted(got, key=lambda r: repr(r[0])), strict=True):
        by_source[s][0] += r[4]
        by_source[s][1] = r[3]
    assert all(abs(taken - target) <= 0.5 for taken, target in by_source.values())
