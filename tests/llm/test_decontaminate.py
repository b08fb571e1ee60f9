"""Decontamination against a brute-force scan."""

import hashlib
import random
import re
import time

import pytest

from faultline.llm import decontaminate as D
from faultline.llm.queries import op4_decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        iw = words(t)
        size = min(window, len(iw))
        for k in range(len(iw) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p:p + size] == iw[k:k + size]:
                    hit.update(range(p, p + size))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_query_matches_brute_force(spark, sf001):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = op4_decontaminate(spark, sf001).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows[::3] + [r for r in rows if r.contaminated]:
        assert brute(docs[r.doc_id], items) == (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)


ITEMS = [(1, "One two three"), (2, "one TWO, three"), (3, "Über a b c d e f g h i j k"), (4, None), (None, "zzz"), (5, "!?")]
TEXTS = [(1, "x one-two three y", "k"), (2, None, "k"), (3, "", None), (4, "über A b c d e f g h i", "k"),
         (4, "über A b c d e f g h i", "k"), (5, "a b c d e f g h i j k, one two", "k"), (None, "zzz " * 5000, "k"),
         (7, "one one two three two three", "k")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_odd_rows(spark, block_bytes):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = D.find_contamination(docs, bench, block_bytes=block_bytes).collect()
    good = [(i, t) for i, t in ITEMS if i is not None]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=str) == \
        sorted(((i, *(b := brute(t, good))[:3], b[4]) for i, t, _ in TEXTS), key=str)
    assert D.find_contamination(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in D.find_contamination(docs, bench.limit(0)).collect())


def test_removal(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.remove_contamination(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 3, 4, 4]
    cut = {r.doc_id: r.text for r in D.remove_contamination(docs, bench, mode="spans").collect()}
    assert cut[1] == "x  y" and cut[2] is None and cut[4] == TEXTS[3][1]
    assert "one" not in cut[7]  # the cut joins a window, which is cut as well
    with pytest.raises(ValueError, match="mode"):
        D.remove_contamination(docs, bench, mode="other")


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_removal_in_blocks_releases_each_broadcast(spark, monkeypatch, mode):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, items string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    held, put, most = [], type(spark.sparkContext).broadcast, []

    def counted(context, value):
        b = put(context, value)
        destroy = b.destroy
        held.append(b)
        most.append(len(held))
        b.destroy = lambda *a: (held.remove(b), destroy(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", counted)
    got = D.remove_contamination(docs, bench, mode=mode, block_bytes=1).collect()
    assert max(most) == 1 and len(most) > 2
    D.find_contamination(docs, bench, block_bytes=1).collect()
    assert max(most) == 1
    monkeypatch.undo()
    assert sorted(got, key=str) == sorted(D.remove_contamination(docs, bench, mode=mode).collect(), key=str)


def test_spans_of_all_blocks_are_cut_until_none_is_left(spark):
    """A cut in one block joins a window of another, before or after it."""
    w, v, u = ([f"{c}{k}" for k in range(10)] for c in "wvu")
    docs = spark.createDataFrame([(1, " ".join(w[:5] + v + w[5:])), (2, " ".join(u[:3] + w[:4] + v + w[4:] + u[3:]) + " end"),
                                  (3, "clean text")], "doc_id long, text string")
    for order in ((w, v, u), (v, w, u), (u, w, v)):
        bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(order)], "item_id long, text string")
        for block_bytes in (1 << 20, 1):
            cut = {r.doc_id: r.text.split() for r in
                   D.remove_contamination(docs, bench, mode="spans", block_bytes=block_bytes).collect()}
            assert cut == {1: [], 2: ["end"], 3: ["clean", "text"]}


def test_a_window_of_many_items_and_a_large_block():
    """Twenty thousand items with one prompt; setting up is array work, not a step per window and item."""
    prompt = " ".join(f"p{k}" for k in range(12))
    items = [(str(k), f"{prompt} answer {k} of item number {k}".encode()) for k in range(20_000)]
    t = time.process_time()
    found = D.WindowSet(items)
    spans, own = found.hits(D.words(f"x {prompt} y".encode()))
    assert time.process_time() - t < 10
    assert spans == [(1, 13)] and own == sorted(i for i, _ in items)
    assert found.hits(D.words(f"{prompt} answer 77 of item number 77".encode()))[1] == own
    assert found.hits(D.words(b"p5 p6 p7 p8 p9 p10 p11 answer 77 of item number 77"))[1] == ["77"]


@pytest.mark.parametrize("base", [0, 1])
def test_windows_of_equal_hash(monkeypatch, base):
    """With a poor hash many windows collide; words decide."""
    monkeypatch.setattr(D, "_BASE", D.np.uint64(base))
    rng = random.Random(5)
    items = [(str(k), " ".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))).encode()) for k in range(60)]
    found = D.WindowSet(items, 4)
    assert any(w.others for w in found.windows)
    for _ in range(200):
        text = " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 25)))
        n, hit, n_items, _, _ = brute(text, [(i, t.decode()) for i, t in items], 4)
        spans, own = found.hits(D.words(text.encode()))
        assert sum(b - a for a, b in spans) == hit and len(own) == n_items
