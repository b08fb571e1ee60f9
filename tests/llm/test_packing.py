"""Packing: exact round trip, mixture proportions, and equality with the tokenizer's own library."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import packing
from faultline.llm.queries import op1_packing


def rebuilt(rows):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    return by_doc, by_seq


@pytest.fixture(scope="module")
def expected(spark, sf001):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()
    return {d.doc_id: [*e.ids, 0] for d, e in zip(docs, t.encode_batch([d.text or "" for d in docs],
                                                                       add_special_tokens=False))}


def test_query_round_trip(spark, sf001, expected):
    by_doc, by_seq = rebuilt(op1_packing(spark, sf001).collect())
    assert by_doc.keys() == expected.keys()
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
        assert sum(r.length for r in rows) == len(expected[i]) == rows[0].doc_tokens
        for r in rows:
            own = np.array(expected[i][r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(own)
    total = sum(map(len, expected.values()))
    assert len(by_seq) == -(-total // 1024)
    for s, rows in by_seq.items():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0] + [r.length for r in rows])[:-1].tolist()
        assert sum(r.length for r in rows) == (1024 if s < len(by_seq) - 1 else total - 1024 * s)


def test_windows_follow_the_mixture(spark, sf001):
    p = packing.pack(spark.read.parquet(f"{sf001}/documents.parquet"), min_piece=32)
    rows = p.groupBy("queue", "sequence_id").agg(F.sum("length").alias("n")).collect()
    total, last = {}, max(r.sequence_id for r in rows)
    for r in rows:
        total[r.queue] = total.get(r.queue, 0) + r.n
    whole = sum(total.values())
    got = dict.fromkeys(total, 0)
    for s in range(last):
        for r in rows:
            if r.sequence_id == s:
                got[r.queue] += r.n
        for q, n in total.items():
            assert abs(got[q] - n * 1024 * (s + 1) / whole) <= 2 * 32 + 2


def test_targets_hold_until_a_queue_is_dry():
    s = packing.Schedule({"a": 100_000, "b": 300_000, "c": 7}, {"a": 1, "b": 1})
    assert s.ends == [100_000, 300_000, 7]
    a, b, _ = s.served(1)
    assert abs(a - b) <= 1 and a + b > 60_000
    for q, n in (("a", 100_000), ("b", 300_000), ("c", 7)):
        assert sum(m for _, m, _ in s.pieces(q, 0, n)) == n
    spans = sorted((place, m) for q, n in (("a", 100_000), ("b", 300_000), ("c", 7)) for _, m, place in s.pieces(q, 0, n))
    at = 0
    for place, m in spans:
        assert place == at
        at += m
    assert at == 400_007


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "x"), (2, "", "s", "x"), (2, "", "s", "x"), (None, "a b  c\n\n d <|endoftext|>", "s", None),
         (5, "wörter ohne " * 3000, "t", "y")],
        "doc_id long, text string, source string, ids string")
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values()) + 1
    assert {r.doc_id for r in rows} == {1, 2, None, 5}
    seq = packing.sequences(packing.pack(docs)).collect()
    assert all(len(r.ids) == 4 * r.length and r.padded_length in (1024, r.length) for r in seq)
    assert packing.pack(docs.limit(0)).collect() == []


def test_many_sources_share_queues(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("ab cd").alias("text"),
                                  F.col("id").cast("string").alias("source"))
    t = packing.tokenized(docs, max_queues=8)
    assert t.select("queue").distinct().count() <= 8 and t.count() == 40


def test_targets_hold_with_more_sources_than_queues(spark):
    """Named sources keep queues of their own, also with the default smallest piece."""
    named = {"0": 3, "1": 1, "#2": 2}
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 60).alias("text"),
        F.expr("CASE id % 8 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '#2' ELSE concat('s', id % 40) END").alias("source"))
    rows = packing.pack(docs, targets=named, max_queues=4).groupBy("queue", "sequence_id") \
        .agg(F.sum("length").alias("n")).collect()
    total = {q: sum(r.n for r in rows if r.queue == q) for q in named}
    assert len(set(total.values())) == 1 and len({r.queue for r in rows}) <= 7
    for s in range(int(total["0"] / 3 * 6 // 1024) - 1):
        done = {q: sum(r.n for r in rows if r.queue == q and r.sequence_id <= s) for q in named}
        for q, w in named.items():
            assert abs(done[q] - 1024 * (s + 1) * w / 6) <= 2 * packing.MIN_PIECE + 2


def test_production_piece_follows_the_corpus(spark, sf001):
    rows = packing.pack(spark.read.parquet(f"{sf001}/documents.parquet")).groupBy("queue", "sequence_id") \
        .agg(F.sum("length").alias("n")).collect()
    whole, last = sum(r.n for r in rows), max(r.sequence_id for r in rows)
    for q in {r.queue for r in rows}:
        n = sum(r.n for r in rows if r.queue == q)
        for s in range(last):
            got = sum(r.n for r in rows if r.queue == q and r.sequence_id <= s)
            assert abs(got - n * 1024 * (s + 1) / whole) <= 2 * packing.MIN_PIECE + 2


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|", "<|EndOfText|> é"])
def test_ids_are_the_library_call_also_for_added_tokens(text):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(packing.default_tokenizer())(text), "<u4").tolist() == want
