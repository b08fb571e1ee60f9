"""WARC: exact round trips, segments, broken archives."""

import hashlib
from base64 import b32encode

import pytest
from hypothesis import given
from hypothesis import strategies as st

from faultline.llm import warc as W
from faultline.llm.queries import op7_warc
from faultline.session import tables_dir


def expected(pages, min_bytes=0):
    first = {}
    for i, h in pages:
        p = (h or "").encode()
        first[p] = min(first.get(p, i), i)
    for i, h in pages:
        p = (h or "").encode()
        again = first[p] != i and len(p) >= min_bytes
        yield (i, len(p), b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response",
               first[p] if again else None)


def test_query_round_trip(spark, sf001):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()]
    rows = op7_warc(spark, sf001).collect()
    assert sorted(r[:5] for r in rows) == sorted(expected(pages))
    assert all(r.ok for r in rows)


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(data, size):
    framed = W.chunked(data, size)
    assert W.unchunked(framed) == data


@given(st.lists(st.sampled_from([b"\r\n", b"\r", b"WARC/1.1", b"W", b"\r\n\r\nWARC/1.1\r\n", b"x"]), max_size=30).map(b"".join),
       st.integers(20, 90))
def test_records_are_walked_whatever_they_hold(data, segment):
    records = W.records_of("1", "u", data, None, 1 << 20, segment)
    stream = b"".join(r + W.RECORD_END for r in records)
    got = list(W.walk(stream))
    assert len(got) == len(records) and all(r[9] for r in got)
    assert b"".join(r[8] for r in got) == W._HTTP + W.chunked(data, 1 << 20)


@pytest.mark.parametrize("broken", [b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n", b"-1\r\n", b"3\r\nabcde0\r\n\r\n"])
def test_broken_chunks(broken):
    assert W.unchunked(broken) is None


ROWS = [(3, "http://a", "x" * 100, 1), (1, "http://b\r\nWARC/1.1", "x" * 100, 1), (7, None, None, 1), (5, "u", "", 1),
        (9, "u", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50, 1), (2, "u", "z" * 3000, None),
        (11, "u", "lone", 1), (11, "u", "lone", 1), (12, "u", "ab " * 100_000, 1)]


@pytest.mark.parametrize("min_bytes", [0, 50])
def test_odd_rows(spark, min_bytes):
    path = f"{tables_dir(spark)}/warc-odd-{min_bytes}"
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, payload int")
    W.write(pages, path, min_bytes=min_bytes, chunk_bytes=37, segment_bytes=200)
    rows = W.read_pages(spark, path).collect()
    got = sorted(((int(r.page), r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None)
                  for r in rows), key=str)
    assert got == sorted(expected([(r[0], r[2]) for r in ROWS], min_bytes), key=str)
    assert all(r.ok for r in rows)
    assert {int(r.page): r.payload for r in rows if r.payload}[12] == b"ab " * 100_000


def test_null_ids_and_empty(spark):
    path = f"{tables_dir(spark)}/warc-null"
    pages = spark.createDataFrame([(None, "u", "same"), (4, "u", "same")], "page_id long, url string, html string")
    W.write(pages, path)
    assert sorted((r.page, r.record_type, r.refers_to) for r in W.read_pages(spark, path).collect()) == \
        [("", "revisit", "4"), ("4", "response", None)]
    W.write(pages.limit(0), path + "-empty")
    assert W.read_pages(spark, path + "-empty").collect() == []


def test_lost_segment_is_told(spark):
    path = f"{tables_dir(spark)}/warc-broken"
    records = [W.records_of(str(k), "u", b"payload " * 50, None, 64, 120) for k in range(4)]
    records[1].pop(1)  # a segment is missing
    records[2][-1] = records[2][-1].replace(b"Total-Length: ", b"Total-Length: 1")
    records[3][0] = records[3][0].replace(b"sha1:", b"sha1:A")
    flat = [(r.decode(),) for rs in records for r in reversed(rs)]
    spark.createDataFrame(flat, "value string").repartition(3).write.option("lineSep", "\r\n\r\n").text(path)
    assert [r[9] for r in W.walk(b"junk" + records[0][0][:-5])] == [False]
    got = {r.page: (r.ok, r.payload is None) for r in W.read_pages(spark, path).collect()}
    assert got == {"0": (True, False), "1": (False, True), "2": (False, True), "3": (False, False)}


def test_rows_that_repeat_an_id_lose_nothing(spark):
    """Equal rows of several segments, an id with two payloads, null ids: each row has its own record."""
    path = f"{tables_dir(spark)}/warc-repeated"
    big = "<p>much text</p>" * 7000
    rows = [(5, "u", big), (5, "u", big), (0, "u", "same"), (1, "u", "same"), (1, "u", "other text"), (None, "u", "same"),
            (None, "u", "alone"), (None, "u", "alone"), (None, "u", big), (7, "u", ""), (7, "u", None), (8, "u", None)]
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = W.read_pages(spark, path).collect()
    assert all(r.ok for r in got)
    key = lambda r: (r.page, r.record_type, r.refers_to or "", r.payload_bytes)
    assert sorted(map(key, got)) == sorted([
        ("5", "response", "", len(big)), ("5", "response", "", len(big)), ("0", "response", "", 4),
        ("1", "revisit", "0", 4), ("1", "response", "", 10), ("", "revisit", "0", 4), ("", "response", "", 5),
        ("", "response", "", 5), ("", "revisit", "5", len(big)), ("7", "response", "", 0), ("7", "response", "", 0),
        ("8", "revisit", "7", 0)])
    assert sorted(len(r.payload) for r in got if r.page == "5") == [len(big)] * 2


def test_query_with_a_null_id(spark, tmp_path):
    rows = [(None, "u", "a"), (3, "u", "a"), (None, "u", "b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id or -1, r.record_type, r.refers_to, r.ok) for r in op7_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(-1, "revisit", 3, True), (3, "response", None, True), (-1, "response", None, True)], key=str)


def test_a_revisit_of_another_digest_isnt_ok(spark):
    path = f"{tables_dir(spark)}/warc-wrong-digest"
    good, = W.records_of("1", "u", b"same", "0", 64, 120)
    bad = good.replace(b"sha1:", b"sha1:Z").replace(b"page:1#", b"page:2#")
    ids = W.records_of("a#b <c>", "u", b"x", "d#e", 64, 120)[0]
    spark.createDataFrame([(r.decode(),) for r in (good, bad, ids)], "value string") \
        .write.option("lineSep", "\r\n\r\n").text(path)
    assert sorted((r.page, r.refers_to, r.ok) for r in W.read_pages(spark, path).collect()) == \
        [("1", "0", True), ("2", "0", False), ("a#b <c>", "d#e", True)]
