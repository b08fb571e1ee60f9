"""WARC archives: segmented records with chunked payloads, written and read back by Spark.

Writing: pages with equal payloads share one ``response`` record, that of the smallest page
id; the others are ``revisit`` records that refer to it.  A record id says the page, the
payload's digest and, for the records of this writer, a number of the row's own, so rows
that repeat an id keep their payloads and segments apart; a revisit refers by page and
digest.  A payload is framed in HTTP chunks,
and a record block longer than ``segment_bytes`` is cut into segments: the first is the
record itself, the rest are ``continuation`` records that name the origin record, their
number, and on the last one the total length.  Spark's text writer puts the records out, one
row each, with the record end ``CRLF CRLF`` as its line end, through its commit protocol; a
file gets at most ``file_records`` records, so its size has a bound.

Reading: each archive is one row of Spark's binary-file source and is walked by the stated
content lengths, so blocks may hold anything, also what looks like a record.  Segments are
grouped by origin, ordered by number, checked against the total length, and only then is
the chunk framing undone.
"""

from __future__ import annotations

import re
from base64 import b32encode
from hashlib import sha1
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map
from faultline.session import drop_tables, materialize

VERSION = b"WARC/1.1"
CRLF = b"\r\n"
#: The end of a header, and of a record.
RECORD_END = CRLF + CRLF
CHUNK_BYTES = 16_384
SEGMENT_BYTES = 65_536
#: Records in a file: with segments, at most 128 MB and what the headers take.
FILE_RECORDS = 2048

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return b32encode(sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP chunk framing."""
    parts = (payload[a:a + size] for a in range(0, len(payload), size))
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in parts), b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """The payload of a chunk framing; None if it is broken."""
    out, at = [], 0
    while True:
        end = data.find(CRLF, at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:  # trailers may follow
            return b"".join(out)
        if data[at + n:at + n + 2] != CRLF:
            return None
        out.append(data[at:at + n])
        at += n + 2


def _clean(value: str) -> bytes:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip().encode()


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without its end mark."""
    lines = [VERSION, *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block


def _urn(page: str, digest: str, *numbers: int) -> bytes:
    """A record id: page, digest and what tells the row's records apart."""
    return f"<urn:page:{'#'.join([quote(page, safe=''), digest, *map(str, numbers)])}>".encode()


def _named(urn: str | None) -> tuple[str, str | None]:
    """Page and digest of a record id."""
    page, *rest = (urn or "").removeprefix("<urn:page:").removesuffix(">").split("#")
    return unquote(page), rest[0] if rest else None


def records_of(page: str, url: str, payload: bytes, refers_to: str | None, chunk: int, segment: int,
               number: int = 0) -> list[bytes]:
    """The records of one page: a revisit, or a response in segments."""
    digest = payload_digest(payload)
    own = [(b"WARC-Record-ID", _urn(page, digest, number)), (b"WARC-Target-URI", _clean(url)),
           (b"WARC-Payload-Digest", b"sha1:" + digest.encode())]
    if refers_to is not None:
        block = _HTTP.replace(b"Transfer-Encoding: chunked", b"Content-Length: %d" % len(payload))
        return [_record([(b"WARC-Type", b"revisit"), *own,
                         (b"WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                         (b"WARC-Refers-To", _urn(refers_to, digest)),
                         (b"Content-Type", b"application/http; msgtype=response")], block)]
    block = _HTTP + chunked(payload, chunk)
    edges = [*range(0, len(block), segment), len(block)]
    n = len(edges) - 1
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        head = [(b"WARC-Type", b"continuation" if k else b"response")]
        head += own if k == 0 else [(b"WARC-Record-ID", _urn(page, digest, number, k + 1)), own[1]]
        if n > 1:
            head.append((b"WARC-Segment-Number", b"%d" % (k + 1)))
        if k:
            head.append((b"WARC-Segment-Origin-ID", own[0][1]))
            if k == n - 1:
                head.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        else:
            head.append((b"Content-Type", b"application/http; msgtype=response"))
        out.append(_record(head, block[a:b]))
    return out


_PAYLOAD = ["_sha1", "_sha2", "_bytes"]


def _told(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The pages with ``_page`` and what tells their payloads apart: SHA-1, SHA-256 and length."""
    body = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    return pages.select("*", F.col(id_col).alias("_page"), F.sha1(body).alias("_sha1"), F.sha2(body, 256).alias("_sha2"),
                        F.octet_length(body).alias("_bytes"))


def revisits(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(_page, _sha1, _sha2, _bytes, _refers_to)`` of each page and payload that isn't the
    first page of the payload.

    A row per payload and task leaves the map side, however many copies there are.  A null
    id comes after all others, and nothing refers to it."""
    d = _told(pages, id_col, html_col).where(F.col("_bytes") >= min_bytes).select("_page", *_PAYLOAD)
    first = d.groupBy(_PAYLOAD).agg(F.min("_page").alias("_refers_to"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return d.join(first, _PAYLOAD).where(~F.col("_page").eqNullSafe(F.col("_refers_to")) & F.col("_refers_to").isNotNull()) \
        .select("_page", *_PAYLOAD, "_refers_to").distinct()


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, segment_bytes: int = SEGMENT_BYTES,
          file_records: int = FILE_RECORDS) -> None:
    """Write one record for each row under ``path`` (its payload the html in UTF-8; null is empty).

    Of pages with equal payloads of at least ``min_bytes`` that with the smallest id is the
    response, the others are revisits.  Rows that repeat an id are decided each by its own
    payload; equal rows are all responses or all revisits.  Ids and urls are written as
    text, a null as nothing; rows without an id revisit as others do, but nothing refers to
    them.  Only ids and hashes of revisits are joined, a table written first, so that its
    size is known and a small one is broadcast."""
    first = materialize(revisits(pages, id_col, html_col, min_bytes), "warc-revisits")
    copies = first.select(*[F.col(c).alias("_copy" + c) for c in ("_page", *_PAYLOAD)], "_refers_to")
    told = _told(pages, id_col, html_col).withColumns(
        {"_url": F.col(url_col).cast("string"), "_html": F.col(html_col).cast("string")})
    same = F.col("_page").eqNullSafe(F.col("_copy_page"))
    for c in _PAYLOAD:
        same = same & (F.col(c) == F.col("_copy" + c))
    # unique within the files that are committed, which is all that it need be
    d = told.select("_page", *_PAYLOAD, "_url", "_html").join(copies, same, "left").select(
        F.col("_page").cast("string"), "_url", "_html", F.col("_refers_to").cast("string"),
        F.monotonically_increasing_id().alias("_number"))

    def rows(ids, urls, htmls, refers, numbers):
        for lo in range(0, len(ids), 64):
            out = []
            for i, u, h, r, n in zip(*(c[lo:lo + 64] for c in (ids, urls, htmls, refers, numbers))):
                out += records_of(i or "", u or "", (h or "").encode(), r, chunk_bytes, segment_bytes, n)
            yield (out,)

    made = arrow_map(d, rows, "record binary")
    made.select(F.col("record").cast("string").alias("value")) \
        .write.option("lineSep", RECORD_END.decode()).option("maxRecordsPerFile", file_records).text(path)
    drop_tables(first)


def read_records(spark, path: str) -> DataFrame:
    """Every record under ``path``: ``type, record_id, url, digest, refers_to, segment, origin,
    total_length, block, whole``; ``whole`` says that the block has its stated length.

    What stands between records and isn't one is passed over to the next version line; a
    record without a length reaches to the end of its file and isn't whole."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(contents):
        for data in contents:
            part, size = [], 0
            for r in walk(data):
                part.append(r)
                size += len(r[8])
                if size > 1 << 22:
                    yield tuple(map(list, zip(*part)))
                    part, size = [], 0
            if part:
                yield tuple(map(list, zip(*part)))

    return arrow_map(files, rows, "type string, record_id string, url string, digest string, refers_to string, "
                                  "segment int, origin string, total_length long, block binary, whole boolean")


def walk(data: bytes):
    """The fields of :func:`read_records` of each record of an archive."""
    at = data.find(VERSION)
    while at >= 0:
        end = data.find(RECORD_END, at)
        if end < 0:
            return
        named = {}
        for line in data[at:end].split(CRLF):
            k, colon, v = line.partition(b":")
            if colon:
                named[k.strip().lower()] = v.strip().decode("utf-8", "replace")

        def number(name: bytes) -> int | None:
            v = named.get(name, "")
            return int(v) if v.isascii() and v.isdigit() else None

        length, start = number(b"content-length"), end + len(RECORD_END)
        block = data[start:] if length is None else data[start:start + length]
        digest = named.get(b"warc-payload-digest", "").removeprefix("sha1:") or None
        yield (named.get(b"warc-type"), named.get(b"warc-record-id"), named.get(b"warc-target-uri"), digest,
               named.get(b"warc-refers-to"), number(b"warc-segment-number"), named.get(b"warc-segment-origin-id"),
               number(b"warc-segment-total-length"), block, length is not None and len(block) == length)
        at = data.find(VERSION, start + len(block))


def read_pages(spark, path: str) -> DataFrame:
    """Each page of the archives: ``page, url, record_type, payload`` (null for a revisit),
    ``payload_bytes, payload_digest, refers_to, ok``.

    Records in one segment are decoded where they are read; only segments are shuffled, and
    a group is one page's.  ``ok`` is false, and the payload null, if a segment is missing,
    repeated or not whole, the total length is wrong, the chunk framing is broken, or the
    digest differs; and for a revisit that refers to a record of another digest.  Nothing is
    dropped; an orphan segment shows under its origin's page."""
    r = read_records(spark, path)
    alone = F.col("segment").isNull() & (F.col("type") != "continuation")
    one = r.where(alone).select("type", "record_id", "url", "digest", "refers_to", "block", F.col("whole").alias("whole"))
    many = r.where(~alone | F.col("type").isNull()) \
        .withColumn("key", F.coalesce("origin", "record_id")) \
        .groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
            F.coalesce("segment", F.lit(0)).alias("n"), "type", "url", "digest", "total_length", "whole", "block"))).alias("s"))
    block = F.aggregate("s", F.lit(b""), lambda a, s: F.concat(a, s["block"]))
    in_order = F.size(F.filter("s", lambda s, k: (s["n"] != k + 1) | ~s["whole"])) == 0
    joined = many.select(
        F.col("s")[0]["type"].alias("type"), F.col("key").alias("record_id"), F.col("s")[0]["url"].alias("url"),
        F.col("s")[0]["digest"].alias("digest"), F.lit(None).cast("string").alias("refers_to"), block.alias("block"),
        (in_order & F.coalesce(F.element_at("s", -1)["total_length"] == F.octet_length(block), F.lit(False))).alias("whole"))

    def rows(kinds, ids, urls, digests, refers, blocks, whole):
        for lo in range(0, len(kinds), 64):
            part = slice(lo, lo + 64)
            out = [_page_of(*x) for x in zip(*(c[part] for c in (kinds, ids, urls, digests, refers, blocks, whole)))]
            yield tuple(map(list, zip(*out)))

    return arrow_map(one.unionByName(joined), rows,
                     "page string, url string, record_type string, payload binary, payload_bytes long, "
                     "payload_digest string, refers_to string, ok boolean")


def _page_of(kind, record_id, url, digest, refers_to, block, whole) -> tuple:
    head, _, body = (block or b"").partition(RECORD_END)
    page = _named(record_id)[0]
    if kind == "revisit":
        n = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
        other, of = _named(refers_to)
        return page, url, kind, None, int(n[1]) if n else None, digest, other, bool(whole and n and of == digest)
    framed = re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", head)
    payload = (unchunked(body) if framed else body) if whole else None
    ok = payload is not None and payload_digest(payload) == digest
    return (page, url, kind, payload, None if payload is None else len(payload),
            None if payload is None else payload_digest(payload), None, ok)
