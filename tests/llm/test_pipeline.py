"""The pipeline's stages against brute-force versions, each on its predecessor's result."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from faultline.llm import packing
from faultline.llm import quality_rules as Q
from faultline.session import materialize
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_line_dedup import rows_collected
from tests.llm.test_quality_rules import brute as brute_counts
from tests.llm.test_simhash import brute_components, brute_fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def line_fails(x):
    w = WORD.findall(x)
    n = len(w)
    if not n:
        return False
    if n <= Q.PHRASE_MAX_WORDS and any(p in x.lower() for p in Q.PHRASES):
        return True
    if n < Q.SHARE_MIN_WORDS:
        return False
    count = lambda chars: sum(c in chars for c in x)
    return (count(Q.SEPARATORS) > 0.2 * n or count(Q.SYMBOLS) > 0.5 * n or x.count("!!") > 0.3 * n
            or x.upper() == x != x.lower() or n >= 16 and len(set(w)) < 0.25 * n or not count(Q.ENDS))


def quality(docs):
    out = {}
    for i, t in docs.items():
        n, _, _, _, repeated = brute_counts(t)
        if n >= 50 and 100 * repeated <= 50 * n:
            good = "\n".join(x for x in t.split("\n") if not line_fails(x))
            if len(WORD.findall(good)) >= 0.5 * n:
                out[i] = good
    return out


def line_dedup(docs):
    first = brute_lines(list(docs.items()))
    out = {}
    for i, t in docs.items():
        kept = [x for k, x in enumerate(t.split("\n")) if first.get((i, k), (i, k)) == (i, k)]
        if WORD.search("\n".join(kept)):
            out[i] = "\n".join(kept)
    return out


def near_dedup(docs):
    own = brute_components(list(docs), [brute_fp(t) for t in docs.values()])
    return {i: t for i, t in docs.items() if own[i] == i}


@pytest.fixture(scope="module")
def stages(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], sf001), f"test-{name}"))
    return out


def texts(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.doc_id: r.text for r in rows}


def test_stages_match_brute_force(spark, sf001, stages):
    documents, good, lines, near, clean, _ = stages
    assert all(s.schema == documents.schema for s in (good, lines, near, clean))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    raw = {r.doc_id: r.text for r in documents.collect()}
    assert texts(good) == quality(raw)
    assert texts(lines) == line_dedup(texts(good))
    assert texts(near) == near_dedup(texts(lines))
    before = texts(near)
    assert texts(clean) == {i: t for i, t in before.items() if not brute_hits(t, items)[4]}
    assert 50 < clean.count() < len(raw)


def test_packing_is_the_kept_documents(stages):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = stages[-1].collect()
    ids = {i: [*t.encode(x, add_special_tokens=False).ids, 0] for i, x in texts(stages[-2]).items()}
    assert {r.doc_id for r in rows} == ids.keys()
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())


def test_run_gives_the_last_stage(spark, sf001, stages):
    assert sorted(corpus_pipeline.run(spark, sf001).collect()) == sorted(stages[-1].collect())


def test_empty_documents(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf001)
        assert docs.collect() == []


def test_line_dedup_stage_collects_few_rows(spark, monkeypatch):
    """What the second stage brings to the driver doesn't grow with the lines that are like others."""
    rng = np.random.default_rng(4)
    lines = ["".join(chr(97 + c) for c in rng.integers(0, 26, 60)) for _ in range(1500)]
    docs = spark.createDataFrame([(2 * k + b, x[:-1] + "?!"[b], "en", "web", 60) for k, x in enumerate(lines) for b in (0, 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_collected(spark, monkeypatch)
    kept = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert sum(got) < 200
    assert 1500 <= kept.count() < 1530
