"""Fill-in-the-middle against a plain cut of the units, and the exact way back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from faultline.llm import fill_in_middle as FIM
from faultline.llm.queries import op12_fill_in_middle


def draws(doc_id, seed=7):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k:8 * k + 8], 16) for k in range(4)]


def brute(doc_id, text, unit=r"[^\n]*\n|[^\n]+", fim=100, spm=50, marks=("<P>", "<S>", "<M>")):
    p, s, m = marks
    text = text or ""
    units = re.findall(unit, text)
    n = len(units)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(x in text for x in marks) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid
    return n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid


ROWS = [(1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "one line"), (6, "a\nb\nc\n"), (7, "a\r\nb\rc d\u0085e\n"),
        (8, "holds <S> itself\nb\n"), (9, "almost <S <<P <M\n<\n"), (10, "\U0001d4aeé\n\U0001f600" * 40),
        (None, "x\ny\nz"), (11, "same\nid"), (11, "same\nid"), (11, "another\ntext\n"), (12, "$1 \\1 \\E {2} (?x)\n" * 9),
        *((k, "".join(f"line {k} {j}\n" for j in range(k % 37))) for k in range(20, 160))]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_matches_plain_cuts_and_goes_back(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, fim_n int, other string")
    d = FIM.fill_in_middle(docs)
    assert d.columns == ["doc_id", "text", "other", "fim_n", "fim_form", "fim_output"]
    out, form = F.col("fim_output"), F.col("fim_form")
    got = d.select("doc_id", "text", "fim_n", form, *FIM.part_chars(out, form), out, FIM.restored(out, form)).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r[2:7]) == brute(r.doc_id, r.text)
        assert r[7] == (r.text or "")
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("fim", "spm", "marks", "unit"), [
    (30, 100, ("<|fim_p|>", "<|fim_s|>", "<|fim_m|>"), FIM.LINE), (100, 0, ("$1[", "\\E]", "(*"), r"[^ ]* |[^ ]+")])
def test_parameters(spark, fim, spm, marks, unit):
    docs = spark.createDataFrame([r for r in ROWS if r[1] is None or "\\E" not in r[1]], "doc_id long, text string")
    d = FIM.fill_in_middle(docs, unit=unit, fim_percent=fim, spm_percent=spm, marks=marks)
    out, form = F.col("fim_output"), F.col("fim_form")
    for r in d.select("doc_id", "text", "fim_n", form, out, FIM.restored(out, form, marks)).collect():
        n, kind, _, _, text = brute(r.doc_id, r.text, unit, fim, spm, marks)
        assert (r[2], r[3], r[4], r[5]) == (n, kind, text, r.text or "")


def test_very_long_texts_need_no_deep_stack(spark):
    """A million lines, one line of three million characters, a million blank lines."""
    texts = [(k, t) for k, t in enumerate(["ab\n" * 1_000_000, "x" * 3_000_000, "\n" * 1_000_000, "y" * 999_999 + "\né"])]
    d = FIM.fill_in_middle(spark.createDataFrame(texts, "doc_id long, text string"))
    out, form = F.col("fim_output"), F.col("fim_form")
    got = d.select("doc_id", "fim_n", form, *FIM.part_chars(out, form), F.sha2(out, 256),
                   F.sha2(FIM.restored(out, form), 256)).collect()
    for r in got:
        want = brute(r[0], texts[r[0]][1])
        assert tuple(r[1:5]) == want[:4] and r[5] == digest(want[4]) and r[6] == digest(texts[r[0]][1])


def test_query_and_empty_table(spark, sf001):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    rows = op12_fill_in_middle(spark, sf001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, pre, mid, out = brute(r.doc_id, docs[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, pre, mid, digest(out), digest(docs[r.doc_id] or ""))
    assert FIM.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
