"""Quality rules: base counts against brute force, line rules by example."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered))


def test_base_counts_match_brute_force(spark, sf001):
    d = Q.quality_rules(spark.read.parquet(f"{sf001}/documents.parquet"))
    for r in d.select("text", "_quality.*").collect():
        assert brute(r.text) == (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdict_agrees_with_the_labels(spark, sf001):
    d = Q.quality_rules(spark.read.parquet(f"{sf001}/documents.parquet")).where("_quality.n_words >= 50")
    lab = spark.read.parquet(f"{sf001}/labels.parquet")
    rows = d.join(lab, "doc_id").select("quality", "_quality.kept").collect()
    assert len(rows) > 30
    assert sum((r.quality == 1) == r.kept for r in rows) / len(rows) > 0.97


@pytest.mark.parametrize(("line", "failure"), [
    ("", ""), (" \t ", ""), ("Home | News | Sport | Mail", "navigation"),
    ("A line of prose that ends well.", ""), ("A line of prose without any end", "punctuation"),
    ("All Rights Reserved.", "boilerplate"), ("SALE NOW! BUY ALL OF IT.", "boilerplate"),
    ("the### end$$$ of%%% it***.", "boilerplate"), ("now!! buy!! all!! this!!", "boilerplate"),
    ("spam " * 20 + ".", "boilerplate"), ("Two words", ""),
    ("Der Text ist „gut“ [sagt er]", ""), ("word " * 3, ""),
    ("It says read more " + "in a long line of varied prose with many words that go on and on here a b c d e f g h i j k l m n o p.", ""),
])
def test_line_rules(spark, line, failure):
    assert spark.range(1).select(Q.line_failure(F.lit(line)).alias("f")).first().f == failure


def test_odd_rows(spark):
    good = "\n".join(" ".join(f"w{k * 8 + j}" for j in range(8)) + "." for k in range(12))
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, good), (4, good), (5, good + "\nHome | A | B | C"), (None, good),
            (6, "\n".join([*(f"A{k} | B{k} | C{k} | D{k}" for k in range(12)), good[:120]])), (7, "w" * 500_000 + " .")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_chars long, n_words string")
    got = Q.quality_rules(docs).select("doc_id", "_quality.*").collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: False, 3: False, 4: True, 5: True, None: True, 6: False, 7: False}
    assert {r.doc_id: r.n_failed_lines for r in got}[5] == 1
    kept = Q.quality_filter(docs, length_col="n_chars")
    assert kept.schema == docs.schema
    assert all(r.text == good and r.n_chars == len(good) and r.n_words == "x" for r in kept.collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "5", "None"]
    assert Q.quality_filter(docs.limit(0)).collect() == []


def test_native_plan_without_shuffle(spark, sf001):
    plan = Q.quality_rules(spark.read.parquet(f"{sf001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("line", "failure"), [
    ("यह एक साफ हिंदी वाक्य है।", ""), ("یہ ایک صاف اردو جملہ ہے۔", ""), ("هل هذا سؤال واضح جدا؟", ""),
    ("Սա մաքուր հայերեն նախադասություն է։", ""), ("ይህ ንጹህ የአማርኛ ዓረፍተ ነገር ነው።", ""), ("នេះ ជា ប្រយោគ ខ្មែរ ។", ""),
    ("นี่คือ ประโยค ภาษาไทย ที่ สะอาด", ""), ("ນີ້ ແມ່ນ ປະໂຫຍກ ພາສາລາວ", ""), ("यह एक वाक्य नहीं", "punctuation"),
    ("𑀅 𑀆 𑀇 𑀈𑁇", ""), ("The design in the house was resign in name.", ""), ("Spread more of the butter on it.", ""),
    ("Please sign in to go on.", "boilerplate"), ("(Read more)", "boilerplate"), ("read more: design in it.", "boilerplate"),
])
def test_line_rules_of_other_scripts_and_whole_phrases(spark, line, failure):
    assert spark.range(1).select(Q.line_failure(F.lit(line)).alias("f")).first().f == failure


def test_clean_hindi_is_kept(spark):
    text = "\n".join(" ".join(f"शब्द{chr(0x915 + 8 * k + j)}" for j in range(8)) + "।" for k in range(8))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert Q.quality_filter(docs).first().text == text
