"""Language ID: held-out accuracy, false-positive correction, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import language_id as L
from faultline.llm.queries import op2_language_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op2_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    rows = got.select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_row_once(spark, sf001):
    rows = op2_language_id(spark, sf001).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 200
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_mask_holds_every_language_and_corrects():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 60, n) for n in (150_000, 40_000))
    m = L.Model({"a": a, "b": np.concatenate((b, a[:100]))})
    slots = L._slots(a[:100].view(np.uint64))
    assert ((m.table[slots[0]] & m.table[slots[1]]) == 3).all()
    fresh = rng.integers(0, 1 << 60, 200_000).view(np.uint64)
    s = L._slots(fresh)
    hit = np.mean(m.table[s[0]] & m.table[s[1]] & np.uint64(1))
    assert abs(hit - m.false[0]) < 0.003


def test_grams_by_hand():
    letters = L._letter_table()
    owner, grams = L.gram_hashes(["Ab, cd", "x", "", "ab\0cd"], letters)
    assert owner.tolist() == [0, 0, 0, 0, 3, 3, 3, 3]
    assert grams[:4].tolist() == grams[4:].tolist()
    long = "wort für wort " * 90_000
    m = L.Model({"de": np.unique(L.gram_hashes([long[:1000]], letters)[1]).view(np.int64)})
    assert m.predict([long, "wort"], letters)[0] == ["de", "de"]


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 2), (3, None, "en", 3), (4, "", "de", 4),
            (5, "12 + 34!", None, 5), (None, "und die", None, None), (2, "der hund und die katze", "de", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = L.fit(docs)
    got = [(r.doc_id, r.lang_pred) for r in L.predict(docs, m).collect()]
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (2, "de")]
    empty = docs.limit(0)
    assert L.predict(empty, m).collect() == []
    assert {r.lang_pred for r in L.predict(docs, L.fit(empty)).collect()} == {"und"}
    assert L.predict(docs.withColumn("lang_pred", F.lit(1)), m).count() == len(rows)


def test_more_languages_than_bits_of_a_word(spark):
    """Each of 130 labels has words of its own; all are learned, the rarest too."""
    letters = [chr(0x4E00 + k) for k in range(130)]
    rows = [(k * 10 + j, f"{c}{c}ab{c} {c}a{c}b{c}", f"l{k:03}") for k, c in enumerate(letters) for j in range(1 + (k < 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.table.shape == (L.SLOTS, 3) and m.languages[0] == "l000" and m.languages[-1] == "l129"
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, m).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_rows_of_one_id_or_none_are_learned_in_part(spark):
    """Every id of a language is the same, or null, beyond the rows that are used."""
    for key in (None, *range(4)):
        docs = spark.range(600).select(F.lit(key).cast("long").alias("doc_id"), F.concat(
            F.lit("ein Satz mit Wort "), F.col("id").cast("string"), F.lit(" und noch mehr")).alias("text"), F.lit("de").alias("lang"))
        docs = docs.unionByName(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("the cat sat here").alias("text"),
                                                       F.lit("en").alias("lang")))
        got = L.predict(docs.where("lang = 'de'").limit(3), L.fit(docs, fit_documents=100)).collect()
        assert {r.lang_pred for r in got} == {"de"}
