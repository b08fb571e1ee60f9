"""Classification of texts by a table of keyword rules of any size.

A rule is ``(priority, label, keyword)``: a text takes the label of the smallest priority
whose keyword it contains, case aside.  Every keyword is filed under the rarest of its
3-grams (a shorter one under itself), the distinct texts meet the rules by an equi-join on
their grams, and what meets is verified.  No text is compared with rules that share no gram
with it, so rules may number millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.columns import classify_by_keywords
from faultline.session import drop_tables, materialize, materialize_observed

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """The distinct ``n``-grams of a text."""
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def rule_table(spark, groups: list[tuple[str, list[str]]]) -> DataFrame:
    """Ordered groups of keywords as a table of rules, a group's priority its place."""
    rows = [(k, label, w) for k, (label, words) in enumerate(groups) for w in words]
    return spark.createDataFrame(rows, "priority int, label string, keyword string")


def matches(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``(text, priority, label)``: the winning rule of each distinct text ``text`` that any rule fits.

    ``rules``: ``priority, label, keyword``; of equal priorities the smaller label wins.
    Rules without a keyword or a label fit nothing; an empty keyword fits every text."""
    low = texts.select("text", F.lower("text").alias("low")).where("low IS NOT NULL")
    kept = rules.where("keyword IS NOT NULL AND label IS NOT NULL").select(
        F.struct("priority", "label").alias("rule"), F.lower("keyword").alias("word"))
    kept, seen = materialize_observed(
        kept.groupBy("word").agg(F.min("rule").alias("rule")).withColumn("n", F.least(F.length("word"), F.lit(GRAM))),
        "rules", any=F.min(F.when(F.col("n") == 0, F.col("rule"))), lengths=F.collect_set("n"))
    lengths = sorted(n for n in seen["lengths"] if n)
    grams = F.flatten(F.array(*[_grams(F.col("low"), n) for n in lengths])) if lengths \
        else F.array().cast("array<string>")
    of_texts = materialize(low.select("text", "low", F.explode(grams).alias("gram")), "rule-grams")

    own = F.when(F.col("n") < GRAM, F.array("word")).otherwise(_grams(F.col("word"), GRAM))
    of_rules = kept.where("n > 0").select("word", "rule", F.explode(own).alias("gram"))
    counts = of_texts.join(of_rules.select("gram").distinct(), "gram", "left_semi").groupBy("gram") \
        .agg(F.count(F.lit(1)).alias("c"))
    # A keyword with a gram that no text has fits none; its rarest gram is that one.
    filed = of_rules.join(counts, "gram", "left").groupBy("word") \
        .agg(F.min("rule").alias("rule"), F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "gram")).alias("g")) \
        .where("g.c > 0").select("word", "rule", F.col("g.gram").alias("gram"))
    fits = of_texts.join(filed, "gram").where(F.contains("low", "word")).select("text", "rule")
    if seen["any"] is not None:
        rule = seen["any"]
        every = F.struct(F.lit(rule["priority"]).cast(rules.schema["priority"].dataType).alias("priority"),
                         F.lit(rule["label"]).alias("label"))
        fits = fits.unionByName(low.select("text", every.alias("rule")))
    best = materialize(fits.groupBy("text").agg(F.min("rule").alias("rule")), "rule-matches")
    drop_tables(kept, of_texts)
    return best.select("text", "rule.priority", "rule.label")


def classify_by_rules(df: DataFrame, col: str, rules: DataFrame | list[tuple[str, list[str]]], default: str,
                      name: str = "Region") -> DataFrame:
    """``df`` with ``name``: the label that its text ``col`` takes by the rules; NULL texts and
    texts without a match take ``default`` (X4).

    Ordered groups given as a list are one expression; a table of rules is joined through
    its index, once for each distinct text.  An own column called ``name`` is replaced."""
    if not isinstance(rules, DataFrame):
        return df.withColumn(name, classify_by_keywords(col, rules, default))
    texts = df.select(F.col(col).alias("text")).where("text IS NOT NULL").distinct()
    best = matches(texts, rules).select(F.col("text").alias("_text"), F.col("label").alias("_label"))
    own = [F.col(c) for c in df.columns if c != name]
    return df.join(best, F.col(col) == F.col("_text"), "left").select(
        *own, F.coalesce("_label", F.lit(default)).alias(name))
