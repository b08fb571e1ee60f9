"""Rule tables (X4) against a plain scan of the rules."""

import random

from faultline.constants import REGION_DEFAULT, REGION_GROUPS
from faultline.operators import rules as X


def brute(text, rules, default="none"):
    if text is None:
        return default
    fit = [(p, label) for p, label, w in rules if w is not None and label is not None and w.lower() in text.lower()]
    return min(fit)[1] if fit else default


def check(spark, texts, rules):
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "k int, place string, Region string")
    table = spark.createDataFrame(rules, "priority int, label string, keyword string")
    got = {r.k: r.Region for r in X.classify_by_rules(df, "place", table, "none").collect()}
    assert got == {k: brute(t, rules) for k, t in enumerate(texts)}


def test_edges(spark):
    rules = [(2, "b", "Bar"), (1, "a", "foobar"), (3, "c", "o"), (3, "d", "xy"), (2, "z", "bar"), (9, "e", None),
             (9, None, "bar"), (4, "f", "ÄÖü"), (5, "g", "%_\\"), (6, "h", "aaaa")]
    texts = [None, "", "o", "BAR", "a FooBar!", "xy", "XYo", "the äöÜ", "100%_\\", "aaa", "aaaab", "ba r", "foobar"] * 2
    check(spark, texts, rules)
    check(spark, texts, [*rules, (7, "all", "")])
    check(spark, texts, [])
    check(spark, [None, ""], [(1, "a", "x")])


def test_many_rules_of_common_words(spark):
    """Thousands of rules, most of whose grams are everywhere."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(3000)]
    rules = [(rnd.randint(0, 500), f"l{k % 40}", w) for k, w in enumerate(words)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3))) for _ in range(300)]
    check(spark, texts, rules)


def test_list_and_table_agree(spark, sf001):
    from faultline.sources.catalog import quake_view
    raw = quake_view(spark, sf001)
    by_list = X.classify_by_rules(raw, "General_Location", REGION_GROUPS, REGION_DEFAULT)
    by_table = X.classify_by_rules(raw, "General_Location", X.rule_table(spark, REGION_GROUPS), REGION_DEFAULT)
    assert sorted(by_list.select("quake_id", "Region").collect()) == sorted(by_table.select("quake_id", "Region").collect())
