"""Fill-in-the-middle by a counted-quantifier regular expression.

A text is cut into units (lines by default).  ``regexp_count`` gives their number ``n``, a
hash of the document's id two cuts ``a <= b`` in 0..n, and a pattern of the row's own,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``, takes prefix, middle and suffix in one match,
whose replacement already is the output.  The counted groups are possessive: they never
give a unit back, so the match goes through the text once, in a loop and not by recursion,
however many units there are.

Forms: ``psm`` is mark P, prefix, mark S, suffix, mark M, middle; ``spm`` mark S, suffix,
mark P, prefix, mark M, middle; ``plain`` the text itself, for texts that are empty, hold a
mark, or aren't drawn.  As no transformed text holds a mark, :func:`restored` is exact.

A narrow pass of Spark's own functions: no shuffle, no Python on the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or the last one without.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, so many are transformed; of 100 transformed ones, so many as ``spm``.
FIM_PERCENT, SPM_PERCENT = 100, 50


def _draw(digest: Column, k: int) -> Column:
    """The ``k``-th group of eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _verbatim(mark: str) -> str:
    """The mark as it is in a replacement."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def _literal(mark: str) -> str:
    """The mark as it is in a pattern."""
    return re.sub(r"([^\w\s])", r"\\\1", mark)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The exact text from an output and its form."""
    p, s, m = map(_literal, marks)
    psm = F.regexp_replace(output, rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z", "$1$3$2")
    spm = F.regexp_replace(output, rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def part_chars(output: Column, form: Column,
               marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[Column, Column]:
    """Code points of prefix and middle, read off the output; null for the plain form."""
    p, s, m = marks
    at = {x: F.locate(x, output) for x in marks}
    prefix = F.when(form == "psm", at[s]).when(form == "spm", at[m]) - F.when(form == "psm", len(p) + 1) \
        .otherwise(at[p] + len(p))
    middle = F.when(form != "plain", F.length(output) - at[m] - len(m) + 1)
    return prefix.cast("long"), middle.cast("long")


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", unit: str = LINE, seed: int = SEED,
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                   marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """Per document its columns and ``fim_n`` (units), ``fim_form`` and ``fim_output``.

    ``unit`` is a Java regular expression that never matches the empty string and whose
    matches cover the text; no proper end of a mark may begin a mark.  The cuts come from
    SHA-256 of ``seed:id`` alone, so a rerun gives the same rows and rows that repeat an id
    are cut by the same draws.

    A null text counts as empty: no units, plain, output empty.  A null id is drawn as the
    empty string.  Other columns pass through unread; those called as the new ones are
    replaced.  An empty table gives no rows."""
    p, s, m = marks
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    own = [c for c in docs.columns if c not in ("fim_n", "fim_form", "fim_output")]
    d = docs.select(*own, text.alias("__text"), digest.alias("__digest"))
    d = d.select("*", F.regexp_count("__text", F.lit(unit)).cast("long").alias("fim_n"))
    held = F.col("__text") == ""
    for x in marks:
        held = held | F.col("__text").contains(x)
    cuts = [_draw(F.col("__digest"), k) % (F.col("fim_n") + 1) for k in (0, 1)]
    d = d.select(*own, "__text", "fim_n", F.least(*cuts).alias("__a"), F.greatest(*cuts).alias("__b"),
                 F.when(held | (_draw(F.col("__digest"), 2) % 100 >= fim_percent), F.lit("plain"))
                 .when(_draw(F.col("__digest"), 3) % 100 < spm_percent, F.lit("spm"))
                 .otherwise(F.lit("psm")).alias("fim_form"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{unit}){{"), F.col("__a").cast("string"), F.lit(rf"}}+)((?:{unit}){{"),
                       (F.col("__b") - F.col("__a")).cast("string"), F.lit(r"}+)(.*)\z"))
    p, s, m = map(_verbatim, marks)
    order = F.when(F.col("fim_form") == "psm", F.lit(f"{p}$1{s}$3{m}$2")).otherwise(F.lit(f"{s}$3{p}$1{m}$2"))
    output = F.when(F.col("fim_form") == "plain", F.col("__text")) \
        .otherwise(F.regexp_replace(F.col("__text"), pattern, order))
    return d.select(*own, "fim_n", "fim_form", output.alias("fim_output"))
