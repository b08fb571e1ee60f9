"""Line-first cleaning: rules drop lines, then documents that lose too much text.

Every line is judged by itself, all with Spark's own functions (no Python on the rows):

* navigation: its separators such as ``|`` number a large part of its words;
* boilerplate: it is short and says one of the fixed phrases, its symbols (or ``!!``)
  number a large part of its words, all its letters are capitals, or a few words make up
  nearly all of it;
* punctuation: it has several words and no sentence end (``.!?:;"'`` or a closing bracket
  or their kin, or the sentence end of any script) anywhere, and none of its letters are of
  a script written without sentence marks.

Lines that fail are removed.  A document is kept if it passes the base rules (at least
50 words; at most half of them in repeated 3-word windows) and the lines that stay hold
at least ``min_kept`` of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import SPACES

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Least part of a document's words that its good lines must hold.
MIN_KEPT = 0.5
#: A line of fewer words is too short for the rules on shares of words.
SHARE_MIN_WORDS = 4
#: Phrases mark a line of at most so many words; a longer one is prose that mentions them.
PHRASE_MAX_WORDS = 30
MAX_SEPARATORS_PER_WORD = 0.2
MAX_SYMBOLS_PER_WORD = 0.5
MAX_SHOUTS_PER_WORD = 0.3
#: Of a line of at least four times SHARE_MIN_WORDS words.
MIN_DISTINCT_SHARE = 0.25

# Characters counted as symbols, separators between menu entries, characters
# that end a sentence, and phrases that mark a line as boilerplate (in lower case).
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»•·"
ENDS = ".!?:;…。！？\"'”’)]"
#: Unicode's sentence terminals beyond these (Armenian, Arabic, Indic, Ethiopic, Khmer, full-width
#: and others), Tibetan shads, and the stops, colons and closing brackets of the scripts that have their own.
STOPS = (
    "\\u0589\\u055C\\u055E\\u037E\\u061B\\u061D-\\u061F\\u06D4\\u0700-\\u0702\\u07F9\\u0837\\u0839\\u083D\\u083E\\u0964\\u0965"
    "\\u0DF4\\u0F0D-\\u0F12\\u104A\\u104B\\u1362-\\u1368\\u166E\\u1735\\u1736\\u17D4-\\u17D6\\u1803\\u1809\\u1944\\u1945"
    "\\u1AA8-\\u1AAB\\u1B4E\\u1B4F\\u1B5A\\u1B5B\\u1B5E\\u1B5F\\u1B7D-\\u1B7F\\u1C3B\\u1C3C\\u1C7E\\u1C7F\\u2024\\u203C\\u203D"
    "\\u2047-\\u2049\\u2CF9-\\u2CFB\\u2E2E\\u2E3C\\u2E53\\u2E54\\u300D\\u300F\\uA4FF\\uA60E\\uA60F\\uA6F3\\uA6F7\\uA876\\uA877"
    "\\uA8CE\\uA8CF\\uA92F\\uA9C8\\uA9C9\\uAA5D-\\uAA5F\\uAAF0\\uAAF1\\uABEB\\uFE12\\uFE15\\uFE16\\uFE52\\uFE56\\uFE57"
    "\\uFF09\\uFF0E\\uFF1A\\uFF1B\\uFF61"
    "\\x{10A56}\\x{10A57}\\x{10F55}-\\x{10F59}\\x{10F86}-\\x{10F89}\\x{11047}\\x{11048}\\x{110BE}-\\x{110C1}"
    "\\x{11141}-\\x{11143}\\x{111C5}\\x{111C6}\\x{111CD}\\x{111DE}\\x{111DF}\\x{11238}\\x{11239}\\x{1123B}\\x{1123C}"
    "\\x{112A9}\\x{1144B}\\x{1144C}\\x{115C2}\\x{115C3}\\x{115C9}-\\x{115D7}\\x{11641}\\x{11642}\\x{1173C}-\\x{1173E}"
    "\\x{11944}\\x{11946}\\x{11A42}\\x{11A43}\\x{11A9B}\\x{11A9C}\\x{11C41}\\x{11C42}\\x{11EF7}\\x{11EF8}\\x{11F43}\\x{11F44}"
    "\\x{16A6E}\\x{16A6F}\\x{16AF5}\\x{16B37}\\x{16B38}\\x{16B44}\\x{16E98}\\x{1BC9F}\\x{1DA88}")
#: Scripts whose prose has blanks where others have stops.
UNMARKED = "\\p{IsThai}\\p{IsLao}\\p{IsTai_Le}\\p{IsNew_Tai_Lue}\\p{IsTai_Viet}"
PHRASES = [
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "lorem ipsum",
    "subscribe to our newsletter",
    "sign in",
    "read more",
    "licensed under",
    "released under",
]


def _words(text: Column) -> Column:
    """Words of a text without a null; ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once (a lambda's argument is; a repeated
    expression inside a lambda is not)."""
    return F.transform(F.array(value), body)[0]


def line_failure(line: Column) -> Column:
    """The first rule that a line fails (``navigation``, ``boilerplate``, ``punctuation``),
    or ``''``.  A line without a word passes."""

    def judged(w: Column) -> Column:
        return _let(F.size(w), lambda n: F.when(n == 0, "").when(
            n <= PHRASE_MAX_WORDS,
            F.when(_says_phrase(line), "boilerplate").otherwise(_shares(line, w, n))
        ).otherwise(_shares(line, w, n)))

    return _let(_words(line), judged)


def _says_phrase(line: Column) -> Column:
    def any_of(low: Column) -> Column:
        found = F.contains(low, F.lit(PHRASES[0]))
        for p in PHRASES[1:]:
            found = found | F.contains(low, F.lit(p))
        return found

    # substrings first, which is cheap; few lines hold one
    whole = r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(PHRASES) + r")(?![\p{L}\p{M}\p{N}])"
    return _let(F.lower(line), lambda low: any_of(low) & F.rlike(low, F.lit(whole)))


def _shares(line: Column, words: Column, n: Column) -> Column:
    def has(chars: str) -> Column:
        return F.rlike(line, F.lit("[" + chars.replace("]", "\\]") + "]"))

    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        F.when(n < SHARE_MIN_WORDS, "")
        .when(has(SEPARATORS) & (_count(line, SEPARATORS) > MAX_SEPARATORS_PER_WORD * n), "navigation")
        .when(has(SYMBOLS) & (_count(line, SYMBOLS) > MAX_SYMBOLS_PER_WORD * n), "boilerplate")
        .when(shouts > MAX_SHOUTS_PER_WORD * n, "boilerplate")
        .when((F.upper(line) == line) & (F.lower(line) != line), "boilerplate")
        .when((n >= 4 * SHARE_MIN_WORDS) & (F.size(F.array_distinct(words)) < MIN_DISTINCT_SHARE * n), "boilerplate")
        .when(~(has(ENDS) | F.rlike(line, F.lit(f"[{STOPS}{UNMARKED}]"))), "punctuation")
        .otherwise("")
    )


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice, each word once.

    Windows of one text are compared by a 64-bit hash.  Where all differ, the answer is
    zero; else they are sorted with their places, so that equal ones are neighbours."""

    def marked(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]))
            return F.size(F.array_distinct(F.flatten(
                F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, places))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3),
                          lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, marked))


def quality_rules(docs: DataFrame, text_col: str = "text", min_kept: float = MIN_KEPT) -> DataFrame:
    """Per document its columns ``docs.columns`` and a struct ``_quality`` of

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (base counts),
    ``n_lines, n_failed_lines`` (with a word), ``kept_words``, ``clean_text`` (the lines
    that stay), ``base_failed`` and ``kept``.

    A null text has no words, so it fails the base rules; its clean text is null.  A text
    of blank lines is the same with itself as clean text.  Repeated documents are judged
    each by itself, an empty table gives no rows, other columns pass through unread (one
    called ``_quality`` is replaced).  One narrow pass: no shuffle, whole texts.
    """
    q = F.col("_quality")

    def bound(d: DataFrame, **fields: Column) -> DataFrame:
        """Fields worked out once: what follows a generator isn't merged into what feeds it."""
        s = F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()])))
        return d.withColumn("__quality_next", s).drop("_quality").withColumnRenamed("__quality_next", "_quality")

    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = bound(docs.drop("_quality"), t=t, w=_words(t), l=F.split(t, "\n"))
    d = bound(d, t=q["t"], w=q["w"], l=F.filter(q["l"], lambda x: F.rlike(x, F.lit(f"[^{SPACES}]"))),
              j=F.transform(q["l"], lambda x: F.struct(x.alias("line"), line_failure(x).alias("failure"))))
    d = bound(
        d,
        n_words=F.size(q["w"]).cast("long"),
        word_chars=F.aggregate(q["w"], F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        n_symbols=_count(q["t"], SYMBOLS).cast("long"),
        n_dup_lines=(F.size(q["l"]) - F.size(F.array_distinct(q["l"]))).cast("long"),
        n_repeat_words=_repeated_words(q["w"]).cast("long"),
        n_lines=F.size(q["l"]).cast("long"),
        n_all=F.size(q["j"]),
        good=F.transform(F.filter(q["j"], lambda x: x["failure"] == ""), lambda x: x["line"]))
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEATED_PERCENT * q["n_words"])
    d = bound(
        d, **{c: q[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")},
        n_failed_lines=(q["n_all"] - F.size(q["good"])).cast("long"),
        clean_text=F.when(F.col(text_col).isNotNull(), F.concat_ws("\n", q["good"])),
        kept_words=F.aggregate(q["good"], F.lit(0).cast("long"), lambda a, x: a + F.size(_words(x))),
        base_failed=failed)
    return d.withColumn("_quality", q.withField(
        "kept", ~q["base_failed"] & (q["kept_words"] >= min_kept * q["n_words"])))


def quality_filter(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents that :func:`quality_rules` keeps, with the same columns; the text is
    the lines that stay, and ``length_col`` (if given) its code points."""
    q = quality_rules(docs, text_col).where("_quality.kept")
    new = {text_col: F.col("_quality.clean_text")}
    if length_col:
        new[length_col] = F.length("_quality.clean_text").cast(docs.schema[length_col].dataType)
    return q.withColumns(new).select(*docs.columns)
