"""Language ID: one bit-sliced Bloom filter that answers with a mask of languages.

A slot of the filter holds a bit for each language, in as many 64-bit words as that takes.  An n-gram sets its language's bit in
``HASHES`` slots; looked up, the AND of those slots is the mask of all languages that hold
it.  Every n-gram of a text is looked up at once, and the masks' set bits are counted per
language.  A language whose bits fill a part ``f`` of the slots answers falsely with chance
``f ** HASHES``, so of ``c`` hits among ``n`` n-grams ``(c - n p) / (1 - p)`` are expected to
be real; the language with the most real hits is the text's.

An n-gram is held for a language if it is frequent there: at least ``MIN_SHARE`` of the
language's n-grams, so there are fewer than ``1 / MIN_SHARE`` a language, which bounds what
the driver gathers.  The counts come from the labelled rows, summed by Spark.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map

GRAM = 4
SLOTS = 1 << 20
HASHES = 2
MIN_SHARE = 1e-5
#: Most labelled documents a language that the filter is fitted on: those of the smallest
#: hash of their id.  A documented bound of the fit only; predictions cover every text.
FIT_DOCUMENTS = 4000
UNKNOWN = "und"
#: Code points of text worked on at once in a task.
_CHUNK = 1 << 20


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


def gram_hashes(texts: list[str], letters: np.ndarray):
    """(text number, 64-bit value) of the n-grams of lower-cased texts, in which a run of
    anything but letters is one gap, as are a text's ends.  An n-gram has two letters."""
    joined = "".join(f"\0{t.lower()} " for t in (t.replace("\0", " ") for t in texts))
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.cumsum(codes == 0) - 1
    letter = letters[codes]
    gap_run = ~letter
    keep = letter | np.concatenate(([True], letter[:-1] | (owner[1:] != owner[:-1]))) if len(codes) else letter
    codes, owner, gap_run = codes[keep], owner[keep], gap_run[keep]
    value = np.where(gap_run, 0, codes).astype(np.uint64)
    n = len(value) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    count = np.zeros(n, np.int8)
    for k in range(GRAM):
        mixed = mixed * np.uint64(0x110000) + value[k:k + n]
        count += ~gap_run[k:k + n]
    good = (owner[:n] == owner[GRAM - 1:]) & (count >= 2)
    return owner[:n][good], mixed[good]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = _mix(grams)
    step = np.uint64(64 // HASHES)
    return [((h >> (np.uint64(k) * step)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, n)``: counts summed per batch in the tasks, then by Spark."""
    def rows(letters, texts, langs):
        by_lang = {}
        for t, g in zip(texts, langs):
            by_lang.setdefault(g, []).append(t)
        for lang, own in by_lang.items():
            _, grams = gram_hashes(own, letters)
            value, n = np.unique(grams, return_counts=True)
            yield [lang] * len(value), value.view(np.int64), n

    counts = arrow_map(docs.select(text_col, lang_col), rows, "lang string, gram long, n long", setup=_letter_table)
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """The filter and its false-positive rates; ``grams`` gives (language, n-grams) pairs or
    a dictionary, of which one language is held at a time.  ``languages`` is their order."""

    def __init__(self, grams, languages: list[str] | None = None):
        self.languages = list(grams if languages is None else languages)
        number = {lang: k for k, lang in enumerate(self.languages)}
        self.table = np.zeros((SLOTS, max(1, -(-len(number) // 64))), np.uint64)
        for lang, own in grams.items() if isinstance(grams, dict) else grams:
            word, bit = divmod(number[lang], 64)
            for s in _slots(np.asarray(own, np.int64).view(np.uint64)):
                self.table[s, word] |= np.uint64(1 << bit)
        self.false = np.array([np.mean(self.table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) ** HASHES
                               for k in range(len(self.languages))])

    def counts(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each text, and hits by (text, language)."""
        owner, grams = gram_hashes(texts, letters)
        n = np.bincount(owner, minlength=len(texts))
        hits = np.zeros((len(texts), len(self.languages)))
        a, *rest = _slots(grams)
        for word in range(self.table.shape[1]):
            mask = self.table[a, word]
            for s in rest:
                mask &= self.table[s, word]
            for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                hits[:, k] = np.bincount(owner, (mask >> np.uint64(k % 64)) & np.uint64(1), len(texts))
        return n, hits

    def predict(self, texts: list[str], letters: np.ndarray) -> tuple[list[str], list[float]]:
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for lo, hi, part in _chunks(texts):
            more, found = self.counts(part, letters)
            if hi - lo == 1:  # one text may come in several parts
                n[lo] += more.sum()
                hits[lo] += found.sum(0)
            else:
                n[lo:hi], hits[lo:hi] = more, found
        real = np.clip((hits - n[:, None] * self.false) / (1 - self.false), 0, None)
        langs, scores = [], []
        for t, row, count in zip(texts, real, n):
            if not self.languages or not any(c.isalpha() for c in t):
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(row))  # of equal ones the first, which has more labels
            langs.append(self.languages[best])
            scores.append(float(min(1.0, row[best] / row.sum())) if row.sum() else 0.0)
        return langs, scores


def _chunks(texts: list[str]):
    """(first, end, texts) of about _CHUNK code points; a longer text alone, in parts that
    overlap by an n-gram less one."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield lo, k, texts[lo:k]
            lo, size = k, 0
        if len(t) > _CHUNK:
            for at in range(0, len(t), _CHUNK):
                yield k, k + 1, [t[max(0, at - GRAM + 1):at + _CHUNK]]
            lo, size = k + 1, 0
        else:
            size += len(t)
    if lo < len(texts):
        yield lo, len(texts), texts[lo:]


#: A table of so many labels is broadcast in the fit.
BROADCAST_LABELS = 10_000


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Learn from the rows that have a text and a language.

    Of each language about ``fit_documents`` rows are used, those with the smallest hash of
    id and text, so rows that share an id or have none are taken in part like others.  Every
    language is learned.  The driver takes the n-grams of one part of the languages after the
    other, fewer than 1 / MIN_SHARE each; the filter has 8 MB for each 64 languages."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1 << 16)).alias("b"))
    size = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not size:
        return Model({})
    # rows are spread evenly over the buckets, so a language's bound is a share of them
    share = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(1 << 16, -(-(fit_documents << 16) // r["count"]))) for r in size], "lang string, share long")
    # so few rows are broadcast, else the texts would be shuffled for them
    used = rows.join(F.broadcast(share) if len(size) <= BROADCAST_LABELS else share, "lang").where("b < share")
    counts = gram_counts(used, "text", "lang")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(total, "lang").where(F.col("n") >= MIN_SHARE * F.col("total"))
    grams = frequent.groupBy("lang").agg(F.collect_list("gram").alias("grams"))  # fewer than 1 / MIN_SHARE a language
    return Model(((r["lang"], r["grams"]) for r in grams.toLocalIterator()), [r["lang"] for r in size])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every row, from the whole text alone.

    ``lang_pred`` is ``und`` (score 0) for a null text, one without a letter, or a model
    without a language; of equal languages the one with more labelled rows wins, also where
    no n-gram is known.  ``score`` is the language's share of the real hits.  Narrow; the model is a fixed
    number of slots.  Repeated rows give a row each, other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(letters, ids, texts):
        langs, scores = held.value.predict([t or "" for t in texts], letters)
        yield ids, langs, scores

    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")), rows,
                     f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double",
                     setup=_letter_table)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
