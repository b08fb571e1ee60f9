"""PII: fixed patterns, and a semi-Markov conditional random field over candidate spans.

The base patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers.
The field then looks at islands, the runs of words with a digit or ``@``: it scores every
span of at most ``MAX_TOKENS`` tokens as a whole (shape, digits, check sum, what stands
beside it) for each type, and dynamic programming over the island chooses boundaries and
types together, so that spans never overlap.  What it finds beside the base spans is added:
keys and other secrets, phone numbers without a plus, spelled-out addresses.

Its weights are the most likely ones given a Gaussian prior around ``PRIOR`` and islands
labelled by the base patterns and the rule for named keys, from a bounded sample of rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Longest span in tokens (runs of letters and digits, runs of white space, single others).
MAX_TOKENS = 16
#: Rows whose islands the weights are fitted on: those of the smallest hash of id and text.
#: A documented bound of the fit only; every text is searched whole.
FIT_DOCUMENTS = 4000
#: Islands of them, again by hash.
FIT_ISLANDS = 600
FIT_STEPS = 25
#: Strength of the prior.
PRIOR_WEIGHT = 0.05

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", *m.span()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _at_most_255(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


_DIGIT = re.compile(r"[0-9]")
#: Words with a digit or @, and spelled-out addresses, one or two blanks apart.  A word is
#: looked at from its beginning only, so a long run without blanks is passed once.
_PART = (r"(?:\S+\s?[\[(]\s?at\s?[\])]\s?\S+(?:\s?[\[(]\s?dot\s?[\])]\s?\S+)+"
         r"|[^\s0-9@]*+[0-9@]\S*+)")
_ISLAND = re.compile(rf"(?<!\S){_PART}(?:\s{{1,2}}{_PART})*", re.I)
_SPELLED = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
_TOKEN = re.compile(r"[^\W_]+|\s+|.", re.S)
_AT_DOT = re.compile(r"[\w.+-]+\s?[\[(]\s?at\s?[\])]\s?[\w-]+(?:\s?[\[(]\s?dot\s?[\])]\s?[\w-]+)+", re.I | re.A)
_AREA = re.compile(r"(?:\+?[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}")
_GROUPS = re.compile(r"(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}")
_PHONE_CHARS = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")
_CARD_CHARS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_LONG = re.compile(r"[A-Za-z0-9_-]{20,}")
_HEX = re.compile(r"[0-9A-Fa-f]{32,}")
_NAMED = re.compile(r"(?:token|secret|key|password|passwd|api)\W{1,6}\Z", re.I)

FEATURES = (
    "bias", "email shape", "at without shape", "spelled address", "ip", "dotted but no ip", "plus", "phone digits",
    "card digits", "check sum", "area code", "phone groups", "hex", "mixed run", "named key", "clean edges",
    "cut on the left", "cut on the right", "card without check sum", "only digits")
_F = {f: k for k, f in enumerate(FEATURES)}

# The prior: what a span of a type looks like, before any data.
PRIOR = np.full((len(KINDS), len(FEATURES)), 0.0)
for _kind, _weights in {
    "email": {"bias": -6, "email shape": 10, "spelled address": 9, "at without shape": -2},
    "ip": {"bias": -6, "ip": 10, "dotted but no ip": -4},
    "card": {"bias": -6, "card digits": 3, "check sum": 6, "card without check sum": -8},
    "phone": {"bias": -7, "phone digits": 2, "plus": 5, "area code": 5, "phone groups": 5, "ip": -6, "only digits": -3},
    "secret": {"bias": -7, "hex": 3, "mixed run": 2, "named key": 5, "only digits": -4},
}.items():
    for _f, _w in _weights.items():
        PRIOR[KINDS.index(_kind), _F[_f]] = _w
    PRIOR[KINDS.index(_kind), [_F["cut on the left"], _F["cut on the right"]]] = -4
    PRIOR[KINDS.index(_kind), _F["clean edges"]] = 0.5


def span_features(text: str, start: int, end: int) -> list[int]:
    """Features of a whole span; none if it can't be personal data."""
    s = text[start:end]
    got = [0]

    def note(name: str, holds) -> bool:
        if holds:
            got.append(_F[name])
        return bool(holds)

    if "@" in s:
        note("at without shape", not note("email shape", _EMAIL.fullmatch(s)))
    note("spelled address", _AT_DOT.fullmatch(s))
    digits = sum("0" <= c <= "9" for c in s)
    if digits:
        if _DOTTED.fullmatch(s):
            note("dotted but no ip", not note("ip", s.count(".") == 3 and all(map(_at_most_255, s.split(".")))))
        if _PHONE_CHARS.fullmatch(s):
            note("phone digits", 10 <= digits <= 15)
            note("plus", s[0] == "+" and 10 <= digits <= 15)
            note("area code", _AREA.fullmatch(s))
            note("phone groups", _GROUPS.fullmatch(s))
        if 14 <= digits <= 19 and _CARD_CHARS.fullmatch(s):
            note("card digits", True)
            note("card without check sum", not note("check sum", luhn(_digits(s))))
        if digits < len(s) and _LONG.fullmatch(s) and any(c.isalpha() for c in s):
            note("mixed run", True)
            note("hex", _HEX.fullmatch(s))
    if len(got) == 1:
        return []
    note("named key", _NAMED.search(text, max(0, start - 16), start))
    note("only digits", digits == len(s))
    left, right = text[start - 1:start], text[end:end + 2]
    cut_left = left.isalnum() or left in ("@", "+", "_", ".", "-") and left != ""
    cut_right = right[:1].isalnum() or right[:1] in ("@", "_") and right != "" or \
        right[:1] in (".", "-") and right[:1] != "" and right[1:].isalnum()
    note("cut on the left", cut_left)
    note("cut on the right", cut_right)
    note("clean edges", not (cut_left or cut_right))
    return got


class Island:
    """Token edges of a stretch of text and its candidate spans (first token, end token, features)."""

    def __init__(self, text: str, start: int, end: int):
        self.edges = [start, *(m.end() for m in _TOKEN.finditer(text, start, end))]
        self.spans: list[tuple[int, int, list[int]]] = []
        e, n = self.edges, len(self.edges) - 1
        can = [not text[e[k]].isspace() for k in range(n)]
        # digits and at-signs so far: a span with neither enough is no candidate, but for a long mixed run
        marks = np.cumsum([0, *(sum("0" <= c <= "9" for c in text[e[k]:e[k + 1]]) + 8 * ("@" in text[e[k]:e[k + 1]])
                                for k in range(n))]).tolist()
        spelled = bool(_SPELLED.search(text, start, end))
        for i in range(n):
            if can[i]:
                for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                    m = marks[j] - marks[i]
                    if can[j - 1] and (m >= 4 or spelled or m and _LONG.fullmatch(text, e[i], e[j])) \
                            and (f := span_features(text, e[i], e[j])):
                        self.spans.append((i, j, f))

    def gold(self, spans: list[tuple[str, int, int]]) -> set[tuple[int, int, int]] | None:
        """(first token, end token, type) of labels in here; None if one doesn't fit the candidates."""
        place = {c: k for k, c in enumerate(self.edges)}
        known = {s[:2] for s in self.spans}
        out = set()
        for kind, a, b in spans:
            if a < self.edges[-1] and b > self.edges[0]:
                if (t := (place.get(a, -1), place.get(b, -1))) not in known:
                    return None
                out.add((*t, KINDS.index(kind)))
        return out


def scores(island: Island, weights: np.ndarray) -> np.ndarray:
    """By span and type."""
    return np.array([weights[:, f].sum(1) for _, _, f in island.spans]).reshape(-1, len(KINDS))


def decode(island: Island, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """The best segmentation: spans and types together, all other tokens plain (score 0)."""
    if not island.spans:
        return []
    s = scores(island, weights)
    kinds, tops = s.argmax(1), s.max(1)
    ending: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(island.spans):
        ending.setdefault(j, []).append(k)
    n = len(island.edges) - 1
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ending.get(j, ()):
            v = best[island.spans[k][0]] + tops[k]
            if v > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j:
        if (k := back[j]) < 0:
            j -= 1
        else:
            i = island.spans[k][0]
            out.append((KINDS[kinds[k]], island.edges[i], island.edges[j]))
            j = i
    return out[::-1]


def _expected(island: Island, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and the chance of each span and type."""
    s, n = scores(island, weights), len(island.edges) - 1
    total = np.logaddexp.reduce(s, 1)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    order = sorted(range(len(island.spans)), key=lambda k: island.spans[k][1])
    k = 0
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        while k < len(order) and island.spans[order[k]][1] == j:
            ahead[j] = np.logaddexp(ahead[j], ahead[island.spans[order[k]][0]] + total[order[k]])
            k += 1
    order.sort(key=lambda k: -island.spans[k][0])
    k = 0
    for i in range(n - 1, -1, -1):
        behind[i] = behind[i + 1]
        while k < len(order) and island.spans[order[k]][0] == i:
            behind[i] = np.logaddexp(behind[i], behind[island.spans[order[k]][1]] + total[order[k]])
            k += 1
    i, j = (np.array([x[k] for x in island.spans]) for k in (0, 1))
    return ahead[n], np.exp(s + (ahead[i] + behind[j] - ahead[n])[:, None])


def fit_weights(islands: list[tuple[Island, set]], steps: int = FIT_STEPS) -> np.ndarray:
    """The most likely weights given labelled islands and the prior, by gradient ascent with
    a step that halves when it would lower the objective."""
    islands = [x for x in islands if x[0].spans]
    w, step, last = PRIOR.copy(), 1.0, -np.inf
    best = w
    for _ in range(steps if islands else 0):
        value = -PRIOR_WEIGHT / 2 * np.sum((w - PRIOR) ** 2)
        up = -PRIOR_WEIGHT * (w - PRIOR)
        for island, gold in islands:
            z, chance = _expected(island, w)
            value -= z / len(islands)
            for (i, j, f), p in zip(island.spans, chance):
                for t in range(len(KINDS)):
                    right = (i, j, t) in gold
                    if right:
                        value += w[t, f].sum() / len(islands)
                    up[t, f] += (right - p[t]) / len(islands)
        if value > last:
            best, last, slope = w, value, up
        else:
            step /= 2
        w = best + step * slope
    return best


def islands_of(text: str):
    if "@" in text or _DIGIT.search(text) or _SPELLED.search(text):
        for m in _ISLAND.finditer(text):
            yield m.span()


def _labels(text: str) -> list[tuple[str, int, int]]:
    """The labels of the fit: base spans that don't overlap, and long hex runs after a key's name."""
    out: list[tuple[str, int, int]] = []
    for s in base_spans(text):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out + [("secret", *m.span()) for m in _HEX.finditer(text)
                  if _NAMED.search(text, max(0, m.start() - 16), m.start())
                  and not any(a < m.end() and b > m.start() for _, a, b in out)]


#: Hashes of rows are compared in so many bits with the part of them that the fit reads.
_SHARE_BITS = 48


def fit_share(n: int, fit_documents: int = FIT_DOCUMENTS) -> int:
    """How many of the ``2^48`` hash values the fit reads, of ``n`` rows: never none."""
    return 1 << _SHARE_BITS if n <= fit_documents else -(-(fit_documents << _SHARE_BITS) // n)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_documents: int = FIT_DOCUMENTS,
        fit_islands: int = FIT_ISLANDS) -> np.ndarray:
    """Weights from the islands of about ``fit_documents`` rows, of which at most
    ``fit_islands`` (those of the smallest hash) reach the driver."""
    share = fit_share(docs.count(), fit_documents)
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(1 << _SHARE_BITS))

    def rows(texts):
        out = []
        for t in texts:
            for a, b in islands_of(t or ""):
                a, b = max(0, a - 16), min(len(t), b + 16)
                if b - a <= 512:
                    out.append(t[a:b])
        yield (out,)

    found = arrow_map(docs.where(bucket < share).select(F.col(text_col).cast("string").alias("_t")), rows, "part string")
    sample = found.dropDuplicates(["part"]).orderBy(F.xxhash64("part"), "part").limit(fit_islands).collect()
    islands = []
    for r in sample:
        island = Island(r["part"], 0, len(r["part"]))
        gold = island.gold(_labels(r["part"]))
        if gold is not None:
            islands.append((island, gold))
    return fit_weights(islands)


def all_spans(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans; and those with what the field adds, none of which overlaps a base span."""
    base = base_spans(text)
    starts = [x for _, x, _ in base]
    reach = list(accumulate((y for _, _, y in base), max))  # the farthest end so far
    added = []
    for a, b in islands_of(text):
        for s in decode(Island(text, a, b), weights):
            before = bisect_left(starts, s[2])  # base spans that begin before its end
            if not before or reach[before - 1] <= s[1]:
                added.append(s)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find_pii(docs: DataFrame, weights: np.ndarray = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``id_col, base, spans``: arrays of (kind, start, end) in code points, by start
    and then kind; ``spans`` holds the base spans and the added ones.

    A null or empty text has none.  Whole texts are searched; an island of any length is
    one dynamic program of bounded spans.  Repeated rows give a row each, an empty table
    none; other columns are not read.  Narrow: no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    spans = "array<struct<kind:string,start:long,end:long>>"

    def rows(ids, texts):
        base, every = [], []
        for t in texts:
            for column, found in zip((base, every), all_spans(t or "", held.value)):
                column.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        yield ids, base, every

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t")), rows,
                     f"{id_col} {kind}, base {spans}, spans {spans}")


def listed(spans: str) -> Column:
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, weights: np.ndarray = PRIOR, text_col: str = "text") -> DataFrame:
    """The documents with each span's text replaced by its kind in angle brackets; of
    overlapping spans the first is replaced.  Same columns; a null text stays null."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    k = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = []
            for t in batch.column(k).to_pylist():
                parts, last = [], 0
                for kind, a, b in all_spans(t or "", held.value)[1]:
                    if a >= last:
                        parts += [t[last:a], f"<{kind}>"]
                        last = b
                out.append(t if t is None else "".join([*parts, t[last:]]))
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)
