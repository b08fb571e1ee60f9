"""Benchmark decontamination: a broadcast set of test n-grams against every training window.

Words are runs of digits, letters a to z (upper case lowered) and everything beyond ASCII.
A benchmark item gives its windows of ``window`` consecutive words; a shorter item with a
word is one window by itself.  The windows of a block of items are broadcast as a hash set
keyed by 64-bit rolling hashes; a document's window that meets a key is verified word by
word before it counts.  Blocks hold at most ``block_bytes`` of item text, so what is
broadcast at once is bounded whatever the benchmark's size: a larger one is scanned in
several blocks, whose hits are put together per document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import arrow_map, utf8
from faultline.session import drop_tables, materialize, materialize_observed

WINDOW = 10
#: Most bytes of item text in one broadcast block.
BLOCK_BYTES = 16_000_000

#: Bytes that are part of a word map to themselves (A-Z to a-z), all others to a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _window_hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``size`` word numbers from each place in ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * _BASE + ids[at + k].astype(np.uint64)
    return out


class _Windows:
    """The distinct windows of one length: sorted hashes, a place of each, and the items of each."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, item: np.ndarray, size: int):
        self.ids, self.size = ids, size
        h = _window_hashes(ids, at, size)
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        like = np.ones(len(h), bool)  # the same words as the first of its hash
        for k in range(size):
            like &= ids[at + k] == ids[at[first][group] + k]
        # windows of equal hash and other words, if there ever are any, are kept by their words
        self.others: dict[bytes, set[int]] = {}
        for k in np.flatnonzero(~like).tolist():
            self.others.setdefault(self._words(at[k]), set()).add(int(item[k]))
        self.hashes, self.place = h[first], at[first]
        group, item = group[like], item[like]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])))
        self.item = item[new]
        self.edges = np.searchsorted(group[new], np.arange(len(first) + 1))

    def _words(self, place: int) -> bytes:
        return self.ids[place:place + self.size].tobytes()

    def found(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which places of a text begin a window of an item, and the items."""
        h = _window_hashes(ids, at, self.size)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        near = np.flatnonzero(self.hashes[k] == h)
        at, k = at[near], k[near]
        same = np.ones(len(at), bool)
        for j in range(self.size):
            same &= ids[at + j] == self.ids[self.place[k] + j]
        items: set[int] = set()
        for g in np.unique(k[same]).tolist():
            items.update(self.item[self.edges[g]:self.edges[g + 1]].tolist())
        if self.others:
            for j, p in enumerate(at.tolist()):
                if own := self.others.get(ids[p:p + self.size].tobytes()):
                    same[j] = True
                    items |= own
        return at[same], items


class WindowSet:
    """The windows of some items, by length in words."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.names = [i for i, _ in items]
        parts = [[number(w, len(self.vocabulary) + 1) for w in words(t)] for _, t in items]
        length = np.array([len(p) for p in parts], np.int64)
        ids = np.fromiter((w for p in parts for w in p), np.int64, int(length.sum()))
        begin = np.cumsum(length) - length
        size = np.minimum(window, length)
        self.windows: list[_Windows] = []
        for s in np.unique(size[size > 0]).tolist():
            of = np.flatnonzero(size == s)
            many = length[of] - s + 1
            item = np.repeat(of, many)
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            self.windows.append(_Windows(ids, np.repeat(begin[of], many) + step, item, s))

    def hits(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Word ranges (start, end) of the windows that occur, and the items they are of."""
        look = self.vocabulary.get
        ids = np.fromiter((look(w, 0) for w in text_words), np.int64, len(text_words))
        spans, items = [], set()
        # only windows that lie wholly within known words can match
        good = np.cumsum(np.concatenate(([0], ids > 0)))
        for w in self.windows:
            if len(ids) < w.size:
                continue
            at = np.flatnonzero(good[w.size:] - good[:-w.size] == w.size)
            if not len(at):
                continue
            at, own = w.found(ids, at)
            spans += [(p, p + w.size) for p in at.tolist()]
            items |= own
        return _merged(spans), sorted({self.names[k] for k in items})


#: The last set of windows made in this process, with the name of its block.
_LAST: dict[str, WindowSet] = {}


def _window_set(name: str, items: list[tuple[str, bytes | None]], window: int) -> WindowSet:
    """The windows of a broadcast block, made once in each worker process."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = WindowSet(items, window)
    return _LAST[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """The items as (id, text) lists of at most ``block_bytes`` of text each (or one item).

    The driver sees one block at a time: sizes are summed first, then rows stream through
    ``toLocalIterator``, which holds one partition."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), utf8(text_col).alias("t"))
    rows = rows.where("i IS NOT NULL AND t IS NOT NULL").orderBy("i", "t")
    block, used = [], 0
    for r in rows.toLocalIterator():
        text = bytes(r["t"])
        if block and used + len(text) > block_bytes:
            yield block
            block, used = [], 0
        block.append((r["i"], text))
        used += len(text)
    yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: ``id_col, n_words, n_hit, n_items, items`` (sorted strings), ``spans``
    (word ranges hit, merged) and ``contaminated``.

    A null or empty text has no words and no hits; items without an id, text or word give
    no window; an empty benchmark hits nothing; equal items each count.  Every row gives one
    row, repeated ones too (with several blocks, rows of equal id and text are told apart
    by a row number within the written first scan).  Other columns are not read.  Texts are
    scanned whole; only the word numbers of one document are held at a time.
    """
    spark = docs.sparkSession
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words long, " \
             "items array<string>, spans array<struct<start:long,end:long>>"

    def scanned(source: DataFrame, held, more: str = "") -> DataFrame:
        def rows(found, ids, texts, *rest):
            for k, (i, t) in enumerate(zip(ids, texts)):
                w = words(t)
                spans, items = found.hits(w)
                yield [i], [len(w)], [items], [[{"start": a, "end": b} for a, b in spans]], *([r[k]] for r in rest)
        name = uuid.uuid4().hex
        return arrow_map(source, rows, schema + more, setup=lambda: _window_set(name, held.value, window))

    d = docs.select(F.col(id_col), utf8(text_col).alias("_t"))
    blocks = _item_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        found = scanned(d, spark.sparkContext.broadcast(block))
    else:
        d, found = materialize(d.withColumn("_row", F.monotonically_increasing_id()), "decontaminate"), None
        while block is not None:  # one block's broadcast at a time: its scan is written before the next
            held = spark.sparkContext.broadcast(block)
            part = materialize(scanned(d, held, ", _row long"), "decontaminate-found")
            held.destroy()
            found = part if found is None else found.unionByName(part)
            block, following = following, next(blocks, None)
        drop_tables(d)
        found = found.groupBy("_row").agg(
            F.first(id_col).alias(id_col), F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            _merge_spans(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        "items", "spans", (n_hit > 0).alias("contaminated"))


def _merge_spans(spans):
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(spans, empty, lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["start"].alias("start"),
            F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(a, F.array(s))))


def cut_spans(text: str, found: WindowSet) -> str:
    """The text without the words of any window that occurs, to the end of the last word of
    each run; cut again while the cut itself has made a window."""
    while True:
        folded = text.encode().translate(_FOLD)
        places, at = [], 0
        for w in folded.split():
            at = folded.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        spans, _ = found.hits([folded[a:b] for a, b in places])
        if not spans:
            return text
        raw, out, last = text.encode(), [], 0
        for a, b in spans:
            out.append(raw[last:places[a][0]])
            last = places[b - 1][1]
        text = b"".join([*out, raw[last:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without the benchmark, with the same columns.

    ``mode="documents"`` drops each document with a hit; ``"spans"`` keeps every document
    and cuts the hit words out of its text.  One narrow pass per block of items: no shuffle;
    of several blocks each pass is written before the next block is broadcast, and spans are
    cut again until no block has any in what is left.  A null text stays as it is.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is 'documents' or 'spans', not {mode!r}")
    spark, out, before = docs.sparkSession, docs, None
    k = docs.columns.index(text_col)
    cut = T.StructType([*docs.schema.fields, T.StructField("_decontaminate_cut", T.BooleanType())])
    while True:
        blocks = _item_blocks(benchmark, item_col, item_text_col, block_bytes)
        block, following, any_cut, several = next(blocks), next(blocks, None), False, False
        while block is not None:
            held, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

            def run(batches, held=held, name=name):
                import pyarrow as pa
                found = _window_set(name, held.value, window)
                for batch in batches:
                    texts = batch.column(k).to_pylist()
                    if mode == "documents":
                        yield batch.filter(pa.array([not found.hits(words((t or "").encode()))[0] for t in texts], pa.bool_()))
                    else:
                        new = [t if t is None else cut_spans(t, found) for t in texts]
                        field = batch.schema.field(k)
                        yield batch.set_column(k, field, pa.array(new, field.type)).append_column(
                            "_decontaminate_cut", pa.array([a != b for a, b in zip(new, texts)], pa.bool_()))

            several |= following is not None
            if mode == "documents":
                out = out.mapInArrow(run, docs.schema)
            else:
                out = out.mapInArrow(run, cut)
            if several:  # one broadcast at a time, one table kept
                if mode == "documents":
                    out = materialize(out, "decontaminate")
                else:
                    out, seen = materialize_observed(out, "decontaminate", docs.columns,
                                                     n=F.count_if("_decontaminate_cut"))
                    any_cut |= seen["n"] > 0
                held.destroy()
                drop_tables(before)
                before = out
            else:
                out = out.select(*docs.columns)
            block, following = following, next(blocks, None)
        # with several blocks, a cut may have joined a window of another block
        if not any_cut:
            return out
