"""Fuzzy line dedup: MinHash bands, exact Jaccard verification, distributed union-find.

A line is its characters without white space at its ends; blank lines take no part.  Its
shingles are its runs of ``SHINGLE`` characters (a shorter line is one), compared by 64-bit
hashes.  Lines whose shingles have a Jaccard similarity of ``threshold`` or more are linked,
links make components, and of each component the line that comes first (by document id,
then line number) is kept, wherever else its members stand.

1. Every distinct line gets ``BANDS`` hashes of ``ROWS`` MinHashes each.  Bands that only
   one line has are dropped by a pre-aggregated minimum and maximum; the smallest line of a
   shared band is its pivot, and lines that share a pivot are a group.  Two lines of
   similarity 0.8 meet with a chance above 0.99, of 0.9 above 0.9999.
2. Only lines in groups are read again, told by a Bloom filter of bounded size (a join
   after it is exact).  Groups are cut into blocks of at most ``BLOCK`` lines; each block
   and the pivot are compared whole, by a product of shingle counts, and only links that
   connect leave the task.
3. After union-find, lines of a cut group that haven't come to their pivot's component are
   compared with every line of the group, block by block, and union-find runs again.  All
   pairs of a group are then linked, known to be unlike, or connected already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import SPACES, arrow_map
from faultline.llm.simhash import spanning_forest
from faultline.operators.components import connected_components
from faultline.session import drop_tables, materialize, materialize_observed

SHINGLE = 8
THRESHOLD = 0.8
BANDS = 7
ROWS = 3
#: Most lines of a group that are compared in one task row; two blocks meet for the rest.
BLOCK = 256
#: Largest filter of lines to read again, in bits (32 MB); what passes it falsely is joined away.
#: Above about 10^8 shared lines more and more lines pass it: results stay exact, joins grow.
MAX_FILTER_BITS = 1 << 28
#: Lines remembered in a task, so that a copy in the same task needs no second signature.
_SEEN = 1 << 17
#: Shingles hashed, and matrix columns multiplied, at once.
_HASH_CHUNK = 1 << 16
_SLICE = 1 << 21
_COLUMNS = 4096
#: Up to so many lines are compared as Python sets of shingles, which is quicker.
_FEW = 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors and masks of the MinHash permutations of 32-bit values.
_FACTORS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(32)
            ).astype(np.uint32) | np.uint32(1)
_MASKS = (np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_doc, _text_id, _line_no, _line, _id, _id2)`` of every line that isn't blank: its
    document's id and text hash, its number in the text from 0, and two 64-bit hashes of
    different seeds, together its identity."""
    text = F.col(text_col).cast("string")
    # hashed here, as what is said beside a generator is worked out for each of its rows
    d = docs.select(F.col(id_col).alias("_doc"), text_id(text).alias("_text_id"), text.alias("_text"))
    d = d.select("_doc", "_text_id", F.posexplode(F.split("_text", "\n")).alias("_line_no", "_raw"))
    line = F.btrim("_raw", F.lit(" \t\n\x0b\x0c\r"))
    d = d.select("_doc", "_text_id", F.col("_line_no").cast("long"), line.alias("_line")).where("_line <> ''")
    return d.select("*", F.xxhash64("_line").alias("_id"), F.xxhash64(F.lit(1), "_line").alias("_id2"))


def text_id(text: Column) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.lit(2), text)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all lines, and the first place of each line's."""
    size = np.array([len(x) for x in lines], np.int64)
    short = np.maximum(SHINGLE - size, 0)
    # a short line is filled up to one shingle with NULs
    codes = np.frombuffer("".join(x if len(x) >= SHINGLE else x + "\0" * (SHINGLE - len(x)) for x in lines)
                          .encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size += short
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _BASE + codes[k:k + n] + np.uint64(1)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    starts = np.cumsum(size) - size
    inside = np.ones(n, bool)
    for k in range(1, SHINGLE):  # runs that cross into the next line
        inside[starts[1:] - k] = False
    count = size - SHINGLE + 1
    return h[inside], np.cumsum(count) - count


def signatures(lines: list[str]) -> np.ndarray:
    """Band hashes by (line, band), as signed longs."""
    h, starts = shingle_hashes(lines)
    h = (h >> np.uint64(32)).astype(np.uint32)
    moved = np.empty_like(h)
    out = np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        mixed = np.full(len(lines), band + 1, np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(h, _MASKS[row], out=moved)
            np.multiply(moved, _FACTORS[row], out=moved)
            mixed = (mixed ^ np.minimum.reduceat(moved, starts)) * _BASE
            mixed ^= mixed >> np.uint64(32)
        out[:, band] = mixed
    return out.view(np.int64)


def _chunks(lines: list[str]):
    lo = size = 0
    for k, x in enumerate(lines):
        if size and size + len(x) > _HASH_CHUNK:
            yield lo, k
            lo, size = k, 0
        size += len(x)
    if lo < len(lines):
        yield lo, len(lines)


def banded_lines(lines: DataFrame) -> DataFrame:
    """``(_doc, _text_id, _line_no, _id, _id2, bands)`` of every line; ``bands`` only where the
    line is new in its task, else null."""
    lines = lines.select("_doc", "_text_id", "_line_no", "_id", "_id2", "_line")
    out = T.StructType([*lines.schema.fields[:-1], T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(out)
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > _SEEN:
                seen.clear()
            ids, texts = batch.column("_id").to_pylist(), batch.column("_line")
            new = [k for k, i in enumerate(ids) if not (i in seen or seen.add(i))]
            fresh = (texts.take(pa.array(new, pa.int64())) if len(new) < len(ids) else texts).to_pylist()
            found = [signatures(fresh[a:b]) for a, b in _chunks(fresh)]
            flat = np.concatenate(found).ravel() if found else np.zeros(0, np.int64)
            size = np.zeros(len(ids), np.int64)
            size[new] = BANDS
            none = np.ones(len(ids), bool)
            none[new] = False
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()),
                                             pa.array(flat), mask=pa.array(none))
            columns = [batch.column(n) for n in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, bands.cast(schema.field("bands").type)], schema=schema)

    return lines.mapInArrow(run, out)


class Filter:
    """A Bloom filter of longs, two bits each."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        got = np.ones(len(values), bool)
        for h in (values.view(np.uint64), values.view(np.uint64) * _BASE ^ np.uint64(0x5851F42D4C957F2D)):
            h = (h ^ (h >> np.uint64(32))) & self.mask
            got &= (self.words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)) == 1
        return got


def bloom(values: DataFrame, n: int) -> Filter:
    """A filter of the longs of a one-column table of ``n`` rows: 16 bits a row, but never more
    than MAX_FILTER_BITS.  Tasks set bits, Spark ORs the words, the driver gets those alone,
    packed by the batch: 12 bytes a word, never a row for each."""
    bits = 1 << 12
    while bits < 16 * n and bits < MAX_FILTER_BITS:
        bits <<= 1
    mask = np.uint64(bits - 1)

    def rows(v):
        v = np.array(v, np.int64)
        words = np.zeros(bits // 64, np.uint64) if len(v) > bits // 256 else {}
        for h in (v.view(np.uint64), v.view(np.uint64) * _BASE ^ np.uint64(0x5851F42D4C957F2D)):
            h = (h ^ (h >> np.uint64(32))) & mask
            place, bit = (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))
            if isinstance(words, dict):
                for p, b in zip(place.tolist(), bit.tolist()):
                    words[p] = words.get(p, 0) | b
            else:
                np.bitwise_or.at(words, place, bit)
        if isinstance(words, dict):
            place = np.array(list(words), np.int64)
            words = np.array(list(words.values()), np.uint64)
        else:
            place = np.flatnonzero(words)
            words = words[place]
        yield place.tolist(), words.view(np.int64).tolist()

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns],
                                             names=["places", "words"])

    got = arrow_map(values, rows, "place int, word long").groupBy("place").agg(F.bit_or("word").alias("word"))
    words = np.zeros(bits // 64, np.uint64)
    for part in got.mapInArrow(packed, "places binary, words binary").collect():
        words[np.frombuffer(part["places"], np.int32)] = np.frombuffer(part["words"], np.uint64)
    return Filter(words)


def similar_pairs(lines: list[str], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of lines whose shingle sets have at least that Jaccard similarity.

    A few lines are compared as sets of strings.  Else intersections come from a product of 0/1 matrices over the shingles that two lines or
    more share; hash ranges are worked on one after the other, which bounds memory."""
    n = len(lines)
    if n <= _FEW and max(map(len, lines)) < _SLICE:
        sets = [{x[k:k + SHINGLE] for k in range(max(1, len(x) - SHINGLE + 1))} for x in lines]
        links = [(a, b) for a in range(n) for b in range(a + 1, n)
                 if (both := len(sets[a] & sets[b])) >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9]
        return np.array([a for a, _ in links], np.int64), np.array([b for _, b in links], np.int64)
    shared = np.zeros((n, n), np.float64)
    size = np.zeros(n, np.int64)
    total = sum(map(len, lines))
    slices = 1 + total // _SLICE
    for s in range(slices):
        value, owner = [], []
        for a, b in _chunks(lines):
            h, starts = shingle_hashes(lines[a:b])
            own = np.repeat(np.arange(a, b), np.diff(np.append(starts, len(h))))
            if slices > 1:
                use = h % np.uint64(slices) == s
                h, own = h[use], own[use]
            value.append(h)
            owner.append(own)
        value, owner = np.concatenate(value), np.concatenate(owner)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[first], owner[first]
        size += np.bincount(owner, minlength=n)
        column = np.cumsum(np.concatenate(([True], value[1:] != value[:-1]))) - 1 if len(value) else value.astype(np.int64)
        many = np.bincount(column)[column] > 1 if len(value) else np.zeros(0, bool)
        column, owner = column[many], owner[many]
        if not len(column):
            continue
        column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
        edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + _COLUMNS, _COLUMNS))
        for a, b, base in zip(edges, edges[1:], range(0, column[-1] + 1, _COLUMNS)):
            m = np.zeros((n, min(_COLUMNS, column[-1] + 1 - base)), np.float32)
            m[owner[a:b], column[a:b] - base] = 1
            shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    x, y = np.nonzero(np.triu(shared >= threshold * union - 1e-9, 1))
    return x, y


def _verified(tasks: DataFrame, threshold: float) -> DataFrame:
    """``(u, v)`` links of lines, each a struct of its two hashes, from rows of ``members``,
    arrays of (id, id2, line)."""
    def rows(groups):
        for members in groups:
            by_key = {(m["id"], m["id2"]): m["line"] for m in members}
            if len(by_key) < 2:
                continue
            keys = list(by_key)
            x, y = similar_pairs(list(by_key.values()), threshold)
            node, root = spanning_forest(len(keys), x, y)
            if len(node):
                yield tuple([{"id": keys[k][0], "id2": keys[k][1]} for k in side] for side in (node, root))

    key = "struct<id:long,id2:long>"
    return arrow_map(tasks.select("members"), rows, f"u {key}, v {key}")


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(node, component)``, structs of a line's two hashes, for lines that are like another
    and not the smallest of their component; and the places of all lines, written once."""
    lines = lines_of(docs, id_col, text_col)
    places = materialize(banded_lines(lines), "line-places")
    sigs = places.where("bands IS NOT NULL").select(F.col("_id").alias("id"), "bands")
    shared, seen = materialize_observed(
        sigs.select("id", F.explode("bands").alias("band")).groupBy("band")
        .agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").select("band", "pivot"),
        "line-buckets", n=F.count(F.lit(1)))
    held = docs.sparkSession.sparkContext.broadcast(bloom(shared.select("band"), seen["n"]))

    pair = T.StructType([T.StructField("id", T.LongType()), T.StructField("band", T.LongType())])

    def banded(batches):
        for batch in batches:
            b = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            line, place = np.nonzero(held.value(b.ravel()).reshape(b.shape))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[line]), pa.array(b[line, place])],
                                             names=["id", "band"])

    members, seen = materialize_observed(
        sigs.mapInArrow(banded, pair).join(shared, "band").select("pivot", "id").distinct(),
        "line-members", n=F.count(F.lit(1)))
    drop_tables(shared)
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(members.select("id").distinct(), seen["n"]))

    lines = lines.select("_id", "_id2", "_line")
    text = T.StructType([T.StructField("id", T.LongType()), T.StructField("id2", T.LongType()),
                         T.StructField("line", T.StringType())])

    def again(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        schema, seen = to_arrow_schema(text), set()
        for batch in batches:
            if len(seen) > _SEEN:
                seen.clear()
            batch = batch.filter(pa.array(wanted.value(batch.column("_id").to_numpy())))
            own = zip(batch.column("_id").to_pylist(), batch.column("_id2").to_pylist())
            new = [k for k, i in enumerate(own) if not (i in seen or seen.add(i))]
            batch = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema)], schema=schema)

    found = lines.mapInArrow(again, text)
    texts = materialize(found.repartition("id").dropDuplicates(["id", "id2"]), "line-texts")

    # the first blocks: each with its group's pivot
    split = F.ceil(F.count(F.lit(1)) / block).cast("int")
    size, cut = materialize_observed(members.groupBy("pivot").agg(split.alias("blocks")), "line-groups",
                                     n=F.sum((F.col("blocks") > 1).cast("long")))
    placed = members.join(size, "pivot").select(
        "pivot", "id", F.explode(F.when(F.col("id") == F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1))
                                 .otherwise(F.array(F.pmod(F.xxhash64("id"), "blocks").cast("int")))).alias("block"))
    member = F.struct("id", "id2", "line")
    tasks = placed.join(texts, "id").groupBy("pivot", "block").agg(F.collect_list(member).alias("members"))
    links = materialize(_verified(tasks, threshold), "line-links")
    label = connected_components(links, local=True)
    if cut["n"]:
        more, found = _rest(members.join(size.where("blocks > 1"), "pivot"), texts, label, threshold, block)
        if found["n"]:
            stars = label.select(F.col("node").alias("u"), F.col("component").alias("v"))
            label = connected_components(stars.unionByName(more), local=True)
    drop_tables(texts, members)
    return label, places


def _rest(members: DataFrame, texts: DataFrame, label: DataFrame, threshold: float, block: int):
    """Links of the lines of cut groups outside their pivot's component with all of the group,
    and their number."""
    key = F.struct("id", "id2")
    known = members.join(texts.select("id", "id2"), "id").withColumn("node", key) \
        .join(label, "node", "left") \
        .select("pivot", "id", "id2", "blocks", F.coalesce("component", "node").alias("component"))
    known = materialize(known, "line-known")
    centre = known.where("id = pivot").groupBy("pivot").agg(F.min("component").alias("centre"))
    rest = materialize(known.join(centre, "pivot").where("component <> centre").select("pivot", "id", "id2", "blocks"),
                       "line-rest")
    size = rest.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rests"))
    own = F.xxhash64("id", "id2")
    every = known.join(size, "pivot").select(
        "pivot", "id", "id2", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("r"),
        F.pmod(own, "blocks").cast("int").alias("b"))
    alone = rest.join(size, "pivot").select(
        "pivot", "id", "id2", F.pmod(own, "rests").cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    tasks = every.unionByName(alone).join(texts, ["id", "id2"]) \
        .groupBy("pivot", "r", "b").agg(F.collect_list(F.struct("id", "id2", "line")).alias("members"))
    return materialize_observed(_verified(tasks, threshold), "line-links", n=F.count(F.lit(1)))


def _among(places: DataFrame, ids: Filter, inside: bool) -> DataFrame:
    """The places whose line passes a filter, or those whose line doesn't."""
    held = places.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value(batch.column("_id").to_numpy()) == inside))

    return places.mapInArrow(run, places.schema)


def _firsts(places: DataFrame, label: DataFrame) -> tuple[DataFrame, int]:
    """``(_id, _id2, _first)`` of every line whose component has another line, and their
    number: ``_first`` is the place (doc, text_id, line_no) of the line that is kept."""
    # null ids come last
    place = F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("doc"), F.col("_text_id").alias("text_id"),
                     F.col("_line_no").alias("line_no"))
    label = label.select(F.col("node.id").alias("_id"), F.col("node.id2").alias("_id2"),
                         F.col("component.id").alias("_c"), F.col("component.id2").alias("_c2"))
    centres = label.select(F.col("_c").alias("_id"), F.col("_c2").alias("_id2"), "_c", "_c2").distinct()
    # a row for each distinct line; only those that stand twice or are like another go on
    every = places.groupBy("_id", "_id2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")) \
        .join(label.unionByName(centres), ["_id", "_id2"], "left").where("n > 1 OR _c IS NOT NULL")
    every = materialize(every.select("_id", "_id2", F.coalesce("_c", "_id").alias("_c"), F.coalesce("_c2", "_id2").alias("_c2"),
                                     "at"), "line-classes")
    # written, so that the join back can split the lines of a large component
    first = materialize(every.groupBy("_c", "_c2").agg(F.min("at").alias("_first")), "line-class-firsts")
    out, seen = materialize_observed(
        every.join(first, ["_c", "_c2"]).select("_id", "_id2", F.struct(
            "_first.doc", "_first.text_id", "_first.line_no").alias("_first")), "line-firsts", n=F.count(F.lit(1)))
    drop_tables(every, first)
    return out, seen["n"]


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(_doc, _text_id, _line_no, _first, _many, _kept)`` of every line that isn't blank: the
    place (doc, line_no) of the line that its component keeps, whether the component has
    another line, and whether it is this line that is kept.

    Only lines of components with another line are joined, told by a filter that never
    misses one; what passes it falsely finds no partner."""
    label, places = similar_lines(docs, id_col, text_col, threshold, block)
    places = places.drop("bands")
    firsts, n = _firsts(places, label)
    ids = bloom(firsts.select("_id"), n)
    own = F.struct(F.col("_doc").alias("doc"), F.col("_text_id").alias("text_id"), F.col("_line_no").alias("line_no"))
    met = _among(places, ids, True).join(firsts, ["_id", "_id2"], "left") \
        .select("_doc", "_text_id", "_line_no", F.coalesce("_first", own).alias("_first"),
                F.col("_first").isNotNull().alias("_many"))
    alone = _among(places, ids, False).select("_doc", "_text_id", "_line_no", own.alias("_first"), F.lit(False).alias("_many"))
    return met.unionByName(alone).select("_doc", "_text_id", "_line_no", F.col("_first").dropFields("text_id").alias("_first"),
                                         "_many", F.col("_first").eqNullSafe(own).alias("_kept"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """The documents without the lines that their component keeps elsewhere, same columns.

    Blank lines stay.  A document that had a line and keeps none is dropped; a null, empty
    or blank text stays as it is.  ``length_col`` gets the new code points.  A row is its id
    and its text: rows that share an id lose each their own lines, equal rows lose the same
    and stay.  Null ids keep all their lines.  Extra columns pass through.  An empty table
    gives no rows."""
    label, places = similar_lines(docs, id_col, text_col, threshold, block)
    places = places.drop("bands")
    firsts, n = _firsts(places, label)
    lost = _among(places, bloom(firsts.select("_id"), n), True).where("_doc IS NOT NULL").join(firsts, ["_id", "_id2"]) \
        .where(~F.struct("_doc", "_text_id", "_line_no").eqNullSafe(
            F.struct("_first.doc", "_first.text_id", "_first.line_no")))
    lost = lost.groupBy(F.col("_doc").alias("_dedup_id"), F.col("_text_id").alias("_dedup_text_id")) \
        .agg(F.collect_set("_line_no").alias("_dedup_lost"))  # at most a text's lines
    lost = materialize(lost, "line-lost")
    drop_tables(firsts)
    text = F.col(text_col).cast("string")
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x, k: F.struct(x.alias("x"), k.cast("long").alias("k"))),
                    lambda s: ~F.array_contains("_dedup_lost", s["k"]))
    new = F.when(F.col("_dedup_lost").isNull(), text).otherwise(F.concat_ws("\n", F.transform(kept, lambda s: s["x"])))
    # the lost lines grow with the documents, so they are never broadcast
    same = (docs[id_col] == lost["_dedup_id"]) & (text_id(docs[text_col].cast("string")) == lost["_dedup_text_id"])
    out = docs.join(lost.hint("merge"), same, "left").withColumn("_dedup_text", new) \
        .where(F.col("_dedup_lost").isNull() | F.rlike("_dedup_text", F.lit(f"[^{SPACES}]")))
    columns = {text_col: F.col("_dedup_text")}
    if length_col:
        columns[length_col] = F.when(F.col("_dedup_lost").isNull(), F.col(length_col)) \
            .otherwise(F.length("_dedup_text").cast(docs.schema[length_col].dataType))
    return out.withColumns(columns).select(*docs.columns)
