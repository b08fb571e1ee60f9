"""SimHash near-dedup: fingerprints, then a binary-trie self-join within Hamming distance.

Pairs of fingerprints at ``max_bits`` differing bits or fewer agree wholly on at least
``blocks - max_bits`` of ``blocks`` equal parts of their bits.  So each fingerprint goes to
one group for each choice of that many parts, keyed by its bits there; any linked pair meets
in a group.  In a group a binary trie over the sorted fingerprints joins itself: pairs of
nodes are traversed together from the root, differing bits accumulate, and a pair is pruned
as soon as they exceed the budget.  Of the links of a task only a spanning forest leaves it.

Groups larger than ``group_rows`` are split into blocks by a hash, one task row for each
pair of blocks, so that no task holds more than twice that many fingerprints.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map, utf8
from faultline.operators.components import connected_components
from faultline.session import materialize, materialize_observed

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Most fingerprints of a group (or block of one) on each side of a trie join.
GROUP_ROWS = 512
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
_CHUNK = 1 << 15
#: Fingerprints joined at once in a task.
_BATCH = 1 << 13


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 bits; each is 1 if set in over half of the hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    w = text.lower().split() if text else []  # ASCII letters and white space only, as these are bytes
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(w) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(w) - n:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in
                         zip(first[at:at + _CHUNK], last[at:at + _CHUNK])), np.uint64, min(_CHUNK, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)`` for every row; ``fp`` is the fingerprint as a signed long.  Narrow."""
    def rows(ids, texts):
        yield ids, np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64).tolist()

    return arrow_map(docs.select(F.col(id_col), utf8(text_col).alias("_t")), rows,
                     f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Bit masks of every choice of ``blocks - max_bits`` of ``blocks`` near-equal parts."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - max_bits)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def trie_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, max_bits: int = MAX_BITS):
    """Linked pairs of places in ``fps`` (uint64), all groups' tries joined level by level.

    Rows must be sorted by (group, side, fingerprint).  A group with side 0 only joins
    itself; one with sides 0 and 1 joins the one with the other.  A node is a range of rows
    that share the leading bits."""
    n = len(fps)
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    one = side[lo] == 1
    paired = np.zeros(len(lo), bool)
    paired[:-1] = one[1:]  # side 1 follows its side 0
    alone = ~one & ~paired
    a_lo, a_hi = np.concatenate((lo[alone], lo[paired])), np.concatenate((hi[alone], hi[paired]))
    b_lo = np.concatenate((lo[alone], lo[np.flatnonzero(paired) + 1]))
    b_hi = np.concatenate((hi[alone], hi[np.flatnonzero(paired) + 1]))
    diff = np.zeros(len(a_lo), np.int16)
    out_a, out_b = [], []
    for bit in range(63, -1, -1):
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():  # two leaves: the rest of their bits at once
            x, y = a_lo[single], b_lo[single]
            near = (x != y) & (_popcount(fps[x] ^ fps[y]) <= max_bits)
            out_a.append(x[near])
            out_b.append(y[near])
            a_lo, a_hi, b_lo, b_hi, diff = (v[~single] for v in (a_lo, a_hi, b_lo, b_hi, diff))
        if not len(a_lo):
            break
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        own = (a_lo == b_lo) & (a_hi == b_hi)
        pairs = [
            (a_lo, a_mid, b_lo, b_mid, diff, None),
            (a_mid, a_hi, b_mid, b_hi, diff, None),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, None),
            (a_mid, a_hi, b_lo, b_mid, diff + 1, ~own),  # of a node with itself, once is enough
        ]
        kept = []
        for al, ah, bl, bh, d, only in pairs:
            use = (ah > al) & (bh > bl) & (d <= max_bits)
            if only is not None:
                use &= only
            kept.append([v[use] for v in (al, ah, bl, bh, d)])
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(v) for v in zip(*kept))
    same = (a_hi > a_lo) & (b_hi > b_lo)  # equal fingerprints on two sides
    out_a.append(a_lo[same])
    out_b.append(b_lo[same])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return a[a != b], b[a != b]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray):
    """Links (node, smallest node of its component) that connect what ``a`` and ``b`` connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new[label]


def _joined(fps_a: list, fps_b: list, max_bits: int):
    """Spanning links of the task rows: lists of side-0 and side-1 fingerprints of each group."""
    k, total = 0, 0
    starts = [0]
    for x, y in zip(fps_a, fps_b):
        total += len(x) + len(y)
        k += 1
        if total >= _BATCH:
            starts.append(k)
            total = 0
    for lo, hi in zip(starts, [*starts[1:], len(fps_a)]):
        # a block without a partner block has nothing to join
        parts = [p for g in range(lo, hi) if len(fps_a[g]) for p in ((g, 0, fps_a[g]), (g, 1, fps_b[g])) if len(p[2])]
        if not parts:
            continue
        fps = np.concatenate([np.array(p[2], np.int64) for p in parts]).view(np.uint64)
        size = [len(p[2]) for p in parts]
        group, side = np.repeat([p[0] for p in parts], size), np.repeat([p[1] for p in parts], size)
        order = np.lexsort((fps, side, group))
        fps, group, side = fps[order], group[order], side[order]
        a, b = trie_links(fps, group, side, max_bits)
        # nodes are the fingerprints themselves, so links of several groups share one forest
        value, place = np.unique(fps, return_inverse=True)
        node, root = spanning_forest(len(value), place[a], place[b])
        yield value[node].view(np.int64).tolist(), value[root].view(np.int64).tolist()


def hamming_links(fps: DataFrame, n: int, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``(u, v)``: links that connect all of the ``n`` distinct longs ``fps.fp`` which differ in
    at most ``max_bits`` bits, directly or in steps.

    The number of parts follows ``n``, so that random fingerprints make groups below
    ``group_rows``; any number gives the same components."""
    blocks = max_bits + 1
    while n >> round(64 * (blocks - max_bits) / blocks) > group_rows and blocks < 2 * max_bits + 2:
        blocks += 1
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, max_bits)]
    m = F.posexplode(F.array(*[F.lit(x).cast("long") for x in masks])).alias("mask", "bits")
    member = fps.select("fp", m).select("fp", "mask", F.col("fp").bitwiseAND(F.col("bits")).alias("key"))
    size = member.groupBy("mask", "key").count().where("count > 1")
    split = F.ceil(F.col("count") / group_rows).cast("int")
    own = F.pmod(F.xxhash64("fp"), split).cast("int")
    placed = member.join(size, ["mask", "key"]).select("fp", "mask", "key", own.alias("own"), split.alias("split"))
    pairs = placed.select("fp", "mask", "key", "own",
                          F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("other"))
    tasks = pairs.groupBy("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")) \
        .agg(F.collect_list(F.when(F.col("own") <= F.col("other"), F.col("fp"))).alias("a"),
             F.collect_list(F.when(F.col("own") > F.col("other"), F.col("fp"))).alias("b"))

    def rows(a, b):
        yield from _joined(a, b, max_bits)

    return arrow_map(tasks.select("a", "b"), rows, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """Per document ``id_col, fp`` (signed long) and ``component_id``: the smallest id whose
    fingerprint can be reached over links of ``max_bits`` differing bits or fewer.

    A null or wordless text has fingerprint zero and links like any other.  Documents of
    equal fingerprint are one node, however many they are.  A null id takes part; a
    component of null ids only has a null ``component_id``.  Repeated rows give a row each.
    An empty table gives no rows.  Other columns are not read.
    """
    return _components(docs, id_col, text_col, shingle, max_bits).select(id_col, "fp", "component_id")


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> DataFrame:
    """:func:`near_duplicates` with ``component``, a fingerprint that names it also where ids are null."""
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes, seen = materialize_observed(
        own.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-nodes", n=F.count(F.lit(1)))
    label = connected_components(hamming_links(nodes.select("fp"), seen["n"], max_bits))
    label = label.select(F.col("node").alias("fp"), "component")
    nodes = nodes.join(label, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    nodes = materialize(nodes, "simhash-nodes")
    ids = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    return own.join(nodes.join(ids, "component").select("fp", "component", "component_id"), "fp") \
        .select(id_col, "fp", "component", "component_id")


def _with_fingerprints(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``docs`` with ``_simhash_fp``."""
    d = docs.withColumn("_simhash_fp", utf8(text_col))
    schema = docs.withColumn("_simhash_fp", F.lit(0).cast("long")).schema

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64), pa.int64())],
                                             names=batch.schema.names)

    return d.mapInArrow(run, schema)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with the columns of ``docs``: that of the smallest id
    (a null one only where there is no other) and of its rows that of the smallest
    fingerprint; of rows equal in both any one.

    Rows are told by a left-semi join with the ids that stay, which grow with the documents
    and so are never broadcast.  Only where several rows share an id (or have none) are
    those rows' fingerprints worked out again to tell them apart."""
    found = materialize(_components(docs, id_col, text_col, shingle, max_bits), "simhash-found")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("i"), "fp"))
                                          .alias("k"))
    kept = materialize(kept.select(F.col("k.i").alias("_simhash_id"), F.col("k.fp").alias("_simhash_fp")), "simhash-kept")
    clash, seen = materialize_observed(
        found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_simhash_clash")).count().where("count > 1")
        .select("_simhash_clash"), "simhash-clash", n=F.count(F.lit(1)))
    ids = kept.where("_simhash_id IS NOT NULL")
    nulls = kept.where("_simhash_id IS NULL").limit(1).count()
    if seen["n"]:
        ids = ids.join(clash, F.col("_simhash_id") == F.col("_simhash_clash"), "left_anti")
    out = docs.join(ids.select("_simhash_id").hint("merge"), F.col(id_col) == F.col("_simhash_id"), "left_semi")
    more = []
    if seen["n"]:
        more.append(docs.join(clash, F.col(id_col) == F.col("_simhash_clash"), "left_semi"))
    if nulls:
        more.append(docs.where(F.col(id_col).isNull()))
    for d in more:
        d = _with_fingerprints(d, text_col, shingle).withColumnRenamed("_simhash_fp", "_simhash_own")
        same = (F.col("_simhash_own") == F.col("_simhash_fp")) & F.col(id_col).eqNullSafe(F.col("_simhash_id"))
        d = d.join(kept.hint("merge"), same, "left_semi").dropDuplicates([id_col, "_simhash_own"])
        out = out.unionByName(d.drop("_simhash_own"))
    return out
