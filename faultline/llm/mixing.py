"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

* **Targets.**  The sources share ``share`` times all words by weight; a source stops at
  ``max_epochs`` times its own size and what it can't take is shared again by weight among
  the others, until none is above.
* **Blocks.**  The documents of a source are shuffled (ordered by a hash of id and text) and
  laid end to end, epoch after epoch; that stream is cut into blocks of ``block_words``
  words up to the source's target, which only its last block falls short of.
* **Schedule.**  Slot ``i`` of the mix sits at the van der Corput point ``v(i)``, the number
  ``i`` with its bits mirrored behind the point.  Points of ``2^m >= N`` slots are the
  multiples of ``2^-m``; the first ``N`` multiples, one for each block, are laid over the
  sources' cumulative block counts, so point ``j / 2^m`` belongs to the source in whose
  stretch ``j`` falls and every source gets exactly as many slots as it has blocks.  Ordered
  by ``i`` they stay in proportion in every stretch of the schedule.
* **Join.**  A source's slots are ranked in schedule order; its ``k``-th slot takes its
  ``k``-th block.

Spark's own functions throughout.  Texts are read once for sizes and hashes and are never
shuffled.  No window covers a whole source: documents and slots are numbered inside hash
buckets or stretches of bounded size, whose totals are added up apart, and equal rows are
counted before they meet.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import SPACES
from faultline.session import drop_tables, materialize, materialize_observed

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 512
SEED = 13
#: Documents of one bucket (on average, at most), slots of one stretch and copies of one step (at most).
BUCKET_ROWS, STRETCH, COPIES = 1 << 10, 1 << 16, 1 << 12
#: Rows that one task makes where rows are generated, beyond the session's number of partitions.
TASK_ROWS = 1 << 20


@dataclass
class Mix:
    """A planned mix.

    ``sources``: ``source, number, source_size, weight, target, quota, blocks, first_slot``;
    ``documents``: a row per input row, ``id, source, key, copy, size, number, source_size,
    target, quota, start`` (its first word's place in the source's epoch);
    ``slots``: ``turn`` (the place in the schedule; some turns are free), ``number, block``."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    block_words: int
    max_epochs: int


def _spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Dealt out for generating ``rows`` rows, however few bytes the seeds of them have."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1), *by)


def _before(partition: list[str], *by) -> Window:
    return Window.partitionBy(*partition).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)


def _running_total(df: DataFrame, by: Column, value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before, by ``by``; ranges are summed each by itself first."""
    placed = materialize(df.repartitionByRange(by).withColumns(
        {"_range": F.spark_partition_id(), "_value": value.cast("long")}), "mix-ranges")
    totals = placed.groupBy("_range").agg(F.sum("_value").alias("_total"))  # a row for each range
    first = totals.select("_range", F.coalesce(F.sum("_total").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return placed.join(first, "_range").withColumn(
        name, F.col("_first") + F.coalesce(F.sum("_value").over(_before(["_range"], by)), F.lit(0))) \
        .drop("_range", "_value", "_first")


def _targets(sources: DataFrame, share: float, max_epochs: int) -> DataFrame:
    """``target`` by weight, stopped at ``max_epochs`` sizes and the rest shared again."""
    size, weight = F.col("source_size"), F.col("weight")
    now = sources.withColumn("stopped", F.lit(False))
    while True:
        s = now.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("stopped"), size).otherwise(0)).alias("full"),
                    F.sum(F.when(F.col("stopped"), 0).otherwise(weight)).alias("weight")).first()
        if not s["weight"]:
            return now.withColumn("target", F.when(F.col("stopped"), max_epochs * size).otherwise(0).cast("double"))
        left = share * s["all"] - max_epochs * s["full"]
        cap = (max_epochs * size).cast("double")
        by_weight = weight * F.lit(left) / F.lit(float(s["weight"]))
        then, seen = materialize_observed(
            now.withColumn("target", F.when(F.col("stopped"), cap).otherwise(by_weight))
            .withColumn("above", F.col("target") > cap).withColumn("stopped", F.col("stopped") | F.col("above")),
            "mix-targets", above=F.count_if("above"))
        drop_tables(now)
        if not seen["above"]:
            return then.drop("stopped", "above")
        now = then.drop("target", "above")


def _slots(sources: DataFrame, n: int) -> DataFrame:
    """``turn, number, block``: the sources' slots, each one's ranked by turn."""
    bits = max(1, (n - 1).bit_length())
    seeds = sources.where("blocks > 0").select(
        "number", "first_slot", "blocks", F.expr(f"explode(sequence(0L, (blocks - 1) div {STRETCH}))").alias("k"))
    points = _spread(seeds, n, "number", "k").select("number", F.expr(
        f"explode(sequence(first_slot + k * {STRETCH}, first_slot + least(blocks, (k + 1) * {STRETCH}) - 1))").alias("j"))
    turn = F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long")
    turns = points.select("number", turn.alias("turn")).withColumn("stretch", F.expr(f"turn div {STRETCH}"))
    counts = turns.groupBy("number", "stretch").agg(F.count(F.lit(1)).alias("c"))
    first = counts.select("number", "stretch", F.coalesce(
        F.sum("c").over(_before(["number"], "stretch")), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("number", "stretch").orderBy("turn"))
    # Generated rows look as few as their seeds to the planner: no join of theirs may broadcast.
    return turns.withColumn("rank", rank).join(first.hint("merge"), ["number", "stretch"]) \
        .select("turn", "number", (F.col("first") + F.col("rank") - 1).alias("block"))


def plan_mix(docs: DataFrame, weights: Sequence[int] | DataFrame = WEIGHTS, share: float = SHARE,
             max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", source_col: str = "source") -> Mix:
    """Sources, documents and slots of a mix.

    ``weights``: numbers that the sources take in turn, by code point, null last; or a table
    ``(source, weight)``, where a source without a row weighs 0.  ``share`` is at most
    ``max_epochs`` (else every source stops there).

    A null text has no words; a document without words takes no part but stays in
    ``documents``.  Null sources are one source.  Rows that repeat an id are documents of
    their own; of wholly equal rows, ``copy`` 0, 1, ... tell them apart.  An empty table
    gives empty tables.  Other columns are not read.  Reruns give the same rows, whatever
    the partitions: the order hashes id and text, ties are equal rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
              .cast("binary")).alias("key"))
    distinct, seen = materialize_observed(
        read.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-documents",
        n=F.count(F.lit(1)), rows=F.coalesce(F.sum("copies"), F.lit(0)))

    sources = distinct.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sources = _running_total(sources, F.col("source").asc_nulls_last(), F.lit(1), "number")
    if isinstance(weights, DataFrame):
        w = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source") \
            .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        cycle = F.array(*[F.lit(float(w)) for w in weights])
        sources = sources.withColumn("weight", cycle[(F.col("number") % len(weights)).cast("int")])
    sources = _targets(sources, share, max_epochs) \
        .withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")) \
        .withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    sources = materialize(_running_total(sources, F.col("number"), F.col("blocks"), "first_slot"), "mix-sources")
    n = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]

    # A source's documents by key: buckets of the key's first bits, numbered each by itself.
    bits = max(0, math.ceil(math.log2(max(1, seen["n"]) / BUCKET_ROWS)))
    words = F.col("size") * F.col("copies")
    known = sources.select(F.col("source").alias("_source"), "number", "source_size", "target", "quota")
    d = distinct.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source") \
        .withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 10), 16, 10).cast("long"), 40 - min(bits, 40)))
    totals = d.groupBy("number", "bucket").agg(F.sum(words).alias("_total"))
    first = totals.select("number", "bucket", F.coalesce(
        F.sum("_total").over(_before(["number"], "bucket")), F.lit(0)).alias("_first"))
    d = d.withColumn("_at", F.coalesce(F.sum(words).over(_before(["number", "bucket"], "key", "id", "size")), F.lit(0))) \
        .join(first, ["number", "bucket"])
    # A row for each copy again, so many of them from one row at a time.
    d = _spread(d.withColumn("_k", F.expr(f"explode(sequence(0L, (copies - 1) div {COPIES}))")), seen["rows"], "key", "_k")
    d = d.withColumn("copy", F.expr(f"explode(sequence(_k * {COPIES}, least(copies, (_k + 1) * {COPIES}) - 1))"))
    documents = materialize(d.select(
        "id", "source", "key", "copy", "size", "number", "source_size", "target", "quota",
        (F.col("_first") + F.col("_at") + F.col("copy") * F.col("size")).alias("start")), "mix-placed")
    drop_tables(distinct)
    return Mix(sources, documents, materialize(_slots(sources, n), "mix-slots"), block_words, max_epochs)


def pieces(mix: Mix) -> DataFrame:
    """What each slot holds: ``turn, at`` (the word's place in the slot), ``source, id, key,
    copy, epoch, from_word, n_words`` (which words of the document), in no order."""
    b = mix.block_words
    epochs = F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs - 1)))
    d = mix.documents.where("size > 0").select("id", "source", "key", "copy", "size", "number", "source_size", "quota",
                                               "start", epochs.alias("epoch")) \
        .withColumn("lo", F.col("start") + F.col("epoch") * F.col("source_size")) \
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("lo < hi")
    d = d.withColumn("block", F.expr(f"explode(sequence(lo div {b}, (hi - 1) div {b}))"))
    begin, end = F.greatest(F.col("block") * b, F.col("lo")), F.least((F.col("block") + 1) * b, F.col("hi"))
    return d.join(mix.slots.hint("merge"), ["number", "block"]).select(
        "turn", (begin - F.col("block") * b).alias("at"), "source", "id", "key", "copy", "epoch",
        (begin - F.col("lo")).alias("from_word"), (end - begin).alias("n_words"))


def taken_words(mix: Mix) -> DataFrame:
    """``documents`` with ``taken``: the words of each that the mix takes, repeats counted."""
    row = ["id", "source", "key", "copy"]
    sums = pieces(mix).groupBy(*row).agg(F.sum("n_words").alias("taken"))
    sums = sums.select(*[F.col(c).alias("_" + c) for c in row], "taken")
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in row]
    return mix.documents.join(sums, same, "left").drop(*["_" + c for c in row]) \
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
