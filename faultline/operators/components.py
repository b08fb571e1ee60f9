"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import drop_tables, materialize_observed


def _mins(edges: DataFrame):
    """The smallest neighbour of every node, and how many nodes there are; pre-aggregated per task, so hubs are cheap.

    Written as a table so that the join back to the edges reads two plain shuffles,
    which adaptive execution can split at a hub."""
    return materialize_observed(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-min", n=F.count(F.lit(1)))


def _spanning_stars(batches: Iterator) -> Iterator:
    """Union-find over the edges of one task: each of its nodes linked to the smallest it reaches there."""
    import pyarrow as pa
    parent: dict = {}

    def find(x):
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    schema, names = None, None
    for batch in batches:
        schema = batch.schema
        sides = [batch.column(0).to_pylist(), batch.column(1).to_pylist()]
        if pa.types.is_struct(schema.field(0).type):  # fields in order, as Spark compares them
            names = [f.name for f in schema.field(0).type]
            sides = [[tuple(x.values()) for x in side] for side in sides]
        for u, v in zip(*sides, strict=True):
            u, v = find(u), find(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    if parent:
        nodes = list(parent)
        sides = [nodes, [find(x) for x in nodes]]
        if names:
            sides = [[dict(zip(names, x)) for x in side] for side in sides]
        yield pa.RecordBatch.from_arrays([pa.array(side, f.type) for side, f in zip(sides, schema)], schema=schema)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", local: bool = False) -> DataFrame:
    """``(node, component)`` for every node that has an edge and is not itself the smallest
    of its component; ``component`` is the smallest node reachable.

    ``src`` and ``dst`` may be of any one orderable type.  Nulls, loops and repeated edges
    are ignored; no edges give no rows.  Each round links every larger neighbour of a node
    to the node's smallest neighbour (large star), then every smaller neighbour and the node
    itself to the smallest (small star).  That needs O(log^2 n) rounds at most, few in
    practice, whatever the shape (paths, arches, hubs), so there is no limit on the rounds.
    It is done when the large star moves nothing and each node has one smaller neighbour.
    Every round is a written table: a lost executor costs part of a round.

    ``local`` first replaces the edges of each task by stars of what they connect, which
    pays where tasks hold edges of the same neighbourhoods (or the graph is small): fewer
    edges and rounds.  A task holds its own edges' nodes: integers, strings in code point order
    or structs of them, without nulls inside.
    """
    start = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")) \
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    size = {"n": F.count(F.lit(1))}
    if local:
        start = start.repartitionByRange("u", "v").mapInArrow(_spanning_stars, start.schema)
    e, seen = materialize_observed(start.distinct(), "cc-edges", **size)
    while seen["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m, _ = _mins(both)
        centred, moved = materialize_observed(
            both.where("v > u").join(m, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("moved")),
            "cc-large", keep=["u", "v"], n=F.count_if("moved"))
        large = centred.distinct() if moved["n"] else centred
        m2, nodes = _mins(large)
        if not moved["n"] and nodes["n"] == seen["n"]:
            drop_tables(m, m2, e)
            e = centred
            break
        small = large.join(m2, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(m2.select("u", F.col("m").alias("v")))
        after, seen = materialize_observed(small.distinct(), "cc-edges", **size)
        drop_tables(e, m, centred, m2)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
