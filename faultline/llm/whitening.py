"""Embedding whitening with Spark MLlib's BlockMatrix.

Vectors become integers, ``floor(scale * c)``; the **fit list** holds each distinct integer
vector once.  Its rows, centred on the exact mean, are indexed and laid out as dense blocks
of a distributed ``BlockMatrix`` X; ``X^T X`` is the scatter; its covariance is decomposed
locally (``eigh`` of dimensions x dimensions numbers), and a second block product by the
whitening matrix projects every row of the fit list.  Rows of the table take the projection
of their vector by a join.

Layout for many rows: X is one block wide and as tall as the fit list.  The scatter splits
the product's middle dimension, so that blocks meet in as many tasks as there are groups of
``MID_BLOCKS`` of them and only sums of dimensions x dimensions numbers leave a task.  For
the projection the same blocks are folded into a square grid, times a block-diagonal matrix
with the whitening matrix in every diagonal block: MLlib deals a square grid to as many
tasks as X has partitions, but a tall one only to the square root of that.  What MLlib keeps
on the driver is one pair of numbers for each block.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import drop_tables, materialize, materialize_observed

SCALE = 256
COMPONENTS = 4
#: Numbers in a block (4 MB) and blocks that meet in one task of the scatter, at most.
BLOCK_NUMBERS, MID_BLOCKS = 1 << 19, 16
#: A component whose variance is below this part of the largest one's has none to double precision.
NO_VARIANCE = 1e-12

_PAIR = T.StructType([T.StructField("_1", T.LongType(), False), T.StructField("_2", T.LongType(), False)])
_MATRIX = MatrixUDT.sqlType()


def usable(vector: Column) -> Column:
    """True where a vector is there and all its entries are finite."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))


def integers(vector: Column, dims: int, scale: int = SCALE) -> Column:
    """``floor(scale * c)`` of each entry; a shorter vector is filled up with zeros."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(F.size(x) == dims, x).otherwise(F.concat(x, F.array_repeat(F.lit(0).cast("long"), dims - F.size(x))))


def _matrix(rows: int, cols: int, values: Column) -> Column:
    """A dense matrix, its values row by row, as MLlib's matrix type stores it."""
    none = F.lit(None).cast("array<int>")
    return F.struct(F.lit(1).cast("byte").alias("type"), F.lit(rows).cast("int").alias("numRows"),
                    F.lit(cols).cast("int").alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"),
                    values.alias("values"), F.lit(True).alias("isTransposed"))


def _as_matrices(written: DataFrame) -> DataFrame:
    """A written table ``(b, m)`` read with ``m`` as MLlib's matrix type."""
    schema = T.StructType([T.StructField("b", T.LongType()), T.StructField("m", MatrixUDT())])
    return written.sparkSession.read.schema(schema).parquet(written._faultline_path)


def _block_matrix(blocks: DataFrame, at: tuple[Column, Column], block: tuple[int, int], grid: tuple[int, int]) -> BlockMatrix:
    """The blocks at grid places ``at`` as a distributed matrix; the values stay in the JVM."""
    placed = blocks.select(F.struct(at[0].alias("_1"), at[1].alias("_2")).alias("at"), "m")
    rows, cols = block
    java = callMLlibFunc("createBlockMatrix", placed, rows, cols, grid[0] * rows, grid[1] * cols)
    return BlockMatrix(java, rows, cols)


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """``a.multiply(b)`` with the middle dimension split, which the Python method doesn't offer."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, each one's largest entry positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1], v[:, ::-1]
    largest = np.abs(v).argmax(axis=0)
    return e, v * np.where(v[largest, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def _indexed(fit: DataFrame, dims: int) -> tuple[DataFrame, int, int]:
    """The fit list with a block number ``b`` and a place ``p`` in the block; rows a block, number of blocks.

    Blocks don't cross the written partitions, so numbering them only adds up a number a partition."""
    parts = fit.groupBy("_part").agg((F.max("_at") + 1).alias("n"))
    most = parts.agg(F.max("n").alias("m")).first()["m"]
    rows = max(1, min(most, BLOCK_NUMBERS // dims))
    parts = parts.select("_part", F.ceil(F.col("n") / rows).cast("long").alias("blocks"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    first = parts.select("_part", "blocks", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("_first"))
    n = parts.agg(F.sum("blocks").alias("n")).first()["n"]
    at = fit.join(first.drop("blocks"), "_part").select(
        "x", (F.col("_first") + F.expr(f"_at div {rows}")).alias("b"), (F.col("_at") % rows).cast("int").alias("p"))
    return at, rows, n


def _result(spark: SparkSession, df: DataFrame) -> T.StructType:
    added = "n long, deviation long, component int, whitened double, explained double, identity_error double"
    return T.StructType([*df.schema.fields, *spark.createDataFrame([], added).schema.fields])


def whiten(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Per usable row and component (from 1, by falling variance) the row's columns and

    ``n`` (vectors in the fit list), ``deviation`` (the exact sum over dimensions of
    ``(n x - S)^2``, null beyond a long), ``component``, ``whitened`` (the centred vector on
    the component over its standard deviation), ``explained`` (the component's part of all
    variance), ``identity_error`` (one value: largest entry of the whitened fit list's
    covariance less the identity).

    Rows whose vector is null or has a null or non-finite entry are left out.  Vectors of
    fewer dimensions than the longest count as filled up with zeros; entries beyond a long
    are its ends.  Equal vectors weigh once, whatever their number.  There are fewer
    components where there are fewer dimensions, none for an empty table or empty vectors.
    ``whitened`` is null for a component without variance (one distinct vector, or fewer
    than components), which ``identity_error`` leaves out; ``explained`` and the error are
    null where there is no variance at all.  Columns of the result's names are replaced,
    others pass through."""
    spark = df.sparkSession
    new = ["n", "deviation", "component", "whitened", "explained", "identity_error"]
    own = [c for c in df.columns if c not in new]
    rows = df.select(*own, F.col(vector_col).alias("_white_vector")).where(usable(F.col("_white_vector")))
    dims = rows.agg(F.max(F.size("_white_vector")).alias("d")).first()["d"] or 0
    if not dims:
        return spark.createDataFrame([], _result(spark, df.select(*own)))
    x = integers(F.col("_white_vector"), dims, scale)

    # The fit list; exact sums of each dimension.
    fit, seen = materialize_observed(
        rows.select(x.alias("x")).distinct().withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "whiten-fit", n=F.count(F.lit(1)))
    n = seen["n"]
    sums = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos") \
        .agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()  # a row for each dimension
    total = [int(s) for _, s in sorted(map(tuple, sums))]
    mean = F.array(*[F.lit(s / n) for s in total])

    # X: centred rows, block by block.
    at, r, n_blocks = _indexed(fit, dims)
    centred = F.zip_with("x", mean, lambda v, m: v.cast("double") - m)
    held = at.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("p", centred.alias("c")))).alias("rows"))
    values = F.flatten(F.col("rows.c"))
    filled = F.concat(values, F.array_repeat(F.lit(0.0), r * dims - F.size(values)))
    written = materialize(held.select("b", _matrix(r, dims, filled).alias("m")), "whiten-blocks")
    blocks, zero = _as_matrices(written), F.lit(0).cast("long")
    tall = _block_matrix(blocks, (F.col("b"), zero), (r, dims), (n_blocks, 1))
    scatter = _product(tall.transpose(), tall, -(-n_blocks // MID_BLOCKS)).toLocalMatrix().toArray()
    variance, vectors = eigen(scatter / n)
    trace = float(np.trace(scatter)) / n
    k = min(components, dims)
    has = [bool(variance[0] > 0 and variance[c] > NO_VARIANCE * variance[0]) for c in range(k)]
    w = np.column_stack([vectors[:, c] / math.sqrt(variance[c]) if has[c] else np.zeros(dims) for c in range(k)])

    # Y = X W on the folded grid.
    side = math.isqrt(n_blocks - 1) + 1
    same = F.array(*[F.lit(float(v)) for v in w.ravel()])
    diagonal = materialize(spark.range(side).select(F.col("id").alias("b"), _matrix(dims, k, same).alias("m")), "whiten-w")
    folded = _block_matrix(blocks, (F.expr(f"b div {side}"), F.col("b") % side), (r, dims), (side, side))
    y = folded.multiply(_block_matrix(_as_matrices(diagonal), (F.col("b"), F.col("b")), (dims, k), (side, side)))
    y = callMLlibFunc("getMatrixBlocks", y._java_matrix_wrapper._java_model).toDF("at", "m")
    y = materialize(y, "whiten-projected")
    y = spark.read.schema(T.StructType([T.StructField("at", _PAIR), T.StructField("m", _MATRIX)])).parquet(y._faultline_path)
    v = F.col("m.values")
    row = F.array(*[F.when(F.col("m.isTransposed"), F.get(v, F.col("p") * k + c))
                    .otherwise(F.get(v, F.col("m.numRows") * c + F.col("p"))) for c in range(k)])
    y = y.select((F.col("at._1") * side + F.col("at._2")).alias("b"), "m",
                 F.explode(F.sequence(F.lit(0), F.col("m.numRows") - 1)).alias("p")).select("b", "p", row.alias("y"))
    projected = materialize(at.join(y, ["b", "p"]).select("x", "y"), "whiten-rows")

    # How far the whitened fit list is from the identity.
    cov = [F.abs(F.covar_pop(F.col("y")[i], F.col("y")[j]) - float(i == j))
           for i in range(k) for j in range(i + 1) if has[i] and has[j]]
    error = projected.agg(F.greatest(*cov, *cov[:1])).first()[0] if cov else None
    drop_tables(fit, written, diagonal)

    wide = [s if -2**63 <= s < 2**63 else None for s in total]
    sums_of = F.array(*[F.lit(s).cast("long") for s in wide])
    apart = F.zip_with("x", sums_of, lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s))
    deviation = F.aggregate(apart, zero, lambda acc, t: F.try_add(acc, F.try_multiply(t, t)))
    parts = F.array(*[F.struct(F.lit(c + 1).alias("component"),
                               (F.col("y")[c] if has[c] else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(float(variance[c]) / trace if trace > 0 else None).cast("double").alias("explained"))
                      for c in range(k)])
    scored = projected.select(F.col("x").alias("_white_x"), deviation.alias("deviation"), parts.alias("_white_parts"))
    rows = rows.withColumn("_white_x", x).drop("_white_vector").join(scored, "_white_x")
    return rows.select(*own, F.lit(n).cast("long").alias("n"), "deviation", F.explode("_white_parts").alias("_white")) \
        .select(*own, "n", "deviation", "_white.*", F.lit(error).cast("double").alias("identity_error"))
