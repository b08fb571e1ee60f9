"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rules: space and the ASCII controls tab to carriage return.
SPACES = " \\t-\\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    """The text's UTF-8 bytes; null stays null."""
    return F.col(col).cast("string").cast("binary")


def arrow_map(df: DataFrame, rows: Callable, schema: str, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` by columns: ``rows`` gets each batch's columns as Python lists (after
    the result of ``setup()``, made once a task, if given) and yields one tuple of output
    columns for each part of its result, so that a batch of long texts needn't give one
    large output batch."""
    out = df.sparkSession.createDataFrame([], schema).schema
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in rows(*state, *(c.to_pylist() for c in batch.columns)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=arrow.field(n).type) for n, v in zip(names, part, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)
