"""Reading the corpus tables, and cutting Arrow batches to a bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of ``sf_dir``; any path that Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def own_columns(docs: DataFrame, names: list[str] | None = None) -> list[Column]:
    """A frame's columns, or some, whatever signs their names have."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names or docs.columns]


def afterwards(rows: Iterator, drop: Callable[[], None]) -> Iterator:
    """The same rows; at the task's end caches are dropped, as a worker may idle for long and serve other operators."""
    try:
        yield from rows
    finally:
        drop()


def small(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes, so that Python objects stay few."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
