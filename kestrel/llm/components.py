"""Connected components as DataFrame jobs: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.sum(F.xxhash64("b", "a") % (1 << 31))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of ``edges`` (two columns, any one type with an order).

    The component's name is its least node. Loops, repeated and reversed edges do
    no harm; no edges give no rows. Each round is written to the shared folder.
    A node of very many edges is only ever aggregated or joined, never gathered.
    """
    a, b = edges.columns
    stars = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    seen = _mark(stars)
    while True:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "c")
        small = large.join(low, F.col("a") == F.col("c")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = written(small.where("a <> b").distinct(), "edges", instead_of=stars)
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
