"""Segments between consecutive observations of one object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns(names: str | Sequence[str]) -> list[str]:
    """One name or several, as a list."""
    return [names] if isinstance(names, str) else list(names)


def pair_segments(obs: DataFrame, key: str | Sequence[str], t: str, values: list[str], gap_s: float, ties: tuple[str, ...] = (), block_s: float | None = None) -> DataFrame:
    """Segments from each observation to the key's next, where 0 < gap <= gap_s (``t`` in seconds).

    ``key`` is a column or several. With ``block_s``, at least gap_s, an object's
    observations are dealt by blocks of time, so that one object of very many rows
    takes no single task; those within gap_s of a block's start also end the
    block before. A null key names no object and has no next observation.
    """
    keys, blocks = columns(key), []
    if block_s:
        if block_s < gap_s:
            raise ValueError("a block must be as long as the gap at least")
        own = F.floor(F.col(t) / block_s)
        both = F.when(F.col(t) - own * block_s <= gap_s, F.array(own, own - 1)).otherwise(F.array(own))
        obs, blocks = obs.withColumn("_own", own).withColumn("_block", F.explode(both)), ["_block"]
    then = Window.partitionBy(*keys, *blocks).orderBy(t, *ties)
    after = obs.dropna(subset=keys).select(*keys, F.col(t).alias("t0"), *[F.col(v).alias(f"{v}0") for v in values],
                                           F.lead(t).over(then).alias("t1"), *[F.lead(v).over(then).alias(f"{v}1") for v in values], *([(F.col("_own") == F.col("_block")).alias("_here")] if blocks else []))
    if blocks:
        after = after.where("_here").drop("_here")
    gap = F.col("t1") - F.col("t0")
    return after.where((gap > 0) & (gap <= gap_s)).withColumn("paired", F.lit(1))


def segments(obs: DataFrame, key: str | Sequence[str], t: str, values: list[str], gap_s: float, ties: tuple[str, ...] = (), block_s: float | None = None) -> DataFrame:
    """A segment without length for every observation, and those to the next ones.

    ``paired`` is 0 for the former, which come first where a choice between
    equally near segments is to be made.
    """
    single = obs.select(*columns(key), F.col(t).alias("t0"), *[F.col(v).alias(f"{v}0") for v in values], F.col(t).alias("t1"), *[F.col(v).alias(f"{v}1") for v in values], F.lit(0).alias("paired"))
    return single.unionByName(pair_segments(obs, key, t, values, gap_s, ties, block_s))
