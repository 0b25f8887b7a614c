"""Synthetic flights: Poisson arrivals, rejection-sampled legs, one position a second."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.config import Flights
from kestrel.functions.geodesy import direct
from kestrel.functions.geometry import Box
from kestrel.functions.parsing import numbered
from kestrel.functions.randoms import between, poisson_count, uniform
from kestrel.operators.numbering import number_in_order


#: Attempts that every flight makes before those without a fit go on.
FIRST_ATTEMPTS = 8


#: Arrivals that are made from one row.
TOGETHER = 10_000


def arrivals(spark: SparkSession, windows: Sequence[tuple], f: Flights = Flights()) -> DataFrame:
    """region, density_level, i, spawn: the arrivals of every region and density, numbered in time order.

    ``windows`` has (region, t_min, t_max), one for each region of a catalogue. A
    region's arrivals don't depend on the others.
    """
    rows = []
    for region, t_min, t_max in windows:
        for density, rate in f.per_hour.items():
            count = poisson_count(rate * (t_max - t_min) / 3600, f"{f.seed}|{region}|{density}|count")
            rows += [(region, density, float(t_min), float(t_max - t_min), k, min(count, k + TOGETHER)) for k in range(0, count, TOGETHER)]
    blocks = spark.createDataFrame(rows, "region string, density_level string, t_min double, span double, low long, high long").repartition("region", "density_level", "low")
    drawn = blocks.withColumn("id", F.explode(F.sequence("low", F.col("high") - 1)))
    u = uniform(F.lit(f.seed), "region", "density_level", F.lit("spawn"), "id")
    drawn = drawn.select("region", "density_level", (F.col("t_min") + F.col("span") * u).alias("spawn"), F.floor(u * 1024).cast("int").alias("slot"))
    return number_in_order(drawn, ["region", "density_level"], "slot", "spawn")


def spawns(spark: SparkSession, t_min: float, t_max: float, f: Flights = Flights()) -> DataFrame:
    """density_level, i, spawn (epoch seconds): arrivals of every density, numbered in time order."""
    parts = []
    for density, rate in f.per_hour.items():
        count = poisson_count(rate * (t_max - t_min) / 3600, f"{f.seed}|{density}|count")
        drawn = spark.range(count).select(F.lit(density).alias("density_level"), (F.lit(t_min) + F.lit(t_max - t_min) * uniform(F.lit(f.seed), F.lit(density), F.lit("spawn"), F.col("id"))).alias("spawn"))
        # sorted by range and numbered without one task for all: the order statistic of a uniform is a rank
        ranked = drawn.withColumn("slot", F.floor((F.col("spawn") - t_min) / max(1e-9, (t_max - t_min)) * 1024).cast("int"))
        parts.append(ranked)
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return number_in_order(rows, "density_level", "slot", "spawn")


def flights(arrivals: DataFrame, box: Box | None, f: Flights = Flights()) -> DataFrame:
    """A leg for each arrival whose end lies in the box: the first that fits of all attempts.

    ``box`` None takes each row's own, from its columns south, west, north and
    east; draws then depend on ``region`` too. Speed, duration and altitude are
    drawn once for a flight; starts and bearings at each attempt. A flight for
    which none fits raises an error.
    """
    south, west, north, east = [F.lit(x) for x in box] if box else [F.col(x) for x in ("south", "west", "north", "east")]
    key = [F.lit(f.seed), *([] if box else [F.col("region")]), F.col("density_level"), F.col("i")]
    drawn = arrivals.withColumns({"speed_mps": between(*f.speed, *key, F.lit("speed")), "raw": between(*f.duration, *key, F.lit("duration")), "altitude_m": between(*f.altitude, *key, F.lit("altitude"))})
    drawn = drawn.withColumn("duration_s", F.least(F.col("raw"), F.lit(f.longest_m) / F.col("speed_mps"))).withColumn("distance", F.col("speed_mps") * F.col("duration_s")).drop("raw")

    def legs(rows: DataFrame, attempts: range) -> DataFrame:
        tried = rows.withColumn("attempt", F.explode(F.sequence(F.lit(attempts[0]), F.lit(attempts[-1]))))
        start = F.floor(F.col("attempt") / f.bearings)
        tried = tried.withColumns({"start_lat": between(south, north, *key, F.lit("lat"), start), "start_lon": between(west, east, *key, F.lit("lon"), start), "bearing": between(0.0, 360.0, *key, F.lit("bearing"), F.col("attempt"))})
        ended = direct(tried, "start_lon", "start_lat", "bearing", "distance", "end_lon", "end_lat")
        fits = F.col("end_lat").between(south, north) & F.col("end_lon").between(west, east)
        return ended.groupBy(*rows.columns).agg(F.min_by(F.when(fits, F.struct("start_lat", "start_lon", "bearing")), F.when(fits, F.col("attempt"))).alias("leg"))

    # most flights fit at one of the first attempts; only the others try the rest
    most = f.starts * f.bearings
    early = legs(drawn, range(min(FIRST_ATTEMPTS, most)))
    chosen = early.where("leg IS NOT NULL")
    if most > FIRST_ATTEMPTS:
        chosen = chosen.unionByName(legs(early.where("leg IS NULL").drop("leg"), range(FIRST_ATTEMPTS, most)))
    else:
        chosen = early
    leg = F.when(F.col("leg").isNull(), F.raise_error(F.lit("no attempt at a flight ends in the box"))).otherwise(F.col("leg"))
    return chosen.withColumn("leg", leg).select(*drawn.columns, "leg.*").withColumn("drone_id", numbered(F.col("density_level"), F.col("i")))


def tracks(legs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Positions at whole seconds after the spawn, both ends included; ``keep`` names further columns that stay."""
    seconds = legs.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("duration_s").cast("int"))))
    moved = direct(seconds.withColumn("gone", F.col("speed_mps") * F.col("s")), "start_lon", "start_lat", "bearing", "gone", "longitude", "latitude")
    at = F.timestamp_micros(F.rint(F.col("spawn") * 1e6).cast("bigint") + F.col("s").cast("bigint") * 1000000)
    return moved.select(*keep, "drone_id", "density_level", at.alias("timestamp_utc"), "latitude", "longitude", "altitude_m", F.col("bearing").alias("heading_deg"), "speed_mps")
