"""Boxes, rings and distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    """Whether a point lies in the box, its edges included."""
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def overlaps_box(ring: Column, box: Box) -> Column:
    """Whether the ring's bounds meet the box. ``ring`` is an array of structs (x, y)."""
    south, west, north, east = box
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return (F.array_max(xs) >= west) & (F.array_min(xs) <= east) & (F.array_max(ys) >= south) & (F.array_min(ys) <= north)


def _clip_edge(ring: Column, axis: str, edge: Column, keep_above: bool) -> Column:
    """The part of the ring on one side of a line: crossings are added where a side changes."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] >= edge if keep_above else p[axis] <= edge

    def crossing(a: Column, b: Column) -> Column:
        share = (edge - a[axis]) / (b[axis] - a[axis])
        at = a[other] + share * (b[other] - a[other])
        return F.struct(*[(edge if c == axis else at).alias(c) for c in ("x", "y")])

    def step(p: Column, i: Column) -> Column:
        before = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))
        return F.when(inside(p) & inside(before), F.array(p)).when(inside(p), F.array(crossing(before, p), p)).when(inside(before), F.array(crossing(before, p))).otherwise(F.slice(F.array(p), 1, 0))

    return F.flatten(F.transform(ring, step))


def clip(frame: DataFrame, ring: str, box: Box | None) -> DataFrame:
    """``frame`` with ``ring`` clipped to the box; rings of fewer than three points left go.

    ``box`` None takes each row's own, from its columns south, west, north and east.
    """
    south, west, north, east = [F.lit(float(x)) for x in box] if box else [F.col(x) for x in ("south", "west", "north", "east")]
    out = frame.withColumn(ring, F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))
    for axis, edge, above in (("x", west, True), ("x", east, False), ("y", south, True), ("y", north, False)):
        out = out.withColumn(ring, F.explode(F.array(_clip_edge(F.col(ring), axis, edge, above))))  # a barrier: each edge is clipped once
    return out.where(F.size(ring) >= 3)


def from_least_corner(ring: Column) -> Column:
    """The ring in its own direction, from its least corner on."""
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, F.lit(1), at - 1))


def ring_area(ring: Column) -> Column:
    """The area within a ring."""
    following = lambda i: F.element_at(ring, i % F.size(ring) + 1)
    twice = F.aggregate(F.sequence(F.lit(1), F.size(ring)), F.lit(0.0), lambda a, i: a + F.element_at(ring, i)["x"] * following(i)["y"] - following(i)["x"] * F.element_at(ring, i)["y"])
    return F.abs(twice) / 2


#: Sizes of the grid that boxes meet in: the least cell, doubled so often at most.
LEVELS = 12


def _cells(south: Column, west: Column, north: Column, east: Column, size: Column) -> list[Column]:
    return [F.sequence(F.floor(low / size), F.floor(high / size)) for low, high in ((west, east), (south, north))]


def rings_in_regions(rings: DataFrame, ring: str, regions: DataFrame, cell: float = 1.0) -> DataFrame:
    """Rings clipped to each region's box that they reach into: the columns of both, one row for each such pair.

    ``regions`` has south, west, north and east. An equi-join on the cells of a
    grid brings together what may overlap: a ring's box goes to the level whose
    cells are as wide as it is, so it touches four cells at most however large it
    is, and a region's box to its cells on every level. A pair counts in the cell
    that holds the lower left corner of what the boxes share. Clipped rings start
    at their least corner. A ring without points is in no region.
    """
    xs, ys = F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double"))
    boxed = rings.where(F.size(ring) > 0).withColumns({"_w": F.array_min(xs), "_e": F.array_max(xs), "_s": F.array_min(ys), "_n": F.array_max(ys)})
    widest = F.greatest(F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s"), F.lit(cell))
    boxed = boxed.withColumn("_level", F.least(F.ceil(F.log2(widest / cell)), F.lit(LEVELS)).cast("int"))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), "_level")
    for axis, cells in zip(("_cx", "_cy"), _cells(F.col("_s"), F.col("_w"), F.col("_n"), F.col("_e"), size), strict=True):
        boxed = boxed.withColumn(axis, F.explode(cells))
    placed = regions.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    for axis, cells in zip(("_cx", "_cy"), _cells(F.col("south"), F.col("west"), F.col("north"), F.col("east"), size), strict=True):
        placed = placed.withColumn(axis, F.explode(cells))
    met = boxed.join(placed, ["_level", "_cx", "_cy"])
    low = {"_cx": F.greatest("_w", "west"), "_cy": F.greatest("_s", "south")}
    met = met.where((F.col("_e") >= F.col("west")) & (F.col("_w") <= F.col("east")) & (F.col("_n") >= F.col("south")) & (F.col("_s") <= F.col("north")))
    met = met.where((F.floor(low["_cx"] / size) == F.col("_cx")) & (F.floor(low["_cy"] / size) == F.col("_cy")))
    clipped = clip(met.select(*rings.columns, *regions.columns), ring, None)
    return clipped.withColumn(ring, from_least_corner(F.col(ring)))


def geojson_rings(frame: DataFrame, column: str) -> DataFrame:
    """One row for each ring of a GeoJSON feature collection's polygons: feature, polygon, number, ring."""
    point = "array<double>"
    kinds = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    feature = frame.select(F.posexplode(F.from_json(column, kinds)["features"]).alias("feature", "f"))
    place = F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json(place, f"array<array<array<{point}>>>")).otherwise(F.array(F.from_json(place, f"array<array<{point}>>")))
    rings = feature.select("feature", F.posexplode(polygons).alias("polygon", "p")).select("feature", "polygon", F.posexplode("p").alias("number", "r"))
    return rings.select("feature", "polygon", "number", F.transform("r", lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))).alias("ring"))


def along(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def clamped_share(t: Column, t0: Column, t1: Column) -> Column:
    """How far ``t`` lies from t0 to t1, within 0 and 1; a span of no length counts as one second."""
    span = F.when(t1 == t0, F.lit(1.0)).otherwise(t1 - t0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - t0) / span))


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)
