"""The interval-bucket join: moving points against segments of moving objects."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.geometry import along, clamped_share, planar
from kestrel.operators.dedup import nearest_by


#: The join's own columns: a bucket of time and a cell of the grid.
PLACE = ["bucket", "cx", "cy"]


def bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def in_buckets(segs: DataFrame, width: int, most: int = 10_000) -> DataFrame:
    """Segments, one row for each bucket that they touch; one over more than ``most`` is an error, not dropped."""
    first, last = bucket(F.col("t0"), width), bucket(F.col("t1"), width)
    spanned = F.when(last - first >= most, F.raise_error(F.lit(f"a segment spans over {most} buckets"))).otherwise(F.sequence(first, last))
    return segs.withColumn("bucket", F.explode(spanned))


def cells_near(way: Callable[[str], Column], axis: str, width: int, radius: float, cell: float) -> tuple[Column, Column]:
    """The first and the last row of grid cells on an axis within ``radius`` of a way (its columns by name) in the ``bucket``."""
    reach = radius * (1 + 1e-9) + 1e-6
    ends = [along(way(f"{axis}0"), way(f"{axis}1"), clamped_share((F.col("bucket") + i) * F.lit(float(width)), way("t0"), way("t1"))) for i in (0, 1)]
    return F.floor((F.least(*ends) - reach) / cell), F.floor((F.greatest(*ends) + reach) / cell)


def in_cells(segs: DataFrame, width: int, radius: float, cell: float) -> DataFrame:
    """Segments in a bucket, one row for each grid cell within ``radius`` of their way in that bucket."""
    rows = segs.select("*", F.explode(F.sequence(*cells_near(F.col, "x", width, radius, cell))).alias("cx"))
    return rows.select("*", F.explode(F.sequence(*cells_near(F.col, "y", width, radius, cell))).alias("cy"))


#: What a segment is but for its object.
WAY = ["t0", "x0", "y0", "alt0", "t1", "x1", "y1", "alt1", "paired"]


def merged(segs: DataFrame, key: str, region: str | None = None) -> DataFrame:
    """Equal segments of several objects as one: ``key`` is the least of theirs (null, if one is), ``copies`` their number."""
    least = F.when(F.count(key) == F.count(F.lit(1)), F.min(key))
    return segs.groupBy(*([region] if region else []), *WAY).agg(least.alias(key), F.count(F.lit(1)).alias("copies"))


def together(rows: DataFrame, keys: Sequence[str], own: Sequence[str], name: str, most: int = 1024) -> DataFrame:
    """Rows equal in ``keys`` as one, with structs of their ``own`` columns in the array ``name``; beyond ``most`` of them, as several."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*own))
    parts = rows.select(*keys, *own, F.floor((nth - 1) / most).alias("_part"))
    return parts.groupBy(*keys, "_part").agg(F.collect_list(F.struct(*own)).alias(name)).drop("_part")


def placed(points: DataFrame, radius: float, width: int = 1, cell: float | None = None) -> DataFrame:
    """``points`` with their bucket, cx and cy, unless they have them."""
    if set(PLACE) <= set(points.columns):
        return points
    cell = cell or 4 * radius
    return points.withColumns({"bucket": bucket(F.col("t"), width), "cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})


def meetings(points: DataFrame, segs: DataFrame, radius: float, width: int = 1, on: Sequence[str] = (), cell: float | None = None) -> DataFrame:
    """All columns of the pairs that ``candidates`` describes, with their bucket, cx and cy; rows are dealt by these and ``on``.

    Sizes that are estimated leave out what ``explode`` adds to a side, so the join
    is told to merge: neither side is ever broadcast.
    """
    cell = cell or 4 * radius
    right = in_cells(in_buckets(segs, width), width, radius, cell)
    met = placed(points, radius, width, cell).hint("merge").join(right, [*PLACE, *on])
    met = met.withColumn("share", clamped_share(F.col("t"), F.col("t0"), F.col("t1")))
    return met.withColumns(offsets(F.col, F.col("share"))).withColumn("horizontal", planar(F.col("dx"), F.col("dy"))).where(F.col("horizontal") <= radius)


def offsets(way: Callable[[str], Column], share: Column) -> dict[str, Column]:
    """dx, dy and vertical of a point and a way (its columns by name) at ``share`` of it."""
    return {
        "dx": along(way("x0"), way("x1"), share) - F.col("x"), "dy": along(way("y0"), way("y1"), share) - F.col("y"),
        "vertical": F.abs(F.col("alt") - along(way("alt0"), way("alt1"), share))}


def candidates(points: DataFrame, segs: DataFrame, key: str, radius: float, width: int = 1, region: str | None = None, cell: float | None = None) -> DataFrame:
    """Pairs of a point and a segment in one bucket of time, at most ``radius`` apart in the plane.

    ``points`` has t, x, y, alt; ``segs`` has ``key``, t0, t1, x0.. alt1, paired.
    Buckets are compared, not the interval, so the share along a segment is
    clamped. An equi-join on the bucket, on a cell of a grid (of four times the
    radius, unless ``cell`` says otherwise) and on ``region`` carries the join: a
    point lies in one cell, a segment in all that it may be near in the bucket.
    The distance filters what meets. Results are the points' columns and key, dx, dy,
    horizontal, vertical, t0, paired, and copies where ``segs`` are ``merged``.
    """
    met = meetings(points, segs, radius, width, [region] if region else [], cell)
    return met.select(*points.columns, key, "dx", "dy", "horizontal", "vertical", "t0", "paired", *[c for c in ("copies",) if c in segs.columns])


def within(h: float, v: float) -> Column:
    """The separation rule, which is the cylinder too."""
    return (F.col("horizontal") <= h) & (F.col("vertical") <= v)


def nearest(found: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Count of candidates and the one nearest in the plane, for each point that has any."""
    order = [F.col("horizontal"), F.col("paired"), F.col(key), F.col("t0")]
    near = nearest_by(found, keys, order, {"nearest": F.col(key), "nearest_h": F.col("horizontal"), "nearest_v": F.col("vertical")})
    return near


def labels(points: DataFrame, found: DataFrame, keys: list[str], key: str, h: float, v: float, more: Mapping[str, Column] | None = None) -> DataFrame:
    """``points`` with danger, n_candidates and the nearest candidate: one aggregation, one left join.

    ``more`` names predicates on candidates, each a flag of the points that any candidate fulfils.
    """
    flags = {"danger": within(h, v), **(more or {})}
    best = F.min_by(F.struct(F.col(key).alias("nearest"), F.col("horizontal").alias("nearest_h"), F.col("vertical").alias("nearest_v")),
                    F.struct("horizontal", "paired", key, "t0")).alias("best")
    by = found.groupBy(*keys).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()], F.count(F.lit(1)).alias("n"), best)
    by = by.select(*keys, *flags, "n", "best.*")
    return points.join(by, keys, "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in flags} | {"n_candidates": F.coalesce("n", F.lit(0))}).drop("n")


def counted(found: DataFrame) -> Column:
    """Aggregate: the number of candidates, each ``merged`` one as often as it stands for."""
    return F.sum("copies") if "copies" in found.columns else F.count(F.lit(1))


def labels_where_met(points: DataFrame, segs: DataFrame, key: str, radius: float, width: int, h: float, v: float, more: Mapping[str, Column] | None = None) -> DataFrame:
    """The points that have candidates, with what ``labels`` adds; equal points come out as one.

    Points are dealt once, to the join's place, and candidates never. The first
    pass over the candidates takes flags, counts and the least distance in a hash
    table of the points; the second meets the same segments where they lie and only
    keeps those at that distance, so that the order that breaks ties sorts no more
    than these.
    """
    flags = {"danger": within(h, v), **(more or {})}
    points = placed(points, radius, width)
    own = [*PLACE, *[c for c in points.columns if c not in PLACE]]
    met = meetings(points, segs, radius, width)
    by = met.groupBy(*own).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()], counted(met).alias("n_candidates"), F.min("horizontal").alias("nearest_h"))
    ties = meetings(by, segs, radius, width).where(F.col("horizontal") == F.col("nearest_h"))
    best = nearest_by(ties, by.columns, [F.col("paired"), F.col(key), F.col("t0")], {"nearest": F.col(key), "nearest_v": F.col("vertical")})
    return best.drop(*PLACE)


def labels_by_place(points: DataFrame, segs: DataFrame, keys: list[str], key: str, radius: float, width: int, h: float, v: float, more: Mapping[str, Column] | None = None) -> DataFrame:
    """``points``, which ``keys`` tell apart, with what ``labels_where_met`` finds; those without candidates have none of its columns set."""
    met = labels_where_met(points, segs, key, radius, width, h, v, more)
    return points.hint("merge").join(met.drop(*[c for c in points.columns if c not in keys]), keys, "left")


def offsets_of_nearest(labelled: DataFrame, segs: DataFrame, key: str, radius: float, width: int) -> DataFrame:
    """``labelled`` points, each with dx and dy of all candidates that its nearest object has; nulls where it has none.

    Only objects that are nearest to a point take part. ``labelled`` is read twice.
    """
    named = labelled.where(F.col("nearest").isNotNull())
    own = segs.withColumn("nearest", F.col(key)).join(named.select("nearest").distinct().hint("merge"), "nearest", "left_semi")
    offsets = candidates(named, own, key, radius, width, "nearest").select(*labelled.columns, "dx", "dy")
    return offsets.unionByName(labelled.where(F.col("nearest").isNull()), allowMissingColumns=True)


def gathered(segs: DataFrame, key: str, width: int) -> DataFrame:
    """What ``segments`` makes, by bucket and object: bucket, way, ``rest`` (the object's further ways in that bucket, or null), copies and objects.

    Rows that are equal in their ways are one, for ``objects`` objects. In a bucket
    strictly between its ends a segment is its object's only one, so only the buckets
    of ends are put together by object; the others go by the segment's way, as do
    those of no object.
    """
    first, last = bucket(F.col("t0"), width), bucket(F.col("t1"), width)
    way = F.struct(*WAY)
    named = segs.where(F.col(key).isNotNull())
    ends = named.select(key, way.alias("way"), F.explode(F.array_distinct(F.array(first, last))).alias("bucket"))
    ends = ends.groupBy(key, "bucket").agg(F.sort_array(F.collect_list("way")).alias("ways"))
    ends = ends.groupBy("bucket", "ways").agg(F.count(F.lit(1)).alias("objects"))
    ends = ends.select("bucket", F.col("ways")[0].alias("way"), F.when(F.size("ways") > 1, F.slice("ways", 2, F.size("ways") - 1)).alias("rest"), F.col("objects").alias("copies"), "objects")
    alone = segs.where(F.col(key).isNull() | (last - first > 1)).groupBy(*WAY).agg(F.count(F.lit(1)).alias("copies"), F.count(key).alias("objects"))
    alone = in_buckets(alone, width).where((F.col("objects") == 0) | ((F.col("bucket") > first) & (F.col("bucket") < last)))
    return ends.unionByName(alone.select("bucket", way.alias("way"), F.lit(None).cast(ends.schema["rest"].dataType).alias("rest"), "copies", "objects"))


def group_sizes(points: DataFrame, segs: DataFrame, keys: list[str], key: str, radius: float, width: int, h: float, v: float) -> DataFrame:
    """n candidates, danger and the number of objects of each point that has any.

    ``segs`` are those of ``segments``. A point meets all ways of an object in its
    bucket in one row, so that objects are counted without a list of them; rows
    are grouped where they meet, and never shuffled.
    """
    cell = 4 * radius
    rows = gathered(segs, key, width)

    def cells(axis: str) -> Column:
        low, high = cells_near(lambda c: F.col("way")[c], axis, width, radius, cell)
        lows, highs = (F.transform("rest", lambda w: F.struct(*cells_near(lambda c: w[c], axis, width, radius, cell))[f"col{i}"]) for i in (1, 2))
        return F.sequence(F.least(low, F.array_min(lows)), F.greatest(high, F.array_max(highs)))

    rows = rows.select("*", F.explode(cells("x")).alias("cx"))
    rows = rows.select("*", F.explode(cells("y")).alias("cy"))

    def tested(way: Callable[[str], Column]) -> tuple[Column, Column]:
        at = offsets(way, clamped_share(F.col("t"), way("t0"), way("t1")))
        horizontal = planar(at["dx"], at["dy"])
        return horizontal <= radius, (horizontal <= h) & (at["vertical"] <= v)

    met = placed(points, radius, width, cell).hint("merge").join(rows, PLACE)
    near, inside = tested(lambda c: F.col("way")[c])
    further = F.coalesce(F.size(F.filter("rest", lambda w: tested(lambda c: w[c])[0])), F.lit(0))
    dangers = F.coalesce(F.exists("rest", lambda w: F.coalesce(tested(lambda c: w[c])[0] & tested(lambda c: w[c])[1], F.lit(False))), F.lit(False))
    more = F.col("rest").isNotNull()
    met = met.select(*PLACE, *keys, "copies", "objects", (F.coalesce(near, F.lit(False)).cast("long") + F.when(more, further).otherwise(0)).alias("n"),
                     (F.coalesce(near & inside, F.lit(False)) | F.when(more, dangers).otherwise(False)).alias("danger")).where("n > 0")
    return met.groupBy(*PLACE, *keys).agg(F.sum(F.col("n") * F.col("copies")).alias("n"), F.bool_or("danger").alias("danger"), F.sum("objects").alias("objects")).drop(*PLACE)
