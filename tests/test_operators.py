import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel import config
from kestrel.functions import geodesy, geometry, parsing, quantize, randoms
from kestrel.operators import dedup, numbering, proximity, segments, shapes, simulate, statistics


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").orderBy("i")


@pytest.mark.parametrize("function, values, expected", [
    (parsing.parse_bool, ["True", "False", "true", "1", "", None], [True, False, False, False, False, False]),
    (parsing.trim_reported, ["AB1 ", "   ", "", None], ["AB1", "", None, None]),
    (parsing.trim_stored, ["AB1 ", "   ", "", None], ["AB1", None, None, None]),
    (parsing.parse_longs, ["[1, 2]", "(3)", "[]", "oops", "", None], [[1, 2], [3], None, None, None, None]),
    (parsing.parse_double, ["1.5", "abc", "", "NaN"], [1.5, None, None, None]),
    (parsing.parse_long, ["12.0", "7", "x"], [12, 7, None]),
    (parsing.parse_byte, [None, "2"], [0, 2]),
    (parsing.slug, ["New York"], ["new_york"]),
    (parsing.has_offset, ["2024-01-01 00:00:00+02:00", "2024-01-01 00:00:00", None], [True, False, False]),
])
def test_parsing(spark, function, values, expected):
    assert [r[0] for r in column(spark, values).select(function(F.col("c"))).collect()] == expected


def test_golden_constants():
    v = config.Volumes()
    assert (v.sphere_m, v.major_m, v.minor_m) == pytest.approx((144.2249570307408, 300, 100), abs=1e-9)
    codes = {"Boston": 32619, "New York": 32618, "Los Angeles": 32611, "Chicago": 32616, "San Francisco": 32610, "Seattle": 32610,
             "Miami": 32617, "Dallas": 32614, "Atlanta": 32616, "Denver": 32613, "London": 32630}
    assert {r: config.utm_epsg(config.bbox_of(r)) for r in config.REGIONS} == codes
    with pytest.raises(ValueError):
        config.bbox_of("Atlantis")


def test_geodesy(spark):
    frame = spark.createDataFrame([(7.5, 51.2)], "lon double, lat double")
    x, y = geodesy.utm(frame, "lon", "lat", 32632, "x", "y").select("x", "y").first()
    assert (x, y) == pytest.approx((395201.3104, 5673135.241), abs=1e-3)
    dms = lambda d, m, s: d + m / 60 + s / 3600
    frame = spark.createDataFrame([(dms(144, 25, 29.52440), -dms(37, 57, 3.72030), dms(306, 52, 5.37), 54972.271)], "lon double, lat double, az double, m double")
    lon, lat = geodesy.direct(frame, "lon", "lat", "az", "m", "lon2", "lat2").select("lon2", "lat2").first()
    assert (lon, lat) == pytest.approx((dms(143, 55, 35.38390), -dms(37, 39, 10.15610)), abs=2e-8)


def test_clip(spark):
    ring = "array<struct<x:double,y:double>>"
    frame = spark.createDataFrame([
        ("cover", [(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)]), ("outside", [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]),
        ("edge", [(0.0, 0.0), (2.0, 0.0), (0.0, 0.5)])], f"name string, ring {ring}")
    got = {r.name: {(p.x, p.y) for p in r.ring} for r in geometry.clip(frame, "ring", (-1.0, -1.0, 1.0, 1.0)).collect()}
    assert got == {"cover": {(-1, -1), (1, -1), (1, 1), (-1, 1)}, "edge": {(0, 0), (1, 0), (1, 0.25), (0, 0.5)}}
    overlap = frame.where(geometry.overlaps_box(F.col("ring"), (-1.0, -1.0, 1.0, 1.0)))
    assert {r.name for r in overlap.collect()} == {"cover", "edge"}


def test_geojson(spark):
    text = '{"features":[{"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}},{"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6]]],[[[7,7],[8,7],[8,8]]]]}}]}'
    got = geometry.geojson_rings(spark.createDataFrame([(text,)], "j string"), "j").collect()
    assert sorted((r.feature, r.polygon, r.number, r.ring[0].x) for r in got) == [(0, 0, 0, 0.0), (1, 0, 0, 5.0), (1, 1, 0, 7.0)]


def observed(spark, data):
    return spark.createDataFrame(data, "id string, t double, x double, y double, alt double")


def test_gap_limits(spark):
    got = segments.segments(observed(spark, [("a", 0.0, 0.0, 0.0, 0.0), ("a", 180.0, 1.0, 1.0, 1.0), ("a", 360.000001, 2.0, 2.0, 2.0)]), "id", "t", ["x", "y", "alt"], 180.0)
    assert sorted((r.paired, r.t0, r.t1) for r in got.collect()) == [(0, 0, 0), (0, 180, 180), (0, 360.000001, 360.000001), (1, 0, 180)]


def joined(spark, seg_rows, point, radius=330.0):
    segs = segments.segments(observed(spark, seg_rows), "id", "t", ["x", "y", "alt"], 180.0)
    points = spark.createDataFrame([point], "p int, t double, x double, y double, alt double, heading double")
    return points, proximity.candidates(points, segs, "id", radius)


def test_bucket_join_compares_seconds_not_intervals(spark):
    _, got = joined(spark, [("a", 100.7, 0.0, 0.0, 0.0), ("a", 160.7, 60.0, 0.0, 0.0)], (1, 100.2, 0.0, 0.0, 0.0, 0.0))
    assert {(r.paired, r.dx) for r in got.collect()} == {(0, 0.0), (1, 0.0)}


def test_three_candidates_of_one_object(spark):
    _, got = joined(spark, [("a", 40.5, 0.0, 0.0, 0.0), ("a", 100.5, 60.0, 0.0, 0.0), ("a", 160.5, 120.0, 0.0, 0.0)], (1, 100.5, 0.0, 0.0, 0.0, 0.0))
    assert got.count() == 3


def test_nearest_is_horizontal_even_if_another_is_the_danger(spark):
    points, got = joined(spark, [("A", 5.0, 50.0, 0.0, 300.0), ("B", 5.0, 150.0, 0.0, 10.0)], (1, 5.0, 0.0, 0.0, 0.0, 0.0))
    r = proximity.labels(points.select("p"), got, ["p"], "id", 200, 50).first()
    assert (r.danger, r.nearest, r.n_candidates) == (True, "A", 2)


def test_search_radius_includes_its_edge(spark):
    _, got = joined(spark, [("A", 5.0, 330.0, 0.0, 0.0), ("B", 5.0, 330.0001, 0.0, 0.0)], (1, 5.0, 0.0, 0.0, 0.0, 0.0))
    assert [r.id for r in got.collect()] == ["A"]


def test_no_candidates(spark):
    points, got = joined(spark, [("A", 500.0, 0.0, 0.0, 0.0)], (1, 5.0, 0.0, 0.0, 0.0, 0.0))
    r = proximity.labels(points.select("p"), got, ["p"], "id", 200, 50).first()
    assert (r.danger, r.nearest, r.n_candidates) == (False, None, 0)


def test_shapes(spark):
    frame = spark.createDataFrame([(200.0, 50.0, 200.0, 0.0, 0.0), (290.0, 0.0, 290.0, 0.0, 90.0), (290.0, 0.0, 0.0, 290.0, 90.0)], "horizontal double, vertical double, dx double, dy double, heading double")
    got = frame.select(*[c.alias(n) for n, c in shapes.all_shapes().items()]).collect()
    assert [(r.cylinder, r.ellipsoid) for r in got] == [(True, False), (False, True), (False, False)]
    with pytest.raises(ValueError):
        shapes.assert_same(frame.select((F.col("dx") > 0).alias("a"), F.lit(True).alias("b")), "a", "b")


@pytest.mark.parametrize("few, n, p", [(2, 10, 0.109375), (3, 7, 1.0), (14, 42, 0.0435585219), (0, 0, 1.0)])
def test_exact_binomial(spark, few, n, p):
    frame = spark.createDataFrame([(few, n)], "few bigint, n bigint")
    assert frame.select(statistics.binomial_two_sided(F.col("few"), F.col("n"))).first()[0] == pytest.approx(p, abs=1e-9)


def test_rates_without_dangers(spark):
    r = statistics.with_rates(spark.createDataFrame([(0, 1, 9, 0)], "TP bigint, FP bigint, TN bigint, FN bigint")).first()
    assert (r.TPR, r.FPR, r.dist_to_corner) == (None, 0.1, None)


@pytest.mark.parametrize("mean", [0.0, 0.4, 9.0, 2500.0])
def test_poisson_counts(mean):
    got = np.array([randoms.poisson_count(mean, f"{mean}|{i}") for i in range(1500)])
    assert abs(got.mean() - mean) <= 4 * (mean / 1500) ** 0.5 and (not mean or got.var() == pytest.approx(mean, rel=0.15))


def test_replicates_draw_as_many_clusters_as_there_are(spark):
    made = [("d", "s", i, 1, i, 0, 0) for i in range(700)] + [("e", "s", i, 1, i, 0, 0) for i in range(20)] + [("f", "s", 7, 1, 7, 0, 0)]
    clusters = spark.createDataFrame(made, "density string, shape string, drone string, TP long, FP long, TN long, FN long")
    got = statistics.replicates(clusters, "drone", 300, 5).collect()
    assert {(r.density, r.TP) for r in got} == {("d", 700), ("e", 20), ("f", 1)} and len(got) == 900 and all(r.TP == r.n_clusters for r in got)
    # the sum of numbers drawn with replacement has n times their mean and variance
    for name, n in (("d", 700), ("e", 20)):
        sums = np.array([r.FP for r in got if r.density == name])
        assert abs(sums.mean() - n * (n - 1) / 2) < 4 * n * (n / 12**0.5) / (n * 300) ** 0.5 * 1.2
        assert sums.std() == pytest.approx((n * (n * n - 1) / 12) ** 0.5, rel=0.15)
    again = statistics.replicates(clusters.repartition(7), "drone", 300, 5).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_bootstrap_agrees_with_plain_resampling(spark):
    draw = np.random.default_rng(3)
    counts = np.stack([draw.poisson(m, 150) for m in (2, 1, 40, 1)], 1)
    clusters = spark.createDataFrame([("d", "s", i, *map(int, c)) for i, c in enumerate(counts)], "density string, shape string, drone long, TP long, FP long, TN long, FN long")
    got = statistics.bootstrap(clusters, "drone", 2000, 1).first()
    sums = counts[draw.integers(0, 150, (4000, 150))].sum(1)
    tpr, fpr = sums[:, 0] / (sums[:, 0] + sums[:, 3]), sums[:, 1] / (sums[:, 1] + sums[:, 2])
    for name, rates in (("tpr", tpr), ("fpr", fpr)):
        for end, q in (("low", 0.025), ("high", 0.975)):
            assert got[f"{name}_{end}"] == pytest.approx(np.quantile(rates, q), abs=0.15 * rates.std())
    assert got.n_clusters == 150


def test_percentile(spark):
    r = column(spark, [1.0, 2.0, 5.0, 9.0, 20.0], "double").agg(F.percentile("c", 0.025), F.percentile("c", 0.975)).first()
    assert tuple(r) == pytest.approx((1.1, 18.9))


def test_keep_last(spark):
    frame = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", None, 1), ("b", None, 2)], "k string, tp int, o int")
    assert sorted(rows(dedup.keep_last_where_set(frame, ["k"], "tp", [F.col("o")])), key=str) == [("a", 1, 2), ("b", None, 1), ("b", None, 2)]
    assert sorted(rows(dedup.keep_last(frame, ["k"], [F.col("o")])), key=str) == [("a", 1, 2), ("b", None, 2)]


def test_grain(spark):
    left, right = spark.range(4).withColumn("a", F.col("id") * 2), spark.range(4).withColumn("b", F.lit("x"))
    assert sorted(rows(dedup.inner_by_grain(left, right, ["id"]))) == [(i, 2 * i, "x") for i in range(4)]
    for bad in (right.where("id < 3"), right.union(right.limit(1)), right.union(spark.range(9, 10).withColumn("b", F.lit("y")))):
        for sides in ((left, bad), (bad, left)):
            with pytest.raises(Exception, match="grain differs"):
                dedup.inner_by_grain(*sides, ["id"]).collect()


def test_segments_of_a_long_track_in_blocks(spark):
    draw = random.Random(6)
    obs = [(draw.choice(["a", "b", None]), draw.choice(["n", "s"]), float(draw.randrange(4000)), float(i)) for i in range(600)]
    frame = spark.createDataFrame(obs, "id string, region string, t double, x double")
    want = rows(segments.pair_segments(frame, ["region", "id"], "t", ["x"], 30.0, ("x",)))
    assert sorted(rows(segments.pair_segments(frame, ["region", "id"], "t", ["x"], 30.0, ("x",), 100.0))) == sorted(want) and len(want) > 100
    assert all(r[1] is not None for r in want)
    with pytest.raises(ValueError):
        segments.pair_segments(frame, "id", "t", ["x"], 30.0, block_s=10.0)


def test_rings_meet_the_regions_that_they_reach_into(spark):
    draw = random.Random(3)
    rings = []
    for i in range(120):
        x, y, r = draw.uniform(-170, 170), draw.uniform(-80, 80), draw.choice([0.2, 3.0, 40.0, 300.0])
        rings.append((i, [(x, y), (x + draw.uniform(0, r), y + draw.uniform(-r, r)), (x - draw.uniform(0, r), y + draw.uniform(0, r))]))
    rings += [(900, []), (901, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)])]
    boxes = [(f"r{k}", s, w, s + draw.uniform(0.5, 25), w + draw.uniform(0.5, 25)) for k, (s, w) in enumerate((draw.uniform(-80, 60), draw.uniform(-170, 150)) for _ in range(25))] + [("in", 2.0, 2.0, 3.0, 4.0)]
    frame = spark.createDataFrame(rings, "id int, ring array<struct<x:double,y:double>>")
    got = {(r.id, r.region): [tuple(p) for p in r.ring] for r in geometry.rings_in_regions(frame, "ring", spark.createDataFrame(boxes, "region string, south double, west double, north double, east double")).collect()}
    want = {}
    for name, *box in boxes:
        for r in geometry.clip(frame.where("size(ring) > 0"), "ring", tuple(box)).collect():
            want[r.id, name] = [tuple(p) for p in r.ring]
    assert got.keys() == want.keys() and len(got) > 60
    for key, ring in got.items():
        at = want[key].index(min(want[key]))
        assert ring == want[key][at:] + want[key][:at]
    assert got[901, "in"] == [(2.0, 2.0), (4.0, 2.0), (4.0, 3.0), (2.0, 3.0)]


def test_quantize_degenerate_and_error(spark):
    frame = column(spark, [5.0, 5.0], "double")
    assert rows(frame.crossJoin(quantize.parameters(frame, ["c"])).select(F.abs(quantize.restored(quantize.quantized(F.col("c"), F.col("c_s"), F.col("c_z")), F.col("c_s"), F.col("c_z")) - F.col("c")) < 1e-6)) == [(True,), (True,)]


def test_numbering(spark):
    frame = spark.range(50).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 10).alias("slot"), "id")
    got = numbering.number_in_order(frame, "g", "slot", "id").collect()
    assert sorted((r.g, r.id, r.i) for r in got) == sorted((i % 2, i, i // 2) for i in range(50))


def test_simulation_does_not_depend_on_partitions(spark):
    f = config.Flights(per_hour={"sparse": 6.0})
    box = config.bbox_of("Boston")
    made = [sorted(rows(simulate.flights(simulate.spawns(spark, 0.0, 3600.0, f).repartition(n), box, f)), key=str) for n in (1, 5)]
    assert made[0] == made[1] and len(made[0]) > 0
    legs = simulate.flights(simulate.spawns(spark, 0.0, 3600.0, f), box, f)
    track = simulate.tracks(legs).groupBy("drone_id").count().join(legs, "drone_id").collect()
    assert all(r["count"] == int(r.duration_s) + 1 and r.distance <= 8000.0001 for r in track)
    assert math.isclose(sum(r["count"] for r in track) / len(track), 706, rel_tol=0.6)


def crossing(spark, copies=4):
    """Points, each several times over, and tracks that objects share, some at equal distances: (points, segments)."""
    draw = random.Random(8)
    tracks = [[(float(60 * i + j), draw.choice([0.0, 50.0, 100.0, 400.0]), draw.choice([0.0, 60.0, 300.0]), 10.0 * draw.randrange(8)) for i in range(6)] for j in range(5)]
    seen = [(f"{c}{j}", *p) for c in "abcd"[:copies] for j, track in enumerate(tracks) for p in track]
    places = [(float(draw.randrange(400)), draw.choice([0.0, 50.0, 75.0]), draw.choice([0.0, 30.0]), 20.0) for _ in range(40)]
    points = spark.createDataFrame([(c * 100 + i, *p) for c in range(3) for i, p in enumerate(places)], "p int, t double, x double, y double, alt double")
    return points, segments.segments(observed(spark, seen), "id", "t", ["x", "y", "alt"], 180.0)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_no_side_of_the_proximity_join_is_broadcast(spark):
    points, segs = crossing(spark)
    assert "Broadcast" not in plan(proximity.candidates(points, segs, "id", 330.0))


SPOT = ["t", "x", "y", "alt"]


def test_labels_by_place_are_those_of_all_candidates(spark):
    points, segs = crossing(spark)
    want = proximity.labels(points, proximity.candidates(points, segs, "id", 330.0), ["p"], "id", 200, 50).select("p", "danger", "n_candidates", "nearest", "nearest_h", "nearest_v")
    got = proximity.labels_by_place(points.select(*SPOT).distinct(), proximity.merged(segs, "id"), SPOT, "id", 330.0, 1, 200, 50)
    got = points.join(got, SPOT, "left").select("p", F.coalesce("danger", F.lit(False)), F.coalesce("n_candidates", F.lit(0)), "nearest", "nearest_h", "nearest_v")
    assert sorted(rows(got), key=str) == sorted(rows(want), key=str) and any(r[2] > 8 for r in rows(want))


def test_offsets_of_the_nearest_object(spark):
    points, segs = crossing(spark)
    found = proximity.candidates(points, segs, "id", 330.0)
    labelled = proximity.labels(points, found, ["p"], "id", 200, 50).where("danger").select("p", *SPOT, "nearest")
    want = labelled.join(found.select("p", F.col("id").alias("nearest"), "dx", "dy"), ["p", "nearest"]).select("p", "nearest", "dx", "dy")
    got = proximity.offsets_of_nearest(labelled, segs, "id", 330.0, 1).select("p", "nearest", "dx", "dy")
    assert sorted(rows(got)) == sorted(rows(want)) and got.count() > 0


def test_merged_segments_are_counted_as_often_as_they_stand_for(spark):
    points, segs = crossing(spark)
    merged = proximity.merged(segs, "id")
    assert merged.count() * 4 == segs.count() and {r[0][0] for r in merged.select("id").collect()} == {"a"}
    alert = {"alert": shapes.all_shapes()["cylinder"]}
    want = shapes.evaluate(points, proximity.candidates(points, segs, "id", 330.0), ["p"], alert, "n")
    got = shapes.evaluate(points, proximity.candidates(points.select(*SPOT).distinct(), merged, "id", 330.0), SPOT, alert, "n")
    assert sorted(rows(got.select(*want.columns))) == sorted(rows(want))
    unnamed = observed(spark, [("a", 1.0, 0.0, 0.0, 0.0), (None, 1.0, 0.0, 0.0, 0.0)])
    assert [(r.id, r.copies) for r in proximity.merged(segments.segments(unnamed, "id", "t", ["x", "y", "alt"], 180.0), "id").collect()] == [(None, 2)]


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_pairs_of_what_lies_together_are_all_pairs(spark, most):
    points, segs = crossing(spark)
    want = proximity.candidates(points, segs, "id", 330.0).select("p", "id", "dx", "dy", "horizontal", "vertical", "t0", "paired")
    places, ways = proximity.together(points, SPOT, ["p"], "ps", most), proximity.together(segs, proximity.WAY, ["id"], "ids", most)
    met = proximity.candidates(places, ways, "ids", 330.0)
    got = met.select(F.explode("ps.p").alias("p"), *[c for c in met.columns if c != "ps"]).withColumn("id", F.explode("ids.id")).select(*want.columns)
    assert sorted(rows(got)) == sorted(rows(want)) and met.select(F.max(F.size("ids"))).first()[0] == min(most, 4)
    assert met.count() * 3 * 4 <= want.count() or most < 4


def test_group_sizes_without_a_shuffle_of_pairs(spark):
    points, segs = crossing(spark)
    found = proximity.candidates(points, segs, "id", 330.0)
    want = found.groupBy("p").agg(F.count(F.lit(1)), F.bool_or(proximity.within(200, 50)), F.count_distinct("id"))
    got = proximity.group_sizes(points, segs, ["p"], "id", 330.0, 1, 200, 50)
    assert sorted(rows(got)) == sorted(rows(want))
    joined, dealt = plan(got).split("SortMergeJoin", 1)
    assert "Exchange" not in joined and "Exchange" in dealt


def test_poisson_sums_are_those_of_the_column_arithmetic(spark):
    limits = [1400000000, 3000000000, 4000000000]
    units = spark.createDataFrame([("a" if i % 3 else "b", (i * 2654435769) % 2**32, [i, 7]) for i in range(90)], "g string, base long, counts array<long>").withColumn("limits", F.array(*[F.lit(x).cast("long") for x in limits]))
    got = pd.concat(statistics.poisson_sums([units.toPandas()], ["g"], ["x", "y"], 40))
    draws = statistics.with_mixed(units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(39)))), "u", F.col("base") + F.col("rep").cast("long") * statistics.APART)
    times = sum((F.col("u") >= x).cast("int") for x in limits)
    want = draws.select("g", "rep", "counts", times.alias("times")).groupBy("g", "rep").agg(F.sum(F.col("counts")[0] * F.col("times")), F.sum(F.col("counts")[1] * F.col("times")), F.sum("times"))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(rows(want)) and len(got) == 80
