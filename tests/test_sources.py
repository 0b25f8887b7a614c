import json
import time

import pytest
from pyspark.sql import functions as F

from kestrel.schemas import STATES
from kestrel.sources import lake, states
from kestrel.sources.http import SnapshotReader, SnapshotSource, TokenCache
from kestrel.streaming import collector


def state(icao, callsign=None, tp=1, lon=1.0, lat=2.0, ground=False, velocity=5.0):
    return [icao, callsign, "X", tp, tp, lon, lat, 10.0, ground, velocity, 0.0, 0.0, None, 11.0, "0743", False, 0]


def payloads(spark, *items):
    return spark.createDataFrame([(t, json.dumps({"states": s})) for t, s in items], "t bigint, payload string").select(F.timestamp_seconds("t").alias("query_timestamp_utc"), "payload")


def test_payload_to_clean(spark):
    got = states.clean(states.from_payloads(payloads(spark, (0, [state("a", "AB1 "), state("b", "  "), state("a", velocity=9.0), state("c", lon=None)]), (300, None))), "reported")
    assert got.schema.names == STATES.names
    assert sorted((r.icao24, r.callsign, r.velocity, r.squawk) for r in got.collect()) == [("a", None, 9.0, "0743"), ("b", "", 5.0, "0743")]


def test_csv(spark, tmp_path):
    head = ",".join(STATES.names)
    line = '2024-01-01 10:00:00+00:00,abc,CS1 ,X,12.0,12,1.5,2.5,bad,True,1,2,3,"[1, 2]",,0743,False,'
    (tmp_path / "day.csv").write_text(head + "\n" + line + "\n")
    r = states.clean(states.read_csv(spark, str(tmp_path / "day.csv")), "stored").first()
    assert (r.callsign, r.time_position, r.baro_altitude, r.on_ground, r.sensors, r.geo_altitude, r.squawk, r.position_source) == ("CS1", 12, None, True, [1, 2], None, "0743", 0)
    (tmp_path / "bad.csv").write_text("icao24\nx\n")
    with pytest.raises(ValueError):
        states.read_csv(spark, str(tmp_path / "bad.csv"))


def cleaned(spark, *items):
    return states.clean(states.from_payloads(payloads(spark, *items)), "reported")


def test_compaction(spark, tmp_path):
    store, day = lake.Lake(spark, str(tmp_path / "lake")), 1_700_000_000
    store.append(cleaned(spark, (day, [state("a", tp=7, velocity=1.0), state("n", tp=None)])), "boston", "poll-1")
    store.append(cleaned(spark, (day + 300, [state("a", tp=7, velocity=2.0), state("n", tp=None)])), "boston", "poll-2")
    store.append(cleaned(spark, (day + 600, [state("m", tp=1)])), "miami", "poll-1")
    assert store.compact("2023-11-14") == 0
    assert store.compact("2023-11-15", ["boston"]) == 1
    got = lambda: sorted((r.icao24, r.velocity) for r in store.clean("boston").collect())
    assert got() == [("a", 2.0), ("n", 5.0), ("n", 5.0)]
    store.append(cleaned(spark, (day + 900, [state("late", tp=9)])), "boston", "poll-3")
    assert store.compact("2023-11-15", ["boston"]) == 0 and len(got()) == 3
    with pytest.raises(ValueError):
        store.clean("nowhere")
    assert store.today_or_latest("boston", "2023-11-14").count() == 4
    assert store.today_or_latest("boston", "2030-01-01").count() == 3


def test_migrated_rows_win_and_skip_date(spark, tmp_path):
    store, day = lake.Lake(spark, str(tmp_path / "lake")), 1_700_000_000
    store.append(cleaned(spark, (day + 60, [state("a", tp=7, velocity=1.0)])), "boston", "poll-000000000001")
    assert lake.backfill(store, cleaned(spark, (day, [state("a", tp=7, velocity=3.0)])), "boston", "2023-11-16", skip="2023-11-14").days == 0
    assert store.compact("2023-11-16") == 1
    assert [r.velocity for r in store.clean("boston").collect()] == [3.0]


def test_replay_survives_a_restart(spark, tmp_path):
    feed, store = tmp_path / "feed", lake.Lake(spark, str(tmp_path / "lake"))
    feed.mkdir()

    def run():
        collector.collect(collector.replay(spark, str(feed)), store, "boston", str(tmp_path / "ck"), None, lambda: "2023-11-14").awaitTermination(120)

    (feed / "1.json").write_text(json.dumps({"time": 1_700_000_000, "states": [state("a")]}))
    (feed / "2.json").write_text(json.dumps({"time": 1_700_000_300, "states": None}))
    run()
    (feed / "3.json").write_text(json.dumps({"time": 1_700_000_600, "states": [state("b", tp=3)]}))
    run()
    assert sorted(r.icao24 for r in store.raw().collect()) == ["a", "b"]


def test_snapshot_reader(monkeypatch):
    reader = SnapshotReader({"url": "http://localhost:1/none"})
    got, offset = reader.read({"polls": 0})
    assert list(got) == [] and offset == {"polls": 0} and reader.wait_until > 0
    reader = SnapshotReader({"url": "x"})
    monkeypatch.setattr(reader, "fetch", lambda: "{}")
    got, offset = reader.read(reader.initialOffset())
    assert [p for _, p in got] == ["{}"] and offset == {"polls": 1}
    assert SnapshotSource.name() == "snapshots"
    cache = TokenCache("http://unused", "a", "b")
    cache.value, cache.until = "t", 1000.0
    assert cache.get(now=900.0) == "t"


def test_kept_snapshots_are_read_again(monkeypatch, tmp_path):
    reader = SnapshotReader({"url": "x", "keep": str(tmp_path / "kept")})
    monkeypatch.setattr(reader, "fetch", lambda: '{"time": 1}')
    rows, first = reader.read(reader.initialOffset())
    rows = list(rows)
    _, second = reader.read(first)
    again = SnapshotReader({"url": "x", "keep": str(tmp_path / "kept")})
    assert list(again.readBetweenOffsets({"polls": 0}, first)) == rows and len(list(again.readBetweenOffsets({"polls": 0}, second))) == 2
    again.commit(second)
    assert list(again.readBetweenOffsets({"polls": 0}, first)) == [] and len(list(again.readBetweenOffsets(first, second))) == 1
    assert list(SnapshotReader({"url": "x"}).readBetweenOffsets({"polls": 0}, second)) == []


def test_run_until_ends_after_the_batch_in_hand(spark, tmp_path):
    feed, store = tmp_path / "feed", lake.Lake(spark, str(tmp_path / "lake"))
    feed.mkdir()
    (feed / "1.json").write_text(json.dumps({"time": 1_700_000_000, "states": [state("a")]}))
    query = collector.collect(collector.replay(spark, str(feed)), store, "boston", str(tmp_path / "ck"), "1 second", lambda: "2023-11-14")
    collector.run_until(query, time.time() + 12)
    assert not query.isActive and query.exception() is None
    assert [r.icao24 for r in store.raw().collect()] == ["a"]


@pytest.mark.parametrize("form", ["parquet", "csv", "json"])
def test_results_are_replaced_whole(spark, tmp_path, form):
    store = lake.Lake(spark, str(tmp_path / "lake"))
    for rows in ([("a", 1), ("b", 2)], [("c", 3)]):
        store.save(spark.createDataFrame(rows, "name string, n int"), "table", form)
    back = spark.read.option("header", True).format(form).load(str(tmp_path / "lake/results/table"))
    assert [(r.name, int(r.n)) for r in back.collect()] == [("c", 3)]
