"""The collector stopped at bad moments, its ledger, and the reader of many services."""

import http.server
import json
import threading
import time
from datetime import datetime, timedelta, timezone

import pyarrow.parquet as pq
import pytest

from kestrel.sources import lake as lakes
from kestrel.sources.http import RegionReader, RegionSnapshotSource, TokenCache
from kestrel.streaming import collector
from kestrel.streaming.ledger import Ledger, Totals

START = 1_700_000_000


def state(icao, tp=1, lon=1.0):
    return [icao, "CS", "X", tp, tp, lon, 2.0, 10.0, False, 5.0, 0.0, 0.0, None, 11.0, "0743", False, 0]


def feed(folder, *polls):
    folder.mkdir(exist_ok=True)
    for k, rows in enumerate(polls, len(list(folder.iterdir()))):
        (folder / f"{k:03d}.json").write_text(json.dumps({"time": START + 60 * k, "states": rows}))


def run(spark, tmp_path, store, today="2023-11-14"):
    collector.collect(collector.replay(spark, str(tmp_path / "feed")), store, "boston", str(tmp_path / "ck"), None, lambda: today).awaitTermination(120)


@pytest.mark.parametrize("where", ["append", "record", "compact"])
def test_a_stop_between_write_and_commit_neither_doubles_nor_loses(spark, tmp_path, monkeypatch, where):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    feed(tmp_path / "feed", [state("a", tp=None), state("b", tp=None)], None, [state("a", tp=None)])
    owner, fails = {"append": (lakes.Lake, [1]), "record": (Ledger, [1]), "compact": (lakes.Lake, [2])}[where], None
    owner, fails = owner
    plain, calls = getattr(owner, where), []

    def once(self, *a, **k):
        out = plain(self, *a, **k)
        calls.append(1)
        if len(calls) in fails:
            raise RuntimeError("stopped here")
        return out

    monkeypatch.setattr(owner, where, once)
    with pytest.raises(Exception, match="stopped here"):
        run(spark, tmp_path, store)
    run(spark, tmp_path, store)
    feed(tmp_path / "feed", [state("c", tp=None)])
    run(spark, tmp_path, store)
    assert sorted(r.icao24 for r in store.raw().collect()) == ["a", "a", "b", "c"]
    got = Ledger(store).totals("boston")
    assert (got.polls, got.rows, got.last_poll.timestamp()) == (4, 4, START + 180)
    # rows without time_position all stay, so a doubled batch would show here
    assert store.compact("2023-11-16") == 1 and store.clean("boston").count() == 4


def test_a_new_checkpoint_overwrites_nothing(spark, tmp_path):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    feed(tmp_path / "feed", [state("a", tp=None)])
    run(spark, tmp_path, store)
    feed(tmp_path / "feed-2", [state("b", tp=None)])
    collector.collect(collector.replay(spark, str(tmp_path / "feed-2")), store, "boston", str(tmp_path / "ck-2"), None, lambda: "2023-11-14").awaitTermination(120)
    assert sorted(r.icao24 for r in store.raw().collect()) == ["a", "b"]


def test_open_days_read_no_rows(spark, tmp_path, monkeypatch):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    feed(tmp_path / "feed", [state("a")])
    run(spark, tmp_path, store)
    monkeypatch.setattr(lakes.Lake, "_read", lambda *_: pytest.fail("rows were read"))
    assert store.open_days("2023-11-16") == [("boston", "2023-11-14")] and store.open_days("2023-11-14") == [] == store.open_days("2023-11-16", ["miami"])
    assert store.compact("2023-11-14") == 0


def test_window_and_totals_survive_a_restart(spark, tmp_path):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    now = datetime(2023, 11, 14, tzinfo=timezone.utc)
    first = Ledger(store).begin("boston", 2.0, 60.0, now)
    feed(tmp_path / "feed", [state("a")], [state("a"), state("b")], [])
    run(spark, tmp_path, store)
    again = Ledger(lakes.Lake(spark, str(tmp_path / "lake")))
    assert again.begin("boston", 9.0, 300.0, now + timedelta(days=1)) == first and first.end - first.start == timedelta(days=2)
    before = again.totals("boston")
    assert (before.polls, before.rows) == (3, 3)
    again.fold("boston")
    assert again.totals("boston") == before and len(store.partitions("ledger/batches", "region", "batch")) == 1
    feed(tmp_path / "feed", [state("c")])
    run(spark, tmp_path, store)
    again.fold("boston")
    assert (again.totals("boston").polls, again.totals("boston").rows, again.window("boston").end) == (4, 4, first.end)
    assert Ledger(store).totals("miami") == Totals()


def test_a_fold_that_is_cut_off_keeps_the_totals(spark, tmp_path, monkeypatch):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    book = Ledger(store)
    book.begin("boston", 1.0)
    feed(tmp_path / "feed", [state("a")], [state("b")], [state("c")])
    run(spark, tmp_path, store)
    before = book.totals("boston")
    files = store._files()

    class Stuck:
        def __getattr__(self, name):
            if name == "delete":
                raise RuntimeError("cut off")
            return getattr(files, name)

    monkeypatch.setattr(lakes.Lake, "_files", lambda self: Stuck())
    with pytest.raises(RuntimeError):
        book.fold("boston")
    assert book.totals("boston") == before
    monkeypatch.undo()
    book.fold("boston")
    assert book.totals("boston") == before and len(store.partitions("ledger/batches", "region", "batch")) == 1


def test_older_states_are_taken_over_once(spark, tmp_path):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    old = {"start_ts": "2023-11-01T00:00:00+00:00", "end_ts": "2023-12-31T00:00:00+00:00", "poll_interval_seconds": 300, "total_polls": 7, "total_rows_written": 90, "last_poll_ts": None}
    book = Ledger(store)
    got = book.take_over("boston", json.dumps(old | {"compacted_dates": ["2023-11-14"]}))
    assert (got.polls, got.rows, got.every_s) == (7, 90, 300.0) and store.sealed() == [("boston", "2023-11-14")]
    assert book.take_over("boston", json.dumps(old | {"total_polls": 1})) == got and book.begin("boston", 1.0) == got
    assert book.take_over("miami", json.dumps(old)).rows == 90
    feed(tmp_path / "feed", [state("a")])
    run(spark, tmp_path, store, "2023-11-16")
    assert (book.totals("boston").polls, book.totals("boston").rows) == (8, 91)
    assert store.raw().count() == 1 and not store.partitions("clean", "region", "date")  # the day was sealed before


class Service:
    """A state service that answers, or fails with a status."""

    def __init__(self, name, status=200):
        self.asked, outer = 0, self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                outer.asked += 1
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps({"time": 1, "states": [state(f"{name}-{outer.asked}", tp=None)]}).encode())

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/states"


def test_one_failing_service_stops_no_other(spark, tmp_path):
    good, bad = Service("good"), Service("bad", 503)
    spark.dataSource.register(RegionSnapshotSource)
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    stream = spark.readStream.format("region_snapshots").option("keep", str(tmp_path / "keep")).option("regions", json.dumps({"north": {"url": good.url, "lamin": 1}, "south": {"url": bad.url}, "gone": {"url": "http://127.0.0.1:9/x"}})).load()
    today = f"{datetime.now(timezone.utc):%Y-%m-%d}"
    query = collector.collect(stream, store, None, str(tmp_path / "ck"), "2 seconds", lambda: today)
    until = time.time() + 60
    while good.asked < 3 and time.time() < until:
        time.sleep(0.2)
    collector.run_until(query, time.time())
    assert query.exception() is None and bad.asked == 1  # the pause holds from poll to poll
    rows = store.raw().collect()
    assert len(rows) >= 2 and {r.region for r in rows} == {"north"} and len({r.icao24 for r in rows}) == len(rows)
    assert Ledger(store).totals("north").polls == len(rows) and Ledger(store).totals("south") == Totals()


def test_a_poll_that_is_done_again_is_read_from_its_folder(tmp_path, monkeypatch):
    reader = RegionReader({"regions": json.dumps({"a": {"url": "x"}, "b": {"url": "y"}}), "keep": str(tmp_path / "keep")})
    said = iter(["one", "two", "three"])
    monkeypatch.setattr(reader, "fetch", lambda region: next(said))
    [a, b] = reader.partitions(reader.initialOffset(), {"at": 5})
    assert (a.region, b.region) == ("a", "b")
    first = list(reader.read(a))
    assert first == list(reader.read(a)) and first[0][0] == "a" and first[0][2] == "one"
    [later] = [p for p in reader.partitions({"at": 5}, {"at": 9}) if p.region == "a"]
    second = list(reader.read(later))
    reader.commit({"at": 9})
    assert second[0][2] == "two" and list(reader.read(later)) == second and not (tmp_path / "keep/a/5.json").exists()
    with pytest.raises(ValueError):
        RegionReader({"regions": "{}"})


def test_tokens_are_asked_for_anew_before_they_end():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append(self.rfile.read(int(self.headers["Content-Length"])).decode())
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"access_token": f"t{len(asked)}", **({"expires_in": 100} if len(asked) < 3 else {})}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    cache = TokenCache(f"http://127.0.0.1:{server.server_port}/token", "me", "hush")
    # 30 seconds early; without a life of its own a token has 1800 seconds
    assert [cache.get(now) for now in (0.0, 69.0, 70.0, 139.0, 140.0, 1909.0, 1910.0)] == ["t1", "t1", "t2", "t2", "t3", "t3", "t4"]
    assert len(asked) == 4 and "client_id=me" in asked[0] and "client_secret=hush" in asked[0]


def test_clean_days_are_written_in_order(spark, tmp_path):
    store = lakes.Lake(spark, str(tmp_path / "lake"))
    feed(tmp_path / "feed", [state(f"a{i * 7 % 10}", tp=i) for i in range(10)], [state(f"a{i}", tp=50 + i) for i in (3, 1, 2)])
    run(spark, tmp_path, store)
    assert store.compact("2023-11-16") == 1
    [file] = (tmp_path / "lake/clean/region=boston/date=2023-11-14").glob("*.parquet")
    rows = pq.read_table(file).select(["icao24", "query_timestamp_utc"]).to_pylist()
    keys = [(r["icao24"], r["query_timestamp_utc"]) for r in rows]
    assert keys == sorted(keys) and len(keys) == 13
