"""The collector: payload snapshots to the lake's raw layer, days closed on the way."""

from __future__ import annotations

import json
import signal
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kestrel.sources import states
from kestrel.sources.lake import Lake
from kestrel.streaming.ledger import Ledger


def replay(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """Payload files (one JSON object each, with ``time`` in epoch seconds and ``states``) as a stream."""
    lines = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(folder)
    at = F.timestamp_seconds(F.get_json_object("value", "$.time").cast("bigint"))
    return lines.select(at.alias("query_timestamp_utc"), F.col("value").alias("payload"))


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps for as long as its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"].split("-")[0]


def collect(payloads: DataFrame, lake: Lake, region: str | None, checkpoint: str, every: str | None = "300 seconds", today: Callable[[], str] | None = None) -> StreamingQuery:
    """Starts a query that appends each batch's clean rows, notes them in the ledger and compacts closed days.

    ``region`` None takes the payloads' own ``region``. ``every`` None takes what is
    there and ends. A batch without rows writes nothing, but its polls count. The
    checkpoint lets a restart go on where the last run stopped. Rows and the
    ledger's entry are keyed by the stream and its batch: a batch that is done
    again after a failure replaces what it left, so nothing is lost or doubled.
    """
    regions = None if region is None else [region]

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch if region is None else batch.withColumn("region", F.lit(region))
        rows = states.clean(states.from_payloads(placed), "reported").persist()
        try:
            polls = placed.groupBy("region").agg(F.count(F.lit(1)).alias("polls"), F.max("query_timestamp_utc").alias("last_poll")).collect()  # a row for each region
            if polls:
                # files are in the order of time, whatever stream they come from
                key = f"poll-{max(r.last_poll for r in polls):%Y%m%dT%H%M%S}-{stream_name(spark, checkpoint)}-{number:012d}"
                counts = {r.region: r["n"] for r in rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
                if counts:
                    lake.append(rows, None, key)
                entries = [(r.polls, counts.get(r.region, 0), r.last_poll, r.region, key) for r in polls]
                Ledger(lake).record(spark.createDataFrame(entries, "polls long, rows long, last_poll timestamp, region string, batch string"))
        finally:
            rows.unpersist()
        lake.compact(today() if today else None, regions)

    lake.compact(today() if today else None, regions)
    writer = payloads.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_until(query: StreamingQuery, end: float) -> None:
    """Waits until ``end`` (epoch seconds) or a signal, then stops after the batch in hand."""
    stopped: list[int] = []
    for kind in (signal.SIGINT, signal.SIGTERM):
        signal.signal(kind, lambda *_: stopped.append(1))
    while query.isActive and not stopped and time.time() < end:
        query.awaitTermination(min(1.0, max(0.01, end - time.time())))
    while query.isActive and query.status["isTriggerActive"]:
        time.sleep(0.1)
    query.stop()
