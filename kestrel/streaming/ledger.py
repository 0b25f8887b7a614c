"""The collector's ledger: each region's run window, and what every batch brought.

An entry belongs to a batch of a stream and is replaced whole, so a batch that is
done again counts once. A window is a numbered version that is never changed;
the last complete one holds. Totals are the window's own and its later entries'.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from kestrel.sources.lake import Lake

WINDOW = "start timestamp, end timestamp, every_s double, polls long, rows long, last_poll timestamp, folded array<string>"
ENTRY = "polls long, rows long, last_poll timestamp, region string, batch string"


@dataclass(frozen=True)
class Totals:
    """Polls that succeeded, rows that were written, and the time of the last poll."""

    polls: int = 0
    rows: int = 0
    last_poll: datetime | None = None


class Ledger:
    def __init__(self, lake: Lake):
        self.lake, self.spark = lake, lake.spark

    def _versions(self, region: str) -> list[int]:
        files = self.lake._files()
        found = [int(v) for r, v in self.lake.partitions("ledger/windows", "region", "version") if r == region]
        return sorted(v for v in found if files.exists(self.lake._path(f"ledger/windows/region={region}/version={v}/_SUCCESS")))

    def window(self, region: str) -> Row | None:
        """The region's window, or None before its first run."""
        done = self._versions(region)
        return self.spark.read.schema(WINDOW).parquet(f"{self.lake.root}/ledger/windows/region={region}/version={done[-1]}").first() if done else None

    def _put(self, region: str, values: tuple) -> Row:
        version = max(self._versions(region), default=0) + 1
        rows = self.spark.createDataFrame([values], WINDOW)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.lake.root}/ledger/windows/region={region}/version={version}")
        return self.window(region)

    def begin(self, region: str, days: float, every_s: float = 300.0, now: datetime | None = None) -> Row:
        """The window that the region's run has, or a new one from now for ``days``: a restart goes on to the same end."""
        now = now or datetime.now(timezone.utc)
        return self.window(region) or self._put(region, (now, now + timedelta(days=days), every_s, 0, 0, None, []))

    def take_over(self, region: str, text: str) -> Row:
        """The window of an older collector's state (a JSON object, of either version), unless the region has one already.

        Its totals are kept, and the days that it compacted are sealed. The names of
        its fields are fixed values.
        """
        if found := self.window(region):
            return found
        old = json.loads(text)
        when = {k: datetime.fromisoformat(old[k]) if old.get(k) else None for k in ("start_ts", "end_ts", "last_poll_ts")}
        self.lake.seal([(region, d) for d in old.get("compacted_dates", [])])
        return self._put(region, (when["start_ts"], when["end_ts"], float(old["poll_interval_seconds"]), int(old["total_polls"]), int(old["total_rows_written"]), when["last_poll_ts"], []))

    def record(self, entries: DataFrame) -> None:
        """Entries (``ENTRY``) of a batch, one for each of its regions."""
        self.lake._overwrite(entries.select("polls", "rows", "last_poll", "region", "batch").repartition(1), "ledger/batches", "region", "batch")

    def entries(self, region: str) -> DataFrame:
        return self.lake._read("ledger/batches", ENTRY).where(F.col("region") == region)

    def totals(self, region: str) -> Totals:
        own = self.window(region)
        later = self.entries(region)
        if own and own.folded:
            later = later.where(~F.col("batch").isin(own.folded))
        sums = later.agg(F.sum("polls").alias("polls"), F.sum("rows").alias("rows"), F.max("last_poll").alias("last")).first()
        times = [t for t in (sums.last, own.last_poll if own else None) if t]
        return Totals((sums.polls or 0) + (own.polls if own else 0), (sums.rows or 0) + (own.rows if own else 0), max(times, default=None))

    def fold(self, region: str) -> None:
        """Adds all entries but the last to the window, in one version, and drops their files.

        Cut off at any point, it leaves the totals as they are: the new version
        names the entries that it holds until they are gone.
        """
        own = self.window(region)
        batches = sorted(b for r, b in self.lake.partitions("ledger/batches", "region", "batch") if r == region)
        done = batches[:-1]
        if not own or not done:
            return
        fresh = [b for b in done if b not in own.folded]
        sums = self.entries(region).where(F.col("batch").isin(fresh)).agg(F.sum("polls").alias("polls"), F.sum("rows").alias("rows"), F.max("last_poll").alias("last")).first()
        times = [t for t in (sums.last, own.last_poll) if t]
        self._put(region, (own.start, own.end, own.every_s, own.polls + (sums.polls or 0), own.rows + (sums.rows or 0), max(times, default=None), done))
        for batch in done:
            self.lake._files().delete(self.lake._path(f"ledger/batches/region={region}/batch={batch}"), True)
