"""A state service as a Spark data source: each read is one snapshot of a box."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "query_timestamp_utc timestamp, payload string"


class TokenCache:
    """A bearer token, asked for anew ``margin`` seconds before it ends."""

    def __init__(self, url: str, client: str, secret: str, margin: float = 30.0, default_life: float = 1800.0):
        self.url, self.client, self.secret, self.margin, self.default_life = url, client, secret, margin, default_life
        self.value, self.until = "", 0.0

    def get(self, now: float | None = None) -> str:
        now = time.time() if now is None else now
        if now >= self.until - self.margin:
            form = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": self.client, "client_secret": self.secret}).encode()
            with urllib.request.urlopen(urllib.request.Request(self.url, data=form), timeout=30) as reply:
                answer = json.load(reply)
            self.value, self.until = answer["access_token"], now + float(answer.get("expires_in", self.default_life))
        return self.value


class SnapshotReader(SimpleDataSourceStreamReader):
    """One snapshot a micro-batch. After an error it gives no rows until a pause is over; the offset counts snapshots.

    With a ``keep`` folder, on a disk that outlives the driver, each snapshot is
    written there before the offset moves, and read from there when its batch is
    done again; it is removed once a later batch is committed.
    """

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.token = TokenCache(options["tokenUrl"], options.get("clientId", ""), options.get("clientSecret", "")) if "tokenUrl" in options else None
        self.wait_until = 0.0
        self.keep = Path(options["keep"]) if "keep" in options else None

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def fetch(self) -> str:
        box = {k: self.options[k] for k in ("lamin", "lomin", "lamax", "lomax") if k in self.options}
        request = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(box)}")
        if self.token:
            request.add_header("Authorization", f"Bearer {self.token.get()}")
        with urllib.request.urlopen(request, timeout=30) as reply:
            return reply.read().decode()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        from datetime import datetime, timezone
        now = time.time()
        if now < self.wait_until:
            return iter([]), start
        try:
            payload = self.fetch()
        except urllib.error.HTTPError:
            self.wait_until = now + 60
        except OSError:
            self.wait_until = now + 30
        else:
            at = datetime.now(timezone.utc)
            if self.keep:
                self.keep.mkdir(parents=True, exist_ok=True)
                part = self.keep / f"{start['polls']}.part"
                part.write_text(json.dumps([at.timestamp(), payload]))
                part.replace(self.keep / f"{start['polls']}.json")
            return iter([(at, payload)]), {"polls": start["polls"] + 1}
        return iter([]), start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The kept snapshots of a batch that is done again; without ``keep`` they can't be had again."""
        from datetime import datetime, timezone
        for number in range(start["polls"], end["polls"]) if self.keep else ():
            if (self.keep / f"{number}.json").exists():
                at, payload = json.loads((self.keep / f"{number}.json").read_text())
                yield datetime.fromtimestamp(at, timezone.utc), payload

    def commit(self, end: dict) -> None:
        for file in self.keep.glob("*.json") if self.keep else ():
            if int(file.stem) < end["polls"] - 1:
                file.unlink(missing_ok=True)


class SnapshotSource(DataSource):
    """``spark.readStream.format("snapshots")`` with url, the box, and tokenUrl, clientId, clientSecret, keep where needed."""

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(dict(self.options))


class RegionPartition(InputPartition):
    """One region's snapshot of a poll."""

    def __init__(self, region: str, at: int):
        self.region, self.at = region, at


#: Tokens of an executor's worker process, by service and client.
_tokens: dict[tuple[str, str], TokenCache] = {}


class RegionReader(DataSourceStreamReader):
    """A snapshot of every region at each trigger, a partition for each region, read on the executors.

    A poll is named by its time in milliseconds. Each snapshot is kept in the
    shared ``keep`` folder before it is handed on, and a poll that is done again is
    read from there. A region whose service fails gives no rows and is left alone
    for a pause; the others go on.
    """

    def __init__(self, options: dict[str, str]):
        for name in ("regions", "keep"):
            if name not in options:
                raise ValueError(f"region_snapshots needs the option {name}")
        self.options = options
        self.regions: dict[str, dict] = json.loads(options["regions"])

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        return {"at": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[RegionPartition]:
        return [RegionPartition(region, end["at"]) for region in sorted(self.regions)]

    def _folder(self) -> tuple:
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.options["keep"])

    def fetch(self, region: str) -> str:
        own = {**self.options, **self.regions[region]}
        box = {k: own[k] for k in ("lamin", "lomin", "lamax", "lomax") if k in own}
        request = urllib.request.Request(f"{own['url']}?{urllib.parse.urlencode(box)}")
        if "tokenUrl" in own:
            key = (own["tokenUrl"], own.get("clientId", ""))
            token = _tokens.setdefault(key, TokenCache(*key, own.get("clientSecret", "")))
            request.add_header("Authorization", f"Bearer {token.get()}")
        with urllib.request.urlopen(request, timeout=30) as reply:
            return reply.read().decode()

    def read(self, partition: RegionPartition) -> Iterator[tuple]:
        from datetime import datetime, timezone
        files, base = self._folder()
        place, kept = f"{base}/{partition.region}", f"{base}/{partition.region}/{partition.at}.json"

        def there(path: str) -> bool:
            return bool(files.get_file_info(path).type)

        def put(path: str, text: str) -> None:
            part = f"{path}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as out:
                out.write(text.encode())
            files.move(part, path)

        def got(path: str) -> str:
            with files.open_input_stream(path) as source:
                return source.read().decode()

        files.create_dir(place, recursive=True)
        if not there(kept):
            now = time.time()
            if there(f"{place}/wait") and now < float(got(f"{place}/wait")):
                return
            try:
                payload = self.fetch(partition.region)
            except (OSError, http.client.HTTPException) as error:
                pause = float(self.options.get("httpPause", 60)) if isinstance(error, urllib.error.HTTPError) else float(self.options.get("networkPause", 30))
                put(f"{place}/wait", str(now + pause))
                return
            put(kept, json.dumps([time.time(), payload]))
        at, payload = json.loads(got(kept))
        yield partition.region, datetime.fromtimestamp(at, timezone.utc), payload

    def commit(self, end: dict) -> None:
        """Drops the snapshots of polls before the one that is committed."""
        from pyarrow import fs
        files, base = self._folder()
        for region in self.regions:
            for info in files.get_file_info(fs.FileSelector(f"{base}/{region}", allow_not_found=True)):
                stem, _, kind = info.base_name.partition(".")
                if kind == "json" and stem.isdigit() and int(stem) < end["at"]:
                    files.delete_file(info.path)


class RegionSnapshotSource(DataSource):
    """``spark.readStream.format("region_snapshots")``: region, query_timestamp_utc, payload.

    Options: ``regions``, a JSON object of each region's own options (box, and url
    where it has one); ``url``, ``tokenUrl``, ``clientId``, ``clientSecret`` for all;
    ``keep``, a folder that the driver and all executors share; ``httpPause`` and
    ``networkPause`` in seconds.
    """

    @classmethod
    def name(cls) -> str:
        return "region_snapshots"

    def schema(self) -> str:
        return "region string, " + SCHEMA

    def streamReader(self, schema: StructType) -> RegionReader:
        return RegionReader({k: self.options[k] for k in ("regions", "url", "tokenUrl", "clientId", "clientSecret", "keep", "httpPause", "networkPause") if k in self.options})
