"""JSON documents written in ordered chunks: no document ever lies in one row or one task.

``ordered(pieces)`` deals pieces of text, each with its document's name and its
place, to partitions by range; ``write`` puts a chunk for each partition and
document into a folder of the write's own. Its commit names the chunks in order in
one manifest, which makes the documents visible at once; an abort drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "document string, text string"


def ordered(pieces: DataFrame, document: str, place: list[str], text: str, chunks: int | None = None) -> DataFrame:
    """document and text in the order of (document, place), in as many ranges as the session has shuffle partitions, or ``chunks``."""
    by = [document, *place]
    n = chunks or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartitionByRange(n, *by).sortWithinPartitions(*by).select(F.col(document).cast("string").alias("document"), F.col(text).alias("text"))


@dataclass
class Chunks(WriterCommitMessage):
    """The chunks that a task wrote: (document, partition, file, bytes)."""

    files: list[tuple[str, int, str, int]]


class ChunkWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Chunks:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(self.path)
        context = TaskContext.get()
        # every attempt has files of its own; only those of the one that is committed are named
        own = f"{base}/run={self.run}/{context.partitionId():08d}-{context.taskAttemptId()}"
        done: list[tuple[str, int, str, int]] = []
        out, name, size = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, context.partitionId(), place, size))

        for batch in iterator:
            for document, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if document != name:
                    close()
                    name, size, place = document, 0, f"{own}-{len(done):04d}.json"
                    files.create_dir(place.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(place)
                raw = (text or "").encode()
                out.write(raw)
                size += len(raw)
        close()
        return Chunks(done)

    def commit(self, messages: list[Chunks | None]) -> None:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[tuple[int, str, int]]] = {}
        for message in messages:
            for document, partition, file, size in message.files if message else ():
                found.setdefault(document, []).append((partition, file.removeprefix(f"{base}/"), size))
        listed = {d: [{"file": file, "bytes": size} for _, file, size in sorted(own)] for d, own in found.items()}
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/{self.run}.part") as out:
            out.write(json.dumps(listed).encode())
        files.move(f"{base}/{self.run}.part", f"{base}/manifest.json")

    def abort(self, messages: list[Chunks | None]) -> None:
        from pyarrow import fs
        files, base = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{base}/run={self.run}").type:
            files.delete_dir(f"{base}/run={self.run}")


class ChunkedDocuments(DataSource):
    """``df.write.format("ordered_chunks").mode("append").save(path)`` of (document, text) in order."""

    @classmethod
    def name(cls) -> str:
        return "ordered_chunks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"])


def save(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Writes documents from ``ordered`` pieces; those that ``path`` had are replaced when all are written."""
    spark.dataSource.register(ChunkedDocuments)
    rows.write.format("ordered_chunks").mode("append").save(path)


def manifest(path: str) -> dict[str, list[dict]]:
    """The chunks of each document of a folder, in order."""
    from pyarrow import fs
    files, base = fs.FileSystem.from_uri(path.rstrip("/"))
    with files.open_input_stream(f"{base}/manifest.json") as source:
        return json.loads(source.read())


def chunks(path: str, document: str) -> Iterator[bytes]:
    """One document's chunks, one after the other."""
    from pyarrow import fs
    files, base = fs.FileSystem.from_uri(path.rstrip("/"))
    for chunk in manifest(path)[document]:
        with files.open_input_stream(f"{base}/{chunk['file']}") as source:
            yield source.read()
