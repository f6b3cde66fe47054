"""A log of messages as segment files, and a streaming source of it with offsets.

A log has partitions; a message's offset is its place in its partition. Segments are files of JSON lines named by their first offset and their number of messages, so what the log holds is known from its listing. A stream's progress is one
offset for each partition, kept in the query's checkpoint; a batch reads the segments between two of them, each in a task of its own, and a batch that is run again reads the same. Columns are those of Kafka's source: key, value, partition, offset."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_NAME = re.compile(r"partition=(\d+)/(\d{20})-(\d+)\.jsonl$")
_SCHEMA = "key string, value string, partition int, offset long"


def segments(folder: str) -> dict[int, list[tuple[int, int, str]]]:
    """Of each partition the segments in order: first offset, messages, path."""
    store, path = fs.FileSystem.from_uri(folder)
    found: dict[int, list] = {}
    for f in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        if m := _NAME.search(f.path):
            found.setdefault(int(m[1]), []).append((int(m[2]), int(m[3]), f.path))
    return {p: sorted(s) for p, s in found.items()}


def ends(folder: str) -> dict[int, int]:
    """The offset after the last message of each partition."""
    return {p: s[-1][0] + s[-1][1] for p, s in segments(folder).items()}


def append(messages: DataFrame, folder: str, order: list[str]) -> None:
    """Append messages (key, value, partition) in ``order``, one segment for each partition that gets any. One writer at a time; a segment appears under its name when it is whole."""
    known = ends(folder)

    def run(batches: Iterator[pa.RecordBatch]):
        store, path = fs.FileSystem.from_uri(folder)
        open_: dict[int, list] = {}

        def closed(p: int) -> None:
            out, temporary, n = open_.pop(p)
            out.close()
            store.move(temporary, f"{path}/partition={p}/{known.get(p, 0):020d}-{n}.jsonl")

        for b in batches:
            for key, value, p in zip(*(b.column(c).to_pylist() for c in ("key", "value", "partition"))):
                if p not in open_:
                    for other in list(open_):  # rows are sorted by partition
                        closed(other)
                    store.create_dir(f"{path}/partition={p}", recursive=True)
                    temporary = f"{path}/partition={p}/_{known.get(p, 0):020d}.part"
                    open_[p] = [store.open_output_stream(temporary), temporary, 0]
                open_[p][0].write((json.dumps([key, value]) + "\n").encode())
                open_[p][2] += 1
        for p in list(open_):
            closed(p)
        yield from ()

    dealt = messages.repartition("partition").sortWithinPartitions("partition", *order).select("key", "value", F.col("partition").cast("int"))
    dealt.mapInArrow(run, "done int").collect()


class Stretch(InputPartition):
    """Messages of one segment: from one offset to before another."""

    def __init__(self, path: str, partition: int, base: int, start: int, end: int):
        self.path, self.partition, self.base, self.start, self.end = path, partition, base, start, end


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(p): n for p, n in sorted(ends(self.folder).items())}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for p, own in sorted(segments(self.folder).items()):
            first, last = int(start.get(str(p), 0)), int(end.get(str(p), 0))
            out += [Stretch(path, p, base, max(base, first), min(base + n, last)) for base, n, path in own if base < last and base + n > first]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        schema = pa.schema([("key", pa.string()), ("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64())])
        held, at, rest, data = [], partition.base, b"", b"\n"
        with store.open_input_stream(partition.path) as f:
            while data and at < partition.end:
                data = f.read(1 << 20)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    if partition.start <= at < partition.end:
                        held.append((*json.loads(line), partition.partition, at))
                    at += 1
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                    held = []

    def commit(self, end: dict) -> None:
        """Segments stay; their retention is the log's own."""


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment_log"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> Reader:
        return Reader(self.options["path"])


def from_log(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of a log: key, value, partition, offset."""
    spark.dataSource.register(SegmentLog)
    return spark.readStream.format("segment_log").option("path", folder).load()
