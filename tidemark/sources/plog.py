"""A partitioned log as a Spark data source, and the pass-through to Kafka.

The "plog" source reads a folder with one subfolder or file per partition: {path}/{topic}/{part}.jsonl,
a JSON object with k and v (strings or null) and ts (microseconds) on each line; a record's offset is
its line number. Appending lines feeds the stream. It is one input partition for each log
partition, and plans no batch while the file named by `pauseFile` exists, which is how admission control throttles it.

`startingOffsets` is earliest, latest or a JSON object of offsets by "topic/part", and counts for a new query only.
`maxOffsetsPerPartition` caps what a batch takes of each partition. An available-now query ends at the end that its
first batch was planned with, so a capped one takes one cap's worth: the runtime starts it anew until nothing is left.
A capped query needs `positionFile`, where the end of the last planned batch is kept: Spark doesn't tell a restarted
reader where it is before it asks for the next end.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import LOG_SCHEMA


class Slice(InputPartition):
    def __init__(self, topic: str, part: int, start: int, end: int):
        self.topic, self.part, self.start, self.end = topic, part, start, end


class _Log:
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path = options["path"]
        self.topics = [t.strip() for t in options.get("subscribe", "").split(",") if t.strip()]
        self.most = int(options["maxoffsetsperpartition"]) if "maxoffsetsperpartition" in options else None
        self.pause, self.position, self.begin = options.get("pausefile"), options.get("positionfile"), options.get("startingoffsets", "earliest")
        if self.most is not None and self.position is None:
            raise ValueError("maxOffsetsPerPartition needs positionFile")

    def partitions(self) -> dict[str, int]:
        """The records there are, by "topic/part"; a line that isn't ended yet doesn't count."""
        out = {}
        for topic in self.topics or sorted(os.listdir(self.path)):
            folder = os.path.join(self.path, topic)
            for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
                if name.endswith(".jsonl"):
                    with open(os.path.join(folder, name), "rb") as f:
                        out[f"{topic}/{int(name[:-6])}"] = sum(block.count(b"\n") for block in iter(lambda: f.read(1 << 20), b""))
        return out

    def read(self, piece: Slice) -> Iterator[tuple]:
        with open(os.path.join(self.path, piece.topic, f"{piece.part}.jsonl"), encoding="utf-8") as f:
            for off, line in enumerate(f):
                if off >= piece.end:
                    break
                if off >= piece.start:
                    x = json.loads(line)
                    ts = datetime.datetime.fromtimestamp(x.get("ts", 0) / 1e6, datetime.UTC)
                    yield (piece.topic, piece.part, off, x.get("k"), x.get("v"), ts)


def _slices(start: dict[str, int], end: dict[str, int]) -> list[Slice]:
    return [Slice(tp.rpartition("/")[0], int(tp.rpartition("/")[2]), start.get(tp, 0), n) for tp, n in sorted(end.items()) if n > start.get(tp, 0)]


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.log = _Log(options)

    def partitions(self) -> list[Slice]:
        return _slices({}, self.log.partitions())

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.log.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.log, self.last = _Log(options), None
        if self.log.position and os.path.exists(self.log.position):
            with open(self.log.position, encoding="utf-8") as f:
                self.last = json.load(f)

    def initialOffset(self) -> dict:
        if self.log.begin == "latest":
            return self.log.partitions()
        return {} if self.log.begin == "earliest" else json.loads(self.log.begin)

    def latestOffset(self) -> dict:
        last = self.initialOffset() if self.last is None else self.last
        if not (self.log.pause and os.path.exists(self.log.pause)):
            # New partitions appear of themselves; each moves on by the cap at most.
            there = self.log.partitions()
            last = last | {tp: n if self.log.most is None else max(last.get(tp, 0), min(n, last.get(tp, 0) + self.log.most)) for tp, n in there.items()}
        return last

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.last = end
        if self.log.position:
            os.makedirs(os.path.dirname(self.log.position) or ".", exist_ok=True)
            with open(f"{self.log.position}.new", "w", encoding="utf-8") as f:
                json.dump(end, f)
            os.replace(f"{self.log.position}.new", self.log.position)
        return _slices(start, end)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint is the authority on progress."""


class PlogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plog"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def read_plog(spark: SparkSession, path: str, stream: bool = True, **options: str) -> DataFrame:
    spark.dataSource.register(PlogSource)
    reader = (spark.readStream if stream else spark.read).format("plog").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_kafka(spark: SparkSession, servers: str, topics: tuple[str, ...], stream: bool = True, **options: str) -> DataFrame:
    """The same columns from Kafka, where its connector is on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().selectExpr("topic", "partition AS part", "offset AS off", "CAST(key AS STRING) AS k", "CAST(value AS STRING) AS v", "timestamp AS ts")


def append(path: str, topic: str, part: int, records: list[tuple[str | None, str | None]]) -> None:
    """Feeds a log, for tests and small tools."""
    os.makedirs(os.path.join(path, topic), exist_ok=True)
    with open(os.path.join(path, topic, f"{part}.jsonl"), "a", encoding="utf-8") as f:
        for k, v in records:
            f.write(json.dumps({"k": k, "v": v, "ts": 0}) + "\n")
