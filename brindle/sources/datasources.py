"""Data sources written in Python: a JSON array over many files, and channels of notifications.

``json_array`` writes a table as one JSON array, no row of which meets another: each task writes its rows as a file, and the commit
adds files of brackets and commas between them, so that a folder's files in order of their names are the array. What tasks that
failed have left is removed by the commit.

``channel`` reads notifications, numbered files of JSON lines that ``notify`` adds to a folder, as a stream of (seq, channel,
payload). Its offset is the number of files read, so a stream with a checkpoint goes on where it was. Folders are reached through
pyarrow's file systems (local and shared paths, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from brindle.session import ship


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:/") else f"file://{folder}")


@dataclass
class Part(WriterCommitMessage):
    """A task's file, and whether it has rows."""

    name: str
    rows: int


class JsonArrayWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        where, path = _open(self.folder)
        where.create_dir(path, recursive=True)
        name, rows = f"part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", 0
        with where.open_output_stream(f"{path}/{name}") as out:
            for row in iterator:
                out.write((b",\n" if rows else b"") + row[0].encode())
                rows += 1
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        where, path = _open(self.folder)
        where.create_dir(path, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.name)
        kept = {m.name for m in parts if m.rows}
        for f in where.get_file_info(fs.FileSelector(path)):
            if f.type == fs.FileType.File and f.base_name not in kept:
                where.delete_file(f.path)

        def put(name: str, text: bytes) -> None:
            with where.open_output_stream(f"{path}/{name}") as out:
                out.write(text)

        put("a-begin", b"[")
        for m in [m for m in parts if m.rows][1:]:
            # its name sorts just before that of its part
            put(m.name.rpartition("-")[0], b",\n")
        put("z-end", b"]\n")

    def abort(self, messages: list[Part | None]) -> None:
        where, path = _open(self.folder)
        for m in messages:
            if m is not None:
                where.delete_file(f"{path}/{m.name}")


class JsonArray(DataSource):
    """Format ``json_array``: option path, rows of one text column."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> JsonArrayWriter:
        if not overwrite and _exists(self.options["path"]):
            raise ValueError(f"{self.options['path']} has files already")
        return JsonArrayWriter(self.options["path"])


def _exists(folder: str) -> bool:
    where, path = _open(folder)
    return where.get_file_info(path).type != fs.FileType.NotFound and bool(where.get_file_info(fs.FileSelector(path)))


@dataclass
class Notices(InputPartition):
    names: tuple[str, ...]


class ChannelReader(DataSourceStreamReader):
    def __init__(self, folder: str, channel: str | None):
        self.folder, self.channel = folder, channel

    def _names(self) -> list[str]:
        where, path = _open(self.folder)
        if where.get_file_info(path).type == fs.FileType.NotFound:
            return []
        return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".jsonl"))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._names())}

    def partitions(self, start: dict, end: dict) -> list[Notices]:
        names = self._names()[start["files"] : end["files"]]
        return [Notices(tuple(names[i : i + 64])) for i in range(0, len(names), 64)]

    def read(self, partition: Notices) -> Iterator[tuple]:
        where, path = _open(self.folder)
        for name in partition.names:
            with where.open_input_stream(f"{path}/{name}") as lines:
                for i, line in enumerate(lines.read().decode().splitlines()):
                    x = json.loads(line)
                    if self.channel in (None, x["channel"]):
                        yield int(name.split(".")[0]), i, x["channel"], x["payload"]

    def commit(self, end: dict) -> None:
        pass


class Channel(DataSource):
    """Format ``channel``: options path, and channel to read only one."""

    @classmethod
    def name(cls) -> str:
        return "channel"

    def schema(self) -> str:
        return "seq bigint, place int, channel string, payload string"

    def streamReader(self, schema: StructType) -> ChannelReader:
        return ChannelReader(self.options["path"], self.options.get("channel"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(JsonArray)
    spark.dataSource.register(Channel)


def export_json_array(df: DataFrame, folder: str) -> None:
    """The rows as one JSON array in the folder's files, in no order; null fields are written."""
    register(df.sparkSession)
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.format("json_array").mode("overwrite").save(folder)


def read_json_array(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The rows of such a folder: its lines, less the commas that end them."""
    lines = spark.read.text(f"{folder.rstrip('/')}/part-*").select(F.rtrim("value", F.lit(",")).alias("value")).where("value <> ''")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def notify(folder: str, notices: list[tuple[str, str]]) -> int:
    """Add notices (channel, payload) to a folder as its next file; returned is its number. One writer is assumed: the file appears
    whole, under a name that no other had."""
    where, path = _open(folder)
    where.create_dir(path, recursive=True)
    seq = 1 + max((int(f.base_name.split(".")[0]) for f in where.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".jsonl")), default=0)
    with where.open_output_stream(f"{path}/{seq:012d}.tmp") as out:
        for channel, payload in notices:
            out.write(json.dumps({"channel": channel, "payload": payload}).encode() + b"\n")
    where.move(f"{path}/{seq:012d}.tmp", f"{path}/{seq:012d}.jsonl")
    return seq


def listen(spark: SparkSession, folder: str, channel: str | None = None) -> DataFrame:
    """The stream of a folder's notices."""
    register(spark)
    reader = spark.readStream.format("channel").option("path", folder)
    return (reader.option("channel", channel) if channel else reader).load()
