"""An append-only partitioned log over Parquet folders: the engine's stand-in for a broker.

Records are (key, value, headers, partition, offset, timestamp, txn). A topic is a folder of batches; a batch is one atomic
write. Offsets are dense a partition; transaction markers take one, so committed reads show gaps. One writer a topic."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "key string, value string, headers map<string,string>, partition int, offset bigint, timestamp timestamp, txn string, marker string"


class Topic:
    def __init__(self, spark: SparkSession, folder: str, partitions: int):
        self.spark, self.folder, self.partitions = spark, folder.rstrip("/"), partitions

    def _path(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def reset(self) -> Topic:
        p, fs = self._path()
        fs.delete(p, True)
        self.spark.createDataFrame([], SCHEMA).write.parquet(self.folder)
        return self

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def _next(self) -> DataFrame:
        return self._raw().groupBy(F.col("partition").alias("__p")).agg((F.max("offset") + 1).alias("__next"))

    def produce(self, rows: DataFrame, txn: str | None = None, batch: int = 0) -> DataFrame:
        """Append rows (key, value, optional headers; ``seq`` orders them). Same key, same partition; a batch of keyless rows
        sticks to one. Returned: each row's partition and offset."""
        headers = F.col("headers") if "headers" in rows.columns else F.lit(None).cast("map<string,string>")
        home = F.when(F.col("key").isNull(), F.lit(batch % self.partitions)).otherwise(F.pmod(F.xxhash64("key"), F.lit(self.partitions))).cast("int")
        r = rows.select("key", "value", headers.alias("headers"), "seq", home.alias("partition"))
        n = F.row_number().over(Window.partitionBy("partition").orderBy("seq")) - 1
        placed = r.withColumn("n", n).join(F.broadcast(self._next()), F.col("partition") == F.col("__p"), "left")  # a row a partition
        out = placed.select("key", "value", "headers", "partition", (F.coalesce("__next", F.lit(0)) + F.col("n")).cast("long").alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(txn).cast("string").alias("txn"), F.lit(None).cast("string").alias("marker"))
        before = {x["__p"]: x["__next"] for x in self._next().collect()}
        out.write.mode("append").parquet(self.folder)
        written = self._raw()
        known = F.coalesce(*[F.when(F.col("partition") == p, F.lit(n)) for p, n in before.items()], F.lit(0))
        return written.where(F.col("offset") >= known).select("key", "value", "partition", "offset")

    def end(self, txn: str, commit: bool) -> None:
        """A marker on each partition that the transaction wrote to."""
        mine = self._raw().where(F.col("txn") == txn).select("partition").distinct()
        m = mine.join(self._next(), F.col("partition") == F.col("__p"))
        m.select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("map<string,string>").alias("headers"), "partition", F.col("__next").alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(txn).alias("txn"), F.lit("commit" if commit else "abort").alias("marker")).write.mode("append").parquet(self.folder)

    def read(self, start: dict[int, int] | int | str = "earliest", committed: bool = True) -> DataFrame:
        """Records from the start, an offset, an offset a partition, or the end ('latest': none). committed leaves out what
        open and aborted transactions wrote."""
        raw = self._raw()
        r = raw.where("marker IS NULL")
        if committed:
            done = raw.where("marker = 'commit'").select(F.col("txn").alias("__t")).distinct()
            r = r.join(done, F.col("txn") == F.col("__t"), "left").where("txn IS NULL OR __t IS NOT NULL").drop("__t")
        if start == "latest":
            r = r.limit(0)
        elif isinstance(start, int):
            r = r.where(F.col("offset") >= start)
        elif isinstance(start, dict):
            known = F.coalesce(*[F.when(F.col("partition") == p, F.lit(o)) for p, o in start.items()], F.lit(0))
            r = r.where(F.col("offset") >= known)
        return r.select("key", "value", "headers", "partition", "offset", "timestamp")

    def bounds(self) -> DataFrame:
        return self._raw().groupBy("partition").agg(F.min("offset").alias("first"), (F.max("offset") + 1).alias("next"))

    def stream(self) -> DataFrame:
        """As a stream: the checkpoint is the group's committed offsets."""
        return self.spark.readStream.schema(SCHEMA).parquet(self.folder)


def lag(ends: DataFrame, commits: DataFrame) -> DataFrame:
    """partition, committed, end, lag."""
    c = commits.select(F.col("partition").alias("__p"), F.col("committed").alias("__c"))
    j = ends.select("partition", F.col("next").alias("end")).join(c, F.col("partition") == F.col("__p"), "left")
    return j.select("partition", F.coalesce("__c", F.lit(0)).alias("committed"), "end", (F.col("end") - F.coalesce("__c", F.lit(0))).alias("lag"))


def homes(records: DataFrame) -> DataFrame:
    """Each key's partition, and whether it has but one."""
    return records.groupBy("key").agg(F.max_by("partition", "offset").alias("partition"), (F.count_distinct("partition") == 1).alias("one_home"))


def replay_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), "").alias("values"))


def replay_digest(records: DataFrame) -> DataFrame:
    """(partition, first, last, digest): each partition replayed in the order of its offsets, digest being the md5 of its values one
    after the other. A partition is one task's, as its order is, but none of its values are kept."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for partition, offset, value in zip(b.column("partition").to_pylist(), b.column("offset").to_pylist(), b.column("value").to_pylist()):
                if now is None or partition != now[0]:
                    if now is not None:
                        out.append((*now[:3], now[3].hexdigest()))
                    now = [partition, offset, offset, hashlib.md5()]
                now[2] = offset
                now[3].update((value or "").encode())
        if now is not None:
            out.append((*now[:3], now[3].hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[3] for x in out], pa.string())], names=["partition", "first", "last", "digest"])

    rows = records.select(F.col("partition").cast("long").alias("partition"), F.col("offset").cast("long").alias("offset"), F.col("value").cast("string").alias("value"))
    return rows.repartition("partition").sortWithinPartitions("partition", "offset").mapInArrow(replay, "partition bigint, first bigint, last bigint, digest string")


ENVELOPE = "id string, source string, specversion string, type string, datacontenttype string, topic string, pubsubname string, data string"


def cloud_event(value) -> object:
    """The envelope's eight known fields."""
    return F.from_json(value, ENVELOPE)
