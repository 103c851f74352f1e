"""Streams: outbox relay, channels, keyed state, echo, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Everything there is since the checkpoint, then stop: a poll loop until idle, and resume after a restart."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def relay(outbox: DataFrame, checkpoint: str, sink: str):
    """Outbox to log, at least once; a batch's number names its folder, so a repeated batch overwrites itself and each row
    arrives once."""
    return drain(outbox, checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/batch={n}"))


def channel(stream: DataFrame, name: str) -> DataFrame:
    """Notifications of one channel."""
    return stream.where(F.col("channel") == name)


def echo(stream: DataFrame) -> DataFrame:
    return stream.select(F.concat(F.lit("you said: "), "value").alias("value"))


def sessions(events: DataFrame, gap: str, watermark: str) -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), "user_id").count()


def tumbling(events: DataFrame, width: str, watermark: str) -> DataFrame:
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def compare_and_set(stream: DataFrame) -> DataFrame:
    """Keyed value state with versions over a stream of (key, value, expected, seq): a write is accepted if ``expected`` is
    the version it finds (null: always), in the order of seq within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, version = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            ok = pd.isna(row.expected) or int(row.expected) == version
            if ok:
                value, version = row.value, version + 1
            out.append((key[0], int(row.seq), bool(ok), version, value))
        state.update((value, version))
        yield pd.DataFrame(out, columns=["key", "seq", "accepted", "version", "value"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, seq long, accepted boolean, version long, value string", "value string, version long", "append", "NoTimeout")


def on_append(stream: DataFrame, checkpoint: str, notify: Callable[[dict], None]):
    """A trigger: for each appended row, one call on the driver. For streams of notifications, not of data."""

    def each(df: DataFrame, _: int) -> None:
        for row in df.toLocalIterator():
            notify(row.asDict())

    return drain(stream, checkpoint, each)


def keyed_state(stream: DataFrame) -> DataFrame:
    """A keyed store over a stream of operations (key, kind, value, expected, seq): put (only if the version is as expected, where
    that is given), get, and delete, in the order of seq within a batch. Each operation's answer: the version and value that it
    left or found; version 0 and null without any."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, version = state.get if state.exists else (None, 0)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            ok = pd.isna(row.expected) or int(row.expected) == version
            if row.kind == "put" and ok:
                value, version = row.value, version + 1
            elif row.kind == "delete" and ok:
                value, version = None, 0
            out.append((key[0], int(row.seq), row.kind, bool(ok), int(version), value))
        if version:
            state.update((value, version))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "seq", "kind", "accepted", "version", "value"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, seq long, kind string, accepted boolean, version long, value string", "value string, version long", "append", "NoTimeout")
