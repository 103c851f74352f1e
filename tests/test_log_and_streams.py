"""The partitioned log, the key-value store and the streams, on the fixtures' rows and results."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.sources import logstore, tables
from brindle.streaming import relays


@pytest.fixture()
def topic(spark, tmp_path):
    return lambda name, partitions: logstore.Topic(spark, str(tmp_path / name), partitions).reset()


def records(spark, pairs):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, seq int")


def memory(stream, name, mode):
    """All that a stream makes of what there is."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_keys_stay_on_one_partition(spark, topic):
    t = topic("orders", 3)
    first = t.produce(records(spark, [("a", "1"), ("b", "2"), ("a", "3"), ("c", "4"), ("b", "5"), ("a", "6")])).collect()
    assert sorted(r.value for r in first) == list("123456")
    more = t.produce(records(spark, [(None, str(i)) for i in range(7, 11)]), batch=1).collect()
    assert sorted(r.value for r in more) == ["10", "7", "8", "9"] and {r.partition for r in more} == {1}
    assert all(r.one_home for r in logstore.homes(t.read().where("key IS NOT NULL")).collect())
    assert [r.value for r in t.read().where("key = 'a'").orderBy("offset").collect()] == ["1", "3", "6"]
    for r in t.bounds().collect():  # offsets are dense
        assert sorted(x.offset for x in t.read().where(F.col("partition") == r.partition).collect()) == list(range(r.first, r.next))


def test_replay(spark, topic):
    t = topic("log", 1)
    t.produce(records(spark, [(None, c) for c in "ABCDEFGHIJ"]))
    summary = lambda start: [tuple(r)[1:] for r in logstore.replay_summary(t.read(start)).collect()]
    assert summary("earliest") == [(0, 9, "ABCDEFGHIJ")]
    assert summary(6) == summary({0: 6}) == [(6, 9, "GHIJ")]
    assert summary("latest") == []
    assert [tuple(r) for r in t.bounds().collect()] == [(0, 0, 10)]
    commits = spark.createDataFrame([(0, 4)], "partition int, committed long")
    assert [tuple(r) for r in logstore.lag(t.bounds(), commits).collect()] == [(0, 4, 10, 6)]
    assert topic("nothing", 2).read().count() == 0


def test_transactions(spark, topic):
    t = topic("tx", 1)
    t.produce(records(spark, [(None, "committed-1"), (None, "committed-2")]), txn="one")
    t.end("one", True)
    t.produce(records(spark, [(None, "aborted-1"), (None, "aborted-2")]), txn="two")
    t.end("two", False)
    t.produce(records(spark, [(None, "committed-3")]), txn="three")
    assert t.read().count() == 2 and t.read(committed=False).count() == 5  # the third is open
    t.end("three", True)
    got = t.read().orderBy("offset").collect()
    assert [r.value for r in got] == ["committed-1", "committed-2", "committed-3"]
    assert [r.offset for r in got] == [0, 1, 6]


def test_state_store(spark):
    items = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    s = tables.StateStore.of(spark).save(items(("greeting", "hello"), ("a", "1"))).save(items(("greeting", "goodbye")))
    got = {r.key: (r.value, r.version) for r in s.get(keys("greeting", "a", "missing")).collect()}
    assert got == {"greeting": ("goodbye", 2), "a": ("1", 1), "missing": ("", 0)}
    assert {r.key for r in s.delete(keys("a")).rows.collect()} == {"greeting"}


def test_relay_resumes(spark, tmp_path):
    outbox, sink = str(tmp_path / "outbox"), str(tmp_path / "sink")
    write = lambda ids: spark.createDataFrame([(i, f"order {i}") for i in ids], "id int, payload string").coalesce(1).write.mode("append").parquet(outbox)
    stream = lambda: spark.readStream.schema("id int, payload string").parquet(outbox)
    for ids in ([1, 2], [3, 4], []):  # the last run finds nothing new
        if ids:
            write(ids)
        relays.relay(stream(), str(tmp_path / "checkpoint"), sink)
    assert Counter(r.id for r in spark.read.parquet(sink).collect()) == Counter([1, 2, 3, 4])


def test_channel_and_echo(spark, tmp_path):
    spark.createDataFrame([("orders", "one"), ("other", "two")], "channel string, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, value string").parquet(str(tmp_path / "in"))
    got = memory(relays.echo(relays.channel(stream, "orders")), "echoed", "append")
    assert [r.value for r in got.collect()] == ["you said: one"]


def test_topic_as_stream(spark, topic, tmp_path):
    t, seen = topic("events", 2), []
    take = lambda df, n: seen.extend(r.value for r in df.where("marker IS NULL").collect())
    for part in ("ab", "cd"):
        t.produce(records(spark, [(c, c) for c in part]))
        relays.drain(t.stream(), str(tmp_path / "group"), take)
    assert sorted(seen) == list("abcd")


def test_compare_and_set(spark, tmp_path):
    folder = str(tmp_path / "writes")
    rows = [("k", "hello", None, 1), ("k", "goodbye", 1, 2), ("k", "stale", 1, 3), ("other", "x", 0, 4), ("other", None, None, 5)]
    spark.createDataFrame(rows, "key string, value string, expected long, seq long").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("key string, value string, expected long, seq long").parquet(folder)
    got = {r.seq: (r.accepted, r.version, r.value) for r in memory(relays.compare_and_set(stream), "cas", "append").collect()}
    assert got == {1: (True, 1, "hello"), 2: (True, 2, "goodbye"), 3: (False, 2, "goodbye"), 4: (True, 1, "x"), 5: (True, 2, None)}


def test_windows(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(1, "view", 2.0, "2026-01-01 00:00:10"), (1, "view", 3.0, "2026-01-01 00:00:50"), (2, "view", 4.0, "2026-01-01 00:01:05"), (1, "buy", 1.0, "2026-01-01 01:00:00")]
    spark.createDataFrame(rows, "user_id long, event_type string, value double, t string").select("user_id", "event_type", "value", F.to_timestamp("t").alias("ts")).write.parquet(folder)
    stream = spark.readStream.schema("user_id long, event_type string, value double, ts timestamp").parquet(folder)
    wide = memory(relays.tumbling(stream, "1 minute", "1 hour"), "tumbling", "complete")
    assert sorted((r.event_type, r.n, r.total) for r in wide.collect()) == [("buy", 1, 1.0), ("view", 1, 4.0), ("view", 2, 5.0)]
    visits = memory(relays.sessions(stream, "5 minutes", "1 hour"), "visits", "complete")
    assert sorted((r.user_id, r["count"]) for r in visits.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_second_group_reads_all(spark, topic, tmp_path):
    t = topic("events", 2)
    t.produce(records(spark, [(c, c) for c in "abcd"]))
    for group in ("one", "two"):
        seen = []
        relays.drain(t.stream(), str(tmp_path / group), lambda df, n: seen.extend(r.value for r in df.where("marker IS NULL").collect()))
        assert sorted(seen) == list("abcd")


def test_trigger(spark, tmp_path):
    folder, seen = str(tmp_path / "rows"), []
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i,) for i in ids], "id int").write.mode("append").parquet(folder)
        relays.on_append(spark.readStream.schema("id int").parquet(folder), str(tmp_path / "checkpoint"), lambda row: seen.append(row["id"]))
    assert sorted(seen) == [1, 2, 3]


def test_keyed_state(spark, tmp_path):
    folder = str(tmp_path / "operations")
    rows = [("a", "put", "x", None, 1), ("a", "put", "y", 0, 2), ("a", "put", "z", 1, 3), ("a", "get", None, None, 4), ("a", "delete", None, None, 5), ("a", "get", None, None, 6), ("b", "get", None, None, 7)]
    spark.createDataFrame(rows, "key string, kind string, value string, expected long, seq long").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("key string, kind string, value string, expected long, seq long").parquet(folder)
    got = {r.seq: (r.accepted, r.version, r.value) for r in memory(relays.keyed_state(stream), "store", "append").collect()}
    assert got == {1: (True, 1, "x"), 2: (False, 1, "x"), 3: (True, 2, "z"), 4: (True, 2, "z"), 5: (True, 0, None), 6: (True, 0, None), 7: (True, 0, None)}


def test_stores_are_alike(spark, tmp_path):
    items = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")

    def story(s):
        s = s.save(items(("a", "1"), ("b", "2"))).save(items(("a", "3"))).delete(keys.where("key = 'b'"))
        return sorted(tuple(r) for r in s.get(keys).collect())

    assert story(tables.StateStore.of(spark)) == story(tables.FolderStore(spark, str(tmp_path / "store"))) == [("a", "3", 2), ("b", "", 0), ("c", "", 0)]
