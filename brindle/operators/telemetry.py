"""Spans and metrics as tables."""

from __future__ import annotations

from collections import Counter
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

BOUNDS = (5.0, 25.0, 100.0)


def with_parent_name(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name, (root) without one."""
    parents = spans.select(F.col("span_id").alias("__p"), F.col("trace_id").alias("__t"), F.col("name").alias("parent_name"))
    j = spans.join(parents, (spans["parent_id"] == F.col("__p")) & (spans["trace_id"] == F.col("__t")), "left")
    return j.select(*spans.columns, F.coalesce("parent_name", F.lit("(root)")).alias("parent_name"))


def orphan_spans(spans: DataFrame) -> DataFrame:
    return spans.where("parent_id IS NOT NULL").join(spans.select(F.col("span_id").alias("__p")), F.col("parent_id") == F.col("__p"), "left_anti")


def details(spans: DataFrame) -> DataFrame:
    """Attributes and events as rows (name, kind, key, value)."""
    a = spans.select("name", F.lit("attribute").alias("kind"), F.explode(F.map_entries("attributes")).alias("e")).select("name", "kind", "e.key", "e.value")
    e = spans.select("name", F.lit("event").alias("kind"), F.explode("events").alias("key"), F.lit(None).cast("string").alias("value"))
    return a.unionAll(e)


def bucket(value: Column, bounds=BOUNDS) -> Column:
    """Place of the first bound that the value does not pass; upper bounds belong to their bucket, the last place is overflow."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], F.lit(i)).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, keys=(), bounds=BOUNDS) -> DataFrame:
    """count, sum, and buckets as an array of counts."""
    b = bucket(F.col(value), bounds)
    counts = [F.count_if(b == i) for i in range(len(bounds) + 1)]
    return df.groupBy(*keys).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.array(*counts).alias("buckets"))


def counter(df: DataFrame, value: str, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"))


def gauge(df: DataFrame, value: str, at: str, keys) -> DataFrame:
    """The last observed value."""
    return df.groupBy(*keys).agg(F.max_by(value, at).alias("last"))


class Recorder:
    """Spans of the driver's own work, kept in memory: ``with recorder.span('name'):``, nested as they are opened."""

    SCHEMA = "span_id bigint, parent_id bigint, trace_id bigint, name string, status string, attributes map<string,string>, events array<string>"

    def __init__(self, spark):
        self.spark, self.rows, self.open = spark, [], []

    @contextmanager
    def span(self, name: str, **attributes: str):
        me = {"span_id": len(self.rows) + 1, "parent_id": self.open[-1]["span_id"] if self.open else None, "name": name, "status": "Ok", "attributes": attributes, "events": []}
        me["trace_id"] = self.open[-1]["trace_id"] if self.open else me["span_id"]
        self.rows.append(me)
        self.open.append(me)
        try:
            yield me["events"]
        except Exception as e:
            me["status"] = "Error"
            me["events"].append(str(e))
            raise
        finally:
            self.open.pop()

    def spans(self) -> DataFrame:
        names = [x.split()[0] for x in self.SCHEMA.split(", ")]
        return self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], self.SCHEMA)


class Calls:
    """Counts calls, and runs a hook around each: ``calls.around(function)``."""

    def __init__(self, hook=None):
        self.counts: Counter[str] = Counter()
        self.hook = hook

    def around(self, function):
        @wraps(function)
        def call(*args, **kwargs):
            self.counts[function.__name__] += 1
            if self.hook is None:
                return function(*args, **kwargs)
            return self.hook(function.__name__, lambda: function(*args, **kwargs))

        return call


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The rows, and metrics of them that are there once they have been computed, in the same pass: ``observation.get``."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen
