"""Keyed state by a stateful processor: stores of entries with versions, transactions over several keys, and expiry.

Operations are (store, seq, txn, kind, key, value, expected, ttl_ms, ts). A store is one group of the stream: its entries are map
state, its revision value state, so a transaction may span any keys of a store. State is kept by the RocksDB provider and comes back
from the checkpoint after a restart.

kind is put, delete or get; expected, where given, must be the version found (0: none), or nothing of the operation's
transaction is applied; operations without a txn stand alone. An entry that is put with ttl_ms is gone for operations whose ts is
that much later, and is removed, with a row of kind ``expired``, when the watermark passes its time. Operations of a batch are applied in
the order of seq; a transaction's must be in one batch and follow each other. A null ts never expires anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from brindle.session import ship

ANSWER = "store string, seq long, txn string, kind string, key string, accepted boolean, version long, value string, revision long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ENTRY = StructType([StructField("value", StringType()), StructField("version", LongType()), StructField("expires", LongType())])


class Store(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.revision = handle.getValueState("revision", StructType([StructField("n", LongType())]))
        self.entries = handle.getMapState("entries", StructType([StructField("key", StringType())]), _ENTRY)

    def _get(self, key: str, now: int | None) -> tuple[str | None, int]:
        """Value and version of an entry that has not expired."""
        if not self.entries.containsKey((key,)):
            return None, 0
        value, version, expires = self.entries.getValue((key,))
        return (None, 0) if expires is not None and now is not None and now >= expires else (value, version)

    def _apply(self, op, now: int | None) -> tuple[int, str | None]:
        value, version = self._get(op.key, now)
        if op.kind == "put":
            expires = None if pd.isna(op.ttl_ms) or now is None else now + int(op.ttl_ms)
            self.entries.updateValue((op.key,), (op.value, version + 1, expires))
            if expires is not None:
                self.handle.registerTimer(expires)
            return version + 1, op.value
        if op.kind == "delete":
            if self.entries.containsKey((op.key,)):
                self.entries.removeKey((op.key,))
            return 0, None
        return version, value

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        revision = self.revision.get()[0] if self.revision.exists() else 0
        out = []
        ops = list(pd.concat(list(rows)).sort_values("seq").itertuples(index=False))
        for _, group in groupby(enumerate(ops), lambda x: (x[1].txn, None) if isinstance(x[1].txn, str) else (None, x[0])):
            group = [op for _, op in group]
            times = [None if pd.isna(op.ts) else int(op.ts.timestamp() * 1000) for op in group]
            # later operations of a transaction see what earlier ones leave
            seen: dict[str, int] = {}
            good = True
            for op, now in zip(group, times):
                found = seen.get(op.key, self._get(op.key, now)[1])
                good = good and (pd.isna(op.expected) or int(op.expected) == found)
                seen[op.key] = found + 1 if op.kind == "put" else 0 if op.kind == "delete" else found
            if good and any(op.kind != "get" for op in group):
                revision += 1
            for op, now in zip(group, times):
                value, version = self._get(op.key, now)
                if good:
                    version, value = self._apply(op, now)
                out.append((key[0], int(op.seq), op.txn if isinstance(op.txn, str) else None, op.kind, op.key, good, version, value, revision))
        self.revision.update((revision,))
        yield pd.DataFrame(out, columns=["store", "seq", "txn", "kind", "key", "accepted", "version", "value", "revision"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [(k[0], e) for k, e in self.entries.iterator() if e[2] is not None and e[2] <= now]
        for k, _ in gone:
            self.entries.removeKey((k,))
        revision = self.revision.get()[0] if self.revision.exists() else 0
        yield pd.DataFrame([(key[0], None, None, "expired", k, True, int(e[1]), e[0], revision) for k, e in gone], columns=["store", "seq", "txn", "kind", "key", "accepted", "version", "value", "revision"]).astype({"seq": "Int64", "version": "int64", "revision": "int64", "accepted": "bool"})

    def close(self) -> None:
        pass


def keyed_store(operations: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """The answer to each operation of a stream, and a row for each entry that expires."""
    spark = operations.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return operations.withWatermark("ts", watermark).groupBy("store").transformWithStateInPandas(Store(), ANSWER, "Update", "EventTime")
