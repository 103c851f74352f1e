"""Write algebra as pure functions: (old rows, change) -> (new rows, returned rows). Nothing is updated in place; a result is
written by one atomic overwrite or swap of a folder. Row locks have no counterpart: a single writer is assumed."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import intervals
from brindle.session import durable

Keys = Sequence[str]


def _on(a: DataFrame, b: DataFrame, keys: Keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & (a[k] == b[k])
    return cond


def first_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order (end it with a unique column)."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def first_rows(df: DataFrame, keys: Keys, order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order; before they are exchanged, each task leaves no more than those."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def once_per_key(change: DataFrame, keys: Keys, command: str) -> DataFrame:
    """The rows of a change; an error when it runs if a key occurs twice in it, as what the row becomes would depend on their
    order. Null keys equal none. The check partitions by the key, as the join that follows does."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    twice = known & (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1)
    checked = F.when(twice, F.raise_error(F.lit(f"{command} command cannot affect row a second time")).cast("boolean")).otherwise(F.lit(True))
    return change.withColumn("__once", checked).where("__once").drop("__once")


def insert_returning(old: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return old.unionByName(rows), rows


def numbered(rows: DataFrame, name: str, order: Sequence[Column], start: int = 1) -> DataFrame:
    """The rows with whole numbers from ``start`` in the given order, without a task that sees them all: they are sorted in ranges
    and written, each range counts its own, and what the ranges before it hold is one row a range."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order) if rows.columns else rows
    place = durable(ranged.withColumn("__id", F.monotonically_increasing_id()))
    # the number of a range is in the upper bits, that of a row within it in the lower 33
    part = F.shiftright("__id", 33)
    counts = place.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    out = place.withColumn("__p", part).join(F.broadcast(before), F.col("__p") == F.col("__part"))  # a row a range
    return out.withColumn(name, (F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + start).cast("long")).drop("__id", "__p", "__part", "__before")


def with_identity(rows: DataFrame, name: str, order: Sequence[Column], start: int = 1) -> DataFrame:
    """Identity values from ``start``."""
    return numbered(rows, name, order, start)


def upsert(old: DataFrame, new: DataFrame, keys: Keys, matched: dict[str, Callable[[Callable, Callable], Column]]) -> tuple[DataFrame, DataFrame]:
    """INSERT ... ON CONFLICT DO UPDATE: ``matched`` maps a column to a function of (old column, new column) accessors.
    Returned: the inserted and updated rows. An error if the new rows have a key twice."""
    new = once_per_key(new, keys, "ON CONFLICT DO UPDATE")
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o__"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns], F.lit(True).alias("n__"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    get_o, get_n = (lambda c: F.col(f"o_{c}")), (lambda c: F.col(f"n_{c}"))
    both = F.col("o__").isNotNull() & F.col("n__").isNotNull()
    cols = [F.when(both, matched[c](get_o, get_n) if c in matched else get_o(c)).otherwise(F.coalesce(get_o(c), get_n(c))).alias(c) for c in old.columns]
    joined = o.join(n, cond, "full").select(*cols, F.col("n__").isNotNull().alias("__touched"))
    return joined.drop("__touched"), joined.where("__touched").drop("__touched")


def get_or_create(old: DataFrame, wanted: DataFrame, key: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO SELECT: existing rows are returned, missing keys get the next ids in key order."""
    w = wanted.select(key).distinct()
    have = w.join(old, key, "left_semi").join(old, key)
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    fresh = numbered(w.join(old, key, "left_anti"), "__n", [F.col(key)]).crossJoin(F.broadcast(top))  # one row
    fresh = fresh.select(*[(F.col("__top") + F.col("__n")).cast("long").alias(c) if c == id_col else F.col(key) if c == key else F.lit(None).alias(c) for c in old.columns])
    return old.unionByName(fresh), have.select(*old.columns).unionByName(fresh)


def update_returning(old: DataFrame, where: Column, sets: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """New rows, and the updated ones with before and after images: columns old_x and new_x."""
    hit = F.coalesce(where, F.lit(False))
    images = old.select("*", hit.alias("__hit"), *[v.alias(f"__new_{c}") for c, v in sets.items()])
    new = images.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in old.columns])
    returned = images.where("__hit").select(*[F.col(c).alias(f"old_{c}") for c in old.columns], *[F.col(f"__new_{c}" if c in sets else c).alias(f"new_{c}") for c in old.columns])
    return new, returned


def move_rows(source: DataFrame, target: DataFrame, where: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DELETE ... RETURNING into INSERT: (source left, target grown, moved)."""
    hit = F.coalesce(where, F.lit(False))
    moved = source.where(hit).select(*target.columns)
    return source.where(~hit), target.unionByName(moved), moved


def claim(jobs: DataFrame, where: Column, order: Sequence[Column], n: int, key: str, sets: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The claim CTE: the first n rows that match change state. ``held`` rows are left out by ``where``."""
    picked = jobs.where(where).orderBy(*order).limit(n).select(F.col(key).alias("__k"))
    marked = jobs.join(picked, jobs[key] == F.col("__k"), "left")
    new = marked.select(*[F.when(F.col("__k").isNotNull(), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in jobs.columns], F.col("__k").isNotNull().alias("__hit"))
    return new.drop("__hit"), new.where("__hit").drop("__hit")


def skip_locked(jobs: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows that no other worker holds (FOR UPDATE SKIP LOCKED, with the locks as a relation)."""
    return jobs.join(held.select(key), key, "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: Keys, update: dict[str, Callable] | None = None, insert: bool = True, orphan: dict[str, Column] | None = None, delete_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """MERGE: matched update, not matched insert, not matched by source update or delete. Returned: changed rows with
    merge_action. An error if the source has a key twice."""
    source = once_per_key(source, keys, "MERGE")
    o = target.select(*[F.col(c).alias(f"o_{c}") for c in target.columns], F.lit(1).alias("o__"))
    n = source.select(*[F.col(c).alias(f"n_{c}") for c in source.columns], F.lit(1).alias("n__"))
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    matched, only_source, only_target = F.col("o__").isNotNull() & F.col("n__").isNotNull(), F.col("o__").isNull(), F.col("n__").isNull()
    action = F.when(matched & F.lit(update is not None), F.lit("UPDATE")).when(only_source & F.lit(insert), F.lit("INSERT"))
    action = action.when(only_target & F.lit(orphan is not None), F.lit("UPDATE")).when(only_target & F.lit(delete_orphans), F.lit("DELETE"))
    get_o, get_n = (lambda c: F.col(f"o_{c}")), (lambda c: F.col(f"n_{c}"))

    def value(c: str) -> Column:
        inserted = get_n(c) if c in source.columns else F.lit(None)
        v = F.when(only_source, inserted)
        if update and c in update:
            v = v.when(matched, update[c](get_o, get_n))
        if orphan and c in orphan:
            v = v.when(only_target, orphan[c])
        return v.otherwise(get_o(c)).alias(c)

    j = o.join(n, cond, "full").select(*[value(c) for c in target.columns], action.alias("merge_action"), only_source.alias("__new"))
    kept = j.where(~(F.col("__new") & F.col("merge_action").isNull()) & ~F.coalesce(F.col("merge_action") == "DELETE", F.lit(False)))
    return kept.select(*target.columns), j.where("merge_action IS NOT NULL").drop("__new")


def portion_update(df: DataFrame, lo: str, hi: str, start: Column, end: Column, sets: dict[str, Column] | None) -> DataFrame:
    """FOR PORTION OF [start, end): the part inside changes (or goes, with sets None), the rest of each row is kept."""
    bound = F.struct
    inside = (F.col(lo) < end) & (F.col(hi) > start)
    left = bound(F.col(lo).alias("lo"), F.least(F.col(hi), start).alias("hi"), F.lit(False).alias("mid"))
    mid = bound(F.greatest(F.col(lo), start).alias("lo"), F.least(F.col(hi), end).alias("hi"), F.lit(True).alias("mid"))
    right = bound(F.greatest(F.col(lo), end).alias("lo"), F.col(hi).alias("hi"), F.lit(False).alias("mid"))
    pieces = F.when(inside, F.filter(F.array(left, mid, right), lambda p: p["lo"] < p["hi"])).otherwise(F.array(bound(F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit(False).alias("mid"))))
    out = df.withColumn("__p", F.explode(pieces))
    if sets is None:
        out, sets = out.where("NOT __p.mid"), {}
    return out.select(*[F.col("__p.lo").alias(c) if c == lo else F.col("__p.hi").alias(c) if c == hi else F.when(F.col("__p.mid"), sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in df.columns])


def duplicate_keys(df: DataFrame, keys: Keys) -> DataFrame:
    """Keys that break PRIMARY KEY or UNIQUE."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows that break a foreign key."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


def missing(df: DataFrame, columns: Keys) -> DataFrame:
    """Rows that break NOT NULL."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


def overlapping(df: DataFrame, keys: Keys, lo: str, hi: str) -> DataFrame:
    """Rows whose half-open range begins before an earlier one of the same key ends, the shorter first of those that begin together:
    a running maximum by time, which a hot key spreads over buckets. Empty ranges overlap nothing, null bounds are open."""
    return intervals.overlapping(df, lo, hi, keys, keep_longest=False)


def conflicts(candidates: DataFrame, old: DataFrame, keys: Keys, lo: str, hi: str) -> DataFrame:
    """Incoming rows that overlap an existing row of the same key, which an exclusion constraint rejects."""
    return intervals.conflicting(candidates, old, lo, hi, keys)


def rejected(violations: DataFrame) -> bool:
    """Whether a write must be rejected."""
    return not violations.isEmpty()


def compare_and_set(state: DataFrame, writes: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """State rows (key, value, version); writes (key, value, expected): accepted iff expected is the version, 0 for a new key.
    With a column ``order``, writes of one key are judged one after the other, each against what the accepted ones before it
    left; without, a key that is written twice is an error. Returned: the new state, and the writes with ``accepted``."""
    current = state.select(F.col("key").alias("__k"), F.col("version").alias("__v"))
    if order is None:
        j = once_per_key(writes, ["key"], "compare-and-set").join(current, F.col("key") == F.col("__k"), "left")
        judged = j.select("key", "value", "expected", (F.coalesce("__v", F.lit(0)) == F.col("expected")).alias("accepted"))
    else:
        j = writes.join(current, F.col("key") == F.col("__k"), "left").withColumn("__v", F.coalesce("__v", F.lit(0)).cast("long"))
        kinds = writes.schema
        asked = j.select(F.col("key").alias("key"), F.col("value").alias("value"), F.col("expected").cast("long").alias("expected"), F.col(order).alias(order), "__v")
        ddl = ", ".join([f"key {kinds['key'].dataType.simpleString()}", f"value {kinds['value'].dataType.simpleString()}", "expected bigint", f"`{order}` {kinds[order].dataType.simpleString()}", "accepted boolean"])
        judged = asked.repartition("key").sortWithinPartitions("key", order).mapInArrow(_in_turn, ddl)
    good = judged.where("accepted").groupBy("key").agg(F.max_by("value", "expected").alias("value"), (F.max("expected") + 1).alias("version"))
    new = state.join(good, "key", "left_anti").unionByName(good)
    return new, judged


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each write judged after those before it; rows are sorted by key and order, and only the last key's version is kept."""
    last, version = None, 0
    for b in batches:
        accepted = []
        for key, expected, first in zip(b.column("key").to_pylist(), b.column("expected").to_pylist(), b.column("__v").to_pylist()):
            if key != last:
                last, version = key, first
            accepted.append(key is not None and expected == version)
            version += accepted[-1]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(accepted, pa.bool_())], names=[*b.schema.names[:4], "accepted"])


def apply_operations(state: DataFrame, ops: DataFrame) -> DataFrame:
    """A state transaction: ops (seq, kind upsert or delete, key, value), the last of a key wins, all in one new state."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("o"))
    kept = state.select("key", "value").join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last.where("o.kind = 'upsert'").select("key", F.col("o.value").alias("value")))


def with_defaults(rows: DataFrame, **defaults: Column) -> DataFrame:
    """Columns that the rows lack, or that are null in them, get their defaults."""
    return rows.withColumns({c: F.coalesce(F.col(c), v) if c in rows.columns else v for c, v in defaults.items()})


def add_with_key(table: DataFrame, row: dict[str, Column], key: str, prefix: str, fk: str, parents: DataFrame, pk: str) -> tuple[DataFrame, DataFrame]:
    """(new table, added): one row whose key is the prefix and the number of rows plus one. An error when it runs if its foreign key
    has no parent."""
    n = table.agg(F.count(F.lit(1)).alias("__n"))
    one = n.select(F.concat(F.lit(prefix), (F.col("__n") + 1).cast("string")).alias(key), *[v.alias(c) for c, v in row.items()])
    known = one.join(parents.select(F.col(pk).alias("__pk")).distinct(), F.col(fk) == F.col("__pk"), "left")
    checked = F.when(F.col("__pk").isNull(), F.raise_error(F.concat(F.lit(f"no such {pk}: "), F.col(fk).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    added = known.withColumn("__ok", checked).where("__ok").select(*table.columns)
    return table.unionByName(added), added


def upload(catalogue: DataFrame, sent: DataFrame, key: str, order: str, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(new catalogue, summary): of a stream of rows the valid ones are put by key, the last by ``order`` wins; the summary counts
    accepted and rejected ones."""
    ok = F.coalesce(valid, F.lit(False))
    last = sent.where(ok).groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in catalogue.columns if c != key]), order).alias("__r"))
    new = last.select(key, "__r.*").select(*catalogue.columns)
    summary = sent.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))
    return catalogue.join(new.select(key), key, "left_anti").select(*catalogue.columns).unionByName(new), summary


def relay(outbox: DataFrame, n: int, order: str, mark: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, new outbox): the first n rows without a mark are sent, and marked. What is marked is never sent again."""
    pending = outbox.where(F.col(mark).isNull()).orderBy(order).limit(n)
    sent = pending.select(F.col(order).alias("__k"))
    j = outbox.join(sent, F.col(order) == F.col("__k"), "left")
    return pending.drop(mark), j.select(*[F.when(F.col("__k").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == mark else F.col(c) for c in outbox.columns])
