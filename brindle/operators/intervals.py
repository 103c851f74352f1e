"""Joins and checks of half-open intervals without an equal key.

``overlap_pairs``: an interval is put at the level of the power of two that its length fits in, where it touches two buckets at most,
and is looked for at its own level and at each higher one that has intervals, in two buckets at most each. So each pair meets at
the level of its longer interval, in few buckets, and is taken in the one where the later of the two begins. Whatever the lengths, an
interval has a few rows a level; buckets where many intervals meet are split, as both sides are exchanged for the join. Levels are
put together where that makes at most three times as many candidates, by the counts of intervals: fewer rows are exchanged.

``overlap_twos``: each two rows of one table, once. Rows stand in order of their begin, and those that a row overlaps of the later ones
are the next ones: a range of places, which the count of begins before its end gives. So no candidate is made that is no pair: a row is
joined with the blocks of its range, arrays of at most ``BLOCK`` rows, and opened to what lies in it.

``reach``: of the intervals that begin before a point, the latest end. With it, whether an interval conflicts with any of a set
takes no pairs at all: it is a running maximum by time, whose buckets hold about as many rows each, and what earlier buckets reach
is one row a bucket. An interval that overlaps many is found as fast as one that overlaps none.

Times are numbers, dates or timestamps. A null lower bound is before, a null upper bound after everything; empty intervals overlap
nothing; null keys equal none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import durable

#: Buckets of a running maximum.
BUCKETS = 128

#: Rows of a block, at most and at least; in between, so many that small tables have blocks for all tasks.
BLOCK, SMALL_BLOCK, BLOCKS = 4096, 32, 512


#: Bounds past all others, of whole numbers and of doubles.
FAR, FAR_DOUBLE = 1 << 62, 1e300


def number(c: Column, kind: str) -> Column:
    """A time as a number, in order."""
    return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else F.unix_date(c).cast("long") if kind == "date" else c.cast("long") if kind in ("int", "smallint", "tinyint") else c


def _timed(df: DataFrame, lo: str, hi: str, keys: Sequence[str], side: str) -> DataFrame:
    """The rows as one struct, their bounds as numbers, and their key."""
    kinds = dict(df.dtypes)
    key = F.struct(*[F.col(f"`{k}`") for k in keys]) if keys else F.lit(0)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(f"`{k}`").isNotNull()
    return df.where(known).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), number(F.col(f"`{lo}`"), kinds[lo]).alias("lo"), number(F.col(f"`{hi}`"), kinds[hi]).alias("hi"), key.alias("key"))


def _closed(d: DataFrame) -> DataFrame:
    """The rows with null bounds past all others, and without empty intervals."""
    far = FAR_DOUBLE if dict(d.dtypes)["lo"] in ("double", "float") else FAR
    return d.withColumns({"lo": F.coalesce("lo", F.lit(-far)), "hi": F.coalesce("hi", F.lit(far))}).where(F.col("lo") < F.col("hi"))


def joined_levels(counts: dict[int, int], most: float = 3.0) -> dict[int, int]:
    """The level at which intervals of each level are put: its own or a higher one. An interval's candidates are as many as its
    level's buckets are wide; in all they are at most ``most`` times what own levels make."""
    to = {x: x for x in counts}
    top = max(counts, default=0)
    cost = lambda: sum(n * 2.0 ** (to[x] - top) for x, n in counts.items())
    limit = most * cost()
    for x in sorted(counts, reverse=True)[1:]:
        own, to[x] = to[x], min(to[y] for y in counts if y > x)
        if cost() > limit:
            to[x] = own
    return to


def overlap_pairs(left: DataFrame, right: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """(left, right), structs of the rows, for each two that overlap (and whose keys are equal). Both have the columns lo, hi and keys."""
    a, b = _closed(_timed(left, lo, hi, keys, "left")), _closed(_timed(right, lo, hi, keys, "right"))
    level = F.ceil(F.log2(F.col("hi").cast("double") - F.col("lo").cast("double"))).cast("int")
    a, b = a.withColumn("level", level), b.withColumn("level", level)
    # as many rows as there are different powers of two
    to = joined_levels(dict(a.select("level").union(b.select("level")).groupBy("level").count().collect()))
    levels = sorted(set(to.values()))
    if to:
        shared = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])[F.col("level")]
        a, b = a.withColumn("level", shared), b.withColumn("level", shared)

    def put(d: DataFrame, own: bool) -> DataFrame:
        """A row for each bucket: of its own level, or of each higher one."""
        at = F.array(F.col("level")) if own else F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("level"))
        there = d.select("*", F.explode(at).alias("at"))
        wide = F.pow(F.lit(2.0), F.col("at"))
        # the last point inside may be past the upper bound's bucket's begin by nothing: a bucket too many is no harm
        return there.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor(F.col("hi") / wide)))).drop("level")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        later = F.greatest("x.lo", "y.lo")
        inside = (F.col("x.lo") < F.col("y.hi")) & (F.col("y.lo") < F.col("x.hi")) & (F.floor(later / F.pow(F.lit(2.0), F.col("x.at"))) == F.col("x.bucket"))
        return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.bucket") == F.col("y.bucket")) & inside).select("left", "right")

    own = met(put(a, True), put(b, True))
    return own if len(levels) < 2 else own.union(met(put(a, True), put(b, False))).union(met(put(a, False), put(b, True)))


def begun(points: DataFrame, asked: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """points, asked: (key, t). Returned: (key, t, before) of every t of both, before being how many points of its key have a lesser
    t; and the number of points."""
    marks = points.select("key", "t", F.lit(1).alias("n")).union(asked.select("key", "t", F.lit(0).alias("n")))
    one = durable(marks.groupBy("key", "t").agg(F.sum("n").alias("n")))
    # bounds: so many numbers, whatever the size
    cuts, total = one.agg(F.percentile_approx("t", [i / buckets for i in range(1, buckets)], 10_000), F.coalesce(F.sum("n"), F.lit(0))).first()
    one = one.withColumn("bucket", sum((F.when(F.col("t") >= c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0)))
    earlier = lambda *by: Window.partitionBy("key", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tops = one.groupBy("key", "bucket").agg(F.sum("n").alias("n")).select(F.col("key").alias("k"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(earlier("bucket")), F.lit(0)).alias("carried"))
    near = one.withColumn("near", F.coalesce(F.sum("n").over(earlier("bucket", "t")), F.lit(0)))
    joined = near.join(tops, (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")))
    return durable(joined.select("key", "t", (F.col("near") + F.col("carried")).alias("before"))), total


def overlap_twos(df: DataFrame, row: Column, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """(first, second), values of ``row``, for each two rows that overlap (and whose keys are equal), once; first begins no later."""
    d = _closed(_timed(df.withColumn("__row", row), lo, hi, keys, "side")).select("key", "lo", "hi", F.col("side.__row").alias("row"))
    at, total = begun(d.select("key", F.col("lo").alias("t")), d.select("key", F.col("hi").alias("t")))
    size = min(BLOCK, max(SMALL_BLOCK, total // BLOCKS))
    of = lambda end, name: at.select(F.col("key").alias("k"), F.col("t"), F.col("before").alias(name))
    met = lambda x, end, name: x.join(of(end, name), (F.col("key") == F.col("k")) & (F.col(end) == F.col("t"))).drop("k", "t")
    # those that begin together stand in any order, but always in the same one
    place = F.row_number().over(Window.partitionBy("key", "lo").orderBy("hi")) - 1
    placed = durable(met(met(d, "lo", "before"), "hi", "end").withColumn("place", F.col("before") + place).select("key", "row", "place", "end"))
    block = lambda c: F.floor(c / size)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda x: x["row"]).alias("rows")
    blocks = placed.groupBy(F.col("key").alias("k"), block(F.col("place")).alias("b")).agg(rows)
    begin = F.col("place") + 1
    spans = placed.where(begin < F.col("end")).withColumn("block", F.explode(F.sequence(block(begin), block(F.col("end") - 1))))
    start = F.col("block") * size
    inside = spans.select("key", "block", F.col("row").alias("first"), F.greatest(begin - start, F.lit(0)).cast("int").alias("i"), F.least(F.col("end") - start, F.lit(size)).cast("int").alias("j"))
    # a row of either side is opened to many: as many tasks as are set, however small they are
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside, blocks = inside.repartition(tasks, "key", "block"), blocks.repartition(tasks, "k", "b")
    found = inside.join(blocks.hint("merge"), (F.col("key") == F.col("k")) & (F.col("block") == F.col("b")))
    return found.select("first", F.explode(F.slice("rows", F.col("i") + 1, F.col("j") - F.col("i"))).alias("second"))


def reach(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """events: (key, t, hi); hi is null for a point that asks. Returned: (key, t, reach) of the points that ask, reach being the
    greatest hi of the events of its key before t."""
    # one row a key and time
    one = events.groupBy("key", "t").agg(F.max("hi").alias("hi"), F.max(F.col("hi").isNull()).alias("asks"))
    # bounds: so many numbers, whatever the size
    cuts = events.agg(F.percentile_approx("t", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = sum((F.when(F.col("t") >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    one = one.withColumn("bucket", bucket)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = one.groupBy("key", "bucket").agg(F.max("hi").alias("top")).withColumn("carried", F.max("top").over(before)).select(F.col("key").alias("k"), F.col("bucket").alias("b"), "carried")
    within = Window.partitionBy("key", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    inside = one.withColumn("near", F.max("hi").over(within)).where("asks")
    joined = inside.join(tops, (F.col("key") == F.col("k")) & (F.col("bucket") == F.col("b")))
    return joined.select("key", "t", F.greatest("near", "carried").alias("reach"))


def conflicting(candidates: DataFrame, old: DataFrame, lo: str, hi: str, keys: Sequence[str] = ()) -> DataFrame:
    """The candidates that overlap any old row (of equal keys): what an exclusion constraint rejects. No pair is made."""
    a, b = _closed(_timed(candidates, lo, hi, keys, "row")), _closed(_timed(old, lo, hi, keys, "row"))
    asks = a.select("key", F.col("hi").alias("t"), F.lit(None).cast(dict(b.dtypes)["hi"]).alias("hi"))
    known = reach(b.select("key", F.col("lo").alias("t"), "hi").union(asks)).select(F.col("key").alias("k"), "t", "reach")
    # an old row begins before the candidate ends, and one of those that do ends after it begins
    return a.join(known, (F.col("key") == F.col("k")) & (F.col("hi") == F.col("t")) & (F.col("reach") > F.col("lo"))).select("row.*")


def overlapping(df: DataFrame, lo: str, hi: str, keys: Sequence[str] = (), keep_longest: bool = True) -> DataFrame:
    """Rows that begin before one that began earlier (of equal keys) ends; of rows that begin together, all but the longest (or the
    shortest), and of equal ones all but one. Without any, no two rows overlap."""
    a = _closed(_timed(df, lo, hi, keys, "row"))
    known = reach(a.select("key", F.col("lo").alias("t"), "hi").union(a.select("key", F.col("lo").alias("t"), F.lit(None).cast(dict(a.dtypes)["hi"]).alias("hi")))).select(F.col("key").alias("k"), "t", "reach")
    late = a.join(known, (F.col("key") == F.col("k")) & (F.col("lo") == F.col("t"))).withColumn("earlier", F.coalesce(F.col("reach") > F.col("lo"), F.lit(False)))
    # rows that begin together overlap: one of them stays
    first = Window.partitionBy("key", "lo").orderBy(F.desc("hi") if keep_longest else F.asc("hi"))
    return late.withColumn("place", F.row_number().over(first)).where(F.col("earlier") | (F.col("place") > 1)).select("row.*")
