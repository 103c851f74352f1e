"""Joins by trigram similarity: pairs of values whose trigram sets overlap enough, without looking at all pairs.

Distinct values of both sides are joined, and rows are joined to the pairs found, so a value that many rows have is compared once.
Two sets of sizes a and b with similarity (Jaccard) of at least t share at least t / (1 + t) (a + b) members, their sizes differ by
no more than the factor t, and, all sets being sorted by how many pairs have a member, they share one among the first a - s + 1 of
the one and b - s + 1 of the other, s being what a set shares at least with any similar one of the sizes that the other side has.
Members that only one side has make no pair: they come first, and are left out of the first ones. So only these first members are
exchanged and joined; sizes, the members' places and 64 bits of what members a set has rule out most candidates at once, a pair is
taken at the first member its prefixes share, and what is left is compared whole. All
steps are built-in functions; a member that many values have in their prefix is split, as both sides of that join are exchanged.
Members are numbered by rarity, so that sets are arrays of numbers. Rows and prefixes are joined by merging, whatever Spark takes their
size to be: it does not know how many rows a set is opened to, nor what a compressed table is in memory, and the driver would hold them.

A null value is similar to nothing; a value without letters or digits has no trigrams and is similar to nothing; values that
differ only in case or in what stands between words have similarity 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.values import trigrams
from brindle.session import durable


def _sets(values: DataFrame) -> DataFrame:
    """(value, members, n) of distinct values (value) that have trigrams."""
    return values.where("value IS NOT NULL").distinct().select("value", F.explode(F.array(trigrams(F.col("value")))).alias("members")).select("value", "members", F.size("members").alias("n")).where("n > 0")


def needed(n: int, others: list[int], threshold: float) -> int:
    """Members that a set of n shares with any similar one of the sizes that there are, in order, at least; 0 if none can be similar."""
    fit = next((m for m in others if min(n, m) >= max(n, m) * threshold - 1e-9), None)
    return 0 if fit is None else max(1, math.ceil((n + fit) * threshold / (1 + threshold) - 1e-9))


def pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right, similarity) of values (value) of either side that are similar."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    a, b = _sets(left).withColumn("side", F.lit(0)), _sets(right).withColumn("side", F.lit(1))
    both = durable(a.union(b))
    # as many rows as there are different sizes
    found = [(x["side"], x["n"]) for x in both.select("side", "n").distinct().collect()]
    sizes = [sorted(n for at, n in found if at == side) for side in (0, 1)]
    needs = [(side, n, needed(n, sizes[1 - side], threshold)) for side, n in found]
    needs = both.sparkSession.createDataFrame([x for x in needs if x[2]], "side int, n int, need int")
    # members of both sides in one order for all sets: those that make few pairs come first, ties by the member
    member, of = F.explode("members").alias("member"), lambda side: F.count(F.when(F.col("side") == side, 1))
    counts = both.select("side", member).groupBy("member").agg((of(0) * of(1)).alias("pairs")).where("pairs > 0").orderBy("pairs", "member")
    counts = durable(counts.select(F.col("member").alias("m"), F.monotonically_increasing_id().alias("rank")))
    ranked = both.join(F.broadcast(needs), ["side", "n"]).select("side", "value", "n", "need", member).join(counts, F.col("member") == F.col("m"))
    bits = F.bit_or(F.expr("shiftleft(1L, cast(rank % 64 as int))")).alias("bits")
    ordered = durable(ranked.groupBy("side", "value", "n", "need").agg(F.array_sort(F.collect_list("rank")).alias("ms"), bits).where(F.size("ms") >= F.col("need")))
    # members of one side only would stand before all others: prefixes are shorter by them
    first = ordered.select("side", "value", "n", "ms", "bits", F.posexplode(F.slice("ms", F.lit(1), F.size("ms") - F.col("need") + 1)).alias("p", "key"))
    x = first.where("side = 0").select(F.col("value").alias("left"), F.col("n").alias("na"), F.col("ms").alias("a"), F.col("bits").alias("ba"), F.col("p").alias("pa"), "key")
    y = first.where("side = 1").select(F.col("value").alias("right"), F.col("n").alias("nb"), F.col("ms").alias("b"), F.col("bits").alias("bb"), F.col("p").alias("pb"), F.col("key").alias("key2"))
    na, nb, sizes = F.col("na"), F.col("nb"), F.col("na") + F.col("nb")
    need = F.ceil(sizes * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    # what both have from here on is all that they can share, as this is the first member that both have; and a bit that only one of them has is a member that the other lacks
    alike = F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold) - F.lit(1e-9)
    rest = F.least(F.size("a") - F.col("pa"), F.size("b") - F.col("pb")) >= need
    lacks = lambda m, u, v: F.size(m) - F.bit_count(F.col(u).bitwiseAND(F.bitwise_not(F.col(v)))) >= need
    earlier = F.arrays_overlap(F.slice("a", F.lit(1), F.col("pa")), F.slice("b", F.lit(1), F.col("pb")))
    shared = F.size(F.array_intersect("a", "b"))
    similarity = shared / (sizes - shared)
    # one condition, as filters of their own would be tested in any order: what costs most comes last
    fits = F.when(~(alike & rest & lacks("a", "ba", "bb") & lacks("b", "bb", "ba")), False).when(F.coalesce(earlier, F.lit(False)), False).otherwise(similarity >= threshold)
    # a row of either side meets many: as many tasks as are set, however small they are
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = x.repartition(tasks, "key").join(y.repartition(tasks, "key2").hint("merge"), (F.col("key") == F.col("key2")) & fits)
    return met.select("left", "right", similarity.alias("similarity"))


def similar_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float = 0.3) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` whose values are similar, and ``similarity``. Column names of the two
    sides must differ."""
    clash = set(left.columns) & set(right.columns) | ({"similarity"} & (set(left.columns) | set(right.columns)))
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    found = pairs(left.select(F.col(f"`{left_on}`").cast("string").alias("value")), right.select(F.col(f"`{right_on}`").cast("string").alias("value")), threshold)
    found = found.select(F.col("left").alias("__l"), F.col("right").alias("__r"), "similarity")
    out = left.join(found.hint("merge"), F.col(f"`{left_on}`").cast("string") == F.col("__l"))
    return out.join(right.hint("merge"), F.col(f"`{right_on}`").cast("string") == F.col("__r")).drop("__l", "__r")


def nearest(left: DataFrame, right: DataFrame, left_on: str, right_on: str, k: int, threshold: float = 0.3) -> DataFrame:
    """Of each left value its k most similar right values, at least as similar as the threshold: (left, right, similarity, place);
    ties by the right value."""
    found = pairs(left.select(F.col(f"`{left_on}`").cast("string").alias("value")), right.select(F.col(f"`{right_on}`").cast("string").alias("value")), threshold)
    by = Window.partitionBy("left").orderBy(F.desc("similarity"), "right")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
