"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source's budget becomes a threshold on that hash: documents below it
are taken. The threshold is found from histograms alone: words summed by source and leading hash bits show in which bucket
the budget is reached, and only that bucket is split by the next bits. No sort, no per-source list; a source that holds a
third of all rows is as many small bucket sums as any other.

Defined results: a null text has 0 words and null is a source of its own, the last; an empty table gives an empty result;
rows that share an id and a source share a hash, so they are taken together or not at all; a source without words has the
target 0 and nothing of it is taken; extra columns are left out of the result of ``mix`` and kept by ``resample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, durable, n_words, packed, unpacked

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
#: Hash bits that each level of the histogram resolves; they sum to the 60 bits of the hash.
LEVELS = (12, 12, 12, 12, 12)
BITS = sum(LEVELS)


def unit_hash(c: Column) -> Column:
    """60 bits of the id's md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size -> target: weight times one level, capped at ``most`` times the source's size, where the level
    makes the targets sum to ``share`` of all words. Sharing the excess out again and again ends at this level."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_code) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_of = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_of) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_of)["level"]
    return s.select("source", "source_size", F.when(F.col("cap") / F.col("weight") <= final, F.col("cap")).otherwise(final * F.col("weight")).cast("double").alias("target"))


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' slim table (doc_id, source, size, h) and, for each source, its plan: (source, source_size, target, base,
    threshold). A document is taken ``base`` times, and once more if its hash is at most the threshold."""
    slim = durable(docs.select(F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), unit_hash(F.col("doc_id")).alias("h")))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("base", F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS)).cast("long"))
    plan = plan.withColumn("base", F.coalesce("base", F.lit(0)))
    plan = plan.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
    # prefix: the hash bits fixed so far; below: words of this source under the prefix
    plan = durable(plan.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    done = 0
    for bits in LEVELS:
        done += bits
        bucket = F.shiftright("h", BITS - done)
        inside = slim.join(plan.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright(bucket, bits) == F.col("prefix")))
        sums = inside.groupBy(F.col("source").alias("s"), bucket.alias("b")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("s").orderBy("b")
        sums = sums.withColumn("upto", F.sum("words").over(upto))
        found = sums.join(plan, F.col("s").eqNullSafe(F.col("source")))
        reached = (F.col("below") + F.col("upto")) > F.col("budget")
        found = found.groupBy("s").agg(
            F.min(F.when(reached, F.struct("b", F.col("below") + F.col("upto") - F.col("words"), F.col("below") + F.col("upto")))).alias("at"),
            F.max("b").alias("last"),
            F.max(F.col("below") + F.col("upto")).alias("whole"),
        )
        plan = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "base", "budget",
            # the budget lies past the last bucket: all is taken, and the last bucket stays the boundary
            F.coalesce(F.col("at.b"), F.col("last"), F.shiftleft("prefix", bits)).alias("prefix"),
            F.coalesce(F.col("at.col2"), F.when(F.col("last").isNotNull(), F.col("whole")), F.col("below")).alias("below"),
            F.coalesce(F.col("at.col3"), F.col("whole"), F.col("below")).alias("with_bucket"),
        )
        plan = durable(plan)
    # the last bucket is one hash value: it is taken if that comes nearer to the budget
    near = (F.col("with_bucket") - F.col("budget")) < (F.col("budget") - F.col("below"))
    plan = plan.withColumn("threshold", F.when((F.col("below") < F.col("with_bucket")) & ~near, F.col("prefix") - 1).otherwise(F.col("prefix")))
    return slim, plan.select("source", "source_size", "target", "base", "threshold", "budget")


def _times(base: Column, budget: Column, h: Column, threshold: Column) -> Column:
    extra = (budget > 0) & (h <= threshold) & (base < MOST_REPEATS)
    return F.least(base + extra.cast("long"), F.lit(MOST_REPEATS).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of the document) for every document."""
    slim, plan = copies(docs)
    out = slim.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("base"), F.col("budget"), F.col("h"), F.col("threshold"))).alias("taken"))


def resample(docs: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as often as the mix takes it, with all its columns."""
    _, plan = copies(docs)
    plan = plan.select(F.struct("source", "base", "threshold", "budget").alias("plan"))
    rows = packed(docs, "doc_id", F.col("source").cast("string").alias("source"))
    joined = rows.join(plan, rows["source"].eqNullSafe(F.col("plan.source")))
    times = _times(F.col("plan.base"), F.col("plan.budget"), unit_hash(rows["doc_id"]), F.col("plan.threshold"))
    return unpacked(joined.select("row", F.explode(F.array_repeat(F.lit(True), times.cast("int")))))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
    FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, cap::DOUBLE / weight) AS final FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN cap::DOUBLE / weight <= final THEN cap::DOUBLE ELSE final * weight END AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2)::BIGINT END AS base FROM t),
g AS (SELECT *, target - base * source_size AS budget FROM b),
r AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT r.*, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM r),
x AS (SELECT g.source, min(CASE WHEN upto > budget THEN struct_pack(h := h, under := upto - words, over := upto) END) AS hit
    FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source GROUP BY g.source),
p AS (SELECT g.*, CASE WHEN hit IS NULL THEN 9223372036854775807 WHEN hit.over - budget < budget - hit.under THEN hit.h ELSE hit.h - 1 END AS threshold
    FROM g JOIN x ON g.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target,
    (size * least(base + CASE WHEN budget > 0 AND h <= threshold AND base < 2 THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {"op2_mixing": ORACLE}
