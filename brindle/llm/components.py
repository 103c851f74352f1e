"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, removed, written


#: Links in a file of a round's table, about.
PART_LINKS = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its larger neighbours to the least of its neighbours and itself. Small: each node links its
    smaller neighbours and itself to the least of them. Links are (u, v) with u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # the least node of a large component meets all of its nodes
    joined = both.join(least, apart(both["u"]) == apart(least["w"]))
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that a link (a, b) has; component is its least reachable node. Links may repeat, point
    either way, or join a node to itself, which then has no row unless another link has it. Rounds grow with the logarithm of
    the longest path; links that are not settled after so many are an error, never a result."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") > F.col("v")).distinct()
    e, folder = written(e, "links")
    before, links = None, e.count()
    for _ in range(most_rounds):
        old = folder
        e, folder = written(_star(_star(e, True), False).coalesce(1 + links // PART_LINKS), "links")
        removed(edges.sparkSession, old)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, links = now, now[0]
    else:
        raise RuntimeError(f"links are not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def local_roots(n: int, pairs) -> list[int]:
    """Least reachable place for each of n places, from pairs of places."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
