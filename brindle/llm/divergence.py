r"""Source divergence audit by inclusion and exclusion over supports, in built-in functions.

Each language keeps the terms of at least ``MIN_DOCUMENTS`` of its documents, V of them. A source's smoothed share of a term is
p(c) = 1 + floor(10^9 (c + 5) / (N + 5 V)), c its count there and N the sum of the source's counts. The distance of two sources
A and B is the sum of abs(p_A - p_B) over all V terms, most of which one of them lacks, or both. With z = p(0) and supports a
and b:

    sum over a of abs(p_A(c) - z_B)  +  sum over b of abs(z_A - p_B(c))                  from each source's histogram of counts
    + (V - |a| - |b| + |a and b|) * abs(z_A - z_B)                                       a constant, times a number
    + sum over a and b of abs(p_A - p_B) - abs(p_A - z_B) - abs(z_A - p_B)               from terms that both have

Only the last line needs terms: a join of the sources' postings, less than V times the pairs of sources and summed at once.
Counts are summed before any exchange; no group meets in one task but as sums, as its fifty best terms, or as its distances.
All arithmetic is that of whole numbers.

Defined results: a null text, lang or source is the empty one; a source of which no document has a kept term has N = 0 and is
compared like any other; a language without kept terms has distances 0 and no terms; repeated rows count each time, whatever
their ids; equal values rank by the item's bytes; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fold, written

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS, TOP, PRIOR, UNIT = 30, 50, 5, 1_000_000_000


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR terms)), exactly; 0 terms have no shares."""
    return F.when(terms > 0, F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), (total + PRIOR * terms).cast("decimal(20,0)")) + 1)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, df): occurrences, and documents that have the term."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), fold(text)).otherwise(F.lower(text))
    d = docs.select(*_names(), F.explode(F.array(F.split(low, SEPARATORS))).alias("words"))
    both = F.array(F.struct(F.col("words").alias("w"), F.lit(1).alias("c"), F.lit(0).alias("df")), F.struct(F.array_distinct("words").alias("w"), F.lit(0).alias("c"), F.lit(1).alias("df")))
    d = d.select("lang", "source", F.explode(both).alias("x"))
    d = d.select("lang", "source", F.col("x.c").alias("c"), F.col("x.df").alias("df"), F.explode("x.w").alias("term")).where("term <> ''")
    return d.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def _names() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _tables(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """groups: (lang, source, g, n, v, ln) of every group that occurs; postings: (g, lang, source, k, term, c, p, q) of the kept
    terms it has, k being the term's number, p the group's share and q the language's."""
    counts, _ = written(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("lc"), F.sum("df").alias("ldf")).where(F.col("ldf") >= least)
    kept, _ = written(kept.select("lang", "term", "lc", F.monotonically_increasing_id().alias("k")), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lc").alias("ln"))
    found, _ = written(counts.select("lang", "source", "term", "c").join(kept, ["lang", "term"]), "found")
    sizes = found.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = docs.select(*_names()).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups, _ = written(groups.select("lang", "source", F.monotonically_increasing_id().alias("g"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "ln")]), "groups")
    # a group's row meets as many terms as the group has
    key = F.struct("lang", "source")
    of = groups.select(F.struct("lang", "source").alias("key"), "g", "n", "v", "ln")
    postings = found.withColumn("key_", key).join(of, F.col("key_") == F.col("key"))
    postings = postings.select("g", "lang", "source", "k", "term", "c", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), share(F.col("lc"), F.col("ln"), F.col("v")).alias("q"))
    postings, _ = written(postings, "postings")
    return groups, postings


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each two sources of a language, both ways."""
    zeros = groups.select("lang", "g", "source", "v", share(F.lit(0), F.col("n"), F.col("v")).alias("z"))
    # one-sided terms: what each group's histogram of shares costs against another's zero
    histogram = postings.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("terms"))
    supports = postings.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    own = zeros.join(supports, "g", "left").select("lang", "g", "source", "v", "z", F.coalesce("size", F.lit(0)).alias("size"))
    x, y = own.alias("x"), own.alias("y")
    pairs = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.g") < F.col("y.g"))).select(F.col("x.lang").alias("lang"), F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.col("x.source").alias("sa"), F.col("y.source").alias("sb"), F.col("x.v").alias("v"), F.col("x.z").alias("za"), F.col("y.z").alias("zb"), (F.col("x.size") + F.col("y.size")).alias("sizes"))
    against = zeros.select(F.col("lang").alias("l2"), F.col("g").alias("g2"), "z")
    sided = histogram.join(against, (F.col("lang") == F.col("l2")) & (F.col("g") != F.col("g2")))
    sided = sided.groupBy(F.least("g", "g2").alias("a"), F.greatest("g", "g2").alias("b")).agg(F.sum(F.col("terms") * F.abs(F.col("p") - F.col("z"))).alias("sided"))
    # terms of both supports
    z = zeros.select(F.col("g").alias("zg"), "z")
    priced = postings.select("g", "k", "p").join(z, F.col("g") == F.col("zg")).select("g", "k", "p", "z")
    left, right = priced.select(F.col("g").alias("a"), "k", F.col("p").alias("pa"), F.col("z").alias("oa")), priced.select(F.col("g").alias("b"), F.col("k").alias("k2"), F.col("p").alias("pb"), F.col("z").alias("ob"))
    met = left.join(right, (F.col("k") == F.col("k2")) & (F.col("a") < F.col("b")))
    shared = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.sum(F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("ob")) - F.abs(F.col("oa") - F.col("pb"))).alias("correction"))
    zero = F.lit(0).cast("long")
    common = F.coalesce("common", zero)
    value = F.coalesce("sided", zero) + (F.col("v") - F.col("sizes") + common) * F.coalesce(F.abs(F.col("za") - F.col("zb")), zero) + F.coalesce("correction", zero)
    valued = pairs.join(sided, ["a", "b"], "left").join(shared, ["a", "b"], "left").select("lang", "sa", "sb", value.cast("long").alias("value"))
    both = F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("x")
    return valued.select("lang", both, "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distances to the others of its language, and its ``top`` terms by
    how much their share exceeds the language's."""
    groups, postings = _tables(docs, least)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pair = distances(groups, postings).withColumn("rank", F.row_number().over(ranked))
    over = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


QUERIES = {"op12_divergence": op12_divergence}
#: All terms of all pairs, zeros written out.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lc)::HUGEINT AS ln FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(ln, 0) AS ln, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (n + 5 * v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (lc + 5) // (ln + 5 * v))::BIGINT AS q
    FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
o AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM e UNION ALL SELECT * FROM o)
QUALIFY part = 'pair' OR rank <= 50
"""
ORACLE_SQL = {"op12_divergence": ORACLE}
