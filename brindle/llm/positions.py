r"""Benchmark decontamination by a positional inverted index, in built-in functions only.

``build`` stores the postings of the training documents: (row, pos, tid), a row for each occurrence of an indexed term, written
where documents are read, without an exchange, and for each document one row more with its id and its number of words.
``phrases`` finds where runs of words occur: of each run the two terms that the corpus has least are looked up first, and their
lists, each less the term's offset in the run, are intersected; overlapping runs that have the same two rarest terms at the same
distance share this intersection. What is left is intersected with the lists of the other terms. ``near`` finds where all words
of a run stand within a span, in any order, from the rarest term's postings and buckets of positions around them.

Joins on a term, or on a place in a document, have two sides that are exchanged or one that Spark has found small, so a hot term
is split; equal runs are searched for once, whatever the number of items that have them, and equal items are one class. Terms
are compared as such and not by hashes.

Defined results: a null or empty text has no words, and neither hits nor is hit; rows are judged one by one, so repeated rows,
and rows that share a doc_id, or have none, are judged alike; items that share an item_id count as one item with the windows of
all, a null item_id counts as the item ``null``; an empty table of documents gives an empty result, an empty table of items no
hits; a text of any length is one row of positions; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, fold, stage_folder, written

#: What stands between words, in text whose A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N = 10
#: The term number of the row that each document has besides its postings; its position is the number of words and one.
END = -1


def cut(text: Column) -> Column:
    """An empty string, the words, and an empty string."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), fold(text)).otherwise(F.lower(text))
    return F.split(F.concat(F.lit(" "), F.coalesce(low, F.lit("")), F.lit(" ")), SEPARATORS)


def words(text: Column) -> Column:
    return F.filter(cut(text), lambda w: w != "")


@dataclass
class Index:
    """terms: (term, tid); postings: (row, pos, tid), pos from 1; rows: (row, doc_id, n_words) of each document."""

    terms: DataFrame
    postings: DataFrame
    rows: DataFrame


def _numbered(terms: DataFrame) -> DataFrame:
    """(term, tid) of the terms and of the empty one, END. A table, whose size Spark knows: it broadcasts a small one."""
    distinct = terms.select("term").where("term <> ''").distinct().withColumn("tid", F.monotonically_increasing_id())
    end = terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(END).cast("long").alias("tid"))
    numbered, _ = written(distinct.union(end), "terms")
    return numbered


def build(docs: DataFrame, terms: DataFrame | None = None) -> Index:
    """The index of ``docs`` (doc_id, text) over ``terms`` (term), by default all of their words."""
    if terms is None:
        terms = docs.select(F.explode(cut(F.col("text"))).alias("term"))
    known = _numbered(terms)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), cut(F.col("text")).alias("words"))
    tokens = d.select("row", "doc_id", F.posexplode("words").alias("pos", "term")).where("term <> '' OR pos > 0")
    end = F.col("tid") == END
    # one table, written at once: a number that a document gets here is the same in all of its rows
    table, _ = written(tokens.join(known, "term").select("row", "pos", "tid", F.when(end, F.col("doc_id")).alias("doc_id")), "postings")
    return Index(known.where(F.col("tid") != END), table.where(~end).select("row", "pos", "tid"), table.where(end).select("row", "doc_id", (F.col("pos") - 1).cast("long").alias("n_words")))


@dataclass
class Runs:
    """runs: (run, length, ranked), ranked being the terms as (df, off, tid) from the rarest; runs that the corpus lacks a term
    of are left out. owners: (run, class). classes: (class, ids) of items with the same words."""

    runs: DataFrame
    owners: DataFrame
    classes: DataFrame


def item_classes(items: DataFrame) -> DataFrame:
    """(class, words, ids) of the items (item_id, text) that have words."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), words(F.col("text")).alias("words"))
    found, _ = written(named.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("id").alias("ids")).withColumn("class", F.monotonically_increasing_id()), "items")
    return found


def cut_runs(classes: DataFrame, index: Index, n: int = N) -> Runs:
    """Windows of n words of each class of items, or the whole of a shorter one, by the index's counts."""
    counts = index.postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    counted, _ = written(index.terms.join(counts, "tid"), "counts")
    placed = classes.select("class", F.size("words").alias("m"), F.posexplode("words").alias("at", "term")).join(counted, "term")
    whole = placed.groupBy("class", "m").agg(F.array_sort(F.collect_list(F.struct("at", "tid", "df"))).alias("known"))
    # a window is whole if all its places are known; places of unknown terms are missing
    starts = whole.select("class", F.least("m", F.lit(n)).alias("length"), "known", F.explode(F.sequence(F.lit(0), F.size("known") - 1)).alias("i"))
    cut_out = starts.select("class", "length", F.slice("known", F.col("i") + 1, F.col("length")).alias("w")).where((F.size("w") == F.col("length")) & (F.element_at("w", -1)["at"] - F.get("w", F.lit(0))["at"] == F.col("length") - 1))
    windows, _ = written(cut_out.select("class", "length", F.transform("w", lambda x: x["tid"]).alias("tids"), F.array_sort(F.transform("w", lambda x, i: F.struct(x["df"].alias("df"), i.alias("off"), x["tid"].alias("tid")))).alias("ranked")), "windows")
    runs, _ = written(windows.groupBy("tids").agg(F.first("length").alias("length"), F.first("ranked").alias("ranked")).withColumn("run", F.monotonically_increasing_id()), "runs")
    owners = windows.select("tids", "class").join(runs.select("tids", "run"), "tids").select("run", "class").distinct()
    return Runs(runs.drop("tids"), owners, classes.select("class", "ids"))


def phrases(index: Index, runs: DataFrame) -> DataFrame:
    """(run, row, start, length): every occurrence of every run."""
    first = F.get("ranked", F.lit(0))
    ranked = runs.select("run", "length", first["tid"].alias("t1"), first["off"].alias("off"), F.get("ranked", F.lit(1)).alias("second"), F.slice("ranked", 3, F.greatest(F.size("ranked") - 2, F.lit(0))).alias("rest"))
    ranked = ranked.select("*", F.col("second.tid").alias("t2"), (F.col("second.off") - F.col("off")).alias("delta"))
    p = index.postings
    # written, so that Spark knows how few they are, and does not exchange the postings for none
    single, _ = written(ranked.where("length = 1").select("run", "t1", "length"), "single")
    one = p.join(single, F.col("tid") == F.col("t1")).select("run", "row", F.col("pos").alias("start"), "length")
    # the two rarest terms at their distance: a pattern, which runs share
    patterns, _ = written(ranked.where("length > 1").select("t1", "t2", "delta").distinct(), "patterns")
    heads = p.join(patterns, F.col("tid") == F.col("t1")).select("row", F.col("pos").alias("at"), "t1", "t2", "delta", (F.col("pos") + F.col("delta")).alias("pos2"))
    seconds = p.join(patterns.select(F.col("t2").alias("tid")).distinct(), "tid", "left_semi").select(F.col("row").alias("row2"), F.col("pos").alias("p2"), F.col("tid").alias("tid2"))
    both = heads.join(seconds, (F.col("row") == F.col("row2")) & (F.col("pos2") == F.col("p2")) & (F.col("t2") == F.col("tid2"))).select("row", "at", "t1", "t2", "delta")
    left, _ = written(both.join(ranked.where("length > 1"), ["t1", "t2", "delta"]).select("run", "row", (F.col("at") - F.col("off")).alias("start"), "length", "rest"), "left")
    wanted = left.where("length > 2").select("run", "row", "start", "length", F.explode("rest").alias("x")).select("run", "row", "start", "length", (F.col("start") + F.col("x.off")).alias("place"), F.col("x.tid").alias("want"))
    # of the postings, those of documents that have a pattern are looked at: a mask for 64 documents, which Spark broadcasts
    at, bit = F.shiftright("row", 6), (F.col("row") % 64).cast("int")
    masks, _ = written(left.where("length > 2").select("row").distinct().groupBy(at.alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(row % 64 as int))")).alias("mask")), "masks")
    others = p.join(masks, (at == F.col("block")) & (F.getbit("mask", bit) == 1), "left_semi").select(F.col("row").alias("row2"), "pos", "tid")
    met = wanted.join(others, (F.col("row") == F.col("row2")) & (F.col("place") == F.col("pos")) & (F.col("want") == F.col("tid")))
    more = met.groupBy("run", "row", "start", "length").agg(F.count(F.lit(1)).alias("n")).where("n = length - 2").drop("n")
    return one.union(left.where("length = 2").drop("rest")).union(more)


def near(index: Index, runs: DataFrame, span: int) -> DataFrame:
    """(run, row, start): places from which ``span`` words hold every distinct term of the run, in any order; of the spans around
    one occurrence of the rarest term, the first."""
    p = index.postings
    terms = runs.select("run", F.get("ranked", F.lit(0))["tid"].alias("t1"), F.array_distinct(F.transform("ranked", lambda x: x["tid"])).alias("terms"))
    heads = p.join(terms, F.col("tid") == F.col("t1")).select("run", "row", F.col("pos").alias("at"), "terms")
    asked = heads.select("run", "row", "at", F.size("terms").alias("n"), F.explode("terms").alias("want"), F.floor(F.col("at") / span).alias("b")).withColumn("bucket", F.explode(F.sequence(F.col("b") - 1, F.col("b") + 1)))
    there = p.select(F.col("row").alias("row2"), "pos", "tid", F.floor(F.col("pos") / span).alias("bucket2"))
    met = asked.join(there, (F.col("row") == F.col("row2")) & (F.col("bucket") == F.col("bucket2")) & (F.col("want") == F.col("tid"))).where(F.abs(F.col("pos") - F.col("at")) < span)
    # at most the places of two spans
    around = met.groupBy("run", "row", "at", "n").agg(F.collect_list(F.struct("pos", "tid")).alias("places"))
    holds = lambda s: F.size(F.array_distinct(F.transform(F.filter("places", lambda x: (x["pos"] >= s) & (x["pos"] < s + span)), lambda x: x["tid"]))) == F.col("n")
    starts = F.filter(F.sequence(F.greatest(F.col("at") - span + 1, F.lit(1)), F.col("at")), holds)
    return around.select("run", "row", F.get(starts, F.lit(0)).alias("start")).where("start IS NOT NULL").distinct()


def hit_words(found: DataFrame) -> DataFrame:
    """(row, n_hit): words of each row that stand inside any occurrence."""
    by_start = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("length") - 1).alias("last"))
    spans = spans.withColumn("before", F.coalesce(F.max("last").over(by_start), F.lit(0)))
    return spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("before"), F.col("start") - 1))).alias("n_hit"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """For every document: doc_id, n_words, n_hit (words inside an occurrence of a window), and ``items``, the sorted ids of the
    items with occurring windows."""
    classes = item_classes(items)
    index = build(docs, classes.select(F.explode("words").alias("term")))
    runs = cut_runs(classes, index, n)
    found, _ = written(phrases(index, runs.runs), "occurrences")
    met = found.select("row", "run").distinct().join(runs.owners, "run").select("row", "class").distinct()
    ids = met.join(runs.classes, "class").groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    return index.rows.join(hit_words(found), "row", "left").join(ids, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op11_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda k: array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' '))) AS run FROM b WHERE len(w) > 0),
p AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS s, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(list_slice(w, k, k + n - 1), ' '))) AS run FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
m AS (SELECT DISTINCT r, s, p.n, item FROM p JOIN i ON p.run = i.run AND p.n = i.n),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS x FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
ORACLE_SQL = {"op11_decontamination": ORACLE}
