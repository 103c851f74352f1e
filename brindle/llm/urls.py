r"""URL filters: hand-written rules first, mined association rules for the urls that no rule fits.

The hand-written rules label the urls that they fit. Spark's FP-growth mines token combinations of those urls together with
their label; combinations that imply one label with enough support and confidence become rules, and an inverted index from
token to rule finds the rules whose tokens a url has. A rule names a host, or a part of one: the hand-written rules are the only
labels, and what a path has on their hosts says nothing of others'. It must also imply its label more often than that stands anyway.

Defined results: a null url or one without ``://`` has an empty host and path, no rule, and is allowed unless a mined rule of
no tokens exists (none does); repeated rows are judged alike; without any labelled url nothing is mined and all unruled urls
are allowed; of rules that match, the one of highest confidence decides, then support, then block; extra columns are ignored
by ``judge``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, fold

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.0
#: Tokens of a rule, its label not counted: a parameter of the rules that are wanted.
MAX_TOKENS = 3
#: FP-growth fits on at most about so many labelled urls, chosen by the hash of the url.
FIT_ROWS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return fold(host), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(verdict, rule), or null."""
    def fits(rule: str) -> Column:
        at = rule.index("/")
        return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])

    cases = [F.when(fits(r), F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule"))) for v, r in sorted(rules, key=lambda x: -len(x[1]))]
    return reduce(lambda a, b: F.coalesce(a, b), cases)


def tokens(host: Column, path: Column) -> Column:
    """What a url is made of, once each: host labels by place from the end, and path segments with # for their digits."""
    labels = F.reverse(F.split(host, r"\."))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    named = F.transform(segments, lambda x: F.when(x.rlike(r"^[0-9]+$"), F.lit("#")).otherwise(F.regexp_replace(x, "[0-9]+", "#")))
    return F.array_distinct(
        F.concat(
            F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
            F.transform(named, lambda x: F.concat(F.lit("p:"), x)),
        )
    )


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path"))
    return d.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))


def mine(labelled: DataFrame) -> DataFrame:
    """(rule_id, tokens, label, confidence, support) of the rules that hold among rows of (tokens, verdict)."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("label="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=MIN_SUPPORT, minConfidence=MIN_CONFIDENCE).fit(items)
    r = model.associationRules.where(F.element_at("consequent", 1).startswith("label=") & (F.size("antecedent") <= MAX_TOKENS))
    r = r.where(~F.exists("antecedent", lambda x: x.startswith("label=")) & F.exists("antecedent", lambda x: x.startswith("h")) & (F.col("lift") > MIN_LIFT))
    key = F.array_sort("antecedent")
    return r.select(F.md5(F.array_join(key, "\n")).alias("rule_id"), key.alias("tokens"), F.substring(F.element_at("consequent", 1), 7, 10).alias("label"), "confidence", "support")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the mined rule's tokens (in order, between spaces) and confidence where one
    decides."""
    d = parsed(pages, rules)
    labelled = durable(d.where("fit IS NOT NULL").select(tokens(F.col("host"), F.col("path")).alias("tokens"), F.col("fit.verdict").alias("verdict"), F.xxhash64("url").alias("h")))
    n = labelled.count()
    if n > FIT_ROWS:
        labelled = labelled.where(F.pmod("h", F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    none = d.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"))
    nobody = (F.lit(None).cast("string").alias("mined_rule"), F.lit(None).cast("double").alias("confidence"))
    if n == 0:
        return none.select("*", *nobody).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    mined = durable(mine(labelled))
    index = mined.select("rule_id", F.explode("tokens").alias("token"))
    # unruled urls with the same tokens get the same verdict: each token set is matched once
    todo = d.where("fit IS NULL").select(tokens(F.col("host"), F.col("path")).alias("tokens"))
    sets = todo.withColumn("set_id", F.sha2(F.array_join(F.array_sort("tokens"), "\n"), 256)).groupBy("set_id").agg(F.any_value("tokens").alias("tokens"))
    hits = sets.select("set_id", F.explode("tokens").alias("token")).join(index, "token").groupBy("set_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))
    best = (
        hits.join(mined, "rule_id")
        .where(F.col("n") == F.size("tokens"))
        .groupBy("set_id")
        .agg(F.max(F.struct("confidence", "support", (F.col("label") == "block").cast("int").alias("block"), "label", "tokens")).alias("best"))
    )
    # the other side's key is not that of its groups: both are exchanged for the join, and a hot set of tokens can be split
    best = best.select(F.concat(F.lit("s"), "set_id").alias("of"), "best")
    set_id = F.when(F.col("fit").isNull(), F.sha2(F.array_join(F.array_sort(tokens(F.col("host"), F.col("path"))), "\n"), 256))
    # a ruled row's null set_id joins nothing; salted, as null keys would all meet in one task
    rows = d.withColumn("set_id", F.coalesce(set_id, F.concat(F.lit("ruled"), F.xxhash64("url").cast("string"))))
    out = rows.join(best, F.concat(F.lit("s"), "set_id") == F.col("of"), "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "best.label", F.lit("allow")).alias("verdict"),
        F.array_join("best.tokens", " ").alias("mined_rule"),
        F.col("best.confidence").alias("confidence"),
    )


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_url_filters": op4_url_filters}
#: Combinations are listed and counted one by one, which small tables allow; the rules are those of the sample of all rows.
ORACLE = r"""
WITH a AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, r, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, '.' || host AS dotted FROM b),
d AS (SELECT *, CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    list_filter(list_reverse(string_split(host, '.')), lambda x: x <> '') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segments FROM c),
t AS (SELECT r, page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS fixed,
    list_sort(list_distinct(list_concat(list_transform(generate_series(1, len(labels)), lambda i: 'h' || (i - 1) || ':' || labels[i]),
        list_transform(segments, lambda x: 'p:' || CASE WHEN regexp_full_match(x, '[0-9]+') THEN '#' ELSE regexp_replace(x, '[0-9]+', '#', 'g') END)))) AS tokens FROM d),
u AS (SELECT r, fixed, unnest(tokens) AS token FROM t),
s AS (SELECT r, fixed, [token] AS set FROM u UNION ALL SELECT x.r, x.fixed, [x.token, y.token] FROM u x JOIN u y ON x.r = y.r AND x.token < y.token
    UNION ALL SELECT x.r, x.fixed, [x.token, y.token, z.token] FROM u x JOIN u y ON x.r = y.r AND x.token < y.token JOIN u z ON y.r = z.r AND y.token < z.token),
n AS (SELECT count(*) AS n FROM t WHERE fixed IS NOT NULL),
v AS (SELECT fixed AS label, count(*) AS n_label FROM t WHERE fixed IS NOT NULL GROUP BY fixed),
k AS (SELECT array_to_string(set, ' ') AS rule_tokens, count(*) AS n_set, count(*) FILTER (WHERE fixed = 'allow') AS allow, count(*) FILTER (WHERE fixed = 'block') AS block FROM s WHERE fixed IS NOT NULL GROUP BY set),
m AS (SELECT rule_tokens, label, CASE label WHEN 'allow' THEN allow ELSE block END AS n_both, n_set, n_label, n.n FROM k, v, n),
g AS (SELECT rule_tokens, label, n_both::DOUBLE / n_set AS confidence, n_both::DOUBLE / n AS support FROM m
    WHERE n_both > 0 AND n_both >= ceil(0.01::DOUBLE * n) AND n_both::DOUBLE / n_set >= 0.8 AND (n_both::DOUBLE / n_set) / (n_label::DOUBLE / n) > 1 AND regexp_matches(' ' || rule_tokens, ' h[0-9]')),
h AS (SELECT s.r, max(struct_pack(confidence := confidence, support := support, block := (label = 'block')::INT, label := label, tokens := rule_tokens)) AS best FROM s JOIN g ON array_to_string(s.set, ' ') = rule_tokens WHERE s.fixed IS NULL GROUP BY s.r)
SELECT page_id, host, path, rule, coalesce(fixed, best.label, 'allow') AS verdict, best.tokens AS mined_rule, best.confidence AS confidence FROM t LEFT JOIN h ON h.r = t.r
"""
ORACLE_SQL = {"op4_url_filters": ORACLE}
