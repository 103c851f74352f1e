r"""Line-first quality rules, in built-in functions only.

Each line is judged by itself: as navigation (short segments between bars or arrows), as boilerplate (notices and script
messages), as a shout or symbol line, and by its closing punctuation. Lines that fail are removed; a document that loses too
much of its text is rejected.

A document that is kept goes on without its failed lines.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a blank line neither passes nor
fails; documents are judged one by one, so repeated rows are judged alike; extra columns are ignored by ``measure`` and kept
by ``keep``. A text of one very long line is one line.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, packed

SPACES = r"[\x20\x09-\x0D]+"

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected if fewer than so many percent of its words stand in lines that pass.
MIN_KEPT_PERCENT = 50
#: A line fails with a symbol for every so many words, or fewer.
WORDS_PER_SYMBOL = 4
#: A line without closing punctuation passes with so many words; shorter ones are headings, menus or fragments.
MIN_OPEN_WORDS = 8
CLOSING = (".", "!", "?", ":", ";", "…", "。", "！", "？", "।", "؟", '"', "'", "”", "’", "»", ")", "]")
#: A line of so many bars or arrows is navigation, unless so many words stand between each two.
BARS, MIN_BARS, WORDS_PER_BAR = "|>", 3, 6
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookies policy", "cookie settings", "cookies settings", "enable javascript", "lorem ipsum", "click here", "sign in", "log in", "subscribe to")
NOTICE = "(?i)(?:" + "|".join(BOILERPLATE) + ")"
#: A line with a notice fails unless it has so many words for each one: in a long line a notice is a part, not the line.
WORDS_PER_NOTICE = 24
#: Words of capitals with shouting marks, line by line: most of a line's words.
SHOUT = r"(?<![^\x20\x09-\x0D])[^\p{Ll}\x20\x09-\x0D]*\p{Lu}[^\p{Ll}\x20\x09-\x0D]*!(?![^\x20\x09-\x0D])"


def once(d: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows with the value as a column that later steps read; the generator keeps the optimizer from copying its expression into each of them."""
    return d.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is evaluated once: an array that a lambda reads at each step is else built at each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(words: Column) -> Column:
    """Hashes of the windows of three words, in order."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    three = let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    return F.when(F.size(words) < 4, F.array().cast("array<bigint>")).otherwise(three)


def covered(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more, the first occurrence included: sorted by hash, equal windows are
    neighbours; sorted by place, each repeated window adds what the next one does not cover."""
    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    twice = let(pairs, lambda s: F.filter(s, lambda p, k: (k > 0) & (p["x"] == F.get(s, k - 1)["x"]) | (p["x"] == F.get(s, k + 1)["x"])))
    places = F.array_sort(F.transform(twice, lambda p: p["i"]))
    steps = let(places, lambda a: F.transform(a, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - p, F.lit(3)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_passes(line: Column, n_symbols: Column, notices: Column) -> Column:
    """A line with a word stays if every rule lets it pass. n_symbols, notices: of the whole text; without any, three rules have
    nothing to count. Each rule begins with its cheapest test, as most lines of prose pass on it."""
    bare = F.rtrim(line, F.lit(SPACE))
    words = F.size(F.split(F.ltrim(bare, F.lit(SPACE)), SPACES))
    bars = F.regexp_count(line, F.lit(f"[{BARS}]"))
    closed = reduce(lambda a, b: a | b, [bare.endswith(x) for x in CLOSING])
    return (
        ((n_symbols == 0) | ((F.regexp_count(line, F.lit(f"[{SYMBOLS}]")) * WORDS_PER_SYMBOL < words) & ((bars < MIN_BARS) | (words >= WORDS_PER_BAR * bars))))
        & (closed | (words >= MIN_OPEN_WORDS))
        & (~notices | ~line.rlike(NOTICE) | (F.regexp_count(line, F.lit(NOTICE)) * WORDS_PER_NOTICE <= words))
        & (~line.contains("!") | (F.regexp_count(line, F.lit(SHOUT)) * 2 < words))
    )


def judge(docs: DataFrame, *beside: str) -> DataFrame:
    """The columns ``beside`` and one more, ``q``: every measure and both verdicts, and the text without its failed lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.struct(
        words_of(text).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SPACE)) != "").alias("lines"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        let(F.lower(text), lambda x: reduce(lambda a, b: a | b, [x.contains(n) for n in BOILERPLATE])).alias("notices"),
    )
    d = once(docs.select(*beside, "text"), parts, "p")
    d = once(d, F.struct(windows(F.col("p.words")).alias("tri"), F.filter("p.lines", lambda x: line_passes(x, F.col("p.n_symbols"), F.col("p.notices"))).alias("good")), "g")
    repeats = F.size(F.array_distinct("g.tri")) < F.size("g.tri")
    no_line_fails = F.size("g.good") == F.size("p.lines")
    clean = F.array_join("g.good", "\n")
    measures = F.struct(
        F.size("p.words").cast("long").alias("n_words"),
        F.aggregate("p.words", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w)).alias("word_chars"),
        F.col("p.n_symbols").alias("n_symbols"),
        (F.size("p.lines") - F.size(F.array_distinct("p.lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered(F.col("g.tri"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("p.lines").cast("long").alias("n_lines"),
        (F.size("p.lines") - F.size("g.good")).cast("long").alias("n_failed_lines"),
        F.when(no_line_fails, F.size("p.words")).otherwise(F.size(words_of(clean))).cast("long").alias("n_kept_words"),
        F.when(no_line_fails, text).otherwise(clean).alias("clean_text"),
    )
    d = once(d, measures, "m")
    failed = (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))
    lost = 100 * F.col("m.n_kept_words") < MIN_KEPT_PERCENT * F.col("m.n_words")
    return d.select(*beside, F.struct("m.*", failed.alias("base_failed"), (~failed & ~lost).alias("kept")).alias("q"))


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: the measures, ``base_failed``, ``kept`` and ``clean_text`` (what the line rules leave; the text as
    it came where no line fails)."""
    return judge(docs, "doc_id").select("doc_id", "q.*")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failed lines: ``text`` is the clean text, and ``n_chars``, where there is such a
    number, its length; all other columns are as they came."""
    kept = judge(packed(docs, "text"), "row").where("q.kept")
    clean = F.col("q.clean_text")
    changed = F.col("q.n_failed_lines") > 0
    length = {c: F.when(changed, F.char_length(clean)).otherwise(F.col(f"row.`{c}`")).cast(kind) for c, kind in docs.dtypes if c == "n_chars" and kind in ("int", "bigint")}
    return kept.select(*[clean.alias(c) if c == "text" else length[c].alias(c) if c in length else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The measures, with the clean text's digest in its place."""
    return measure(documents(spark, sf_dir)).withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS three FROM a WHERE len(w) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, three) AS c FROM i),
p AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY r),
l AS (SELECT r, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM a WHERE len(lines) > 0),
m AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|>]')) AS bars,
    len(regexp_extract_all(lower(line), 'all rights reserved|terms of (?:use|service)|privacy policy|cookies? (?:policy|settings)|enable javascript|lorem ipsum|click here|sign in|log in|subscribe to')) AS notices,
    right(regexp_replace(line, '[\x20\x09-\x0D]+$', ''), 1) AS final FROM l),
n AS (SELECT r, i, line, len(w) AS words, symbols * 4 < len(w) AND (bars < 3 OR len(w) >= 6 * bars) AND (final IN ('.', '!', '?', ':', ';', '…', '。', '！', '？', '।', '؟', '"', chr(39), '”', '’', '»', ')', ']') OR len(w) >= 8)
    AND (notices = 0 OR notices * 24 <= len(w)) AND 2 * len(list_filter(w, lambda x: regexp_full_match(x, '[^\p{Ll}]*\p{Lu}[^\p{Ll}]*!'))) < len(w) AS good FROM m),
k AS (SELECT r, count(*) FILTER (WHERE NOT good) AS n_failed_lines, coalesce(sum(words) FILTER (WHERE good), 0) AS n_kept_words, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE good), '') AS clean FROM n GROUP BY r),
q AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words,
    sha256(CASE WHEN coalesce(n_failed_lines, 0) = 0 THEN t ELSE clean END) AS clean_sha256 FROM a LEFT JOIN p ON p.r = a.r LEFT JOIN k ON k.r = a.r)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 50 * n_words AS kept FROM q
"""
ORACLE_SQL = {"op6_quality_rules": ORACLE}
