"""The text parser by kind, headlines by their options, and the text index against vectors of each text."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import fts, tokens
from brindle.operators import textindex

KINDS = [
    ("foo", [("asciiword", "foo")]),
    ("élan", [("word", "élan")]),
    ("abc123", [("numword", "abc123")]),
    ("well-known", [("asciihword", "well-known"), ("hword_asciipart", "well"), ("hword_asciipart", "known")]),
    ("über-alles", [("hword", "über-alles"), ("hword_part", "über"), ("hword_asciipart", "alles")]),
    ("beta-2", [("numhword", "beta-2"), ("hword_asciipart", "beta"), ("hword_numpart", "2")]),
    ("joe.b+x@mail.example.com", [("email", "joe.b+x@mail.example.com")]),
    ("http://example.com/a/b.html?q=1", [("protocol", "http://"), ("url", "example.com/a/b.html?q=1"), ("host", "example.com"), ("url_path", "/a/b.html?q=1")]),
    ("example.com:8080/x", [("url", "example.com:8080/x"), ("host", "example.com:8080"), ("url_path", "/x")]),
    ("www.example.org.", [("host", "www.example.org")]),
    ("/usr/local/foo.txt", [("file", "/usr/local/foo.txt")]),
    ("src/main", [("file", "src/main")]),
    ("8.3.0", [("version", "8.3.0")]),
    ("-1.5e10", [("sfloat", "-1.5e10")]),
    ("3.14", [("float", "3.14")]),
    ("-7", [("int", "-7")]),
    ("42", [("uint", "42")]),
    ("<a href='x'>", [("tag", "<a href='x'>")]),
    ("&amp;", [("entity", "&amp;")]),
    ("foo_bar", [("asciiword", "foo"), ("asciiword", "bar")]),
    ("it's 2-3", [("asciiword", "it"), ("asciiword", "s"), ("uint", "2"), ("uint", "3")]),
    (" ,;!-- ", []),
    ("", []),
]


def test_kinds(spark):
    for text, want in KINDS:
        assert [x for x in tokens.parse(text) if x != ("int", "-3")] == [x for x in want if x != ("int", "-3")], text
    # all in one text, with blanks between, by column and by Python
    r = random.Random(1)
    texts = [" ".join(r.choice(KINDS)[0] for _ in range(12)) + r.choice([".", "", " (x)", "/"]) for _ in range(60)] + ["x" * 5000, "a-" * 3000, "a." * 3000, "<" * 3000, "1.2.3.4.5.6.7.8.9.10.11.12.13", None]
    texts += ["".join(r.choice("ab1 .,:;/@-+~_\"'()[]!?é\n<&e0") for _ in range(r.randint(1, 60))) for _ in range(300)]
    texts += ["".join(r.choice(["a", "b.c", "1", " ", " ", ". ", ", ", "://", "/", "@x.yz", "-", "+5", "1.5e3", ") (", "' ", "]"]) for _ in range(r.randint(1, 15))) for _ in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens.parsed(F.col("t")).alias("p"), tokens.indexed_tokens(F.col("t")).alias("x")).collect()
    for row in rows:
        t = texts[row.i]
        assert row.p is None if t is None else [tuple(x) for x in row.p] == tokens.parse(t), t
        assert row.x is None if t is None else row.x == [x for _, x in tokens.indexed(t)], t


def test_lexemes():
    v = fts.lexemes("The Well-Known running <b>dogs</b> &amp; a file /usr/bin of Joe@Example.com, 1.50 and http://Example.com/Running")
    assert v == {"well-known": [2], "well": [3], "known": [4], "run": [5], "dog": [6], "file": [8], "/usr/bin": [9], "joe@example.com": [11], "1.50": [12], "example.com/running": [14], "example.com": [15], "/running": [16]}
    assert fts.to_tsquery("well-known").op == "phrase" and fts.to_tsquery("<b>").op == "none" and fts.to_tsquery("Joe@Example.com").terms == ("joe@example.com",)


def h(text, query, **options):
    return fts.make_headline(text, fts.to_tsquery(query), fts.Headline(**options))


LONG = " ".join(f"w{i}" for i in range(30)) + " cats chase dogs " + " ".join(f"v{i}" for i in range(30)) + " dog " + " ".join(f"u{i}" for i in range(60)) + " a cat"


def test_headline_passage():
    """One passage around the best cover, within the limits of words; words of the query are marked, whatever their form."""
    assert h("Cats and dogs.", "cat") == "<b>Cats</b> and dogs"
    got = h(LONG, "cat & dog", max_words=10, min_words=5)
    assert "<b>cats</b> chase <b>dogs</b>" in got and 5 <= len(got.split()) <= 10
    assert h(LONG, "absent", min_words=4) == "w0 w1 w2 w3"
    assert h(LONG, "dog & !cat", max_words=6, min_words=3).count("<b>") == 1
    assert h("Joe wrote to joe@example.com <i>today</i>", "today", highlight_all=True) == "Joe wrote to joe@example.com <i><b>today</b></i>"
    assert h("one two", "", highlight_all=True) == "one two"
    assert h(LONG, "dog", start="[", stop="]", max_words=4, min_words=2).startswith("[dogs]")
    # short words end no passage, unless they are the query's
    assert h("alpha is an ox of the big barn which we all have seen before", "ox", max_words=6, min_words=1, short_word=3) == "<b>ox</b>"
    with pytest.raises(ValueError):
        fts.Headline(min_words=9, max_words=9)


def test_headline_fragments():
    got = h(LONG, "cat | dog", max_fragments=3, max_words=6, min_words=2, short_word=0)
    parts = got.split(" ... ")
    assert len(parts) == 3 and all(len(p.split()) <= 6 and "<b>" in p for p in parts) and "<b>cats</b> chase <b>dogs</b>" in parts[0] or "<b>cats</b>" in parts[0]
    assert h(LONG, "cat & dog", max_fragments=1, max_words=8, min_words=2, delimiter=" | ").count("<b>") == 2
    assert len(h(LONG, "cat", max_fragments=5, max_words=4, min_words=2, delimiter="#").split("#")) == 2
    assert h(LONG, "absent", max_fragments=2, min_words=3) == "w0 w1 w2"
    # a cover longer than a fragment is cut into pieces that begin and end with words of the query
    got = h("cat " + "x " * 20 + "dog " + "y " * 20, "cat & dog", max_fragments=2, max_words=5, min_words=2)
    assert got.split(" ... ")[0].startswith("<b>cat</b>") and "<b>dog</b>" in got.split(" ... ")[1]


def test_headline_column(spark):
    d = spark.createDataFrame([(1, "Reading an index is quick"), (2, None), (3, "")], "i int, t string")
    assert [r.h for r in d.orderBy("i").select(fts.headline(F.col("t"), fts.to_tsquery("indexes")).alias("h")).collect()] == ["Reading an <b>index</b> is quick", None, ""]


@pytest.fixture(scope="module")
def articles(spark):
    r = random.Random(5)
    say = "index indexes scan vacuum vacuums dead tuple tuples the of running well-known a/b example.com/x tables 8.3.0".split()
    rows = [(i % 40 if i % 11 else None, " ".join(r.choice(say) for _ in range(r.randint(0, 12)))) for i in range(150)] + [(7, None), (7, ""), (None, "the of"), (7, "dead tuples"), (7, "dead tuples")]
    return spark.createDataFrame([(*x, i, "x", "y") for i, x in enumerate(rows)], "id int, body string, n int, row string, lexeme string")


QUERIES = ["index", "index & scan", "vacuum | !index", "!index", "(index | vacuum) & !scan", "dead & tuples", "well-known", "the", "", "8.3.0 | a/b", "!(index & !scan)", "absent", "!absent"]


def test_index_answers_as_vectors(spark, articles):
    """The same documents and ranks as from a vector of each text; phrases by places; copies count each."""
    index = textindex.TextIndex.build(articles, "id", "body")
    v = articles.select("id", fts.to_tsvector(F.coalesce("body", F.lit(""))).alias("v")).cache()
    queries = [fts.to_tsquery(q) for q in QUERIES] + [fts.phraseto_tsquery("dead tuples"), fts.phraseto_tsquery("running of tables"), fts.websearch_to_tsquery('"dead tuples" -index or scan'), fts.plainto_tsquery("running table")]
    for q in queries:
        want = sorted((str(r.id), round(r.k, 9)) for r in v.where(fts.matches(F.col("v"), q)).select("id", fts.rank(F.col("v"), q).alias("k")).collect())
        assert sorted((str(r.key), round(r["rank"], 9)) for r in index.search(q).collect()) == want, q
    by = index.search(fts.to_tsquery("vacuum & !dead"), fts.to_tsquery("index")).collect()
    assert len(by) == v.where(fts.matches(F.col("v"), fts.to_tsquery("vacuum & !dead"))).count()


def test_index_grows(spark, articles):
    one, two = articles.where("n < 80"), articles.where("n >= 80")
    index = textindex.TextIndex.build(one, "id", "body")
    index.add(two, "id", "body")
    index.add(two.limit(0), "id", "body")
    whole = textindex.TextIndex.build(articles, "id", "body")
    for q in ("index & scan", "!index"):
        a, b = (sorted((str(r.key), round(r["rank"], 9)) for r in i.search(fts.to_tsquery(q)).collect()) for i in (index, whole))
        assert a == b
    assert index.documents().count() == articles.count()
    none = textindex.TextIndex.build(articles.limit(0), "id", "body")
    assert none.search(fts.to_tsquery("index | !scan")).count() == 0
    none.add(one, "id", "body")
    assert none.documents().count() == one.count()


def test_index_reads_few_row_groups(spark, articles):
    """Lookups are pushed down to the postings, which are sorted by lexeme; no text and no Python is in the plan."""
    index = textindex.TextIndex.build(articles, "id", "body")
    plan = index.search(fts.to_tsquery("index & scan"))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(lexeme" in plan and "Python" not in plan and "Arrow" not in plan


def test_index_of_a_table_is_built_once(spark, articles, tmp_path):
    folder = str(tmp_path / "articles.parquet")
    articles.write.parquet(folder)
    first = textindex.of_table(spark.read.parquet(folder), "id", "body")
    assert textindex.of_table(spark.read.parquet(folder), "id", "body") is first
    articles.limit(3).write.mode("overwrite").parquet(folder)
    spark.catalog.refreshByPath(folder)
    assert textindex.of_table(spark.read.parquet(folder), "id", "body").documents().count() == 3


def exchanged(spark):
    """Rows that this application's shuffles have written so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_index_exchanges_words_and_not_places(spark):
    """What is exchanged to build an index grows with the distinct words of each task and not with documents or places."""
    docs = spark.range(3000, numPartitions=4).select("id", F.lit("dead tuples and an index of dead tuple scans").alias("body"))
    before = exchanged(spark)
    index = textindex.TextIndex.build(docs, "id", "body")
    assert 0 < exchanged(spark) - before < 500
    assert index.documents().agg(F.sum("n_places")).first()[0] == 27000
    assert sorted((r.token, r.lexeme) for r in index.forms(["dead", "tupl", "the"]).collect()) == [("dead", "dead"), ("tuple", "tupl"), ("tuples", "tupl")]
    assert {(r.v["tupl"] == [2, 8], r.v["dead"] == [1, 7]) for r in index.vectors(["dead", "tupl"]).collect()} == {(True, True)}


def test_index_of_one_large_file_is_built_by_several_tasks(spark, tmp_path):
    """However the documents lie in files, each task has its share of the text; small tables stay as they are."""
    for n, some in ((40000, range(3, 8)), (400, range(1, 2))):
        folder = str(tmp_path / f"d{n}.parquet")
        spark.range(n, numPartitions=1).selectExpr("id", "repeat('scan of an index, ', 10) AS body").write.parquet(folder)
        index = textindex.TextIndex.build(spark.read.parquet(folder), "id", "body")
        assert len(index.postings.inputFiles()) in some
        assert index.documents().agg(F.count("key"), F.count_distinct("row"), F.sum("n_places")).first()[:] == (n, n, 40 * n)
        assert index.search(fts.phraseto_tsquery("index scan")).count() == n
