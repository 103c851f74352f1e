"""Operators and functions that no registered query shows whole: errors, awkward values, fixtures."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from brindle.functions import fts, ranges, values
from brindle.operators import authz, selection, telemetry, writes
from brindle.sources import tables


def one(df):
    return df.first()[0]


@pytest.fixture()
def school(spark):
    author = spark.createDataFrame([("a1", "ada", "london"), ("a2", "grace", "new york"), ("a3", "linus", "helsinki")], "id string, name string, city string")
    book = spark.createDataFrame([("b1", "notes on the engine", 1843, "a1"), ("b2", "on looms", 1845, "a1"), ("b3", "the compiler", 1952, "a2")], "id string, title string, year int, author_id string")
    types = {
        "Author": selection.Type(author, {"books": selection.Link("Book", "id", "author_id", "year", {"before": lambda v: F.col("year") < v})}, {"secret": "not allowed"}),
        "Book": selection.Type(book),
    }
    return types, {"author": selection.Root("Author", {"id": lambda v: F.col("id") == v}), "authors": selection.Root("Author", {}, {"city": lambda v: F.col("city") == v})}


def test_selection(school):
    types, roots = school
    text = 'query Q($id: ID!, $before: Int = 1845) { author(id: $id) { ...who works: books(before: $before) { title } all: books { year } secret } others: authors(city: "new york") { name } } fragment who on Author { name home: city }'
    found = selection.run(text, types, roots, {"id": "a1", "before": 1845})
    r = found["author"].collect()
    assert [x.asDict(recursive=True) for x in r] == [{"node": {"name": "ada", "home": "london", "works": [{"title": "notes on the engine"}], "all": [{"year": 1843}, {"year": 1845}], "secret": None}, "errors": ["secret: not allowed"]}]
    assert [x.node.name for x in found["others"].collect()] == ["grace"]
    assert selection.run("{ authors { name books { title } } }", types, roots)["authors"].where("node.name = 'linus'").first().node.books == []
    assert selection.depth(selection.parse(text).inner) == 2


@pytest.mark.parametrize(
    "text, variables",
    [
        ("{ authors { nam } }", {}),
        ("{ author { name } }", {}),
        ("query Q($id: ID!) { author(id: $id) { name } }", {}),
        ("{ author(id: $id) { name } }", {"id": "a1"}),
        ("{ authors { books } }", {}),
        ("{ authors { name { first } } }", {}),
        ("{ authors { ...no } }", {}),
        ("{ authors { ...a } } fragment a on Author { ...a }", {}),
        ("{ writers { name } }", {}),
        ("{ authors { name }", {}),
        ("", {}),
    ],
)
def test_selection_rejects(school, text, variables):
    with pytest.raises(selection.QueryError):
        selection.run(text, *school, variables)


def test_lookup(school):
    authors = school[0]["Author"].rows
    assert one(selection.found_or_error(authors.where("id = 'a1'"), "a1")) == "a1"
    with pytest.raises(PySparkException, match="not found: a9"):
        selection.found_or_error(authors.where("id = 'a9'"), "a9").collect()


def test_add_with_key(school):
    types, _ = school
    row = lambda author: {"title": F.lit("more"), "year": F.lit(1900), "author_id": F.lit(author)}
    new, added = writes.add_with_key(types["Book"].rows, row("a2"), "id", "b", "author_id", types["Author"].rows, "id")
    assert one(added) == "b4" and new.count() == 4
    with pytest.raises(PySparkException, match="no such id: a9"):
        writes.add_with_key(types["Book"].rows, row("a9"), "id", "b", "author_id", types["Author"].rows, "id")[1].collect()


def test_upload_and_relay(spark):
    old = spark.createDataFrame([("b1", "one"), ("b2", "two")], "id string, title string")
    sent = spark.createDataFrame([("b2", "2", 1), ("b3", "", 2), ("b2", "zwei", 3)], "id string, title string, seq int")
    new, summary = writes.upload(old, sent, "id", "seq", F.col("title") != "")
    assert tuple(summary.first()) == (2, 1) and {tuple(r) for r in new.collect()} == {("b1", "one"), ("b2", "zwei")}
    box = spark.createDataFrame([(i, f"order {i}", None) for i in range(1, 5)], "id int, payload string, published_at timestamp")
    seen = []
    for _ in range(3):
        sent, box = writes.relay(box, 2, "id", "published_at", F.current_timestamp())
        seen.append([r.id for r in sent.orderBy("id").collect()])
    assert seen == [[1, 2], [3, 4], []]


def test_policies(spark):
    notes = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "alice")], "id int, owner string")
    p = authz.Policy(lambda name: F.col("owner") == name)
    alice = authz.Principal("alice", privileges=frozenset({"select", "insert"}))
    new = spark.createDataFrame([(4, "alice")], notes.schema)
    assert p.read(p.insert(notes, new, alice), alice).count() == 3
    with pytest.raises(PermissionError, match="row-level"):
        p.insert(notes, spark.createDataFrame([(5, "bob")], notes.schema), alice)
    with pytest.raises(PermissionError, match="denied"):
        p.read(notes, authz.Principal("eve"))
    owner = authz.Principal("alice", owner=True)
    assert p.read(notes, owner).count() == 3 and authz.Policy(p.using, force=True).read(notes, owner).count() == 2
    assert authz.Policy(p.using, force=True).read(notes, authz.Principal("root", superuser=True)).count() == 3


def test_store_and_paths(spark):
    rows = [("document", "design", "owner", "user", "alice"), ("document", "readme", "viewer", "team", "core"), ("team", "core", "member", "user", "dave")]
    s = authz.Store(spark.createDataFrame(rows[:1], "object_type string, object_id string, relation string, subject_type string, subject_id string"), authz.IMPLIES)
    assert s.list_objects("dave", "viewer", "document").count() == 0
    s = s.write(spark.createDataFrame(rows[1:], s.tuples.schema))
    assert [r.object for r in s.list_objects("dave", "viewer", "document").collect()] == ["document:readme"]
    assert [r.path for r in authz.explain_check(s.tuples, "dave", "viewer", "readme").collect()] == [["user:dave", "team:core#member", "viewer"]]


def test_recorder_and_calls(spark):
    r = telemetry.Recorder(spark)
    with r.span("GET /orders", route="/orders"):
        with r.span("postgres query"):
            with r.span("redis lookup"):
                pass
        with pytest.raises(ValueError), r.span("call payments"):
            raise ValueError("timeout")
    got = {x.name: (x.parent_name, x.status) for x in telemetry.with_parent_name(r.spans()).collect()}
    assert got == {"GET /orders": ("(root)", "Ok"), "postgres query": ("GET /orders", "Ok"), "redis lookup": ("postgres query", "Ok"), "call payments": ("GET /orders", "Error")}
    assert telemetry.orphan_spans(r.spans()).count() == 0
    seen = []
    calls = telemetry.Calls(lambda name, go: (seen.append(name), go())[1])
    sql = calls.around(spark.sql)
    assert [one(sql(f"SELECT {i}")) for i in range(3)] == [0, 1, 2] and calls.counts == {"sql": 3} and seen == ["sql"] * 3


def test_observed(spark):
    df, seen = telemetry.observed(spark.range(10), "rows", n=F.count(F.lit(1)), top=F.max("id"))
    assert df.where("id < 3").count() == 3 and seen.get == {"n": 10, "top": 9}


def test_extensions(spark):
    from brindle.functions import extensions

    with pytest.raises(ValueError):
        extensions.load(spark, "none")
    assert set(extensions.load(spark, "trigrams", "maps")) == {"show_trgm", "similarity", "hstore", "akeys"}
    r = spark.sql("SELECT similarity('postgres', 'postgresql') AS s, similarity('', '') AS z, show_trgm('cat') AS t, akeys(hstore('b=>2, a=>1')) AS k").first()
    assert r.s == pytest.approx(2 / 3) and r.z == 0.0 and sorted(r.t) == ["  c", " ca", "at ", "cat"] and r.k == ["a", "b"]


def test_json_changes(spark):
    d = spark.createDataFrame([(1, '{"a":{"b":1},"t":["x"]}'), (2, "[1]"), (3, "7"), (4, "nope"), (5, None), (6, "")], "id int, d string")
    get = lambda c: {r.id: r.v for r in d.select("id", c.alias("v")).collect()}
    assert get(values.json_set(F.col("d"), ("a", "b"), 2)) == {1: '{"a":{"b":2},"t":["x"]}', 2: "[1]", 3: "7", 4: None, 5: None, 6: None}
    assert get(values.json_set(F.col("d"), ("no", "b"), 2))[1] == '{"a":{"b":1},"t":["x"]}'
    assert get(values.json_set(F.col("d"), (5,), 2))[2] == "[1,2]"
    assert get(values.json_merge(F.col("d"), '{"z":1}', ("a",))) == {1: '{"t":["x"],"z":1}', 2: '[1,{"z":1}]', 3: '[7,{"z":1}]', 4: None, 5: None, 6: None}
    assert get(values.json_kind(F.col("d"))) == {1: "object", 2: "array", 3: "scalar", 4: None, 5: None, 6: None}


@pytest.mark.parametrize(
    "doc, literal, holds",
    [('{"a":1.0}', '{"a":1}', True), ('{"a":1}', '{"a":1.00}', True), ('["a","b"]', '"a"', True), ('[["a"]]', '["a"]', False), ('[["a","b"],3]', '[["a"]]', True), ("[1,2,3]", "[3,1,1]", True), ('{"a":"1"}', '{"a":1}', False), ('{"a":null}', '{"a":null}', True),
     ("{}", '{"a":null}', False), ('{"a":{"b":[1,{"c":true}]},"d":2}', '{"a":{"b":[{"c":true}]}}', True), ("1e2", "100", True), ("[1]", "[]", True), ("{}", "{}", True), ("[]", "{}", False), ('"a"', '["a"]', False), ("12345678901234567890.1230", "12345678901234567890.123", True), ("100", "1e2", True), ("[100.0,-0]", "[1e2,0]", True), ("true", "1", False), ("0.5", "0.50", True), ("10", "1", False), ("nope", "{}", None)],
)
def test_json_contains(spark, doc, literal, holds):
    assert one(spark.createDataFrame([(doc,)], "d string").select(values.json_contains(F.col("d"), literal))) == holds


def test_json_in_the_jvm(spark):
    """Digits are kept, no Python runs, NaN is no JSON, repeated keys are."""
    d = spark.createDataFrame([(1, '{"n":12345678901234567890.123,"a":[1,[2,3]]}')], "id int, d string")
    out = d.select(values.json_set(F.col("d"), ("a", 1, -1), {"x": [None, True]}).alias("s"), values.json_merge(F.col("d"), '{"b":0.10}', ("a",)).alias("m"))
    assert tuple(out.first()) == ('{"a":[1,[2,{"x":[null,true]}]],"n":12345678901234567890.123}', '{"b":0.1,"n":12345678901234567890.123}')
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    kinds = {'{"a":1,"a":2}': "object", '[{"a":1,"a":2}]': "array", "NaN": None, "-Infinity": None, "[NaN]": None, '{"a":1,"a":NaN}': None, '{"a":1,"a":2} x': None, '{"a":1,"a":2}]': None, '{"a":1,"a":2}],{"b":1}': None, '{"a":1,"a":2}},{"b":1}': None, ' {"a":1,"a":2}\n': "object", "{'a':1,'a':2}": None, "null": "scalar", "": None, '{"a":1': None, "1 2": None}
    rows = spark.createDataFrame([(k,) for k in kinds], "d string").select("d", values.json_kind(F.col("d")).alias("k"), values.json_unique_keys(F.col("d")).alias("u")).collect()
    assert {r.d: r.k for r in rows} == kinds and {r.d for r in rows if r.u} == {"null"}
    more = spark.createDataFrame([('["x","y",1]',), ('"s"',), ("{}",)], "d string").select(values.json_merge(F.col("d"), "[2]", ("x",)).alias("l"), values.json_merge(F.col("d"), "{}", ("x",)).alias("o"), values.json_set(F.col("d"), (0,), "z").alias("s"))
    assert [tuple(r) for r in more.collect()] == [('["y",1,2]', '["y",1,{}]', '["z","y",1]'), ('["s",2]', '["s",{}]', '"s"'), ("[{},2]", "{}", '{"0":"z"}')]


@pytest.mark.parametrize("word, stem", [x.split(":") for x in "running:run indexes:index tables:tabl reclaims:reclaim quickly:quick cats:cat generalization:general consistency:consist knightly:knight hoping:hope hopping:hop dying:die news:news agreed:agre conditional:condit sky:sky y:y by:by toy:toy flies:fli succeeding:succeed".split()])
def test_stems(word, stem):
    assert fts.stem(word) == stem


def test_full_text_queries(spark):
    rows = [(1, "Postgres indexes: an index on a table makes reads quick"), (2, "Running vacuum reclaims the space of dead tuples in a table"), (3, "Writing queries that scan an index")]
    d = spark.createDataFrame(rows, "id int, body string").select("id", "body", fts.to_tsvector(F.col("body")).alias("v"))
    hits = lambda q: [r.id for r in d.where(fts.matches(F.col("v"), q)).orderBy("id").collect()]
    assert hits(fts.to_tsquery("index")) == [1, 3] and hits(fts.to_tsquery("reclaim")) == [2]
    assert hits(fts.to_tsquery("index & scan")) == [3] and hits(fts.to_tsquery("!index")) == [2] and hits(fts.to_tsquery("(index | vacuum) & !scan")) == [1, 2]
    assert hits(fts.phraseto_tsquery("dead tuples")) == [2] and hits(fts.phraseto_tsquery("space of dead")) == [2] and hits(fts.phraseto_tsquery("tuples dead")) == []
    assert hits(fts.websearch_to_tsquery('"table" -vacuum')) == [1] and hits(fts.websearch_to_tsquery("scan or dead")) == [2, 3] and hits(fts.plainto_tsquery("tables reading")) == [1]
    for q in (fts.to_tsquery(""), fts.to_tsquery("the & of"), fts.websearch_to_tsquery(""), fts.websearch_to_tsquery("the or of"), fts.phraseto_tsquery("")):
        assert hits(q) == [] and one(d.select(fts.rank(F.col("v"), q))) == 0.0
    assert hits(fts.to_tsquery("the & index")) == [1, 3]
    for bad in ("a &", "| a", "(a", "a b", "a )"):
        with pytest.raises(ValueError):
            fts.to_tsquery(bad)
    both = {r.id: r.k for r in d.select("id", fts.rank(F.col("v"), fts.to_tsquery("dead & tuples")).alias("k")).collect()}
    assert both[2] == pytest.approx((0.01 / (1.005 + 0.05 * 2.718281828459045 ** (1 / 1.5 - 2))) ** 0.5) and both[1] == pytest.approx(1e-20)
    marked = {r.id: r.h for r in d.select("id", fts.headline(F.col("body"), fts.to_tsquery("indexing")).alias("h")).collect()}
    assert marked[1] == "Postgres <b>indexes</b>: an <b>index</b> on a table makes reads quick" and "<b>" not in marked[2]


def test_ranges_reject(spark):
    r = lambda a, b: ranges.make(F.lit(a), F.lit(b))
    d = spark.range(1)
    assert one(d.select(ranges.render(ranges.difference(r(1, 10), r(5, 20))))) == "[1,5)"
    for bad in (ranges.difference(r(1, 10), r(3, 4)), ranges.make(F.lit(5), F.lit(1))):
        with pytest.raises(PySparkException):
            d.select(bad).collect()
    assert one(d.select(ranges.coalesced(F.array(r(5, 8), r(1, 5), r(9, 10))))) == [(1, 8), (9, 10)]


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    with pytest.raises(TypeError):
        tables.contract(d, "id int, name int")
    assert tables.introspect(d)[0]["name"] == "id" and [tuple(r)[1:3] for r in tables.fields(d).collect()] == [("id", "int"), ("name", "string")]
    folder = str(tmp_path / "rows")
    assert tables.append(d, folder).count() == 2 and tables.append(d.where("id = 1"), folder).count() == 3
    s = [r.bytes for r in tables.sizes(spark.read.parquet(folder)).collect()]
    assert s == sorted(s, reverse=True) and min(s) > 0
    assert list(tables.emit(d.orderBy("id"))) == [{"id": 1, "name": "a"}, {"id": 2, "name": None}]
    tables.as_json_lines(d, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2


def test_table_lifecycle(spark):
    for statement in ("DROP TABLE IF EXISTS brindle_life", "CREATE TABLE brindle_life (id INT, state STRING) USING parquet", "INSERT INTO brindle_life SELECT id, 'new' FROM range(3)", "ANALYZE TABLE brindle_life COMPUTE STATISTICS"):
        tables.run_script(spark, statement)
    assert "3 rows" in " ".join(str(r[1]) for r in spark.sql("DESCRIBE EXTENDED brindle_life").collect())
    spark.sql("TRUNCATE TABLE brindle_life")
    assert spark.table("brindle_life").count() == 0
    spark.sql("DROP TABLE brindle_life")
    assert not spark.catalog.tableExists("brindle_life")


def test_transactions_of_tables(spark, tmp_path):
    from brindle.sources.database import Conflict, Database

    d = Database(spark, str(tmp_path / "db"))
    orders = spark.createDataFrame([(1, 10), (2, 20)], "id int, total int")
    t = d.begin()
    t.write("orders", orders)
    t.write("outbox", orders.select("id"))
    with pytest.raises(KeyError):
        d.read("orders")  # nothing is seen before the commit
    assert t.commit() == 1 and d.read("orders").count() == d.read("outbox").count() == 2
    t = d.begin()
    t.write("orders", t.read("orders").where("id = 1"))
    t.drop("outbox")
    assert t.read("orders").count() == 1 and d.read("orders").count() == 2
    t.rollback()
    assert t.read("orders").count() == 2 and d.latest() == 1
    one, two = d.begin(), d.begin()
    one.write("orders", orders.where("id = 2"))
    two.write("outbox", orders.select("id").limit(0))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert [r.id for r in d.read("orders").collect()] == [2] and d.read("outbox").count() == 2 and d.read("orders", 1).count() == 2


def test_locks():
    from brindle.sources.database import Locks

    k = Locks()
    assert k.acquire("a", "jobs") and k.acquire("a", "jobs") and not k.acquire("b", "jobs")
    assert k.release("a", "jobs") and not k.acquire("b", "jobs") and k.release("a", "jobs") and k.acquire("b", "jobs")
    assert not k.release("a", "jobs") and not k.release("a", "none")


def test_inet_rejects(spark):
    from brindle.functions import ranges

    good = spark.createDataFrame([("0.0.0.0",), ("255.255.255.255/32",), ("10.1.2.3/0",), (None,)], "t string").select(ranges.inet(F.col("t")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in good] == [(0, 32), (2**32 - 1, 32), (10 * 2**24 + 2**16 + 2 * 256 + 3, 0), None]
    for bad in ("300.1.1.1", "1.2.3", "1.2.3.4/33", "1.2.3.4.5", "a.b.c.d", "", "01.2.3.4"):
        with pytest.raises(Exception, match="invalid input syntax for type inet"):
            spark.createDataFrame([(bad,)], "t string").select(ranges.inet(F.col("t"))).collect()


def test_changes_with_repeated_keys(spark):
    """What a row would become depends on the order: an error, or by order where there is one. Null keys equal none."""
    from brindle.sources import tables

    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    twice = spark.createDataFrame([("a", 5), ("a", 6)], "k string, v int")
    for new in (lambda: writes.upsert(old, twice, ["k"], {"v": lambda o, n: n("v")})[0], lambda: writes.merge(old, twice, ["k"], {"v": lambda o, n: n("v")})[0], lambda: tables.StateStore.of(spark).save(twice.select(F.col("k").alias("key"), F.col("v").cast("string").alias("value"))).rows):
        with pytest.raises(Exception, match="second time"):
            new().collect()
    nulls = spark.createDataFrame([(None, 5), (None, 6), ("b", 7)], "k string, v int")
    assert writes.upsert(old, nulls, ["k"], {"v": lambda o, n: n("v")})[0].count() == 4
    state = spark.createDataFrame([("x", "old", 1)], "key string, value string, version long")
    asks = spark.createDataFrame([("x", "p", 1, 1), ("x", "q", 1, 2), ("x", "r", 2, 3), ("x", "s", 2, 4), ("y", "n", 0, 1), ("y", "m", 0, 2), ("z", "w", 1, 1)], "key string, value string, expected int, seq int")
    with pytest.raises(Exception, match="second time"):
        writes.compare_and_set(state, asks)[1].collect()
    new, judged = writes.compare_and_set(state, asks.repartition(3), "seq")
    assert sorted((r.key, r.value, r.accepted) for r in judged.collect()) == [("x", "p", True), ("x", "q", False), ("x", "r", True), ("x", "s", False), ("y", "m", False), ("y", "n", True), ("z", "w", False)]
    assert sorted(tuple(r) for r in new.collect()) == [("x", "r", 3), ("y", "n", 1)]
    one_each = writes.compare_and_set(state, asks.where("seq = 1"))
    assert sorted(tuple(r) for r in one_each[0].collect()) == [("x", "p", 2), ("y", "n", 1)]


def test_numbered(spark):
    """Whole numbers in order without gaps, over many ranges; ties get a number each."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), (F.col("id") % 3).alias("__n")).repartition(9)
    got = [(r.k, r.no) for r in writes.numbered(df, "no", [F.col("k")], 10).orderBy("no").collect()]
    assert [n for _, n in got] == list(range(10, 5010)) and [k for k, _ in got] == sorted(k for k, _ in got)
    ties = spark.createDataFrame([("a",)] * 5 + [("b",)], "k string")
    assert sorted(r.no for r in writes.numbered(ties, "no", [F.col("k")]).collect()) == [1, 2, 3, 4, 5, 6]
    assert writes.numbered(df.limit(0), "no", [F.col("k")]).count() == 0
    old = writes.with_identity(spark.createDataFrame([("x",), ("y",)], "name string"), "id", [F.col("name")]).select("id", "name")
    new, got = writes.get_or_create(old, spark.createDataFrame([("z",), ("x",), ("w",), ("w",)], "name string"), "name", "id")
    assert {(r.name, r.id) for r in got.collect()} == {("x", 1), ("w", 3), ("z", 4)} and new.count() == 4


def test_first_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "k string, v int")
    assert sorted(tuple(r) for r in writes.first_rows(df, ["k"], [F.desc("v")], 2).collect()) == [("a", 7), ("a", 8), ("b", 1)]


def test_replay_digest(spark):
    import hashlib

    from brindle.sources import logstore

    rows = [(p, o, f"v{p}.{o}") for p in range(3) for o in range(5, 400)] + [(7, 0, None)]
    got = logstore.replay_digest(spark.createDataFrame(rows, "partition int, offset long, value string").repartition(5)).collect()
    assert {r.partition: (r.first, r.last, r.digest) for r in got} == {**{p: (5, 399, hashlib.md5("".join(f"v{p}.{o}" for o in range(5, 400)).encode()).hexdigest()) for p in range(3)}, 7: (0, 0, hashlib.md5(b"").hexdigest())}
    assert logstore.replay_digest(spark.createDataFrame([], "partition int, offset long, value string")).count() == 0


def test_unaccent(spark):
    import unicodedata

    texts = ["café crème brûlée", "plain", "Ångström Łódź ﬁ ½", "é́ 漢字 ǅ", "é", "", None, "ñ" * 3000, "ĳ ŉ ſ ǆ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", values.unaccent(F.col("t")).alias("u")).collect()
    assert {r.i: r.u for r in rows} == {i: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for i, t in enumerate(texts)}
