"""More queries over the driver's tables: what the first registry does not call. Each is compared with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import extensions, fts, ranges, values
from brindle.operators import authz, graph, selection, telemetry, textindex, writes
from brindle.plans import named
from brindle.plans.registry import EDGES, RANGED, _places, _ranged, _trade, _tuples, query
from brindle.sources import logstore, tables

text = lambda c: F.col(c).cast("string")


# Bound parameters
@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 200000")
def bound_parameters(t):
    o = t("orders")
    return o.sparkSession.sql("SELECT o_orderkey, o_totalprice FROM {o} JOIN {c} ON o_custkey = c_custkey WHERE c_mktsegment = :segment AND o_totalprice > :least", args={"segment": "BUILDING", "least": 200000}, o=o, c=t("customer"))


# Five named queries with declared columns; authors are customers, books are orders
@query("SELECT c_custkey AS id, c_name AS name, n_name AS city FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def named_get_author(t):
    return named.get_author(named.authors(t), 7)


@query("SELECT o_orderkey AS id, o_custkey AS author_id, o_orderpriority AS title, year(o_orderdate)::INT AS year FROM orders WHERE o_custkey = 7 AND year(o_orderdate) >= 1994 ORDER BY 4, 1")
def named_books_by_author(t):
    return named.books_by_author(named.books(t), 7, 1994)


@query("SELECT n_name AS city, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def named_count_per_city(t):
    return named.count_books_per_city(named.authors(t))


@query("SELECT 'a' AS side, count(*) + 1 AS n, max(c_custkey) + 1 AS id FROM customer UNION ALL SELECT 'b', count(*) + 1, max(o_orderkey) + 1 FROM orders")
def named_create(t):
    """CreateAuthor and AddBook, with the rows that they return."""
    a, new_a = named.create_author(named.authors(t), "ada", "london")
    b, new_b = named.add_book(named.books(t), 7, "notes on the engine", 1843)
    side = lambda all_of, new, s: all_of.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n")).join(F.broadcast(new.select("id")), F.lit(True))  # noqa: E731  one row
    return side(a, new_a, "a").unionByName(side(b, new_b, "b"))


# A query text with an alias, a fragment, arguments and a variable
SCHOOL = """query Nations($least: Int!, $rich: Float = 9000.0) { regions(from: $least) { ...place nations { ...town people: customers(above: $rich) { id: c_custkey } } } }
fragment place on Region { name }
fragment town on Nation { name }"""


def _types(t):
    region = t("region").withColumnRenamed("r_name", "name")
    nation = t("nation").withColumnRenamed("n_name", "name")
    types = {
        "Region": selection.Type(region, {"nations": selection.Link("Nation", "r_regionkey", "n_regionkey", "name")}),
        "Nation": selection.Type(nation, {"customers": selection.Link("Customer", "n_nationkey", "c_nationkey", "c_custkey", {"above": lambda v: F.col("c_acctbal") > v})}),
        "Customer": selection.Type(t("customer"), {}, {"secret": "not allowed"}),
    }
    roots = {"regions": selection.Root("Region", {"from": lambda v: F.col("r_regionkey") >= v}), "customer": selection.Root("Customer", {"id": lambda v: F.col("c_custkey") == v})}
    return types, roots


@query("SELECT r_name AS region, n_name AS nation, coalesce(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey), '') AS people FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 WHERE r_regionkey >= 2 GROUP BY ALL")
def selection_text(t):
    types, roots = _types(t)
    found = selection.run(SCHOOL, types, roots, {"least": 2})["regions"]
    flat = found.select("node.name", F.explode("node.nations").alias("n"))
    return flat.select(F.col("name").alias("region"), F.col("n.name").alias("nation"), F.array_join(F.transform("n.people", lambda p: p["id"].cast("string")), ",").alias("people"))


# A lookup by key, and a field that fails
@query("SELECT c_name AS name, NULL::VARCHAR AS secret, 1::INT AS n_errors, 'secret: not allowed' AS error FROM customer WHERE c_custkey = 5")
def partial_result(t):
    types, roots = _types(t)
    found = selection.run("{ customer(id: 5) { name: c_name secret } }", types, roots)["customer"]
    found = selection.found_or_error(found, "customer 5")
    return found.select("node.name", "node.secret", F.size("errors").alias("n_errors"), F.col("errors")[0].alias("error"))


@query("SELECT 3 AS levels")
def selection_depth(t):
    """How deep a query text is nested, before it runs."""
    return t("region").sparkSession.range(1).select(F.lit(selection.depth(selection.parse(SCHOOL).inner)).alias("levels"))


# Schemas and the catalog as data
@query("SELECT * FROM (VALUES (1, 'n_nationkey', 'int'), (2, 'n_name', 'string'), (3, 'n_regionkey', 'int')) AS v(place, name, kind)")
def introspection(t):
    return tables.fields(tables.contract(t("nation"), "n_nationkey int, n_name string, n_regionkey int")).select("place", "name", "kind")


@query("SELECT * FROM (VALUES ('brindle_nation', true, 3), ('brindle_region', true, 2)) AS v(name, temporary, columns)")
def catalog_columns(t):
    found = []
    for n in ("nation", "region"):
        t(n).createOrReplaceTempView(f"brindle_{n}")
        found.append(tables.fields(t(n)).withColumn("of", F.lit(f"brindle_{n}")))
    c = tables.catalog(t("nation").sparkSession).where(F.col("name").startswith("brindle_"))
    return c.join(found[0].union(found[1]), F.col("of") == c["name"]).groupBy(c["name"], "temporary").agg(F.count(F.lit(1)).cast("int").alias("columns"))


# The functions that sets have loaded, from the catalog; temporary ones have no namespace
@query("SELECT f AS name, true AS temporary, false AS in_namespace, n_nationkey AS k, CASE f WHEN 'nlevel' THEN n_regionkey + 1 ELSE n_regionkey END::INT AS result FROM nation, (VALUES ('nlevel'), ('hstore')) AS v(f)")
def catalog_functions(t):
    spark = t("nation").sparkSession
    extensions.load(spark, "labels", "maps")
    found = tables.functions(spark).where(F.col("name").isin("nlevel", "hstore")).join(tables.namespaces(spark), "namespace", "left").select("name", "temporary", F.col("catalog").isNotNull().alias("in_namespace"))
    t("nation").createOrReplaceTempView("brindle_nation")
    called = spark.sql("SELECT 'nlevel' AS f, n_nationkey AS k, nlevel(array_join(array_repeat('a', n_regionkey + 1), '.')) AS result FROM brindle_nation UNION ALL SELECT 'hstore', n_nationkey, cast(hstore(concat('r=>', n_regionkey))['r'] AS int) FROM brindle_nation")
    return found.join(called, F.col("name") == F.col("f")).select("name", "temporary", "in_namespace", "k", "result")


# A script of statements; a view over tables
@query("SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM customer UNION ALL SELECT 's' FROM supplier) GROUP BY kind")
def script_and_view(t):
    spark = t("customer").sparkSession
    t("customer").createOrReplaceTempView("brindle_customer")
    t("supplier").createOrReplaceTempView("brindle_supplier")
    return tables.run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW brindle_parties AS SELECT 'c' AS kind, c_custkey AS id FROM brindle_customer UNION ALL SELECT 's', s_suppkey FROM brindle_supplier; SELECT kind, count(*) AS n FROM brindle_parties GROUP BY kind")[-1]


# Computed columns, defaults, returned rows
@query("SELECT p_partkey, p_size * p_retailprice AS area, coalesce(p_size, 0) AS size, 'new' AS state FROM part")
def computed_and_defaults(t):
    p = tables.computed(t("part"), area=F.col("p_size") * F.col("p_retailprice"))
    return writes.with_defaults(p.withColumnRenamed("p_size", "size"), state=F.lit("new"), size=F.lit(0)).select("p_partkey", "area", "size", "state")


@query("SELECT (SELECT count(*) FROM orders) + count(*) AS n, count(*) AS returned, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_totalprice > 300000")
def insert_returning(t):
    o = t("orders").select("o_orderkey", "o_totalprice")
    new, returned = writes.insert_returning(o, o.where("o_totalprice > 300000"))
    return returned.agg(F.count(F.lit(1)).alias("returned"), F.sum("o_orderkey").alias("keys")).join(F.broadcast(new.agg(F.count(F.lit(1)).alias("n"))), F.lit(True)).select("n", "returned", "keys")  # one row


# The claim itself, with the rows that it returns
@query("SELECT o_orderkey, 'running' AS state FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 3 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 25")
def claim_returning(t):
    jobs = t("orders").select("o_orderkey", "o_orderdate", F.col("o_orderstatus").alias("state"))
    return writes.claim(jobs, (F.col("state") == "O") & (F.col("o_orderkey") % 3 != 0), ["o_orderdate", "o_orderkey"], 25, "o_orderkey", {"state": F.lit("running")})[1].select("o_orderkey", "state")


# The table that a merge leaves
@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 0 END AS hits FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 7 = 0")
def merge_new_table(t):
    old = t("customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("hits"))
    source = old.where("k % 7 = 0 OR k % 5 <> 0").withColumn("hits", F.when(F.col("k") % 7 == 0, 1).otherwise(-1))
    return writes.merge(old, source, ["k"], {"hits": lambda o, n: o("hits") + n("hits")}, True, None, True)[0]


# What a constraint rejects
@query(f"WITH r AS ({RANGED}) SELECT count(*) FILTER (WHERE NOT hit) AS accepted, count(*) FILTER (WHERE hit) AS refused FROM (SELECT a.k, EXISTS (SELECT 1 FROM r b WHERE b.c = a.c AND b.k % 10 <> 0 AND a.lo < b.hi AND b.lo < a.hi) AS hit FROM r a WHERE a.k % 10 = 0)")
def expect_rejection(t):
    r = _ranged(t)
    new = r.where("k % 10 = 0")
    bad = writes.conflicts(new, r.where("k % 10 <> 0"), ["c"], "lo", "hi")
    if not writes.rejected(bad):
        raise AssertionError("the write should have been rejected")
    return new.join(bad.select(F.col("k").alias("b")).distinct(), F.col("k") == F.col("b"), "left").agg(F.count_if(F.col("b").isNull()).alias("accepted"), F.count_if(F.col("b").isNotNull()).alias("refused"))


# State after compare-and-set, and after a transaction of operations
@query("SELECT user_id::VARCHAR AS key, CASE WHEN user_id % 2 = 0 THEN 'w' ELSE 'v' END AS value, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM (SELECT DISTINCT user_id FROM events)")
def compare_and_set_state(t):
    users = t("events").select(text("user_id").alias("key"), "user_id").distinct()
    state = users.select("key", F.lit("v").alias("value"), F.lit(1).cast("long").alias("version"))
    asks = users.select("key", F.lit("w").alias("value"), (F.col("user_id") % 2 + 1).cast("long").alias("expected"))
    return writes.compare_and_set(state, asks)[0].select("key", "value", "version")


# Each user's events write one key in turn, two of them expecting each version
@query("SELECT event_id AS seq, user_id::VARCHAR AS key, (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) % 2 = 1 AS accepted, (1 + (count(*) OVER (PARTITION BY user_id) + 1) // 2)::BIGINT AS version FROM events")
def compare_and_set_in_turn(t):
    e = t("events").select(text("user_id").alias("key"), F.col("event_id").alias("seq"), text("event_id").alias("value"))
    state = e.select("key", F.lit("v").alias("value"), F.lit(1).cast("long").alias("version")).distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    new, judged = writes.compare_and_set(state, e.withColumn("expected", F.ceil(place / 2)), "seq")
    return judged.join(new.select("key", "version"), "key").select("seq", "key", "accepted", "version")


# A change whose keys repeat, cut to its first row a key before the upsert, which would reject it
@query("WITH f AS (SELECT user_id AS k, min(event_id) AS id FROM events GROUP BY user_id) SELECT coalesce(c_custkey, k) AS k, CASE WHEN c_custkey IS NULL THEN id WHEN k IS NULL THEN 0 ELSE -id END::BIGINT AS hits FROM customer FULL JOIN f ON c_custkey = k")
def upsert_first_of_repeated(t):
    old = t("customer").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("hits"))
    change = t("events").select(F.col("user_id").alias("k"), F.col("event_id").alias("hits"))
    return writes.upsert(old, writes.first_per_key(change, ["k"], ["hits"]), ["k"], {"hits": lambda _, n: -n("hits")})[0]


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, max(event_id) AS id FROM events GROUP BY user_id) SELECT user_id::VARCHAR AS key, id::VARCHAR AS value FROM l WHERE kind <> 'purchase'")
def state_transaction(t):
    ops = t("events").select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "delete").otherwise("upsert").alias("kind"), text("user_id").alias("key"), text("event_id").alias("value"))
    state = ops.select("key", F.lit("old").alias("value")).distinct()
    return writes.apply_operations(state, ops)


# Relay of an outbox, n at a time
@query("SELECT 'sent' AS side, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY o_orderkey LIMIT 40) UNION ALL SELECT 'pending', count(*), sum(o_orderkey)::BIGINT FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 ORDER BY o_orderkey OFFSET 40)")
def outbox_relay(t):
    box = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("2026-01-01").cast("timestamp")).alias("published_at"))
    first, box = writes.relay(box, 25, "o_orderkey", "published_at", F.lit("2026-01-02").cast("timestamp"))
    second, box = writes.relay(box, 15, "o_orderkey", "published_at", F.lit("2026-01-03").cast("timestamp"))
    side = lambda d, s: d.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    return side(first.union(second), "sent").union(side(box.where("published_at IS NULL"), "pending"))


# A row whose key is counted on, if its parent exists
@query("SELECT 'b' || (count(*) + 1) AS id, 'on looms' AS title, 3::BIGINT AS author FROM orders")
def add_with_key(t):
    books = t("orders").select(F.concat(F.lit("b"), text("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("author"))
    return writes.add_with_key(books, {"title": F.lit("on looms"), "author": F.lit(3).cast("long")}, "id", "b", "author", t("customer"), "c_custkey")[1]


# Upload of a stream into a catalogue
@query("SELECT count(*) FILTER (WHERE event_type <> 'click') AS accepted, count(*) FILTER (WHERE event_type = 'click') AS rejected, (SELECT count(DISTINCT user_id) FROM events) AS size, (SELECT count(*) FROM (SELECT user_id, arg_max(event_type, event_id) AS k FROM events WHERE event_type <> 'click' GROUP BY user_id) WHERE k = 'view') AS views FROM events")
def upload_summary(t):
    e = t("events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "click", F.col("event_type")).otherwise("").alias("title"), "event_id")
    old = e.select("id", F.lit("old").alias("title")).distinct()
    new, summary = writes.upload(old, e, "id", "event_id", F.col("title") != "")
    return summary.join(F.broadcast(new.agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("title") == "view").alias("views"))), F.lit(True))  # one row


# A graph's matches joined to a table
@query(f"WITH {EDGES} SELECT c_name AS buyer, s_name AS seller, n_name AS home FROM e JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = 4 AND qty > 20")
def graph_joined(t):
    p = graph.Pattern((graph.Hop("out", F.col("qty") > 20),), {0: F.col("nation") == 4})
    m = graph.graph_table(_trade(t), p, {"buyer": "v0.name", "seller": "v1.name", "nation": "v1.nation"})
    return m.join(t("nation"), F.col("nation") == F.col("n_nationkey")).select("buyer", "seller", F.col("n_name").alias("home"))


# The envelope of a nested walk, taken apart again
@query("SELECT r_name AS region, count(n_nationkey)::INT AS n, 0 AS n_errors FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def response_envelope(t):
    j = graph.response(graph.nested(_places(t), F.col("id").startswith("r"), {"name": {}, "holds": {"name": {}}}, "holds", "name"), "region")
    d = j.select(F.from_json("json", "data struct<region:struct<name:string,holds:array<struct<name:string>>>>, errors array<string>").alias("j"))
    return d.select("j.data.region.name", F.size("j.data.region.holds").alias("n"), F.size("j.errors").alias("n_errors")).withColumnRenamed("name", "region")


# Lists, explanations, filters by permission
@query("SELECT 'document:' || o_orderkey AS object FROM orders WHERE o_custkey = 1 OR (o_orderkey % 100 = 0 AND o_orderkey % 25 = (SELECT c_nationkey FROM customer WHERE c_custkey = 1))")
def permission_objects(t):
    return authz.Store(_tuples(t), authz.IMPLIES).list_objects("1", "viewer", "document")


@query("SELECT 'user:' || o_custkey || ' owner viewer' AS path FROM orders WHERE o_orderkey = 100 UNION SELECT 'user:' || c_custkey || ' team:' || c_nationkey || '#member viewer' FROM customer WHERE c_nationkey = 0")
def permission_paths(t):
    return authz.expand(_tuples(t)).where("relation = 'viewer' AND object_id = '100'").select(F.array_join("path", " ").alias("path")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 1 OR (o_orderkey % 100 = 0 AND o_orderkey % 25 = (SELECT c_nationkey FROM customer WHERE c_custkey = 1))")
def permission_filter(t):
    o = t("orders").select(text("o_orderkey").alias("id"), "o_orderkey", "o_totalprice")
    return authz.visible(o, "id", _tuples(t), "1", "viewer", "document").select("o_orderkey", "o_totalprice")


# Three answers to one question, and whether they agree
@query("SELECT o_orderkey::VARCHAR AS id, (o_custkey = 1)::VARCHAR AS checked, (o_custkey = 1)::VARCHAR AS listed, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey = 1)::VARCHAR ELSE 'n/a' END AS policy, true AS agree FROM orders")
def answers_agree(t):
    tuples = _tuples(t)
    q = t("orders").select(F.lit("document").alias("object_type"), text("o_orderkey").alias("object_id"), F.lit("1").alias("user_id"), F.lit("editor").alias("relation"))
    one = authz.check(q, tuples).select(F.col("object_id").alias("id"), F.col("allowed").alias("a"))
    two = authz.list_objects(tuples, "1", "editor", "document").select(F.substring_index("object", ":", -1).alias("id2"), F.lit(True).alias("b"))
    policy = authz.Policy(lambda name: text("o_custkey") == name)
    seen = policy.read(t("orders").where("o_orderkey % 2 = 0"), authz.Principal("1", privileges=frozenset({"select"}))).select(text("o_orderkey").alias("id3"), F.lit(True).alias("c"))
    j = one.join(two, F.col("id") == F.col("id2"), "left").join(seen, F.col("id") == F.col("id3"), "left")
    c = F.when(F.col("id").cast("long") % 2 == 0, F.coalesce("c", F.lit(False)))
    b = F.coalesce("b", F.lit(False))
    return j.select("id", text("a").alias("checked"), b.cast("string").alias("listed"), F.coalesce(c.cast("string"), F.lit("n/a")).alias("policy"), (F.col("a").eqNullSafe(b) & (c.isNull() | (c == b))).alias("agree"))


# Policies on writes, force, superusers, grants
@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) AS forced_owner, (SELECT count(*) FROM orders) AS superuser, (SELECT count(*) FROM orders WHERE o_custkey <> 7) AS violations, (SELECT count(*) + 1 FROM orders) AS inserted")
def policy_force_and_check(t):
    o = t("orders").select("o_orderkey", "o_custkey")
    p = authz.Policy(lambda name: text("o_custkey") == name, force=True)
    owner, root = authz.Principal("7", owner=True), authz.Principal("root", superuser=True)
    new = o.sparkSession.sql("SELECT -1L AS o_orderkey, 7L AS o_custkey")
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    out = n(p.read(o, owner), "forced_owner")
    for other in (n(p.read(o, root), "superuser"), n(p.violations(o, owner), "violations"), n(p.insert(o, new, owner), "inserted")):
        out = out.join(F.broadcast(other), F.lit(True))  # one row each
    return out


@query("SELECT 'r' || (n_nationkey % 3) AS role, 'p' || n_regionkey AS privilege FROM nation GROUP BY ALL HAVING arg_max(n_nationkey % 2, n_nationkey) = 0")
def granted_privileges(t):
    s = t("nation").select(F.col("n_nationkey").alias("seq"), F.when(F.col("n_nationkey") % 2 == 0, "grant").otherwise("revoke").alias("kind"), F.concat(F.lit("r"), (F.col("n_nationkey") % 3).cast("string")).alias("role"), F.concat(F.lit("p"), text("n_regionkey")).alias("privilege"))
    return authz.privileges(s)


# Arrays from subqueries, pretty JSON, any value, members' partitions
@query("SELECT r_regionkey, (SELECT array_to_string(list(n_name ORDER BY n_name), ',') FROM nation WHERE n_regionkey = r_regionkey) AS names, '{\n  \"r_regionkey\" : ' || r_regionkey || ',\n  \"r_name\" : \"' || r_name || '\"\n}' AS pretty, (SELECT any_value(n_regionkey) FROM nation WHERE n_regionkey = r_regionkey) AS any FROM region")
def subquery_arrays(t):
    n = t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.any_value("n_regionkey").alias("any"))
    return t("region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "names", values.json_pretty(F.struct("r_regionkey", "r_name")).alias("pretty"), "any")


@query("SELECT 'm' || (p % 2) AS member, string_agg(p::VARCHAR, ',' ORDER BY p) AS partitions FROM (SELECT DISTINCT user_id % 4 AS p FROM events) GROUP BY p % 2")
def members_partitions(t):
    p = t("events").select((F.col("user_id") % 4).alias("p")).distinct()
    return p.groupBy(F.concat(F.lit("m"), (F.col("p") % 2).cast("string")).alias("member")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x.cast("string")), ",").alias("partitions"))


# Counters, gauges, details of spans
@query("SELECT event_type, round(sum(value), 6) AS total, arg_max(value, struct_pack(ts := ts, id := event_id)) AS last FROM events GROUP BY event_type")
def metric_counter(t):
    e = t("events").withColumn("at", F.struct("ts", "event_id"))
    return telemetry.counter(e, "value", ["event_type"]).join(telemetry.gauge(e, "value", "at", ["event_type"]), "event_type").select("event_type", F.round("total", 6).alias("total"), "last")


@query("SELECT event_type AS name, 'attribute' AS kind, 'user' AS key, user_id::VARCHAR AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT event_type, 'event', 'seen', NULL, count(*) FROM events GROUP BY ALL")
def span_details(t):
    s = t("events").select(F.col("event_type").alias("name"), F.create_map(F.lit("user"), text("user_id")).alias("attributes"), F.array(F.lit("seen")).alias("events"))
    return telemetry.details(s).groupBy("name", "kind", "key", "value").agg(F.count(F.lit(1)).alias("n"))


# The nearest by trigram distance (the limit is the feature)
@query("""WITH g AS (SELECT p_partkey, p_name, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), lambda x: list_transform(generate_series(1, length(x) + 1), lambda i: substr('  ' || x || ' ', i::INT, 3))))) AS g,
    ['  n', ' ne', 'new', 'ew ', '  p', ' pl', 'pla', 'lat', 'ate', 'te '] AS q FROM part) SELECT p_partkey, p_name, round(1 - len(list_intersect(g, q))::DOUBLE / (len(g) + len(q) - len(list_intersect(g, q))), 6) AS distance FROM g ORDER BY 3, p_partkey LIMIT 5""")
def nearest_names(t):
    return t("part").select("p_partkey", "p_name", F.round(values.distance(F.col("p_name"), "new plate"), 6).alias("distance")).orderBy("distance", "p_partkey").limit(5)


# Case folding, sizes, samples
@query("SELECT n_nationkey, lower(n_name) || 'strasse' AS folded, CASE WHEN b >= 10 * 1024 * 1024 THEN (round(b / 1048576.0))::BIGINT || ' MB' WHEN b >= 10240 THEN (round(b / 1024.0))::BIGINT || ' kB' ELSE b || ' bytes' END AS size FROM (SELECT n_nationkey, n_name, (n_nationkey::BIGINT * n_nationkey * 50021) AS b FROM nation)")
def folded_and_sizes(t):
    b = (F.col("n_nationkey").cast("long") * F.col("n_nationkey") * 50021).alias("b")
    return t("nation").select("n_nationkey", "n_name", b).select("n_nationkey", values.casefold(F.concat("n_name", F.lit("Straße"))).alias("folded"), values.size_pretty(F.col("b")).alias("size"))


@query("SELECT vec_id, 2 AS n, true AS inside FROM embeddings")
def sampled_arrays(t):
    s = t("embeddings").select("vec_id", "embedding", values.sample(F.col("embedding"), 2).alias("s"))
    return s.select("vec_id", F.size("s").alias("n"), values.contains_all(F.col("embedding"), F.col("s")).alias("inside"))


# JSON documents made, and read by nested and indexed paths
DOC = "SELECT n_nationkey AS k, n_name AS name, 'x' || n_regionkey AS tag, CASE WHEN n_nationkey % 2 = 0 THEN 'even' END AS note FROM nation"


def _doc(t):
    meta = F.struct(F.struct(F.col("n_regionkey").alias("region")).alias("place"), F.lit("c").alias("city"))
    d = t("nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("x"), text("n_regionkey")), F.lit("git")).alias("tags"), meta.alias("meta"))).alias("d"))
    return d, F.col("d")


@query("SELECT n_nationkey, 'c' AS city, n_regionkey AS region, 'x' || n_regionkey AS tag0, true AS has_git, true AS has_meta, false AS has_other, '[\"x' || n_regionkey || '\",\"git\"]' AS tags FROM nation")
def json_nested_paths(t):
    d, doc = _doc(t)
    return d.select(
        "n_nationkey", values.json_text(doc, "$.meta.city").alias("city"), values.json_value(doc, "$.meta.place.region", "int").alias("region"), values.json_text(doc, "$.tags[0]").alias("tag0"), values.has_element(doc, "$.tags", "git").alias("has_git"),
        values.has_key(doc, "meta").alias("has_meta"), values.has_key(doc, "other").alias("has_other"), values.json_query(doc, "$.tags").alias("tags"),
    )


@query("SELECT n_nationkey, unnest(['x' || n_regionkey, 'git']) AS tag FROM nation")
def json_array_elements(t):
    d, doc = _doc(t)
    return d.select("n_nationkey", F.explode(values.json_elements(doc, "$.tags")).alias("tag"))


@query(f"SELECT k, '{{\"name\":\"' || name || '\",\"note\":' || coalesce('\"' || note || '\"', 'null') || '}}' AS object, '[1,2,' || k || ']' AS array, CASE WHEN note IS NULL THEN 'null' ELSE '[\"' || note || '\"]' END AS v1, CASE WHEN note IS NULL THEN '[]' ELSE '[\"' || note || '\"]' END AS v2 FROM ({DOC})")
def json_constructors(t):
    note = F.when(F.col("n_nationkey") % 2 == 0, "even")
    many = F.when(note.isNotNull(), F.array(note))
    return t("nation").select(F.col("n_nationkey").alias("k"), values.json_object(name=F.col("n_name"), note=note).alias("object"), values.json_array(F.lit(1), F.lit(2), F.col("n_nationkey")).alias("array"), values.json_list(many, False).alias("v1"), values.json_list(many, True).alias("v2"))


# Documents changed, and containment that does not always hold
@query("SELECT event_id, '{\"k\":100}' AS put, '{\"active\":true}' AS merged, (json_extract(props, '$.k')::INT = 5) AS holds FROM events")
def json_changes(t):
    p = F.col("props")
    return t("events").select("event_id", values.json_set(p, ("k",), 100).alias("put"), values.json_merge(p, '{"active":true}', ("k",)).alias("merged"), values.json_contains(p, '{"k": 5}').alias("holds"))


# What is JSON, of which kind: props of events, some of them made into other kinds or spoilt
KIND_DOC = "CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',7]' WHEN 2 THEN event_id::{0} WHEN 3 THEN substr(props, 2) WHEN 4 THEN substr(props, 1, length(props) - 1) || ',\"k\":2}}' WHEN 5 THEN 'NaN' WHEN 6 THEN props || ' x' WHEN 7 THEN '\"' || event_type || '\"' ELSE '[' || props || ',Infinity]' END"
KIND_OF = "CASE event_id % 9 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'scalar' WHEN 4 THEN 'object' WHEN 7 THEN 'scalar' END"


@query(f"SELECT event_id, doc, kind IS NOT NULL AS valid, kind, event_id % 9 IN (0, 1, 2, 7) AS unique_keys FROM (SELECT event_id, {KIND_DOC.format('VARCHAR')} AS doc, {KIND_OF} AS kind FROM events WHERE props IS NOT NULL)")
def json_kinds(t):
    d = t("events").where("props IS NOT NULL").select("event_id", F.expr(KIND_DOC.format("string").replace("event_id::string", "cast(event_id AS string)")).alias("doc"))
    kind = values.json_kind(F.col("doc"))
    return d.select("event_id", "doc", kind.isNotNull().alias("valid"), kind.alias("kind"), values.json_unique_keys(F.col("doc")).alias("unique_keys"))


# containment by value and by element, where numbers are written in other ways
@query("SELECT event_id, k = 5 AS by_value, k BETWEEN 4 AND 6 AS by_element, false AS other FROM (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)")
def json_containment(t):
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.concat(F.lit('{"a":[{"k":'), k, F.lit('.0,"z":null},"s"],"n":'), k, F.lit("}"))
    near = F.concat(F.lit("["), k - 1, F.lit(","), k, F.lit(".0,"), k + 1, F.lit("]"))
    c = values.json_contains
    return t("events").select("event_id", (c(doc, '{"a":[{"k":5,"z":null}]}') & c(doc, '{"n":5.00}')).alias("by_value"), c(near, "5").alias("by_element"), (c(doc, '{"a":{"k":5}}') | c(doc, '{"n":"5"}') | c(near, "[[5]]")).alias("other"))


# Times, random values and identifiers, by their properties
@query("SELECT event_id, (event_id * 1000)::BIGINT AS ms, 7 AS v7, 4 AS v4, true AS in_range, true AS ordered, 8 AS n_bytes, true AS past FROM events")
def identifier_properties(t):
    ms = F.col("event_id") * 1000
    d = t("events").select("event_id", ms.alias("ms"), values.uuid7(ms).alias("u"), values.uuid7(ms + 1).alias("later"), F.uuid().alias("v4"), values.random_between(1, 6).alias("i"), values.random_range(1.0, 2.0).alias("x"), values.random_bytes(8).alias("b"), values.local_time(F.col("ts")).alias("here"), "ts")
    return d.select(
        "event_id", F.unix_millis(values.uuid7_time(F.col("u"))).alias("ms"), values.uuid_version(F.col("u")).alias("v7"), values.uuid_version(F.col("v4")).alias("v4"), (F.col("i").between(1, 6) & (F.col("x") >= 1) & (F.col("x") < 2)).alias("in_range"),
        ((F.col("u") < F.col("later")) & (F.length("v4") == 36)).alias("ordered"), F.length("b").alias("n_bytes"), ((F.col("here") == F.col("ts")) & (F.col("ts") < F.current_timestamp())).alias("past"),
    )


# Lexemes, queries, ranks and headlines, where the words' forms are few enough for SQL
WORDS = "SELECT doc_id, text, [x FOR x IN regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')] AS ws FROM documents"
TF = "len(list_filter(ws, lambda x: x IN ('{0}', '{0}s')))"


@query("WITH d AS (SELECT doc_id, " + ", ".join(TF.format(w) + f" AS {w}" for w in ("idiot", "clown", "moron")) + f" FROM ({WORDS})) SELECT doc_id, round((list_sum(list_transform(generate_series(1, clown), lambda j: 0.1 / (j * j)))::DOUBLE) / 1.64493406685, 6) AS rank FROM d WHERE clown > 0 AND idiot = 0 AND moron = 0")
def full_text_boolean(t):
    found = textindex.of_table(t("documents"), "doc_id", "text").search(fts.to_tsquery("clowns & !(idiot | moron)"), fts.to_tsquery("clown"))
    return found.select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(f"SELECT doc_id, len(ws)::INT AS n FROM ({WORDS}) WHERE len(list_filter(ws, lambda x: x IN ('idiot', 'idiots'))) > 0 AND len(list_filter(ws, lambda x: x IN ('scum', 'scums'))) = 0")
def full_text_websearch(t):
    """Words are counted before the join, so that no text is exchanged for it."""
    d = t("documents")
    found = textindex.of_table(d, "doc_id", "text").find(fts.websearch_to_tsquery("the idiot -scum"))
    counted = d.select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")).alias("n"))
    return counted.join(found.select(F.col("key").alias("doc_id")), "doc_id", "left_semi")


# Contents of multiranges
@query("SELECT k, CASE WHEN lo < 25 THEN '[' || lo || ',' || least(hi, 25) || ')' ELSE '' END || CASE WHEN hi > 40 THEN '[' || greatest(lo, 40) || ',' || hi || ')' ELSE '' END AS left_over, (30 >= lo AND 30 < hi) AS holds30, (10 >= lo AND 10 < hi AND NOT (10 >= 25 AND 10 < 40)) AS holds10, CASE WHEN hi <= 40 AND lo < 25 THEN least(hi, 25) END AS cut FROM (SELECT o_orderkey AS k, (o_orderkey % 50)::BIGINT AS lo, (o_orderkey % 50 + 20)::BIGINT AS hi FROM orders)")
def multirange_contents(t):
    lo = (F.col("o_orderkey") % 50).cast("long")
    d = t("orders").select(F.col("o_orderkey").alias("k"), ranges.make(lo, lo + 20).alias("r"), ranges.make(F.lit(25).cast("long"), F.lit(40).cast("long")).alias("s"))
    m = ranges.multi_difference(F.array("r"), F.array("s"))
    one = F.when((F.col("r.hi") <= 40) & (F.col("r.lo") < 25), ranges.difference(F.col("r"), F.col("s"))["hi"])
    return d.select("k", F.array_join(F.transform(m, ranges.render), "").alias("left_over"), ranges.multi_contains(F.array("r"), F.lit(30)).alias("holds30"), ranges.multi_contains(m, F.lit(10)).alias("holds10"), one.alias("cut"))


# Envelopes of events
@query("SELECT event_id, 'events' AS topic, event_type AS type, json_extract_string(props, '$.k') AS k FROM events")
def cloud_events(t):
    raw = F.to_json(F.struct(text("event_id").alias("id"), F.lit("1.0").alias("specversion"), F.col("event_type").alias("type"), F.lit("events").alias("topic"), F.col("props").alias("data"), F.lit("more").alias("unknown")))
    e = t("events").select("event_id", logstore.cloud_event(raw).alias("e"))
    return e.select("event_id", "e.topic", "e.type", values.json_text(F.col("e.data"), "$.k").alias("k"))


# Rows as aligned lines
@query("SELECT rpad(r_regionkey::VARCHAR, 11, ' ') || '  ' || r_name AS line FROM region")
def aligned_lines(t):
    return tables.aligned(t("region").select("r_regionkey", "r_name"))


# Functions that are loaded by name and called in SQL text
@query("SELECT n_nationkey, 2 AS depth, 'x' AS top, 'r' || n_regionkey AS b, sha256(n_name) AS digest, 'cafe' AS plain, n_nationkey = 7 AS same FROM nation")
def loaded_extensions(t):
    n = t("nation")
    extensions.load(n.sparkSession, "trigrams", "labels", "maps", "digests", "accents")
    return n.sparkSession.sql(
        "SELECT n_nationkey, nlevel('x.y') AS depth, subpath('x.y', 0, 1) AS top, hstore(concat('a=>1, b=>r', n_regionkey))['b'] AS b, digest_hex(n_name) AS digest, unaccent('café') AS plain, similarity(n_name, 'nation_7') = 1 AS same FROM {n}", n=n
    )


# Catalogs in memory
@query("SELECT * FROM (VALUES ('ada', 'notes on the engine', 1843), ('ada', 'on looms', 1845), ('grace', 'the compiler', 1952)) AS v(name, title, year)")
def catalog_in_memory(t):
    spark = t("region").sparkSession
    authors = spark.createDataFrame([("a1", "ada", "london"), ("a2", "grace", "new york"), ("a3", "linus", "helsinki")], "id string, name string, city string")
    books = spark.createDataFrame([("b1", "notes on the engine", 1843, "a1"), ("b2", "on looms", 1845, "a1"), ("b3", "the compiler", 1952, "a2")], "book string, title string, year int, author string")
    return authors.join(books, F.col("id") == F.col("author")).select("name", "title", "year")
