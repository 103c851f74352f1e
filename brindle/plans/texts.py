"""Queries by text over the driver's tables: table functions and policies in SQL, selections, walks, exports; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import tablefunctions
from brindle.operators import authz, graph, selection
from brindle.plans.more import _types
from brindle.plans.registry import EDGES, _places, _trade, query
from brindle.session import shared_folder
from brindle.sources import datasources


# Walks from a start, of any depth and of some; one vertex's nested walk
FOLLOWS = "e AS (SELECT o_custkey AS src, (o_orderkey * 7) % 1500 AS dst FROM orders WHERE o_orderkey % 9 = 0)"


def _follows(t):
    e = t("orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7) % 1500).alias("dst"))
    return graph.PropertyGraph(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), e)


@query(f"WITH RECURSIVE {FOLLOWS}, r AS (SELECT c_custkey AS id FROM customer WHERE c_custkey < 5 UNION SELECT dst FROM r JOIN e ON id = src JOIN customer ON c_custkey = dst) SELECT id FROM r")
def walk_any_depth(t):
    return graph.walk(_follows(t), F.col("id") < 5).select("id")


@query(f"WITH RECURSIVE {FOLLOWS}, r AS (SELECT c_custkey AS id, 0 AS depth FROM customer WHERE c_custkey < 40 UNION SELECT src, depth + 1 FROM r JOIN e ON id = dst JOIN customer ON c_custkey = src WHERE depth < 3) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id")
def walk_back_three(t):
    return graph.walk(_follows(t), F.col("id") < 40, "in", 3)


@query(f"WITH {FOLLOWS}, k AS (SELECT src, dst FROM e JOIN customer ON c_custkey = dst) SELECT a.src || '>' || a.dst AS path, count(*) AS n FROM k a WHERE a.src < 20 AND a.src <> a.dst GROUP BY 1 UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst, count(*) FROM k a JOIN k b ON a.dst = b.src WHERE a.src < 20 AND a.src <> a.dst AND b.dst NOT IN (a.src, a.dst) GROUP BY 1")
def walk_trails(t):
    return graph.trails(_follows(t), F.col("id") < 20, 2).groupBy(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, count(c_custkey) AS n, min(c_name) AS first FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY n_name")
def nested_from_one(t):
    """From one region: only its nations and their customers are read."""
    w = graph.nested(_places(t), F.col("id") == "r2", {"name": {}, "holds": {"name": {}, "holds": {"name": {}}}}, "holds", "name").select(F.explode("node.holds").alias("n"))
    return w.select(F.col("n.name").alias("n_name"), F.size("n.holds").cast("long").alias("n"), F.try_element_at("n.holds", F.lit(1))["name"].alias("first"))


# Table functions that SQL text calls
@query("SELECT r_regionkey AS region, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey))::INT AS rn, n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'none' END AS tag, n_nationkey % 2 = 0 AS tagged, (n_nationkey / 4)::DOUBLE AS quarter FROM region JOIN nation ON n_regionkey = r_regionkey")
def json_table_in_sql(t):
    """Documents with an array each, as rows whose columns the call declares."""
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tags = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("first"), F.lit("even")))
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), tags.alias("tags"), (F.col("n_nationkey") / 4).alias("quarter"))
    docs = n.groupBy("r_regionkey").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("items")).alias("of"))).alias("doc"))
    spark = docs.sparkSession
    tablefunctions.register(spark)
    docs.createOrReplaceTempView("brindle_docs")
    columns = "rn FOR ORDINALITY, id INT, name STRING PATH ''$.name'', tag TEXT PATH ''$.tags[1]'' DEFAULT ''none'', tagged BOOLEAN EXISTS PATH ''$.tags'', quarter DOUBLE"
    return spark.sql(f"SELECT r_regionkey AS region, j.* FROM brindle_docs d, LATERAL json_table(d.doc, '$.of.items[*]', '{columns}') j")


@query(f"WITH {EDGES} SELECT n_name AS nation, c_name AS buyer, s_name AS seller, qty FROM e JOIN customer ON c = c_custkey JOIN supplier ON s = s_suppkey JOIN nation ON c_nationkey = n_nationkey WHERE qty > 40 AND n_regionkey = 1")
def graph_table_in_sql(t):
    """A pattern as a function of a nation, called for each nation of a region."""
    g = _trade(t)
    spark = g.vertices.sparkSession
    g.vertices.createOrReplaceTempView("brindle_traders")
    g.edges.createOrReplaceTempView("brindle_trades")
    t("nation").createOrReplaceTempView("brindle_nation")
    graph.table_function(spark, "buys_of", "home INT, least DOUBLE", "brindle_traders", "brindle_trades", ["out"], "v0.nation = home AND e1.qty > least", {"buyer": "v0.name", "seller": "v1.name", "qty": "e1.qty"}, g.key, g.source, g.target)
    return spark.sql("SELECT n_name AS nation, b.* FROM brindle_nation n, LATERAL buys_of(n.n_nationkey, 40.0D) b WHERE n_regionkey = 1")


# One text, three principals
@query("SELECT who, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS buyers FROM (VALUES ('admin', NULL), ('3', 3), ('4', 4)) AS w(who, nation) JOIN customer ON nation IS NULL OR c_nationkey = nation JOIN orders ON o_custkey = c_custkey AND (nation IS NULL OR o_custkey % 5 <> 0) GROUP BY who")
def policies_in_sql(t):
    """Customers of a principal's nation, and orders of those less some: whatever the text says, it sees no others."""
    load = lambda name: lambda s: s.read.parquet(*t(name).inputFiles())
    mine = authz.Policy(lambda who: F.col("c_nationkey") == F.lit(who).cast("int"))
    some = authz.Policy(lambda _: F.col("o_custkey") % 5 != 0)
    gate = authz.Gate(t("customer").sparkSession, {"customer": (load("customer"), mine), "orders": (load("orders"), some), "nation": (load("nation"), None)})
    reader = frozenset({"select"})
    text = "WITH c AS (SELECT * FROM customer) SELECT :who AS who, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT c_custkey) AS buyers FROM orders JOIN c ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation)"
    out = None
    for who in (authz.Principal("admin", superuser=True), authz.Principal("3", privileges=reader), authz.Principal("4", privileges=reader)):
        rows = gate.sql(who, text, {"who": who.name})
        out = rows if out is None else out.union(rows)
    return out


# A table as one JSON array, without a row that holds it
@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total, max(l_shipdate)::VARCHAR AS last FROM lineitem GROUP BY l_returnflag")
def json_array_export(t):
    rows = t("lineitem")
    folder = shared_folder(rows.sparkSession, "export")
    datasources.export_json_array(rows, folder)
    back = datasources.read_json_array(rows.sparkSession, folder, rows.schema)
    return back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_shipdate").cast("string").alias("last"))


# Inline fragments, directives, kinds, changes, and the types as data
ROOTED = "query Q($least: Float!, $few: Boolean = true) { regions(from: 3) { __typename ... on Region { name nations { ...N ... @skip(if: $few) { n_nationkey } } } } } fragment N on Nation { kind: __typename name people: customers(above: $least) @include(if: $few) { c_custkey } }"


@query("SELECT 'Region' AS region_kind, r_name AS region, 'Nation' AS kind, n_name AS nation, count(c_custkey) AS people FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000.5 WHERE r_regionkey >= 3 GROUP BY ALL")
def selection_fragments(t):
    types, roots = _types(t)
    found = selection.run(ROOTED, types, roots, {"least": 5000.5})["regions"].select("node.__typename", "node.name", F.explode("node.nations").alias("n"))
    return found.select(F.col("__typename").alias("region_kind"), F.col("name").alias("region"), "n.kind", F.col("n.name").alias("nation"), F.size("n.people").cast("long").alias("people"))


@query("SELECT c_nationkey, round(sum(CASE WHEN c_nationkey = 4 THEN c_acctbal + 100.5 ELSE c_acctbal END), 2) AS total, count(*) FILTER (WHERE c_nationkey = 4) AS changed FROM customer GROUP BY c_nationkey")
def selection_mutation(t):
    """A change by text; what is selected of it, and the types after it."""
    types, _ = _types(t)

    def pay(types, given):
        old = types["Customer"]
        hit = F.col("c_nationkey") == given["nation"]
        new = old.rows.withColumn("c_acctbal", F.when(hit, F.col("c_acctbal") + given["by"]).otherwise(F.col("c_acctbal")))
        return types | {"Customer": selection.Type(new, old.links, old.failing)}, new.where(hit)

    change = {"pay": selection.Mutation("Customer", pay, {"nation": "Int!", "by": "Float!"})}
    after, found = selection.mutate("mutation ($n: Int!) { pay(nation: $n, by: 100.5) { c_custkey } }", types, change, {"n": 4})
    changed = found["pay"].select(F.col("node.c_custkey").alias("k"))
    rows = after["Customer"].rows
    return rows.join(changed, F.col("c_custkey") == F.col("k"), "left").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.count("k").alias("changed"))


@query("SELECT 'OBJECT' AS kind, column_name AS field, CASE column_type WHEN 'BIGINT' THEN 'ID' WHEN 'INTEGER' THEN 'Int' WHEN 'DOUBLE' THEN 'Float' ELSE 'String' END AS type, 0::INT AS args FROM (DESCRIBE customer) UNION ALL SELECT 'OBJECT', 'secret', 'String', 0")
def selection_introspection(t):
    """The fields of a type, asked for by a query text."""
    types, roots = _types(t)
    types, roots = selection.with_introspection(t("customer").sparkSession, types, roots)
    found = selection.run('{ __type(name: "Customer") { kind fields { name type args { name } } } }', types, roots)["__type"].select("node.kind", F.explode("node.fields").alias("f"))
    return found.select("kind", F.col("f.name").alias("field"), "f.type", F.size("f.args").alias("args"))
