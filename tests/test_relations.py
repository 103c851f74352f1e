"""Similarity joins, authorization models, intervals, walks, table functions, gates, data sources, processors, query texts: against
brute force on small made-up rows."""

import datetime
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.functions import tablefunctions, values
from brindle.operators import authz, authzmodel, graph, intervals, selection, similarity, writes
from brindle.plans import registry, relations
from brindle.sources import datasources
from brindle.streaming import processors, relays


# trigram similarity
@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_similar_pairs(spark, threshold):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    a = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(120)] + ["Same Name", "", " !", "é漢", "same-name", None]
    b = [x if r.random() < 0.2 else " ".join(word() for _ in range(r.randint(1, 3))) for x in a] + ["SAME name", None]
    left, right = (spark.createDataFrame([(x,) for x in v], "value string") for v in (a, b))
    sets = {x: frozenset(values.trigrams_of(x)) for x in {*a, *b} if x}
    want = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in {*a} - {None} for y in {*b} - {None} if x and y and sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= threshold}
    got = {(x["left"], x["right"]): x.similarity for x in similarity.pairs(left, right, threshold).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_similar_rows(spark):
    left = spark.createDataFrame([(1, "postgres"), (2, "postgres"), (3, None)], "i int, a string")
    right = spark.createDataFrame([(7, "postgresql"), (8, "mysql"), (9, "postgres")], "j int, b string")
    assert Counter((x.i, x.j, round(x.similarity, 3)) for x in similarity.similar_join(left, right, "a", "b", 0.5).collect()) == Counter([(1, 7, 0.667), (2, 7, 0.667), (1, 9, 1.0), (2, 9, 1.0)])
    assert [(x["right"], x.place) for x in similarity.nearest(left, right, "a", "b", 1, 0.5).collect()] == [("postgres", 1)]
    assert similarity.similar_join(left.limit(0), right, "a", "b").count() == 0
    with pytest.raises(ValueError):
        similarity.similar_join(left, left, "a", "a")
    plan = similarity.similar_join(left, right, "a", "b", 0.5)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


def test_members_of_one_side_and_sizes_that_are_missing_shorten_prefixes(spark):
    """Words of all names of one side, numbers of both: few first members are exchanged, and every similar pair is found."""
    assert similarity.needed(18, [19], 0.27) == 8 and similarity.needed(18, [5, 19], 0.27) == 5 and similarity.needed(18, [2, 90], 0.27) == 0 and similarity.needed(3, [], 0.5) == 0
    r = random.Random(5)
    a, b = ([f"{word}#{i:09d}" for i in r.sample(range(120), 60)] + more for word, more in (("Supplier", ["a b", "x"]), ("Customer", ["b a c", "word " * 3 + " ".join(f"w{i}" for i in range(80))])))
    left, right = (spark.createDataFrame([(x,) for x in v], "value string") for v in (a, b))
    sets = {x: frozenset(values.trigrams_of(x)) for x in {*a, *b}}
    want = {(x, y): s for x in a for y in b if (s := len(sets[x] & sets[y]) / len(sets[x] | sets[y])) >= 0.27}
    found = similarity.pairs(left, right, 0.27)
    got = {(x["left"], x["right"]): x.similarity for x in found.collect()}
    assert got == pytest.approx(want) and len(want) > 30


def test_similar_rows_are_not_broadcast(spark):
    """Rows, found pairs and prefixes are merged, however small Spark takes them to be."""
    left, right = spark.createDataFrame([(1, "postgres")], "i int, a string"), spark.createDataFrame([(7, "postgresql")], "j int, b string")
    plan = similarity.similar_join(left, right, "a", "b", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3


# authorization models
def evaluate(model, tuples):
    """Facts by trying all rules until nothing is new; a difference only over what is settled."""
    allowed = [t for t in tuples if (t[3], "" if "#" not in t[4] and t[4] != "*" else "*" if t[4] == "*" else t[4].split("#")[1]) in (model.subjects(t[0], t[2]) if t[0] in model.types and t[2] in model.types[t[0]] else ())]
    objects = defaultdict(set)
    for t in allowed:
        objects[t[0]].add(t[1])
        objects[t[3]].add(t[4].split("#")[0])
    facts = {}

    def of(rule, kind, i, name):
        if isinstance(rule, authzmodel.Direct):
            out = set()
            for t in allowed:
                if t[:3] == (kind, i, name):
                    who, _, rel = t[4].partition("#")
                    out |= facts.get((t[3], who, rel), set()) if rel else {(t[3], who)}
            return out
        if isinstance(rule, authzmodel.Computed):
            return facts.get((kind, i, rule.relation), set())
        if isinstance(rule, authzmodel.From):
            return set().union(*(facts.get((t[3], t[4], rule.relation), set()) for t in allowed if t[:3] == (kind, i, rule.tupleset)))
        parts = [of(p, kind, i, name) for p in rule.parts]
        return set.union(*parts) if rule.op == "or" else set.intersection(*parts) if rule.op == "and" else parts[0] - parts[1]

    for group in model.strata():
        while True:
            new = {(k, i, r): of(model.types[k][r], k, i, r) for k, r in group for i in objects[k]}
            if all(facts.get(n, set()) == v for n, v in new.items()):
                break
            facts |= new
    return {(k, i, r, *u) for (k, i, r), us in facts.items() for u in us}


MODEL = """
model
  schema 1.1
type user
type bot
type group
  relations
    define member: [user, bot, group#member] or lead
    define lead: [user]
type folder
  relations
    define parent: [folder]
    define owner: [user, group#member]
    define viewer: [user, user:*] or owner or viewer from parent   # inherited
type doc
  relations
    define parent: [folder]
    define blocked: [user, group#member]
    define trained: [user, group#member]
    define reader: [user] or owner from parent
    define editor: (reader and trained) but not blocked
"""


def test_model_by_brute_force(spark):
    r = random.Random(11)
    model = authzmodel.Model.parse(MODEL)
    u, g, f, d = (lambda n: lambda: f"{n}{r.randrange(6)}")("u"), lambda: f"g{r.randrange(5)}", lambda: f"f{r.randrange(5)}", lambda: f"d{r.randrange(5)}"
    make = [
        lambda: ("group", g(), "member", "user", u()), lambda: ("group", g(), "member", "group", g() + "#member"), lambda: ("group", g(), "lead", "user", u()), lambda: ("group", g(), "member", "bot", "b1"),
        lambda: ("folder", f(), "parent", "folder", f()), lambda: ("folder", f(), "owner", r.choice(["user", "group"]), r.choice([u(), g() + "#member"])), lambda: ("folder", f(), "viewer", "user", r.choice([u(), u(), "*"])),
        lambda: ("doc", d(), "parent", "folder", f()), lambda: ("doc", d(), "blocked", "group", g() + "#member"), lambda: ("doc", d(), "trained", "user", u()), lambda: ("doc", d(), "trained", "group", g() + "#member"), lambda: ("doc", d(), "reader", "user", u()),
        lambda: ("doc", d(), "reader", "bot", "b1"), lambda: ("doc", d(), "nothing", "user", u()), lambda: ("car", "c", "member", "user", u()),
    ]
    for seed in range(3):
        r.seed(seed)
        rows = [r.choice(make)() for _ in range(70)]
        tuples = spark.createDataFrame(rows + rows[:5], "object_type string, object_id string, relation string, subject_type string, subject_id string")
        want = evaluate(model, set(rows))
        assert {tuple(x) for x in model.permissions(tuples).collect()} == want
        asked = [(k, i, rel, "user", f"u{n}") for k, i, rel in sorted({x[:3] for x in want})[::3] for n in range(3)] + [("doc", "none", "editor", "user", "u1"), ("group", "g0", "member", "bot", "b1")]
        got = model.check(spark.createDataFrame(asked, "object_type string, object_id string, relation string, user_type string, user_id string"), tuples).collect()
        assert {tuple(x)[:5]: x.allowed for x in got} == {q: q in want or (*q[:4], "*") in want for q in asked}
        bad = {tuple(x) for x in model.rejected(tuples).collect()}
        assert bad >= {x for x in rows if x[0] == "car" or x[2] == "nothing" or x[0] == "doc" and x[3] == "bot"}
    assert {x[0] for x in model.list_objects(tuples, "user", "u1", "viewer", "folder").collect()} == {x[1] for x in want if x[0] == "folder" and x[2] == "viewer" and x[4] in ("u1", "*")}
    assert model.permissions(tuples.limit(0)).count() == 0


def test_model_by_classes(spark):
    """Leaf objects by classes: the same facts, counts and answers as by brute force, with users of their own and in groups."""
    r = random.Random(5)
    model = authzmodel.Model.parse(MODEL.replace("define reader: [user]", "define watcher: [user, user:*]\n    define reader: [user]"))
    u, g, f, d = lambda: f"u{r.randrange(9)}", lambda: f"g{r.randrange(3)}", lambda: f"f{r.randrange(3)}", lambda: f"d{r.randrange(9)}"
    make = [
        lambda: ("group", g(), "member", "user", u()), lambda: ("group", g(), "member", "group", g() + "#member"), lambda: ("group", g(), "member", "bot", "b1"), lambda: ("folder", f(), "parent", "folder", f()),
        lambda: ("folder", f(), "owner", r.choice(["user", "group"]), r.choice([u(), g() + "#member"])), lambda: ("doc", d(), "parent", "folder", f()), lambda: ("doc", d(), "blocked", "group", g() + "#member"),
        lambda: ("doc", d(), "trained", "user", u()), lambda: ("doc", d(), "trained", "group", g() + "#member"), lambda: ("doc", d(), "reader", "user", u()), lambda: ("doc", d(), "blocked", "user", u()), lambda: ("doc", d(), "watcher", "user", r.choice([u(), "*"])),
    ]
    assert model.leaves() == ["doc"]
    rows = {r.choice(make)() for _ in range(90)}
    tuples = spark.createDataFrame(sorted(rows), "object_type string, object_id string, relation string, subject_type string, subject_id string")
    want = {x for x in evaluate(model, rows) if x[0] == "doc"}
    found = model.by_class(tuples)
    assert Counter(map(tuple, found.expanded().collect())) == Counter(want)
    counts = Counter((x[3], x[4], x[0], x[2]) for x in want if x[3] in ("user", "bot") and x[4] != "*")
    assert {tuple(x)[:4]: x.n for x in found.objects_per_user().collect()} == counts
    asked = [("doc", f"d{i}", rel, *who) for i in range(9) for rel in ("parent", "watcher", "reader", "editor") for who in [("user", f"u{n}") for n in range(0, 10, 3)] + [("folder", "f1"), ("bot", "b1")]]
    q = spark.createDataFrame(asked, "object_type string, object_id string, relation string, user_type string, user_id string")
    assert {tuple(x)[:5]: x.allowed for x in model.check(q, tuples, q, q).collect()} == {x: x in want or (*x[:4], "*") in want for x in asked}


@pytest.mark.parametrize(("name", "most"), [("model_teams_in_teams", 1400), ("model_checks", 1400), ("model_folders", 4000)])
def test_models_make_no_row_for_each_permission(spark, monkeypatch, name, most):
    rows, was = [], authzmodel.Model.permissions

    def counted(self, tuples):
        found = was(self, tuples)
        rows.append(tuples.count() + found.where("object_type = 'document'").count())
        return found

    monkeypatch.setattr(authzmodel.Model, "permissions", counted)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert rows and max(rows) < most  # of 1,500 orders, 200 parts and 150 customers


@pytest.mark.parametrize(("few", "block"), [(1, 2), (1000, 4096)])
def test_all_objects_are_checked_with_all_users(spark, monkeypatch, few, block):
    """As the join's questions one by one: users of their own, everyone, classes, objects as users, folders that are no leaves, rows twice, nulls."""
    monkeypatch.setattr(authzmodel, "FEW", few)
    monkeypatch.setattr(authzmodel, "BLOCK", block)
    text = "type user\ntype group\n relations\n define member: [user, group#member]\ntype folder\n relations\n define owner: [user, group#member]\ntype doc\n relations\n define parent: [folder]\n define blocked: [user]\n define reader: ([user, user:*, group#member] or owner from parent) but not blocked\n define open: [user, user:*, folder]"
    model = authzmodel.Model.parse(text.replace("[user, user:*, group#member]", "[user, group#member]"))
    r = random.Random(few)
    u, g, d = (lambda: f"u{r.randrange(12)}"), (lambda: f"g{r.randrange(4)}"), (lambda: f"d{r.randrange(8)}")
    make = [lambda: ("group", g(), "member", "user", u()), lambda: ("group", g(), "member", "group", g() + "#member"), lambda: ("folder", "f1", "owner", "group", g() + "#member"), lambda: ("doc", d(), "parent", "folder", "f1"), lambda: ("doc", d(), "blocked", "user", u()), lambda: ("doc", d(), "reader", "user", u()), lambda: ("doc", d(), "reader", "group", g() + "#member"), lambda: ("doc", d(), "open", r.choice(["user", "folder"]), r.choice(["f1", "*", u()]))]
    tuples = spark.createDataFrame(sorted({r.choice(make)() for _ in range(60)}), "object_type string, object_id string, relation string, subject_type string, subject_id string")
    asked = [("doc", f"d{i}", x, i % 2 if i else None) for i in range(9) for x in ("reader", "open", "blocked")] + [("folder", "f1", "owner", 1), ("doc", "d1", "reader", 1)]
    objects = spark.createDataFrame(asked, "object_type string, object_id string, relation string, r int")
    users = spark.createDataFrame([("user", f"u{i}", i % 2) for i in range(14)] + [("folder", "f1", 0), ("user", "u3", 1)], "user_type string, user_id string, r int")
    q = objects.join(users, "r").select(*authzmodel.FACT)
    want = Counter(map(tuple, model.check(q, tuples).collect()))
    assert Counter(map(tuple, model.check_all(tuples, objects, users, ["r"]).collect())) == want
    assert {x[-1] for x in want} == {True, False} and max(want.values()) > 1


def test_checks_are_not_joined_one_by_one(spark):
    """No step of the query exchanges a row for each question."""
    df = registry.QUERIES["model_checks"](spark, "/root/testdata/sf0.01")
    n = df.count()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert n == 3000 and plan.index("Generate explode(ids") < plan.index("Join")


def test_model_of_the_survey(spark):
    """The demonstrated model and tuples, from text and in their text form."""
    rows = [("user:alice", "owner", "document:readme"), ("user:bob", "owner", "document:design"), ("user:carol", "editor", "document:design"), ("user:carol", "member", "team:platform"), ("user:dave", "member", "team:platform"), ("team:platform#member", "viewer", "document:readme")]
    tuples = authzmodel.triples(spark.createDataFrame(rows, "user string, relation string, object string"))
    model = authzmodel.Model.parse(relations.TEAMS)
    asked = [("alice", "viewer", "readme", True), ("bob", "viewer", "design", True), ("carol", "viewer", "design", True), ("dave", "viewer", "readme", True), ("dave", "editor", "readme", False), ("alice", "viewer", "design", False)]
    q = spark.createDataFrame([("document", o, r, "user", u) for u, r, o, _ in asked], "object_type string, object_id string, relation string, user_type string, user_id string")
    assert {(x.user_id, x.relation, x.object_id, x.allowed) for x in model.check(q, tuples).collect()} == set(asked)
    assert model.rejected(tuples).count() == 0


@pytest.mark.parametrize(
    "text",
    ["type a\n relations\n define x: [b]", "type a\n relations\n define x: y", "type a\ntype a", "type user\ntype a\n relations\n define x: [user] or [user] and [user]", "type user\ntype a\n relations\n define x: [user] but not x", "type user\ntype a\n relations\n define p: [a]\n define x: y from p", "hello", "type user\ntype a\n relations\n define x: [user", "type user\ntype a\n relations\n define x: [user]\n define x: [user]", "type user\ntype a\n relations\n define x: ([user] and y)\n define y: x"],
)
def test_model_rejects(text):
    with pytest.raises(authzmodel.ModelError):
        authzmodel.Model.parse(text)


def test_model_json_is_the_text():
    this, from_parent = {"this": {}}, {"tupleToUserset": {"tupleset": {"relation": "parent"}, "computedUserset": {"relation": "viewer"}}}
    assert authzmodel.Model.from_json(json.dumps(relations.FOLDERS)) == authzmodel.Model.parse("type user\ntype folder\n relations\n define parent: [folder]\n define viewer: [user] or viewer from parent\ntype document\n relations\n define parent: [folder]\n define blocked: [user]\n define viewer: ([user] or viewer from parent) but not blocked")
    with pytest.raises(authzmodel.ModelError):
        authzmodel.Model.from_json({"type_definitions": [{"type": "a", "relations": {"x": {"what": {}}}}]})
    assert this and from_parent


# intervals
def test_intervals(spark):
    """Points, long and short ones, open and empty ones, ties, keys."""
    r = random.Random(2)
    rows = [(i, r.choice("ab") if i % 9 else None, None if i % 23 == 0 else r.randrange(200), 0) for i in range(150)]
    rows = [(i, k, lo, None if i % 31 == 0 else (lo or 0) + r.choice([0, 1, 2, 3, 10, 64, 150])) for i, k, lo, _ in rows]
    df = spark.createDataFrame(rows, "i int, k string, lo long, hi long")
    big = 10**6
    close = lambda x: (-big if x[2] is None else x[2], big if x[3] is None else x[3])
    meet = lambda a, b: close(a)[0] < close(a)[1] and close(b)[0] < close(b)[1] and close(a)[0] < close(b)[1] and close(b)[0] < close(a)[1]
    half = [x for x in rows if x[0] % 3]
    for keys in ((), ("k",)):
        same = lambda a, b: not keys or a[1] is not None and a[1] == b[1]  # noqa: E731,B023
        got = Counter((x["left"].i, x["right"].i) for x in intervals.overlap_pairs(df, df.where("i % 3 <> 0"), "lo", "hi", keys).collect())
        assert got == Counter((a[0], b[0]) for a in rows for b in half if same(a, b) and meet(a, b))
        hit = Counter(x.i for x in intervals.conflicting(df, df.where("i % 7 = 0"), "lo", "hi", keys).collect())
        assert hit == Counter(a[0] for a in rows if any(same(a, b) and meet(a, b) for b in rows if b[0] % 7 == 0))
        late = {x.i for x in intervals.overlapping(df, "lo", "hi", keys).collect()}
        left = [x for x in rows if x[0] not in late and (not keys or x[1] is not None)]
        assert not any(a[0] < b[0] and same(a, b) and meet(a, b) for a in left for b in left)
        assert all(any(a[0] != b[0] and same(a, b) and meet(a, b) for b in rows) for a in rows if a[0] in late)
    none = df.limit(0)
    assert intervals.overlap_pairs(none, none, "lo", "hi").count() == 0 and intervals.conflicting(df, none, "lo", "hi").count() == 0 and intervals.overlapping(none, "lo", "hi").count() == 0


def test_levels_are_joined():
    """Lengths that differ little are put at one level; a few long intervals leave many short ones where they are."""
    assert intervals.joined_levels({32: 1, 33: 1, 34: 2, 35: 5, 36: 10, 37: 11}) == dict.fromkeys(range(32, 38), 37)
    assert intervals.joined_levels({3: 1_000_000, 20: 10}) == {3: 3, 20: 20}
    assert intervals.joined_levels({}) == {}


def test_intervals_of_like_lengths_are_exchanged_once(spark):
    d = spark.range(60).select("id", F.col("id").alias("lo"), (F.col("id") + 1 + F.col("id") % 30).alias("hi"))
    found = intervals.overlap_pairs(d, d, "lo", "hi")
    assert "Union" not in found._jdf.queryExecution().toString()
    rows = [(i, i, i + 1 + i % 30) for i in range(60)]
    assert Counter((x["left"].id, x["right"].id) for x in found.collect()) == Counter((a[0], b[0]) for a in rows for b in rows if a[1] < b[2] and b[1] < a[2])


@pytest.mark.parametrize("block", [3, 4096])
def test_twos_are_made_without_other_candidates(spark, monkeypatch, block):
    """Each two rows that overlap, once; blocks of any size, rows alike, open and empty ones, keys."""
    monkeypatch.setattr(intervals, "BLOCK", block)
    monkeypatch.setattr(intervals, "SMALL_BLOCK", min(block, intervals.SMALL_BLOCK))
    r = random.Random(block)
    far = 10**9
    rows = [(i, r.choice("ab") if i % 9 else None, None if i % 23 == 0 else (lo := r.randrange(60)), None if i % 19 == 0 else lo + r.choice([0, 1, 2, 3, 30])) for i in range(1, 130)]
    df = spark.createDataFrame(rows, "i int, k string, lo int, hi int")
    close = [(i, k, -far if lo is None else lo, far if hi is None else hi) for i, k, lo, hi in rows]
    for keys in ((), ("k",)):
        want = Counter((a[0], b[0]) for a in close for b in close if a[0] < b[0] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] and b[2] < a[3] and (not keys or a[1] is not None and a[1] == b[1]))
        got = intervals.overlap_twos(df, F.struct("i", "lo"), "lo", "hi", keys)
        assert Counter((min(x[0].i, x[1].i), max(x[0].i, x[1].i)) for x in got.collect()) == want
        assert all((x[0].lo is None) or x[1].lo is not None and x[0].lo <= x[1].lo for x in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.overlap_twos(df.limit(0), F.col("i"), "lo", "hi").count() == 0


def test_overlapping_orders_without_a_time(spark, tmp_path):
    """In SQL, a row without a time overlaps none."""
    day = datetime.datetime(1995, 1, 1)
    rows = [(1, 1, day), (2, 1, day), (3, 1, None), (None, 1, day), (29, 1, day + datetime.timedelta(hours=1)), (4, 1, day + datetime.timedelta(hours=3)), (5, 1, day + datetime.timedelta(days=3))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(map(tuple, registry.QUERIES["overlapping_orders"](spark, str(tmp_path)).collect()))
    assert got == [(1, 2), (1, 29), (2, 29), (4, 29)]


def test_intervals_of_doubles(spark):
    rows = [(1, 0.25, 0.5), (2, 0.4, None), (3, None, 0.3), (4, 0.5, 0.5), (5, -1e9, 1e9), (6, 2.0, 2.0000001)]
    d = spark.createDataFrame(rows, "i int, lo double, hi double")
    got = {(x["left"].i, x["right"].i) for x in intervals.overlap_pairs(d, d, "lo", "hi").where("left.i < right.i").collect()}
    assert got == {(1, 2), (1, 3), (1, 5), (2, 5), (2, 6), (3, 5), (5, 6)}
    assert {x.i for x in intervals.conflicting(d.where("i in (1, 4, 6)"), d.where("i = 2"), "lo", "hi").collect()} == {1, 6}


def test_exclusion_of_a_hot_key(spark):
    """Many ranges of one key: what a running maximum over the whole key finds."""
    r = random.Random(6)
    rows = [(i, "k" if i % 5 else "other", r.randrange(3000), 0) for i in range(800)]
    rows = [(i, k, lo, lo + r.choice([1, 2, 5])) for i, k, lo, _ in rows]
    df = spark.createDataFrame(rows, "i int, k string, lo int, hi int")
    want = set()
    for key in ("k", "other"):
        top = -1
        for i, _, lo, hi in sorted((x for x in rows if x[1] == key), key=lambda x: (x[2], x[3])):
            if top > lo:
                want.add((key, lo, hi))
            top = max(top, hi)
    assert {(x.k, x.lo, x.hi) for x in writes.overlapping(df, ["k"], "lo", "hi").collect()} == want


def test_intervals_of_times(spark):
    t = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP'2026-01-01 10:00', TIMESTAMP'2026-01-01 11:00'), (2, TIMESTAMP'2026-01-01 10:59:59', TIMESTAMP'2026-01-03 00:00'), (3, TIMESTAMP'2026-01-01 11:00', TIMESTAMP'2026-01-01 12:00') AS v(i, lo, hi)")
    assert {(x["left"].i, x["right"].i) for x in intervals.overlap_pairs(t, t, "lo", "hi").where("left.i < right.i").collect()} == {(1, 2), (2, 3)}
    d = spark.sql("SELECT * FROM VALUES (1, DATE'2026-01-01', DATE'2026-02-01'), (2, DATE'2026-02-01', DATE'2026-02-02') AS v(i, lo, hi)")
    assert intervals.overlapping(d, "lo", "hi").count() == 0
    plan = intervals.conflicting(t, t, "lo", "hi")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


# walks
def test_walks(spark):
    r = random.Random(4)
    edges = [(r.randrange(30), r.randrange(33)) for _ in range(45)]  # some lead to no vertex; cycles
    g = graph.PropertyGraph(spark.createDataFrame([(i, f"n{i}") for i in range(30)], "id int, name string"), spark.createDataFrame(edges, "src int, dst int"))

    def bfs(starts, pairs, most=99):
        depth, now = dict.fromkeys(starts, 0), set(starts)
        for h in range(1, most + 1):
            now = {b for a, b in pairs if a in now and b < 30} - set(depth)
            depth |= dict.fromkeys(now, h)
        return depth

    both = {"out": edges, "in": [(b, a) for a, b in edges], "any": edges + [(b, a) for a, b in edges]}
    for way, pairs in both.items():
        for most in (None, 0, 2):
            got = {x.id: x.depth for x in graph.walk(g, F.col("id") < 3, way, most).collect()}
            assert got == bfs({0, 1, 2}, pairs, 99 if most is None else most), (way, most)
    ways, now = Counter(), [(0,)]
    for _ in range(3):
        now = [(*p, b) for p in now for a, b in edges if a == p[-1] and b not in p and b < 30]
        ways.update(now)
    assert Counter(tuple(x.path) for x in graph.trails(g, F.col("id") == 0, 3).collect()) == ways
    plan = graph.nested(g, F.col("id") == 0, {"name": {}, "to": {"name": {}, "to": {"name": {}}}}, "to", "name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 4


def test_errors_in_the_envelope(spark):
    d = spark.sql("SELECT named_struct('name', 'ada') AS node, array('secret: not allowed') AS errors")
    assert json.loads(graph.response(d, "author").first().json) == {"data": {"author": {"name": "ada"}}, "errors": ["secret: not allowed"]}
    assert json.loads(graph.response(d.drop("errors"), "author").first().json)["errors"] == []


# table functions
def test_json_table(spark):
    tablefunctions.register(spark)
    docs = [(1, '[{"id":1,"name":"ada","tags":["math"]},{"id":2,"name":"linus","tags":["git"]}]'), (2, None), (3, "nope"), (4, '{"id":3}'), (5, '[{"id":"7","name":{"a":1.50}},{"id":2.5,"name":null},5,{"id":3000000000,"name":true}]')]
    spark.createDataFrame(docs, "k int, body string").createOrReplaceTempView("test_docs")
    ask = lambda columns, path="$[*]": [tuple(x) for x in spark.sql(f"SELECT k, j.* FROM test_docs, LATERAL json_table(body, '{path}', '{columns}') j ORDER BY k").collect()]
    got = ask("rn FOR ORDINALITY, id INT PATH ''$.id'', name text, tag string path ''$.tags[0]'' default ''-'', has boolean exists path ''$.tags''")
    assert got == [(1, 1, 1, "ada", "math", True), (1, 2, 2, "linus", "git", True), (5, 1, 7, '{"a":1.5}', "-", False), (5, 2, None, None, "-", False), (5, 3, None, None, "-", False), (5, 4, None, "true", "-", False)]
    assert ask("id BIGINT, d DECIMAL(5,2) PATH ''$.name.a''") == [(1, 1, None), (1, 2, None), (5, 7, __import__("decimal").Decimal("1.50")), (5, None, None), (5, None, None), (5, 3000000000, None)]
    assert ask("id INT", "$") == [(1, None), (4, 3), (5, None)]
    assert spark.sql("SELECT * FROM json_table('{\"a b\":[[1,2],[3]]}', '$[\"a b\"][*][0]', 'x INT PATH ''$''')").collect() == [(1,), (3,)]
    for bad in ("json_table('[]', '$[', 'x INT')", "json_table('[]', '$', '')", "json_table('[]', '$', 'x WHAT')", "json_table('[]', '$', 'x INT y')"):
        with pytest.raises(Exception, match="path|columns|type"):
            spark.sql(f"SELECT * FROM {bad}")


def test_graph_function(spark):
    spark.createDataFrame([(1, "ada"), (2, "linus"), (3, "grace")], "id int, name string").createOrReplaceTempView("test_person")
    spark.createDataFrame([(1, 2, 2020), (3, 1, 2021)], "src int, dst int, since int").createOrReplaceTempView("test_follows")
    graph.table_function(spark, "test_near", "who STRING", "test_person", "test_follows", ["any"], "v0.name = who", {"name": "v1.name", "since": "e1.since"})
    got = spark.sql("SELECT p.name AS of, n.* FROM test_person p, LATERAL test_near(p.name) n WHERE n.since > 2000")
    assert {tuple(x) for x in got.collect()} == {("ada", "linus", 2020), ("ada", "grace", 2021), ("linus", "ada", 2020), ("grace", "ada", 2021)}
    graph.table_function(spark, "test_two", "", "test_person", "test_follows", ["out", "out"], "true", {"a": "v0.name", "c": "v2.name"})
    assert [tuple(x) for x in spark.sql("SELECT * FROM test_two()").collect()] == [("grace", "linus")]
    with pytest.raises(ValueError):
        graph.table_function(spark, "x; drop", "", "test_person", "test_follows", [], "true", {"a": "v0.name"})


# policies under SQL
def test_gate(spark, tmp_path):
    spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "alice")], "id int, owner string").write.parquet(str(tmp_path / "notes"))
    spark.createDataFrame([("x",)], "v string").createOrReplaceTempView("test_hidden")
    load = lambda s: s.read.parquet(str(tmp_path / "notes"))
    gate = authz.Gate(spark, {"notes": (load, authz.Policy(lambda who: F.col("owner") == who)), "forced": (load, authz.Policy(lambda who: F.col("owner") == who, force=True))})
    reader = frozenset({"select"})
    alice, bob, owner, stranger = authz.Principal("alice", privileges=reader), authz.Principal("bob", privileges=reader), authz.Principal("boss", owner=True), authz.Principal("eve")
    ids = lambda who, text: sorted(x[0] for x in gate.sql(who, text).collect())
    for who, want in ((alice, [1, 3]), (bob, [2]), (owner, [1, 2, 3])):
        assert ids(who, "SELECT id FROM notes") == want
        assert ids(who, "WITH n AS (SELECT * FROM notes) SELECT a.id FROM n a WHERE a.id IN (SELECT id FROM Notes) OR EXISTS (SELECT 1 FROM n WHERE false)") == want
    assert ids(owner, "SELECT id FROM forced") == []
    for who, text in [(stranger, "SELECT * FROM notes"), (alice, "SELECT * FROM test_hidden"), (alice, f"SELECT * FROM parquet.`{tmp_path}/notes`"), (alice, "SELECT (SELECT max(v) FROM test_hidden) FROM notes"), (alice, "DROP VIEW notes"), (alice, "CREATE TEMPORARY VIEW x AS SELECT 1"), (alice, "SET a=b")]:
        with pytest.raises(PermissionError):
            gate.sql(who, text)
    assert [x[0] for x in gate.sql(alice, "SELECT count(*) FROM notes WHERE id > :least", {"least": 1}).collect()] == [1]


# data sources
def test_json_array(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit('a"\n,['), "id")).alias("text"))
    for n, name in ((7, "many"), (1, "one")):
        folder = tmp_path / name
        for _ in range(2):  # written again, it is replaced
            datasources.export_json_array(df.where("id < 990").repartition(n), str(folder))
        files = sorted(x for x in folder.iterdir() if not x.name.startswith("."))
        whole = json.loads("".join(x.read_text() for x in files))
        assert sorted((x["id"], x["text"]) for x in whole) == [(i, None if i % 3 == 0 else f'a"\n,[{i}') for i in range(990)]
        assert Counter(datasources.read_json_array(spark, str(folder), df.schema).collect()) == Counter(df.where("id < 990").collect())
    datasources.export_json_array(df.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(x.read_text() for x in sorted((tmp_path / "none").iterdir()) if not x.name.startswith("."))) == []


def test_channel(spark, tmp_path):
    """A listener goes on where it was, after a restart too, and hears only its channel."""
    folder, seen = str(tmp_path / "channel"), []
    assert datasources.notify(folder, [("orders", "one"), ("other", "x"), ("orders", "two")]) == 1
    hear = lambda: relays.drain(datasources.listen(spark, folder, "orders"), str(tmp_path / "cp"), lambda df, n: seen.append([(r.seq, r.payload) for r in df.orderBy("seq", "place").collect()]))
    hear()
    assert datasources.notify(folder, [("orders", "three\nlines é")]) == 2
    hear()
    hear()
    assert [x for x in seen if x] == [[(1, "one"), (1, "two")], [(2, "three\nlines é")]]


# processors
def test_processor(spark, tmp_path):
    """Versions, transactions over keys, a restart, and expiry."""
    folder, ddl = str(tmp_path / "ops"), "store string, seq long, txn string, kind string, key string, value string, expected long, ttl_ms long, ts timestamp"
    at = lambda s: f"2026-01-01 00:00:{s:02d}"

    def send(*ops):
        rows = [(o.get("store", "s"), o["seq"], o.get("txn"), o["kind"], o["key"], o.get("value"), o.get("expected"), o.get("ttl"), at(o["at"])) for o in ops]
        df = spark.createDataFrame(rows, ddl.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
        got = []
        relays.drain(processors.keyed_store(spark.readStream.schema(ddl).parquet(folder)), str(tmp_path / "cp"), lambda d, n: got.extend(d.collect()))
        return {(x.store, x.seq, x.kind, x.key): (x.accepted, x.version, x.value, x.revision) for x in got}

    # foreachBatch takes the update mode of drain's writer
    first = send({"seq": 1, "kind": "put", "key": "a", "value": "1", "at": 1}, {"seq": 2, "kind": "put", "key": "a", "value": "2", "expected": 1, "at": 1}, {"seq": 3, "kind": "put", "key": "a", "value": "3", "expected": 1, "at": 1}, {"seq": 4, "kind": "put", "key": "t", "value": "soon gone", "ttl": 5000, "at": 1}, {"seq": 1, "store": "other", "kind": "get", "key": "a", "at": 1})
    assert first["s", 2, "put", "a"] == (True, 2, "2", 2) and first["s", 3, "put", "a"] == (False, 2, "2", 2) and first["other", 1, "get", "a"] == (True, 0, None, 0)
    # after a restart: one transaction whose last condition fails, one that holds
    second = send({"seq": 5, "txn": "x", "kind": "put", "key": "a", "value": "no", "at": 3}, {"seq": 6, "txn": "x", "kind": "delete", "key": "b", "expected": 9, "at": 3}, {"seq": 7, "txn": "y", "kind": "put", "key": "b", "value": "b1", "expected": 0, "at": 3}, {"seq": 8, "txn": "y", "kind": "put", "key": "b", "value": "b2", "expected": 1, "at": 3}, {"seq": 9, "txn": "y", "kind": "delete", "key": "a", "at": 3}, {"seq": 10, "kind": "get", "key": "t", "at": 3})
    assert second["s", 5, "put", "a"] == (False, 2, "2", 3) and second["s", 8, "put", "b"] == (True, 2, "b2", 4) and second["s", 9, "delete", "a"] == (True, 0, None, 4) and second["s", 10, "get", "t"] == (True, 1, "soon gone", 4)
    third = send({"seq": 11, "kind": "get", "key": "t", "at": 20}, {"seq": 12, "kind": "get", "key": "b", "at": 20}, {"seq": 13, "kind": "get", "key": "a", "at": 20})
    assert third["s", 11, "get", "t"] == (True, 0, None, 4) and third["s", 12, "get", "b"] == (True, 2, "b2", 4) and third["s", 13, "get", "a"] == (True, 0, None, 4)
    later = send({"seq": 14, "kind": "get", "key": "b", "at": 30})
    assert {**third, **later}.get(("s", None, "expired", "t")) == (True, 1, "soon gone", 4)


# query texts
@pytest.fixture()
def school(spark):
    author = spark.createDataFrame([("a1", "ada", "london"), ("a2", "grace", "new york")], "id string, name string, city string")
    book = spark.createDataFrame([("b1", "notes", 1843, "a1"), ("b2", "on looms", 1845, "a1"), ("b3", "the compiler", 1952, "a2")], "id string, title string, year int, author_id string")
    types = {"Author": selection.Type(author, {"books": selection.Link("Book", "id", "author_id", "year", {"before": lambda v: F.col("year") < v, "in": lambda v: F.col("year").isin(v)}, {"before": "Int", "in": "[Int!]"})}), "Book": selection.Type(book)}
    return types, {"author": selection.Root("Author", {"id": lambda v: F.col("id") == v}, {}, {"id": "ID!"}), "authors": selection.Root("Author", {}, {"city": lambda v: F.col("city") == v}, {"city": "String"})}


def nodes(found):
    return sorted((x.node.asDict(recursive=True) for x in found.collect()), key=str)


def test_query_texts(school):
    run = lambda text, **v: {k: nodes(d) for k, d in selection.run(text, *school, v).items()}
    assert run('{ author(id: "a1") { __typename kind: __typename ... on Author { name } ... { books { __typename year } } } }') == {"author": [{"__typename": "Author", "kind": "Author", "name": "ada", "books": [{"__typename": "Book", "year": 1843}, {"__typename": "Book", "year": 1845}]}]}
    text = "query ($yes: Boolean!, $in: [Int!] = [1843, 1952]) { authors { name @skip(if: $yes) city @include(if: $yes) books(in: $in) @include(if: true) { title } } gone: authors @skip(if: true) { name } }"
    assert run(text, yes=True) == {"authors": [{"city": "london", "books": [{"title": "notes"}]}, {"city": "new york", "books": [{"title": "the compiler"}]}]}
    assert run(text, yes=False, **{"in": [1845]})["authors"] == [{"name": "ada", "books": [{"title": "on looms"}]}, {"name": "grace", "books": []}]
    # one name twice is one field, with both selections
    assert run('{ author(id: "a2") { books { title } ...f } } fragment f on Author { books { year } }') == {"author": [{"books": [{"title": "the compiler", "year": 1952}]}]}


@pytest.mark.parametrize(
    "text, variables",
    [
        ("query ($b: Int) { authors { books(before: $b) { title } } }", {"b": "x"}), ("query ($b: Int) { authors { books(before: $b) { title } } }", {"b": 2.5}), ("query ($b: Int) { authors { books(before: $b) { title } } }", {"b": True}), ("query ($b: String) { authors { books(before: $b) { title } } }", {"b": "x"}),
        ("query ($i: ID) { author(id: $i) { name } }", {"i": "a1"}), ("{ author(id: 1.5) { name } }", {}), ('{ authors { books(before: "x") { title } } }', {}), ("{ authors { books(in: [1, null]) { title } } }", {}), ("query ($b: What) { authors { name } }", {"b": 1}), ("query ($b: Int) { authors { name } }", {"c": 1}),
        ("{ authors { ... on Book { title } } }", {}), ("{ authors { ... on Nothing { title } } }", {}), ("{ authors { ...f } } fragment f on Book { title }", {}), ("{ authors { name } } fragment f on Book { title }", {}), ("{ authors { name @what } }", {}), ("{ authors { name @skip } }", {}), ("{ authors { name @skip(if: 1) } }", {}), ("query ($b: Boolean) { authors { name @skip(if: $b) } }", {"b": True}),
        ("{ authors { x: name x: city } }", {}), ("{ authors { books(before: 1) { title } books(before: 2) { title } } }", {}), ("{ authors { } }", {}), ("{ authors }", {}), ("mutation { authors { name } }", {}), ("subscription { authors { name } }", {}), ("{ authors { name } } { authors { city } }", {}), ("{ authors(city: $c) { name } }", {}),
    ],
)
def test_query_texts_rejected(school, text, variables):
    with pytest.raises(selection.QueryError):
        selection.run(text, *school, variables)


def test_mutations(spark, school):
    types, roots = school

    def rename(types, given):
        old = types["Author"]
        rows = old.rows.withColumn("name", F.when(F.col("id") == given["id"], F.lit(given["name"])).otherwise(F.col("name")))
        return types | {"Author": selection.Type(rows, old.links)}, rows.where(F.col("id") == given["id"])

    change = {"rename": selection.Mutation("Author", rename, {"id": "ID!", "name": "String!"})}
    after, found = selection.mutate('mutation M($n: String!) { one: rename(id: "a1", name: $n) { name books { title } } two: rename(id: "a1", name: "last") { name city } }', types, change, {"n": "first"})
    assert nodes(found["one"]) == [{"name": "first", "books": [{"title": "notes"}, {"title": "on looms"}]}] and nodes(found["two"]) == [{"name": "last", "city": "london"}]
    assert [x["name"] for x in nodes(selection.run("{ authors { name } }", after, roots)["authors"])] == ["grace", "last"]
    for bad in ('mutation { rename(id: "a1") { name } }', 'mutation { rename(id: "a1", name: 7) { name } }', "mutation { other { name } }", "{ authors { name } }"):
        with pytest.raises(selection.QueryError):
            selection.mutate(bad, types, change)


def test_introspection(spark, school):
    types, roots = selection.with_introspection(spark, *school, {"rename": selection.Mutation("Author", None, {"id": "ID!"})})
    got = nodes(selection.run("{ __schema { queryType { name fields { name type args { name type } } } mutationType { fields { name } } types { name kind } } }", types, roots)["__schema"])[0]
    assert got["queryType"] == [{"name": "Query", "fields": [{"name": "author", "type": "[Author!]!", "args": [{"name": "id", "type": "ID!"}]}, {"name": "authors", "type": "[Author!]!", "args": [{"name": "city", "type": "String"}]}]}]
    assert got["mutationType"] == [{"fields": [{"name": "rename"}]}] and {"name": "Book", "kind": "OBJECT"} in got["types"] and {"name": "Int", "kind": "SCALAR"} in got["types"]
    book = nodes(selection.run('{ __type(name: "Author") { __typename fields { name type args { name type } } } }', types, roots)["__type"])[0]
    assert {f["name"]: f["type"] for f in book["fields"]} == {"id": "String", "name": "String", "city": "String", "books": "[Book!]!"} and book["fields"][-1]["args"] == [{"name": "before", "type": "Int"}, {"name": "in", "type": "[Int!]"}]
    assert nodes(selection.run('{ __type(name: "None") { name } }', types, roots)["__type"]) == []


def test_object_counts(spark):
    """As many as permissions gives, with users of several groups, repeated grants and nulls."""
    rows = [("document", f"d{i}", "owner" if i % 3 else "viewer", "user", None if i == 7 else f"u{i % 5}") for i in range(20)]
    rows += [("document", f"d{i}", "editor" if i % 2 else "viewer", "team", f"t{i % 4}") for i in range(0, 20, 3)] + [("folder", "d3", "viewer", "team", "t0"), ("document", None, "viewer", "team", "t1"), ("document", "d0", "viewer", "team", "t1"), ("document", "d1", "viewer", "team", None)]
    rows += [("team", f"t{g}", "member", "user", u) for g, u in ((0, "u0"), (1, "u0"), (0, "u1"), (2, "u2"), (2, "u2"), (3, "u9"), (1, None), (8, "u1"), (8, "u8"))]
    t = spark.createDataFrame(rows, "object_type string, object_id string, relation string, subject_type string, subject_id string")
    for relation in ("owner", "editor", "viewer"):
        want = authz.permissions(t).where(F.col("relation") == relation).groupBy("user_id").count().collect()
        assert sorted(map(repr, map(tuple, authz.object_counts(t, relation).collect()))) == sorted(map(repr, map(tuple, want)))
        assert len(want) > 4 or relation == "owner"
    # 3,000 members of one group and 3,000 objects
    n = 3000
    many = spark.range(n).select(F.lit("team").alias("object_type"), F.lit("t").alias("object_id"), F.lit("member").alias("relation"), F.lit("user").alias("subject_type"), F.col("id").cast("string").alias("subject_id"))
    many = many.union(spark.range(n).select(F.lit("document"), F.col("id").cast("string"), F.lit("viewer"), F.lit("team"), F.lit("t")))
    found = authz.object_counts(many, "viewer")
    assert {tuple(r) for r in found.groupBy("n").count().collect()} == {(n, n)}
    assert len(found.collect()) == n
