"""Relationship-based authorization, and row-level policies."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import configure

#: What each relation includes: fixed values of the demonstrated model (owner => editor => viewer).
IMPLIES = {"owner": ("owner", "editor", "viewer"), "editor": ("editor", "viewer"), "viewer": ("viewer",)}


def expand(tuples: DataFrame, implies: dict[str, tuple[str, ...]] = IMPLIES, group: str = "team", member: str = "member") -> DataFrame:
    """Permissions (object_type, object_id, relation, user_id, path) from tuples (object_type, object_id, relation,
    subject_type, subject_id): implied relations, and members of groups that are subjects. path tells how."""
    implied = F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(k), F.array(*map(F.lit, v))) for k, v in implies.items()]))[F.col("relation")])
    grants = tuples.where(F.col("relation").isin(*implies))
    members = tuples.where((F.col("object_type") == group) & (F.col("relation") == member) & (F.col("subject_type") == "user")).select(F.col("object_id").alias("__g"), F.col("subject_id").alias("__u"))
    direct = grants.where("subject_type = 'user'").select("object_type", "object_id", F.col("relation").alias("granted"), implied.alias("relation"), F.col("subject_id").alias("user_id"), F.lit(None).cast("string").alias("via"))
    through = grants.where(F.col("subject_type") == group).join(members, F.col("subject_id") == F.col("__g"))
    through = through.select("object_type", "object_id", F.col("relation").alias("granted"), implied.alias("relation"), F.col("__u").alias("user_id"), F.col("subject_id").alias("via"))
    path = F.filter(F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit(f"{group}:"), "via", F.lit(f"#{member}")), F.col("granted"), F.when(F.col("granted") != F.col("relation"), F.col("relation"))), lambda x: x.isNotNull())
    return direct.unionByName(through).withColumn("path", path)


def permissions(tuples: DataFrame, **model) -> DataFrame:
    return expand(tuples, **model).select("object_type", "object_id", "relation", "user_id").distinct()


def object_counts(tuples: DataFrame, relation: str, implies: dict[str, tuple[str, ...]] = IMPLIES, group: str = "team", member: str = "member") -> DataFrame:
    """(user_id, n): how many objects each user has the relation to, users without any left out. Members are not joined with what
    their groups may see: users of the same groups are one class, whose objects are counted once, and each user's own grants
    are counted where no group of theirs gives the same."""
    grants = tuples.where(F.col("relation").isin([k for k, v in implies.items() if relation in v]))
    direct = grants.where("subject_type = 'user'").select("object_type", "object_id", F.col("subject_id").alias("user_id")).distinct()
    shared = grants.where((F.col("subject_type") == group) & F.col("subject_id").isNotNull()).select("object_type", "object_id", F.col("subject_id").alias("g")).distinct()
    members = tuples.where((F.col("object_type") == group) & (F.col("relation") == member) & (F.col("subject_type") == "user")).select(F.col("object_id").alias("g"), F.col("subject_id").alias("user_id"))
    # groups that nothing is shared with make no class
    users = members.join(shared.select("g").distinct(), "g", "left_semi").groupBy("user_id").agg(F.array_sort(F.collect_set("g")).alias("class"))
    seen = users.select("class").distinct().select("class", F.explode("class").alias("g")).join(shared, "g").select("class", "object_type", "object_id").distinct()
    counted = seen.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    through = users.join(counted, "class").select("user_id", "n")
    u = users.select(F.col("user_id").alias("__u"), "class")
    o = shared.groupBy("object_type", "object_id").agg(F.collect_set("g").alias("groups")).select(F.col("object_type").alias("__t"), F.col("object_id").alias("__o"), "groups")
    own = direct.join(o, F.col("object_type").eqNullSafe(F.col("__t")) & F.col("object_id").eqNullSafe(F.col("__o")), "left").join(u, F.col("user_id").eqNullSafe(F.col("__u")), "left")
    own = own.where(~F.coalesce(F.arrays_overlap("class", "groups"), F.lit(False))).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return own.union(through).groupBy("user_id").agg(F.sum("n").alias("n"))


def check(questions: DataFrame, tuples: DataFrame, **model) -> DataFrame:
    """Questions (user_id, relation, object_type, object_id, ...) with ``allowed``."""
    p = permissions(tuples, **model).withColumn("__yes", F.lit(True))
    return questions.join(p, ["object_type", "object_id", "relation", "user_id"], "left").withColumn("allowed", F.coalesce("__yes", F.lit(False))).drop("__yes")


def list_objects(tuples: DataFrame, user: str, relation: str, object_type: str, **model) -> DataFrame:
    return permissions(tuples, **model).where((F.col("user_id") == user) & (F.col("relation") == relation) & (F.col("object_type") == object_type)).select(F.concat("object_type", F.lit(":"), "object_id").alias("object"))


def explain_check(tuples: DataFrame, user: str, relation: str, object_id: str, **model) -> DataFrame:
    """A derivation path for each way that the user has the relation."""
    return expand(tuples, **model).where((F.col("user_id") == user) & (F.col("relation") == relation) & (F.col("object_id") == object_id)).select("path")


def visible(rows: DataFrame, key: str, tuples: DataFrame, user: str, relation: str, object_type: str, **model) -> DataFrame:
    """Rows that the user may see: a semi join, no function call a row."""
    ids = permissions(tuples, **model).where((F.col("user_id") == user) & (F.col("relation") == relation) & (F.col("object_type") == object_type)).select(F.col("object_id").alias(key))
    return rows.join(ids, key, "left_semi")


@dataclass(frozen=True)
class Store:
    """An authorization store: one model and its tuples. Writes give a new store."""

    tuples: DataFrame
    implies: dict

    def write(self, more: DataFrame) -> Store:
        return Store(self.tuples.unionByName(more).distinct(), self.implies)

    def check(self, questions: DataFrame) -> DataFrame:
        return check(questions, self.tuples, implies=self.implies)

    def list_objects(self, user: str, relation: str, object_type: str) -> DataFrame:
        return list_objects(self.tuples, user, relation, object_type, implies=self.implies)


def privileges(statements: DataFrame) -> DataFrame:
    """(role, privilege) that grants and revokes (seq, kind, role, privilege) leave: of each, the last statement holds."""
    last = statements.groupBy("role", "privilege").agg(F.max_by("kind", "seq").alias("__k"))
    return last.where("__k = 'grant'").select("role", "privilege")


@dataclass(frozen=True)
class Principal:
    name: str
    owner: bool = False
    superuser: bool = False
    privileges: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Policy:
    """Row-level security of a table: ``using`` filters reads, ``check`` writes; both are functions of the principal's name.
    Owners bypass it unless forced, superusers always."""

    using: object
    check: object | None = None
    force: bool = False

    def bypassed(self, who: Principal) -> bool:
        return who.superuser or (who.owner and not self.force)

    def read(self, table: DataFrame, who: Principal) -> DataFrame:
        if not (who.superuser or who.owner or "select" in who.privileges):
            raise PermissionError(f"permission denied for {who.name}")
        return table if self.bypassed(who) else table.where(self.using(who.name))

    def violations(self, rows: DataFrame, who: Principal) -> DataFrame:
        """Rows of a write that the policy rejects."""
        test: Column = (self.check or self.using)(who.name)
        return rows.limit(0) if self.bypassed(who) else rows.where(~F.coalesce(test, F.lit(False)))

    def insert(self, table: DataFrame, rows: DataFrame, who: Principal) -> DataFrame:
        if not (who.superuser or who.owner or "insert" in who.privileges):
            raise PermissionError(f"permission denied for {who.name}")
        if not self.violations(rows, who).isEmpty():
            raise PermissionError("new row violates row-level security policy")
        return table.unionByName(rows)


class Gate:
    """Tables that principals read by SQL text. Each principal has a session whose views are the tables as the policies let them
    see; a text finds nothing else there: other tables, files named in the text and statements that are no queries are
    refused before anything runs. tables maps names to (loader of a session, policy or None); a loader reads in the session
    that it is given."""

    def __init__(self, spark: SparkSession, tables: dict[str, tuple[Callable[[SparkSession], DataFrame], Policy | None]]):
        self.spark, self.tables = spark, tables
        self._sessions: dict[Principal, SparkSession] = {}

    def session(self, who: Principal) -> SparkSession:
        if who not in self._sessions:
            own = configure(self.spark.newSession())
            own.conf.set("spark.sql.runSQLOnFiles", "false")
            for name, (load, policy) in self.tables.items():
                try:
                    rows = (policy or Policy(lambda _: F.lit(True))).read(load(own), who)
                except PermissionError:
                    continue  # no view: the text is refused if it names the table
                rows.createOrReplaceTempView(name)
            self._sessions[who] = own
        return self._sessions[who]

    def sql(self, who: Principal, text: str, args: dict | None = None) -> DataFrame:
        own = self.session(who)
        plan = own._jsparkSession.sessionState().sqlParser().parsePlan(text)
        command = own._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
        written = plan.treeString()
        if command.isInstance(plan) or "Insert" in written.split("\n")[0]:
            raise PermissionError(f"only queries may be run for {who.name}")
        mine = {t.name for t in own.catalog.listTables() if t.isTemporary}
        named = re.findall(r"'UnresolvedRelation \[([^\]]*)\]", written)
        # names that the text itself gives to its parts, as in WITH x AS (...)
        given = {n.lower() for n in re.findall(r"CTE \[([^\]]*)\]", written) for n in re.split(r",\s*", n)}
        for n in named:
            if n.lower() not in {x.lower() for x in mine} | given:
                raise PermissionError(f"permission denied for {who.name}: {n}")
        return own.sql(text, args=args) if args else own.sql(text)
