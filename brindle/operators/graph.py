"""Property graphs over two tables: patterns compiled to join chains or to SQL table functions, selections pushed down to one
plan, and walks of any depth."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import durable


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    key: str = "id"
    source: str = "src"
    target: str = "dst"


@dataclass(frozen=True)
class Hop:
    """One edge of a pattern: its direction (out, in or any), and a filter on the edge."""

    direction: str = "out"
    where: Column | None = None


@dataclass(frozen=True)
class Pattern:
    """(v0)-[e1]->(v1)...: hops, and filters on vertices by place."""

    hops: tuple[Hop, ...]
    where: dict[int, Column] = field(default_factory=dict)


def _directed(g: PropertyGraph, direction: str) -> DataFrame:
    e = g.edges
    swap = {g.source: g.target, g.target: g.source}
    back = e.select(*[F.col(swap.get(c, c)).alias(c) for c in e.columns])
    return e if direction == "out" else back if direction == "in" else e.unionByName(back)


def match(g: PropertyGraph, p: Pattern, optional: bool = False) -> DataFrame:
    """A row for each match, with struct columns v0, e1, v1, ...; optional keeps matches that end early (left joins).
    Filters are applied before the joins, and Catalyst orders and prunes them. From a filtered start each further hop's edges are
    cut to those of the vertices reached so far, by a semi join that goes below an aggregation of the edges."""

    def vertices(i: int) -> DataFrame:
        v = g.vertices if i not in p.where else g.vertices.where(p.where[i])
        return v.select(F.struct(*v.columns).alias(f"v{i}"))

    out = vertices(0)
    how = "left" if optional else "inner"
    for i, hop in enumerate(p.hops, 1):
        e = _directed(g, hop.direction)
        e = e if hop.where is None else e.where(hop.where)
        if i > 1 and 0 in p.where:
            reached = out.select(F.col(f"v{i - 1}.{g.key}").alias("__reached")).distinct()
            e = e.join(reached, F.col(g.source) == F.col("__reached"), "left_semi")
        step = e.select(F.struct(*e.columns).alias(f"e{i}")).join(vertices(i), F.col(f"e{i}.{g.target}") == F.col(f"v{i}.{g.key}"))
        out = out.join(step, F.col(f"v{i - 1}.{g.key}") == F.col(f"e{i}.{g.source}"), how)
    return out


def graph_table(g: PropertyGraph, p: Pattern, columns: dict[str, str]) -> DataFrame:
    """Columns of the matches, by name: 'v1.name' and the like."""
    return match(g, p).select(*[F.col(c).alias(a) for a, c in columns.items()])


def table_function(spark: SparkSession, name: str, parameters: str, vertices: str, edges: str, hops: Sequence[str], where: str, columns: dict[str, str], key: str = "id", source: str = "src", target: str = "dst") -> None:
    """A pattern as a table function for SQL text: ``SELECT ... FROM t, LATERAL name(t.x)``. vertices and edges name tables or
    views; hops are directions (out, in or any), where is a condition on v0, e1, v1, ... and the parameters. Its body is
    inlined into the plans that call it, so filters and columns are pushed through it."""
    for n in (name, *columns, key, source, target):
        if not re.fullmatch(r"\w+", n):
            raise ValueError(f"{n!r} is no name")
    joins = [f"{vertices} AS v0"]
    for i, hop in enumerate(hops, 1):
        ends = {"out": ((source, target),), "in": ((target, source),), "any": ((source, target), (target, source))}[hop]
        both = " UNION ALL ".join(f"SELECT *, {a} AS __from, {b} AS __to FROM {edges}" for a, b in ends)
        joins.append(f"JOIN ({both}) AS e{i} ON v{i - 1}.{key} = e{i}.__from JOIN {vertices} AS v{i} ON e{i}.__to = v{i}.{key}")
    chosen = ", ".join(f"{c} AS {a}" for a, c in columns.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN SELECT {chosen} FROM {' '.join(joins)} WHERE {where}")


def walk(g: PropertyGraph, start: Column, direction: str = "out", most: int | None = None) -> DataFrame:
    """(key, depth) of the vertices that are reached from those that match ``start``, at the least depth, up to ``most`` hops if
    that is given. Round by round the edges are cut to those of the vertices reached last, by a semi join; visited vertices are
    never entered again, so cycles end. Edges to what is no vertex lead nowhere."""
    edges = _directed(g, direction).select(F.col(g.source).alias("__s"), F.col(g.target).alias("__t"))
    keys = g.vertices.select(F.col(g.key).alias("__v"))
    new = durable(g.vertices.where(start).select(F.col(g.key).alias(g.key)).distinct().withColumn("depth", F.lit(0)))
    seen, hops = [new], 0
    while (most is None or hops < most) and not new.isEmpty():
        hops += 1
        step = edges.join(new.select(F.col(g.key).alias("__s")), "__s", "left_semi").select(F.col("__t").alias(g.key)).distinct()
        known = reduce(DataFrame.union, seen).select(F.col(g.key).alias("__k"))
        fresh = step.join(known, F.col(g.key) == F.col("__k"), "left_anti").join(keys, F.col(g.key) == F.col("__v"), "left_semi")
        new = durable(fresh.withColumn("depth", F.lit(hops)))
        seen.append(new)
    return reduce(DataFrame.union, seen)


def trails(g: PropertyGraph, start: Column, most: int, direction: str = "out") -> DataFrame:
    """(path) of keys, one row for each way of 1 to ``most`` edges that meets no vertex twice; edges that join the same two vertices
    are ways of their own."""
    edges = _directed(g, direction).select(F.col(g.source).alias("__s"), F.col(g.target).alias("__t"))
    keys = g.vertices.select(F.col(g.key).alias("__v"))
    new = g.vertices.where(start).select(F.array(g.key).alias("path"))
    found = []
    for _ in range(most):
        ends = new.withColumn("__end", F.element_at("path", -1))
        reached = ends.select(F.col("__end").alias("__s")).distinct()
        step = ends.join(edges.join(reached, "__s", "left_semi"), F.col("__end") == F.col("__s")).join(keys, F.col("__t") == F.col("__v"), "left_semi")
        new = step.where(~F.array_contains("path", F.col("__t"))).select(F.concat("path", F.array("__t")).alias("path"))
        found.append(new)
    return reduce(DataFrame.union, found)


def depth(selection: dict, field_name: str) -> int:
    """Hops that a nested selection asks for."""
    inner = selection.get(field_name)
    return 0 if inner is None else 1 + depth(inner, field_name)


def nested(g: PropertyGraph, root: Column, selection: dict, field_name: str, sort: str) -> DataFrame:
    """A selection like {'name': {}, 'follows': {'name': {}}} from the vertices that match ``root``: one left-join plan as
    deep as the selection, folded bottom up to arrays of structs. Children are one per edge, in order; those without any are
    empty arrays. Each level's edges and children are cut to what the level above reaches, by semi joins, before they are
    folded. All fields but the last level's parents are pruned to the selection."""

    def level(v: DataFrame, sel: dict) -> DataFrame:
        fields = [c for c in sel if c != field_name]
        if field_name not in sel:
            return v.select(g.key, F.struct(*fields).alias("node"), F.col(sort).alias("__sort"))
        reached = v.select(F.col(g.key).alias("__r")).distinct()
        edges = g.edges.select(F.col(g.source).alias("__s"), F.col(g.target).alias("__t")).join(reached, F.col("__s") == F.col("__r"), "left_semi")
        ends = edges.select(F.col("__t").alias("__e")).distinct()
        kids = level(g.vertices.join(ends, F.col(g.key) == F.col("__e"), "left_semi"), sel[field_name])
        pairs = edges.join(kids, F.col("__t") == kids[g.key])
        lists = pairs.groupBy("__s").agg(F.transform(F.array_sort(F.collect_list(F.struct("__sort", "__t", "node"))), lambda x: x["node"]).alias("__kids"))
        joined = v.join(lists, v[g.key] == F.col("__s"), "left")
        return joined.select(g.key, F.struct(*fields, F.coalesce("__kids", F.array()).alias(field_name)).alias("node"), F.col(sort).alias("__sort"))

    return level(g.vertices.where(root), selection).select("node")


def response(nodes: DataFrame, name: str) -> DataFrame:
    """The {data, errors} envelope, a row each. The messages are those of a column ``errors``, where there is one."""
    errors = F.coalesce("errors", F.array().cast("array<string>")) if "errors" in nodes.columns else F.array().cast("array<string>")
    return nodes.select(F.to_json(F.struct(F.struct(F.col("node").alias(name)).alias("data"), errors.alias("errors"))).alias("json"))
