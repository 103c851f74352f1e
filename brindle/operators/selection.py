"""Query texts with nested selections, compiled to one plan: fields, aliases, arguments, variables, named and inline fragments,
directives, mutations, and questions about the types themselves.

A text is parsed to a tree, checked against the types and the declared kinds of its variables and arguments before anything runs,
and compiled bottom up: each nested list is one aggregation and one left join, whatever the number of parents, over the rows
that a semi join leaves of those the parents reach. ``__typename`` is a field of every type; ``with_introspection`` adds the entry points
``__schema`` and ``__type``. There are no interfaces or unions, so a fragment on another type than that of its place is an error."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s+|,|#[^\n]*|(\.\.\.|[{}():!=\[\]$@]|\"(?:[^\"\\]|\\.)*\"|-?\d+(?:\.\d+)?|\w+)")


class QueryError(ValueError):
    """A query text that is rejected before it runs."""


@dataclass(frozen=True)
class Link:
    """A nested list: rows of the type ``of`` whose ``theirs`` equals the parent's ``ours``, in the order of ``sort``. arguments
    maps names to functions of the value and give a filter."""

    of: str
    ours: str
    theirs: str
    sort: str
    arguments: dict[str, Callable[[object], Column]] = field(default_factory=dict)
    #: Kinds of arguments, as 'Int!' or '[String!]'; those without one take anything.
    kinds: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Type:
    """An object type: its rows, and its lists. Every column is a field. failing: fields that raise, with their message."""

    rows: DataFrame
    links: dict[str, Link] = field(default_factory=dict)
    failing: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Root:
    """An entry point: a type, its required and optional arguments as filters."""

    of: str
    required: dict[str, Callable[[object], Column]] = field(default_factory=dict)
    optional: dict[str, Callable[[object], Column]] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Mutation:
    """A change: ``apply`` takes the types and the arguments, and returns the types after it and the rows, of type ``of``, that the
    selection is made of. kinds declares its arguments."""

    of: str
    apply: Callable[[dict[str, Type], dict], tuple[dict[str, Type], DataFrame]]
    kinds: dict[str, str] = field(default_factory=dict)


@dataclass
class Node:
    name: str
    alias: str
    arguments: dict
    inner: list[Node]
    #: Conditions of the directives: (include or skip, value).
    when: list[tuple[str, object]] = field(default_factory=list)
    #: Types that the fragments around it name.
    on: tuple[str, ...] = ()


@dataclass
class Document:
    """variables: whether each is required; defaults: of those that have one; kinds: as declared."""

    variables: dict[str, bool]
    inner: list[Node]
    defaults: dict = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    operation: str = "query"


@dataclass
class _Spread:
    """A fragment in a selection: its name, or its own selection."""

    name: str
    inner: list
    on: str
    when: list


class _Variable(str):
    pass


def parse(text: str) -> Document:
    """The tree of a query text; fragments are put in their places."""
    tokens = [m[1] for m in TOKEN.finditer(text) if m[1]]
    if "".join(tokens) != re.sub(r"\s|,|#[^\n]*", "", text) and '"' not in text:
        raise QueryError("a character that no query has")
    fragments: dict[str, list] = {}
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal place
        t = peek()
        if not t or want is not None and t != want:
            raise QueryError(f"{want or 'a name'} expected, {t or 'the end'} found")
        place += 1
        return t

    def name_token(what: str = "a name") -> str:
        if not re.fullmatch(r"[A-Za-z_]\w*", peek()):
            raise QueryError(f"{what} expected, {peek() or 'the end'} found")
        return take()

    def value():
        t = take()
        if t == "$":
            return _Variable(name_token())
        if t == "[":
            items = []
            while peek() != "]":
                items.append(value())
            take()
            return items
        if t[0] == '"':
            return t[1:-1].replace('\\"', '"')
        if t in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[t]
        try:
            return float(t) if "." in t else int(t)
        except ValueError:
            if not re.fullmatch(r"[A-Za-z_]\w*", t):
                raise QueryError(f"a value expected, {t} found") from None
            return t

    def kind() -> str:
        if peek() == "[":
            take()
            inner = kind()
            take("]")
            out = f"[{inner}]"
        else:
            out = name_token("a type")
        if peek() == "!":
            take()
            out += "!"
        return out

    def arguments() -> dict:
        out = {}
        if peek() == "(":
            take()
            while peek() != ")":
                k = name_token("an argument")
                if k in out:
                    raise QueryError(f"argument {k} is given twice")
                take(":")
                out[k] = value()
            take()
        return out

    def directives() -> list:
        out = []
        while peek() == "@":
            take()
            name, given = name_token("a directive"), arguments()
            if name not in ("include", "skip"):
                raise QueryError(f"unknown directive @{name}")
            if set(given) != {"if"}:
                raise QueryError(f"@{name} takes the argument if")
            out.append((name, given["if"]))
        return out

    def selection() -> list:
        take("{")
        out = []
        while peek() != "}":
            if peek() == "...":
                take()
                if peek() == "on":
                    take()
                    on = name_token("a type")
                    when = directives()
                    out.append(_Spread("", selection(), on, when))
                elif peek() in ("{", "@"):
                    when = directives()
                    out.append(_Spread("", selection(), "", when))
                else:
                    out.append(_Spread(name_token("a fragment"), [], "", directives()))
                continue
            name = alias = name_token("a field")
            if peek() == ":":
                take()
                name = name_token("a field")
            given, when = arguments(), directives()
            out.append(Node(name, alias, given, selection() if peek() == "{" else [], when))
        take()
        if not out:
            raise QueryError("an empty selection")
        return out

    variables: dict[str, bool] = {}
    defaults: dict = {}
    kinds: dict[str, str] = {}
    ons: dict[str, str] = {}
    roots, operation = None, "query"
    while place < len(tokens):
        if peek() == "fragment":
            take()
            name = name_token("a fragment")
            take("on")
            ons[name] = name_token("a type")
            fragments[name] = selection()
            continue
        if roots is not None:
            raise QueryError("more than one operation")
        if peek() in ("query", "mutation", "subscription"):
            operation = take()
            if operation == "subscription":
                raise QueryError("subscriptions are streams, not queries")
            if peek() not in ("{", "("):
                name_token()
            if peek() == "(":
                take()
                while peek() != ")":
                    take("$")
                    name = name_token("a variable")
                    if name in variables:
                        raise QueryError(f"variable ${name} is declared twice")
                    take(":")
                    kinds[name] = kind()
                    variables[name] = kinds[name].endswith("!")
                    if peek() == "=":
                        take()
                        defaults[name] = value()
                        variables[name] = False
                take()
        roots = selection()
    if roots is None:
        raise QueryError("no operation")

    used: set[str] = set()

    def spread(nodes: list, inside: tuple[str, ...], when: list, on: tuple[str, ...]) -> list[Node]:
        out: list[Node] = []
        for n in nodes:
            if isinstance(n, _Spread):
                if n.name and n.name not in fragments:
                    raise QueryError(f"unknown fragment {n.name}")
                if n.name in inside:
                    raise QueryError(f"fragment {n.name} holds itself")
                used.add(n.name)
                kind_of = ons.get(n.name, n.on)
                out += spread(fragments[n.name] if n.name else n.inner, (*inside, n.name) if n.name else inside, when + n.when, (*on, kind_of) if kind_of else on)
            else:
                out.append(Node(n.name, n.alias, n.arguments, spread(n.inner, inside, [], ()), when + n.when, on))
        return out

    document = Document(variables, spread(roots, (), [], ()), defaults, kinds, operation)
    if set(fragments) - used:
        raise QueryError(f"fragment {sorted(set(fragments) - used)[0]} is not used")
    return document


def depth(nodes: list[Node]) -> int:
    """Levels of nesting below the entry points."""
    return max((1 + depth(n.inner) for n in nodes if n.inner), default=0)


SCALARS: dict[str, Callable[[object], bool]] = {
    "Int": lambda v: isinstance(v, int) and not isinstance(v, bool) and -(2**31) <= v < 2**31,
    "Float": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "String": lambda v: isinstance(v, str),
    "ID": lambda v: isinstance(v, (str, int)) and not isinstance(v, bool),
    "Boolean": lambda v: isinstance(v, bool),
}


def fits(value, kind: str) -> bool:
    """Whether a value is of a kind: 'Int', 'Int!', '[Int!]'. A single value stands for a list of it."""
    if kind.endswith("!"):
        return value is not None and fits(value, kind[:-1])
    if value is None:
        return True
    if kind.startswith("["):
        return all(fits(v, kind[1:-1]) for v in (value if isinstance(value, list) else [value]))
    if kind not in SCALARS:
        raise QueryError(f"unknown type {kind}")
    return SCALARS[kind](value)


def _passes(given: str, wanted: str, has_default: bool) -> bool:
    """Whether a variable of one kind may stand where another is wanted."""
    if wanted.endswith("!"):
        return (given.endswith("!") or has_default) and _passes(given.rstrip("!") if not given.endswith("]!") else given[:-1], wanted[:-1], has_default)
    given = given[:-1] if given.endswith("!") else given
    if wanted.startswith("["):
        return given.startswith("[") and _passes(given[1:-1], wanted[1:-1], False)
    return given == wanted or (given, wanted) in {("Int", "Float"), ("Int", "ID"), ("String", "ID")}


def included(n: Node, values: dict) -> bool:
    """Whether the directives let a field be."""
    return all((values.get(v) if isinstance(v, _Variable) else v) is (d == "include") for d, v in n.when)


def merged(nodes: list[Node], values: dict) -> list[Node]:
    """Fields that are left of the directives; those that have one name in the result are one, or an error."""
    out: dict[str, Node] = {}
    for n in nodes:
        if not included(n, values):
            continue
        if n.alias not in out:
            out[n.alias] = Node(n.name, n.alias, n.arguments, list(n.inner), [], n.on)
            continue
        first = out[n.alias]
        if (first.name, first.arguments) != (n.name, n.arguments):
            raise QueryError(f"{n.alias} stands for two fields")
        first.inner += n.inner
    return list(out.values())


def validate(document: Document, types: dict[str, Type], roots: dict[str, Root], variables: dict, mutations: dict[str, Mutation] | None = None) -> None:
    """An error for unknown fields, missing or unknown arguments, values and variables of other kinds than declared, and fragments
    on other types than that of their place, before anything runs."""
    for name, required in document.variables.items():
        if required and variables.get(name) is None:
            raise QueryError(f"variable ${name} is required")
        if not fits(variables.get(name), document.kinds[name] if required else document.kinds[name].removesuffix("!")):
            raise QueryError(f"variable ${name} is no {document.kinds[name]}")
    for name in variables:
        if name not in document.variables:
            raise QueryError(f"variable ${name} is not declared")

    def used(v, wanted: str | None, what: str) -> None:
        if isinstance(v, _Variable):
            if v not in document.variables:
                raise QueryError(f"variable ${v} is not declared")
            if wanted and not _passes(document.kinds[v], wanted, document.defaults.get(v) is not None):
                raise QueryError(f"variable ${v} is no {wanted}, for {what}")
        elif isinstance(v, list) and any(isinstance(x, _Variable) for x in v):
            for x in v:
                used(x, wanted and wanted.strip("!")[1:-1], what)
        elif wanted and not fits(v, wanted):
            raise QueryError(f"{v!r} is no {wanted}, for {what}")

    def arguments(n: Node, known, kinds: dict[str, str]) -> None:
        for k, v in n.arguments.items():
            if k not in known:
                raise QueryError(f"unknown argument {k} of {n.name}")
            used(v, kinds.get(k), f"{k} of {n.name}")
        for k, wanted in kinds.items():
            if wanted.endswith("!") and k not in n.arguments:
                raise QueryError(f"argument {k} of {n.name} is required")

    def place(kind: str, n: Node) -> None:
        for on in n.on:
            if on not in types:
                raise QueryError(f"unknown type {on}")
            if on != kind:
                raise QueryError(f"a fragment on {on} within {kind}")
        for d, v in n.when:
            used(v, "Boolean!", f"@{d}")

    def inside(kind: str, nodes: list[Node]) -> None:
        t = types[kind]
        for n in nodes:
            place(kind, n)
            if n.name in t.links:
                link = t.links[n.name]
                arguments(n, link.arguments, link.kinds)
                if not n.inner:
                    raise QueryError(f"{n.name} needs a selection")
                inside(link.of, n.inner)
            elif n.name not in t.rows.columns and n.name not in t.failing and n.name != "__typename":
                raise QueryError(f"unknown field {n.name} of {kind}")
            elif n.inner or n.arguments:
                raise QueryError(f"{n.name} is no object")
        merged(nodes, variables)

    change = document.operation == "mutation"
    for n in document.inner:
        for on in n.on:
            if on != ("Mutation" if change else "Query"):
                raise QueryError(f"a fragment on {on} at the top")
        for d, v in n.when:
            used(v, "Boolean!", f"@{d}")
        if n.name not in (mutations or {} if change else roots):
            raise QueryError(f"unknown {document.operation} {n.name}")
        if change:
            arguments(n, mutations[n.name].kinds, mutations[n.name].kinds)
        else:
            r = roots[n.name]
            arguments(n, {*r.required, *r.optional}, r.kinds)
            for k in r.required:
                if k not in n.arguments:
                    raise QueryError(f"argument {k} of {n.name} is required")
        of = mutations[n.name].of if change else roots[n.name].of
        if not n.inner:
            raise QueryError(f"{n.name} needs a selection")
        inside(of, n.inner)


def _select(types: dict[str, Type], kind: str, rows: DataFrame, nodes: list[Node], values: dict) -> DataFrame:
    """(node, errors) of rows of a type."""

    def of(v):
        return values.get(v) if isinstance(v, _Variable) else [of(x) for x in v] if isinstance(v, list) else v

    def level(kind: str, rows: DataFrame, nodes: list[Node], keep: list[str]) -> DataFrame:
        """The columns ``keep`` as __k0, ..., and node and errors."""
        t = types[kind]
        out = rows.select(F.struct(*rows.columns).alias("__r"))
        fields, errors = [], []
        for i, n in enumerate(merged(nodes, values)):
            if n.name in t.failing:
                fields.append(F.lit(None).cast("string").alias(n.alias))
                errors.append(F.array(F.lit(f"{n.alias}: {t.failing[n.name]}")))
            elif n.name in t.links:
                link = t.links[n.name]
                kids = types[link.of].rows
                for k, v in n.arguments.items():
                    if of(v) is not None:
                        kids = kids.where(link.arguments[k](of(v)))
                # only what the parents reach is folded
                reached = rows.select(F.col(link.ours).alias("__o")).distinct()
                kids = kids.join(reached, F.col(link.theirs) == F.col("__o"), "left_semi")
                kids = level(link.of, kids, n.inner, [link.theirs, link.sort])
                # one row a parent before the join
                lists = kids.groupBy(F.col("__k0").alias(f"__p{i}")).agg(
                    F.transform(F.array_sort(F.collect_list(F.struct("__k1", "node"))), lambda x: x["node"]).alias(f"__l{i}"), F.array_distinct(F.flatten(F.collect_list("errors"))).alias(f"__e{i}")
                )
                out = out.join(lists, F.col(f"__r.{link.ours}") == F.col(f"__p{i}"), "left").drop(f"__p{i}")
                fields.append(F.coalesce(F.col(f"__l{i}"), F.array()).alias(n.alias))
                errors.append(F.coalesce(F.col(f"__e{i}"), F.array().cast("array<string>")))
            elif n.name == "__typename":
                fields.append(F.lit(kind).alias(n.alias))
            else:
                fields.append(F.col(f"__r.{n.name}").alias(n.alias))
        failed = F.concat(*errors) if errors else F.array().cast("array<string>")
        node = F.struct(*fields) if fields else F.struct(F.lit(None).cast("string").alias("__none"))
        return out.select(*[F.col(f"__r.{c}").alias(f"__k{i}") for i, c in enumerate(keep)], node.alias("node"), failed.alias("errors"))

    return level(kind, rows, nodes, [])


def run(text: str, types: dict[str, Type], roots: dict[str, Root], variables: dict | None = None) -> dict[str, DataFrame]:
    """For each entry point by its alias, a frame of (node, errors): the selected struct, and the messages of its fields that
    failed, which are null in it."""
    document = parse(text)
    if document.operation == "mutation":
        raise QueryError("a mutation is run by mutate()")
    values = document.defaults | (variables or {})
    validate(document, types, roots, values)
    found = {}
    for n in merged(document.inner, values):
        r = roots[n.name]
        rows = types[r.of].rows
        for k, v in n.arguments.items():
            v = values.get(v) if isinstance(v, _Variable) else v
            if v is not None:
                rows = rows.where((r.required | r.optional)[k](v))
        found[n.alias] = _select(types, r.of, rows, n.inner, values)
    return found


def mutate(text: str, types: dict[str, Type], mutations: dict[str, Mutation], variables: dict | None = None) -> tuple[dict[str, Type], dict[str, DataFrame]]:
    """The types after the changes, which are made one after the other, and for each change by its alias what was selected of it."""
    document = parse(text)
    if document.operation != "mutation":
        raise QueryError("a query is run by run()")
    values = document.defaults | (variables or {})
    validate(document, types, {}, values, mutations)
    found = {}
    for n in merged(document.inner, values):
        m = mutations[n.name]
        types, rows = m.apply(types, {k: values.get(v) if isinstance(v, _Variable) else v for k, v in n.arguments.items()})
        found[n.alias] = _select(types, m.of, rows, n.inner, values)
    return types, found


#: Kinds of columns by their type's name.
KINDS = {"string": "String", "int": "Int", "smallint": "Int", "tinyint": "Int", "bigint": "ID", "double": "Float", "float": "Float", "boolean": "Boolean"}


def with_introspection(spark, types: dict[str, Type], roots: dict[str, Root], mutations: dict[str, Mutation] | None = None) -> tuple[dict[str, Type], dict[str, Root]]:
    """The types and entry points with those that tell about them: ``__schema { queryType { name } types { name fields { name type } } }``
    and ``__type(name: "X")``. A few rows for each field of the types."""
    fields, given = [], []

    def add(owner: str, name: str, kind: str, kinds: dict[str, str]) -> None:
        fields.append((owner, len(fields), name, kind))
        given.extend((f"{owner}.{name}", i, k, v) for i, (k, v) in enumerate(kinds.items()))

    for name, t in types.items():
        for c, kind in t.rows.dtypes:
            add(name, c, KINDS.get(kind.partition("(")[0], "String"), {})
        for c in t.failing:
            add(name, c, "String", {})
        for c, link in t.links.items():
            add(name, c, f"[{link.of}!]!", {k: link.kinds.get(k, "String") for k in link.arguments})
    for name, r in roots.items():
        add("Query", name, f"[{r.of}!]!", {k: r.kinds.get(k, "String" + "!" * (k in r.required)) for k in (*r.required, *r.optional)})
    for name, m in (mutations or {}).items():
        add("Mutation", name, f"[{m.of}!]!", m.kinds)
    kinds = [(n, "OBJECT", "one") for n in (*types, "Query", *(["Mutation"] if mutations else []))] + [(n, "SCALAR", "one") for n in SCALARS]
    own = spark.createDataFrame(kinds, "name string, kind string, schema string")
    tops = spark.createDataFrame([("one", "Query", "Mutation" if mutations else None)], "schema string, query string, mutation string")
    of_fields = spark.createDataFrame(fields, "owner string, place int, name string, type string").withColumn("id", F.concat("owner", F.lit("."), "name"))
    of_arguments = spark.createDataFrame(given or [("", 0, "", "")], "owner string, place int, name string, type string")
    added = {
        "__Schema": Type(tops, {"types": Link("__Type", "schema", "schema", "name"), "queryType": Link("__Type", "query", "name", "name"), "mutationType": Link("__Type", "mutation", "name", "name")}),
        "__Type": Type(own, {"fields": Link("__Field", "name", "owner", "place")}),
        "__Field": Type(of_fields, {"args": Link("__InputValue", "id", "owner", "place")}),
        "__InputValue": Type(of_arguments),
    }
    return types | added, roots | {"__schema": Root("__Schema"), "__type": Root("__Type", {"name": lambda v: F.col("name") == v}, {}, {"name": "String!"})}


def found_or_error(df: DataFrame, what: str) -> DataFrame:
    """The rows, or an error when the plan runs and there are none. For lookups by key: their few rows are sent to all tasks."""
    first = df.select(F.struct(*df.columns).alias("r"))
    empty = first.agg(F.count(F.lit(1)).alias("n"))
    checked = empty.select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"not found: {what}")).cast("boolean")).otherwise(F.lit(True)).alias("ok"))
    return first.join(F.broadcast(checked), F.col("ok"), "right").select("r.*")  # one row
