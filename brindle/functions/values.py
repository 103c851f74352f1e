"""Arrays, maps, paths, text, JSON, identifiers: scalar functions over columns."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# arrays
def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def length(a: Column) -> Column:
    """Null for an empty array."""
    return F.nullif(F.size(a), F.lit(0))


def head(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def sample(a: Column, n: int) -> Column:
    return F.slice(F.shuffle(a), 1, n)


def zip_shortest(a: Column, b: Column) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


# maps
def hstore(text: Column) -> Column:
    """'a=>1, b=>2' -> map."""
    return F.str_to_map(text, F.lit(", *"), F.lit("=>"))


def lookup(m: Column, k: str) -> Column:
    return F.try_element_at(m, F.lit(k))


def merged(a: Column, b: Column) -> Column:
    """The right side wins, whatever the session's policy."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def label_key(m: Column) -> Column:
    """Canonical k=v,k=v of a label set."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# label paths
def nlevel(p: Column) -> Column:
    return F.size(F.split(p, r"\."))


def subpath(p: Column, offset: int, n: int) -> Column:
    return F.array_join(F.slice(F.split(p, r"\."), offset + 1, n), ".")


def lquery(pattern: str) -> str:
    """A label-path query of names, * and | as a regular expression. A leading * takes no dot before it."""
    out = ""
    for i, part in enumerate(pattern.split(".")):
        if part == "*":
            out += r"([^.]+(\.|$))*"
        else:
            out += "(" + "|".join(part.split("|")) + r")(\.|$)"
    return "^" + out + "$"


def path_matches(p: Column, pattern: str) -> Column:
    return p.rlike(lquery(pattern))


# text
def trigrams(s: Column) -> Column:
    """The trigram set of a text: each word padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def trigrams_of(text: str) -> list[str]:
    """The trigram set of a known text."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)})


def similarity(a: Column, b: Column | str) -> Column:
    """Of two columns, or of a column and a known text, whose trigrams are then made once."""
    x = trigrams(a)
    y = trigrams(b) if isinstance(b, Column) else F.lit(trigrams_of(b)) if trigrams_of(b) else F.array().cast("array<string>")
    both = F.size(F.array_intersect(x, y))
    all_of = F.size(x) + F.size(y) - both
    return F.when(all_of == 0, F.lit(0.0)).otherwise(both / all_of)


def similar(a: Column, b: Column | str, threshold: float = 0.3) -> Column:
    return similarity(a, b) >= threshold


def distance(a: Column, b: Column | str) -> Column:
    return 1 - similarity(a, b)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.collate(a, "UTF8_LCASE") == F.collate(b, "UTF8_LCASE")


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


#: Latin letters with a mark, and what is left without it, by the rule of their decomposition: what is one letter and marks.
_MARKED = {chr(i): d for i in range(0xC0, 0x250) if (d := "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))) != chr(i) and len(d) == 1}


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def unaccent(text: Column) -> Column:
    """Texts without their marks, by compatibility decomposition. Texts of Latin letters stay in the JVM; only those with others,
    which Python must decompose, are sent to it."""
    latin = F.translate(text, "".join(_MARKED), "".join(_MARKED.values()))
    # null where the JVM's result is the whole one
    other = F.when(latin.rlike(r"[^\x00-\x7F]"), text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.coalesce(unaccent_udf()(other), latin)).otherwise(text)


def unaccent_udf():
    """For SQL text, where a function of a name is wanted: each text is decomposed in Python."""

    @F.arrow_udf(T.StringType())
    def decomposed(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _plain(t) for t in texts.to_pylist()], pa.string())

    return decomposed


def size_pretty(n: Column) -> Column:
    """Bytes in the largest unit of which there are ten or more."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for i, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 10 * 1024**i, F.concat(F.round(n / 1024**i).cast("long").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


# JSON
def json_text(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def json_value(doc: Column, path: str, kind: str = "string", default=None) -> Column:
    v = F.try_variant_get(F.try_parse_json(doc), path, kind)
    return v if default is None else F.when(json_exists(doc, path), v).otherwise(F.lit(default))


def json_query(doc: Column, path: str) -> Column:
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), path, "variant"))


def json_exists(doc: Column, path: str) -> Column:
    """Also true for a JSON null at the path."""
    return F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull()


def json_object(**fields: Column) -> Column:
    """A document of the given fields; a null stays as null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def json_array(*items: Column) -> Column:
    return F.to_json(F.array(*items))


def json_pretty(doc: Column) -> Column:
    """A struct, array or map as indented JSON."""
    return F.to_json(doc, {"pretty": "true"})


def json_list(a: Column, null_as_empty: bool) -> Column:
    """An array as JSON: a null one as null, or as an empty list."""
    return F.coalesce(F.to_json(a), F.lit("[]" if null_as_empty else "null"))


def json_elements(doc: Column, path: str = "$") -> Column:
    return F.from_json(F.get_json_object(doc, path), "array<string>")


def has_element(doc: Column, path: str, x: str) -> Column:
    return F.coalesce(F.array_contains(json_elements(doc, path), x), F.lit(False))


def has_key(doc: Column, k: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), k), F.lit(False))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the value, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _json(doc: Column) -> Column:
    """A text that is one JSON value as a variant, else null. The parser stops after a value: within an array and within an object,
    what follows it breaks one or the other."""

    def whole(d: Column) -> Column:
        named = F.try_parse_json(F.concat(F.lit('{"v":'), d, F.lit("}")))
        return _let(_items(F.try_parse_json(F.concat(F.lit("["), d, F.lit("]")))), lambda x: F.when((F.size(x) == 1) & named.isNotNull(), F.get(x, F.lit(0))))

    return _let(doc, whole)


def _object(v: Column) -> Column:
    """A variant's fields as a map; null if it is no object."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _items(v: Column) -> Column:
    """A variant's elements; null if it is no array."""
    return F.try_variant_get(v, "$", "array<variant>")


def _text(value: Column) -> Column:
    """A variant as text. Its own fields are written by the length of their names, then by their bytes, inner ones by name; numbers
    in their shortest form, doubles where they have more than 38 digits."""

    def written(v: Column, fields: Column) -> Column:
        named = F.transform(F.map_entries(fields), lambda e: F.struct(F.octet_length(e["key"]).alias("n"), F.encode(e["key"], "utf-8").alias("b"), e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
        parts = F.transform(F.array_sort(named), lambda x: F.concat(F.to_json(x["k"].cast("variant")), F.lit(":"), x["v"]))
        return F.when(fields.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(F.to_json(v))

    return _let(value, lambda v: _let(_object(v), lambda fields: written(v, fields)))


def _variant(value) -> Column:
    """A Python value as a variant; numbers keep their digits."""
    return F.parse_json(F.lit(json.dumps(value, ensure_ascii=False, cls=_Digits)))


class _Digits(json.JSONEncoder):
    """Decimals as numbers."""

    def iterencode(self, o, _one_shot=False):
        if isinstance(o, Decimal):
            return iter([format(o, "f")])
        if isinstance(o, dict):
            return iter(["{", ",".join(f"{json.dumps(k, ensure_ascii=False)}:{self.encode(v)}" for k, v in o.items()), "}"])
        if isinstance(o, (list, tuple)):
            return iter(["[", ",".join(self.encode(v) for v in o), "]"])
        return super().iterencode(o, _one_shot)

    def encode(self, o) -> str:
        return "".join(self.iterencode(o))


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _literal(text: str):
    """A JSON text; NaN and Infinity are none."""
    return json.loads(text, parse_float=Decimal, parse_constant=_no_constant)


def _equals(have: Column, scalar) -> Column:
    """Whether a variant is the given scalar; numbers are equal by value."""
    kind = F.schema_of_variant(have)
    if scalar is None:
        return F.is_variant_null(have)
    if isinstance(scalar, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(have, "$", "boolean") == F.lit(scalar))
    if isinstance(scalar, str):
        return (kind == "STRING") & (F.try_variant_get(have, "$", "string") == F.lit(scalar))
    # exact numbers by their text, which is the shortest one, others as doubles
    plain = format(Decimal(scalar).normalize(), "f")
    as_double = (kind == "DOUBLE") & (F.try_variant_get(have, "$", "double") == F.lit(float(scalar)))
    return F.when(kind.rlike("^(BIGINT|DECIMAL)"), F.to_json(have) == F.lit(plain)).otherwise(as_double)


def json_contains(doc: Column, literal: str) -> Column:
    """doc @> literal: objects by key, arrays by element, scalars by equality, at any depth; at the top an array also contains a
    scalar that is one of its elements. Null where the document is no JSON."""

    def holds(part) -> Callable[[Column], Column]:
        return lambda have: inside(have, part)

    def all_of(tests: list[Column], there: Column) -> Column:
        return F.coalesce(reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), tests, there.isNotNull()), F.lit(False))

    def inside(have: Column, part) -> Column:
        if isinstance(part, dict):
            return _let(_object(have), lambda fields: all_of([_let(F.try_element_at(fields, F.lit(k)), holds(v)) for k, v in part.items()], fields))
        if isinstance(part, list):
            return _let(_items(have), lambda items: all_of([F.exists(items, holds(p)) for p in part], items))
        return F.coalesce(_equals(have, part), F.lit(False))

    want = _literal(literal)
    found = (lambda v: inside(v, want)) if isinstance(want, (dict, list)) else (lambda v: inside(v, want) | inside(v, [want]))
    return _let(_json(doc), lambda v: F.when(v.isNotNull(), found(v)))


def json_set(doc: Column, path: tuple, value) -> Column:
    """The value put at a path of keys and places. As a path without its parent, or into a scalar, changes nothing; a place past an
    array's end is appended, one before its beginning is put first. Null where there is no JSON. Written by _text."""

    def put(at: Column, steps: tuple) -> Column:
        if not steps:
            return _variant(value)
        return _let(_object(at), lambda fields: _let(_items(at), lambda items: changed(at, fields, items, steps[0], steps[1:])))

    def changed(at: Column, fields: Column, items: Column, k, rest: tuple) -> Column:
        name = F.lit(str(k))
        there = F.map_contains_key(fields, name)
        field = put(F.try_element_at(fields, name), rest)
        out = F.when(fields.isNotNull() & (there if rest else F.lit(True)), F.to_variant_object(F.map_concat(F.map_filter(fields, lambda f, _: f != name), F.create_map(name, field)))).otherwise(at)
        if isinstance(k, int):
            place = F.lit(k) if k >= 0 else F.size(items) + k
            known = (place >= 0) & (place < F.size(items))
            out = F.when(items.isNotNull() & known, F.to_variant_object(F.transform(items, lambda x, i: F.when(i == place, put(x, rest)).otherwise(x)))).otherwise(out)
            if not rest:
                one = F.array(_variant(value))
                out = F.when(items.isNotNull() & ~known, F.to_variant_object(F.concat(items, one) if k >= 0 else F.concat(one, items))).otherwise(out)
        return out

    return _text(_let(_json(doc), lambda v: put(v, path)))


def json_merge(doc: Column, literal: str, drop: tuple[str, ...] = ()) -> Column:
    """(doc - keys) || literal at the top level. Of an array, strings among the keys go and the literal's elements are appended; a
    scalar stands for the array of it. Written by _text."""
    more, gone = _literal(literal), [str(k) for k in drop]
    tail = F.array(*[_variant(x) for x in (more if isinstance(more, list) else [more])]) if more != [] else F.slice(F.array(_variant(0)), 1, 0)

    def is_gone(x: Column) -> Column:
        return F.coalesce((F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").isin(gone), F.lit(False)) if gone else F.lit(False)

    def merged_fields(fields: Column) -> Column:
        kept = F.map_filter(fields, lambda k, _: ~k.isin(gone + list(more))) if gone or more else fields
        return F.to_variant_object(F.map_concat(kept, F.create_map(*[x for k, m in more.items() for x in (F.lit(k), _variant(m))])) if more else kept)

    def change(v: Column, fields: Column, items: Column) -> Column:
        listed = F.to_variant_object(F.concat(F.when(items.isNotNull(), F.filter(items, lambda x: ~is_gone(x))).otherwise(F.array(v)), tail))
        out = F.when(v.isNotNull(), listed)
        return F.when(fields.isNotNull(), merged_fields(fields)).otherwise(out) if isinstance(more, dict) else out

    return _text(_let(_json(doc), lambda v: _let(_object(v), lambda fields: _let(_items(v), lambda items: change(v, fields, items)))))


def json_kind(doc: Column) -> Column:
    """object, array or scalar; null if it is no JSON. Repeated keys are JSON here; NaN and Infinity are none."""

    def repeated(d: Column) -> Column:
        # a variant has no key twice: such documents are parsed as text by strict rules, within an array and within an object, as
        # whatever ends the one early breaks the other
        strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
        listed = F.from_json(F.concat(F.lit("["), d, F.lit("]")), "array<string>", strict)
        named = F.from_json(F.concat(F.lit('{"v":'), d, F.lit("}")), "map<string,string>", strict)
        first = F.substring(F.ltrim(d, F.lit(" \t\r\n")), 1, 1)
        return F.when((F.size(listed) == 1) & (F.size(named) == 1), F.when(first == "{", F.lit("object")).when(first == "[", F.lit("array")))

    def kind(v: Column) -> Column:
        return F.when(_object(v).isNotNull(), F.lit("object")).when(_items(v).isNotNull(), F.lit("array")).otherwise(F.lit("scalar"))

    return _let(doc, lambda d: _let(_json(d), lambda v: F.when(v.isNotNull(), kind(v)).otherwise(repeated(d))))


def json_unique_keys(doc: Column) -> Column:
    """Whether it is JSON and no object repeats a key."""
    return _json(doc).isNotNull()


def json_table(doc: Column, ddl: str) -> Column:
    """Rows of a JSON array of objects, with ordinality from 0, for select(): pos and col."""
    return F.posexplode(F.from_json(doc, f"array<struct<{ddl}>>"))


# identifiers, digests, numbers
def uuid_version(u: Column) -> Column:
    return F.conv(F.substring(u, 15, 1), 16, 10).cast("int")


def uuid7(ms: Column | None = None) -> Column:
    """A version 7 identifier: 48 bits of milliseconds, version, variant, random bits."""
    ms = F.unix_millis(F.current_timestamp()) if ms is None else ms
    t, r = F.lpad(F.lower(F.hex(ms)), 12, "0"), F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 4), F.lit("-7"), F.substring(r, 1, 3), F.lit("-a"), F.substring(r, 4, 3), F.lit("-"), F.substring(r, 18, 12))


def uuid7_time(u: Column) -> Column:
    return F.timestamp_millis(F.conv(F.concat(F.substring(u, 1, 8), F.substring(u, 10, 4)), 16, 10).cast("long"))


def sha256_hex(s: Column) -> Column:
    return F.sha2(s, 256)


def random_bytes(n: int) -> Column:
    return F.unhex(F.substring(F.concat(*[F.replace(F.uuid(), F.lit("-"), F.lit("")) for _ in range(-(-n // 14))]), 1, 2 * n))


def random_between(a: int, b: int) -> Column:
    """A whole number from a to b, both included."""
    return F.floor(F.rand() * (b - a + 1)).cast("int") + a


def random_range(a: float, b: float) -> Column:
    return F.lit(a) + F.rand() * (b - a)


def local_time(ts: Column) -> Column:
    """A time of UTC as the wall clock of the session's time zone shows it."""
    return F.from_utc_timestamp(ts, F.current_timezone())


def integer_literal(text: str) -> Column:
    """0x, 0o, 0b and underscores."""
    return F.lit(int(text, 0))
