"""Function sets that are loaded into a session by name, for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from brindle.functions import values

_WORDS = "filter(split(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"
_TRIGRAMS = "array_distinct(flatten(transform(" + _WORDS + ", w -> transform(sequence(1, char_length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))"

#: By set, functions as (signature, result, body). Bodies are SQL, and so are inlined into the plans that call them.
SETS: dict[str, tuple[tuple[str, str, str], ...]] = {
    "trigrams": (
        ("show_trgm(s STRING)", "ARRAY<STRING>", _TRIGRAMS.format("s")),
        ("similarity(a STRING, b STRING)", "DOUBLE", f"coalesce(try_divide(size(array_intersect({_TRIGRAMS.format('a')}, {_TRIGRAMS.format('b')})), size(array_union({_TRIGRAMS.format('a')}, {_TRIGRAMS.format('b')}))), 0.0D)"),
    ),
    "labels": (
        ("nlevel(p STRING)", "INT", "size(split(p, '\\\\.'))"),
        ("subpath(p STRING, start INT, n INT)", "STRING", "array_join(slice(split(p, '\\\\.'), start + 1, n), '.')"),
    ),
    "maps": (("hstore(s STRING)", "MAP<STRING, STRING>", "str_to_map(s, ', *', '=>')"), ("akeys(m MAP<STRING, STRING>)", "ARRAY<STRING>", "array_sort(map_keys(m))")),
    "digests": (("digest_hex(s STRING)", "STRING", "sha2(s, 256)"),),
    "accents": (),
}


def load(spark: SparkSession, *names: str) -> list[str]:
    """The functions of the named sets, as temporary functions of the session; returned are their names. An unknown set is an
    error."""
    made = []
    for n in names:
        if n not in SETS:
            raise ValueError(f"unknown extension {n}")
        for signature, kind, body in SETS[n]:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
            made.append(signature.partition("(")[0])
        if n == "accents":
            spark.udf.register("unaccent", values.unaccent_udf())
            made.append("unaccent")
    return made
