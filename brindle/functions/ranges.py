"""Half-open ranges as struct<lo,hi>, multiranges as sorted arrays of them, and network addresses. A null bound is open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(lo: Column, hi: Column) -> Column:
    return F.when(lo > hi, F.raise_error(F.lit("range lower bound must be less than or equal to upper bound"))).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def is_empty(r: Column) -> Column:
    return F.coalesce(r["lo"] >= r["hi"], F.lit(False))


def contains(r: Column, x: Column) -> Column:
    return F.coalesce(x >= r["lo"], F.lit(True)) & F.coalesce(x < r["hi"], F.lit(True))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(a["lo"] < b["hi"], F.lit(True)) & F.coalesce(b["lo"] < a["hi"], F.lit(True)) & ~is_empty(a) & ~is_empty(b)


def intersection(a: Column, b: Column) -> Column:
    """Null if the ranges do not overlap. greatest and least skip nulls, which are open bounds here."""
    return F.when(overlaps(a, b), F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi")))


def pieces(a: Column, b: Column) -> Column:
    """What is left of a without b: none, one or two ranges."""
    left = F.struct(a["lo"].alias("lo"), b["lo"].alias("hi"))
    right = F.struct(b["hi"].alias("lo"), a["hi"].alias("hi"))
    has_left = b["lo"].isNotNull() & (a["lo"].isNull() | (a["lo"] < b["lo"]))
    has_right = b["hi"].isNotNull() & (a["hi"].isNull() | (b["hi"] < a["hi"]))
    kept = F.filter(F.array(F.when(has_left, left), F.when(has_right, right)), lambda x: x.isNotNull())
    return F.when(overlaps(a, b), kept).otherwise(F.array(F.struct(a["lo"].alias("lo"), a["hi"].alias("hi"))))


def difference(a: Column, b: Column) -> Column:
    """One range or null; an error if two pieces are left."""
    p = pieces(a, b)
    return F.when(F.size(p) > 1, F.raise_error(F.lit("result of range difference would not be contiguous"))).otherwise(F.get(p, F.lit(0)))


def multi_contains(m: Column, x: Column) -> Column:
    return F.exists(m, lambda r: contains(r, x))


def multi_difference(m: Column, b: Column) -> Column:
    """A multirange without each range of another."""
    return F.aggregate(b, m, lambda acc, r: F.flatten(F.transform(acc, lambda a: pieces(a, r))))


def coalesced(m: Column) -> Column:
    """Sorted and joined where ranges touch or overlap: the normal form of a multirange with closed ends."""
    start = F.slice(F.array_sort(m), 1, 0)

    def step(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["hi"] >= r["lo"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(m), start, step)


def render(r: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(r["lo"].cast("string"), F.lit("")), F.lit(","), F.coalesce(r["hi"].cast("string"), F.lit("")), F.lit(")"))


def inet(text: Column) -> Column:
    """'a.b.c.d/n' -> struct<addr, masklen>; without a mask, 32. An error for what is no such address."""
    octet, mask_size = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])", "(?:3[0-2]|[12]?[0-9])"
    known = text.rlike(rf"^{octet}(?:\.{octet}){{3}}(?:/{mask_size})?$")
    parts = F.split(F.substring_index(text, "/", 1), r"\.")
    addr = F.lit(0).cast("long")
    for i in range(4):
        addr = addr * 256 + F.element_at(parts, i + 1).cast("long")
    mask = F.when(text.contains("/"), F.substring_index(text, "/", -1).cast("int")).otherwise(F.lit(32))
    found = F.struct(addr.alias("addr"), mask.alias("masklen"))
    return F.when(known, found).when(text.isNotNull(), F.raise_error(F.concat(F.lit("invalid input syntax for type inet: "), text)))


def _network(a: Column, masklen: Column) -> Column:
    return F.floor(a / F.pow(F.lit(2.0), F.lit(32) - masklen)).cast("long")


def within(a: Column, b: Column) -> Column:
    """a << b: strictly inside."""
    return (a["masklen"] > b["masklen"]) & (_network(a["addr"], b["masklen"]) == _network(b["addr"], b["masklen"]))


def contains_or_equals(a: Column, b: Column) -> Column:
    """a >>= b."""
    return (a["masklen"] <= b["masklen"]) & (_network(a["addr"], a["masklen"]) == _network(b["addr"], a["masklen"]))


def set_masklen(a: Column, n: int) -> Column:
    return F.struct(a["addr"].alias("addr"), F.lit(n).alias("masklen"))


def inet_text(a: Column) -> Column:
    octets = [(F.floor(a["addr"] / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)]
    return F.concat(F.concat_ws(".", *octets), F.when(a["masklen"] < 32, F.concat(F.lit("/"), a["masklen"].cast("string"))).otherwise(F.lit("")))
