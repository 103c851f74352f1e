"""Full-text search: documents as maps from lexeme to positions, queries as boolean trees over them.

Texts are parsed into tokens of documented kinds (``tokens``). Words, hyphenated ones and their parts are stemmed by the published
English Snowball algorithm (Porter2); all other kinds are lexemes as they stand, in lower case. Stop words are no lexemes and are
dropped from queries, but count as places. A query of nothing, or of stop words only, matches nothing. Ranks are PostgreSQL's
published formulas at its default weights. ``textindex`` keeps postings, which answer queries without reading texts again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import tokens
from brindle.session import ship

#: English stop words.
STOP = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)
VOWELS = "aeiouy"


#: Fixed values of the stemmer: words that it does not treat by rule, and its steps' endings.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = frozenset("sky news howe atlas cosmos bias andes".split())
KEPT_LATER = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = dict(x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble ogi:og fulli:ful lessli:less li:".split())
STEP3 = dict(x.split(":") for x in "tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness: ative:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _regions(w: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""

    def after(i: int) -> int:
        while i < len(w) and w[i] not in VOWELS:
            i += 1
        while i < len(w) and w[i] in VOWELS:
            i += 1
        return min(i + 1, len(w))

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _ends_short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-1] not in VOWELS + "wxY" and w[-2] in VOWELS and w[-3] not in VOWELS


def _longest(w: str, ends) -> str | None:
    return max((e for e in ends if w.endswith(e)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(w: str) -> str:
    """The stem of a word in lower case."""
    if len(w) <= 2:
        return w
    if w in SPECIAL:
        return SPECIAL[w]
    if w in KEPT:
        return w
    w = re.sub(f"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in KEPT_LATER:
        return w
    end = _longest(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = _longest(w, STEP2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + STEP2[end]
    end = _longest(w, STEP3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP3[end]
    end = _longest(w, STEP4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in tuple("st")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _ends_short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=1 << 16)
def lexeme(kind: str, token: str) -> str | None:
    """The lexeme of a token in lower case; null for a stop word."""
    if kind.endswith(("word", "part")) and "num" not in kind:
        return None if token in STOP else stem(token)
    return token


def lexeme_of(token: str) -> str | None:
    """As lexeme(), of a token of unknown kind."""
    return lexeme(tokens.expand(token)[0][0] if not token.isalpha() else "word", token)


def lexemes(text: str | None) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, (kind, token) in enumerate(tokens.indexed(text or ""), 1):
        if (found := lexeme(kind, token)) is not None:
            out.setdefault(found, []).append(i)
    return out


def _vectors(texts: pa.Array) -> pa.Array:
    # few texts at a time: a batch's lexemes as Python objects take many times their text
    kind, few = pa.map_(pa.string(), pa.list_(pa.int32())), 256
    return pa.concat_arrays([pa.array([list(lexemes(t.as_py()).items()) for t in texts.slice(i, few)], kind) for i in range(0, max(len(texts), 1), few)])


def to_tsvector(text: Column) -> Column:
    """Lexemes with their places, of each text by itself. For many queries over one table build a ``textindex`` instead."""
    ship(SparkSession.active())

    @F.arrow_udf(T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))
    def vectors(texts: pa.Array) -> pa.Array:
        return _vectors(texts)

    # a filter on the vector would else be pushed below it and compute it again
    return vectors.asNondeterministic()(text)


@dataclass(frozen=True)
class Query:
    """op: term, phrase, and, or, not, none (matches nothing)."""

    op: str
    terms: tuple = ()


NONE = Query("none")


def joined(op: str, parts: list[Query]) -> Query:
    """What is left of the parts that are something."""
    some = tuple(p for p in parts if p.op != "none")
    return NONE if not some else some[0] if len(some) == 1 else Query(op, some)


def negated(q: Query) -> Query:
    return q if q.op == "none" else Query("not", (q,))


def _words(text: str) -> Query:
    """A word, a phrase where a token holds several, or none for stop words."""
    q = phraseto_tsquery(text)
    return Query("term", (q.terms[0][0],)) if q.op == "phrase" and len(q.terms) == 1 else q


def to_tsquery(text: str) -> Query:
    """a & b | !c, with parentheses. An operator without an operand is an error."""
    tokens = re.findall(r"[&|!()]|[^\s&|!()]+", text)
    if not tokens:
        return NONE
    place = 0

    def peek() -> str:
        return tokens[place] if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        if not peek():
            raise ValueError(f"syntax error in tsquery: {text!r}")
        place += 1
        return tokens[place - 1]

    def either() -> Query:
        parts = [both()]
        while peek() == "|":
            take()
            parts.append(both())
        return joined("or", parts)

    def both() -> Query:
        parts = [one()]
        while peek() == "&":
            take()
            parts.append(one())
        return joined("and", parts)

    def one() -> Query:
        t = take()
        if t == "!":
            return negated(one())
        if t == "(":
            q = either()
            if take() != ")":
                raise ValueError(f"syntax error in tsquery: {text!r}")
            return q
        if t in "&|)":
            raise ValueError(f"syntax error in tsquery: {text!r}")
        return _words(t)

    q = either()
    if peek():
        raise ValueError(f"syntax error in tsquery: {text!r}")
    return q


def phraseto_tsquery(text: str) -> Query:
    """Words at the same distances as in the phrase; stop words count as places."""
    at = sorted((p, w) for w, ps in lexemes(text).items() for p in ps)
    return Query("phrase", tuple((w, p - at[0][0]) for p, w in at)) if at else NONE


def plainto_tsquery(text: str) -> Query:
    """All words, joined by and."""
    return joined("and", [Query("term", (w,)) for w in lexemes(text)])


def websearch_to_tsquery(text: str) -> Query:
    """Words are joined by and; "phrases", or, and -word. Any text is a query."""
    groups: list[list[Query]] = [[]]
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if word.lower() == "or" and not minus:
            groups.append([])
            continue
        q = _words(quoted or word)
        groups[-1].append(negated(q) if minus else q)
    return joined("or", [joined("and", g) for g in groups])


def matches(v: Column, q: Query) -> Column:
    """v @@ q, over map columns, without Python."""
    if q.op == "none":
        return F.lit(False)
    if q.op == "term":
        return F.coalesce(F.map_contains_key(v, q.terms[0]), F.lit(False))
    if q.op == "phrase":
        first = q.terms[0][0]
        rest = [lambda p, w=w, d=d: F.coalesce(F.array_contains(F.try_element_at(v, F.lit(w)), p + d), F.lit(False)) for w, d in q.terms[1:]]

        def all_of(p: Column) -> Column:
            out = F.lit(True)
            for r in rest:
                out = out & r(p)
            return out

        return F.coalesce(F.exists(F.try_element_at(v, F.lit(first)), all_of), F.lit(False))
    if q.op == "not":
        return ~matches(v, q.terms[0])
    out = matches(v, q.terms[0])
    for t in q.terms[1:]:
        out = (out & matches(v, t)) if q.op == "and" else (out | matches(v, t))
    return out


def words_of(q: Query) -> list[str]:
    if q.op == "term":
        return [q.terms[0]]
    if q.op == "phrase":
        return [w for w, _ in q.terms]
    return [] if q.op in ("not", "none") else [w for t in q.terms for w in words_of(t)]


#: Fixed values of the rank formulas: the weight of a place, and the limit of the sum of inverse squares.
WEIGHT, SQUARES = 0.1, 1.64493406685


def _operands(q: Query) -> list[str]:
    """Distinct words of a query, those under a not included."""
    if q.op in ("not", "and", "or"):
        return sorted({w for t in q.terms for w in _operands(t)})
    return sorted(set(words_of(q)))


def rank(v: Column, q: Query) -> Column:
    """ts_rank: for or, each word's places add inverse squares of their numbers, over the number of words; for and and phrases,
    each two words add what is near."""
    ws = _operands(q)
    if not ws:
        return F.lit(0.0)
    places = {w: F.coalesce(F.try_element_at(v, F.lit(w)), F.array().cast("array<int>")) for w in ws}
    if q.op not in ("and", "phrase") or len(ws) < 2:
        out = F.lit(0.0)
        for w in ws:
            out = out + F.aggregate(F.transform(places[w], lambda _, i: F.lit(WEIGHT) / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, x: a + x) / SQUARES
        return out / len(ws)

    def near(p: Column, o: Column) -> Column:
        d = F.abs(p - o)
        return F.sqrt(WEIGHT * WEIGHT * F.when(d > 100, F.lit(1e-30)).otherwise(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2))))

    missing = F.lit(1.0)  # of nothing near
    for i, a in enumerate(ws):
        for b in ws[i + 1 :]:
            other = places[b]
            pairs = F.flatten(F.transform(places[a], lambda p: F.transform(other, lambda o: near(p, o))))  # noqa: B023  used at once
            missing = missing * F.aggregate(pairs, F.lit(1.0), lambda m, x: m * (1 - x))
    return F.when(missing == 1.0, F.lit(1e-20)).otherwise(1 - missing)


@dataclass(frozen=True)
class Headline:
    """How headlines are made: fixed values are the published defaults. Without fragments, one passage of at most ``max_words`` and
    at least ``min_words`` words; with them, up to ``max_fragments`` of at most ``max_words`` each."""

    max_words: int = 35
    min_words: int = 15
    short_word: int = 3
    highlight_all: bool = False
    max_fragments: int = 0
    start: str = "<b>"
    stop: str = "</b>"
    delimiter: str = " ... "

    def __post_init__(self):
        if not 0 < self.min_words < self.max_words:
            raise ValueError("min_words must be positive and less than max_words")
        if self.short_word < 0 or self.max_fragments < 0:
            raise ValueError("short_word and max_fragments must not be negative")


def _holds(q: Query, places: dict[str, list[int]]) -> bool:
    """Whether the places of a passage satisfy the query, with any negation left out."""
    if q.op == "term":
        return bool(places.get(q.terms[0]))
    if q.op == "phrase":
        first, *rest = q.terms
        return any(all(p + d in places.get(w, ()) for w, d in rest) for p in places.get(first[0], ()))
    if q.op in ("and", "or"):
        return (all if q.op == "and" else any)(_holds(t, places) for t in q.terms)
    return q.op == "not"


def _without_not(q: Query) -> Query:
    """The query's positive part."""
    if q.op in ("and", "or"):
        return joined(q.op, [_without_not(t) for t in q.terms])
    return NONE if q.op == "not" else q


class _Text:
    """The words of a text: spans, places and which of them the query names."""

    def __init__(self, text: str, wanted: frozenset[str]):
        self.text = text
        self.spans: list[tuple[int, int]] = []
        self.named: list[list[tuple[str, int]]] = []
        place = 0
        for begin, end, parts in tokens.scan(text):
            if parts[0][0] in tokens.DROPPED:
                continue
            some = []
            for kind, token in parts:
                place += 1
                if (found := lexeme(kind, token.lower())) in wanted:
                    some.append((found, place))
            self.spans.append((begin, end))
            self.named.append(some)

    def hits(self, a: int, b: int) -> int:
        return sum(bool(x) for x in self.named[a:b])

    def dull(self, i: int, short: int) -> bool:
        begin, end = self.spans[i]
        return end - begin <= short and not self.named[i]

    def marked(self, a: int, b: int, how: Headline, whole: bool = False) -> str:
        """Words a to b with what stands between them."""
        if a >= b and not whole:
            return ""
        at, stop = (0, len(self.text)) if whole else (self.spans[a][0], self.spans[b - 1][1])
        out = []
        for i in range(a, b):
            begin, end = self.spans[i]
            out.append(self.text[at:begin])
            out.append(f"{how.start}{self.text[begin:end]}{how.stop}" if self.named[i] else self.text[begin:end])
            at = end
        return "".join(out) + self.text[at:stop]

    def covers(self, q: Query) -> list[tuple[int, int]]:
        """The shortest passages (words a to b) that satisfy the query, none within another."""
        at = [i for i, x in enumerate(self.named) if x]
        out: list[tuple[int, int]] = []
        for k, i in enumerate(at):
            places: dict[str, list[int]] = {}
            for j in at[k:]:
                for w, p in self.named[j]:
                    places.setdefault(w, []).append(p)
                if _holds(q, places):
                    if out and out[-1][1] >= j + 1:
                        out.pop()  # it holds this one
                    out.append((i, j + 1))
                    break
            else:
                break  # no later beginning finds more
        return out


def make_headline(text: str, q: Query, how: Headline = Headline()) -> str:
    """The passage or fragments of the text that show the query best, with its words marked."""
    q = _without_not(q)
    t = _Text(text, frozenset(words_of(q)))
    n = len(t.spans)
    if how.highlight_all:
        return t.marked(0, n, how, whole=True)
    covers = t.covers(q) if q.op != "none" else []
    if not covers:
        return t.marked(0, min(n, how.min_words), how)
    if not how.max_fragments:
        best: tuple | None = None
        for a, b in covers:
            b = min(b, a + how.max_words)
            while b < n and b - a < how.max_words and (b - a < how.min_words or t.dull(b - 1, how.short_word)):
                b += 1
            while b - a > how.min_words and t.dull(b - 1, how.short_word):
                b -= 1
            while a > 0 and b - a < how.min_words:
                a -= 1
            while b - a > how.min_words and t.dull(a, how.short_word):
                a += 1
            if best is None or t.hits(a, b) > best[0]:
                best = (t.hits(a, b), a, b)
        return t.marked(best[1], best[2], how)
    # covers that are too long are cut into pieces that begin and end with words of the query
    pieces = []
    for a, b in covers:
        while a < b:
            end = min(b, a + how.max_words)
            last = max(i for i in range(a, end) if t.named[i]) + 1
            pieces.append((a, last))
            a = next((i for i in range(last, b) if t.named[i]), b)
    chosen: list[tuple[int, int]] = []
    for a, b in sorted(dict.fromkeys(pieces), key=lambda p: (-t.hits(*p), p[1] - p[0], p[0])):
        if len(chosen) == how.max_fragments:
            break
        if any(a < d and c < b for c, d in chosen):
            continue
        room = how.max_words - (b - a)
        low, high = max([0, *(d for _, d in chosen if d <= a)]), min([n, *(c for c, _ in chosen if c >= b)])
        left, right = max(low, a - room // 2), min(high, b + room - room // 2)
        while left < a and t.dull(left, how.short_word):
            left += 1
        while right > b and t.dull(right - 1, how.short_word):
            right -= 1
        chosen.append((left, right))
    return how.delimiter.join(t.marked(a, b, how) for a, b in sorted(chosen))


def headline(text: Column, q: Query, how: Headline = Headline()) -> Column:
    """Headlines of a column of texts; null for null."""
    ship(SparkSession.active())

    @F.arrow_udf(T.StringType())
    def mark(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else make_headline(t, q, how) for t in texts.to_pylist()], pa.string())

    return mark(text)
