r"""The text parser of full-text search: a text as tokens of documented kinds.

A token is a word (``asciiword``, ``word``, ``numword``), a hyphenated word (``asciihword``, ``hword``, ``numhword``) followed by its
parts (``hword_asciipart``, ``hword_part``, ``hword_numpart``), an ``email``, a ``protocol``, a ``url`` followed by its ``host`` and
``url_path``, a ``host``, a ``file``, a number (``sfloat``, ``float``, ``int``, ``uint``), a ``version``, a ``tag`` or an ``entity``.
What stands between tokens has no kind. The same patterns serve columns, in the JVM, and query texts, in Python. Repetitions are
bounded, so that no text makes a match deep or slow; what is longer is cut there and goes on as the next token.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_C = r"\p{L}\p{N}"
HOST = rf"(?:[{_C}](?:[{_C}_-]{{0,62}}[{_C}])?\.){{1,30}}\p{{L}}[{_C}]{{1,62}}(?::[0-9]{{1,5}})?"
PATH = r"/(?:[^\s<>\"']{0,2000}[^\s<>\"'.,;:!?)\]])?"
NUMBER = r"[-+]?[0-9]{1,400}(?:\.[0-9]{1,400})?(?:[eE][-+]?[0-9]{1,9})?"
NAME = rf"[{_C}_](?:[{_C}._-]{{0,254}}[{_C}_])?"

#: What a token is, in the order in which kinds are tried at a place.
SHAPES = {
    "tag": r"<[/!?]?\p{L}[^<>]{0,2000}>",
    "entity": rf"&(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|\p{{L}}[{_C}]{{0,30}});",
    "email": rf"[{_C}][{_C}._+-]{{0,63}}@{HOST}",
    "protocol": rf"\p{{L}}[{_C}+.-]{{0,30}}://",
    "url": HOST + PATH,
    "host": HOST,
    "file": rf"(?:~?/)?(?:[{_C}._-]{{1,255}}/){{1,63}}{NAME}|~?/{NAME}",
    "version": r"[0-9]{1,9}(?:\.[0-9]{1,9}){2,9}",
    "number": rf"(?<![{_C}]){NUMBER}(?![{_C}])",
    "hyphenated": rf"\p{{L}}[{_C}]{{0,62}}(?:-[{_C}]{{1,63}}){{1,63}}",
    "word": rf"[{_C}]{{1,2000}}",
}
#: Most tokens are words that nothing follows that any other kind could go on with.
PLAIN = rf"[{_C}]{{1,2000}}+(?![{_C}.@/:_+~-])"
TOKEN = f"{PLAIN}|" + "|".join(f"(?:{p})" for p in SHAPES.values())
#: Kinds that are parsed but not indexed, as in the published configuration.
DROPPED = ("tag", "entity", "protocol")

_token = regex.compile(TOKEN)
_shapes = {k: regex.compile(p) for k, p in SHAPES.items()}
_ASCII, _LETTERS = regex.compile(r"[A-Za-z-]+"), regex.compile(r"[\p{L}-]+")


def _word_kind(token: str, prefix: str, suffix: str) -> str:
    kind = "ascii" if _ASCII.fullmatch(token) else "" if _LETTERS.fullmatch(token) else "num"
    return f"{prefix}{kind}{suffix}" if suffix == "part" else f"{kind}{suffix}"


def _number_kind(token: str) -> str:
    return "sfloat" if "e" in token.lower() else "float" if "." in token else "int" if token[0] in "+-" else "uint"


def expand(token: str) -> list[tuple[str, str]]:
    """(kind, token) of a token of the text, and of its parts."""
    shape = next(k for k, p in _shapes.items() if p.fullmatch(token))
    if shape == "url":
        host = token[: token.index("/")]
        return [("url", token), ("host", host), ("url_path", token[len(host) :])]
    if shape == "hyphenated":
        return [(_word_kind(token, "", "hword"), token)] + [(_word_kind(p, "hword_", "part"), p) for p in token.split("-")]
    return [(_number_kind(token) if shape == "number" else _word_kind(token, "", "word") if shape == "word" else shape, token)]


def scan(text: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """(begin, end, tokens) of a text: each token with its parts."""
    return [(m.start(), m.end(), expand(m[0])) for m in _token.finditer(text)]


def parse(text: str) -> list[tuple[str, str]]:
    """(kind, token) in order."""
    return [t for _, _, parts in scan(text) for t in parts]


def indexed(text: str) -> list[tuple[str, str]]:
    """(kind, token) of the kinds that are indexed, in lower case."""
    return [(k, t) for k, t in parse(text.lower()) if k not in DROPPED]


# the same for columns


def _shape(token: Column) -> Column:
    out = F.lit("word")
    for kind, p in reversed(list(SHAPES.items())[:-1]):
        out = F.when(token.rlike(f"^(?:{p})$"), F.lit(kind)).otherwise(out)
    return out


def _kind_of_word(token: Column, prefix: str, suffix: str) -> Column:
    ascii_, letters, other = (f"{prefix}ascii{suffix}", f"{prefix}{suffix}", f"{prefix}num{suffix}")
    return F.when(token.rlike("^[A-Za-z-]+$"), F.lit(ascii_)).when(token.rlike(r"^[\p{L}-]+$"), F.lit(letters)).otherwise(F.lit(other))


def _pair(kind: Column, token: Column) -> Column:
    return F.struct(kind.alias("kind"), token.alias("token"))


def parsed(text: Column) -> Column:
    """array<struct<kind, token>> of a column of texts; null for null."""

    def of(token: Column) -> Column:
        host = F.substring_index(token, "/", 1)
        path = F.substring(token, F.char_length(host) + 1, F.char_length(token))
        shape = _shape(token)
        number = F.when(token.rlike("[eE]"), F.lit("sfloat")).when(token.contains("."), F.lit("float")).when(token.rlike("^[-+]"), F.lit("int")).otherwise(F.lit("uint"))
        parts = F.transform(F.split(token, "-"), lambda p: _pair(_kind_of_word(p, "hword_", "part"), p))
        return (
            F.when(shape == "url", F.array(_pair(F.lit("url"), token), _pair(F.lit("host"), host), _pair(F.lit("url_path"), path)))
            .when(shape == "hyphenated", F.concat(F.array(_pair(_kind_of_word(token, "", "hword"), token)), parts))
            .otherwise(F.array(_pair(F.when(shape == "number", number).when(shape == "word", _kind_of_word(token, "", "word")).otherwise(shape), token)))
        )

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), of))


#: What ends a token whatever its kind, but for tags and entities, with the punctuation that belongs to none.
BETWEEN = r"[.,;:!?)\]]*[\s\"']+[(\[]*"


def indexed_tokens(text: Column) -> Column:
    """array<string> of the indexed kinds' tokens in lower case, parts included: a token's number in it is its place. Texts without
    tags and entities are split first, and most pieces are plain words; only the others are scanned."""
    urls, hyphens = f"^(?:{SHAPES['url']})$", f"^(?:{SHAPES['hyphenated']})$"
    gone = "^(?:" + "|".join(f"(?:{SHAPES[k]})" for k in DROPPED) + ")$"

    def of(token: Column) -> Column:
        host = F.substring_index(token, "/", 1)
        path = F.substring(token, F.char_length(host) + 1, F.char_length(token))
        other = F.when(token.rlike(gone), F.array().cast("array<string>")).when(token.rlike(hyphens), F.concat(F.array(token), F.split(token, "-"))).when(token.rlike(urls), F.array(token, host, path)).otherwise(F.array(token))
        return F.when(token.rlike(f"^[{_C}]+$"), F.array(token)).otherwise(other)

    def scanned(part: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0)), of))

    low = F.lower(text)
    pieces = F.flatten(F.transform(F.split(low, BETWEEN), lambda c: F.when(c.rlike(f"^[{_C}]{{1,2000}}$"), F.array(c)).otherwise(scanned(c))))
    return F.when(text.rlike("[<&]"), scanned(low)).otherwise(pieces)
