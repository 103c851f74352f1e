r"""Token counts without tokens: heap-and-linked-list byte-pair merging.

A text's symbols stand in a linked list; a heap holds the adjacent pairs whose concatenation is a piece, by rank, then place.
The lowest is popped and merged until none is left. The count is the number of symbols minus the merges, plus what byte
fallback adds for symbols that are no piece. No id is made.

No piece of the vocabulary has a space mark after another character (checked when the file is read), so no merge crosses the
start of a word, and a text's count is the sum of its words' counts; frequent words are counted once a worker. A vocabulary
that breaks this rule is merged text by text.

Defined results: a null text is the empty text and has no tokens; repeated rows get equal counts; an empty table gives an
empty result; a text of one very long word is merged by the same heap in n log n steps; extra columns are not looked at.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, session

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their counts in a worker, and the longest of them.
MEMO_WORDS, MEMO_CHARS = 1 << 19, 64


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        i += 1
        if b[i - 1] < 128:
            return x, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            v, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Counter:
    """Counts the tokens of texts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import struct

        with open(path, "rb") as f:
            raw = f.read()
        pieces, self.dummy_prefix, self.trim, self.escape, charsmap = [], True, True, True, b""
        self.suffix = False
        for number, value in fields(raw):
            if number == 1:
                p = dict(fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                self.suffix = bool(dict(fields(value)).get(24, 0))
            elif number == 3:
                n = dict(fields(value))
                charsmap = n.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if charsmap or self.suffix or any(k == USER for _, _, k in pieces):
            raise ValueError("only models without a character map, suffix spaces and user-defined pieces are counted here")
        ordered = sorted({s for _, s, k in pieces if k in (NORMAL, UNUSED)}, reverse=True)
        rank_of = {s: i for i, s in enumerate(ordered)}
        self.rank = {p: rank_of[s] for p, s, k in pieces if k in (NORMAL, UNUSED)}
        if any(k == UNUSED for _, _, k in pieces):
            raise ValueError("unused pieces would be taken apart again; this model has some")
        if not any(k == BYTE for _, _, k in pieces):
            raise ValueError("without byte fallback neighbouring unknown symbols would be one token; this model has none")
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.memo: dict[str, int] = {}
        self.word = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def merge(self, symbols: str) -> int:
        """Tokens of a run of symbols: symbols minus merges, plus the bytes of those that stay without a piece."""
        rank, n = self.rank, len(symbols)
        text, right, left = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i : i + 2])
            if r is not None:
                heap.append((r, i, symbols[i : i + 2]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if text[i] else n
            if j >= n or text[i] + text[j] != pair:
                continue
            merges += 1
            text[i], text[j] = pair, ""
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                r = rank.get(pair + text[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, pair + text[k]))
            h = left[i]
            if h >= 0:
                r = rank.get(text[h] + pair)
                if r is not None:
                    heapq.heappush(heap, (r, h, text[h] + pair))
        return n - merges + sum(len(t.encode()) - 1 for t in text if len(t) == 1 and t not in rank)

    def count(self, text: str) -> int:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return 0
        if self.escape:
            text = text.replace(" ", MARK)
            if self.dummy_prefix:
                text = MARK + text
        if not self.by_word:
            return self.merge(text)
        memo, total = self.memo, 0
        for w in self.word.findall(text):
            c = memo.get(w)
            if c is None:
                c = self.merge(w)
                if len(w) <= MEMO_CHARS:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    memo[w] = c
            total += c
        return total


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    from .bpe import vocabulary

    session(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text").mapInArrow(_count_batches(path or vocabulary(MODEL)), f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return d.withColumn("over_limit", d["n_tokens"] > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return count(documents(spark, sf_dir))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE_SQL: dict[str, str] = {}
