r"""Byte-level BPE: overlapping-chunk encoding and decoding.

Encoding. A text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``; chunks of long texts are spread over
the cluster and pre-tokenised in parallel. A chunk's first pre-tokens may be wrong, as it begins anywhere, and so may its
last; but a pre-token depends only on what follows its start, so from the first start that two neighbours share in their
overlap on, both agree. There the text is cut, and the pieces between cuts are encoded, again in parallel, and put together
in order. Where neighbours share no start in the overlap (one run longer than it), the two pieces are joined: the result is
always that of the whole text. Texts of one chunk take one pass and no shuffle.

Decoding concatenates the bytes of the ids.

Defined results: a null text is the empty text and has no ids; texts are encoded one by one, so repeated rows and rows
sharing an id are independent; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, session

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Characters that a pre-token's match reads past its own end, at most.
LOOKAHEAD = 3
#: The file of ranks; any path that the executors can read.
RANKS = "byte_bpe_50k.tiktoken"


def vocabulary(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """(tiktoken encoding, pre-token pattern, bytes by id) of a file of ranks."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public_tokenizers.PATTERN), table


def starts(chunk: str, at: int, last: bool, pattern) -> list[int]:
    """Starts of the pre-tokens of a chunk that begins at ``at``, as far as what follows the chunk cannot change them, and
    as far as a text may be cut there."""
    found, end = [at], at + len(chunk)
    for m in pattern.finditer(chunk):
        if not last and at + m.end() + LOOKAHEAD > end:
            break
        # a piece that ended in white space would be matched to its end, where a letter after it leaves the last space out
        if not chunk[m.end() - 1].isspace():
            found.append(at + m.end())
    return found


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """(place, characters) of the overlapping chunks; the last one reaches the end."""
    n = max(1, -(-len(text) // size))
    return [(i * size, text[i * size : (i + 1) * size + (overlap if i < n - 1 else 0)]) for i in range(n)]


def cuts(found: list[tuple[int, list[int]]]) -> list[int]:
    """For chunks (place, starts), where each piece begins: at the first start that a chunk shares with the one before it.
    -1: it shares none, and its piece goes on from the one before."""
    out, seen = [0], found[0][1]
    for place, mine in found[1:]:
        both = sorted(set(seen).intersection(mine))
        out.append(both[0] if both else -1)
        # without a shared start the chunk before is still the last one known to be right, and no start of this one is
        seen = mine[mine.index(both[0]) :] if both else []
    return out


def encode_text(text: str, path: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text, by the same steps on one machine."""
    enc, pattern, _ = encoder(path)
    parts = chunks(text, size, overlap)
    if len(parts) == 1:
        return enc.encode_ordinary(text)
    at = [c for c in cuts([(p, starts(c, p, i == len(parts) - 1, pattern)) for i, (p, c) in enumerate(parts)]) if c >= 0]
    return [i for a, b in zip(at, [*at[1:], len(text)]) for i in enc.encode_ordinary(text[a:b])]


def _ids_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encode_batches(path: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _, _ = encoder(path)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):  # ids take four times the room of a text
                part = batch.slice(at, 256)
                ids = [enc.encode_ordinary(t.as_py() or "") for t in texts.slice(at, 256)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in columns] + [_ids_array(ids)], names=[*columns, "ids"])

    return run


def _split(size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("__row").to_pylist(), batch.column("text")):
                parts = chunks(text.as_py(), size, overlap)
                for i, (place, chunk) in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([i]), pa.array([place]), pa.array([i == len(parts) - 1]), pa.array([chunk])], names=["__row", "i", "place", "last", "chunk"])

    return run


def _pretokenise(path: str, size: int, overlap: int):
    """Of each chunk only what its neighbours need: the starts inside its two overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pattern, _ = encoder(path)
        for batch in batches:
            out = []
            for place, last, chunk in zip(batch.column("place").to_pylist(), batch.column("last").to_pylist(), batch.column("chunk")):
                found = starts(chunk.as_py(), place, last, pattern)
                out.append([s for s in found if s <= place + overlap or s >= place + size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "starts"])

    return run


def _stitch(group: pa.Table) -> pa.Table:
    """The chunks of one text, in order: each with the place where its piece begins, -1 for none."""
    order = np.argsort(group.column("i").to_numpy())
    group = group.take(order)
    at = cuts(list(zip(group.column("place").to_pylist(), group.column("starts").to_pylist())))
    chunk, place = group.column("chunk").to_pylist(), group.column("place").to_pylist()
    begin = [a for a in at if a >= 0]
    ends = [*begin[1:], place[-1] + len(chunk[-1])]
    pieces = []
    holders = [i for i, a in enumerate(at) if a >= 0]
    for h, (a, b) in zip(holders, zip(begin, ends)):
        text, i = chunk[h][a - place[h] :], h
        while place[i] + len(chunk[i]) < b:  # the piece goes on in the next chunks
            i += 1
            text += chunk[i][place[i - 1] + len(chunk[i - 1]) - place[i] :]
        pieces.append(text[: b - a])
    n = len(pieces)
    return pa.table({"__row": group.column("__row").take(list(range(1)) * n), "i": pa.array(range(n), pa.int64()), "piece": pa.array(pieces, pa.string())})


def _parts(docs: DataFrame, path: str, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk (doc_id, text), and all others encoded (doc_id, ids)."""
    session(docs)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    short = d.where(F.coalesce(F.length("text"), F.lit(0)) <= size)
    # a row's place in the scan is its key here: ids may be null or repeat
    long = d.where(F.length("text") > size).withColumn("__row", F.monotonically_increasing_id())
    named = long.select(F.struct("__row", "doc_id").alias("__row"), "text")
    key = f"struct<__row:bigint,doc_id:{kind}>"
    parts = named.mapInArrow(_split(size, overlap), f"__row {key}, i bigint, place bigint, last boolean, chunk string")
    parts = parts.repartition("__row", "i").mapInArrow(_pretokenise(path, size, overlap), f"__row {key}, i bigint, place bigint, last boolean, chunk string, starts array<bigint>")
    pieces = parts.groupBy("__row").applyInArrow(_stitch, f"__row {key}, i bigint, piece string")
    encoded = pieces.withColumnRenamed("piece", "text").repartition("__row", "i").mapInArrow(_encode_batches(path, ["__row", "i"]), f"__row {key}, i bigint, ids array<int>")
    whole = encoded.groupBy("__row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short, whole.select("__row.doc_id", "ids")


def encode(docs: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id and ids (array<int>) for every document."""
    path = path or vocabulary()
    short, long = _parts(docs, path, size, overlap)
    return short.mapInArrow(_encode_batches(path, ["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>").union(long)


def _digested(doc_ids: pa.Array, lists: list[np.ndarray], table: list[bytes]) -> pa.RecordBatch:
    flat = [np.asarray(x, "<u4") for x in lists]
    ids_sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in flat]
    text_sha = [hashlib.sha256(decode_ids(x.tolist(), table)).hexdigest() for x in flat]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in flat], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _digest_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, table = encoder(path)
        for batch in batches:
            yield _digested(batch.column("doc_id"), [x.values.to_numpy() for x in batch.column("ids")], table)

    return run


def _encode_and_digest(path: str):
    """As _encode_batches and _digest_batches: the ids never leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _, table = encoder(path)
        for batch in batches:
            yield _digested(batch.column("doc_id"), [np.array(enc.encode_ordinary(t.as_py() or ""), "<u4") for t in batch.column("text")], table)

    return run


def decode_ids(ids: list[int], table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded (binary) of rows with ids."""
    session(encoded)
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, table = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([decode_ids(x.as_py() or [], table) for x in batch.column("ids")], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded binary")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    session(encoded)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_digest_batches(path or vocabulary()), f"doc_id {kind}, {DIGESTS}")


def round_trip(docs: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The digests of the encoded documents, ids of short texts being made and decoded in one step."""
    path = path or vocabulary()
    short, long = _parts(docs, path, size, overlap)
    return short.mapInArrow(_encode_and_digest(path), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGESTS}").union(digests(long, path))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
