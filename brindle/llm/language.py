r"""Language identification by string kernels.

The kernel of two texts is a blended-spectrum presence kernel: for n = 1, 2, 3 bytes, the n-grams that both texts hold, over
the root of the product of how many each holds. Landmarks give a Nyström map of it, and one ridge regression for each
language is solved in that space. As the kernel is linear in a text's presence vector, landmark kernels, map and weights fold
into one matrix for each n, and texts are scored in batches by matrix products.

The fit reads at most ``FIT_ROWS`` texts of each language, chosen by the hash of their id, as presence bits (16 KiB a text,
whatever its length). Every language is learned: landmarks are its first texts, at least ``MARKS_EACH``, tasks sum up the
regressions' equations, and the matrix has half a megabyte a language. Predictions read whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties of scores go to the first language by
code point; without any row to learn from all is ``und``; repeated rows are predicted alike and count as often as they
appear in the fit; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, durable, remainder, session

FOLDS, HELD_OUT = 5, 0
FIT_ROWS, LANDMARKS, MARKS_EACH = 300, 256, 4
RIDGE, SHARPNESS = 1e-2, 6.0
#: Places of presence vectors: all bytes, all pairs of bytes, hashed triples.
WIDTHS = (1 << 8, 1 << 16, 1 << 16)
TOTAL = sum(WIDTHS)
BATCH = 64


def presence(text: str, out: np.ndarray) -> None:
    """Mark the text's n-grams in a zeroed row of TOTAL places. ASCII letters are taken in lower case, white space as one."""
    b = np.frombuffer(b" " + b" ".join(text.encode().lower().split()) + b" ", np.uint8)
    out[b] = 1
    pairs = b[:-1].astype(np.int32) << 8 | b[1:]
    out[WIDTHS[0] + pairs] = 1
    if len(b) > 2:
        triples = (pairs[:-1].astype(np.uint32) << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(16)
        out[WIDTHS[0] + WIDTHS[1] + triples.astype(np.int32)] = 1


def scaled(rows: np.ndarray) -> np.ndarray:
    """Presence rows as floats whose product is the kernel: each n's part divided by the root of its count."""
    x, at = rows.astype(np.float32), 0
    for w in WIDTHS:
        part = x[:, at : at + w]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(WIDTHS))
        at += w
    return x


def kernels(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Kernels of packed presence rows with packed landmarks; only BATCH of each are ever held as floats."""
    out = np.empty((len(bits), len(marks)))
    for j in range(0, len(marks), BATCH):
        some = unpacked(marks[j : j + BATCH]).T
        for i in range(0, len(bits), BATCH):
            out[i : i + BATCH, j : j + BATCH] = unpacked(bits[i : i + BATCH]) @ some
    return out


def unpacked(some: np.ndarray) -> np.ndarray:
    return scaled(np.unpackbits(some, axis=1, count=TOTAL))


def packed(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, blobs)), np.uint8).reshape(len(blobs), -1)


def _equations(shared):
    """A task's parts of the regressions' equations: by language, its weighted sum of kernels and 1 (``lang``, ``blob``); and
    the sum of their products (``lang`` null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, weights = shared.value
        square, sums = np.zeros((len(marks) + 1, len(marks) + 1)), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            k = np.hstack([kernels(packed(batch.column("bits").to_pylist()), marks), np.ones((len(langs), 1))])
            kw = k * np.array([weights[n] for n in langs])[:, None]
            square += kw.T @ k
            for n, row in zip(langs, kw):
                sums[n] = sums.get(n, 0) + row
        if sums:
            for n, x in [(None, square), *sums.items()]:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.string()), pa.array([x.tobytes()], pa.binary())], names=["lang", "blob"])

    return run


def solve(names: list[str], marks: np.ndarray, square: np.ndarray, sums: np.ndarray, mean_weight: float) -> np.ndarray:
    """A (TOTAL + 1, languages) matrix that maps scaled presence rows, and 1, to scores."""
    values, vectors = np.linalg.eigh(kernels(marks, marks))
    good = values > 1e-8 * values[-1]
    root = np.zeros((len(marks) + 1, good.sum() + 1))
    root[:-1, :-1] = vectors[:, good] / np.sqrt(values[good])
    root[-1, -1] = 1
    a = root.T @ square @ root + RIDGE * np.eye(root.shape[1]) * mean_weight
    # 1 for a language's own rows, -1 for all others
    solved = root @ np.linalg.solve(a, root.T @ (2 * sums - sums.sum(0)).T)
    matrix = np.zeros((TOTAL + 1, len(names)), np.float32)
    matrix[-1] = solved[-1]
    for j in range(0, len(marks), BATCH):
        matrix[:-1] += unpacked(marks[j : j + BATCH]).T @ solved[:-1][j : j + BATCH].astype(np.float32)
    return matrix


def _sample_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), BATCH):
            part = batch.slice(start, BATCH)
            rows = np.zeros((len(part), TOTAL), np.uint8)
            for row, t in zip(rows, part.column("text")):
                presence(t.as_py(), row)
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("r"), pa.array([x.tobytes() for x in np.packbits(rows, axis=1)], pa.binary())], names=["lang", "r", "bits"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Fit on the documents that are not held out and have a text and a language."""
    d = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    hashed = F.pmod(F.xxhash64("doc_id", F.lit("language fit")), F.lit(1 << 30))
    share = F.least(F.lit(1.0), F.lit(2.0 * FIT_ROWS + 20) / F.col("count")) * (1 << 30)
    shares = durable(d.groupBy("lang").count()).select("lang", share.alias("share"))
    picked = d.select("lang", "text", hashed.alias("h")).join(F.broadcast(shares), "lang").where(F.col("h") < F.col("share"))
    picked = picked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).where(F.col("r") <= FIT_ROWS)
    rows = durable(picked.select("lang", "text", "r").mapInArrow(_sample_bits, "lang string, r int, bits binary"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not found:
        return None
    names = sorted(found)
    first = rows.where(F.col("r") <= max(LANDMARKS // len(names), MARKS_EACH)).collect()
    marks = packed([r["bits"] for r in sorted(first, key=lambda r: (r["lang"], r["r"]))])
    # each language weighs the same, however many of its rows are in the sample
    shared = docs.sparkSession.sparkContext.broadcast((marks, {n: 1 / c for n, c in found.items()}))
    square, sums, at = np.zeros((len(marks) + 1, len(marks) + 1)), np.zeros((len(names), len(marks) + 1)), {n: i for i, n in enumerate(names)}
    for r in rows.mapInArrow(_equations(shared), "lang string, blob binary").toLocalIterator():
        part = np.frombuffer(r["blob"])
        if r["lang"] is None:
            square += part.reshape(square.shape)
        else:
            sums[at[r["lang"]]] += part
    return names, solve(names, marks, square, sums, len(names) / sum(found.values()))


def _predict(model, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None:
            names, matrix = model.value
        for batch in batches:
            langs, scores = [], []
            for start in range(0, len(batch), BATCH):
                texts = [t.as_py() or "" for t in batch.column("text").slice(start, BATCH)]
                known = [any(map(str.isalpha, t)) for t in texts]
                if model is None:
                    langs += ["und"] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                rows = np.zeros((len(texts), TOTAL), np.uint8)
                for row, t in zip(rows, texts):
                    presence(t, row)
                f = scaled(rows) @ matrix[:-1] + matrix[-1]
                p = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)).astype(np.float64))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs += [names[b] if k else "und" for b, k in zip(best, known)]
                scores += [float(x[b]) if k else 0.0 for x, b, k in zip(p, best, known)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in schema_names] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*schema_names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    spark = session(docs)
    model = train(docs)
    d = docs.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    # the matrix has TOTAL + 1 floats a language: half a megabyte
    shared = spark.sparkContext.broadcast(model) if model else None
    return d.mapInArrow(_predict(shared, ["doc_id", "held_out"]), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}
