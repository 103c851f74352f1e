r"""Toxicity: subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its character n-grams, hashed to rows of an embedding table; a window of words is the mean of its words'
vectors; a softmax over it is toxic or not. Table and softmax are trained jointly in numpy. Unseen misspellings and endings
share n-grams with words that were seen. A document's score is that of its worst window: some insults in a long text are not
averaged away. For training, each document's worst window under the current model stands for it, again and again. With one
average over the whole text instead, the same embeddings call far more clean documents toxic (figures in the README).

The fit reads at most ``FIT_ROWS`` labelled documents (clean, toxic), chosen by the hash of their id among those that are there,
and all of their texts; its first steps, on whole documents, take the first ``FIRST_ROWS`` of each label. Scores read whole texts.

Defined results: a null or empty text has the score of an empty window; without both labels among the rows to learn from the
score is 0; labels other than 0 and 1 are not learned from; of rows that share an id the fit takes the first text; a document
that has both labels is learned from with each; repeated rows score alike; extra columns, whatever their names,
are not looked at by ``score`` and kept by ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, packed, remainder, session, unpacked
from .flat import NUMBER, ODD, buffer, mixed, names, runs, slices

FOLDS, HELD_OUT = 5, 0
FIT_ROWS = (2000, 1000)
WINDOW = 6
BUCKETS, DIM, GRAMS = 1 << 18, 4, (4, 5, 6)
ROUNDS, STEPS, DECAY, SCALE = 14, 10, 1e-6, 4.0
FIRST_ROWS, FIRST_STEPS = 400, 8
#: Words whose n-grams the fit makes at once.
GRAMS_AT_ONCE = 20_000
RATES = (0.3, 0.05, 0.05)
#: Bytes of words: letters, digits, _ and all that is not ASCII. Texts are taken in lower case.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begin, end, first): the words of a column of texts, and each row's first one."""
    buf, at = buffer(pc.utf8_lower(column))
    return buf, *runs(IN_WORD[buf], at)


def grams(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sizes): of each word <word>, the buckets of its n-grams of bytes and of the word itself, one after the other."""
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = end - begin
    wide = size + 2
    first = np.cumsum(wide) - wide
    n = int(wide.sum())
    text = np.full(n, ord("<"), np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[within + np.repeat(first + 1, size)] = buf[within + np.repeat(begin, size)]
    text[first + wide - 1] = ord(">")
    owner, stop, place = np.repeat(np.arange(len(begin)), wide), np.repeat(first + wide, wide), np.arange(n)
    number, rolled, power = NUMBER[text], np.zeros(n, np.uint64), 1
    found, owners = [names(buf, begin, end)], [np.arange(len(begin))]
    for j in range(max(GRAMS)):
        rolled[: n - j] += number[j:] * np.uint64(power)
        power = power * ODD[0] % (1 << 64)
        if j + 1 in GRAMS:
            whole = place + j + 1 <= stop
            found.append(mixed(rolled[whole] + np.uint64((j + 1) * ODD[1] % (1 << 64))))
            owners.append(owner[whole])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)[order], np.bincount(owners, minlength=len(begin))


def windows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, places, begins): the mean of each window of WINDOW words and its first word, and each row's first window. A shorter
    text is one window, an empty one has none."""
    count = np.diff(first)
    each = np.where(count > 0, np.maximum(count - WINDOW + 1, 1), 0)
    begins = np.cumsum(each) - each
    place = np.arange(int(each.sum())) - np.repeat(begins - first[:-1], each)
    stop = np.minimum(place + WINDOW, np.repeat(first[1:], each))
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return (total[stop] - total[place]) / (stop - place), place, begins


def _groups(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each of n keys begins in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.searchsorted(keys[order], np.arange(n))


class _Model:
    """The embedding table and the softmax, with their momentum; steps touch only the rows that the examples use."""

    def __init__(self):
        random = np.random.default_rng(7)
        self.x = [random.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32), random.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.m = [np.zeros_like(x) for x in self.x]

    def update(self, k: int, rows, g: np.ndarray) -> None:
        """Momentum, scaled by the largest gradient of all rows: what most examples agree on moves far ahead of chance."""
        m = self.m[k][rows] = 0.8 * self.m[k][rows] + 0.2 * g
        self.x[k][rows] -= RATES[k] * m / max(float(np.abs(m).max()), 1e-12)

    def train(self, examples: list[np.ndarray], y: np.ndarray, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, steps: int) -> None:
        """Full-batch steps on windows of word numbers; a word's buckets are flat[begins:begins + sizes]."""
        lens = np.array([len(e) for e in examples])
        used, local = np.unique(np.concatenate(examples), return_inverse=True)
        gsize = sizes[used]
        gb = np.concatenate([[0], np.cumsum(gsize)[:-1]])
        where = np.repeat(begins[used] - gb, gsize) + np.arange(gsize.sum())
        rows, gram = np.unique(flat[where], return_inverse=True)
        word_of_gram = np.repeat(np.arange(len(used)), gsize)
        by_row, row_at = _groups(gram, len(rows))
        by_word, word_at = _groups(local, len(used))
        example_of = np.repeat(np.arange(len(examples)), lens)[by_word]
        grams_by_row = word_of_gram[by_row]
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        inverse = (1 / gsize).astype(np.float32)[:, None]
        share = (np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())).astype(np.float32)[:, None]
        for _ in range(steps):
            table, soft, bias = self.x
            words = np.add.reduceat(table[rows][gram], gb) * inverse
            mean = np.add.reduceat(words[local], at) / lens[:, None].astype(np.float32)
            logits = (mean @ soft) * SCALE + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= share
            each = (p @ soft.T) * SCALE / lens[:, None].astype(np.float32)
            per_word = np.add.reduceat(each[example_of], word_at) * inverse
            grad = np.add.reduceat(per_word[grams_by_row], row_at) + DECAY * table[rows]
            self.update(0, rows, grad)
            self.update(1, slice(None), mean.T @ p * SCALE)
            self.update(2, slice(None), p.sum(0))

    def values(self) -> tuple[np.ndarray, float]:
        """What scoring needs of table and softmax: each bucket's part of the logit's difference, and the bias."""
        table, soft, bias = self.x
        return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float64) * SCALE, float(bias[1] - bias[0])


def fit(column: pa.Array, labels: list[int]) -> tuple[np.ndarray, float]:
    """Value of each bucket and the bias, from texts and labels. First whole documents are the examples; then each toxic
    document's worst window is one, and every window of a clean one that has been its worst."""
    buf, begin, end, first = words(column)
    some = np.flatnonzero(np.diff(first) > 0)
    y = np.asarray(labels)[some]
    if set(y.tolist()) != {0, 1}:
        return np.zeros(BUCKETS), 0.0
    _, one, number = np.unique(names(buf, begin, end), return_index=True, return_inverse=True)
    parts = [grams(buf, begin[i], end[i]) for i in np.split(one, range(GRAMS_AT_ONCE, len(one), GRAMS_AT_ONCE))]
    flat, sizes = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([n for _, n in parts])
    del parts
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    model = _Model()
    few = np.array([i for c in (0, 1) for i in np.flatnonzero(y == c)[:FIRST_ROWS]])
    model.train([number[first[i] : first[i + 1]] for i in some[few]], y[few], flat, begins, sizes, FIRST_STEPS)
    negatives: dict[tuple[int, int], np.ndarray] = {}
    for _ in range(ROUNDS):
        value, _ = model.values()
        mean, place, at = windows((np.add.reduceat(value.astype(np.float32)[flat], begins) / sizes)[number], first)
        top = [int(place[a + mean[a:b].argmax()]) for a, b in zip(at[some].tolist(), [*at[some[1:]].tolist(), len(mean)])]
        window = [number[t : min(t + WINDOW, first[i + 1])] for t, i in zip(top, some)]
        negatives |= {(i, top[i]): window[i] for i in np.flatnonzero(y == 0)}
        positives = [window[i] for i in np.flatnonzero(y == 1)]
        model.train(positives + list(negatives.values()), np.array([1] * len(positives) + [0] * len(negatives)), flat, begins, sizes, STEPS)
    return model.values()


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Fit on labelled documents that are not held out; null without both labels."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT)).distinct()
    # ids first, so that no text is exchanged; rows of one id are numbered by the order of their texts
    there = known.join(docs.select("doc_id").distinct(), "doc_id").select(F.xxhash64("doc_id", F.lit("toxicity fit")).alias("h"), "doc_id", "toxic")
    chosen = [there.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(FIT_ROWS[c]) for c in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # the sum of FIT_ROWS
    named = docs.select("doc_id", "text").join(ids, "doc_id")
    rows = named.groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("toxic", "ascending")])
    found = rows.column("toxic").to_pylist()
    if set(found) != {0, 1}:
        return None
    model = fit(rows.column("text").combine_chunks(), found)
    del rows
    pa.default_memory_pool().release_unused()
    return model


def scores(column: pa.Array, value: np.ndarray, bias: float) -> np.ndarray:
    """The score of each text of a column."""
    out = []
    for a, b in slices(column):
        buf, begin, end, first = words(column.slice(a, b - a))
        z = np.zeros(b - a)
        if len(begin):
            _, one, number = np.unique(names(buf, begin, end), return_index=True, return_inverse=True)
            flat, sizes = grams(buf, begin[one], end[one])
            word = np.add.reduceat(value[flat], np.cumsum(sizes) - sizes) / sizes
            mean, _, at = windows(word[number], first)
            some = np.diff(first) > 0
            z[some] = np.maximum.reduceat(mean, at[some])
        out.append(1 / (1 + np.exp(-np.clip(z + bias, -500, 500))))
    return np.concatenate(out) if out else np.zeros(0)


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column("text"), *model.value) if model is not None else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found)], names=[*names, "score"])

    return run


def _scored(docs: DataFrame, plain: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``plain``, which has the documents' text, with a last column ``score``."""
    from pyspark.sql.types import DoubleType, StructType

    spark = session(docs)
    model = train(docs, labels)
    shared = spark.sparkContext.broadcast(model) if model else None  # BUCKETS doubles
    return plain.mapInArrow(_score(shared, plain.columns), StructType([*plain.schema.fields]).add("score", DoubleType()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    s = _scored(docs, docs.select("doc_id", "text"), labels)
    return s.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they came."""
    return unpacked(_scored(docs, packed(docs, "text"), labels).where(F.col("score") < 0.5).select("row"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
