r"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves; each half has its own codebook of k centroids, and the pair of nearest centroids names a
cell of a k x k grid. Each vector is in one cell. A search visits cells by growing sum of the two half distances
(multi-sequence order) until the target recall is reached, then verifies every vector met there by its cosine in double
precision. A search ends where a cell's sum exceeds that of its nearest cell by more than a margin, so searches in dense
places visit many cells and others few; the margin that reaches the target is measured at fit time with pairs made at exactly
the threshold in random directions, the hardest there are. A pair counts if either of its vectors visits the other's cell.

The codebooks are fitted on a bounded sample (``FIT_ROWS`` vectors for each centroid, by the hash of the vector); every row is
indexed and searched. Cells with many vectors or visitors are cut into blocks that are verified one by one: a group of copies
that holds a third of all rows becomes many small tasks, which return counts and a spanning forest, never pairs. Equal vectors
are verified once and counted as often as they appear. Vectors of different lengths are indexed apart, each length with all of
its own.

Defined results: a null or zero vector, or one with a null or non-finite component links with nothing; ties need no rule; rows
sharing a vec_id are one vector each, and every row has its own vector's links; a null vec_id is compared like any other and is
no one's component; an empty table gives an empty result; labels and extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, durable, session
from .components import components, local_roots

THRESHOLD = 0.95
FIT_ROWS, LEAST_FIT_ROWS, PROBES, TARGET_RECALL = 16, 4096, 2000, 0.985
#: Rows that a cell should hold on average, and the most centroids of a half: cells grow beyond a thousand million rows.
CELL_ROWS, MAX_CENTROIDS = 64, 4096
#: Vectors and visitors that are verified at once.
BLOCK, VISITORS = 1024, 4096
#: Distances that a fit holds at once.
DISTANCES = 1 << 22


def usable(e: DataFrame) -> DataFrame:
    """vec_id, length, v: the rows whose embedding can link, v being its components as bytes: of floats if they are such, else of
    doubles."""
    kind = e.schema["embedding"].dataType.elementType.simpleString()
    width = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("length"), pa.array([x.values.to_numpy(zero_copy_only=False).astype(width).tobytes() for x in column], pa.binary())], names=["vec_id", "length", "v"])

    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    good = e.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select("vec_id", F.size("embedding").alias("length"), "embedding")
    return good.mapInArrow(run, f"vec_id {e.schema['vec_id'].dataType.simpleString()}, length int, v binary")


def matrix(column, length: int) -> np.ndarray:
    """Vectors of the given length as unit vectors of doubles."""
    rows = column.to_pylist()
    raw = b"".join(rows)
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * length * len(rows) else np.float64).reshape(len(rows), length).astype(np.float64)
    x /= np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(np.float64).tiny)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, random) -> np.ndarray:
    """k centroids. Distances are taken for blocks of rows: no matrix of all rows and all centroids is made."""
    c = x[random.choice(len(x), k, replace=False)]
    step = max(1, DISTANCES // k)
    for _ in range(12):
        squares = (c * c).sum(1)
        near = np.concatenate([(x[i : i + step] @ c.T * -2 + squares).argmin(1) for i in range(0, len(x), step)])
        order = np.argsort(near, kind="stable")
        begin = np.flatnonzero(np.diff(near[order], prepend=-1))
        c[near[order[begin]]] = np.add.reduceat(x[order], begin) / np.diff(np.append(begin, len(x)))[:, None]
    return c


class Grid:
    """The product grid: two codebooks, and how far past its nearest cell a search goes."""

    def __init__(self, sample: np.ndarray, k: int):
        random = np.random.default_rng(11)
        self.length = sample.shape[1]
        self.half = max(1, self.length // 2)
        self.books = [kmeans(p, k, random) for p in self.parts(sample)]
        self.k = k
        x = sample[random.choice(len(sample), min(len(sample), PROBES), replace=False)]
        noise = random.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        y = THRESHOLD * x + math.sqrt(1 - THRESHOLD**2) * noise / np.maximum(norm, 1e-12)
        # a pair is found from either side
        excess = np.minimum(self.excess(x, self.cells(y)), self.excess(y, self.cells(x)))
        self.margin = float(np.quantile(excess, TARGET_RECALL, method="higher")) + 1e-9

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :] if self.length > self.half else np.zeros((len(x), 1))]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [p @ c.T * -2 + (c * c).sum(1) + (p * p).sum(1, keepdims=True) for p, c in zip(self.parts(x), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return (a.argmin(1) * self.k + b.argmin(1)).astype(np.int64)

    def excess(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How much farther each vector's given cell is than its nearest one."""
        a, b = self.distances(x)
        rows = np.arange(len(x))
        return a[rows, cells // self.k] + b[rows, cells % self.k] - a.min(1) - b.min(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cells, counts): the cells that each vector visits, one vector after the other. For the first half's centroids by
        growing distance, the second half's as far as the sum stays within the margin."""
        a, b = self.distances(x)
        ia, ib = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        sa, sb = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        left = self.margin - (sa - sa[:, :1])  # what the second half may be farther than its nearest
        rows, cells = [], []
        for i in range(self.k):
            some = np.flatnonzero(left[:, i] >= 0)
            if not len(some):
                break
            r, j = np.nonzero(sb[some] - sb[some, :1] <= left[some, i : i + 1])
            rows.append(some[r])
            cells.append(ia[some[r], i] * self.k + ib[some[r], j])
        rows, cells = np.concatenate(rows), np.concatenate(cells)
        order = np.argsort(rows, kind="stable")
        return cells[order].astype(np.int64), np.bincount(rows, minlength=len(x))


def centroids(rows: int) -> int:
    return int(min(MAX_CENTROIDS, max(1, math.isqrt(rows // CELL_ROWS))))


def _place(shared):
    """Each vector with its cell and the cells that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for b in batches:
            if len(b):
                x = matrix(b.column("v"), grid.length)
                cells, counts = grid.visits(x)
                visits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(cells))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(grid.cells(x)), visits], names=[*b.schema.names, "cell", "visits"])

    return run


def _verify(threshold: float, length: int):
    """One block of a cell's vectors against one block of its visitors: counts for each vector, and a forest of the links."""

    def run(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").to_pylist(), bool)
        x, ids = matrix(group.column("v"), length), np.array(group.column("id").to_pylist(), np.int64)
        n = np.array(group.column("n").to_pylist(), np.int64)
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = np.zeros(len(ids), np.int64)
        links: list[tuple[int, int]] = []
        if len(q) and len(m):
            cell = np.array(group.column("cell").to_pylist(), np.int64)
            visits = group.column("visits").take(pa.array(m)).to_pylist()
            homes, home_of = np.unique(cell[q], return_inverse=True)
            known = {c: i for i, c in enumerate(homes.tolist())}
            # whether the member visits the visitor's cell, and so finds the pair itself
            mutual = np.zeros((len(homes), len(m)), bool)
            for j, v in enumerate(visits):
                for c in v:
                    if c in known:
                        mutual[known[c], j] = True
            place = {i: k for k, i in enumerate(ids[m].tolist())}
            for s in range(0, len(q), 512):
                part = q[s : s + 512]
                hit = x[part] @ x[m].T >= threshold
                for r, i in enumerate(ids[part].tolist()):  # not with itself
                    if i in place:
                        hit[r, place[i]] = False
                found[part] += hit @ n[m]
                found[m] += (hit & ~mutual[home_of[s : s + 512]]).T @ n[part]
                # each visitor to its first link, each member to its first visitor, and those that join rows
                rows, cols = np.nonzero(hit)
                links += zip((part[rows]).tolist(), (m[cols]).tolist()) if len(rows) <= 4 * len(ids) else _forest(hit, part, m)
        root = local_roots(len(ids), links)
        return pa.table({"id": pa.array(ids), "found": pa.array(found), "root": pa.array(ids[root])})

    return run


def _forest(hit: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that join what the links join: labels spread over rows and columns until they stay."""
    big = len(rows) + len(cols)
    row, col = np.arange(len(rows)), np.full(len(cols), big)
    while True:
        new_col = np.minimum(col, np.where(hit, row[:, None], big).min(0))
        new_row = np.minimum(row, np.where(hit, new_col[None, :], big).min(1))
        if (new_col == col).all() and (new_row == row).all():
            break
        row, col = new_row, new_col
    return [(int(rows[i]), int(rows[r])) for i, r in enumerate(row)] + [(int(cols[j]), int(rows[c])) for j, c in enumerate(col) if c < big]


def _classes(good: DataFrame, length: int, threshold: float, kind: str) -> DataFrame:
    """(v, n_links, component_id) of the distinct vectors of one length."""
    spark = good.sparkSession
    # equal vectors are one class
    classes = durable(good.where(F.col("length") == length).groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id()))
    rows = classes.count()
    k = centroids(rows)
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(max(LEAST_FIT_ROWS, FIT_ROWS * k)).toArrow().column("v")
    sample = matrix(sample, length)
    grid = spark.sparkContext.broadcast(Grid(sample, min(k, max(1, len(sample) // 4))))  # two codebooks of MAX_CENTROIDS at most
    placed = durable(classes.mapInArrow(_place(grid), f"v binary, n bigint, least {kind}, id bigint, cell bigint, visits array<bigint>"))
    asked = placed.select(F.explode("visits").alias("at"), "id")
    # blocks by cell: a row for each cell that is used, MAX_CENTROIDS squared at most
    blocks = placed.groupBy(F.col("cell").alias("at")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("mb")).join(asked.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("qb")), "at", "left")
    blocks = blocks.select("at", "mb", F.coalesce("qb", F.lit(0)).alias("qb"))
    slot = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    members = placed.withColumn("at", F.col("cell")).join(blocks, "at").select("at", slot(F.col("mb")).alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(False).alias("asks"), "id", "n", "v", "cell", "visits").where(F.col("q") >= 0)
    visitors = placed.select("id", "n", "v", "cell", F.explode("visits").alias("at")).join(blocks, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), slot(F.col("qb")).alias("q"), F.lit(True).alias("asks"), "id", "n", "v", "cell", F.lit(None).cast("array<bigint>").alias("visits"))
    found = durable(members.union(visitors).groupBy("at", "m", "q").applyInArrow(_verify(threshold, length), "id bigint, found bigint, root bigint"))
    counts = found.groupBy("id").agg(F.sum("found").alias("found"))
    linked = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # the least vec_id of a component, over all rows of its classes
    labels = classes.select("id", "least", "n", "v").join(counts, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labels.groupBy("component").agg(F.min("least").alias("component_id")).select(apart(F.col("component")).alias("of"), "component_id")
    return labels.join(least, apart(F.col("component")) == F.col("of")).select("v", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")


def near_duplicates(e: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    session(e)
    kind = e.schema["vec_id"].dataType.simpleString()
    all_rows = e.select("vec_id", "embedding")
    good = usable(all_rows)
    # a model makes vectors of one length; a table of several models' has some
    lengths = sorted(r["length"] for r in good.select("length").distinct().collect())
    named = [_classes(good, n, threshold, kind) for n in lengths]
    found = good.select("vec_id", "v").join(reduce(DataFrame.union, named), "v").select("vec_id", "n_links", "component_id") if named else None
    # rows that cannot link are those that usable() leaves out: as many of a vec_id as are missing
    used = good.groupBy(F.col("vec_id").alias("u")).agg(F.count(F.lit(1)).alias("used"))
    left = all_rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("all")).join(used, F.col("vec_id").eqNullSafe(F.col("u")), "left")
    rest = left.where(F.col("all") > F.coalesce("used", F.lit(0))).select("vec_id", F.explode(F.array_repeat(F.lit(0).cast("long"), (F.col("all") - F.coalesce("used", F.lit(0))).cast("int"))).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.union(rest) if found is not None else rest
    return out.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
#: All pairs, for tables small enough; the query's recall is below 1 on large ones.
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON id = vec_id LEFT JOIN n ON n.a = vec_id
"""
ORACLE_SQL = {"op10_embedding_dedup": ORACLE}
