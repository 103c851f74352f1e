r"""Whitening of vectors by TSQR: no covariance matrix is formed.

Entries are whole numbers x = floor(1024 c) + 100000, so sums are exact. Rows are centred by them, x - S/n, each partition is
reduced to the R factor of its rows, block by block, and R factors are merged in a tree of ``FAN`` at a time until one is left:
its singular values s and right vectors are those of all centred rows. The eigenvalues of the covariance (divisor n) are
s^2 / n, a row's whitened components are its projections on the right vectors over s / sqrt(n).

What meets in one place is bounded by the vectors' length d, whatever the number of rows: a task holds ``FAN`` R factors of
d x d, the driver one. Rows are read three times and never gathered.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are left out; vectors of different
lengths are whitened apart, each length with all of its own; rows are judged one by one, so repeated rows, and rows that share
a vec_id or have none, count each; there are no components of eigenvalue 0 (to double precision), hence none for a single row or
equal ones, and such rows give none; entries beyond 2^49 count as that; equal eigenvalues may take any order;
a table without rows gives an empty result; labels and extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, session, written

COMPONENTS = 8
#: R factors that are merged at once; doubles of a block of rows.
FAN, BLOCK = 16, 1 << 20
UNITS, SHIFT, MOST = 1024, 100_000, 2.0**59


def usable(e: DataFrame) -> DataFrame:
    """vec_id, length, embedding of the rows that are whitened."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return e.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select("vec_id", F.size("embedding").alias("length"), "embedding")


def whole(column: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """x of the given rows, which have the given length."""
    column = column.take(pa.array(rows))
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)
    return np.clip(np.floor(c * UNITS), -MOST, MOST).astype(np.int64) + SHIFT


def blocks(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, x) of a batch's rows, in blocks of one length."""
    lengths = b.column("length").to_numpy(zero_copy_only=False)
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        for part in np.array_split(places, max(1, -(-len(places) * n // BLOCK))):
            if len(part):
                yield n, part, whole(b.column("embedding"), part, n)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, dim, n, s) of a task's rows; sums of the high and the low bits cannot overflow."""
    total: dict[int, list] = {}
    for b in batches:
        for n, part, x in blocks(b):
            t = total.setdefault(n, [0, np.zeros(n, object)])
            t[0] += len(part)
            t[1] += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    for n, (rows, s) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([rows] * n, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))], names=["length", "dim", "n", "s"])


class Centre:
    """The exact mean S/n of one length as a whole part and a rest: x - S/n rounds once."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 = n^2 y^2 - 2 n y r + r^2, y being x less the whole part of the mean and r the rest."""
        y = x - self.base
        rest = np.array(self.rest, object)
        most, length = int(np.abs(y).max()), len(rest)
        if most * max(most, self.n) * length < 1 << 62:
            square, cross = (y * y).sum(1), (y * rest.astype(np.int64)).sum(1)
        else:
            y = y.astype(object)
            square, cross = (y * y).sum(1), (y * rest).sum(1)
        own = int((rest * rest).sum())
        return [self.n * self.n * a - 2 * self.n * c + own for a, c in zip(square.tolist(), cross.tolist())]


def centres(good: DataFrame) -> dict[int, Centre]:
    """The centre of each length: as many sums as all lengths have dimensions together."""
    sums = good.mapInArrow(_sums, "length int, dim int, n bigint, s decimal(38,0)").groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    found: dict[int, dict] = {}
    for r in sums:
        found.setdefault(r["length"], {})[r["dim"]] = (r["n"], int(r["s"]))
    return {k: Centre(v[0][0], [v[i][1] for i in range(k)]) for k, v in found.items()}


def _factors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The R factor of a task's centred rows, for each length."""
        known: dict[int, np.ndarray] = {}
        for b in batches:
            for n, _, x in blocks(b):
                y = shared.value[n].centred(x)
                known[n] = np.linalg.qr(np.vstack([known[n], y]) if n in known else y, mode="r")
        node = TaskContext.get().partitionId()
        for n, r in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([node], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["length", "node", "r"])

    return run


def _merge(group: pa.Table) -> pa.Table:
    n, node = group.column("length")[0].as_py(), group.column("node").to_pylist()
    parts = [np.frombuffer(group.column("r")[i].as_py(), np.float64).reshape(-1, n) for i in np.argsort(node)]
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return pa.table({"length": pa.array([n], pa.int32()), "node": pa.array([min(node) // FAN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})


class Fit:
    """What whitens the vectors of one length: centre, unit right vectors over the deviations along them, shares explained."""

    def __init__(self, centre: Centre, r: np.ndarray, components: int):
        self.centre = centre
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        real = s > (s[0] if len(s) else 0) * max(centre.n, r.shape[1]) ** 0.5 * r.shape[1] * np.finfo(np.float64).eps
        k = min(components, int(real.sum()))
        vt = vt[:k]
        vt = vt * np.where(vt[np.arange(k), np.abs(vt).argmax(1)] < 0, -1.0, 1.0)[:, None]  # one sign in every run
        self.scale = (vt / (s[:k, None] / math.sqrt(centre.n))).T
        self.explained = (s[:k] ** 2 / (s**2).sum()).tolist() if k else []


def fit(good: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each length that occurs."""
    known = centres(good)
    shared = good.sparkSession.sparkContext.broadcast(known)  # two numbers a dimension
    kind = "length int, node bigint, r binary"
    tree = durable(good.mapInArrow(_factors(shared), kind))
    last = tree.agg(F.max("node")).first()[0] or 0
    while last:
        tree, last = tree.groupBy("length", F.floor(F.col("node") / FAN)).applyInArrow(_merge, kind), last // FAN
    return {r["length"]: Fit(known[r["length"]], np.frombuffer(r["r"], np.float64).reshape(-1, r["length"]), components) for r in tree.collect()}


def _project(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part, x in blocks(b):
                f = shared.value[n]
                w = f.centre.centred(x) @ f.scale
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                deviation = [d if d < 10**38 else None for d in f.centre.deviation(x)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(part)), pa.array([n] * len(part), pa.int32()), pa.array([None if d is None else Decimal(d) for d in deviation], pa.decimal128(38, 0)), lists], names=["vec_id", "length", "deviation", "w"])

    return run


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Of each length, the largest absolute entry of the whitened rows' covariance less the identity, centred before multiplying."""
    out = {}
    for n, f in fits.items():
        k = len(f.explained)
        if k:
            own = rows.where(F.col("length") == n).select(*[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(k)])
            mean = own.agg(*[F.avg(c).alias(c) for c in own.columns]).first()
            pairs = list(combinations_with_replacement(range(k), 2))
            moments = own.agg(*[F.sum((F.col(f"w{i}") - mean[i]) * (F.col(f"w{j}") - mean[j])) for i, j in pairs]).first()
            out[n] = max(abs(m / f.centre.n - (i == j)) for m, (i, j) in zip(moments, pairs))
    return out


def whiten(e: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation decimal(38,0) (null past that), whitened, explained, identity_error for every usable row
    of ``e`` (vec_id, embedding) and each of its length's first components."""
    spark = session(e)
    good = usable(e)
    fits = fit(good, components)
    kind = e.schema["vec_id"].dataType.simpleString()
    rows, _ = written(good.mapInArrow(_project(spark.sparkContext.broadcast(fits)), f"vec_id {kind}, length int, deviation decimal(38,0), w array<double>"), "whitened")
    errors = identity_errors(rows, fits)

    def of(n: int) -> DataFrame:
        shares = F.array(*[F.lit(x) for x in fits[n].explained])
        flat = rows.where(F.col("length") == n).select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
        return flat.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fits[n].centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"), F.lit(errors[n]).alias("identity_error"))

    some = [of(n) for n in sorted(errors)]
    return reduce(DataFrame.union, some) if some else spark.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The deviation as a long; null where that cannot hold it, which takes millions of rows."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op13_whitening": op13_whitening}
#: No SQL: singular value decomposition.
ORACLE_SQL: dict[str, str] = {}
