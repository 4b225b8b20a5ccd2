"""Embedding whitening by polarisation: every covariance is a difference of variances.

An entry c becomes the integer x = floor(64 c) + 1000000. One scan gives the number of vectors n and the sums S per
dimension; a second one takes x less the whole part of S/n, and sums the squares for every dimension and for the sum of
every two dimensions. With t the centred value and r the sum of t, n * sum(t^2) - r^2 is n^2 times a variance; of a pair's
sum, less those of its two dimensions, it is twice n^2 times their covariance. All of this is whole numbers of any size, so
neither the offset nor the number of vectors costs a digit. The matrix (at most ``MOST_DIMENSIONS`` wide) goes to ``eigh`` on
the driver, a third scan measures the covariance of what the whitening returns, and the last one returns it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.words import ready, table
from tarnlake.names import quoted

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
MOST_DIMENSIONS = 2048
#: an eigenvalue of at most this share of the largest one, times the dimensions, is zero but for rounding
ZERO = 1e-15
#: entries beyond count as this
LARGEST = 2.0**53

WHOLE = pa.decimal128(38, 0)
SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def whole_numbers(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    """x of each entry, one row per vector."""
    entries = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    return np.floor(np.clip(entries * SCALE, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def _safe(values: np.ndarray, most: int, times: int) -> np.ndarray:
    """The same values, as Python's own integers if ``times`` numbers up to ``most`` may not fit 64 bits in a sum."""
    return values if most * times < 1 << 62 else values.astype(object)


def _sums_batch(places: list[tuple[int, int]], totals: list[int]) -> pa.RecordBatch:
    # two parts, as a sum of many large squares can have more than 38 digits
    high, low = ([Decimal(f(t)) for t in totals] for f in (lambda t: t >> 64, lambda t: t & (1 << 64) - 1))
    arrays = [pa.array([p[k] for p in places], pa.int32()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(high, WHOLE), pa.array(low, WHOLE)], names=["i", "j", "high", "low"])


def _collected(rows: DataFrame) -> dict[tuple[int, int], int]:
    found = rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): (int(r["high"]) << 64) + int(r["low"]) for r in found}


def _first_sums(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dimensions
        for batch in batches:
            x = whole_numbers(batch, dimensions)
            if len(x):
                n += len(x)
                added = _safe(x, int(np.abs(x).max()), len(x)).sum(axis=0)
                sums = [a + int(b) for a, b in zip(sums, added, strict=True)]
        if n:
            yield _sums_batch([(-1, -1), *((i, -1) for i in range(dimensions))], [n, *sums])

    return run


def _squares(centre: np.ndarray):
    dimensions = len(centre)
    places = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(places), object)
        n = 0
        for batch in batches:
            t = whole_numbers(batch, dimensions) - centre
            if not len(t):
                continue
            n += len(t)
            t = _safe(t, (2 * int(np.abs(t).max())) ** 2, len(t))
            found = []
            for i in range(dimensions):
                pairs = t[:, i + 1 :] + t[:, i : i + 1]
                found += [(t[:, i] * t[:, i]).sum(keepdims=True), (pairs * pairs).sum(axis=0)]
            totals += np.concatenate(found).astype(object)
        if n:
            yield _sums_batch(places, [int(t) for t in totals])

    return run


class Whitening:
    """What the vectors of one table need: centre, components and their scales."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int):
        self.n, self.sums = n, sums
        dimensions = len(sums)
        self.centre = np.array([s // n for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]
        # n^2 times the variances of dimensions and of sums of two of them
        of_one = [n * squares[i, i] - r * r for i, r in enumerate(self.rest)]
        covariance = np.zeros((dimensions, dimensions), np.longdouble)
        for i in range(dimensions):
            covariance[i, i] = np.longdouble(of_one[i]) / n / n
            for j in range(i + 1, dimensions):
                of_both = n * squares[i, j] - (self.rest[i] + self.rest[j]) ** 2
                covariance[i, j] = covariance[j, i] = np.longdouble((of_both - of_one[i] - of_one[j]) // 2) / n / n
        self.trace = float(np.longdouble(sum(of_one)) / n / n)
        _, vectors = np.linalg.eigh(covariance.astype(float))
        # Rayleigh quotients: the error is the square of the vector's
        values = np.einsum("ik,ij,jk->k", vectors, covariance, vectors, optimize=True).astype(float)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, vectors = values[order], vectors[:, order]
        # the largest entry of a component is positive
        at = np.abs(vectors).argmax(axis=0)
        self.vectors = vectors * np.where(vectors[at, np.arange(len(at))] < 0, -1.0, 1.0)
        self.usable = self.values > max(0.0, self.values.max(initial=0.0) * dimensions * ZERO)
        self.shift = np.array([r / n for r in self.rest])
        self.scaled = self.vectors[:, self.usable] / np.sqrt(self.values[self.usable])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x - self.centre

    def projected(self, t: np.ndarray) -> np.ndarray:
        """The usable components of centred vectors, scaled to variance one. Not by BLAS, whose sums depend on a
        vector's place in the batch: equal vectors have equal results."""
        return np.einsum("ij,jk->ik", t.astype(float) - self.shift, self.scaled)

    def deviations(self, t: np.ndarray) -> np.ndarray:
        most = int(np.abs(t).max(initial=0)) + 1
        t = _safe(t, (self.n * most) ** 2, t.shape[1])
        rest = np.array(self.rest, object if t.dtype == object else np.int64)
        from_mean = t * self.n - rest
        return (from_mean * from_mean).sum(axis=1)


def _products(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        wide = int(model.usable.sum())
        total, n = np.zeros((wide + 1, wide)), 0
        for batch in batches:
            y = model.projected(model.centred(whole_numbers(batch, len(model.sums))))
            total += np.vstack([y.sum(axis=0), y.T @ y])
            n += len(y)
        if n:
            i, j = np.indices(total.shape)
            arrays = [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "total"])

    return run


def _whiten(shared):
    schema = pa.schema([("deviation", WHOLE), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Whitening = shared.value
        for batch in batches:
            t = model.centred(whole_numbers(batch, len(model.sums)))
            deviations = model.deviations(t)
            if deviations.dtype == object:
                deviations = pa.array([Decimal(v) if v < 10**38 else None for v in deviations.tolist()], WHOLE)
            else:
                deviations = pa.array(deviations).cast(WHOLE)
            y = np.zeros((len(t), len(model.usable)))
            y[:, model.usable] = model.projected(t)
            missing = np.broadcast_to(~model.usable, y.shape)
            ends = pa.array(np.arange(len(t) + 1, dtype=np.int32) * len(model.usable))
            whitened = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), mask=missing.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), deviations, whitened], names=["_id", *schema.names]
            )

    return run


def whitened(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: key, component (from 1, largest eigenvalue first), n, deviation (decimal),
    whitened, explained, identity_error.

    Vectors that are null or hold nulls, infinities or NaN go. Of vectors of several lengths, those of the commonest
    one (of equally common ones the longest) are the table's vectors and the others go. Repeated vectors and keys and
    null keys count like any others. A component without variance (all vectors alike, fewer vectors than dimensions) cannot be
    whitened: its ``whitened`` is null, and ``identity_error`` leaves it out (null if none has variance). ``explained`` is 0 if
    nothing varies. A deviation of more than 38 digits is null. Entries beyond 2^47 count as that. No vector: no rows.
    """
    spark = vectors.sparkSession
    ready(spark, batch_rows=4096)
    sound = F.forall(F.col("_v"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(quoted(key)).alias("_id"), F.col(quoted(column)).cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & sound).withColumnRenamed("_v", "vector")
    lengths = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimensions = lengths["d"] if lengths else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} entries; at most {MOST_DIMENSIONS}")
    types = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not dimensions:
        none = rows.select("_id").limit(0).withColumnRenamed("_id", key)
        return none.select(F.col(quoted(key)), *[F.lit(None).cast(t).alias(c) for c, t in map(str.split, types.split(", "))])
    rows = rows.filter(F.size("vector") == dimensions)
    only = rows.select("vector")
    first = _collected(only.mapInArrow(_first_sums(dimensions), SUMS))
    n, sums = first[-1, -1], [first[i, -1] for i in range(dimensions)]
    centre = np.array([s // n for s in sums], np.int64)
    squares = _collected(only.mapInArrow(_squares(centre), SUMS))
    model = Whitening(n, sums, squares, components)
    shared = spark.sparkContext.broadcast(model)

    error = None
    wide = int(model.usable.sum())
    if wide:
        measured = only.mapInArrow(_products(shared), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
        total = np.zeros((wide + 1, wide))
        for r in measured.collect():
            total[r["i"], r["j"]] = r["total"]
        mean = total[0] / n
        error = float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(wide)).max())
    explained = [float(v / model.trace) if model.trace else 0.0 for v in model.values]
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(_whiten(shared), f"_id {kind}, deviation decimal(38,0), whitened array<double>")
    found = found.select("_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return found.select(
        F.col("_id").alias(key),
        (F.col("_at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*map(F.lit, explained)), F.col("_at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The deviation as long; null where it does not fit."""
    return whitened(table(spark, folder, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
