"""Whitening of embeddings, with covariances recovered by polarisation."""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT = 64, 1_000_000
LARGEST = 1 << 40  # entries from here on (times SCALE) are not taken: sums of their squares would outgrow 38 digits
EXACT = pa.decimal128(38, 0)
ROWS = 4096  # vectors that are worked on at once


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, the scaled vector in whole numbers, of the rows whose vector is neither null nor empty and has finite entries under LARGEST / SCALE only."""
    v = F.col(vector)
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST / SCALE), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    return df.where(v.isNotNull() & (F.size(v) > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrices(column: pa.Array, d: int):
    """A column of vectors of d entries as matrices of up to ROWS rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    for at in range(0, len(flat), ROWS):
        yield flat[at : at + ROWS]


def _exact(m: np.ndarray, most: int) -> np.ndarray:
    """m in integers that hold sums up to `most`: of 64 bits, or Python's own."""
    return m if most < 1 << 62 else m.astype(object)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the sums by dimension; d + 1 exact numbers."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            for m in _matrices(batch.column(0), d):
                n += len(m)
                total += _exact(m, int(np.abs(m).max(initial=0)) * len(m)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(int(v)) for v in (n, *total)], EXACT)], ["i", "v"])

    found = {r.i: int(r.v) for r in fit.select("x").mapInArrow(run, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _squares(fit: DataFrame, middle: list[int]) -> np.ndarray:
    """[i, j]: the sum over the fit list of the square of y_i + y_j, and for i = j of y_i, in whole numbers; y is x less `middle`, the whole numbers next to the means."""
    d, m0 = len(middle), np.array(middle, np.int64)

    def run(batches):
        total = np.zeros((d, d), object)
        for batch in batches:
            for m in _matrices(batch.column(0), d):
                y = m - m0
                y = _exact(y, (2 * int(np.abs(y).max(initial=0))) ** 2 * len(y))
                for i in range(d):
                    total[i, i] += (y[:, i] * y[:, i]).sum()
                    both = y[:, i : i + 1] + y[:, i + 1 :]
                    total[i, i + 1 :] += (both * both).sum(axis=0)
        at = [(i, j) for i in range(d) for j in range(i, d)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array([Decimal(int(total[p])) for p in at], EXACT)], ["i", "j", "v"])

    found = np.zeros((d, d), object)
    for r in fit.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect():
        found[r.i, r.j] = int(r.v)
    return found


def covariance(n: int, rest: list[int], squares: np.ndarray) -> np.ndarray:
    """V from the sums of squares of y, y's sums being `rest`: exact in whole numbers until the last division.

    n^2 Var(z) = n * sum(z^2) - sum(z)^2 for z = y_i and for z = y_i + y_j; half of what the variance of a sum has over
    both variances is the covariance.
    """
    d = len(rest)
    spread = lambda i, j: n * squares[i, j] - (rest[i] if i == j else rest[i] + rest[j]) ** 2
    own = [spread(i, i) for i in range(d)]
    found = np.zeros((d, d))
    for i in range(d):
        found[i, i] = float(Fraction(own[i], n * n))
        for j in range(i + 1, d):
            found[i, j] = found[j, i] = float(Fraction(spread(i, j) - own[i] - own[j], 2 * n * n))
    return found


def _projected(m: np.ndarray, middle: np.ndarray, part: np.ndarray, to: np.ndarray) -> np.ndarray:
    """(x - S / n) times `to`; the whole part of the mean is taken off in whole numbers."""
    return ((m - middle).astype(float) - part) @ to


def _identity_error(fit: DataFrame, middle: np.ndarray, part: np.ndarray, to: np.ndarray, n: int) -> float:
    """The largest entry of the covariance of the projected fit list minus the identity; k * (k + 3) / 2 sums."""
    d, k = to.shape

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            for m in _matrices(batch.column(0), d):
                w = _projected(m, middle, part, to)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) * k), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    sums = np.zeros((k + 1) * k)
    for r in fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r.i] = r.v
    sums = sums.reshape(k + 1, k) / n
    return float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """vectors(vec_id, embedding) on their first principal components, scaled to variance 1: a row for each usable vector and component.

    Columns: vec_id, component (from 1 by falling variance), n (distinct vectors), deviation (decimal(38,0): the sum over the
    dimensions of (n * x - S)^2, null beyond 38 digits), whitened, explained (the component's share of the whole variance) and identity_error
    (how far the covariance of `whitened` over the distinct vectors is from the identity, at its largest entry).

    x is the vector times 64, rounded down, plus 1,000,000, in longs. Means and covariances are those of the distinct x. Sums of
    squares of centred entries and of centred sums of two dimensions are aggregated in whole numbers; the
    covariances are differences of their variances; only eigh on the matrix of d by d entries is done by the driver,
    which holds d * (d + 1) / 2 sums (d is a property of the embedding, not of the table).

    Left out: rows with a null or empty vector, with null, NaN or infinite entries or such of 2^34 or more, and rows
    whose vector has another length than most (ties: the longer). Components without variance (under d * 2^-52 of the
    largest) don't exist, so a table of one distinct vector, and an empty one, give no rows. Repeated rows and null
    vec_ids are carried through. Other columns are ignored.

    Distinct vectors are found in one shuffle after a partial aggregation, so a vector that a third of the rows have
    is a row from each task; they are kept in the shared folder, from which all sums are read. Rows are projected
    where they are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", vector), vector)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 1
    rows = rows.where(F.size("x") == d)
    fit = written(rows.select("x").distinct())
    n, total = _sums(fit, d)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    middle = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, middle)]
    v = covariance(n, rest, _squares(fit, middle))
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(components, int((e > max(e[0], 0) * d * 2.0**-52).sum()))
    if k == 0:
        return spark.createDataFrame([], schema)
    m0, r0, part = np.array(middle, np.int64), np.array(rest, object), np.array([float(Fraction(r, n)) for r in rest])
    to, explained = np.ascontiguousarray(axes[:, :k] / np.sqrt(e[:k])), e[:k] / math.fsum(np.diag(v))
    error = _identity_error(fit, m0, part, to, n)

    def run(batches):
        for batch in batches:
            at = 0
            for m in _matrices(batch.column(1), d):
                y = m - m0
                far = n * (int(np.abs(y).max()) + 1)
                y = _exact(y, far * far * d) * n - (r0 if far * far * d >= 1 << 62 else r0.astype(np.int64))
                deviation = (y * y).sum(axis=1)
                ids = batch.column(0).slice(at, len(m)).take(pa.array(np.repeat(np.arange(len(m)), k)))
                at += len(m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))), pa.array(np.full(len(m) * k, n, np.int64)),
                        pa.array([x for s in deviation.tolist() for x in [Decimal(s) if s < 10**38 else None] * k], EXACT), pa.array(_projected(m, m0, part, to).ravel()),
                        pa.array(np.tile(explained, len(m))), pa.array(np.full(len(m) * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)
