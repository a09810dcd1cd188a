"""Whitening of embeddings by shifted CholeskyQR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm.shared import documents, stored

SCALE = 256.0
COMPONENTS = 4
MOST_PASSES = 5
SETTLED = 1e-9
RANK = 1e-14
LOW = 32
LONG = 1 << 63


def _quantised(scale: float):
    """Rows (key, vector) to (key, length, x): x holds floor(scale * entry) as little-endian longs. Rows
    that are null or hold a null or non-finite entry go; beyond a long the value is its nearest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vectors = batch.column(0), batch.column(1).cast(pa.large_list(pa.float64()))
            present = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            keys, vectors = keys.take(pa.array(present)), vectors.take(pa.array(present))
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null arrives as NaN
            good = np.flatnonzero(bad[bounds[1:]] == bad[bounds[:-1]])
            scaled = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
            whole = np.where(np.abs(scaled) < 9.2e18, scaled, 0.0).astype(np.int64)
            whole[scaled >= 9.2e18], whole[scaled <= -9.2e18] = LONG - 1, -LONG
            rows = [whole[bounds[i]:bounds[i + 1]].tobytes() for i in good]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(good)), pa.array(np.diff(bounds)[good], pa.int64()), pa.array(rows, pa.binary())], ["key", "length", "x"])

    return run


def _longs(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The long vectors of a batch as a matrix."""
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), dtype=np.int64).reshape(batch.num_rows, size)


def _sums(size: int):
    """Per task and dimension: rows and sums, the latter as a high and a low half, so that none overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            x = _longs(batch, 0, size)
            n, high, low = n + len(x), high + (x >> LOW).sum(axis=0), low + (x & ((1 << LOW) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["d", "n", "high", "low"])

    return run


def solve_rows(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Y with Y R = X for an upper triangular R, column by column."""
    y = np.empty_like(x)
    for j in range(r.shape[1]):
        y[:, j] = (x[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


def _gram(size: int, mean: np.ndarray, factors: list[np.ndarray]):
    """Upper half of the Gram matrix of the rows, centred and solved through the factors, per task."""
    i, j = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = _longs(batch, 0, size) - mean
            for r in factors:
                y = solve_rows(y, r)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    return run


def _moments(size: int, mean: np.ndarray, basis: np.ndarray):
    """Per task: sums of the projected rows (row -1) and of their products."""
    k = basis.shape[1]
    i, j = np.meshgrid(np.arange(-1, k), np.arange(k), indexing="ij")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_longs(batch, 0, size) - mean) @ basis
            total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def cells(fit: DataFrame, task, rows: int, columns: int) -> np.ndarray:
    """Sum over all tasks of the matrix cells (i, j, v) each of them makes; its size is set by the
    dimensions alone, whatever the number of rows."""
    summed = fit.select("x").mapInArrow(task, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((rows, columns))
    for r in summed:
        out[r.i, r.j] = r.v  # row -1 is the last one
    return out


def shifted_cholesky(gram: np.ndarray, rows: int, shift: bool) -> np.ndarray:
    """Upper triangular R of a Gram matrix, shifted by its rounding error where it must be or fails without."""
    size = len(gram)
    amount = 11 * (rows * size + size * (size + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + np.eye(size) * (amount if shift else 0.0)).T
        except np.linalg.LinAlgError:
            amount, shift = amount * (10 if shift else 1), True


def factorise(fit: DataFrame, size: int, n: int, mean: np.ndarray) -> tuple[np.ndarray, float]:
    """F with F'F = the Gram matrix of the centred rows (x), and that matrix's trace.

    Each pass solves the rows through the factors so far and takes the Cholesky factor of what is
    left; the first is shifted, so it exists for any rows. Passes end when the solved rows are
    orthonormal, but for directions in which there is nothing. The last Gram matrix enters by its root.
    """
    factors: list[np.ndarray] = []
    product, trace = np.eye(size), 0.0
    while True:
        gram = cells(fit, _gram(size, mean, factors), size, size)
        gram = np.triu(gram) + np.triu(gram, 1).T
        values, vectors = np.linalg.eigh(gram)
        if not factors:
            trace = float(np.trace(gram))
        elif len(factors) == MOST_PASSES or np.all((np.abs(values - 1) < SETTLED) | (values < SETTLED)):
            return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ product, trace
        if trace == 0.0:
            return np.zeros((size, size)), trace
        factors.append(shifted_cholesky(gram, n, not factors))
        product = factors[-1] @ product


def _outputs(scale: float, size: int, n: int, sums: list[int], mean: np.ndarray, basis: np.ndarray, explained: np.ndarray, error: float):
    quantise = _quantised(scale)
    k = basis.shape[1]
    exact = np.array(sums, dtype=object)

    def deviations(x: np.ndarray) -> pa.Array:
        far = np.abs(x.astype(float) * n - np.array(sums, dtype=float)).max(initial=0.0)
        if size * far * far < 2.0 ** 62 and n * np.abs(x.astype(float)).max(initial=0.0) < 2.0 ** 62:
            return pa.array(((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
        whole = [int(((row.astype(object) * n - exact) ** 2).sum()) for row in x]
        return pa.array([v if v < LONG else None for v in whole], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in quantise(batches):
            batch = batch.filter(pa.array(batch.column(1).to_numpy() == size))
            x = _longs(batch, 2, size)
            white = (x - mean) @ basis
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), n)), deviations(x).take(pa.array(each)), pa.array(white.ravel()),
                 pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error))],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = SCALE, most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row and component.

    The components are fitted on each distinct quantised vector once. Rows whose vector is null or
    holds a null or non-finite entry go, and so do empty vectors and those that have not the commonest
    length (ties: the longer). Rows that repeat, or have a null key, come out each. Components without
    variance are left out: of n distinct vectors there are at most n - 1, of one none, and so no rows.
    A deviation beyond a long is null; the sign of a component makes its largest weight positive.

    What reaches the driver are sums per dimension and pair of dimensions, whatever the number of rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("vector"))
    kind = "key long, length long, x binary"
    nothing = spark.createDataFrame([], f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    distinct = stored(rows.mapInArrow(_quantised(scale), kind).where("length > 0").select("length", "x").distinct(), "fit")
    lengths = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("length")).count()
    held = distinct.select("length").distinct().join(lengths, "length")
    common = held.orderBy(F.col("count").desc(), F.col("length").desc()).first()
    if common is None:
        return nothing
    size = int(common.length)
    fit = distinct.where(F.col("length") == size)
    exact = "decimal(38,0)"
    per = fit.select("x").mapInArrow(_sums(size), "d long, n long, high long, low long").groupBy("d").agg(
        F.sum("n").alias("n"), (F.sum(F.col("high").cast(exact))).alias("high"), F.sum(F.col("low").cast(exact)).alias("low")).orderBy("d").collect()
    n, sums = int(per[0].n), [(int(r.high) << LOW) + int(r.low) for r in per]
    mean = np.array([s / n for s in sums])
    factor, trace = factorise(fit, size, n, mean)
    _, sigma, weights = np.linalg.svd(factor)
    variance = sigma ** 2 / n
    k = min(most, int((variance > variance[0] * RANK).sum()))
    if trace == 0.0 or k == 0:
        return nothing
    weights = weights[:k] * np.sign(weights[np.arange(k), np.abs(weights[:k]).argmax(axis=1)])[:, None]
    basis = weights.T / np.sqrt(variance[:k])
    moments = cells(fit, _moments(size, mean, basis), k + 1, k) / n
    covariance = moments[:k] - np.outer(moments[k], moments[k])
    error = float(np.abs(covariance - np.eye(k)).max())
    out = "key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_outputs(scale, size, n, sums, mean, basis, variance[:k] * n / trace, error), out).withColumnRenamed("key", key)


def op11_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(documents(spark, sf_dir, "embeddings"))
