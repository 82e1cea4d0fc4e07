"""Whitening of embeddings: centred, turned to their leading principal axes and scaled to variance one.

1. *Sums.*  Entries become whole numbers, ``floor(scale * c) + shift``; the number of vectors and the sums of
   their dimensions are exact, whatever the order of adding.
2. *Covariance*, distributed: each batch of rows is centred by the mean and multiplied with itself; partitions add
   their batches and emit one row per line of the matrix, which Spark adds up.  Divisor n.
3. *Components*, on the driver, from a matrix as wide as a vector: Householder reflections to tridiagonal form,
   bisection with Sturm counts for the leading eigenvalues, inverse iteration for their vectors, where those of
   close eigenvalues are orthogonalised against each other again, and the reflections backwards.
4. *Projection.*  Mean and components go to every task (at most ``components`` times a vector) and each vector is
   projected and divided by the root of its eigenvalue.  The covariance of the result is computed in the same
   distributed way; its largest distance from the identity is the error that is returned.

Every row counts on all paths; nothing is sampled.  Sums in floating point may differ in the last digits between runs.

Defined cases: vectors that are NULL, empty or hold NULL or non-finite entries are dropped, and so are those with entries
of 2^40 or more in size (their multiples would not be exact) and those of another length than most (the smaller of two
equally frequent ones counts).  Rows with NULL ids, repeated ids and repeated rows count like others.
Components whose eigenvalue is no more than rounding (1e-12 of the trace or less) are left out, as nothing can be scaled by
it: a table of one vector, or of equal ones, gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**40)
ROWS_AT_ONCE = 8_192
_EPSILON = np.finfo(np.float64).eps


# --- eigenvectors of a symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections (one unit vector a row) of Householder's form of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    size = len(a)
    reflections = np.zeros((max(size - 2, 0), size))
    for i in range(size - 2):
        column = a[i + 1 :, i].copy()
        length = np.linalg.norm(column)
        if length == 0:
            continue
        column[0] += np.copysign(length, column[0])
        column /= np.linalg.norm(column)
        reflections[i, i + 1 :] = column
        # Both sides at once: A - v w' - w v'.
        block = a[i + 1 :, i + 1 :]
        turned = block @ column
        turned -= (column @ turned) * column
        block -= 2 * (np.outer(column, turned) + np.outer(turned, column))
        a[i + 1, i] = a[i, i + 1] = -np.copysign(length, a[i + 1, i])
        a[i + 2 :, i] = a[i, i + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def _below(diagonal: np.ndarray, squares: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues lie below each point."""
    pivot = diagonal[0] - points
    count = (pivot < 0).astype(np.int64)
    for value, square in zip(diagonal[1:], squares, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, np.where(pivot < 0, -tiny, tiny), pivot)
        pivot = value - points - square / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, each bisected until its bounds are neighbouring numbers."""
    size = len(diagonal)
    around = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    lowest, highest = float((diagonal - around).min()), float((diagonal + around).max())
    widest = max(abs(lowest), abs(highest), np.finfo(np.float64).tiny)
    low, high = np.full(wanted, lowest - widest * 1e-9), np.full(wanted, highest + widest * 1e-9)
    ranks = size - np.arange(wanted)  # so many eigenvalues are not above the one wanted
    tiny = widest * _EPSILON * _EPSILON
    for _ in range(120):
        middle = low + (high - low) / 2
        enough = _below(diagonal, off * off, middle, tiny) >= ranks
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
        if np.all(high - low <= 2 * _EPSILON * np.maximum(np.abs(low), np.abs(high)) + tiny):
            break
    return low + (high - low) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of the tridiagonal system, by elimination with row exchanges; zero pivots become tiny ones."""
    size = len(diagonal)
    # Rows of the triangle: pivot, next, next but one.
    rows, x = np.zeros((size, 3)), right.copy()
    rows[:, 0], rows[:-1, 1] = diagonal, off
    for i in range(size - 1):
        lower = np.array([off[i], rows[i + 1, 0], rows[i + 1, 1]])
        if abs(off[i]) > abs(rows[i, 0]):
            upper, lower = lower, rows[i].copy()
            rows[i] = upper
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(rows[i, 0]) < tiny:
            rows[i, 0] = tiny
        factor = lower[0] / rows[i, 0]
        rows[i + 1] = [lower[1] - factor * rows[i, 1], lower[2] - factor * rows[i, 2], 0]
        x[i + 1] -= factor * x[i]
    for i in range(size - 1, -1, -1):
        if abs(rows[i, 0]) < tiny:
            rows[i, 0] = tiny
        ahead = sum(rows[i, j] * x[i + j] for j in (1, 2) if i + j < size)
        x[i] = (x[i] - ahead) / rows[i, 0]
        if abs(x[i]) > 1e150:  # keep the size in range: only the direction counts
            x /= abs(x[i])
    return x


def eigenvectors(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    The sign is fixed: the entry of largest size is positive (the first of several).
    """
    size = len(matrix)
    wanted = min(wanted, size)
    if not np.any(matrix):
        return np.zeros(wanted), np.eye(size)[:wanted]
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, wanted)
    norm = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(np.float64).tiny)
    draw, vectors = np.random.default_rng(5), np.zeros((wanted, size))
    cluster = 0  # where the present group of close eigenvalues begins
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        # Equal eigenvalues are moved apart a little, so that their iterations differ.
        shift = value - (k - cluster) * 4 * _EPSILON * norm
        vector = draw.normal(size=size)
        for _ in range(6):
            vector /= np.linalg.norm(vector)
            vector = _solved(diagonal - shift, off, vector, _EPSILON * norm)
            vector /= np.linalg.norm(vector)
            for _ in range(2):
                vector -= vectors[cluster:k].T @ (vectors[cluster:k] @ vector)
        vectors[k] = vector / np.linalg.norm(vector)
    for column in reflections[::-1]:
        vectors -= 2 * np.outer(vectors @ column, column)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    largest = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(wanted), largest])[:, None]


# --- distributed sums


def _blocks(batches: Iterator[pd.DataFrame], name: str) -> Iterator[np.ndarray]:
    for batch in batches:
        for start in range(0, len(batch), ROWS_AT_ONCE):
            yield np.stack(batch[name].iloc[start : start + ROWS_AT_ONCE].to_numpy())


def dimension_sums(vectors: DataFrame, name: str) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension, of arrays of whole numbers."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches, name):
            rows = {"place": np.arange(block.shape[1]), "total": block.sum(axis=0), "n": len(block)}
            yield pd.DataFrame(rows)

    parts = vectors.select(name).mapInPandas(partial, "place int, total long, n long")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    rows = parts.groupBy("place").agg(wide, F.sum("n").alias("n")).orderBy("place").collect()
    return (rows[0].n if rows else 0), [int(row.total) for row in rows]


def covariance(vectors: DataFrame, name: str, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance matrix (divisor n) of the arrays in a column, centred before multiplying."""
    dim = len(mean)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for block in _blocks(batches, name):
            centred = block - mean
            total += centred.T @ centred
        yield pd.DataFrame({"line": np.arange(dim), "entries": list(total)})

    parts = vectors.select(name).mapInPandas(partial, "line int, entries array<double>")
    entries = parts.select("line", F.posexplode("entries").alias("column", "entry"))
    cells = entries.groupBy("line", "column").agg(F.sum("entry").alias("entry")).collect()
    matrix = np.zeros((dim, dim))
    for cell in cells:
        matrix[cell.line, cell.column] = cell.entry / n
    return (matrix + matrix.T) / 2


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the whole numbers ``x`` of the vectors that take part."""
    c = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", c.alias("embedding")).where("embedding is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & (F.size("embedding") > 0))
    lengths = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    rows = rows.where(F.size("embedding") == F.lit(most.dim if most else 0))
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long") + SHIFT)
    return rows.select("vec_id", whole.alias("x"))


_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (squared distance from the mean times n squared, exact), whitened,
    explained (share of the variance) and identity_error for each usable vector of (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = written(_usable(vectors))
    n, sums = dimension_sums(rows, "x")
    if not n:
        return spark.createDataFrame([], _RESULT)
    mean = np.array([total // n + (total % n) / n for total in sums])
    spread = covariance(rows, "x", mean, n)
    trace = float(np.trace(spread))
    values, axes = eigenvectors(spread, components)
    large = values > 1e-12 * trace
    values, axes = values[large], axes[large]
    if not len(values):
        return spark.createDataFrame([], _RESULT)
    scaled = axes / np.sqrt(values)[:, None]

    @F.pandas_udf("deviation string, whitened array<double>")
    def project(columns: pd.Series) -> pd.DataFrame:
        deviations, whitened = [], []
        for start in range(0, len(columns), ROWS_AT_ONCE):
            x = np.stack(columns.iloc[start : start + ROWS_AT_ONCE].to_numpy())
            size = float(np.abs(x).max()) * n + max(map(abs, sums))
            if size * size * x.shape[1] < 2**62:
                apart = x * n - np.array(sums, np.int64)
                deviation = (apart * apart).sum(axis=1)
            else:  # beyond 64 bits: Python's whole numbers
                deviation = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
            deviations += [str(int(d)) for d in deviation]
            whitened += list((x - mean) @ scaled.T)
        return pd.DataFrame({"deviation": deviations, "whitened": whitened})

    projected = written(rows.select("vec_id", project("x").alias("p")).select("vec_id", "p.*"))
    found = covariance(projected, "whitened", np.zeros(len(values)), n)
    error = float(np.abs(found - np.eye(len(values))).max())
    shares = F.array(*[F.lit(float(value / trace)) for value in values])
    spread_out = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return spread_out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation AS DECIMAL(38,0))").alias("deviation"),
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
