"""Whitening of vectors: exact sums on Spark, leading eigenvectors by spectrum slicing.

The number of eigenvalues above a shift is read off the signs of an LDL' factor of the shifted
covariance (inertia).  Bisection on that count isolates each leading eigenvalue, Rayleigh
quotient iteration from there converges cubically, and the counts on both sides of the value it
ends at certify that it is the k-th.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

#: Components that are kept, and the whole numbers that entries become: floor(SCALE c) + SHIFT.
COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: Whole numbers beyond this are cut: doubles of that size have no fraction to keep.
_MOST = 2.0**53
_EPS = float(np.finfo(float).eps)
#: The pivot bound of Bunch and Kaufman.
_PIVOT = (1 + np.sqrt(17)) / 8


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of an LDL' factor.

    Diagonal pivoting keeps the factor stable, with blocks of two where no single pivot is large
    enough; such a block has one positive and one negative eigenvalue.
    """
    a = matrix - shift * np.eye(len(matrix))
    count = k = 0
    n = len(a)
    while k < n:
        column = np.abs(a[k + 1:, k])
        most = column.max(initial=0.0)
        pivot = abs(a[k, k])
        if max(most, pivot) == 0:
            k += 1
            continue
        two = False
        if pivot < _PIVOT * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            widest = row.max()
            if pivot * widest < _PIVOT * most * most:
                two = abs(a[r, r]) < _PIVOT * widest
                to = k + 1 if two else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if two:
            block = a[k:k + 2, k:k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[1, 0], block[0, 0]]]) / det
            rest = a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= rest @ inverse @ rest.T
            count += 1
            k += 2
        else:
            rest = a[k + 1:, k]
            a[k + 1:, k + 1:] -= np.outer(rest, rest / a[k, k])
            count += a[k, k] > 0
            k += 1
    return int(count)


def _orthogonal(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def _refined(matrix: np.ndarray, lo: float, hi: float, found: list[np.ndarray], noise: float) -> tuple[float, np.ndarray, float]:
    """(eigenvalue, unit eigenvector, residual) from a bracket: inverse steps, then Rayleigh quotient iteration.

    A step is kept while the residual falls; it falls with the third power, so few are made.
    """
    n = len(matrix)
    one = np.eye(n)

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        try:
            y = np.linalg.solve(matrix - shift * one, x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(matrix - (shift + noise) * one, x)
        return _orthogonal(y / np.abs(y).max(), found)

    x = _orthogonal(np.random.default_rng(n).standard_normal(n), found)
    for _ in range(3):
        x = solved((lo + hi) / 2, x)
    value = float(x @ matrix @ x)
    left = float(np.linalg.norm(matrix @ x - value * x))
    while left > 0:
        y = solved(value, x)
        now = float(y @ matrix @ y)
        rest = float(np.linalg.norm(matrix @ y - now * y))
        if rest >= left:
            break
        x, value, left = y, now, rest
    return value, x, left


def leading_eigenpairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``most`` largest positive eigenvalues, falling.

    Each number k is certified: at least k eigenvalues lie above the value less a margin and
    fewer than k above the value plus it, the margin being the residual and the rounding of the
    factor.  Values that agree within rounding share a bracket, and their vectors are kept
    orthogonal; values that rounding cannot tell from 0 are not returned.
    """
    n = len(matrix)
    bound = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    if bound == 0:
        return np.zeros(0), np.zeros((n, 0))
    matrix = matrix / bound
    noise = 8 * n * _EPS
    values: list[float] = []
    vectors: list[np.ndarray] = []
    counted = {1 + noise: 0, noise: above(matrix, noise)}  # shift -> eigenvalues above it
    while len(vectors) < min(most, counted[noise]):
        k = len(vectors) + 1
        while True:
            lo = max(s for s, c in counted.items() if c >= k)
            hi = min(s for s, c in counted.items() if c < k)
            if hi - lo <= noise or (counted[lo] == k and counted[hi] == k - 1):
                break
            counted[(lo + hi) / 2] = above(matrix, (lo + hi) / 2)
        while True:
            value, vector, left = _refined(matrix, lo, hi, vectors, noise)
            margin = left + noise
            if above(matrix, value - margin) >= k > above(matrix, value + margin):
                break
            if hi - lo <= noise:  # cannot be told apart any more; orthogonality separates them
                break
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if above(matrix, middle) >= k else (lo, middle)
        values.append(value * bound)
        vectors.append(vector)
    order = sorted(range(len(values)), key=lambda i: -values[i])
    return np.array([values[i] for i in order]), np.stack([vectors[i] for i in order], axis=1) if order else np.zeros((n, 0))


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE c) + SHIFT as long."""
    return np.clip(np.floor(vectors.astype(float) * SCALE), -_MOST, _MOST).astype(np.int64) + SHIFT


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce((F.size(v) > 0) & fine, F.lit(False)))


def _matrices(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if len(batch):
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
            yield batch, whole_numbers(flat.reshape(len(batch), size))


def _exact_gram(u: np.ndarray) -> np.ndarray:
    """u' u of whole numbers, exactly: in doubles as far as they hold all bits, else in Python's integers."""
    total = np.zeros((u.shape[1], u.shape[1]), object)
    top = int(np.abs(u).max(initial=0))
    if not top:
        return total
    step = 2**53 // (top * top)
    if not step:
        return u.astype(object).T @ u.astype(object)
    for k in range(0, len(u), step):
        part = u[k:k + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _summed(frame: DataFrame, make, size: int) -> list[list[int]]:
    """Element-wise exact sums of the rows that tasks give: one row of whole numbers per place."""
    def add(batches):
        total = None
        for part in make(batches):
            total = part if total is None else total + part
        for i, row in enumerate([] if total is None else total):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(row), pa.int32()), pa.array(range(len(row)), pa.int32()),
                                              pa.array([str(int(v)) for v in row], pa.string())], names=["i", "j", "v"])

    rows = frame.mapInArrow(add, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[0] * size for _ in range(size)]
    for r in rows.collect():  # as many as pairs of dimensions
        out[r["i"]][r["j"]] = int(r["v"])
    return out


def fit_list(vectors: DataFrame, column: str = "embedding") -> tuple[int, int, list[int], np.ndarray]:
    """(dimensions, n, sums, covariance) of the whole numbers of all usable vectors.

    Numbers are centred at the nearest whole mean before they are multiplied; the rest of the
    mean, half a unit at most, is taken out of the exact sums.  So each entry of the covariance
    is a ratio of two whole numbers, rounded once.
    """
    counts = vectors.groupBy(F.size(column).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if counts is None:
        return 0, 0, [], np.zeros((0, 0))
    d, n = counts["d"], counts["n"]
    rows = vectors.filter(F.size(column) == d).select(column)
    sums = _summed(rows, lambda b: (x.astype(object).sum(axis=0, keepdims=True) for _, x in _matrices(b, column, d)), d)[0]
    middle = np.array([round(s / n) for s in sums], np.int64)
    gram = _summed(rows, lambda b: (_exact_gram(x - middle) for _, x in _matrices(b, column, d)), d)
    left = [s - n * int(m) for s, m in zip(sums, middle)]
    covariance = np.array([[(n * gram[i][j] - left[i] * left[j]) / (n * n) for j in range(d)] for i in range(d)], float)
    return d, n, sums, covariance


def _deviation(z: np.ndarray) -> list[int | None]:
    """Sums of squares of whole numbers, exactly; null where a long cannot hold them."""
    top = int(np.abs(z).max(initial=0))
    if top * top * z.shape[1] < 2**63:
        return (z * z).sum(axis=1).tolist()
    wide = [sum(int(v) ** 2 for v in row) for row in z]
    return [v if v < 2**63 else None for v in wide]


def whitened_rows(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Usable rows of ``vectors`` with ``n``, ``deviation`` and ``whitened``, plus ``explained`` and ``identity_error``.

    ``whitened`` and ``explained`` hold one double per component, in order; there are fewer than
    asked where the vectors span fewer dimensions, and none if all are equal.  ``deviation`` is
    null where a long cannot hold it.  ``identity_error`` is measured on the written rows: the
    largest entry by which the covariance of ``whitened`` differs from the identity.

    Usable are vectors that are neither null nor empty, hold no null or non-finite entry and
    have the commonest length (the greater one of a tie).  Entries past 2**53 / 1024 are cut
    there.  Repeated rows and null ids are rows like any other.  Other columns are kept, those
    of the new names replaced; without usable rows there are none.
    """
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    others = [c for c in vectors.columns if c not in new]
    usable = _usable(vectors.select(F.struct(*others).alias("row"), F.col(column).alias("_v")), "_v")
    d, n, sums, covariance = fit_list(usable, "_v")
    values, axes = leading_eigenpairs(covariance, components)
    scaled = axes / np.sqrt(values)
    total = float(np.trace(covariance))
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    narrow = n * 2 * (max(map(abs, sums), default=0) // max(n, 1) + 2**20) < 2**62

    def project(batches):
        for batch, x in _matrices(batches, "_v", d):
            if narrow and int(np.abs(x - whole).max()) < 2**20:
                z = n * x - np.array(sums, np.int64)
            else:
                z = n * x.astype(object) - np.array(sums, object)
            y = np.stack([(((x - whole) - part) * axis).sum(axis=1) for axis in scaled.T], axis=1) if len(values) else np.zeros((len(x), 0))
            offsets = np.arange(len(batch) + 1, dtype=np.int32) * len(values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(_deviation(z), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))],
                names=["row", "deviation", "whitened"])

    schema = T.StructType([usable.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = stored(usable.filter(F.size("_v") == d).mapInArrow(project, schema), "whitened")
    return rows.select(
        *[F.col(f"row.{c}").alias(c) for c in others], F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(float(v / total)) for v in values]).cast("array<double>").alias("explained"),
        F.lit(identity_error(rows.select("whitened"), len(values))).cast("double").alias("identity_error"))


def identity_error(rows: DataFrame, k: int) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` less the identity; None without components."""
    if not k:
        return None
    w = [F.col("whitened")[i] for i in range(k)]
    mean = rows.agg(*[F.avg(w[i]).alias(f"m{i}") for i in range(k)]).first()
    centred = [w[i] - F.lit(mean[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = rows.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[p] - (i == j)) for p, (i, j) in enumerate(pairs))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitened_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")))
    return each.select("vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", "col.whitened", "col.explained", "identity_error")
