"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, written
from .vectors import matrices, packed, summed

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: A component whose eigenvalue is a smaller share of the largest can't be told from rounding.
RANK_SHARE = 1e-11


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dim: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal columns v and an upper bidiagonal B with X V = U B, U orthonormal, by `dim` Lanczos steps.

    `product` is one pass over the rows: each task takes u = X p for its rows and adds up X^T u. A left vector u
    is as long as the table and lies in the range of X, so it is held as the short p with u = X p. Both sides are
    orthogonalised in full and twice: v against all earlier v, and u against all earlier u, whose inner products
    with X p are those of the earlier p with X^T X p. Where the space is used up a new direction starts.
    """
    rng = np.random.default_rng(seed)
    basis, left, back = (np.zeros((dim, 0)) for _ in range(3))
    bidiagonal = np.zeros((dim, dim))
    largest = 0.0

    def fresh() -> np.ndarray:
        v = rng.standard_normal(dim)
        for _ in range(2):
            v -= basis @ (basis.T @ v)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    for j in range(dim):
        p = v - beta * left[:, -1] if j else v.copy()
        basis = np.column_stack([basis, v])
        z = product(p)
        for _ in range(2):
            shares = left.T @ z
            p, z = p - left @ shares, z - back @ shares
        alpha = float(np.sqrt(max(p @ z, 0.0)))
        largest = max(largest, alpha)
        if alpha <= 1e-13 * largest or alpha == 0:  # v is in the null space
            alpha, p, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            p, z = p / alpha, z / alpha
        left, back = np.column_stack([left, p]), np.column_stack([back, z])
        bidiagonal[j, j] = alpha
        if j + 1 < dim:
            w = z - alpha * v
            for _ in range(2):
                w -= basis @ (basis.T @ w)
            beta = float(np.linalg.norm(w))
            if beta <= 1e-12 * largest:
                v, beta = fresh(), 0.0
            else:
                v = w / beta
            bidiagonal[j, j + 1] = beta
    return basis, bidiagonal


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each usable vector and component.

    An entry c counts as x = floor(scale * c) + shift. The rows are centred by the exact sums S before anything is
    multiplied; the singular vectors of the small bidiagonal matrix, turned by V, are the covariance's unit
    eigenvectors, by falling eigenvalue e; whitened is a centred row's projection over sqrt(e), explained is
    e / trace, identity_error the largest entry of the whitened rows' covariance less the identity.
    deviation is the sum of (n * x - S)**2, exact, null where it passes 64 bits.

    The vectors are written once as blocks of whole numbers; each of the as many steps as a vector has entries
    reads them once, and a task returns one short vector.

    Vectors that are null or hold a null or non-finite entry are left out; shorter ones count as filled up with
    zeros. Null ids stay, rows that repeat count each, extra columns are ignored. Of a covariance of lower rank
    (equal rows, fewer rows than entries) only the components over 1e-11 of the largest eigenvalue are given, none at all
    for one row. An empty table, or one without a usable vector, gives an empty result.
    """
    spark = vectors.sparkSession
    blocks, _ = written(packed(vectors, id_col, vec_col, scale, shift))
    kind_of_id = field(vectors.select(F.col(f"`{id_col}`").alias("id")), "id").split(" ", 1)[1]
    schema = f"vec_id {kind_of_id}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    dim = blocks.agg(F.max("dim")).first()[0] or 0
    tasks = blocks.rdd.getNumPartitions()
    totals = summed(blocks, lambda x: np.append(x.sum(axis=0), len(x)), dim, shift, "<i8", tasks)
    if totals is None or dim == 0:
        return spark.createDataFrame([], schema)
    sums, n = totals[:-1], int(totals[-1])

    whole, part = sums // n, (sums % n) / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole).astype(np.float64) - part

    def deviations(x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)**2 of each row, in Python's numbers where longs don't hold it."""
        most = int(np.abs(x - whole).max(initial=0)) + 1
        x = x.astype(object) if (most * n) ** 2 * dim >= 1 << 63 else x
        return ((x * n - sums) ** 2).sum(axis=1)

    def step(p: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            rows = centred(x)
            return rows.T @ (rows @ p)

        return summed(blocks, work, dim, shift, "<f8", tasks)

    basis, bidiagonal = bidiagonalise(step, dim)
    _, singular, turned = np.linalg.svd(bidiagonal)
    values = singular**2 / n
    trace = float((bidiagonal**2).sum() / n)
    kept = [i for i in range(min(components, dim)) if values[i] > RANK_SHARE * values[0]]
    if not kept:
        return spark.createDataFrame([], schema)
    axes = basis @ turned[kept].T
    axes = axes / np.linalg.norm(axes, axis=0)
    scaled_axes = axes / np.sqrt(values[kept])
    k = len(kept)

    def gram(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ scaled_axes
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    found = summed(blocks, gram, dim, shift, "<f8", tasks) / n
    mean = found[k * k :]
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values[kept] / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch, dim, shift):
                y, squares = centred(x) @ scaled_axes, deviations(x)
                squares = pa.array([int(s) if s < 1 << 63 else None for s in squares] if squares.dtype == object else squares, pa.int64())
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [ids.take(each), np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), np.full(len(x) * k, n), squares.take(each), y.ravel(), np.tile(explained, len(x)), np.full(len(x) * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(project, schema)
