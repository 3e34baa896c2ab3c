"""Vector arithmetic as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in doubles; vectors of different length raise an error."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def is_normalized(v: Column, tolerance: float = 0.01) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def normalize(v: Column) -> Column:
    """v over its norm; a zero vector stays."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def stacked(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's usable vectors, and these as a matrix; null vectors and those with null or non-finite entries are none."""
    at = np.flatnonzero([v is not None for v in vectors])
    if not len(at):
        return at, np.zeros((0, 0))
    matrix = np.stack([np.asarray(vectors.iloc[i], np.float64) for i in at])
    good = np.isfinite(matrix).all(axis=1)
    return at[good], matrix[good]


class Tops:
    """Each query's k best of the rows that it is shown, in bounded memory: tiles of scores, and 2 * k rows a query between two prunings.

    Queries go in groups, of which one is multiplied, pruned or given out at a time: sorting takes several times what is kept,
    and so takes it for a group alone. Scores are those of the two vectors alone, whatever the shape of the product that found them. Ties: smaller id.
    """

    ROWS, QUERIES, PART, SLACK = 2048, 256, 4096, 1e-9
    #: Rows kept for a group's queries, at the most, if k is not larger.
    GROUP = 1 << 16

    def __init__(self, matrix: np.ndarray, k: int, least: float = -np.inf, owners: np.ndarray | None = None):
        self.matrix, self.k, self.owners = matrix, k, owners
        self.bar, self.least = np.full(len(matrix), least), least
        size = max(1, min(self.QUERIES, self.GROUP // max(1, k)))
        self.groups = [slice(at, min(at + size, len(matrix))) for at in range(0, len(matrix), size)]
        self.held, self.n = [[] for _ in self.groups], [0 for _ in self.groups]

    def add(self, ids: np.ndarray, rows: np.ndarray, owners: np.ndarray | None = None) -> None:
        """Rows with their ids."""
        for lo in range(0, len(rows), self.ROWS):
            own, number = rows[lo : lo + self.ROWS], ids[lo : lo + self.ROWS]
            for g, q in enumerate(self.groups):
                matrix, bar = self.matrix[q], self.bar[q]
                scores = matrix @ own.T
                if self.owners is not None:
                    scores[self.owners[q][:, None] == owners[lo : lo + self.ROWS]] = -np.inf
                if len(number) > self.k:
                    bar = np.maximum(bar, np.partition(scores, len(number) - self.k, axis=1)[:, len(number) - self.k])
                hit, col = np.nonzero((scores >= bar[:, None] - self.SLACK) & (scores > -np.inf))
                parts = (slice(i, i + self.PART) for i in range(0, len(hit), self.PART))
                exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", matrix[hit[p]], own[col[p]]) for p in parts)])
                good = exact >= self.least
                self.held[g].append(((q.start + hit[good]).astype(np.int32), number[col[good]], exact[good]))
                self.n[g] += int(good.sum())
                if self.n[g] > 2 * self.k * len(matrix) + self.PART:
                    self._prune(g)

    def _prune(self, g: int) -> None:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held[g]))
        self.held[g] = []
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        last = rank == self.k - 1
        self.bar[q[last]] = np.maximum(self.bar[q[last]], scores[last])
        kept = rank < self.k
        self.held[g], self.n[g] = [(q[kept], ids[kept], scores[kept])], int(kept.sum())

    def each(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query's place, id, score) of the best, a group of queries at a time, which is let go."""
        for g in range(len(self.groups)):
            if self.n[g]:
                self._prune(g)
                out, self.held[g], self.n[g] = self.held[g][0], [], 0
                yield out

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the best."""
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return tuple(np.concatenate(x) for x in zip(none, *self.each()))


def centroids(chunks: DataFrame, key: str = "document_id", vector: str = "embedding", unit: bool = True) -> DataFrame:
    """(key, centroid, effective_chunk_count): the mean of each key's vectors, of unit length if asked.

    The mean is taken place by place, so that sums are combined before the shuffle and a hot document costs
    one row for each place and task. A document with ragged or non-finite vectors is left out.
    """
    v = F.col(vector)
    sizes = chunks.groupBy(key).agg(F.count(v).alias("effective_chunk_count"), F.min(F.size(v)).alias("lo"), F.max(F.size(v)).alias("hi"), F.min(finite(v).cast("int")).alias("ok"))
    good = sizes.filter("lo = hi and ok = 1").select(key, "effective_chunk_count")
    means = chunks.filter(v.isNotNull()).select(key, F.posexplode(v).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda e: e.x).alias("centroid"))
    out = whole.join(good, key)
    return out.withColumn("centroid", normalize(F.col("centroid"))) if unit else out
