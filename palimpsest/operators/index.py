"""An inverted file kept on storage: vectors by cell, a small table of centres, and searches that read the probed cells alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import Tops, finite, stacked

#: Cells, at the most: the centres go to every task (64 places of 8 bytes: 32 MB).
MOST_CELLS = 65_536
#: Vectors that the upper centres are fitted on, and for each cell those that its centre is fitted on, at the most.
SAMPLE, SAMPLE_A_CELL = 20_000, 64
#: Upper cells whose cells are compared with a vector.
UPPER = 6
#: Queries of one pass.
BLOCK = 2048


def cells_for(n: int) -> int:
    """As many cells as the root of the number of vectors, 16 to MOST_CELLS."""
    return min(MOST_CELLS, max(16, int(n**0.5)))


def lloyd(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centres of a bounded set of points; fewer if there are fewer distinct ones."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]]
    for _ in range(rounds if len(points) > k else 0):
        at = ((centres**2).sum(axis=1) / 2 - points @ centres.T).argmin(axis=1)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """Centres in two levels: the cells of upper centre i are the rows [starts[i], starts[i + 1]) of `centres`."""

    upper: np.ndarray
    starts: np.ndarray
    centres: np.ndarray

    def nearest(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """Each vector's n nearest cells among those of its UPPER nearest upper centres, nearest first; -1 where there are fewer."""
        far = lambda own, middle: (middle**2).sum(axis=1) / 2 - own @ middle.T
        above = far(vectors, self.upper)
        wide = min(UPPER, len(self.upper))
        tops = np.argpartition(above, wide - 1, axis=1)[:, :wide] if wide < len(self.upper) else np.tile(np.arange(wide), (len(vectors), 1))
        most = int(np.diff(self.starts).max())
        apart, cell = np.full((len(vectors), wide, most), np.inf), np.full((len(vectors), wide, most), -1)
        for top in np.unique(tops):
            row, place = np.nonzero(tops == top)
            lo, hi = self.starts[top], self.starts[top + 1]
            apart[row, place, : hi - lo] = far(vectors[row], self.centres[lo:hi])
            cell[row, place, : hi - lo] = np.arange(lo, hi)
        apart, cell = apart.reshape(len(vectors), -1), cell.reshape(len(vectors), -1)
        out = np.full((len(vectors), n), -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, :n]
        out[:, : order.shape[1]] = np.take_along_axis(cell, order, axis=1)
        return out


def fit_cells(vectors: DataFrame, cells: int, seed: int = 42) -> Cells:
    """Cells of (vec_id, vector) in two levels of k-means: upper centres on one bounded sample, and under each of them its cells on a second.

    The second sample is split by upper centre and fitted in tasks, each of which has a bounded number of rows.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = max(1, vectors.count())
    k = max(1, round(cells**0.5))
    below = -(-cells // k)
    part = lambda rows: vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < min(1 << 40, (1 << 40) * rows // n))
    found = part(SAMPLE).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    upper = np.array(KMeans(k=k, seed=seed, maxIter=10).fit(found).clusterCenters()) if k > 1 else np.zeros((1, len(vectors.first().vector)))
    shared = vectors.sparkSession.sparkContext.broadcast(upper)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, own = stacked(batch.vector)
            top = ((shared.value**2).sum(axis=1) / 2 - own @ shared.value.T).argmin(axis=1)
            yield pd.DataFrame({"top": top, "vec_id": batch.vec_id.to_numpy()[at], "vector": list(own)})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"top": rows.top.iloc[0], "centre": list(lloyd(np.stack(rows.vector.to_list()), below, seed))})

    placed = part(SAMPLE_A_CELL * cells).select("vec_id", "vector").mapInPandas(place, "top long, vec_id long, vector array<double>")
    order = Window.partitionBy("top").orderBy(F.xxhash64("vec_id"))
    bounded = placed.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= 4 * SAMPLE_A_CELL * below)
    rows = bounded.groupBy("top").applyInPandas(fit, "top long, centre array<double>").collect()  # `cells` rows
    centres: list[list] = [[] for _ in upper]
    for r in rows:
        centres[r.top].append(r.centre)
    held = [i for i, c in enumerate(centres) if c]
    lists = [sorted(centres[i]) for i in held]
    return Cells(upper[held], np.cumsum([0, *map(len, lists)]), np.array([c for own in lists for c in own], np.float64))


@dataclass(frozen=True)
class InvertedFile:
    """An index under `path`: `vectors`, Parquet by cell, each vector in its `copies` nearest cells; `centres`, a row a cell."""

    spark: SparkSession
    path: str
    cells: Cells

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, copies: int = 4, seed: int = 42, keep: tuple[str, ...] = ()) -> InvertedFile:
        """Fit the cells of (vec_id, vector, [keep]) and write every usable vector to its cells; `cells` by cells_for if not given.

        Vectors go to their cells in one exchange, whose large cells adaptive execution splits over several tasks and files.
        Null, non-finite and empty vectors are left out. Without any vector the index is empty.
        """
        spark = vectors.sparkSession
        vectors = cut(vectors.select("vec_id", "vector", *keep).filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite(F.col("vector"))))
        n = vectors.count()
        if not n:
            return cls(spark, path, Cells(np.zeros((0, 0)), np.zeros(1, np.int64), np.zeros((0, 0))))
        found = fit_cells(vectors, min(cells or cells_for(n), n), seed)
        shared = spark.sparkContext.broadcast(found)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at, own = stacked(batch.vector)
                if len(at):
                    near = shared.value.nearest(own, copies)
                    row, place = np.nonzero(near >= 0)
                    yield batch.iloc[at[row]].assign(cell=near[row, place].astype(np.int32))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
        rows = vectors.mapInPandas(assign, f"{kinds}, cell int")
        rows.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
        tops = np.searchsorted(found.starts, np.arange(len(found.centres)), "right") - 1
        rows = [(i, int(t), [float(x) for x in found.upper[t]], [float(x) for x in c]) for i, (t, c) in enumerate(zip(tops, found.centres))]
        spark.createDataFrame(rows, "cell int, top int, upper array<double>, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        return cls(spark, path, found)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> InvertedFile:
        """A stored index; nothing but its centres is read."""
        rows = spark.read.parquet(f"{path}/centres").sort("cell").collect()  # MOST_CELLS rows
        tops = np.array([r.top for r in rows])
        starts = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
        return cls(spark, path, Cells(np.array([rows[i].upper for i in starts]), np.r_[starts, len(rows)], np.array([r.centre for r in rows])))

    def vectors(self, probed: list[int]) -> DataFrame:
        """(vec_id, vector, [kept columns], cell) of some cells, whose folders alone are read."""
        return self.stored().filter(f"cell in ({', '.join(map(str, probed))})")

    def stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def nearest(self, queries: DataFrame, k: int, probes: int = 16, block: int = BLOCK) -> DataFrame:
        """(query_id, vec_id, score, rank): each query's k nearest by dot product among the vectors of its `probes` nearest cells.

        Queries (query_id, vector) are taken in blocks, each broadcast with its cells; a cell is multiplied in tiles with the
        queries that probe it and gives k rows for each and task at the most. Ties: smaller id.
        """

        def given(tops: Tops, ids: np.ndarray) -> Iterator[pd.DataFrame]:
            for place, own, scores in tops.each():
                yield pd.DataFrame({"query_id": ids[place], "vec_id": own, "score": scores})

        queries = cut(queries.select("query_id", "vector"))
        n_blocks = max(1, -(-queries.count() // block))
        found = None
        for i in range(n_blocks if len(self.cells.centres) else 0):
            rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).toPandas()
            at, asked = stacked(rows.vector)
            if not len(at):
                continue
            near = self.cells.nearest(asked, probes)
            probed = sorted(set(near[near >= 0].tolist()))
            shared = self.spark.sparkContext.broadcast((rows.query_id.to_numpy()[at], asked, {c: np.flatnonzero((near == c).any(axis=1)) for c in probed}))

            def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                ids, asked, probing = shared.value
                tops, held = None, None
                for batch in batches:
                    for cell, part in batch.groupby("cell"):
                        if cell != held:  # a vector is once in a cell, and a cell's rows follow each other in a file
                            if tops is not None:
                                yield from given(tops, ids[probing[held]])
                            tops, held = Tops(asked[probing[cell]], k), cell
                        tops.add(part.vec_id.to_numpy(np.int64), np.stack(part.vector.to_list()).astype(np.float64))
                if tops is not None:
                    yield from given(tops, ids[probing[held]])

            part = self.vectors(probed).mapInPandas(scan, "query_id bigint, vec_id bigint, score double")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a vector has copies in several cells
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
