"""Exact top-k search by inner product: a cover tree over queries and data, searched by pairs of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, written
from .vectors import narrowest, scaled, widened

K = 5
SCALE = 256
#: Rows of one stored subtree and of one leaf, on average and at the most.
SUBTREE = 4096
LEAF = 256
#: Children of a node, at the most.
FANOUT = 16
#: Vectors, at the most, among which the centres of the upper level are looked for, and the number of these.
SAMPLE = 8192
CENTRES = 1024
#: Queries that are searched for in one pass over the index.
QUERIES = 4096
#: Stands for no score; its negative is a long too.
NONE = -(2**63 - 1)


def farthest_first(points: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, owner, distance): a net of the points, each centre the point farthest from those before.

    Ends at `most` centres or when all points are within `within` of one. Centres are apart by more than the
    distance that is left, and prefixes of the list are the nets of the coarser levels.
    """
    squares = (points**2).sum(axis=1)
    centres, owner, far = [], np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    at = 0
    while len(centres) < most:
        apart = np.maximum(squares + squares[at] - 2 * (points @ points[at]), 0)
        owner[apart < far] = len(centres)
        far = np.minimum(far, apart)
        centres.append(at)
        at = int(far.argmax())
        if far[at] <= within**2:
            break
    return np.array(centres), owner, np.sqrt(far)


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, radii): a cover tree of a block of points.

    A node covers the rows order[lo:hi] within its radius around the row `centre`, itself one of them; its
    children are a net at half its radius, or the first `fanout` centres of it. nodes has (lo, hi, centre, first child,
    children), parents first. Leaf rows are by id. Points that are all equal are one leaf of radius 0.
    """
    order = np.argsort(ids, kind="stable")
    nodes, radii = [[0, len(points), 0, 0, 0]], [0.0]
    at = 0
    while at < len(nodes):
        lo, hi = nodes[at][:2]
        own = points[order[lo:hi]]
        middle = nodes[at][2]
        apart = np.sqrt(np.maximum(((own - points[middle]) ** 2).sum(axis=1), 0)) if len(own) else np.zeros(1)
        radii[at] = float(apart.max())
        if hi - lo > leaf and radii[at] > 0:
            centres, owner, _ = farthest_first(own, fanout, radii[at] / 2)
            by = np.argsort(owner, kind="stable")
            rows, counts = order[lo:hi], np.bincount(owner, minlength=len(centres))
            nodes[at][3:] = len(nodes), len(centres)
            ends = lo + np.cumsum(counts)
            nodes += [[int(e - c), int(e), int(rows[m]), 0, 0] for e, c, m in zip(ends, counts, centres)]
            radii += [0.0] * len(centres)
            order[lo:hi] = rows[by]
        at += 1
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    table = np.array(nodes, np.int64)
    table[:, 2] = back[table[:, 2]] if len(points) else 0
    return order, table, np.array(radii)


@dataclass
class Queries:
    """Queries of one pass: vectors, and the groups (leaves of the tree) that hold them."""

    ids: np.ndarray
    vectors: np.ndarray
    cells: np.ndarray  # of each query
    group: np.ndarray  # of each query
    centres: np.ndarray  # of each group
    radii: np.ndarray
    floor: np.ndarray  # a score that each query is known to reach k times


class Best:
    """The k best (score, id) of each query so far, as flat arrays."""

    def __init__(self, queries: Queries, k: int):
        self.k, n = k, len(queries.ids)
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = queries.floor.copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(at)
        at = np.concatenate([at, np.repeat(touched, self.k)])
        scores, ids = np.concatenate([scores, self.scores[touched].ravel()]), np.concatenate([ids, self.ids[touched].ravel()])
        by = np.lexsort((ids, -scores, at))
        at = at[by]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        good = place < self.k
        self.scores[at[good], place[good]], self.ids[at[good], place[good]] = scores[by][good], ids[by][good]
        self.floor[touched] = np.maximum(self.floor[touched], self.scores[touched, self.k - 1])


def search_block(queries: Queries, best: Best, ids: np.ndarray, points: np.ndarray, nodes: np.ndarray, radii: np.ndarray, asked: np.ndarray | None = None) -> int:
    """Add a subtree's rows to the best of the queries (those of `asked`); the number of scores that were computed.

    A pair of a query group and a node is left out when no inner product between their balls reaches the worst
    kth score of the group: c . d + R |d| + r |c| + R r, for centres c and d with radii R and r. At a leaf each query is
    tried alone, by q . d + |q| r, and the rest is one product of matrices.
    """
    exact = np.sqrt((points**2).sum(axis=1).max(initial=0)) * np.sqrt((queries.vectors**2).sum(axis=1).max(initial=0)) < 2.0**52
    lengths = np.sqrt((queries.vectors**2).sum(axis=1))
    group_lengths = np.sqrt((queries.centres**2).sum(axis=1))
    present = np.ones(len(queries.ids), bool) if asked is None else asked
    stack, computed = [(0, np.unique(queries.group[present]))], 0
    while stack:
        at, groups = stack.pop()
        lo, hi, middle, child, children = nodes[at]
        centre, r = points[middle], radii[at]
        length = np.sqrt((centre**2).sum())
        worst = np.full(len(queries.centres), np.inf)
        np.minimum.at(worst, queries.group[present], best.floor[present].astype(np.float64))
        bound = queries.centres[groups] @ centre + queries.radii[groups] * length + r * group_lengths[groups] + queries.radii[groups] * r
        groups = groups[bound + 1 + 1e-9 * np.abs(bound) >= worst[groups]]  # 1 and more than the rounding
        if not len(groups):
            continue
        if children:
            stack += sorted(((int(c), groups) for c in range(child, child + children)), key=lambda x: float((queries.centres[groups] @ points[nodes[x[0], 2]]).max()))
            continue
        q = np.flatnonzero(present & np.isin(queries.group, groups))
        single = queries.vectors[q] @ centre + lengths[q] * r
        q = q[single + 1 + 1e-9 * np.abs(single) >= best.floor[q]]
        if not len(q):
            continue
        computed += len(q) * int(hi - lo)
        if exact:
            scores = (queries.vectors[q] @ points[lo:hi].T).astype(np.int64)
        else:
            wide = queries.vectors[q].astype(object) @ points[lo:hi].T.astype(object)
            if np.abs(wide).max() >= 1 << 63:
                raise OverflowError("a score passes 64 bits")
            scores = wide.astype(np.int64)
        row, col = np.nonzero((scores >= best.floor[q][:, None]) & (queries.ids[q][:, None] != ids[None, lo:hi]))
        if len(row):
            best.add(q[row], scores[row, col], ids[lo:hi][col])
    return computed


def _index(vectors: DataFrame, id_col: str, vec_col: str, is_query: Column, scale: float) -> DataFrame:
    """(cell, dim, kind, ids, asked, x, nodes, radii): all rows, queries and data together, as stored subtrees."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), is_query.alias("asked"), F.col(f"`{vec_col}`").alias("v")).filter("id is not null and v is not null")
    n = rows.count()
    share = min(1_000_000, -(-1_000_000 * SAMPLE // max(n, 1)))
    sample = [r.v for r in rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("v").limit(2 * SAMPLE).collect()]
    _, points = scaled(pa.array(sample, pa.list_(pa.float64())), scale)
    points = points.astype(np.float64)
    centres = points[farthest_first(points, min(CENTRES, max(1, n // SUBTREE)))[0]] if len(points) else np.zeros((1, 0))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matrix = scaled(batch.column(2), scale)
            if len(at):
                dim = max(matrix.shape[1], shared.value.shape[1])
                own, middle = widened(matrix, dim).astype(np.float64), widened(shared.value, dim)
                cell = ((middle**2).sum(axis=1) - 2 * own @ middle.T).argmin(axis=1)
                kind = narrowest(matrix)
                x = [r.tobytes() for r in matrix.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cell), pa.array([kind] * len(at)), pa.array(x, pa.binary())], names=["id", "asked", "cell", "kind", "x"])

    placed = rows.mapInArrow(place, "id bigint, asked boolean, cell bigint, kind string, x binary")
    placed, path = written(placed)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / SUBTREE).alias("parts"))  # CENTRES rows, at the most
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", "x"), F.col("parts"))).distinct()

    def subtree(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        own = [np.frombuffer(x, k) for x, k in zip(table["x"].to_pylist(), table["kind"].to_pylist())]
        dim = max(map(len, own), default=0)
        points = np.stack([np.append(x, np.zeros(dim - len(x), x.dtype)) for x in own]).astype(np.int64).reshape(len(own), dim)
        order, nodes, radii = build(points.astype(np.float64), ids)
        kind = narrowest(points)
        asked = table["asked"].to_numpy(zero_copy_only=False).astype(bool)[order]
        row = {"cell": table["cell"][0].as_py(), "dim": dim, "kind": kind, "ids": ids[order].tobytes(), "asked": asked.tobytes(), "x": points[order].astype(kind).tobytes(), "nodes": nodes.tobytes(), "radii": radii.tobytes()}
        return pa.Table.from_pylist([row], schema=names)

    names = pa.schema([("cell", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("ids", "asked", "x", "nodes", "radii"))])
    index, _ = written(dealt.groupBy("cell", "part").applyInArrow(subtree, "cell bigint, dim int, kind string, ids binary, asked binary, x binary, nodes binary, radii binary"))
    discard(vectors.sparkSession, path)
    return index


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(cell, ids, asked, points, nodes, radii) of each subtree of a batch."""
    for row in batch.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        points = np.frombuffer(row["x"], row["kind"]).reshape(len(ids), row["dim"]).astype(np.float64)
        yield row["cell"], ids, np.frombuffer(row["asked"], bool), points, np.frombuffer(row["nodes"], np.int64).reshape(-1, 5), np.frombuffer(row["radii"], np.float64)


def query_groups(index: DataFrame) -> DataFrame:
    """(cell, ids, dim, x, centre, radius): the queries of each leaf, with the ball that holds them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, ids, asked, points, nodes, _ in _blocks(batch):
                for lo, hi in nodes[nodes[:, 4] == 0, :2]:
                    at = lo + np.flatnonzero(asked[lo:hi])
                    if len(at):
                        centre = points[at].mean(axis=0)
                        radius = float(np.sqrt(((points[at] - centre) ** 2).sum(axis=1)).max())
                        row = {"cell": cell, "ids": ids[at].tobytes(), "dim": points.shape[1], "x": points[at].tobytes(), "centre": centre.tobytes(), "radius": radius}
                        yield pa.RecordBatch.from_pylist([row], schema=names)

    names = pa.schema([("cell", pa.int64()), ("ids", pa.binary()), ("dim", pa.int32()), ("x", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())])
    return index.mapInArrow(scan, "cell bigint, ids binary, dim int, x binary, centre binary, radius double")


def _gathered(groups: DataFrame, dim: int) -> Queries:
    rows = groups.collect()
    ids = [np.frombuffer(bytes(r.ids), np.int64) for r in rows]
    n = [len(x) for x in ids]
    as_wide = lambda x, own: widened(np.frombuffer(bytes(x)).reshape(-1, own), dim)
    return Queries(
        np.concatenate(ids), np.concatenate([as_wide(r.x, r.dim) for r in rows]), np.repeat([r.cell for r in rows], n), np.repeat(np.arange(len(rows)), n),
        np.concatenate([as_wide(r.centre, r.dim) for r in rows]), np.array([r.radius for r in rows]), np.full(sum(n), NONE),
    )


def _scan(index: DataFrame, shared: Broadcast, k: int, near: bool) -> DataFrame:
    """(q, vec_id, score): the k best of each query in each task; with `near`, in the subtrees of its own cell alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        best, dim = Best(queries, k), queries.vectors.shape[1]
        for batch in batches:
            for cell, ids, _, points, nodes, radii in _blocks(batch):
                asked = queries.cells == cell if near else None
                if asked is None or asked.any():
                    search_block(queries, best, ids, widened(points, dim), nodes, radii, asked)
        q, place = np.nonzero(best.ids < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.ids[q, place]), pa.array(best.scores[q, place])], names=["q", "vec_id", "score"])

    return index.mapInArrow(scan, "q bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, queries_a_pass: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k rows of the highest inner product, ties to the smaller id.

    Queries are the rows of `vectors` for which `is_query` holds; an entry x counts as floor(scale * x). All rows,
    queries and data, go into one cover tree: an upper level of up to 1,024 centres, a net of a bounded sample, and subtrees
    of about 4,096 rows under them, dealt by a hash where a centre has more, and written once. A query group is a leaf's
    queries. A pass takes about `queries_a_pass` of them, which are broadcast with their groups' balls: first each query
    meets its own centre's subtrees, which gives a floor for its kth score, then all subtrees are searched by pairs of nodes,
    and a task gives k rows for each query at the most. Results don't depend on the sample, the net or the passes.

    Vectors that are null or hold a null or non-finite entry take no part, nor do rows without an id; shorter vectors
    count as filled up with zeros. Rows that repeat both id and vector are one row; a query's own rows are those with its id, so
    that of rows that repeat an id with other vectors each is a query. Extra columns are ignored. A query with fewer than k
    other rows has them all; an empty table gives an empty result. A score beyond 64 bits raises an error.
    """
    spark = vectors.sparkSession
    index = _index(vectors, id_col, vec_col, is_query, scale)
    groups, path = written(query_groups(index))
    size = groups.agg(F.sum(F.length("ids") / 8), F.max("dim")).first()
    dim = max(size[1] or 0, index.agg(F.max("dim")).first()[0] or 0)
    passes = -(-int(size[0] or 0) // queries_a_pass)
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    by_query = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    found = None
    for i in range(passes):
        queries = _gathered(groups.filter(F.pmod(F.xxhash64("cell", "ids"), F.lit(passes)) == i), dim) if passes else None
        if not len(queries.ids):
            continue
        near = _scan(index, spark.sparkContext.broadcast(queries), k, True).withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k)
        for row in near.select("q", "score").collect():
            queries.floor[row.q] = row.score
        ids = spark.createDataFrame(list(enumerate(queries.ids.tolist())), "q bigint, query_id bigint")  # queries_a_pass rows
        part = checkpoint(_scan(index, spark.sparkContext.broadcast(queries), k, False).join(F.broadcast(ids), "q").withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k))
        found = part if found is None else found.unionByName(part)
    discard(spark, path)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return found.select("query_id", "rank", "vec_id", "score")
