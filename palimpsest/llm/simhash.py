"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are grouped under a leading masked pattern (one of four 16-bit blocks must be equal when at
most three bits differ), each group is sorted by Gray rank, and a tree of shared bit patterns is built over
the sorted run: a node holds the bits on which everything below it agrees. A search goes down the tree,
adds up the differences on the bits that each node newly fixes, and drops a whole subtree once the sum
exceeds the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, field, renamed, row_hash, utf8
from .components import connected_components

MAX_DIFF = 3
SHINGLE = 3
SEED = 42
FANOUT = 8
#: Distinct fingerprints under one masked pattern before it is split by further blocks.
MAX_GROUP = 20_000
#: Widths of the four blocks at each level; five levels leave at most 2**16 values under one pattern.
LEVELS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6), (5, 5, 5, 6))


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, lower-cased in A-Z; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n, votes = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])), np.uint64, n)
    for part in np.array_split(hashes, n // 50_000 + 1):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint's bits as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, utf8(text_col)).mapInArrow(scan, f"{field(docs, id_col)}, fp bigint")


def gray_rank(code: Column) -> Column:
    """The position of a 64-bit code in Gray order (the inverse of x ^ x >> 1)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _under_patterns(nodes: DataFrame, max_group: int) -> DataFrame:
    """(path, fp, rep) rows under masked patterns: any two fingerprints that link share a path.

    A pattern with more than max_group members is split by a block of its remaining bits, again and again;
    three differences leave one of four blocks equal, so no pair is lost.
    """
    ready, rows = None, nodes.select(F.array().cast("array<bigint>").alias("path"), F.col("fp").alias("rest"), "fp", "rep")
    for level, widths in enumerate(LEVELS):
        shifts = [sum(widths[:i]) for i in range(len(widths))]
        low = lambda n: F.lit((1 << n) - 1)
        options = [
            F.struct(
                F.lit(i).cast("bigint").alias("block"),
                F.shiftrightunsigned("rest", s).bitwiseAND(low(w)).alias("value"),
                F.shiftleft(F.shiftrightunsigned("rest", s + w) if s + w < 64 else F.lit(0).cast("bigint"), s).bitwiseOR(F.col("rest").bitwiseAND(low(s))).alias("left"),
            )
            for i, (s, w) in enumerate(zip(shifts, widths))
        ]
        rows = rows.withColumn("o", F.explode(F.array(*options))).select(
            F.concat("path", F.array("o.block", "o.value")).alias("path"), F.col("o.left").alias("rest"), "fp", "rep"
        )
        if level + 1 == len(LEVELS):
            break
        large = rows.groupBy("path").count().filter(F.col("count") > max_group).select("path")
        if large.isEmpty():
            break
        large = checkpoint(large)
        small = rows.join(large, "path", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        rows = rows.join(large, "path", "left_semi")
    rows = rows if ready is None else ready.unionByName(rows)
    block = F.element_at("path", 1)
    turned = F.shiftrightunsigned("fp", 0)
    for i in (1, 2, 3):
        turned = F.when(block == i, F.shiftrightunsigned("fp", 16 * i).bitwiseOR(F.shiftleft("fp", 64 - 16 * i))).otherwise(turned)
    return rows.select("path", gray_rank(turned).alias("rank"), "fp", "rep")


class GrayTree:
    """Nodes over runs of fingerprints that are sorted by group and Gray rank; one root for each group.

    Level 0 is the fingerprints. A node covers up to FANOUT nodes below it; `mask` holds the bits that all
    of them share, `bits` their values, `first`/`last` the range of leaves.
    """

    def __init__(self, fps: np.ndarray, starts: np.ndarray):
        n = len(fps)
        group = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        both, any_, first, last = fps, fps, np.arange(n), np.arange(n)
        self.levels = [(np.full(n, ~np.uint64(0)), fps, first, last, None)]
        while len(both) > len(starts):
            head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(head, np.diff([*head, len(group)]))
            cut = np.flatnonzero(place % FANOUT == 0)
            both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)
            last = last[np.r_[cut[1:] - 1, len(group) - 1]]
            first, group = first[cut], group[cut]
            self.levels.append((~(both ^ any_), both, first, last, np.r_[cut, len(place)]))
        self.group = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
        self.fps = fps

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf), leaf after the query in its group, at `limit` differing bits or fewer."""
        mask, bits, _, last, kids = self.levels[-1]
        q, node = queries, self.group[queries]
        diff = np.bitwise_count((self.fps[q] ^ bits[node]) & mask[node]).astype(np.int16)
        keep = (diff <= limit) & (last[node] > q)
        q, node, diff = q[keep], node[keep], diff[keep]
        for up, down in zip(self.levels[:0:-1], self.levels[-2::-1]):
            n = up[4][node + 1] - up[4][node]
            child = np.repeat(up[4][node] - np.r_[0, np.cumsum(n)[:-1]].astype(np.int64), n) + np.arange(n.sum())
            q, fixed, diff = np.repeat(q, n), np.repeat(up[0][node], n), np.repeat(diff, n)
            diff = diff + np.bitwise_count((self.fps[q] ^ down[1][child]) & down[0][child] & ~fixed)
            keep = (diff <= limit) & (down[3][child] > q)
            q, node, diff = q[keep], child[keep], diff[keep]
        return q, node


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a[i] and b[i] in place; a label is the smallest row of its set."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _links(rows: DataFrame, limit: int) -> DataFrame:
    """(u, v) edges between representatives: a spanning star for each linked set under a pattern."""

    def linked(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tree, label = GrayTree(fps, starts), np.arange(len(fps))
        sizes = np.diff([*starts, len(fps)])
        reach = np.cumsum(np.repeat(sizes, sizes))
        cuts = np.searchsorted(reach, np.arange(2_000_000, int(reach[-1]) + 2_000_000, 2_000_000), side="left") + 1
        begin = 0
        for end in np.unique(np.minimum(cuts, len(fps))):
            _join_labels(label, *tree.search(np.arange(begin, end), limit))
            begin = end
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return label[moved], moved

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(block: pa.Table) -> Iterator[pa.RecordBatch]:
            if not block.num_rows:
                return
            path, fps = block.column(0).to_numpy(), block.column(1).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            alone = np.diff([*starts, len(path)]) == 1
            if alone.all():
                return
            keep = ~np.repeat(alone, np.diff([*starts, len(path)]))
            path, fps, reps = path[keep], fps[keep], block.column(2).filter(pa.array(keep)).combine_chunks()
            u, v = linked(fps, np.flatnonzero(np.r_[True, path[1:] != path[:-1]]))
            if len(u):
                yield pa.RecordBatch.from_arrays([reps.take(pa.array(u)), reps.take(pa.array(v))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            block = pa.Table.from_batches(held)
            path = block.column(0).to_numpy()
            whole = int(np.searchsorted(-(path != path[-1]).astype(np.int8), 0)) if path[0] != path[-1] else 0
            yield from flush(block.slice(0, whole))
            held = block.slice(whole).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    key = rows.select(F.xxhash64("path").alias("key"), "path", "rank", "fp", "rep")
    ordered = key.repartition("path").sortWithinPartitions("key", "path", "rank", "fp").select("key", "fp", "rep")
    return ordered.mapInArrow(scan, f"{field(rows, 'rep', 'u')}, {field(rows, 'rep', 'v')}")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF, max_group: int = MAX_GROUP) -> DataFrame:
    """(id, fingerprint, component_id): one row per document.

    Documents link when their fingerprints differ in at most max_diff (0 to 3) bits; component_id is the
    smallest id reachable over links. Equal fingerprints form one class with its smallest id standing for
    all, so copies are never paired with each other.

    Null or wordless text: fingerprint zero, linked like any other. A null id links nothing by itself: the
    row takes the component of its fingerprint's class, null when the class has no id. Repeated rows each
    keep a row; different texts under one id are not linked by it. Texts are read whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    marks, classes = _classes(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), max_diff, max_group)
    return marks.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _classes(docs: DataFrame, max_diff: int, max_group: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row of docs (id, text), and (fp, component, component_id) of each fingerprint.

    Fingerprints are the nodes, so that texts that share an id are not linked by it. `component` is the smallest
    fingerprint reachable, component_id the smallest id of all of them.
    """
    if not 0 <= max_diff <= 3:
        raise ValueError("max_diff must be from 0 to 3: four blocks leave one equal for three differences")
    marks = checkpoint(fingerprints(docs, "id"))
    classes = checkpoint(marks.groupBy("fp").agg(F.min("id").alias("low")))
    nodes = classes.filter("low is not null").select("fp", F.col("fp").alias("rep"))
    labels = connected_components(_links(_under_patterns(nodes, max_group), max_diff)).withColumnRenamed("node", "fp")
    named = checkpoint(classes.join(labels, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    return marks, named.join(lowest, "component").select("fp", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_diff: int = MAX_DIFF, max_group: int = MAX_GROUP) -> DataFrame:
    """One document of each component of fingerprints, with its columns, whatever these are named: the one with the smallest id.

    Of rows of a component that share that id one stays, whatever their texts; rows that share an id but no
    component are told apart. Documents without an id stay: nothing tells which of them a group should keep.
    Null and wordless texts are one group. An empty table gives an empty result. Texts are read whole.
    """
    inner, names = renamed(docs)
    doc = F.col(names[id_col])
    rows = inner.filter(doc.isNotNull()).withColumns({"id": doc, "tag": F.xxhash64(F.col(names[text_col]).cast("string"))})
    texts = rows.select(F.struct("id", "tag").alias("id"), F.col(names[text_col]).alias("text"))
    marks, classes = _classes(texts, max_diff, max_group)
    kept = marks.join(classes, "fp").groupBy("component").agg(F.min("id").alias("first")).select(F.col("first.id").alias("id"), F.col("first.tag").alias("tag"))
    of_text = Window.partitionBy("id", "tag").orderBy("hash")
    one = rows.join(kept, ["id", "tag"], "left_semi").withColumn("hash", row_hash(inner)).withColumn("copy", F.row_number().over(of_text))
    return one.filter("copy = 1").select(*names.values()).unionByName(inner.filter(doc.isNull())).toDF(*docs.columns)
