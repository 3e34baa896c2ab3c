"""Vector search: exact neighbours in blocks, candidate retrieval, prefilter, inverted-file search, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_folder
from ..functions.vectors import Tops, stacked
from .index import InvertedFile

#: Query vectors in one broadcast block, and neighbours that a task keeps for a block's queries together, at the most.
BLOCK, KEPT = 2048, 1 << 20


def nearest(queries: DataFrame, vectors: DataFrame, k: int, min_score: float | None = None, block: int = BLOCK, owner: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): each query's k nearest rows of `vectors` by dot product.

    `queries` (query_id, vector) is a stated set; it is taken in blocks of `block` rows, fewer where k is large, each broadcast once
    and multiplied with the Arrow batches of `vectors` (vec_id, vector) in tiles. A task gives no more than k rows for
    each query, so the ranking shuffles k rows for a query and task and never a pair table. Ties: smaller id.
    With `owner`, a column of both, rows of the query's own owner are left out. Null and non-finite vectors take no part.
    """
    spark, more = queries.sparkSession, [owner] if owner else []
    queries = cut(queries.select("query_id", "vector", *more))  # read once for each block
    block = max(1, min(block, KEPT // max(1, k)))
    n_blocks = max(1, -(-queries.count() // block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    found = None
    for i in range(n_blocks):
        rows = pd.DataFrame(dealt.filter(F.col("block") == i).collect(), columns=dealt.columns)
        at, matrix = stacked(rows.vector)
        ids = rows.query_id.to_numpy(np.int64)[at]
        shared = spark.sparkContext.broadcast((ids, matrix, rows[owner].to_numpy()[at] if owner else None))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix, owners = shared.value
            if not len(ids):
                return
            tops = Tops(matrix, k, -np.inf if min_score is None else min_score, owners)
            for batch in batches:
                for lo in range(0, len(batch), Tops.ROWS):
                    piece = batch.iloc[lo : lo + Tops.ROWS]
                    at, held = stacked(piece.vector)
                    if len(at):
                        tops.add(piece.vec_id.to_numpy(np.int64)[at], held, piece[owner].to_numpy()[at] if owner else None)
            for place, own, scores in tops.each():
                yield pd.DataFrame({"query_id": ids[place], "vec_id": own, "score": scores})

        part = vectors.select("vec_id", "vector", *more).mapInPandas(scan, "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def near_documents(sources: DataFrame, chunks: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(source_id, target_id): documents of which one has a chunk among `sources` and the other a chunk with a dot product of `threshold` or more.

    The chunks of `sources`, a stated set, are broadcast in blocks and multiplied with the batches of `chunks`; a batch gives
    each pair of documents once, and no other pair becomes a row. A document is not paired with itself.
    """
    spark = sources.sparkSession
    held = cut(sources.select("vec_id", "document_id", "embedding"))
    n_blocks, found = max(1, -(-held.count() // block)), None
    kind = sources.schema["document_id"].dataType.simpleString()
    for i in range(n_blocks):
        rows = pd.DataFrame(held.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).collect(), columns=held.columns)
        at, matrix = stacked(rows.embedding)
        shared = spark.sparkContext.broadcast((rows.document_id.to_numpy()[at], matrix.T))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            owners, matrix = shared.value
            for batch in batches:
                at, own = stacked(batch.embedding)
                if len(at) and len(owners):
                    row, col = np.nonzero(own @ matrix >= threshold)
                    pairs = pd.DataFrame({"source_id": owners[col], "target_id": batch.document_id.to_numpy()[at][row]}).drop_duplicates()
                    yield pairs[pairs.source_id != pairs.target_id]

        part = chunks.select("document_id", "embedding").mapInPandas(scan, f"source_id {kind}, target_id {kind}")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def stage0_candidates(sources: DataFrame, chunks: DataFrame, top_k: int = 600) -> DataFrame:
    """(source_id, document_id, score, rank): documents by their best chunk against a source's centroid.

    Takes the 2 * top_k best chunks of other documents, then each document's maximum. `sources` has
    (document_id, centroid), `chunks` (vec_id, document_id, embedding).
    """
    queries = sources.select(F.col("document_id").alias("query_id"), "document_id", F.col("centroid").alias("vector"))
    hits = nearest(queries, chunks.select("vec_id", "document_id", F.col("embedding").alias("vector")), 2 * top_k, owner="document_id")
    best = hits.join(chunks.select("vec_id", "document_id"), "vec_id").groupBy(F.col("query_id").alias("source_id"), "document_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("source_id").orderBy(F.desc("score"), "document_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def neighbours_per_chunk(candidates: int) -> int:
    return 36 if candidates <= 400 else 45 if candidates <= 600 else 54 if candidates <= 800 else 60


def stage1_prefilter(source_chunks: DataFrame, chunks: DataFrame, candidates: DataFrame, k: int = 36, top_k: int = 250, least: int = 1) -> DataFrame:
    """(source_id, document_id, matched_chunks, rank): candidates by distinct source chunks that they are near.

    Neighbours are taken over the whole index, source chunks and foreign documents included, before the
    candidates are looked up among them. Those with fewer than `least` matched chunks go.
    """
    queries = source_chunks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = nearest(queries, chunks.select("vec_id", F.col("embedding").alias("vector")), k)
    named = (
        hits.join(chunks.select("vec_id", "document_id"), "vec_id")
        .join(source_chunks.select(F.col("vec_id").alias("query_id"), F.col("document_id").alias("source_id")), "query_id")
        .join(candidates.select("source_id", "document_id"), ["source_id", "document_id"], "left_semi")
    )
    counted = named.groupBy("source_id", "document_id").agg(F.countDistinct("query_id").alias("matched_chunks")).filter(F.col("matched_chunks") >= least)
    order = Window.partitionBy("source_id").orderBy(F.desc("matched_chunks"), "document_id")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def search_candidates(sources: DataFrame, chunks: DataFrame, top_k: int = 600, keep: int = 250, allowed: Column | None = None, found: DataFrame | None = None) -> DataFrame:
    """(source_id, document_id): stage 0, and stage 1 for the sources that it leaves more than `keep` candidates.

    Stage 1's neighbours for each chunk follow a source's number of candidates, so its sources are taken in
    groups of like number, four at most. `allowed`, a filter of chunks, bounds stage 0 alone: stage 1 looks its
    candidates up among the neighbours in the whole index. `found` is stage 0's result where it is there already.
    """
    found = found.select("source_id", "document_id") if found is not None else cut(stage0_candidates(sources, chunks if allowed is None else chunks.filter(allowed), top_k).select("source_id", "document_id"))
    sizes = found.groupBy("source_id").count()
    out = found.join(sizes.filter(F.col("count") <= keep), "source_id", "left_semi")
    groups: dict[int, list[int]] = {}
    for n in [r["count"] for r in sizes.filter(F.col("count") > keep).select("count").distinct().collect()]:
        groups.setdefault(neighbours_per_chunk(n), []).append(n)
    for k, counts in sorted(groups.items()):
        many = sizes.filter(F.col("count").isin(counts)).select("source_id")
        own = chunks.join(many.withColumnRenamed("source_id", "document_id"), "document_id", "left_semi")
        out = out.unionByName(stage1_prefilter(own, chunks, found.join(many, "source_id", "left_semi"), k, keep).select("source_id", "document_id"))
    return out


def rank_fusion(lists: list[DataFrame], k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, id, score) from ranked lists (*by, id, rank): the sum of 1 / (k + rank)."""
    rows = lists[0].select(*by, "id", "rank")
    for more in lists[1:]:
        rows = rows.unionByName(more.select(*by, "id", "rank"))
    return rows.groupBy(*by, "id").agg(F.sum(1.0 / (F.col("rank") + k)).alias("score"))


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int, cells: int | None = None, probes: int = 16, copies: int = 4, path: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): nearest among the vectors in the `probes` cells nearest to a query.

    The vectors go to an inverted file under `path`, or in the shared folder; see index.InvertedFile, which a second search opens.
    """
    return InvertedFile.build(vectors, path or shared_folder(queries.sparkSession), cells, copies).nearest(queries, k, probes)
