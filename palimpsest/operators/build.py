"""The chunk build as one job: paragraphs or pages in, stored chunks with vectors and stored centroids out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import cut
from ..functions.text import embedding_input, hashed_words
from ..functions.vectors import centroids
from .chunking import KEY, clean_paragraphs, drop_page_range, merge_form_options, merge_incomplete, merge_tiny, pack, paged_chunks, split_oversized
from .store import BucketStore

CHUNKS = "chunk_index int, chunk_text string, start_page int, end_page int, character_count bigint, embedding array<double>"
CENTROIDS = "mode string, chunk_count bigint, effective_chunk_count bigint, centroid array<double>"


def embedder(dim: int = 64) -> Callable[[Column], Column]:
    """The default plug-in: hashed word counts of unit length, in Arrow batches. Any pandas UDF from a text to an array of doubles will do."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hashed_words(t, dim) for t in texts], dtype=object)

    return embed


def numbered(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with idx counted anew from 0, after some have been left out."""
    return paragraphs.withColumn("idx", F.row_number().over(Window.partitionBy(KEY).orderBy("idx")) - 1)


def chunks_by_mode(pages: DataFrame, paragraphs: DataFrame, excluded: DataFrame, limit: int = 1000, least: int = 80) -> DataFrame:
    """(document_id, mode, chunk_index, chunk_text, start_page, end_page, character_count): by paragraphs where a document has any, else by sentences.

    `paragraphs` has (document_id, idx, page_number, text), `pages` (document_id, page_number, text), `excluded` page ranges
    (document_id, low, high), which are left out of both; a range that would leave nothing is ignored. Sentence chunks don't overlap.
    """
    kept = numbered(drop_page_range(paragraphs, excluded))
    by_paragraph = pack(split_oversized(merge_tiny(merge_incomplete(clean_paragraphs(merge_form_options(kept, limit)), limit), least, limit), limit), limit)
    rest = drop_page_range(pages.join(paragraphs.select(KEY).distinct(), KEY, "left_anti"), excluded)
    by_sentence = paged_chunks(rest, overlap=0, limit=limit)
    cols = [F.col(c).cast(t).alias(c) for c, t in (("chunk_index", "int"), ("chunk_text", "string"), ("start_page", "int"), ("end_page", "int"), ("character_count", "bigint"))]
    named = lambda rows, mode: rows.select(KEY, F.lit(mode).alias("mode"), *cols)
    return named(by_paragraph, "paragraphs").unionByName(named(by_sentence, "sentences"))


@dataclass(frozen=True)
class ChunkBuild:
    """The job over two stores, `chunks` and `centroids`, both by document.

    A run takes the documents that have no row in `centroids`, which is written last: chunks are made, embedded, put in place of the document's
    old ones, and their centroids stored. So a run that was stopped anywhere is finished by the next, chunks that were stored already are
    not written again, and documents that are done are not read again. `again` (document_id) names documents to build anew.
    """

    chunks: BucketStore
    centroids: BucketStore
    embed: Callable[[Column], Column]

    @classmethod
    def at(cls, spark: SparkSession, path: str, key_type: str = "bigint", embed: Callable[[Column], Column] | None = None, buckets: int = 16) -> ChunkBuild:
        store = lambda name, columns: BucketStore(spark, f"{path}/{name}", StructType.fromDDL(f"{KEY} {key_type}, {columns}"), KEY, buckets)
        return cls(store("chunks", CHUNKS), store("centroids", CENTROIDS), embed or embedder())

    def run(self, pages: DataFrame, paragraphs: DataFrame, excluded: DataFrame, again: DataFrame | None = None, limit: int = 1000, least: int = 80) -> int:
        """Build what is not built yet; the number of documents."""
        done = self.centroids.read().select(KEY)
        if again is not None:
            done = done.join(again.select(KEY).distinct(), KEY, "left_anti")
        todo = cut(pages.select(KEY).unionByName(paragraphs.select(KEY)).distinct().join(done, KEY, "left_anti"))
        if not (n := todo.count()):
            return 0
        own = lambda rows: rows.join(todo, KEY, "left_semi")
        made = chunks_by_mode(own(pages), own(paragraphs), excluded, limit, least)
        prepared = F.nullif(embedding_input(F.col("chunk_text")), F.lit(""))
        made = cut(made.withColumn("embedding", self.embed(prepared)))
        self.chunks.replace(made, todo)
        counts = made.groupBy(KEY).agg(F.max("mode").alias("mode"), F.count("*").alias("chunk_count"))
        figures = todo.join(counts, KEY, "left").join(centroids(made), KEY, "left").fillna(0, ["chunk_count", "effective_chunk_count"])
        self.centroids.replace(figures)
        return n
