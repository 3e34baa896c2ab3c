"""Reports with their bounds: jobs and health of a period, users, documents, page spans, reconciled counts, scans and matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import nonspace_length
from ..functions.vectors import finite, stacked
from .activity import count_if, health, since
from .catalog import search_titles
from .search import BLOCK, nearest


def counts_map(rows: DataFrame, key: str, name: str, alias: str) -> DataFrame:
    """(key, alias): a map from each value of `name` to its number of rows, in order; few values a key."""
    counted = rows.groupBy(key, name).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(name).alias("k"), "n")))).alias(alias))


def job_performance(jobs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(processing_method, status, day, job_count, times, avg_attempts, error_count) of the jobs created in the last `days` days."""
    took = F.col("processing_time_ms")
    return jobs.filter(since("created_at", as_of, days)).groupBy("processing_method", "status", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("job_count"), F.avg(took).alias("avg_ms"), F.min(took).alias("min_ms"), F.max(took).alias("max_ms"), F.avg("attempts").alias("avg_attempts"), count_if(F.col("status") == "error").alias("error_count")
    )


def recent_health(components: dict[str, DataFrame], as_of: str, days: int = 1) -> DataFrame:
    """`activity.health` of the rows created in the last `days` days."""
    return health({name: rows.filter(since("created_at", as_of, days)) for name, rows in components.items()})


def user_stats(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(user_id, total_documents, by_status, by_type, storage_mb, one count for each child table): a user's documents; a null type is `unknown`.

    `children` are tables with a document_id; each is counted by document before it meets the documents.
    """
    typed = documents.withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    out = typed.groupBy("user_id").agg(F.count("*").alias("total_documents"), F.round(F.sum("file_size") / 1048576.0, 2).alias("storage_mb"))
    out = out.join(counts_map(typed, "user_id", "status", "by_status"), "user_id").join(counts_map(typed, "user_id", "document_type", "by_type"), "user_id")
    for name, rows in children.items():
        each = rows.groupBy("document_id").agg(F.count("*").alias("n")).join(documents.select("document_id", "user_id"), "document_id")
        out = out.join(each.groupBy("user_id").agg(F.sum("n").alias(name)), "user_id", "left").fillna(0, [name])
    return out


def document_summary(documents: DataFrame, children: dict[str, DataFrame], entities: DataFrame, jobs: DataFrame) -> DataFrame:
    """documents with a count for each child table, entities_by_type, and latest_jobs, the newest job's status of each type."""
    out = documents
    for name, rows in children.items():
        out = out.join(rows.groupBy("document_id").agg(F.count("*").alias(name)), "document_id", "left").fillna(0, [name])
    newest = jobs.groupBy("document_id", "job_type").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"))
    latest = newest.groupBy("document_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("job_type", "status")))).alias("latest_jobs"))
    return out.join(counts_map(entities, "document_id", "type", "entities_by_type"), "document_id", "left").join(latest, "document_id", "left")


def span_profile(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, n_chunks, n_ranged, coverage_percent, single_page, multi_page, max_span): how many chunks have a page range, and of what length."""
    span = F.when(F.col("start_page").isNotNull() & F.col("end_page").isNotNull(), F.col("end_page") - F.col("start_page") + 1)
    out = chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.count(span).alias("n_ranged"), count_if(span == 1).alias("single_page"), count_if(span > 1).alias("multi_page"), F.max(span).alias("max_span"))
    return out.withColumn("coverage_percent", F.round(F.col("n_ranged") * 100.0 / F.col("n_chunks"), 2))


def predicate_gain(rows: DataFrame, old: Column, new: Column, by: str) -> DataFrame:
    """(by, n_old, n_new, only_old, only_new, gain_percent): what a filter finds beside the one before, from one scan; no gain is told of nothing."""
    a, b = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    out = rows.groupBy(by).agg(count_if(a).alias("n_old"), count_if(b).alias("n_new"), count_if(a & ~b).alias("only_old"), count_if(b & ~a).alias("only_new"))
    return out.withColumn("gain_percent", F.round(F.try_divide((F.col("n_new") - F.col("n_old")) * 100.0, F.col("n_old")), 2))


def reconciled(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, expected, stored, delta, place): `catalog.reconcile` in order of the largest difference, and a row of totals, whose key is null, at place 0."""
    from .catalog import reconcile

    rows = reconcile(expected, stored, key)
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("delta")), key)))
    totals = rows.agg(*(F.sum(c).alias(c) for c in ("expected", "stored", "delta"))).select(F.lit(None).cast(rows.schema[key].dataType).alias(key), "expected", "stored", "delta", F.lit(0).alias("place"))
    return placed.unionByName(totals)


def unmatched(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, target_id, side, chunk_index): chunks of either side that no match of the pair holds."""
    pairs = cut(matches.select("source_id", "target_id").distinct())
    out = None
    for side, key, index in (("source", "source_id", "a_index"), ("target", "target_id", "b_index")):
        own = pairs.join(chunks.select(F.col("document_id").alias(key), "chunk_index"), key)
        taken = matches.select("source_id", "target_id", F.col(index).alias("chunk_index")).distinct()
        left = own.join(taken, ["source_id", "target_id", "chunk_index"], "left_anti").select("source_id", "target_id", F.lit(side).alias("side"), "chunk_index")
        out = left if out is None else out.unionByName(left)
    return out


def cleaned_logs(logs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """logs (id, action_type, resource_type, metadata, api_endpoint, logged_at) less those older than `days` days, and a row that tells how many went.

    The count comes with the same scan that filters. A row without a time stays.
    """
    old = F.coalesce(~since("logged_at", as_of, days), F.lit(False))
    gone = logs.filter(old).agg(F.count("*").alias("deleted_count"))
    audit = gone.select(
        F.lit(None).cast(logs.schema["id"].dataType).alias("id"), F.lit("cleanup").alias("action_type"), F.lit("activity_log").alias("resource_type"), F.to_json(F.struct("deleted_count")).alias("metadata"),
        F.lit("system_maintenance").alias("api_endpoint"), F.lit(as_of).cast(logs.schema["logged_at"].dataType).alias("logged_at"),
    )
    return logs.filter(~old).select(*audit.columns).unionByName(audit)


def refresh_marked(documents: DataFrame, stale: DataFrame) -> DataFrame:
    """documents (document_id, status, metadata) with the stale ones pending and flagged in their JSON metadata."""
    from .catalog import merge_json

    joined = documents.join(stale.select("document_id", F.lit(True).alias("__stale")).distinct(), "document_id", "left")
    hit = F.col("__stale").isNotNull()
    flagged = merge_json(F.col("metadata"), F.lit('{"embedding_refresh":"true"}'))
    return joined.withColumns({"status": F.when(hit, "pending").otherwise(F.col("status")), "metadata": F.when(hit, flagged).otherwise(F.col("metadata"))}).drop("__stale")


def scan_chunks(rows: DataFrame, text: str = "chunk_text", vector: str = "embedding") -> DataFrame:
    """The chunks of documents as a search takes them: (document_id, chunk_index, page_number, character_count, embedding).

    Without an index a row is left out, of rows that repeat one the first by id stays; vectors may be JSON text; one that is no list of
    finite numbers is left out; the page is 1 by default; the length is the stored one, else that of the text without spaces, else 1.
    """
    numbers = F.from_json(F.col(vector), "array<double>") if rows.schema[vector].dataType.simpleString() == "string" else F.col(vector).cast("array<double>")
    length = nonspace_length(F.col(text)) if text in rows.columns else F.lit(None)
    chars = F.coalesce(F.nullif(F.col("character_count").cast("bigint"), F.lit(0)), F.nullif(length.cast("bigint"), F.lit(0)), F.lit(1))
    order = Window.partitionBy("document_id", "chunk_index").orderBy("vec_id")
    first = rows.filter("chunk_index is not null").withColumn("__rn", F.row_number().over(order)).filter("__rn = 1")
    shaped = first.select("document_id", "chunk_index", F.coalesce("page_number", F.lit(1)).alias("page_number"), chars.alias("character_count"), numbers.alias("embedding"))
    return shaped.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite(F.col("embedding")))


def effective_counts(rows: DataFrame, text: str = "chunk_text", vector: str = "embedding") -> DataFrame:
    """(document_id, effective_chunk_count, total_characters): usable vectors, and stored lengths or else those of the texts without spaces."""
    usable = F.col(vector).isNotNull() & finite(F.col(vector))
    return rows.groupBy("document_id").agg(count_if(usable).alias("effective_chunk_count"), F.sum(F.coalesce(F.col("character_count").cast("bigint"), nonspace_length(F.col(text)).cast("bigint"), F.lit(0))).alias("total_characters"))


def match_chunks(queries: DataFrame, chunks: DataFrame, columns: tuple[str, ...], threshold: float = 0.78, most: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): chunks over the threshold by the first of their vector columns that is filled, nearest first.

    A query (query_id, vector, document_id) with a document looks among its chunks alone, one without among all.
    """
    held = chunks.select("vec_id", "document_id", F.coalesce(*columns).alias("vector")).filter("vector is not null")
    free = nearest(queries.filter("document_id is null").select("query_id", "vector"), held, most, threshold)
    kind = "query_id bigint, vec_id bigint, score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = np.stack(batch.q.to_list()).astype(np.float64), np.stack(batch.v.to_list()).astype(np.float64)
            yield batch[["query_id", "vec_id"]].assign(score=(a * b).sum(axis=1))

    bound = queries.filter("document_id is not null").select("query_id", "document_id", F.col("vector").alias("q"))
    own = bound.join(held.filter(finite(F.col("vector"))).withColumnRenamed("vector", "v"), "document_id").select("query_id", "vec_id", "q", "v").mapInPandas(score, kind)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = free.select("query_id", "vec_id", "score").unionByName(own).filter(F.col("score") > threshold)
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def fingerprint_neighbours(prints: DataFrame, queries: DataFrame, most: int = 5, least: float = 0.1, block: int = BLOCK) -> DataFrame:
    """(query_id, document_id, filename, similarity_score, content_similarity, rank): a user's completed documents most like each query's.

    Prints have (document_id, user_id, status, filename, v of unit length, n_sections), queries the same. The score is 0.7 of the
    cosine and 0.3 of the ratio of section counts (1 if both are 0, 0 if one is). Queries, a stated set, are broadcast in blocks, and a batch
    of prints gives no more than `most` rows for each.
    """
    spark = prints.sparkSession
    held = cut(queries.select(F.col("document_id").alias("query_id"), "user_id", "v", "n_sections"))
    n_blocks, found = max(1, -(-held.count() // block)), None
    for i in range(n_blocks):
        rows = pd.DataFrame(held.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == i).collect(), columns=held.columns)
        at, matrix = stacked(rows.v)
        shared = spark.sparkContext.broadcast((rows.iloc[at].reset_index(drop=True), matrix.T))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            asked, matrix = shared.value
            for batch in batches:
                at, own = stacked(batch.v)
                if not len(at) or not len(asked):
                    continue
                part = batch.iloc[at]
                content = own @ matrix
                a, b = part.n_sections.to_numpy(np.float64)[:, None], asked.n_sections.to_numpy(np.float64)
                shape = np.where((a == 0) & (b == 0), 1.0, np.minimum(a, b) / np.maximum(np.maximum(a, b), 1))
                score = 0.7 * content + 0.3 * shape
                score[(part.user_id.to_numpy()[:, None] != asked.user_id.to_numpy()) | (part.document_id.to_numpy()[:, None] == asked.query_id.to_numpy())] = -np.inf
                score[score < least] = -np.inf
                order = np.lexsort((np.broadcast_to(part.document_id.to_numpy()[:, None], score.shape), -score), axis=0)[:most]
                pick = lambda x: np.take_along_axis(x, order, axis=0).ravel()
                out = pd.DataFrame({"query_id": np.tile(asked.query_id, len(order)), "document_id": part.document_id.to_numpy()[order].ravel(), "filename": part.filename.to_numpy()[order].ravel(), "similarity_score": pick(score), "content_similarity": pick(content)})
                yield out[out.similarity_score > -np.inf]

        part = prints.filter("status = 'completed'").select("document_id", "user_id", "filename", "v", "n_sections").mapInPandas(scan, "query_id bigint, document_id bigint, filename string, similarity_score double, content_similarity double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity_score"), "document_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def form_field_search(fields: DataFrame, documents: DataFrame, text: str, owner: object = None) -> DataFrame:
    """Fields whose name, value or label contains the text, with their document's file name; an owner's alone if one is given.

    `place` is the order: surest first, unknown confidence last, newest document first among equals.
    """
    own = documents if owner is None else documents.filter(F.col("user_id") == owner)
    found = fields.filter(search_titles(text, ("field_name", "field_value", "field_label"))).join(own.select("document_id", "filename", "created_at"), "document_id")
    order = Window.orderBy(F.desc_nulls_last("confidence_score"), F.desc("created_at"), "document_id", "field_name")
    return found.withColumn("place", F.row_number().over(order))


#: Fixed values by strategy: most pages a batch, least pages a batch, pages divided by, batches at once, milliseconds between, chunking, prefetching, asynchronous, priority.
PROCESSING = {
    "fast-track": (10, None, 1, 10, 0, "standard", True, False, "critical"),
    "standard": (25, None, 1, 8, 50, "standard", True, False, "high"),
    "optimized": (30, 10, 3, 6, 100, "memory-optimized", True, True, "normal"),
    "batch-optimized": (20, 5, 5, 4, 200, "memory-optimized", False, True, "normal"),
    "enterprise-batch": (15, 3, 8, 3, 300, "streaming", False, True, "low"),
    "streaming-batch": (10, 2, 12, 2, 500, "streaming", False, True, "low"),
}
#: The reasons for special handling and what is advised, in order.
SPECIAL = (
    ("High memory requirements", "Consider processing during off-peak hours"),
    ("Extended processing time expected", "Enable email notifications for completion status"),
    ("Enterprise-scale document", "Ensure stable internet connection for the duration"),
    ("Resource-intensive processing required", "Avoid uploading multiple large documents simultaneously"),
)


def processing_settings(strategy: Column, pages: Column) -> dict[str, Column]:
    """Batch settings of a document of so many pages by its strategy."""
    names = ("batch_size", "concurrency", "delay_ms", "chunking", "prefetch", "asynchronous", "priority_level")
    out: dict[str, Column] = {}
    for name, (most, least, by, *rest) in PROCESSING.items():
        size = F.least(pages, F.lit(most)) if least is None else F.least(F.lit(most), F.greatest(F.lit(least), F.floor(pages / by)))
        own = dict(zip(names, (size.cast("bigint"), *map(F.lit, rest))))
        out = own if not out else {n: F.when(strategy == name, own[n]).otherwise(out[n]) for n in names}
    return out


def special_handling(tier: Column, memory_mb: Column, timeout_minutes: Column, concurrency: Column) -> tuple[Column, Column]:
    """(reasons, recommendations) as arrays, empty when a document needs no special handling."""
    tests = (memory_mb > 1000, timeout_minutes > 30, tier.isin("ENTERPRISE", "MASSIVE"), concurrency <= 3)
    return tuple(F.array_compact(F.array(*(F.when(t, texts[i]) for t, texts in zip(tests, SPECIAL)))) for i in (0, 1))
