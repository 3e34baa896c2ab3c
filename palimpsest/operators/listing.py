"""Listings, search requests, ranked results, library searches and append sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import similarity_search
from .search import nearest, search_candidates


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """A row for each wanted key, with `error` where the table lacks it."""
    found = wanted.select(key).distinct().join(rows.withColumn("__there", F.lit(True)), key, "left")
    return found.withColumn("error", F.when(F.col("__there").isNull(), "not found")).drop("__there")


def page_request_rules(page_count: str = "page_count") -> list[tuple[Column, str]]:
    """Rules of a page-range request (start_page, end_page); see catalog.with_first_error."""
    low, high, most = F.col("start_page"), F.col("end_page"), F.col(page_count)
    none = low.isNull() & high.isNull()
    return [
        (none | (low.isNotNull() & high.isNotNull()), "both pages are needed"),
        (none | ((low >= 1) & (high >= 1)), "pages start at 1"),
        (none | (low <= high), "the first page comes after the last"),
        (none | most.isNull() | (high <= most), "beyond the last page"),
    ]


def result_limit(asked: float | None, most: int = 100) -> int | None:
    """A request's number of results: none for nothing or less than one, whole, `most` at the most."""
    return None if asked is None or asked <= 0 else min(int(asked), most)


def activity_page(rows: DataFrame, user: object = None, action: str | None = None, since: str | None = None, until: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A user's, action's or period's rows, newest first, one page of them."""
    for given, keep in ((user, F.col("user_uuid") == user), (action, F.col("action_type") == action), (since, F.col("logged_at") >= F.lit(since).cast("timestamp_ntz")), (until, F.col("logged_at") <= F.lit(until).cast("timestamp_ntz"))):
        rows = rows if given is None else rows.filter(keep)
    return rows.sort(F.desc("logged_at"), F.desc("id")).offset(offset).limit(limit)


def page_metadata(rows: DataFrame, page: int, limit: int) -> DataFrame:
    """(page, limit, total, total_pages, has_next, has_prev, next_page, prev_page) of a listing, from one count."""
    pages = F.ceil(F.col("total") / F.lit(limit))
    sized = rows.agg(F.count("*").alias("total")).select(F.lit(page).alias("page"), F.lit(limit).alias("limit"), "total", pages.alias("total_pages"))
    return sized.withColumns({"has_next": F.lit(page) < F.col("total_pages"), "has_prev": F.lit(page > 1), "next_page": F.when(F.lit(page) < F.col("total_pages"), page + 1), "prev_page": F.lit(page - 1 if page > 1 else None).cast("int")})


def ranked_results(results: DataFrame, by: str = "source_score", ascending: bool = False, most: int | None = None, key: str = "source_id") -> DataFrame:
    """Results of each search in the wanted order, ties by both scores to six places, then creation, title and id."""
    ties = [F.desc(F.round("source_score", 6)), F.desc(F.round("target_score", 6)), F.desc("created_at"), F.collate("title", "UNICODE"), "target_id"]
    first = [] if by == "source_score" and not ascending else [F.col(by).asc() if ascending else F.col(by).desc()]
    ranked = results.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*first, *ties)))
    return ranked if most is None else ranked.filter(F.col("place") <= most)


def listing_order(rows: DataFrame, by: str = "upload_time", ascending: bool = False, key: str | None = None) -> DataFrame:
    """rows with `place`, of all or within each `key`: by upload time, name or size, ties by upload time, newest first, and id.

    Names are compared as a reader expects, accents and letter case after the letters themselves.
    """
    column = {"upload_time": F.col("created_at"), "name": F.collate("title", "UNICODE") if "title" in rows.columns else None, "size": F.col("file_size") if "file_size" in rows.columns else None}[by]
    order = [column.asc() if ascending else column.desc(), F.desc("created_at"), "id"]
    window = Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))
    return rows.withColumn("place", F.row_number().over(window.orderBy(*order)))


def top_sections(sections: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` sections of each pair in document order."""
    order = Window.partitionBy("source_id", "target_id").orderBy("section")
    return sections.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).drop("rn")


def span_distribution(chunks: DataFrame, key: str = "document_id", most: int = 11) -> DataFrame:
    """(key, span, n): chunks of each document by pages spanned, `most` and more together; span 0 has no range."""
    span = F.when(F.col("start_page").isNull() | F.col("end_page").isNull(), 0).otherwise(F.least(F.col("end_page") - F.col("start_page") + 1, F.lit(most)))
    return chunks.groupBy(key, span.alias("span")).agg(F.count("*").alias("n"))


def queue_snapshot(jobs: DataFrame, latest: int = 50) -> DataFrame:
    """(status, n) of the `latest` newest jobs."""
    return jobs.sort(F.desc("created_at"), F.desc("id")).limit(latest).groupBy("status").agg(F.count("*").alias("n"))


def owned_children(children: DataFrame, documents: DataFrame, owner: object, key: str, order: str, most: int = 50) -> DataFrame:
    """The first `most` children of each document that the owner has."""
    own = children.join(documents.filter(F.col("user_id") == owner).select(key).distinct(), key, "left_semi")
    return own.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("rn") <= most).drop("rn")


def vector_matches(queries: DataFrame, vectors: DataFrame, attributes: DataFrame, threshold: float, most: int, owner: object = None) -> DataFrame:
    """(query_id, vec_id, score, rank, attributes): each query's `most` nearest over the threshold, of one owner if given.

    `vectors` (vec_id, vector[, user_id]) may be chunks, documents or sections; `attributes` joins on vec_id.
    """
    held = vectors if owner is None else vectors.filter(F.col("user_id") == owner)
    hits = nearest(queries, held.select("vec_id", "vector"), most, threshold).filter(F.col("score") > threshold)
    return hits.join(attributes, "vec_id")


def document_neighbours(sources: DataFrame, chunks: DataFrame, most: int = 10, threshold: float = 0.7, allowed: Column | None = None) -> DataFrame:
    """(query_id, vec_id, document_id, score, rank): chunks of other documents near a document's vector, its first one or the mean of its pages.

    The most + 10 nearest of other documents are taken, those under the threshold go, `most` stay. `sources` has
    (document_id, embedding) and may name its rows by a query_id of their own; `allowed` is a filter of chunks.
    """
    name = "query_id" if "query_id" in sources.columns else "document_id"
    queries = sources.select(F.col(name).alias("query_id"), "document_id", F.col("embedding").alias("vector"))
    held = chunks if allowed is None else chunks.filter(allowed)
    hits = nearest(queries, held.select("vec_id", "document_id", F.col("embedding").alias("vector")), most + 10, threshold, owner="document_id")
    return hits.filter(F.col("rank") <= most).join(chunks.select("vec_id", "document_id"), "vec_id")


def field_search(fields: DataFrame, text: str, columns: tuple[str, ...], confidence: str, created: str, most: int) -> DataFrame:
    """Fields whose name, value or label contains the text, surest first, unknown confidence last, newest first among equals."""
    from .catalog import search_titles

    return fields.filter(search_titles(text, columns)).sort(F.desc_nulls_last(confidence), F.desc(created)).limit(most)


def without_changed(cache: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Cached rows less those of changed documents."""
    return cache.join(changed.select(key).distinct(), key, "left_anti")


def append_rows(rows: DataFrame, path: str) -> None:
    """Append activity rows or status snapshots to a Parquet log."""
    rows.write.mode("append").parquet(path)


def upload_manifest(files: DataFrame, user: object, metadata: dict[str, str] | None = None) -> DataFrame:
    """(title, filename, file_path, file_size, content_type, user_id, status, metadata) of files as `binaryFile` lists them; contents are not read."""
    pairs = [x for k, v in (metadata or {}).items() for x in (F.lit(k), F.lit(v))]
    entries = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^/.]+$", "").alias("title"), name.alias("filename"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.lit("application/pdf").alias("content_type"), F.lit(user).alias("user_id"), F.lit("uploading").alias("status"), entries.alias("metadata"))


def feature_neighbours(features: DataFrame, queries: DataFrame, threshold: float = 0.3, most: int = 10) -> DataFrame:
    """(query_id, document_id, filename, similarity_score, form_field_similarity, legal_clause_similarity, semantic_similarity, rank).

    Feature rows (document_id, filename, v of unit length, n_sections, n_fields, complexity) nearest to each query's: those over 0.8 of the threshold,
    2 * most of them by cosine, scored by cosine, section counts and complexity. The threshold isn't applied to the score.
    """
    asked = queries.select(F.col("document_id").alias("query_id"), F.col("v").alias("vector"))
    near = nearest(asked, features.select(F.col("document_id").alias("vec_id"), F.col("v").alias("vector")), 2 * most + 1, threshold * 0.8)
    others = near.filter((F.col("vec_id") != F.col("query_id")) & (F.col("score") > threshold * 0.8))
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= 2 * most)
    side = lambda rows, key, tag: rows.select(F.col("document_id").alias(key), F.col("n_sections").alias(f"n_{tag}"), F.col("n_fields").alias(f"f_{tag}"), *([F.col("filename")] if tag == "b" else []), F.col("complexity").alias(f"x_{tag}"))
    both = ranked.withColumnRenamed("vec_id", "document_id").join(side(features, "document_id", "b"), "document_id").join(side(queries, "query_id", "a"), "query_id")
    ratio = lambda a, b, floor: F.least(F.col(a) / F.greatest(F.col(b), F.lit(floor)), F.col(b) / F.greatest(F.col(a), F.lit(floor)))
    clauses, forms = ratio("n_b", "n_a", 1), ratio("f_b", "f_a", 1)
    score = F.greatest(F.col("score") * 0.5 + clauses * 0.35 + ratio("x_b", "x_a", 0.1) * 0.15, F.lit(0.0))
    return both.select("query_id", "document_id", "filename", score.alias("similarity_score"), forms.alias("form_field_similarity"), clauses.alias("legal_clause_similarity"), F.col("score").alias("semantic_similarity"), "rank")


def search_summary(found: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """(source_id, stage0_candidates, average_score, stage1_candidates, final_results) of each search."""
    count = lambda rows, name: rows.groupBy("source_id").agg(F.count("*").alias(name))
    out = found.groupBy("source_id").agg(F.count("*").alias("stage0_candidates"), F.round(F.avg("score"), 3).alias("average_score"))
    out = out.join(count(candidates, "stage1_candidates"), "source_id", "left").join(count(results, "final_results"), "source_id", "left")
    return out.fillna(0, ["stage1_candidates", "final_results"])


def search_request(sources: DataFrame, chunks: DataFrame, documents: DataFrame, titles: DataFrame, asked: float | None = None, allowed: Column | None = None, **options) -> DataFrame:
    """The whole search for a table of sources: filtered candidates, matches and scores, floors, order, the number asked for.

    `titles` has (document_id, created_at, title); `allowed` is a filter of chunks, such as an owner's; the options are similarity_search's.
    """
    candidates = search_candidates(sources.select("document_id", "centroid"), chunks, allowed=allowed)
    results = similarity_search(sources, chunks, documents, candidates, **options)
    return ranked_results(results.join(titles.withColumnRenamed("document_id", "target_id"), "target_id"), most=result_limit(asked))
