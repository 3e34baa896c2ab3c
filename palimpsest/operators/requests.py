"""Search requests as a table: each names a document, its asker and, if wanted, a page range; checked, scoped and searched together."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.vectors import centroids
from .listing import page_request_rules
from .matching import similarity_search
from .search import nearest, neighbours_per_chunk

#: The model that documents are expected to be embedded with, and the messages of a request's checks; fixed values.
MODEL = "text-embedding-004"
NOT_FOUND = "Document not found"
NOT_COMPLETED = "Document is not ready for similarity search"
NOT_READY = "Document is not ready for similarity search v2"
NO_CENTROID = "Missing centroid_embedding (run backfill or reprocess)"
NO_COUNT = "Missing effective_chunk_count (run backfill or reprocess)"
NO_CHUNKS = "No embeddings found for document"
#: Pages of one bucket of the range join.
PAGES = 16


def readiness(documents: DataFrame, chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """(document_id, errors, warnings, ready) of all documents (document_id, centroid, effective_chunk_count, embedding_model).

    A document needs a centroid, a count of chunks that is not 0, and a stored chunk; another model is a warning.
    """
    there = chunks.select("document_id").distinct().withColumn("__there", F.lit(True))
    rows = documents.join(there, "document_id", "left")
    rules = ((F.col("centroid").isNull(), NO_CENTROID), (F.coalesce("effective_chunk_count", F.lit(0)) == 0, NO_COUNT), (F.col("__there").isNull(), NO_CHUNKS))
    warning = F.when(~F.col("embedding_model").eqNullSafe(F.lit(model)), F.concat(F.lit("Unexpected embedding model: "), F.coalesce("embedding_model", F.lit("null"))))
    errors = F.array_compact(F.array(*(F.when(rule, text) for rule, text in rules)))
    return rows.select("document_id", errors.alias("errors"), F.array_compact(F.array(warning)).alias("warnings")).withColumn("ready", F.size("errors") == 0)


_SCOPE = ("document_id", "low", "high")


def scopes(requests: DataFrame) -> DataFrame:
    """(request_id, document_id, low, high, n_requests): the distinct scopes, each under the least id of its requests, so that none is searched twice."""
    return requests.groupBy(*_SCOPE).agg(F.min("request_id").alias("request_id"), F.count("*").alias("n_requests"))


def by_scope(requests: DataFrame, found: DataFrame, kind: str = "inner") -> DataFrame:
    """`found`, rows of scopes (document_id, low, high and more), for each of the requests (request_id and the rest) that ask for them."""
    named = found.withColumnsRenamed({c: f"__{c}" for c in _SCOPE})
    return requests.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _SCOPE], kind).drop(*(f"__{c}" for c in _SCOPE))


def page_scoped(requests: DataFrame, chunks: DataFrame, width: int = PAGES) -> DataFrame:
    """chunks with request_id: those of each request's document, and with a range (low, high) those that its pages touch.

    Ranges and chunks meet by document and bucket of `width` pages, so that a long document's requests don't each meet all of
    its chunks; a pair that shares several buckets counts in the first. A chunk without a range of pages goes by its page number.
    """
    start, end = (F.when(F.col("start_page").isNull() | F.col("end_page").isNull(), F.col("page_number")).otherwise(F.col(c)) for c in ("start_page", "end_page"))
    bucket = lambda page: F.floor(page / width)
    placed = chunks.withColumns({"__start": start, "__end": end}).filter("__start <= __end")
    placed = placed.withColumn("__b", F.explode(F.sequence(bucket(F.col("__start")), bucket(F.col("__end")))))
    ranged = requests.filter("low <= high").select("request_id", "document_id", "low", "high")
    asked = ranged.withColumn("__b", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    touched = (F.col("__start") <= F.col("high")) & (F.col("__end") >= F.col("low"))
    first = F.col("__b") == F.greatest(bucket(F.col("__start")), bucket(F.col("low")))
    part = asked.join(placed, ["document_id", "__b"]).filter(touched & first).select("request_id", *chunks.columns)
    whole = requests.filter("low is null and high is null").select("request_id", "document_id").join(chunks, "document_id").select("request_id", *chunks.columns)
    return part.unionByName(whole)


def scope_figures(requests: DataFrame, scoped: DataFrame) -> DataFrame:
    """(request_id, document_id, n_chunks, total_characters, centroid): counts, and the mean vector, not of unit length, of each request's chunks."""
    totals = scoped.groupBy("request_id").agg(F.count("*").alias("n_chunks"), F.sum("character_count").cast("bigint").alias("total_characters"))
    means = centroids(scoped, "request_id", unit=False).select("request_id", "centroid")
    return requests.select("request_id", "document_id").join(totals, "request_id", "left").fillna(0, ["n_chunks", "total_characters"]).join(means, "request_id", "left")


def checked(requests: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests with `error`, the first that stops a request (null: none), `details` and `warnings`.

    `documents` has (document_id, user_id, status, page_count, centroid, effective_chunk_count, embedding_model). In order: the
    asker's own document, completed, a valid page range, ready, and a chunk within the pages.
    """
    docs = documents.select("document_id", F.col("user_id").alias("__owner"), "status", "page_count").join(readiness(documents, chunks), "document_id")
    rows = requests.withColumns({"start_page": F.col("low"), "end_page": F.col("high")}).join(docs, "document_id", "left")
    asked = scopes(requests)
    scoped = page_scoped(asked, chunks.select("document_id", "page_number", "start_page", "end_page")).select("request_id").distinct()
    rows = by_scope(rows, asked.join(scoped, "request_id").select(*_SCOPE, F.lit(True).alias("__scoped")), "left")
    own = F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False))
    pages = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(text)) for rule, text in page_request_rules()]
    nothing = F.format_string("Source document %s has no embeddings within pages %d-%d", F.col("document_id").cast("string"), "low", "high")
    error = F.coalesce(
        F.when(~own, NOT_FOUND), F.when(~F.col("status").eqNullSafe(F.lit("completed")), NOT_COMPLETED), *pages, F.when(~F.col("ready"), NOT_READY), F.when(F.col("__scoped").isNull(), nothing)
    )
    shown = lambda c: F.when(own, F.col(c)).otherwise(F.array().cast("array<string>"))
    return rows.select(*requests.columns, error.alias("error"), F.when(error == NOT_READY, shown("errors")).otherwise(F.array().cast("array<string>")).alias("details"), shown("warnings").alias("warnings"))


def candidates(asked: DataFrame, scoped: DataFrame, chunks: DataFrame, top_k: int = 600, keep: int = 250, allowed: Column | None = None) -> DataFrame:
    """(request_id, document_id): stage 0 by each request's vector, and stage 1 by its own chunks for those with more than `keep`.

    `asked` has (request_id, document_id, centroid). A request's own document is left out in the scan. Neighbours of a chunk are
    looked up once, however many requests it belongs to.
    """
    held = chunks if allowed is None else chunks.filter(allowed)
    vectors = lambda rows: rows.select("vec_id", "document_id", F.col("embedding").alias("vector"))
    hits = nearest(asked.select(F.col("request_id").alias("query_id"), "document_id", F.col("centroid").alias("vector")), vectors(held), 2 * top_k, owner="document_id")
    owners = chunks.select("vec_id", "document_id")
    best = hits.join(owners, "vec_id").groupBy(F.col("query_id").alias("request_id"), "document_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "document_id")
    found = best.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top_k).drop("rn")
    return _narrowed(cut(found), scoped, chunks, keep)


def _narrowed(found: DataFrame, scoped: DataFrame, chunks: DataFrame, keep: int) -> DataFrame:
    owners = chunks.select("vec_id", F.col("document_id").alias("near_id"))
    sizes = found.groupBy("request_id").count()
    out = found.join(sizes.filter(F.col("count") <= keep), "request_id", "left_semi").select("request_id", "document_id", "score")
    groups: dict[int, list[int]] = {}
    for n in [r["count"] for r in sizes.filter(F.col("count") > keep).select("count").distinct().collect()]:
        groups.setdefault(neighbours_per_chunk(n), []).append(n)
    for k, counts in sorted(groups.items()):  # four at the most
        own = scoped.join(sizes.filter(F.col("count").isin(counts)), "request_id", "left_semi").select("request_id", "vec_id", "embedding")
        queries = own.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")).dropDuplicates(["query_id"])
        near = nearest(queries, chunks.select("vec_id", F.col("embedding").alias("vector")), k).join(owners, "vec_id").select("query_id", F.col("near_id").alias("document_id"))
        matched = own.select("request_id", F.col("vec_id").alias("query_id")).join(near, "query_id").join(found, ["request_id", "document_id"])
        counted = matched.groupBy("request_id", "document_id").agg(F.countDistinct("query_id").alias("n"), F.first("score").alias("score"))
        order = Window.partitionBy("request_id").orderBy(F.desc("n"), "document_id")
        out = out.unionByName(counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= keep).select("request_id", "document_id", "score"))
    return out


@dataclass
class Answer:
    """Checked requests, the results of those that passed, and figures of the run, taken while its tables were written."""

    requests: DataFrame
    results: DataFrame
    figures: dict[str, object] = field(default_factory=dict)


def answer(requests: DataFrame, documents: DataFrame, chunks: DataFrame, allowed: Column | None = None, most: int = 30, min_source: float = 0.7, min_target: float = 0.7, **options) -> Answer:
    """All requests (request_id long, document_id, user_id, low, high): checks, candidates, matches, directional scores, rank, floors.

    A request with pages searches by the mean of the chunks that they touch, and its source figures count these alone; one without
    searches by its document's centroid. `documents` needs total_characters beside what `checked` reads; the other options are match_pairs'.
    Results have (request_id, target_id, matched_source_chars, matched_target_chars, matched_chunks, source_score, target_score, length_ratio, rank).
    """
    verdicts = cut(checked(requests, documents, chunks))
    good = verdicts.filter("error is null").select(*requests.columns)
    wanted = cut(scopes(good))  # requests for the same pages of a document are searched once, and their results given to each
    scoped = cut(page_scoped(wanted, chunks))
    figures = scope_figures(wanted, scoped)
    whole = documents.select("document_id", F.col("centroid").alias("__centroid"), F.col("total_characters").cast("bigint").alias("__total"))
    sized = wanted.join(figures.drop("document_id"), "request_id").join(whole, "document_id")
    entire = F.col("low").isNull()
    asked = cut(sized.select("request_id", "document_id", F.when(entire, F.col("__centroid")).otherwise(F.col("centroid")).alias("centroid"), F.when(entire, F.col("__total")).otherwise(F.col("total_characters")).alias("total_characters")))

    first, last = Observation("candidates"), Observation("results")
    weighed = candidates(asked, scoped, chunks, allowed=allowed).join(wanted.select("request_id", "n_requests"), "request_id")
    total = F.sum("n_requests")
    pool = cut(weighed.observe(first, F.coalesce(total, F.lit(0)).alias("n"), F.try_divide(F.sum(F.col("score") * F.col("n_requests")), total).alias("score")))
    # requests and documents share one name space from here on, so that a scoped source is matched like a document
    name = lambda mark, c: F.concat(F.lit(mark), F.lpad(F.col(c).cast("string"), 24, "0"))
    doc, request = name("d", "document_id"), name("r", "request_id")
    both = chunks.withColumn("document_id", doc).unionByName(scoped.withColumn("document_id", request).drop("request_id"))
    totals = documents.select(doc.alias("document_id"), "total_characters").unionByName(asked.select(request.alias("document_id"), "total_characters"))
    pairs = pool.select(request.alias("source_id"), doc.alias("document_id"))
    scores = similarity_search(asked.select(request.alias("document_id"), "centroid"), both, totals, pairs, most, min_source, min_target, **options)
    names = asked.select(request.alias("source_id"), "request_id"), documents.select(doc.alias("target_id"), F.col("document_id").alias("__target"))
    named = scores.join(names[0], "source_id").join(names[1], "target_id").drop("source_id", "target_id").withColumnRenamed("__target", "target_id")
    each = by_scope(good.select("request_id", *_SCOPE), wanted.join(named, "request_id").drop("request_id", "n_requests")).drop(*_SCOPE)
    results = cut(each.observe(last, F.count("*").alias("n"), F.avg("source_score").alias("score")))
    return Answer(verdicts, results, {"candidates": first.get["n"], "mean_candidate_score": first.get["score"], "results": last.get["n"], "mean_source_score": last.get["score"]})
