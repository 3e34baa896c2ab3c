"""Registered queries of listings, status rules, library searches and reports with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import status as S
from ..functions.lineage import shared_folder
from ..functions.vectors import centroids
from ..operators import catalog as C
from ..operators import listing, pairing, search
from ..streaming import feeds
from . import bindings as B
from .queries import ACTIVITY, CENTROIDS, CHUNKS, JOBS, SECTIONS, SOURCES, _matched, query


@query("document_lookup", "SELECT d AS document_id, o_orderstatus AS status, CASE WHEN o_orderkey IS NULL THEN 'not found' END AS error FROM (SELECT DISTINCT l_orderkey * 2 AS d FROM lineitem) LEFT JOIN orders ON d = o_orderkey")
def document_lookup(spark, sf_dir):
    wanted = B.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 2).alias("document_id"))
    return listing.lookup(B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status")), wanted, "document_id")


@query("page_requests", """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 7 AS a, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS INT) % 5 END AS b, 4 AS n FROM lineitem)
SELECT CASE WHEN b IS NULL THEN 'both pages are needed' WHEN a < 1 OR b < 1 THEN 'pages start at 1' WHEN a > b THEN 'the first page comes after the last' WHEN b > n THEN 'beyond the last page' END AS error, count(*) AS n FROM r GROUP BY 1""")  # fmt: skip
def page_requests(spark, sf_dir):
    """Order lines as requests for page ranges of four-page documents."""
    n = F.col("l_quantity").cast("int")
    rows = B.table(spark, sf_dir, "lineitem").select((n % 7).alias("start_page"), F.when(F.col("l_linenumber") != 3, n % 5).alias("end_page"), F.lit(4).alias("page_count"))
    return C.with_first_error(rows, listing.page_request_rules()).groupBy("error").agg(F.count("*").alias("n"))


@query("tenant_listing", f"WITH {JOBS} SELECT id, status FROM jobs WHERE user_id % 7 = 3 AND status IN ('uploading', 'queued', 'processing')")
def tenant_listing(spark, sf_dir):
    return B.jobs(spark, sf_dir).filter((F.col("user_id") % 7 == 3) & C.status_in("processing")).select("id", "status")


@query("activity_page", f"WITH {ACTIVITY} SELECT id, user_uuid, action_type FROM activity WHERE action_type = 'search' AND logged_at >= '2024-01-03' AND logged_at <= '2024-01-20' ORDER BY logged_at DESC, id DESC LIMIT 50 OFFSET 20")
def activity_page(spark, sf_dir):
    return listing.activity_page(B.activity(spark, sf_dir), action="search", since="2024-01-03", until="2024-01-20", offset=20).select("id", "user_uuid", "action_type")


@query("listing_metadata", "SELECT 3 AS page, 20 AS \"limit\", count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 20.0) AS has_next, true AS has_prev, CASE WHEN 3 < ceil(count(*) / 20.0) THEN 4 END AS next_page, 2 AS prev_page FROM documents WHERE n_chars > 500")
def listing_metadata(spark, sf_dir):
    return listing.page_metadata(B.documents(spark, sf_dir).filter("n_chars > 500"), 3, 20)


@query("listing_order", f"WITH {JOBS} SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY file_size DESC, created_at DESC, id) AS place FROM jobs")
def listing_order(spark, sf_dir):
    """Each user's documents by size, then upload time."""
    return listing.listing_order(B.jobs(spark, sf_dir), "size", key="user_id").select("id", F.col("place").cast("bigint").alias("place"))


@query("latest_completed", f"WITH {JOBS} SELECT id, user_id FROM jobs WHERE status = 'completed' ORDER BY created_at DESC, id DESC LIMIT 1")
def latest_completed(spark, sf_dir):
    return B.jobs(spark, sf_dir).filter("status = 'completed'").sort(F.desc("created_at"), F.desc("id")).limit(1).select("id", "user_id")


@query("queue_snapshot", f"WITH {JOBS} SELECT status, count(*) AS n FROM (SELECT status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50) GROUP BY 1")
def queue_snapshot(spark, sf_dir):
    return listing.queue_snapshot(B.jobs(spark, sf_dir))


@query("span_distribution", f"WITH {CHUNKS} SELECT document_id, least(end_page - start_page + 1, 11) AS span, count(*) AS n FROM chunks GROUP BY ALL")
def span_distribution(spark, sf_dir):
    return listing.span_distribution(B.chunks(spark, sf_dir))


@query("vector_coverage", "SELECT 'documents' AS part, count(*) AS n FROM (SELECT DISTINCT vec_id // 10 FROM embeddings WHERE embedding IS NOT NULL) UNION ALL SELECT 'chunks', count(embedding) FROM embeddings")
def vector_coverage(spark, sf_dir):
    """Rows with a vector: documents, then chunks."""
    chunks = B.chunks(spark, sf_dir)
    docs = chunks.filter("embedding is not null").agg(F.lit("documents").alias("part"), F.countDistinct("document_id").alias("n"))
    return docs.unionByName(chunks.agg(F.lit("chunks").alias("part"), F.count("embedding").alias("n")))


_STATUS = "CASE event_type WHEN 'click' THEN 'uploading' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'queued' ELSE event_type END"
_MESSAGE = "CASE CAST(floor(value) AS BIGINT) % 6 WHEN 0 THEN 'generating embedding 3' WHEN 1 THEN 'structured data' WHEN 2 THEN 'upload lost' WHEN 3 THEN 'Pinecone upsert: Rate limit' WHEN 4 THEN 'error 429' END"


@query("status_phases", f"""WITH r AS (SELECT event_id, {_STATUS} AS s, {_MESSAGE} AS m, CAST(floor(value) AS BIGINT) % 120 AS p FROM events)
SELECT event_id, CASE WHEN s = 'uploading' OR m LIKE '%upload%' THEN 'upload' WHEN s = 'queued' THEN 'upload' WHEN s = 'processing' THEN CASE WHEN m LIKE '%structured%' THEN 'analysis' WHEN m LIKE '%embedding%' THEN 'embeddings' WHEN m LIKE '%Pinecone%' THEN 'indexing' ELSE 'extraction' END
  WHEN s = 'completed' THEN 'indexing' WHEN s = 'error' THEN CASE WHEN m LIKE '%embedding%' THEN 'embeddings' WHEN m LIKE '%Pinecone%' THEN 'indexing' ELSE 'extraction' END ELSE 'upload' END AS phase,
  CASE s WHEN 'uploading' THEN least(p, 100) WHEN 'processing' THEN least(greatest(p, 10), 95) WHEN 'queued' THEN 100 WHEN 'completed' THEN 100 ELSE 0 END AS progress,
  coalesce(m, CASE s WHEN 'uploading' THEN 'Uploading document to secure storage...' WHEN 'queued' THEN 'Document uploaded successfully, queued for processing...' WHEN 'processing' THEN 'Processing document with AI...' WHEN 'completed' THEN 'Document processing completed successfully' WHEN 'error' THEN 'Document processing failed' ELSE 'Processing status unknown' END) AS message,
  m IS NOT NULL AND regexp_matches(lower(m), 'rate|quota|429|limit|throttl') AS rate_limited FROM r""")  # fmt: skip
def status_phases(spark, sf_dir):
    """Events as status snapshots with messages."""
    rows = B.table(spark, sf_dir, "events").select("event_id", F.expr(_STATUS).alias("s"), F.expr(_MESSAGE).alias("m"), (F.floor("value") % 120).alias("p"))
    s, m = F.col("s"), F.col("m")
    return rows.select("event_id", S.phase(s, m).alias("phase"), S.phase_progress(s, F.col("p")).alias("progress"), F.coalesce(m, S.default_message(s)).alias("message"), S.is_rate_limit(m).alias("rate_limited"))


@query("shown_names", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'T' || doc_id WHEN doc_id % 3 = 1 AND trim(lang) <> '' THEN lang ELSE CAST(doc_id AS VARCHAR) END AS title, CASE WHEN doc_id % 3 = 1 AND trim(lang) <> '' THEN lang ELSE doc_id || '.pdf' END AS filename, doc_id % 100 + 1 AS page FROM documents""")
def shown_names(spark, sf_dir):
    title, name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), F.col("doc_id"))).otherwise("  "), F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    page = S.page_of_reference(F.concat((F.col("doc_id") % 100).cast("string"), F.lit(" of 100"))).cast("bigint")
    return B.documents(spark, sf_dir).select("doc_id", S.shown_title(title, name, F.col("doc_id")).alias("title"), S.shown_filename(name, F.col("doc_id")).alias("filename"), page.alias("page"))


@query("owned_chunks", f"WITH {CHUNKS} SELECT vec_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn FROM chunks WHERE user_id = 1) WHERE rn <= 5")
def owned_chunks(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    return listing.owned_children(chunks, chunks.select("document_id", "user_id").distinct(), 1, "document_id", "chunk_index", 5).select("vec_id", "document_id")


_NEAR = "SELECT q.vec_id AS query_id, k.vec_id, list_dot_product(q.e, k.e) AS score FROM chunks q JOIN chunks k ON q.vec_id % 50 = 0"


def _queries(vectors):
    return vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")


@query("search_owned", f"""WITH {CHUNKS}, h AS ({_NEAR} AND k.user_id = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h WHERE score > 0.15)
SELECT query_id, vec_id, document_id, round(score, 6) AS score, rank FROM r JOIN chunks USING (vec_id) WHERE rank <= 10""")  # fmt: skip
def search_owned(spark, sf_dir):
    """One owner's chunks near each query vector, with their documents."""
    chunks = B.chunks(spark, sf_dir)
    vectors = chunks.select("vec_id", F.col("embedding").alias("vector"), "user_id")
    found = listing.vector_matches(_queries(vectors), vectors, chunks.select("vec_id", "document_id"), 0.15, 10, owner=1)
    return found.select("query_id", "vec_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_DOC_NEAR = f"""WITH {CENTROIDS}, h AS (SELECT s.document_id AS query_id, k.document_id, list_dot_product(s.c, k.c) AS score FROM centroids s JOIN centroids k ON s.document_id % 50 = 0 WHERE {{keep}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM h WHERE score > {{t}})
SELECT query_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= {{n}}"""


def _document_search(spark, sf_dir, threshold, most, owner=None):
    docs = B.document_figures(spark, sf_dir).select(F.col("document_id").alias("vec_id"), F.col("centroid").alias("vector"), (F.col("document_id") % 3).alias("user_id"))
    found = listing.vector_matches(_queries(docs), docs, docs.select("vec_id"), threshold, most, owner)
    return found.select("query_id", F.col("vec_id").alias("document_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("search_documents", _DOC_NEAR.format(keep="k.document_id % 3 = 2", t=0.1, n=10))
def search_documents(spark, sf_dir):
    """One owner's documents near each query document, by document vectors."""
    return _document_search(spark, sf_dir, 0.1, 10, owner=2)


@query("similar_documents_global", _DOC_NEAR.format(keep="true", t=0.2, n=5))
def similar_documents_global(spark, sf_dir):
    """All owners' documents near each query document."""
    return _document_search(spark, sf_dir, 0.2, 5)


@query("similar_sections", f"""WITH {CHUNKS}, h AS ({_NEAR} AND k.label = 3 AND k.user_id = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h WHERE score > 0.1)
SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r JOIN chunks USING (vec_id) WHERE rank <= 5""")  # fmt: skip
def similar_sections(spark, sf_dir):
    """One owner's sections of one type near each query vector; a chunk's label is its section's type."""
    chunks = B.chunks(spark, sf_dir)
    vectors = chunks.select("vec_id", F.col("embedding").alias("vector"), "user_id", "label")
    found = listing.vector_matches(_queries(vectors), vectors.filter("label = 3"), chunks.select("vec_id", "label"), 0.1, 5, owner=0)
    return found.select("query_id", "vec_id", "label", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("document_neighbours", f"""WITH {CHUNKS}, h AS (SELECT q.document_id AS query_id, k.vec_id, k.document_id, list_dot_product(q.e, k.e) AS score FROM chunks q JOIN chunks k ON q.document_id % 50 = 0 AND q.chunk_index = 0 AND k.document_id <> q.document_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h) SELECT query_id, vec_id, document_id, round(score, 6) AS score, rank FROM t WHERE rank <= 10 AND score >= 0.15""")  # fmt: skip
def document_neighbours(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    found = listing.document_neighbours(chunks.filter(SOURCES).filter("chunk_index = 0"), chunks, 10, 0.15)
    return found.select("query_id", "vec_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("page_scoped_candidates", f"""WITH {CHUNKS}, places AS (SELECT document_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS x FROM chunks WHERE document_id % 50 = 0 AND start_page <= 3 AND end_page >= 2), means AS (
  SELECT document_id, place, avg(x) AS x FROM places GROUP BY ALL), scoped AS (SELECT document_id, list(x ORDER BY place) AS c FROM means GROUP BY 1), hits AS (
  SELECT s.document_id AS source_id, k.document_id, list_dot_product(s.c, k.e) AS score, row_number() OVER (PARTITION BY s.document_id ORDER BY list_dot_product(s.c, k.e) DESC, vec_id) AS rn FROM scoped s JOIN chunks k ON k.document_id <> s.document_id), top AS (
  SELECT source_id, document_id, max(score) AS score FROM hits WHERE rn <= 1200 GROUP BY ALL)
SELECT source_id, document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, document_id) AS rank FROM top QUALIFY rank <= 600""")  # fmt: skip
def page_scoped_candidates(spark, sf_dir):
    """Stage 0 from the mean, not of unit length, of the chunks on pages 2 to 3 of each source."""
    chunks = B.chunks(spark, sf_dir)
    scoped = centroids(chunks.filter(SOURCES).filter(C.page_overlap(2, 3)), unit=False).select("document_id", "centroid")
    found = search.stage0_candidates(scoped, chunks)
    return found.select("source_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("top_sections", f"WITH {SECTIONS} SELECT source_id, target_id, section FROM sections QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY section) <= 2")
def top_sections(spark, sf_dir):
    found = pairing.pair_sections(_matched(spark, sf_dir, *pairing.PAGED))
    return pairing.exploded(found, F.slice("sections", 1, 2), "source_id", "target_id").select("source_id", "target_id", "section")


@query("field_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%widget%' OR p_type ILIKE '%widget%' ORDER BY p_retailprice DESC NULLS LAST, p_partkey DESC LIMIT 40")
def field_search(spark, sf_dir):
    return listing.field_search(B.table(spark, sf_dir, "part"), "Widget", ("p_name", "p_type"), "p_retailprice", "p_partkey", 40).select("p_partkey")


@query("cache_after_changes", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def cache_after_changes(spark, sf_dir):
    changed = B.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return listing.without_changed(B.table(spark, sf_dir, "orders").select("o_orderkey"), changed, "o_orderkey")


@query("change_stream", """SELECT user_id AS id, event_id AS seq, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")  # fmt: skip
def change_stream(spark, sf_dir):
    """`change_feed` as a stream."""
    path = f"{sf_dir}/events.parquet"
    stream = feeds.table_stream(spark, path, spark.read.parquet(path).schema)
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    changes = stream.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("event_type"), "value")
    return feeds.drain_changes(changes, ["id", "seq", "value"], shared_folder(spark)).withColumn("value", F.round("value", 6))


@query("centroid_stream", f"WITH {CHUNKS}, places AS (SELECT document_id, unnest(range(1, len(e) + 1)) - 1 AS place, unnest(e) AS x FROM chunks) SELECT document_id, place, round(avg(x), 6) AS x FROM places GROUP BY ALL")
def centroid_stream(spark, sf_dir):
    """Means of the documents' vectors, place by place, from a stream of new chunks."""
    path = f"{sf_dir}/embeddings.parquet"
    stream = feeds.table_stream(spark, path, spark.read.parquet(path).schema).select(F.expr("vec_id div 10").alias("document_id"), "embedding")
    sums = feeds.drain_centroids(stream, shared_folder(spark))
    return sums.select("document_id", F.col("place").cast("bigint").alias("place"), F.round(F.col("total") / F.col("n"), 6).alias("x"))
