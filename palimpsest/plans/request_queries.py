"""Registered queries of search requests, stores, builds, streams with state and sketches with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..operators import build, index, listing, requests, sketches, store
from ..streaming import feeds
from . import bindings as B
from .queries import CHUNKS, query

REQUESTS = f"""{CHUNKS}, asked AS (SELECT o_orderkey AS request_id, o_custkey % 60 AS document_id, CASE WHEN o_orderkey % 350 = 0 THEN 9 ELSE o_custkey % 60 % 3 END AS user_id,
    CASE o_orderkey // 50 % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 END AS low, CASE o_orderkey // 50 % 4 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 END AS high FROM orders WHERE o_orderkey % 50 = 0), docs AS (
  SELECT document_id, document_id % 3 AS user_id, CASE WHEN document_id % 7 = 3 THEN 'processing' ELSE 'completed' END AS status, max(end_page) AS page_count, document_id % 11 <> 5 AS ready,
    CASE WHEN document_id % 5 <> 1 THEN 'text-embedding-004' WHEN document_id % 2 = 0 THEN 'other' END AS model FROM chunks GROUP BY 1), verdict AS (
  SELECT a.*, CASE WHEN d.document_id IS NULL OR d.user_id <> a.user_id THEN 'Document not found' WHEN d.status <> 'completed' THEN 'Document is not ready for similarity search'
    WHEN a.high > d.page_count THEN 'beyond the last page' WHEN NOT d.ready THEN 'Document is not ready for similarity search v2' END AS error,
    d.user_id = a.user_id AND d.model IS DISTINCT FROM 'text-embedding-004' AS warned, d.model FROM asked a LEFT JOIN docs d ON d.document_id = a.document_id)"""


def _requests(spark, sf_dir):
    """Requests out of the orders, some of them by others, of unfinished or unready documents, or beyond the last page."""
    kind, doc = F.col("o_orderkey") / 50 % 4, F.col("o_custkey") % 60
    page = lambda *values: F.element_at(F.array(*(F.lit(v).cast("int") for v in values)), kind.cast("int") + 1)
    rows = B.table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0")
    return rows.select(F.col("o_orderkey").alias("request_id"), doc.alias("document_id"), F.when(F.col("o_orderkey") % 350 == 0, 9).otherwise(doc % 3).alias("user_id"), page(None, 1, 2, 5).alias("low"), page(None, 2, 4, 6).alias("high"))


def _request_documents(spark, sf_dir):
    i = F.col("document_id")
    return B.document_figures(spark, sf_dir).withColumns(
        {
            "user_id": i % 3,
            "status": F.when(i % 7 == 3, "processing").otherwise("completed"),
            "effective_chunk_count": F.when(i % 11 == 5, 0).otherwise(F.col("effective_chunk_count")),
            "embedding_model": F.when(i % 5 != 1, requests.MODEL).when(i % 2 == 0, "other"),
        }
    )


@query("request_checks", f"""WITH {REQUESTS} SELECT request_id, error, CASE WHEN error LIKE '%v2' THEN 'Missing effective_chunk_count (run backfill or reprocess)' ELSE '' END AS details,
  CASE WHEN warned THEN 'Unexpected embedding model: ' || coalesce(model, 'null') ELSE '' END AS warnings FROM verdict""")  # fmt: skip
def request_checks(spark, sf_dir):
    found = requests.checked(_requests(spark, sf_dir), _request_documents(spark, sf_dir), B.chunks(spark, sf_dir))
    return found.select("request_id", "error", F.array_join("details", "; ").alias("details"), F.array_join("warnings", "; ").alias("warnings"))


SCOPED = f"""{REQUESTS}, scope AS (SELECT v.request_id, v.low, chunks.* FROM verdict v JOIN chunks USING (document_id) WHERE v.error IS NULL AND (v.low IS NULL OR (start_page <= v.high AND end_page >= v.low))), sums AS (
  SELECT request_id, any_value(document_id) AS document_id, any_value(low) AS low, count(*) AS n_chunks, sum(character_count) AS t FROM scope GROUP BY 1), flat AS (
  SELECT request_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS x FROM scope), mean AS (SELECT request_id, place, avg(x) AS x FROM flat GROUP BY ALL), centre AS (
  SELECT request_id, list(x ORDER BY place) AS c, sqrt(sum(x * x)) AS norm FROM mean GROUP BY 1)"""


@query("request_scopes", f"WITH {SCOPED} SELECT request_id, document_id, n_chunks, CAST(t AS BIGINT) AS total_characters, round(norm, 6) AS centroid_length FROM sums JOIN centre USING (request_id)")
def request_scopes(spark, sf_dir):
    """Chunks, characters and mean vector of each accepted request's pages."""
    chunks = B.chunks(spark, sf_dir)
    good = requests.checked(_requests(spark, sf_dir), _request_documents(spark, sf_dir), chunks).filter("error is null")
    asked = requests.scopes(good)
    figures = requests.scope_figures(asked, requests.page_scoped(asked, chunks)).drop("document_id")
    found = requests.by_scope(good.select("request_id", "document_id", "low", "high"), asked.join(figures, "request_id").drop("request_id"))
    return found.select("request_id", "document_id", "n_chunks", "total_characters", F.round(requests_norm(), 6).alias("centroid_length"))


def requests_norm():
    from ..functions.vectors import norm

    return norm(F.col("centroid"))


ANSWERED = f"""{SCOPED}, asking AS (SELECT request_id, document_id, CASE WHEN low IS NULL THEN [x / norm FOR x IN c] ELSE c END AS c FROM sums JOIN centre USING (request_id)), hits AS (
  SELECT q.request_id, k.document_id, list_dot_product(q.c, k.e) AS score, row_number() OVER (PARTITION BY q.request_id ORDER BY list_dot_product(q.c, k.e) DESC, vec_id) AS rn FROM asking q JOIN chunks k ON k.document_id <> q.document_id), pool AS (
  SELECT DISTINCT request_id, document_id AS target_id FROM hits WHERE rn <= 1200), cand AS (
  SELECT a.request_id, b.document_id AS target_id, a.chunk_index AS a_index, b.chunk_index AS b_index, a.page_number AS a_page, b.page_number AS b_page, a.character_count AS a_chars, b.character_count AS b_chars, list_dot_product(a.e, b.e) AS score
  FROM pool JOIN scope a USING (request_id) JOIN chunks b ON b.document_id = pool.target_id AND list_dot_product(a.e, b.e) >= 0.25), best AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, target_id, a_index ORDER BY score DESC, abs(a_page - b_page), b_index) AS rn FROM cand) WHERE rn = 1
  UNION SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, target_id, b_index ORDER BY score DESC, abs(a_page - b_page), a_index) AS rn FROM cand) WHERE rn = 1), tot AS (
  SELECT document_id AS target_id, sum(character_count) AS u FROM chunks GROUP BY 1), gate AS (
  SELECT request_id, target_id, t, u FROM best JOIN sums USING (request_id) JOIN tot USING (target_id) GROUP BY ALL HAVING least(sum(a_chars), sum(b_chars)) >= greatest(1600, ceil(0.05 * least(t, u)))), sa AS (
  SELECT request_id, target_id, sum(a_chars) AS s, count(*) AS n FROM (SELECT DISTINCT request_id, target_id, a_index, a_chars FROM best) GROUP BY ALL), sb AS (
  SELECT request_id, target_id, sum(b_chars) AS s FROM (SELECT DISTINCT request_id, target_id, b_index, b_chars FROM best) GROUP BY ALL), scored AS (
  SELECT request_id, target_id, sa.s AS ms, sb.s AS mt, n, sa.s / t AS ss, sb.s / u AS ts FROM gate JOIN sa USING (request_id, target_id) JOIN sb USING (request_id, target_id)), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ss DESC, ts DESC, mt DESC, n DESC, target_id) AS rank FROM scored)"""


def _answer(spark, sf_dir):
    options = {"min_source": 0.05, "min_target": 0.05, "primary": 0.25, "fallback": None, "tolerance": 0}
    return requests.answer(_requests(spark, sf_dir), _request_documents(spark, sf_dir), B.chunks(spark, sf_dir), **options)


@query("search_requests", f"""WITH {ANSWERED} SELECT request_id, target_id, CAST(ms AS BIGINT) AS matched_source_chars, CAST(mt AS BIGINT) AS matched_target_chars, n AS matched_chunks, round(ss, 6) AS source_score, round(ts, 6) AS target_score, rank
FROM ranked WHERE rank <= 30 AND ss >= 0.05 AND ts >= 0.05""")  # fmt: skip
def search_requests(spark, sf_dir):
    """A table of requests, with pages and without, from the checks to the ranked results; no fallback pass, which SQL can't say."""
    found = _answer(spark, sf_dir).results
    return found.select("request_id", "target_id", "matched_source_chars", "matched_target_chars", "matched_chunks", F.round("source_score", 6).alias("source_score"), F.round("target_score", 6).alias("target_score"), F.col("rank").cast("bigint").alias("rank"))


@query("request_summary", f"""WITH {ANSWERED}, r AS (SELECT * FROM ranked WHERE rank <= 30 AND ss >= 0.05 AND ts >= 0.05)
SELECT (SELECT count(*) FROM pool) AS candidates, round((SELECT avg(s) FROM (SELECT max(score) AS s FROM hits WHERE rn <= 1200 GROUP BY request_id, document_id)), 6) AS mean_candidate_score, (SELECT count(*) FROM r) AS results, round((SELECT avg(ss) FROM r), 6) AS mean_source_score""")  # fmt: skip
def request_summary(spark, sf_dir):
    """Figures of the run of search_requests, observed while it ran."""
    figures = _answer(spark, sf_dir).figures
    row = (int(figures["candidates"]), round(figures["mean_candidate_score"] or 0.0, 6), int(figures["results"]), round(figures["mean_source_score"] or 0.0, 6))
    return spark.createDataFrame([row], "candidates long, mean_candidate_score double, results long, mean_source_score double")


@query("page_neighbours", f"""WITH {SCOPED}, hits AS (SELECT q.request_id, k.vec_id, k.document_id, list_dot_product(centre.c, k.e) AS score FROM sums q JOIN centre USING (request_id) JOIN chunks k ON k.document_id <> q.document_id WHERE k.user_id <> 1),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) AS rank FROM hits WHERE score >= 0.05) SELECT request_id, vec_id, document_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")  # fmt: skip
def page_neighbours(spark, sf_dir):
    """Chunks near the mean of a request's pages, of two owners' other documents."""
    chunks = B.chunks(spark, sf_dir)
    good = requests.checked(_requests(spark, sf_dir), _request_documents(spark, sf_dir), chunks).filter("error is null")
    asked = requests.scopes(good)
    figures = requests.scope_figures(asked, requests.page_scoped(asked, chunks))
    found = listing.document_neighbours(figures.select("document_id", F.col("request_id").alias("query_id"), F.col("centroid").alias("embedding")), chunks, 5, 0.05, F.col("user_id") != 1)
    each = asked.join(found.select(F.col("query_id").alias("request_id"), "vec_id", F.col("document_id").alias("near_id"), "score", "rank"), "request_id").drop("request_id")
    found = requests.by_scope(good.select("request_id", "document_id", "low", "high"), each).drop("document_id").withColumnRenamed("near_id", "document_id")
    return found.select("request_id", "vec_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_IVF = "WITH r AS (SELECT q.vec_id AS query_id, k.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings k ON q.vec_id % 50 = 0), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r)"


@query("stored_index_all_cells", f"{_IVF} SELECT query_id, vec_id, round(score, 6) AS score, rank FROM s WHERE rank <= 10")
def stored_index_all_cells(spark, sf_dir):
    """A stored inverted file, opened again and probed in all cells, which gives the exact neighbours; `ivf_neighbours` probes 16."""
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    path = shared_folder(spark)
    index.InvertedFile.build(vectors, path, cells=36)
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    found = index.InvertedFile.open(spark, path).nearest(queries, 10, probes=36)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("bucket_store", """WITH w AS (SELECT doc_id AS document_id, unnest(range(0, 4)) AS chunk_index, n_chars, source FROM documents), v AS (
  SELECT document_id, chunk_index, CASE WHEN chunk_index = 1 AND document_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n, CASE WHEN chunk_index = 1 AND document_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM w WHERE document_id % 3 <> 0)
SELECT document_id, chunk_index, n, version FROM v WHERE document_id % 5 <> 0 UNION ALL SELECT doc_id, 0, 0, 3 FROM documents WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0""")  # fmt: skip
def bucket_store(spark, sf_dir):
    """A chunk store that is filled, upserted twice with the same rows, in which documents are replaced, and others deleted."""
    docs = B.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("n_chars").cast("bigint").alias("n"))
    rows = docs.select("document_id", F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(4)))).alias("chunk_index"), "n", F.lit(1).cast("bigint").alias("version"))
    kept = store.BucketStore(spark, shared_folder(spark), rows.schema, "document_id", 16)
    kept.replace(rows)
    later = rows.filter("chunk_index = 1 and document_id % 4 = 0").withColumns({"n": F.col("n") + 1, "version": F.lit(2).cast("bigint")})
    for _ in range(2):
        kept.upsert(later, ["document_id", "chunk_index"], "version")
    anew = docs.filter("document_id % 5 = 0").select("document_id", *(F.lit(v).cast("bigint").alias(n) for n, v in (("chunk_index", 0), ("n", 0), ("version", 3))))
    kept.replace(anew)
    kept.delete(docs.filter("document_id % 3 = 0"))
    return kept.read()


@query("build_job")
def build_job(spark, sf_dir):
    """The whole build into two stores: two of three documents by paragraphs, the others by sentences, pages left out, vectors, centroids."""
    from ..operators.chunking import paragraphs_of

    docs = B.documents(spark, sf_dir).filter("doc_id is not null")
    lines = paragraphs_of(docs, "doc_id", "text")
    pages = lines.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), "\n").alias("text"))
    excluded = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("low"), F.lit(2).alias("high"))
    job = build.ChunkBuild.at(spark, shared_folder(spark))
    job.run(pages, lines.filter("document_id % 3 <> 0"), excluded)
    return job.centroids.read()


@query("stream_changed_status", """SELECT user_id AS document_id, event_id AS seq, event_type AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type""")
def stream_changed_status(spark, sf_dir):
    """Snapshots that differ from their document's one before, from a stream with a value as state."""
    path = f"{sf_dir}/events.parquet"
    stream = feeds.table_stream(spark, path, spark.read.parquet(path).schema).select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return feeds.drain_changed(stream, "document_id", "seq", ["status"], shared_folder(spark))


@query("usage_sketches", """WITH a AS (SELECT strftime(ts, '%Y-%m') AS period, user_id, value * 10 AS d FROM events), q AS (SELECT period, count(*) AS n, round(avg(d), 6) AS mean_duration, quantile_disc(d, 0.95) AS p95 FROM a GROUP BY 1),
u AS (SELECT period, user_id, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT period, max(n) AS most FROM u GROUP BY 1) SELECT period, n, mean_duration, CAST(most AS BIGINT) AS most FROM q JOIN t USING (period)""")  # fmt: skip
def usage_sketches(spark, sf_dir):
    """Figures by month, merged from daily sketches; the p95 and the list of users are held against exact ones in a test."""
    daily = sketches.daily_sketches(B.activity(spark, sf_dir))
    found = sketches.period_figures(daily, F.date_format("day", "yyyy-MM"))
    return found.select("period", "n", F.round("mean_duration", 6).alias("mean_duration"), F.get("top_users", F.lit(0))["count"].alias("most"))
