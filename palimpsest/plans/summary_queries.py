"""Registered queries of the reports with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import pairing, reports, upkeep
from . import bindings as B
from .queries import CHUNKS, FINGERPRINTS, JOBS, MATCHES, SOURCES, SQL, _matched, _prints, query

_METHOD = "CASE user_id % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'batch' END"


def _method_jobs(spark, sf_dir):
    method = F.when(F.col("user_id") % 3 == 0, "sync").when(F.col("user_id") % 3 == 1, "batch")
    return B.jobs(spark, sf_dir).withColumns({"processing_method": method, "processing_time_ms": F.col("file_size") % 1000, "attempts": F.col("priority")})


@query("job_performance_recent", f"""WITH {JOBS} SELECT {_METHOD} AS processing_method, status, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS job_count, round(avg(file_size % 1000), 4) AS avg_ms, min(file_size % 1000) AS min_ms, max(file_size % 1000) AS max_ms,
  round(avg(priority), 4) AS avg_attempts, count(*) FILTER (WHERE status = 'error') AS error_count FROM jobs WHERE created_at >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAYS GROUP BY ALL""")  # fmt: skip
def job_performance_recent(spark, sf_dir):
    found = reports.job_performance(_method_jobs(spark, sf_dir), "1998-06-01")
    return found.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "avg_ms": F.round("avg_ms", 4), "avg_attempts": F.round("avg_attempts", 4)})


@query("health_recent", f"""WITH {JOBS}, parts AS (SELECT 'jobs' AS component, status FROM jobs WHERE created_at >= TIMESTAMP '1998-06-01' - INTERVAL 1 DAY UNION ALL SELECT 'urgent', status FROM jobs WHERE priority = 1 AND created_at >= TIMESTAMP '1998-06-01' - INTERVAL 1 DAY)
SELECT component, count(*) AS total_count, count(*) FILTER (WHERE status = 'completed') AS healthy_count, count(*) FILTER (WHERE status = 'error') AS error_count, round(count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*), 2) AS health_percentage FROM parts GROUP BY 1""")  # fmt: skip
def health_recent(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    return reports.recent_health({"jobs": jobs, "urgent": jobs.filter("priority = 1")}, "1998-06-01").withColumn("health_percentage", F.col("health_percentage").cast("double"))


@query("user_document_stats", f"""WITH {JOBS}, d AS (SELECT *, CASE WHEN priority < 4 THEN 'type' || priority ELSE 'unknown' END AS kind FROM jobs), items AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem GROUP BY 1), s AS (
  SELECT user_id, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status FROM (SELECT user_id, status, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1), t AS (
  SELECT user_id, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_type FROM (SELECT user_id, kind, count(*) AS n FROM d GROUP BY ALL) GROUP BY 1)
SELECT d.user_id, count(*) AS total_documents, round(sum(file_size) / 1048576.0, 2) AS storage_mb, any_value(by_status) AS by_status, any_value(by_type) AS by_type, CAST(coalesce(sum(items.n), 0) AS BIGINT) AS total_fields
FROM d JOIN s USING (user_id) JOIN t USING (user_id) LEFT JOIN items ON items.document_id = d.id GROUP BY 1""")  # fmt: skip
def user_document_stats(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir).withColumn("document_type", F.when(F.col("priority") < 4, F.concat(F.lit("type"), F.col("priority").cast("string"))))
    items = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"))
    found = reports.user_stats(jobs, {"total_fields": items})
    return found.withColumns({c: _shown(c) for c in ("by_status", "by_type")})


def _shown(name):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")


@query("document_summary", f"""WITH {JOBS}, e AS (SELECT document_id, string_agg(t || '=' || n, ',' ORDER BY t) AS entities_by_type FROM (SELECT l_orderkey AS document_id, l_returnflag AS t, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1), i AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem GROUP BY 1), v AS (
  SELECT user_id % 500 AS document_id, event_type AS job_type, event_type || value::INT AS status, ts, event_id, row_number() OVER (PARTITION BY user_id % 500, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events), j AS (SELECT document_id, string_agg(job_type || '=' || status, ',' ORDER BY job_type) AS latest_jobs FROM v WHERE rn = 1 GROUP BY 1)
SELECT jobs.document_id, coalesce(i.n, 0) AS fields, entities_by_type, latest_jobs FROM jobs LEFT JOIN e USING (document_id) LEFT JOIN i USING (document_id) LEFT JOIN j USING (document_id)""")  # fmt: skip
def document_summary(spark, sf_dir):
    items = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("type"))
    value = F.rint("value").cast("int").cast("string")
    runs = B.table(spark, sf_dir, "events").select((F.col("user_id") % 500).alias("document_id"), F.col("event_type").alias("job_type"), F.concat("event_type", value).alias("status"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    found = reports.document_summary(B.jobs(spark, sf_dir).select("document_id"), {"fields": items}, items, runs)
    return found.withColumns({c: _shown(c) for c in ("entities_by_type", "latest_jobs")})


@query("span_coverage", f"""WITH {CHUNKS}, c AS (SELECT document_id, CASE WHEN vec_id % 7 > 0 THEN end_page - start_page + 1 END AS span FROM chunks) SELECT document_id, count(*) AS n_chunks, count(span) AS n_ranged, count(*) FILTER (WHERE span = 1) AS single_page,
  count(*) FILTER (WHERE span > 1) AS multi_page, max(span) AS max_span, round(count(span) * 100.0 / count(*), 2) AS coverage_percent FROM c GROUP BY 1""")  # fmt: skip
def span_coverage(spark, sf_dir):
    rows = B.chunks(spark, sf_dir).withColumn("start_page", F.when(F.col("vec_id") % 7 > 0, F.col("start_page")))
    return reports.span_profile(rows)


@query("predicate_gain", f"""WITH {CHUNKS}, f AS (SELECT document_id, page_number = 2 AS a, start_page <= 2 AND end_page >= 2 AS b FROM chunks), s AS (SELECT document_id, count(*) FILTER (WHERE a) AS n_old, count(*) FILTER (WHERE b) AS n_new, count(*) FILTER (WHERE a AND NOT b) AS only_old, count(*) FILTER (WHERE b AND NOT a) AS only_new FROM f GROUP BY 1)
SELECT *, round((n_new - n_old) * 100.0 / nullif(n_old, 0), 2) AS gain_percent FROM s""")  # fmt: skip
def predicate_gain(spark, sf_dir):
    """Chunks of page 2 by page number and by page range."""
    return reports.predicate_gain(B.chunks(spark, sf_dir), F.col("page_number") == 2, C.page_overlap(2, 2), "document_id")


@query("count_reconcile_ordered", f"""WITH r AS ({SQL["count_reconcile"]}) SELECT k, expected, stored, delta, row_number() OVER (ORDER BY abs(delta) DESC, k) AS place FROM r
UNION ALL SELECT NULL, CAST(sum(expected) AS BIGINT), CAST(sum(stored) AS BIGINT), CAST(sum(delta) AS BIGINT), 0 FROM r""")
def count_reconcile_ordered(spark, sf_dir):
    expected = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("expected"))
    stored = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("stored"))
    return reports.reconciled(expected, stored, "k").withColumn("place", F.col("place").cast("bigint"))


@query("unmatched_both_sides", f"""WITH {MATCHES}, p AS (SELECT DISTINCT source_id, target_id FROM best)
SELECT p.*, 'source' AS side, c.chunk_index FROM p JOIN chunks c ON c.document_id = source_id WHERE NOT EXISTS (SELECT 1 FROM best m WHERE m.source_id = p.source_id AND m.target_id = p.target_id AND m.a_index = c.chunk_index)
UNION ALL SELECT p.*, 'target', c.chunk_index FROM p JOIN chunks c ON c.document_id = target_id WHERE NOT EXISTS (SELECT 1 FROM best m WHERE m.source_id = p.source_id AND m.target_id = p.target_id AND m.b_index = c.chunk_index)""")  # fmt: skip
def unmatched_both_sides(spark, sf_dir):
    return pairing.pair_unmatched(_matched(spark, sf_dir, "a_index", "b_index", listed=True))


@query("cleaned_logs", """SELECT event_id AS id, event_type AS action_type, NULL AS resource_type, props AS metadata, NULL AS api_endpoint FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS
UNION ALL SELECT NULL, 'cleanup', 'activity_log', '{"deleted_count":' || count(*) || '}', 'system_maintenance' FROM events WHERE ts < TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS""")  # fmt: skip
def cleaned_logs(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action_type"), none.alias("resource_type"), F.col("props").alias("metadata"), none.alias("api_endpoint"), F.col("ts").alias("logged_at"))
    return reports.cleaned_logs(rows, "2024-01-20", 10).drop("logged_at")


@query("refresh_marked", f"""WITH {JOBS} SELECT document_id, CASE WHEN priority = 1 THEN 'pending' ELSE status END AS status, CASE WHEN priority = 1 THEN 'true' END AS flag FROM jobs""")
def refresh_marked(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    found = reports.refresh_marked(jobs.select("document_id", "status", F.lit('{"pages":"3"}').alias("metadata")), jobs.filter("priority = 1"))
    return found.select("document_id", "status", F.get_json_object("metadata", "$.embedding_refresh").alias("flag"))


@query("chunk_scan_whole", f"""WITH {CHUNKS} SELECT document_id, chunk_index, CASE WHEN vec_id % 4 > 0 THEN page_number ELSE 1 END AS page_number, CAST(CASE WHEN vec_id % 6 > 0 THEN character_count WHEN vec_id % 5 = 0 THEN 1 ELSE length(repeat('ab', CAST(vec_id % 5 AS INT))) END AS BIGINT) AS character_count, len(e) AS dimension
FROM chunks WHERE vec_id % 9 <> 4 AND vec_id % 8 <> 3""")  # fmt: skip
def chunk_scan_whole(spark, sf_dir):
    """Rows without an index or page, with vectors as text, some of them no vectors, lengths from texts, and each row twice."""
    i = F.col("vec_id")
    rows = B.chunks(spark, sf_dir).withColumns(
        {
            "chunk_index": F.when(i % 9 != 4, F.col("chunk_index")),
            "page_number": F.when(i % 4 > 0, F.col("page_number")),
            "character_count": F.when(i % 6 > 0, F.col("character_count")),
            "chunk_text": F.concat(F.lit(" "), F.repeat(F.lit("a b "), (i % 5).cast("int"))),
            "embedding": F.when(i % 8 == 3, "no vector").otherwise(F.to_json("embedding")),
        }
    )
    found = reports.scan_chunks(rows.unionByName(rows.withColumns({"vec_id": i + 1_000_000, "page_number": F.lit(7)})))
    return found.select("document_id", "chunk_index", "page_number", "character_count", F.size("embedding").cast("bigint").alias("dimension"))


@query("effective_counts", f"WITH {CHUNKS} SELECT document_id, count(*) FILTER (WHERE vec_id % 5 > 0) AS effective_chunk_count, CAST(sum(CASE WHEN vec_id % 6 > 0 THEN character_count ELSE 3 END) AS BIGINT) AS total_characters FROM chunks GROUP BY 1")
def effective_counts(spark, sf_dir):
    i = F.col("vec_id")
    rows = B.chunks(spark, sf_dir).withColumns({"character_count": F.when(i % 6 > 0, F.col("character_count")), "chunk_text": F.lit("a b\n c"), "embedding": F.when(i % 5 > 0, F.col("embedding"))})
    return reports.effective_counts(rows)


@query("match_chunks", f"""WITH {CHUNKS}, q AS (SELECT vec_id AS query_id, e, CASE WHEN vec_id % 100 = 0 THEN (document_id + 1) % 50 END AS doc FROM chunks WHERE vec_id % 50 = 0), r AS (
  SELECT query_id, vec_id, list_dot_product(q.e, k.e) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(q.e, k.e) DESC, vec_id) AS rank FROM q JOIN chunks k ON (q.doc IS NULL OR q.doc = k.document_id) AND list_dot_product(q.e, k.e) > 0.05)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")  # fmt: skip
def match_chunks(spark, sf_dir):
    """Half of the stated queries look in one document; a third of the chunks have their vector in the second column."""
    chunks, i = B.chunks(spark, sf_dir), F.col("vec_id")
    queries = chunks.filter("vec_id % 50 = 0").select(i.alias("query_id"), F.col("embedding").alias("vector"), F.when(i % 100 == 0, (F.col("document_id") + 1) % 50).alias("document_id"))
    rows = chunks.withColumns({"content_embedding": F.when(i % 3 > 0, F.col("embedding")), "embeddings": F.when(i % 3 == 0, F.col("embedding"))})
    found = reports.match_chunks(queries, rows, ("content_embedding", "embeddings"), 0.05)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("fingerprint_neighbours", f"""WITH {FINGERPRINTS}, s AS (SELECT a.document_id AS query_id, b.document_id, list_dot_product(a.v, b.v) AS content, 0.7 * list_dot_product(a.v, b.v) + 0.3 * CASE WHEN a.n_sections = 0 AND b.n_sections = 0 THEN 1.0 WHEN a.n_sections = 0 OR b.n_sections = 0 THEN 0.0
  ELSE CAST(least(a.n_sections, b.n_sections) AS DOUBLE) / greatest(a.n_sections, b.n_sections) END AS score FROM prints a JOIN prints b ON a.document_id % 50 = 0 AND b.document_id <> a.document_id AND a.document_id % 3 = b.document_id % 3 AND b.document_id % 4 <> 1), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s WHERE score >= 0.1) SELECT query_id, r.document_id, d.source AS filename, round(score, 6) AS similarity_score, round(content, 6) AS content_similarity, rank FROM r JOIN documents d ON d.doc_id = r.document_id WHERE rank <= 5""")  # fmt: skip
def fingerprint_neighbours(spark, sf_dir):
    names = B.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))
    i = F.col("document_id")
    prints = _prints(spark, sf_dir).join(names, "document_id").withColumns({"user_id": i % 3, "status": F.when(i % 4 == 1, "processing").otherwise("completed")})
    found = reports.fingerprint_neighbours(prints, prints.filter(SOURCES))
    return found.withColumns({c: F.round(c, 6) for c in ("similarity_score", "content_similarity")}).withColumn("rank", F.col("rank").cast("bigint"))


@query("form_field_search", f"""WITH {JOBS}, f AS (SELECT l_orderkey AS document_id, l_returnflag || l_linenumber AS field_name, l_returnflag AS field_value, l_linestatus AS field_label, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS INT) END AS confidence_score FROM lineitem)
SELECT f.document_id, 'o' || f.document_id || '.pdf' AS filename, field_name, row_number() OVER (ORDER BY confidence_score DESC NULLS LAST, created_at DESC, f.document_id, field_name) AS place FROM f JOIN jobs j ON j.document_id = f.document_id AND j.user_id % 4 = 1 WHERE (field_name ILIKE '%r%' OR field_value ILIKE '%r%' OR field_label ILIKE '%r%')""")  # fmt: skip
def form_field_search(spark, sf_dir):
    items = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("field_name"), F.col("l_returnflag").alias("field_value"), F.col("l_linestatus").alias("field_label"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("confidence_score")
    )
    docs = B.jobs(spark, sf_dir).select("document_id", (F.col("user_id") % 4).alias("user_id"), F.concat(F.lit("o"), F.col("document_id").cast("string"), F.lit(".pdf")).alias("filename"), "created_at")
    return reports.form_field_search(items, docs, "r", 1).select("document_id", "filename", "field_name", F.col("place").cast("bigint").alias("place"))


_SETTINGS = ", ".join(f"('{s}', {m}, {'NULL' if lo is None else lo}, {by}, {rest[0]}, {rest[1]}, '{rest[2]}', {rest[3]}, {rest[4]}, '{rest[5]}')" for s, (m, lo, by, *rest) in reports.PROCESSING.items())


@query("processing_settings", f"""WITH d AS ({SQL["document_sizing"]}), m AS ({SQL["document_limits"]}), p(strategy, most, fewest, per, concurrency, delay_ms, chunking, prefetch, asynchronous, priority_level) AS (VALUES {_SETTINGS})
SELECT d.id, CASE WHEN p.fewest IS NULL THEN least(pages, most) ELSE least(most, greatest(p.fewest, CAST(floor(pages / per) AS BIGINT))) END AS batch_size, concurrency, delay_ms, chunking, prefetch, asynchronous, priority_level,
  concat_ws('; ', CASE WHEN memory_mb > 1000 THEN 'High memory requirements' END, CASE WHEN timeout_minutes > 30 THEN 'Extended processing time expected' END, CASE WHEN tier IN ('ENTERPRISE', 'MASSIVE') THEN 'Enterprise-scale document' END, CASE WHEN concurrency <= 3 THEN 'Resource-intensive processing required' END) AS reasons
FROM d JOIN m USING (id) JOIN p USING (strategy)""")  # fmt: skip
def processing_settings(spark, sf_dir):
    from .upkeep_queries import document_sizing

    rows = document_sizing(spark, sf_dir)
    limits = upkeep.limits(F.col("strategy"), F.col("pages"))
    rows = rows.withColumns({**reports.processing_settings(F.col("strategy"), F.col("pages")), **{n: limits[n] for n in ("memory_mb", "timeout_minutes")}})
    reasons = reports.special_handling(F.col("tier"), F.col("memory_mb"), F.col("timeout_minutes"), F.col("concurrency"))[0]
    return rows.select("id", "batch_size", "concurrency", "delay_ms", "chunking", "prefetch", "asynchronous", "priority_level", F.array_join(reasons, "; ").alias("reasons"))
