"""Registered queries of search requests, explanations, feature caches, records and limits with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import listing, matching, pairing, search, upkeep
from . import bindings as B
from .queries import CHUNKS, FINGERPRINTS, JOBS, MATCHES, SECTIONS, SOURCES, SQL, _candidates, _matched, _prints, query
from .upkeep_queries import SCORED_WHOLE

_SECTION = "struct<type:string,start_page:int,end_page:int,page_count:int>"


@query("exclusion_record", """WITH d AS (SELECT doc_id, CAST(doc_id % 5 + 1 AS INT) AS a, CAST(n_chars % 7 + 2 AS INT) AS n FROM documents), s AS (
  SELECT doc_id, 0 AS place, 'subscription_agreement' AS type, 1 AS start_page, 2 AS end_page, 2 AS page_count FROM d WHERE doc_id % 3 = 0 AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 1, 'appendix', a, a + 1, 2 FROM d UNION ALL SELECT doc_id, 2, 'subscription_agreement', 2, 1 + n, n FROM d WHERE doc_id % 3 <> 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS place, type, start_page, end_page, page_count FROM s""")  # fmt: skip
def exclusion_record(spark, sf_dir):
    """Documents with an appendix, every other one with an older agreement too; two of three get a new agreement record."""
    part = lambda kind, low, n: F.struct(F.lit(kind).alias("type"), low.cast("int").alias("start_page"), (low + n - 1).cast("int").alias("end_page"), n.cast("int").alias("page_count")).cast(_SECTION)
    kind, i = "subscription_agreement", F.col("doc_id")
    appendix = part("appendix", i % 5 + 1, F.lit(2))
    held = F.when(i % 2 == 0, F.array(part(kind, F.lit(1), F.lit(2)), appendix)).otherwise(F.array(appendix))
    fresh = F.when(i % 3 != 0, part(kind, F.lit(2), F.col("n_chars") % 7 + 2))
    rows = B.documents(spark, sf_dir).select("doc_id", F.posexplode(C.record_exclusion(held, fresh, kind)).alias("place", "s"))
    return rows.select("doc_id", F.col("place").cast("bigint").alias("place"), "s.*")


@query("skipped_embeddings", f"""WITH {JOBS}, m AS (SELECT id, status, CASE priority WHEN 1 THEN '{{"embeddings_skipped":true}}' WHEN 2 THEN '{{"embeddings_error":"time"}}' WHEN 3 THEN '{{"embeddings_skipped":"true"}}' WHEN 4 THEN '{{"embeddings_error":3}}' END AS metadata FROM jobs)
SELECT id FROM m WHERE status = 'completed' AND (json_type(metadata, '$.embeddings_skipped') = 'BOOLEAN' AND json_extract_string(metadata, '$.embeddings_skipped') = 'true' OR json_type(metadata, '$.embeddings_error') = 'VARCHAR')""")  # fmt: skip
def skipped_embeddings(spark, sf_dir):
    """Completed jobs whose metadata, by their priority, says that the embedding was skipped or failed."""
    texts = ('{"embeddings_skipped":true}', '{"embeddings_error":"time"}', '{"embeddings_skipped":"true"}', '{"embeddings_error":3}')
    metadata = F.try_element_at(F.array(*map(F.lit, texts)), F.col("priority"))
    return B.jobs(spark, sf_dir).filter((F.col("status") == "completed") & C.embedding_skipped(metadata)).select("id")


@query("vector_records", f"""WITH {CHUNKS}, r AS (SELECT document_id || '_chunk_' || chunk_index AS name, c.*, d.lang, d.source FROM chunks c LEFT JOIN documents d ON d.doc_id = c.document_id), kv AS (
  SELECT name, 'document_id' AS key, CAST(document_id AS VARCHAR) AS value FROM r UNION ALL SELECT name, 'chunk_index', CAST(chunk_index AS VARCHAR) FROM r UNION ALL SELECT name, 'user_id', CAST(user_id AS VARCHAR) FROM r
  UNION ALL SELECT name, 'pages', '[' || start_page || ',' || end_page || ']' FROM r UNION ALL SELECT name, 'lang', lang FROM r UNION ALL SELECT name, 'source', source FROM r)
SELECT * FROM kv WHERE value IS NOT NULL""")  # fmt: skip
def vector_records(spark, sf_dir):
    """Vector records with their own and their document's metadata, flat and without nulls, a row an entry."""
    docs = B.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "lang", "source")
    rows = B.chunks(spark, sf_dir).withColumn("pages", F.array("start_page", "end_page")).join(docs, "document_id", "left")
    kinds = {"document_id": "bigint", "chunk_index": "int", "user_id": "bigint", "pages": "array<int>", "lang": "string", "source": "string"}
    return rows.select(T.vector_id(F.col("document_id"), F.col("chunk_index")).alias("name"), F.explode(C.flatten_metadata(F.struct(*kinds), kinds)).alias("key", "value"))


@query("cache_cleanup", "SELECT count(*) FILTER (WHERE ts < newest - INTERVAL 7 DAY) AS deleted, count(*) FILTER (WHERE ts >= newest - INTERVAL 7 DAY) AS kept FROM events, (SELECT max(ts) AS newest FROM events)")
def cache_cleanup(spark, sf_dir):
    rows = C.without_expired(B.table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    return rows.agg(F.count_if("expired").alias("deleted"), F.count_if(~F.col("expired")).alias("kept"))


@query("cached_features", f"WITH {FINGERPRINTS} SELECT document_id, n_sections, complexity FROM prints WHERE document_id % 3 = 0 AND document_id % 5 = 0")
def cached_features(spark, sf_dir):
    """The feature rows of the documents asked for (ids divisible by 5) that the owner has (remainder 0 by 3)."""
    wanted = B.chunks(spark, sf_dir).filter("document_id % 5 = 0").select("document_id").distinct()
    own = _prints(spark, sf_dir).filter("document_id % 3 = 0")
    return own.join(wanted, "document_id", "left_semi").select("document_id", "n_sections", "complexity")


@query("feature_neighbours", f"""WITH {FINGERPRINTS}, own AS (SELECT p.*, d.source AS filename, d.n_chars % 5 AS n_fields FROM prints p JOIN documents d ON d.doc_id = p.document_id WHERE document_id % 3 = 0), r AS (
  SELECT a.document_id AS query_id, b.document_id, b.filename, least(b.n_fields / greatest(a.n_fields, 1), a.n_fields / greatest(b.n_fields, 1)) AS forms, list_dot_product(a.v, b.v) AS near, least(b.n_sections / greatest(a.n_sections, 1), a.n_sections / greatest(b.n_sections, 1)) AS clauses,
    least(b.complexity / greatest(a.complexity, 0.1), a.complexity / greatest(b.complexity, 0.1)) AS logic FROM own a JOIN own b ON a.document_id % 50 = 0 AND a.document_id <> b.document_id), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, document_id) AS rank FROM r WHERE near > 0.08)
SELECT query_id, document_id, filename, round(forms, 6) AS form_field_similarity, round(greatest(near * 0.5 + clauses * 0.35 + logic * 0.15, 0), 6) AS similarity_score, round(clauses, 6) AS legal_clause_similarity, round(near, 6) AS semantic_similarity, rank FROM n WHERE rank <= 20""")  # fmt: skip
def feature_neighbours(spark, sf_dir):
    names = B.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), (F.col("n_chars") % 5).alias("n_fields"))
    own = _prints(spark, sf_dir).filter("document_id % 3 = 0").join(names, "document_id")
    found = listing.feature_neighbours(own, own.filter(SOURCES), threshold=0.1)
    return found.withColumns({c: F.round(c, 6) for c in ("similarity_score", "form_field_similarity", "legal_clause_similarity", "semantic_similarity")}).withColumn("rank", F.col("rank").cast("bigint"))


@query("score_explanation", f"""WITH {MATCHES}, tot AS (SELECT document_id, CAST(sum(character_count) AS BIGINT) AS t FROM chunks GROUP BY 1), n AS (SELECT source_id, target_id, count(*) AS n FROM best GROUP BY ALL),
a AS (SELECT source_id, target_id, CAST(sum(a_chars) AS BIGINT) AS s FROM (SELECT DISTINCT source_id, target_id, a_index, a_chars FROM best) GROUP BY ALL),
b AS (SELECT source_id, target_id, CAST(sum(b_chars) AS BIGINT) AS s FROM (SELECT DISTINCT source_id, target_id, b_index, b_chars FROM best) GROUP BY ALL)
SELECT source_id, target_id, format('Source reuse {{:.1f}}% ({{:,}}/{{:,}} characters), target reuse {{:.1f}}% ({{:,}}/{{:,}} characters) across {{}} chunk pairs.',
  floor(a.s / x.t * 1000 + 0.5) / 10, a.s, x.t, floor(b.s / y.t * 1000 + 0.5) / 10, b.s, y.t, n.n) AS explanation
FROM a JOIN b USING (source_id, target_id) JOIN n USING (source_id, target_id) JOIN tot x ON x.document_id = source_id JOIN tot y ON y.document_id = target_id""")  # fmt: skip
def score_explanation(spark, sf_dir):
    found = pairing.pair_scores(_matched(spark, sf_dir, *pairing.SCORED))
    return found.select("source_id", "target_id", matching.explained().alias("explanation"))


@query("section_summary", f"""WITH {SECTIONS}, n AS (SELECT source_id, target_id, count(*) FILTER (WHERE avg_score > 0.85) AS high, count(*) FILTER (WHERE avg_score >= 0.65 AND avg_score <= 0.85) AS review, count(*) FILTER (WHERE avg_score < 0.65) AS low FROM sections GROUP BY ALL)
SELECT source_id, target_id, concat_ws(', ', CASE WHEN high > 0 THEN high || ' highly reusable sections (>85% similarity)' END, CASE WHEN review > 0 THEN review || ' sections need review (65-85% similarity)' END, CASE WHEN low > 0 THEN low || ' low similarity sections (<65%)' END) AS summary FROM n""")  # fmt: skip
def section_summary(spark, sf_dir):
    return pairing.pair_summary(pairing.pair_sections(_matched(spark, sf_dir, *pairing.PAGED)))


_LIMITS = ", ".join(f"('{s}', {', '.join(map(str, v))})" for s, v in upkeep.LIMITS.items())


@query("document_limits", f"""WITH d AS ({SQL["document_sizing"]}), l(strategy, mb, memory_buffer, most, chunk_seconds, retry_seconds, attempts) AS (VALUES {_LIMITS})
SELECT id, CAST(least(ceil(pages * 8 * 1.5), mb) AS BIGINT) AS memory_mb, memory_buffer, CAST(least(most, ceil(greatest(120, pages * 30) / 60)) AS BIGINT) AS timeout_minutes, chunk_seconds, retry_seconds, attempts FROM d JOIN l USING (strategy)""")  # fmt: skip
def document_limits(spark, sf_dir):
    """Memory and time-outs of the files that document_sizing sizes."""
    from .upkeep_queries import document_sizing

    rows = document_sizing(spark, sf_dir)
    return rows.select("id", *(c.alias(n) for n, c in upkeep.limits(F.col("strategy"), F.col("pages")).items()))


@query("search_summary", f"""WITH {SCORED_WHOLE}, s0 AS (SELECT source_id, count(*) AS n, round(avg(score), 3) AS average_score FROM stage0 WHERE rank <= 600 GROUP BY 1), s1 AS (SELECT source_id, count(*) AS n FROM candidates GROUP BY 1), s2 AS (SELECT source_id, least(count(*), 30) AS n FROM scored GROUP BY 1)
SELECT source_id, s0.n AS stage0_candidates, average_score, coalesce(s1.n, 0) AS stage1_candidates, coalesce(s2.n, 0) AS final_results FROM s0 LEFT JOIN s1 USING (source_id) LEFT JOIN s2 USING (source_id)""")  # fmt: skip
def search_summary(spark, sf_dir):
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    sources = figures.filter(SOURCES)
    found = matching.cut(search.stage0_candidates(sources.select("document_id", "centroid"), chunks))  # once, for the candidates and the figures
    pool = matching.cut(search.search_candidates(sources, chunks, found=found))
    results = matching.similarity_search(sources, chunks, figures, pool, min_source=0.0, min_target=0.0, primary=0.25, fallback=None, tolerance=0)
    return listing.search_summary(found, pool, results)


@query("search_request", f"""WITH {SCORED_WHOLE.replace("k.document_id <> s.document_id", "k.document_id <> s.document_id AND k.document_id % 3 < 2")},
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ss DESC, ts DESC, mt DESC, n DESC, target_id) AS rank FROM scored), f AS (
  SELECT r.*, row_number() OVER (PARTITION BY source_id ORDER BY round(ss, 6) DESC, round(ts, 6) DESC, n_chars DESC, d.source, target_id) AS place FROM r JOIN documents d ON d.doc_id = target_id WHERE rank <= 30 AND ss >= 0.05 AND ts >= 0.05)
SELECT source_id, target_id, round(ss, 6) AS source_score, round(ts, 6) AS target_score, place FROM f WHERE place <= 10""")  # fmt: skip
def search_request(spark, sf_dir):
    """A whole request without the fallback pass: two owners' documents, candidates, matches, scores, floors, order, ten results."""
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    titles = B.documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("created_at"), F.col("source").alias("title"))
    options = {"min_source": 0.05, "min_target": 0.05, "primary": 0.25, "fallback": None, "tolerance": 0}
    found = listing.search_request(figures.filter(SOURCES), chunks, figures, titles, asked=10.9, allowed=F.col("user_id") < 2, **options)
    return found.select("source_id", "target_id", F.round("source_score", 6).alias("source_score"), F.round("target_score", 6).alias("target_score"), F.col("place").cast("bigint").alias("place"))


@query("corpus_pairs")
def corpus_pairs(spark, sf_dir):
    """All pairs of documents with shared evidence, by their vectors; the recall of the index is tested and stated."""
    return matching.corpus_pairs(B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir), primary=0.25, fallback=None, tolerance=0)
