"""Registered queries of the library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, is_normalized, norm
from ..operators import activity as A
from ..operators import catalog as C
from ..operators import chunking, matching, pairing, search, upkeep
from ..streaming import feeds
from . import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The searches' stated query set; it is compared with all documents.
SOURCES = "document_id % 50 = 0"

CHUNKS = """chunks AS (
  SELECT vec_id, vec_id // 10 AS document_id, CAST(vec_id % 10 AS INT) AS chunk_index, CAST(1 + (vec_id % 10) // 2 AS INT) AS page_number,
    CAST(1 + (vec_id % 10) // 2 AS INT) AS start_page, CAST(1 + (vec_id % 10) // 2 + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS INT) AS end_page,
    CAST(200 + (vec_id * 37) % 800 AS INT) AS character_count, (vec_id // 10) % 3 AS user_id, label, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings)"""
CENTROIDS = f"""{CHUNKS}, places AS (
  SELECT document_id, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS x FROM chunks), means AS (
  SELECT document_id, place, avg(x) AS x FROM places GROUP BY ALL), raw AS (
  SELECT document_id, list(x ORDER BY place) AS c, sqrt(sum(x * x)) AS n FROM means GROUP BY 1), centroids AS (
  SELECT document_id, [x / n FOR x IN c] AS c FROM raw)"""
JOBS = """jobs AS (
  SELECT o_orderkey AS id, o_orderkey AS document_id, o_custkey AS user_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' WHEN 'F' THEN 'completed' END AS status,
    CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS file_size FROM orders)"""
ACTIVITY = """activity AS (
  SELECT event_id AS id, user_id AS user_uuid, CASE event_type WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'login' ELSE event_type END AS action_type,
    ts AS logged_at, value * 10 AS duration_ms, props AS metadata FROM events)"""
PARAGRAPHS = """paras AS (
  SELECT doc_id AS document_id, unnest(range(0, len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"""
MATCHES = f"""{CHUNKS}, cand AS (
  SELECT a.document_id AS source_id, b.document_id AS target_id, a.chunk_index AS a_index, b.chunk_index AS b_index, a.page_number AS a_page, b.page_number AS b_page,
    a.start_page AS a_start, a.end_page AS a_end, b.start_page AS b_start, b.end_page AS b_end, a.character_count AS a_chars, b.character_count AS b_chars, list_dot_product(a.e, b.e) AS score
  FROM chunks a JOIN chunks b ON a.document_id % 50 = 0 AND b.document_id <> a.document_id AND list_dot_product(a.e, b.e) >= 0.25), best AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, a_index ORDER BY score DESC, abs(a_page - b_page), b_index) AS rn FROM cand) WHERE rn = 1
  UNION
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id, b_index ORDER BY score DESC, abs(a_page - b_page), a_index) AS rn FROM cand) WHERE rn = 1)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _matched(spark: SparkSession, sf_dir: str, *fields: str, listed: bool = False) -> DataFrame:
    """Documents of the stated query set, those whose id is divisible by 50, and the others that have a chunk near one of theirs, with the best matches' `fields`."""
    chunks = B.chunks(spark, sf_dir)
    return pairing.matched_pairs(chunks.filter(SOURCES), chunks, 0.25, None, tolerance=0, listed=listed, fields=fields or pairing.FIELDS)


@query("centroid", f"WITH {CENTROIDS} SELECT document_id, unnest(range(1, len(c) + 1)) - 1 AS place, round(unnest(c), 6) AS x FROM centroids")
def centroid(spark, sf_dir):
    found = B.document_figures(spark, sf_dir)
    return found.select("document_id", F.posexplode("centroid").alias("place", "x")).select("document_id", F.col("place").cast("bigint").alias("place"), F.round("x", 6).alias("x"))


STAGE0 = f"""{CENTROIDS}, hits AS (
  SELECT s.document_id AS source_id, k.document_id, list_dot_product(s.c, k.e) AS score, row_number() OVER (PARTITION BY s.document_id ORDER BY list_dot_product(s.c, k.e) DESC, vec_id) AS rn
  FROM centroids s JOIN chunks k ON s.document_id % 50 = 0 AND k.document_id <> s.document_id), top AS (
  SELECT source_id, document_id, max(score) AS score FROM hits WHERE rn <= 40 GROUP BY ALL), stage0 AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, document_id) AS rank FROM top)"""


def _candidates(spark, sf_dir):
    """Stages 0 and 1 with the operator's own bounds: 600 candidates, and 250 by chunks where there are more."""
    sources = B.document_figures(spark, sf_dir).filter(SOURCES).select("document_id", "centroid")
    return search.search_candidates(sources, B.chunks(spark, sf_dir))


STAGE0_WHOLE = STAGE0.replace("rn <= 40", "rn <= 1200")


@query("stage0_candidates", f"WITH {STAGE0_WHOLE} SELECT source_id, document_id, round(score, 6) AS score, rank FROM stage0 WHERE rank <= 600")
@query("stage0_whole", f"WITH {STAGE0_WHOLE} SELECT source_id, document_id, round(score, 6) AS score, rank FROM stage0 WHERE rank <= 600")
def stage0_whole(spark, sf_dir):
    sources = B.document_figures(spark, sf_dir).filter(SOURCES).select("document_id", "centroid")
    found = search.stage0_candidates(sources, B.chunks(spark, sf_dir))
    return found.select("source_id", "document_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


CANDIDATES = f"""{STAGE0_WHOLE}, pool AS (SELECT source_id, document_id, count(*) OVER (PARTITION BY source_id) AS n FROM stage0 WHERE rank <= 600), near AS (
  SELECT a.document_id AS source_id, a.vec_id AS q, b.document_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.e, b.e) DESC, b.vec_id) AS rn
  FROM chunks a JOIN chunks b ON a.document_id % 50 = 0), cnt AS (
  SELECT source_id, document_id, count(DISTINCT q) AS matched_chunks FROM near JOIN pool USING (source_id, document_id) WHERE n > 250 AND rn <= CASE WHEN n <= 400 THEN 36 ELSE 45 END GROUP BY ALL), filtered AS (
  SELECT source_id, document_id, row_number() OVER (PARTITION BY source_id ORDER BY matched_chunks DESC, document_id) AS rank FROM cnt), candidates AS (
  SELECT source_id, document_id FROM filtered WHERE rank <= 250 UNION ALL SELECT source_id, document_id FROM pool WHERE n <= 250)"""


@query("stage1_prefilter", f"WITH {CANDIDATES} SELECT source_id, document_id FROM candidates")
@query("stage1_whole", f"WITH {CANDIDATES} SELECT source_id, document_id FROM candidates")
def stage1_whole(spark, sf_dir):
    """The candidates that the search goes on from."""
    return _candidates(spark, sf_dir)


@query("best_match", f"WITH {MATCHES} SELECT source_id, target_id, a_index, b_index, round(score, 6) AS score FROM best")
def best_match(spark, sf_dir):
    found = pairing.exploded(_matched(spark, sf_dir, "a_index", "b_index", "score"), "matches", *matching.PAIR)
    return found.select("source_id", "target_id", "a_index", "b_index", F.round("score", 6).alias("score"))


@query("pair_evidence", f"""WITH {MATCHES}, tot AS (SELECT document_id, sum(character_count) AS t FROM chunks GROUP BY 1)
SELECT source_id, target_id, CAST(least(sum(a_chars), sum(b_chars)) AS BIGINT) AS evidence FROM best JOIN tot x ON x.document_id = source_id JOIN tot y ON y.document_id = target_id
GROUP BY source_id, target_id, x.t, y.t HAVING least(sum(a_chars), sum(b_chars)) >= greatest(1600, ceil(0.05 * least(x.t, y.t)))""")  # fmt: skip
def pair_evidence(spark, sf_dir):
    found = _matched(spark, sf_dir, "a_chars", "b_chars")
    return found.filter(pairing.enough(found)).select("source_id", "target_id", pairing.evidence(found).alias("evidence"))


@query("adaptive_score", f"""WITH {MATCHES}, tot AS (SELECT document_id, sum(character_count) AS t FROM chunks GROUP BY 1),
a AS (SELECT source_id, target_id, sum(a_chars) AS s, count(*) AS n FROM (SELECT DISTINCT source_id, target_id, a_index, a_chars FROM best) GROUP BY ALL),
b AS (SELECT source_id, target_id, sum(b_chars) AS s FROM (SELECT DISTINCT source_id, target_id, b_index, b_chars FROM best) GROUP BY ALL)
SELECT source_id, target_id, CAST(a.s AS BIGINT) AS matched_source_chars, CAST(b.s AS BIGINT) AS matched_target_chars, a.n AS matched_chunks,
  round(a.s / x.t, 6) AS source_score, round(b.s / y.t, 6) AS target_score, round(x.t / y.t * 100, 6) AS length_ratio
FROM a JOIN b USING (source_id, target_id) JOIN tot x ON x.document_id = source_id JOIN tot y ON y.document_id = target_id""")  # fmt: skip
def adaptive_score(spark, sf_dir):
    found = pairing.pair_scores(_matched(spark, sf_dir, *pairing.SCORED)).drop("n_pairs", "source_total", "target_total")
    return found.withColumns({c: F.round(c, 6) for c in ("source_score", "target_score", "length_ratio")})


SECTIONS = f"""{MATCHES}, marks AS (
  SELECT *, CASE WHEN a_page - lag(a_page) OVER w > 1 THEN 1 ELSE 0 END AS new FROM best WINDOW w AS (PARTITION BY source_id, target_id ORDER BY a_page, b_page, a_index, b_index)), numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY source_id, target_id ORDER BY a_page, b_page, a_index, b_index ROWS UNBOUNDED PRECEDING) AS section FROM marks), sections AS (
  SELECT source_id, target_id, CAST(section AS BIGINT) AS section, avg(score) AS avg_score, count(*) AS n_matches, min(a_page) AS a_first, max(a_page) AS a_last, min(b_page) AS b_first, max(b_page) AS b_last FROM numbered GROUP BY ALL)"""


@query("sections", f"""WITH {SECTIONS} SELECT source_id, target_id, section, round(avg_score, 6) AS avg_score, n_matches, CASE WHEN a_first = a_last THEN CAST(a_first AS VARCHAR) ELSE a_first || '-' || a_last END AS source_pages,
  CASE WHEN b_first = b_last THEN CAST(b_first AS VARCHAR) ELSE b_first || '-' || b_last END AS target_pages, avg_score > 0.85 AS reusable, CASE WHEN avg_score > 0.85 THEN 'high' WHEN avg_score >= 0.65 THEN 'review' ELSE 'low' END AS tier FROM sections""")  # fmt: skip
def sections(spark, sf_dir):
    found = matching.shown_sections(pairing.exploded(pairing.pair_sections(_matched(spark, sf_dir, *pairing.PAGED)), "sections", *matching.PAIR))
    return found.select("source_id", "target_id", "section", F.round("avg_score", 6).alias("avg_score"), "n_matches", "source_pages", "target_pages", "reusable", "tier")


@query("section_coverage", f"""WITH {SECTIONS}, pc AS (SELECT document_id, max(end_page) AS n FROM chunks GROUP BY 1),
a AS (SELECT source_id, target_id, count(DISTINCT p) AS n FROM (SELECT source_id, target_id, unnest(range(a_first, a_last + 1)) AS p FROM sections) GROUP BY ALL),
b AS (SELECT source_id, target_id, count(DISTINCT p) AS n FROM (SELECT source_id, target_id, unnest(range(b_first, b_last + 1)) AS p FROM sections) GROUP BY ALL)
SELECT source_id, target_id, a.n AS a_pages, b.n AS b_pages, round(a.n * 100.0 / x.n, 6) AS a_percent, round(b.n * 100.0 / y.n, 6) AS b_percent
FROM a JOIN b USING (source_id, target_id) JOIN pc x ON x.document_id = source_id JOIN pc y ON y.document_id = target_id""")  # fmt: skip
def section_coverage(spark, sf_dir):
    found = pairing.pair_coverage(pairing.pair_sections(_matched(spark, sf_dir, *pairing.PAGED)))
    return found.select("source_id", "target_id", "a_pages", "b_pages", F.round("a_percent", 6).alias("a_percent"), F.round("b_percent", 6).alias("b_percent"))


@query("similarity_search")
def similarity_search(spark, sf_dir):
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    return matching.similarity_search(figures.filter(SOURCES), chunks, figures, _candidates(spark, sf_dir), min_source=0.0, min_target=0.0, primary=0.25, fallback=0.15, floor=1600)


@query("selected_search")
def selected_search(spark, sf_dir):
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    return matching.selected_search(figures.filter(SOURCES), figures.filter("total_characters >= 6000"), chunks, figures, primary=0.25, fallback=0.15)


@query("corpus_reuse")
def corpus_reuse(spark, sf_dir):
    """Each document's text that stands in any other document, by runs of eight words."""
    return matching.listed_reuse(chunking.chunk_lists(B.documents(spark, sf_dir)))


@query("chunk_build")
def chunk_build(spark, sf_dir):
    return chunking.build_chunks(B.documents(spark, sf_dir))


@query("sentence_chunks")
def sentence_chunks(spark, sf_dir):
    return chunking.sentence_chunks(B.table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text"), "id", "text")


INCOMPLETE = rf"(^|\s)({T.JOINING_WORDS}|{T.NUMBER_WORDS})$|({'|'.join(T.JOINING_PHRASES)})$"


@query("merge_incomplete", rf"""WITH {PARAGRAPHS}, kept AS (SELECT *, length(regexp_replace(text, '\s+', '', 'g')) AS chars, lead(text) OVER w AS next, row_number() OVER w AS r FROM paras WHERE trim(text) <> '' WINDOW w AS (PARTITION BY document_id ORDER BY idx)), marks AS (
  SELECT *, coalesce(next IS NOT NULL AND NOT regexp_matches(trim(text), '[.!?;:)]$') AND (regexp_matches(lower(trim(text)), '{INCOMPLETE}') OR regexp_matches(trim(next), '^[a-z]'))
    AND chars + lead(chars) OVER (PARTITION BY document_id ORDER BY idx) < 1000, false) AS can FROM kept), runs AS (
  SELECT *, coalesce(max(CASE WHEN NOT can THEN r END) OVER (PARTITION BY document_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marks)
SELECT document_id, idx, md5(CASE WHEN can THEN text || ' ' || next ELSE text END) AS text_md5 FROM runs WHERE (r - before) % 2 = 1""")  # fmt: skip
def merge_incomplete(spark, sf_dir):
    rows = chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text").filter("trim(text) <> ''")
    return chunking.merge_incomplete(rows, 1000).select("document_id", F.col("idx").cast("bigint").alias("idx"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("merge_tiny")
def merge_tiny(spark, sf_dir):
    return chunking.merge_tiny(chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text"), 80, 1000)


@query("split_oversized")
def split_oversized(spark, sf_dir):
    return chunking.split_oversized(chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text"), 400)


@query("paged_chunks")
def paged_chunks(spark, sf_dir):
    """Each document's lines as its pages."""
    return chunking.paged_chunks(chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text", per_page=1))


@query("ivf_neighbours")
def ivf_neighbours(spark, sf_dir):
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search.approximate_nearest(vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), vectors, 10)


@query("vector_match", f"""WITH {CHUNKS}, hits AS (SELECT q.vec_id AS query_id, k.vec_id, list_dot_product(q.e, k.e) AS score FROM chunks q JOIN chunks k ON q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM hits WHERE score >= 0.2)
SELECT query_id, vec_id, document_id, user_id, round(score, 6) AS score, rank FROM r JOIN chunks USING (vec_id) WHERE rank <= 10""")  # fmt: skip
def vector_match(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    vectors = chunks.select("vec_id", F.col("embedding").alias("vector"))
    hits = search.nearest(vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), vectors, 10, 0.2)
    return hits.join(chunks, "vec_id").select("query_id", "vec_id", "document_id", "user_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("vector_checks", f"WITH {CHUNKS} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, abs(sqrt(list_dot_product(e, e)) - 1) <= 0.01 AS normalized FROM chunks")
def vector_checks(spark, sf_dir):
    v = F.col("embedding")
    return B.chunks(spark, sf_dir).select("vec_id", F.round(norm(v), 6).alias("norm"), is_normalized(v).alias("normalized"))


@query("vector_store_stats", "SELECT count(*) AS total_vectors, max(len(embedding)) AS dimension FROM embeddings")
def vector_store_stats(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total_vectors"), F.max(F.size("embedding")).cast("bigint").alias("dimension"))


FINGERPRINTS = f"""{CENTROIDS}, prints AS (SELECT c.document_id, c.c AS v, count(*) FILTER (WHERE label % 2 = 0) AS n_sections, CAST(sum(character_count) AS DOUBLE) AS complexity
  FROM centroids c JOIN chunks USING (document_id) GROUP BY ALL)"""


def _prints(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    sums = chunks.groupBy("document_id").agg(A.count_if(F.col("label") % 2 == 0).alias("n_sections"), F.sum("character_count").cast("double").alias("complexity"))
    return sums.join(B.document_figures(spark, sf_dir).select("document_id", F.col("centroid").alias("v")), "document_id")


FINGERPRINT = f"""WITH {FINGERPRINTS} SELECT b.document_id, round(0.7 * list_dot_product(a.v, b.v) + 0.3 * CASE WHEN a.n_sections = 0 AND b.n_sections = 0 THEN 1.0 WHEN a.n_sections = 0 OR b.n_sections = 0 THEN 0.0
  ELSE CAST(least(a.n_sections, b.n_sections) AS DOUBLE) / greatest(a.n_sections, b.n_sections) END, 6) AS similarity FROM prints a JOIN prints b ON a.document_id = 0 AND b.document_id <> 0"""  # fmt: skip


FEATURE = f"""WITH {FINGERPRINTS} SELECT b.document_id, round(0.5 * list_dot_product(a.v, b.v) + 0.35 * least((a.n_sections + 1.0) / (b.n_sections + 1.0), (b.n_sections + 1.0) / (a.n_sections + 1.0))
  + 0.15 * least(a.complexity / b.complexity, b.complexity / a.complexity), 6) AS similarity FROM prints a JOIN prints b ON a.document_id = 0 AND b.document_id <> 0 AND list_dot_product(a.v, b.v) > 0"""  # fmt: skip


RRF = f"""WITH {CHUNKS}, q AS (SELECT vec_id AS query_id, e FROM chunks WHERE vec_id % 50 = 0),
a AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(chunks.e, q.e) DESC, vec_id) AS rank FROM chunks, q), b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY character_count DESC, vec_id) AS rank FROM chunks)
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT query_id, id, rank FROM b, q WHERE rank <= 50) GROUP BY query_id, id"""  # fmt: skip


@query("rrf", RRF)
@query("rrf_by_query", RRF)
def rrf_by_query(spark, sf_dir):
    """`rrf` for the stated query set."""
    chunks = B.chunks(spark, sf_dir)
    vectors = chunks.select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    near = search.nearest(queries, vectors, 50).select("query_id", F.col("vec_id").alias("id"), "rank")
    top = chunks.sort(F.desc("character_count"), "vec_id").limit(50)
    long = top.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("character_count"), "vec_id")).alias("rank"))
    each = queries.select("query_id").crossJoin(F.broadcast(long))  # 50 rows
    return search.rank_fusion([near, each], by=("query_id",)).select("query_id", "id", F.round("score", 9).alias("score"))


def _with_sources(prints, columns):
    """Each print beside each other document of the query set, which is broadcast in blocks of search.BLOCK rows."""
    sources = prints.filter(SOURCES).select(F.col("document_id").alias("query_id"), *columns)
    n = max(1, -(-sources.count() // search.BLOCK))
    both = None
    for i in range(n):
        block = sources.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)
        part = prints.crossJoin(F.broadcast(block))
        both = part if both is None else both.unionByName(part)
    return both.filter("document_id <> query_id")


def _by_query(sql):
    """The twin of a comparison with document 0, for the stated query set."""
    return sql.replace("a.document_id = 0 AND b.document_id <> 0", "a.document_id % 50 = 0 AND b.document_id <> a.document_id").replace("SELECT b.document_id", "SELECT a.document_id AS query_id, b.document_id")


@query("fingerprint_similarity", _by_query(FINGERPRINT))
@query("fingerprint_similarity_by_query", _by_query(FINGERPRINT))
def fingerprint_similarity_by_query(spark, sf_dir):
    """`fingerprint_similarity` for the stated query set."""
    both = _with_sources(_prints(spark, sf_dir), [F.col("v").alias("v0"), F.col("n_sections").alias("n0")])
    n, n0 = F.col("n_sections"), F.col("n0")
    structure = F.when((n == 0) & (n0 == 0), 1.0).when((n == 0) | (n0 == 0), 0.0).otherwise(F.least(n, n0).cast("double") / F.greatest(n, n0))
    return both.select("query_id", "document_id", F.round(0.7 * cosine(F.col("v"), F.col("v0")) + 0.3 * structure, 6).alias("similarity"))


@query("feature_similarity", _by_query(FEATURE))
@query("feature_similarity_by_query", _by_query(FEATURE))
def feature_similarity_by_query(spark, sf_dir):
    """`feature_similarity` for the stated query set."""
    both = _with_sources(_prints(spark, sf_dir), [F.col("v").alias("v0"), (F.col("n_sections") + 1.0).alias("n0"), F.col("complexity").alias("x0")])
    near = cosine(F.col("v"), F.col("v0"))
    ratio = lambda a, b: F.least(a / b, b / a)
    score = 0.5 * near + 0.35 * ratio(F.col("n_sections") + 1.0, F.col("n0")) + 0.15 * ratio(F.col("complexity"), F.col("x0"))
    return both.filter(near > 0).select("query_id", "document_id", F.round(score, 6).alias("similarity"))


@query("page_overlap", f"""WITH {CHUNKS} SELECT CASE WHEN start_page >= 2 AND end_page <= 3 THEN 'inside' WHEN start_page < 2 THEN 'starts earlier' ELSE 'ends later' END AS category, count(*) AS n
FROM chunks WHERE start_page <= 3 AND end_page >= 2 GROUP BY 1""")  # fmt: skip
def page_overlap(spark, sf_dir):
    return B.chunks(spark, sf_dir).filter(C.page_overlap(2, 3)).groupBy(C.overlap_category(2, 3).alias("category")).agg(F.count("*").alias("n"))


@query("page_predicates", f"WITH {CHUNKS} SELECT document_id, count(*) FILTER (WHERE page_number = 2) AS by_page, count(*) FILTER (WHERE start_page <= 2 AND end_page >= 2) AS by_overlap FROM chunks GROUP BY 1")
def page_predicates(spark, sf_dir):
    return B.chunks(spark, sf_dir).groupBy("document_id").agg(A.count_if(F.col("page_number").between(2, 2)).alias("by_page"), A.count_if(C.page_overlap(2, 2)).alias("by_overlap"))


@query("page_span_profile", f"WITH {CHUNKS} SELECT least(end_page - start_page + 1, 6) AS span, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM chunks GROUP BY 1")
def page_span_profile(spark, sf_dir):
    spans = B.chunks(spark, sf_dir).groupBy(F.least(F.col("end_page") - F.col("start_page") + 1, F.lit(6)).alias("span")).agg(F.count("*").alias("n"))
    return spans.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))  # six rows


@query("chunks_per_page", f"WITH {CHUNKS} SELECT document_id, page, count(*) AS n FROM (SELECT document_id, unnest(range(start_page, end_page + 1)) AS page FROM chunks) GROUP BY ALL")
def chunks_per_page(spark, sf_dir):
    return B.chunks(spark, sf_dir).select("document_id", F.explode(F.sequence(F.col("start_page").cast("bigint"), F.col("end_page").cast("bigint"))).alias("page")).groupBy("document_id", "page").agg(F.count("*").alias("n"))


@query("page_order_anomalies", f"""WITH {CHUNKS}, r AS (SELECT *, vec_id // 40 AS volume, lag(end_page) OVER w AS prev_end, row_number() OVER w AS place FROM chunks WINDOW w AS (PARTITION BY vec_id // 40 ORDER BY vec_id)), m AS (
  SELECT volume, vec_id, start_page, prev_end, coalesce(prev_end - start_page > 1, false) AS out_of_order, start_page = 1 AND end_page = 1 AND place >= 12 AS stuck FROM r) SELECT * FROM m WHERE out_of_order OR stuck""")  # fmt: skip
def page_order_anomalies(spark, sf_dir):
    """Volumes of four documents, so that pages start anew within them."""
    rows = B.chunks(spark, sf_dir).withColumn("volume", F.expr("vec_id div 40"))
    return C.page_order_anomalies(rows, "volume", "vec_id").select("volume", "vec_id", "start_page", "prev_end", "out_of_order", "stuck")


@query("chunk_scan", f"WITH {CHUNKS} SELECT document_id, chunk_index, page_number, character_count, len(e) AS dimension FROM chunks")
def chunk_scan(spark, sf_dir):
    first = B.chunks(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("document_id", "chunk_index").orderBy("vec_id"))).filter("rn = 1")
    return first.select("document_id", "chunk_index", F.coalesce("page_number", F.lit(1)).alias("page_number"), F.coalesce(F.nullif("character_count", F.lit(0)), F.lit(1)).alias("character_count"), F.size("embedding").cast("bigint").alias("dimension"))


@query("readiness", f"WITH {CHUNKS} SELECT document_id, count(*) AS n_chunks, count(e) = count(*) AS ready FROM chunks GROUP BY 1")
def readiness(spark, sf_dir):
    return B.chunks(spark, sf_dir).groupBy("document_id").agg(F.count("*").alias("n_chunks"), (F.count("embedding") == F.count("*")).alias("ready"))


@query("stale_vectors", "SELECT vec_id, vec_id // 10 AS document_id FROM embeddings WHERE vec_id // 10 NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 500)")
def stale_vectors(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    named = chunks.select("vec_id", T.vector_id(F.col("document_id"), F.col("chunk_index")).alias("name")).withColumn("document_id", T.document_of_vector(F.col("name")).cast("bigint"))
    valid = B.documents(spark, sf_dir).filter("n_chars >= 500").select(F.col("doc_id").alias("document_id"))
    return named.join(valid, "document_id", "left_anti").select("vec_id", "document_id")


@query("count_reconcile", """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS stored, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k""")  # fmt: skip
def count_reconcile(spark, sf_dir):
    expected = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("expected"))
    return C.reconcile(expected, B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("stored")), "k")


@query("orphans", "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphans(spark, sf_dir):
    return C.orphans(B.table(spark, sf_dir, "events"), B.table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "user_id", "c_custkey").select("event_id", "user_id")


@query("latest_status", """SELECT user_id AS document_id, event_id AS seq, event_type AS status, ts AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")  # fmt: skip
def latest_status(spark, sf_dir):
    return A.latest(B.snapshots(spark, sf_dir), "document_id", "created_at", "seq", ["status"]).select("document_id", "seq", "status", "created_at")


@query("status_retention", "SELECT user_id AS document_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def status_retention(spark, sf_dir):
    return A.newest(B.snapshots(spark, sf_dir), "document_id", "created_at", "seq").select("document_id", "seq")


@query("change_feed", """SELECT user_id AS id, event_id AS seq, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")  # fmt: skip
def change_feed(spark, sf_dir):
    feed = B.feed(spark, sf_dir)
    empty = feed.select("id", "seq", "value").filter("false")
    early = feeds.apply_changes(empty, feed.filter("seq % 2 = 0"))  # what comes again later changes nothing
    return feeds.apply_changes(early, feed).select("id", "seq", F.round("value", 6).alias("value"))


@query("activity_stats", f"""WITH {ACTIVITY} SELECT count(*) AS total, count(DISTINCT user_uuid) + max(CASE WHEN user_uuid IS NULL THEN 1 ELSE 0 END) AS unique_users, count(*) FILTER (WHERE action_type = 'upload') AS uploads,
  count(*) FILTER (WHERE action_type = 'delete') AS deletes, count(*) FILTER (WHERE action_type = 'search') AS searches, count(*) FILTER (WHERE action_type = 'download') AS downloads, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_duration_ms FROM activity""")  # fmt: skip
def activity_stats(spark, sf_dir):
    return A.activity_stats(B.activity(spark, sf_dir))


@query("activity_daily", f"WITH {ACTIVITY} SELECT strftime(logged_at, '%Y-%m-%d') AS day, action_type, count(*) AS n, count(DISTINCT user_uuid) AS users FROM activity GROUP BY ALL")
def activity_daily(spark, sf_dir):
    return B.activity(spark, sf_dir).groupBy(F.date_format("logged_at", "yyyy-MM-dd").alias("day"), "action_type").agg(F.count("*").alias("n"), F.countDistinct("user_uuid").alias("users"))


@query("activity_recent", f"""WITH {ACTIVITY} SELECT id, user_uuid, action_type, CASE action_type WHEN 'upload' THEN 'Uploaded document' WHEN 'delete' THEN 'Deleted document' WHEN 'search' THEN 'Searched documents' WHEN 'similarity' THEN 'Found similar documents' ELSE action_type END AS description
FROM activity WHERE logged_at >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")  # fmt: skip
def activity_recent(spark, sf_dir):
    rows = B.activity(spark, sf_dir)
    last = rows.agg(F.max("logged_at").alias("m"))
    recent = rows.crossJoin(F.broadcast(last)).filter("logged_at >= m - INTERVAL 7 DAYS")  # `last` is one row
    return recent.select("id", "user_uuid", "action_type", A.describe_action(F.col("action_type")).alias("description"))


@query("activity_coerced", f"WITH {ACTIVITY} SELECT CASE WHEN action_type IN ('upload', 'search', 'view') THEN action_type ELSE 'view' END AS action, count(*) AS n FROM activity GROUP BY 1")
def activity_coerced(spark, sf_dir):
    return B.activity(spark, sf_dir).groupBy(A.coerce(F.col("action_type"), ("upload", "search", "view"), "view").alias("action")).agg(F.count("*").alias("n"))


@query("usage_analytics", f"""WITH {ACTIVITY} SELECT CAST(date_part('hour', logged_at) AS INT) AS hour, count(*) AS n, count(DISTINCT user_uuid) AS users, round(avg(duration_ms), 4) AS mean_ms FROM activity GROUP BY 1""")
def usage_analytics(spark, sf_dir):
    return B.activity(spark, sf_dir).groupBy(F.hour("logged_at").alias("hour")).agg(F.count("*").alias("n"), F.countDistinct("user_uuid").alias("users"), F.round(F.avg("duration_ms"), 4).alias("mean_ms"))


@query("metadata_flatten", f"WITH {ACTIVITY} SELECT id, unnest(json_keys(metadata)) AS k, json_extract_string(metadata, unnest(json_keys(metadata))) AS v FROM activity")
def metadata_flatten(spark, sf_dir):
    rows = B.activity(spark, sf_dir).select("id", F.map_filter(F.from_json("metadata", "map<string,string>"), lambda _, v: v.isNotNull()).alias("m"))
    return rows.select("id", F.explode("m").alias("k", "v"))


@query("job_queue_topk", f"WITH {JOBS} SELECT id, status, priority FROM jobs WHERE status IN ('queued', 'processing') ORDER BY priority DESC, created_at, id LIMIT 25")
def job_queue_topk(spark, sf_dir):
    return A.queue(B.jobs(spark, sf_dir), 25).select("id", "status", "priority")


@query("job_performance", f"WITH {JOBS} SELECT status, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg(file_size), 4) AS avg_size FROM jobs GROUP BY ALL")
def job_performance(spark, sf_dir):
    return B.jobs(spark, sf_dir).groupBy("status", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("file_size"), 4).alias("avg_size"))


@query("user_analytics", f"""WITH {JOBS} SELECT user_id, count(*) AS total_documents, count(*) FILTER (WHERE status = 'completed') AS completed_documents, count(*) FILTER (WHERE status = 'processing') AS processing_documents,
  count(*) FILTER (WHERE status = 'error') AS error_documents, CAST(sum(file_size) AS BIGINT) AS total_file_size, round(avg(file_size), 4) AS avg_file_size, min(created_at) AS first_upload, max(created_at) AS last_upload FROM jobs GROUP BY 1""")  # fmt: skip
def user_analytics(spark, sf_dir):
    return A.user_analytics(B.jobs(spark, sf_dir)).withColumn("avg_file_size", F.round("avg_file_size", 4))


@query("user_storage", f"WITH {JOBS} SELECT user_id, status, count(*) AS n, round(sum(file_size) / 1048576.0, 2) AS storage_mb FROM jobs GROUP BY ALL")
def user_storage(spark, sf_dir):
    return B.jobs(spark, sf_dir).groupBy("user_id", "status").agg(F.count("*").alias("n"), F.round(F.sum("file_size") / 1048576.0, 2).alias("storage_mb"))


@query("health_dashboard", f"""WITH {JOBS}, parts AS (SELECT 'jobs' AS component, status FROM jobs UNION ALL SELECT 'urgent', status FROM jobs WHERE priority = 1)
SELECT component, count(*) AS total_count, count(*) FILTER (WHERE status = 'completed') AS healthy_count, count(*) FILTER (WHERE status = 'error') AS error_count, round(count(*) FILTER (WHERE status = 'completed') * 100.0 / count(*), 2) AS health_percentage FROM parts GROUP BY 1""")  # fmt: skip
def health_dashboard(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    return A.health({"jobs": jobs, "urgent": jobs.filter("priority = 1")}).withColumn("health_percentage", F.col("health_percentage").cast("double"))


@query("retry_eligible", f"WITH {JOBS} SELECT document_id FROM jobs j WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM jobs a WHERE a.document_id = j.document_id AND a.status IN ('queued', 'processing'))")
def retry_eligible(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir)
    docs = jobs.select("document_id", F.when(F.col("status") == "completed", "error").otherwise("x").alias("status"), F.lit(False).alias("embeddings_skipped"), "user_id")
    return A.retry_eligible(docs, jobs).select("document_id")


@query("job_after_attempt", f"WITH {JOBS} SELECT CASE WHEN priority < 3 THEN 'queued' ELSE 'error' END AS next_status, count(*) AS n FROM jobs GROUP BY 1")
def job_after_attempt(spark, sf_dir):
    return B.jobs(spark, sf_dir).groupBy(A.normal_status(A.after_attempt(F.col("priority"), F.lit(3))).alias("next_status")).agg(F.count("*").alias("n"))


@query("job_documents", f"WITH {JOBS} SELECT id, c_name, c_mktsegment FROM jobs JOIN customer ON user_id = c_custkey WHERE status = 'processing'")
def job_documents(spark, sf_dir):
    owners = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name", "c_mktsegment")
    return B.jobs(spark, sf_dir).filter("status = 'processing'").join(owners, "user_id").select("id", "c_name", "c_mktsegment")


@query("listing_nested", "SELECT c_custkey, count(o_orderkey) AS n_jobs, coalesce(max(o_orderkey), 0) AS last_job FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def listing_nested(spark, sf_dir):
    nested = C.nest_children(B.table(spark, sf_dir, "customer").select("c_custkey"), B.table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", ["o_orderkey", "o_orderstatus"], "jobs")
    last = F.coalesce(F.array_max(F.transform("jobs", lambda j: j.o_orderkey)), F.lit(0))
    return nested.select("c_custkey", F.size("jobs").cast("bigint").alias("n_jobs"), last.alias("last_job"))


@query("facet_filter", "SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND lang IN ('en', 'de') AND source = 'src3' AND n_chars > 500")
def facet_filter(spark, sf_dir):
    return B.documents(spark, sf_dir).filter(C.search_titles("the", ("text",)) & C.metadata_filter({"lang": ["en", "de"], "source": [" src3 "], "user_id": 4, "blank": ""}) & (F.col("n_chars") > 500)).select("doc_id")


@query("facet_counts", "SELECT lang, source, count(*) AS n, GROUPING(lang) AS all_langs, GROUPING(source) AS all_sources FROM documents GROUP BY CUBE (lang, source)")
def facet_counts(spark, sf_dir):
    return B.documents(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"), F.grouping("lang").cast("bigint").alias("all_langs"), F.grouping("source").cast("bigint").alias("all_sources"))


@query("keyset_page", "SELECT doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id > 100) > 20 AS has_more FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 20")
def keyset_page(spark, sf_dir):
    return C.keyset_page(B.documents(spark, sf_dir).select("doc_id", "lang"), "doc_id", 20, 100)


@query("upsert_latest", "SELECT user_id AS k, max(event_id) AS v FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    rows = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    return C.upsert(rows.filter("v % 2 = 0"), rows.filter("v % 2 = 1"), ["k"], "v")


@query("delete_cascade", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def delete_cascade(spark, sf_dir):
    gone = B.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("document_id"))
    kept = C.delete_everywhere({"items": (B.table(spark, sf_dir, "lineitem"), "l_orderkey")}, gone)["items"]
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("size_tiers", """WITH d AS (SELECT CAST(floor(o_totalprice) AS BIGINT) * 100 AS size FROM orders)
SELECT CASE WHEN size > 26214400 THEN 3 WHEN size > 10485760 THEN 4 WHEN size > 2097152 THEN 5 ELSE 7 END AS priority, count(*) AS n FROM d GROUP BY 1""")  # fmt: skip
def size_tiers(spark, sf_dir):
    """Jobs by the priority that their size gives; a unit of price is taken for 100 bytes."""
    return B.jobs(spark, sf_dir).groupBy(upkeep.job_priority(F.col("file_size") * 100).alias("priority")).agg(F.count("*").alias("n"))


NOISE_SQL = "|".join(T.NOISE)


@query("noise_filter", f"WITH {PARAGRAPHS} SELECT document_id, count(*) AS n, count(*) FILTER (WHERE length(trim(text)) < 10 OR regexp_matches(trim(text), '^({NOISE_SQL})$')) AS noise FROM paras GROUP BY 1")
def noise_filter(spark, sf_dir):
    rows = chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text")
    return rows.groupBy("document_id").agg(F.count("*").alias("n"), A.count_if(T.is_noise(F.col("text"))).alias("noise"))


def _stripped() -> str:
    out = trimmed = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    for p in T.PREFIXES:
        out = f"regexp_replace({out}, '^{p}', '')"
    lone = f"regexp_matches({trimmed}, '^([A-Z]\\.|[0-9]+\\.?)\\s*$')"
    return f"WITH {PARAGRAPHS} SELECT document_id, idx, CASE WHEN {lone} THEN '' ELSE regexp_replace({out}, '^\\s+|\\s+$', '', 'g') END AS text FROM paras"


@query("strip_prefixes", _stripped())
@query("strip_prefixes_whole", _stripped())
def strip_prefixes_whole(spark, sf_dir):
    """All paragraphs as they stand."""
    rows = chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text")
    return rows.select("document_id", F.col("idx").cast("bigint").alias("idx"), T.strip_prefixes(F.col("text")).alias("text"))


@query("nonspace_length", "SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) AS n FROM documents")
def nonspace_length(spark, sf_dir):
    return B.documents(spark, sf_dir).select("doc_id", T.nonspace_length(F.col("text")).cast("bigint").alias("n"))


@query("embedding_input", "SELECT doc_id, substr(trim(replace(text, chr(10), ' ')), 1, 3072) AS prepared FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''")
def embedding_input(spark, sf_dir):
    return B.documents(spark, sf_dir).select("doc_id", T.embedding_input(F.col("text")).alias("prepared")).filter("prepared <> ''")


@query("manifest_validation", """SELECT CASE WHEN html IS NULL OR length(html) < 500 THEN 'too small' WHEN length(html) > 3000 THEN 'too large' WHEN url NOT LIKE 'http%' THEN 'bad url' END AS error, count(*) AS n FROM pages GROUP BY 1""")
def manifest_validation(spark, sf_dir):
    rules = [(F.length("html") >= 500, "too small"), (F.length("html") <= 3000, "too large"), (F.col("url").like("http%"), "bad url")]
    return C.with_first_error(B.table(spark, sf_dir, "pages"), rules).groupBy("error").agg(F.count("*").alias("n"))


@query("enriched_facets", "SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enriched_facets(spark, sf_dir):
    labels = B.table(spark, sf_dir, "labels")
    return B.documents(spark, sf_dir).select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", "lang", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("retention_cleanup", "SELECT 'kept' AS part, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAYS UNION ALL SELECT 'dropped', count(*) FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 90 DAYS")
def retention_cleanup(spark, sf_dir):
    rows = B.activity(spark, sf_dir)
    marked = rows.crossJoin(F.broadcast(rows.agg(F.max("logged_at").alias("m")))).withColumn("old", F.expr("logged_at < m - INTERVAL 90 DAYS"))
    kept = marked.agg(F.lit("kept").alias("part"), A.count_if(~F.col("old")).alias("n"))
    return kept.unionByName(marked.agg(F.lit("dropped").alias("part"), A.count_if(F.col("old")).alias("n")))
