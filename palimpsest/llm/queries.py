"""One registered query for each operator of this subpackage, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .covertree import top_k
from .decontamination import find_contamination
from .langid import identify_languages
from .lm import score_documents
from .mixing import TEMPERATURE, mix
from .packing import pack_documents
from .quality import quality_rules, trusted_ids
from .sharding import assign_shards
from .simhash import simhash_components
from .substring import dedup_substrings
from .trie import prefix_trie
from .warc import fixity_audit, warc_records
from .whitening import whiten

SHARDS = [1.0] * 8


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the archive of all pages against a replica of which records were damaged, lost or added."""
    records = warc_records(table(spark, sf_dir, "pages"))
    pick = F.pmod(F.col("offset") + F.col("file"), F.lit(97))
    replica = records.withColumn("record", F.when(pick == 5, F.concat(F.lit("x").cast("binary"), F.col("record"))).otherwise(F.col("record"))).filter(pick != 7)
    added = records.filter(pick == 11).withColumn("offset", F.col("offset") + 1)
    return fixity_audit(records, replica.unionByName(added))


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("mix_key")  # the order of rows; SQL lacks its hash


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), keep_cols=("doc_id",))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op9_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign_shards(table(spark, sf_dir, "documents"), SHARDS, keep_cols=("doc_id",))
    return found.withColumn("law", F.lit("key"))


def op11_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_WORDS3 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORDS3}') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
  FROM item, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i) WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORDS3}') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM win
), spot AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE len(w) >= n
), found AS (SELECT doc_id, i, n, win, item_id FROM spot JOIN win USING (win, n)
), word AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM found
), hit AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY 1
), items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CRLF = "chr(13) || chr(10)"
OP4_SQL = f"""
WITH page AS (
  SELECT page_id, page_id // 1000 AS file,
    'WARC/1.0' || {_CRLF} || 'WARC-Type: resource' || {_CRLF} || 'WARC-Record-ID: <urn:page:' || page_id || '>' || {_CRLF} || 'WARC-Date: 1970-01-01T00:00:00Z' || {_CRLF}
    || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF}
    || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF} || coalesce(html, '') || {_CRLF} || {_CRLF} AS record
  FROM pages
), rec AS (
  SELECT file, CAST(coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", record FROM page
), pick AS (SELECT *, ("offset" + file) % 97 AS p FROM rec)
SELECT file, "offset", CASE p WHEN 5 THEN 'corrupt' ELSE 'missing' END AS status, CAST(strlen(record) AS BIGINT) AS left_length,
  CASE p WHEN 5 THEN CAST(strlen(record) + 1 AS BIGINT) END AS right_length, sha256(record) AS left_digest, CASE p WHEN 5 THEN sha256('x' || record) END AS right_digest
FROM pick WHERE p IN (5, 7)
UNION ALL
SELECT file, "offset" + 1, 'extra', NULL, CAST(strlen(record) AS BIGINT), NULL, sha256(record) FROM pick WHERE p = 11
"""

OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM doc, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) WHERE len(w) >= 50
), low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY 1 HAVING count(DISTINCT doc_id) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN low USING (h) WHERE low < doc_id
), word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM doc
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY 1)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

_U = "CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0"
OP5_SQL = f"""
WITH RECURSIVE size AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY 1
), rate AS (SELECT source, weight / (SELECT sum(weight) FROM size) * (SELECT sum(n) FROM size) / n AS rate FROM size
), step AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM step WHERE k < rate + 10 * sqrt(rate) + 30
), doc AS (SELECT *, {_U} AS u FROM documents
), counted AS (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(doc.source) AS source, any_value(n_chars) AS n_chars, count(*) AS n_copies
  FROM doc JOIN step ON doc.source IS NOT DISTINCT FROM step.source AND cdf <= u GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n_copies + 1)) AS copy, n_copies FROM counted
"""

OP11_SQL = """
WITH vec AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM vec q JOIN vec c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pair)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))))"
OP12_SQL = f"""
WITH turn AS (
  SELECT conv_id AS c, conv_id - conv_id % 100 AS g, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (SELECT c, g, {_CRC32.format('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c, g FROM turn)
), rebuilt AS (
  SELECT conv.c, turn.pos, 0 AS own, k, chars FROM conv JOIN turn ON turn.c = conv.g AND turn.pos <= h
  UNION ALL SELECT conv.c, turn.pos, 1, k, chars FROM conv JOIN turn ON turn.c = conv.c AND turn.pos > h
), listed AS (SELECT c, list(k ORDER BY own, pos) AS ks, list(chars ORDER BY own, pos) AS ns FROM rebuilt GROUP BY c
), whole AS (SELECT conv.c, coalesce(ks, []) AS ks, coalesce(ns, []) AS ns FROM conv LEFT JOIN listed USING (c)
), path AS (
  SELECT c, d, md5(array_to_string(list_slice(ks, 1, d), ',')) AS k, md5(array_to_string(list_slice(ks, 1, d - 1), ',')) AS up, CASE WHEN d = 0 THEN 0 ELSE ns[d] END AS chars, d = len(ks) AS ends
  FROM whole, LATERAL (SELECT unnest(range(0, len(ks) + 1)) AS d)
), node AS (
  SELECT d, k, any_value(up) AS up, any_value(chars) AS chars, min(c) AS rep, count(*) AS n, count(*) FILTER (WHERE ends) AS n_ends, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids
  FROM path GROUP BY d, k
), under AS (
  SELECT path.d, path.k, sum((n - 1) * node.chars) AS saved, count(*) FILTER (WHERE n_ends = n) AS leaves, count(*) FILTER (WHERE node.d = path.d + 1) AS children
  FROM node JOIN path ON path.c = node.rep AND path.d <= node.d GROUP BY path.d, path.k)
SELECT node.rep AS conv_id, CAST(node.d AS BIGINT) AS depth, above.rep AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(node.ids) AS ends_sha256
FROM node JOIN under USING (d, k) LEFT JOIN node above ON above.d = node.d - 1 AND above.k = node.up
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_lm_scoring, op2_quality_rules, op3_decontamination, op4_warc_fixity, op5_poisson_mixing, op6_language_id, op7_simhash_dedup, op8_substring_dedup, op9_sequence_packing, op10_rendezvous_sharding, op11_cover_tree_topk, op12_prefix_trie, op13_embedding_whitening, pipeline)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op4_warc_fixity": OP4_SQL, "op5_poisson_mixing": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op11_cover_tree_topk": OP11_SQL, "op12_prefix_trie": OP12_SQL}
