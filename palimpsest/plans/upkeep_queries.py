"""Registered queries of OCR tables, upkeep, reports and ranked results with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import shared_folder
from ..operators import activity as A
from ..operators import catalog as C
from ..operators import chunking, matching, pairing, upkeep
from ..sources import ocr
from ..streaming import feeds
from . import bindings as B
from .queries import ACTIVITY, CANDIDATES, CHUNKS, JOBS, MATCHES, PARAGRAPHS, SOURCES, SQL, STAGE0, _candidates, _matched, query


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, though it stands in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _line_starts(lines: Column, block: int = 256) -> Column:
    """Where each line of a text starts, and where one more would: sums within blocks of lines and over the blocks, as a step copies the sums before it."""
    running = lambda sizes: F.aggregate(sizes, F.array(F.lit(0)), lambda sums, n: F.concat(sums, F.array(F.get(sums, F.size(sums) - 1) + n)))
    firsts = lambda sizes: F.sequence(F.lit(1), F.size(sizes), F.lit(block))
    of_blocks = lambda sizes: F.transform(firsts(sizes), lambda first: running(F.slice(sizes, first, block)))
    joined = lambda sums, before: F.flatten(F.transform(sums, lambda x, k: F.transform(F.slice(x, 2, block), lambda n: n + F.get(before, k))))
    stops = _let(_let(F.transform(lines, lambda x: F.length(x) + 1), of_blocks), lambda sums: _let(running(F.transform(sums, lambda x: F.element_at(x, -1))), lambda before: joined(sums, before)))
    return F.concat(F.array(F.lit(0)), stops)


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as OCR results: a line is a paragraph and a table row of its page, five lines are a page. Each is made within its row: nothing is shuffled."""
    rows = B.documents(spark, sf_dir).filter("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), "text", "lang", _line_starts(F.split("text", "\n")).alias("starts"))
    segment = lambda start, stop: F.struct(start.cast("string").alias("startIndex"), stop.cast("string").alias("endIndex"))
    layout = lambda s: F.struct(F.struct(F.struct(F.array(s).alias("textSegments")).alias("textAnchor"), F.lit(1.0).alias("confidence")).alias("layout"))
    blocks = lambda starts: F.transform(F.slice(starts, 2, 5), lambda after, j: layout(segment(F.get(starts, j), after - 1)))
    of_pages = lambda starts: F.transform(F.sequence(F.lit(1), F.size(starts) - 1, F.lit(5)), lambda first: blocks(F.slice(starts, first, 6)))
    pair = lambda b: F.array(F.struct(F.get(b, 0).layout.alias("key"), F.get(b, 1).layout.alias("value")))  # noqa: E731, a page's first two lines
    lines = lambda b, first, n: F.transform(F.slice(b, first, n), lambda x: F.struct(F.array(x).alias("cells")))
    table = lambda b: F.array(F.struct(lines(b, 1, 1).alias("headerRows"), lines(b, 2, 5).alias("bodyRows")))
    none = lambda c: F.lit(None).alias(c)
    full = F.transform(_let(F.col("starts"), of_pages), lambda b, i: F.struct((i + 1).alias("pageNumber"), b.alias("paragraphs"), none("lines"), none("formFields"), pair(b).alias("keyValuePairs"), b.alias("blocks"), none("tokens"), table(b).alias("tables"), F.array(F.struct(F.col("lang").alias("languageCode"))).alias("detectedLanguages")))
    wanted = spark.createDataFrame([], ocr.SCHEMA).schema
    return rows.select("document_id", F.lit(0).alias("page_offset"), "text", full.cast(wanted["pages"].dataType).alias("pages"), F.lit(None).cast(wanted["entities"].dataType).alias("entities"))


OCR_LINES = f"{PARAGRAPHS}, lines AS (SELECT CAST(document_id AS VARCHAR) AS document_id, idx, CAST(1 + idx // 5 AS INT) AS page_number, text FROM paras)"


@query("ocr_pages", rf"""WITH {OCR_LINES} SELECT document_id, page_number, md5(trim(string_agg(text, chr(10) ORDER BY idx), ' ')) AS text_md5 FROM lines GROUP BY ALL HAVING trim(string_agg(text, chr(10) ORDER BY idx), ' ') <> ''""")
def ocr_pages(spark, sf_dir):
    return ocr.page_texts(_ocr(spark, sf_dir)).select("document_id", "page_number", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("ocr_paragraphs", f"""WITH {OCR_LINES} SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY idx) - 1 AS idx, page_number, trim(text, ' ') AS text FROM lines WHERE trim(text, ' ') <> ''""")
def ocr_paragraphs(spark, sf_dir):
    return ocr.ocr_paragraphs(_ocr(spark, sf_dir)).withColumn("idx", F.col("idx").cast("bigint"))


@query("ocr_tables", f"""WITH {OCR_LINES}, full_lines AS (SELECT *, trim(text, ' ') AS t FROM lines)
SELECT document_id, page_number, max(CASE WHEN idx % 5 = 0 AND t <> '' THEN t END) AS header, count(*) FILTER (WHERE idx % 5 > 0 AND t <> '') AS n_rows FROM full_lines GROUP BY ALL HAVING count(*) FILTER (WHERE idx % 5 > 0 AND t <> '') > 0""")  # fmt: skip
def ocr_tables(spark, sf_dir):
    found = ocr.tables(_ocr(spark, sf_dir))
    return found.select("document_id", "page_number", F.col("header_rows")[0][0].alias("header"), F.size("body_rows").cast("bigint").alias("n_rows"))


@query("ocr_profile", f"""WITH {OCR_LINES} SELECT l.document_id, length(any_value(d.text)) AS text_length, max(page_number) AS pages, count(*) AS paragraphs, 0 AS lines, max(page_number) AS tables, 0 AS form_fields, 0 AS entities, 1 AS languages
FROM lines l JOIN documents d ON l.document_id = CAST(d.doc_id AS VARCHAR) GROUP BY 1""")  # fmt: skip
def ocr_profile(spark, sf_dir):
    return ocr.profile(_ocr(spark, sf_dir))


@query("ocr_page_profile", f"WITH {OCR_LINES} SELECT document_id, page_number, count(*) AS blocks, count(*) AS paragraphs, 0 AS lines, 0 AS tokens, 1 AS tables, 0 AS form_fields, 1 AS pairs, 1 AS languages FROM lines GROUP BY ALL")
def ocr_page_profile(spark, sf_dir):
    return ocr.page_profile(_ocr(spark, sf_dir))


@query("ocr_field_pairs", f"""WITH {OCR_LINES} SELECT a.document_id, 'pair' AS kind, trim(a.text, ' ') AS name, trim(b.text, ' ') AS value, 'text' AS type, a.page_number
FROM lines a JOIN lines b ON a.document_id = b.document_id AND b.idx = a.idx + 1 AND a.idx % 5 = 0 WHERE a.text <> '' AND b.text <> ''""")  # fmt: skip
def ocr_field_pairs(spark, sf_dir):
    return ocr.structured_fields(_ocr(spark, sf_dir)).drop("confidence")


@query("page_exclusion", f"""WITH {PARAGRAPHS}, marked AS (SELECT document_id, idx, coalesce(1 + idx // 5 BETWEEN 1 AND 1 + quality, false) AS inside FROM paras LEFT JOIN labels ON doc_id = document_id), counted AS (
  SELECT *, count(*) FILTER (WHERE NOT inside) OVER (PARTITION BY document_id) AS left_over FROM marked) SELECT document_id, count(*) AS n FROM counted WHERE NOT inside OR left_over = 0 GROUP BY 1""")  # fmt: skip
def page_exclusion(spark, sf_dir):
    """The first pages that a document's label excludes."""
    ranges = B.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("low"), (F.col("quality") + 1).alias("high"))
    kept = chunking.drop_page_range(chunking.paragraphs_of(B.documents(spark, sf_dir), "doc_id", "text"), ranges)
    return kept.groupBy("document_id").agg(F.count("*").alias("n"))


@query("replace_chunks", f"""WITH {CHUNKS}, gone AS (SELECT document_id FROM chunks WHERE label = 0) SELECT vec_id, document_id, character_count FROM chunks WHERE document_id NOT IN (SELECT document_id FROM gone)
UNION ALL SELECT vec_id, document_id, CAST(character_count + 1 AS INT) FROM chunks WHERE label = 0""")  # fmt: skip
def replace_chunks(spark, sf_dir):
    rows = B.chunks(spark, sf_dir)
    fresh = rows.filter("label = 0").select("vec_id", "document_id", (F.col("character_count") + 1).alias("character_count"))
    return C.replace_of_documents(rows.select(*fresh.columns), fresh)


@query("metadata_patch", f"""WITH {ACTIVITY}, m AS (SELECT id, json_extract_string(metadata, '$.k') AS k, c_mktsegment FROM activity LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON user_uuid = c_custkey)
SELECT id, 'k' AS name, CASE WHEN c_mktsegment IS NULL THEN k ELSE 'patched' END AS value FROM m WHERE k IS NOT NULL OR c_mktsegment IS NOT NULL UNION ALL SELECT id, 'segment', c_mktsegment FROM m WHERE c_mktsegment IS NOT NULL""")  # fmt: skip
def metadata_patch(spark, sf_dir):
    rows = B.activity(spark, sf_dir).select("id", F.col("user_uuid").alias("document_id"), F.from_json("metadata", "map<string,string>").alias("metadata"))
    patch = F.create_map(F.lit("k"), F.lit("patched"), F.lit("segment"), F.col("c_mktsegment"))
    patches = B.table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), patch.alias("metadata"))
    return C.patch_metadata(rows, patches, "document_id").select("id", F.explode("metadata").alias("name", "value"))


@query("rename_documents", "SELECT doc_id, source || ' ' || lang || '.pdf' AS filename, source || '/' || lang || '/' || source || ' ' || lang || '.pdf' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def rename_documents(spark, sf_dir):
    docs = B.documents(spark, sf_dir).filter("source is not null and lang is not null")
    name, path = C.rename_document(F.concat_ws(" ", "source", "lang"), F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".pdf")))
    return docs.select("doc_id", name.alias("filename"), path.alias("path"))


@query("cancel_jobs", f"""WITH {JOBS}, listed AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_quantity > 45 AND l_orderkey NOT IN (SELECT document_id FROM jobs WHERE status = 'completed'))
SELECT id, CASE WHEN l.document_id IS NULL THEN status ELSE 'cancelled' END AS status, CASE WHEN l.document_id IS NOT NULL THEN status END AS original_status FROM jobs LEFT JOIN listed l USING (document_id)""")  # fmt: skip
def cancel_jobs(spark, sf_dir):
    listed = B.table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("document_id"))
    return upkeep.cancel_jobs(B.jobs(spark, sf_dir), listed).select("id", "status", "original_status")


@query("complete_jobs", f"""WITH {JOBS}, items AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 3)
SELECT j.id, CASE WHEN n IS NULL THEN status ELSE 'completed' END AS status, coalesce(CAST(n AS VARCHAR), '0') AS n_items, CAST(priority AS VARCHAR) AS priority FROM jobs j LEFT JOIN items USING (id)""")  # fmt: skip
def complete_jobs(spark, sf_dir):
    jobs = B.jobs(spark, sf_dir).withColumn("result_summary", F.to_json(F.struct(F.lit("0").alias("n_items"), F.col("priority").cast("string").alias("priority"))))
    items = B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n")).filter("n > 3")
    done = upkeep.complete_jobs(jobs, items.select("id", F.to_json(F.struct(F.col("n").cast("string").alias("n_items"))).alias("summary")))
    got = lambda c: F.get_json_object("result_summary", f"$.{c}").alias(c)
    return done.select("id", "status", got("n_items"), got("priority"))


@query("batch_report", f"""WITH {JOBS}, n AS (SELECT count(*) FILTER (WHERE status = 'completed') AS d, count(*) FILTER (WHERE status = 'error') AS f, count(*) FILTER (WHERE status = 'processing') AS p, count(*) FILTER (WHERE status = 'queued') AS q FROM jobs)
SELECT d AS successful, f AS failed, round((d + f) * 60.0 / 3600, 4) AS throughput_per_minute, round(least(p, 1000) * 100.0 / 1000, 4) AS utilisation_percent, greatest(1000 - p, 0) AS free_slots, q AS waiting FROM n""")  # fmt: skip
def batch_report(spark, sf_dir):
    found = upkeep.batch_report(B.jobs(spark, sf_dir), 1000, 3600)
    return found.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("throughput_per_minute", "utilisation_percent")})


@query("job_faults", f"""WITH {JOBS}, docs AS (SELECT l_orderkey AS document_id, min(l_suppkey) AS owner FROM lineitem WHERE l_quantity < 40 GROUP BY 1)
SELECT id, CASE WHEN d.document_id IS NULL THEN 'no document' ELSE 'other owner' END AS fault FROM jobs LEFT JOIN docs d USING (document_id) WHERE d.document_id IS NULL OR owner IS DISTINCT FROM user_id""")  # fmt: skip
def job_faults(spark, sf_dir):
    docs = B.table(spark, sf_dir, "lineitem").filter("l_quantity < 40").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.min("l_suppkey").alias("user_id"))
    return upkeep.job_faults(B.jobs(spark, sf_dir), docs)


@query("page_backfill", f"WITH {CHUNKS} SELECT vec_id, CASE WHEN label = 0 THEN page_number ELSE start_page END AS start_page, CASE WHEN label < 2 THEN CASE WHEN label = 0 THEN page_number ELSE start_page END ELSE end_page END AS end_page FROM chunks")
def page_backfill(spark, sf_dir):
    holed = B.chunks(spark, sf_dir).withColumns({"start_page": F.when(F.col("label") != 0, F.col("start_page")), "end_page": F.when(F.col("label") >= 2, F.col("end_page"))})
    return upkeep.backfilled(holed).select("vec_id", "start_page", "end_page")


@query("refresh_embeddings", f"WITH {CHUNKS} SELECT document_id, count(*) AS n, CASE WHEN document_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 0 ELSE count(*) END AS embedded FROM chunks GROUP BY 1")
def refresh_embeddings(spark, sf_dir):
    stale = B.table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("document_id"))
    return upkeep.refreshed(B.chunks(spark, sf_dir), stale).groupBy("document_id").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))


@query("first_insert", "SELECT c_custkey AS id, 'known' AS role FROM customer UNION ALL SELECT DISTINCT user_id, 'new' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def first_insert(spark, sf_dir):
    users = B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("known").alias("role"))
    return upkeep.insert_absent(users, B.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.lit("new").alias("role")).distinct(), "id")


@query("document_sizing", """WITH d AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * 250 AS size, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'application/pdf' WHEN '2' THEN 'image/png' WHEN '3' THEN 'application/msword' ELSE 'text/plain' END AS mime FROM orders), p AS (
  SELECT id, size, CAST(CASE WHEN mime LIKE '%pdf%' THEN ceil(size / 1048576.0::DOUBLE / 0.3::DOUBLE) WHEN mime LIKE '%image%' THEN 1 WHEN mime LIKE '%word%' OR mime LIKE '%doc%' THEN ceil(size / 1048576.0::DOUBLE / 0.1::DOUBLE) ELSE ceil(size / 1048576.0::DOUBLE / 0.2::DOUBLE) END AS BIGINT) AS pages FROM d), tiers(rank, mb, most, tier, strategy, least, each, priority) AS (
  VALUES (1, 2, 5, 'MICRO', 'fast-track', 0.5::DOUBLE, 0.1::DOUBLE, 1), (2, 10, 15, 'SMALL', 'standard', 1, 0.2, 2), (3, 25, 50, 'MEDIUM', 'optimized', 2, 0.3, 3), (4, 50, 100, 'LARGE', 'batch-optimized', 5, 0.5, 3), (5, 100, 200, 'ENTERPRISE', 'enterprise-batch', 10, 0.7, 4), (6, 1000000::BIGINT, 1000000000, 'MASSIVE', 'streaming-batch', 15, 1.0, 4)), fit AS (
  SELECT p.*, tiers.*, row_number() OVER (PARTITION BY id ORDER BY rank) AS rn FROM p JOIN tiers ON size <= mb * 1048576 AND pages <= most)
SELECT id, pages, tier, strategy, CAST(ceil(greatest(least, pages * each)) AS BIGINT) AS minutes, priority FROM fit WHERE rn = 1""")  # fmt: skip
def document_sizing(spark, sf_dir):
    """Orders as files: a unit of price is taken for 250 bytes, the order's priority for its type."""
    mime = F.when(F.col("priority") == 1, "application/pdf").when(F.col("priority") == 2, "image/png").when(F.col("priority") == 3, "application/msword").otherwise("text/plain")
    rows = B.jobs(spark, sf_dir).select("id", (F.col("file_size") * 250).alias("size"), upkeep.page_estimate(F.col("file_size") * 250, mime).alias("pages"))
    return rows.select("id", "pages", *(c.alias(n) for n, c in upkeep.sizing(F.col("size"), F.col("pages")).items()))


@query("chunk_edges", f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS f, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index DESC) AS l FROM chunks)
SELECT document_id, chunk_index, CASE WHEN f <= 2 AND l <= 2 THEN 'both' WHEN f <= 2 THEN 'first' ELSE 'last' END AS edge FROM r WHERE f <= 2 OR l <= 2""")  # fmt: skip
def chunk_edges(spark, sf_dir):
    return upkeep.edges(B.chunks(spark, sf_dir), "document_id", "chunk_index", 2).select("document_id", "chunk_index", "edge")


@query("system_counts", f"""WITH {JOBS} SELECT (SELECT count(*) FROM jobs) AS jobs, (SELECT count(*) FROM jobs WHERE status = 'completed') AS completed_jobs, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM events) AS activities""")
def system_counts(spark, sf_dir):
    one = lambda name, alias: B.table(spark, sf_dir, name).agg(F.count("*").alias(alias))
    jobs = B.jobs(spark, sf_dir).agg(F.count("*").alias("jobs"), A.count_if(F.col("status") == "completed").alias("completed_jobs"))
    for name, alias in (("documents", "documents"), ("embeddings", "vectors"), ("events", "activities")):
        jobs = jobs.crossJoin(F.broadcast(one(name, alias)))  # single rows
    return jobs


@query("document_structure", "SELECT l_orderkey AS document_id, l_returnflag AS type, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def document_structure(spark, sf_dir):
    return B.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("upload_dates", "SELECT event_id, strftime(ts, '%d %b %Y - %-I:%M %p') AS shown FROM events")
def upload_dates(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", T.shown_date(F.col("ts").cast("string")).alias("shown"))


@query("field_types", "SELECT event_type, CASE WHEN event_type LIKE '%date%' OR event_type LIKE '%time%' THEN 'date' ELSE 'text' END AS field_type, count(*) AS n FROM (SELECT event_type || CASE WHEN value > 50 THEN '_Time' ELSE '' END AS raw, lower(raw) AS event_type FROM events) GROUP BY ALL")
def field_types(spark, sf_dir):
    raw = F.concat("event_type", F.when(F.col("value") > 50, "_Time").otherwise(""))
    return B.table(spark, sf_dir, "events").select(F.lower(raw).alias("event_type"), T.field_type(raw).alias("field_type")).groupBy("event_type", "field_type").agg(F.count("*").alias("n"))


@query("offset_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, sf_dir):
    return B.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").sort(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


SCORED = f"""{STAGE0}, {MATCHES.removeprefix(CHUNKS).lstrip(', ')}, tot AS (SELECT document_id, sum(character_count) AS t FROM chunks GROUP BY 1), held AS (
  SELECT best.* FROM best JOIN (SELECT source_id, document_id AS target_id FROM stage0 WHERE rank <= 20) USING (source_id, target_id)), gate AS (
  SELECT source_id, target_id FROM held JOIN tot x ON x.document_id = source_id JOIN tot y ON y.document_id = target_id GROUP BY source_id, target_id, x.t, y.t HAVING least(sum(a_chars), sum(b_chars)) >= greatest(1600, ceil(0.05 * least(x.t, y.t)))), ok AS (
  SELECT held.* FROM held JOIN gate USING (source_id, target_id)), sa AS (
  SELECT source_id, target_id, sum(a_chars) AS s, count(*) AS n FROM (SELECT DISTINCT source_id, target_id, a_index, a_chars FROM ok) GROUP BY ALL), sb AS (
  SELECT source_id, target_id, sum(b_chars) AS s FROM (SELECT DISTINCT source_id, target_id, b_index, b_chars FROM ok) GROUP BY ALL), scored AS (
  SELECT source_id, target_id, sa.s AS ms, sb.s AS mt, n, sa.s / x.t AS ss, sb.s / y.t AS ts, x.t / y.t * 100 AS ratio FROM sa JOIN sb USING (source_id, target_id) JOIN tot x ON x.document_id = source_id JOIN tot y ON y.document_id = target_id)"""


SCORED_WHOLE = SCORED.replace(STAGE0, CANDIDATES).replace("SELECT source_id, document_id AS target_id FROM stage0 WHERE rank <= 20", "SELECT source_id, document_id AS target_id FROM candidates")


PRIMARY = f"""WITH {SCORED_WHOLE}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ss DESC, ts DESC, mt DESC, n DESC, target_id) AS rank FROM scored)
SELECT source_id, target_id, CAST(ms AS BIGINT) AS matched_source_chars, CAST(mt AS BIGINT) AS matched_target_chars, n AS matched_chunks, round(ss, 6) AS source_score, round(ts, 6) AS target_score, round(ratio, 6) AS length_ratio, rank FROM r WHERE rank <= 30"""  # fmt: skip


@query("primary_search", PRIMARY)
@query("primary_search_whole", PRIMARY)
def primary_search_whole(spark, sf_dir):
    """The whole search without the fallback pass, which SQL can't say: candidates of both stages, best matches, evidence, scores, rank."""
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    found = matching.similarity_search(figures.filter(SOURCES), chunks, figures, _candidates(spark, sf_dir), min_source=0.0, min_target=0.0, primary=0.25, fallback=None, tolerance=0)
    return found.withColumns({c: F.round(c, 6) for c in ("source_score", "target_score", "length_ratio")}).withColumn("rank", F.col("rank").cast("bigint"))


@query("unmatched_chunks", f"""WITH {MATCHES} SELECT b.source_id, b.target_id, c.chunk_index FROM (SELECT DISTINCT source_id, target_id FROM best) b JOIN chunks c ON c.document_id = b.source_id
WHERE NOT EXISTS (SELECT 1 FROM best m WHERE m.source_id = b.source_id AND m.target_id = b.target_id AND m.a_index = c.chunk_index)""")  # fmt: skip
def unmatched_chunks(spark, sf_dir):
    found = pairing.pair_unmatched(_matched(spark, sf_dir, "a_index", listed=True), ("source",))
    return found.select("source_id", "target_id", "chunk_index")


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("stream_latest_status", """SELECT user_id AS document_id, ts AS created_at, event_type AS status, event_id AS seq FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'""")  # fmt: skip
def stream_latest_status(spark, sf_dir):
    """The latest status of each document from a stream, errors taken as completed ones, which are not live."""
    status = F.when(F.col("event_type") == "error", "completed").otherwise(F.col("event_type"))
    rows = feeds.table_stream(spark, f"{sf_dir}/events.parquet", EVENTS).select(F.col("user_id").alias("document_id"), F.struct("ts", "event_id").alias("at"), status.alias("status"))
    last = feeds.drain_updates(feeds.latest_status(rows, "document_id", "at", ["status"]), ["document_id"], shared_folder(spark))
    return feeds.live_statuses(last).select("document_id", F.col("at.ts").alias("created_at"), "status", F.col("at.event_id").alias("seq"))


@query("stream_retention", "SELECT user_id AS document_id, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10")
def stream_retention(spark, sf_dir):
    rows = feeds.table_stream(spark, f"{sf_dir}/events.parquet", EVENTS).select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"))
    return feeds.drain_retention(rows, "document_id", "created_at", "seq", 10, shared_folder(spark)).select("document_id", "seq")


@query("stream_daily_activity", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_activity(spark, sf_dir):
    rows = feeds.table_stream(spark, f"{sf_dir}/events.parquet", EVENTS).select(F.col("ts").cast("timestamp").alias("logged_at"), "event_type")
    counts = feeds.drain_updates(feeds.daily_activity(rows, "logged_at", "event_type"), ["day", "event_type"], shared_folder(spark))
    return counts.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n")
