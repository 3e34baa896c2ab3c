"""Job and document upkeep: cancellation, completion, integrity, reports, backfill, refresh, first inserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .activity import count_if
from .catalog import merge_json


def cancel_jobs(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """All jobs of the listed documents set to cancelled, with their old status; a document with a completed one is left alone."""
    done = jobs.filter("status = 'completed'").select("document_id").distinct()
    named = cancelled.select("document_id").distinct().join(done, "document_id", "left_anti").withColumn("__hit", F.lit(True))
    joined = jobs.join(named, "document_id", "left")
    hit = F.coalesce("__hit", F.lit(False)) & (F.col("status") != "cancelled")
    return joined.withColumns({"original_status": F.when(hit, F.col("status")), "status": F.when(hit, "cancelled").otherwise(F.col("status"))}).drop("__hit")


def complete_jobs(jobs: DataFrame, finished: DataFrame) -> DataFrame:
    """Jobs with a row in `finished` (id, summary, duration_ms) completed; its summary goes over the job's result_summary."""
    joined = jobs.join(finished.withColumnRenamed("summary", "__new"), "id", "left")
    merged = merge_json(F.col("result_summary"), F.col("__new"))
    hit = F.col("__new").isNotNull()
    return joined.withColumns({"status": F.when(hit, "completed").otherwise(F.col("status")), "result_summary": F.when(hit, merged).otherwise(F.col("result_summary"))}).drop("__new")


def batch_report(jobs: DataFrame, slots: int, seconds: float) -> DataFrame:
    """One row: jobs by outcome, finished jobs a minute, share of the slots in use, free slots, jobs waiting."""
    running = count_if(F.col("status") == "processing")
    done, failed = count_if(F.col("status") == "completed"), count_if(F.col("status").isin("error", "failed"))
    return jobs.agg(
        done.alias("successful"),
        failed.alias("failed"),
        ((done + failed) * 60.0 / seconds).alias("throughput_per_minute"),
        (F.least(running, F.lit(slots)) * 100.0 / slots).alias("utilisation_percent"),
        F.greatest(F.lit(slots) - running, F.lit(0)).alias("free_slots"),
        count_if(F.col("status") == "queued").alias("waiting"),
    )


def job_faults(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, fault): jobs without a document row, or of another owner than their document's."""
    owners = documents.select("document_id", F.col("user_id").alias("__owner"), F.lit(True).alias("__known"))
    joined = jobs.join(owners, "document_id", "left")
    fault = F.when(F.col("__known").isNull(), "no document").when(~F.col("user_id").eqNullSafe(F.col("__owner")), "other owner")
    return joined.select("id", fault.alias("fault")).filter("fault is not null")


def backfilled(rows: DataFrame) -> DataFrame:
    """Missing start and end pages taken from the page number, or else 1."""
    page = F.coalesce("page_number", F.lit(1))
    return rows.withColumns({"start_page": F.coalesce("start_page", page), "end_page": F.coalesce("end_page", "start_page", page)})


def refreshed(rows: DataFrame, stale: DataFrame, vector: str = "embedding") -> DataFrame:
    """Vectors of the stale documents set to null and marked pending."""
    joined = rows.join(stale.select("document_id", F.lit(True).alias("__stale")).distinct(), "document_id", "left")
    hit = F.col("__stale").isNotNull()
    return joined.withColumns({vector: F.when(~hit, F.col(vector)), "pending": hit}).drop("__stale")


def insert_absent(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table with the rows of `fresh` whose key it lacks."""
    return table.unionByName(fresh.join(table.select(key), key, "left_anti").select(*table.columns))


#: Megabytes a page by what a MIME type contains, in order; an image has one page.
PAGE_MEGABYTES = ((("pdf",), 0.3), (("image",), None), (("word", "doc"), 0.1), ((), 0.2))
#: Fixed values by size tier: most megabytes, most pages, name, strategy, least minutes, minutes a page, priority.
TIERS = (
    (2, 5, "MICRO", "fast-track", 0.5, 0.1, 1),
    (10, 15, "SMALL", "standard", 1.0, 0.2, 2),
    (25, 50, "MEDIUM", "optimized", 2.0, 0.3, 3),
    (50, 100, "LARGE", "batch-optimized", 5.0, 0.5, 3),
    (100, 200, "ENTERPRISE", "enterprise-batch", 10.0, 0.7, 4),
    (None, None, "MASSIVE", "streaming-batch", 15.0, 1.0, 4),
)
#: A job's priority by most megabytes.
JOB_PRIORITIES = ((2, 7), (10, 5), (25, 4), (None, 3))
#: Fixed values by strategy: most megabytes of memory, buffer in %, most minutes, seconds a chunk, seconds to a retry, attempts.
LIMITS = {
    "fast-track": (500, 20, 5, 30, 10, 3),
    "standard": (500, 20, 10, 60, 15, 3),
    "optimized": (1000, 30, 20, 90, 20, 5),
    "batch-optimized": (1500, 40, 30, 120, 30, 25),
    "enterprise-batch": (1500, 40, 45, 180, 45, 35),
    "streaming-batch": (2000, 50, 60, 300, 60, 10),
}
_MEGABYTE = 1024 * 1024


def page_estimate(size: Column, mime: Column) -> Column:
    """Pages of a file of so many bytes by its MIME type."""
    out, low = None, F.coalesce(mime, F.lit(""))
    for marks, each in reversed(PAGE_MEGABYTES):
        pages = F.lit(1).cast("bigint") if each is None else F.ceil(size / F.lit(float(_MEGABYTE)) / F.lit(each))
        hit = F.lit(False)
        for m in marks:
            hit = hit | low.contains(m)
        out = pages if out is None else F.when(hit, pages).otherwise(out)
    return out


def sizing(size: Column, pages: Column) -> dict[str, Column]:
    """Tier, strategy, minutes (rounded up) and priority of a document of so many bytes and pages: the first tier that holds both."""
    out: dict[str, Column] = {}
    for most, most_pages, name, strategy, least, each, priority in reversed(TIERS):
        own = {"tier": F.lit(name), "strategy": F.lit(strategy), "minutes": F.ceil(F.greatest(F.lit(least), pages * F.lit(each))), "priority": F.lit(priority)}
        out = own if most is None else {k: F.when((size <= most * _MEGABYTE) & (pages <= most_pages), own[k]).otherwise(out[k]) for k in own}
    return out


def limits(strategy: Column, pages: Column) -> dict[str, Column]:
    """Memory and time that a document of so many pages is given: 12 MB and 30 s a page, 120 s at least, within the strategy's bounds."""
    names = ("memory_mb", "memory_buffer", "timeout_minutes", "chunk_seconds", "retry_seconds", "attempts")
    each = F.create_map(*(x for s, values in LIMITS.items() for x in (F.lit(s), F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values))))))
    out = {n: each[strategy].getField(n) for n in names}
    out["memory_mb"] = F.least(pages * 12, out["memory_mb"].cast("bigint"))
    out["timeout_minutes"] = F.least(F.ceil(F.greatest(F.lit(120), pages * 30) / 60), out["timeout_minutes"].cast("bigint"))
    return out


def job_priority(size: Column) -> Column:
    """Small files first, to keep the queue moving."""
    out = None
    for most, priority in reversed(JOB_PRIORITIES):
        out = F.lit(priority) if most is None else F.when(size <= most * _MEGABYTE, priority).otherwise(out)
    return out


def edges(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first and the last n rows of each key, with `edge` first, last or both."""
    w = Window.partitionBy(key)
    marked = rows.withColumns({"__f": F.row_number().over(w.orderBy(order)), "__l": F.row_number().over(w.orderBy(F.desc(order)))})
    edge = F.when((F.col("__f") <= n) & (F.col("__l") <= n), "both").when(F.col("__f") <= n, "first").when(F.col("__l") <= n, "last")
    return marked.withColumn("edge", edge).filter("edge is not null").drop("__f", "__l")
