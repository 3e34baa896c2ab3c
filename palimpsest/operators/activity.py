"""Status logs, job tables, activity analytics and retention. Now is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The descriptions of the activity view.
DESCRIPTIONS = {"upload": "Uploaded document", "delete": "Deleted document", "search": "Searched documents", "similarity": "Found similar documents"}
TERMINAL = ("completed", "error", "cancelled", "cancelling")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def since(column: str, as_of: str, days: int) -> Column:
    return F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def newest(rows: DataFrame, key: str, time: str, tie: str, keep: int = 10) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= keep).drop("__rn")


def latest(rows: DataFrame, key: str, time: str, tie: str, fields: list[str]) -> DataFrame:
    """The last row of each key by aggregation: partial maxima are combined before the shuffle."""
    best = rows.groupBy(key).agg(F.max(F.struct(time, tie, *fields)).alias("m"))
    return best.select(key, *(f"m.{c}" for c in (time, tie, *fields)))


def activity_stats(rows: DataFrame) -> DataFrame:
    """Totals; a null user counts as one user, the mean duration is rounded half up, 0 without any."""
    return rows.agg(
        F.count("*").alias("total"),
        (F.countDistinct("user_uuid") + F.coalesce(F.max(F.col("user_uuid").isNull().cast("int")), F.lit(0))).alias("unique_users"),
        *(count_if(F.col("action_type") == a).alias(n) for a, n in (("upload", "uploads"), ("delete", "deletes"), ("search", "searches"), ("download", "downloads"))),
        F.coalesce(F.floor(F.avg("duration_ms") + 0.5), F.lit(0)).alias("avg_duration_ms"),
    )


def describe_action(action: Column) -> Column:
    out = action
    for name, text in DESCRIPTIONS.items():
        out = F.when(action == name, text).otherwise(out)
    return out


def coerce(column: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(column.isin(*allowed), column).otherwise(F.lit(default))


def user_analytics(docs: DataFrame) -> DataFrame:
    return docs.groupBy("user_id").agg(
        F.count("*").alias("total_documents"),
        *(count_if(F.col("status") == s).alias(f"{s}_documents") for s in ("completed", "processing", "error")),
        F.sum("file_size").alias("total_file_size"),
        F.avg("file_size").alias("avg_file_size"),
        F.min("created_at").alias("first_upload"),
        F.max("created_at").alias("last_upload"),
    )


def health(components: dict[str, DataFrame]) -> DataFrame:
    """One row for each component: counts and the percentage that is healthy, null without rows."""
    out = None
    for name, rows in components.items():
        one = rows.agg(F.count("*").alias("total_count"), count_if(F.col("status") == "completed").alias("healthy_count"), count_if(F.col("status") == "error").alias("error_count"))
        one = one.select(F.lit(name).alias("component"), "*", F.round(F.try_divide(F.col("healthy_count") * 100.0, "total_count"), 2).alias("health_percentage"))
        out = one if out is None else out.unionByName(one)
    return out


def after_attempt(attempts: Column, most: Column) -> Column:
    return F.when(attempts < most, "queued").otherwise("failed")


def normal_status(status: Column) -> Column:
    return F.when(status == "failed", "error").otherwise(status)


def queue(jobs: DataFrame, slots: int) -> DataFrame:
    return jobs.filter(F.col("status").isin("queued", "processing")).sort(F.desc("priority"), "created_at", "id").limit(slots)


def retry_eligible(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    active = jobs.filter(F.col("status").isin("queued", "processing")).select("document_id")
    return docs.filter("status = 'error' or embeddings_skipped").join(active, "document_id", "left_anti")
