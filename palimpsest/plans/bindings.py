"""The logical tables of the library, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import centroids


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    start = 1 + F.expr("vec_id % 10 div 2")
    return rows.select(
        "vec_id",
        F.expr("vec_id div 10").alias("document_id"),
        F.expr("cast(vec_id % 10 as int)").alias("chunk_index"),
        start.cast("int").alias("page_number"),
        start.cast("int").alias("start_page"),
        (start + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)).cast("int").alias("end_page"),
        (200 + (F.col("vec_id") * 37) % 800).cast("int").alias("character_count"),
        F.expr("vec_id div 10 % 3").alias("user_id"),
        "label",
        "embedding",
    )


def document_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, total_characters, page_count, centroid, effective_chunk_count)."""
    rows = chunks(spark, sf_dir)
    sums = rows.groupBy("document_id").agg(F.sum("character_count").alias("total_characters"), F.max("end_page").alias("page_count"))
    return sums.join(centroids(rows), "document_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.create_map(*map(F.lit, ("O", "queued", "P", "processing", "F", "completed"))), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("document_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        F.floor("o_totalprice").cast("bigint").alias("file_size"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.create_map(*map(F.lit, ("click", "search", "view", "view", "purchase", "upload", "signup", "login", "error", "error"))), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("user_uuid"),
        F.coalesce(action, F.col("event_type")).alias("action_type"),
        F.col("ts").alias("logged_at"),
        (F.col("value") * 10).alias("duration_ms"),
        F.col("props").alias("metadata"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = F.pmod(F.floor("value").cast("int"), F.lit(101))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), progress.alias("progress"), F.col("ts").alias("created_at"))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("event_type"), F.col("value").alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")
