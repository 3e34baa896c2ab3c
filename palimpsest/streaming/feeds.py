"""Structured Streaming over change feeds, status snapshots and activity logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import cut
from ..operators.activity import TERMINAL
from ..operators.store import BucketStore
from .state import STORE, ChangedStatus, NewestRows, stateful


def latest_changes(feed: DataFrame, key: str = "id", sequence: str = "seq") -> DataFrame:
    """The last change of each key in a batch."""
    cols = [c for c in feed.columns if c != key]
    return feed.groupBy(key).agg(F.max_by(F.struct(*cols), sequence).alias("m")).select(key, "m.*")


def apply_changes(table: DataFrame, feed: DataFrame, key: str = "id", sequence: str = "seq", kind: str = "event_type") -> DataFrame:
    """A keyed table after a batch of INSERT, UPDATE (both merge or add) and DELETE rows."""
    last = latest_changes(feed, key, sequence)
    fresh = last.filter(F.col(kind) != "DELETE").select(*table.columns)
    return table.join(last.select(key), key, "left_anti").unionByName(fresh)


def latest_status(snapshots: DataFrame, key: str, time: str, fields: list[str]) -> DataFrame:
    """Latest status of each key; runs in update mode on a stream."""
    return snapshots.groupBy(key).agg(F.max_by(F.struct(time, *fields), time).alias("last")).select(key, "last.*")


def daily_activity(activity: DataFrame, time: str, action: str, late: str = "1 day") -> DataFrame:
    """Counts by day and action; rows later than the watermark are dropped."""
    counts = activity.withWatermark(time, late).groupBy(F.window(time, "1 day"), action).count()
    return counts.select(F.col("window.start").alias("day"), action, F.col("count").alias("n"))


def centroid_sums(chunks: DataFrame, key: str = "document_id", vector: str = "embedding") -> DataFrame:
    """(key, place, total, n): partial sums of a batch of new chunks; add them to what is stored."""
    return chunks.select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.sum(F.col("x").cast("double")).alias("total"), F.count("*").alias("n"))


def merge_sums(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    return stored.unionByName(fresh).groupBy(key, "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def table_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], folder: str) -> None:
    """All that the stream has now, batch by batch; progress is kept in the folder, so a restart goes on from there."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0])
    conf.set(*STORE)
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{folder}/log")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(STORE[0], before)


def kept_table(stream: DataFrame, folder: str, key: str, buckets: int = 8, more: str = "") -> BucketStore:
    """The store that a stream keeps in its folder: its columns, by buckets of the key."""
    schema = StructType([*stream.schema.fields, *(StructType.fromDDL(more).fields if more else [])])
    return BucketStore(stream.sparkSession, f"{folder}/table", schema, key, buckets)


def _own(store: BucketStore, rows: DataFrame) -> BucketStore:
    """The store in the session of a batch."""
    return replace(store, spark=rows.sparkSession)


def drain_updates(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The last state of each key of an aggregation in update mode, merged into a stored table.

    A batch rewrites the buckets of the keys that it changed; one that runs again finds them as they are.
    """
    store = kept_table(stream, folder, keys[0], more="batch bigint")
    drain(stream, "update", lambda rows, n: _own(store, rows).upsert(rows.withColumn("batch", F.lit(n).cast("bigint")), keys, "batch"), folder)
    return store.read().select(*keys, *(c for c in stream.columns if c not in keys))


def drain_retention(stream: DataFrame, key: str, time: str, tie: str, keep: int, folder: str) -> DataFrame:
    """The newest `keep` rows of each key: a list of so many rows is the key's state, and a batch replaces the lists that it changed."""
    store = kept_table(stream, folder, key)
    lists = stateful(stream, key, NewestRows(key, stream.schema, time, tie, keep), "Update")
    drain(lists, "update", lambda rows, n: _own(store, rows).replace(cut(rows)), folder)
    return store.read()


def drain_changed(stream: DataFrame, key: str, sequence: str, fields: list[str], folder: str) -> DataFrame:
    """A log of the snapshots that differ in `fields` from the key's one before; a batch that runs again overwrites its own part."""
    changed = stateful(stream, key, ChangedStatus(key, stream.schema, sequence, fields), "Append")
    drain(changed, "append", lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/table/batch={n}"), folder)
    return stream.sparkSession.read.schema(changed.schema).parquet(f"{folder}/table/batch=*").select(*stream.columns)


def drain_changes(stream: DataFrame, columns: list[str], folder: str, key: str = "id", sequence: str = "seq", kind: str = "event_type") -> DataFrame:
    """A change feed applied as a stream to a stored table: a batch rewrites the buckets of its keys, the last change of each by sequence.

    A batch that runs again finds its changes applied and writes nothing. A deleted key stays as its deletion, so that an earlier
    change which comes late doesn't bring it back.
    """
    store = kept_table(stream, folder, key)
    drain(stream, "append", lambda rows, n: _own(store, rows).upsert(latest_changes(rows, key, sequence).select(*stream.columns), [key], sequence), folder)
    return store.read().filter(F.col(kind) != "DELETE").select(*columns)


def drain_centroids(stream: DataFrame, folder: str, key: str = "document_id", vector: str = "embedding") -> DataFrame:
    """(key, place, total, n) of a stream of new chunks, added batch by batch to a stored table.

    Each row carries the last batch that was added to its key, so a batch that runs again, wherever it was stopped, adds to the keys that lack it alone.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kind}, place int, total double, n bigint, batch bigint")
    store = BucketStore(stream.sparkSession, f"{folder}/table", schema, key, 8)

    def add(rows: DataFrame, batch: int) -> None:
        fresh = cut(centroid_sums(rows, key, vector).withColumn("batch", F.lit(batch).cast("bigint")))

        def merge(old: DataFrame) -> DataFrame:
            new = fresh.join(old.filter(F.col("batch") >= batch).select(key).distinct(), key, "left_anti")
            sums = old.unionByName(new).groupBy(key, "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("batch").alias("batch"))
            return sums.withColumn("batch", F.max("batch").over(Window.partitionBy(key)))

        _own(store, rows).change(fresh, merge)

    drain(stream, "append", add, folder)
    return store.read().drop("batch")


def live_statuses(latest: DataFrame, status: str = "status") -> DataFrame:
    """The latest statuses less the terminal ones, which clear what is shown as live."""
    return latest.filter(~F.col(status).isin(*TERMINAL))
