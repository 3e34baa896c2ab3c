"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed

SEED = 42
#: Rows that one task numbers at a time, on average.
ROWS_A_GROUP = 20_000


def shard_of(key: Column, weights: list[float], seed: int = SEED) -> Column:
    """The shard with the highest score -weight / ln(u), u from a hash of seed, shard number and key.

    The score of a shard depends on the key and that shard alone: a new shard takes rows only into itself, a
    dropped one gives away only its own, and a shard holds rows in proportion to its weight. Ties go to the
    larger number; a shard of weight 0 gets nothing.
    """
    scores = []
    for i, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key.cast("string")), 12)
            u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
            scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(i).alias("shard")))
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    return (F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("shard")


def assign_shards(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", grown_weight: float | None = None, seed: int = SEED, keep_cols: tuple[str, ...] | None = None) -> DataFrame:
    """[keep_cols], size, text_crc32, shard, slot, grown_shard: one row for each row of docs.

    The law is `key`: id and shards alone decide, so equal texts under different ids may part. size is the
    text's UTF-8 bytes (null: none) plus 1; slot counts the rows of a shard from 0 without a gap, by hash
    group and id; grown_shard is the shard with one more shard of weight grown_weight (1 if not given).

    Slots need no pass over a whole shard: rows are dealt into hash groups of about ROWS_A_GROUP, numbered
    there, and moved by the groups' running counts, which come from the ids alone.

    A null id is the key '' (the same shard for all such rows, apart in slots, in groups by their texts). Rows that repeat an id are
    numbered by crc32 and size, then as they come. Columns of docs may have any name; those named like the
    result's are replaced. Texts of any length are measured whole. An empty table gives an empty result.
    """
    own = ("size", "text_crc32", "shard", "slot", "grown_shard")
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in own]
    docs, names = renamed(docs)
    keep, id_col, text_col = [names[c] for c in kept], names[id_col], names[text_col]
    n_groups = max(64, -(-docs.count() // (ROWS_A_GROUP * len(weights))))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    own_text = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string")))  # rows without an id are dealt by their texts
    place = {"__shard": shard_of(key, weights, seed), "__group": F.pmod(F.xxhash64(F.lit(seed + 1), key, own_text), F.lit(n_groups))}
    counts = docs.select(id_col, text_col).withColumns(place).groupBy("__shard", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumns({**place, "__size": F.length(text).cast("bigint") + 1, "__crc": F.crc32(text)})
    grown = shard_of(key, [*weights, 1.0 if grown_weight is None else grown_weight], seed)
    rows = rows.withColumn("__grown", grown).select(*keep, key.alias("__key"), "__shard", "__group", "__size", "__crc", "__grown")
    order = Window.partitionBy("__shard", "__group").orderBy("__key", "__crc", "__size")
    rows = rows.withColumn("__row", F.row_number().over(order)).join(counts, ["__shard", "__group"])
    slot = (F.col("__before") + F.col("__row") - 1).cast("bigint")
    return rows.select(*keep, "__size", "__crc", "__shard", slot, "__grown").toDF(*kept, *own)
