"""A corpus pipeline of five stages; each takes the documents that the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import discard, shared_folder, table
from palimpsest.llm.decontamination import drop_contaminated
from palimpsest.llm.langid import drop_unidentified
from palimpsest.llm.mixing import mix
from palimpsest.llm.sharding import assign_shards
from palimpsest.llm.simhash import drop_near_duplicates

SHARDS = [1.0] * 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: keep the documents whose language is found, by prototypes learned from the documents themselves.

    Null text and text without a letter go; null ids and repeated rows are judged by their text. Bytes that are
    no UTF-8 count as U+FFFD. Very long texts are read whole. Columns keep their names, whatever these are. An
    empty table, or one without a labelled text, gives an empty result.
    """
    return drop_unidentified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: keep one document of each group of near copies, the one with the smallest id.

    Null and wordless texts are one group. Of rows that repeat an id in a group one stays, also when they tie in
    all columns; different texts under one id are told apart; rows with a null id stay. Very long texts are read
    whole. Columns keep their names. An empty table gives an empty result.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: drop the documents in which any window of ten benchmark words, or a whole shorter item, occurs.

    Null and wordless texts and null ids stay; repeated rows share their fate. Very long texts are searched
    whole. Columns keep their names. An empty benchmark keeps all; an empty table gives an empty result.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: repeat or leave out documents by their Poisson count, so that sources weigh their size to the power 0.7.

    A null source is a source of its own; null ids and texts count as empty in the hash, and rows that repeat
    both get the same count. Very long texts are hashed whole. Columns keep their names. An empty table gives an
    empty result.
    """
    return mix(docs, copy_cols=False)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: add size, text_crc32, shard, slot and grown_shard by rendezvous hashing of the id.

    All null ids go to one shard, in slots of their own; repeated rows keep a row and a slot each, and rows that
    tie in id, crc32 and size are numbered as they come. Null text has size 1. Columns of the input with the
    five names are replaced. Very long texts are measured whole. An empty table gives an empty result.
    """
    return assign_shards(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The language and fingerprint stages can't be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each result written as Parquet to the shared folder and read again.

    A stage's folder goes once the next stage is written; the last one stays for the caller.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{i}-{name}")
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
