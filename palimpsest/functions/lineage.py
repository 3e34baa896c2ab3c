"""Cutting the lineage of tables that a plan reads several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that spark.checkpoint.dir names; a local session without it gets its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def _folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that spark.checkpoint.dir names; a local session without it gets its own."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"
