"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without it (a test) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named __in_0, __in_1 ..., and the new name of each: no name clashes, no dots in names."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*(f"__in_{i}" for i in range(len(docs.columns)))), names


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; those with maps, which have no hash, go by their JSON text."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    return F.xxhash64(*map(plain, docs.schema.fields))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table that is needed for a while to the shared folder; see `discard`.

    Parquet holds sorted ids and small numbers in far fewer bytes than a checkpoint, and is read by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table, by the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def id_remainder(id_col: str, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(text_col: str) -> Column:
    """The UTF-8 bytes of a text, as they are; null stays null."""
    return F.col(text_col).cast("string").cast("binary")


def valid_text(text_col: str) -> Column:
    """A text with U+FFFD in place of bytes that are no UTF-8; null stays null."""
    return F.make_valid_utf8(F.col(text_col).cast("string"))


def field(df: DataFrame, name: str, alias: str | None = None) -> pa.Field:
    """The Arrow-free Spark DDL type of a column, for output schemas of mapInArrow."""
    return f"`{alias or name}` {df.schema[name].dataType.simpleString()}"


def slices(batch: pa.RecordBatch, column: int, limit: int, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about `limit` bytes of texts and `rows` rows, one row at least."""
    start, held = 0, 0
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        if i > start and (held + n > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
