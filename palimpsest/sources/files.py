"""Files before an upload: their first bytes, the upload rules and a summary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of each file that are read.
HEAD = 1024
#: Limits, types and messages of the upload rules; fixed values.
MOST_BYTES, LEAST_BYTES, LARGE_BYTES, LONGEST_NAME = 50 << 20, 1024, 10 << 20, 255
TYPES = ("application/pdf",)
EXTENSION = ".pdf"
ISSUES = {
    "type": "Only PDF files are supported",
    "large": "File size exceeds 50 MB limit",
    "small": "File appears to be empty or corrupted",
    "encrypted": "Password-protected PDFs are not currently supported",
}
WARNINGS = {
    "extension": "File extension should be .pdf",
    "name": "Filename is very long and may cause issues",
    "slow": "Large file - processing may take several minutes",
    "unread": "Could not analyze file - proceeding with upload",
}


def file_heads(spark: SparkSession, folder: str, head: int = HEAD) -> DataFrame:
    """(path, length, modificationTime, head): the files of a folder and below with their first `head` bytes, null where they can't be read.

    Spark lists the files without their contents; tasks then open each and read `head` bytes, so a file costs the same whatever its
    length. Files are opened by pyarrow's file systems (local, HDFS, S3, Google storage).
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column(0).to_pylist():
                try:
                    system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
                    with system.open_input_stream(at, buffer_size=0) as f:
                        heads.append(f.read(head))
                except OSError:
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])

    return listed.mapInArrow(scan, "path string, length bigint, modificationTime timestamp, head binary")


def sniffed_type(head: Column) -> Column:
    """The type that the first bytes tell, null if none."""
    starts = (("25504446", "application/pdf"), ("89504e47", "image/png"), ("ffd8ff", "image/jpeg"), ("504b0304", "application/zip"))
    return F.coalesce(*(F.when(F.lower(F.hex(F.substring(head, 1, len(mark) // 2))) == mark, kind) for mark, kind in starts))


def is_encrypted(head: Column) -> Column:
    """An encryption reference and a password field in the first bytes; either alone is not enough."""
    text = F.decode(head, "ISO-8859-1")
    marks = [text.contains(m) for m in ("/U ", "/UE ", "/O ", "/OE ")]
    return F.coalesce(text.rlike(r"/Encrypt\s+\d+\s+\d+\s+R") & (marks[0] | marks[1] | marks[2] | marks[3]), F.lit(False))


def validated(files: DataFrame, mime: Column | None = None) -> DataFrame:
    """files (path, length, head) with name, type, encrypted, issues, warnings and valid: the upload rules, all that fail.

    `mime` is the type that was declared; without it the first bytes tell it.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumns({"name": name, "type": sniffed_type(F.col("head")) if mime is None else mime, "encrypted": is_encrypted(F.col("head"))})
    small, large = F.col("length") < LEAST_BYTES, F.col("length") > MOST_BYTES
    listed = lambda rules, texts: F.array_compact(F.array(*(F.when(rule, texts[k]) for k, rule in rules)))
    issues = (("type", ~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))), ("large", large), ("small", small), ("encrypted", F.col("encrypted")))
    warnings = (("extension", ~F.lower("name").endswith(EXTENSION)), ("name", F.length("name") > LONGEST_NAME), ("unread", F.col("head").isNull()), ("slow", F.col("length") > LARGE_BYTES))
    return rows.withColumns({"issues": listed(issues, ISSUES), "warnings": listed(warnings, WARNINGS)}).withColumn("valid", F.size("issues") == 0)


def validation_summary(files: DataFrame) -> DataFrame:
    """One row (total, valid, invalid, total_warnings, total_issues, can_proceed) of validated files."""
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    found = files.agg(F.count("*").alias("total"), count(F.col("valid").cast("int")).alias("valid"), count(F.size("warnings")).alias("total_warnings"), count(F.size("issues")).alias("total_issues"))
    return found.select("total", "valid", (F.col("total") - F.col("valid")).alias("invalid"), "total_warnings", "total_issues", (F.col("total") == F.col("valid")).alias("can_proceed"))


def metadata_complete(facets: list[str], low: str, high: str, skipped: str) -> Column:
    """Whether no facet is empty (null counts as empty) and the pages to leave out are skipped or two numbers from 1 in order."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in facets]
    ranged = F.coalesce(F.col(skipped), F.lit(False)) | F.coalesce((F.col(low) >= 1) & (F.col(high) >= F.col(low)), F.lit(False))
    return reduce(lambda a, b: a & b, filled, ranged)
