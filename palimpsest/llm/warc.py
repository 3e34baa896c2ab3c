"""WARC records and a Merkle fixity audit between two replicas of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import checkpoint

#: Bytes of one leaf range and children of a node, as powers of two.
LEAF_BITS = 16
FANOUT_BITS = 4
RECORDS_A_FILE = 1000
#: The date of records whose pages tell none.
DATE = "1970-01-01T00:00:00Z"


def _lines(*parts: Column) -> Column:
    return F.concat(*(F.concat(p, F.lit("\r\n")) for p in parts))


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", records_a_file: int = RECORDS_A_FILE, date: str = DATE) -> DataFrame:
    """(file, offset, record): one WARC/1.0 resource record for each page, in files of records_a_file ids.

    offset is the record's first byte in its file, in id order; a file holds a bounded number of ids. Numbers as ids
    fill files in their order, text ids are dealt to files by a hash. `date` stands as each record's WARC-Date, for pages carry no time. Null
    url or body count as empty; pages without an id are left out; of pages that repeat an id each is a
    record, ordered by url and body. Pages of any length are one record; extra columns are ignored; an empty table gives an empty result.
    """
    docs = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in ((id_col, "__id"), (url_col, "__url"), (body_col, "__body"))))
    if isinstance(docs.schema["__id"].dataType, NumericType):
        file = F.floor(F.col("__id") / records_a_file).cast("bigint")
    else:
        file = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(max(1, -(-docs.count() // records_a_file))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = text("__body")
    head = _lines(
        F.lit("WARC/1.0"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("__id").cast("string"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), text("__url")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""),
    )
    rows = docs.filter(F.col("__id").isNotNull()).select(
        file.alias("file"),
        "__id",
        F.concat(head, body, F.lit("\r\n\r\n")).cast("binary").alias("record"),
    )
    before = Window.partitionBy("file").orderBy("__id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("file", F.coalesce(F.sum(F.length("record")).over(before), F.lit(0)).cast("bigint").alias("offset"), "record")


def merkle_leaves(records: DataFrame) -> DataFrame:
    """(file, offset, length, digest): the SHA-256 of each record; what a replica's site computes once."""
    record = F.coalesce(F.col("record").cast("binary"), F.lit("").cast("binary"))
    return records.select("file", F.col("offset").cast("bigint").alias("offset"), F.length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("digest"))


def merkle_levels(leaves: DataFrame, height: int, leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> list[DataFrame]:
    """(file, range, digest) for each level, leaf ranges first; the last has one root for each file.

    A leaf range covers 2**leaf_bits bytes of a file and digests the records that start in it, in offset
    order; a node covers 2**fanout_bits ranges of the level below. A node's digest covers the offsets too, so
    a moved record changes it. Each level is written once, some hundred bytes for each range, so that a step of
    the descent reads its level and nothing below.
    """
    row = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest"))
    parts = leaves.select("file", F.shiftright("offset", leaf_bits).alias("range"), F.col("offset").alias("at"), row.alias("part"))
    levels = []
    for _ in range(height):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x.part), "\n")
        level = parts.groupBy("file", "range").agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
        levels.append(level := checkpoint(level))
        parts = level.select("file", F.shiftright("range", fanout_bits).alias("range"), F.col("range").alias("at"), F.concat_ws(":", F.col("range").cast("string"), "digest").alias("part"))
    return levels


def fixity_audit(left: DataFrame, right: DataFrame, leaf_bits: int = LEAF_BITS, fanout_bits: int = FANOUT_BITS) -> DataFrame:
    """(file, offset, status, left_length, right_length, left_digest, right_digest): the records that differ.

    `left` and `right` are the replicas' records (file, offset, record). Both are hashed into trees; the
    roots are compared, and each level is read only under the branches that differ, down to the records.
    status is corrupt (both have the offset, other bytes), missing (left only) or extra (right only).

    A null record is empty bytes; a null file or offset is left out. Records that repeat an offset are
    compared as a sorted bag: the digests' join differs when any does. Extra columns are ignored. Equal or
    empty replicas give an empty result.
    """
    sides = [checkpoint(merkle_leaves(x.filter("file is not null and offset is not null"))) for x in (left, right)]
    top = max((x.agg(F.max("offset")).first()[0] or 0) for x in sides)
    height = 1
    while top >> leaf_bits + fanout_bits * (height - 1):
        height += 1
    trees = [merkle_levels(x, height, leaf_bits, fanout_bits) for x in sides]
    suspects = None
    for depth in range(height - 1, -1, -1):
        nodes = [t[depth] for t in trees]
        if suspects is not None:
            nodes = [n.withColumn("up", F.shiftright("range", fanout_bits)).join(suspects, ["file", "up"], "left_semi").drop("up") for n in nodes]
        differ = nodes[0].alias("l").join(nodes[1].alias("r"), ["file", "range"], "full").filter("not (l.digest <=> r.digest)")
        suspects = checkpoint(differ.select("file", F.col("range").alias("up")))
    flat = [
        x.withColumn("up", F.shiftright("offset", leaf_bits)).join(suspects, ["file", "up"], "left_semi").groupBy("file", "offset").agg(
            F.sum("length").alias("length"), F.array_join(F.array_sort(F.collect_list("digest")), ",").alias("digest")
        )
        for x in sides
    ]
    found = flat[0].alias("l").join(flat[1].alias("r"), ["file", "offset"], "full").filter("not (l.digest <=> r.digest)")
    status = F.when(F.col("r.digest").isNull(), "missing").when(F.col("l.digest").isNull(), "extra").otherwise("corrupt")
    return found.select(
        "file", "offset", status.alias("status"), F.col("l.length").alias("left_length"), F.col("r.length").alias("right_length"), F.col("l.digest").alias("left_digest"), F.col("r.digest").alias("right_digest")
    )
