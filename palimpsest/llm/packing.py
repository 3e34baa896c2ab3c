"""Token-id output: best-fit-decreasing packing of tokenized documents into fixed-length rows."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, slices, valid_text

LENGTH = 2048
#: Mean UTF-8 bytes of text that one packing group holds.
GROUP_BYTES = 8 << 20
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenization pattern of this vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_encoding(ranks: bytes) -> tuple[tiktoken.Encoding, int, str]:
    """The encoding of a vocabulary file, its end token, and the smallest type that holds all ids."""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    end = max(table.values()) + 1
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), end, "<u2" if end < 1 << 16 else "<u4"


class CapacityTree:
    """A segment tree over capacities 0..limit that counts open rows; finds the least one that fits."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.counts = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(limit + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.counts[at] += by
            at >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.open[capacity].append(row)
        self._change(capacity, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row with room for `least`, taken out; None without one."""
        at, counts = least + self.size, self.counts
        if not counts[at]:
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if counts[2 * at] else 2 * at + 1
        capacity = at - self.size
        row = self.open[capacity].pop()
        self._change(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Rows of indexes: each piece, longest first, goes into the fullest row that has room for it."""
    tree, rows = CapacityTree(limit), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[i])
        if found is None:
            capacity, row = limit, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > lengths[i]:
            tree.put(capacity - lengths[i], row)
    return rows


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> tuple[DataFrame, str]:
    """(id, tag, copy, ids binary): the text's token ids and one end token, two or four little-endian bytes each; the numbers' type.

    The vocabulary file is read by Spark and broadcast: some 50,000 entries. Null text has no tokens.
    """
    spark = docs.sparkSession
    path = tokenizer if "://" in tokenizer else f"file://{tokenizer}"
    ranks = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    broadcast = spark.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end, kind = load_encoding(broadcast.value)
        for whole in batches:
            # equal rows are told apart by their number in the batch, so that they go to groups of their own
            pairs = pd.DataFrame({"id": whole.column(0).to_pandas(), "tag": whole.column(1).to_pandas()})
            number = pa.array(pairs.groupby(["id", "tag"], dropna=False).cumcount().to_numpy(np.int64))
            whole = pa.RecordBatch.from_arrays([*whole.columns, number], names=["id", "tag", "text", "copy"])
            for batch in slices(whole, 2, 2 << 20):
                ids = []
                for text in batch.column(2).to_pylist():
                    found = [] if text is None else np.append(encoding.encode_to_numpy(text, disallowed_special=()), end)
                    ids.append(np.asarray(found, kind).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(ids, pa.binary())], names=["id", "tag", "copy", "ids"])

    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = docs.select("id", F.xxhash64(F.col("text").cast("string")).alias("tag"), valid_text("text").alias("text"))
    kind = load_encoding(ranks)[2]
    return rows.mapInArrow(scan, f"{field(rows, 'id')}, tag bigint, copy bigint, ids binary"), kind


def pack_group(table: pa.Table, length: int, pad: int, kind: str) -> pa.Table:
    """Pack a group's documents; see pack_documents for the columns."""
    order = sorted(range(table.num_rows), key=lambda i: ((x := table["id"][i].as_py()) is None, 0 if x is None else x, table["tag"][i].as_py()))
    docs = [(table["id"][i].as_py(), np.frombuffer(table["ids"][i].as_py(), kind)) for i in order]
    pieces = [(d, at, ids[at : at + length]) for d, ids in docs for at in range(0, len(ids), length)]
    rows = best_fit_decreasing([len(x[2]) for x in pieces], length)
    matrix, places = np.full((len(rows), length), pad, np.int32), np.zeros((len(rows), length), np.int32)
    ends, ids, starts = [], [], []
    for i, row in enumerate(rows):
        at, own = 0, [0]
        for p in row:
            n = len(pieces[p][2])
            matrix[i, at : at + n] = pieces[p][2]
            places[i, at : at + n] = np.arange(n)
            at += n
            own.append(at)
        ends.append(own)
        ids.append([pieces[p][0] for p in row])
        starts.append([pieces[p][1] for p in row])
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * length)
    lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))
    group = table["pack_group"][0].as_py() if table.num_rows else 0
    return pa.table(
        {
            "pack_group": pa.array([group] * len(rows), pa.int64()),
            "row_no": pa.array(np.arange(len(rows), dtype=np.int64)),
            "n_tokens": pa.array([x[-1] for x in ends], pa.int32()),
            "input_ids": lists(matrix),
            "cu_seqlens": pa.array(ends, pa.list_(pa.int32())),
            "position_ids": lists(places),
            "doc_ids": pa.array(ids, pa.list_(table.schema.field("id").type)),
            "doc_starts": pa.array(starts, pa.list_(pa.int32())),
        }
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str = TOKENIZER, pad: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(pack_group, row_no, n_tokens, input_ids, cu_seqlens, position_ids, doc_ids, doc_starts): packed rows.

    Documents are dealt by a hash of id and text into groups of about group_bytes of text, which are packed
    apart from each other: best fit decreasing, rows of `length` ids. A longer document is cut into pieces
    of `length`, none of whose tokens are lost; doc_starts tells each piece's first token in its document.
    cu_seqlens has the running piece ends from 0, position_ids start anew in each piece, and the rest of a
    row is `pad` at position 0.

    Null text gives no piece, empty text its end token alone; bytes that are no UTF-8 count as U+FFFD. Ids keep
    their type, text or number; a null id stays null in doc_ids. Rows that
    repeat id and text are packed each, dealt by their number in a batch too. Texts of any length are encoded whole. Other columns are ignored. An empty table gives an empty result.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    n_groups = max(1, -(-int(size) // group_bytes))
    ids, kind = tokenize(docs, id_col, text_col, tokenizer)
    ids = ids.filter(F.length("ids") > 0)
    dealt = ids.withColumn("pack_group", F.pmod(F.xxhash64("id", "tag", "copy"), F.lit(n_groups)))
    kind_of_id = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"pack_group bigint, row_no bigint, n_tokens int, input_ids array<int>, cu_seqlens array<int>, position_ids array<int>, doc_ids array<{kind_of_id}>, doc_starts array<int>"
    return dealt.groupBy("pack_group").applyInArrow(lambda t: pack_group(t, length, pad, kind), schema)
