"""Vectors of floats as blocks of whole numbers, for the operators that multiply matrices in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field

#: Vectors of one block.
BLOCK = 4096


def scaled(column: pa.Array, scale: float, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The places of a batch's usable vectors, and floor(scale * c) + shift of their entries as a matrix of longs.

    A vector that is null or holds a null or non-finite entry is not usable. Shorter vectors are filled up with
    the number of an entry 0. An entry whose number passes 2**53 raises an error.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten() if column.null_count == 0 else pa.concat_arrays([x.values for x in column if x.is_valid] or [column.values.slice(0, 0)])
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    owner = np.repeat(np.arange(len(column)), lengths)
    usable = column.is_valid().to_numpy(zero_copy_only=False).copy()
    usable[owner[~np.isfinite(values)]] = False
    at = np.flatnonzero(usable)
    row = np.full(len(column), -1)
    row[at] = np.arange(len(at))
    starts = np.cumsum(lengths) - lengths
    held = usable[owner]
    numbers = np.floor(scale * values[held])
    if len(numbers) and np.abs(numbers).max() > 2.0**53:
        raise ValueError("a vector's entry is too large to be taken as a whole number")
    matrix = np.full((len(at), int(lengths[at].max(initial=0))), shift, np.int64)
    matrix[row[owner[held]], (np.arange(len(values)) - starts[owner])[held]] = numbers.astype(np.int64) + shift
    return at, matrix


def narrowest(matrix: np.ndarray) -> str:
    """The smallest of int16, int32 and int64 that holds all entries."""
    most = int(np.abs(matrix).max(initial=0))
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def widened(matrix: np.ndarray, dim: int, fill: int = 0) -> np.ndarray:
    """A matrix with columns of `fill` up to `dim` columns."""
    if matrix.shape[1] == dim:
        return matrix
    return np.hstack([matrix, np.full((len(matrix), dim - matrix.shape[1]), fill, matrix.dtype)])


def packed(vectors: DataFrame, id_col: str, vec_col: str, scale: float, shift: int = 0, block: int = BLOCK) -> DataFrame:
    """(ids array, dim int, kind string, x binary): the usable vectors in blocks of at most `block`, see `scaled`."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                at, matrix = scaled(part.column(1), scale, shift)
                if len(at):
                    ids, kind = part.column(0).take(pa.array(at)), narrowest(matrix)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays([lists, pa.array([matrix.shape[1]], pa.int32()), pa.array([kind]), pa.array([matrix.astype(kind).tobytes()], pa.binary())], names=["ids", "dim", "kind", "x"])

    return rows.mapInArrow(scan, f"ids array<{field(rows, 'id').split(' ', 1)[1]}>, dim int, kind string, x binary")


def matrices(batch: pa.RecordBatch, dim: int | None = None, fill: int = 0) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix of longs) of each block of a batch; with `dim`, all as wide."""
    for i in range(batch.num_rows):
        own = batch.column("dim")[i].as_py()
        ids = batch.column("ids")[i].values
        matrix = np.frombuffer(batch.column("x")[i].as_py(), batch.column("kind")[i].as_py()).reshape(len(ids), own).astype(np.int64)
        yield ids, matrix if dim is None else widened(matrix, dim, fill)


#: Tasks, at the most, whose small sums go to the driver as they are.
DIRECT = 512


def summed(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray], dim: int, fill: int, kind: str, tasks: int) -> np.ndarray | None:
    """The sum of `work`, a small array, over all blocks, which are `tasks` partitions; None without a block.

    Each task adds up its own; over DIRECT tasks one more task adds up theirs.
    """

    def total(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found = None
        for part in parts:
            found = part if found is None else found + part
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found, kind).tobytes()], pa.binary())], names=["part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(work(matrix) for batch in batches for _, matrix in matrices(batch, dim, fill))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(part.as_py(), kind) for batch in batches for part in batch.column(0))

    parts = blocks.mapInArrow(each, "part binary")
    if tasks > DIRECT:
        parts = parts.repartition(1).mapInArrow(whole, "part binary")
    found = [np.frombuffer(bytes(r.part), kind) for r in parts.collect()]
    return sum(found[1:], found[0]) if found else None
