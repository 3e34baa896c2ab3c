"""Packed token ids as binary files, committed as a whole."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"
#: Bytes of token ids of one file, about.
FILE_BYTES = 64 << 20


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: name, rows, tokens."""

    files: list[tuple[str, int, int]]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:") if path.startswith("file:") else path)


class PackedWriter(DataSourceArrowWriter):
    """A task writes its rows to files of its own; only the driver's manifest, written last, makes them the result."""

    def __init__(self, path: str, run: str, wide: bool, file_bytes: int):
        self.path, self.run, self.wide, self.file_bytes = path, run, wide, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = _system(self.path)
        kind, files, held, size = "<u4" if self.wide else "<u2", [], [], 0
        system.create_dir(path, recursive=True)

        def flush() -> None:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            if table.num_rows:
                name = f"part-{self.run}-{uuid.uuid4().hex}.npz"
                files.append((name, *self._save(system, f"{path}/{name}", table, kind)))
            held, size = [], 0

        for batch in iterator:
            width = max(1, len(batch.column("input_ids").flatten()) // max(1, batch.num_rows)) * (4 if self.wide else 2)
            step = max(1, self.file_bytes // width)
            for low in range(0, batch.num_rows, step):
                held.append(batch.slice(low, step))
                size += held[-1].num_rows * width
                if size >= self.file_bytes:
                    flush()
        if held:
            flush()
        return Written(files)

    def _save(self, system: fs.FileSystem, path: str, table: pa.Table, kind: str) -> tuple[int, int]:
        matrix = lambda c, k: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(k).reshape(table.num_rows, -1)
        ends = table["cu_seqlens"].combine_chunks()
        flat = {"cu_seqlens": ends.flatten().to_numpy(zero_copy_only=False), "cu_starts": np.r_[0, np.cumsum(np.diff(ends.offsets.to_numpy()))]}
        numbers = {c: table[c].to_numpy() for c in ("pack_group", "row_no", "n_tokens")}
        buffer = io.BytesIO()
        np.savez(buffer, input_ids=matrix("input_ids", kind), position_ids=matrix("position_ids", kind), **flat, **numbers)
        with system.open_output_stream(path) as f:
            f.write(buffer.getbuffer())
        return table.num_rows, int(numbers["n_tokens"].sum())

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _system(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}.{self.run}") as f:
            f.write(json.dumps({"files": [{"name": n, "rows": r, "tokens": t} for n, r, t in files]}).encode())
        system.move(f"{path}/{MANIFEST}.{self.run}", f"{path}/{MANIFEST}")
        self._sweep({n for n, *_ in files})

    def abort(self, messages: list[Written | None]) -> None:
        """Remove what this run has written; the manifest, if there was one, still names the run before."""
        system, path = _system(self.path)
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.run}-"):
                system.delete_file(info.path)

    def _sweep(self, kept: set[str]) -> None:
        """Files that the manifest doesn't name: of runs before, and of attempts whose result didn't count."""
        system, path = _system(self.path)
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith("part-") and info.base_name not in kept:
                system.delete_file(info.path)


class PackedFiles(DataSource):
    """The sink `packed_tokens`: path, wide (ids of four bytes), file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def writer(self, schema: StructType, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], uuid.uuid4().hex, self.options.get("wide", "false") == "true", int(self.options.get("file_bytes", FILE_BYTES)))


def write_packed(packed: DataFrame, path: str, wide: bool = False, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of packing.pack_documents as .npz files of input_ids, position_ids (row by row), cu_seqlens with cu_starts, pack_group, row_no and n_tokens.

    Tasks write files under names of their own; the manifest, put in place by one rename when all have ended, names the files that count.
    A run that fails leaves the result before it as it was. An executor that is lost is run again under new names. The path may be in any
    file system that pyarrow opens. `wide` takes four bytes an id instead of two. No row gives a manifest without files.
    """
    packed.sparkSession.dataSource.register(PackedFiles)
    columns = ("pack_group", "row_no", "n_tokens", "input_ids", "cu_seqlens", "position_ids")
    packed.select(*columns).write.format("packed_tokens").mode("overwrite").options(path=path, wide=str(wide).lower(), file_bytes=str(file_bytes)).save()


def read_packed(path: str) -> Iterator[dict[str, np.ndarray]]:
    """The arrays of each file that the manifest names."""
    system, at = _system(path)
    with system.open_input_stream(f"{at}/{MANIFEST}") as f:
        files = json.loads(f.read())["files"]
    for file in files:
        with system.open_input_file(f"{at}/{file['name']}") as f, np.load(io.BytesIO(f.read())) as arrays:
            yield dict(arrays)
