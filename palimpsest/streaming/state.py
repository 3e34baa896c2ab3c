"""Keyed state of streams: the newest rows of each key, and changes of a status alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructType

#: Keyed state in lists and values needs this store; Spark's default holds single rows alone.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value: object, whole: bool) -> object:
    """A pandas cell as a state's value; whole numbers that pandas holds as floats beside nulls become whole again."""
    if value is None or value is pd.NaT or value != value:
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return int(value) if whole else value.item() if hasattr(value, "item") else value


def _rows(batches: Iterator[pd.DataFrame], schema: StructType) -> list[tuple]:
    whole = [isinstance(f.dataType, IntegralType) for f in schema.fields]
    return [tuple(map(_plain, r, whole)) for batch in batches for r in batch[schema.names].itertuples(index=False, name=None)]


def _ranked(value: object) -> tuple:
    """A sort key in which null comes first."""
    return (value is not None, value if value is not None else 0)


class NewestRows(StatefulProcessor):
    """A list of a key's newest `keep` rows by time, then tie; each batch gives the lists that it changed.

    The list never holds more than `keep` rows, whatever the number of batches.
    """

    def __init__(self, key: str, schema: StructType, time: str, tie: str, keep: int):
        self.key, self.schema, self.keep = key, StructType([f for f in schema.fields if f.name != key]), keep
        self.at = [self.schema.names.index(c) for c in (time, tie)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("newest", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        held = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        order = lambda r: tuple(_ranked(r[i]) for i in self.at)
        kept = sorted(held + _rows(rows, self.schema), key=order, reverse=True)[: self.keep]
        if kept != held:
            self.state.put(kept)
            yield pd.DataFrame([(key[0], *r) for r in kept], columns=[self.key, *self.schema.names])

    def close(self) -> None:
        pass


class ChangedStatus(StatefulProcessor):
    """A key's snapshots, in order of `sequence`, that differ from the one before in any of `fields`; one that is no later than the last is left out."""

    def __init__(self, key: str, schema: StructType, sequence: str, fields: list[str]):
        self.key, self.rows, self.schema = key, StructType([f for f in schema.fields if f.name != key]), StructType([schema[c] for c in (sequence, *fields)])
        self.names = self.rows.names
        self.sequence, self.watched = self.names.index(sequence), [self.names.index(c) for c in fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, Spark's name
        last = tuple(self.state.get()) if self.state.exists() else None
        out = []
        for row in sorted(_rows(rows, self.rows), key=lambda r: _ranked(r[self.sequence])):
            now = (row[self.sequence], *(row[i] for i in self.watched))
            if last is None or _ranked(now[0]) > _ranked(last[0]):
                if last is None or now[1:] != last[1:]:
                    out.append((key[0], *row))
                last = now
        if last is not None:
            self.state.update(last)
        if out:
            yield pd.DataFrame(out, columns=[self.key, *self.names])

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, mode: str) -> DataFrame:
    """The stream's rows through a processor by key; the result has the key first, then the other columns. Its session needs STORE."""
    ordered = stream.select(key, *(c for c in stream.columns if c != key))
    return ordered.groupBy(key).transformWithStateInPandas(processor, ordered.schema, mode, "None")
