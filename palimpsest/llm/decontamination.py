"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, renamed, utf8

WINDOW = 10
#: Most bytes of benchmark text: the driver and each worker hold the items, and a worker some 100 bytes for each byte of them.
MOST_BYTES = 16 << 20
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


def build(items: list[tuple[str, bytes]], window: int) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
    """The automaton over the items' windows as sequences of word numbers, and the numbers of their words.

    A window's value is (words, ids of the items that hold it); equal sets of ids are one object. A node stands
    for a word, not a letter, so the automaton takes about ten nodes for each benchmark word.
    """
    numbers: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in normal_words(text)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            holders.setdefault(tuple(words[i : i + size]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    values: dict[tuple[int, frozenset[str]], tuple[int, frozenset[str]]] = {}
    for key, ids in holders.items():
        value = (len(key), frozenset(ids))
        automaton.add_word(key, values.setdefault(value, value))
    automaton.make_automaton()
    return automaton, numbers


def hits(automaton: ahocorasick.Automaton, numbers: dict[bytes, int], text: bytes | None) -> tuple[int, list[tuple[int, int]], frozenset[str]]:
    """(words, spans of hit words as byte offsets in the text, items), from one pass over the text."""
    if not text:
        return 0, [], frozenset()
    flat = text.translate(_NORMAL)  # byte for byte, so offsets stay
    words = flat.split()
    if not words or not numbers:
        return len(words), [], frozenset()
    get = numbers.get
    steps, items = {}, set()
    for last, (size, ids) in automaton.iter(tuple([get(w, 0) for w in words])):
        steps[last - size + 1] = steps.get(last - size + 1, 0) + 1
        steps[last + 1] = steps.get(last + 1, 0) - 1
        items |= ids
    if not steps:
        return len(words), [], frozenset()
    change = np.zeros(len(words) + 1, np.int64)
    change[list(steps)] = list(steps.values())
    hit = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    solid = np.diff(np.r_[False, np.frombuffer(flat, np.uint8) != 32, False].astype(np.int8))
    starts, stops = np.flatnonzero(solid == 1), np.flatnonzero(solid == -1)
    return len(words), list(zip(starts[hit].tolist(), stops[hit].tolist())), frozenset(items)


#: The automaton that this worker built last, by the key of its call; the tasks of a scan share it.
_built: dict[str, tuple[ahocorasick.Automaton, dict[bytes, int]]] = {}


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_cols: tuple[str, ...] = ("text",), window: int = WINDOW, keep_cols: tuple[str, ...] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """(id, [keep_cols], n_words, n_hit, spans, items): one row per document.

    Texts and the items' columns (questions, answers) are normalised alike: A-Z lower-cased, words of
    digits, letters and non-ASCII characters. A window is `window` consecutive words of an item column, or
    all of its words if there are fewer. A document's word is hit when any occurrence of a window covers it;
    `spans` are the hit words' (start, stop) in UTF-8 bytes of the original text, `items` the sorted ids of
    the items with a window in the document.

    One automaton holds the whole benchmark, and the documents are scanned once, of whatever length. A benchmark
    of more than most_bytes is refused with an error.

    Null text has no words, and a null or wordless item no windows; items without an id are ignored. Repeated
    documents each keep a row, repeated items count once. Clashing names: an output column takes the place of an input column of its name.
    """
    parts = [benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), utf8(f"`{c}`").alias("text")) for c in item_text_cols]
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    items = items.filter("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text") + F.octet_length("item"))).first()[0] or 0
    if total > most_bytes:
        raise ValueError(f"the benchmark has {total} bytes, more than most_bytes = {most_bytes}")
    held = [(x.item, bytes(x.text)) for x in items.sort("item", "text").collect()]  # most_bytes bounds it
    broadcast, key = docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex
    keep = [c for c in dict.fromkeys((id_col, *keep_cols)) if c not in ("n_words", "n_hit", "spans", "items")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = build(broadcast.value, window)
        automaton, numbers = _built[key]
        for batch in batches:
            words, spans, ids = [], [], []
            for text in batch.column(batch.num_columns - 1):
                n, at, found = hits(automaton, numbers, text.as_py())
                words.append(n)
                spans.append([{"start": a, "stop": b} for a, b in at])
                ids.append(sorted(found))
            columns = [pa.array(words, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, span), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, "n_words", "n_hit", "spans", "items"])

    schema = ", ".join([*(field(docs, c) for c in keep), "n_words bigint, n_hit bigint, spans array<struct<start:int,stop:int>>, items array<string>"])
    rows = docs.select(*(F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)), utf8(f"`{text_col}`").alias("__bytes"))
    return rows.mapInArrow(scan, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns, whatever these are named.

    Rows with null, empty or wordless text stay, as do null ids; of repeated rows all stay or none. An empty
    benchmark keeps all, an empty table gives an empty result. Texts are searched whole.
    """
    inner, names = renamed(docs)
    found = find_contamination(inner, benchmark, names[id_col], names[text_col], keep_cols=tuple(names.values()), **options)
    return found.filter("n_hit = 0").select(*names.values()).toDF(*docs.columns)
