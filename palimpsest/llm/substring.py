"""Substring dedup by seed and extend.

Seeds are winnowed anchors: in any run of `window` words, the smallest hash among its `gram`-word grams is
selected, so equal runs select the same anchor at the same place. Documents are joined on anchors, an anchor
is extended both ways to all runs that select it, and runs that an earlier document also holds are merged
into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, discard, field, utf8, written

WINDOW = 50
GRAM = 12
#: A key of a join is hot, and its rows are dealt to several tasks, with over a part in HOT_KEYS of all seeds and over HOT_ROWS of them.
HOT_KEYS = 20_000
HOT_ROWS = 5_000
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), 1 << 15)
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers


class RunHashes:
    """Polynomial hashes, modulo 2**64, of any run of words of one document."""

    def __init__(self, words: list[bytes], cache: WordHashes):
        n = len(words)
        up, self.down = _powers_to(n + 1)
        values = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def anchors(runs: RunHashes, n_words: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last, place): each selected gram with the range of window starts that select it.

    Of equal smallest hashes in a window the rightmost is selected; the choice depends on the words of the
    window alone.
    """
    start = np.arange(n_words - gram + 1)
    grams = _mix(runs.of(start, start + gram))
    wide = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], wide)
    best = (len(grams) - 1 - (views.argmin(axis=1) + np.arange(len(views))))[::-1]
    first = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    return grams[best[first]], first, np.r_[first[1:] - 1, len(best) - 1], best[first]


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, context, id, tag, first, n): seeds with their extension to all `n` windows that select them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                runs = RunHashes(words, cache)
                hashes, first, last, place = anchors(runs, len(words), window, gram)
                context = _mix(runs.of(first, last + window) ^ _mix(((last - first) << 32 | (place - first)).astype(np.uint64)))
                out.append((hashes, context, np.full(len(first), i), first, last - first + 1))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield emit(batch, out)
                    out = []
            if out:
                yield emit(batch, out)

    def emit(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
        hashes, context, row, first, n = (np.concatenate(x) for x in zip(*out))
        row = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
            names=["anchor", "context", "id", "tag", "first", "n"],
        )

    return docs.filter("id is not null").select("id", "tag", "bytes").mapInArrow(
        scan, f"anchor bigint, context bigint, {field(docs, 'id')}, tag bigint, first int, n int"
    )


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(id, key, tag, anchor, at, run): every window of the listed anchor extents with a hash of its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                out = []
                for i, (text, extents) in enumerate(zip(part.column(3), part.column(4))):
                    words = text.as_py().split()
                    runs = RunHashes(words, cache)
                    for e in extents.as_py():
                        at = np.arange(e["first"], e["first"] + e["n"])
                        out.append((np.full(len(at), i), np.full(len(at), e["anchor"], np.int64), at, _mix(runs.of(at, at + window)).view(np.int64)))
                row, anchor, at, run = (np.concatenate(x) for x in zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(row) for c in range(3)), pa.array(anchor), pa.array(at.astype(np.int32)), pa.array(run)],
                    names=["id", "key", "tag", "anchor", "at", "run"],
                )

    return texts.select("id", "key", "tag", "bytes", "extents").mapInArrow(
        scan, f"{field(texts, 'id')}, key string, tag bigint, anchor bigint, at int, run bigint"
    )


def _dealt(rows: DataFrame, sums: DataFrame, keys: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on `keys` and `salt`, which deals the rows of a hot key to several tasks.

    `sums` has one row a key, with its number of `rows`. Hot is a key of over one part in HOT_KEYS of `total`
    rows, so fewer than HOT_KEYS keys are hot at any size of the input, and these alone are broadcast. A hot
    key's row is repeated once a salt, which makes at most twice as many rows of it as there are hot keys.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    salts = F.when(F.col("rows") > bound, F.ceil(F.col("rows") / bound)).otherwise(1).cast("long")
    hot = F.broadcast(sums.filter(F.col("rows") > bound).select(*keys, salts.alias("salts")))
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("id", "tag", "first"), F.coalesce("salts", F.lit(1)))).drop("salts")
    return dealt, sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("rows")


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, tag, first, n) of `texts` (id, key, tag, bytes): runs of window starts whose words an earlier id holds too.

    1. Seeds whose anchor occurs under one id alone are dropped.
    2. An extent equals another one if all words that its windows touch are equal. Every extent but those of
       the smallest id of its class is repeated as a whole.
    3. Where an anchor has several classes, the windows of each class's smallest id are compared one by one.
    Both comparisons take the smallest id by aggregation, so a passage that thousands of documents share
    costs its length, not its pairs. Rows of an anchor or class that holds a large part of all seeds are
    dealt to several tasks by a salt; the result is the same.
    """
    seeds, path = written(_seeds(texts, window, gram))
    total = seeds.count()
    shared = checkpoint(seeds.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).filter("low < high").select("anchor", "rows"))
    dealt, sums = _dealt(seeds, shared, ["anchor"], total)
    seeds = checkpoint(dealt.join(sums, ["anchor", "salt"], "left_semi").drop("salt"))
    discard(texts.sparkSession, path)
    classes = checkpoint(seeds.groupBy("anchor", "context").agg(F.min("id").alias("low"), F.count("*").alias("rows")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("rows")).filter("rows > 1")
    dealt, sums = _dealt(seeds, classes, ["anchor", "context"], total)
    judged = checkpoint(dealt.join(sums, ["anchor", "context", "salt"]).drop("salt").withColumn("key", _key("id")))
    whole = judged.filter("low < id").select("key", "tag", "first", "n")
    dealt, sums = _dealt(judged.filter("low = id"), several, ["anchor"], total)
    edge = dealt.join(sums, ["anchor", "salt"], "left_semi").drop("salt")
    listed = edge.groupBy("key", "tag").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("extents"))
    runs = _window_hashes(texts.join(listed, ["key", "tag"]), window)
    earliest = runs.groupBy("anchor", "run").agg(F.min("id").alias("low"))
    partly = runs.join(earliest, ["anchor", "run"]).filter("low < id").select("key", "tag", F.col("at").alias("first"), F.lit(1).alias("n"))
    return whole.unionByName(partly)


def _key(id_col: str) -> Column:
    """The id as text, never null: joins on it need no filter, so the texts' exchange is the same in each."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans[, kept_text]): one row per document.

    Words are runs of other characters than space and \\t\\n\\v\\f\\r, compared as they are. A word is removed
    when a window of `window` words that covers it also starts in a document with a smaller id; `spans` are
    the maximal repeats as (first word, words). Windows are judged on the input.

    Null text has no words. A null id is no earlier than any other: such a row loses nothing and makes
    nothing repeated. Rows that repeat id and text get the same result each; windows within one id never
    count. A document shorter than the window is kept whole. Bytes that are no UTF-8 are compared as they are
    and come back as U+FFFD in kept_text. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = docs.select("id", _key("id").alias("key"), F.xxhash64(F.col("text").cast("string")).alias("tag"), utf8("text").alias("bytes"))
    found = repeats(rows, window, gram).groupBy("key", "tag").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = rows.join(found, ["key", "tag"], "left").select("id", "bytes", "runs")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, runs in zip(batch.column(1), batch.column(2)):
                words, spans = (text.as_py() or b"").split(), []
                n = len(words)
                if runs.is_valid and batch.column(0)[len(out)].is_valid:
                    steps = np.zeros(n + 1, np.int64)
                    for r in runs.as_py():
                        steps[r["first"]] += 1
                        steps[r["first"] + r["n"] + window - 1] -= 1
                    gone = np.cumsum(steps[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans = [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2])]
                    words = [w for w, g in zip(words, gone) if not g]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), spans, kept.decode(errors="replace") if with_text else None))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), KINDS)] if out else [pa.array([], kind) for kind in KINDS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns][: 6 if with_text else 5], names=NAMES[: 6 if with_text else 5])

    names = ", ".join(f"{n} {k}" for n, k in (("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string"), ("spans", "array<struct<first:int,words:int>>")))
    schema = f"{field(rows, 'id')}, {names}" + ", kept_text string" * with_text
    NAMES = ["id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())])), pa.string()]
    return joined.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
