"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, field, utf8

BUCKETS = 1 << 16
#: Mean natural-log ratio under which a document goes.
THRESHOLD = -0.11
#: Log ratio under which a word's bucket is far off the target.
OFF_TARGET = -0.8
#: Summed log ratio of the far-off words, per word of the text, under which a document goes.
TAIL_THRESHOLD = -0.025
#: Labelled rows that the target is fitted on, at most; their ids are broadcast.
MOST_TRUSTED = 500_000
#: Counts added to each bucket.
SMOOTHING = 4.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = bytes(c for c in range(256) if c not in b"#*$%&|<>")
_CONTINUATION = bytes(c for c in range(0x80, 0xC0))


class _Numbers(dict):
    """Numbers of words in order of appearance, with a hash of each."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return n


def _word_numbers(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    numbers = _Numbers()
    at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return at, np.array(numbers.hashes, np.uint64)


def feature_buckets(at: np.ndarray, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets of a text's words and word pairs."""
    one = hashes[at]
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (one[1:] + np.uint64(0x632BE59BD9B4E019))
    x = np.concatenate([one, two])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def repeated_words(at: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    if len(at) < 4:
        return 0
    n = int(at.max()) + 1
    pair = at[:-1] * n + at[1:]
    pair = np.unique(pair, return_inverse=True)[1] if n > 2_000_000 else pair
    _, where, count = np.unique(pair[:-1] * n + at[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[where] > 1)
    steps = np.zeros(len(at) + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + 3, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.split():
            seen.add(line)
    return found


def base_figures(text: bytes | None) -> tuple[tuple[int, int, int, int, int], np.ndarray, np.ndarray]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), word numbers, their hashes)."""
    text = text or b""
    words = text.split()
    at, hashes = _word_numbers(words)
    chars = len(b"".join(words).translate(None, _CONTINUATION))
    return (len(words), chars, len(text.translate(None, _SYMBOLS)), duplicate_lines(text), repeated_words(at)), at, hashes


def learn_ratios(docs: DataFrame, trusted_col: str, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of the whole corpus and of its trusted rows; `buckets` rows at most.

    Each task sends its sums once, so the shuffle holds `buckets` rows for a task at most.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, trusted in zip(batch.column(0), batch.column(1)):
                at, hashes = _word_numbers((text.as_py() or b"").split())
                if len(at):
                    found = np.bincount(feature_buckets(at, hashes, buckets), minlength=buckets)
                    raw += found
                    if trusted.as_py():
                        target += found
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw[used], "target": target[used]})

    counts = docs.select(utf8(text_col), trusted_col).mapInArrow(scan, "bucket bigint, raw bigint, target bigint")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: list[tuple[int, int, int]], buckets: int) -> np.ndarray:
    """ln(p_target / p_raw) by bucket: the target's counts against those that the raw share leads to expect.

    SMOOTHING is added to both, so a bucket that is too rare to tell has a ratio near 0.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts:
        raw[bucket], target[bucket] = r, t
    expected = raw * (target.sum() / max(raw.sum(), 1))
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def text_ratios(at: np.ndarray, hashes: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """(mean log ratio over a text's words and word pairs, summed ratio of its words below OFF_TARGET per word); 0 without words.

    A few far-off words hardly move the mean of a long text; they are all that the second figure counts.
    """
    if not len(at):
        return 0.0, 0.0
    found = ratios[feature_buckets(at, hashes, len(ratios))]
    words = found[: len(at)]
    return float(found.mean()), float(words[words < OFF_TARGET].sum() / len(at))


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS, tail_threshold: float = TAIL_THRESHOLD
) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, tail, kept): a row per document.

    llr is the mean of ln(p_target / p_raw) over the hashed words and word pairs of the whole text, where
    p_target comes from the rows whose ids `trusted` lists, at most MOST_TRUSTED or so, and p_raw from all rows; tail is the sum of
    the ratios under OFF_TARGET of its words, divided by n_words. Every document is kept when it passes the base rules,
    llr >= threshold and tail >= tail_threshold. Without any trusted row all ratios are 0.

    Words are runs of other characters than space and \\t\\n\\v\\f\\r, with their case. Null text has no words
    and fails the base rules. Null ids and repeated rows each keep a row; a null id is never trusted.
    Other columns are ignored. An empty table gives an empty result.
    """
    listed = trusted.select(F.col(f"`{id_col}`").alias("__trusted")).distinct()
    listed = F.broadcast(listed) if trusted.count() <= 2 * MOST_TRUSTED else listed
    marked = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(listed, F.col("__id") == F.col("__trusted"), "left")
    counts = checkpoint(learn_ratios(marked.withColumn("__good", F.col("__trusted").isNotNull()), "__good", "__text", buckets))
    broadcast = docs.sparkSession.sparkContext.broadcast(log_ratios([tuple(x) for x in counts.collect()], buckets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = broadcast.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                figures, at, hashes = base_figures(text.as_py())
                failed = figures[0] < MIN_WORDS or 100 * figures[4] > MAX_REPEAT_PERCENT * figures[0]
                llr, tail = text_ratios(at, hashes, ratios)
                rows.append((*figures, failed, llr, tail, not failed and llr >= threshold and tail >= tail_threshold))
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "tail", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
    schema = f"{field(docs, id_col, 'id')}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, tail double, kept boolean"
    return docs.select(F.col(f"`{id_col}`").alias("id"), utf8(f"`{text_col}`").alias("text")).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = MOST_TRUSTED) -> DataFrame:
    """(id): ids that a label calls good and none calls bad or toxic; a hashed sample of about `most` if there are more.

    Labels without an id are left out, a null quality is not good, a null toxic is not toxic; rows that repeat or
    contradict count together. Other columns are ignored. An empty table gives an empty result.
    """
    good = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))).alias("__trusted")
    )
    ids = checkpoint(good.filter("__trusted").select(id_col))
    n = ids.count()
    return ids if n <= most else ids.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 40)) < int((1 << 40) * most / n))
