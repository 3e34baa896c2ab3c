"""Language identification with hyperdimensional profiles.

A letter has a random vector of +1 and -1, a letter n-gram the product of its letters' vectors, each
permuted (rotated) by its place; a text bundles (sums) the vectors of its n-grams and a language those of
its texts. A document gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, field, id_remainder, renamed, slices, valid_text

DIM = 1024
NGRAM = 3
#: N-gram vectors held at a time.
GRAMS = 4096
#: Prototypes in one pass; more languages take more passes.
BLOCK = 4096
UNKNOWN = "und"
#: Cosines under this are within the chance of random vectors of DIM places.
MIN_SCORE = 0.05


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _random(codes: np.ndarray, dim: int) -> np.ndarray:
    """A +1/-1 vector for each code point, the same on every machine."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dim // 64 + 1, dtype=np.uint64)[None] * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (2 * np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) - 1).reshape(len(codes), dim)


def profile_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, count, codes): letter trigrams of each text; gram indexes the rows of `codes`.

    Runs of anything but letters count as one space; each text starts and ends with a space.
    """
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts])
    row = np.repeat(np.arange(len(texts)), lengths)
    code = np.where(_letters()[code], code, 32)
    keep = np.r_[True, (code[1:] != 32) | (code[:-1] != 32) | (row[1:] != row[:-1])]
    code, row = code[keep], row[keep]
    seen = np.unique(code)
    small = np.searchsorted(seen, code).astype(np.int64)
    whole = row[2:] == row[:-2]
    size = len(seen)
    key = (((row[2:] * size + small[:-2]) * size + small[1:-1]) * size + small[2:])[whole]
    key, count = np.unique(key, return_counts=True)
    gram, place = np.unique(key % size**NGRAM, return_inverse=True)
    return key // size**NGRAM, place, count, seen[np.stack([gram // size**2, gram // size % size, gram % size], axis=1)]


def gram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Bind: the product of the letters' vectors, rotated by 2, 1 and 0 places."""
    seen, at = np.unique(codes, return_inverse=True)
    letters, at = _random(seen, dim), at.reshape(codes.shape)
    out = letters[at[:, -1]]
    for i in range(NGRAM - 1):
        out = out * np.roll(letters, NGRAM - 1 - i, axis=1)[at[:, i]]
    return out.astype(np.float32)


def bundles(row: np.ndarray, gram: np.ndarray, count: np.ndarray, codes: np.ndarray, n_rows: int, dim: int) -> np.ndarray:
    """Bundle: the sum of each row's n-gram vectors, which are made GRAMS at a time."""
    out = np.zeros((n_rows, dim), np.float32)
    for low in range(0, len(codes), GRAMS):
        own = slice(None) if len(codes) <= GRAMS else (gram >= low) & (gram < low + GRAMS)
        vectors, r, g, c = gram_vectors(codes[low : low + GRAMS], dim), row[own], gram[own] - low, count[own].astype(np.float32)
        cut = np.searchsorted(r, np.arange(n_rows + 1))
        for i in np.flatnonzero(np.diff(cut)):
            out[i] += c[cut[i] : cut[i + 1]] @ vectors[g[cut[i] : cut[i + 1]]]
    return out


def learn_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(lang, vector array<double>): the bundle of all n-grams of each language's texts; null rows are left out.

    A batch sends one partial sum for each of its languages; they are added up by place in the vector.
    """
    rows = docs.select(F.make_valid_utf8(F.col(lang_col).cast("string")).alias("lang"), valid_text(text_col).alias("text")).filter("lang is not null and text is not null")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1, 1 << 19):
                langs, group = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
                row, gram, count, codes = profile_counts(part.column(1).to_pylist())
                if not len(codes):
                    continue
                order = np.argsort(group[row], kind="stable")
                sums = bundles(group[row][order], gram[order], count[order], codes, len(langs), dim)
                for lang, own in zip(langs, sums.astype(np.float64)):
                    held[str(lang)] = held.get(str(lang), 0) + own
                if len(held) > 64:
                    yield emit(held)
                    held = {}
        if held:
            yield emit(held)

    def emit(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": list(held), "part": [x.tolist() for x in held.values()]}, pa.schema([("lang", pa.string()), ("part", pa.list_(pa.float64()))]))

    parts = rows.mapInArrow(scan, "lang string, part array<double>")
    sums = parts.select("lang", F.posexplode("part").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    return sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e.x).alias("vector"))


def _score(docs: DataFrame, prototypes: list[tuple[str, list[float]]], text_col: str, keep: list[str], dim: int) -> DataFrame:
    """Replace __lang and __cosine where a prototype of this block is nearer (ties: the smaller name)."""
    prototypes = sorted(prototypes)
    names = [x for x, _ in prototypes]
    matrix = np.array([v for _, v in prototypes], np.float64).reshape(len(names), dim)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)).astype(np.float32)
    broadcast = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = broadcast.value
        for whole in batches:
            for batch in slices(whole, 0, 1 << 19):
                langs, scores = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                texts = [x or "" for x in batch.column(0).to_pylist()]
                row, gram, count, codes = profile_counts(texts)
                if len(codes) and names:
                    sums = bundles(row, gram, count, codes, len(texts), dim)
                    cosines = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)) @ matrix.T
                    best = cosines.argmax(axis=1)
                    for i in np.unique(row):
                        value = min(1.0, max(0.0, float(cosines[i, best[i]])))
                        if langs[i] == UNKNOWN or (-value, names[best[i]]) < (-scores[i], langs[i]):
                            langs[i], scores[i] = names[best[i]], value
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[3:]], names=["__lang", "__cosine", *keep])

    schema = ", ".join(["__lang string, __cosine double", *(field(docs, c) for c in keep)])
    return docs.select(valid_text(text_col).alias("__text"), "__lang", "__cosine", *(F.col(c) for c in keep)).mapInArrow(scan, schema)


def predict_language(docs: DataFrame, prototypes: DataFrame, text_col: str = "text", keep_cols: tuple[str, ...] = ("doc_id",), dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """[keep_cols], lang_pred, score: one row per document, from its text alone.

    score is the cosine with the nearest prototype, cut to 0..1; ties go to the smaller name. Null text and
    text without a letter get 'und' and 0, as does every text when there are no prototypes. Prototypes are
    taken `block` languages at a time, so a pass holds block * dim numbers at most. Bytes that are no UTF-8 count
    as U+FFFD, which is no letter. Kept columns may have any name but the result's two, whose place these take.
    """
    kept = [c for c in dict.fromkeys(keep_cols) if c not in ("lang_pred", "score")]
    docs, names = renamed(docs)
    keep, text_col = [names[c] for c in kept], names[text_col]
    rows = docs.withColumns({"__lang": F.lit(UNKNOWN), "__cosine": F.lit(0.0)})
    n_langs = prototypes.count()
    n_blocks = max(1, -(-2 * n_langs // block) if n_langs > block else 1)
    for i in range(n_blocks):
        held = prototypes if n_blocks == 1 else prototypes.filter(F.pmod(F.xxhash64("lang"), F.lit(n_blocks)) == i)
        more = [] if i + 1 == n_blocks else [text_col]
        rows = _score(rows, [(x.lang, list(x.vector)) for x in held.collect()], text_col, list(dict.fromkeys([*keep, *more])), dim)
    return rows.select(*keep, "__lang", "__cosine").toDF(*kept, "lang_pred", "score")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep_cols: tuple[str, ...] | None = None, dim: int = DIM) -> DataFrame:
    """[keep_cols], held_out, lang_pred, score: learn from four fifths of the labelled rows, predict all.

    A row is held out when crc32(id as text) mod 5 is 0 (a null id counts as the empty string). A null text or
    language teaches nothing. An empty table gives an empty result; repeated rows each keep a row. Kept columns
    may have any name but the result's three, whose place these take.
    """
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in ("held_out", "lang_pred", "score")]
    inner, names = renamed(docs)
    rows = inner.withColumn("held", id_remainder(names[id_col]) == 0)
    prototypes = checkpoint(learn_prototypes(rows.filter(~F.col("held")), names[lang_col], names[text_col], dim))
    return predict_language(rows, prototypes, names[text_col], (*(names[c] for c in kept), "held"), dim).toDF(*kept, "held_out", "lang_pred", "score")


def drop_unidentified(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is found with a cosine of min_score or more, with their columns, whatever these are named.

    Null text and text without a letter go. Of repeated rows all stay or none; a null id stays by its text. An
    empty table gives an empty result, as does one without any labelled text to learn from. Texts are read whole.
    """
    inner, names = renamed(docs)
    found = identify_languages(inner, names[id_col], names[text_col], names[lang_col])
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return kept.select(*names.values()).toDF(*docs.columns)
