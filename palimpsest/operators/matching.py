"""Matching the chunks of document pairs, scoring reuse and finding page sections."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.lineage import cut, shared_folder
from .index import InvertedFile

PAIR = ["source_id", "target_id"]


#: Chunks of a document that are multiplied at a time.
BLOCK = 512
_SIDE = (("chunk_index", "index"), ("page_number", "page"), ("start_page", "start"), ("end_page", "end"), ("character_count", "chars"))


def chunk_pairs(pairs: DataFrame, chunks: DataFrame, threshold: float) -> DataFrame:
    """All chunk pairs of the listed document pairs with a dot product of `threshold` or more.

    A document's chunks go as blocks of BLOCK, which are joined by document id and multiplied as matrices in
    Arrow batches; only pairs over the threshold become rows. Vectors of different length raise an error.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    numbered = chunks.filter(F.col("embedding").isNotNull()).withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
    item = F.struct(*(F.col(c).alias(n) for c, n in _SIDE), F.col("embedding").alias("vector"))
    blocks = numbered.groupBy("document_id", "block").agg(F.collect_list(item).alias("items"))
    side = lambda key, name: blocks.select(F.col("document_id").alias(key), F.col("items").alias(name))
    joined = pairs.select(*PAIR).join(side("source_id", "a"), "source_id").join(side("target_id", "b"), "target_id").select(*PAIR, "a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [batch.column(c)[i].values.flatten() for c in (2, 3)]
                matrices = [x[-1].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x[-1]), -1) for x in held]
                scores = matrices[0] @ matrices[1].T
                at = np.nonzero(scores >= threshold)
                if len(at[0]):
                    keys = [pa.repeat(batch.column(c)[i], len(at[0])) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, *(x.take(pa.array(rows)) for own, rows in zip(held, at) for x in own[:-1]), pa.array(scores[at])], names=names)

    names = [*PAIR, *(f"{p}_{n}" for p in "ab" for _, n in _SIDE), "score"]
    kinds = [chunks.schema[c].dataType.simpleString() for c, _ in _SIDE]
    types = [*(pairs.schema[c].dataType.simpleString() for c in PAIR), *kinds, *kinds, "double"]
    return joined.mapInArrow(multiply, ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def _best(matches: DataFrame, own: str, other: str, tolerance: float, early: int | None, total: DataFrame | None) -> DataFrame:
    """Each own chunk's best other chunk: a fold in other-chunk order in which the nearer page wins within tolerance."""
    cols = ["index", "page", "start", "end", "chars"]
    item = F.struct(F.col(f"{other}_index").alias("index"), "score", F.abs(F.col(f"{own}_page") - F.col(f"{other}_page")).alias("far"), *(F.col(f"{other}_{c}").alias(c) for c in cols[1:]))
    listed = matches.groupBy(*PAIR, *(f"{own}_{c}" for c in cols)).agg(F.sort_array(F.collect_list(item)).alias("items"))
    wins = lambda best, x: F.when(F.abs(x.score - best.score) < tolerance, x.far < best.far).otherwise(x.score > best.score)
    if tolerance == 0:
        wins = lambda best, x: (x.score > best.score) | ((x.score == best.score) & (x.far < best.far))
    best = F.aggregate(F.slice("items", 2, F.size("items")), F.element_at("items", 1), lambda b, x: F.when(wins(b, x), x).otherwise(b))
    chosen = listed.withColumn("best", best).select(*PAIR, *(f"{own}_{c}" for c in cols), *(F.col(f"best.{c}").alias(f"{other}_{c}") for c in cols), F.col("best.score").alias("score"))
    if early is None or total is None:
        return chosen
    first = total.filter(F.col("rn") <= early).select(F.col("document_id").alias("source_id" if own == "a" else "target_id"), F.col("chunk_index").alias(f"{own}_index"))
    awake = chosen.join(first, [first.columns[0], f"{own}_index"], "left_semi").select(*PAIR).distinct()
    return chosen.join(awake, PAIR, "left_semi")


def best_matches(matches: DataFrame, chunks: DataFrame, tolerance: float = 0.001, early: int | None = 40) -> DataFrame:
    """Best matches from both sides, one row for each chunk pair with its highest score.

    A direction yields nothing when none of its first `early` chunks has a match.
    """
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    numbered = chunks.select("document_id", "chunk_index", F.row_number().over(order).alias("rn"))
    forth = _best(matches, "a", "b", tolerance, early, numbered)
    back = _best(matches, "b", "a", tolerance, early, numbered)
    cols = [c for c in forth.columns if c != "score"]
    return forth.unionByName(back.select(*forth.columns)).groupBy(*cols).agg(F.max("score").alias("score"))


def near_enough(score: Column, index_gap: Column, page_gap: Column, sure: float, most_index: int = -1, most_page: int = -1) -> Column:
    """The distance test of a reciprocal match: one whose score is under `sure` fails if it is too far by each bound that is set (-1: none)."""
    index_far, page_far = index_gap > most_index, page_gap > most_page
    far = index_far & page_far if most_index >= 0 and most_page >= 0 else index_far if most_index >= 0 else page_far if most_page >= 0 else F.lit(False)
    return F.coalesce(~((score < sure) & far), F.lit(True))


def fallback_matches(weak: DataFrame, primary: DataFrame, k: int = 5, max_length_gap: float = 0.4, sure: float = 0.85, most_index: int = -1, most_page: int = -1) -> DataFrame:
    """Reciprocal matches of chunks that the primary pass left alone, each chunk used once.

    `weak` has the chunk pairs over the lower threshold. Each side's k nearest are taken among all chunks;
    pairs nearest from both sides, both unmatched and of like length, are chosen greedily in source order. Bounds of
    index and page distance are off by default; see near_enough.
    """
    rank = lambda own, other: F.row_number().over(Window.partitionBy(*PAIR, f"{own}_index").orderBy(F.desc("score"), f"{other}_index"))
    near = weak.withColumn("ra", rank("a", "b")).withColumn("rb", rank("b", "a")).filter((F.col("ra") <= k) & (F.col("rb") <= k))
    sized = (F.col("a_chars") > 0) & (F.col("b_chars") > 0)  # lengths that are unknown or zero tell nothing
    gap = F.try_divide(F.abs(F.col("a_chars") - F.col("b_chars")), F.greatest("a_chars", "b_chars"))
    apart = lambda c: F.abs(F.coalesce(f"a_{c}", F.lit(0)) - F.coalesce(f"b_{c}", F.lit(0)))
    close = near_enough(F.col("score"), apart("index"), apart("page"), sure, most_index, most_page)
    free = near.filter(~F.coalesce(sized & (gap > max_length_gap), F.lit(False)) & close)
    for side in ("a", "b"):
        free = free.join(primary.select(*PAIR, f"{side}_index").distinct(), [*PAIR, f"{side}_index"], "left_anti")
    cols = [c for c in primary.columns if c not in PAIR]
    item = F.struct("a_index", "ra", *(c for c in cols if c != "a_index"))
    listed = free.groupBy(*PAIR).agg(F.sort_array(F.collect_list(item)).alias("items"))  # k for each of a pair's chunks, at the most
    taken = listed.withColumn("taken", _greedy(F.col("items.a_index"), F.col("items.b_index")))
    each = taken.select(*PAIR, F.explode(F.transform("taken", lambda i: F.get("items", i))).alias("m"))
    return each.select(*PAIR, *(F.col(f"m.{c}").alias(c) for c in cols)).select(*primary.columns)


@F.pandas_udf(ArrayType(IntegerType()))
def _greedy(own: pd.Series, other: pd.Series) -> pd.Series:
    """The places of the pairs that a greedy pass takes: each index once on its side; linear in the pairs."""

    def places(a: np.ndarray, b: np.ndarray) -> list[int]:
        used_a, used_b, out = set(), set(), []
        for i, (x, y) in enumerate(zip(a, b)):
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                out.append(i)
        return out

    return pd.Series([places(a, b) for a, b in zip(own, other)], dtype=object)


def minimum_evidence(source_total: Column, target_total: Column, floor: int = 1600, share: float = 0.05) -> Column:
    return F.greatest(F.lit(floor), F.ceil(F.lit(share) * F.least(source_total, target_total)).cast("int"))


def with_evidence(matches: DataFrame, chunks: DataFrame, floor: int = 1600) -> DataFrame:
    """The matches of pairs whose matched characters, counted per pair, reach the minimum evidence."""
    totals = chunks.groupBy("document_id").agg(F.sum("character_count").alias("total"))
    evidence = matches.groupBy(*PAIR).agg(F.least(F.sum("a_chars"), F.sum("b_chars")).alias("evidence"))
    named = evidence.join(totals.withColumnsRenamed({"document_id": "source_id", "total": "ta"}), "source_id").join(totals.withColumnsRenamed({"document_id": "target_id", "total": "tb"}), "target_id")
    return matches.join(named.filter(F.col("evidence") >= minimum_evidence(F.col("ta"), F.col("tb"), floor)), PAIR, "left_semi")


def adaptive_scores(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """(pair, matched_source_chars, matched_target_chars, matched_chunks, source_score, target_score).

    A chunk counts once on its side. `totals` has (document_id, total_characters); pairs without positive
    totals are left out.
    """
    per = {s: matches.select(*PAIR, f"{s}_index", f"{s}_chars").distinct().groupBy(*PAIR).agg(F.sum(f"{s}_chars").alias(f"{s}_sum"), F.count("*").alias(f"{s}_n")) for s in ("a", "b")}
    joined = per["a"].join(per["b"], PAIR)
    for side, key in (("a", "source_id"), ("b", "target_id")):
        joined = joined.join(totals.select(F.col("document_id").alias(key), F.col("total_characters").alias(f"{side}_total")).filter(f"{side}_total > 0"), key)
    return joined.select(
        *PAIR,
        F.col("a_sum").alias("matched_source_chars"),
        F.col("b_sum").alias("matched_target_chars"),
        F.col("a_n").alias("matched_chunks"),
        F.try_divide("a_sum", "a_total").alias("source_score"),
        F.try_divide("b_sum", "b_total").alias("target_score"),
        (F.try_divide("a_total", "b_total") * 100).alias("length_ratio"),
    )


def sections(matches: DataFrame, reusable_over: float = 0.85) -> DataFrame:
    """Sections of a pair: runs of matches, by source page, without a gap of more than one page."""
    order = Window.partitionBy(*PAIR).orderBy("a_page", "b_page", "a_index", "b_index")
    new = F.coalesce((F.col("a_page") - F.lag("a_page").over(order) > 1).cast("int"), F.lit(0))
    numbered = matches.withColumn("new", new).withColumn("section", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy(*PAIR, "section").agg(
        F.avg("score").alias("avg_score"), F.count("*").alias("n_matches"), *(f(f"{s}_page").alias(f"{s}_{n}") for s in ("a", "b") for f, n in ((F.min, "first"), (F.max, "last")))
    )
    return shown_sections(out, reusable_over)


def tier_of(score: Column) -> Column:
    return F.when(score > 0.85, "high").when(score >= 0.65, "review").otherwise("low")


def shown_sections(found: DataFrame, reusable_over: float = 0.85) -> DataFrame:
    """Sections with their pages as text, whether they are reusable, and their tier."""
    span = lambda lo, hi: F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))
    return found.withColumns(
        {"source_pages": span(F.col("a_first"), F.col("a_last")), "target_pages": span(F.col("b_first"), F.col("b_last")), "reusable": F.col("avg_score") > reusable_over, "tier": tier_of(F.col("avg_score"))}
    )


def section_coverage(found: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Distinct pages that a pair's sections cover on each side, and their share of the document."""
    per = []
    for side, key in (("a", "source_id"), ("b", "target_id")):
        pages = found.select(*PAIR, F.explode(F.sequence(f"{side}_first", f"{side}_last")).alias("page")).groupBy(*PAIR).agg(F.countDistinct("page").alias(f"{side}_pages"))
        counts = page_counts.select(F.col("document_id").alias(key), "page_count")
        per.append(pages.join(counts, key).withColumn(f"{side}_percent", F.try_divide(F.col(f"{side}_pages") * 100.0, "page_count")).drop("page_count"))
    return per[0].join(per[1], PAIR)


def match_pairs(pairs: DataFrame, chunks: DataFrame, primary: float = 0.85, fallback: float | None = 0.8, floor: int = 1600, tolerance: float = 0.001, early: int | None = 40) -> DataFrame:
    """Primary and fallback matches of document pairs that pass the evidence gate."""
    weak = cut(chunk_pairs(pairs, chunks, primary if fallback is None else min(fallback, primary)))
    strong = cut(best_matches(weak.filter(F.col("score") >= primary), chunks, tolerance, early))
    both = strong if fallback is None else strong.unionByName(fallback_matches(weak, strong))
    return cut(with_evidence(both, chunks, floor))


def similarity_search(sources: DataFrame, chunks: DataFrame, documents: DataFrame, candidates: DataFrame, limit: int = 30, min_source: float = 0.7, min_target: float = 0.7, **options) -> DataFrame:
    """The search: pair matching over candidates, directional scores, the best `limit`, then the floors."""
    pairs = candidates.join(sources.select(F.col("document_id").alias("source_id")), "source_id", "left_semi").select("source_id", F.col("document_id").alias("target_id"))
    scores = adaptive_scores(match_pairs(pairs, chunks, **options), documents)
    order = Window.partitionBy("source_id").orderBy(F.desc("source_score"), F.desc("target_score"), F.desc("matched_target_chars"), F.desc("matched_chunks"), "target_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.filter((F.col("source_score") >= min_source) & (F.col("target_score") >= min_target))


def selected_search(source: DataFrame, targets: DataFrame, chunks: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Scores of chosen targets without floors; a target with no match has zeros; see pairing.selected_pairs."""
    from .pairing import selected_pairs

    return selected_pairs(source, targets, chunks, documents, **options)


def text_reuse(chunks: DataFrame, size: int = 8) -> DataFrame:
    """listed_reuse of chunks (document_id, chunk_index, chunk_text)."""
    listed = chunks.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("items"))
    return listed_reuse(listed.select("document_id", F.transform("items", lambda x: x.chunk_text).alias("texts")), size)


def _combined(numbers: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of each n numbers in a row."""
    out = np.zeros(len(numbers) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(factor) + numbers[j : j + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def _anchors(numbers: np.ndarray, size: int) -> np.ndarray:
    """For each run of `size` words its anchor, the least hash among its shorter runs: equal runs have equal anchors, and neighbours mostly share one."""
    size = min(size, len(numbers))
    short = size // 2 + 1
    hashes = _combined(numbers, short, 0xC2B2AE3D27D4EB4F)
    n = len(numbers) - size + 1
    return np.minimum.reduce([hashes[i : i + n] for i in range(size - short + 1)]).view(np.int64)


#: A run on its way: two hashes, the place of its document in a list, and where it begins and ends in characters and chunks.
_RUN = np.dtype([("h", "u8"), ("g", "u4"), ("d", "u4"), ("c0", "u4"), ("c1", "u4"), ("k0", "u4"), ("k1", "u4")])


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on, so that bytes that are zero lie side by side and the shuffle's compression takes them away."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(planes: bytes, kind: np.dtype | type) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed(runs: np.ndarray) -> bytes:
    """Runs in the order of their documents; a place is told by its distance from the run before, an end from its start."""
    out = runs.copy()
    for c in ("d", "c0", "k0"):
        out[c][1:] -= runs[c][:-1]
    for low, high in (("c0", "c1"), ("k0", "k1")):
        out[high] -= runs[low]
    return _planes(out)


def _unpacked(planes: bytes) -> np.ndarray:
    out = _values(planes, _RUN)
    for c in ("d", "c0", "k0"):
        out[c] = np.cumsum(out[c], dtype=np.uint32)
    for low, high in (("c0", "c1"), ("k0", "k1")):
        out[high] += out[low]
    return out


def _class_ends(h: np.ndarray, g: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, g, low, high): each class of runs, sorted, with the least and the greatest of its documents."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
    return h[start], g[start], np.minimum.reduceat(low[order], start), np.maximum.reduceat(high[order], start)


def _class_places(h: np.ndarray, g: np.ndarray, of_h: np.ndarray, of_g: np.ndarray) -> np.ndarray:
    """Where the runs of of_h and of_g stand among sorted classes; -1 where they don't."""
    at, stop = np.searchsorted(h, of_h, "left"), np.searchsorted(h, of_h, "right")
    found = np.full(len(of_h), -1)
    for j in range((stop - at).max(initial=0)):  # classes with one h are told apart by g
        k = np.minimum(at + j, len(h) - 1)
        found = np.where((at + j < stop) & (g[k] == of_g), k, found)
    return found


def _parts(batches: Iterator[pd.DataFrame], least: int = 2**18) -> Iterator[pd.DataFrame]:
    """The rows that have words, in pieces of about `least` words, so that a piece has many words of each bucket and its arrays stay bounded."""
    held, n = [], 0
    for batch in batches:
        batch = batch[[x is not None and len(x) > 0 for x in batch.hashes]]
        for part in (batch.iloc[i : i + 32] for i in range(0, len(batch), 32)):
            held.append(part)
            n += sum(map(len, part.hashes))
            if n >= least:
                yield pd.concat(held)
                held, n = [], 0
    if held:
        yield pd.concat(held)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket of sorted ones, and its place."""
    found, starts = np.unique(buckets, return_index=True)
    return zip(found.tolist(), map(slice, starts, [*starts[1:], len(buckets)]), strict=True)


def _mixed(anchors: np.ndarray) -> np.ndarray:
    """Anchors spread evenly over 64 bits: as least hashes they crowd at the low end."""
    return anchors.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _shared_anchors(hashes: DataFrame, size: int, power: int) -> tuple[int, list[tuple[int, bytes]]]:
    """(n, [(bucket, bits)]): for each of 2^power buckets of anchors a table of 2^n bits in which those of two rows or more are set.

    Anchors are told apart by 32 bits and their bucket, so that a bit may be set for others too, never the other way round. All tables hold 2^29 bits at the most.
    """
    n = min(21, 29 - power)

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches):
            own = np.concatenate([np.unique(_anchors(np.asarray(x).view(np.uint64), size)) for x in part.hashes])
            kept, counts = np.unique(_mixed(own) >> np.uint64(32 - power), return_counts=True)
            kept = np.repeat(kept, np.minimum(counts, 2))
            low = kept.astype(np.uint32)
            rows = [(k, _planes(np.diff(low[at], prepend=np.uint32(0)))) for k, at in _by_bucket(kept >> np.uint64(32))]
            yield pd.DataFrame(rows, columns=["bucket", "data"])

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        low = np.sort(np.concatenate([np.cumsum(_values(x, np.uint32), dtype=np.uint32) for x in rows.data]))
        bits = np.zeros(2**n, bool)
        bits[low[1:][low[1:] == low[:-1]] >> np.uint32(32 - n)] = True
        return pd.DataFrame({"bucket": rows.bucket[:1], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    tables = hashes.mapInPandas(anchors, "bucket int, data binary").groupBy("bucket").applyInPandas(table, "bucket int, bits binary")
    return n, [(r.bucket, bytes(r.bits)) for r in tables.collect()]


def listed_reuse(listed: DataFrame, size: int = 8) -> DataFrame:
    """(document_id, reused_characters, reused_chunks, first_document): what a document's text shares with others, of (document_id, texts), its chunks in order.

    A word is reused when a run of `size` words around it stands in another document too, at any offset; a text of
    fewer words counts as one run. Runs are classed by 96 bits of hash and a class counts by its documents, so a run
    repeated within one document is no reuse and no table of pairs is made. reused_characters are those of
    reused words without blanks, reused_chunks the chunks that hold one, first_document the least id among the sharers.

    Only runs are classed whose anchor stands in another row. Of the anchors, some two for each five words, 32 bits are shuffled, and a table of bits, 64 MB
    at the most, tells the tasks which are shared; others that it lets through cost a run's shuffle and are no reuse. Runs go by buckets of their anchors
    as packed arrays, each with its place in characters and chunks, so that texts are met no more. Texts are stored in the shared folder.
    """
    spark, kind = listed.sparkSession, listed.schema["document_id"].dataType.simpleString()
    path = shared_folder(spark)
    listed.filter("document_id is not null").write.parquet(path, compression="zstd")
    texts = spark.read.parquet(path)
    chars = texts.agg(F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)))).first()[0] or 0
    power = min(16, max(4, (chars >> 23).bit_length()))  # some 600,000 to 1,200,000 words a bucket
    words = F.transform("texts", lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    split = texts.select("document_id", words.alias("words"))
    hashed = F.transform(F.flatten("words"), lambda w: F.xxhash64(w)).alias("hashes")
    lengths = F.transform(F.flatten("words"), lambda w: F.length(w)).alias("lengths")
    n, tables = _shared_anchors(split.select(hashed), size, power)
    sent = spark.sparkContext.broadcast(tables)

    def of(hashes: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, d: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        numbers, own = np.asarray(hashes).view(np.uint64), min(size, len(hashes))
        anchors = _mixed(_anchors(numbers, size))
        place = anchors >> np.uint64(64 - power - n)
        at = np.flatnonzero(bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
        chars = np.r_[0, np.cumsum(np.asarray(lengths))]
        chunk = np.repeat(np.arange((sizes > 0).sum()), sizes[sizes > 0])  # chunks with a word alone
        out = np.empty(len(at), _RUN)
        out["h"], out["g"] = _combined(numbers, own, 0x165667B19E3779F9)[at], _combined(numbers, own, 0xD6E8FEB86659FD93)[at] >> np.uint64(32)
        out["d"], out["c0"], out["c1"], out["k0"], out["k1"] = d, chars[at], chars[at + own], chunk[at], chunk[at + own - 1] + 1
        return (anchors[at] >> np.uint64(64 - power)).astype(np.int32), out

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((2**power, 2**n // 8), np.uint8)
        for bucket, data in sent.value:
            bits[bucket] = np.frombuffer(zlib.decompress(data), np.uint8)
        for part in _parts(batches):
            own = [of(h, c, np.asarray(k), d, bits.ravel()) for d, (h, c, k) in enumerate(zip(part.hashes, part.lengths, part.sizes, strict=True))]
            buckets, found, ids = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own]), part.document_id.to_numpy()
            order = np.argsort(buckets, kind="stable")
            rows, found = [], found[order]
            for bucket, at in _by_bucket(buckets[order]):
                owners, d = np.unique(found["d"][at], return_inverse=True)
                found["d"][at] = d
                rows.append((bucket, ids[owners].tolist(), _packed(found[at])))
            yield pd.DataFrame(rows, columns=["bucket", "ids", "data"])

    def shared(rows: pd.DataFrame) -> pd.DataFrame:
        names, ranks = np.unique(np.concatenate([np.asarray(x) for x in rows.ids]), return_inverse=True)
        ranks = np.split(ranks, np.cumsum([len(x) for x in rows.ids])[:-1])
        ends = [_class_ends(x["h"], x["g"], r[x["d"]], r[x["d"]]) for x, r in ((_unpacked(x), r) for x, r in zip(rows.data, ranks, strict=True))]
        h, g, low, high = _class_ends(*map(np.concatenate, zip(*ends, strict=True)))
        h, g, low = (x[low < high] for x in (h, g, low))
        out = []
        for data, r in zip(rows.data, ranks, strict=True):  # a piece's runs at a time
            x = _unpacked(data)
            place = _class_places(h, g, x["h"], x["g"])
            x, least = x[place >= 0], low[place[place >= 0]]
            start = np.flatnonzero(np.r_[True, (x["d"][1:] != x["d"][:-1]) | (x["c0"][1:] > x["c1"][:-1])][: len(x)])  # runs that meet are one
            stop = np.r_[start[1:], len(x)][: len(start)] - 1
            least = np.minimum.reduceat(least, start) if len(x) else least
            out.append(pd.DataFrame({"document_id": names[r[x["d"][start]]], "first_document": names[least], "c0": x["c0"][start], "c1": x["c1"][stop], "k0": x["k0"][start], "k1": x["k1"][stop]}))
        return pd.concat(out)

    sized = split.select("document_id", hashed, lengths, F.transform("words", lambda x: F.size(x)).alias("sizes"))
    rows = sized.mapInPandas(runs, f"bucket int, ids array<{kind}>, data binary")
    reused = rows.groupBy("bucket").applyInPandas(shared, f"document_id {kind}, first_document {kind}, c0 int, c1 int, k0 int, k1 int")
    before = Window.partitionBy("document_id").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)  # runs in their order, each by what it adds
    more = lambda a, b: F.greatest(F.lit(0), F.col(b) - F.greatest(F.col(a), F.coalesce(F.max(b).over(before), F.lit(0))))
    added = reused.select("document_id", "first_document", more("c0", "c1").alias("c"), more("k0", "k1").alias("k"))
    return added.groupBy("document_id").agg(F.sum("c").alias("reused_characters"), F.sum("k").alias("reused_chunks"), F.min("first_document").alias("first_document"))


def with_explanation(scores: DataFrame, matches: DataFrame, totals: DataFrame) -> DataFrame:
    """adaptive_scores with `explanation`, a sentence of the shares, characters and matched pairs."""
    counted = matches.groupBy(*PAIR).agg(F.count("*").alias("n_pairs"))
    out = scores.join(counted, PAIR)
    for side, key in (("source", "source_id"), ("target", "target_id")):
        out = out.join(totals.select(F.col("document_id").alias(key), F.col("total_characters").cast("bigint").alias(f"{side}_total")), key)
    return out.withColumn("explanation", explained())


def explained() -> Column:
    """The sentence of with_explanation, out of its columns."""
    text = "Source reuse %.1f%% (%,d/%,d characters), target reuse %.1f%% (%,d/%,d characters) across %d chunk pairs."
    share = lambda side: (F.col(f"{side}_score") * 100, F.col(f"matched_{side}_chars"), F.col(f"{side}_total"))
    return F.format_string(text, *share("source"), *share("target"), F.col("n_pairs"))


_TIERS = (("high", "%d highly reusable sections (>85%% similarity)"), ("review", "%d sections need review (65-85%% similarity)"), ("low", "%d low similarity sections (<65%%)"))


def tier_words() -> Column:
    """Counts by tier, columns of the tiers' names, in words; tiers without a section are left out."""
    return F.concat_ws(", ", *(F.when(F.col(t) > 0, F.format_string(text, F.col(t))) for t, text in _TIERS))


def section_summary(found: DataFrame) -> DataFrame:
    """(source_id, target_id, summary): a pair's sections counted by tier, in words; tiers without a section are left out."""
    counts = found.groupBy(*PAIR).agg(*(F.count_if(F.col("tier") == t).alias(t) for t, _ in _TIERS))
    return counts.select(*PAIR, tier_words().alias("summary"))


def block_by_cells(chunks: DataFrame, threshold: float, cells: int | None = None, copies: int = 10, block: int = 4096) -> DataFrame:
    """(source_id, target_id), source below target: documents with chunks of a dot product of `threshold` or more that share a cell.

    A vector is in its `copies` nearest cells of a stored inverted file, so that some pairs of far-off cells are missed; there are as many cells as the root
    of the number of vectors by default, 65,536 at the most. A cell's vectors are dealt by a hash to blocks of about `block`, kept as
    packed matrices. Pairs of blocks go as their numbers, each of which fetches its two matrices; no task holds a cell
    and only pairs of documents over the threshold become rows. Null and non-finite vectors are left out.
    """
    spark = chunks.sparkSession
    vectors = chunks.select("vec_id", "document_id", F.col("embedding").alias("vector"))
    index = InvertedFile.build(vectors, shared_folder(spark), cells, copies, keep=("document_id",))
    if not len(index.cells.centres):
        return vectors.select(F.col("document_id").alias("source_id"), F.col("document_id").alias("target_id")).filter("false")
    sizes = index.stored().groupBy("cell").agg(F.ceil(F.count("*") / block).alias("n_blocks"))  # a row a cell, 65,536 at the most
    dealt = index.stored().join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")))
    blocks = cut(dealt.groupBy("cell", "block").agg(F.collect_list(F.struct("document_id", "vector")).alias("items")))
    numbers = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    pairs = sizes.withColumn("one", numbers).withColumn("two", F.explode(F.sequence("one", F.col("n_blocks") - 1))).select("cell", "one", "two")
    side = lambda number, name: blocks.select("cell", F.col("block").alias(number), F.col("items").alias(name))
    joined = pairs.join(side("one", "a"), ["cell", "one"]).join(side("two", "b"), ["cell", "two"]).select("a", "b")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values for c in (0, 1))
                x, y = (np.array(s.field("vector").to_pylist(), np.float64) for s in (a, b))
                own, other = (s.field("document_id").to_numpy(zero_copy_only=False) for s in (a, b))
                at, to = np.nonzero(x @ y.T >= threshold)
                low, high = np.minimum(own[at], other[to]), np.maximum(own[at], other[to])
                found = np.unique(np.stack([low, high])[:, low < high], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=PAIR)

    return joined.mapInArrow(multiply, "source_id bigint, target_id bigint").distinct()


def corpus_pairs(chunks: DataFrame, documents: DataFrame, primary: float = 0.85, fallback: float | None = 0.8, copies: int | None = None, cells: int | None = None, **options) -> DataFrame:
    """adaptive_scores of all pairs of documents, source below target, that pass the evidence gate; exact, see pairing.all_pairs.

    With `copies` or `cells` only the pairs that share a cell of an index meet (block_by_cells at the lower threshold); the pairs found are matched in whole.
    """
    if copies is None and cells is None:
        from .pairing import all_pairs

        return all_pairs(chunks, documents, primary, fallback, **options)
    least = primary if fallback is None else min(primary, fallback)
    pairs = cut(block_by_cells(chunks, least, cells, copies or 10))
    return adaptive_scores(match_pairs(pairs, chunks, primary=primary, fallback=fallback, **options), documents)
