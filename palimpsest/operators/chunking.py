"""Chunk build: paragraph rules as Column expressions, merging and packing as ordered folds over a document's lengths."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.folds import NOISE, OPTION, TEXT, members, merged_groups, option_owners, pack_groups, packed_pieces, piece_starts, tiny_groups
from ..functions.text import is_form_option, is_incomplete, is_noise, nonspace_length, sentences, strip_prefixes, trimmed, with_options_joined, without_footnotes

KEY = "document_id"


def folded(lengths: Column, group_of: Callable[[list[int]], list], kind: str = "array<int>") -> Column:
    """group_of over each array of lengths: a fold in linear time, which sees numbers and no texts."""

    def fold(arrays: pd.Series) -> pd.Series:
        return pd.Series([group_of([int(n) for n in x]) for x in arrays], dtype=object)

    return F.pandas_udf(fold, kind)(lengths)


def plain_folded(lengths: Column, group_of: Callable[[list], list], kind: str = "array<int>") -> Column:
    """folded without Arrow: its worker holds neither pandas nor Arrow's memory, which counts where several folds stand in one task."""
    return F.udf(group_of, kind, useArrow=False)(lengths)


def _exploded(rows: DataFrame, array: Column | str, *names: str) -> DataFrame:
    """rows with a row for each (position, element) of an array under the two names; none for an empty array.

    The outer form, filtered: for a plain explode Spark infers a filter on the array's size and pushes it
    down, which computes a costly array once more, and once for each element where it stands in a lambda.
    """
    return rows.select("*", F.posexplode_outer(array).alias(*names)).filter(F.col(names[0]).isNotNull())


def _dealt(rows: DataFrame, number: str, group_of: Callable[[list[int]], list[int]], fold: Callable[..., Column] = folded) -> DataFrame:
    """(document_id, groups): a document's paragraphs in idx order, dealt to the groups that group_of gives from the column `number`.

    The fold sees a document's numbers alone; its texts stay in their row and are picked by place, so that they are shuffled once, by document.
    """
    rest = [c for c in rows.columns if c not in (KEY, "idx", number)]
    lists = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("idx", number, *rest))).alias("all"))
    dealt = lists.withColumn("at", fold(F.col(f"all.{number}"), lambda numbers: members(group_of(numbers)), "array<array<int>>"))
    groups = F.transform("at", lambda places: F.transform(places, lambda i: F.get("all", i)))
    return dealt.select(KEY, groups.alias("groups"))


def _gathered(rows: DataFrame, number: str, group_of: Callable[[list[int]], list[int]]) -> DataFrame:
    """(document_id, group, items): _dealt's groups, a row each."""
    return _exploded(_dealt(rows, number, group_of), "groups", "group", "items").drop("groups")


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chars", F.coalesce(nonspace_length(F.col("text")), F.lit(0)))


def _ranged(rows: DataFrame) -> DataFrame:
    """rows with start_page and end_page, null where a paragraph has its page number alone."""
    return rows.withColumns({c: F.lit(None).cast("int") for c in ("start_page", "end_page") if c not in rows.columns})


def paragraphs_of(docs: DataFrame, id_col: str, text_col: str, per_page: int = 5) -> DataFrame:
    """(document_id, idx, page_number, text): lines of a text, a page for every `per_page` of them."""
    rows = docs.select(F.col(id_col).alias(KEY), F.posexplode(F.split(text_col, "\n")).alias("idx", "text"))
    return rows.withColumn("page_number", (F.col("idx") / per_page).cast("int") + 1)


def _coded(rows: DataFrame) -> DataFrame:
    """rows with `code`, the length and kind of a paragraph as option_owners reads them."""
    kind = F.when(is_form_option(F.col("text")), OPTION).when(is_noise(F.col("text")), NOISE).otherwise(TEXT)
    return rows.withColumn("code", F.coalesce(nonspace_length(F.col("text")), F.lit(0)) * 4 + kind)


def merge_form_options(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Form options appended to the question: the last paragraph before them that is neither noise nor an option.

    Without a question an option goes to the paragraph before it, noise included. An option that would bring the
    non-space length to `limit` stays apart, and a later one that fits is still appended.
    """
    listed = _gathered(_coded(rows).select(KEY, "idx", "code", "text", "page_number"), "code", lambda codes: option_owners(codes, limit))
    first = F.col("items")[0]
    return listed.select(KEY, first.idx.alias("idx"), first.page_number.alias("page_number"), F.array_join(F.transform("items", lambda x: x.text), " ").alias("text"))


def clean_paragraphs(rows: DataFrame) -> DataFrame:
    """Noise dropped, prefixes stripped, empty ones dropped."""
    kept = rows.filter(~is_noise(F.col("text"))).withColumn("text", strip_prefixes(F.col("text")))
    return kept.filter(F.length("text") > 0)


def merge_incomplete(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Paragraphs that end mid-sentence with the next one appended, in pairs, the pair's pages as its range.

    A paragraph can take the next if both together stay under `limit`. In a run of such paragraphs every
    second one is taken, so its place in the run decides, and no fold is needed.
    """
    order = Window.partitionBy(KEY).orderBy("idx")
    after = lambda c: F.lead(c).over(order)
    marked = _ranged(rows).withColumns({"chars": nonspace_length(F.col("text")), "next": after("text"), "row": F.row_number().over(order)})
    can = F.col("next").isNotNull() & is_incomplete(F.col("text"), F.col("next")) & (F.col("chars") + after("chars") < limit)
    marked = marked.withColumns({"can": F.coalesce(can, F.lit(False)), "last_page": after(F.coalesce("end_page", "page_number"))})
    before = F.coalesce(F.max(F.when(~F.col("can"), F.col("row"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("odd", (F.col("row") - before) % 2 == 1)
    takes = F.col("can") & F.col("odd")
    return marked.filter("odd").select(
        KEY,
        "idx",
        "page_number",
        F.when(takes, F.coalesce("start_page", "page_number")).otherwise(F.col("start_page")).alias("start_page"),
        F.when(takes, F.col("last_page")).otherwise(F.col("end_page")).alias("end_page"),
        F.when(takes, F.concat_ws(" ", "text", "next")).otherwise(F.col("text")).alias("text"),
    )


def merge_tiny(rows: DataFrame, least: int = 120, limit: int = 2000) -> DataFrame:
    """Paragraphs under `least` characters joined with their neighbours, under `limit` together.

    A group has the pages of its long paragraph, or else of its first.
    """
    lists = _gathered(_sized(_ranged(rows)), "chars", lambda lengths: tiny_groups(lengths, least, limit))
    owner = F.coalesce(F.get(F.filter("items", lambda x: x.chars >= least), F.lit(0)), F.get("items", F.lit(0)))
    text = F.array_join(F.transform("items", lambda x: x.text), " ")
    return lists.select(KEY, F.col("items")[0].idx.alias("idx"), owner.alias("o"), text.alias("text")).select(KEY, "idx", "o.page_number", "o.start_page", "o.end_page", "text")


def split_oversized(rows: DataFrame, limit: int = 2000) -> DataFrame:
    """Paragraphs over `limit` characters cut at sentence ends; pieces keep the page number, not the range."""
    rows = _ranged(rows).select(KEY, "idx", "page_number", "start_page", "end_page", "text")
    over = F.coalesce(nonspace_length(F.col("text")), F.lit(0)) > limit
    cut = rows.withColumn("over", over).withColumn("s", F.when(F.col("over"), sentences(F.col("text"))).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("starts", folded(F.transform("s", nonspace_length), lambda lengths: piece_starts(lengths, limit)))
    stop = lambda i: F.coalesce(F.get("starts", i + 1), F.size("s"))
    pieces = F.transform("starts", lambda at, i: trimmed(F.array_join(F.slice("s", at + 1, stop(i) - at), " ")))
    pages = [F.when(~F.col("over"), F.col(c)).alias(c) for c in ("start_page", "end_page")]
    listed = cut.select(KEY, "idx", "page_number", *pages, "over", F.when(F.col("over"), pieces).otherwise(F.array("text")).alias("pieces"))
    split = _exploded(listed, "pieces", "piece", "text").drop("pieces")
    order = Window.partitionBy(KEY).orderBy("idx", "piece")
    kept = split.filter(~F.col("over") | (F.length("text") > 0))
    return kept.withColumn("idx", F.row_number().over(order) - 1).drop("piece", "over")


def pack(rows: DataFrame, limit: int = 1000) -> DataFrame:
    """Chunks of consecutive paragraphs up to `limit` non-space characters, one paragraph at least, no overlap.

    The capacity fold numbers a document's paragraphs from their lengths alone; texts join only afterwards.
    """
    ranged = F.col("start_page").isNotNull() & F.col("end_page").isNotNull()
    page = lambda c: F.when(ranged, F.col(c)).otherwise(F.col("page_number"))
    paged = _sized(_ranged(rows)).select(KEY, "idx", "chars", "text", F.least(page("start_page"), page("end_page")).alias("first"), F.greatest(page("start_page"), page("end_page")).alias("last"))
    joined = _gathered(paged, "chars", lambda lengths: pack_groups(lengths, limit))
    return joined.select(
        KEY,
        F.col("group").alias("chunk_index"),
        F.array_join(F.transform("items", lambda x: x.text), " ").alias("chunk_text"),
        F.array_min(F.transform("items", lambda x: x["first"])).alias("start_page"),
        F.array_max(F.transform("items", lambda x: x["last"])).alias("end_page"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + x.chars).alias("character_count"),
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str, limit: int, least: int) -> DataFrame:
    rows = clean_paragraphs(merge_form_options(paragraphs_of(docs, id_col, text_col), limit))
    return split_oversized(merge_tiny(merge_incomplete(rows, limit), least, limit), limit)


def build_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1000, least: int = 80) -> DataFrame:
    """The whole build: options merged, noise and prefixes dropped, cut and tiny paragraphs merged, long ones split, packed."""
    return pack(_prepared(docs, id_col, text_col, limit, least), limit)


def _picked(places: Column | str, texts: str) -> Column:
    """The texts at each group's places, joined."""
    return F.transform(places, lambda group: F.array_join(F.transform(group, lambda i: F.get(texts, i)), " "))


def _held(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed before what reads them: Spark would put a column's rule, or a fold, into the lambdas that read it, where it runs for each element or can't run."""
    return rows.select(F.explode_outer(F.array(F.struct(*rows.columns))).alias("held")).select("held.*")


def chunk_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1000, least: int = 80) -> DataFrame:
    """(document_id, texts): build_chunks' texts, a row a document, none of them where all lines are noise.

    The same rules one after another, but a document's lines are brought together once and stay in its row, so that nothing else is shuffled.
    """
    size = lambda x: F.coalesce(nonspace_length(x), F.lit(0))
    lines = _held(_dealt(_coded(paragraphs_of(docs, id_col, text_col)).select(KEY, "idx", "code", "text"), "code", lambda codes: option_owners(codes, limit), plain_folded))
    joined = F.transform("groups", lambda items: F.array_join(F.transform(items, lambda x: x.text), " "))
    clean = _held(lines.select(KEY, F.filter(F.transform(F.filter(joined, lambda x: ~is_noise(x)), strip_prefixes), lambda x: F.length(x) > 0).alias("t")))

    after = lambda i: F.get("t", i + 1)
    can = lambda x, i: F.coalesce(is_incomplete(x, after(i)) & (nonspace_length(x) + nonspace_length(after(i)) < limit), F.lit(False))
    codes = F.transform("t", lambda x, i: size(x) * 2 + F.when(can(x, i), 1).otherwise(0))
    merged = _held(clean.withColumn("at", plain_folded(codes, lambda numbers: merged_groups(numbers, least, limit), "array<array<int>>")))

    cut = _held(_held(merged.select(KEY, _picked("at", "t").alias("t"))).withColumn("s", F.transform("t", lambda x: F.when(size(x) > limit, sentences(x)))))
    sizes = F.transform("t", lambda x, i: F.when(F.get("s", i).isNull(), F.array(size(x))).otherwise(F.transform(F.get("s", i), size)))
    packed = _held(cut.withColumn("at", plain_folded(sizes, lambda rows: packed_pieces(rows, limit), "array<array<array<int>>>")))
    piece = lambda p: F.when(F.get("s", p[0]).isNull(), F.get("t", p[0])).otherwise(trimmed(F.array_join(F.slice(F.get("s", p[0]), p[1] + 1, p[2]), " ")))
    return packed.select(KEY, F.transform("at", lambda group: F.array_join(F.transform(group, piece), " ")).alias("texts"))


def window_bounds(lengths: list[int], size: int, overlap: int, least: int, limit: int) -> list[list[int]]:
    """(start, count) of sentence windows: up to `size` sentences, more while under `least` characters.

    A sentence that would pass `limit` ends the window, but for its first two. The next window starts
    `overlap` sentences before the end of this one, so the last one can hold repeated sentences alone.
    """
    out, start = [], 0
    while start < len(lengths):
        n = held = 0
        for length in lengths[start:]:
            fits = held + length <= limit
            if not (fits or n < 2 if n < size else fits and held < least):
                break
            n, held = n + 1, held + length
        out.append([start, n])
        start += max(1, n - overlap)
    return out


def sentence_list(text: Column) -> Column:
    """A text's sentences without footnotes and prefixes."""
    return F.filter(F.transform(sentences(without_footnotes(text)), strip_prefixes), lambda s: F.length(trimmed(s)) > 0)


def with_sentence_chunks(docs: DataFrame, text: Column, size: int, overlap: int, least: int, limit: int) -> DataFrame:
    """docs with `chunk`, the array of its text's sentence chunks."""

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def bounds(arrays: pd.Series) -> pd.Series:
        return pd.Series([window_bounds([int(n) for n in x], size, overlap, least, limit) for x in arrays], dtype=object)

    listed = docs.withColumn("__s", sentence_list(F.coalesce(text, F.lit("")))).withColumn("__s", with_options_joined(F.col("__s")))
    placed = listed.withColumn("__at", bounds(F.transform("__s", nonspace_length)))
    return placed.withColumn("chunk", F.transform("__at", lambda w: F.array_join(F.slice("__s", w[0] + 1, w[1]), " "))).drop("__s", "__at")


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 4, overlap: int = 1, least: int = 400, limit: int = 2000) -> DataFrame:
    """(document_id, chunk_index, chunk_text): windows of sentences, the last `overlap` of them repeated."""
    rows = docs.select(F.col(id_col).alias(KEY), F.col(text_col).alias("text"))
    found = with_sentence_chunks(rows, F.col("text"), size, overlap, least, limit).select(KEY, "chunk")
    return _exploded(found, "chunk", "chunk_index", "chunk_text").drop("chunk")


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _page_places(texts: pd.Series, chunks: pd.Series, lengths: pd.Series) -> pd.Series:
    """Where the pages of each chunk's first and last character stand; a chunk is looked for after the one before."""

    def places(text: str, parts: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
        stops, cursor, out = np.cumsum(sizes), 0, []
        for part in parts:
            at = text.find(part, cursor)
            if at < 0:
                out.append([0, 0])
                continue
            cursor = at + len(part)
            out.append(np.searchsorted(stops, [at, max(at, cursor - 1)], "right").tolist())
        return out

    return pd.Series([places(*row) for row in zip(texts, chunks, lengths)], dtype=object)


def paged_chunks(pages: DataFrame, size: int = 4, overlap: int = 0, least: int = 320, limit: int = 1000) -> DataFrame:
    """(document_id, chunk_index, chunk_text, start_page, end_page, character_count) from (document_id, page_number, text).

    A document's pages are joined, each ended by a line break, and cut into sentence chunks. A chunk has the
    pages of its first and last character; one whose text isn't found as it stands has the first page.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pages.select(KEY, "page_number", F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n"))).alias("body"))
    docs = rows.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("page_number", "body"))).alias("p"))
    docs = docs.select(KEY, F.col("p.page_number").alias("page"), F.array_join("p.body", "").alias("text"), F.transform("p", lambda x: F.length(x.body)).alias("sizes"))
    docs = with_sentence_chunks(docs, F.col("text"), size, overlap, least, limit)
    found = docs.select(KEY, "page", F.arrays_zip("chunk", _page_places("text", "chunk", "sizes").alias("place")).alias("z"))
    each = _exploded(found, "z", "chunk_index", "c")
    page = lambda i: F.get("page", F.col("c.place")[i])
    return each.select(KEY, "chunk_index", F.col("c.chunk").alias("chunk_text"), page(0).alias("start_page"), page(1).alias("end_page"), nonspace_length(F.col("c.chunk")).alias("character_count"))


def drop_page_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Paragraphs outside each document's excluded pages; a range that would drop them all is ignored."""
    joined = rows.join(ranges.select(KEY, "low", "high"), KEY, "left")
    inside = F.coalesce((F.col("low") <= F.col("high")) & F.col("page_number").between(F.col("low"), F.col("high")), F.lit(False))
    marked = joined.withColumn("__inside", inside).withColumn("__left", F.sum((~F.col("__inside")).cast("int")).over(Window.partitionBy(KEY)))
    return marked.filter("not __inside or __left = 0").drop("low", "high", "__inside", "__left")
