"""OCR results as tables: pages, paragraphs and fields of JSON documents, parts merged with a page offset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import field_type

_ANCHOR = "struct<textAnchor:struct<textSegments:array<struct<startIndex:string,endIndex:string>>>,confidence:double>"
_BLOCK = f"array<struct<layout:{_ANCHOR}>>"
_ROWS = f"array<struct<cells:{_BLOCK}>>"
SCHEMA = (
    "document_id string, page_offset int, text string, "
    f"pages array<struct<pageNumber:int,paragraphs:{_BLOCK},lines:{_BLOCK},formFields:array<struct<fieldName:{_ANCHOR},fieldValue:{_ANCHOR}>>,"
    f"keyValuePairs:array<struct<key:{_ANCHOR},value:{_ANCHOR}>>,blocks:{_BLOCK},tokens:{_BLOCK},"
    f"tables:array<struct<headerRows:{_ROWS},bodyRows:{_ROWS}>>,detectedLanguages:array<struct<languageCode:string>>>>, "
    "entities array<struct<type:string,mentionText:string,confidence:double>>"
)

_FIELDS = "array<struct<kind:string,name:string,value:string,type:string,confidence:double,page_number:int>>"


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def anchor_text(anchor: Column, text: Column) -> Column:
    """The first segment's slice of the text; start 0 and end its length by default."""
    segment = F.try_element_at(anchor.textSegments, F.lit(1))
    start = F.coalesce(segment.startIndex.try_cast("int"), F.lit(0))
    end = F.coalesce(segment.endIndex.try_cast("int"), F.length(text))
    return F.when(segment.isNotNull(), F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))).otherwise("")


def page_texts(ocr: DataFrame) -> DataFrame:
    """(document_id, page_number, text): paragraphs, or else lines, of each page; without pages the whole text is page 1."""
    join = lambda blocks: F.array_join(F.transform(blocks, lambda b: anchor_text(b.layout.textAnchor, F.col("text"))), "\n")
    pages = ocr.select("document_id", "page_offset", "text", F.posexplode("pages").alias("i", "p"))
    body = F.coalesce(F.nullif(F.trim(join(F.col("p.paragraphs"))), F.lit("")), F.trim(join(F.col("p.lines"))))
    number = F.coalesce(F.col("p.pageNumber"), F.col("i") + 1) + F.coalesce("page_offset", F.lit(0))
    found = pages.select("document_id", number.alias("page_number"), body.alias("text")).filter("text <> ''")
    bare = ocr.filter(F.coalesce(F.size("pages"), F.lit(0)) <= 0).select("document_id", (F.lit(1) + F.coalesce("page_offset", F.lit(0))).alias("page_number"), F.trim("text").alias("text")).filter("text <> ''")
    return found.unionByName(bare)


def _each(ocr: DataFrame, items: Column, *keep: Column | str) -> DataFrame:
    """(document_id, keep, e) for each element of an array made within a part's row, so that no row of an element holds the part's text.

    The outer form, filtered: for a plain explode Spark pushes down a filter that makes the array once more.
    """
    return ocr.select("document_id", *keep, F.explode_outer(items).alias("e")).filter(F.col("e").isNotNull())


def _of_pages(of_page: Callable[[Column, Column], Column]) -> Column:
    """The elements of the arrays that of_page gives for each page and its place, null ones left out."""
    return F.flatten(F.filter(F.transform("pages", of_page), lambda x: x.isNotNull()))


def ocr_paragraphs(ocr: DataFrame) -> DataFrame:
    """(document_id, idx, page_number, text): paragraphs of all parts of a document, numbered through."""
    offset = F.coalesce("page_offset", F.lit(0))
    text = lambda b: F.trim(anchor_text(b.layout.textAnchor, F.col("text")))
    number = lambda p, i: (F.coalesce(p.pageNumber, i + 1) + offset).alias("page_number")
    blocks = _of_pages(lambda p, i: F.transform(p.paragraphs, lambda b, j: F.struct(i.alias("i"), j.alias("j"), number(p, i), text(b).alias("text"))))
    found = _each(ocr, F.filter(blocks, lambda x: x.text != ""), "page_offset")
    order = Window.partitionBy("document_id").orderBy(offset, "e.i", "e.j")
    return found.select("document_id", (F.row_number().over(order) - 1).alias("idx"), "e.page_number", "e.text")


def merge_parts(ocr: DataFrame) -> DataFrame:
    """(document_id, text, page_count): the parts of a document in page order."""
    parts = F.sort_array(F.collect_list(F.struct("page_offset", "text")))
    return ocr.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x.text), "\n").alias("text"), F.sum(F.greatest(F.size("pages"), F.lit(0))).alias("page_count"))


def fields(ocr: DataFrame) -> DataFrame:
    """(document_id, kind, name, value, confidence): entities and form fields."""
    entities = ocr.select("document_id", F.explode("entities").alias("e")).select("document_id", F.lit("entity").alias("kind"), F.col("e.type").alias("name"), F.col("e.mentionText").alias("value"), F.col("e.confidence").alias("confidence"))
    forms = ocr.select("document_id", "text", F.explode("pages").alias("p")).select("document_id", "text", F.explode("p.formFields").alias("f"))
    named = forms.select("document_id", F.lit("form").alias("kind"), F.trim(anchor_text(F.col("f.fieldName.textAnchor"), F.col("text"))).alias("name"), F.trim(anchor_text(F.col("f.fieldValue.textAnchor"), F.col("text"))).alias("value"), F.col("f.fieldName.confidence").alias("confidence"))
    return entities.unionByName(named)


def tables(ocr: DataFrame) -> DataFrame:
    """(document_id, page_number, table, header_rows, body_rows): trimmed cells, blank cells and rows left out.

    A table without a body row is left out; header_rows is null where none is left.
    """
    number = lambda p, i: (F.coalesce(p.pageNumber, i + 1) + F.coalesce("page_offset", F.lit(0))).alias("page_number")
    filled = lambda cells: F.filter(F.transform(cells, lambda c: F.trim(anchor_text(c.layout.textAnchor, F.col("text")))), lambda x: F.length(x) > 0)
    rows = lambda part: F.filter(F.transform(part, lambda r: filled(r.cells)), lambda r: F.size(r) > 0)
    each = _of_pages(lambda p, i: F.transform(p.tables, lambda t, n: F.struct(number(p, i), n.alias("table"), rows(t.headerRows).alias("header_rows"), rows(t.bodyRows).alias("body_rows"))))
    found = _each(ocr, F.filter(each, lambda t: F.size(t.body_rows) > 0)).select("document_id", "e.*")
    return found.withColumn("header_rows", F.when(F.size("header_rows") > 0, F.col("header_rows")))


def profile(ocr: DataFrame) -> DataFrame:
    """(document_id, text_length, pages, paragraphs, lines, tables, form_fields, languages, entities) over all parts."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    of_pages = lambda name: F.aggregate(F.coalesce(F.col("pages"), F.array().cast(ocr.schema["pages"].dataType)), F.lit(0).cast("bigint"), lambda s, p: s + n(p[name]))
    codes = F.transform(F.flatten(F.filter(F.col("pages.detectedLanguages"), lambda x: x.isNotNull())), lambda x: x.languageCode)
    sized = ocr.select("document_id", F.coalesce(F.length("text"), F.lit(0)).alias("text_length"), n("pages").alias("n_pages"), *(of_pages(c).alias(a) for c, a in (("paragraphs", "paragraphs"), ("lines", "lines"), ("tables", "tables"), ("formFields", "form_fields"))), codes.alias("codes"), n("entities").alias("entities"))
    sums = [F.sum(c).alias(a) for c, a in (("text_length", "text_length"), ("n_pages", "pages"), *((c, c) for c in ("paragraphs", "lines", "tables", "form_fields", "entities")))]
    return sized.groupBy("document_id").agg(*sums, F.size(F.array_distinct(F.flatten(F.collect_list("codes")))).cast("bigint").alias("languages"))


def entity_counts(ocr: DataFrame) -> DataFrame:
    """(document_id, type, n) of the entities."""
    return ocr.select("document_id", F.explode("entities").alias("e")).groupBy("document_id", F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def structured_fields(ocr: DataFrame) -> DataFrame:
    """(document_id, kind, name, value, type, confidence, page_number): entities, form fields and key-value pairs that have a name and a value.

    An entity's type follows from its name and it has no page; the others are text and have their page with the part's offset. Confidence is 0 by default.
    """
    kept = lambda items: F.filter(items, lambda x: (x["name"] != "") & (x.value != ""))
    field = lambda kind, name, value, of, confidence, page: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), of.alias("type"), confidence.alias("confidence"), page.alias("page_number"))
    number = lambda p: F.coalesce(F.nullif(p.pageNumber, F.lit(0)), F.lit(1)) + F.coalesce("page_offset", F.lit(0))
    anchored = lambda a: anchor_text(a.textAnchor, F.col("text"))
    found = [kept(F.transform("entities", lambda e: field("entity", e.type, e.mentionText, field_type(e.type), e.confidence, F.lit(None).cast("int"))))]
    for kind, column, key, value in (("form", "formFields", "fieldName", "fieldValue"), ("pair", "keyValuePairs", "key", "value")):
        of = lambda p, i: F.transform(p[column], lambda f: field(kind, anchored(f[key]), anchored(f[value]), F.lit("text"), f[key].confidence, number(p)))  # noqa: B023, E731
        found.append(F.transform(kept(_of_pages(of)), lambda x: x.withField("name", F.trim(x["name"])).withField("value", F.trim(x.value))))
    all_of = F.flatten(F.filter(F.array(*(x.cast(_FIELDS) for x in found)), lambda x: x.isNotNull()))
    return _each(ocr, all_of).select("document_id", "e.*").fillna(0.0, ["confidence"])


def page_profile(ocr: DataFrame) -> DataFrame:
    """(document_id, page_number, blocks, paragraphs, lines, tokens, tables, form_fields, pairs, languages) of every page."""
    n = lambda c: F.greatest(F.coalesce(F.size(f"p.{c}"), F.lit(0)), F.lit(0)).cast("bigint")
    pages = ocr.select("document_id", F.coalesce("page_offset", F.lit(0)).alias("offset"), F.posexplode("pages").alias("i", "p"))
    number = F.coalesce(F.col("p.pageNumber"), F.col("i") + 1) + F.col("offset")
    names = (("blocks", "blocks"), ("paragraphs", "paragraphs"), ("lines", "lines"), ("tokens", "tokens"), ("tables", "tables"), ("formFields", "form_fields"), ("keyValuePairs", "pairs"))
    codes = F.array_distinct(F.transform(F.col("p.detectedLanguages"), lambda x: x.languageCode))
    return pages.select("document_id", number.alias("page_number"), *(n(c).alias(a) for c, a in names), F.greatest(F.coalesce(F.size(codes), F.lit(0)), F.lit(0)).cast("bigint").alias("languages"))
