"""Listing, filters, facets, pages and keyed-table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that a listing shows as one group; fixed values.
STATUS_GROUPS = {"processing": ("uploading", "queued", "processing")}


def metadata_filter(filters: dict[str, object], ignored: tuple[str, ...] = ("user_id",)) -> Column:
    """Equality for a scalar or a one-element list, IN for a longer list; blanks and nulls are dropped."""
    terms = []
    for name, value in filters.items():
        values = [v.strip() if isinstance(v, str) else v for v in (value if isinstance(value, (list, tuple)) else [value])]
        values = [v for v in values if v is not None and v != ""]
        if values and name not in ignored:
            terms.append(F.col(name) == values[0] if len(values) == 1 else F.col(name).isin(values))
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def exclude_source(source: object, allowed: object = None, id_col: str = "document_id") -> Column:
    """The id filter without the source: != alone, an IN list less the source, nothing if only the source is left."""
    if allowed is None:
        return F.col(id_col) != source
    rest = [x for x in (allowed if isinstance(allowed, (list, tuple)) else [allowed]) if x != source]
    return F.col(id_col).isin(rest) if rest else F.lit(False)


def page_order_anomalies(rows: DataFrame, key: str, order: str, first_pages: int = 11) -> DataFrame:
    """Chunks that start more than a page before the end of the chunk before them, or are stuck on page 1 beyond the first `first_pages`."""
    by = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumns({"prev_end": F.lag("end_page").over(by), "place": F.row_number().over(by)})
    back = F.coalesce(F.col("start_page") < F.col("prev_end") - 1, F.lit(False))
    stuck = (F.col("start_page") == 1) & (F.col("end_page") == 1) & (F.col("place") > first_pages)
    return marked.withColumns({"out_of_order": back, "stuck": F.coalesce(stuck, F.lit(False))}).filter("out_of_order or stuck").drop("place")


def page_overlap(low: int, high: int) -> Column:
    """start <= high and end >= low, or without a range the page in between."""
    ranged = (F.col("start_page") <= high) & (F.col("end_page") >= low)
    return F.coalesce(ranged, F.col("start_page").isNull() & F.col("page_number").between(low, high), F.lit(False))


def overlap_category(low: int, high: int) -> Column:
    start, end = F.col("start_page"), F.col("end_page")
    return F.when((start >= low) & (end <= high), "inside").when(start < low, "starts earlier").otherwise("ends later")


def search_titles(text: str, columns: tuple[str, ...] = ("title", "filename")) -> Column:
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, (F.col(c).ilike(pattern) for c in columns))


def status_in(group: str, column: str = "status") -> Column:
    return F.col(column).isin(*STATUS_GROUPS.get(group, (group,)))


def keyset_page(rows: DataFrame, key: str, limit: int, after: object = None, ascending: bool = True) -> DataFrame:
    """`limit` rows after the cursor with has_more: one top-k over limit + 1 rows, no offset scan."""
    order = F.col(key).asc() if ascending else F.col(key).desc()
    held = rows if after is None else rows.filter(F.col(key) > after if ascending else F.col(key) < after)
    page = held.sort(order).limit(limit + 1)
    numbered = page.withColumns({"rn": F.row_number().over(Window.orderBy(order)), "n": F.count("*").over(Window.partitionBy())})
    return numbered.filter(F.col("rn") <= limit).withColumn("has_more", F.col("n") > limit).drop("rn", "n")


def page_figures(total: int, limit: int, offset: int) -> dict[str, int | bool]:
    return {"total": total, "page": offset // limit + 1, "total_pages": -(-total // limit), "has_next": offset + limit < total, "has_prev": offset > 0}


def nest_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with their children as an array of structs, empty without any."""
    lists = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key by version."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return table.unionByName(changes).withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def replace_of_documents(table: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """All rows of the reprocessed documents replaced."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete_everywhere(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "document_id") -> dict[str, DataFrame]:
    """Each table without the rows of the deleted documents."""
    return {name: frame.join(gone.select(F.col(key).alias(column)), column, "left_anti") for name, (frame, column) in tables.items()}


def patch_metadata(table: DataFrame, patches: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """Map entries of a patch put over those of every row of its document."""
    joined = table.join(patches.select(key, F.col(column).alias("__patch")), key, "left")
    merged = F.map_concat(F.map_filter(column, lambda k, _: ~F.array_contains(F.map_keys("__patch"), k)), F.col("__patch"))
    return joined.withColumn(column, F.when(F.col("__patch").isNull(), F.col(column)).otherwise(merged)).drop("__patch")


def merge_json(old: Column, new: Column) -> Column:
    """Two JSON objects as one map of strings, the right side winning."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    left, right = parse(old), parse(new)
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k)), right))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def reconcile(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, expected, stored, delta) of two count tables, and nothing lost on either side."""
    both = expected.join(stored, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.withColumn("delta", F.col("stored") - F.col("expected"))


def with_first_error(rows: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """`error`: the message of the first rule that fails, null when all hold."""
    return rows.withColumn("error", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules)))


def rename_document(title: Column, path: Column) -> tuple[Column, Column]:
    """filename and path of a document with a new title: title.pdf, in the old folder."""
    name = F.concat(title, F.lit(".pdf"))
    return name, F.concat(F.regexp_extract(path, "^(.*/)?", 0), name)


def flatten_metadata(struct: Column, fields: dict[str, str]) -> Column:
    """A map of strings without nulls: arrays joined as JSON text, structs as JSON text, scalars as they are."""
    def text(name: str, kind: str) -> Column:
        value = struct.getField(name)
        return F.to_json(value) if kind.startswith(("array", "struct", "map")) else value.cast("string")

    pairs = [x for n, k in fields.items() for x in (F.lit(n), text(n, k))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def metadata_lists(struct: Column, names: list[str]) -> Column:
    """A map from the name of each array field that is not null to its elements as strings, nulls among them left out; the counterpart of flatten_metadata."""
    listed = lambda n: F.transform(F.filter(struct.getField(n), lambda x: x.isNotNull()), lambda x: x.cast("string"))
    return F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), listed(n)))), lambda _, v: v.isNotNull())


def record_exclusion(sections: Column, section: Column, kind: str) -> Column:
    """The list of excluded sections with `section` (null: none) in place of those of its kind, at the end; a null list is empty."""
    kept = F.filter(F.coalesce(sections, F.array().cast("array<struct<type:string,start_page:int,end_page:int,page_count:int>>")), lambda s: ~(s.type.eqNullSafe(F.lit(kind))))
    return F.when(section.isNull(), sections).otherwise(F.concat(kept, F.array(section)))


def embedding_skipped(metadata: Column) -> Column:
    """Whether JSON metadata says that the embedding was skipped (the boolean true) or holds an error text."""
    parsed = F.try_parse_json(metadata)
    skipped = F.try_variant_get(parsed, "$.embeddings_skipped", "variant")
    error = F.try_variant_get(parsed, "$.embeddings_error", "variant")
    is_true = (F.schema_of_variant(skipped) == "BOOLEAN") & F.try_variant_get(skipped, "$", "boolean")
    return F.coalesce(is_true, F.lit(False)) | F.coalesce(F.schema_of_variant(error) == "STRING", F.lit(False))


def without_expired(rows: DataFrame, created: str, days: int = 7) -> DataFrame:
    """rows with `expired`: older than `days` before the newest row."""
    newest = rows.agg(F.max(created).alias("__newest"))  # one row
    return rows.crossJoin(F.broadcast(newest)).withColumn("expired", F.coalesce(F.col(created) < F.col("__newest") - F.make_dt_interval(F.lit(days)), F.lit(False))).drop("__newest")
