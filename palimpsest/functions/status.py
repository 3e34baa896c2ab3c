"""Status, error and display rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phases of a document by its status and what the message contains, in order; then the phase without a hit.
PROCESSING_PHASES = ((("Document AI", "processing"), "extraction"), (("structured", "fields"), "analysis"), (("embedding", "generating"), "embeddings"), (("index", "Pinecone"), "indexing"))
ERROR_PHASES = ((("upload", "storage"), "upload"), (("Document AI", "processing"), "extraction"), (("embedding",), "embeddings"), (("Pinecone", "index"), "indexing"))
# The message of a status without one.
MESSAGES = {
    "uploading": "Uploading document to secure storage...",
    "queued": "Document uploaded successfully, queued for processing...",
    "processing": "Processing document with AI...",
    "completed": "Document processing completed successfully",
    "error": "Document processing failed",
}
UNKNOWN_MESSAGE = "Processing status unknown"
# What the message of a rate-limit error contains.
RATE_LIMIT = ("rate", "quota", "429", "limit", "throttl")


def _by_marks(message: Column, rules: tuple, rest: str) -> Column:
    out = F.lit(rest)
    for marks, phase in reversed(rules):
        hit = F.lit(False)
        for m in marks:
            hit = hit | message.contains(m)
        out = F.when(hit, phase).otherwise(out)
    return out


def phase(status: Column, message: Column) -> Column:
    """The phase a document is in, or that failed."""
    text = F.coalesce(message, F.lit(""))
    rest = F.when(status == "queued", "upload").when(status == "processing", _by_marks(text, PROCESSING_PHASES, "extraction")).when(status == "completed", "indexing")
    rest = rest.when(status == "error", _by_marks(text, ERROR_PHASES, "extraction")).otherwise("upload")
    return F.when((status == "uploading") | text.contains("upload"), "upload").otherwise(rest)


def phase_progress(status: Column, progress: Column) -> Column:
    """Progress within bounds: up to 100 while uploading, 10 to 95 while processing, else 100 or 0 by status."""
    inside = F.when(status == "uploading", F.least(progress, F.lit(100))).when(status == "processing", F.least(F.greatest(progress, F.lit(10)), F.lit(95)))
    return inside.when(status.isin("queued", "completed"), 100).otherwise(0)


def default_message(status: Column) -> Column:
    out = F.lit(UNKNOWN_MESSAGE)
    for name, text in MESSAGES.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def is_rate_limit(message: Column) -> Column:
    return F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(RATE_LIMIT))


def page_of_reference(page: Column) -> Column:
    """The one-based page of a zero-based reference, number or text that starts with one; null otherwise."""
    return F.regexp_extract(page.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int") + 1


def shown_title(title: Column, filename: Column, key: Column) -> Column:
    """Title, else filename, else id; blank counts as missing."""
    given = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    return F.coalesce(given(title), given(filename), key.cast("string"))


def shown_filename(filename: Column, key: Column) -> Column:
    return F.coalesce(F.when(F.length(F.trim(filename)) > 0, filename), F.concat(key.cast("string"), F.lit(".pdf")))


def coverage_quality(matched: Column, total: Column) -> tuple[Column, Column]:
    """Percentage of chunks matched, and high over 30, medium over 10, else low."""
    coverage = F.try_divide(matched * 100.0, total)
    return coverage, F.when(coverage > 30, "high").when(coverage > 10, "medium").otherwise("low")
