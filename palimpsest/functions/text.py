"""Text rules as Column expressions: lengths, prefixes, noise, form options, sentences, ids."""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns, in the order in which they apply.
PREFIXES = (
    r"\d+\.\d+\.?\s+",
    r"\d+\.[a-z]\.?\s+",
    r"[A-Z]\.\s+",
    r"\d+\.\s+",
    r"\d+\s+",
    r"\d+\n",
    r"[A-Z]\n",
    r"\([ivxIVX]+\)\s*",
    r"\([A-Za-z]\)\s*",
)
NOISE = (
    r"[0-9]+\.\s*",
    r"[0-9]+\s*",
    r"\d+\.\d+\.?\s*",
    r"\d+\.[a-z]\.?\s*",
    r"[A-Z]\.\s*",
    r"[A-Z]\s*",
    r"\([A-Za-z]\)\s*",
    r"\([ivxIVX]+\)\s*",
    r"%\s*",
    r"(?i:Page\s+\d+\s*)",
    r"(?i:N/A\s*)",
    r"_{2,}\s*%?\s*",
)
# The form options, one entry a rule, in order.
OPTIONS = (
    r"(☐|□|\[\s*\])?\s*(Yes|No|N\/A|Not Applicable)(\s+(☐|□|\[\s*\])?\s*(Yes|No|N\/A|Not Applicable))*\s*",
    r"_{3,}\s*%?\s*",
    r"N\/A\s*",
    r"\s*\[\s*\]\s*",
)
# Words and phrases that ask for more text after them, in order.
JOINING_WORDS = "the|a|an|of|in|on|at|to|for|with|from|by|and|or|but|as|within|under|over|about|into|through|during|before|after|between|among"
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|first|second|third|each|every|any|some|all|both|either|neither|such"
JOINING_PHRASES = (
    r"in\s+each\s+of\s+(the|these|those)?\s*(one|two|three|four|five|six|seven|eight|nine|ten)?",
    r"in\s+excess\s+of",
    r"not\s+less\s+than",
    r"not\s+more\s+than",
    r"subject\s+to",
    r"pursuant\s+to",
    r"in\s+accordance\s+with",
    r"as\s+set\s+forth\s+in",
    r"provided\s+that",
    r"except\s+(that|as|for)",
)
#: The ends of all these words and phrases, of seven letters at the most.
ENDINGS = f"({JOINING_WORDS}|{NUMBER_WORDS}|these|those|than|that)\\z"
# Fixed value: how a footnote paragraph starts.
FOOTNOTE = r"^([⁰¹²³⁴⁵⁶⁷⁸⁹]+|[0-9]+)\s+(For purposes|The SEC currently|This)"
# A field's type by what its name contains; the first that fits counts, else text.
FIELD_TYPES = (
    ("date", ("date", "time")),
    ("number", ("number", "amount", "price")),
    ("currency", ("currency", "money", "dollar")),
    ("address", ("address",)),
    ("phone", ("phone", "tel")),
    ("email", ("email", "mail")),
    ("url", ("url", "link", "website")),
    ("boolean", ("checkbox", "bool")),
)
# Texts whose full stops end no sentence, then references of which the same holds, as (pattern, replacement) with \x01 for the stop.
ABBREVIATIONS = ("U.S.", "U.K.", "vs.", "e.g.", "i.e.", "etc.")
REFERENCES = (
    (r"(\d+)(?U:\s+)U\x01S\x01C\.(?U:\s+)§(?U:\s+)(\d+)", "$1 U\x01S\x01C\x01 § $2"),
    (r"Section(?U:\s+)(\d+)\.(\d+)-(\d+)", "Section $1\x01$2-$3"),
    (r"Section(?U:\s+)(\d+)\.(\d+)\(([a-z])\)", "Section $1\x01$2($3)"),
)


#: White space as the rules mean it, no-break spaces and the byte order mark among them; \\s in Java's patterns is ASCII alone.
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


#: SPACE's characters one by one, and a class of three ranges that holds all of them but the plain blank and no letter of Latin, Greek, Cyrillic or Hebrew.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
ODD = r"[\x00-\x1f\x7f-\x{a0}\x{1680}-\x{ffff}]"
#: How a line starts if any of PREFIXES or a lone number or letter is there.
MARKED = r"(?m)^(?:\d|[A-Z][.\n]|\()"


def spaced(pattern: str) -> str:
    """A pattern whose \\s stands for SPACE."""
    return pattern.replace(r"\s", SPACE)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def nonspace_length(text: Column) -> Column:
    """The length without white space; the class of all spaces, which is slow, is taken where others than plain blanks may be."""
    plain = F.length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text.rlike(ODD), F.length(F.regexp_replace(text, spaced(r"\s+"), ""))).otherwise(plain)


def strip_prefixes(text: Column) -> Column:
    """Numbering and list letters at line starts removed, pass by pass; a lone number or letter gives ''.

    Most texts have no such line start, and one look at them takes the place of the passes.
    """
    start = trimmed(text)
    return F.when(start.rlike(MARKED), _stripped(start)).otherwise(start)


def _stripped(start: Column) -> Column:
    lone = start.rlike(spaced(r"^([A-Z]\.|\d+\.?)\s*$"))
    cut = reduce(lambda t, p: F.regexp_replace(F.regexp_replace(t, f"(?m)^{p}", ""), rf"\n{p}", "\n"), map(spaced, PREFIXES), start)
    return F.when(lone, "").otherwise(trimmed(F.regexp_replace(cut, spaced(r"\n\d+\s*\z"), "")))


def is_noise(text: Column) -> Column:
    t = trimmed(text)
    return (F.length(t) < 10) | t.rlike(spaced(f"^({'|'.join(NOISE)})$"))


def is_form_option(text: Column) -> Column:
    return trimmed(text).rlike(spaced(f"(?i)^({'|'.join(OPTIONS)})$"))


def is_incomplete(text: Column, following: Column) -> Column:
    """Without closing punctuation, and ending in a joining word or phrase or followed by a lower-case start."""
    t = trimmed(text)
    words = F.split(F.lower(t), spaced(r"\s+"))
    last = F.array_join(F.slice(words, F.greatest(F.size(words) - 9, F.lit(1)), 10), " ")
    phrase = last.rlike(f"(^|\\s)({JOINING_WORDS}|{NUMBER_WORDS})\\z") | last.rlike(spaced(f"({'|'.join(JOINING_PHRASES)})\\z"))
    goes_on = F.coalesce(trimmed(following).rlike("^[a-z]"), F.lit(False))
    asks = F.when(F.lower(F.right(t, F.lit(8))).rlike(ENDINGS), phrase).otherwise(False)  # few texts are looked at as a whole
    return ~t.rlike(r"[.!?;:)]\z") & (F.length(t) > 0) & (goes_on | asks)


def sentences(text: Column) -> Column:
    """Sentences, cut after .!? before a space with a capital or bracket, a line's end or the text's, and after a semicolon
    before a line's end, a bracket or 'or'. Some abbreviations and references stay whole."""
    held = reduce(lambda t, a: F.replace(t, F.lit(a), F.lit(a.replace(".", "\u0001"))), ABBREVIATIONS, text)
    held = reduce(lambda t, r: F.regexp_replace(t, *r), REFERENCES, held)
    cut = F.split(F.regexp_replace(held, r"([.!?](?= [A-Z(]|\n|\z)|;(?=\n| \s{0,2}\(| or ))", "$1\u0002"), "\u0002")
    return F.filter(F.transform(cut, lambda s: trimmed(F.translate(s, "\u0001", "."))), lambda s: F.length(s) > 0)


def without_footnotes(text: Column) -> Column:
    """The text less the blank-line separated paragraphs that start like a numbered footnote."""
    return F.array_join(F.filter(F.split(text, "\n\n+"), lambda p: ~trimmed(p).rlike(spaced(FOOTNOTE))), "\n\n")


def with_options_joined(items: Column) -> Column:
    """An array of sentences in which form options are appended to the sentence before them."""
    places = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: (i == 0) | ~is_form_option(F.get(items, i)))
    return F.when(F.size(items) > 0, F.transform(F.arrays_zip(places.alias("at"), F.concat(F.slice(places, 2, F.size(places)), F.array(F.size(items))).alias("stop")), lambda x: F.array_join(F.slice(items, x["at"] + 1, x["stop"] - x["at"]), " "))).otherwise(F.array().cast("array<string>"))


def field_type(name: Column) -> Column:
    low, out = F.lower(name), F.lit("text")
    for kind, marks in reversed(FIELD_TYPES):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(m) for m in marks)), kind).otherwise(out)
    return out


def shown_date(stamp: Column) -> Column:
    """A date text as 05 Jan 2024 - 3:07 PM in UTC, or Invalid date."""
    return F.coalesce(F.date_format(F.try_to_timestamp(stamp), "dd MMM yyyy - h:mm a"), F.lit("Invalid date"))


def vector_id(document: Column, index: Column) -> Column:
    return F.concat(document.cast("string"), F.lit("_chunk_"), index.cast("string"))


def document_of_vector(vector: Column) -> Column:
    """The document id before the last _chunk_ or _page_ mark; null without one."""
    chunk, page = F.regexp_extract(vector, "^(.+)_chunk_", 1), F.regexp_extract(vector, "^(.+)_page_", 1)
    return F.coalesce(F.nullif(chunk, F.lit("")), F.nullif(page, F.lit("")))


def page_range(text: Column) -> tuple[Column, Column]:
    """"5" or "12-20" as two integers; what is no number counts as 0."""
    part = lambda i: F.try_element_at(F.split(text, "-"), F.lit(i)).try_cast("int")
    return F.coalesce(part(1), F.lit(0)), F.coalesce(part(2), part(1), F.lit(0))


def embedding_input(text: Column, limit: int = 3072) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "\n", " ")), 1, limit)


def hashed_words(text: str, dim: int = 64) -> list[float]:
    """The default embedding: counts of a text's lower-case words by hash, of unit length; zeros without a word."""
    counts = [0.0] * dim
    for word in re.findall(r"[^\W_]+", text.lower()):
        counts[zlib.crc32(word.encode("utf-8", "surrogatepass")) % dim] += 1
    length = sum(x * x for x in counts) ** 0.5
    return [x / length for x in counts] if length else counts

