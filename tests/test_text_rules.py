"""The short ways through the text rules against the patterns themselves, and the shuffles of the chunk build."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.plans.queries import QUERIES


def test_short_ways_are_the_patterns(spark):
    rng = random.Random(5)
    marks = [*T.BLANKS, "\x00", "\x1c", "\x85", "​", *"  aAbZ1.2(iv)é☐中😀", "\n", "\r\n", "word", "12. "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None, *T.BLANKS]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    trimmed = F.regexp_replace(t, T.spaced(r"^\s+|\s+\z"), "")
    found = rows.select(
        T.trimmed(t).eqNullSafe(trimmed).alias("trimmed"),
        T.nonspace_length(t).eqNullSafe(F.length(F.regexp_replace(t, T.spaced(r"\s+"), ""))).alias("nonspace"),
        T.strip_prefixes(t).eqNullSafe(T._stripped(trimmed)).alias("stripped"),
        (T._stripped(trimmed) != trimmed).alias("changed"),
    ).collect()
    assert all(r.trimmed and r.nonspace and r.stripped for r in found) and sum(bool(r.changed) for r in found) > 200


def test_every_joining_word_and_phrase_asks_for_more(spark):
    phrases = ["in each of these", "in each of the two", "in each of thosenine", "in excess of", "not less than", "not more   than", "subject to", "pursuant to", "in accordance with", "as set forth in", "provided that", "except that", "except as", "except for"]
    texts = [f"It stands {w}".upper() if i % 2 else f"It stands {w}" for i, w in enumerate([*T.JOINING_WORDS.split("|"), *T.NUMBER_WORDS.split("|"), *phrases])]
    rows = spark.createDataFrame([(t, "Next") for t in texts], "t string, n string")
    assert all(r[0] for r in rows.select(T.is_incomplete(F.col("t"), F.col("n"))).collect())
    none = spark.createDataFrame([("It stands here", "Next"), ("It breathe", "Next"), ("", "Next")], "t string, n string")
    assert not any(r[0] for r in none.select(T.is_incomplete(F.col("t"), F.col("n"))).collect())


def test_chunk_build_shuffles_texts_by_document_alone(spark, sf_dir):
    plan = QUERIES["chunk_build"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 3
