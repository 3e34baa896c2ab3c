"""The pipeline stage by stage, each on what the one before kept, against plain versions."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import langid, mixing
from tests.llm.test_operators import SCHEMA, awkward, lower, plain_components, plain_fingerprint

COLUMNS = SCHEMA_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def windows(text):
    words = ITEM_WORD.findall(lower(text or ""))
    return {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def occurs(window, words):
    return any(tuple(words[i : i + len(window)]) == window for i in range(len(words) - len(window) + 1))


def test_stages(spark, sf_dir, tmp_path):
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for frame in frames[:-1]:
        assert sorted(frame.columns) == sorted(COLUMNS)
        seen.append([tuple(r) for r in frame.select(*COLUMNS).collect()])
    source, spoken, unique, clean, mixed = seen

    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs).collect()}
    assert Counter(spoken) == Counter(r for r in source if found[r[0]][0] != "und" and found[r[0]][1] >= langid.MIN_SCORE)

    prints = [(r[0], plain_fingerprint(r[1])) for r in spoken]
    low = plain_components(prints)
    assert sorted(r[0] for r in unique) == sorted({low[f] for _, f in prints})

    wanted = set().union(*(windows(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()))
    short = [w for w in wanted if len(w) < 10]
    hit = lambda text: bool(windows(text) & wanted) or any(occurs(w, ITEM_WORD.findall(lower(text))) for w in short)
    assert Counter(clean) == Counter(r for r in unique if not hit(r[1]))

    assert Counter(mixed) == Counter(tuple(r) for r in mixing.mix(frames[3]).select(*COLUMNS).collect())
    assert set(mixed) <= set(clean)

    last = frames[-1]
    assert Counter(map(tuple, last.select(*COLUMNS).collect())) == Counter(mixed)
    assert {r.shard for r in last.select("shard").collect()} <= set(range(8))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(mixed)


def test_stages_on_awkward_tables(spark, tmp_path):
    """Nulls in any column, empty, long and repeated texts, repeated rows and clashing columns; then an empty table, through each stage and the run."""
    rows = awkward()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("size", "shard", "fp", "score", "copy", "id")})
    bench = spark.createDataFrame([(1, rows[5][1]), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    for name, frame in (("full", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (stage, function) in enumerate(corpus_pipeline.STAGES):
            function(spark, kept, folder).write.parquet(f"{folder}/{i}")
            out = spark.read.parquet(f"{folder}/{i}")
            if stage != "sharding":
                assert out.columns == docs.columns, stage
                assert stage == "mixing" or out.exceptAll(kept).count() == 0
            kept = out
        assert set(SCHEMA_COLUMNS) <= set(kept.columns) and kept.filter("shard is null or slot is null").count() == 0
        assert (kept.count() > 0) == (name == "full") and corpus_pipeline.run(spark, folder).count() == kept.count()
