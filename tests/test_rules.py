"""Hand-made rows for the rules, folds and feeds that have no SQL twin."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.vectors import centroids
from palimpsest.operators import catalog, chunking, matching, search, upkeep
from palimpsest.plans import bindings as B
from palimpsest.plans.queries import QUERIES, SOURCES
from palimpsest.sources import ocr
from palimpsest.streaming import feeds


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("text, want", [("2.2 Text", "Text"), ("(ii) any company", "any company"), ("Section 2510.3-101 applies", "Section 2510.3-101 applies"), ("7.", ""), ("a\n3.1 b", "a\nb")])
def test_strip_prefixes(spark, text, want):
    assert one(spark, T.strip_prefixes(F.col("t")), t=text) == want


def test_prefixes_of_all_paragraphs(spark):
    """strip_prefixes_whole, paragraph by paragraph, against plain Python: each line of each text as it stands."""
    sf_dir = "/root/testdata/sf0.01"

    def plain(text):
        start = cut = text.strip()
        for p in T.PREFIXES:
            cut = re.sub(f"^{p}", "", cut)
        return "" if re.search(r"^([A-Z]\.|[0-9]+\.?)\s*$", start) else cut.strip()

    want = {(r.doc_id, i): plain(line) for r in B.documents(spark, sf_dir).filter("text is not null").collect() for i, line in enumerate(r.text.split("\n"))}
    found = {(r.document_id, r.idx): r.text for r in QUERIES["strip_prefixes_whole"](spark, sf_dir).collect()}
    print("paragraphs", len(found), "not led by letters", sum(not re.match("[A-Za-z]{3}[a-z ]*[.,]", line) for r in B.documents(spark, sf_dir).filter("text is not null").collect() for line in r.text.split("\n")))
    assert found == want


@pytest.mark.parametrize("text, want", [("Page 3", True), ("2.1", True), ("N/A", True), ("____%", True), ("a long enough line", False), ("page 123456", True)])
def test_noise(spark, text, want):
    assert one(spark, T.is_noise(F.col("t")).cast("string"), t=text) == str(want).lower()


@pytest.mark.parametrize("text, after, want", [("in each of the two", "x", True), ("as provided in the", None, True), ("It ends.", "x", False), ("some words", "lower start", True), ("some words", "Upper start", False)])
def test_incomplete(spark, text, after, want):
    assert one(spark, T.is_incomplete(F.col("t"), F.col("n")).cast("string"), t=text, n=after) == str(want).lower()


def test_text_helpers(spark):
    assert one(spark, T.nonspace_length(F.col("t")).cast("string"), t="a b\n c") == "3"
    assert one(spark, T.document_of_vector(F.col("t")), t="a_chunk_b_chunk_7") == "a_chunk_b"
    assert one(spark, T.is_form_option(F.col("t")).cast("string"), t="Yes No") == "true"
    assert one(spark, F.to_json(T.sentences(F.col("t"))), t="He paid. He left! ok") == json.dumps(["He paid.", "He left! ok"], separators=(",", ":"))
    low, high = T.page_range(F.col("t"))
    assert one(spark, F.concat_ws(",", low, high), t="12-20") == "12,20" and one(spark, F.concat_ws(",", low, high), t="x") == "0,0"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mr. Smith paid.", ["Mr.", "Smith paid."]),
        ("In the U.K. Act and the U.S. Code, e.g. This, it holds. (a) Next", ["In the U.K. Act and the U.S. Code, e.g. This, it holds.", "(a) Next"]),
        ("See 12 U.S.C. § 1813 and Section 2510.3-101 or Section 4.5(a). Then", ["See 12 U.S.C. § 1813 and Section 2510.3-101 or Section 4.5(a).", "Then"]),
        ("It ends.\nhere lower. 5 digits. \"Quoted\"", ["It ends.", "here lower. 5 digits. \"Quoted\""]),
        ("(i) one; (ii) two; or three; and four;\nfive", ["(i) one;", "(ii) two;", "or three; and four;", "five"]),
    ],
)
def test_sentences(spark, text, want):
    assert json.loads(one(spark, F.to_json(T.sentences(F.col("t"))), t=text)) == want


@pytest.mark.parametrize(
    "size, mime, want",
    [
        (1_000_000, "application/pdf", (4, "MICRO", 1, 1)),
        (1_000_000, "application/msword", (10, "SMALL", 2, 2)),
        (30 << 20, "image/png", (1, "LARGE", 5, 3)),
        (10 << 20, "application/pdf", (34, "MEDIUM", 11, 3)),
        (200 << 20, None, (1000, "MASSIVE", 1000, 4)),
    ],
)
def test_sizing(spark, size, mime, want):
    frame = spark.createDataFrame([(size, mime)], "size long, mime string").withColumn("pages", upkeep.page_estimate(F.col("size"), F.col("mime")))
    row = frame.select("pages", *(c.alias(n) for n, c in upkeep.sizing(F.col("size"), F.col("pages")).items())).first()
    assert (row.pages, row.tier, row.minutes, row.priority) == want


def test_job_priority(spark):
    sizes = [2 << 20, (2 << 20) + 1, 10 << 20, 25 << 20, (25 << 20) + 1]
    frame = spark.createDataFrame([(s,) for s in sizes], "size long")
    assert [r[0] for r in frame.sort("size").select(upkeep.job_priority(F.col("size"))).collect()] == [7, 5, 5, 4, 3]


def test_page_order_anomalies(spark):
    rows = [(1, i, p, q) for i, (p, q) in enumerate([(1, 2), (2, 4), (3, 3), (1, 1), *[(1, 1)] * 8])]
    found = catalog.page_order_anomalies(spark.createDataFrame(rows, "document_id int, at int, start_page int, end_page int"), "document_id", "at").sort("at").collect()
    assert [(r["at"], r.out_of_order, r.stuck) for r in found] == [(3, True, False), (11, False, True)]


def test_fallback_without_lengths(spark):
    """Lengths of zero or null don't keep two chunks apart."""
    names = "source_id string, target_id string, a_index int, b_index int, a_page int, b_page int, a_start int, a_end int, b_start int, b_end int, a_chars int, b_chars int, score double"
    frame = spark.createDataFrame([("s", "t", i, i, 1, 1, 1, 1, 1, 1, a, b, 0.9) for i, (a, b) in enumerate([(0, 0), (None, 5), (10, 100), (90, 100)])], names)
    found = matching.fallback_matches(frame, frame.filter("false"))
    assert sorted(r.a_index for r in found.collect()) == [0, 1, 3]


def test_page_overlap(spark):
    rows = [(14, 15, 14), (15, 16, 15), (16, 18, 16), (17, 18, 17), (None, None, 15), (None, None, 17)]
    frame = spark.createDataFrame(rows, "start_page int, end_page int, page_number int").withColumn("x", catalog.page_overlap(15, 16))
    assert [r.x for r in frame.collect()] == [True, True, True, False, True, False]


def test_filters(spark):
    ids = spark.createDataFrame([("s",), ("t",)], "document_id string")
    keep = lambda c: [r[0] for r in ids.filter(c).collect()]
    assert keep(catalog.exclude_source("s")) == ["t"] and keep(catalog.exclude_source("s", ["s", "t"])) == ["t"] and keep(catalog.exclude_source("s", "s")) == []
    named = ids.withColumn("title", F.lit("50%_a")).filter(catalog.search_titles("%_A", ("title",)))
    assert named.count() == 2


@pytest.mark.parametrize("targets, want", [([(0.900, 1), (0.9005, 4), (0.950, 9)], 0.95), ([(0.900, 4), (0.9005, 1)], 0.9)])
def test_best_match_fold(spark, targets, want):
    rows = [("s", "t", 0, i, 5, p, 5, 5, p, p, 10, 10, s) for i, (s, p) in enumerate(targets)]
    names = "source_id string, target_id string, a_index int, b_index int, a_page int, b_page int, a_start int, a_end int, b_start int, b_end int, a_chars int, b_chars int, score double"
    frame = spark.createDataFrame(rows, names)
    assert matching._best(frame, "a", "b", 0.001, None, None).first().score == want


def test_greedy_fallback(spark):
    """Against a plain version, on random pairs."""
    rng = random.Random(4)
    names = "source_id string, target_id string, a_index int, b_index int, a_page int, b_page int, a_start int, a_end int, b_start int, b_end int, a_chars int, b_chars int, score double"
    rows = [("s", "t", a, b, 1, 1, 1, 1, 1, 1, 50 + a, 50 + b, rng.random()) for a in range(12) for b in range(12) if rng.random() < 0.5]
    frame = spark.createDataFrame(rows, names)
    primary = spark.createDataFrame([r for r in rows if r[2] == 3][:1], names).select(*[c for c in frame.columns])
    used_a, used_b = {3}, {next(r for r in rows if r[2] == 3)[3]}
    rank = lambda own, other, r: sorted((x for x in rows if x[own] == r[own]), key=lambda x: (-x[12], x[other])).index(r)
    want = []
    for r in sorted(rows, key=lambda r: (r[2], rank(2, 3, r))):
        if rank(2, 3, r) < 5 and rank(3, 2, r) < 5 and r[2] not in used_a and r[3] not in used_b:
            used_a.add(r[2])
            used_b.add(r[3])
            want.append((r[2], r[3]))
    found = [(r.a_index, r.b_index) for r in matching.fallback_matches(frame, primary).collect()]
    assert sorted(found) == sorted(want) and want


def test_evidence_floor(spark):
    floor = lambda a, b: one(spark, matching.minimum_evidence(F.col("a").cast("int"), F.col("b").cast("int")).cast("string"), a=str(a), b=str(b))
    assert (floor(10_000, 50_000), floor(100_000, 40_000)) == ("1600", "2000")


def test_a_copy_scores_one(spark):
    rows = [(d, i, i + 1, i + 1, i + 1, 900, [1.0 if j == i else 0.0 for j in range(4)]) for d in ("s", "t") for i in range(4)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, page_number int, start_page int, end_page int, character_count int, embedding array<double>")
    totals = chunks.groupBy("document_id").agg(F.sum("character_count").alias("total_characters"))
    found = matching.similarity_search(totals.filter("document_id = 's'"), chunks, totals, spark.createDataFrame([("s", "t")], "source_id string, document_id string")).first()
    assert (found.source_score, found.target_score, found.matched_chunks) == (1.0, 1.0, 4)
    zero = matching.selected_search(totals.filter("document_id = 's'"), spark.createDataFrame([("t",), ("none",)], "document_id string"), chunks, totals).collect()
    assert {r.target_id: r.source_score for r in zero} == {"t": 1.0, "none": 0.0}


def test_rank_fusion(spark):
    lists = [spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int") for ids in (["x", "y"], ["y", "z"])]
    assert {r.id: round(r.score, 9) for r in search.rank_fusion(lists).collect()} == {"x": round(1 / 61, 9), "y": round(1 / 62 + 1 / 61, 9), "z": round(1 / 62, 9)}


def test_nearest_in_blocks_and_recall(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    exact = {tuple(r) for r in search.nearest(queries, vectors, 5).select("query_id", "vec_id").collect()}
    assert exact == {tuple(r) for r in search.nearest(queries, vectors, 5, block=3).select("query_id", "vec_id").collect()}
    near = {tuple(r) for r in search.approximate_nearest(queries, vectors, 5, cells=8, probes=7).select("query_id", "vec_id").collect()}
    assert len(near & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("k,blocks", [(2, 3), (6, 6), (100, 12)])
def test_many_neighbours_take_smaller_blocks(spark, monkeypatch, k, blocks):
    """What a task keeps, k rows for each query of a block, is bounded for any k."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(60)], "vec_id long, vector array<double>")
    queries = vectors.filter("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    rows = lambda found: sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    whole = rows(search.nearest(queries, vectors, k))
    monkeypatch.setattr(search, "KEPT", 12 if k > 2 else 8)
    found = search.nearest(queries, vectors, k)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInPandas") == blocks
    assert rows(found) == whole and len(whole) == 12 * min(k, 60)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_the_registered_index(spark, sf):
    """ivf_neighbours as registered, against brute force."""
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.vec_id) for r in search.nearest(queries, vectors, 10).collect()}
    found = [(r.query_id, r.vec_id) for r in QUERIES["ivf_neighbours"](spark, f"/root/testdata/{sf}").collect()]
    recall = len(set(found) & exact) / len(exact)
    print(f"recall {sf} {recall:.3f}")
    assert len(found) == len(set(found)) == len(exact) and recall >= 0.9


def test_search_candidates_of_both_stages(spark):
    """Against plain loops: stage 1 runs only for a source with more than `keep` candidates, with its own k."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(900, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, i // 2, [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "vec_id long, document_id long, embedding array<double>")
    means = {d: vectors[2 * d : 2 * d + 2].mean(axis=0) for d in (0, 7)}
    sources = spark.createDataFrame([(d, [float(x) for x in m]) for d, m in means.items()], "document_id long, centroid array<double>")
    for top_k, keep in ((600, 250), (30, 250)):
        want = set()
        for d, m in means.items():
            hits = [i for i in np.argsort(-(vectors @ m), kind="stable") if i // 2 != d][: 2 * top_k]
            pool = list(dict.fromkeys(int(i) // 2 for i in hits))[:top_k]
            if len(pool) > keep:
                k = 36 if len(pool) <= 400 else 45
                near = [{int(i) // 2 for i in np.argsort(-(vectors @ vectors[q]), kind="stable")[:k]} for q in (2 * d, 2 * d + 1)]
                pool = sorted((x for x in pool if any(x in n for n in near)), key=lambda x: (-sum(x in n for n in near), x))[:keep]
            want |= {(d, x) for x in pool}
        assert {tuple(r) for r in search.search_candidates(sources, chunks, top_k, keep).collect()} == want


def test_search_is_matched_beyond_the_twentieth_candidate(spark):
    """similarity_search as registered: its best 30 of all documents, where there are fewer than 250."""
    sf_dir = "/root/testdata/sf0.1"
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    everything = figures.filter(SOURCES).select(F.col("document_id").alias("source_id")).crossJoin(figures.select("document_id")).filter("source_id <> document_id")
    want = matching.similarity_search(figures.filter(SOURCES), chunks, figures, everything, min_source=0.0, min_target=0.0, primary=0.25, fallback=0.15, floor=1600)
    found = QUERIES["similarity_search"](spark, sf_dir)
    got = {(r.source_id, r.target_id, r["rank"]) for r in found.collect()}
    print("similarity_search rows", len(got))
    assert got == {(r.source_id, r.target_id, r["rank"]) for r in want.collect()} and len(got) > 80


def test_text_reuse(spark):
    """Passages at another offset, near copies and copies are reuse; a passage repeated in one document isn't."""
    rng = random.Random(12)
    made = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, copied = made(30), made(60)
    near = [*copied[:20], "changed", *copied[21:]]
    texts = {0: made(40) + passage + made(50), 1: made(7) + passage + made(5), 2: copied, 3: near, 4: (own := made(20)) + own, 5: ["few", "words"], 6: ["few", "words"], 7: made(90)}
    rows = [(d, i // 25, " ".join(words[i : i + 25])) for d, words in texts.items() for i in range(0, len(words), 25)]
    found = {r.document_id: (r.reused_characters, r.reused_chunks, r.first_document) for r in matching.text_reuse(spark.createDataFrame(rows, "document_id long, chunk_index int, chunk_text string")).collect()}
    size = lambda words: sum(map(len, words))
    assert found == {
        0: (size(passage), 2, 0), 1: (size(passage), 2, 0), 2: (size(copied) - len(copied[20]), 3, 2), 3: (size(copied) - len(copied[20]), 3, 2), 5: (8, 1, 5), 6: (8, 1, 5),
    }


def test_text_reuse_is_every_shared_run(spark):
    """Against plain sets of runs, over few words, so that anchors and short texts coincide; only runs whose anchor is shared are classed."""
    rng, size = random.Random(4), 8
    texts = {d: [" ".join(rng.choice(["the", "a", "of", "été", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 5))] for d in range(120)}
    for d in range(0, 120, 3):
        words = " ".join(texts[d + 1]).split()
        at = rng.randrange(len(words) + 1)
        texts[d] = [*texts[d], " ".join(words[at : at + rng.randrange(6, 20)])]
    runs = lambda words: {i: tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else {}
    owners = {}
    for d, parts in texts.items():
        for run in runs(" ".join(parts).split()).values():
            owners.setdefault(run, set()).add(d)
    want = {}
    for d, parts in texts.items():
        words = [(w, c) for c, part in enumerate(parts) for w in part.split()]
        hit = {i: owners[run] for i, run in runs([w for w, _ in words]).items() if len(owners[run]) > 1}
        held = {j for i in hit for j in range(i, min(i + size, len(words)))}
        if hit:
            want[d] = (sum(len(words[j][0]) for j in held), len({words[j][1] for j in held}), min(min(o) for o in hit.values()))
    rows = spark.createDataFrame(list(texts.items()), "document_id long, texts array<string>")
    found = matching.listed_reuse(rows, size)
    assert {r.document_id: tuple(r)[1:] for r in found.select("document_id", "reused_characters", "reused_chunks", "first_document").collect()} == want and len(want) > 30


@pytest.mark.parametrize("name, key", [("rrf_by_query", "vec_id"), ("fingerprint_similarity_by_query", "document_id"), ("feature_similarity_by_query", "document_id")])
def test_every_stated_query_has_results(spark, name, key):
    chunks = B.chunks(spark, "/root/testdata/sf0.1")
    want = {r[0] for r in chunks.filter(f"{key} % 50 = 0").select(key).distinct().collect()}
    assert {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.1").select("query_id").distinct().collect()} == want and len(want) > 3


def test_ragged_and_zero_vectors(spark):
    rows = [(1, [3.0, 4.0]), (2, [1.0]), (2, [1.0, 2.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0])]
    found = {r.document_id: r.centroid for r in centroids(spark.createDataFrame(rows, "document_id int, embedding array<double>")).collect()}
    assert found == {1: [0.6, 0.8], 4: [0.0, 0.0]}


def test_chunk_packing(spark):
    """Chunks partition the kept text, in order, and hold at most the limit unless a paragraph is larger."""
    rng = random.Random(8)
    rows = [(d, i, i // 5 + 1, "x" * rng.choice([10, 90, 400, 1200])) for d in range(4) for i in range(rng.randrange(1, 30))]
    frame = spark.createDataFrame(rows, "document_id int, idx int, page_number int, text string")
    found = {}
    for r in chunking.pack(frame, 1000).collect():
        found[(r.document_id, r.chunk_index)] = r.chunk_text
    for d in range(4):
        want, held = [], []
        for _, _, _, t in sorted(r for r in rows if r[0] == d):
            if held and sum(map(len, held)) + len(t) > 1000:
                want.append(" ".join(held))
                held = []
            held.append(t)
        want.append(" ".join(held))
        assert [found[(d, i)] for i in range(len(want))] == want


def paragraph_rows(spark, texts):
    rows = [(1, i, i + 1, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id int, idx int, page_number int, text string")


def test_merge_incomplete(spark):
    """Pairs only: the paragraph that was taken takes none itself."""
    frame = paragraph_rows(spark, ["one of the", "two of the", "three of the", "End here.", "as provided in", "x" * 95])
    found = chunking.merge_incomplete(frame, 100).sort("idx").collect()
    assert [r.text for r in found] == ["one of the two of the", "three of the End here.", "as provided in", "x" * 95]
    assert [(r.start_page, r.end_page) for r in found] == [(1, 2), (3, 4), (None, None), (None, None)]
    assert chunking.merge_incomplete(frame.limit(0)).count() == 0


def plain_tiny(texts, least, limit):
    """[text, page] by the rules as told: a leading collector, then a look back."""
    done, lead = [], None
    for page, t in enumerate(texts, 1):
        room = lambda held: len(held.replace(" ", "")) + len(t) < limit
        if len(t) >= least:
            if lead and room(lead[0]):
                done.append([f"{lead[0]} {t}", page])
            else:
                done += ([lead] if lead else []) + [[t, page]]
            lead = None
        elif lead:
            if room(lead[0]):
                lead[0] += f" {t}"
            else:
                done.append(lead)
                lead = [t, page]
        elif not done:
            lead = [t, page]
        elif room(done[-1][0]):
            done[-1][0] += f" {t}"
        else:
            done.append([t, page])
    return done + ([lead] if lead else [])


def test_merge_tiny(spark):
    rng = random.Random(3)
    texts = {d: ["abcdef"[i % 6] * rng.choice([1, 5, 9, 30, 60]) for i in range(rng.randrange(0, 25))] for d in range(60)}
    texts[99] = ["a" * 9] * 30
    rows = [(d, i, i + 1, t) for d, own in texts.items() for i, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "document_id int, idx int, page_number int, text string")
    found = {}
    for r in chunking.merge_tiny(frame, 10, 64).sort("document_id", "idx").collect():
        found.setdefault(r.document_id, []).append([r.text, r.page_number])
    assert found == {d: plain_tiny(own, 10, 64) for d, own in texts.items() if own}


def test_split_oversized(spark):
    long = "Aaaa bbbb. Cccc dddd! Eeee? Ffff gggg hhhh iiii jjjj. K."
    found = chunking.split_oversized(paragraph_rows(spark, ["Short.", long, "Last."]), 18).sort("idx").collect()
    assert [(r.idx, r.page_number, r.text) for r in found] == [
        (0, 1, "Short."), (1, 2, "Aaaa bbbb."), (2, 2, "Cccc dddd! Eeee?"), (3, 2, "Ffff gggg hhhh iiii jjjj."), (4, 2, "K."), (5, 3, "Last."),
    ]


def test_build_keeps_text(spark):
    """Nothing but noise and prefixes is lost, and no chunk of several paragraphs is over the limit."""
    docs = spark.createDataFrame([(1, "\n".join(f"Paragraph number {'x' * (i % 90)} of many." for i in range(80))), (2, None), (3, "")], "doc_id int, text string")
    found = chunking.build_chunks(docs, limit=300).sort("chunk_index").collect()
    assert {r.document_id for r in found} == {1} and all(r.character_count <= 300 for r in found)
    assert "".join(r.chunk_text.replace(" ", "") for r in found) == docs.first().text.replace("\n", "").replace(" ", "")


def test_paged_chunks(spark):
    pages = spark.createDataFrame([(1, 4, "One a. Two"), (1, 5, "b. Three c."), (1, 6, "Three c."), (2, 7, None)], "document_id int, page_number int, text string")
    found = chunking.paged_chunks(pages, size=1, least=0).sort("chunk_index").collect()
    assert [(r.chunk_text, r.start_page, r.end_page) for r in found] == [("One a.", 4, 4), ("Two\nb.", 4, 5), ("Three c.", 5, 5), ("Three c.", 6, 6)]
    assert [r.chunk_text for r in chunking.paged_chunks(pages, size=2, least=0).sort("chunk_index").collect()] == ["One a. Two\nb.", "Three c. Three c."]


def test_form_options_and_page_exclusion(spark):
    rows = [(1, 0, 1, "Is X the investor?"), (1, 1, 1, "2.1"), (1, 2, 2, "Yes No")]
    frame = spark.createDataFrame(rows, "document_id int, idx int, page_number int, text string")
    assert [r.text for r in chunking.merge_form_options(frame).sort("idx").collect()] == ["Is X the investor? Yes No", "2.1"]
    option = lambda *texts, limit=2000: [r.text for r in chunking.merge_form_options(spark.createDataFrame([(1, i, 1, t) for i, t in enumerate(texts)], frame.schema), limit).sort("idx").collect()]
    assert option("2.1", "Yes No") == ["2.1 Yes No"]
    assert option("Yes", "No") == ["Yes No"]
    assert option("Is it so, please say?", "Not Applicable Not Applicable", "No", limit=22) == ["Is it so, please say? No", "Not Applicable Not Applicable"]
    cut = lambda low, high: chunking.drop_page_range(frame, spark.createDataFrame([(1, low, high)], "document_id int, low int, high int")).count()
    assert (cut(2, 2), cut(1, 2), cut(2, 1)) == (2, 3, 3)


def test_ocr(spark, tmp_path):
    seg = lambda a, b: {"layout": {"textAnchor": {"textSegments": [{"startIndex": a, "endIndex": b}]}}}
    rows = [
        {"document_id": "d", "page_offset": 0, "text": "Hello World", "pages": [{"pageNumber": 1, "paragraphs": [seg(None, "5"), seg("6", None)]}, {"lines": [seg("0", "5")]}]},
        {"document_id": "d", "page_offset": 15, "text": "Later", "pages": [{"paragraphs": [seg("0", "5")]}], "entities": [{"type": "name", "mentionText": "L", "confidence": 0.5}]},
        {"document_id": "e", "text": "Bare"},
    ]
    (tmp_path / "ocr.json").write_text("\n".join(map(json.dumps, rows)))
    frame = ocr.read_ocr(spark, str(tmp_path / "ocr.json"))
    assert sorted(map(tuple, ocr.page_texts(frame).collect())) == [("d", 1, "Hello\nWorld"), ("d", 2, "Hello"), ("d", 16, "Later"), ("e", 1, "Bare")]
    assert [tuple(r) for r in ocr.ocr_paragraphs(frame).sort("idx").collect()] == [("d", 0, 1, "Hello"), ("d", 1, 1, "World"), ("d", 2, 16, "Later")]
    assert {r.document_id: (r.text, r.page_count) for r in ocr.merge_parts(frame).collect()} == {"d": ("Hello World\nLater", 3), "e": ("Bare", 0)}
    assert ocr.fields(frame).filter("kind = 'entity'").first().value == "L"


def test_change_feed_and_stream(spark, tmp_path):
    table = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "id long, seq long, value string")
    feed = spark.createDataFrame([(1, 1, "x", "UPDATE"), (1, 2, None, "DELETE"), (3, 1, "n", "UPDATE"), (2, 1, "m", "INSERT")], "id long, seq long, value string, event_type string")
    assert {r.id: r.value for r in feeds.apply_changes(table, feed).collect()} == {2: "m", 3: "n"}
    for i, rows in enumerate(([(1, "2024-01-01 00:00:00", "queued"), (2, "2024-01-01 00:00:00", "queued")], [(1, "2024-01-01 01:00:00", "done")])):
        spark.createDataFrame(rows, "document_id long, at string, status string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("document_id long, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = feeds.latest_status(stream, "document_id", "at", ["status"]).writeStream.outputMode("complete").format("memory").queryName("last").start()
    query.processAllAvailable()
    query.stop()
    assert {r.document_id: r.status for r in spark.sql("select * from last").collect()} == {1: "done", 2: "queued"}


def test_incremental_centroid(spark):
    part = lambda rows: feeds.centroid_sums(spark.createDataFrame(rows, "document_id int, embedding array<double>"))
    found = feeds.merge_sums(part([(1, [1.0, 2.0])]), part([(1, [3.0, 6.0])])).selectExpr("place", "total / n as x").sort("place").collect()
    assert [r.x for r in found] == [2.0, 4.0]


def test_maps_and_rules(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "9"})], "document_id int, metadata map<string,string>")
    patch = spark.createDataFrame([(1, {"b": "7", "c": "8"})], "document_id int, metadata map<string,string>")
    assert {r.document_id: r.metadata for r in catalog.patch_metadata(rows, patch, "document_id").collect()} == {1: {"a": "1", "b": "7", "c": "8"}, 2: {"a": "9"}}
    merged = one(spark, catalog.merge_json(F.col("a"), F.col("b")), a='{"x":1,"y":2}', b='{"y":3}')
    assert json.loads(merged) == {"x": "1", "y": "3"}
    name, path = catalog.rename_document(F.col("t"), F.col("p"))
    assert one(spark, F.concat_ws(" ", name, path), t="New", p="a/b/old.pdf") == "New.pdf a/b/New.pdf"


def test_ocr_tables_and_profile(spark, tmp_path):
    at = lambda a, b: {"layout": {"textAnchor": {"textSegments": [{"startIndex": a, "endIndex": b}]}}}
    table = {"headerRows": [{"cells": [at(0, 2)]}], "bodyRows": [{"cells": [at(2, 3), at(3, 5)]}, {"cells": [at(2, 3)]}]}
    page = {"tables": [table, {"headerRows": [{"cells": [at(0, 2)]}]}], "lines": [at(0, 2)], "detectedLanguages": [{"languageCode": "en"}]}
    rows = [{"document_id": "d", "page_offset": 2, "text": "ab cd", "pages": [page], "entities": [{"type": "date"}, {"type": "date"}]}, {"document_id": "e", "text": None}]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, rows)))
    frame = ocr.read_ocr(spark, str(tmp_path / "o.json"))
    assert [tuple(r) for r in ocr.tables(frame).collect()] == [("d", 3, 0, [["ab"]], [["cd"]])]
    found = {r.document_id: r.asDict() for r in ocr.profile(frame).collect()}
    assert found["d"] == {"document_id": "d", "text_length": 5, "pages": 1, "paragraphs": 0, "lines": 1, "tables": 2, "form_fields": 0, "entities": 2, "languages": 1}
    assert found["e"]["pages"] == 0 and found["e"]["text_length"] == 0
    assert [tuple(r) for r in ocr.entity_counts(frame).collect()] == [("d", "date", 2)]


def test_window_bounds():
    """Four sentences a window; more while it is short, fewer where it would grow too long."""
    assert chunking.window_bounds([100] * 6, 4, 1, 0, 2000) == [[0, 4], [3, 3], [5, 1]]
    assert chunking.window_bounds([100] * 6, 2, 0, 450, 2000) == [[0, 5], [5, 1]]
    assert chunking.window_bounds([900, 900, 900], 4, 0, 400, 1000) == [[0, 2], [2, 1]]  # two are taken even over the limit
    assert chunking.window_bounds([10, 10, 995, 10], 4, 0, 400, 1000) == [[0, 2], [2, 2]]
    assert chunking.window_bounds([], 4, 1, 400, 2000) == []


def test_sentence_chunks(spark):
    docs = spark.createDataFrame([(1, "1. Is it so? Yes No ends here. Go.\n\n3 This is a note."), (2, None), (3, "")], "id int, text string")
    found = chunking.sentence_chunks(docs, "id", "text", least=0).collect()
    assert sorted(map(tuple, found)) == [(1, 0, "Is it so? Yes No ends here. Go."), (1, 1, "Go.")]  # the tail repeats the overlap


def test_sentence_rules(spark):
    assert one(spark, F.to_json(T.with_options_joined(F.split("t", ";"))), t="Q one?;Yes;No;Next.;N/A") == json.dumps(["Q one? Yes No", "Next. N/A"], separators=(",", ":"))
    assert one(spark, F.to_json(T.with_options_joined(F.split("t", ";"))), t="Yes") == '["Yes"]'
    assert one(spark, T.without_footnotes(F.col("t")), t="A\n\n12 For purposes of\n\n\nB") == "A\n\nB"
    assert [one(spark, T.field_type(F.col("t")), t=x) for x in ("Start_Time", "phone number", "email", "telex", "other")] == ["date", "number", "email", "phone", "text"]
    assert one(spark, T.shown_date(F.col("t")), t="2024-03-05 15:07:09") == "05 Mar 2024 - 3:07 PM"
    assert one(spark, T.shown_date(F.col("t")), t="no date") == "Invalid date"


def test_drained_streams(spark, tmp_path):
    """Several batches: later ones change and retain as one batch would; what ran once isn't read again."""
    schema = "id long, at long, seq long, status string"
    batches = [[(1, 1, 1, "queued"), (2, 1, 2, "queued")], [(1, 3, 3, "completed"), (1, 2, 4, "late")], [(2, 2, 5, "processing")]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in.parque[t]"))
    statuses = lambda: feeds.drain_updates(feeds.latest_status(stream(), "id", "at", ["status"]), ["id"], str(tmp_path / "a"))
    for _ in range(2):
        assert sorted((r.id, r.at, r.status) for r in statuses().collect()) == [(1, 3, "completed"), (2, 2, "processing")]
    assert [r.id for r in feeds.live_statuses(statuses()).collect()] == [2]
    kept = feeds.drain_retention(stream(), "id", "at", "seq", 2, str(tmp_path / "b"))
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4, 5]
    assert kept.columns == ["id", "at", "seq", "status"]


def test_tops_are_bounded_and_exact():
    """The best of many rows in little memory, whatever the tiles; equal vectors by their ids."""
    import tracemalloc

    from palimpsest.functions.vectors import Tops

    rng = np.random.default_rng(5)
    rows = rng.normal(size=(20_000, 16))
    rows[10_000:] = rows[rng.integers(0, 500, 10_000)]  # many copies
    ids, queries, owners = rng.permutation(20_000), rng.normal(size=(2000, 16)), rng.integers(0, 7, 20_000)
    asking = rng.integers(0, 7, 2000)
    tracemalloc.start()
    tops = Tops(queries, 12, 0.5, asking)
    for lo in range(0, len(rows), 6000):
        tops.add(ids[lo : lo + 6000], rows[lo : lo + 6000], owners[lo : lo + 6000])
    place, found, scores = tops.found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # a block of 4096 rows and all queries with its order took 260 MB
    for q in range(0, 2000, 97):
        exact = np.einsum("ij,j->i", rows, queries[q])
        kept = np.flatnonzero((exact >= 0.5) & (owners != asking[q]))
        want = kept[np.lexsort((ids[kept], -np.round(exact[kept], 9)))][:12]
        assert found[place == q].tolist() == ids[want].tolist()


@pytest.mark.parametrize("k,n_queries,most", [(1200, 873, 90e6), (50, 2048, 29e6)])
def test_a_task_of_nearest_is_bounded(spark, monkeypatch, k, n_queries, most):
    """What one task holds of stage 0 (similarity_search) and of rrf at their whole blocks, and what it gives, in Arrow batches of 10,000 rows."""
    import tracemalloc

    import pandas as pd
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(5)
    matrix, rows = rng.normal(size=(n_queries, 64)), rng.normal(size=(30_000, 64)).astype(np.float32)
    ids = rng.permutation(30_000)
    queries = spark.createDataFrame(list(enumerate(matrix.tolist())), "query_id long, vector array<double>")
    vectors = spark.createDataFrame([], "vec_id long, vector array<float>")
    tasks, through = [], DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, task, *more: tasks.append(task) or through(self, task, *more))
    search.nearest(queries, vectors, k)
    assert len(tasks) == 1
    batches = [pd.DataFrame({"vec_id": ids[lo : lo + 10_000], "vector": list(rows[lo : lo + 10_000])}) for lo in range(0, len(rows), 10_000)]
    tracemalloc.start()
    n, seen = 0, {}
    for part in tasks[0](iter(batches)):
        n += len(part)
        for q in (0, n_queries // 2, n_queries - 1):
            seen.setdefault(q, []).extend(part.vec_id[part.query_id == q])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == k * n_queries and peak < most
    for q, found in seen.items():
        exact = np.einsum("ij,j->i", rows.astype(np.float64), matrix[q])
        assert set(found) == set(ids[np.argsort(-exact)[:k]])


def test_exact_scores_take_small_parts():
    """The first tile of rrf's block, in which each query keeps its 50 best: their vectors are not all taken side by side."""
    import tracemalloc

    from palimpsest.functions.vectors import Tops

    rng = np.random.default_rng(5)
    queries, rows = rng.normal(size=(2048, 64)), rng.normal(size=(2048, 64))
    tracemalloc.start()
    tops = Tops(queries, 50)
    tops.add(np.arange(2048), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14e6
    place, found, _ = tops.found()
    for q in range(0, 2048, 511):
        assert found[place == q].tolist() == np.argsort(-(rows @ queries[q]))[:50].tolist()
