"""Stores by bucket, the stored index, the build job and streams with state, on small rows and folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import text as T
from palimpsest.operators import build, index, listing, matching, search, sketches, store
from palimpsest.plans import bindings as B
from palimpsest.sources import files
from palimpsest.streaming import feeds


def listed(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def bucket_store(spark, path, buckets=8):
    return store.BucketStore(spark, f"{path}/t", StructType.fromDDL("document_id long, chunk_index int, v string, version long"), "document_id", buckets)


def test_store_rewrites_touched_buckets_alone(spark, tmp_path):
    s = bucket_store(spark, tmp_path)
    rows = lambda rows: spark.createDataFrame(rows, s.schema)
    assert s.read().count() == 0 and s.delete(rows([])) == []
    first = [(d, c, f"{d}.{c}", 1) for d in range(40) for c in range(3)]
    s.upsert(rows(first), ["document_id", "chunk_index"], "version")
    assert sorted(tuple(r) for r in s.read().collect()) == first
    before = listed(s.path)
    change = rows([(7, 1, "new", 2), (7, 3, "more", 2), (8, 0, "late", 0)])
    touched = s.upsert(change, ["document_id", "chunk_index"], "version")
    after = listed(s.path)
    assert len(touched) == 1 and {f.split("/")[0] for f in before ^ after} == {f"bucket={touched[0]}"}
    want = sorted([r for r in first if r[:2] != (7, 1)] + [(7, 1, "new", 2), (7, 3, "more", 2)])
    assert sorted(tuple(r) for r in s.read().collect()) == want
    assert s.upsert(change, ["document_id", "chunk_index"], "version") == [] and listed(s.path) == after  # a rerun writes nothing
    assert sorted(tuple(r) for r in s.read([7, 99]).collect()) == [r for r in want if r[0] == 7]
    plan = s.read([7])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_store_replaces_and_deletes_documents(spark, tmp_path):
    s = bucket_store(spark, tmp_path, 4)
    other = store.BucketStore(spark, f"{tmp_path}/u", StructType.fromDDL("id long, m map<string,string>"), "id", 4)
    rows = lambda rows: spark.createDataFrame(rows, s.schema)
    s.replace(rows([(d, c, "a", 1) for d in range(10) for c in range(4)]))
    other.replace(spark.createDataFrame([(d, {"k": str(d)}) for d in range(10)], other.schema))
    s.replace(rows([(3, 0, "b", 2)]), spark.createDataFrame([(3,), (4,)], "document_id long"))
    assert sorted((r.document_id, r.v) for r in s.read().filter("document_id in (3, 4)").collect()) == [(3, "b")]
    gone = spark.createDataFrame([(d,) for d in range(9)], "document_id long")
    assert store.delete_from_stores([s, other], gone)[s.path]
    assert {r.document_id for r in s.read().collect()} == {9} and {r.id for r in other.read().collect()} == {9}
    assert len({f.split("/")[0] for f in listed(s.path)}) == 1  # emptied buckets are gone
    assert store.delete_from_stores([s, other], gone) == {s.path: [], other.path: []}


def test_stored_index(spark, sf_dir, tmp_path, monkeypatch):
    vectors = B.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    odd = spark.createDataFrame([(10_000, None), (10_001, [float("nan")] * 64), (10_002, [])], "vec_id long, vector array<float>")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    built = index.InvertedFile.build(vectors.unionByName(odd), str(tmp_path), cells=40)
    exact = {(r.query_id, r.vec_id) for r in search.nearest(queries, vectors.unionByName(odd.filter("vec_id < 10002")), 10).collect()}
    monkeypatch.setattr(index, "fit_cells", lambda *a, **k: pytest.fail("an index is opened without a fit"))
    again = index.InvertedFile.open(spark, str(tmp_path))
    assert np.array_equal(again.cells.centres, built.cells.centres) and np.array_equal(again.cells.starts, built.cells.starts)
    found = {(r.query_id, r.vec_id) for r in again.nearest(queries, 10, probes=16).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    everything = {(r.query_id, r.vec_id) for r in again.nearest(queries, 10, probes=1000, block=3).collect()}
    if len(again.cells.upper) <= index.UPPER:
        assert everything == exact
    read = {f for (f,) in again.vectors([1, 5]).select(F.input_file_name()).distinct().collect()}
    assert read and all("/cell=1/" in f or "/cell=5/" in f for f in read)
    assert {r.cell for r in again.vectors([1, 5]).select("cell").distinct().collect()} == {1, 5}


def test_empty_index_and_null_vectors(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, vector array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    assert search.approximate_nearest(one, empty, 3, path=str(tmp_path)).collect() == []
    held = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("inf"), 0.0]), (4, [0.5, 0.5])], "vec_id long, vector array<float>")
    asked = one.unionByName(spark.createDataFrame([(2, None)], "query_id long, vector array<float>"))
    assert [(r.query_id, r.vec_id) for r in search.nearest(asked, held, 5).collect()] == [(1, 1), (1, 4)]
    assert search.nearest(asked.filter("query_id = 2"), held, 5).collect() == []
    chunks = held.select("vec_id", (F.col("vec_id") % 2).alias("document_id"), F.col("vector").alias("embedding"))
    sources = spark.createDataFrame([(0, [1.0, 0.0])], "document_id long, centroid array<float>")
    assert [(r.source_id, r.document_id) for r in search.stage0_candidates(sources, chunks).collect()] == [(0, 1)]


def test_blocks_of_cells(spark, sf_dir):
    chunks = B.chunks(spark, sf_dir)
    want = {(r.s, r.t) for r in chunks.alias("a").join(chunks.alias("b"), F.col("a.document_id") < F.col("b.document_id")).select(F.col("a.document_id").alias("s"), F.col("b.document_id").alias("t"), F.zip_with("a.embedding", "b.embedding", lambda x, y: x.cast("double") * y).alias("p")).filter(F.aggregate("p", F.lit(0.0), lambda s, x: s + x) >= 0.3).distinct().collect()}
    found = {tuple(r) for r in matching.block_by_cells(chunks, 0.3, block=40).collect()}
    assert found <= want and len(found) >= 0.98 * len(want)


def test_build_job(spark, tmp_path, monkeypatch):
    lines = ["The first paragraph of a long enough text that says something of use.", "Page 3", "2.1 A second paragraph, which is as long as the one before it is.", "Another page has its own paragraph, which is left out by its page range."]
    paragraphs = spark.createDataFrame([(1, i, i + 1, t) for i, t in enumerate(lines)], "document_id long, idx int, page_number int, text string")
    pages = spark.createDataFrame([(d, p, f"Document {d} has page {p} with a sentence of words. Then it has another sentence.") for d in (1, 2) for p in (1, 2, 3)] + [(3, 1, "")], "document_id long, page_number int, text string")
    excluded = spark.createDataFrame([(1, 4, 4), (2, 3, 3), (3, 9, 9)], "document_id long, low int, high int")
    job = build.ChunkBuild.at(spark, str(tmp_path), buckets=4)
    assert job.run(pages, paragraphs, excluded) == 3
    chunks = {(r.document_id, r.chunk_index): r for r in job.chunks.read().collect()}
    modes = {r.document_id: r for r in job.centroids.read().collect()}
    assert {d: r.mode for d, r in modes.items()} == {1: "paragraphs", 2: "sentences", 3: None}
    text = " ".join(chunks[k].chunk_text for k in sorted(chunks) if k[0] == 1)
    assert "Page 3" not in text and "left out" not in text and text.count("paragraph") == 2 and "2.1" not in text
    assert "page 3" not in " ".join(r.chunk_text for k, r in chunks.items() if k[0] == 2)
    for d, r in modes.items():
        own = [np.array(c.embedding) for k, c in chunks.items() if k[0] == d]
        assert r.chunk_count == r.effective_chunk_count == len(own)
        if own:
            assert all(np.allclose(v, T.hashed_words(T_prepared(c.chunk_text))) for v, (k, c) in zip(own, [(k, c) for k, c in chunks.items() if k[0] == d]))
            mean = np.mean(own, axis=0)
            assert np.allclose(r.centroid, mean / np.linalg.norm(mean))
    held = listed(str(tmp_path))
    assert job.run(pages, paragraphs, excluded) == 0 and listed(str(tmp_path)) == held
    # a run that ends after the chunks are stored is finished by the next, which finds them as they are
    again = spark.createDataFrame([(2,)], "document_id long")
    monkeypatch.setattr(build, "centroids", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        job.run(pages, paragraphs, excluded, again)
    monkeypatch.undo()
    assert job.run(pages, paragraphs, excluded, again) == 1
    assert {(r.document_id, r.chunk_index) for r in job.chunks.read().collect()} == set(chunks)


def T_prepared(text):  # noqa: N802
    return text.replace("\n", " ").strip(" ")[:3072]


def arriving(spark, folder, parts, schema):
    """Write the parts to a folder one by one; a stream over it that takes a file a batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet"):
                os.utime(os.path.join(folder, f))
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_keeps_a_bounded_table(spark, tmp_path):
    schema = "id long, seq long, event_type string, value string"
    parts = [[(i % 5, 10 * n + i, "DELETE" if (n, i) == (3, 4) else "UPDATE", f"{n}.{i}") for i in range(5)] for n in range(6)]
    stream = arriving(spark, str(tmp_path / "in"), parts[:4], schema)
    state = str(tmp_path / "state")
    drained = lambda: {r.id: r.value for r in feeds.drain_changes(stream(), ["id", "seq", "value"], state).collect()}
    assert drained() == {i: f"3.{i}" for i in range(4)}
    arriving(spark, str(tmp_path / "in"), [[(4, 1, "UPDATE", "late")], *parts[4:]], schema)
    assert drained() == {i: f"5.{i}" for i in range(5)}
    assert len(listed(state + "/table")) <= 8  # buckets, whatever the number of batches


def test_centroid_stream_adds_a_batch_once(spark, tmp_path):
    schema = "document_id long, embedding array<double>"
    stream = arriving(spark, str(tmp_path / "in"), [[(1, [1.0, 2.0]), (2, [1.0, 1.0])], [(1, [3.0, 6.0])], [(1, [5.0, 1.0]), (3, [2.0, 2.0])]], schema)
    sums = lambda rows: {(r.document_id, r.place): (r.total, r.n) for r in rows.collect()}
    want = {(1, 0): (9.0, 3), (1, 1): (9.0, 3), (2, 0): (1.0, 1), (2, 1): (1.0, 1), (3, 0): (2.0, 1), (3, 1): (2.0, 1)}
    found = sums(feeds.drain_centroids(stream(), str(tmp_path / "s")))
    assert found == want
    # stopped after the write and before the commit: the last batch runs again on what it has written
    log = sorted((int(f) for f in os.listdir(tmp_path / "s/log/commits") if f.isdigit()))
    os.remove(tmp_path / f"s/log/commits/{log[-1]}")
    for f in os.listdir(tmp_path / "s/log/commits"):
        if f == f".{log[-1]}.crc":
            os.remove(tmp_path / "s/log/commits" / f)
    held = listed(str(tmp_path / "s/table"))
    assert sums(feeds.drain_centroids(stream(), str(tmp_path / "s"))) == want and listed(str(tmp_path / "s/table")) == held


def test_newest_rows_as_state(spark, tmp_path):
    schema = "id long, at long, seq long, note string"
    rng = np.random.default_rng(2)
    parts = [[(int(i), None if a == 0 else int(a), n * 50 + k, f"n{k}") for k, (i, a) in enumerate(zip(rng.integers(0, 4, 50), rng.integers(0, 30, 50)))] for n in range(4)]
    stream = arriving(spark, str(tmp_path / "in"), parts, schema)
    found = sorted(tuple(r) for r in feeds.drain_retention(stream(), "id", "at", "seq", 10, str(tmp_path / "s")).select("id", "at", "seq", "note").collect())
    rows = [r for p in parts for r in p]
    want = [r for i in range(4) for r in sorted((r for r in rows if r[0] == i), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)[:10]]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert len(listed(str(tmp_path / "s/table"))) <= 8


def test_changed_statuses_alone(spark, tmp_path):
    schema = "id long, seq long, status string, error string"
    first = [(1, 1, "queued", None), (1, 2, "queued", None), (1, 3, "processing", None), (2, 1, "queued", None)]
    stream = arriving(spark, str(tmp_path / "in"), [first], schema)
    log = lambda: sorted(tuple(r) for r in feeds.drain_changed(stream(), "id", "seq", ["status", "error"], str(tmp_path / "s")).select("id", "seq").collect())
    assert log() == [(1, 1), (1, 3), (2, 1)]
    arriving(spark, str(tmp_path / "in"), [[(1, 4, "processing", None), (2, 2, "queued", None)]], schema)
    assert log() == [(1, 1), (1, 3), (2, 1)]  # a snapshot that says the same gives nothing
    arriving(spark, str(tmp_path / "in"), [[(1, 5, "processing", "late"), (2, 3, "done", None), (2, 2, "queued", None)]], schema)
    assert log() == [(1, 1), (1, 3), (1, 5), (2, 1), (2, 3)]


def test_upload_rules(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pdf = b"%PDF-1.7\n" + b" " * 2000
    (folder / "a.pdf").write_bytes(pdf)
    (folder / "b.PDF").write_bytes(b"%PDF-1.7\n/Encrypt 5 0 R /U (x) " + b" " * 2000)
    (folder / "c.pdf").write_bytes(b"%PDF-1.7 /Encrypt 5 0 R " + b" " * 1100 + b"/U (x)")  # the field is beyond the first bytes
    (folder / "d.txt").write_bytes(b"text")
    with open(folder / "e.pdf", "wb") as f:
        f.write(pdf)
        f.truncate(11 << 20)
    with open(folder / "f.pdf", "wb") as f:
        f.write(pdf)
        f.truncate((50 << 20) + 1)
    heads = files.file_heads(spark, str(folder))
    assert {len(r.head) for r in heads.collect()} == {1024, 4}
    found = {r.name: r for r in files.validated(heads).collect()}
    assert {n for n, r in found.items() if r.valid} == {"a.pdf", "c.pdf", "e.pdf"}
    assert found["b.PDF"].issues == [files.ISSUES["encrypted"]] and found["b.PDF"].warnings == []
    assert found["d.txt"].issues == [files.ISSUES["type"], files.ISSUES["small"]] and found["d.txt"].warnings == [files.WARNINGS["extension"]]
    assert found["e.pdf"].warnings == [files.WARNINGS["slow"]] and found["f.pdf"].issues == [files.ISSUES["large"]]
    assert tuple(files.validation_summary(files.validated(heads)).first()) == (6, 3, 3, 3, 4, False)
    rows = [("a", "b", 1, 3, False), ("a", "", 1, 3, False), ("a", None, 1, 3, False), ("a", "b", None, 3, False), ("a", "b", 4, 3, False), ("a", "b", None, None, True), ("a", "b", 0, 3, None)]
    frame = spark.createDataFrame(rows, "x string, y string, low int, high int, skipped boolean")
    assert [r[0] for r in frame.select(files.metadata_complete(["x", "y"], "low", "high", "skipped")).collect()] == [True, False, False, False, False, True, False]
    row = listing.upload_manifest(heads, 7, {"source": "s"}).filter("filename = 'a.pdf'").first()
    assert (row.title, row.content_type, row.metadata) == ("a", "application/pdf", {"source": "s"})


def test_sketches_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2024-01-{d + 1:02d} 10:00:00", f"u{min(int(u), 300)}", float(x)) for d, u, x in zip(rng.integers(0, 14, 20_000), rng.zipf(1.5, 20_000), rng.exponential(100, 20_000))]
    frame = spark.createDataFrame([*rows, (None, "u1", 1.0), ("2024-01-03 10:00:00", None, None)], "logged_at string, user_uuid string, duration_ms double").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    daily = sketches.daily_sketches(frame)
    week = F.date_trunc("week", F.col("day"))
    for r in sketches.period_figures(daily, week).collect():
        own = [x for x in rows if r.period.strftime("%Y-%m-%d") <= x[0][:10] < str(np.datetime64(r.period.strftime("%Y-%m-%d")) + 7)]
        values = np.sort([x[2] for x in own])
        rank = np.searchsorted(values, r.p95_duration, "right") / len(values)
        assert abs(rank - 0.95) < 0.005 and abs(r.mean_duration - values.mean()) < 1e-6
        users = {}
        for x in own:
            users[x[1]] = users.get(x[1], 0) + 1
        assert [t["count"] for t in r.top_users] == sorted(users.values(), reverse=True)[:10] and abs(r.distinct_users - len(users)) <= 0.05 * len(users)
    whole = sketches.period_figures(daily, F.lit("all")).first()
    direct = sketches.period_figures(sketches.daily_sketches(frame.withColumn("logged_at", F.lit("2024-01-01").cast("timestamp")).filter("user_uuid is not null and duration_ms <> 1.0")), F.lit("all")).first()
    assert whole.n == 20_001 and direct.n == 20_000 and whole.top_users[0] == direct.top_users[0]


def test_top_users_among_very_many(spark):
    """More users than any sketch tracks, each about as often as the others."""
    rows = spark.range(60_000).select(F.expr("date_add(date'2024-01-01', cast(id % 3 as int)) + interval 1 hour").cast("timestamp").alias("logged_at"), F.expr("concat('u', id % 30000)").alias("user_uuid"), F.lit(1.0).alias("duration_ms"))
    more = rows.limit(1).withColumn("user_uuid", F.lit("u7"))
    found = sketches.period_figures(sketches.daily_sketches(rows.unionByName(more)), F.lit("all")).first()
    assert (found.n, tuple(found.top_users[0]), len(found.top_users), found.top_users[1]["count"]) == (60_001, ("u7", 3), 10, 2)
    empty = sketches.period_figures(sketches.daily_sketches(more.withColumn("user_uuid", F.lit(None).cast("string"))), F.lit("all")).first()
    assert empty.n == 1 and empty.top_users == []


@pytest.mark.parametrize("space", ["\u00a0", "\u2009", "\u3000", "\ufeff"])
def test_spaces_of_any_kind(spark, space):
    """OCR text is full of spaces that Java's \\s doesn't know."""
    texts = [f"1.{space}The text here", f"2.1{space}Scope of it", f"Yes{space}No", f"Page{space}3 ", f"{space}in{space}excess{space}of{space}", f"a{space}b", f"(iv){space}{space}words"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").sort("i")
    t = F.col("t")
    rows = frame.select(T.strip_prefixes(t).alias("s"), T.is_form_option(t).alias("o"), T.is_noise(t).alias("n"), T.is_incomplete(t, F.lit("x")).alias("c"), T.nonspace_length(t).alias("l")).collect()
    assert rows[0].s == "The text here" and rows[1].s == "Scope of it" and rows[2].o and rows[3].n and rows[4].c and rows[5].l == 2 and rows[6].s == "words"


def test_fields_and_pages_of_ocr(spark, tmp_path):
    import json

    from palimpsest.sources import ocr

    at = lambda a, b, **k: {"textAnchor": {"textSegments": [{"startIndex": a, "endIndex": b}]}, **k}
    page = {"formFields": [{"fieldName": at(0, 5, confidence=0.5), "fieldValue": at(5, 9)}, {"fieldName": at(0, 5), "fieldValue": {}}], "keyValuePairs": [{"key": at(9, 12), "value": at(12, 14)}], "blocks": [{}, {}], "tokens": [{}], "detectedLanguages": [{"languageCode": "en"}, {"languageCode": "en"}]}
    rows = [{"document_id": "d", "page_offset": 15, "text": "Name: Ann Key vv", "pages": [page], "entities": [{"type": "birth_date", "mentionText": "1 May"}, {"type": "x"}]}, {"document_id": "e"}]
    (tmp_path / "o.json").write_text("\n".join(map(json.dumps, rows)))
    frame = ocr.read_ocr(spark, str(tmp_path / "o.json"))
    assert sorted(map(str, map(tuple, ocr.structured_fields(frame).collect()))) == sorted(map(str, [("d", "entity", "birth_date", "1 May", "date", 0.0, None), ("d", "form", "Name:", "Ann", "text", 0.5, 16), ("d", "pair", "Ke", "y", "text", 0.0, 16)]))
    assert [tuple(r) for r in ocr.page_profile(frame).collect()] == [("d", 16, 2, 0, 0, 1, 0, 2, 1, 1)]


def test_distance_tests_and_lists(spark):
    from palimpsest.operators import catalog, reports

    frame = spark.createDataFrame([(0.82, 9, 9), (0.82, 9, 1), (0.9, 9, 9), (0.82, None, None)], "score double, i int, p int")
    kept = lambda **o: [r[0] for r in frame.select(matching.near_enough(F.col("score"), F.col("i"), F.col("p"), 0.85, **o)).collect()]
    assert kept() == [True] * 4 and kept(most_index=3) == [False, False, True, True] and kept(most_index=3, most_page=3) == [False, True, True, True] and kept(most_page=3) == [False, True, True, True]
    row = spark.sql("select named_struct('a', array(1, null, 2), 'b', cast(null as array<string>), 'c', array('x')) as s")
    assert row.select(catalog.metadata_lists(F.col("s"), ["a", "b", "c"]).alias("m")).first().m == {"a": ["1", "2"], "c": ["x"]}
    names = spark.createDataFrame([(1, "zebra"), (2, "Émile"), (3, "emu"), (4, "Zoë"), (5, "apple")], "id int, title string").withColumn("created_at", F.lit(0))
    assert [r.id for r in listing.listing_order(names, "name", ascending=True).sort("place").collect()] == [5, 2, 3, 1, 4]
    logs = spark.createDataFrame([(1, "2024-01-01"), (2, None)], "id int, logged_at string").withColumns({"logged_at": F.col("logged_at").cast("timestamp_ntz"), "action_type": F.lit("x"), "resource_type": F.lit("r"), "metadata": F.lit("{}"), "api_endpoint": F.lit("e")})
    assert {(r.id, r.metadata) for r in reports.cleaned_logs(logs, "2024-06-01").collect()} == {(2, "{}"), (None, '{"deleted_count":1}')}
