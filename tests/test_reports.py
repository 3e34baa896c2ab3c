"""Small rows for corpus pairs, records, limits and the metadata of skipped embeddings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalog, matching, upkeep
from palimpsest.plans import bindings as B


def plain_pairs(rows, threshold):
    ids, v = np.array([r.document_id for r in rows]), np.array([r.embedding for r in rows], float)
    a, b = np.nonzero(v @ v.T >= threshold)
    return {(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for x, y in zip(a, b) if ids[x] != ids[y]}


@pytest.mark.parametrize("block", [512, 16])
def test_blocking_finds_the_pairs(spark, monkeypatch, block):
    """As registered; blocks of 16 deal a cell to several."""
    monkeypatch.setattr(matching, "BLOCK", block)
    chunks = B.chunks(spark, "/root/testdata/sf0.01")
    found = {tuple(r) for r in matching.block_by_cells(chunks, 0.25).collect()}
    want = plain_pairs(chunks.select("document_id", "embedding").collect(), 0.25)
    assert found <= want and len(found) >= 0.9 * len(want)


def test_blocking_of_no_rows(spark, sf_dir):
    assert matching.block_by_cells(B.chunks(spark, sf_dir).filter("false"), 0.25).count() == 0


def test_corpus_pairs_are_the_matched_pairs(spark, sf_dir):
    """With each vector in every cell, nothing is missed."""
    chunks, figures = B.chunks(spark, sf_dir), B.document_figures(spark, sf_dir)
    ids = sorted(r.document_id for r in figures.collect())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "source_id long, target_id long")
    options = {"primary": 0.25, "fallback": 0.15, "floor": 400}
    want = matching.adaptive_scores(matching.match_pairs(pairs, chunks, **options), figures)
    got = matching.corpus_pairs(chunks, figures, cells=4, copies=4, **options)
    key = lambda r: (r.source_id, r.target_id, r.matched_source_chars, r.matched_target_chars, r.matched_chunks, round(r.source_score, 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) != []


def test_exclusion_record(spark):
    kind = "array<struct<type:string,start_page:int,end_page:int,page_count:int>>"
    rows = spark.createDataFrame([(1, None, ("a", 1, 2, 2)), (2, [("a", 5, 6, 2), (None, 1, 1, 1)], ("a", 1, 2, 2)), (3, [("a", 5, 6, 2)], None)], f"id int, held {kind}, fresh {kind[6:-1]}")
    found = {r.id: [s.start_page for s in r.x] for r in rows.select("id", catalog.record_exclusion(F.col("held"), F.col("fresh"), "a").alias("x")).collect()}
    assert found == {1: [1], 2: [1, 1], 3: [5]}


def test_embedding_skipped(spark):
    texts = [None, "{", "[]", "{}", '{"embeddings_skipped":false}', '{"embeddings_skipped":true}', '{"embeddings_skipped":"true"}', '{"embeddings_error":""}', '{"embeddings_error":null}', '{"embeddings_error":{}}']
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.i for r in frame.filter(catalog.embedding_skipped(F.col("t"))).sort("i").collect()] == [5, 7]


def test_limits(spark):
    frame = spark.createDataFrame([("fast-track", 1), ("fast-track", 50), ("streaming-batch", 30)], "s string, pages long")
    found = [tuple(r) for r in frame.select(*upkeep.limits(F.col("s"), F.col("pages")).values()).collect()]
    assert found == [(12, 20, 2, 30, 10, 3), (500, 20, 5, 30, 10, 3), (360, 50, 15, 300, 60, 10)]


def test_a_scope_is_searched_once(spark):
    """Requests for the same pages share one search, and each has its results and its place in the figures."""
    from palimpsest.operators import requests

    rows = [(i, i % 2, 0, None if i % 4 < 2 else 1, None if i % 4 < 2 else 2) for i in range(40)]
    asked = spark.createDataFrame(rows, "request_id long, document_id long, user_id long, low int, high int")
    scopes = requests.scopes(asked)
    assert sorted((r.request_id, r.n_requests) for r in scopes.collect()) == [(0, 10), (1, 10), (2, 10), (3, 10)]
    back = requests.by_scope(asked, scopes.withColumnRenamed("request_id", "scope_id")).collect()
    assert len(back) == 40 and all(r.scope_id == r.request_id % 4 for r in back)
