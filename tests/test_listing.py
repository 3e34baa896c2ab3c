"""Small rows for listings, results, sinks and manifests."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import status as S
from palimpsest.operators import catalog, listing


def test_page_requests(spark):
    rows = [(1, 2, 4), (None, None, 4), (1, None, 4), (0, 2, 4), (3, 2, 4), (3, 9, 4), (3, 9, None)]
    frame = spark.createDataFrame(rows, "start_page int, end_page int, page_count int")
    errors = [r.error for r in catalog.with_first_error(frame, listing.page_request_rules()).collect()]
    assert errors == [None, None, "both pages are needed", "pages start at 1", "the first page comes after the last", "beyond the last page", None]


@pytest.mark.parametrize("asked, want", [(None, None), (0, None), (-3, None), (7.9, 7), (1000, 100)])
def test_result_limit(asked, want):
    assert listing.result_limit(asked) == want


def test_ranked_results(spark):
    rows = [("s", "a", 0.9, 0.5, 3, "x"), ("s", "b", 0.9 + 1e-9, 0.5, 5, "x"), ("s", "c", 0.9, 0.8, 1, "z"), ("s", "d", 0.2, 0.9, 9, "y")]
    frame = spark.createDataFrame(rows, "source_id string, target_id string, source_score double, target_score double, created_at int, title string")
    order = lambda **o: [r.target_id for r in listing.ranked_results(frame, **o).sort("place").collect()]
    assert order() == ["c", "b", "a", "d"] and order(by="target_score", most=2) == ["d", "c"] and order(by="created_at", ascending=True) == ["c", "a", "b", "d"]


def test_lookup_names_what_lacks(spark):
    table = spark.createDataFrame([(1, "a")], "id int, v string")
    found = {r.id: (r.v, r.error) for r in listing.lookup(table, spark.createDataFrame([(1,), (2,), (2,)], "id int"), "id").collect()}
    assert found == {1: ("a", None), 2: (None, "not found")}


def test_manifest_and_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.b.pdf").write_bytes(b"12345")
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    row = listing.upload_manifest(files, 7).first()
    assert (row.title, row.filename, row.file_size, row.user_id, row.status) == ("a.b", "a.b.pdf", 5, 7, "uploading")
    for i in range(2):
        listing.append_rows(spark.range(i, i + 1), str(tmp_path / "log"))
    assert {r.id for r in spark.read.parquet(str(tmp_path / "log")).collect()} == {0, 1}


def test_span_without_range(spark):
    frame = spark.createDataFrame([(1, 1, 30), (1, None, 2), (1, 2, 2)], "document_id int, start_page int, end_page int")
    assert {(r.span, r.n) for r in listing.span_distribution(frame).collect()} == {(11, 1), (0, 1), (1, 1)}


def test_status_rules(spark):
    frame = spark.createDataFrame([(10, 40), (3, 10), (1, 100), (1, 0)], "a int, b int")
    pairs = [tuple(r) for r in frame.select(*S.coverage_quality(F.col("a"), F.col("b"))).collect()]
    assert [p[1] for p in pairs] == ["medium", "medium", "low", "low"] and pairs[0][0] == 25
    pages = spark.createDataFrame([("7",), ("3x",), ("x",), (None,)], "p string").select(S.page_of_reference(F.col("p")).alias("p"))
    assert [r.p for r in pages.collect()] == [8, 4, None, None]
