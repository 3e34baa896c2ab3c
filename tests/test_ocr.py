"""OCR queries on long documents, and that no row of a line holds its document's text."""

import pytest

from palimpsest.plans import upkeep_queries  # noqa: F401, registers the queries
from palimpsest.plans.queries import QUERIES

TEXTS = {1: "\n".join(f" {'é' * (i % 7)}line {i}" if i % 11 else "" for i in range(700)), 2: "", 3: "one\n\n", 4: None, 5: " \nb"}


@pytest.fixture(scope="module")
def long_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in TEXTS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def lines():
    """(document_id, place, line) of all texts."""
    return [(str(k), i, x) for k, t in TEXTS.items() if t is not None for i, x in enumerate(t.split("\n"))]


def shuffled(plan):
    """Bytes that the exchanges of a plan that has run were given."""
    if "QueryStage" in plan.nodeName():
        return shuffled(plan.plan())
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return shuffled(plan.executedPlan())
    below = plan.children()
    return (plan.metrics().apply("dataSize").value() if plan.nodeName() == "Exchange" else 0) + sum(shuffled(below.apply(i)) for i in range(below.size()))


def collected(name, spark, folder):
    """The query's rows, and the bytes that it shuffled."""
    frame = QUERIES[name](spark, folder)
    return frame.collect(), shuffled(frame._jdf.queryExecution().executedPlan())


def test_paragraphs_of_long_documents(spark, long_dir):
    found, size = collected("ocr_paragraphs", spark, long_dir)
    assert 0 < size < 20 * len(TEXTS[1])  # paragraphs go by document to be numbered, each with its own text
    want, count = [], {}
    for k, i, x in lines():
        if x.strip(" "):
            want.append((k, count.get(k, 0), 1 + i // 5, x.strip(" ")))
            count[k] = count.get(k, 0) + 1
    assert sorted((r.document_id, r.idx, r.page_number, r.text) for r in found) == sorted(want)


def test_field_pairs_of_long_documents(spark, long_dir):
    found, size = collected("ocr_field_pairs", spark, long_dir)
    assert size == 0
    by = {(k, i): x for k, i, x in lines()}
    want = [(k, "pair", x.strip(" "), by[k, i + 1].strip(" "), "text", 1 + i // 5) for (k, i), x in by.items() if i % 5 == 0 and x and by.get((k, i + 1))]
    assert sorted((r.document_id, r.kind, r.name, r.value, r.type, r.page_number) for r in found) == sorted(want)


def test_tables_of_long_documents(spark, long_dir):
    found, size = collected("ocr_tables", spark, long_dir)
    assert size == 0
    want = {}
    for k, i, x in lines():
        header, n = want.get((k, 1 + i // 5), (None, 0))
        want[k, 1 + i // 5] = (x.strip(" ") or None, 0) if i % 5 == 0 else (header, n + bool(x.strip(" ")))
    assert {(r.document_id, r.page_number): (r.header, r.n_rows) for r in found} == {k: v for k, v in want.items() if v[1]}
