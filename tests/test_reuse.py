"""What the search for reused text sends through exchanges."""

import random

from palimpsest.operators import chunking, matching
from palimpsest.plans import bindings as B


def shuffled(spark):
    """Bytes that the session's tasks have written for exchanges."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_reuse_sends_few_bytes_a_word(spark):
    """A quarter of the texts are copies: 4 bytes for each of some two anchors in five words, a packed run for each word of a copy, and no text."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(500)) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts + texts[:100])), "document_id long, text string").selectExpr("document_id", "array(text) as texts")
    before = shuffled(spark)
    found = {r.document_id: r.first_document for r in matching.listed_reuse(rows).collect()}
    assert found == {d: d % 300 for d in (*range(100), *range(300, 400))}
    assert shuffled(spark) - before < 16 * 500 * 400


def test_runs_are_packed_without_loss():
    rng = random.Random(5)
    runs = matching.np.zeros(50, matching._RUN)
    for c in matching._RUN.names:
        runs[c] = [rng.randrange(2**32) for _ in range(50)]
    assert (matching._unpacked(matching._packed(runs)) == runs).all()


def test_chunk_lists_are_the_chunk_build(spark):
    """Within a document's row the rules give the chunks that the build gives by paragraphs, hand-made texts among them, and lines go through one exchange."""
    made = ["one of the\ntwo of the\nthree of the\nEnd here it does.", "Is X the investor?\nYes\nNo\nThe next paragraph is here.", "Short one here.\n" * 9, "", None, "12\n7.", " \n".join(["(a) A sentence that goes on. Another one; or a third"] * 40), "é" * 1200 + " tail. And more of it."]
    docs = B.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text").unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    for limit, least in ((1000, 80), (90, 30)):
        want = {}
        for r in sorted(chunking.build_chunks(docs, limit=limit, least=least).collect(), key=lambda r: r.chunk_index):
            want.setdefault(r.document_id, []).append(r.chunk_text)
        found = chunking.chunk_lists(docs, limit=limit, least=least)
        assert {r.document_id: r.texts for r in found.collect() if r.texts} == want and len(want) > 900
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the plan as it ran and as it was made


def test_classes_of_one_first_hash():
    """Two classes that share the first hash stay apart by the second one."""
    np = matching.np
    h, g = np.array([5, 5, 5, 9, 5], "u8"), np.array([1, 2, 1, 1, 1], "u4")
    found = matching._class_ends(h, g, *[np.array([3, 4, 7, 1, 2])] * 2)
    assert [tuple(map(int, x)) for x in zip(*found)] == [(5, 1, 2, 7), (5, 2, 4, 4), (9, 1, 1, 1)]
    assert matching._class_places(found[0], found[1], np.array([5, 5, 9, 9, 7], "u8"), np.array([2, 1, 1, 2, 1], "u4")).tolist() == [1, 0, 2, -1, -1]
