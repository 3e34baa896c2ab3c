"""The operators on vectors and conversations against plain versions on small, awkward tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import covertree, queries, trie, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def awkward_vectors(seed=1, n=260, dim=6):
    """Random vectors with groups of equal ones, nulls, non-finite and short ones, repeated rows and ids."""
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim) / 2], i % 3) for i in range(n)]
    rows += [(n + i, rows[7][1], None) for i in range(90)]  # a hot vector
    rows += [(5000, None, 1), (5001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (5050, [float("nan")] * dim, 1), (5100, [float("inf")] + [0.0] * (dim - 1), 2), (None, rows[3][1], 1)]
    rows += [(6000, [0.5, -0.25], 1), (6050, [], 1), rows[50], rows[50], rows[9]]
    return rows


def entries(rows, scale, shift, dim=6):
    """Ids and whole-number vectors of the rows that take part."""
    good = [(i, v) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [i for i, _ in good], np.array([[int(np.floor(scale * x)) + shift for x in v] + [shift] * (dim - len(v)) for _, v in good])


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in ("id", "x", "v", "cell", "part", "score", "rank", "q", "n", "component", "a.b")})


@pytest.mark.parametrize("sizes", [{}, {"SUBTREE": 40, "LEAF": 8, "FANOUT": 3, "CENTRES": 5}])
def test_top_k(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(covertree, name, value)
    if sizes:
        monkeypatch.setattr(covertree.build, "__defaults__", (8, 3))
    rows = awkward_vectors()
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = sorted(tuple(r) for r in covertree.top_k(df, F.col("vec_id") % 50 == 0, queries_a_pass=5 if sizes else 4096).collect())
    ids, x = entries([r for r in rows if r[0] is not None], 256, 0)
    held = sorted({(i, tuple(map(int, v))) for i, v in zip(ids, x)})
    want = []
    for i, v in held:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if j != i)[:5]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_top_k_small(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert covertree.top_k(empty, F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [0.5, 0.5], 0)], VECTORS)
    assert [tuple(r) for r in covertree.top_k(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    alone = few.filter("vec_id = 0")
    assert covertree.top_k(alone, F.col("vec_id") % 50 == 0).collect() == []
    large = spark.createDataFrame([(0, [3e6, 1.0], 0), (1, [3e6, 0.5], 0)], VECTORS)
    assert [r.score for r in covertree.top_k(large, F.col("vec_id") == 0).collect()] == [768_000_000**2 + 256 * 128]  # beyond a double's whole numbers


def test_cover_tree_prunes():
    """Nodes cover their rows, and far-off nodes are left out without changing the result."""
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((8, 12)) * 400
    points = np.floor(np.concatenate([m + rng.standard_normal((200, 12)) * 5 for m in middles]))
    ids = rng.permutation(len(points))
    order, nodes, radii = covertree.build(points, ids, 64, 8)
    held = points[order]
    for (lo, hi, middle, child, children), r in zip(nodes, radii):
        assert np.sqrt(((held[lo:hi] - held[middle]) ** 2).sum(axis=1)).max() <= r + 1e-9
        if children:
            assert sorted(map(tuple, nodes[child : child + children, :2].tolist()))[0][0] == lo and nodes[child : child + children, 1].max() == hi
    q = points[:40]
    asked = covertree.Queries(ids[:40], q, np.zeros(40, int), np.repeat(np.arange(4), 10), np.stack([q[i : i + 10].mean(axis=0) for i in range(0, 40, 10)]), np.array([np.sqrt(((q[i : i + 10] - q[i : i + 10].mean(axis=0)) ** 2).sum(axis=1)).max() for i in range(0, 40, 10)]), np.full(40, covertree.NONE))
    best = covertree.Best(asked, 5)
    done = covertree.search_block(asked, best, ids[order], held, nodes, radii)
    for i in range(40):
        want = sorted((-int(q[i] @ p), int(j)) for p, j in zip(points, ids) if j != ids[i])[:5]
        assert list(zip(-best.scores[i], best.ids[i])) == want
    assert done < 0.7 * 40 * len(points)


def test_whitening(spark):
    rows = awkward_vectors()
    df = clashing(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = whitening.whiten(df).collect()
    ids, x = entries(rows, 64, 1_000_000)
    n, sums = len(x), x.sum(axis=0)
    off = n * x - sums
    centred = off / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    y = centred @ axes / np.sqrt(values)
    assert len(got) == n * 6 and {r.n for r in got} == {n}
    assert sorted(str((r.vec_id, r.deviation)) for r in got if r.component == 1) == sorted(str((i, int((o**2).sum()))) for i, o in zip(ids, off))
    for c in range(6):
        mine = {(r.vec_id, round(r.whitened, 7) + 0.0) for r in got if r.component == c + 1}
        assert any(mine == {(i, round(s * float(v), 7) + 0.0) for i, v in zip(ids, y[:, c])} for s in (1, -1))
        assert {r.explained for r in got if r.component == c + 1}.pop() == pytest.approx(values[c] / values.sum(), rel=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_small(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)], VECTORS)
    assert whitening.whiten(one).collect() == []  # no spread
    line = spark.createDataFrame([(i, [0.5, float(i)], 0) for i in range(5)], VECTORS)
    got = sorted(tuple(r)[:2] + (abs(round(r.whitened, 9)),) for r in whitening.whiten(line).collect())
    assert got == [(i, 1, round(abs(i - 2) / 2**0.5, 9)) for i in range(5)]


def test_bidiagonalise():
    """V and B hold the product's singular values, also when directions repeat or vanish."""
    rng = np.random.default_rng(2)
    for x in (rng.standard_normal((50, 9)), rng.standard_normal((4, 9)), np.eye(9), np.zeros((5, 9)), rng.standard_normal((40, 9)) * 10.0 ** -np.arange(9)):
        v, b = whitening.bidiagonalise(lambda p, x=x: x.T @ (x @ p), 9)
        assert np.abs(v.T @ v - np.eye(9)).max() < 1e-12
        assert np.abs(np.triu(np.tril(b, 1)) - b).max() == 0
        want = np.zeros(9)
        own = np.linalg.svd(x, compute_uv=False)
        want[: len(own)] = own
        assert np.linalg.svd(b, compute_uv=False) == pytest.approx(want, abs=1e-6 * max(1e-9, want[0]))


TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            tie = hashlib.md5(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest()
            own[c].append((t is not None, t or 0, tie, r or "", x or ""))
    own = {c: [x[3:] for x in sorted(own[c])] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(int(c / 100) * 100, [])[:h] + own[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * len(k[-1][1]) if k else 0
    digest = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted(map(str, ((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), children[k], leaves[k], saved[k], digest(k)) for k in members)))


@pytest.fixture(scope="module")
def turns():
    """Short and long conversations with shared starts, ties, nulls, absent and turnless ones, one far longer than the others."""
    rng = random.Random(3)
    rows = []
    for c in [*range(-5, 40), *range(201, 240), 1000]:
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 20])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ab é", None, ""])))
    rows += [(None, 1, "x", "y"), *rows[5:9]]
    rows += [(c, t, "u", f"long {t % 7}") for c, n in ((300, 150), (301, 140), (302, 150)) for t in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("options", "piece"), [({}, 2048), ({"shard": 50, "segment": 4}, 2), ({"shard": 300, "segment": 7}, 1)])
def test_prefix_trie(spark, turns, monkeypatch, options, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("clash") for c in ("g", "h", "t", "chars", "part", "depth", "a.b")}).repartition(3)
    assert sorted(str(tuple(r)) for r in trie.prefix_trie(df, **options).collect()) == plain_trie(turns)


def test_prefix_trie_small(spark):
    rows = [(5, 1, "u", "a")]
    assert [str(tuple(r)) for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()] == plain_trie(rows)
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []


def test_minimal_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    table = trie.NodeTable(keys)
    assert sorted(table.find(keys)) == list(range(5000))
    assert (table.find(keys + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        trie.MinimalPerfectHash(np.concatenate([keys, keys[:1]]))


@pytest.mark.parametrize("name", ["op11_cover_tree_topk", "op12_prefix_trie"])
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_other_ids_and_names(spark):
    """Text ids, empty ones among them, dotted names, and rows that repeat."""
    from palimpsest.llm import decontamination, packing, quality, sharding, substring, warc

    rows = [("", "some words of a text"), ("b", "other words"), (None, "words"), ("a", None), *[("a", "equal rows")] * 400]
    docs = spark.createDataFrame(rows, "`doc.id` string, `the.text` string")
    names = {"id_col": "doc.id", "text_col": "the.text"}
    packed = packing.pack_documents(docs, **names, length=16, group_bytes=200).collect()
    assert sum(len(r.doc_ids) for r in packed) == 403 and len({r.pack_group for r in packed if "a" in r.doc_ids}) > 10
    assert quality.quality_rules(docs, docs.select("`doc.id`").limit(0), **names).count() == 404
    assert substring.dedup_substrings(docs, **names).count() == 404
    bench = spark.createDataFrame([("x", "equal rows")], "`item.id` string, `a.b` string")
    assert decontamination.find_contamination(docs, bench, **names, item_col="item.id", item_text_cols=("a.b",)).filter("n_hit > 0").count() == 400
    nulls = spark.createDataFrame([(None, f"text {i}") for i in range(300)], "doc_id long, text string")
    found = sharding.assign_shards(nulls, [1.0] * 4).collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(300))
    pages = spark.createDataFrame([("p/1", "u", "<p>"), ("p/2", None, None), (None, "u", "x"), ("p/1", "u", "<q>")], "page_id string, url string, html string")
    records = warc.warc_records(pages, records_a_file=2).collect()
    assert len(records) == 3 and all(b"WARC-Date: " in r.record for r in records) and {r.file for r in records} <= {0, 1}
    assert warc.fixity_audit(warc.warc_records(pages), warc.warc_records(pages)).count() == 0


def test_packed_files(spark, tmp_path):
    """Written files hold the packed rows, and only a run that has ended counts."""
    import os

    from palimpsest.llm import packed_files, packing

    docs = spark.createDataFrame([(i, f"some words of text {i} " * (i % 13)) for i in range(80)], "doc_id long, text string").repartition(4)
    packed = packing.pack_documents(docs, length=64, group_bytes=2000)
    path = str(tmp_path / "out")
    packed_files.write_packed(packed, path, file_bytes=1000)
    want = {(r.pack_group, r.row_no): (r.n_tokens, r.input_ids, r.position_ids, r.cu_seqlens) for r in packed.collect()}

    def held():
        out = {}
        for f in packed_files.read_packed(path):
            for i, key in enumerate(zip(f["pack_group"].tolist(), f["row_no"].tolist())):
                ends = f["cu_seqlens"][f["cu_starts"][i] : f["cu_starts"][i + 1]]
                out[key] = (int(f["n_tokens"][i]), f["input_ids"][i].tolist(), f["position_ids"][i].tolist(), ends.tolist())
        return out

    assert held() == want and len(os.listdir(path)) > 3
    before = sorted(os.listdir(path))
    failing = packed.withColumn("n_tokens", F.when(F.col("row_no") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("n_tokens")))
    with pytest.raises(Exception, match="lost"):
        packed_files.write_packed(failing, path)
    assert sorted(os.listdir(path)) == before and held() == want
    packed_files.write_packed(packed.filter("row_no = 0"), path)
    assert held() == {k: v for k, v in want.items() if k[1] == 0}
    packed_files.write_packed(packed.filter("false"), path)
    assert held() == {} and os.listdir(path) == [packed_files.MANIFEST]
