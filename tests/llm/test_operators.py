"""The operators against plain versions on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, langid, lm, mixing, packing, quality, sharding, simhash, substring, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def awkward(seed=1, n=120):
    """Random texts with copies, near copies, shared passages, long and empty texts, nulls and repeated rows."""
    rng = random.Random(seed)
    vocab = [["alpha", "Beta", "gamma", "x y", "été", "Ωmega", "d#", "|", "12", "naïve!"][i % 10] + "abcdefg"[i % 7] for i in range(60)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 9, 40, 80, 200]))]
        text = "".join(w + rng.choice([" ", "\n", "\t ", "  "]) for w in words)
        if i % 7 == 0:
            text = f"{text} {passage} {text}"
        if i % 11 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 13 == 0 and rows and rows[-1][1]:
            text = rows[-1][1] + " tail"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(text or "")))
    rows += [(500, None, "en", "s1", None), (501, "", None, "s1", 0), (502, "?! 12", "en", None, 5), (503, "word " * 30_000, "en", "s0", 1)]
    rows += [(None, rows[7][1], "en", "s0", 1), rows[3], rows[3], rows[14]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names clash with results and inner names."""
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "tag", "fp", "size", "shard", "score", "n_words", "items")}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(map(tuple, rows))


# SimHash


def plain_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """(id, fingerprint) pairs to the smallest id reachable, by comparing all with all."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    low = defaultdict(list)
    for i, f in pairs:
        if i is not None:
            low[find(f)].append(i)
    return {f: min(low[find(f)], default=None) for f in prints}


def test_simhash_components(docs, rows):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows]
    label = plain_components(pairs)
    want = bag((i, f"{f:016x}", label[f]) for i, f in pairs)
    assert bag(simhash.simhash_components(docs).collect()) == want


@pytest.mark.parametrize("max_group", [20_000, 8, 2])
def test_gray_index_finds_every_link(spark, max_group):
    """Dense clusters of fingerprints, with patterns split again and again."""
    rng = random.Random(5)
    prints = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            f = centre
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    pairs = [(i, f) for i, f in enumerate(sorted(prints))]
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in pairs], "fp long, rep long")
    edges = simhash._links(simhash._under_patterns(nodes, max_group), 3)
    found = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    label = plain_components(pairs)
    assert {i: found.get(i, i) for i, _ in pairs} == {i: label[f] for i, f in pairs}


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    found = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates_leave_one(docs, rows):
    label = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter([i for i in set(label.values()) if i is not None] + [r[0] for r in rows if r[0] is None])


# Substring dedup


def plain_substrings(rows, window):
    first = {}
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        for s in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[s : s + window])
            first[key] = min(i, first.get(key, i))
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[s : s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        yield i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize("window, gram", [(50, 12), (6, 3), (4, 4)])
def test_substrings(spark, rows, docs, window, gram):
    small = [r for r in rows if r[0] != 503] if window < 50 else rows
    frame = docs.filter("doc_id is null or doc_id <> 503") if window < 50 else docs
    found = substring.dedup_substrings(frame, window=window, gram=gram)
    assert bag(r[:4] for r in found.collect()) == bag(plain_substrings(small, window))


def test_substrings_with_hot_anchors(spark, docs, monkeypatch):
    """Dealing every anchor to several tasks doesn't change the result."""
    monkeypatch.setattr(substring, "HOT_ROWS", 1)
    monkeypatch.setattr(substring, "HOT_KEYS", 10**9)
    passage = " ".join(f"p{i}" for i in range(70))
    small = [(i, passage if i % 3 == 0 else f"start{i} {passage} end{i % 5}") for i in range(40)] + [(7, passage), (None, passage), (99, None)]
    frame = spark.createDataFrame(small, "doc_id long, text string")
    assert bag(r[:4] for r in substring.dedup_substrings(frame).collect()) == bag(plain_substrings(small, 50))


def test_substring_spans_rebuild_the_text(docs):
    for r in substring.dedup_substrings(docs.select("doc_id", "text"), with_text=True).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = WORD.findall(r.text or "")
        for s in reversed(r.spans):
            del words[s["first"] : s["first"] + s["words"]]
        assert r.kept_text == " ".join(words)


# Decontamination


def plain_contamination(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall(lower(text or ""))
        size = min(window, len(words))
        for s in range(len(words) - size + 1) if words and item is not None else ():
            windows[tuple(words[s : s + size])].add(str(item))
    sizes = {len(w) for w in windows}
    for i, text, *_ in rows:
        words = word.findall(lower(text or ""))
        hit, ids = set(), set()
        for size in sizes:
            for s in range(len(words) - size + 1):
                if found := windows.get(tuple(words[s : s + size])):
                    hit |= set(range(s, s + size))
                    ids |= found
        yield i, len(words), len(hit), tuple(sorted(ids))


def test_contamination(spark, docs, rows):
    texts = [r[1] for r in rows if r[1] and 100 < len(r[1]) < 3000]
    items = [(i, f"Q: {t[20:120]}") for i, t in enumerate(texts[:8])] + [(50, "12"), (51, None), (52, "?!"), (None, "12"), (53, "Beta"), (54, "Beta"), (54, "Beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(docs, bench)
    assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()) == bag(plain_contamination(rows, items))
    clean = bag((r[0],) for r in plain_contamination(rows, items) if not r[2])
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and bag((r.doc_id,) for r in kept.collect()) == clean


def test_contamination_by_a_large_benchmark(spark):
    """Over 2 MB of items: still one automaton and one scan of the documents, and the same result."""
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(50_000)}" for _ in range(120))) for i in range(2800)]
    assert sum(len(t) for _, t in items) > 2 << 20
    rows = [(i, f"some text {' '.join(items[i * 31][1].split()[5 : 5 + i])} and more") for i in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(docs, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert bag((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()) == bag(plain_contamination(rows, items))
    with pytest.raises(ValueError, match="most_bytes"):
        decontamination.find_contamination(docs, bench, most_bytes=1000)


def test_contamination_offsets(spark):
    docs = spark.createDataFrame([(1, "Où est -- The ANSWER, là: été?")], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "the answer là", "x")], "item_id string, q string, a string")
    row = decontamination.find_contamination(docs, bench, item_text_cols=("q", "a")).first()
    raw = b"".join("Où est -- The ANSWER, là: été?".encode()[s.start : s.stop] + b" " for s in row.spans)
    assert raw.decode() == "The ANSWER là "


# Language ID


def test_language_profiles(spark, docs, rows, sf_dir):
    found = langid.identify_languages(docs, keep_cols=("doc_id",)).collect()
    assert bag((r.doc_id,) for r in found) == bag((r[0],) for r in rows)
    for r in found:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {i for i, t in texts.items() if not any(map(str.isalpha, t or ""))}
    corpus = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    held = langid.identify_languages(corpus, keep_cols=("doc_id", "lang")).filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()


def test_language_blocks_agree(spark, docs):
    profiles = spark.createDataFrame([(f"l{i}", [math.sin(i * 7 + j) for j in range(1024)]) for i in range(9)], "lang string, vector array<double>")
    near = lambda frame: bag((r.doc_id, r.lang_pred, round(r.score, 5)) for r in frame.collect())
    assert near(langid.predict_language(docs, profiles)) == near(langid.predict_language(docs, profiles, block=4))


def test_bundle_is_the_sum_of_bound_letters():
    row, gram, count, codes = langid.profile_counts(["Ab!"])
    got = langid.bundles(row, gram, count, codes, 1, 256)[0]
    import numpy as np

    v = {c: langid._random(np.array([ord(c)]), 256)[0].astype(int) for c in " ab"}
    want = np.roll(v[" "], 2) * np.roll(v["a"], 1) * v["b"] + np.roll(v["a"], 2) * np.roll(v["b"], 1) * v[" "]
    assert (got == want).all()


# Quality


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_quality(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 17 == 0)) for i in range(0, 120, 2)] + [(None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    listed = quality.trusted_ids(labels)
    trusted = {i for i in range(0, 120, 2) if i % 3 and i % 17 and i != 4}
    assert {r.doc_id for r in listed.collect()} == trusted
    assert 0 < quality.trusted_ids(labels, most=10).count() < len(trusted)
    found = quality.quality_rules(docs, listed).collect()
    assert bag((r[0], *r[1:7]) for r in found) == bag((r[0], *plain_quality(r[1])) for r in rows)
    mix = lambda x: ((x ^ x >> 32) * 0xD6E8FEB86659FD93) % (1 << 64)
    end = lambda x: (x ^ x >> 32) % quality.BUCKETS

    def features(text):
        one = [xxhash.xxh64_intdigest(w.encode()) for w in WORD.findall(text or "")]
        two = [(a * 0x9E3779B97F4A7C15) % (1 << 64) ^ (b + 0x632BE59BD9B4E019) % (1 << 64) for a, b in zip(one, one[1:])]
        return [end(mix(x)) for x in one + two]

    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(f := features(r[1]))
        if r[0] in trusted:
            target.update(f)
    share = target.total() / raw.total()
    by_id = {r[0]: r[1] for r in rows}
    for r in found:
        f = features(by_id[r.doc_id])
        llr = sum(math.log((target[b] + 4) / (raw[b] * share + 4)) for b in f) / len(f) if f else 0
        assert abs(r.llr - llr) < 1e-9 and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_quality_drops_a_few_toxic_words(spark):
    """Five insults in 250 words of common prose are dropped, labelled or not; clean rows stay."""
    rng = random.Random(5)
    vocab, insults = [f"w{i}" for i in range(400)], ["scum", "moron", "idiot", "clown"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(vocab) for _ in range(250)]
        if toxic := i % 8 == 0:
            for _ in range(5):
                words[rng.randrange(250)] = rng.choice(insults)
        rows.append((i, " ".join(words)))
        if i % 3 == 0:
            labels.append((i, 1, int(toxic)))
    listed = quality.trusted_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), listed).collect()}
    assert {i for i, kept in found.items() if not kept} == {i for i in range(400) if i % 8 == 0}


# LM


@pytest.mark.parametrize("head_size", [200_000, 25])
def test_lm_base_scores(docs, rows, head_size):
    found = lm.score_documents(docs, head_size=head_size).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    toks = lambda t: [*WORD.findall(lower(t or "")), "\n"]
    counts = Counter(w for r in rows if not held(r[0]) for w in toks(r[1]))
    n, v = counts.total(), len(counts)
    want = defaultdict(list)
    for r in rows:
        t = toks(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[r[0]].append((held(r[0]), len(t), sum(counts[w] > 0 for w in t), n, base))
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for r in found:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and abs(r.base_score - w[4]) < 1e-6 * max(1, -w[4]) for w in want[r.doc_id])
        assert math.isfinite(r.score) and r.score < 0


def plain_lm(rows, head_size, n_bits, shares=lm.STEPS):
    """P(token | history) of every text by plain loops and dictionaries; only hashes and tree paths come from the library."""
    import numpy as np

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    toks = lambda t: [w.encode() for w in WORD.findall(lower(t or ""))] + [lm.END]
    hashes = {}
    for r in rows:
        t, found = toks(r[1]), lm.Words([(r[1] or "").encode()])
        assert found.bytes_of(np.arange(len(t))).to_pylist() == t
        hashes.update(zip(t, found.hash.tolist()))
    counts = Counter(w for r in rows if not held(r[0]) for w in toks(r[1]))
    return held, toks, hashes, counts


@pytest.mark.parametrize("head_size", [1000, 25])
def test_lm_scores_against_plain_loops(spark, rows, head_size, monkeypatch):
    """The model of two rounds, trained and applied token by token, and its score of each text; partitions don't matter."""
    import numpy as np

    few = [r for r in rows if r[0] != 503 and len(r[1] or "") < 900]
    frame = spark.createDataFrame(few, SCHEMA)
    held, toks, hashes, counts = plain_lm(few, head_size, 10)
    found = {}
    kept = {}
    start = lm.start_model
    monkeypatch.setattr(lm, "start_model", lambda *a: kept.setdefault("model", start(*a)))
    for parts in (2, 7):
        found[parts] = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in lm.score_documents(frame.repartition(parts), head_size=head_size).collect()}
    for key, score in found[2].items():
        assert abs(score - found[7][key]) < 1e-3 * max(1, -score)
    tree, n_rows = kept["model"].classes, len(kept["model"].weights)
    place = {int(h): i for i, h in enumerate(tree.hashes)}
    code = lambda w: place.get(hashes[w], len(place) + (hashes[w] >> 32))
    if head_size == 1000:
        assert set(place) == {hashes[w] for w in counts}
    by_hash = Counter()
    for w, c in counts.items():
        by_hash[hashes[w]] = c
    weights = defaultdict(float)
    bits = n_rows.bit_length() - 1
    scalar = lambda *parts: int(lm._hash(*parts)[0])

    def symbol(c):
        if c < n_rows // 4:
            return c
        leaf = int(tree.leaves(np.array([c]))[0])
        path = tree.nodes[tree.starts[leaf] : tree.starts[leaf + 1]]
        return (1 << 40) + int(path[min(lm.CLASS_LEVEL, len(path) - 1)])

    def steps(c, one, two):
        leaf = int(tree.leaves(np.array([c]))[0])
        for depth, p in enumerate(range(tree.starts[leaf], tree.starts[leaf + 1])):
            node, slot = int(tree.nodes[p]), int(tree.slots[p])
            cells = []
            for i, (deep, parts) in enumerate(zip(lm.DEPTHS, ((one,), (two,), (one, two)))):
                if depth < deep:
                    mixed = (scalar(i + 1, *(symbol(x) + 2 for x in parts)) ^ scalar(9, node)) * int(lm._MIX) % (1 << 64)
                    cells.append(mixed >> (64 - bits))
            logits = [float(tree.bias[node, j]) + sum(weights[r, j] for r in cells) for j in range(lm.ARITY)]
            top = max(logits)
            total = sum(math.exp(x - top) for x in logits)
            yield [math.exp(x - top) / total for x in logits], slot, cells

    part = {i: r.x for i, r in enumerate(frame.select(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(len(lm.STEPS))).alias("x")).collect())}
    order = [(r.doc_id, r.text) for r in frame.collect()]
    for turn, step in enumerate(lm.STEPS):
        expected, observed = Counter(), Counter()
        for i, (d, text) in enumerate(order):
            if held(d) or part[i] != turn:
                continue
            codes = [code(w) for w in toks(text)]
            for at, c in enumerate(codes):
                for p, slot, cells in steps(c, codes[at - 1] if at else -1, codes[at - 2] if at > 1 else -1):
                    for r in cells:
                        observed[r, slot] += 1
                        for j, x in enumerate(p):
                            expected[r, j] += x
        for cell in set(expected) | set(observed):
            weights[cell] += step * math.log((observed[cell] + lm.CALM) / (expected[cell] + lm.CALM))
    n = counts.total()
    for d, text in order:
        codes, score, base = [code(w) for w in toks(text)], 0.0, 0.0
        for at, (c, w) in enumerate(zip(codes, toks(text))):
            base += math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1)))
            for p, slot, _ in steps(c, codes[at - 1] if at else -1, codes[at - 2] if at > 1 else -1):
                score += math.log10(p[slot])
            if c >= len(place):
                score += math.log10((counts[w] + 0.5) / tree.leaf_mass[(c - len(place)) % len(tree.leaf_mass)])
        got = found[2][d, len(codes), round(base, 6)]
        assert abs(got - score) < 2e-3 * max(1, -score)


def test_lm_model_sums_to_one():
    """The probabilities of all leaves add up to one after any history, before and after training."""
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = np.sort(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    counts = np.sort(rng.zipf(1.4, 700).clip(1, 5000))[::-1]
    tree = lm.class_tree(hashes, counts, rng.integers(1, 90, 256) + 0.5, 2)
    model = lm.Model(tree, np.zeros((1 << 10, lm.ARITY), np.float32))
    every = np.arange(700 + 256)
    assert (tree.leaves(every) == every).all()
    codes = rng.integers(0, 60, 5000)
    one, two = lm.histories(codes, np.array([0, 500]))
    before = lm.log_probabilities(model, codes, one, two).sum()
    expected, observed = np.zeros(model.weights.size, np.float32), np.zeros(model.weights.size, np.int32)
    lm.add_gradient(model, expected, observed, codes, one, two)
    moved = lm.Model(tree, (0.5 * np.log((observed + lm.CALM) / (expected + lm.CALM))).astype(np.float32).reshape(model.weights.shape))
    assert lm.log_probabilities(moved, codes, one, two).sum() > before
    for m in (model, moved):
        for a, b in ((-1, -1), (3, -1), (140, 2), (10**6, 5)):
            p = np.exp(lm.log_probabilities(m, every, np.full(len(every), a), np.full(len(every), b)))
            assert abs(p.sum() - 1) < 1e-4


def test_lm_head_of_equal_counts(spark):
    words = spark.range(5000).select(F.col("id").cast("string").cast("binary").alias("word"), F.xxhash64("id").alias("hash"), F.lit(3).cast("long").alias("n"))
    hashes, counts = lm.most_frequent(words, 1000)
    assert 800 < len(hashes) < 1200 and set(counts) == {3}


def test_lm_beats_its_base_on_held_out_texts(spark, sf_dir):
    corpus = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    held = lm.score_documents(corpus).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# Mixing


def test_mixing_inverts_the_poisson(spark, docs, rows):
    target = spark.createDataFrame([("s0", 1.0), ("s1", 6.0), (None, 2.0), ("absent", 3.0), ("s1", -1.0)], "source string, weight double")
    found = mixing.mix(docs, target, epochs=20.0)
    assert found.columns == [*docs.columns, "copy", "n_copies", "mix_key"]
    sizes = Counter(r[3] for r in rows)
    weight = {"s0": 1.0, "s1": 6.0, None: 2.0}
    want = Counter()
    for r in rows:
        rate = weight[r[3]] / 9 * 20 * len(rows) / sizes[r[3]]
        text = f"42|{'' if r[0] is None else r[0]}|{hashlib.md5((r[1] or '').encode()).hexdigest()}"
        u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)
        k, log_p, cdf = 0, -rate, math.exp(-rate)
        while cdf <= u:
            k += 1
            log_p += math.log(rate) - math.log(k)
            cdf += math.exp(log_p)
        for i in range(k):
            want[(r[0], r[1], i + 1, k)] += 1
    assert Counter((r.doc_id, r.text, r.copy, r.n_copies) for r in found.collect()) == want


def test_mixing_large_rates_and_missing_sources(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id < 2, 'rare', 'rest') as source")
    target = spark.createDataFrame([("rare", 1.0)], "source string, weight double")
    found = mixing.mix(docs, target, epochs=3.0)
    n = found.count()
    assert found.filter("source = 'rest'").count() == 0 and 2600 < n < 3400


# Sharding


def test_sharding(docs, rows):
    found = sharding.assign_shards(docs, [1.0] * 8, keep_cols=("doc_id", "text")).collect()
    assert bag((r.doc_id, r.text) for r in found) == bag((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in found:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_follows_weights(spark):
    keys = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    two = sharding.assign_shards(keys, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    assert {r.shard for r in two} == {0, 1} and abs(next(r["count"] for r in two if r.shard == 1) / 40_000 - 0.75) < 0.02


# WARC


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i * 37 % 4000)) for i in range(300)] + [(5, None, None), (None, "u", "b")], "page_id long, url string, html string")
    left = warc.warc_records(pages)
    held = {(r.file, r.offset): bytes(r.record) for r in left.collect()}
    assert len(held) == 301
    ends = {(f, o + len(x)) for (f, o), x in held.items()}
    assert all(o == 0 or (f, o) in ends for f, o in held)
    keys = sorted(held)
    broken = {k: v for k, v in held.items() if k not in keys[10:12]} | {keys[40]: held[keys[40]][:-1] + b"!", keys[200]: b""} | {(9, 5): b"new"}
    right = spark.createDataFrame([(f, o, bytearray(x)) for (f, o), x in broken.items()], "file long, offset long, record binary")
    for bits in ((16, 4), (8, 1)):
        found = {(r.file, r.offset): r.status for r in warc.fixity_audit(left, right, *bits).collect()}
        assert found == {keys[10]: "missing", keys[11]: "missing", keys[40]: "corrupt", keys[200]: "corrupt", (9, 5): "extra"}
    assert warc.fixity_audit(left, left).count() == 0


# Packing


def test_best_fit_decreasing():
    rng = random.Random(2)
    for limit in (1, 7, 64, 100):
        lengths = [rng.randint(1, limit) for _ in range(300)]
        free, want = [], []
        for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
            fits = [f for f in free if f >= lengths[i]]
            want.append(min(fits, default=limit))
            if fits:
                free.remove(min(fits))
            free.append((min(fits) if fits else limit) - lengths[i])
        rows = packing.best_fit_decreasing(lengths, limit)
        assert sorted(i for r in rows for i in r) == list(range(300))
        assert sorted(limit - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_packing_round_trip(spark, docs, rows):
    import tiktoken

    table = open(packing.TOKENIZER, "rb").read()
    encoding, end, _ = packing.load_encoding(table)
    packed = packing.pack_documents(docs, length=64, group_bytes=20_000).collect()
    assert len({r.pack_group for r in packed}) > 1
    found = defaultdict(list)
    for r in packed:
        assert len(r.input_ids) == len(r.position_ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        for d, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert r.position_ids[a:b] == list(range(b - a))
            found[d].append((start, tuple(r.input_ids[a:b])))
    want = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            ids = [*encoding.encode_ordinary(r[1]), end]
            want[r[0]] += [(at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert isinstance(encoding, tiktoken.Encoding)


# Names, types and bytes


def test_odd_columns_and_bytes(spark):
    """Dotted, clashing and map columns, text ids, and bytes that are no UTF-8: no crash, and columns come back as they were."""
    base = spark.createDataFrame([(i, f"un texte français numéro {i} avec des mots" if i % 2 else f"an english text number {i} with words", "en fr".split()[i % 2]) for i in range(30)], "doc_id long, text string, lang string")
    odd = {c: F.lit("x") for c in ("__text", "__size", "__copy", "__shard", "__in_0", "__lang", "source", "held", "row", "hash")}
    docs = base.withColumns(odd).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    broken = base.select(F.lit(99).cast("long").alias("doc_id"), F.expr("cast(X'61ff6220FF' as string)").alias("text"), "lang").limit(1).withColumns(odd).withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    docs = docs.unionByName(broken)
    bench = spark.createDataFrame([(1, "nothing here")], "item_id long, text string")
    for kept in (simhash.drop_near_duplicates(docs), decontamination.drop_contaminated(docs, bench), langid.drop_unidentified(docs), mixing.mix(docs, copy_cols=False), sharding.assign_shards(docs, [1.0] * 4)):
        assert kept.columns[: len(docs.columns)] == docs.columns and kept.count() > 0
        assert {r["__size"] for r in kept.collect()} == {"x"} and {r["__copy"] for r in kept.collect()} == {"x"}
    assert {r.lang_pred for r in langid.identify_languages(docs.filter("doc_id = 99").unionByName(docs)).filter("doc_id = 99").collect()} <= {"en", "fr"}
    assert substring.dedup_substrings(docs, with_text=True).count() == 31
    assert lm.score_documents(docs).count() == 31
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    packed = packing.pack_documents(named, length=64).collect()
    assert {d for r in packed for d in r.doc_ids} == {f"d{i}" for i in [*range(30), 99]}


def test_near_duplicates_under_one_id(spark):
    """Different texts that share an id both stay; of near copies under one id one stays."""
    a, b = "the quick brown fox jumps over the lazy dog again and again " * 5, "completely other words stand in this second text of the same number here " * 5
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (None, a)], "doc_id long, text string")
    assert bag(simhash.drop_near_duplicates(docs).collect()) == bag([(1, a), (1, b), (None, a)])


def test_language_by_plain_cosine(spark, rows, docs):
    """Prototypes, cosine and arg-max by plain loops over letters."""
    import numpy as np

    vector = lambda c: langid._random(np.array([ord(c)]), langid.DIM)[0].astype(np.int64)
    letters = {}

    def bundle(text):
        flat = re.sub(r" +", " ", "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} "))
        out = np.zeros(langid.DIM, np.int64)
        grams = Counter(flat[i : i + 3] for i in range(len(flat) - 2))
        for g, n in grams.items():
            v = 1
            for place, c in enumerate(g):
                v = v * np.roll(letters.setdefault(c, vector(c)), 2 - place)
            out += n * v
        return out

    sums = defaultdict(lambda: np.zeros(langid.DIM, np.int64))
    for r in rows:
        if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 and r[2] is not None and r[1] is not None:
            sums[r[2]] += bundle(r[1])
    for r in langid.identify_languages(docs, keep_cols=("doc_id", "text")).collect():
        v = bundle(r.text)
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        cosines = {lang: float(v @ s / np.linalg.norm(v) / np.linalg.norm(s)) for lang, s in sums.items()}
        best = max(cosines.values())
        assert abs(cosines[r.lang_pred] - best) < 1e-5 and abs(r.score - max(0, best)) < 1e-5


def test_shards_by_plain_rendezvous(spark, rows, docs):
    """shard and grown_shard by the highest -1 / ln(u) of plain hashes."""

    def best(key, n):
        scores = []
        for i in range(n):
            h = xxhash.xxh64_intdigest(key.encode(), chain(i)) >> 12
            scores.append((-1.0 / math.log((h + 0.5) / (1 << 52)), i))
        return max(scores)[1]

    def chain(i):
        # Spark hashes its columns one after the other, each seeded by the one before; an int as four bytes
        return xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest((sharding.SEED).to_bytes(4, "little"), 42))

    for r in sharding.assign_shards(docs, [1.0] * 8, keep_cols=("doc_id",)).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (best(key, 8), best(key, 9))


def test_trusted_beyond_the_broadcast(spark, docs, monkeypatch):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    listed = quality.trusted_ids(labels)
    small = bag(quality.quality_rules(docs, listed).select("doc_id", F.round("llr", 9)).collect())
    monkeypatch.setattr(quality, "MOST_TRUSTED", 5)
    assert bag(quality.quality_rules(docs, listed).select("doc_id", F.round("llr", 9)).collect()) == small


# Empty tables


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0
    assert langid.drop_unidentified(empty).count() == 0 and decontamination.drop_contaminated(empty, bench).count() == 0
    assert substring.dedup_substrings(empty).count() == 0
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert langid.identify_languages(empty).count() == 0
    assert quality.quality_rules(empty, quality.trusted_ids(spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    assert lm.score_documents(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.assign_shards(empty, [1.0] * 8).count() == 0
    assert packing.pack_documents(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.fixity_audit(warc.warc_records(pages), warc.warc_records(pages)).count() == 0
