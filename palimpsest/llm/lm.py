"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Words are the leaves of a tree of classes, the more frequent the nearer to the root. P(word | history) is the
product, down the word's path, of P(class | history), then P(subclass | class, history) and so on to the word:
each factor is a softmax over the ARITY members of a class, whose logits add the members' log shares and the
rows that the hashed features of the history select in a weight matrix. Every counted word has a path.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, id_remainder, slices, utf8, written

#: The token after a text's last word; no word holds a line feed.
END = b"\n"
#: Members of a class.
ARITY = 16
#: Words with a leaf of their own, whose counts each worker holds; other words share hashed leaves and are joined with their counts.
HEAD = 200_000
#: Training tokens for each hashed leaf, at least; a leaf holds the words whose hash it is.
TOKENS_A_LEAF = 4096
#: Training tokens for each row of the weight matrix, and the logarithms of the fewest and the most rows: each task ships its matrix.
TOKENS_A_ROW = 128
MIN_BITS, MAX_BITS = 10, 16
#: A history word beyond a quarter of the rows goes by its class, its path's node at this level or its lowest one.
CLASS_LEVEL = 1
#: In how many levels of the tree each feature is used: previous word, skipped word, word pair. Below them words go by their shares.
DEPTHS = (3, 2, 1)
#: Step of each round; a round trains on its share of the texts.
STEPS = (0.7, 0.5)
#: Added to the observed and the expected count of a weight.
CALM = 6.0
BATCH = 8192
_BLOCK = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of words that are hashed at a time.
_SPAN = 1 << 16
#: What stands for END in a batch: a byte that UTF-8 lacks.
_MARK = b" \xff "
_IN_WORD = ~np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))


@dataclass(frozen=True)
class Classes:
    """The tree. A code is the place of a word's hash in `hashes`, or len(hashes) + 32 bits of it for any other word.

    Leaf i has the path nodes[starts[i]:starts[i + 1]], taking the member `slots` of each; leaves beyond
    len(hashes) are the hashed ones, `leaf_mass` their count and 0.5 for each of their words and one unseen.
    `deep` is the log share of a leaf in its class of the lowest level with features, `group` the class that stands
    for a leaf in histories when its word is rare.
    """

    hashes: np.ndarray
    starts: np.ndarray
    nodes: np.ndarray
    slots: np.ndarray
    bias: np.ndarray
    deep: np.ndarray
    group: np.ndarray
    leaf_mass: np.ndarray

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        return np.where(codes < n, codes, n + (codes - n) % len(self.leaf_mass))

    def symbols(self, codes: np.ndarray, limit: int) -> np.ndarray:
        """What histories are hashed by: the word itself among the `limit` most frequent, else its class; -1 before a text."""
        return np.where(codes < limit, codes, (1 << 40) + self.group[self.leaves(codes)])


@dataclass(frozen=True)
class Model:
    """The tree and its weights: a row holds a weight for each member of a class; see TOKENS_A_ROW for their number."""

    classes: Classes
    weights: np.ndarray

    def arrived(self) -> Model:
        """The same after a broadcast: numpy's quick paths want its own dtype objects, not the unpickled ones."""
        own = lambda x: x.view(x.dtype.type)
        return Model(Classes(*(own(getattr(self.classes, f.name)) for f in fields(self.classes))), own(self.weights))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * _SPAN)
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE))
    return _powers


class Words:
    """The tokens of a batch of texts, lower-cased in A-Z, found and hashed as arrays.

    `start` and `stop` are their bytes in `data`, `hash` 64 bits of each, `first` the first token of each text.
    The byte that marks an end lacks in UTF-8; in a text it counts as 0xFE. Words of one hash are taken for one: among a billion words the chance is about one in forty.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join([x.lower().replace(_MARK[1:2], b"\xfe") + _MARK for x in texts]), np.uint8)
        inside = _IN_WORD[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.r_[0, edge] if len(inside) and inside[0] else edge
        self.start, self.stop = edge[::2], edge[1::2]
        self.hash = np.empty(len(self.start), np.uint64)
        cuts = np.unique(np.r_[0, np.searchsorted(self.start, np.arange(_SPAN, len(self.data), _SPAN)), len(self.start)])
        for low, high in zip(cuts, cuts[1:]):
            self._hash(low, high)
        ends = np.flatnonzero((self.data[self.start] == _MARK[1]) & (self.stop - self.start == 1))
        self.first = np.r_[0, ends[:-1] + 1][: len(ends)]

    def _hash(self, low: int, high: int) -> None:
        """Polynomial hashes of some words, from running sums over their bytes."""
        at, last = self.start[low], self.stop[high - 1]
        up, down = _powers_to(last - at + 1)
        value = self.data[at:last].astype(np.uint64)
        value += np.uint64(1)
        value *= up[: last - at]
        sums = np.zeros(last - at + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        start = self.start[low:high] - at
        x = (sums[self.stop[low:high] - at] - sums[start]) * down[start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        self.hash[low:high] = x ^ (x >> np.uint64(32))

    def bytes_of(self, at: np.ndarray) -> pa.Array:
        """The words at these places."""
        lengths = self.stop[at] - self.start[at]
        offsets = np.r_[0, np.cumsum(lengths)]
        held = self.data[np.arange(offsets[-1]) + np.repeat(self.start[at] - offsets[:-1], lengths)]
        held[offsets[:-1][(lengths == 1) & (self.data[self.start[at]] == _MARK[1])]] = END[0]
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(held)])


class Codes:
    """Codes of hashes: see Classes. The sorted hashes are entered at the first that shares the leading bits."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.hashes, self.size = hashes[self.order], len(hashes)
        self.shift = np.uint64(64 - max(self.size.bit_length(), 1) - 1)
        self.entry = np.searchsorted(self.hashes, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        rest = self.size + (hashes >> np.uint64(32)).astype(np.int64)
        if not self.size:
            return rest
        at = self.entry[(hashes >> self.shift).astype(np.int64)]
        below = np.arange(len(hashes))
        while len(below):
            below = below[at[below] < self.size]
            below = below[self.hashes[at[below]] < hashes[below]]
            at[below] += 1
        at[at == self.size] = 0
        return np.where(self.hashes[at] == hashes, self.order[at], rest)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p).astype(np.uint64)) * _MIX
        x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9)


def huffman(masses: np.ndarray, arity: int = ARITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parent, slot, mass) of each leaf, then each class, of the tree with the least mean depth; -1 above the root."""
    n = len(masses)
    order = np.argsort(masses, kind="stable").tolist()
    pad = -(n - 1) % (arity - 1)
    total = n + -(-(n - 1) // (arity - 1))
    parent, slot, mass = [-1] * total, [0] * total, [*masses.tolist(), *[0.0] * (total - n)]
    low, made = 0, n  # the next leaf and the next class without a parent, both by rising mass
    for new in range(n, total):
        for j in range(pad if new == n else 0, arity):
            if low < n and (made >= new or mass[order[low]] <= mass[made]):
                kid, low = order[low], low + 1
            else:
                kid, made = made, made + 1
            parent[kid], slot[kid] = new, j
            mass[new] += mass[kid]
    return np.array(parent), np.array(slot), np.array(mass)


def class_tree(hashes: np.ndarray, counts: np.ndarray, leaf_mass: np.ndarray, levels: int) -> Classes:
    """The words' leaves by Huffman's rule, with one more for all other words; below it a full tree of `levels` over hashes."""
    n = len(hashes)
    parent, slot, mass = huffman(np.r_[counts + 0.5, leaf_mass.sum()])
    n_nodes = len(parent) - n - 1
    node_of = lambda i: len(parent) - 1 - i  # noqa: E731, the root is 0
    bias = [np.full((n_nodes, ARITY), -1e4)]
    kids = np.flatnonzero(parent >= 0)
    bias[0][node_of(parent[kids]), slot[kids]] = np.log(mass[kids] / mass[parent[kids]])
    at, steps = np.arange(n + 1), []
    while (parent[at] >= 0).any():
        up = parent[at] >= 0
        steps.append((np.where(up, node_of(parent[at]), -1), slot[at]))
        at = np.where(up, parent[at], at)
    found = np.stack([x for x, _ in steps[::-1]], axis=1) if steps else np.zeros((n + 1, 0), int)  # the root last in `steps`
    taken = np.stack([x for _, x in steps[::-1]], axis=1) if steps else found
    rest, rest_slots = found[n][found[n] >= 0], taken[n][found[n] >= 0]
    lengths = (found[:n] >= 0).sum(axis=1)
    nodes, slots = found[:n][found[:n] >= 0], taken[:n][found[:n] >= 0]
    bucket, first, below, below_slots = np.arange(len(leaf_mass)), n_nodes, [], []
    for level in range(levels):
        size = ARITY**level
        sums = leaf_mass.reshape(size, ARITY, -1).sum(axis=2)
        bias.append(np.log(sums / sums.sum(axis=1, keepdims=True)))
        below.append(first + bucket // ARITY ** (levels - level))
        below_slots.append(bucket // ARITY ** (levels - level - 1) % ARITY)
        first += size
    tail = lambda own, more: np.column_stack([np.tile(own, (len(bucket), 1)), *more]).ravel()
    lengths = np.r_[lengths, np.full(len(bucket), len(rest) + levels)]
    nodes, slots = np.r_[nodes, tail(rest, below)].astype(np.int64), np.r_[slots, tail(rest_slots, below_slots)].astype(np.int64)
    starts, bias = np.r_[0, np.cumsum(lengths)], np.concatenate(bias)
    leaf = np.repeat(np.arange(len(lengths)), lengths)
    low = np.flatnonzero(np.arange(len(leaf)) - starts[leaf] >= max(DEPTHS))
    deep = np.bincount(leaf[low], bias[nodes[low], slots[low]], len(lengths)).astype(np.float64)
    group = nodes[starts[:-1] + np.minimum(CLASS_LEVEL, lengths - 1)] if len(nodes) else np.zeros(len(lengths), np.int64)
    return Classes(hashes, starts, nodes, slots, bias.astype(np.float32), deep, group, leaf_mass)


def histories(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes one and two words back; before a text's start they are -1."""
    one, two = np.r_[-1, codes[:-1]], np.r_[-1, -1, codes[:-2]][: len(codes)]
    one[starts] = -1
    two[starts] = -1
    after = starts + 1
    two[after[after < len(codes)]] = -1
    return one, two


_ONES = np.ones(ARITY, np.float32)


def factors(model: Model, codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each level with features: (places of the tokens with a class there, logits, member taken, each feature's rows).

    Every token has all features; a history word beyond the len(weights) / 4 most frequent is taken by its class.
    """
    tree, n_rows = model.classes, len(model.weights)
    shift = np.uint64(64 - n_rows.bit_length() + 1)
    leaf = tree.leaves(codes)
    start, length = tree.starts[leaf], tree.starts[leaf + 1] - tree.starts[leaf]
    one, two, salts = tree.symbols(one, n_rows // 4), tree.symbols(two, n_rows // 4), _hash(9, np.arange(len(tree.bias)))
    features = [(d, _hash(i + 1, *parts)) for i, (d, parts) in enumerate(zip(DEPTHS, ((one + 2,), (two + 2,), (one + 2, two + 2))))]
    for depth in range(min(int(length.max(initial=0)), max(DEPTHS))):
        at = np.flatnonzero(length > depth)
        place = start[at] + depth
        node = tree.nodes[place]
        salt, logits, rows = salts[node], tree.bias.take(node, axis=0), []
        for deep, hashes in features:
            if depth < deep:
                row = (((hashes[at] ^ salt) * _MIX) >> shift).astype(np.int64)
                logits += model.weights.take(row, axis=0)
                rows.append(row)
        yield at, np.minimum(logits, np.float32(80), out=logits), tree.slots[place], rows


def log_probabilities(model: Model, codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """ln P of each token's leaf."""
    out = model.classes.deep[model.classes.leaves(codes)]
    for low in range(0, len(codes), BATCH):
        part = slice(low, low + BATCH)
        for at, logits, slot, _ in factors(model, codes[part], one[part], two[part]):
            own = logits[np.arange(len(at)), slot].astype(np.float64)
            out[low + at] += np.maximum(own - np.log(np.exp(logits, out=logits) @ _ONES), -70.0)
    return out


def add_gradient(model: Model, expected: np.ndarray, observed: np.ndarray, codes: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Add each weight's expected count under the model and its observed count; their difference is the gradient."""
    members, ones = np.arange(ARITY), np.ones(BATCH, observed.dtype)
    for low in range(0, len(codes), BATCH):
        part = slice(low, low + BATCH)
        for at, logits, slot, rows in factors(model, codes[part], one[part], two[part]):
            np.exp(logits, out=logits)
            logits /= (logits @ _ONES)[:, None]
            for row in rows:
                np.add.at(expected, (row[:, None] * ARITY + members).ravel(), logits.ravel())
                np.add.at(observed, row * ARITY + slot, ones[: len(row)])


def _words(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for whole in batches:
        for batch in slices(whole, 0, limit):
            yield batch, Words([x or b"" for x in batch.column(0).to_pylist()])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, hash, n): the tokens of all texts, the end token included; counted before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _words(batches, 8 << 20):
            hashes, at, n = np.unique(words.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([words.bytes_of(at), pa.array(hashes.view(np.int64)), pa.array(n)], names=["word", "hash", "n"])

    return docs.select(utf8(text_col)).mapInArrow(scan, "word binary, hash bigint, n bigint").groupBy("word", "hash").agg(F.sum("n").alias("n"))


def most_frequent(words: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and counts of about `size` of the most frequent words, by falling count; of all if there are no more.

    A histogram of the counts' logarithms, some hundred rows, tells the step that fills the list; of the words
    in that step those with the smallest hashes are taken. Nothing is sorted, no other word comes to the driver.
    """
    step, slot = F.floor(F.log2(F.col("n").cast("double")) * 8), F.pmod("hash", F.lit(1 << 30))
    held, wanted = 0, F.lit(False)
    for x in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda x: -x.step):
        share = min(1.0, (size - held) / x["count"])
        wanted = wanted | ((step == x.step) & (slot < math.ceil(share * (1 << 30)))) if share < 1 else step >= x.step
        held += x["count"]
        if share < 1:
            break
    found = words.filter(wanted).select("hash", "n").toArrow()
    hashes, n = found["hash"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort((hashes, -n))
    return hashes[order], n[order]


def start_model(words: DataFrame, hashes: np.ndarray, counts: np.ndarray, n_tokens: int) -> Model:
    """Weights of zero: so far P is the add-half share of each word, with one unseen word in each hashed leaf."""
    rest, levels = n_tokens - int(counts.sum()), 0
    while levels < 4 and ARITY ** (levels + 1) * TOKENS_A_LEAF <= rest:
        levels += 1
    n_leaves = ARITY**levels
    mass = np.full(n_leaves, 0.5)
    leaf = F.pmod(F.shiftrightunsigned("hash", 32), F.lit(n_leaves))
    for x in words.groupBy(leaf.alias("leaf")).agg((F.sum("n") + F.count("*") * 0.5).alias("mass")).collect():  # n_leaves rows
        mass[x.leaf] += x.mass
    np.subtract.at(mass, ((hashes >> np.uint64(32)) % np.uint64(n_leaves)).astype(np.int64), counts + 0.5)
    bits = min(max(math.ceil(math.log2(max(n_tokens, 1) / TOKENS_A_ROW)), MIN_BITS), MAX_BITS)
    return Model(class_tree(hashes, counts, np.maximum(mass, 0.5), levels), np.zeros((1 << bits, ARITY), np.float32))


def _gradient(docs: DataFrame, model: Model, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(expected, observed) counts of each weight over the texts, summed over tasks; the weights' shape.

    A task sends its sums once, in blocks of rows, the expected ones at half precision; a block's sums are
    added up as a stream, so no task holds more than one matrix of each.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    n_rows = len(model.weights)
    size = _BLOCK * ARITY
    schema = "block int, scale double, expected binary, observed binary"

    def emit(blocks: list[tuple], kinds: tuple[type, type]) -> pa.RecordBatch:
        scales = [max(float(e.max()), 1e-9) for _, e, _ in blocks]
        packed = lambda x, kind: zlib.compress(x.astype(kind).tobytes(), 1)  # noqa: E731, most are zeros
        expected = [packed(e / s, kinds[0]) for (_, e, _), s in zip(blocks, scales)]
        columns = [pa.array([b for b, *_ in blocks], pa.int32()), pa.array(scales, pa.float64()), pa.array(expected, pa.binary()), pa.array([packed(o, kinds[1]) for *_, o in blocks], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "scale", "expected", "observed"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value.arrived()
        codes, expected, part = Codes(model.classes.hashes), np.zeros(n_rows * ARITY), np.zeros(n_rows * ARITY, np.float32)
        observed = np.zeros(n_rows * ARITY, np.int32)
        for _, words in _words(batches):
            flat = codes.of(words.hash)
            add_gradient(model, part, observed, flat, *histories(flat, words.first))
            expected += part
            part[:] = 0
        used = [i for i in range(0, n_rows, _BLOCK) if observed[i * ARITY : i * ARITY + size].any()]
        for low in range(0, len(used), 256):
            yield emit([(i, expected[i * ARITY : i * ARITY + size], observed[i * ARITY : i * ARITY + size]) for i in used[low : low + 256]], (np.float16, np.int32))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for x in batch.to_pylist():
                held = sums.setdefault(x["block"], [np.zeros(size), np.zeros(size, np.int64)])
                held[0] += np.frombuffer(zlib.decompress(x["expected"]), np.float16).astype(np.float64) * x["scale"]
                held[1] += np.frombuffer(zlib.decompress(x["observed"]), np.int32)
        yield emit([(block, e, o) for block, (e, o) in sums.items()], (np.float32, np.int64))

    sums = docs.select(utf8(text_col)).mapInArrow(train, schema).repartition("block").mapInArrow(add, schema)
    expected, observed = np.zeros(n_rows * ARITY), np.zeros(n_rows * ARITY)
    for x in sums.collect():  # n_rows / _BLOCK rows
        own = slice(x.block * ARITY, x.block * ARITY + size)
        expected[own], observed[own] = np.frombuffer(zlib.decompress(x.expected), np.float32).astype(np.float64) * x.scale, np.frombuffer(zlib.decompress(x.observed), np.int64)
    return expected.reshape(n_rows, ARITY), observed.reshape(n_rows, ARITY)


def train_model(train: DataFrame, model: Model, id_col: str, text_col: str = "text", steps: tuple[float, ...] = STEPS) -> Model:
    """Distributed gradient updates: every training text once, an equal share of them, by a hash of the id, in each round.

    A weight moves by the step times ln((observed + CALM) / (expected + CALM)), the gradient's direction on the
    scale of generalised iterative scaling. The sums don't depend on how the rows are dealt to tasks, but for
    rounding: about one part in ten thousand of an expected count.
    """
    for i, step in enumerate(steps):
        part = train.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit("round")), F.lit(len(steps))) == i)
        expected, observed = _gradient(part, model, text_col)
        model = Model(model.classes, (model.weights + step * np.log((observed + CALM) / (expected + CALM))).astype(np.float32))
    return model


def _score_known(rows: DataFrame, model: Model, counts: np.ndarray, base_total: float) -> DataFrame:
    """(id, n_tokens, n_head, base, score, tail): sums of log10 over a text, and its words without a leaf of their own.

    base lacks log10(c + 0.5) of those words, score the same term of their share in their leaf.
    """
    broadcast = rows.sparkSession.sparkContext.broadcast((model, np.log10(counts + 0.5)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = broadcast.value[0].arrived(), broadcast.value[1]
        codes, leaf_logs = Codes(model.classes.hashes), np.log10(model.classes.leaf_mass)
        for batch, words in _words(batches):
            flat, first = codes.of(words.hash), words.first
            score = log_probabilities(model, flat, *histories(flat, first)) / math.log(10)
            tail = np.flatnonzero(flat >= codes.size)
            score[tail] -= leaf_logs[(flat[tail] - codes.size) % len(leaf_logs)]
            base, n = np.zeros(len(flat)), np.diff(np.r_[first, len(flat)])
            head = np.flatnonzero(flat < codes.size)
            base[head] = logs[flat[head]]
            offsets = pa.array(np.searchsorted(tail, np.r_[first, len(flat)]).astype(np.int32))
            sums = [np.add.reduceat(x, first) for x in (base - base_total, score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(n), pa.array(n - np.diff(offsets)), *map(pa.array, sums), pa.ListArray.from_arrays(offsets, words.bytes_of(tail))],
                names=["id", "n_tokens", "n_head", "base", "score", "tail"],
            )

    return rows.select(utf8("text"), "id").mapInArrow(scan, f"{field(rows, 'id')}, n_tokens bigint, n_head bigint, base double, score double, tail array<binary>")


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, held_out: int = 1, head_size: int = HEAD, steps: tuple[float, ...] = STEPS
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document.

    Trained on the texts with crc32(id as text) mod `modulus` other than `held_out`. Tokens are the text's
    words, lower-cased in A-Z, and one end. base_score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over the
    tokens, score the model's log10 probability; n_known counts tokens with c > 0.

    All training words are counted and all training texts pass through the gradient. The `head_size` or so most
    frequent words have leaves of their own; other words go by hash to leaves whose number grows with their
    tokens, and share a leaf's probability by their counts plus a half, one unseen word among them.

    Null text counts as empty (its one token is the end), a null id as the empty string in the crc32. Rows
    that repeat id and text get the same figures each. Without training text N and V are 0. Other columns
    are ignored, whatever their names. Texts of any length are taken whole, bytes that are no UTF-8 as they are. An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    train = rows.filter(id_remainder("id", modulus) != held_out)
    words, _ = written(count_words(train))
    n_tokens, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hashes, counts = most_frequent(words, head_size)
    model = train_model(train, start_model(words, hashes, counts, n_tokens), "id", steps=steps)
    base_total = math.log10(n_tokens + 0.5 * (n_words + 1))

    known = _score_known(rows, model, counts, base_total).withColumn("row", F.monotonically_increasing_id())
    known, _ = written(known)  # a row's number is stored with it
    tail = known.filter("n_head < n_tokens").select("row", F.explode("tail").alias("word"))
    sums = tail.join(words, "word", "left").groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("found"))
    share = lambda c: F.coalesce(c, F.lit(0))
    return known.join(sums, "row", "left").select(
        F.col("id").alias(id_col),
        (id_remainder("id", modulus) == held_out).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + share("found")).alias("n_known"),
        F.lit(int(n_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + share("logs")).alias("base_score"),
        (F.col("score") + share("logs")).alias("score"),
    )
