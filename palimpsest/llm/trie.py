"""Prefix trie of conversations: shared turn prefixes as nodes, counted in flat arrays behind minimal perfect hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, written

#: Conversations of one block share the first turns of the block's first one.
GROUP = 100
SHARED = 6
#: Rebuilt turns of one shard, on average, and turns of one conversation in a shard, at the most.
SHARD = 200_000
SEGMENT = 1 << 16
#: Sorted turns of one partition, on average, and ids of one piece of a list of ends.
PART = 500_000
PIECE = 2048
MASK = (1 << 64) - 1
#: The odd bases of the two lanes of a prefix digest, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
KEY = ["depth", "pa", "pb"]


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square, left = square * square & MASK, left >> np.uint64(1)
    return out


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct 128-bit keys: a key alone in its place of a level has the place's rank, the others go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = keys, 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys repeat")
            at = self._place(left, len(self.levels), 2 * len(left) + 1)
            alone = np.bincount(at, minlength=2 * len(left) + 1) == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            base, left = base + int(alone.sum()), left[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = keys[:, 0] ^ (keys[:, 1] + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & MASK))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; that of a key which was not there at the start is another's, or -1."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(keys[open_], level, len(alone))
            out[open_[alone[at]]] = rank[at[alone[at]]]
            open_ = open_[~alone[at]]
        return out


class NodeTable:
    """The distinct nodes of a shard in slots; a lookup is checked against the digest that the slot holds."""

    def __init__(self, keys: np.ndarray):
        self.hash = MinimalPerfectHash(keys)
        self.keys = np.empty_like(keys)
        self.keys[self.hash.slots(keys)] = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.hash.slots(keys)
        return np.where((at >= 0) & (self.keys[at] == keys).all(axis=1), at, -1) if len(self.keys) else at


def _lane_key(depth: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    return np.stack([pa_.view(np.uint64) + depth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), pb.view(np.uint64)], axis=1)


# --- order and prefix digests


@dataclass
class Run:
    """What is known of a conversation from its first turns on: their number, the digest of all, and digests and lengths of the first."""

    conv: int
    group: int
    count: int = 0
    total: tuple[int, int] = (0, 0)
    first: list[tuple[int, int, int]] = field(default_factory=list)

    def grown(self, more: Run) -> Run:
        """This run, gone on with by `more`, whose digests start anew."""
        shift = [pow(b, self.count, 1 << 64) for b in BASES]
        moved = lambda d: tuple((t + s * x) & MASK for t, s, x in zip(self.total, shift, d))
        first = (self.first + [(*moved(d[:2]), d[2]) for d in more.first])[: SHARED - 1]
        return Run(self.conv, self.group, self.count + more.count, moved(more.total), first)


@dataclass
class Carry:
    """What a partition needs of those before it, and whether its last conversation goes on in the next."""

    run: Run | None = None
    head: Run | None = None
    goes_on: bool = False


class Turns:
    """A partition's turns in order, with positions and digests of a conversation's first turns up to each."""

    def __init__(self, table: pa.Table, carry: Carry | None = None):
        number = lambda c: table[c].to_numpy().astype(np.int64)
        self.group, self.conv, self.shared, self.chars = (number(c) for c in ("g", "conv_id", "h", "chars"))
        n = len(self.conv)
        digest = np.frombuffer(b"".join(table["t"].to_pylist()), np.uint64).reshape(n, 2)
        new = np.ones(n, bool)
        new[1:] = self.conv[1:] != self.conv[:-1]
        self.starts, self.run = np.flatnonzero(new), np.cumsum(new) - 1
        self.pos = np.arange(n) - self.starts[self.run] + 1
        before = carry.run if carry and carry.run and n and carry.run.conv == self.conv[0] else None
        self.continued = np.zeros(len(self.starts), bool)
        if before:
            self.pos[self.run == 0] += before.count
            self.continued[0] = True
        self.terms = np.stack([digest[:, i] * powers(b, self.pos) for i, b in enumerate(BASES)], axis=1)
        sums = np.cumsum(self.terms, axis=0, dtype=np.uint64)
        at = self.starts[self.run]
        self.sums = sums - sums[at] + self.terms[at]
        #: By run and place 0..5: the digest of so many first turns, the last one's length, and how many there are.
        self.first, self.first_chars = np.zeros((len(self.starts), SHARED, 2), np.uint64), np.zeros((len(self.starts), SHARED), np.int64)
        self.known = np.zeros(len(self.starts), np.int64)
        if before:
            self.sums[self.run == 0] += np.array(before.total, np.uint64)
            for i, (a, b, chars) in enumerate(before.first, 1):
                self.first[0, i], self.first_chars[0, i] = (a, b), chars
        early = np.flatnonzero(self.pos < SHARED)
        self.first[self.run[early], self.pos[early]], self.first_chars[self.run[early], self.pos[early]] = self.sums[early], self.chars[early]
        ends = np.append(self.starts[1:], n) - 1
        self.lengths = self.pos[ends] if n else np.zeros(0, np.int64)
        self.ends, self.known = ends, np.minimum(self.lengths, SHARED - 1)

    def as_run(self, r: int) -> Run:
        first = [(*map(int, self.first[r, i]), int(self.first_chars[r, i])) for i in range(1, int(self.known[r]) + 1)]
        return Run(int(self.conv[self.starts[r]]), int(self.group[self.starts[r]]), int(self.lengths[r]), tuple(map(int, self.sums[self.ends[r]])), first)


def _edges(turns: Turns) -> list[Run]:
    """The runs that a later partition may need: the first, the head of the last group, the last."""
    last = len(turns.starts) - 1
    convs, groups = turns.conv[turns.starts], turns.group[turns.starts]
    head = np.flatnonzero((groups == groups[last]) & (convs == groups[last]))
    return [turns.as_run(r) for r in sorted({0, *map(int, head[:1]), last})]


def _carries(edges: list[list[Run]]) -> list[Carry]:
    """Each partition's carry from all partitions' edges, in order; a partition without turns has none."""
    out, state = [], Carry()
    for own in edges:
        out.append(Carry(state.run, state.head))
        for run in own:
            same = state.run is not None and state.run.conv == run.conv
            run = state.run.grown(run) if same else run
            head = run if run.conv == run.group else state.head if state.head and state.head.group == run.group else None
            state = Carry(run, head)
    following = None
    for carry, own in zip(reversed(out), reversed(edges)):
        if own:
            carry.goes_on = following == own[-1].conv
            following = own[0].conv
    return out


def _rebuilt(turns: Turns, carry: Carry) -> dict[str, np.ndarray]:
    """Rows (depth, pa, pb, qa, qb, chars, conv_id, g, ended): rebuilt turns and roots with ended 0, ends with ended 1; q is the parent's digest."""
    runs = np.arange(len(turns.starts))
    convs, groups, shared = (x[turns.starts] for x in (turns.conv, turns.group, turns.shared))
    is_head = convs == groups
    # a group's head comes first: it stands in this partition, or it was carried here, or there is none
    opens = np.ones(len(runs), bool)
    opens[1:] = groups[1:] != groups[:-1]
    leader = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    held = is_head[leader]
    first, chars, known = turns.first[leader], turns.first_chars[leader], np.where(held, turns.known[leader], 0)
    first[~held], chars[~held] = 0, 0
    if carry.head:
        for r in np.flatnonzero(~held & (groups == carry.head.group)):
            known[r] = len(carry.head.first)
            for i, (a, b, c) in enumerate(carry.head.first, 1):
                first[r, i], chars[r, i] = (a, b), c
    taken = np.minimum(shared, known)
    skipped = np.where(is_head, 0, shared)
    back = np.stack([powers(b, np.where(is_head, 0, shared - taken)) for b in INVERSES], axis=1)
    start = np.where(is_head[:, None], np.uint64(0), first[runs, taken])  # digest of what comes from the head
    base = np.where(is_head[:, None], np.uint64(0), turns.first[runs, shared])  # and of what it stands for
    cut = np.where(is_head, 0, shared - taken)

    own = np.flatnonzero(turns.pos > skipped[turns.run])
    r = turns.run[own]
    digest = start[r] + back[r] * (turns.sums[own] - base[r])
    parent = start[r] + back[r] * (turns.sums[own] - turns.terms[own] - base[r])
    parts = [(turns.pos[own] - cut[r], digest, parent, turns.chars[own], r, 0)]
    for i in range(SHARED):  # roots, then turns from the head
        at = np.flatnonzero(~turns.continued & ((i == 0) | (~is_head & (taken >= i))))
        zero = np.zeros((len(at), 2), np.uint64)
        parts.append((np.full(len(at), i), first[at, i] if i else zero, first[at, i - 1] if i else zero, chars[at, i] if i else zero[:, 0], at, 0))
    done = runs[:-1] if carry.goes_on else runs
    beyond = turns.lengths[done] > skipped[done]
    digest = np.where(beyond[:, None], start[done] + back[done] * (turns.sums[turns.ends[done]] - base[done]), start[done])
    parts.append((np.where(beyond, turns.lengths[done] - cut[done], np.where(is_head[done], 0, taken[done])), digest, np.zeros_like(digest), np.zeros(len(done)), done, 1))
    whole = lambda f: np.concatenate([f(p) for p in parts])
    rows = whole(lambda p: p[4])
    digests, parents = whole(lambda p: p[1]).view(np.int64), whole(lambda p: p[2]).view(np.int64)
    return {
        "depth": whole(lambda p: p[0]).astype(np.int64), "pa": digests[:, 0], "pb": digests[:, 1], "qa": parents[:, 0], "qb": parents[:, 1],
        "chars": whole(lambda p: p[3]).astype(np.int64), "conv_id": convs[rows], "g": groups[rows], "ended": np.repeat([p[5] for p in parts], [len(p[0]) for p in parts]),
    }


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """The prefixes of all rebuilt conversations, see `_rebuilt`; one sort of narrow rows, then two scans.

    A turn goes as 16 bytes of MD5 and its length, so no text is sorted. Partitions are ranges of (block, conversation, turn),
    so that one conversation may lie in many: what one needs of the turns before it, a count, a running digest and five first turns,
    comes from the partitions' ends, three rows each.
    """
    spark = conversations.sparkSession
    names = {c: F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text")}
    text = {c: F.coalesce(names[c].cast("string"), F.lit("")) for c in ("role", "text")}
    conv = names["conv_id"].cast("bigint")
    digest = F.unhex(F.md5(F.concat(F.octet_length(text["role"]).cast("string"), F.lit(":"), text["role"], text["text"]).cast("binary")))
    rows = conversations.filter(names["conv_id"].isNotNull()).select(
        (conv - conv % GROUP).alias("g"), conv.alias("conv_id"), names["turn"].alias("turn"), (F.crc32(conv.cast("string").cast("binary")) % SHARED).alias("h"), digest.alias("t"), F.char_length(text["text"]).alias("chars")
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-conversations.count() // PART))
    order = ["g", F.col("conv_id") != F.col("g"), "conv_id", "turn", "t"]
    ordered = checkpoint(rows.repartitionByRange(parts, *order, F.rand(42)).sortWithinPartitions(*order).select("g", "conv_id", "h", "t", "chars").withColumn("part", F.spark_partition_id()))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            table = pa.Table.from_batches(held)
            if table.num_rows:
                runs = [{**vars(r), "total": [x - (x >> 63 << 64) for x in r.total], "first": [[x - (x >> 63 << 64) for x in f] for f in r.first]} for r in _edges(Turns(table))]
                yield pa.RecordBatch.from_pylist([{"part": table["part"][0].as_py(), "runs": runs}], schema=shape)

    numbers = pa.list_(pa.int64())
    shape = pa.schema([("part", pa.int32()), ("runs", pa.list_(pa.struct([("conv", pa.int64()), ("group", pa.int64()), ("count", pa.int64()), ("total", numbers), ("first", pa.list_(numbers))])))])
    kind = "part int, runs array<struct<conv bigint, `group` bigint, `count` bigint, total array<bigint>, first array<array<bigint>>>>"
    found: dict[int, list[Run]] = {}
    for row in ordered.mapInArrow(edges, kind).collect():
        found[row.part] = [Run(x["conv"], x["group"], x["count"], tuple(t & MASK for t in x["total"]), [(f[0] & MASK, f[1] & MASK, f[2]) for f in x["first"]]) for x in row.runs]
    at = sorted(found)
    shared = spark.sparkContext.broadcast(dict(zip(at, _carries([found[p] for p in at]))))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            table = pa.Table.from_batches(held)
            if table.num_rows:
                carry = shared.value[table["part"][0].as_py()]
                out = pa.table(_rebuilt(Turns(table, carry), carry))
                yield from out.to_batches(max_chunksize=100_000)

    return ordered.mapInArrow(rebuild, "depth bigint, pa bigint, pb bigint, qa bigint, qb bigint, chars bigint, conv_id bigint, g bigint, ended bigint")


# --- nodes


def _nodes(table: pa.Table) -> pa.Table:
    """A shard's node table: a row for each distinct prefix, its slot, its parent's slot, members, ends and least member."""
    get = lambda c: table[c].to_numpy()
    depth, turns = get("depth"), get("ended") == 0
    keys = _lane_key(depth, get("pa"), get("pb"))
    parents = _lane_key(depth - 1, get("qa"), get("qb"))
    inner = turns & (depth > 0)
    # parents that lie in an earlier segment of their conversation have a slot too, without members
    all_keys = np.concatenate([keys, parents[inner]])
    _, at = np.unique(all_keys.view([("a", "u8"), ("b", "u8")]).ravel(), return_index=True)
    nodes = NodeTable(all_keys[at])
    n, none = len(at), np.iinfo(np.int64).max
    slot = nodes.find(keys)
    columns = {c: np.zeros(n, np.int64) for c in ("depth", "pa", "pb", "qa", "qb", "chars")}
    place = nodes.find(parents[inner])
    for c, of in (("depth", depth[inner] - 1), ("pa", get("qa")[inner]), ("pb", get("qb")[inner])):
        columns[c][place] = of
    for c in columns:
        columns[c][slot[turns]] = get(c)[turns]
    members, ends, low, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, none), np.full(n, -1)
    np.add.at(members, slot[turns], 1)
    np.add.at(ends, slot[~turns], 1)
    np.minimum.at(low, slot[turns], get("conv_id")[turns])
    parent[slot[inner]] = place
    shard = {c: np.full(n, table[c][0].as_py()) for c in ("segment", "bucket")}
    return pa.table({**shard, "slot": np.arange(n), "parent": parent, **columns, "members": members, "ends": ends, "low": low})


def _accumulated(table: pa.Table) -> pa.Table:
    """Sums over subtrees of a shard's nodes: children, leaves and saved tokens climb the parent slots, deepest first.

    A node's own figures count in one shard alone, that of its least member, which holds the whole path to it.
    """
    n = table.num_rows
    at = table["slot"].to_numpy()

    def flat(c: str) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[at] = table[c].to_numpy()
        return out

    depth, parent, total, rep = flat("depth"), flat("parent"), flat("n_convs"), flat("rep")
    own = flat("low") == rep
    children, leaves, saved = np.zeros(n, np.int64), own * (flat("n_ends") == total) + flat("more_leaves"), own * (total - 1) * flat("chars") + flat("more_saved")
    inner = np.flatnonzero(parent >= 0)
    np.add.at(children, parent[inner], own[inner])
    inner = inner[np.argsort(-depth[inner], kind="stable")]
    for level in np.split(inner, np.flatnonzero(np.diff(depth[inner])) + 1):
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    outer = flat("members") == 0  # in another segment, which has these sums from `more`
    leaves[outer], saved[outer] = 0, 0
    parent_conv = pa.array(rep[parent], mask=parent < 0)
    return pa.table({"depth": depth, "pa": flat("pa"), "pb": flat("pb"), "rep": rep, "n_convs": total, "parent_conv_id": parent_conv, "n_children": children, "n_leaves": leaves, "saved_tokens": saved})


def _ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, pa, pb, ends_sha256): of each node's members that end there, ascending and comma-joined.

    Ids are sorted in ranges and joined to pieces of PIECE; a node's pieces then pass through one hash in order, held one by one.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1), batch.column(3).to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = np.concatenate([np.arange(lo, hi, PIECE) for lo, hi in zip([0, *cuts], [*cuts, len(ids)])]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
            texts = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[starts, c]) for c in range(3)), pa.array(ids[starts]), pa.array(texts, pa.string())], names=[*KEY, "at", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], r)) for r in out], schema=shape)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], (*held, state.hexdigest())))], schema=shape)

    shape = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
    keys = "depth bigint, pa bigint, pb bigint"
    listed = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, f"{keys}, at bigint, piece string")
    return listed.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(digests, f"{keys}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix.

    Turns (conv_id, turn, role, text) are ordered by turn, null first, ties by a digest of role and text. A conversation c starts
    with the first h turns of conversation c - c % 100, h = crc32(c as text) % 6, and goes on with its own after its first h.

    A prefix has a 128-bit digest that grows by a turn; equal digests with other parents or lengths raise an error.
    Shards hold whole blocks of conversations, about `shard` rebuilt turns, cut every `segment` turns so that a giant conversation lies in many.
    A shard's prefixes get the slots of a minimal perfect hash, checked against the digests; counts are scattered into arrays
    by slot, summed over the shards by digest and sent back, and sums over subtrees climb the parent slots in depth
    order. Of a conversation in several segments the deeper ones' sums enter the last slot of those before.
    The same digest in several shards is summed once more, so a prefix that a third of all rows share is a row for each shard.

    Null role or text is empty, rows without conv_id are left out, rows that repeat are turns each, a turn of any length goes
    by its digest. Extra columns are ignored. An empty table gives an empty result.
    """
    prefixes, path = written(rebuilt_prefixes(conversations))
    size = prefixes.agg(F.count("*"), F.max("depth")).first()
    buckets = max(1, -(-size[0] // shard))
    place = {"segment": F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / segment), "bucket": F.pmod(F.xxhash64("g"), F.lit(buckets))}
    placed = prefixes.withColumns(place)
    columns = ["segment", "bucket", "slot", "parent", "depth", "pa", "pb", "qa", "qb", "chars", "members", "ends", "low"]
    nodes, nodes_path = written(placed.groupBy("segment", "bucket").applyInArrow(_nodes, ", ".join(f"{c} bigint" for c in columns)))
    met = nodes.filter("members > 0")
    one = lambda *cs: F.coalesce(*(F.when(F.min(c) != F.max(c), F.raise_error(F.lit("two prefixes share a digest"))) for c in cs), F.min("low"))
    figures = met.groupBy(*KEY).agg(F.sum("members").alias("n_convs"), F.sum("ends").alias("n_ends"), one("qa", "qb", "chars").cast("bigint").alias("rep"))
    joined = nodes.join(figures, KEY)
    if (size[1] or 0) > segment:
        joined = joined.join(_deeper(placed, joined, segment), ["segment", "bucket", *KEY], "left").fillna(0, ["more_leaves", "more_saved"])
    else:
        joined = joined.withColumns({c: F.lit(0).cast("bigint") for c in ("more_leaves", "more_saved")})
    out = ["depth", "pa", "pb", "rep", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    climbed = joined.groupBy("segment", "bucket").applyInArrow(_accumulated, ", ".join(f"{c} bigint" for c in out))
    summed = climbed.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("rep", "n_convs", "parent_conv_id")), *(F.sum(c).alias(c) for c in out[6:]))
    ends = _ends_digest(prefixes.filter("ended = 1"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(ends, KEY, "left").select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", *out[4:5], *out[6:], F.coalesce("ends_sha256", none).alias("ends_sha256"))


def _deeper(placed: DataFrame, joined: DataFrame, segment: int) -> DataFrame:
    """(segment, bucket, depth, pa, pb, more_leaves, more_saved): what the deeper segments of a conversation add at the end of each."""
    own = joined.filter("segment > 0 and low = rep").groupBy(F.col("rep").alias("conv_id"), "segment").agg(
        F.sum((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.count_if(F.col("n_ends") == F.col("n_convs")).alias("leaves")
    )
    above = own.select("conv_id", (F.col("segment") - 1).alias("segment"), "saved", "leaves")
    ends = placed.filter(f"ended = 0 and depth > 0 and depth % {segment} = 0").select("conv_id", "segment", "bucket", *KEY)
    below = Window.partitionBy("conv_id").orderBy(F.desc("segment"))  # a row for each segment of a conversation
    found = ends.join(above, ["conv_id", "segment"], "left").withColumns({"more_saved": F.sum("saved").over(below), "more_leaves": F.sum("leaves").over(below)})
    return found.groupBy("segment", "bucket", *KEY).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
