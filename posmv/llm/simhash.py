"""SimHash near-dedup with vantage-point trees over Hamming space.

Fingerprints are 64 majority bits over the XXH64 of word shingles. The distinct ones are dealt to shards by a
vantage-point tree: a node sends a fingerprint inside when its Hamming distance to the vantage point is at
most the node's radius, else outside. For links of at most `distance` bits the triangle inequality allows a
pair to part at a node only if one of them lies within `distance` of the radius; so a fingerprint is the
member of one shard and asks in every shard whose side of each radius it can reach. In a shard members and
askers go down a further tree in the same way until few are left, which are compared by popcount. The tree over
shards is fitted to a sample of PER_SHARD fingerprints a shard; the sample decides only how even the shards are. There
are as many shards as keep the members of one near SHARD, and MOST_SHARDS at most, so sample and tree stay below some
20 MB; beyond SHARD * MOST_SHARDS (two thousand million) distinct fingerprints the shards grow, by 8 bytes a member.

A shard returns the links of a spanning forest, not all pairs, so a large group of near copies costs no more
than its number of distinct fingerprints. Equal fingerprints are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.common import materialize, slices
from posmv.llm.components import components

#: Members of a shard aimed at, the number of shards at most, and sampled fingerprints for each shard.
SHARD, MOST_SHARDS, PER_SHARD = 16_384, 1 << 17, 16
_LEAF = 96


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned; 0 for a text without words. Fewer words than a shingle has: the whole sequence is one."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    return majority(np.fromiter(_shingles(tokens, words, seed, xxhash.xxh64_intdigest), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _shingles(tokens: list[bytes], words: int, seed: int, digest) -> Iterator[int]:
    if len(tokens) <= words:
        return iter((digest(b" ".join(tokens), seed),))
    return (digest(b" ".join(s), seed) for s in zip(*(tokens[i:] for i in range(words)), strict=False))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Return doc_id and fp, the fingerprint as a signed long, of each whole text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def fit(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """A tree as nodes (vantage point, radius, inside, outside); a child below zero is shard -child - 1."""
    rng = np.random.default_rng(0)
    nodes: list = []
    shards = 0

    def grow(points: np.ndarray, want: int) -> int:
        nonlocal shards
        if want > 1 and len(points) > 8:
            split = _split(points, rng)
            if split is not None:
                vantage, radius, near = split
                nodes.append(None)
                at = len(nodes) - 1
                nodes[at] = (int(vantage), radius, grow(points[near], want // 2), grow(points[~near], want - want // 2))
                return at
        shards += 1
        return -shards

    root = grow(sample, leaves)
    return nodes if root == 0 else []


def _split(points: np.ndarray, rng) -> tuple[np.uint64, int, np.ndarray] | None:
    """Of a few vantage points the one whose median radius has the fewest points on its border."""
    best = None
    for vantage in points[rng.integers(0, len(points), 6)]:
        d = np.bitwise_count(points ^ vantage)
        radius = int(np.median(d))
        near = d <= radius
        inside = near.mean()
        if 0.2 <= inside <= 0.8:
            border = (np.abs(d.astype(np.int64) - radius) <= 2).mean()
            if best is None or border < best[0]:
                best = border, vantage, radius, near
    return best and best[1:]


def visit(nodes: list, points: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shard that is reached: its number, indices of points, and whether each is a member."""
    stack = [(0 if nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        at, index, member = stack.pop()
        if not len(index):
            continue
        if at < 0:
            yield -at - 1, index, member
            continue
        vantage, radius, inside, outside = nodes[at]
        d = np.bitwise_count(points[index] ^ np.uint64(vantage)).astype(np.int64)
        for child, side, reach in ((inside, d <= radius, d <= radius + distance), (outside, d > radius, d > radius - distance)):
            stack.append((child, index[reach], (member & side)[reach]))


def near_pairs(members: np.ndarray, askers: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of every member and asker within distance of each other, by a tree built on the way down."""
    rng = np.random.default_rng(0)
    stack = [(np.arange(len(members)), np.arange(len(askers)))]
    while stack:
        m, a = stack.pop()
        if not len(m) or not len(a):
            continue
        points = members[m]
        split = _split(points, rng) if len(m) > _LEAF else None
        if split is None:
            step = max(1, (1 << 21) // len(m))
            for k in range(0, len(a), step):
                i, j = np.nonzero(np.bitwise_count(askers[a[k : k + step], None] ^ points) <= distance)
                if len(i):
                    yield m[j], a[k + i]
            continue
        vantage, radius, near = split
        d = np.bitwise_count(askers[a] ^ vantage).astype(np.int64)
        stack.append((m[near], a[d <= radius + distance]))
        stack.append((m[~near], a[d > radius - distance]))


def forest(fps: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], room: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the least of its component, among the pairs of one shard; fps ascends."""
    labels = np.arange(len(fps))

    def join(own: np.ndarray, other: np.ndarray) -> None:
        nonlocal labels
        x, y = np.searchsorted(fps, own), np.searchsorted(fps, other)
        while True:
            apart = labels[x] != labels[y]
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            low, high = np.minimum(labels[x], labels[y]), np.maximum(labels[x], labels[y])
            np.minimum.at(labels, high, low)
            while (labels != (up := labels[labels])).any():
                labels = up

    held, size = [], 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= room:
            join(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        join(*map(np.concatenate, zip(*held, strict=True)))
    tied = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[tied], fps[labels[tied]]


def links(distinct: DataFrame, distance: int = 2, shard: int = SHARD) -> DataFrame:
    """distinct: column fp, each once. Return links a, b between fingerprints that join exactly those within
    `distance` bits, directly or through others."""
    spark = distinct.sparkSession
    total = distinct.count()
    shards = min(MOST_SHARDS, max(1, -(-total // shard)))
    share = min(1.0, PER_SHARD * max(512, shards) / max(1, total))  # at most some 2**21 fingerprints
    taken = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("fp").toArrow()
    nodes = fit(np.sort(taken.column("fp").to_numpy().view(np.uint64)), shards)
    tree = spark.sparkContext.broadcast(nodes)  # at most MOST_SHARDS nodes of four numbers

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for number, index, member in visit(tree.value, fps.view(np.uint64), distance):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), number, np.int32)), pa.array(fps[index]), pa.array(member)], ["shard", "fp", "member"])

    def search(key: tuple, shard_rows: pa.Table) -> pa.Table:
        fps = shard_rows.column("fp").to_numpy().view(np.uint64)
        members = fps[shard_rows.column("member").to_numpy()]
        a, b = forest(np.sort(fps), ((members[i], fps[j]) for i, j in near_pairs(members, fps, distance)))
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, fp long, member boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """Return doc_id, fp (signed long), fingerprint (hex), component_id, the smallest doc_id reachable.

    Documents of equal fingerprints are linked; null and empty texts have fingerprint zero, linked like any
    other. Repeated rows stay, each with the same component. Null ids are ignored when the smallest is
    sought, so a component of such rows alone has none. An empty table gives no rows. Other columns are not
    read, whatever their names.
    """
    marked = materialize(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, distance))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
