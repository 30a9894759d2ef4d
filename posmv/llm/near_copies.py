"""Near copies by shared word shingles: SimHash fingerprints in overlapping shards, and an exact check of the pairs.

Two texts are near copies when the Jaccard similarity of their sets of `words`-word shingles (A-Z lower-cased) is
`similarity` or more. At 0.8 the 64-bit SimHashes of two texts differ in 10 bits or so and, but for one pair in
some ten thousand, in at most RADIUS. Random fingerprints lie 32 bits apart, give or take 4, so at this radius the
triangle bounds of a vantage point exclude no shard: a tree over the whole corpus would ask everywhere. The
shards are therefore made by the shingles themselves: a text is in one shard for each of BANDS keys, a key being
the least hashes of its shingles under ROWS permutations. Two texts of similarity s meet in a shard with
probability 1 - (1 - s**ROWS)**BANDS, which is 0.9998 at 0.8. Within its shards a fingerprint asks the
vantage-point search for all fingerprints in its radius, and every pair so found is checked on the whole sets.

Only links that join two components matter, so large groups cost no more than their members: first each shard's
members are checked against its first row; then only those that are in another component than the first row ask
further, all members of the shard, the nearest first, and no longer once they are in one component. For that a shard
is cut into blocks of at most BLOCK members and BLOCK askers; each block of members and of askers is a group of its own,
so no task holds a whole large shard, and sets of shingles move only for rows that have something in their radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.chunks import Spans, text_bytes
from posmv.llm.common import materialize, slices
from posmv.llm.components import components
from posmv.llm.simhash import majority, near_pairs
from posmv.llm.substring import mix

BANDS, ROWS, RADIUS, BLOCK = 16, 4, 20, 2048
#: Members of a shard that an asker is checked against at a time.
NEAREST = 32
#: Pairs of members and askers that are held at a time (some 100 bytes each).
PAIRS = 1 << 18
#: Rows whose numbers are broadcast at most (8 bytes each).
LISTED = 1 << 20


_bytes = np.arange(256)
_SPACE = (_bytes == 0x20) | ((_bytes >= 9) & (_bytes <= 13))
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
_rng = np.random.default_rng(23)
_ODD = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the distinct hashes of its shingles, ascending. Fewer words than a shingle has: the whole sequence
    is one; no words: one shingle of its own."""
    data, offsets = text_bytes(texts.fill_null(""))
    solid = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    if not len(starts):
        return [np.zeros(1, np.uint64)] * len(texts)
    each = mix(Spans(_LOWER[data], starts, ends - starts).hash)
    odd = np.multiply.accumulate(np.full(words, 0x9E3779B97F4A7C15, np.uint64))
    whole = np.zeros(len(each), np.uint64)  # of the shingle that begins at each word, if it has all its words
    for k in range(words):
        whole[: len(each) - k] += each[k:] * odd[k]
    whole = mix(whole + np.uint64(words))
    out = []
    for x, y in zip(at := np.searchsorted(starts, offsets).tolist(), at[1:]):
        if y - x >= words:
            out.append(np.unique(whole[x : y - words + 1]))
        elif y > x:
            out.append(mix(np.array([(each[x:y] * odd[: y - x]).sum() + np.uint64(y - x)], np.uint64)))
        else:
            out.append(np.zeros(1, np.uint64))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays without repeats, neither empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def band_keys(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of sets of hashes that follow each other in flat."""
    out = np.zeros((len(starts), BANDS), np.uint64)
    for t in range(BANDS):
        for i in range(ROWS):
            out[:, t] += mix(np.minimum.reduceat(flat * _ODD[t, i], starts)) * _FOLD[t, i]
    return mix(out)


def _marks(rows: DataFrame, words: int) -> DataFrame:
    """row, text to row, fp, size (distinct shingles), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            sets = shingle_sets(part.column("text"), words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
            keys = band_keys(flat, starts).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(fps), pa.array(sizes), lists], ["row", "fp", "size", "keys"])

    return rows.select("row", "text").mapInArrow(run, "row long, fp long, size long, keys array<long>")


def _near(members: np.ndarray, askers: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of members and askers (tables with row, of, fp, size) in RADIUS of each other, in different components and
    of sizes that allow the similarity; by asker, the nearest first, and PAIRS at most at a time."""
    step = max(1, PAIRS // max(1, members.shape[1]))
    for k in range(0, askers.shape[1], step):
        held = list(near_pairs(members[2].view(np.uint64), askers[2, k : k + step].view(np.uint64), RADIUS))
        if not held:
            continue
        i, j = (np.concatenate(x) for x in zip(*held, strict=True))
        j += k
        low, high = np.minimum(members[3][i], askers[3][j]), np.maximum(members[3][i], askers[3][j])
        ok = (members[1][i] != askers[1][j]) & (low / high >= similarity)
        i, j = i[ok], j[ok]
        order = np.lexsort((members[0][i], np.bitwise_count(members[2][i] ^ askers[2][j]), j))
        yield i[order], j[order]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
    """For each run of rows with one key, b and c: the table key, b, c, asks, row, of, fp, size, and the sets if
    there are any."""
    held: list[tuple[np.ndarray, list]] = []

    def whole() -> tuple[np.ndarray, list]:
        out = np.concatenate([t for t, _ in held], 1), [x for _, s in held for x in s]
        held.clear()
        return out

    for batch in batches:
        table = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "b", "c", "asks", "row", "of", "fp", "size")])
        if not table.shape[1]:
            continue
        sets = batch.column("set").to_pylist() if "set" in batch.schema.names else []
        if held and (held[-1][0][:3, -1] != table[:3, 0]).any():
            yield whole()
        cuts = [0, *(np.flatnonzero((table[:3, 1:] != table[:3, :-1]).any(0)) + 1).tolist(), table.shape[1]]
        for x, y in zip(cuts, cuts[1:]):
            held.append((table[:, x:y], sets[x:y]))
            if y < table.shape[1]:
                yield whole()
    if held:
        yield whole()


_GROUP = "key long, b long, c long, asks long, row long, of long, fp long, size long"


def _dealt(members: DataFrame) -> DataFrame:
    """members: key, row, of, fp, size, first (the component of the shard's first row). Every member of the shards that have
    askers in a block b of members, once for each block c of askers, and every asker once for each b."""
    open_ = members.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.expr("of != first")).alias("m")).filter("m > 0")
    open_ = open_.selectExpr("key", f"(n + {BLOCK} - 1) div {BLOCK} AS n", f"(m + {BLOCK} - 1) div {BLOCK} AS m")
    rows = members.join(open_, "key").withColumn("h", F.xxhash64("row"))
    own = rows.selectExpr("key", "pmod(h, n) AS b", "explode(sequence(0L, m - 1)) AS c", "0L AS asks", "row", "of", "fp", "size")
    asks = rows.filter("of != first").selectExpr("key", "explode(sequence(0L, n - 1)) AS b", "pmod(h, m) AS c", "1L AS asks", "row", "of", "fp", "size")
    return own.unionByName(asks)


def _involved(dealt: DataFrame, similarity: float) -> DataFrame:
    """The rows of each group with a member or asker of another component near them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _groups(batches):
            asks = np.flatnonzero(table[3])
            owns = np.flatnonzero(table[3] == 0)
            near = [(np.unique(i), np.unique(j)) for i, j in _near(table[4:, owns], table[4:, asks], similarity) if len(i)]
            if near:
                i, j = (np.unique(np.concatenate(x)) for x in zip(*near, strict=True))
                part = table[:, np.concatenate([owns[i], asks[j]])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["key", "b", "c", "asks", "row", "of", "fp", "size"])

    return dealt.repartition("key", "b", "c").sortWithinPartitions("key", "b", "c").mapInArrow(run, _GROUP)


def _runs(j: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(j[1:] != j[:-1]) + 1).tolist(), len(j)]
    return zip(edges, edges[1:]) if len(j) else iter(())


def linked(table: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join exactly the components which similar rows of one group join. table: asks, row, of, fp, size."""
    asks, owns = np.flatnonzero(table[0]), np.flatnonzero(table[0] == 0)
    of = table[2].copy()
    found = []
    for a, todo in ((asks[j[x]], owns[i[x:y]]) for i, j in _near(table[1:, owns], table[1:, asks], similarity) for x, y in _runs(j)):
        while len(todo := todo[of[todo] != of[a]]):
            now, todo = todo[:NEAREST], todo[NEAREST:]
            flat = np.concatenate([sets[t] for t in now])
            sizes = np.array([len(sets[t]) for t in now])
            at = np.minimum(np.searchsorted(sets[a], flat), len(sets[a]) - 1)
            both = np.add.reduceat((sets[a][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for t in now[both / (sizes + len(sets[a]) - both) >= similarity]:
                if of[t] != of[a]:
                    found.append((int(table[1][a]), int(table[1][t])))
                    of[of == of[t]] = of[a]
    return found


def _resolved(involved: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, held in _groups(batches):
            found = linked(table[3:], [np.frombuffer(x, np.uint64) for x in held], similarity)
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = involved.join(sets, "row").repartition("key", "b", "c").sortWithinPartitions("key", "b", "c")
    return rows.select("key", "b", "c", "asks", "row", "of", "fp", "size", "set").mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """row, text to row, set: the shingles' hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([x.tobytes() for x in shingle_sets(part.column("text"), words)], pa.binary())], ["row", "set"])

    return rows.mapInArrow(run, "row long, set binary")


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs a, b whose whole sets of shingles are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("row").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("row").alias("a"), F.col("set").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _listed(rows: DataFrame) -> DataFrame:
    """rows (one long each), to be joined with whole texts: by broadcast if there are LISTED at most, so that the texts are
    not shuffled for a few of them."""
    held = materialize(rows, "near-listed")
    return F.broadcast(held) if held.count() <= LISTED else held


def near_copy_labels(rows: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """rows: row (long, without repeats) and text. Return node and root for every row with a link: the least row of
    its component."""
    marks = materialize(_marks(rows, words), "near-marks")
    flat = marks.select("row", "fp", "size", F.explode("keys").alias("key"))
    first = flat.groupBy("key").agg(F.min(F.struct("row", "fp", "size")).alias("lead"), F.count("*").alias("n")).filter("n > 1").select("key", "lead")
    shared = materialize(flat.join(first, "key"), "near-shards")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("lead.fp"))) <= RADIUS
    alike = F.least("size", "lead.size") / F.greatest("size", "lead.size") >= similarity
    star = materialize(shared.filter((F.col("row") != F.col("lead.row")) & near & alike).select(F.col("lead.row").alias("a"), F.col("row").alias("b")).distinct(), "near-star")
    asked = star.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    links = materialize(_checked(star, materialize(_sets(rows.select("row", "text").join(_listed(asked), "row", "left_semi"), words), "near-sets"), similarity), "near-links")
    labels = components(links)

    of = shared.select("key", "row", "fp", "size").join(labels, F.col("row") == F.col("node"), "left").withColumn("of", F.coalesce("root", "row")).drop("node", "root")
    leads = shared.select("key", F.col("lead.row").alias("lead")).distinct().join(labels, F.col("lead") == F.col("node"), "left").select("key", F.coalesce("root", "lead").alias("first"))
    involved = materialize(_involved(_dealt(of.join(leads, "key")), similarity), "near-involved")
    sets = materialize(_sets(rows.select("row", "text").join(_listed(involved.select("row").distinct()), "row", "left_semi"), words), "near-sets")
    more = materialize(_resolved(involved, sets, similarity), "near-links")
    if more.isEmpty():
        return labels
    known = labels.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    return components(known.unionByName(more))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without those that are near copies, directly or through others, of a row with
    a smaller doc_id.

    Of each group one row stays: the one with the smallest doc_id, null ids last, and any one of those that repeat
    it. Rows are told apart by themselves, not by their ids, so rows with null or repeated ids and different texts
    all stay. Null and empty texts are copies of each other. An empty table gives no rows; no column of docs
    clashes with those used here.
    """
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row"))
    kept = materialize(kept, "near-rows")
    rows = kept.select("row", F.col("d").getField(text).alias("text"), F.col("d").getField(doc_id).alias("id"))
    labels = near_copy_labels(rows, words, similarity)
    tied = rows.select("row", "id").join(labels, F.col("row") == F.col("node"))
    stays = tied.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")).select("root", F.col("least.row").alias("stay"))
    gone = tied.join(stays, "root").filter("row != stay").select("row")
    return kept.join(_listed(gone), "row", "left_anti").select("d.*")
