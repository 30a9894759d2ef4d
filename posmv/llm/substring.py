"""Substring dedup: a log-structured index of window fingerprints.

A window is `window` consecutive words. Its fingerprint is the least hash among its word n-grams, so equal
windows have equal fingerprints and successive windows mostly share one: an occurrence is a fingerprint with
the run of windows that share it, about one for every 22 words instead of one for each word. An occurrence
also has a digest of all words that its windows cover.

The index is a log of immutable runs in the shared folder: (fp, digest) with the first document that has it, in buckets
by hash, each sorted. A batch of documents, all with larger ids than the batches before, is dealt to the same buckets
once and merge-joined with each run as it lies there; no run is shuffled again. What matches by fingerprint is
verified by the digest of the words, and all windows of such an occurrence are covered at once. What is new in the batch
is the next run, and when there are more than `max_runs` they are compacted into one. A manifest lists the runs, so a later
job can open the index and add its own batch.

Occurrences of one fingerprint with different digests may still share some windows (at the ends of a repeated
passage). Only there, and only for the first document of each digest, windows are compared one by one, by
a digest of each window, at every place where that document has the occurrence.

Copies collapse to one row for each digest and input task before they are shuffled. Where they are joined with their entry again,
those of a digest with more than HOT places go to the entries by broadcast, so that no task gets them all.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posmv.llm.chunks import Spans
from posmv.llm.common import delete_at_end, discard, materialize, scratch, slices, stored

WINDOW, GRAM = 50, 8
_Q = 0xD1B54A32D192ED03
_LAST = 2**63 - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _powers(size: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below size."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span, whatever its place."""
    power, inverse = _powers(max(1 << 12, 1 << (len(values) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a text, joined by one space, with their places."""

    def __init__(self, text: str | bytes | None):
        self.list = (text if isinstance(text, bytes) else (text or "").encode()).split()
        self.joined = b" ".join(self.list)
        sizes = np.fromiter(map(len, self.list), np.int64, len(self.list))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def digest(self, start: int, end: int) -> int:
        """Of the words start to end - 1, as a signed number of 64 bits."""
        data = self.joined[self.starts[start] : self.ends[end - 1]]
        return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def word_hashes(words: Words) -> np.ndarray:
    """Of each word; there must be one."""
    return mix(Spans(np.frombuffer(words.joined, np.uint8), words.starts, words.ends - words.starts).hash)


def occurrences(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fp, first window and number of windows of each occurrence, in order."""
    n = len(words.list)
    if n < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    each = word_hashes(words)
    at = np.arange(n - gram + 1)
    hashes = spans(each, at, at + gram)
    # the place of the least of each `wide` hashes, the first of equals
    wide, least, span = window - gram + 1, at, 1
    while span * 2 <= wide:
        a, b = least[: len(least) - span], least[span:]
        least, span = np.where(hashes[a] <= hashes[b], a, b), span * 2
    if wide > span:
        a, b = least[: len(least) - (wide - span)], least[wide - span :]
        least = np.where(hashes[a] <= hashes[b], a, b)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return hashes[least[first]], first, np.diff(np.append(first, len(least)))


#: Places from which on a digest's rows are not sent to one task; more if that lets over 2**16 digests through.
HOT = 4096


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """o: doc_id, or the largest number for null; x: a hash of the text, to tell rows that repeat an id apart. Ids that
    are no whole numbers are replaced by their rank."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if docs.schema[doc_id].dataType.typeName() in ("byte", "short", "integer", "long"):
        ranked = rows.withColumn("o", F.col("doc_id").cast("long"))
    else:
        sorted_ = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        places = materialize(sorted_.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "substring-ids")
        # one row a partition
        before = places.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        ranks = places.join(before, "part").select("doc_id", (F.col("before") + F.col("nth")).alias("o"))
        ranked = rows.join(ranks, "doc_id", "left")
    return ranked.select("doc_id", "text", F.coalesce("o", F.lit(_LAST)).alias("o"), F.xxhash64("text").alias("x"))


def find_occurrences(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            o, x, fp, digest, first, many = [], [], [], [], [], []
            for oi, xi, text in zip(part.column("o").to_pylist(), part.column("x").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = Words(text)
                f, a, n = occurrences(words, window)
                fp.append(f)
                first.append(a)
                many.append(n)
                o.append(np.full(len(f), oi))
                x.append(np.full(len(f), xi))
                digest.extend(words.digest(i, j) for i, j in zip(a.tolist(), (a + n + window - 1).tolist(), strict=True))
            join = lambda c, t: pa.array(np.concatenate(c).astype(t))
            fps = pa.array(np.concatenate(fp).view(np.int64))
            yield pa.RecordBatch.from_arrays([join(o, np.int64), join(x, np.int64), fps, pa.array(digest, pa.int64()), join(first, np.int32), join(many, np.int32)], ["o", "x", "fp", "digest", "a", "n"])

    return keyed.select("o", "x", "text").mapInArrow(run, "o long, x long, fp long, digest long, a int, n int")


class FingerprintIndex:
    """Runs of entries fp, digest, o, x, a, n (the first place of each), all places of which are in the shared folder.

    path: an index that another one wrote to `path`, or the place for a new one.
    """

    _COLUMNS = "fp bigint, digest bigint, o bigint, x bigint, a int, n int, last bigint, times bigint, owner bigint"

    def __init__(self, spark: SparkSession, max_runs: int = 3, path: str | None = None):
        self.spark, self.max_runs, self.path = spark, max_runs, path or scratch(spark, "substring-index")
        #: fp, o, x, a, n of the further places where the first document of a digest has it, of each batch.
        self.again: list[DataFrame] = []
        self.runs: list[tuple[str, str, int]] = []
        self.compactions = 0
        self.version = 0
        if path is None:
            delete_at_end(spark, self._made(self.path))
        else:
            self._open()

    def _made(self, path: str) -> str:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(where)
        return path

    def _open(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._made(self.path))
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)
        versions = [int(n[9:]) for f in files if (n := f.getPath().getName()).startswith("manifest-")]
        if versions:
            self.version = max(versions)
            for r in self.spark.read.schema("run string, buckets int, nth int").json(f"{self.path}/manifest-{self.version}").orderBy("nth").collect():
                self.runs.append((self._table(r["run"], r["buckets"]), r["run"], r["buckets"]))

    def _publish(self) -> None:
        """The list of runs under a new number; a job that breaks off before leaves the one before in force."""
        self.version += 1
        listed = [(run, buckets, i) for i, (_, run, buckets) in enumerate(self.runs)]
        self.spark.createDataFrame(listed, "run string, buckets int, nth int").coalesce(1).write.json(f"{self.path}/manifest-{self.version}")

    def _table(self, run: str, buckets: int) -> str:
        name = f"posmv_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({self._COLUMNS}) USING parquet CLUSTERED BY (fp, digest) SORTED BY (fp, digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return name

    def _written(self, rows: DataFrame) -> tuple[str, str, int]:
        run, buckets = f"run-{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = self._table(run, buckets)
        rows.select(*[c.split()[0] for c in self._COLUMNS.split(", ")]).write.insertInto(name)
        return name, run, buckets

    def _entries(self, name: str) -> DataFrame:
        """A run's own entries; its table also has the batch's rows that an older run owns."""
        return self.spark.table(name).filter("owner IS NULL")

    def entries(self) -> DataFrame:
        """All entries; each (fp, digest) is in one run only."""
        return functools.reduce(DataFrame.unionByName, (self._entries(name) for name, *_ in self.runs)).select("fp", "digest", "o", "x", "a", "n")

    def add(self, found: DataFrame) -> DataFrame:
        """Add a batch's occurrences and return those that are covered: o, x, a, n. All o of a batch are larger
        than those of earlier batches."""
        new = found.groupBy("fp", "digest").agg(F.min(F.struct("o", "x", "a", "n")).alias("first"), F.max("o").alias("last"), F.count("*").alias("times"))
        owner = F.lit(None).cast("long")
        for i, (name, *_) in enumerate(self.runs):
            new = new.join(self._entries(name).select("fp", "digest", F.col("o").alias(f"owner{i}")), ["fp", "digest"], "left")
            owner = F.coalesce(owner, F.col(f"owner{i}"))
        run = self._written(new.select("fp", "digest", "first.*", "last", "times", owner.alias("owner")))
        self.runs.append(run)

        entries = self.spark.table(run[0])
        shared = entries.select("fp", "digest", F.coalesce("owner", "o").alias("owner"), F.col("x").alias("fx"), F.col("a").alias("fa"), "last", "times").filter("owner < last OR times > 1")
        bound = max(HOT, (entries.agg(F.sum("times")).first()[0] or 0) >> 16)
        often = [r.digest for r in shared.filter(F.col("times") > bound).select("digest").distinct().collect()]  # at most 2**16
        hot = F.col("digest").isin(often)
        parts = [found.join(shared, ["fp", "digest"])] if not often else [
            found.filter(~hot).join(shared.filter(~hot), ["fp", "digest"]), found.filter(hot).join(F.broadcast(shared.filter(hot)), ["fp", "digest"])]
        # What is not covered is the owner's own: its first place is in the entry.
        placed = [x.filter("o > owner OR x != fx OR a != fa").select(F.expr("if(o = owner, fp, null)").alias("own"), "o", "x", "a", "n") for x in parts]
        matched = materialize(functools.reduce(DataFrame.unionByName, placed), "substring-covered")
        self.again.append(matched.filter("own IS NOT NULL").select(F.col("own").alias("fp"), "o", "x", "a", "n"))
        if len(self.runs) > self.max_runs:
            self._compact()
        self._publish()
        return matched.filter("own IS NULL").select("o", "x", "a", "n")

    def _compact(self) -> None:
        none = F.lit(None).cast("long")
        old, buckets = self.runs, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        merged = self.entries().repartition(buckets, "fp", "digest")
        self.runs = [self._written(merged.select("*", none.alias("last"), none.alias("times"), none.alias("owner")))]
        self.compactions += 1
        self._publish()
        for name, *_ in old:
            self.spark.sql(f"DROP TABLE {name}")
        discard(self.spark, *(f"{self.path}/{run}" for _, run, _ in old))

    def close(self) -> None:
        """Take the runs' tables out of the session; the index stays where it is."""
        for name, *_ in self.runs:
            self.spark.sql(f"DROP TABLE {name}")


def shared_windows(entries: DataFrame, again: DataFrame, keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of the first documents of each digest, the windows that also start in a smaller one: o, x, a, n = 1."""
    several = entries.groupBy("fp").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo < hi").select("fp")
    places = entries.select("fp", "o", "x", "a", "n").unionByName(again)
    asked = places.join(several, "fp").select("o", "x", F.struct("fp", "a", "n").alias("at"))
    lists = asked.groupBy("o", "x").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for o, x, text, at in zip(*(part.column(c).to_pylist() for c in ("o", "x", "text", "at")), strict=True):
                words = Words(text)
                for each in at:
                    rows.extend((o, x, each["fp"], words.digest(s, s + window), s) for s in range(each["a"], each["a"] + each["n"]))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["o", "x", "fp", "digest", "a"])

    # A text that a document repeats in a row of its own counts once: o and x are the same.
    texts = keyed.select("o", "x", "text")
    windows = texts.join(lists, ["o", "x"]).select("o", "x", "text", "at").mapInArrow(run, "o long, x long, fp long, digest long, a int")
    windows = materialize(windows, "substring-windows")
    discard(keyed.sparkSession)
    twice = windows.groupBy("fp", "digest").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo < hi")
    return windows.join(twice, ["fp", "digest"]).filter("o > lo").select("o", "x", "a", F.lit(1).alias("n"))


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, batches: int = 4, max_runs: int = 2) -> DataFrame:
    """Return doc_id, n_words, n_removed and kept_text (words joined by one space) of every row.

    A word is removed if a window of its document covers it that also starts in a document with a smaller
    doc_id; ids may be of any type that has an order. Null text has no words. A null doc_id comes after all others, as
    does the largest long; rows that repeat a doc_id are not smaller than each other. An empty table gives no rows;
    other columns are not read. The documents are added to a new index in `batches` by id.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs, doc_id, text)
    cuts = sorted(set(keyed.agg(F.percentile_approx("o", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    number = functools.reduce(lambda c, cut: c + (F.col("o") > cut).cast("int"), cuts, F.lit(0))
    found, place = stored(find_occurrences(keyed, window).withColumn("batch", number), "substring-occurrences", "batch")
    index = FingerprintIndex(spark, max_runs)
    covered = []
    for i in range(len(cuts) + 1):
        covered.append(index.add(found.filter(F.col("batch") == i).drop("batch")))
        discard(spark, f"{place}/batch={i}")
    again = functools.reduce(DataFrame.unionByName, index.again)
    spans_ = functools.reduce(DataFrame.unionByName, covered).unionByName(shared_windows(index.entries(), again, keyed, window))
    spans_ = materialize(spans_, "substring-spans")
    index.close()
    discard(spark, index.path)
    lists = spans_.groupBy("o", "x").agg(F.collect_list(F.struct("a", "n")).alias("at"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(rows, "text"):
            total, removed, kept = [], [], []
            for text, at in zip(part.column("text").to_pylist(), part.column("at"), strict=True):
                words = text.encode().split()
                total.append(len(words))
                if at.is_valid:
                    a, n = (np.asarray(at.values.field(i)) for i in (0, 1))
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, a + n + window - 1, -1)
                    words = list(compress(words, np.cumsum(step[:-1]) == 0))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = keyed.join(lists, ["o", "x"], "left").select("doc_id", "text", "at")
    return joined.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    return drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w != '') AS words FROM documents),
w AS (SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM d)),
f AS (SELECT seq, min(doc_id) AS first FROM w GROUP BY seq),
c AS (SELECT DISTINCT w.doc_id, w.s FROM w JOIN f USING (seq) WHERE f.first < w.doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM c),
x AS (SELECT doc_id, list(i) AS gone FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
             CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END AS kept
      FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
