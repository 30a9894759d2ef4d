"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of words has a bit for each language; an n-gram's hashes give a few rows whose AND is the mask of all
languages that contain it. A text's n-grams are looked up together, each language's bits are counted, and the
count is corrected for the false positives that the fill of that language's slice predicts. The language with
the largest corrected share wins.

A language contains an n-gram if the n-gram is among its most frequent ones and is not much rarer in it than
in another language, so that stray foreign lines in the training texts do no harm.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from posmv.llm.common import id_text_crc, slices

#: Lengths of n-grams; the filter's rows (2**BITS) and hashes.
SIZES, BITS, HASHES = (2, 3, 4), 20, 3
#: Training: texts for each language at most (about; they are drawn by a hash), n-grams kept for each
#: language at most, the least count, and how many times as frequent another language may have an n-gram.
TEXTS, GRAMS, LEAST, RATIO = 1500, 60_000, 3, 6.0
UND = "und"
_MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None, block: int = 1 << 18) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of the lower-cased letters, with one space for anything between, a block of the text at
    a time; none without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint32)
    some = codes != 0
    codes = codes[some | np.concatenate([[True], some[:-1]])]
    for k in range(0, len(codes), block):
        part = codes[k : k + block + max(SIZES) - 1].astype(np.uint64)
        h = part + np.uint64(1)
        for n in range(2, max(SIZES) + 1):
            if len(part) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(1)
            if n in SIZES:
                x = (h[:block] ^ np.uint64(n)) * _MULT
                x ^= x >> np.uint64(32)
                yield x * _MULT


class Filter:
    """table: rows of words; bit l of a row is language l's slice."""

    def __init__(self, languages: list[str], sets: list[np.ndarray]):
        self.languages = languages
        self.table = np.zeros((1 << BITS, max(1, -(-len(languages) // 64))), np.uint64)
        for l, hashes in enumerate(sets):
            for slot in self._slots(hashes):
                np.bitwise_or.at(self.table[:, l // 64], slot, np.uint64(1) << np.uint64(l % 64))
        fill = np.array([(self.table[:, l // 64] >> np.uint64(l % 64) & np.uint64(1)).mean() for l in range(len(languages))])
        self.false = fill**HASHES

    @staticmethod
    def _slots(hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(HASHES):
            yield (hashes >> np.uint64(k * 21)) & np.uint64((1 << BITS) - 1)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it (or seem to), as words of bits."""
        return functools.reduce(np.bitwise_and, (self.table[slot] for slot in self._slots(hashes)))

    def predict(self, text: str | None) -> tuple[str, float]:
        hits, total = np.zeros(len(self.languages)), 0
        for hashes in grams(text):
            total += len(hashes)
            masks = self.masks(hashes)
            for l in range(len(self.languages)):
                hits[l] += np.count_nonzero(masks[:, l // 64] & (np.uint64(1) << np.uint64(l % 64)))
        if not total or not self.languages:
            return UND, 0.0
        share = np.clip((hits / total - self.false) / (1 - self.false), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Filter:
    """Learn from about TEXTS texts of each language at most, drawn by a hash of the column `order`, with null
    languages and texts left out. The n-gram counts that reach the driver are bounded by GRAMS a language."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(order).alias("k")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Filter([], [])
    share = F.create_map(*[F.lit(x) for kv in ((k, min(1.0, TEXTS / n)) for k, n in sorted(counts.items())) for x in kv])
    drawn = rows.filter(F.pmod(F.xxhash64("k"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 500_000):
            by: dict[str, list[np.ndarray]] = {}
            for l, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by.setdefault(l, [np.empty(0, np.uint64)]).extend(grams(t))
            for l, hashes in by.items():
                gram, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(gram)), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    held = drawn.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = held.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = held.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = F.max("rate").over(Window.partitionBy("gram"))
    good = rate.withColumn("top", top).filter((F.col("n") >= LEAST) & (F.col("rate") * RATIO >= F.col("top")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    chosen = good.withColumn("rank", rank).filter(F.col("rank") <= GRAMS).select("lang", "gram").toArrow()
    languages = sorted(counts, key=lambda l: (-counts[l], l))
    lang, gram = np.array(chosen.column("lang").to_pylist(), object), chosen.column("gram").to_numpy().view(np.uint64)
    return Filter(languages, [gram[lang == l] for l in languages])


def identify(docs: DataFrame, model: Filter, doc_id: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """Return doc_id, lang_pred, score and the columns `more` of docs for every row, from the whole text.

    `und` with score 0 where the text is null or has no letter, or the model knows no language. Ties go to the
    language with more training texts. Repeated rows stay; an empty table gives no rows; columns that are not
    named are not read. The filter (2**BITS words for 64 languages) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shared.value.predict(t) for t in part.column("text").to_pylist()]
            kept = [part.column(c) for c in ("doc_id", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", *more, "lang_pred", "score"])

    return read.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return id_text_crc(doc_id) % 3 == 1


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learnt from those that are not held out."""
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: Below this share of known n-grams no learned language is accepted.
ACCEPT = 0.15


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the learned languages: rejected are texts without
    a letter and those with less than ACCEPT of their n-grams in the best language."""
    model = train(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [shared.value.predict(t) for t in part.column(at).to_pylist()]
            yield part.filter(pa.array([l != UND and s >= ACCEPT for l, s in found]))

    return docs.mapInArrow(run, docs.schema)
