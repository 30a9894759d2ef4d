"""Scoring by a Brown class-based bigram model.

p(w | previous) = p(class of w | class of previous) * p(w | class of w). Exchange clustering assigns the classes, in two
steps of which the second is distributed:

* the UNITS most frequent words and the end of a text are exchanged between the classes, one by one, on the matrix
  of their bigrams over the whole training corpus, until a round moves none;
* every other training word goes to the class that its own contexts make most likely, given the units' classes: it is the
  exchange step for that word, on the counts of the classes of the units to its left and right over the whole
  corpus. As it looks at units alone, moving one word changes nothing for another, and one round settles all.

A word with fewer than LEAST such neighbours, or not seen in training, takes the class that the contexts of all words with
its last three letters make most likely (SUFFIXES groups of endings by hash).

Transitions are smoothed by Witten-Bell over class frequencies, emissions by adding one with one place a class for
a word that was not seen.

Counts of all words and contexts stay distributed. The HEAD most frequent words go to the executors (a bound of a few tens
of MB); they have numbers, and texts are turned into numbers once. Other words are joined with their counts and classes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posmv.llm.common import discard, id_text_crc, materialize, slices, stored

UNITS, CLASSES, HEAD, LEAST, SUFFIXES = 1023, 48, 200_000, 4, 4096
#: Distinct words that a task counts before it passes them on, and rows of a batch.
_HELD, _ROWS = 300_000, 500_000
#: The end of a text among the words; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words without the end, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """text to (word, n), ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        seen: Counter = Counter()
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                seen.update(tokens(text))
            seen[END] += part.num_rows
            if len(seen) > _HELD:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The words of the largest counts, the largest first: as many as there are down to a count at which they are at
    most `most`; and that count. Only a table of how many words have each count, and those words, reach the driver."""
    table = counts.groupBy("n").agg(F.count("*").alias("words")).toArrow()
    n, words = (table.column(c).to_numpy() for c in ("n", "words"))
    order = np.argsort(-n)
    fit = order[np.cumsum(words[order]) <= most]
    if not len(fit):
        return {}, 2**62
    least = int(n[fit[-1]])
    top = counts.filter(F.col("n") >= least).toArrow()
    pairs = zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)
    return dict(sorted(pairs, key=lambda p: (-p[1], p[0]))), least


def encoded(docs: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """doc_id, text, learns to row, doc_id, learns, ids (the words' numbers in head, -1 for others, and 0 for the end) and
    others (the words that have none, in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(list(head))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = {w: i for i, w in enumerate(shared.value)}.get
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            ids, others, ends, other_ends = [], [], [], []
            for text in part.column("text").to_pylist():
                words = tokens(text)
                own = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                others.extend(words[i] for i in np.flatnonzero(own < 0).tolist())
                ids += (own, np.zeros(1, np.int32))
                ends.append(len(words) + 1)
                other_ends.append(len(others))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *ends]), pa.int32()), pa.array(np.concatenate(ids)))
            rest = pa.ListArray.from_arrays(pa.array([0, *other_ends], pa.int32()), pa.array(others, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ends))), part.column("doc_id"), part.column("learns"), lists, rest], ["row", "doc_id", "learns", "ids", "others"])
            row += len(ends)

    return docs.mapInArrow(run, f"row long, doc_id {kind}, learns boolean, ids array<int>, others array<binary>")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each list's begin, and the end."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _counted(rows: DataFrame, column: str, size: int, pairs) -> np.ndarray:
    """Counts of pairs of numbers below size over all lists of a column: a list's first number follows a 0. pairs
    gives the arrays of left and right numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            left, right = pairs(batch.column(0))
            total += np.bincount(left * size + right, minlength=size * size)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    found = rows.select(column).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def unit_bigrams(rows: DataFrame, size: int) -> np.ndarray:
    """Counts of the bigrams of numbers below size."""

    def pairs(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        right, _ = _flat(lists)
        left = np.concatenate([np.zeros(1, right.dtype), right[:-1]])  # every list ends with 0
        ok = (left >= 0) & (left < size) & (right >= 0) & (right < size)
        return left[ok].astype(np.int64), right[ok]

    return _counted(rows, "ids", size, pairs)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 30) -> np.ndarray:
    """The class of each unit: units move, one by one, to the class that gives the class bigrams the largest
    likelihood, until a round moves none. Unit 0, the end, is class 0 and stays alone."""
    n = bigrams.astype(np.float64)
    size = len(n)
    weight = n.sum(0)
    order = np.argsort(-weight[1:], kind="stable") + 1
    of = np.zeros(size, np.int64)
    of[order] = 1 + np.arange(size - 1) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    grid = member.T @ n @ member
    right, left = n @ member, n.T @ member
    rows, cols = grid.sum(1), grid.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a = of[w]
            r, l, own = right[w].copy(), left[w].copy(), n[w, w]
            # without w; its own pairs count neither as right nor as left neighbours
            r[a] -= own
            l[a] -= own
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= own
            rw, cw = r.sum() + own, l.sum() + own
            rows[a] -= rw
            cols[a] -= cw
            gain = (_f(grid + r) - _f(grid)).sum(1) + (_f(grid + l[:, None]) - _f(grid)).sum(0)
            d = np.diagonal(grid)
            gain += _f(d + r + l + own) - _f(d + r) - _f(d + l) + _f(d)
            gain -= _f(rows + rw) - _f(rows) + _f(cols + cw) - _f(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += own
            rows[b] += rw
            cols[b] += cw
            if b != a:
                moved += 1
                of[w] = b
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moved:
            break
    return of


def contexts(rows: DataFrame, of: np.ndarray, head: int) -> DataFrame:
    """id, word, ctx, n: how often each word that is no unit has a unit of each class to its left (ctx is the class) and
    to its right (CLASSES more). Words with a number have id, others word."""
    shared = rows.sparkSession.sparkContext.broadcast(of.astype(np.int16))
    classes = CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        units, total = len(of), np.zeros(max(0, head - len(of)) * 2 * classes, np.int32)

        def out(ids, words, ctx, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(words, pa.binary()), pa.array(ctx, pa.int16()), pa.array(n, pa.int64())], ["id", "word", "ctx", "n"])

        for batch in _parts(batches):
            ids, _ = _flat(batch.column("ids"))
            words = batch.column("others").flatten().to_pylist()
            unit = (ids >= 0) & (ids < units)
            cls = np.where(unit, of[np.where(unit, ids, 0)], -1)
            left, right = np.concatenate([[0], cls[:-1]]), np.concatenate([cls[1:], [-1]])  # nothing follows the end
            rare: Counter = Counter()
            which = np.cumsum(ids < 0) - 1
            for side, near in enumerate((left, right)):
                known = (ids >= units) & (near >= 0)
                np.add.at(total, (ids[known] - units).astype(np.int64) * 2 * classes + side * classes + near[known], 1)
                known = (ids < 0) & (near >= 0)
                rare.update(zip(map(words.__getitem__, which[known].tolist()), (side * classes + near[known]).tolist(), strict=True))
            if rare:
                yield out(np.full(len(rare), -1), [w for w, _ in rare], [c for _, c in rare], list(rare.values()))
        cells = np.flatnonzero(total)
        for k in range(0, len(cells), _ROWS):
            part = cells[k : k + _ROWS]
            yield out(part // (2 * classes) + units, [None] * len(part), part % (2 * classes), total[part])

    found = rows.select("ids", "others").mapInArrow(run, "id int, word binary, ctx short, n long")
    summed = found.groupBy("id", "word", "ctx").agg(F.sum("n").alias("n"))
    return summed.groupBy("id", "word").agg(F.collect_list(F.struct("ctx", "n")).alias("seen"))  # 2 * CLASSES at most


def suffix(word: bytes, groups: int) -> int:
    """The group of a word's last three letters."""
    return zlib.crc32(word.decode()[-3:].encode()) % groups


def _seen(lists: pa.ListArray, classes: int) -> np.ndarray:
    """(words, 2 * classes) counts of contexts."""
    at = lists.offsets.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(at))
    out = np.zeros((len(lists), 2 * classes))
    inner = lists.flatten()
    out[row, inner.field("ctx").to_numpy()] = inner.field("n").to_numpy()
    return out


class Fit:
    """What a word gains in each class by its contexts, given the bigrams of the units' classes."""

    def __init__(self, grid: np.ndarray):
        rows, cols, total = grid.sum(1), grid.sum(0), max(1, grid.sum())
        self.left = np.log((grid + 0.5) * total / ((rows + 1)[:, None] * (cols + 1)))
        self.right = np.log((grid + 0.5) * total / ((rows + 1)[:, None] * (cols + 1))).T

    def best(self, seen: np.ndarray) -> np.ndarray:
        """The class of each row of counts; 0 is the end's own."""
        n = len(self.left)
        gain = seen[:, :n] @ self.left + seen[:, n:] @ self.right
        gain[:, 0] = -np.inf
        return gain.argmax(1)


def assigned(found: DataFrame, fit: Fit, head: dict[bytes, int]) -> tuple[DataFrame, np.ndarray]:
    """The contexts' words with their class (id, word, cls; those with LEAST neighbours), and the class of each group of
    endings."""
    shared = found.sparkSession.sparkContext.broadcast((fit, list(head)))
    classes, groups, least = CLASSES, SUFFIXES, LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = _seen(batch.column("seen"), classes)
            whole = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("word"), pa.array(shared.value[0].best(seen).astype(np.int16))], ["id", "word", "cls"])
            yield whole.filter(pa.array(seen.sum(1) >= least))

    def endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros((groups, 2 * classes)), shared.value[1]
        for batch in batches:
            words = (names[i] if w is None else w for i, w in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist(), strict=True))
            np.add.at(total, [suffix(w, groups) for w in words], _seen(batch.column("seen"), classes))
        group, ctx = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((group * 2 * classes + ctx).astype(np.int32)), pa.array(total[group, ctx].astype(np.int64))], ["cell", "n"])

    summed = found.mapInArrow(endings, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(groups * 2 * classes)
    total[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return found.mapInArrow(run, "id int, word binary, cls short"), fit.best(total.reshape(groups, -1))


class Words:
    """Classes and log counts of the head's words by their number, and the class of endings."""

    def __init__(self, head: dict[bytes, int], of: np.ndarray, endings: np.ndarray):
        self.of, self.endings = of.astype(np.int64), endings
        self.logs = np.log10(np.fromiter(head.values(), np.float64, len(head)) + 1)
        self.known = np.fromiter(head.values(), np.int64, len(head)) > 0

    def path(self, ids: np.ndarray, others: list[bytes], found: list[dict]) -> tuple[np.ndarray, float, int]:
        """The class of each token, the sum of the log counts, and the known tokens; found: k, n and cls of
        those of `others` that training has."""
        path, logs, known = self.of[ids], self.logs[ids], self.known[ids]
        if others:
            rest = np.flatnonzero(ids < 0)
            cls, n = np.array([self.endings[suffix(w, len(self.endings))] for w in others]), np.zeros(len(others))
            for f in found:
                cls[f["k"]], n[f["k"]] = f["cls"], f["n"]
            path[rest], logs[rest], known[rest] = cls, np.log10(n + 1), n > 0
        return path, float(logs.sum()), int(known.sum())


class Model:
    """Log transitions between classes and log totals of their emissions."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray, total: np.ndarray):
        base = (total + 1) / (total.sum() + len(total))
        kinds = (pairs > 0).sum(1, keepdims=True)
        seen = pairs.sum(1, keepdims=True)
        self.step = np.log10(np.where(seen > 0, (pairs + kinds * base) / np.maximum(seen + kinds, 1), base))
        self.emission = np.log10(total + words + 1)

    def score(self, path: np.ndarray) -> float:
        """Of the classes of a text's tokens, without the words' log counts."""
        return float(self.step[np.concatenate([[0], path[:-1]]), path].sum() - self.emission[path].sum())


def fitted(docs: DataFrame) -> tuple[DataFrame, Model, int, int]:
    """doc_id, text, learns to row, doc_id, learns, path, logs and known of every text, the model, N and V."""
    spark = docs.sparkSession
    learning = docs.filter("learns")
    counts = materialize(word_counts(learning), "word-counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = learning.count()
    top, least = most_frequent(counts, HEAD)
    head = {END: ends} | {w: n for w, n in top.items() if w != END}
    rows, place = stored(encoded(docs, head), "encoded")
    units = min(len(head), UNITS + 1)
    trained = rows.filter("learns")
    bigrams = unit_bigrams(trained, units)
    of = exchange(bigrams, CLASSES)
    member = np.zeros((units, CLASSES))
    member[np.arange(units), of] = 1
    found, place2 = stored(contexts(trained, of, len(head)), "contexts")
    by_context, endings = assigned(found, Fit(member.T @ bigrams @ member), head)
    by_context, place3 = stored(by_context, "classes")

    numbered = by_context.filter("id >= 0").select("id", "cls").toArrow()  # HEAD rows at most
    head_of = np.concatenate([of, [endings[suffix(w, SUFFIXES)] for w in list(head)[units:]]]).astype(np.int64)
    head_of[numbered.column("id").to_numpy()] = numbered.column("cls").to_numpy()
    shared = spark.sparkContext.broadcast(Words(head, head_of, endings))
    ending = spark.sparkContext.broadcast(endings)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = [ending.value[suffix(w, len(ending.value))] if c is None else c for w, c in zip(batch.column("word").to_pylist(), batch.column("cls").to_pylist(), strict=True)]
            yield batch.set_column(2, "cls", pa.array(cls, pa.int16()))

    beyond = counts.filter((F.col("n") < least) & (F.col("word") != F.lit(bytearray(END))))
    beyond = materialize(beyond.join(by_context.filter("id < 0").select("word", "cls"), "word", "left").mapInArrow(fill, "word binary, n long, cls short"), "rare-words")
    held = beyond.groupBy("cls").agg(F.count("*").alias("words"), F.sum("n").alias("n")).toArrow()
    class_words = np.bincount(head_of, np.fromiter(head.values(), np.int64) > 0, minlength=CLASSES)
    class_tokens = np.bincount(head_of, np.fromiter(head.values(), np.float64), minlength=CLASSES)
    class_words[held.column("cls").to_numpy()] += held.column("words").to_numpy()
    class_tokens[held.column("cls").to_numpy()] += held.column("n").to_numpy()

    asked = rows.select("row", F.posexplode("others").alias("k", "word"))
    answers = asked.join(beyond, "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "cls")).alias("found"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, at = _flat(batch.column("ids"))
            out = [shared.value.path(ids[a:b], o, f or []) for a, b, o, f in zip(at, at[1:], batch.column("others").to_pylist(), batch.column("found").to_pylist())]
            columns = [pa.array([x[0].astype(np.uint8).tobytes() for x in out], pa.binary()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("learns"), *columns], ["doc_id", "learns", "path", "logs", "known"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = rows.join(answers, "row", "left").select("doc_id", "learns", "ids", "others", "found").mapInArrow(paths, f"doc_id {kind}, learns boolean, path binary, logs double, known long")
    whole = materialize(whole, "paths")
    discard(spark, place, place2, place3)

    def pairs(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        right = np.frombuffer(b"".join(texts.to_pylist()), np.uint8).astype(np.int64)
        return np.concatenate([np.zeros(min(1, len(right)), np.int64), right[:-1]]), right

    return whole, Model(_counted(whole.filter("learns"), "path", CLASSES, pairs), class_words, class_tokens), int(total), int(vocabulary)


def score(docs: DataFrame, learns: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of docs, by the
    model of all texts of the rows where `learns` is true.

    Null text is the end alone. Repeated rows stay; an empty table gives no rows; without training texts every
    token is unknown. Other columns are not read, but for those that `learns` reads.
    """
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))
    rows, model, total, vocabulary = fitted(read)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = read.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [shared.value.score(np.frombuffer(p, np.uint8).astype(np.int64)) for p in batch.column("path").to_pylist()]
            sizes = [len(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("known"), batch.column("logs"), pa.array(rest, pa.float64())], ["doc_id", "n_tokens", "n_known", "logs", "rest"])

    found = rows.select("doc_id", "path", "known", "logs").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, logs double, rest double")
    value = F.col("logs") + F.col("rest")
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(total + vocabulary + 1)))
    return found.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), value.alias("score"), F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"))


def held_out(doc_id: str = "doc_id"):
    return id_text_crc(doc_id) % 7 == 2


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from those that are not held out."""
    found = score(docs, ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
