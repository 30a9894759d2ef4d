"""Byte-level BPE encoding and decoding in numpy.

Distinct pieces are put into matrices of token ids, padded within buckets of similar length. In each round
every row merges its leftmost pair of least rank; only the two pairs beside the merge are looked up anew, in
a hash table of all pairs, and rows without a pair leave the matrix. A piece of over LONG bytes is a matrix by
itself, with its parts as rows, so that a round costs the root of its length and not its length.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.chunks import ChunkEncoder, encode_batches

NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing from a pair of ids to the id of their concatenation, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(4 * max(len(rank), 1) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, _EMPTY), np.full(1 << bits, NONE)
        keys = self._key(left, right)
        slot = (keys * _MULT) >> self.shift
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == _EMPTY]
            put = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where the pair has none or an id is negative (padding)."""
        out = np.full(left.shape, NONE)
        ok = (left >= 0) & (right >= 0)
        keys = self._key(left[ok], right[ok])
        slot = (keys * _MULT) >> self.shift
        found = np.full(len(keys), NONE)
        todo = np.arange(len(keys))
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            found[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != _EMPTY)]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        out[ok] = found
        return out


class ByteBPE:
    LONG, CELLS = 512, 1 << 19

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        size = max(self.tokens, default=-1) + 1
        self.sizes = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.split = regex.compile(_pattern()).findall
        # a worker lives on through the stages of a pipeline, and what is kept with it
        self.chunks = ChunkEncoder(self.encode_strings, kept=1 << 18)

    def encode_strings(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of int32."""
        pieces = [[p.encode() for p in self.split(t)] for t in texts]
        distinct = sorted(set().union(*pieces)) if pieces else []
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        return [b"".join(map(ids.__getitem__, p)) for p in pieces]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > self.LONG:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(-(-len(p) // 4) * 4 if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, self.CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.where(np.arange(width) < sizes[:, None], self.of_byte[raw], np.int32(-1))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(1)  # the first of equal ranks: the leftmost
            each = np.arange(len(row))
            best = ranks[each, at]
            if (done := best == NONE).any():
                for r, x in zip(row[done], ids[done], strict=True):
                    out[r] = x[x >= 0].tobytes()
                row, ids, ranks, at, best = row[~done], ids[~done], ranks[~done], at[~done], best[~done]
                each = np.arange(len(row))
                if not len(row):
                    break
            ids[each, at] = best
            keep = np.arange(ids.shape[1] - 1)
            shifted = keep + (keep > at[:, None])
            ids = np.take_along_axis(ids, shifted, 1)
            if not ids.shape[1] - 1:
                ranks = np.full((len(row), 1), NONE)
                continue
            pad = np.concatenate([ranks, np.full((len(row), 1), NONE)], 1)
            ranks = np.take_along_axis(pad, shifted[:, :-1] if ids.shape[1] > 1 else shifted, 1)
            last = ids.shape[1] - 1
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < last))
                ranks[ok, side[ok]] = self.pairs(ids[ok, side[ok]], ids[ok, side[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece, as a matrix whose rows are its parts: the leftmost least rank of each row is
        kept, a round looks through those and one row, and the matrix is compacted when half its ids are gone."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        width = max(16, math.isqrt(len(ids)))
        while True:
            n = len(ids)
            rows = -(-n // width)
            ranks = np.full(rows * width, NONE)
            ranks[: n - 1] = self.pairs(ids[:-1], ids[1:])
            grid = ranks.reshape(rows, width)
            least = grid.min(1)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            own, gone = ids.tolist(), 0
            while 2 * gone <= n:
                row = int(least.argmin())
                if (best := least[row]) == NONE:
                    break
                i = row * width + int(grid[row].argmin())
                j, gone = after[i], gone + 1
                own[i], own[j], k = int(best), -1, after[j]
                after[i] = k
                ranks[j] = NONE
                ranks[i] = self.rank(own[i], own[k]) if k < n else NONE
                touched = {row, j // width}
                if k < n:
                    before[k] = i
                if (h := before[i]) >= 0:
                    ranks[h] = self.rank(own[h], own[i])
                    touched.add(h // width)
                for r in touched:
                    least[r] = grid[r].min()
            ids = np.array([x for x in own if x >= 0], np.int32)
            if 2 * gone <= n:
                return ids.tobytes()

    def rank(self, left: int, right: int) -> int:
        return self.ranks.get(self.tokens[left] + self.tokens[right], NONE)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.chunks.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_all(ids)[0].tobytes()

    def decode_all(self, ids: np.ndarray, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where those of each id begin, and the end."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes[ids])])
        out = np.empty(at[-1], np.uint8)
        for k in range(0, len(ids), block):
            part = ids[k : k + block]
            low = at[k : k + len(part)]
            high = at[k + len(part)]
            out[low[0] : high] = self.pool[np.repeat(self.starts[part] - (low - low[0]), self.sizes[part]) + np.arange(high - low[0])]
        return out, at


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def load(path: str) -> ByteBPE:
    """One coder for each worker and rank file."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def bpe_encode(docs: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return doc_id and ids, an array of ints, of each whole text.

    Null and empty texts have no ids; repeated rows stay; an empty table gives no rows. Other columns are not
    read, whatever their names. ranks: a file of base64 tokens and ranks on every machine.
    """
    path = ranks or default_ranks()
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(lambda batches: encode_batches(batches, load(path).chunks), f"doc_id {kind}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], coder: ByteBPE) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) with decoded, the bytes of the ids; parts of about 250,000 ids, one row at least."""
    for batch in batches:
        all_ids = batch.column("ids")
        ends = all_ids.offsets.to_numpy()[1:].astype(np.int64) - all_ids.offsets[0].as_py()
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + 250_000, "right")))
            part = batch.slice(start, stop - start)
            ids = part.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            data, at = coder.decode_all(flat)
            where = at[offsets - offsets[0]]
            found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(where.tobytes()), pa.py_buffer(data)])
            found = pc.if_else(ids.is_valid(), found, pa.scalar(None, pa.large_binary())).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, found], ["doc_id", "ids", "decoded"])
            start = stop


def bpe_decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Return the columns of `encoded` (doc_id, ids) and decoded, the bytes of the ids; null ids give null."""
    path = ranks or default_ranks()
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decoded(batches, load(path)), f"doc_id {kind}, ids array<int>, decoded binary")


def bpe_round_trip(docs: DataFrame, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """bpe_decode of bpe_encode, by one worker for each task instead of one for each step."""
    path = ranks or default_ranks()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        return _decoded(encode_batches(batches, coder.chunks), coder)

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded documents."""
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return bpe_round_trip(docs, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
