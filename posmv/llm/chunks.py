"""Whole-text tokenization by way of distinct chunks.

Texts are cut only where the pre-tokenization pattern must begin a piece, so the ids of a text are the ids of its
chunks in order. Words repeat, so each worker keeps the ids of the chunks it has met, in arrays under a 64-bit hash (about
60 bytes a chunk, against some 200 in a dict), and encodes the distinct new ones of a slice of rows together. Where
hashes are equal the bytes are compared. Hashing, lookup and the joining of ids run over all chunks of a slice at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from posmv.llm.common import slices

#: Bytes of text that are worked on together, and chunks that a worker keeps before it lets go of those it met once.
SLICE, KEPT = 1_000_000, 1_000_000

_NONE = np.int32(-1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_bytes = np.arange(256)
#: Bytes that no white-space character begins with; ASCII letters, marks and all visible ASCII.
_SOLID = ((_bytes > 0x20) & (_bytes < 0x7F)) | ((_bytes > 0xC2) & ~np.isin(_bytes, (0xE1, 0xE2, 0xE3)))
_LETTER = (((_bytes | 32) >= 97) & ((_bytes | 32) <= 122)) & (_bytes < 128)
_SEEN = (_bytes > 0x20) & (_bytes < 0x7F)
_MARK = _SEEN & ~_LETTER & ~((_bytes >= 48) & (_bytes <= 57))


def cuts(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """_cuts, a block at a time with the bytes around it."""
    out = np.empty(len(data), bool)
    for k in range(0, len(data), SLICE):
        low, high = max(0, k - 2), min(len(data), k + SLICE + 1)
        out[k : k + SLICE] = _cuts(data[low:high], last[(last >= low) & (last < high)] - low)[k - low : k - low + SLICE]
    return out


def _cuts(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where a chunk may begin: at a space before a visible character, where a mark follows a letter, and around a
    single newline between visible characters. last: the last byte of each text, whose successor is another's.

    A space run followed by a visible character ends a piece before its last space; letters end a piece before a
    mark; a lone newline is a piece. In each case the pattern, which never looks back, goes on as it would at the
    beginning of a text, and what lies before ends as it would at the end of one.
    """
    out = np.zeros(len(data) + 1, bool)
    after = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    space = (data == 0x20) & _SOLID[after]
    line = (data == 0x0A) & _SEEN[after]
    space[last], line[last] = False, False
    line[1:] &= _SEEN[data[:-1]]
    out[:-1] = space | line
    out[1:] |= line
    out[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return out[:-1]


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _grown(held: np.ndarray, least: int) -> np.ndarray:
    return held if least <= len(held) else np.concatenate([held, np.zeros(max(least, 2 * len(held)) - len(held), held.dtype)])


_KEEP = np.array([2**64 - 1] + [2 ** (8 * n) - 1 for n in range(1, 8)], np.uint64)


class Spans:
    """Spans of bytes as words of eight, the last one filled up with zeros, and a hash of each span."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        low, high = int(starts[0]), int(starts[-1] + sizes[-1])
        self.starts, self.sizes = starts - low, sizes
        self.data = np.zeros(high - low + 8, np.uint8)
        self.data[: high - low] = data[low:high]
        self.at = np.ndarray(high - low + 1, np.uint64, self.data, strides=(1,))
        self.hash = sizes.astype(np.uint64) * _MULT
        todo, k = np.arange(len(starts)), 0
        while len(todo):
            h = (self.hash[todo] ^ self.word(todo, k)) * _MULT
            self.hash[todo] = h ^ (h >> np.uint64(29))
            k += 1
            todo = todo[sizes[todo] > 8 * k]
        self.hash *= _MULT

    def word(self, which: np.ndarray, k: int) -> np.ndarray:
        """Number k of each of these spans, all of which have more than 8 k bytes."""
        left = self.sizes[which] - 8 * k
        return self.at[self.starts[which] + 8 * k] & _KEEP[np.where(left < 8, left, 0)]

    def words(self, which: np.ndarray) -> np.ndarray:
        """All words of these spans, one span after the other."""
        many = -(-self.sizes[which] // 8)
        ends = np.cumsum(many)
        out, todo, k = np.empty(ends[-1], np.uint64), np.arange(len(which)), 0
        while len(todo):
            out[(ends - many)[todo] + k] = self.word(which[todo], k)
            k += 1
            todo = todo[many[todo] > k]
        return out

    def equal(self, which: np.ndarray, words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether these spans have as many bytes as sizes and the words that begin at `at`."""
        same = self.sizes[which] == sizes
        todo, k = np.flatnonzero(same), 0
        while len(todo):
            ok = words[at[todo] + k] == self.word(which[todo], k)
            same[todo[~ok]] = False
            k += 1
            todo = todo[ok & (sizes[todo] > 8 * k)]
        return same


class ChunkEncoder:
    """encode_many gives the ids of each string, as bytes of int32.

    apart: byte strings that the vocabulary takes out of a text before its pattern is applied. Each is a chunk of its
    own, the leftmost and longest first.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], kept: int = KEPT, apart: list[bytes] = ()):
        self.encode_many, self.kept = encode_many, kept
        self.apart = re.compile(b"|".join(map(re.escape, sorted(apart, key=len, reverse=True)))) if apart else None
        self._clear()

    def _clear(self, room: int = 1 << 16) -> None:
        self.count = 0
        self.hash = np.zeros(room, np.uint64)
        self.start, self.size = np.zeros(room, np.int64), np.zeros(room, np.int32)
        self.at, self.length = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.used = np.zeros(room, bool)
        self.ids, self.ids_used = np.zeros(1 << 18, np.int32), 0
        self.words, self.words_used = np.zeros(1 << 17, np.uint64), 0
        self._index(room * 2)

    def _shrink(self) -> None:
        """Let go of the chunks that were met in one slice only since the last time; of all, if more than half would stay."""
        stay = np.flatnonzero(self.used[: self.count])
        if not len(stay) or 2 * len(stay) > self.kept:
            return self._clear()
        hash_, size, length = self.hash[stay], self.size[stay], self.length[stay]
        many = -(-length // 8)
        ids, words = _gather(self.ids, self.start[stay], size.astype(np.int64)), _gather(self.words, self.at[stay], many)
        room = 1 << max(16, len(stay).bit_length())
        self._clear(room)
        n = len(stay)
        self.hash[:n], self.size[:n], self.length[:n] = hash_, size, length
        self.start[:n], self.at[:n] = np.cumsum(size) - size, np.cumsum(many) - many
        self.ids, self.words = _grown(self.ids, len(ids)), _grown(self.words, len(words))
        self.ids[: len(ids)], self.words[: len(words)] = ids, words
        self.count, self.ids_used, self.words_used = n, len(ids), len(words)
        self._place(np.arange(n))

    def _index(self, places: int) -> None:
        """Open addressing over the kept chunks."""
        self.shift, self.mask = np.uint64(64 - (places.bit_length() - 1)), np.uint64(places - 1)
        self.slots = np.full(places, _NONE)
        self._place(np.arange(self.count))

    def _place(self, todo: np.ndarray) -> None:
        at = self.hash[todo] >> self.shift
        while len(todo):
            free = np.flatnonzero(self.slots[at] == _NONE)
            # of those that want one slot the last one written has it
            self.slots[at[free]] = todo[free]
            rest = self.slots[at] != todo
            todo, at = todo[rest], (at[rest] + np.uint64(1)) & self.mask

    def _find(self, spans: "Spans", asked: np.ndarray) -> np.ndarray:
        """The kept chunk with the same bytes as each of the spans asked for, or _NONE."""
        found = np.full(len(asked), _NONE)
        at, todo = spans.hash[asked] >> self.shift, np.arange(len(asked))
        while len(todo):
            held = self.slots[at]
            some = held != _NONE
            todo, at, held = todo[some], at[some], held[some]
            hit = self.hash[held] == spans.hash[asked[todo]]
            hit[hit] = spans.equal(asked[todo[hit]], self.words, self.at[held[hit]], self.length[held[hit]])
            found[todo[hit]] = held[hit]
            todo, at = todo[~hit], (at[~hit] + np.uint64(1)) & self.mask
        return found

    def _add(self, spans: "Spans", new: np.ndarray, ids: list[bytes]) -> None:
        sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
        flat, words = np.frombuffer(b"".join(ids), np.int32), spans.words(new)
        many = -(-spans.sizes[new] // 8)
        n = self.count + len(ids)
        if n > len(self.hash):
            for name in ("hash", "start", "size", "at", "length", "used"):
                setattr(self, name, _grown(getattr(self, name), n))
        self.ids, self.words = _grown(self.ids, self.ids_used + len(flat)), _grown(self.words, self.words_used + len(words))
        to = slice(self.count, n)
        self.hash[to], self.size[to], self.length[to] = spans.hash[new], sizes, spans.sizes[new]
        self.start[to] = self.ids_used + np.cumsum(sizes) - sizes
        self.at[to] = self.words_used + np.cumsum(many) - many
        self.ids[self.ids_used : self.ids_used + len(flat)] = flat
        self.words[self.words_used : self.words_used + len(words)] = words
        added = np.arange(self.count, n)
        self.count, self.ids_used, self.words_used = n, self.ids_used + len(flat), self.words_used + len(words)
        if 2 * n > len(self.slots):
            self._index(1 << (4 * n).bit_length())
        else:
            self._place(added)

    def _kept(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The kept chunk of each span of data; new ones are encoded first."""
        spans = Spans(data, starts, sizes)
        found = self._find(spans, np.arange(len(starts)))
        self.used[found[found != _NONE]] = True
        if (new := np.flatnonzero(found == _NONE)).size and self.count > self.kept:
            self._shrink()
            found = self._find(spans, np.arange(len(starts)))
            new = np.flatnonzero(found == _NONE)
        while new.size:
            # one of each hash; what has the same hash and other bytes is still missing afterwards
            one = new[np.unique(spans.hash[new], return_index=True)[1]]
            raw = [data[s : s + n].tobytes().decode() for s, n in zip(starts[one].tolist(), sizes[one].tolist(), strict=True)]
            self._add(spans, one, self.encode_many(raw))
            found[new] = self._find(spans, new)
            new = new[found[new] == _NONE]
        return found

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: texts as bytes of UTF-8 one after the other; offsets: where each begins, and the end. Returns all
        ids and where each text's begin."""
        bounds = np.unique(offsets)
        if len(bounds) < 2:
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        begin = cuts(data, bounds[1:] - 1)
        begin[bounds[:-1]] = True
        if self.apart:
            for low, high in zip(bounds.tolist(), bounds[1:].tolist()):
                for m in self.apart.finditer(data, low, high):
                    begin[m.start() : m.end()] = False
                    begin[m.start()] = True
                    if m.end() < len(data):
                        begin[m.end()] = True
        starts = np.flatnonzero(begin)
        sizes = np.diff(np.append(starts, len(data)))
        out, many = [], np.empty(len(starts), np.int64)
        edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), SLICE)), len(starts)))
        for a, b in zip(edges, edges[1:]):
            found = self._kept(data, starts[a:b], sizes[a:b])
            n = many[a:b] = self.size[found]
            out.append(_gather(self.ids, self.start[found], n))
        return np.concatenate(out), np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])[np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is empty text."""
        raw = [(t or "").encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        ids, at = self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [ids[a:b] for a, b in zip(at, at[1:])]


def encode_batches(batches: Iterator[pa.RecordBatch], encoder: ChunkEncoder, end: int | None = None) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, ids), with the id `end` after each row's ids."""
    for part in slices(batches, "text", SLICE):
        text = part.column("text").fill_null("")
        data, offsets = text_bytes(text)
        ids, at = encoder.encode_bytes(data, offsets)
        if end is not None:
            ids, at = np.insert(ids, at[1:], np.int32(end)), at + np.arange(len(at))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])


def text_bytes(text: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array without nulls, and their offsets; no copy."""
    wide = pa.types.is_large_string(text.type)
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return held, offsets - offsets[0]
