"""Media columns: payloads stored as WAV, spectra of their samples, and peak-pair fingerprints.

A payload is kept losslessly as unsigned 8-bit mono samples and read back by the wave module. Its short-time
Fourier transform takes Hann windows of FRAME samples every HOP; the strongest bin of each frequency band that
is a local maximum in time is a peak; each peak is paired with the later ones of its frame and with those of the
next frames. A pair gives a code (both bins and the frames between) at the time of its first peak: two arrays of equal length, in
order of time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posmv.llm.common import slices

RATE, FRAME, HOP = 8000, 256, 128
#: Edges of the bands in bins; frames from a peak to the last that it is paired with.
BANDS, AHEAD = (1, 6, 12, 24, 48, 96, 129), 3
#: Frames that are transformed at a time.
BLOCK = 2048


def padded(data: bytes, unit: int = 64) -> bytes:
    """With bytes 0 up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes (frames, bins) of the STFT, a block of frames at a time; the end is padded with silence."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
    for k in range(0, frames, BLOCK):
        n = min(BLOCK, frames - k)
        part = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
        held = samples[k * HOP : k * HOP + len(part)]
        part[: len(held)] = held
        rows = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        yield np.abs(np.fft.rfft((rows.astype(np.float32) - 128) * window, axis=1)).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """The bin of each frame and band's peak, or 0 where the band has none."""
    tops, sizes = [], []
    for block in spectrum(samples):
        bands = [block[:, a:b] for a, b in zip(BANDS, BANDS[1:])]
        tops.append(np.stack([x.argmax(1) + a for x, a in zip(bands, BANDS)], 1))
        sizes.append(np.stack([x.max(1) for x in bands], 1))
    top, size = np.concatenate(tops), np.rint(np.concatenate(sizes) * 16)
    edge = np.zeros((1, size.shape[1]), size.dtype)
    before, after = np.concatenate([edge, size[:-1]]), np.concatenate([size[1:], edge])
    return np.where((size > before) & (size >= after) & (size > 0), top, 0)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """times (frames) and codes of all peak pairs, in order of time."""
    found = peaks(samples)
    times, codes = [], []
    for dt in range(AHEAD + 1):
        if len(found) <= dt:
            break
        first, second = found[: len(found) - dt, :, None], found[dt:, None, :]
        t, i, j = np.nonzero((first > 0) & (second > 0) & (second > first if dt == 0 else True))
        times.append(t)
        codes.append(found[t, i] << 16 | found[t + dt, j] << 8 | dt)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_media: bool = True) -> DataFrame:
    """Return doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media (the WAV; null unless
    keep_media), media_bytes, media_sha256, fp_times, fp_codes for the UTF-8 bytes of each whole text.

    Everything but n_bytes is taken from the stored form. Null is empty: a payload of 64 bytes 0. Repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            rows = []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                data = text or b""
                media = to_wav(padded(data))
                stored = from_wav(media)
                times, codes = fingerprint(np.frombuffer(stored, np.uint8))
                rows.append((len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), media if keep_media else None, len(media), hashlib.sha256(media).hexdigest(), times, codes))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "media_bytes", "media_sha256", "fp_times", "fp_codes"])

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_bytes long, media_sha256 string, fp_times array<int>, fp_codes array<int>")


def digests(docs: DataFrame) -> DataFrame:
    """The columns of media_columns with a digest of the fingerprint as `feature`."""
    listed = F.concat_ws(",", F.col("fp_times").cast("array<string>")), F.concat_ws(",", F.col("fp_codes").cast("array<string>"))
    feature = F.concat(F.size("fp_codes").cast("string"), F.lit(":"), F.sha2(F.concat_ws("|", *listed), 256))
    return media_columns(docs, keep_media=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "fp_times", "fp_codes")
