"""Audio columns: WAV files made and read by the ``wave`` module, and landmark fingerprints of their spectra.

A payload is stored as the samples of an 8-bit mono WAV file.  What is read back is cut into frames of ``FRAME``
samples, ``HOP`` apart; a short-time Fourier transform (Hann window) gives a magnitude spectrum per frame, whose
``PEAKS`` strongest local maxima are kept.  Each peak is paired with those of the next ``REACH`` frames: a landmark is
(first bin, second bin, frames between), stored as an integer beside the time of its first peak, so a recording is a
pair of arrays (times, landmarks) in order of time.  A payload of one frame or less is
padded to a frame with silence and repeated over ``REACH + 1`` frames, as one frame has no pairs.

Null texts and payloads count as empty: a payload of 64 zero bytes.  Ids may be null; equal payloads have equal
values; very long texts are transformed ``CHUNK`` frames at a time; of equally strong peaks the lower bin is first; an empty table gives no rows; other columns are ignored.
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

from veilmark.llm.common import mapped

UNIT, RATE, FRAME, HOP, PEAKS, REACH = 64, 8000, 256, 128, 3, 3
#: Frames transformed at once, so that memory doesn't depend on a recording's length.
CHUNK = 2048
_HANN = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono only")
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """(frames, PEAKS) bins of the strongest local maxima, strongest first; -1 where a frame has fewer."""
    x = np.frombuffer(samples, np.uint8)
    if len(x) <= FRAME:
        x = np.resize(np.pad(x, (0, FRAME - len(x)), constant_values=128), FRAME + REACH * HOP)
    n = -(-(len(x) - FRAME) // HOP) + 1
    out = np.full((n, PEAKS), -1, np.int16)
    for at in range(0, n, CHUNK):
        m = min(CHUNK, n - at)
        part = np.full((m - 1) * HOP + FRAME, 128, np.float32)
        own = x[at * HOP : at * HOP + len(part)]
        part[: len(own)] = own
        frames = np.lib.stride_tricks.sliding_window_view(part - 128, FRAME)[::HOP]
        mag = np.abs(np.fft.rfft(frames * _HANN, axis=1)).astype(np.float32)
        top = (mag[:, 1:-1] > mag[:, :-2]) & (mag[:, 1:-1] >= mag[:, 2:])
        inner = np.where(top, mag[:, 1:-1], 0)
        for k in range(PEAKS):
            best = inner.argmax(1)
            rows = np.arange(m)
            out[at : at + m, k] = np.where(inner[rows, best] > 0, best + 1, -1)
            inner[rows, best] = 0
    return out


def landmarks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, landmarks), both int32, in order of time and landmark."""
    p = peaks(samples).astype(np.int32)
    times, marks = [], []
    for gap in range(1, min(REACH, len(p) - 1) + 1):
        a, b = np.broadcast_arrays(p[:-gap, :, None], p[gap:, None, :])
        ok = (a >= 0) & (b >= 0)
        times.append(np.broadcast_to(np.arange(len(a), dtype=np.int32)[:, None, None], a.shape)[ok])
        marks.append((a[ok] << 16) | (b[ok] << 4) | gap)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, m = np.concatenate(times), np.concatenate(marks)
    order = np.argsort((t.astype(np.int64) << 32) | m, kind="stable")
    return t[order], m[order]


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


_MEDIA = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_landmarks long, feature string, times array<int>, landmarks array<int>"
_ARRAYS = "doc_id long, times array<int>, landmarks array<int>"


def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            made = [payload(x) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def _digest(d, n: int, stored: bytes) -> tuple:
    back = from_wav(stored)
    t, m = landmarks(back)
    feature = hashlib.sha256(t.astype("<i4").tobytes() + m.astype("<i4").tobytes()).hexdigest()
    return d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), len(t), feature, t, m


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _FEATURES.split(", ")[:-2]]
    for b in batches:
        for at in range(0, b.num_rows, 100):
            rows = [_digest(*x) for x in zip(*[c.to_pylist() for c in b.slice(at, 100).columns], strict=True)]
            *plain, times, marks = zip(*rows, strict=True)
            yield pa.record_batch([*[pa.array(c, k) for c, k in zip(plain, kinds, strict=True)], _lists(times), _lists(marks)], names=names)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values), pa.int32()))


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 100):
            part = b.slice(at, 100)
            got = [landmarks(from_wav(x)) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), *[_lists([g[k] for g in got]) for k in (0, 1)]], names=["doc_id", "times", "landmarks"])


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text stored as a WAV file."""
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), store, _MEDIA)


def fingerprints(media: DataFrame) -> DataFrame:
    """(doc_id, times, landmarks) of WAV files (doc_id, media), as time-coded arrays."""
    return mapped(media.select("doc_id", "media"), arrays, _ARRAYS)


def describe(media: DataFrame) -> DataFrame:
    """Sizes and digests of WAV files (doc_id, n_bytes, media) and of what is read back; ``times`` and ``landmarks``: the
    time-coded arrays of the spectral peaks' pairs; ``feature``: SHA-256 of both, times first, as little-endian 32-bit integers."""
    return mapped(media.select("doc_id", "n_bytes", "media"), features, _FEATURES)
