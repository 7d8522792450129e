"""Operator 7: media columns. Bytes as a WAV sound, its spectrum, and fingerprints of pairs of spectral peaks.

A payload becomes a mono WAV of 8-bit samples, which is read again by the wave module. A short-time Fourier transform (frames of
FRAME samples, a Hann window, a step of HOP samples, a quarter of the frame, so that a passage that recurs at any offset shares most codes) gives magnitudes; the strongest bin of each of BANDS frequency bands of a frame
is a peak (of equal ones the lowest) where it stands out of the frame's mean; a peak is paired with the first PAIRS peaks of the frames after it (up to REACH), and
each pair gives the code (bin, bin, frames between) with the time of its first frame: an array of structs of time and code.

Null or empty text: a payload of 576 bytes of 255 (silence at full level, without peaks). Equal texts have equal values, repeated rows and
null doc_ids are kept. Very long texts are transformed in blocks of frames. Extra columns of the input are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import pick, small_batches, utf8

UNIT, RATE, PAD = 576, 8000, b"\xff"
FRAME, HOP, BANDS, PAIRS, REACH = 512, 128, 4, 3, 32
BLOCK_FRAMES = 4096

SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, fingerprints array<struct<time:int,code:int>>, feature string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("fingerprints", pa.list_(pa.struct([("time", pa.int32()), ("code", pa.int32())]))), ("feature", pa.string())])


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw + PAD * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


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


def spectrum(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of magnitudes (frames x bins) with the number of their first frame. The last frame is filled with silence."""
    count = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    for f in range(0, count, BLOCK_FRAMES):
        g = min(count, f + BLOCK_FRAMES)
        x = np.full(((g - f - 1) * HOP + FRAME,), 128, np.uint8)
        part = samples[f * HOP : f * HOP + len(x)]
        x[: len(part)] = part
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP].astype(np.float32) - 128
        yield f, np.abs(np.fft.rfft(frames * window, axis=1)[:, 1:])


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each spectral peak, in the order of frames, then bins."""
    at, bins = [], []
    for f, m in spectrum(samples):
        bands = m.reshape(len(m), BANDS, -1)
        best = bands.argmax(axis=2)
        out = np.take_along_axis(bands, best[:, :, None], 2)[:, :, 0] > 2 * m.mean(axis=1, keepdims=True) + 1e-3
        i, b = np.nonzero(out)
        at.append(i + f)
        bins.append(best[i, b] + b * bands.shape[2])
    return np.concatenate(at), np.concatenate(bins)


def fingerprints(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of pairs of peaks, ordered by time, then code."""
    at, bins = peaks(samples)
    after = np.searchsorted(at, at, "right")  # the first peak of a later frame
    times, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(PAIRS):
        other = after + k
        ok = np.flatnonzero(other < len(at))
        ok = ok[at[other[ok]] - at[ok] <= REACH]
        times.append(at[ok])
        codes.append(bins[ok] << 16 | bins[other[ok]] << 8 | at[other[ok]] - at[ok])
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def feature(times: np.ndarray, codes: np.ndarray) -> str:
    """Number of pairs, distinct codes, and a digest of the time-coded array."""
    both = np.stack([times, codes], 1).astype("<i4").tobytes()
    return f"{len(times)}:{len(np.unique(codes))}:{hashlib.md5(both).hexdigest()}"


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small_batches(batches, "text"):
        raw, at = utf8(b.column(1))
        data, sizes, media, back, lists, features, ends = raw.tobytes(), [], [], [], [], [], [0]
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            media.append(to_wav(padded(data[i:j])))
            back.append(from_wav(media[-1]))
            t, c = fingerprints(np.frombuffer(back[-1], np.uint8))
            sizes.append(j - i)
            lists.append((t, c))
            features.append(feature(t, c))
            ends.append(ends[-1] + len(t))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in lists] or [np.zeros(0, np.int32)]), pa.int32()) for k in (0, 1)], ["time", "code"])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(features, pa.string())], schema=_ARROW)


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as a WAV file (media), the samples read back from it (payload), fingerprints and a digest of these."""
    return pick(docs, {"doc_id": doc_id, "text": text}).mapInArrow(_media, SCHEMA)
