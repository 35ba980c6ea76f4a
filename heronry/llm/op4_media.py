"""Media columns: payloads stored as WAV, with spectral-peak pair fingerprints.

A payload is written by the ``wave`` module as mono 8-bit samples and read back
by it. The features come from the samples read: Hann-windowed short-time Fourier
transforms (``FRAME`` samples, ``HOP`` apart), the strongest bin in each of
``BANDS`` frequency bands of a frame if it stands above the frame's mean as a
peak, and pairs of a peak with the strongest peak of its own and each of the
next ``AHEAD`` frames. A pair is one 64-bit number, its time in the high 32 bits
and (bin, bin, frames between) below, so the array is sorted by time. Frames are worked on in blocks, which
bounds memory for long payloads.

Defined results: a null text counts as empty, an empty one is a payload of 64
zero bytes, whose spectrum has no peaks and whose fingerprint is empty; equal
payloads give equal values; ids may be null or repeat; other columns aren't
read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heronry.llm.common import id_field, map_texts

UNIT, RATE = 64, 8000
FRAME, HOP, AHEAD, BLOCK = 256, 128, 2, 4096
#: Edges of the frequency bands, in bins.
BANDS = (1, 12, 40, 129)
_WINDOW = np.hanning(FRAME).astype(np.float32)


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """Zeros up to a positive multiple of ``unit``."""
    return data + bytes((-len(data)) % unit or (0 if data else unit))


def to_wav(payload: bytes) -> bytes:
    """The stored form."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """All samples of the stored form."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each frame the peak bin of each band, or -1, and the strongest of them."""
    x = np.frombuffer(samples, dtype=np.uint8)
    n, bands = max(1, -(-len(x) // HOP)), len(BANDS) - 1
    bins, best = np.full((n, bands), -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        part = x[first * HOP : (last - 1) * HOP + FRAME]
        y = np.zeros((last - first - 1) * HOP + FRAME, dtype=np.float32)
        y[: len(part)] = part
        y[: len(part)] -= 128.0
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))
        floor = np.maximum(1.5 * power.mean(axis=1), 1e-3)
        row, height = np.arange(last - first), np.zeros((last - first, bands))
        for b in range(bands):
            top = power[:, BANDS[b] : BANDS[b + 1]].argmax(axis=1) + BANDS[b]
            h = power[row, top]
            height[:, b] = np.where(h > floor, h, 0.0)
            bins[first:last, b] = np.where(h > floor, top, -1)
        best[first:last] = bins[first:last][row, height.argmax(axis=1)]
    return bins, best


def fingerprint(samples: bytes) -> np.ndarray:
    """Sorted pair codes."""
    bins, best = peaks(samples)
    parts = []
    for d in range(AHEAD + 1):
        a, b = bins[: len(bins) - d], best[d:]
        t = np.arange(len(a), dtype=np.int64)
        for i in range(bins.shape[1]):
            ok = (a[:, i] >= 0) & (b >= 0) & ((a[:, i] != b) | (d > 0))
            parts.append((t[ok] << 32) | (a[ok, i] << 20) | (b[ok] << 8) | d)
    return np.sort(np.concatenate(parts))


def feature(code: np.ndarray) -> str:
    """A short form of a fingerprint: pairs and a digest."""
    return f"{len(code)}:{hashlib.sha1(code.astype('<i8').tobytes()).hexdigest()}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_bytes, payload_bytes, payload_sha256, tail_crc32, media, fingerprint, feature."""
    schema = T.StructType(
        [
            id_field(docs, id_col),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_sha256", T.StringType()),
            T.StructField("tail_crc32", T.LongType()),
            T.StructField("media", T.BinaryType()),
            T.StructField("fingerprint", T.ArrayType(T.LongType())),
            T.StructField("feature", T.StringType()),
        ]
    )

    def work(ids, texts):
        got = {n: [] for n in schema.names[1:]}
        for t in texts:
            data = t.encode("utf-8", "surrogatepass")
            media = to_wav(pad(data))
            back = from_wav(media)
            code = fingerprint(back)
            row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), media, code, feature(code))
            for c, v in zip(got.values(), row):
                c.append(v)
        return {id_col: ids} | got

    return map_texts(docs, work, schema, id_col, text_col)
