"""Media columns: texts stored as 8-bit WAV, and spectral-peak pair fingerprints of what is read back.

The wave module writes and reads the media form.  Short-time Fourier transforms of the samples give a
spectrogram; the strongest local peaks of each frame are paired with one another and with peaks of the frames
that follow, and each pair (first bin, second bin, frames between) becomes a code at the first peak's time.

Defined cases.  Null is empty; the payload of an empty text is 64 zero bytes, whose silence has no peaks
and so no pairs.  Equal texts have equal media and fingerprints.  Very long texts are transformed in slices of
frames, whole.  Equal peaks: the lower bin first; equally near partners: the stronger peak first.  Rows are independent,
so repeated rows, null ids and further columns don't matter.  An empty table gives an empty table.
"""

from __future__ import annotations

import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import as_bytes, batches, sha256_hex, two

RATE, FRAME, HOP = 8000, 512, 256
PEAKS, FAN, AHEAD = 3, 4, 8
SLICE = 512
BLOCK = 64


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def spectrogram(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Magnitudes of the frames, a slice of frames at a time; the last frame is filled up with the middle value."""
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    signal = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    signal[: len(samples)] = samples.astype(np.float32) - samples.mean()
    shape = np.hanning(FRAME).astype(np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    for at in range(0, frames, SLICE):
        yield np.abs(np.fft.rfft(windows[at : at + SLICE] * shape, axis=1))


def peaks(magnitudes: np.ndarray) -> np.ndarray:
    """(frames, PEAKS) bins of the strongest local maxima, strongest first, ties to the lower bin; -1 where there are fewer."""
    level = np.round(magnitudes, 3)
    inner = level[:, 1:-1]
    top = np.where((inner > level[:, :-2]) & (inner >= level[:, 2:]) & (inner > 1.0), inner, 0)
    order = np.argsort(-top, axis=1, kind="stable")[:, :PEAKS]
    return np.where(np.take_along_axis(top, order, axis=1) > 0, order + 1, -1)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): pairs of peaks of one frame, and of frames at most AHEAD apart: for each first peak its FAN nearest partners that are there."""
    bins = np.concatenate([peaks(m) for m in spectrogram(np.frombuffer(samples, np.uint8))])
    frames = len(bins)
    times, codes, ranks = [], [], []
    for first in range(PEAKS):  # a frame's own peaks, so that a text of one frame has a fingerprint too
        for second in range(first + 1, PEAKS):
            ok = np.flatnonzero(bins[:, second] >= 0)  # peaks are in order of strength, so the first is there
            times.append(ok)
            codes.append(bins[ok, first] << 12 | bins[ok, second] << 4)
            ranks.append(np.full(len(ok), first * PEAKS + second - PEAKS * PEAKS))
    paired = np.zeros((PEAKS, frames), np.int64)  # partners of each first peak so far
    for ahead in range(1, min(AHEAD, frames - 1) + 1):
        if not ((paired < FAN) & (bins.T >= 0)).any():
            break
        for second in range(PEAKS):
            there = bins[ahead:, second] >= 0
            for first in range(PEAKS):
                ok = np.flatnonzero(there & (bins[:-ahead, first] >= 0) & (paired[first, :-ahead] < FAN))
                paired[first, ok] += 1
                times.append(ok)
                codes.append(bins[ok, first] << 12 | bins[ok + ahead, second] << 4 | ahead)
                ranks.append(np.full(len(ok), (ahead * PEAKS + second) * PEAKS + first))
    t, c, r = (np.concatenate(x) for x in (times, codes, ranks))
    order = np.lexsort((r, t))
    return t[order], c[order]


RESULT = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("media", pa.binary()), ("fp_times", pa.list_(pa.int32())), ("fp_codes", pa.list_(pa.int32()))])


def _store(with_media: bool):
    def one(i, text: bytes) -> tuple:
        media = to_wav(payload_of(text))
        back = from_wav(media)
        times, codes = fingerprint(back)
        return i, len(text), len(back), sha256_hex(back), zlib.crc32(back[-BLOCK:]), len(media), sha256_hex(media), media if with_media else None, times.astype(np.int32), codes.astype(np.int32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield from batches((one(*row) for row in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)), RESULT, 512)

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, media: bool = True) -> DataFrame:
    """Per row: id, payload and media digests, the WAV itself if asked for, and the time-coded fingerprint arrays."""
    src = two(docs, id_col, text_col)
    ddl = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media binary, fp_times array<int>, fp_codes array<int>"
    return src.select(src["_id"].cast("long").alias("_id"), "_text").mapInArrow(_store(media), ddl).withColumnRenamed("_id", id_col)
