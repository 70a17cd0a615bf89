"""Texts as WAV media, and spectral-peak fingerprints of what was stored.

encode() puts each payload into an 8-bit mono WAV file held in a binary column; features() reads
such files back with the wave module, takes a short-time Fourier transform frame by frame and pairs
the peaks of neighbouring frames. A fingerprint is two arrays of equal length: fp_time, the frame of
the first peak, and fp_code, the two frequencies and the frames between them.

Defined results: a null text is an empty one; an empty text is a payload of 192 spaces; a null
doc_id stays null; repeated rows give repeated rows with equal values; an empty table gives an empty
table; input columns other than doc_id and text are not read. Texts of any length run in the memory
of one text and CHUNK frames.
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

from quillcheck.llm.common import from_batches

UNIT, PAD, TAIL, RATE = 192, b" ", 16, 8000
FRAME, HOP, CHUNK = 192, 96, 4096
#: Bins of each band; the strongest bin of a band may be a peak.
BANDS = ((2, 14), (14, 40), (40, 97))
#: A peak is the largest of its band over so many frames to either side; it is paired with the next FAN peaks, REACH frames on at most.
AROUND, FAN, REACH = 2, 2, 63

MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fp_time array<int>, fp_code array<int>"


def payload_of(text: str) -> tuple[int, bytes]:
    data = text.encode()
    return len(data), data + PAD * ((-len(data)) % UNIT if data else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def band_maxima(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its level (whole decibels) of each band in each frame."""
    n = 1 + (len(samples) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    bins, levels = np.empty((n, len(BANDS)), np.int32), np.empty((n, len(BANDS)), np.int32)
    for at in range(0, n, CHUNK):
        part = (frames[at : at + CHUNK].astype(np.float32) - 128.0) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))
        for k, (lo, hi) in enumerate(BANDS):
            best = power[:, lo:hi].argmax(axis=1)
            bins[at : at + len(part), k] = best + lo
            levels[at : at + len(part), k] = np.rint(20 * np.log10(power[np.arange(len(part)), best + lo] + 1e-6))
    return bins, levels


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp_time and fp_code, ordered by time."""
    bins, levels = band_maxima(samples)
    around = np.pad(levels, ((AROUND, AROUND), (0, 0)), constant_values=-(2**30))
    peak = np.ones(levels.shape, bool)
    for d in range(2 * AROUND + 1):
        other = around[d : d + len(levels)]
        peak &= levels > other if d < AROUND else levels >= other  # the first of equals is the peak
    t, k = np.nonzero(peak)
    f = bins[t, k]
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        times.append(t[:-step][near])
        codes.append((f[:-step] << 13 | f[step:] << 6 | gap)[near])
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [payload_of(x or "") for x in from_batches(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((n for n, _ in payloads), pa.int64()), pa.array((to_wav(p) for _, p in payloads), pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload, tail, media, time, code = [], [], [], [], []
        for stored in batch.column(2):
            stored = stored.as_py()
            back = from_wav(stored)
            payload.append((len(back), hashlib.sha256(back).hexdigest()))
            tail.append(zlib.crc32(back[-TAIL:]))
            media.append((len(stored), hashlib.sha256(stored).hexdigest()))
            t, c = fingerprint(np.frombuffer(back, np.uint8))
            time.append(t)
            code.append(c)
        arrays = [pa.array([n for n, _ in payload], pa.int64()), pa.array([h for _, h in payload], pa.string()), pa.array(tail, pa.int64()), pa.array([n for n, _ in media], pa.int64()), pa.array([h for _, h in media], pa.string()), pa.array(time, pa.list_(pa.int32())), pa.array(code, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[x.split()[0] for x in FEATURES.split(", ")])


def encode(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, a whole WAV file."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encoded, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """Digests and fingerprints of stored files; reads the table of encode()."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)


def feature_text() -> "F.Column":
    """The fingerprint as time:code pairs in hexadecimal."""
    return F.array_join(F.transform(F.arrays_zip("fp_time", "fp_code"), lambda p: F.concat(F.lower(F.hex(p["fp_time"])), F.lit(":"), F.lower(F.hex(p["fp_code"])))), " ")
