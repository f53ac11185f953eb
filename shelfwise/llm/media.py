"""Media columns: texts as WAV sounds, and spectral-peak pair fingerprints of the sounds.

A payload (the text's UTF-8 bytes with spaces up to a positive multiple of 192) is stored
losslessly as the samples of an 8-bit mono WAV file, written and read by the wave module.
Features come from the samples that were read back: a short-time Fourier transform in
frames of FRAME samples every HOP samples; in each frame the strongest bin of each of
BANDS bands is a peak if it is above the mean of its band's strongest bins over the
sound; each peak is paired with the next FAN peaks in time. A pair is stored as
(first bin, second bin, frames between) in one integer with the frame of its first peak:
two arrays of equal length, in time order.

Null and empty texts have 192 bytes of payload. Equal texts have equal values; repeated rows are
each returned. Of equally strong bins of a band the lowest is the peak. A payload
shorter than a frame is one frame filled up with silence. Spectra are made a block of
frames at a time, so a long text needs memory only for its samples and its peaks. An
empty table gives no rows. The key and the text are the only columns that are read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT, RATE = 192, 8000
FRAME, HOP, FAN, REACH = 256, 128, 3, 16
#: First bin of each band, and the end of the last.
BANDS = np.array([1, 9, 17, 33, 65, 129])
BLOCK_FRAMES = 8192
_WINDOW = np.hanning(FRAME).astype(np.float32)

SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, pairs array<int>, frames array<int>"


def payload_of(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % UNIT if text else UNIT)


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


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, by frame and then bin."""
    n = max(1, 1 + (len(samples) - FRAME + HOP - 1) // HOP)
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(samples)] = samples.astype(np.float32) - 128
    frames = np.lib.stride_tricks.as_strided(padded, (n, FRAME), (padded.strides[0] * HOP, padded.strides[0]))
    level, at = np.empty((n, len(BANDS) - 1), np.float32), np.empty((n, len(BANDS) - 1), np.int32)
    for i in range(0, n, BLOCK_FRAMES):
        spectrum = np.fft.rfft(frames[i : i + BLOCK_FRAMES] * _WINDOW, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        for b, (lo, hi) in enumerate(zip(BANDS[:-1], BANDS[1:], strict=True)):
            best = power[:, lo:hi].argmax(axis=1)
            at[i : i + BLOCK_FRAMES, b] = best + lo
            level[i : i + BLOCK_FRAMES, b] = power[np.arange(len(power)), best + lo]
    strong = level > level.mean(axis=0, dtype=np.float64).astype(np.float32)
    t, band = np.nonzero(strong)
    return t, at[t, band]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes, frame of each pair), by frame; both int32."""
    t, f = peaks(samples)
    codes, times = [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = np.flatnonzero(gap < REACH)
        codes.append((f[near] << 16) | (f[near + k] << 8) | gap[near])
        times.append(t[near])
    code, time = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((code, time))
    return code[order].astype(np.int32), time[order].astype(np.int32)


def describe(text: bytes) -> tuple:
    media = to_wav(payload_of(text))
    back = from_wav(media)
    pairs, frames = fingerprint(np.frombuffer(back, np.uint8))
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), pairs, frames


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key with the figures of payload and sound and the fingerprint's two arrays."""
    slim = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [describe(x) for x in part.column(1).to_pylist()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5]), pa.array(cols[6], pa.list_(pa.int32())), pa.array(cols[7], pa.list_(pa.int32()))],
                    ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "pairs", "frames"],
                )

    kind = slim.schema["key"].dataType.simpleString()
    return slim.mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def op2_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sound; feature is the digest of the time-coded pairs."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    coded = F.concat(F.array_join(F.col("pairs").cast("array<string>"), ","), F.lit("|"), F.array_join(F.col("frames").cast("array<string>"), ","))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2(coded, 256).alias("feature"), F.size("pairs").alias("n_pairs"))
