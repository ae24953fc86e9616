"""Audio media columns: text bytes as 8-bit samples, and log-mel features of them.

A payload (UTF-8, zero bytes appended up to a positive multiple of 64) is stored as the data
chunk of a mono 8-bit PCM WAV file in a binary column of a table in the shared folder. The features
are computed from the stored bytes, read back from that table: polyphase resampling from 8 to 16/3 kHz, overlapped log-mel filterbank frames,
and segments by hysteresis on frame energy. They are stored as an Arrow stream with one
fixed-shape tensor (FRAMES x MELS) per block of frames, with its time span; the segments' spans
stand in the schema's metadata.

Defined cases: null and empty texts are 64 zero bytes; equal texts give equal values; null ids
and repeated rows keep a row each; very long texts give more blocks of the same shape; empty
tables give empty results; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import portions, table, text_of, tidy, written

RATE, UP, DOWN, TAPS = 8000, 2, 3, 12
WINDOW, HOP, MELS, FRAMES = 256, 128, 20, 16
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def to_wav(payload: bytes) -> bytes:
    """Mono, 8 bits a sample; the samples are the payload."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The data chunk; chunks before it are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def lowpass() -> np.ndarray:
    """One row of taps for each phase of the resampler."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return (h * UP / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


def mel_bank() -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, over the bins of a frame; one row a band."""
    rate = RATE * UP / DOWN
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2) / 2595) - 1)
    bins = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((bins - left) / (mid - left), (right - bins) / (right - mid))).astype(np.float32)


_LOWPASS, _BANK, _HANN = lowpass(), mel_bank(), np.hanning(WINDOW).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """UP/DOWN times the rate: each output sample uses the taps of its own phase.

    Sums run tap by tap, so a sample's value depends on its neighbourhood alone.
    """
    n = -(-len(x) * UP // DOWN)
    wide = np.pad(x, (TAPS // 2, TAPS))
    out = np.empty(n, np.float32)
    for k in range(UP):
        at = np.arange(k, n, UP) * DOWN
        phase, at = at[0] % UP if len(at) else 0, at // UP + TAPS // 2
        total = np.zeros(len(at), np.float32)
        for j in range(TAPS):
            total += _LOWPASS[phase, j] * wide[at + TAPS // 2 - j]
        out[k::UP] = total
    return out


def log_mels(frames: np.ndarray) -> np.ndarray:
    """(n, WINDOW) samples to (n, MELS); each row is computed by itself."""
    spectrum = np.fft.rfft(frames * _HANN, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    out = np.empty((len(frames), MELS), np.float32)
    for m, row in enumerate(_BANK):
        used = np.flatnonzero(row)
        out[:, m] = (power[:, used[0] : used[-1] + 1] * row[used[0] : used[-1] + 1]).sum(axis=1)
    return np.log(out + np.float32(1e-6))


def segments(energy: np.ndarray, first: np.ndarray, lens: np.ndarray, up: float = 0.3, down: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """First and last frames of the segments of many signals that stand one after the other.

    A segment begins above its signal's mean energy + `up` and ends below the mean - `down`.
    """
    mean = np.repeat(np.add.reduceat(energy, first) / lens, lens)
    say = np.where(energy > mean + up, 1, np.where(energy < mean - down, 0, -1))
    say[first] = np.maximum(say[first], 0)
    on = say[np.maximum.accumulate(np.where(say >= 0, np.arange(len(say)), -1))] == 1
    begins, ends = np.zeros(len(on), bool), np.zeros(len(on), bool)
    begins[first] = True
    ends[first + lens - 1] = True
    return np.flatnonzero(on & (begins | ~np.r_[False, on[:-1]])), np.flatnonzero(on & (ends | ~np.r_[on[1:], False]))


def features(media: list[bytes]) -> list[bytes]:
    """The Arrow stream of each file: tensors of FRAMES x MELS with start_ms and end_ms.

    The signals stand in one array, zeros between them, each at a multiple of UP * DOWN.
    """
    payloads = [from_wav(m) for m in media]
    size = np.array([len(p) for p in payloads])
    unit = UP * DOWN * HOP
    room = -(-(size + unit) // unit) * unit
    at = np.cumsum(room) - room
    x = np.zeros(int(room.sum()), np.float32)
    for p, i in zip(payloads, at.tolist()):
        x[i : i + len(p)] = (np.frombuffer(p, np.uint8).astype(np.float32) - 128) / 128
    low, low_at, low_n = resample(x), at * UP // DOWN, -(-size * UP // DOWN)
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, low_at, 1)
    np.add.at(inside, low_at + low_n, -1)
    low = np.pad(low * np.cumsum(inside[:-1]), (0, WINDOW)).astype(np.float32)
    lens = np.maximum(0, -(-(low_n - WINDOW) // HOP)) + 1
    first = np.cumsum(lens) - lens
    start = np.repeat(low_at, lens) + HOP * (np.arange(int(lens.sum())) - np.repeat(first, lens))
    mels = log_mels(np.lib.stride_tricks.sliding_window_view(low, WINDOW)[start])
    ms = 1000 * HOP * DOWN / (RATE * UP)
    begin, end = segments(mels.mean(axis=1), first, lens)
    own = np.searchsorted(first, begin, side="right") - 1
    spans = np.c_[np.round((begin - first[own]) * ms), np.round((end + 1 - first[own]) * ms)].astype(int).tolist()
    cut = np.searchsorted(own, np.arange(len(media) + 1)).tolist()
    out = []
    for i, (f, n) in enumerate(zip(first.tolist(), lens.tolist())):
        blocks = -(-n // FRAMES)
        full = np.zeros((blocks * FRAMES, MELS), np.float32)
        full[:n] = mels[f : f + n]
        edge = np.minimum(np.arange(blocks + 1) * FRAMES, n)
        edge = np.round(edge * ms).astype(np.int64)
        tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS))
        schema = pa.schema([("log_mel", TENSOR), ("start_ms", pa.int64()), ("end_ms", pa.int64())], metadata={"segments_ms": json.dumps(spans[cut[i] : cut[i + 1]])})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            stream.write_batch(pa.record_batch([tensors, pa.array(edge[:-1]), pa.array(edge[1:])], schema=schema))
        out.append(sink.getvalue().to_pybytes())
    return out


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the WAV file of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [t.encode() for t in batch.text]
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "n_bytes": [len(r) for r in raw], "media": [to_wav(padded(r)) for r in raw]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(tidy(run), "doc_id long, n_bytes long, media binary")


def extract(stored: DataFrame) -> DataFrame:
    """Adds payload figures, and the feature stream, from the stored bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, features binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            back = [from_wav(m) for m in batch.media]
            yield pd.DataFrame({
                "doc_id": batch.doc_id.astype("Int64"), "n_bytes": batch.n_bytes, "payload_bytes": [len(p) for p in back], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back], "tail_crc32": [zlib.crc32(p[-64:]) for p in back],
                "media_bytes": [len(m) for m in batch.media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in batch.media], "features": [f for part in portions(batch.media.tolist()) for f in features(part)],
            })

    return stored.mapInPandas(tidy(run), schema)


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every document; `feature` is the SHA-256 of its feature stream."""
    got = extract(written(store(table(spark, sf_dir, "documents")), "media", compression="zstd"))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.sha2("features", 256).alias("feature"))


QUERIES = {"op10_audio_features": op10_audio_features}
