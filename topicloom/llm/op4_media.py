"""Media columns: audio, its lossless storage, and features read from the stored bytes.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the unsigned 8-bit samples of a mono WAV file, kept in a binary
column. Features are computed from the samples that are read back: polyphase resampling (up 3, down 4), log-mel filterbanks
over half-overlapping frames (the last one filled up with silence), and segments by energy with hysteresis (a segment begins above the mean and half a deviation, and
ends below the mean). Each segment has a time span and a tensor of fixed shape, its log-mel values averaged over PARTS equal parts of
its time. Samples are resampled in blocks, so memory follows the frames, a fraction of the samples.

Defined results: a null text counts as empty and gives 64 zero samples; silence has one segment that spans the clip; equal texts give
equal bytes and features; repeated rows and null keys each keep a row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from topicloom.llm.common import bounded_batches, table

UNIT, RATE = 64, 8000
UP, DOWN, TAPS = 3, 4, 12
FRAME, HOP, MELS, PARTS = 256, 128, 16, 4
#: Samples that are resampled at once; a multiple of DOWN.
BLOCK = DOWN << 16
SHAPE = (PARTS, MELS)
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a WAV file; other chunks than the format and the data are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


@cache
def lowpass() -> np.ndarray:
    """Windowed sinc for UP times the rate; (UP, TAPS), a row for each phase."""
    n = np.arange(UP * TAPS) - (UP * TAPS - 1) / 2
    h = np.sinc(n / max(UP, DOWN)) * np.hamming(UP * TAPS)
    return (h * UP / h.sum()).reshape(TAPS, UP).T.astype(np.float32)


@cache
def mel_bank() -> np.ndarray:
    """(bins, MELS) triangles, evenly spaced in mel up to half the new rate."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    at = np.arange(FRAME // 2 + 1)[:, None] * top / (FRAME // 2)
    return np.maximum(0, np.minimum((at - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - at) / (edge[2:] - edge[1:-1]))).astype(np.float32)


def resample(block: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A block whose length is a multiple of DOWN, after the TAPS samples before it."""
    x, taps, m = np.concatenate([before, block]), lowpass(), len(block) // DOWN
    out = np.zeros((m, UP), np.float32)
    for r in range(UP):
        for k in range(TAPS):
            at = TAPS + r * DOWN // UP - k
            out[:, r] += taps[r * DOWN % UP, k] * x[at : at + (m - 1) * DOWN + 1 : DOWN]
    return out.ravel()


def log_mel(samples: bytes) -> np.ndarray:
    """(frames, MELS); at least one frame."""
    raw = np.frombuffer(samples, np.uint8)
    left, before, rows, window = np.zeros(0, np.float32), np.zeros(TAPS, np.float32), [], np.hanning(FRAME).astype(np.float32)
    for at in range(0, len(raw), BLOCK):
        x = (raw[at : at + BLOCK].astype(np.float32) - 128) / 128
        y = np.concatenate([left, resample(x, before)])
        before = np.concatenate([before, x])[-TAPS:]
        if at + BLOCK >= len(raw):  # the last frame is filled up with silence
            y = np.pad(y, (0, FRAME - len(y) if len(y) < FRAME else (FRAME - len(y)) % HOP))
        n = max(0, (len(y) - FRAME) // HOP + 1)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[: n * HOP : HOP] if n else np.zeros((0, FRAME), np.float32)
        for f in range(0, n, 2048):
            power = np.abs(np.fft.rfft(frames[f : f + 2048] * window)) ** 2
            rows.append(np.log(power.astype(np.float32) @ mel_bank() + 1e-6))
        left = y[n * HOP :]
    return np.concatenate(rows)


def segments(energy: np.ndarray) -> np.ndarray:
    """(n, 2) first and last-but-one frames: loud from above the mean and half a deviation until below the mean."""
    mean, spread = energy.mean(dtype=np.float64), energy.std(dtype=np.float64)
    mark = np.where(energy >= mean + spread / 2, 1, np.where(energy < mean, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    loud = np.where(last >= 0, mark[last], -1) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], loud, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2) if len(edges) and spread > 1e-9 else np.array([[0, len(energy)]])


def features(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans in seconds (n, 2), and tensors (n, PARTS, MELS)."""
    mel = log_mel(samples)
    spans = segments(mel.mean(axis=1))
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    at = spans[:, :1] + (spans[:, 1:] - spans[:, :1]) * np.arange(PARTS + 1) / PARTS
    low = np.floor(at[:, :-1]).astype(int)
    high = np.maximum(low + 1, np.ceil(at[:, 1:]).astype(int))
    tensor = (sums[high] - sums[low]) / (high - low)[:, :, None]
    return spans * HOP / (RATE * UP / DOWN), tensor.astype(np.float32)


def _to_media(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text as bytes) to (key, n_bytes, media)."""
    for b in it:
        raw = [t or b"" for t in b.column(1).to_pylist()]
        media = [wav(t + bytes(-len(t) % UNIT if t else UNIT)) for t in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])


def _to_features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, media) to digests, spans and tensors."""
    for b in it:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        spans, tensors, counts = [np.zeros((0, 2))], [np.zeros((0, *SHAPE), np.float32)], [0]
        for m in b.column(2):
            m = m.as_py()
            samples = samples_of(m)
            s, t = features(samples)
            spans.append(s)
            tensors.append(t)
            counts.append(len(s))
            coarse = np.round(t * 8).astype("<i2").tobytes() + np.round(s * 1000).astype("<i8").tobytes()
            row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), f"{len(s)}:{hashlib.sha256(coarse).hexdigest()[:16]}")
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        cuts = pa.array(np.cumsum(counts), pa.int32())
        each = np.ascontiguousarray(np.concatenate(tensors))
        tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(each).storage.cast(pa.list_(pa.float32())) if len(each) else pa.array([], pa.list_(pa.float32()))
        times = np.concatenate(spans).astype(np.float64)
        span = pa.StructArray.from_arrays([pa.array(times[:, 0]), pa.array(times[:, 1]), tensor], names=["start_s", "stop_s", "tensor"])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [b.column(0), b.column(1), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)), pa.ListArray.from_arrays(cuts, span)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", *out, "segments"])


#: The tensors' fixed shape stands in the metadata of their field, as Spark's arrays have none.
SEGMENT = StructType([StructField("start_s", DoubleType()), StructField("stop_s", DoubleType()), StructField("tensor", ArrayType(FloatType()), metadata={"shape": list(SHAPE)})])
MEDIA = [StructField("n_bytes", LongType()), StructField("media", BinaryType())]
FEATURES = [
    StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()), StructField("segments", ArrayType(SEGMENT)),
]


def _mapped(df: DataFrame, key: str, function, fields: list[StructField]) -> DataFrame:
    bounded_batches(df.sparkSession)
    schema = StructType([StructField("key", df.schema["key"].dataType), *fields])
    return df.mapInArrow(function, schema).withColumnRenamed("key", key)


def media_column(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the WAV file of each text."""
    return _mapped(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), key, _to_media, MEDIA)


def audio_features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Columns of media(key, n_bytes, media) without the bytes, but with digests of them, time spans and tensors of shape SHAPE (rows of PARTS x MELS floats, as an Arrow fixed-shape tensor stores them)."""
    return _mapped(media.select(F.col(key).alias("key"), "n_bytes", "media"), key, _to_features, FEATURES)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """audio_features(media_column(docs)) in one Python worker a task instead of two: the WAV files go from one step to the other as an Arrow column."""
    return _mapped(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), key, lambda it: _to_features(_to_media(it)), FEATURES)


def tensors(found: list[list[float]]) -> pa.FixedShapeTensorArray:
    """The tensors of segments, read from Spark, as an Arrow tensor array again."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.asarray(found, np.float32).reshape(-1, *SHAPE))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns and, after them, the segments themselves: time spans and tensors."""
    return media_features(table(spark, sf_dir, "documents"))
