"""Media columns: texts' bytes as 8-bit audio, with log-mel features and energy segments.

``store`` writes a payload as the samples of a WAV file (8-bit PCM, one channel), losslessly. ``features`` reads the
samples back from the stored file, resamples them by a polyphase filter, takes overlapped log-mel filterbanks and
finds energy segments with hysteresis. Features are fixed-shape tensors, ``FRAMES`` x ``MELS`` values a clip (the last
clip padded with the floor), each with its time span. Spark has no tensor type, so they are stored as Arrow's own: a
stream of its IPC format in a binary column, with a ``fixed_shape_tensor`` column beside the spans (``read_clips``).
"""

from __future__ import annotations

import io
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples a second as stored, and after resampling by UP / DOWN.
RATE, UP, DOWN = 16_000, 2, 3
#: Taps of each phase of the resampling filter.
TAPS = 16
#: Frame and hop in resampled samples; filters; frames of a clip; the log floor.
FRAME, HOP, MELS, FRAMES, FLOOR = 256, 128, 20, 64, 1e-6
#: A segment begins where a frame's energy is this far (dB) above the clip's median and ends below the second value.
ENTER_DB, LEAVE_DB = 1.5, 0.5
#: Frames worked on together, so that memory doesn't grow with a recording's length.
STEP = 2048
UNIT = 64


def payload(data: bytes, unit: int = UNIT) -> bytes:
    """The bytes, with bytes 0 appended up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit or (unit if not data else 0))


def store(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of the bytes as 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_back(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes()), r.getframerate()


@lru_cache
def resampler(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase filter bank ``[phase, tap]`` of a windowed sinc, each phase of unit gain."""
    reach = -(-taps * max(up, down) // (2 * up)) * up  # whole steps of the input to either side
    t = np.arange(-reach, reach + 1)
    cut = 1.0 / max(up, down)
    kernel = np.sinc(t * cut) * cut * np.hamming(len(t))
    phases = np.zeros((up, 2 * reach // up + 1))
    for p in range(up):
        phases[p, : len(kernel[p::up])] = kernel[p::up]
    return phases / phases.sum(axis=1, keepdims=True)


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output n is the filter's phase (n * down) mod up applied at input (n * down) div up."""
    phases = resampler(up, down)
    taps = phases.shape[1]
    n = -(-len(samples) * up // down)
    padded = np.concatenate([np.zeros(taps // 2), samples, np.zeros(taps)])
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n)
    for p in range(up):
        at = np.arange(p, n, up)
        phase, place = (p * down) % up, at * down // up
        for k in range(0, len(at), 1 << 16):
            out[at[k : k + (1 << 16)]] = views[place[k : k + (1 << 16)]] @ phases[phase][::-1]
    return out


@lru_cache
def mel_filters(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as ``[bin, mel]``."""
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(0.0), mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    bins = np.fft.rfftfreq(frame, 1.0 / rate)
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0.0, np.minimum(rise, fall))


def log_mel(samples: np.ndarray, rate: float) -> np.ndarray:
    """``[frame, mel]``, at least one frame; the end is padded with zeros to a whole frame."""
    n = max(1, -(-max(0, len(samples) - FRAME) // HOP) + 1)
    padded = np.zeros((n - 1) * HOP + FRAME)
    padded[: len(samples)] = samples[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, filters = np.hanning(FRAME), mel_filters(rate)
    out = np.empty((n, MELS))
    for k in range(0, n, STEP):
        power = np.abs(np.fft.rfft(frames[k : k + STEP] * window, axis=1)) ** 2
        out[k : k + STEP] = np.log(power @ filters + FLOOR)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames ``[first, stop)`` that rise above the upper threshold and last until they fall below the lower."""
    level = np.median(energy)
    above, below = energy >= level + ENTER_DB, energy < level + LEAVE_DB
    # The state after each frame is that of the last frame that decides: on (above) or off (below).
    deciding = np.where(above | below, np.arange(len(energy)), -1)
    last = np.maximum.accumulate(deciding)
    on = np.where(last >= 0, above[last], False)
    edge = np.diff(np.r_[0, on.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def features(media: bytes) -> dict:
    """``clips`` (start_ms, end_ms, tensor) and ``segments`` (start_ms, end_ms) of a stored file."""
    data, rate = read_back(media)
    samples = (np.frombuffer(data, np.uint8).astype(np.float64) - 128.0) / 128.0
    slow = rate * UP / DOWN
    mel = log_mel(resample(samples), slow)
    energy = 10.0 / np.log(10.0) * np.log(np.exp(mel).sum(axis=1))
    ms = lambda frame: round(frame * HOP * 1000 / slow)
    clips = []
    for k in range(0, len(mel), FRAMES):
        part = np.full((FRAMES, MELS), np.log(FLOOR))
        some = mel[k : k + FRAMES]
        part[: len(some)] = some
        clips.append((ms(k), ms(k + len(some)), part.astype(np.float32)))
    return {"clips": clips, "segments": [{"start_ms": ms(a), "end_ms": ms(b)} for a, b in segments(energy)]}


#: A clip's tensor, and the columns in which clips are stored.
TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS], dim_names=["frame", "mel"])
CLIPS = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("tensor", TENSOR)])


def write_clips(clips: list[tuple[int, int, np.ndarray]]) -> bytes:
    """Clips (start, end, tensor) as an Arrow IPC stream."""
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(np.stack([c[2] for c in clips]))
    columns = [pa.array([c[0] for c in clips], pa.int64()), pa.array([c[1] for c in clips], pa.int64()), pa.ExtensionArray.from_storage(TENSOR, tensors.storage)]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, CLIPS) as stream:
        stream.write_batch(pa.record_batch(columns, schema=CLIPS))
    return out.getvalue().to_pybytes()


def read_clips(stored: bytes) -> pa.Table:
    """The table of clips: ``start_ms``, ``end_ms``, ``tensor`` of shape (FRAMES, MELS)."""
    return pa.ipc.open_stream(stored).read_all()


SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media, clips, spans, means, segments)`` per row: the WAV file; its clips' tensors as an Arrow IPC
    stream (see ``read_clips``), with their time spans and mean values again as columns; and its energy segments.

    A null or empty text is stored as one unit of zeros. Equal texts give equal values: each is worked on alone.
    Null or repeated ids are kept, other columns ignored. An empty table gives no rows. Texts of any length are stored
    whole (to the 4 GiB of the format).
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [store(payload(r)) for r in raw]
                found = [features(m) for m in media]
                spans = [[{"start_ms": a, "end_ms": b} for a, b, _ in f["clips"]] for f in found]
                means = [[round(float(c.mean(dtype=np.float64)), 3) for _, _, c in f["clips"]] for f in found]
                columns = [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array([write_clips(f["clips"]) for f in found], pa.binary())]
                columns += [pa.array(spans, SPANS), pa.array(means, pa.list_(pa.float64())), pa.array([f["segments"] for f in found], SPANS)]
                yield pa.record_batch(columns, ["id", "n_bytes", "media", "clips", "spans", "means", "segments"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    span = "array<struct<start_ms: long, end_ms: long>>"
    return rows.mapInArrow(run, f"id long, n_bytes long, media binary, clips binary, spans {span}, means array<double>, segments {span}")


#: Bytes of a WAV file before its samples.
HEADER = len(store(b""))


def digests(media: DataFrame) -> DataFrame:
    """Columns that pin a stored file down: payload read back from it, checksums, and the features in short."""
    stored = F.expr(f"substring(media, {HEADER + 1}, length(media) - {HEADER})")  # payloads are even, so no pad byte
    rows = media.withColumn("payload", stored)
    feature = F.concat(
        F.lit(f"{FRAMES}x{MELS} clips="), F.size("spans"), F.lit(" segments="), F.size("segments"),
        F.lit(" span_ms="), F.coalesce(F.element_at("spans", -1)["end_ms"], F.lit(0)),
        F.lit(" means="), F.sha2(F.array_join(F.col("means").cast("array<string>"), ","), 256),
    )
    return rows.select(
        F.col("id").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, length(payload) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
