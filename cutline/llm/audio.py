"""Audio columns: 8-bit samples in a lossless container, resampled log-mel features, energy segments as fixed-shape tensors."""

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

UNIT = 64                # payloads are a positive multiple of so many bytes
BLOCK_FRAMES = 4096      # frames whose samples are in memory at once
BATCH_BYTES = 8 << 20    # media bytes of one batch that leaves a task


@dataclass(frozen=True)
class Settings:
    """Rates in hertz, windows in resampled samples, tensor shape as (slots in time, mel bands)."""

    rate: int = 8000
    target_rate: int = 5000
    window: int = 128
    hop: int = 50
    bands: int = 16
    slots: int = 8
    taps: int = 8
    raise_by: float = 0.5   # a segment opens this many deviations above the mean energy
    fall_by: float = 0.0    # and closes below this many
    least_frames: int = 3


def wav(payload: bytes, rate: int) -> bytes:
    """Mono 8-bit PCM in a RIFF container."""
    body = b"fmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + rate.to_bytes(4, "little") * 2 \
        + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"data" + len(payload).to_bytes(4, "little") + payload
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body


def samples(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a mono 8-bit container, found by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at:at + 4], int.from_bytes(media[at + 4:at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate = (int.from_bytes(media[at + a:at + b], "little") for a, b in ((8, 10), (10, 12), (12, 16)))
            if (kind, channels, int.from_bytes(media[at + 22:at + 24], "little")) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples are read")
        if name == b"data":
            return media[at + 8:at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """One row of filter taps per phase: a windowed sinc below the lower of both half rates."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(cut * t) * cut * up * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    rows = h.reshape(taps, up).T[:, ::-1]
    return np.ascontiguousarray(rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resampled(x: np.ndarray, first: int, last: int, up: int, down: int, taps: int) -> np.ndarray:
    """Outputs [first, last) of the polyphase filter; beyond its ends the signal is silent."""
    n = np.arange(first, last, dtype=np.int64) * down
    base, phase = n // up, n % up
    lead = taps // 2
    lo, hi = int(base[0]) - lead, int(base[-1]) - lead + taps
    held = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, x.size)
    if a < b:
        held[a - lo:b - lo] = (x[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(held, taps)[base - base[0]]
    return np.einsum("ij,ij->i", windows, phases(up, down, taps)[phase])


@lru_cache(maxsize=8)
def mel_bank(rate: int, window: int, bands: int) -> np.ndarray:
    """Overlapped triangles, equally spaced on the mel scale, over the spectrum's bins."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.arange(window // 2 + 1) * rate / window
    up, down = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray, s: Settings) -> np.ndarray:
    """(frames, bands) of 8-bit samples, block by block."""
    common = gcd(s.target_rate, s.rate)
    up, down = s.target_rate // common, s.rate // common
    total = x.size * up // down
    frames = max(1, 1 + (total - s.window) // s.hop) if total else 0
    out = np.empty((frames, s.bands), np.float32)
    taper = np.hanning(s.window).astype(np.float32)
    for a in range(0, frames, BLOCK_FRAMES):
        b = min(a + BLOCK_FRAMES, frames)
        y = resampled(x, a * s.hop, (b - 1) * s.hop + s.window, up, down, s.taps)
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, s.window)[::s.hop] * taper)) ** 2
        out[a:b] = np.log(power.astype(np.float32) @ mel_bank(s.target_rate, s.window, s.bands) + 1e-6)
    return out


def segments(energy: np.ndarray, s: Settings) -> np.ndarray:
    """[first, past the last] frames of segments: opened above the higher threshold, held until below the lower one."""
    if not energy.size:
        return np.zeros((0, 2), np.int64)
    high, low = energy.mean() + s.raise_by * energy.std(), energy.mean() + s.fall_by * energy.std()
    event = np.where(energy > high, 1, np.where(energy < low, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(event.size), -1))
    on = (last >= 0) & (event[np.maximum(last, 0)] > 0)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    spans = np.stack([np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]], axis=1)
    return spans[spans[:, 1] - spans[:, 0] >= s.least_frames]


def pooled(mel: np.ndarray, spans: np.ndarray, s: Settings) -> np.ndarray:
    """(segments, slots, bands): each segment's frames averaged over equal slots of its time."""
    total = np.concatenate([np.zeros((1, s.bands)), np.cumsum(mel, axis=0, dtype=np.float64)])
    width = spans[:, 1:] - spans[:, :1]
    a = spans[:, :1] + np.arange(s.slots) * width // s.slots
    b = np.maximum(spans[:, :1] + (np.arange(s.slots) + 1) * width // s.slots, a + 1)
    return ((total[b] - total[a]) / (b - a)[..., None]).astype(np.float32)


def store(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, zeros up to a positive multiple of 64, as a WAV file.

    A null text is stored like an empty one; repeated rows stay; a null doc_id is kept; an empty table gives an empty
    result. Other columns are not read.
    """
    def run(batches):
        for batch in batches:
            held, first, sizes, media = 0, 0, [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                text = text or b""
                sizes.append(len(text))
                media.append(wav(text + b"\0" * (-len(text) % UNIT if text else UNIT), settings.rate))
                held += len(text)
                if held >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())],
                                                     names=["doc_id", "n_bytes", "media"])
                    held, first, sizes, media = 0, i + 1, [], []
    schema = docs.select("doc_id", F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("media")).schema
    return texts_of(docs, "doc_id").mapInArrow(run, schema)


def features(stored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Read the stored media back and compute, per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, frames, mel_mean, spans (begin and end in seconds) and tensors.

    ``tensors`` has one flat tensor of slots x bands per span; ``tensor_table`` gives them Arrow's fixed-shape type. Equal media
    have equal values; a null medium has nulls.
    """
    kinds = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "frames": "long",
             "mel_mean": "array<float>", "spans": "array<struct<begin:double,end:double>>", "tensors": "array<array<float>>"}
    arrow = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "frames": pa.int64(),
             "mel_mean": pa.list_(pa.float32()), "spans": pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())])), "tensors": pa.list_(pa.list_(pa.float32()))}
    s = settings

    def one(media):
        payload, _ = samples(media)
        mel = log_mel(np.frombuffer(payload, np.uint8), s)
        spans = segments(mel.mean(1), s)
        seconds = np.stack([spans[:, 0] * s.hop, (spans[:, 1] - 1) * s.hop + s.window], axis=1) / s.target_rate
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel),
                mel.mean(0, dtype=np.float64).astype(np.float32).tolist(), [{"begin": a, "end": b} for a, b in seconds.tolist()],
                pooled(mel, spans, s).reshape(len(spans), s.slots * s.bands).tolist())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [(None,) * len(kinds) if m is None else one(m.as_py()) for m in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow.values())]],
                                                 names=["doc_id", "n_bytes", *arrow])

    rows = stored.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(run, rows.select("doc_id", "n_bytes", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()]).schema)


def tensor_table(table: pa.Table, settings: Settings = Settings()) -> pa.Table:
    """One row per span of an Arrow table of ``features``: doc_id, begin, end and a fixed-shape tensor (slots, bands)."""
    spans = table.column("spans").combine_chunks()
    at = pa.compute.list_parent_indices(spans)
    flat = table.column("tensors").combine_chunks().flatten()
    shape = (settings.slots, settings.bands)
    storage = pa.FixedSizeListArray.from_arrays(flat.flatten(), settings.slots * settings.bands)
    tensor = pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), shape, dim_names=["time", "mel"]), storage)
    inner = spans.flatten()
    return pa.table({"doc_id": table.column("doc_id").take(at), "begin": inner.field("begin"), "end": inner.field("end"), "tensor": tensor})
