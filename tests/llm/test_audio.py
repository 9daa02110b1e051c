"""Audio columns: exact round trip, filters against plain formulas, segments against a state machine."""

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest

import cutline.llm.audio as A
from cutline.llm.queries import QUERIES

TEXTS = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "The cat. " * 700, "The cat. " * 700]


def test_container_is_read_by_the_standard_library():
    media = A.wav(bytes(range(256)), 8000)
    with wave.open(io.BytesIO(media)) as w:
        assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(999)) == (8000, 1, 1, bytes(range(256)))
    assert A.samples(media) == (bytes(range(256)), 8000)
    with pytest.raises(ValueError):
        A.samples(b"RIFX" + media[4:])


def test_polyphase_equals_upsampled_convolution():
    rng = np.random.default_rng(1)
    x, up, down, taps = rng.integers(0, 256, 200).astype(np.uint8), 5, 8, 8
    got = A.resampled(x, 0, 120, up, down, taps)
    signal = (x.astype(float) - 128) / 128
    for n in (0, 1, 17, 60, 119):
        base, phase = n * down // up, n * down % up
        want = sum(A.phases(up, down, taps)[phase, k] * (signal[base - taps // 2 + k] if 0 <= base - taps // 2 + k < x.size else 0) for k in range(taps))
        assert abs(got[n] - want) < 1e-5
    assert np.allclose(A.resampled(x, 40, 70, up, down, taps), got[40:70])
    tone = lambda f: (128 + 100 * np.sin(2 * np.pi * f * np.arange(4000) / 8000)).astype(np.uint8)
    power = lambda f: A.resampled(tone(f), 100, 2000, 5, 8, 8).std()
    assert power(500) > 5 * power(3800)


def test_blocks_change_nothing(monkeypatch):
    x = np.random.default_rng(2).integers(0, 256, 30_000).astype(np.uint8)
    whole = A.log_mel(x, A.Settings())
    monkeypatch.setattr(A, "BLOCK_FRAMES", 7)
    assert np.allclose(A.log_mel(x, A.Settings()), whole, atol=1e-4) and whole.shape == (373, 16)
    assert A.mel_bank(5000, 128, 16).shape == (65, 16)


def test_segments_equal_a_state_machine():
    rng = np.random.default_rng(3)
    energy = np.cumsum(rng.normal(size=500))
    s = A.Settings(least_frames=1)
    high, low = energy.mean() + .5 * energy.std(), energy.mean()
    on, want = False, []
    for i, e in enumerate(energy):
        before, on = on, e > high or (on and e >= low)
        if on and not before:
            want.append([i, i])
        if on:
            want[-1][1] = i + 1
    assert A.segments(energy, s).tolist() == want
    assert A.segments(np.zeros(0), s).shape == (0, 2)


def test_round_trip_and_query(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op8_audio_features"](spark, str(tmp_path)).collect()}
    media = {r.doc_id: r.media for r in A.store(docs).collect()}
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert A.samples(bytes(media[i]))[0] == payload
    assert got[6].feature == got[7].feature != got[5].feature and got[0].feature == got[1].feature


def test_tensors_have_arrow_s_fixed_shape(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    table = A.features(A.store(docs)).toArrow()
    tensors = A.tensor_table(table)
    assert tensors.num_rows == sum(len(x) for x in table.column("spans").to_pylist()) > 0
    assert tensors.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (8, 16), dim_names=["time", "mel"])
    assert all(0 <= b < e for b, e in zip(tensors.column("begin").to_pylist(), tensors.column("end").to_pylist()))
    assert A.features(A.store(docs.where("false"))).count() == 0


def test_log_mel_equals_its_definition():
    s = A.Settings()
    x = np.random.default_rng(5).integers(0, 256, 900).astype(np.uint8)
    got = A.log_mel(x, s)
    y = A.resampled(x, 0, x.size * 5 // 8, 5, 8, s.taps)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    back = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [back(mel(s.target_rate / 2) * k / (s.bands + 1)) for k in range(s.bands + 2)]
    for frame in (0, 3, len(got) - 1):
        part = [float(y[frame * s.hop + n]) * (0.5 - 0.5 * np.cos(2 * np.pi * n / (s.window - 1))) for n in range(s.window)]
        power = [abs(sum(v * np.exp(-2j * np.pi * k * n / s.window) for n, v in enumerate(part))) ** 2 for k in range(s.window // 2 + 1)]
        for band in range(s.bands):
            low, middle, high = edges[band:band + 3]
            total = 0.0
            for k, p in enumerate(power):
                f = k * s.target_rate / s.window
                total += p * max(0.0, min((f - low) / (middle - low), (high - f) / (high - middle)))
            assert abs(got[frame, band] - np.log(total + 1e-6)) < 1e-3


def test_an_empty_table_a_null_id_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(None, "no id", "x"), (None, "no id", "x"), (1, "long " * 60_000, "x")], "doc_id long, text string, frames string")
    assert A.features(A.store(docs.where("false"))).count() == 0
    rows = A.features(A.store(docs)).collect()
    assert sorted(r.n_bytes for r in rows) == [5, 5, 300_000]
    assert len({r.payload_sha256 for r in rows if r.doc_id is None}) == 1
