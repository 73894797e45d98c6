import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from almoner.llm import audio


def test_wav_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 3):
        wav = audio.to_wav(audio.pad(data))
        samples, rate = audio.from_wav(wav)
        assert samples[: len(data)] == data and not any(samples[len(data) :]) and len(samples) % 64 == 0 and len(samples) > 0 and rate == audio.RATE
    with pytest.raises(ValueError):
        audio.from_wav(b"RIFFxxxxWAVE")


def test_resampler_is_the_direct_filter():
    x = np.random.default_rng(0).normal(size=300).astype(np.float32)
    for up, down in ((1, 2), (2, 3), (3, 1)):
        taps = audio._bank(up, down).T.ravel()
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        full = np.convolve(np.concatenate([wide, np.zeros(audio.TAPS * up)]), taps)
        want = full[(audio.TAPS // 2 - 1) * up : (audio.TAPS // 2 - 1) * up + len(x) * up][::down]
        assert np.allclose(audio.resample(x, up, down), want[: -(-len(x) * up // down)], atol=1e-4)


def test_a_tone_passes_and_lights_one_band():
    t = np.arange(16_000) / audio.RATE
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    tensors, spans, _ = audio.features(tone)
    frames = tensors.reshape(-1, audio.MELS)[:50]
    assert len(set(frames.argmax(1).tolist())) == 1 and spans[0][0] == 0 and abs(spans[-1][1] - 1.0) < 0.05
    assert tensors.shape[1:] == (audio.CLIP_FRAMES, audio.MELS)
    high = (128 + 100 * np.sin(2 * np.pi * 7000 * t)).astype(np.uint8).tobytes()
    assert audio.features(high)[0].max() < tensors.max() - 3  # above the new Nyquist frequency


def test_blocks_join_without_a_seam(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 50_000).astype(np.uint8).tobytes()
    whole = audio.features(x)[0]
    monkeypatch.setattr(audio, "BLOCK", 4096)
    assert np.allclose(audio.features(x)[0], whole, atol=1e-3)


def test_segments_have_hysteresis():
    db = np.array([0, 0, 10, 7, 7, 5, 7, 8, 12, 5, 0])
    assert audio.segments(db) == [(2, 5), (8, 9)]


def test_rows(spark, edge, empty):
    rows = audio.audio_features(edge).collect()
    assert len(rows) == edge.count()
    by_text = {}
    for r, d in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(edge.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id)), strict=True):
        payload = audio.pad((d.text or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((d.text or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(d.text or "", r[1:]) == r[1:]
    assert audio.audio_features(empty).isEmpty()


def test_tensors(spark, edge):
    media = audio.to_media(edge.filter("doc_id = 8"))
    stored = audio.to_clips(media)
    rows = audio.clips(stored).orderBy("clip").collect()
    payload = audio.from_wav(media.first().media)[0]
    want, spans, _ = audio.features(payload)
    assert np.allclose(np.array([r.tensor for r in rows]).reshape(want.shape), want) and [r.start_s for r in rows] == spans[:, 0].tolist()
    kind = pa.ipc.open_stream(bytes(stored.first().clips)).schema.field("tensor").type
    assert kind == audio.tensor_type() and kind.shape == [audio.CLIP_FRAMES, audio.MELS]


def brute(samples):
    """Log-mel frames by direct sums, and the active spans by a state machine."""
    x = [(v - 128) / 128 for v in samples]
    taps = audio._bank(audio.UP, audio.DOWN).T.ravel().astype(float)
    half = audio.TAPS // 2
    y = [sum(taps[k] * x[i + half - 1 - k] for k in range(len(taps)) if 0 <= i + half - 1 - k < len(x)) for i in range(0, len(x), audio.DOWN)]
    y += [0.0] * (audio.FRAME - len(y))
    rate, n, width = audio.RATE // 2, audio.FRAME, audio.MELS
    mel = [(2595 * math.log10(1 + rate / 2 / 700)) * i / (width + 1) for i in range(width + 2)]
    edges = [700 * (10 ** (m / 2595) - 1) / rate * n for m in mel]
    wave = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    frames = []
    for at in range(0, len(y) - n + 1, audio.HOP):
        power = np.abs(wave @ [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1))) for i, v in enumerate(y[at : at + n])]) ** 2
        frames.append([math.log(1e-6 + sum(p * max(0, min((k - a) / (b - a), (c - k) / (c - b))) for k, p in enumerate(power))) for a, b, c in zip(edges, edges[1:], edges[2:], strict=False)])
    db = [10 * math.log10(sum(math.exp(v) for v in f) / width) for f in frames]
    on, spans = False, []
    for i, v in enumerate(db):
        opened, closed = v >= min(db) + audio.OPEN_DB, v < min(db) + audio.CLOSE_DB
        if opened and not on:
            spans.append([i, i + 1])
        on = opened or (on and not closed)
        if on:
            spans[-1][1] = i + 1
    return np.array(frames), [(a * audio.HOP / rate, ((b - 1) * audio.HOP + n) / rate) for a, b in spans]


def test_query_equals_brute_force(spark):
    texts = ["", "short", "Plain prose with some words. " * 60, "a" * 900 + "Zq~\u00e9" * 200 + "a" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in audio.audio_features(docs).collect():
        frames, spans = brute(audio.pad(texts[r.doc_id].encode()))
        count = -(-len(frames) // audio.CLIP_FRAMES)
        padded = np.concatenate([frames, np.zeros((count * audio.CLIP_FRAMES - len(frames), audio.MELS))])
        shape, mean, active, _ = r.feature.split(";")
        assert shape == f"{count}x{audio.CLIP_FRAMES}x{audio.MELS}" and r.n_clips == count
        assert np.allclose([float(v) for v in mean.removeprefix("mean=").split(",")], padded.mean(0), atol=0.02)
        assert r.n_segments == len(spans) and abs(float(active.split(":")[1][:-1]) - sum(b - a for a, b in spans)) < 0.002
