import hashlib
import zlib

import numpy as np

from topicloom.llm import op4_media as op


def test_whole_table(spark, docs, texts, empty):
    rows = op.audio_features(op.media_column(docs)).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = op.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["feature"]) == r["feature"]
        assert all(s["start_s"] < s["stop_s"] and len(s["tensor"]) == op.PARTS * op.MELS for s in r["segments"])
    tensors = op.tensors([s["tensor"] for r in rows for s in r["segments"]])
    assert tensors.type.shape == list(op.SHAPE)
    assert sorted(map(str, op.media_features(docs).collect())) == sorted(map(str, rows))
    assert op.audio_features(op.media_column(empty)).count() == 0


def test_round_trip_and_other_chunks():
    raw = bytes(range(256)) * 4
    assert op.samples_of(op.wav(raw)) == raw
    media = op.wav(raw)
    assert op.samples_of(media[:12] + b"LIST\x03\0\0\0abc\0" + media[12:]) == raw


def test_resampling_keeps_a_tone_and_its_pitch(monkeypatch):
    t = np.arange(16_000) / op.RATE
    x = np.sin(2 * np.pi * 1000 * t).astype(np.float32)
    y = op.resample(x, np.zeros(op.TAPS, np.float32))
    spectrum = np.abs(np.fft.rfft(y[1000:9000] * np.hanning(8000)))
    assert abs(spectrum.argmax() * op.RATE * op.UP / op.DOWN / 8000 - 1000) < 2
    assert abs(np.abs(y[1000:9000]).max() - 1) < 0.05
    samples = bytes(np.random.default_rng(1).integers(0, 256, 40_000, np.uint8))
    whole = op.log_mel(samples)
    monkeypatch.setattr(op, "BLOCK", op.DOWN * 512)
    assert np.allclose(op.log_mel(samples), whole, atol=1e-4)


def test_hysteresis():
    e = np.array([0, 0, 10, 4, 4, 0, 4, 0, 10, 0], float)
    assert op.segments(e).tolist() == [[2, 5], [8, 9]]
    assert op.segments(np.zeros(4)).tolist() == [[0, 4]]


def plain_features(samples):
    """The same from the definitions: up-sampled by zeros, filtered, every DOWN-th kept; a DFT a frame; segments and parts by loops."""
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    i = np.arange(op.UP * op.TAPS) - (op.UP * op.TAPS - 1) / 2
    h = np.sinc(i / op.DOWN) * np.hamming(op.UP * op.TAPS)
    wide = np.zeros(len(x) * op.UP)
    wide[:: op.UP] = x
    y = np.convolve(wide, h * op.UP / h.sum())[: len(wide) : op.DOWN]
    y = np.concatenate([y, np.zeros(op.FRAME - len(y) if len(y) < op.FRAME else -(len(y) - op.FRAME) % op.HOP)])
    rate = op.RATE * op.UP / op.DOWN
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + rate / 1400), op.MELS + 2)]
    n = np.arange(op.FRAME)
    dft = np.exp(-2j * np.pi * np.outer(np.arange(op.FRAME // 2 + 1), n) / op.FRAME)
    mel = []
    for at in range(0, len(y) - op.FRAME + 1, op.HOP):
        power = np.abs(dft @ (y[at : at + op.FRAME] * np.hanning(op.FRAME))) ** 2
        row = []
        for m in range(op.MELS):
            a, b, c = edges[m : m + 3]
            row.append(np.log(1e-6 + sum(p * max(0, min((f - a) / (b - a), (c - f) / (c - b))) for p, f in zip(power, np.arange(len(power)) * rate / op.FRAME))))
        mel.append(row)
    mel = np.array(mel)
    energy = mel.mean(axis=1)
    found, start = [], None
    for k, e in enumerate(energy):
        if start is None and e >= energy.mean() + energy.std() / 2:
            start = k
        elif start is not None and e < energy.mean():
            found.append((start, k))
            start = None
    if start is not None:
        found.append((start, len(energy)))
    found = found if found and energy.std() > 1e-9 else [(0, len(energy))]
    tensors = []
    for a, b in found:
        parts = [(a + (b - a) * q / op.PARTS, a + (b - a) * (q + 1) / op.PARTS) for q in range(op.PARTS)]
        tensors.append([mel[int(np.floor(u)) : max(int(np.floor(u)) + 1, int(np.ceil(v)))].mean(axis=0) for u, v in parts])
    return [(a * op.HOP / rate, b * op.HOP / rate) for a, b in found], np.array(tensors)


def test_features_against_the_definitions(spark):
    rng = np.random.default_rng(4)
    texts = ["", "short", "".join(chr(rng.integers(32, 127)) for _ in range(2_000)), "".join(" " * rng.integers(0, 300) + "zZ~" * rng.integers(1, 200) for _ in range(12)), "ü€" * 700]
    rows = op.media_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        spans, tensors = plain_features(raw + bytes(-len(raw) % 64 if raw else 64))
        assert [(s["start_s"], s["stop_s"]) for s in r["segments"]] == spans
        assert np.allclose(np.array([s["tensor"] for s in r["segments"]]).reshape(-1, *op.SHAPE), tensors, atol=2e-3)


def test_the_end_of_a_payload_counts_and_the_shape_is_in_the_schema(spark):
    one, two = "a" * 344 + "b" * 40, "a" * 344 + "c" * 40
    got = op.media_features(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"))
    assert len({str(r["segments"]) for r in got.collect()}) == 2
    assert got.schema["segments"].dataType.elementType["tensor"].metadata == {"shape": list(op.SHAPE)}
