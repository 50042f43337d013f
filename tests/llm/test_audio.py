import hashlib
import zlib

import numpy as np
import pytest

from quillgraph.llm import audio
from quillgraph.llm.registry import op8_audio_features


@pytest.mark.parametrize("data", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 5])
def test_bytes_survive_the_round_trip(data):
    padded = audio.payload(data)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(data) and not padded[len(data) :].strip(b"\0") and len(padded) - len(data) <= 64
    assert audio.read_back(audio.store(padded)) == (padded, audio.RATE)


@pytest.mark.parametrize("up, down", [(2, 3), (1, 2), (3, 2), (3, 4), (441, 640)])
def test_resampling_keeps_a_low_tone_and_drops_a_high_one(up, down):
    t = np.arange(16_000) / 16_000
    rate = 16_000 * up / down
    low, high = audio.resample(np.sin(2 * np.pi * 500 * t), up, down), audio.resample(np.sin(2 * np.pi * 7000 * t), up, down)
    assert len(low) == -(-16_000 * up // down)
    want = np.sin(2 * np.pi * 500 * np.arange(len(low)) / rate)
    assert np.abs(low - want)[100:-100].max() < 0.05 and (up > down or np.abs(high)[100:-100].max() < 0.05)


def test_resampling_against_the_sum(up=audio.UP, down=audio.DOWN):
    """Each output as the windowed sinc around its time, input by input."""
    x = np.random.default_rng(1).normal(size=150)
    got = audio.resample(x, up, down)
    reach = -(-audio.TAPS * max(up, down) // (2 * up)) * up
    window, cut = np.hamming(2 * reach + 1), 1 / max(up, down)
    assert up > 1 and down > 1  # the query's filter has several phases
    for n in range(len(got)):
        weights = {m: np.sinc((n * down - m * up) * cut) * window[n * down - m * up + reach] for m in range(-80, 300) if abs(n * down - m * up) <= reach}
        assert np.isclose(got[n], sum(w * x[m] for m, w in weights.items() if 0 <= m < len(x)) / sum(weights.values()), atol=1e-9)


def test_log_mel_against_the_transform_by_definition():
    x, rate = np.random.default_rng(2).normal(size=700), 10_000.0
    got = audio.log_mel(x, rate)
    k = np.arange(audio.FRAME // 2 + 1)[:, None]
    for frame in range(len(got)):
        part = np.zeros(audio.FRAME)
        some = x[frame * audio.HOP : frame * audio.HOP + audio.FRAME]
        part[: len(some)] = some
        turned = (part * np.hanning(audio.FRAME) * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FRAME)).sum(axis=1)
        mel = lambda hz: 2595 * np.log10(1 + hz / 700)
        edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(rate / 2), audio.MELS + 2)]
        for j in range(audio.MELS):
            total = 0.0
            for bin_, power in enumerate(np.abs(turned) ** 2):
                hz = bin_ * rate / audio.FRAME
                total += power * max(0.0, min((hz - edges[j]) / (edges[j + 1] - edges[j]), (edges[j + 2] - hz) / (edges[j + 2] - edges[j + 1])))
            assert np.isclose(got[frame, j], np.log(total + audio.FLOOR), atol=1e-6)
    assert len(got) == 5


def test_a_tone_peaks_in_its_filter():
    mel = audio.log_mel(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000), 8000.0)
    centre = (audio.mel_filters(8000.0) * np.fft.rfftfreq(256, 1 / 8000)[:, None]).sum(0) / audio.mel_filters(8000.0).sum(0)
    assert abs(centre[mel.mean(0).argmax()] - 1000) < 150 and mel.shape == (62, audio.MELS)


def test_hysteresis():
    energy = np.array([0, 0, 2, 1, 1, 0.2, 1, 2, 0, 0, 0, 0])
    assert audio.segments(energy) == [(2, 5), (7, 8)]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_audio_features(spark, sf).collect()
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        padded = audio.payload(texts[r.doc_id].encode())
        media = audio.store(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(texts[r.doc_id].encode()), len(padded), hashlib.sha256(padded).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(texts[r.doc_id], r.feature) == r.feature


def test_clips_are_tensors_that_cover_the_recording(spark):
    docs = spark.createDataFrame([(None, None, "x"), (1, "", None), (1, "ab" * 40_000, None)], "doc_id long, text string, media string")
    rows = sorted(audio.media_columns(docs).collect(), key=lambda r: r.n_bytes)
    tables = [audio.read_clips(bytes(r.clips)) for r in rows]
    assert [t.num_rows for t in tables[:2]] == [1, 1] and rows[0].clips == rows[1].clips
    last = tables[2]
    assert last.schema.field("tensor").type.shape == [audio.FRAMES, audio.MELS]
    tensors = last.column("tensor").combine_chunks().to_numpy_ndarray()
    assert tensors.shape == (last.num_rows, audio.FRAMES, audio.MELS) and tensors.dtype == np.float32
    want = audio.features(audio.store(audio.payload(b"ab" * 40_000)))["clips"]
    assert all((a == b[2]).all() for a, b in zip(tensors, want))
    starts, ends = last.column("start_ms").to_pylist(), last.column("end_ms").to_pylist()
    assert [(s.start_ms, s.end_ms) for s in rows[2].spans] == list(zip(starts, ends)) and starts[1:] == ends[:-1] and abs(ends[-1] - 5000) < 40
    assert np.allclose(rows[2].means, tensors.mean(axis=(1, 2)), atol=1e-3)
    assert audio.digests(audio.media_columns(docs.limit(0))).count() == 0
