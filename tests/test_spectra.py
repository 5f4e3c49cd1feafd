import numpy as np
import pytest
from pyspark.sql import functions as F

from verselake.functions import signal as S
from verselake.functions import spectra

RATE = 16_000


def tone(seconds, hz):
    t = np.arange(int(seconds * RATE)) / RATE
    return (0.3 * np.sin(2 * np.pi * hz * t) + 0.1 * np.sin(4 * np.pi * hz * t)).astype(np.float32)


def test_round_trip():
    rng = np.random.default_rng(1)
    for n, size, hop in ((20_000, 1024, 256), (4097, 1024, 256), (3000, 512, 128), (2500, 500, 120)):
        x = rng.normal(0, 0.2, n).astype(np.float32)
        back = spectra.istft(spectra.stft(x, size, hop), size, hop)
        assert 0 <= n - len(back) <= hop and np.abs(back - x[: len(back)]).max() < 1e-4
    frames = spectra.stft(rng.normal(0, 1, 3000))
    out, weight = np.zeros((2, 1024 + 256 * (len(frames) - 1)))
    for i, f in enumerate(frames):
        out[i * 256 : i * 256 + 1024] += np.fft.irfft(f, 1024) * np.hanning(1024)
        weight[i * 256 : i * 256 + 1024] += np.hanning(1024) ** 2
    want = np.where(weight > 1e-8, out / np.maximum(weight, 1e-8), out)[512:-512]
    assert np.allclose(spectra.istft(frames), want, atol=1e-5)


def test_stretch_and_shift_of_tones():
    x = tone(1.5, 220)
    for rate in (0.7, 1.3):
        y = spectra.time_stretched(x, rate)
        assert len(y) == pytest.approx(len(x) / rate, abs=600) and S.pitch_summary(y, RATE)["median_hz"] == pytest.approx(220, rel=0.01)
    for semitones in (-5, 3, 7):
        y = spectra.pitch_shifted(x, semitones)
        assert len(y) == len(x) and S.pitch_summary(y[2000:-2000], RATE)["median_hz"] == pytest.approx(220 * 2 ** (semitones / 12), rel=0.015)
        assert S.rms(y[4000:-4000]) == pytest.approx(S.rms(x), rel=0.25)
    assert len(spectra.fitted(x, 30_000)) == 30_000 and S.pitch_summary(spectra.fitted(x, 30_000), RATE)["median_hz"] == pytest.approx(220, rel=0.01)
    assert spectra.pitch_shifted(x[:500], 5) is not None and len(spectra.pitch_shifted(x[:500], 5)) == 500
    assert spectra.fitted(x, 0).size == 0 and spectra.fitted(x[:0], 5).tolist() == [0] * 5
    assert spectra.nearest_peaks(np.zeros(9)) is None and spectra.nearest_peaks(np.array([0, 1, 5, 1, 0, 0, 2, 7, 2, 0.0])).tolist() == [2] * 5 + [7] * 5


def test_loudness_and_timbre():
    x = tone(1, 200)
    assert S.rms(spectra.loudness_matched(x, 0.05)) == pytest.approx(0.05, rel=1e-4)
    assert np.abs(spectra.loudness_matched(x, 5.0)).max() == pytest.approx(0.99, rel=1e-4) and np.abs(spectra.loudness_matched(x, 0)).max() == pytest.approx(0.9, rel=1e-4)
    assert spectra.loudness_matched(x[:0], 0.1).size == 0 and not spectra.loudness_matched(np.zeros(9), 0.1).any()
    rng = np.random.default_rng(2)
    bright, dark = rng.normal(0, 0.1, RATE), np.convolve(rng.normal(0, 0.1, RATE), np.ones(12) / 12, "same")
    bands = lambda v: np.array(S.envelope_bands(v, RATE, 28, 90.0, 7600.0))
    moved = spectra.timbre_matched(bright, RATE, bands(dark).tolist())
    assert len(moved) == RATE and np.abs(bands(moved) - bands(dark)).mean() < 0.5 * np.abs(bands(bright) - bands(dark)).mean()
    assert np.array_equal(spectra.timbre_matched(bright, RATE, None), bright.astype(np.float32)) and len(spectra.timbre_matched(bright[:99], RATE, [0.0] * 28)) == 99
    assert np.array_equal(spectra.timbre_matched(bright, RATE, bands(bright).tolist()), bright.astype(np.float32))


def test_columns(spark):
    x = tone(0.3, 220)
    df = spark.createDataFrame([([float(v) for v in x], 4.0, 5000), (None, 1.0, 3), ([0.5], None, None)], "x array<float>, by double, n int")
    got = df.select(spectra.shifted(F.col("x"), F.col("by")).alias("s"), spectra.fitted_to(F.col("x"), F.col("n")).alias("f")).collect()
    assert np.allclose(got[0].s, spectra.pitch_shifted(x, 4.0), atol=1e-6) and len(got[0].f) == 5000
    assert [(r.s, r.f) for r in got[1:]] == [(None, None), (None, None)]
