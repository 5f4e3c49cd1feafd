"""Short-time spectra: transform and overlap-add, time stretching, pitch shifting, loudness and timbre matching.

Kernels work on one clip; the Column forms run them over rows of samples in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from verselake.functions import signal as S

SIZE, HOP = 1024, 256
#: Loudest peak, peak of a clip without a target loudness; bands of a matching equaliser with their range, the
#: most gain, the least gain that is worth it (dB), and the bands that a gain is averaged over on either side.
LOUDEST, DEFAULT_PEAK = 0.99, 0.9
BANDS, BAND_LOW, BAND_HIGH, MOST_DB, LEAST_DB, SMOOTH = 28, 90.0, 7600.0, 9.0, 1.0, 2


def stft(samples: np.ndarray, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """(frames, bins) under a Hann window; the clip is mirrored by half a window at both ends."""
    padded = np.pad(np.asarray(samples, float), size // 2, mode="reflect")
    view = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    return np.fft.rfft(view * S.hann(size), axis=1)


def istft(spectra: np.ndarray, size: int = SIZE, hop: int = HOP) -> np.ndarray:
    """Samples by overlap-add, weighted so that an unchanged spectrum gives its clip back (to a whole number of hops)."""
    window, n = S.hann(size), len(spectra)
    parts = np.fft.irfft(spectra, size, axis=1) * window
    out, weight = np.zeros((2, hop * (n - 1) + size + (-size) % hop))
    slots = -(-size // hop)
    wide = np.pad(parts, ((0, 0), (0, slots * hop - size))).reshape(n, slots, hop)
    square = np.pad(window * window, (0, slots * hop - size)).reshape(slots, hop)
    # Frame i covers the hops i, i + 1...; the k-th hop of every frame is added at once.
    rows, weights = out.reshape(-1, hop), weight.reshape(-1, hop)
    for k in range(slots):
        rows[k : k + n] += wide[:, k]
        weights[k : k + n] += square[k]
    np.divide(out, weight, out=out, where=weight > 1e-8)
    return out[size // 2 : hop * (n - 1) + size - size // 2].astype(np.float32)


def nearest_peaks(magnitude: np.ndarray) -> np.ndarray | None:
    """For each bin the bin of the peak whose region it is in, borders half-way; None without a peak (greater than two
    neighbours on either side)."""
    around = np.lib.stride_tricks.sliding_window_view(magnitude, 5)
    peaks = 2 + np.flatnonzero((around[:, 2:3] > around[:, [0, 1, 3, 4]]).all(axis=1))
    return peaks[np.searchsorted((peaks[1:] + peaks[:-1]) / 2, np.arange(len(magnitude)))] if len(peaks) else None


def stretched_spectra(spectra: np.ndarray, rate: float, hop: int = HOP) -> np.ndarray:
    """Frames at every ``rate``-th place of the given ones, by a phase vocoder with phases locked to peaks: the phase of a peak
    advances by its true frequency, and the bins of its region keep their distance to it."""
    n, bins = spectra.shape
    at = np.arange(0, n, rate)
    left = np.floor(at).astype(int)
    share = (at - left)[:, None]
    held = np.vstack([spectra, np.zeros((2, bins))])
    size, phase = np.abs(held), np.angle(held)
    usual = 2 * np.pi * hop * np.arange(bins) / (2 * (bins - 1))
    drift = phase[left + 1] - phase[left] - usual
    advance = usual + drift - 2 * np.pi * np.round(drift / (2 * np.pi))
    free = phase[0] + np.vstack([np.zeros(bins), np.cumsum(advance, axis=0)[:-1]])
    owners = {k: nearest_peaks(size[k]) for k in np.unique(left).tolist()}
    out = np.empty((len(at), bins), complex)
    for i, k in enumerate(left.tolist()):
        owner = owners[k]
        out[i] = np.exp(1j * (free[i] if owner is None else phase[k] + (free[i] - phase[k])[owner]))
    return out * ((1 - share) * size[left] + share * size[left + 1])


def time_stretched(samples: np.ndarray, rate: float) -> np.ndarray:
    """``rate`` times as fast at the same pitch."""
    if rate <= 0 or abs(rate - 1) < 1e-3 or len(samples) < SIZE:
        return np.asarray(samples, np.float32)
    return istft(stretched_spectra(stft(samples), rate))


def pitch_shifted(samples: np.ndarray, semitones: float) -> np.ndarray:
    """Higher or lower in the same time: stretched, then brought back to its length."""
    if abs(semitones) < 1e-2 or len(samples) < SIZE:
        return np.asarray(samples, np.float32)
    return S.stretched(time_stretched(samples, 2 ** (-semitones / 12)), len(samples))


def fitted(samples: np.ndarray, count: int) -> np.ndarray:
    """As many samples as asked for, at the same pitch."""
    if count <= 0 or not len(samples):
        return np.zeros(max(0, count), np.float32)
    close = abs(len(samples) - count) <= 2
    return S.stretched(samples if close else time_stretched(samples, len(samples) / count), count)


def loudness_matched(samples: np.ndarray, target: float) -> np.ndarray:
    """Scaled to a target RMS, or to a usual peak without one, and never above the loudest peak."""
    peak, now = (float(np.max(np.abs(samples))), S.rms(samples)) if len(samples) else (0.0, 0.0)
    if peak <= 1e-6:
        return np.asarray(samples, np.float32)
    gain = target / now if target > 1e-5 and now > 1e-6 else DEFAULT_PEAK / peak
    return (np.asarray(samples) * min(gain, LOUDEST / peak)).astype(np.float32)


def timbre_matched(samples: np.ndarray, rate: int, target: list[float] | None) -> np.ndarray:
    """With its spectrum's envelope bent towards target bands (of ``signal.envelope_bands``): a smooth, bounded equaliser; the
    clip as it is where there is no target, it is too short, or the change is too small to hear."""
    own = S.envelope_bands(samples, rate, BANDS, BAND_LOW, BAND_HIGH, SIZE, HOP) if target is not None and len(target) == BANDS else None
    if own is None:
        return np.asarray(samples, np.float32)
    change = 20 / np.log(10) * (np.asarray(target) - own)
    gain = np.convolve(change, np.full(2 * SMOOTH + 1, 1 / (2 * SMOOTH + 1)), "same")
    if np.abs(gain).max() < LEAST_DB:
        return np.asarray(samples, np.float32)
    edges = np.geomspace(BAND_LOW, max(min(BAND_HIGH, 0.485 * rate), 2 * BAND_LOW), BANDS + 1)
    centres = np.sqrt(edges[1:] * edges[:-1])
    bins = np.maximum(np.fft.rfftfreq(SIZE, 1 / rate), 1.0)
    linear = 10 ** (np.clip(gain, -MOST_DB, MOST_DB) / 20)
    return S.stretched(istft(stft(samples) * np.interp(np.log(bins), np.log(centres), linear)), len(samples))


def shifted(samples: Column, semitones: Column) -> Column:
    """``pitch_shifted`` of arrays of samples; null where either is null."""

    @pandas_udf("array<float>")
    def run(x: pd.Series, by: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or b != b else pitch_shifted(np.asarray(a, np.float32), float(b)).tolist() for a, b in zip(x, by)], dtype=object)

    return run(samples, semitones)


def fitted_to(samples: Column, count: Column) -> Column:
    """``fitted`` of arrays of samples; null where either is null."""

    @pandas_udf("array<float>")
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None or b != b else fitted(np.asarray(a, np.float32), int(b)).tolist() for a, b in zip(x, n)], dtype=object)

    return run(samples, count)
