"""Measurements on sampled sound, in numpy."""

from __future__ import annotations

import numpy as np


def envelope(x: np.ndarray, frame: int = 512, hop: int = 256) -> np.ndarray:
    """Root mean square of overlapping frames."""
    n = max(1, 1 + (len(x) - frame) // hop)
    total = np.concatenate([[0.0], np.cumsum(np.asarray(x, float) ** 2)])
    a = np.arange(n) * hop
    b = np.minimum(a + frame, len(x))
    return np.sqrt(np.maximum(total[b] - total[a], 0) / np.maximum(b - a, 1))


def spectrum(x: np.ndarray, size: int) -> np.ndarray:
    """Magnitudes of one Hann-windowed frame (padded with zeros)."""
    frame = np.zeros(size)
    frame[: min(size, len(x))] = x[:size]
    return np.abs(np.fft.rfft(frame * np.hanning(size + 1)[:-1]))


def centroid(mags: np.ndarray, rate: int) -> float:
    f = np.arange(len(mags)) * rate / (2 * (len(mags) - 1))
    return float((f * mags).sum() / mags.sum()) if mags.sum() > 0 else 0.0


def spread(mags: np.ndarray, rate: int) -> float:
    f, c = np.arange(len(mags)) * rate / (2 * (len(mags) - 1)), centroid(mags, rate)
    return float(np.sqrt((((f - c) ** 2) * mags).sum() / mags.sum())) if mags.sum() > 0 else 0.0


def flatness(mags: np.ndarray) -> float:
    """Geometric over arithmetic mean of power: 0 for a tone, near 1 for noise."""
    p = mags[1:] ** 2 + 1e-12
    return float(np.exp(np.log(p).mean()) / p.mean())


def harmonics(mags: np.ndarray, rate: int, f0: float, most: int = 40, width: float = 0.15) -> tuple[float, float, float]:
    """Share of energy near harmonics of f0, odd share of that, and inharmonicity (what chance coverage of the windows is allowed for)."""
    bin_hz = rate / (2 * (len(mags) - 1))
    power = mags**2
    total = power[1:].sum()
    if total <= 0 or f0 <= 0:
        return 0.0, 0.5, 0.0
    taken, odd = np.zeros(len(power), bool), 0.0
    reach = max(2, int(round(width * f0 / bin_hz)))
    for h in range(1, most + 1):
        at = int(round(h * f0 / bin_hz))
        if at >= len(power):
            break
        own = slice(max(1, at - reach), at + reach + 1)
        if h % 2:
            odd += power[own][~taken[own]].sum()
        taken[own] = True
    inside = power[taken].sum()
    share = inside / total
    covered = taken[1:].mean()
    return float(share), float(odd / inside) if inside > 0 else 0.5, float(np.clip((1 - share) / (1 - min(0.95, covered)), 0, 1))


def track(x: np.ndarray, rate: int, f0: float, hop: float = 0.01) -> np.ndarray:
    """Instantaneous frequency around f0: phase steps of the signal shifted down by f0."""
    t = np.arange(len(x)) / rate
    z = np.asarray(x) * np.exp(-2j * np.pi * f0 * t)
    width = max(8, int(rate / f0 * 2))
    kernel = np.hanning(width)
    low = np.convolve(z, kernel / kernel.sum(), "same")
    step = max(1, int(hop * rate))
    phase = np.unwrap(np.angle(low[::step]))
    return f0 + np.diff(phase) / (2 * np.pi) * rate / step


def moving_average(x: np.ndarray, half: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(len(x))
    a, b = np.maximum(i - half, 0), np.minimum(i + half + 1, len(x))
    return (total[b] - total[a]) / (b - a)


def wobble(x: np.ndarray, half: int) -> float:
    """Root mean square of what a moving average leaves, over the mean."""
    m = x.mean() if len(x) else 0.0
    return float(np.sqrt(((x - moving_average(x, half)) ** 2).mean()) / m) if m > 0 else 0.0


def slope(x: np.ndarray, y: np.ndarray) -> float:
    d = x - x.mean() if len(x) else x
    return float((d * (y - y.mean())).sum() / (d @ d)) if len(x) > 1 and d @ d > 0 else 0.0


def decibel(x: np.ndarray | float) -> np.ndarray:
    return 20 * np.log10(np.maximum(x, 1e-9))
