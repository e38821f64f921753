"""Small numpy helpers used on one window (or one chunk) at a time inside Spark tasks."""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# Fixed filter coefficients: Butterworth band-pass (order 2, 0.7-3.5 Hz at 50 Hz) for the pulse signal and
# Butterworth low-pass (order 4, 10 Hz at 500 Hz) for the muscle signal.
PULSE_BAND = (
    (0.02463060804906884, 0.0, -0.04926121609813769, 0.0, 0.02463060804906884),
    (1.0, -3.441204520171591, 4.506969114694767, -2.6726867979304316, 0.6081056913893528),
)
MUSCLE_LOW = (
    (1.32937288987529e-05, 5.31749155950116e-05, 7.97623733925174e-05, 5.31749155950116e-05, 1.32937288987529e-05),
    (1.0, -3.671729089161935, 5.067998386734189, -3.1159669252017452, 0.7199103272918712),
)
PULSE_HZ = 50.0
MAX_BPM = 220
EDGE = 15  # samples of odd extension on both sides
NEAR = 1e-9  # relative distance of powers that rounding may have told apart
MEMORY = 2048  # impulse responses are below 1e-30 after this many samples


@lru_cache(maxsize=None)
def impulse_response(b: tuple, a: tuple) -> np.ndarray:
    h = np.zeros(MEMORY)
    for i in range(MEMORY):
        acc = b[i] if i < len(b) else 0.0
        for k in range(1, min(i, len(a) - 1) + 1):
            acc -= a[k] * h[i - k]
        h[i] = acc
    return h


def _one_way(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Causal filter of a signal whose first value held for ever before it (steady-state start)."""
    padded = np.concatenate([np.full(MEMORY, x[0]), x])
    size = 1 << int(np.ceil(np.log2(len(padded) + MEMORY)))
    y = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(h, size), size)
    return y[MEMORY:MEMORY + len(x)]


def zero_phase(x: np.ndarray, coefficients: tuple) -> np.ndarray | None:
    """Forward and backward filtering with odd edge extension; None when the signal is too short for the edges."""
    n = len(x)
    if n <= EDGE:
        return None
    h = impulse_response(*coefficients)
    offset = x[0]  # the extension and both passes are linear, so work around the first value for precision
    z = x - offset
    left = 2 * z[0] - z[EDGE:0:-1]
    right = 2 * z[-1] - z[-2:-EDGE - 2:-1]
    forward = _one_way(np.concatenate([left, z, right]), h)
    both = _one_way(forward[::-1], h)[::-1]
    gain = sum(coefficients[0]) / sum(coefficients[1])
    return both[EDGE:EDGE + n] + offset * gain * gain


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Indices of peaks; a flat top counts once, at the floor of its middle; ends never count."""
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0]))
    ends = np.concatenate([starts[1:] - 1, [len(x) - 1]])
    level = x[starts]
    top = np.zeros(len(starts), dtype=bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[top] + ends[top]) // 2


def spaced_peaks(x: np.ndarray, distance: int) -> np.ndarray:
    """Peaks at least `distance` samples apart, the highest kept first."""
    peaks = local_maxima(x)
    keep = np.ones(len(peaks), dtype=bool)
    for i in np.argsort(x[peaks], kind="stable")[::-1]:
        if not keep[i]:
            continue
        lo = np.searchsorted(peaks, peaks[i] - distance, side="right")
        hi = np.searchsorted(peaks, peaks[i] + distance, side="left")
        keep[lo:hi] = False
        keep[i] = True
    return peaks[keep]


def beat_positions(ppg: np.ndarray, fs: float = PULSE_HZ) -> np.ndarray:
    filtered = zero_phase(ppg, PULSE_BAND)
    if filtered is None:
        return np.zeros(0, dtype=np.int64)
    return spaced_peaks(filtered, max(1, int(fs * 60.0 / MAX_BPM)))


@lru_cache(maxsize=256)
def _turn(n: int) -> tuple[np.ndarray, np.ndarray]:
    angles = [2 * math.pi * i / n for i in range(n)]
    return np.array([math.cos(a) for a in angles]), np.array([math.sin(a) for a in angles])


def plain_power(x: np.ndarray, k: int) -> float:
    """Power at one frequency, added up sample by sample in time order."""
    n = len(x)
    at = np.arange(n) * k % n
    return sum(float(np.cumsum(x * part[at])[-1]) ** 2 for part in _turn(n))


def dominant(x: np.ndarray, power: np.ndarray) -> int:
    """The strongest frequency, the lowest of equal ones. A transform's rounding must not choose between those that are
    equal up to it, so these are added up plainly."""
    near = np.flatnonzero(power >= power.max() * (1 - NEAR))
    if len(near) < 2 or power.max() == 0:
        return int(np.argmax(power))
    return int(near[np.argmax([plain_power(x, int(k)) for k in near])])


def spectrum_stats(x: np.ndarray, fs: float) -> tuple[float, float, float]:
    """Dominant frequency (the constant part included) and power below 5 Hz and in 5-15 Hz, not normalised."""
    n = len(x)
    if n < 4:
        return 0.0, 0.0, 0.0
    power = np.abs(np.fft.rfft(x)) ** 2
    freqs = np.arange(len(power)) * (fs / n)
    low, high = freqs < 5, (freqs >= 5) & (freqs < 15)
    return float(freqs[dominant(x, power)]), float(power[low].sum() * fs / n), float(power[high].sum() * fs / n)


def zero_crossing_rate(x: np.ndarray) -> float:
    return float(np.count_nonzero(np.diff(np.sign(x)))) / (len(x) - 1) if len(x) > 1 else 0.0


def warp_curve(knots: np.ndarray, n: int) -> np.ndarray:
    """The cubic through four equally spaced knots (not-a-knot spline of four points), sampled at n positions."""
    nodes = np.linspace(0.0, 1.0, len(knots))
    grid = np.linspace(0.0, 1.0, n) if n > 1 else np.zeros(n)
    curve = np.zeros(n)
    for i, y in enumerate(knots):
        others = np.delete(nodes, i)
        curve += y * np.prod([(grid - o) / (nodes[i] - o) for o in others], axis=0)
    return curve
