"""Numeric descriptors of a mono signal at 48 kHz (inventory G1-G17), as numpy kernels.

They run inside one Arrow stage for each file, so a signal never becomes a column.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

# Analysis frames, ranges and floors.
SAMPLE_RATE = 48_000
FRAME, HOP = 1024, 480
EPSILON = 1e-10
MIN_BPM, MAX_BPM = 60.0, 180.0
CHROMA_FRAME, CHROMA_HOP = 8192, 4096
CHROMA_MIN_HZ, CHROMA_MAX_HZ = 80.0, 5000.0
PEAK_PROMINENCE = 8.0
COVERAGE_FLOOR, CLASS_SHARE, MIN_CLASSES, CORRELATION_FLOOR = 0.5, 0.10, 3, 0.5
A4_HZ = 440.0
MAX_SAMPLES = 480_000
MEL_BINS, MEL_MIN_HZ, MEL_MAX_HZ = 64, 50.0, 14_000.0
MEL_FRAMES = MAX_SAMPLES // HOP + 1
COEFFICIENTS, ENVELOPE, CLIP = 20, 5, 5.0
WIDTH = 2 * COEFFICIENTS + ENVELOPE
TOP_DB, HEAD_FRAMES, ACTIVE, ENERGY_FLOOR = 80.0, 32, 0.1, 1e-12

# Krumhansl-Kessler key profiles.
MAJOR = np.array([6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88])
MINOR = np.array([6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17])

# Means and deviations by which stored vectors are standardized.
MEAN = np.array(
    [
        -304.10266, 30.438253, -6.098621, 5.0541687, -3.435184,
        1.8325026, -1.8831213, 0.6707593, -2.1328785, 0.11564399,
        -1.506913, -0.15735488, -0.85754925, -0.28821665, -0.8148694,
        0.016194029, 0.0013220005, 0.21189223, -0.23650835, 0.18731424,
        101.61157, 29.93432, 18.379799, 12.396472, 10.425744,
        8.3390665, 7.697881, 6.905768, 6.7674394, 6.0128603,
        5.744626, 5.393562, 5.2306466, 5.140672, 4.9379563,
        4.807468, 4.766873, 4.696865, 4.5269523, 4.33141,
        1.7629659, 0.5765331, 20.801981, 0.27705956, 0.2264529,
    ]
)
STD = np.array(
    [
        97.136154, 58.331806, 29.532373, 18.331589, 14.809756,
        11.679447, 10.151789, 8.905907, 8.719429, 6.895168,
        7.2748494, 6.4990687, 5.908938, 5.7687764, 5.538214,
        5.036546, 4.873221, 4.747195, 4.6737103, 3.911214,
        42.616554, 14.689472, 8.617766, 5.2503877, 4.124298,
        3.3012433, 2.847417, 2.6500952, 2.880175, 2.2924635,
        2.459403, 2.1343732, 2.1828003, 2.3387818, 2.1919918,
        2.1220827, 2.1494517, 2.3725028, 2.2546623, 2.1162694,
        2.675303, 1.2797962, 55.97638, 0.6759039, 0.41853553,
    ]
)


@dataclass
class Descriptors:
    peak_db: float | None = None
    rms_db: float | None = None
    lufs_integrated: float | None = None
    spectral_centroid: float | None = None
    spectral_flatness: float | None = None
    zero_crossing: float | None = None
    onset_density: float | None = None
    bpm: float | None = None
    bpm_confidence: float | None = None
    key_root: int | None = None
    key_mode: int | None = None
    key_confidence: float | None = None


DESCRIPTORS = [f.name for f in fields(Descriptors)]


def to_db(amplitude: float) -> float:
    return float(20 * np.log10(max(amplitude, EPSILON)))


def rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0


def zero_crossing(x: np.ndarray) -> float:
    return float(np.mean(np.diff((x >= 0).astype(np.int8)) != 0)) if len(x) > 1 else 0.0


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def spectra(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Power spectra of all whole frames."""
    if len(x) < frame:
        return np.zeros((0, frame // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, np.float64), frame)[::hop]
    return np.abs(np.fft.rfft(frames * hann(frame), axis=1)) ** 2


def loudness(x: np.ndarray, rate: int = SAMPLE_RATE) -> float | None:
    """Integrated loudness by ITU-R BS.1770: K-weighting, 400 ms blocks, absolute and relative gate."""
    y = np.asarray(x, np.float64)
    # The two filters of the recommendation, from their analogue parameters.
    k = np.tan(np.pi * 1681.974450955533 / rate)
    q, gain = 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    vb = gain**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = ([(gain + vb * k / q + k * k) / a0, 2 * (k * k - gain) / a0, (gain - vb * k / q + k * k) / a0], [2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    k = np.tan(np.pi * 38.13547087602444 / rate)
    q = 0.5003270373238773
    a0 = 1 + k / q + k * k
    high = ([1.0, -2.0, 1.0], [2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    for b, a in (shelf, high):
        y = _biquad(y, b, a)
    block, step = int(0.4 * rate), int(0.1 * rate)
    if len(y) < block:
        return None
    power = np.concatenate(([0.0], np.cumsum(y * y)))
    at = np.arange(0, len(y) - block + 1, step)
    mean = (power[at + block] - power[at]) / block
    loud = mean[mean > 10 ** ((-70 + 0.691) / 10)]
    if not len(loud):
        return None
    loud = loud[loud > loud.mean() * 10 ** (-10 / 10)]
    return float(-0.691 + 10 * np.log10(loud.mean())) if len(loud) else None


def _biquad(x: np.ndarray, b: list[float], a: list[float]) -> np.ndarray:
    """A recursive filter as a convolution with its impulse response, which dies out quickly."""
    n = min(len(x), 1 << 15)
    h = np.zeros(n)
    for i in range(n):
        h[i] = (b[i] if i < 3 else 0.0) - (a[0] * h[i - 1] if i > 0 else 0.0) - (a[1] * h[i - 2] if i > 1 else 0.0)
        if i > 64 and abs(h[i]) < 1e-14 and abs(h[i - 1]) < 1e-14:
            h = h[: i + 1]
            break
    size = 1 << (len(x) + len(h)).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def onsets(flux: np.ndarray) -> list[int]:
    """Local maxima over 1.5 times the mean of ten frames either side and half the mean of all,
    five frames apart at least."""
    if len(flux) < 3 or flux.mean() <= EPSILON:
        return []
    total = np.concatenate(([0.0], np.cumsum(flux)))
    i = np.arange(len(flux))
    low, high = np.maximum(i - 10, 0), np.minimum(i + 11, len(flux))
    local = (total[high] - total[low]) / (high - low)
    peak = np.zeros(len(flux), bool)
    peak[1:-1] = (flux[1:-1] > flux[:-2]) & (flux[1:-1] >= flux[2:])
    found: list[int] = []
    for at in np.flatnonzero(peak & (flux > 1.5 * local) & (flux > 0.5 * flux.mean())).tolist():
        if not found or at - found[-1] >= 5:
            found.append(at)
    return found


def tempo(flux: np.ndarray) -> tuple[float, float] | None:
    """Beats a minute and confidence from the autocorrelation of the flux."""
    rate = SAMPLE_RATE / HOP
    low, high = round(rate * 60 / MAX_BPM), round(rate * 60 / MIN_BPM)
    if len(flux) < 2 * high:
        return None
    c = flux - flux.mean()
    energy = float(c @ c)
    if energy <= EPSILON:
        return None
    r = np.array([c[lag:] @ c[: len(c) - lag] for lag in range(low, high + 1)]) / energy
    best = int(r.argmax())
    if r[best] <= 0:
        return None
    return float(rate * 60 / (low + best)), float(np.clip((r[best] - r.mean()) / max(abs(r[best]), EPSILON), 0, 1))


def chroma(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Power by pitch class of resolved partials, and the share of frames that have any."""
    power = spectra(x, CHROMA_FRAME, CHROMA_HOP)
    out = np.zeros(12)
    if not len(power):
        return out, 0.0
    width = SAMPLE_RATE / CHROMA_FRAME
    bins = np.arange(max(int(np.ceil(CHROMA_MIN_HZ / width)), 1), min(int(CHROMA_MAX_HZ // width), power.shape[1] - 2) + 1)
    a, b, c = power[:, bins - 1], power[:, bins], power[:, bins + 1]
    la, lb, lc = (np.log(np.maximum(v, EPSILON)) for v in (a, b, c))
    bend = la - 2 * lb + lc
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = np.where(np.abs(bend) > 1.1920929e-07, 0.5 * (la - lc) / bend, np.inf)
    is_peak = (b > a) & (b >= c) & (b >= PEAK_PROMINENCE * power.mean(axis=1, keepdims=True)) & (np.abs(shift) <= 0.5)
    row, col = np.nonzero(is_peak)
    semitones = 12 * np.log2((bins[col] + shift[row, col]) * width / A4_HZ)
    pitch = (np.floor(np.abs(semitones) + 0.5) * np.sign(semitones)).astype(int)
    np.add.at(out, (pitch + 9) % 12, (a + b + c)[row, col])
    return out, float(is_peak.any(axis=1).mean())


def key(classes: np.ndarray, coverage: float) -> tuple[int, int | None, float] | None:
    """Root, mode (1 major, 0 minor, None where it can not be told) and confidence."""
    if coverage < COVERAGE_FLOOR or classes.sum() <= EPSILON:
        return None
    share = classes / classes.sum()
    if (share >= CLASS_SHARE).sum() >= MIN_CLASSES and share.std() > 0:
        options = [(root, mode) for root in range(12) for mode in (0, 1)]
        r = [float(np.corrcoef(share, np.roll((MINOR, MAJOR)[mode], root))[0, 1]) for root, mode in options]
        best = int(np.argmax(r))
        if r[best] >= CORRELATION_FLOOR:
            return (*options[best], r[best])
    root = int(len(share) - 1 - np.argmax(share[::-1]))
    return root, None, float(share[root])


def describe(x: np.ndarray) -> Descriptors:
    x = np.asarray(x, np.float32)
    d = Descriptors(peak_db=to_db(float(np.abs(x).max(initial=0.0))), rms_db=to_db(rms(x)), zero_crossing=zero_crossing(x), lufs_integrated=loudness(x))
    if len(x) < FRAME:
        return d
    power = spectra(x, FRAME, HOP)
    energy = power.sum(axis=1)
    heard = energy > EPSILON
    if heard.any():
        hz = np.arange(power.shape[1]) * SAMPLE_RATE / FRAME
        p, e = power[heard], energy[heard]
        floor = np.maximum(p, EPSILON)
        flat = np.clip(np.exp(np.log(floor).mean(axis=1)) / floor.mean(axis=1), 0, 1)
        d.spectral_centroid = float(((p @ hz) / e) @ e / e.sum())
        d.spectral_flatness = float(flat @ e / e.sum())
    rise = np.maximum(np.diff(np.sqrt(power), axis=0), 0).sum(axis=1)
    flux = np.concatenate(([0.0], rise))
    d.onset_density = len(onsets(flux)) / (len(x) / SAMPLE_RATE)
    if (beat := tempo(flux)) is not None:
        d.bpm, d.bpm_confidence = beat
    if (found := key(*chroma(x))) is not None:
        d.key_root, d.key_mode, d.key_confidence = found
    return d


def mel(hz: np.ndarray | float) -> np.ndarray:
    """Slaney's scale: linear to 1 kHz, logarithmic above."""
    hz = np.asarray(hz, np.float64)
    return np.where(hz >= 1000, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4), hz * 3 / 200)


def mel_to_hz(m: np.ndarray) -> np.ndarray:
    return np.where(m >= 15, 1000 * np.exp((m - 15) * np.log(6.4) / 27), m * 200 / 3)


def filterbank() -> np.ndarray:
    """Triangles of equal area over the mel scale: one row for each band."""
    edges = mel_to_hz(np.linspace(mel(MEL_MIN_HZ), mel(MEL_MAX_HZ), MEL_BINS + 2))
    hz = np.arange(FRAME // 2 + 1) * SAMPLE_RATE / FRAME
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid)), 0) * 2 / (high - low)


_BANK: np.ndarray | None = None


def log_mel(x: np.ndarray, repeat: bool = False) -> np.ndarray:
    """1001 frames of 64 bands in dB over ten seconds, padded by zeros or by repeats, with
    reflected ends."""
    global _BANK
    if _BANK is None:
        _BANK = filterbank()
    x = np.asarray(x, np.float64)[:MAX_SAMPLES]
    full = np.zeros(MAX_SAMPLES)
    if len(x):
        body = np.tile(x, max(MAX_SAMPLES // len(x), 1)) if repeat else x
        full[: len(body)] = body
        full = np.pad(full, FRAME // 2, mode="reflect")
    else:
        full = np.zeros(MAX_SAMPLES + FRAME)
    return 10 * np.log10(np.maximum(spectra(full, FRAME, HOP) @ _BANK.T, EPSILON))


def dct() -> np.ndarray:
    """Orthonormal DCT-II, the first rows."""
    k, i = np.arange(COEFFICIENTS)[:, None], np.arange(MEL_BINS)[None, :]
    table = np.sqrt(2 / MEL_BINS) * np.cos(np.pi / MEL_BINS * (i + 0.5) * k)
    table[0] = np.sqrt(1 / MEL_BINS)
    return table


def envelope(x: np.ndarray, frames: int) -> np.ndarray:
    """Root mean square around the middle of each frame."""
    total = np.concatenate(([0.0], np.cumsum(np.square(x, dtype=np.float64))))
    middle = np.arange(frames) * HOP
    low, high = np.clip(middle - FRAME // 2, 0, len(x)), np.clip(middle + FRAME // 2, 0, len(x))
    return np.sqrt(np.maximum(total[high] - total[low], 0) / FRAME)


def raw_vector(x: np.ndarray, bands: np.ndarray, truncated: bool = False) -> np.ndarray:
    """Mean and deviation of each coefficient over the frames that hold signal; attack, decay,
    head to tail in dB, log10 length and whether the window was full."""
    out = np.zeros(WIDTH)
    frames = int(np.clip(1 + len(x) // HOP, 1, MEL_FRAMES))
    if len(bands) < frames:
        return out
    real = bands[:frames]
    c = np.maximum(real, real.max() - TOP_DB) @ dct().T
    out[:COEFFICIENTS], out[COEFFICIENTS : 2 * COEFFICIENTS] = c.mean(axis=0), c.std(axis=0)
    level = envelope(np.asarray(x), frames)
    peak = level.max()
    if peak > 0:
        top = int(level.argmax())
        first = int(np.argmax(level > ACTIVE * peak))
        quiet = np.flatnonzero(level[top:] < ACTIVE * peak)
        head, tail = ((part**2).sum() + ENERGY_FLOOR for part in (level[:HEAD_FRAMES], level[HEAD_FRAMES:]))
        out[-5] = max(top - first, 0) * HOP / SAMPLE_RATE
        out[-4] = (int(quiet[0]) if len(quiet) else len(level) - top) * HOP / SAMPLE_RATE
        out[-3] = 10 * np.log10(head / tail)
    out[-2] = np.log10(max(len(x), FRAME) / SAMPLE_RATE)
    out[-1] = float(truncated or len(x) >= MAX_SAMPLES)
    return out


def standardize(raw: np.ndarray) -> np.ndarray:
    """Z-scores clipped to five deviations; what is not finite is 0."""
    z = (np.asarray(raw, np.float64) - MEAN) / STD
    return np.where(np.isfinite(z), np.clip(np.nan_to_num(z), -CLIP, CLIP), 0.0)


def stored(v: np.ndarray) -> np.ndarray:
    """Values as they come back from half-precision storage."""
    return np.asarray(v, np.float32).astype(np.float16).astype(np.float32)


def peaks(x: np.ndarray, buckets: int = 1024) -> list[tuple[float, float]]:
    """Smallest and largest value of each bucket; edges by whole-number division, and a bucket
    holds one value at least. An empty signal is silence."""
    if not len(x):
        return [(0.0, 0.0)] * buckets
    start = np.arange(buckets) * len(x) // buckets
    end = np.append(np.maximum(start[1:], start[:-1] + 1), len(x))
    return [(float(x[a:b].min()), float(x[a:b].max())) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
