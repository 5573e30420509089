"""Signal kernels in numpy, for Arrow batches: transforms, filter banks, cepstra, filters, pitch."""

from __future__ import annotations

import math

import numpy as np


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlapping frames without padding; the tail that fills no frame is left out."""
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def power_spectrogram(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """(frame, bin) power of Hann-windowed frames."""
    return np.abs(np.fft.rfft(frames_of(x, n_fft, hop) * hann(n_fft), axis=1)) ** 2


def decibels(power: np.ndarray, floor: float = -80.0) -> np.ndarray:
    """10 log10 relative to the maximum, cut at the floor."""
    db = 10 * np.log10(np.maximum(power, 1e-10))
    return np.maximum(db - db.max(initial=-np.inf), floor) if db.size else db


def _mel(f: np.ndarray | float) -> np.ndarray:
    f = np.asarray(f, float)
    high = np.log(np.maximum(f, 1.0) / 1000.0) / (np.log(6.4) / 27.0) + 15.0
    return np.where(f >= 1000.0, high, f * 3.0 / 200.0)


def _hertz(m: np.ndarray) -> np.ndarray:
    return np.where(m >= 15.0, 1000.0 * np.exp((np.log(6.4) / 27.0) * (m - 15.0)), m * 200.0 / 3.0)


def mel_bank(rate: float, n_fft: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """(band, bin) triangular weights of unit area on the auditory scale."""
    high = rate / 2 if high is None else high
    freq = np.arange(n_fft // 2 + 1) * rate / n_fft
    edge = _hertz(np.linspace(_mel(low), _mel(high), bands + 2))
    up = (freq[None, :] - edge[:-2, None]) / np.maximum(edge[1:-1] - edge[:-2], 1e-12)[:, None]
    down = (edge[2:, None] - freq[None, :]) / np.maximum(edge[2:] - edge[1:-1], 1e-12)[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2.0 / (edge[2:] - edge[:-2]))[:, None]


def log_bank(rate: float, n_fft: int, bands: int, per_octave: int = 12, low: float = 32.7, spread: float = 0.125) -> np.ndarray:
    """(band, bin) log-normal weights around centres spaced by octaves."""
    freq = np.maximum(np.arange(n_fft // 2 + 1) * rate / n_fft, 1e-9)
    centre = low * 2.0 ** (np.arange(bands) / per_octave)
    w = np.exp(-0.5 * (np.log2(freq[None, :] / centre[:, None]) / spread) ** 2)
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)


def dct(x: np.ndarray, keep: int) -> np.ndarray:
    """Orthonormal type-II cosine transform along the last axis."""
    n = x.shape[-1]
    basis = np.cos(np.pi * (np.arange(n)[:, None] + 0.5) * np.arange(keep)[None, :] / n) * np.sqrt(2.0 / n)
    basis[:, 0] /= np.sqrt(2.0)
    return x @ basis


def delta(x: np.ndarray, width: int = 9, order: int = 1) -> np.ndarray:
    """Derivatives of the given order of least-squares polynomials of that order over `width` (odd) frames along axis 0.

    Frames nearer to an end than half the width have the value of the outermost whole window.
    """
    half = width // 2
    k = np.arange(-half, half + 1)
    weights = np.linalg.pinv(np.vander(k.astype(float), order + 1, increasing=True))[order] * math.factorial(order)
    inner = sum(w * x[i : len(x) - width + 1 + i] for i, w in enumerate(weights))
    return np.pad(inner, ((half, half), *((0, 0),) * (x.ndim - 1)), mode="edge")


def slope_width(frames: int, most: int = 9, least: int = 3) -> int | None:
    """The widest odd width up to `most` that the frames fill; None below `least`."""
    width = min(frames, most)
    width -= 1 - width % 2
    return width if width >= least else None


def fitting_fft(n: int, most: int = 1024) -> int:
    """The largest power of two that fits both the samples and `most`, 2 at least."""
    return 1 << (max(2, min(n, most)).bit_length() - 1)


def centred_spectrogram(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """(frame, bin) magnitude of Hann-windowed frames centred at multiples of the hop, zeros beyond the ends."""
    wide = np.pad(np.asarray(x, float), n_fft // 2)
    return np.abs(np.fft.rfft(frames_of(wide, n_fft, hop) * hann(n_fft), axis=1))


def levels(power: np.ndarray, reference: float = 1.0, depth: float = 80.0) -> np.ndarray:
    """Decibels over a reference, not more than `depth` below the largest."""
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(reference, 1e-10))
    return np.maximum(db, db.max() - depth) if db.size else db


#: Fixed values of the cepstral features: transform, hop, bands, coefficients.
N_FFT, HOP, BANDS, COEFFICIENTS = 760, 256, 128, 13


def mfcc(x: np.ndarray, rate: float, coefficients: int = COEFFICIENTS, bands: int = BANDS, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """(frame, coefficient) cepstra of mel levels, the transform adapted to short signals."""
    size = fitting_fft(len(x), n_fft)
    power = centred_spectrogram(x, size, hop) ** 2
    return dct(levels(power @ mel_bank(rate, size, bands).T), coefficients)


def mfcc_statistics(x: np.ndarray, rate: float, coefficients: int = COEFFICIENTS, **options) -> np.ndarray | None:
    """Means and population deviations of cepstra and their first and second slopes; None for fewer than three frames."""
    c = mfcc(x, rate, coefficients, **options)
    width = slope_width(len(c))
    if width is None:
        return None
    return np.concatenate([v for y in (c, delta(c, width), delta(c, width, 2)) for v in (y.mean(axis=0), y.std(axis=0))])


def spectral_statistics(x: np.ndarray, rate: float, n_fft: int = N_FFT, hop: int = HOP, share: float = 0.85) -> dict[str, float]:
    """Means and deviations over time of the magnitude's centroid, bandwidth and roll-off."""
    size = fitting_fft(len(x), n_fft)
    s = centred_spectrogram(x, size, hop)
    f = np.arange(s.shape[1]) * rate / size
    total = s.sum(axis=1)
    p = s / np.where(total > 0, total, 1)[:, None]
    centroid = p @ f
    width = np.sqrt((p * (f[None, :] - centroid[:, None]) ** 2).sum(axis=1))
    roll = f[(np.cumsum(s, axis=1) >= share * total[:, None]).argmax(axis=1)]
    return {f"{name}_{kind}": float(g(v)) for name, v in (("centroid", centroid), ("bandwidth", width), ("rolloff", roll)) for kind, g in (("mean", np.mean), ("std", np.std))}


def shape_features(s: np.ndarray) -> tuple[float, float]:
    """Bins above the upper quartile of a (frame, bin) spectrogram, and frames per bin."""
    return float((s > np.percentile(s, 75)).sum()), s.shape[0] / max(s.shape[1], 1)


def segment_features(x: np.ndarray, rate: float, start: float, stop: float, low: float, high: float) -> np.ndarray | None:
    """The 88 features of a segment's samples in the order of feature_names(); None where the slopes have too few frames."""
    cepstra = mfcc_statistics(x, rate)
    if cepstra is None:
        return None
    shape = shape_features(centred_spectrogram(x, fitting_fft(len(x), N_FFT), HOP))
    return np.concatenate([cepstra, [stop - start, high - low], list(spectral_statistics(x, rate).values()), shape])


def feature_names(coefficients: int = COEFFICIENTS) -> list[str]:
    """Names of a segment's features in their order."""
    names = [f"{kind}_{stat}_{i}" for kind in ("mfcc", "delta", "delta2") for stat in ("mean", "std") for i in range(1, coefficients + 1)]
    names += ["duration", "bandwidth"]
    names += [f"spectral_{kind}_{stat}" for kind in ("centroid", "bandwidth", "rolloff") for stat in ("mean", "std")]
    return [*names, "shape_total_pixels", "shape_aspect_ratio"]


def resample(x: np.ndarray, rate_in: int, rate_out: int, zeros: int = 16) -> np.ndarray:
    """Band-limited resampling by a windowed-sinc kernel at the reduced ratio of even rates."""
    a, b = rate_in // 2 * 2, rate_out // 2 * 2
    g = np.gcd(a, b)
    up, down = b // g, a // g
    n = -(-len(x) * up // down)
    cut = min(1.0, up / down)
    at = np.arange(n) * down / up
    half = int(np.ceil(zeros / cut))
    x, out = np.asarray(x, float), np.empty(n)
    step = max(1, (1 << 20) // (2 * half))  # outputs at a time, so that memory does not follow the recording
    for a in range(0, n, step):
        place = at[a : a + step]
        k = np.floor(place).astype(int)[:, None] + np.arange(-half + 1, half + 1)[None, :]
        t = place[:, None] - k
        w = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
        out[a : a + step] = (np.where((k >= 0) & (k < len(x)), x[np.clip(k, 0, len(x) - 1)], 0.0) * w).sum(axis=1)
    return out


def butterworth(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of a Butterworth band-pass by the bilinear transform."""
    w1, w2 = (2 * rate * np.tan(np.pi * f / rate) for f in (low, high))
    wide, middle = w2 - w1, np.sqrt(w1 * w2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * wide / 2
    root = np.sqrt(proto**2 - middle**2)
    poles = np.concatenate([proto + root, proto - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[np.imag(z) > 0] if (np.abs(np.imag(z)) > 1e-12).all() else z
    upper = sorted(z, key=abs)[:order] if len(z) >= order else list(z)
    sections = np.array([[1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    f0 = np.exp(2j * np.pi * np.sqrt(low * high) / rate)
    gain = np.prod([abs((1 - f0**-2) / (1 + s[3] / f0 + s[4] / f0**2)) for s in sections])
    sections[:, :3] /= gain ** (1 / len(sections))
    return sections


def _sections(x: np.ndarray, sections: np.ndarray, block: int = 128) -> np.ndarray:
    """Second-order sections one after the other, each by blocks.

    A block's answer is that to its own input, one matrix product for all blocks, and that to the
    two values kept at its start, which alone are carried from block to block.
    """
    n = len(x)
    for b0, b1, b2, a1, a2 in sections:
        step = np.array([[-a1, 1.0], [-a2, 0.0]])
        gain = np.array([b1 - a1 * b0, b2 - a2 * b0])
        reach, enter = np.empty((block, 2)), np.empty((block, 2))  # output of a kept state, state left by an input
        power = np.eye(2)
        for i in range(block):
            reach[i] = power[0]
            enter[block - 1 - i] = power @ gain
            power = step @ power
        answer = np.zeros(block)
        answer[0] = b0
        answer[1:] = reach[: block - 1] @ gain
        rows = np.pad(x, (0, -n % block)).reshape(-1, block)
        at = np.arange(block)
        own = rows @ np.where(at[None, :] >= at[:, None], answer[np.maximum(at[None, :] - at[:, None], 0)], 0.0)
        left = rows @ enter
        states, state = np.empty((len(rows), 2)), np.zeros(2)
        for k in range(len(rows)):
            states[k] = state
            state = power @ state + left[k]
        x = (own + states @ reach.T).ravel()[:n]
    return x


def band_pass(x: np.ndarray, low: float, high: float, rate: float, order: int = 5) -> np.ndarray:
    """Zero-phase band-pass: forwards and backwards over an odd extension of the ends."""
    sections = butterworth(order, low, high, rate)
    pad = min(3 * (2 * order + 1), len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else np.asarray(x, float)
    y = _sections(_sections(wide, sections)[::-1], sections)[::-1]
    return y[pad : pad + len(x)] if pad > 0 else y


def yin(x: np.ndarray, rate: float, low: float = 80.0, high: float = 8000.0, size: int = 1024, hop: int = 256, trust: float = 0.1) -> np.ndarray:
    """Fundamental frequency of each frame by the cumulative-mean-normalised difference function."""
    near, far = max(1, int(rate / high)), int(min(rate / low, size // 2))
    out = []
    for frame in frames_of(x, size, hop):
        head = frame[: size - far]
        d = np.array([((head - frame[t : t + size - far]) ** 2).sum() for t in range(far + 1)])
        norm = np.ones(far + 1)
        norm[1:] = d[1:] * np.arange(1, far + 1) / np.maximum(np.cumsum(d[1:]), 1e-12)
        good = np.flatnonzero(norm[near:far] < trust)
        t = near + (int(good[0]) if len(good) else int(norm[near:far].argmin()))
        while t + 1 < far and norm[t + 1] < norm[t]:
            t += 1
        if 0 < t < far:
            a, b, c = norm[t - 1], norm[t], norm[t + 1]
            bend = a - 2 * b + c
            t = t + (0.5 * (a - c) / bend if bend else 0.0)
        out.append(rate / t)
    return np.array(out)
