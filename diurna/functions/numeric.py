"""Numpy helpers for one series: filters, peaks, spectra. Re-derived from public mathematics."""

from __future__ import annotations

import math

import numpy as np

from .. import params


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, edges reflected."""
    r = int(4 * sigma + 0.5)
    if r < 1 or len(x) < 2:
        return x.copy()
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="symmetric"), k / k.sum(), mode="valid")


def _biquad(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed from the steady state of the first sample."""
    gain = b.sum() / a.sum()
    z2 = b[2] - a[2] * gain
    z1 = b[1] - a[1] * gain + z2
    z1, z2 = z1 * x[0], z2 * x[0]
    out = np.empty_like(x)
    for i, v in enumerate(x.tolist()):
        y = b[0] * v + z1
        z1 = b[1] * v - a[1] * y + z2
        z2 = b[2] * v - a[2] * y
        out[i] = y
    return out


def lowpass(x: np.ndarray, hours: float, per_hour: float) -> np.ndarray:
    """Second-order Butterworth, forward and backward, ends extended by odd reflection."""
    wn = 2.0 / (hours * per_hour) if hours > 0 else 0.0
    n = len(x)
    if n < 4 or not 0 < wn < 1:
        return x.copy()
    k = math.tan(math.pi * wn / 2)
    norm = 1 / (1 + math.sqrt(2) * k + k * k)
    b = k * k * norm * np.array([1.0, 2.0, 1.0])
    a = np.array([1.0, 2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm])
    pad = min(9, n - 1)
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    once = _biquad(b, a, wide)
    return _biquad(b, a, once[::-1])[::-1][pad : pad + n]


def detrend(x: np.ndarray) -> np.ndarray:
    i = np.arange(len(x), dtype=float)
    return x - np.polyval(np.polyfit(i, x, 1), i) if len(x) > 1 else x - x.mean()


def rolling_mean(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """Centred mean of the finite samples i - w//2 .. i - w//2 + w - 1; NaN below ``least``."""
    ok = np.isfinite(x)
    s = np.concatenate(([0.0], np.cumsum(np.where(ok, x, 0.0))))
    n = np.concatenate(([0], np.cumsum(ok)))
    lo = np.clip(np.arange(len(x)) - window // 2, 0, len(x))
    hi = np.clip(np.arange(len(x)) - window // 2 + window, 0, len(x))
    count = n[hi] - n[lo]
    return np.where(count >= max(1, least), (s[hi] - s[lo]) / np.maximum(count, 1), np.nan)


def normalize(x: np.ndarray, kind: str, window: int) -> np.ndarray:
    if kind == "zscore":
        spread = x.std()
        return (x - x.mean()) / (spread if spread > 0 else 1.0)
    if kind == "robust":
        mid = np.median(x)
        spread = np.median(np.abs(x - mid))
        return (x - mid) / (spread if spread > 0 else 1.0)
    if kind == "envelope":
        level = np.abs(x).mean()
        return x / level if level > 0 else x
    if kind == "rolling":
        return x - rolling_mean(x, window, window // 4)
    return x


def preprocess(x: np.ndarray, settings: params.Preprocess, step: int) -> np.ndarray:
    """Smooth, low-pass, detrend, normalise the finite samples of a series; missing ones stay missing."""
    out = np.full(len(x), np.nan)
    ok = np.isfinite(x)
    y = x[ok].astype(float)
    if not len(y):
        return out
    if settings.smooth_sigma_minutes > 0 and len(y) >= 2:
        y = smooth(y, settings.smooth_sigma_minutes / step)
    if settings.lowpass_hours > 0:
        y = lowpass(y, settings.lowpass_hours, 60.0 / step)
    if settings.detrend == "linear":
        y = detrend(y)
    elif settings.detrend == "constant":
        y = y - y.mean()
    out[ok] = normalize(y, settings.normalize, int(settings.rolling_window_hours * 60 // step))
    return out


def find_peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Strict local maxima (middles of plateaus), the higher ones first to keep their distance, prominent enough."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts = np.concatenate(([0], edges + 1))
    ends = np.concatenate((edges, [len(x) - 1]))
    v = x[starts]
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1 if len(v) > 2 else np.zeros(0, int)
    peaks = (starts[inner] + ends[inner]) // 2
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if keep[k]:
                keep &= (np.abs(peaks - peaks[k]) >= distance) | (np.arange(len(peaks)) == k)
        peaks = peaks[keep]
    if prominence > 0:
        good = []
        for p in peaks:
            left = np.flatnonzero(x[:p] > x[p])
            right = np.flatnonzero(x[p + 1 :] > x[p])
            lo = x[(left[-1] if len(left) else 0) : p + 1].min()
            hi = x[p : (p + 1 + right[0] if len(right) else len(x))].min()
            if x[p] - max(lo, hi) >= prominence:
                good.append(p)
        peaks = np.array(good, int)
    return peaks


def longest_block(t: np.ndarray, x: np.ndarray, step: float, bridge: float) -> tuple[np.ndarray, np.ndarray]:
    """The most finite samples whose gaps are at most ``bridge`` minutes, on an even grid; bridged ones interpolated."""
    ok = np.isfinite(x)
    t, x = t[ok], x[ok]
    if not len(t):
        return t, x
    cuts = np.flatnonzero(np.diff(t) > max(step, bridge + step if bridge else step)) + 1
    parts = np.split(np.arange(len(t)), cuts)
    best = parts[int(np.argmax([len(p) for p in parts]))]
    grid = np.arange(t[best[0]], t[best[-1]] + step / 2, step)
    return grid, np.interp(grid, t[best], x[best])


def log_grid(lo: float, hi: float, n: int = params.CURVE_POINTS) -> np.ndarray:
    return np.geomspace(lo, hi, n)


def lomb_scargle_power(hours: np.ndarray, y: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Share of the variance that a constant and one sinusoid explain, for each frequency."""
    y = y - y.mean()
    whole = float(y @ y)
    out = np.zeros(len(freq))
    for at in range(0, len(freq), 256):
        a = 2 * np.pi * freq[at : at + 256, None] * (hours - hours[0])[None, :]
        c, s = np.cos(a), np.sin(a)
        c -= c.mean(axis=1, keepdims=True)
        s -= s.mean(axis=1, keepdims=True)
        cc, ss, cs, yc, ys = (c * c).sum(1), (s * s).sum(1), (c * s).sum(1), c @ y, s @ y
        det = cc * ss - cs * cs
        with np.errstate(divide="ignore", invalid="ignore"):
            p = (yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs) / (det * whole)
        out[at : at + 256] = np.where(det > 1e-9 * np.maximum(cc * ss, 1e-300), p, 0.0)
    return out


def baluev_fap(z: float, n: int, hours: np.ndarray, fmax: float) -> float:
    """False alarm probability of the highest of many frequencies, after Baluev (2008)."""
    if n < 5:
        return 1.0
    z = min(max(z, 0.0), 1 - 1e-15)
    gamma = math.sqrt(2.0 / (n - 1)) * math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2))
    width = fmax * math.sqrt(4 * math.pi * float(np.var(hours)))
    single = math.exp((n - 3) / 2 * math.log1p(-z))
    tau = gamma * width * math.exp((n - 4) / 2 * math.log1p(-z)) * math.sqrt((n - 1) * z / 2)
    return float(-math.expm1(math.log1p(-single) - tau)) if single < 1 else 1.0


def lomb_scargle(hours: np.ndarray, y: np.ndarray, lo: float, hi: float, oversampling: int = 8) -> dict | None:
    ok = np.isfinite(y)
    hours, y = hours[ok], y[ok]
    if len(y) < 5 or y.std() == 0:
        return None
    df = 1.0 / ((hours[-1] - hours[0]) * oversampling)
    freq = 1 / hi + df * np.arange(1 + int(round((1 / lo - 1 / hi) / df)))
    power = lomb_scargle_power(hours, y, freq)
    k = int(np.argmax(power))
    return {"period": 1 / freq[k], "strength": float(power[k]), "fap": baluev_fap(float(power[k]), len(y), hours, float(freq[-1]))}


def autocorrelation(x: np.ndarray) -> np.ndarray:
    y = x - x.mean()
    n = 1 << (2 * len(y) - 1).bit_length()
    f = np.fft.rfft(y, n)
    out = np.fft.irfft(f * np.conj(f), n)[: len(y)]
    return out / out[0] if out[0] > 0 else np.zeros(len(y))


def autocorrelation_period(x: np.ndarray, step: float, lo: float, hi: float, peak: int = 2) -> dict | None:
    """The ``peak``-th peak of the correlogram; its lag over ``peak`` is the period, unless the correlogram is
    negative there: then the lag itself is."""
    if len(x) < 3 or x.std() == 0:
        return None
    r = autocorrelation(x)
    a, b = (int(round(((peak - 1) * 24 + h) * 60 / step)) for h in (lo, hi))
    if a >= len(r) - 1:
        return None
    part = r[a : min(b, len(r) - 1) + 1]
    found = find_peaks(part, 8, 0.05 * float(part.max() - part.min()))
    at = a + int(found[np.argmax(part[found])] if len(found) else np.argmax(part))
    ri, lag = float(r[at]), at * step / 60.0
    half = int(round(at / peak))
    ci = 1.965 / math.sqrt(len(x))
    return {"period": lag if r[half] < 0 and ri > 0 else lag / peak, "power": ri, "ci": ci, "strength": ri / ci}


def burg(x: np.ndarray, order: int) -> tuple[np.ndarray, list[float]]:
    """Prediction-error filter (from 1.0) and the error variance after each order."""
    f, b = x[1:].copy(), x[:-1].copy()
    a, variance = np.array([1.0]), [float(x @ x) / len(x)]
    for _ in range(order):
        power = float(f @ f + b @ b)
        k = -2 * float(f @ b) / power if power > 0 else 0.0
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        variance.append(variance[-1] * (1 - k * k))
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a, variance


def mesa(x: np.ndarray, step_hours: float, lo: float, hi: float, order: int | None = None) -> dict | None:
    """Peak of the maximum-entropy spectrum; the order minimises Akaike's final prediction error, up to a third
    of the samples and a cap."""
    y = x - x.mean()
    n = len(y)
    if n < 10 or y.std() == 0:
        return None
    cap = max(1, min(n // 3, params.MESA_ORDER_CAP))
    if order is None:
        _, v = burg(y, cap)
        orders = np.arange(1, cap + 1)
        order = int(orders[np.argmin([v[m] * (n + m + 1) / (n - m - 1) for m in orders])])
    a, v = burg(y, min(order, n - 2))
    periods = log_grid(lo, hi)
    turn = np.exp(-2j * np.pi * step_hours / periods[:, None] * np.arange(len(a))[None, :])
    psd = v[-1] * step_hours / np.abs(turn @ a) ** 2
    k = int(np.argmax(psd))
    return {"period": float(periods[k]), "strength": float(psd[k]), "order": int(len(a) - 1)}


def wavelet_periods(lo: float, hi: float, voices: int = params.CWT_VOICES, per_hour: float = 1.0) -> np.ndarray:
    """Periods in hours from ``lo`` to ``hi``, whose octaves start at powers of two of samples."""
    first = math.floor(math.log2(lo * per_hour))
    n = int(math.ceil((math.log2(hi * per_hour) - first) * voices)) + 1
    p = 2.0 ** (first + np.arange(n) / voices) / per_hour
    return p[(p >= lo - 1e-9) & (p <= hi + 1e-9)]


def morlet_power(x: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """(scales, samples): squared modulus of the continuous transform with the wavelet e^(-u²/1.5) e^(2πiu)/√(1.5π)."""
    n = len(x)
    pad = 1 << (2 * n).bit_length()
    f = np.fft.fft(x, pad)
    freq = np.fft.fftfreq(pad)
    out = np.empty((len(scales), n))
    for i, s in enumerate(scales):
        # The transform of the wavelet is a Gaussian around one cycle.
        response = math.sqrt(s) * np.exp(-1.5 * (np.pi * (s * freq - 1.0)) ** 2)
        out[i] = np.abs(np.fft.ifft(f * response)[:n]) ** 2
    return out


def wavelet_summary(x: np.ndarray, step: float, lo: float, hi: float, voices: int = params.CWT_VOICES, method: str = "global_rednoise") -> dict | None:
    """Peak of the mean spectrum inside the cone of influence, and its strength against red noise, against the
    mean spectrum (global), or the share of time at a confident ridge (ridge)."""
    y = x - x.mean()
    n = len(y)
    if n < 10 or y.std() == 0:
        return None
    per_hour = 60.0 / step
    periods = wavelet_periods(lo, hi, voices, per_hour)
    power = morlet_power(y, periods * per_hour)
    reach = np.minimum(np.arange(n), n - 1 - np.arange(n)) / per_hour / math.sqrt(2)
    inside = periods[:, None] <= reach[None, :]
    count = inside.sum(axis=1)
    enough = count >= np.maximum(10, periods * per_hour)
    if not enough.any():
        return None
    spectrum = np.where(enough, np.where(inside, power, 0).sum(axis=1) / np.maximum(count, 1), np.nan)
    k = int(np.nanargmax(spectrum))
    period = parabolic_period(periods, spectrum, k)
    if method == "ridge":
        top = power.argmax(axis=0)
        strong = power.max(axis=0) / np.maximum(power.mean(axis=0), 1e-300) >= 2
        strength = float((strong & inside[top, np.arange(n)]).mean())
    elif method == "global":
        strength = float(spectrum[k] / np.nanmean(spectrum))
    else:
        alpha = float(np.clip((y[1:] @ y[:-1]) / max(y @ y, 1e-300), 0, 0.999))
        noise = y.var() * (1 - alpha**2) / (1 + alpha**2 - 2 * alpha * math.cos(2 * math.pi / (period * per_hour)))
        strength = float(spectrum[k] / (noise * math.sqrt(1 / (6 * math.pi))))
        if method == "ar1":
            strength /= -math.log(0.05)
    return {"period": period, "power": float(spectrum[k]), "strength": strength}


def parabolic_period(periods: np.ndarray, spectrum: np.ndarray, k: int) -> float:
    """The peak between nodes, by a parabola in log2(period); the node itself at an edge or where it is not a peak."""
    if not 0 < k < len(periods) - 1 or not np.isfinite(spectrum[k - 1 : k + 2]).all():
        return float(periods[k])
    a, b, c = spectrum[k - 1 : k + 2]
    bend = a - 2 * b + c
    shift = 0.5 * (a - c) / bend if bend < 0 else 2.0
    if abs(shift) > 1:
        return float(periods[k])
    x = np.log2(periods)
    return float(2 ** (x[k] + shift * (x[k + 1] - x[k])))
