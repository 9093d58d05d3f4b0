"""Spectra of series of any length: small numpy helpers on Arrow batches.

Nested SQL lambdas would evaluate the mean and the total once per element; a real FFT per
batch does not. Rows of equal length are stacked, so a batch is a few matrix calls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("total_energy", "low_ratio", "mid_ratio", "high_ratio", "dominant_index", "dominant_ratio", "entropy")
BASE_FEATURES = ("total_energy", "low_ratio", "high_ratio", "dominant_ratio", "entropy")
PAIR_FIELDS = ("lag_corr", "best_lag", "shape", "freq_match", "phase")
BASE_FIELDS = tuple(f"{f}_{s}" for f in BASE_FEATURES for s in ("med", "mad"))


def _struct(names) -> T.StructType:
    whole = ("dominant_index", "best_lag")
    return T.StructType([T.StructField(n, T.IntegerType() if n in whole else T.DoubleType()) for n in names])


def coefficients(x: np.ndarray) -> np.ndarray:
    """Real FFT of the centred rows, without DC."""
    n = x.shape[1]
    if n == 0:
        return np.zeros((len(x), 0), dtype=complex)
    out = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)[:, 1:]
    if n % 2 == 0:
        out[:, -1].imag = 0.0  # the highest bin of an even length is real
    return out


def describe(p: np.ndarray) -> dict[str, np.ndarray]:
    """Band shares (thirds), dominant bin and base-2 entropy of power rows; zeros when silent."""
    rows, n = p.shape
    if n == 0:
        return {f: np.zeros(rows) for f in FEATURES}
    energy = p.sum(axis=1)
    alive = energy >= 1e-12
    share = np.where(alive[:, None], p / np.where(alive, energy, 1.0)[:, None], 0.0)
    third = max(1, n // 3)
    mid = min(2 * third, n)
    logs = np.log2(np.where(share > 0, share, 1.0))
    return {
        "total_energy": np.where(alive, energy, 0.0), "low_ratio": share[:, :third].sum(axis=1),
        "mid_ratio": share[:, third:mid].sum(axis=1), "high_ratio": share[:, mid:].sum(axis=1),
        "dominant_index": np.where(alive, p.argmax(axis=1), 0), "dominant_ratio": share.max(axis=1),
        "entropy": -(share * logs).sum(axis=1),
    }


def _grouped(keys, compute, columns) -> pd.DataFrame:
    """Apply ``compute(positions)`` to the rows of each key and put the results back in order."""
    out = {c: np.zeros(len(keys)) for c in columns}
    rows: dict = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    for pos in map(np.array, rows.values()):
        for name, values in compute(pos).items():
            if name in out:
                out[name][pos] = values
    return pd.DataFrame(out)


def _stack(series: pd.Series, positions) -> np.ndarray:
    return np.array([np.asarray(series.iloc[i], dtype=float) for i in positions])


@F.pandas_udf(_struct(FEATURES))
def spectral_features(x: pd.Series) -> pd.DataFrame:
    frame = _grouped([len(v) for v in x], lambda pos: describe(
        np.abs(coefficients(_stack(x, pos))) ** 2), FEATURES)
    return frame.astype({"dominant_index": "int32"})


@F.pandas_udf(_struct(BASE_FIELDS))
def baseline_features(base: pd.Series, length: pd.Series) -> pd.DataFrame:
    """Median and MAD of the features over consecutive windows; a short baseline is one window."""
    def compute(pos):
        n, x = int(length.iloc[pos[0]]), _stack(base, pos)
        size = n if x.shape[1] >= n else x.shape[1]
        count = x.shape[1] // size if size else 0
        windows = x[:, :count * size].reshape(len(pos) * count, size)
        found = describe(np.abs(coefficients(windows)) ** 2)
        out = {}
        for f in BASE_FEATURES:
            v = found[f].reshape(len(pos), count)
            centre = np.median(v, axis=1)
            out[f"{f}_med"] = centre
            spread = np.median(np.abs(v - centre[:, None]), axis=1)
            # a spread below the rounding noise of the values is none
            out[f"{f}_mad"] = np.where(spread < 1e-9 * np.abs(centre), 0.0, spread)
        return out

    return _grouped([(len(b), int(n)) for b, n in zip(base, length)], compute, BASE_FIELDS)


def _lag(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest normalised cross-correlation over the lags; the lowest lag wins a tie.

    All lags of a pair come from one product of Fourier transforms, n log n steps; the
    correlation at the best lag is then summed directly.
    """
    rows, n = x.shape
    dx, dy = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    sx, sy = np.sqrt((dx * dx).mean(axis=1)), np.sqrt((dy * dy).mean(axis=1))
    flat = (sx < 1e-12) | (sy < 1e-12)
    reach = min(reach, n - 3)
    if reach < 0:
        return np.zeros(rows), np.zeros(rows)
    lags = np.arange(-reach, reach + 1)
    padded = 1 << int(n + reach).bit_length()  # so long that no lag wraps around
    sums = np.fft.irfft(np.conj(np.fft.rfft(dx, padded)) * np.fft.rfft(dy, padded), padded)[:, lags]
    scale = (sx * sy)[:, None] * (n - np.abs(lags)) + 1e-12
    best = lags[np.floor(np.abs(sums / scale) * 1e9 + 0.5).argmax(axis=1)]
    corr = np.empty(rows)
    for k in np.unique(best).tolist():
        at = np.flatnonzero(best == k)
        a, b = (dx[at, :n - k], dy[at, k:]) if k >= 0 else (dx[at, -k:], dy[at, :n + k])
        corr[at] = (a * b).sum(axis=1) / ((n - abs(k)) * sx[at] * sy[at] + 1e-12)
    lag = np.where((np.abs(corr) > 0) & ~flat, best, 0)
    return np.where(flat, 0.0, corr), lag


def _phase(x: np.ndarray, y: np.ndarray, lag: np.ndarray, min_points: int) -> np.ndarray:
    """Agreement of the best lag with the phase shift at the jointly dominant frequency."""
    rows, n = x.shape
    if n < min_points:
        return np.full(rows, 0.5)
    fx, fy = coefficients(x), coefficients(y)
    joint = np.floor((np.abs(fx) ** 2 + np.abs(fy) ** 2) * 1e9 + 0.5)
    k = joint.argmax(axis=1)
    pick = np.arange(rows)
    diff = np.angle(fy[pick, k]) - np.angle(fx[pick, k])
    expected = ((diff + np.pi) % (2 * np.pi) - np.pi) / (2 * np.pi) * n / (k + 1)
    usable = np.abs(expected) > 1e-6
    ratio = np.where(usable, lag / np.where(usable, expected, 1.0), 0.0)
    agree = np.where(ratio > 0, 1.0 / (1.0 + np.abs(ratio - 1.0)), 0.0)
    return np.where(expected == 0, np.where(lag == 0, 1.0, 0.0), agree)


@F.pandas_udf(_struct(PAIR_FIELDS))
def pair_measures(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Lag correlation, spectral shape, dominant-bin match and phase of series pairs."""
    def compute(pos):
        a, b = _stack(x, pos), _stack(y, pos)
        n = min(a.shape[1], b.shape[1])
        corr, lag = _lag(a[:, :n], b[:, :n], max(1, n // 4))
        p, q = np.abs(coefficients(a)) ** 2, np.abs(coefficients(b)) ** 2
        m = min(p.shape[1], q.shape[1])
        norm = lambda v: np.sqrt((v * v).sum(axis=1)) + 1e-12
        cosine = (p[:, :m] * q[:, :m]).sum(axis=1) / (norm(p[:, :m]) * norm(q[:, :m]))
        near = np.abs(describe(p)["dominant_index"] - describe(q)["dominant_index"]) <= 1
        return {"lag_corr": corr, "best_lag": lag, "freq_match": near.astype(float),
                "shape": np.clip((cosine + 1.0) / 2.0, 0.0, 1.0) if m else np.zeros(len(pos)),
                "phase": _phase(a[:, :n], b[:, :n], lag, 16)}

    frame = _grouped([(len(a), len(b)) for a, b in zip(x, y)], compute, PAIR_FIELDS)
    return frame.astype({"best_lag": "int32"})
