"""Small numeric tools in numpy: normal tails, chi-square tails, root finding."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_ROOT_HALF = math.sqrt(0.5)
#: Beyond this many standard deviations the tail's series is exact to the last digits; nodes a standard deviation.
_FAR, _NODES = 30, 512


def _left_tail() -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the distribution function at the nodes from -_FAR to 0, by the library's own erfc, and its slope a node."""
    z = np.arange(-_FAR * _NODES, 2) / _NODES
    value = np.array([math.log(0.5 * math.erfc(-x * _ROOT_HALF)) for x in z.tolist()])
    return value, np.exp(-0.5 * z * z - value) / math.sqrt(2 * math.pi) / _NODES


_VALUE, _SLOPE = _left_tail()


def log_ndtr(z: np.ndarray) -> np.ndarray:
    """Logarithm of the standard normal distribution function, precise in both tails: cubic pieces between nodes."""
    z = np.asarray(z, dtype=float)
    t = (np.maximum(-np.abs(z), -_FAR) + _FAR) * _NODES
    i = t.astype(np.int64)
    t = t - i
    a, b, c, d = _VALUE[i], _VALUE[i + 1], _SLOPE[i], _SLOPE[i + 1]
    up = b - a
    low = a + t * (c + t * (3 * up - 2 * c - d + t * (c + d - 2 * up)))
    if (z < -_FAR).any():
        far = np.minimum(z, -_FAR)
        low = np.where(z < -_FAR, -0.5 * far * far - np.log(-far) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / (far * far)), low)
    return np.where(z > 0, np.log1p(-np.exp(low)), low)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom."""
    if math.isnan(x) or df < 1:
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term = math.erfc(math.sqrt(half)), 2 * math.sqrt(half / math.pi) * math.exp(-half)
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= half / (k + 0.5)
        return total
    term = total = math.exp(-half)
    for k in range(1, df // 2):
        term *= half / k
        total += term
    return total


#: The 0.95 quantile of chi-square with one degree of freedom.
CHI2_95_1 = 3.841458820694124


def root(f: Callable[[float], float], a: float, b: float, rounds: int = 200) -> float:
    """Where ``f`` changes its sign between a and b: the chord's zero, an end that stays twice counting half, halving where that is slow."""
    fa, fb = f(a), f(b)
    if fa == 0 or fb == 0 or (fa > 0) == (fb > 0) or not (math.isfinite(fa) and math.isfinite(fb)):
        return _halved(f, a, b, fa, rounds)
    kept = 0
    for turn in range(rounds):
        x = b - fb * (b - a) / (fb - fa)
        if turn % 8 == 7 or not min(a, b) < x < max(a, b):
            x = (a + b) / 2
        if abs(b - a) < 1e-8 or x in (a, b):
            break
        fx = f(x)
        if fx == 0:
            return x
        if (fx > 0) == (fb > 0):
            b, fb = x, fx
            fa = fa / 2 if kept == 1 else fa
            kept = 1
        else:
            a, fa = x, fx
            fb = fb / 2 if kept == -1 else fb
            kept = -1
        if abs(fx) < 1e-10:
            return x
    return (a + b) / 2


def _halved(f: Callable[[float], float], a: float, b: float, fa: float, rounds: int) -> float:
    for _ in range(rounds):
        mid = (a + b) / 2
        if mid in (a, b) or abs(b - a) < 1e-8:
            break
        if (f(mid) > 0) == (fa > 0):
            a = mid
        else:
            b = mid
    return (a + b) / 2
