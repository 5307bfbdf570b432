"""Driver-side statistics on vectors the size of the sample sheet, and the F distribution."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np


def _continued(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _continued(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _continued(b, a, 1 - x) / b


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def f_quantile(p: float, d1: float, d2: float) -> float:
    """The value that F passes with probability ``p``, by bisection."""
    lo, hi = 0.0, 1.0
    while f_upper(hi, d1, d2) > p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_upper(mid, d1, d2) > p else (lo, mid)
    return (lo + hi) / 2


def _dummies(values: Sequence) -> np.ndarray:
    """Treatment contrasts of a factor, or a numeric column as it is."""
    if all(isinstance(v, (int, float, np.floating, np.integer)) and not isinstance(v, bool) for v in values):
        return np.asarray(values, dtype=float)[:, None]
    levels = sorted(set(map(str, values)))
    return np.array([[float(str(v) == k) for k in levels[1:]] for v in values]).reshape(len(values), len(levels) - 1)


def full_rank(m: np.ndarray, name: str) -> np.ndarray:
    """Without columns that depend on those before them."""
    kept: list[int] = []
    for k in range(m.shape[1]):
        if np.linalg.matrix_rank(m[:, [*kept, k]]) > len(kept):
            kept.append(k)
    if len(kept) < m.shape[1]:
        warnings.warn(f"dropped {m.shape[1] - len(kept)} dependent columns of {name}", stacklevel=3)
    return m[:, kept]


def make_models(depths: Sequence[float] | None, testvars: Sequence, adjustvars: Sequence[Sequence] = (), test_intercept: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Alternative and null model matrices: intercept, test variable, depth, adjustment variables."""
    n = len(testvars)
    if any(len(a) != n for a in adjustvars) or (depths is not None and len(depths) != n):
        raise ValueError("testvars, depths and adjustvars must have a value for every sample")
    one = np.ones((n, 1))
    rest = [np.asarray(depths, dtype=float)[:, None]] if depths is not None else []
    rest += [_dummies(a) for a in adjustvars]
    if test_intercept:
        mod, mod0 = np.hstack([one, *rest]), np.hstack([*rest]) if rest else np.zeros((n, 0))
    else:
        mod, mod0 = np.hstack([one, _dummies(testvars), *rest]), np.hstack([one, *rest])
    return full_rank(mod, "mod"), full_rank(mod0, "mod0")


def projection(m: np.ndarray) -> np.ndarray:
    """I - M (M'M)^-1 M': the squares along its rows sum up to what the model leaves over."""
    return np.eye(len(m)) - m @ np.linalg.pinv(m)
