"""Special functions for the mixture models, in NumPy on small arrays."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def digamma(x):
    """By recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def mvlgamma(a, d: int):
    a = np.asarray(a, float)
    return d * (d - 1) / 4 * math.log(math.pi) + sum(lgamma(a - j / 2) for j in range(d))


def logsumexp(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.sum(np.exp(x - top), axis=axis))
