"""Special functions on NumPy arrays that neither Spark nor NumPy has."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

def lgamma(x) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _shifted(x, step, start):
    """Lifts x above 10 by the recurrence f(x) = f(x + 1) + step(x); returns the lifted x and the sum of steps."""
    x = np.array(x, float, copy=True)
    total = np.full_like(x, start)
    for _ in range(10):
        low = x < 10
        if not low.any():
            break
        total[low] += step(x[low])
        x[low] += 1
    return x, total


def digamma(x) -> np.ndarray:
    """Derivative of log gamma, for x > 0: recurrence up to 10, then the asymptotic series."""
    x, add = _shifted(x, lambda v: -1 / v, 0.0)
    i = 1 / (x * x)
    return add + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (5 / 660 - i * 691 / 32760)))))


def trigamma(x) -> np.ndarray:
    """Second derivative of log gamma, for x > 0."""
    x, add = _shifted(x, lambda v: 1 / (v * v), 0.0)
    i = 1 / (x * x)
    return add + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i * (1 / 30 - i * (5 / 66 - i * 691 / 2730)))))


def bessel_k(nu: float, x, points: int = 400) -> np.ndarray:
    """Modified Bessel function of the second kind, x > 0.

    The trapezoidal rule for the integral of exp(-x cosh t) cosh(nu t) over t > 0: the integrand falls doubly
    exponentially, so the rule converges faster than any power of the step.
    """
    x = np.asarray(x, float)
    flat = np.maximum(x.ravel(), 1e-300)
    end = np.arccosh(1 + (750 + nu * 40) / flat)
    t = np.linspace(0, 1, points)[None, :] * end[:, None]
    exponent = -flat[:, None] * np.cosh(t)
    values = 0.5 * (np.exp(exponent + nu * t) + np.exp(exponent - nu * t))
    step = end / (points - 1)
    return (step * (values.sum(1) - 0.5 * values[:, 0] - 0.5 * values[:, -1])).reshape(x.shape)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
