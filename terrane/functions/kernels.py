"""Covariance kernels as Spark columns and as NumPy functions of distance.

Matern parameters are (variance, range, smoothness). Smoothness 1.5 and 2.5 scale the distance by the square root of
twice the smoothness, other values (0.5 apart, where both agree up to that factor) don't: the closed forms and the
general form are different parametrisations. The double exponential is (variance 1, range 1, variance 2, range 2).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import bessel_k

#: A covariance model: a name, or a function of two (n, d) arrays of paired locations that returns n covariances.
Model = str | Callable[[np.ndarray, np.ndarray], np.ndarray]

CLOSED = (0.5, 1.5, 2.5)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two array columns."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def check(model: Model, parameters: Sequence[float]) -> None:
    if callable(model):
        return
    wanted = {"matern": 3, "esqe": 4}
    if model not in wanted:
        raise ValueError(f"unknown covariance model {model!r}")
    if len(parameters) != wanted[model]:
        raise ValueError(f"{model} takes {wanted[model]} parameters")


def _exp(x: np.ndarray) -> np.ndarray:
    """The C library's exponential, as in SQL. NumPy's vector code is off by the last bit now and then, which shows where
    near points' variance less their covariance cancels."""
    return np.fromiter(map(math.exp, x.ravel().tolist()), float, x.size).reshape(x.shape)


def matern(d: np.ndarray, parameters: Sequence[float]) -> np.ndarray:
    variance, range_, nu = parameters
    h = np.asarray(d, float) / range_
    if nu == 0.5:
        return variance * _exp(-h)
    if nu == 1.5:
        s = math.sqrt(3) * h
        return variance * (1 + s) * np.exp(-s)
    if nu == 2.5:
        s = math.sqrt(5) * h
        return variance * (1 + s + s * s / 3) * np.exp(-s)
    out = np.full(h.shape, float(variance))
    apart = h > 0
    if apart.any():
        v, back = np.unique(h[apart], return_inverse=True)
        k = np.concatenate([bessel_k(nu, v[i : i + 4096]) for i in range(0, len(v), 4096)])
        value = np.exp(math.log(variance) + (1 - nu) * math.log(2) - math.lgamma(nu) + nu * np.log(v) + np.log(np.maximum(k, 1e-300)))
        out[apart] = np.where(k > 0, value, 0.0)[back]
    return out


def esqe(d: np.ndarray, parameters: Sequence[float]) -> np.ndarray:
    v1, r1, v2, r2 = parameters
    d = np.asarray(d, float)
    return v1 * np.exp(-d / r1) + v2 * np.exp(-((d / r2) ** 2))


def covariance(model: Model, parameters: Sequence[float], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Covariances of paired locations: a and b have the same shape (..., d)."""
    if callable(model):
        return np.asarray(model(a.reshape(-1, a.shape[-1]), b.reshape(-1, b.shape[-1])), float).reshape(a.shape[:-1])
    d = np.sqrt(((a - b) ** 2).sum(-1))
    return matern(d, parameters) if model == "matern" else esqe(d, parameters)


def column(d: Column, model: Model, parameters: Sequence[float]) -> Column:
    """A kernel as a column of distances; general smoothness goes through Arrow batches."""
    check(model, parameters)
    if model == "esqe":
        v1, r1, v2, r2 = (F.lit(float(p)) for p in parameters)
        return v1 * F.exp(-d / r1) + v2 * F.exp(-((d / r2) * (d / r2)))
    if callable(model):
        raise TypeError("a function of locations is no function of distance")
    variance, range_, nu = parameters
    h = d / F.lit(float(range_))
    if nu == 0.5:
        return F.lit(float(variance)) * F.exp(-h)
    if nu == 1.5:
        s = F.lit(math.sqrt(3)) * h
        return F.lit(float(variance)) * (1 + s) * F.exp(-s)
    if nu == 2.5:
        s = F.lit(math.sqrt(5)) * h
        return F.lit(float(variance)) * (1 + s + s * s / 3) * F.exp(-s)

    @F.pandas_udf("double")
    def general(x: pd.Series) -> pd.Series:
        return pd.Series(matern(x.to_numpy(), parameters))

    return general(d)
