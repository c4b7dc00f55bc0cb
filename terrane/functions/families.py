"""Likelihood families: log-likelihood, score, negative second derivative and link, as columns and as NumPy functions.

y is the latent value, z the observation. `parameters`: sigma (gaussian), alpha (gamma), beta (beta).
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .special import digamma, lgamma, trigamma

DEFAULTS = {"sigma": math.sqrt(0.1), "alpha": 2.0, "beta": 0.5}


@dataclass(frozen=True)
class Family:
    name: str
    llh: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    hess: Callable[[np.ndarray, np.ndarray], np.ndarray]
    link: Callable[[np.ndarray], np.ndarray]
    support: Callable[[np.ndarray], np.ndarray]
    message: str
    columns: Callable[[Column, Column], dict[str, Column]] | None = None


def _logistic(p: dict) -> Family:
    mean = lambda y: 1 / (1 + np.exp(-y))

    def columns(y: Column, z: Column) -> dict[str, Column]:
        m = 1 / (1 + F.exp(-y))
        return {"llh": z * y - F.log1p(F.exp(y)), "score": z - m, "hess": m * (1 - m), "link": m}

    return Family("logistic", lambda y, z: z * y - np.logaddexp(0, y), lambda y, z: z - mean(y), lambda y, z: mean(y) * (1 - mean(y)), mean, lambda z: (z == 0) | (z == 1), "logistic data must be 0 or 1", columns)


def _poisson(p: dict) -> Family:
    def columns(y: Column, z: Column) -> dict[str, Column]:
        # Spark has no log gamma: Stirling's series, above 10, for log (z + 10)! less the ten logarithms between.
        x = z + 11.0
        high = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - 1 / (1680 * x * x * x * x * x * x * x)
        fact = high
        for k in range(1, 11):
            fact = fact - F.log(z + float(k))
        return {"llh": z * y - F.exp(y) - fact, "score": z - F.exp(y), "hess": F.exp(y), "link": F.exp(y)}

    return Family("poisson", lambda y, z: z * y - np.exp(y) - lgamma(z + 1), lambda y, z: z - np.exp(y), lambda y, z: np.exp(y), np.exp, lambda z: (z >= 0) & (z == np.floor(z)), "poisson data must be whole numbers from 0", columns)


def _gaussian(p: dict) -> Family:
    v = p["sigma"] ** 2

    def columns(y: Column, z: Column) -> dict[str, Column]:
        return {"llh": -((z - y) * (z - y)) / (2 * v) - F.lit(math.log(p["sigma"]) + 0.5 * math.log(2 * math.pi)), "score": (z - y) / v, "hess": F.lit(1 / v), "link": y}

    return Family("gaussian", lambda y, z: -((z - y) ** 2) / (2 * v) - 0.5 * np.log(2 * np.pi * v), lambda y, z: (z - y) / v, lambda y, z: np.full(np.shape(y), 1 / v), lambda y: y, np.isfinite, "gaussian data must be finite", columns)


def _gamma(p: dict) -> Family:
    a = p["alpha"]
    c = a * math.log(a) - math.lgamma(a)

    def columns(y: Column, z: Column) -> dict[str, Column]:
        r = z * F.exp(-y)
        return {"llh": -a * r + (a - 1) * F.log(z) - a * y + F.lit(c), "score": a * (r - 1), "hess": a * r, "link": F.exp(y)}

    return Family("gamma", lambda y, z: -a * z * np.exp(-y) + (a - 1) * np.log(z) - a * y + c, lambda y, z: a * (z * np.exp(-y) - 1), lambda y, z: a * z * np.exp(-y), np.exp, lambda z: z > 0, "gamma data must be above 0", columns)


def _gamma_alt(p: dict) -> Family:
    a = p["alpha"]

    def columns(y: Column, z: Column) -> dict[str, Column]:
        r = z * F.exp(y)
        return {"llh": -r + (a - 1) * F.log(z) + a * y - F.lit(math.lgamma(a)), "score": a - r, "hess": r, "link": a / F.exp(y)}

    return Family("gamma_alt", lambda y, z: -z * np.exp(y) + (a - 1) * np.log(z) + a * y - math.lgamma(a), lambda y, z: a - z * np.exp(y), lambda y, z: z * np.exp(y), lambda y: a * np.exp(-y), lambda z: z > 0, "gamma data must be above 0", columns)


def _beta(p: dict) -> Family:
    b = p["beta"]
    shape = lambda y: (b * np.exp(y), b * (1 + np.exp(y)))

    def score(y, z):
        a, c = shape(y)
        return a * (np.log(z) - digamma(a) + digamma(c))

    def hess(y, z):
        a, c = shape(y)
        return -score(y, z) - a * a * (trigamma(c) - trigamma(a))

    def llh(y, z):
        a, c = shape(y)
        return (a - 1) * np.log(z) + (b - 1) * np.log1p(-z) - (lgamma(a) + lgamma(np.full_like(a, b)) - lgamma(c))

    return Family("beta", llh, score, hess, lambda y: 1 / (1 + np.exp(-y)), lambda z: (z > 0) & (z < 1), "beta data must lie between 0 and 1")


FAMILIES = {"logistic": _logistic, "poisson": _poisson, "gaussian": _gaussian, "gamma": _gamma, "gamma_alt": _gamma_alt, "beta": _beta}


def family(name: str, **parameters: float) -> Family:
    """A family by its name or the beginning of one that is unique (gamma is itself)."""
    if name not in FAMILIES:
        fits = [k for k in FAMILIES if k.startswith(name)]
        if len(fits) != 1:
            raise ValueError(f"unknown or ambiguous family {name!r}")
        name = fits[0]
    return FAMILIES[name](DEFAULTS | parameters)


def terms(rows: DataFrame, fam: Family, y: str = "y", z: str = "z") -> DataFrame:
    """rows with llh, score, hess and link; families without column form go through Arrow batches."""
    if fam.columns is not None:
        return rows.withColumns({k: c.cast("double") for k, c in fam.columns(F.col(y), F.col(z)).items()})

    @F.pandas_udf("llh double, score double, hess double, link double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        yy, zz = a.to_numpy(float), b.to_numpy(float)
        return pd.DataFrame({"llh": fam.llh(yy, zz), "score": fam.score(yy, zz), "hess": fam.hess(yy, zz), "link": fam.link(yy)})

    return rows.withColumn("_f", run(y, z)).select(*rows.columns, "_f.*")


def outside(fam: Family, z: str = "z") -> Column:
    """Whether a value of z that isn't null lies outside the family's support."""
    v = F.col(z)
    inside = {
        "logistic": (v == 0) | (v == 1),
        "poisson": (v >= 0) & (v == F.floor(v)),
        "gaussian": ~F.isnan(v) & (F.abs(v) < float("inf")),
        "gamma": v > 0,
        "gamma_alt": v > 0,
        "beta": (v > 0) & (v < 1),
    }[fam.name]
    return v.isNotNull() & ~inside


def check_support(rows: DataFrame, fam: Family, z: str = "z") -> None:
    if rows.where(outside(fam, z)).limit(1).count():
        raise ValueError(fam.message)
