import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import families, kernels
from terrane.functions.linalg import Factor, incomplete_cholesky
from terrane.functions.optimise import nelder_mead
from terrane.functions.special import bessel_k, digamma, lgamma, normal_quantile, trigamma


def quadrature(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    return (y.sum() - 0.5 * (y[0] + y[-1])) * (x[1] - x[0])


@pytest.mark.parametrize("nu", [0.3, 0.8, 1.3, 2.0])
@pytest.mark.parametrize("x", [1e-3, 0.1, 1.0, 7.5, 40.0])
def test_bessel_k_is_its_integral(nu, x):
    want = quadrature(lambda t: np.exp(-x * np.cosh(t)) * np.cosh(nu * t), 0, np.arccosh(1 + 760 / x))
    assert bessel_k(nu, np.array([x]))[0] == pytest.approx(want, rel=1e-9)


def test_bessel_k_closed_forms():
    x = np.array([0.05, 0.5, 2.0, 10.0])
    assert bessel_k(0.5, x) == pytest.approx(np.sqrt(np.pi / (2 * x)) * np.exp(-x), rel=1e-12)
    assert bessel_k(1.5, x) == pytest.approx(np.sqrt(np.pi / (2 * x)) * np.exp(-x) * (1 + 1 / x), rel=1e-12)


def test_gamma_functions():
    x = np.array([0.05, 0.5, 1.0, 3.7, 25.0])
    h = 1e-5
    assert digamma(x) == pytest.approx((lgamma(x + h) - lgamma(x - h)) / (2 * h), rel=1e-6)
    assert trigamma(x) == pytest.approx((digamma(x + h) - digamma(x - h)) / (2 * h), rel=1e-6)
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert normal_quantile(0.95) == pytest.approx(1.6448536269514722)


@pytest.mark.parametrize("nu", [0.5, 1.5, 2.5, 0.8])
def test_kernels_as_columns_and_arrays(spark, nu):
    d = [0.0, 0.01, 0.2, 1.0, 5.0]
    rows = spark.createDataFrame([(x,) for x in d], "d double")
    got = [r[0] for r in rows.select(kernels.column(F.col("d"), "matern", (1.3, 0.4, nu))).collect()]
    assert got == pytest.approx(kernels.matern(np.array(d), (1.3, 0.4, nu)).tolist(), rel=1e-12, abs=1e-14)
    h = np.array(d) / 0.4
    if nu == 1.5:
        assert got == pytest.approx((1.3 * (1 + np.sqrt(3) * h) * np.exp(-np.sqrt(3) * h)).tolist())
    assert got[0] == pytest.approx(1.3)


def test_general_smoothness_is_not_scaled():
    # At 1.5 the closed form scales the distance, the general form near 1.5 doesn't.
    assert kernels.matern(np.array([1.0]), (1, 1, 1.5))[0] == pytest.approx((1 + math.sqrt(3)) * math.exp(-math.sqrt(3)))
    assert kernels.matern(np.array([1.0]), (1, 1, 1.5 + 1e-9))[0] == pytest.approx(2 * math.exp(-1), abs=1e-6)


def test_kernel_checks():
    with pytest.raises(ValueError):
        kernels.check("matern", (1, 2))
    with pytest.raises(ValueError):
        kernels.check("nothing", (1, 2))


def spd(n, seed=0, density=0.3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < density)
    return a @ a.T + n * np.eye(n)


def test_factor_solves_and_inverts():
    a = spd(12)
    i, j = np.nonzero(np.triu(a))
    f = Factor(12, i, j, a[i, j])
    b = np.arange(12.0)
    assert f.solve(b) == pytest.approx(np.linalg.solve(a, b))
    v = np.zeros((12, 12))
    for c in range(12):
        v[f.index[c], c] = f.value[c]
        v[c, c] = f.diagonal[c]
    assert np.allclose(v @ v.T, a) and np.allclose(v, np.triu(v))
    inverse = np.linalg.inv(a)
    assert f.inverse_diagonal() == pytest.approx(np.diag(inverse))
    for c, own in enumerate(f.selected_inverse()):
        for r, x in own.items():
            assert x == pytest.approx(inverse[r, c])
    with pytest.raises(np.linalg.LinAlgError):
        Factor(2, np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([1.0, 2.0, 1.0]))


def test_incomplete_cholesky():
    a = spd(10, 1, 1.0)
    i, j = np.nonzero(np.tril(np.ones((10, 10))))
    full = np.zeros((10, 10))
    full[i, j] = incomplete_cholesky(i, j, a[i, j])
    assert np.allclose(full, np.linalg.cholesky(a))
    keep = np.abs(i - j) <= 1
    band = incomplete_cholesky(i[keep], j[keep], a[i[keep], j[keep]])
    want = np.zeros((10, 10))
    for r in range(10):
        if r:
            want[r, r - 1] = a[r, r - 1] / want[r - 1, r - 1]
        want[r, r] = math.sqrt(a[r, r] - want[r, r - 1] ** 2 if r else a[r, r])
    assert np.allclose(band, want[i[keep], j[keep]])


def test_nelder_mead():
    best, value, calls, done = nelder_mead(lambda p: (p[0] - 1) ** 2 + 10 * (p[1] + 2) ** 2, np.array([5.0, 5.0]))
    assert done and best == pytest.approx([1, -2], abs=1e-3) and value < 1e-6 and calls <= 300


@pytest.mark.parametrize("name", ["logistic", "poisson", "gaussian", "gamma", "gamma_alt", "beta"])
def test_families_derivatives_and_columns(spark, name):
    fam = families.family(name)
    y = np.array([-1.2, -0.3, 0.4, 1.1])
    z = {"logistic": np.array([0.0, 1, 1, 0]), "poisson": np.array([0.0, 1, 4, 2]), "beta": np.array([0.1, 0.4, 0.7, 0.95])}.get(name, np.array([0.3, 1.2, 2.0, 0.7]))
    h = 1e-5
    assert fam.score(y, z) == pytest.approx((fam.llh(y + h, z) - fam.llh(y - h, z)) / (2 * h), rel=1e-5, abs=1e-7)
    assert fam.hess(y, z) == pytest.approx(-(fam.score(y + h, z) - fam.score(y - h, z)) / (2 * h), rel=1e-4, abs=1e-6)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, z, strict=True))], "i int, y double, z double")
    got = families.terms(rows, fam).orderBy("i").collect()
    for k, want in (("llh", fam.llh(y, z)), ("score", fam.score(y, z)), ("hess", fam.hess(y, z)), ("link", fam.link(y))):
        assert [r[k] for r in got] == pytest.approx(want.tolist(), rel=1e-10, abs=1e-12)


def test_family_names_and_support(spark):
    assert families.family("gauss").name == "gaussian"
    assert families.family("gamma").name == "gamma"
    with pytest.raises(ValueError):
        families.family("ga")
    with pytest.raises(ValueError):
        families.family("cauchy")
    for name, bad in (("logistic", 2.0), ("poisson", 1.5), ("poisson", -1.0), ("gamma", 0.0), ("beta", 1.0)):
        rows = spark.createDataFrame([(bad,)], "z double")
        with pytest.raises(ValueError, match="data must"):
            families.check_support(rows, families.family(name))
    families.check_support(spark.createDataFrame([(None,), (1.0,)], "z double"), families.family("logistic"))
