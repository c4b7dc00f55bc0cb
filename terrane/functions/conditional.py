"""Gaussian inference with conditional approximations on arrays: what a worker does with the rows of a plan."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from .kernels import Model, covariance
from .linalg import Factor


def u_columns(coords: np.ndarray, nbr: np.ndarray, on_latent: np.ndarray, nugget: np.ndarray, model: Model, parameters: Sequence[float], pos: np.ndarray | None = None, form: str = "factor") -> np.ndarray:
    """Entries of the columns of U; form as in u_of_covariances.

    coords: (n, k, d) locations of each row's neighbours, itself first; nbr: (n, k) ids, -1 for none; on_latent: (n, k);
    nugget: (n, k) of the neighbours. With S the covariance of a row's variables, itself last, the entries are
    R^-1 e_last for S = R'R. Rows of the same number of neighbours are solved together.
    """

    def matrices(rows: np.ndarray, size: int) -> np.ndarray:
        c = coords[rows, :size]
        return covariance(model, parameters, np.repeat(c[:, :, None], size, 2), np.repeat(c[:, None], size, 1))

    return u_of_covariances(matrices, nbr, on_latent, nugget, pos, form)


def u_of_covariances(matrices: Callable[[np.ndarray, int], np.ndarray], nbr: np.ndarray, on_latent: np.ndarray, nugget: np.ndarray, pos: np.ndarray | None = None, form: str = "factor") -> np.ndarray:
    """u_columns from matrices(rows, size): the covariances (len(rows), size, size) of rows' first neighbours.

    form: factor raises where a matrix isn't positive definite. limit goes on where a point is determined by its neighbours,
    as at a repeated location: its entries are infinite. regression gives for each row not the entries but the point's
    variance given its neighbours (first) and their coefficients, which are finite there too.
    """
    n, k = nbr.shape
    out = np.zeros((n, k))
    count = (nbr >= 0).sum(1)
    for size in np.unique(count):
        rows = np.flatnonzero(count == size)
        step = max(1, (1 << 21) // max(1, size * size))
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            s = matrices(r, size)[:, ::-1, ::-1].copy()
            noise = np.where(on_latent[r, :size], 0.0, nugget[r, :size])[:, ::-1]
            s[:, np.arange(size), np.arange(size)] += noise
            if form != "factor":
                b, left = regressions(s[:, ::-1, ::-1], r if pos is None else pos[r])
                if form == "limit":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        root = 1 / np.sqrt(left)
                        out[r, :size] = np.c_[root, np.where(b == 0, 0.0, -b * root[:, None])]
                else:
                    out[r, :size] = np.c_[left, b]
                continue
            try:
                low = np.linalg.cholesky(s)
            except np.linalg.LinAlgError:
                bad = next(i for i, one in enumerate(s) if not _definite(one))
                raise np.linalg.LinAlgError(f"the covariance of the neighbours of pos {int(pos[r[bad]]) if pos is not None else int(r[bad])} isn't positive definite") from None
            last = np.zeros((len(r), size, 1))
            last[:, -1] = 1
            x = np.linalg.solve(low.transpose(0, 2, 1), last)[..., 0]
            out[r, :size] = x[:, ::-1]
    return out


def regressions(s: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (n, size - 1) of each matrix' first variable on the others, and its variance given them. s: (n, size,
    size), positive semidefinite. A variable that those before it determine takes the coefficient 0."""
    size = s.shape[1]
    a, r, left = s[:, 1:, 1:].copy(), s[:, 1:, 0].copy(), s[:, 0, 0].copy()
    least = size * np.finfo(float).eps * np.einsum("nii->ni", s)
    share, b = np.zeros(a.shape), np.zeros(r.shape)
    for j in range(size - 1):
        pivot = np.where(a[:, j, j] > least[:, j + 1], a[:, j, j], np.inf)
        if (a[:, j, j] < -1e-8 * s[:, j + 1, j + 1]).any():
            raise np.linalg.LinAlgError(f"the covariance of the neighbours of pos {int(pos[np.argmin(a[:, j, j])])} isn't positive semidefinite")
        share[:, j, j + 1 :] = a[:, j, j + 1 :] / pivot[:, None]
        a[:, j + 1 :, j + 1 :] -= share[:, j, j + 1 :, None] * a[:, j, None, j + 1 :]
        left -= r[:, j] * r[:, j] / pivot
        b[:, j] = r[:, j] / pivot
        r[:, j + 1 :] -= share[:, j, j + 1 :] * r[:, j, None]
    if (left < -1e-8 * s[:, 0, 0]).any():
        raise np.linalg.LinAlgError(f"the covariance of pos {int(pos[np.argmin(left)])} and its neighbours isn't positive semidefinite")
    for j in range(size - 3, -1, -1):
        b[:, j] -= (share[:, j, j + 1 :] * b[:, j + 1 :]).sum(1)
    return b, np.where(left > least[:, 0], left, 0.0)


def _definite(s: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(s)
    except np.linalg.LinAlgError:
        return False
    return True


@dataclass
class Rows:
    """A plan's rows by position: coords (n, d), is_obs (n), nbr and on_latent (n, k) with -1 for no neighbour."""

    coords: np.ndarray
    is_obs: np.ndarray
    nbr: np.ndarray
    on_latent: np.ndarray
    response_first: bool = False

    @property
    def n(self) -> int:
        return len(self.coords)

    def entries(self, nugget: np.ndarray, model: Model, parameters: Sequence[float]) -> np.ndarray:
        at = np.maximum(self.nbr, 0)
        return u_columns(self.coords[at], self.nbr, self._latent(nugget), nugget[at], model, parameters, np.arange(self.n))

    def _latent(self, nugget: np.ndarray) -> np.ndarray:
        """Neighbours without noise are conditioned on by their value, whatever the rule says."""
        at = np.maximum(self.nbr, 0)
        return self.on_latent | (self.is_obs[at] & (nugget[at] == 0))


def imputed(z: np.ndarray, nugget: np.ndarray, is_obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing observations as the mean of the others with a very large noise; the plan stays as it is."""
    gap = is_obs & np.isnan(z)
    if not gap.any():
        return z, nugget
    known = z[is_obs & ~gap]
    z, nugget = z.copy(), nugget.copy()
    z[gap] = known.mean()
    nugget[gap] = known.var(ddof=1) * 1e8
    return z, nugget


class Posterior:
    """U, and what follows from it, for one set of parameters. z and nugget: (n), ignored where nothing is observed.

    Known variables are the responses with noise and the latent values of observations without. `latent` numbers the
    other latent values.
    """

    def __init__(self, rows: Rows, z: np.ndarray, nugget: np.ndarray, model: Model, parameters: Sequence[float], entries: np.ndarray | None = None):
        z, nugget = imputed(np.asarray(z, float), np.asarray(nugget, float), rows.is_obs)
        self.rows, self.z, self.nugget = rows, np.where(rows.is_obs, z, 0.0), nugget
        exact = rows.is_obs & (nugget == 0)
        self.exact = exact
        self.hidden = np.flatnonzero(~exact)
        latent = np.full(rows.n, -1)
        latent[self.hidden] = np.arange(len(self.hidden))
        self.x = rows.entries(nugget, model, parameters) if entries is None else entries
        at, there = np.maximum(rows.nbr, 0), rows.nbr >= 0
        through = rows._latent(nugget) & ~exact[at] & there
        known = there & ~through
        self.sums = np.where(known, self.x * self.z[at], 0.0).sum(1)  # U_known' z, of the columns of latent values
        col, slot = np.nonzero(through)
        self.row, self.col, self.value = latent[at[col, slot]], col, self.x[col, slot]
        self.noisy = np.flatnonzero(rows.is_obs & (nugget > 0))
        self.root = 1 / np.sqrt(nugget[self.noisy])
        m = len(self.hidden)
        b = np.bincount(self.row, self.value * self.sums[self.col], m)
        if not rows.response_first:
            b -= np.bincount(latent[self.noisy], self.root**2 * self.z[self.noisy], m)
        self.b = b
        self.latent = latent
        self.factor = self._factor(m)

    def _factor(self, m: int) -> Factor | None:
        if not m:
            return None
        if self.rows.response_first and len(self.hidden) == self.rows.n:
            return Factor.of_triangular(m, self.row, self.col, self.value)  # U of the latent values is the factor
        order = np.lexsort((self.row, self.col))
        row, col, value = self.row[order], self.col[order], self.value[order]
        count = np.bincount(col, minlength=self.rows.n)
        first = np.cumsum(count) - count
        i, j, w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for size in np.unique(count[count > 0]):
            c = np.flatnonzero(count == size)
            at = first[c][:, None] + np.arange(size)
            a, b = np.triu_indices(size)
            i.append(row[at[:, a]].ravel())
            j.append(row[at[:, b]].ravel())
            w.append((value[at[:, a]] * value[at[:, b]]).ravel())
        if not self.rows.response_first:
            own = self.latent[self.noisy]
            i.append(own)
            j.append(own)
            w.append(self.root**2)
        key, back = np.unique(np.concatenate(i).astype(np.int64) * m + np.concatenate(j), return_inverse=True)
        return Factor(m, key // m, key % m, np.bincount(back, np.concatenate(w)))

    def loglik(self) -> float:
        if not np.isfinite(self.z).all():
            return math.nan
        own = self.x[:, 0]
        quad = (self.sums**2).sum() + ((self.z[self.noisy] * self.root) ** 2).sum()
        det = -2 * np.log(own).sum() - 2 * np.log(self.root).sum()
        if self.factor is not None:
            quad -= (self.factor.half_solve(self.b) ** 2).sum()
            det += 2 * np.log(self.factor.diagonal).sum()
        n = int(self.rows.is_obs.sum())
        return float(-0.5 * (det + quad + n * math.log(2 * math.pi)))

    def mean(self) -> np.ndarray:
        out = self.z.copy()
        if self.factor is not None:
            out[self.hidden] = -self.factor.solve(self.b)
        return out

    def variance(self) -> np.ndarray:
        out = np.zeros(self.rows.n)
        if self.factor is not None:
            out[self.hidden] = self.factor.inverse_diagonal()
        return out

    def combination(self, weights: np.ndarray) -> np.ndarray:
        """The covariance matrix of weights (k, n) times the latent values."""
        if self.factor is None:
            return np.zeros((len(weights), len(weights)))
        t = self.factor.half_solve(weights[:, self.hidden].T)
        return t.T @ t

    def covariance(self) -> np.ndarray:
        """The dense covariance of all latent values given the data; for a few thousand points."""
        return self.combination(np.eye(self.rows.n))
