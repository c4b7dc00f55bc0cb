"""Trend removal, parameter estimation, and prediction from a fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Model, check
from ..functions.optimise import nelder_mead
from ..functions.conditional import Posterior
from ..sources.storage import materialise
from .evaluate import logliks, predict, response_rows, run
from .specify import Plan, specify

#: Points from which the default range is taken.
RANGE_POINTS = 300


def detrend(values: DataFrame, trend: str = "constant") -> tuple[DataFrame, list[float]]:
    """values with z less its trend, and the coefficients. constant: the mean; none; linear: least squares on the array
    column x, by sums of products (one aggregation; a row of p * p numbers comes to the driver)."""
    if trend == "none":
        return values, []
    if trend == "constant":
        beta = [values.agg(F.avg("z")).first()[0] or 0.0]
        return values.withColumn("z", F.col("z") - F.lit(beta[0])), beta
    if trend != "linear":
        raise ValueError(f"trend {trend!r} isn't known")
    known = values.where("z is not null")
    p = known.select(F.size("x").alias("p")).first()["p"]
    x = [F.col("x")[i] for i in range(p)]
    sums = known.agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(x[i] * F.col("z")).alias(f"b{i}") for i in range(p)]).first()
    a = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    beta = np.linalg.solve(a, np.array([sums[f"b{i}"] for i in range(p)])).tolist()
    fit = sum((x[i] * F.lit(beta[i]) for i in range(1, p)), x[0] * F.lit(beta[0]))
    return values.withColumn("z", F.col("z") - fit), beta


@dataclass
class Fit:
    model: Model
    parameters: list[float]
    nugget: float
    beta: list[float]
    trend: str
    loglik: float
    evaluations: int
    converged: bool
    points: DataFrame = field(repr=False)
    values: DataFrame = field(repr=False)

    def named(self) -> dict[str, float]:
        names = {"matern": ["variance", "range", "smoothness"], "esqe": ["variance 1", "range 1", "variance 2", "range 2"]}
        own = names[self.model] if isinstance(self.model, str) else [f"parameter {i + 1}" for i in range(len(self.parameters))]
        return dict(zip([*own, "nugget"], [*self.parameters, self.nugget], strict=True))


def start_values(points: DataFrame, values: DataFrame) -> list[float]:
    """0.9 of the variance, a quarter of the mean distance of pairs among the RANGE_POINTS points of smallest hash,
    smoothness 0.8, nugget 0.1 of the variance."""
    variance = values.agg(F.var_samp("z")).first()[0] or 1.0
    rows = points.orderBy(F.xxhash64("loc_id"), "loc_id").limit(RANGE_POINTS).select("coords").collect()
    x = np.array([r["coords"] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return [0.9 * variance, float(d.mean() / 4) or 1.0, 0.8, 0.1 * variance]


def estimate(points: DataFrame, values: DataFrame, m: int = 20, model: Model = "matern", trend: str = "constant", start: Sequence[float] | None = None, plan: Plan | None = None, max_evaluations: int = 300, tolerance: float = 1.5e-8, **options) -> Fit:
    """Maximum likelihood for the covariance parameters and the nugget, by Nelder-Mead on their logarithms.

    points: (loc_id, coords); values: (loc_id, z[, x]). start ends with the nugget and is required unless the model is
    matern. The plan is made once. For the rule z without missing values each step of the search is one job over all rows
    of the plan, for all parameters that the step may need; for other rules the search runs in one task that holds the rows.
    Raises if a smoothness above 10 is tried.
    """
    residual, beta = detrend(values, trend)
    if start is None:
        if model != "matern":
            raise ValueError("start values are needed for this model")
        start = start_values(points, residual)
    start = [float(s) for s in start]
    if min(start) <= 0:
        raise ValueError("start values must be above 0")
    if not callable(model):
        check(model, start[:-1])
    plan = plan or specify(points, m, **options)

    def check_smoothness(theta: np.ndarray) -> None:
        if model == "matern" and theta[2] > 10:
            raise ValueError("the smoothness went above 10: give other start values or fix it")

    logs = np.log(start)
    if plan.cond_yz == "z" and not plan.n_pred and not residual.where("z is null").limit(1).count():
        rows = materialise(response_rows(plan, residual))

        def together(points_: np.ndarray) -> list[float]:
            thetas = np.exp(points_)
            check_smoothness(thetas[0])
            # Others beyond the limit are only tried ahead, and lose against any value.
            usable = [t for t in thetas if not (model == "matern" and t[2] > 10)]
            found = iter(logliks(rows, [t[:-1].tolist() for t in usable], [float(t[-1]) for t in usable], model))
            return [np.inf if model == "matern" and t[2] > 10 else -next(found) for t in thetas]

        best, value, calls, done = nelder_mead(None, logs, logs, max_evaluations, tolerance, together)
        return Fit(model, np.exp(best[:-1]).tolist(), float(np.exp(best[-1])), beta, trend, -value, calls, done, points, residual)

    def search(p, rows, z, noise) -> pd.DataFrame:
        def cost(logs: np.ndarray) -> float:
            theta = np.exp(logs)
            check_smoothness(theta)
            try:
                return -Posterior(rows, z, np.full(len(z), theta[-1]), model, theta[:-1].tolist()).loglik()
            except np.linalg.LinAlgError:
                return np.inf

        best, value, calls, done = nelder_mead(cost, logs, logs, max_evaluations, tolerance)
        return pd.DataFrame({"theta": [np.exp(best).tolist()], "loglik": [-value], "calls": [calls], "done": [done]})

    got = run(plan, residual, 0.0, search, "theta array<double>, loglik double, calls long, done boolean").first()
    return Fit(model, list(got["theta"][:-1]), got["theta"][-1], beta, trend, got["loglik"], got["calls"], got["done"], points, residual)


def predict_fit(fit: Fit, predictions: DataFrame, m: int = 30, **options) -> DataFrame:
    """loc_id, is_obs, mean, var at observed and predicted points, trend added. predictions: (loc_id, coords[, x]); a linear
    trend without x raises."""
    plan = specify(fit.points, m, predictions, **options)
    out = predict(plan, fit.values, fit.parameters, fit.nugget, fit.model)
    if fit.trend == "none":
        return out
    if fit.trend == "constant":
        return out.withColumn("mean", F.col("mean") + F.lit(fit.beta[0]))
    if "x" not in predictions.columns:
        raise ValueError("predictions need the trend's x")
    x = fit.values.select("loc_id", "x").unionByName(predictions.select("loc_id", "x"))
    level = F.aggregate(F.zip_with("x", F.array(*[F.lit(b) for b in fit.beta]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return out.join(x, "loc_id").withColumn("mean", F.col("mean") + level).drop("x")
