import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import families
from terrane.functions.kernels import covariance
from terrane.plans import estimate as fitting
from terrane.plans import evaluate, laplace
from terrane.plans.specify import block_full_scale, full_tree, independent_blocks, predictive_process, specify

THETA, TAU, N = (1.0, 0.3, 0.5), 0.09, 30


def kernel(a, b, theta=THETA, model="matern"):
    return covariance(model, theta, np.repeat(a[:, None], len(b), 1), np.repeat(b[None], len(a), 0))


class Data:
    def __init__(self, spark, n=N, d=2, seed=1, n_pred=6):
        rng = np.random.default_rng(seed)
        self.x, self.xp = rng.random((n, d)), rng.random((n_pred, d))
        self.y = np.linalg.cholesky(kernel(self.x, self.x)) @ rng.normal(size=n)
        self.z = self.y + TAU**0.5 * rng.normal(size=n)
        self.points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(self.x)], "loc_id long, coords array<double>")
        self.pred = spark.createDataFrame([(1000 + i, r.tolist()) for i, r in enumerate(self.xp)], "loc_id long, coords array<double>")
        self.values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(self.z)], "loc_id long, z double")
        self.c = kernel(self.x, self.x) + TAU * np.eye(n)

    def exact(self, z=None, c=None):
        z, c = self.z if z is None else z, self.c if c is None else c
        return -0.5 * (np.linalg.slogdet(c)[1] + z @ np.linalg.solve(c, z) + len(z) * np.log(2 * np.pi))

    def kriging(self):
        every = np.r_[self.x, self.xp]
        w = np.linalg.solve(self.c, kernel(self.x, every))
        return w.T @ self.z, np.diag(kernel(every, every) - kernel(every, self.x) @ w)


@pytest.fixture(scope="module")
def data(spark):
    return Data(spark)


def number(df):
    return df.first()[0]


@pytest.mark.parametrize("rule", ["SGV", "y", "z"])
def test_likelihood_is_exact_with_all_neighbors(data, rule):
    plan = specify(data.points, N - 1, cond_yz=rule)
    assert number(evaluate.loglik(plan, data.values, THETA, TAU)) == pytest.approx(data.exact(), abs=1e-8)


def test_one_dimension_and_rules(spark):
    d = Data(spark, d=1)
    plan = specify(d.points, N - 1)
    assert plan.ordering == "coord" and plan.cond_yz == "SGV"
    assert number(evaluate.loglik(plan, d.values, THETA, TAU)) == pytest.approx(d.exact(), abs=1e-8)
    # On a line the exponential kernel is Markov: one neighbour is enough.
    assert number(evaluate.loglik(specify(d.points, 1, cond_yz="y"), d.values, THETA, TAU)) == pytest.approx(d.exact(), abs=1e-8)


def test_response_plan_in_all_tasks_and_in_one(data):
    plan = specify(data.points, 5, cond_yz="z")
    split = number(evaluate.loglik(plan, data.values, THETA, TAU))
    whole = number(evaluate.loglik(plan, data.values.withColumn("nugget", F.lit(TAU)), THETA, None))
    assert split == pytest.approx(whole, abs=1e-9)


def test_prediction_is_kriging_with_all_neighbors(data):
    mean, var = data.kriging()
    for options in ({"cond_yz": "SGV"}, {"cond_yz": "y"}, {"cond_yz": "zy"}, {"cond_yz": "y", "order_pred": "general"}):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            plan = specify(data.points, N - 1, data.pred, **options)
        got = evaluate.predict(plan, data.values, THETA, TAU).orderBy("loc_id").collect()
        assert [r["mean"] for r in got] == pytest.approx(mean.tolist(), abs=5e-3)
        assert [r["var"] for r in got] == pytest.approx(var.tolist(), abs=1e-4)
    plan = specify(data.points, N - 1, data.pred, cond_yz="y", pred_cond="independent")
    got = evaluate.predict(plan, data.values, THETA, TAU, returns="mean").orderBy("loc_id").collect()
    assert [r["mean"] for r in got] == pytest.approx(mean.tolist(), abs=5e-3)


def test_zero_nuggets(spark, data):
    noise = np.full(N, TAU)
    noise[[2, 7, 11]] = 0
    values = spark.createDataFrame([(i, float(z), float(t)) for i, (z, t) in enumerate(zip(data.z, noise, strict=True))], "loc_id long, z double, nugget double")
    c = kernel(data.x, data.x) + np.diag(noise)
    for rule in ("SGV", "y", "z"):
        plan = specify(data.points, N - 1, cond_yz=rule)
        assert number(evaluate.loglik(plan, values, THETA, None)) == pytest.approx(data.exact(c=c), abs=1e-7)
    got = evaluate.predict(specify(data.points, N - 1), values, THETA, None).orderBy("loc_id").collect()
    want = kernel(data.x, data.x) @ np.linalg.solve(c, data.z)
    assert [r["mean"] for r in got] == pytest.approx(want.tolist(), abs=1e-7)
    assert got[7]["var"] == 0 and got[7]["mean"] == pytest.approx(data.z[7])


def test_missing_observations(spark, data):
    values = data.values.withColumn("z", F.when(F.col("loc_id") % 3 > 0, F.col("z")))
    seen = np.arange(N) % 3 > 0
    got = evaluate.predict(specify(data.points, N - 1), values, THETA, TAU).orderBy("loc_id").collect()
    want = kernel(data.x, data.x[seen]) @ np.linalg.solve(data.c[np.ix_(seen, seen)], data.z[seen])
    assert [r["mean"] for r in got] == pytest.approx(want.tolist(), abs=1e-4)
    filled = evaluate.impute_missing(values, TAU).orderBy("loc_id").collect()
    assert filled[0]["z"] == pytest.approx(data.z[seen].mean())
    assert filled[0]["nugget"] == pytest.approx(data.z[seen].var(ddof=1) * 1e8)


def test_trees(data):
    for plan in (independent_blocks(data.points, 8), predictive_process(data.points, 5), block_full_scale(data.points, 8), full_tree(data.points, (4, 3, 3), 2, 2)):
        assert np.isfinite(number(evaluate.loglik(plan, data.values, THETA, TAU)))
        assert plan.cond_yz == "y" and plan.notes[0].startswith("MRA")
    a = number(evaluate.loglik(specify(data.points, 2, conditioning="firstm"), data.values, THETA, TAU))
    b = number(evaluate.loglik(predictive_process(data.points, 2), data.values, THETA, TAU))
    assert a == pytest.approx(b, abs=1e-10)
    with pytest.warns(UserWarning, match="max-min"):
        specify(data.points, 4, conditioning="mra", order="coord")


def test_independent_blocks_are_blocks(data):
    plan = independent_blocks(data.points, 8)
    rows = plan.flags.groupBy("pos").agg(F.collect_set("nbr_pos").alias("s")).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        last[r["pos"]] = set(r["s"])
    ids = [r["loc_id"] for r in plan.ordered.orderBy("pos").collect()]
    groups = []
    for pos, s in last.items():
        for g in groups:
            if g & s:
                g |= s
                break
        else:
            groups.append(set(s))
    total = sum(data.exact(data.z[[ids[i] for i in sorted(g)]], data.c[np.ix_([ids[i] for i in sorted(g)], [ids[i] for i in sorted(g)])]) for g in groups)
    assert number(evaluate.loglik(plan, data.values, THETA, TAU)) == pytest.approx(total, abs=1e-8)


def test_no_neighbors(data):
    plan = specify(data.points, 0)
    want = (-0.5 * (data.z**2 / (1 + TAU) + np.log(2 * np.pi * (1 + TAU)))).sum()
    assert number(evaluate.loglik(plan, data.values, THETA, TAU)) == pytest.approx(want)


def test_covariance_models(spark, data):
    plan = specify(data.points, 4, cond_yz="y")
    name = {(r["pos"], r["slot"]): r["cov"] for r in evaluate.covariance_at_pattern(plan, "matern", THETA).collect()}
    function = {(r["pos"], r["slot"]): r["cov"] for r in evaluate.covariance_at_pattern(plan, lambda a, b: np.exp(-np.sqrt(((a - b) ** 2).sum(1)) / 0.3)).collect()}
    k = kernel(data.x, data.x)
    table = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(N) for j in range(i + 1)], "row_id long, col_id long, value double")
    low = np.linalg.cholesky(k)
    factor = spark.createDataFrame([(i, j, float(low[i, j])) for i in range(N) for j in range(i + 1)], "row_id long, k int, value double")
    matrix = {(r["pos"], r["slot"]): r["cov"] for r in evaluate.covariance_at_pattern(plan, table).collect()}
    product = {(r["pos"], r["slot"]): r["cov"] for r in evaluate.covariance_at_pattern(plan, factor, factor=True).collect()}
    assert name == pytest.approx(function) and name == pytest.approx(matrix) and name == pytest.approx(product)
    sgv = specify(data.points, 6)
    a = number(evaluate.loglik(sgv, data.values, THETA, TAU))
    b = number(evaluate.loglik(sgv, data.values, (), TAU, lambda p, q: np.exp(-np.sqrt(((p - q) ** 2).sum(1)) / 0.3)))
    c = number(evaluate.loglik(sgv, data.values, (), TAU, table))
    assert a == pytest.approx(b) and a == pytest.approx(c)


def test_lower_factor(data):
    plan = specify(data.points, N - 1, cond_yz="y")
    ids = [r["loc_id"] for r in plan.ordered.orderBy("pos").collect()]
    low = np.zeros((N, N))
    for r in evaluate.lower_factor(plan, "matern", THETA).collect():
        low[r["row_id"], r["col_id"]] = r["value"]
    assert np.allclose(low @ low.T, kernel(data.x, data.x), atol=1e-10)
    assert np.allclose(np.triu(low[np.ix_(ids, ids)], 1), 0)


def test_latent_inverse_of_a_forest(spark, monkeypatch):
    """Blocks of positions, and locations that repeat."""
    monkeypatch.setattr(evaluate, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = rng.random((60, 2))
    x[40:45] = x[:5]
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "loc_id long, coords array<double>")
    plan = specify(points, 1, order="none", cond_yz="y")
    cov = np.zeros((60, 60))
    pattern = set()
    for k in range(60):  # each value is its nearest earlier one's times c, and independent noise
        cov[k, k] = 1.0
        if k:
            d = np.sqrt(((x[:k] - x[k]) ** 2).sum(1))
            up = int(np.argmin(d))
            pattern.add((up, k))
            cov[k, :k] = cov[:k, k] = np.exp(-d[up] / 0.3) * cov[up, :k]
    got = {(r["row"], r["col"]): r["value"] for r in evaluate.latent_inverse(plan, THETA).collect()}
    assert set(got) == pattern | {(k, k) for k in range(60)}
    assert all(v == pytest.approx(cov[i], abs=1e-12) for i, v in got.items())
    with pytest.raises(ValueError, match="rule y"):
        evaluate.latent_inverse(specify(points, 1, order="none", cond_yz="z"), THETA)


def test_forms_of_entries(spark, data):
    plan = specify(data.points, 5, order="none", cond_yz="y")
    factor, limit, regression = ({(r["pos"], r["slot"]): r["value"] for r in evaluate.u_entries(plan, THETA, 0.0, form=f).collect()} for f in ("factor", "limit", "regression"))
    assert limit == pytest.approx(factor, rel=1e-9)
    for (pos, slot), v in factor.items():
        own = factor[pos, 0]
        assert regression[pos, slot] == pytest.approx(-v / own if slot else 1 / own**2, rel=1e-9)
    twice = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0.0, 0.2, 0.2, 0.2, 0.5])], "loc_id long, coords array<double>")
    got = evaluate.u_entries(specify(twice, 3, cond_yz="y"), THETA, 0.0, form="regression").where("pos = 3").orderBy("slot").collect()
    assert [r["value"] for r in got] == pytest.approx([0, 1, 0, 0], abs=1e-12)


def test_precision_and_selected_inverse(data):
    plan = specify(data.points, N - 1, cond_yz="y")
    ids = [r["loc_id"] for r in plan.ordered.orderBy("pos").collect()]
    w = evaluate.precision(evaluate.u_entries(plan, THETA, TAU))
    dense = np.zeros((N, N))
    for r in w.collect():
        dense[r["row"], r["col"]] = dense[r["col"], r["row"]] = r["value"]
    k = kernel(data.x[ids], data.x[ids])
    assert np.allclose(np.linalg.inv(dense), k, atol=1e-8)
    for r in evaluate.selected_inverse(w).collect():
        assert r["value"] == pytest.approx(k[r["row"], r["col"]], abs=1e-8)


def test_combinations_and_covariances(spark, data):
    plan = specify(data.points, N - 1, data.pred, cond_yz="y")
    every = np.r_[data.x, data.xp]
    post = kernel(every, every) - kernel(every, data.x) @ np.linalg.solve(data.c, kernel(data.x, every))
    weights = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1000, 1.0)], "comb_id long, loc_id long, weight double")
    h = np.zeros((2, len(every)))
    h[0, :2], h[1, N] = 0.5, 1
    want = h @ post @ h.T
    got = {r["comb_id"]: r["var"] for r in evaluate.combinations(plan, data.values, weights, THETA, TAU).collect()}
    assert got == pytest.approx({0: want[0, 0], 1: want[1, 1]}, abs=1e-3)
    full = {(r["a"], r["b"]): r["cov"] for r in evaluate.combinations(plan, data.values, weights, THETA, TAU, full=True).collect()}
    assert full[0, 1] == pytest.approx(want[0, 1], abs=1e-3)
    cov = {(r["row_id"], r["col_id"]): r["cov"] for r in evaluate.covariance_matrix(plan, data.values, THETA, TAU).collect()}
    assert cov[0, 3] == pytest.approx(post[0, 3], abs=1e-3) and len(cov) == len(every) ** 2


@pytest.mark.parametrize("name", ["logistic", "poisson", "gamma", "gauss", "beta"])
def test_laplace_is_dense_laplace(spark, data, name):
    rng = np.random.default_rng(8)
    z = {
        "logistic": (rng.random(N) < 1 / (1 + np.exp(-data.y))) * 1.0,
        "poisson": rng.poisson(np.exp(data.y)) * 1.0,
        "gamma": rng.gamma(2, np.exp(data.y) / 2),
        "gauss": data.z,
        "beta": np.clip(rng.beta(2, 2, N), 0.01, 0.99),
    }[name]
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "loc_id long, z double")
    plan = specify(data.points, N - 1)
    post = laplace.posterior(plan, values, name, THETA)
    want, sd = laplace.dense_posterior(z, families.family(name), kernel(data.x, data.x))
    got = post.table.orderBy("loc_id").collect()
    assert post.converged
    assert [r["mean"] for r in got] == pytest.approx(want.tolist(), abs=1e-5)
    out = laplace.laplace_predict(post, plan).orderBy("loc_id").collect()
    assert [r["var"] ** 0.5 for r in out] == pytest.approx(sd.tolist(), abs=1e-4)
    assert all(r["lower"] <= r["data_mean"] <= r["upper"] for r in out)


def test_laplace_likelihood(spark, data):
    plan = specify(data.points, N - 1)
    got = number(laplace.laplace_loglik(plan, data.values, "gauss", THETA, sigma=TAU**0.5))
    assert got == pytest.approx(data.exact(), abs=1e-7)  # Laplace is exact for Gaussian data
    first = specify(data.points, N, cond_yz="zy")
    own = specify(data.points, first.m)
    assert number(laplace.laplace_loglik(first, data.values, "gauss", THETA, sigma=0.3)) == pytest.approx(number(laplace.laplace_loglik(first, data.values, "gauss", THETA, plan_likelihood=own, sigma=0.3)))
    again = number(laplace.laplace_loglik(first, data.values, "gauss", THETA, plan_likelihood=plan, sigma=TAU**0.5))
    assert again == pytest.approx(data.exact(), abs=1e-5)
    with pytest.warns(UserWarning, match="converge"):
        binary = data.values.withColumn("z", (F.col("z") > 0).cast("double"))
        assert number(laplace.laplace_loglik(plan, binary, "logistic", THETA, max_iterations=1)) == float("-inf")


def test_laplace_checks_and_options(spark, data):
    plan = specify(data.points, 6)
    with pytest.raises(ValueError, match="gamma data must"):
        laplace.posterior(plan, data.values, "gamma", THETA)
    with pytest.raises(ValueError):
        laplace.posterior(plan, data.values, "gauss", (1.0,))
    gaps = data.values.withColumn("z", F.when(F.col("loc_id") % 2 == 0, (F.col("z") > 0).cast("double")))
    start = data.points.select("loc_id", F.lit(0.1).alias("y"))
    a = laplace.posterior(plan, gaps, "logistic", THETA)
    b = laplace.posterior(plan, gaps, "logistic", THETA, start=start)
    assert a.converged and b.converged
    x, y = ({r["loc_id"]: r["mean"] for r in p.table.collect()} for p in (a, b))
    assert x == pytest.approx(y, abs=1e-4)


def test_laplace_accuracy_on_a_grid(spark):
    """400 points, half observed, trees with m = 25: near the dense Laplace solution."""
    side = np.linspace(0, 1, 20)
    x = np.stack(np.meshgrid(side, side), -1).reshape(-1, 2)
    theta = (1.0, 0.15, 1.5)
    k = kernel(x, x, theta)
    rng = np.random.default_rng(3)
    y = np.linalg.cholesky(k + 1e-9 * np.eye(400)) @ rng.normal(size=400)
    z = rng.poisson(np.exp(y)) * 1.0
    seen = rng.permutation(400) < 200
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "loc_id long, coords array<double>")
    values = spark.createDataFrame([(i, float(z[i]) if seen[i] else None) for i in range(400)], "loc_id long, z double")
    post = laplace.posterior(specify(points, 25, conditioning="mra"), values, "poisson", theta)
    dense, _ = laplace.dense_posterior(z[seen], families.family("poisson"), k[np.ix_(seen, seen)])
    full = k[:, seen] @ np.linalg.solve(k[np.ix_(seen, seen)], dense)
    got = np.array([r["mean"] for r in post.table.orderBy("loc_id").collect()])
    assert np.sqrt(((got - full) ** 2).mean()) < 0.25


def test_estimation(spark):
    d = Data(spark)
    values = d.values.withColumn("z", F.col("z") + 3)
    fit = fitting.estimate(d.points, values, 10, max_evaluations=150)
    assert fit.beta[0] == pytest.approx(d.z.mean() + 3)
    assert set(fit.named()) == {"variance", "range", "smoothness", "nugget"}
    plan = specify(d.points, 10)
    start = number(evaluate.loglik(plan, fit.values, (1.0, 0.3, 0.5), 0.1))
    assert fit.loglik > start
    assert fit.loglik == pytest.approx(number(evaluate.loglik(plan, fit.values, fit.parameters, fit.nugget)), abs=1e-6)
    out = fitting.predict_fit(fit, d.pred, 15)
    level = out.agg(F.avg("mean")).first()[0]
    assert 1.5 < level < 4.5
    with pytest.raises(ValueError):
        fitting.estimate(d.points, values, 5, model="esqe")
    with pytest.raises(ValueError):
        fitting.estimate(d.points, values, 5, start=[1.0, -1.0, 0.5, 0.1])
    assert fitting.start_values(d.points, values)[2] == 0.8


def test_trends(spark, data):
    x = spark.createDataFrame([(i, [1.0, float(p[0])]) for i, p in enumerate(data.x)], "loc_id long, x array<double>")
    values = data.values.join(x, "loc_id").withColumn("z", F.col("z") + 2 + 5 * F.col("x")[1])
    rest, beta = fitting.detrend(values, "linear")
    design = np.stack([np.ones(N), data.x[:, 0]], 1)
    want = np.linalg.lstsq(design, data.z + 2 + 5 * data.x[:, 0], rcond=None)[0]
    assert beta == pytest.approx(want.tolist())
    assert fitting.detrend(values, "none")[1] == []
    with pytest.raises(ValueError):
        fitting.detrend(values, "other")
    assert abs(rest.agg(F.avg("z")).first()[0]) < 1e-9


def test_specify_checks(spark, data):
    with pytest.raises(ValueError):
        specify(data.points)
    for bad in ({"order": "x"}, {"cond_yz": "x"}, {"conditioning": "x"}):
        with pytest.raises(ValueError):
            specify(data.points, 3, **bad)
    with pytest.raises(ValueError, match="repeat"):
        specify(data.points, 3, data.points.withColumn("loc_id", F.col("loc_id") + 500))
    with pytest.warns(UserWarning):
        assert specify(data.points, 99).m == N - 1
    assert specify(data.points, 3, data.pred).cond_yz == "zy"
    plan = specify(data.points, 3, order="none", cond_yz="z")
    assert [r["loc_id"] for r in plan.ordered.orderBy("pos").collect()] == list(range(N))
    assert plan.index().count() == N and plan.pattern().count() > 2 * N


def test_failed_factor_names_the_point(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [1.0])], "loc_id long, coords array<double>")
    plan = specify(points, 2, cond_yz="y")
    with pytest.raises(Exception, match="pos 1"):
        evaluate.u_entries(plan, THETA, 0.1).collect()


def test_stream(spark, data, tmp_path):
    from terrane.streaming.scoring import score_stream

    (tmp_path / "in").mkdir()
    data.pred.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.pred.schema).parquet(str(tmp_path / "in"))
    sink = lambda rows, k: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/{k}"))
    q = score_stream(stream, data.points, data.values, THETA, TAU, sink, str(tmp_path / "cp"), m=10, cond_yz="y")
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out/0"))
    want = evaluate.predict(specify(data.points, 10, data.pred, cond_yz="y"), data.values, THETA, TAU).where("not is_obs")
    a, b = ({r["loc_id"]: r["mean"] for r in t.collect()} for t in (got, want))
    assert a == pytest.approx(b)


def test_stream_of_independent_predictions(spark, data, tmp_path):
    """Without a plan's options every location hangs on its nearest observations, whatever the batches."""
    from terrane.streaming.scoring import score_stream

    data.pred.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.pred.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink = lambda rows, k: rows.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}"))
    score_stream(stream, data.points, data.values, THETA, TAU, sink, str(tmp_path / "cp"), m=4, once=True).awaitTermination()
    got = {r["loc_id"]: (r["mean"], r["var"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    z = {r["loc_id"]: r["z"] for r in data.values.collect()}
    x = {r["loc_id"]: np.array(r["coords"]) for r in data.points.collect()}
    for r in data.pred.collect():
        at = np.array(r["coords"])
        near = sorted((float(np.sqrt(((x[i] - at) ** 2).sum())), i) for i in x)[:4]
        own = np.array([x[i] for _, i in near])
        k = kernel(own, own) + TAU * np.eye(4)
        c = kernel(at[None], own)[0]
        want = (c @ np.linalg.solve(k, [z[i] for _, i in near]), 1 - c @ np.linalg.solve(k, c))
        assert got[r["loc_id"]] == pytest.approx(want)
