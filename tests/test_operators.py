import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.operators import latent, mra, neighbors, ordering, pattern
from terrane.sources import points
from terrane.sources.storage import running_sum


def frame(spark, x, first=0):
    x = np.asarray(x, float)
    return spark.createDataFrame([(first + i, row.tolist(), True) for i, row in enumerate(x)], "loc_id long, coords array<double>, is_obs boolean")


def order_of(df):
    return [r["loc_id"] for r in df.orderBy("pos").collect()]


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(5).random((300, 2))


def test_orderings(spark, cloud):
    p = frame(spark, cloud)
    assert order_of(ordering.by_coordinate(p)) == np.argsort(cloud.sum(1), kind="stable").tolist()
    assert order_of(ordering.by_coordinate(p, [1])) == np.argsort(cloud[:, 1], kind="stable").tolist()
    d = np.sqrt(((cloud - [0.2, 0.9]) ** 2).sum(1))
    assert order_of(ordering.by_distance(p, [0.2, 0.9])) == np.argsort(d, kind="stable").tolist()
    d = np.sqrt(((cloud - cloud.mean(0)) ** 2).sum(1))
    middle = np.argsort(d, kind="stable").tolist()
    assert order_of(ordering.middle_out(p)) == middle
    assert order_of(ordering.outside_in(p)) == middle[::-1]
    with pytest.raises(ValueError):
        ordering.by_distance(p, [1.0])


def test_lonlat(spark):
    lonlat = np.array([[0.0, 0.0], [90, 0], [180, 0], [0, 89]])
    p = frame(spark, lonlat)
    xyz = np.array([r[0] for r in p.orderBy("loc_id").select(points.lonlat_xyz(F.col("coords"))).collect()])
    assert np.allclose((xyz**2).sum(1), 1)
    assert order_of(ordering.by_distance(p, [1.0, 1.0], lonlat=True)) == [0, 3, 1, 2]
    assert order_of(ordering.by_distance(p, xyz[2].tolist(), lonlat=True))[0] == 2
    assert sorted(order_of(ordering.middle_out(p, lonlat=True))) == [0, 1, 2, 3]


def greedy(x):
    out = [int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))]
    far = np.full(len(x), np.inf)
    for _ in range(len(x) - 1):
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
        far[out] = -1
        out.append(int(np.argmax(far)))
    return out


@pytest.mark.parametrize("shape", [(1, 2), (2, 1), (300, 1), (900, 2), (300, 5)])
def test_maxmin_is_greedy(shape):
    x = np.random.default_rng(shape[0]).random(shape)
    assert ordering.maxmin_places(x).tolist() == greedy(x)


def test_maxmin_ties_on_a_grid(spark):
    x = np.stack(np.meshgrid(np.arange(25.0), np.arange(25.0)), -1).reshape(-1, 2)
    assert ordering.maxmin_places(x).tolist() == greedy(x)
    assert order_of(ordering.maxmin(frame(spark, x[:50]))) == greedy(x[:50])


def test_maxmin_with_predictions(spark, cloud):
    """Behind the observed points, always the predicted point farthest from all before it."""
    pred = np.vstack([np.random.default_rng(9).random((40, 2)), cloud[:3]])
    both = points.union(frame(spark, cloud), frame(spark, pred, 1000))
    got = order_of(ordering.maxmin_obs_pred(both))
    assert got[:300] == greedy(cloud)
    before, want = cloud, []
    left = dict(enumerate(pred))
    while left:
        far = {i: ((before - p) ** 2).sum(1).min() for i, p in left.items()}
        pick = min(far, key=lambda i: (-far[i], i))
        want.append(1000 + pick)
        before = np.vstack([before, left.pop(pick)])
    assert got[300:] == want
    x = np.random.default_rng(1).random((900, 3))
    assert ordering.maxmin_places(x, 700)[:700].tolist() == greedy(x[:700])
    assert ordering.maxmin_places(x, 0).tolist() == greedy(x) == ordering.maxmin_places(x, 900).tolist()


def test_center_is_exact(spark):
    x = np.r_[[1e16, 1.0, -1e16, 3.0], np.random.default_rng(0).random(500)].reshape(-1, 1) * [1.0, 0.1]
    want = [math.fsum(x[:, i]) / len(x) for i in (0, 1)]
    for parts in (1, 3, 7):
        p = frame(spark, x)
        assert ordering.center(p.repartition(parts, F.xxhash64("loc_id"))) == want
        assert ordering.center(p.where("loc_id < 0").repartition(parts)) == []


def test_rotation(spark):
    x = np.arange(20.0)[:, None]
    o = ordering.by_coordinate(frame(spark, x))
    assert order_of(ordering.rotated(o)) == [0, *range(9, 20), *range(1, 9)]
    assert order_of(ordering.rotated(ordering.by_coordinate(frame(spark, x[:5])))) == [0, 1, 2, 3, 4]


def sets_of(df):
    out = {}
    for r in df.orderBy("pos", "slot").collect():
        out.setdefault(r["pos"], []).append(r["nbr_pos"])
    return out


@pytest.mark.parametrize(("d", "n", "m"), [(1, 200, 3), (2, 600, 5), (3, 150, 4), (2, 5, 9)])
def test_ordered_neighbors(spark, d, n, m):
    x = np.random.default_rng(n).random((n, d))
    o = frame(spark, x).withColumnRenamed("loc_id", "pos")
    got = sets_of(neighbors.ordered_neighbors(o, m))
    for k in range(n):
        dist = np.sqrt(((x[:k] - x[k]) ** 2).sum(1))
        assert got[k] == [k, *np.argsort(dist, kind="stable")[:m].tolist()]


def test_ordered_neighbors_clustered_and_tied(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1e-4, (300, 2)), rng.random((20, 2)) * 100, np.repeat([[3.0, 3.0]], 30, 0)])
    o = frame(spark, x).withColumnRenamed("loc_id", "pos")
    got = sets_of(neighbors.ordered_neighbors(o, 4))
    for k in range(len(x)):
        dist = np.sqrt(((x[:k] - x[k]) ** 2).sum(1))
        assert got[k] == [k, *np.argsort(dist, kind="stable")[:4].tolist()]


def test_plain_and_query_neighbors(spark, cloud):
    q = np.random.default_rng(3).random((50, 2)) * 3 - 1
    got = {}
    for r in neighbors.plain_neighbors(frame(spark, cloud), 6).orderBy("query", "slot").collect():
        got.setdefault(r["query"], []).append(r["nbr"])
    for k in range(len(cloud)):
        d = np.sqrt(((cloud - cloud[k]) ** 2).sum(1))
        d[k] = np.inf
        assert got[k] == np.argsort(d, kind="stable")[:6].tolist()
    got = {}
    table = frame(spark, q).select(F.col("loc_id").alias("query"), "coords")
    for r in neighbors.query_neighbors(table, frame(spark, cloud), 3).orderBy("query", "slot").collect():
        got.setdefault(r["query"], []).append(r["nbr"])
    for k in range(len(q)):
        assert got[k] == np.argsort(np.sqrt(((cloud - q[k]) ** 2).sum(1)), kind="stable")[:3].tolist()


@pytest.mark.parametrize("d", [9, 64])
def test_neighbors_in_many_dimensions(spark, monkeypatch, d):
    """Blocks of pairs, with ties, copies, far points and one without a finite place."""
    monkeypatch.setattr(neighbors, "SIDE", 64)
    rng = np.random.default_rng(d)
    x = np.vstack([np.round(rng.normal(size=(150, d))), np.repeat(rng.normal(size=(1, d)), 60, 0), rng.normal(size=(40, d)) * 1e6])
    o = frame(spark, x)
    plain, before = {}, sets_of(neighbors.ordered_neighbors(o.withColumnRenamed("loc_id", "pos"), 4))
    for r in neighbors.plain_neighbors(o, 6).orderBy("query", "slot").collect():
        plain.setdefault(r["query"], []).append((r["nbr"], r["dist"]))
    for k in range(len(x)):
        dist = np.sqrt(((x - x[k]) ** 2).sum(1))
        assert before[k] == [k, *np.argsort(dist[:k], kind="stable")[:4].tolist()]
        dist[k] = np.inf
        want = np.argsort(dist, kind="stable")[:6]
        assert [n for n, _ in plain[k]] == want.tolist()
        assert [v for _, v in plain[k]] == dist[want].tolist()
    x[5, 2] = np.nan
    row, nbr, _ = neighbors.nearest_rows(x, np.arange(len(x)), np.full(len(x), len(x)), x, np.arange(len(x)), 3)
    assert 5 not in row and 5 not in nbr and (np.bincount(row) == 3).sum() == len(x) - 1


def test_other_sets(spark, cloud):
    o = frame(spark, cloud[:12]).withColumnRenamed("loc_id", "pos")
    assert sets_of(neighbors.first_neighbors(o, 3))[7] == [7, 2, 1, 0]
    assert sets_of(neighbors.first_neighbors(o, 3))[2] == [2, 1, 0]
    assert sets_of(neighbors.no_neighbors(o))[5] == [5]
    mixed = o.withColumn("is_obs", F.col("pos") < 9)
    got = sets_of(neighbors.independent_predictions(mixed, neighbors.no_neighbors(mixed), 4))
    d = np.sqrt(((cloud[:9] - cloud[10]) ** 2).sum(1))
    assert got[10] == [10, *sorted(np.argsort(d, kind="stable")[:4].tolist(), reverse=True)]
    assert got[3] == [3]
    with pytest.raises(ValueError):
        neighbors.check_m(None, 5)
    with pytest.warns(UserWarning):
        assert neighbors.check_m(9, 5) == 4


def naive_sgv(sets, first_pred):
    latent_sets, flags = [], []
    for k, s in enumerate(sets):
        scores = [(len(set(s) & latent_sets[j]) if j < first_pred else -1) for j in s[1:]]
        part = set(s) & latent_sets[s[1:][int(np.argmax(scores))]] if scores and max(scores) > 0 else set()
        part |= {k} | {j for j in s if j >= first_pred}
        latent_sets.append(part)
        flags.append([j in part for j in s])
    return flags


def test_sgv(spark):
    rng = np.random.default_rng(4)
    sets = [[k, *rng.permutation(k)[:5].tolist()] for k in range(60)]
    for first in (40, 60):
        assert latent.sgv_flags(sets, first) == naive_sgv(sets, first)
    rows = [(k, i, int(j)) for k, s in enumerate(sets) for i, j in enumerate(s)]
    got = latent.sgv(spark.createDataFrame(rows, "pos long, slot int, nbr_pos long"), 40, treat_predictions=True)
    flags = {}
    for r in got.orderBy("pos", "slot").collect():
        flags.setdefault(r["pos"], []).append(r["on_latent"])
    assert [flags[k] for k in range(40)] == naive_sgv(sets, 40)[:40]
    assert all(all(flags[k]) for k in range(40, 60))


def test_zero_nuggets_and_rules(spark):
    c = spark.createDataFrame([(0, 0, 0, True), (1, 0, 1, True), (1, 1, 0, False)], "pos long, slot int, nbr_pos long, on_latent boolean")
    nug = spark.createDataFrame([(0, 0.0), (1, 0.2)], "pos long, nugget double")
    got = {(r["pos"], r["slot"]): r["on_latent"] for r in latent.with_zero_nuggets(c, nug).collect()}
    assert got[1, 1] is True
    with pytest.raises(ValueError):
        latent.response_first(c, c, 3, "nothing")


def test_pattern(spark):
    o = spark.createDataFrame([(0, True), (1, False), (2, True)], "pos long, is_obs boolean")
    index = pattern.u_index(o)
    assert [tuple(r) for r in index.orderBy("pos").collect()] == [(0, 0, 1), (1, 2, None), (2, 3, 4)]
    c = spark.createDataFrame([(0, 0, 0, True), (1, 0, 1, True), (1, 1, 0, False), (2, 0, 2, True), (2, 1, 1, True)], "pos long, slot int, nbr_pos long, on_latent boolean")
    got = {(r["row"], r["col"]) for r in pattern.u_pattern(c, index).collect()}
    assert got == {(0, 0), (2, 2), (1, 2), (3, 3), (2, 3), (0, 1), (1, 1), (3, 4), (4, 4)}
    many = spark.range(1000).withColumnRenamed("id", "pos")
    sums = running_sum(many, "pos", F.col("pos") % 3, "s", width=64).orderBy("pos").collect()
    assert [r["s"] for r in sums] == np.cumsum(np.arange(1000) % 3).tolist()


def test_points(spark, cloud):
    p = frame(spark, cloud[:5])
    assert points.check_locations(p) == 2
    with pytest.raises(ValueError):
        points.check_locations(p.drop("coords"))
    with pytest.raises(ValueError):
        points.check_locations(p.unionByName(p))
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "loc_id long, coords array<double>")
    with pytest.raises(ValueError):
        points.check_locations(ragged)
    with pytest.raises(ValueError):
        points.check_predictions(points.union(p, p.withColumn("loc_id", F.col("loc_id") + 10)))
    g = points.grid(spark, 3)
    assert g.count() == 9 and g.agg(F.max(F.col("coords")[1])).first()[0] == 1.0


def test_tree_parameters():
    assert mra.parameters(100, 20, r=[0, 20]) == mra.Tree(1, (0, 20), (8,))
    assert mra.parameters(200, 20, r=[20, 1]) == mra.Tree(1, (20, 1), (256,))
    one = mra.parameters(200, 20, M=1)
    assert one.r == (10, 10) and one.M == 1
    t = mra.choose(200, 20)
    assert sum(t.r) <= 20 and np.dot(t.r, np.cumprod([1, *t.J])) >= 200
    assert mra.choose(100, 1).J == (128,)
    small = mra.choose(1000, 3)
    assert small.r == (1, 1, 1)
    assert mra.choose(200, 20) == mra.Tree(6, (2, 3, 3, 3, 3, 3, 3), (2,) * 6) and mra.choose(1000, 3).J == (2, 512)
    with pytest.warns(UserWarning):
        assert mra.parameters(100, 5, r=[4, 3], J=3, M=1) == mra.Tree(1, (4, 3), (4,))


def test_tree(spark, cloud):
    o = frame(spark, cloud).withColumnRenamed("loc_id", "pos")
    tree = mra.Tree(2, (5, 4, 3), (2, 4))
    found = mra.knots(cloud, tree)
    assert sorted(np.concatenate(list(found.values())).tolist()) == list(range(300))
    assert found["r"].tolist() == [0, 1, 2, 3, 4]
    table = mra.knot_table(o, tree)
    rows = {}
    for r in table.orderBy("node_id", "place").collect():
        rows.setdefault(r["node_id"], []).append(r["pos"])
    assert {k: v.tolist() for k, v in found.items()} == rows
    got = sets_of(mra.ancestor_neighbors(table))
    for node, own in rows.items():
        above = []
        up = node
        while "_" in up:
            up = up.rsplit("_", 1)[0]
            above += rows.get(up, [])[::-1]
        for i, pos in enumerate(own):
            assert got[pos] == [pos, *own[:i][::-1], *above]
    ids = spark.createDataFrame([("r",), ("r_0",), ("r_0_13",)], "n string").select(mra.parent(F.col("n")), mra.depth(F.col("n"))).collect()
    assert [tuple(r) for r in ids] == [(None, 0), ("r", 1), ("r_0", 2)]


def test_regions_are_halved_by_rank():
    x = np.array([0.0, 0.0, 0.0, 0.0, 1.0, 2.0])
    assert mra.upper_half(x, np.zeros(6, int)).tolist() == [False, False, True, False, True, True]
    assert mra.upper_half(-x, np.zeros(6, int)).tolist() == [True, True, True, False, False, False]
    r = np.random.default_rng(0)
    region, x = r.integers(0, 9, 500), r.integers(0, 6, 500).astype(float)
    up = mra.upper_half(x, region)
    for k in range(9):
        mine, top = x[region == k], up[region == k]
        assert top.sum() == len(mine) // 2 and mine[top].min() >= mine[~top].max()
        alone = mra.upper_half(mine, np.zeros(len(mine), int))
        assert (alone == top).all()
    parts = mra.split_regions(r.random((64, 2)), np.zeros(64, int), 8, 1)
    assert np.bincount(parts).tolist() == [8] * 8
