"""Queries over the test tables, one for each operator, and SQL for those that SQL can express.

Points: events on the time axis (p1), parts by size and price (p2), embeddings (pn); predicted points: a grid over the parts'
box. Doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families, kernels
from .operators import latent, mra, neighbors, ordering, pattern
from .plans import estimate as fitting
from .plans import evaluate, laplace
from .plans.specify import Plan, specify
from .sources import points
from .sources.storage import materialise, shared_dir
from .streaming.scoring import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

THETA = (1.0, 2.0, 0.5)  # of events: hours
THETA2 = (1.0, 0.3, 0.5)
NUGGET = 0.1
GRID = 20

P1 = "p1 AS (SELECT event_id AS loc_id, epoch_us(ts) / 3.6e9::DOUBLE AS x, ln(value) - avg(ln(value)) OVER () AS z FROM events), o1 AS (SELECT *, row_number() OVER (ORDER BY x, loc_id) - 1 AS pos FROM p1)"
P2 = """p2 AS (SELECT f.loc_id, f.x, f.y, q.q - avg(q.q) OVER () AS z
  FROM (SELECT CAST(p_size AS DOUBLE) / 50::DOUBLE AS x, (p_retailprice - 900) / 100::DOUBLE AS y, min(p_partkey) AS loc_id FROM part GROUP BY 1, 2) f
  JOIN (SELECT l_partkey, avg(l_quantity) AS q FROM lineitem GROUP BY 1) q ON q.l_partkey = f.loc_id),
o2 AS (SELECT *, row_number() OVER (ORDER BY x + y, loc_id) - 1 AS pos FROM p2)"""
GRID_SQL = f"g AS (SELECT a.i + {GRID} * b.i + 1000000000 AS loc_id, (a.i + 0.5::DOUBLE) / {GRID}::DOUBLE AS x, 12 * (b.i + 0.5::DOUBLE) / {GRID}::DOUBLE AS y FROM range({GRID}) a(i), range({GRID}) b(i))"


def _maxmin_sql(rows: str) -> str:
    """mm (pos, loc_id): the max-min ordering of rows (loc_id, x, y, p), those with p = 0 first; for WITH RECURSIVE."""
    return f"""u AS ({rows}), center AS (SELECT avg(x) FILTER (WHERE p = 0) AS cx, avg(y) FILTER (WHERE p = 0) AS cy, count(*) AS n FROM u),
first AS (SELECT loc_id AS pl, x AS px, y AS py FROM u, center WHERE p = 0 ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), loc_id LIMIT 1),
step AS (SELECT 0 AS k, loc_id, x, y, p, 1e300::DOUBLE AS far, pl, px, py FROM u, first
  UNION ALL SELECT k + 1, loc_id, x, y, p, f, first_value(loc_id) OVER w, first_value(x) OVER w, first_value(y) OVER w
  FROM (SELECT *, CASE WHEN loc_id = pl OR far < 0 THEN -1 ELSE least(far, (x - px) * (x - px) + (y - py) * (y - py)) END AS f FROM step) q, center WHERE k + 1 < n
  WINDOW w AS (ORDER BY f < 0, p, f DESC, loc_id)),
mm AS (SELECT DISTINCT k AS pos, pl AS loc_id FROM step)"""


_MM = f"WITH RECURSIVE {P2}, {_maxmin_sql('SELECT loc_id, x, y, 0 AS p FROM p2')}"
_MM_BOTH = f"WITH RECURSIVE {P2}, {GRID_SQL}, {_maxmin_sql('SELECT loc_id, x, y, 0 AS p FROM p2 UNION ALL SELECT loc_id, x, y, 1 FROM g')}"

D2 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def grid_points(spark: SparkSession) -> DataFrame:
    cell = spark.range(GRID * GRID)
    x = (F.col("id") % GRID + 0.5) / float(GRID)
    y = 12 * (F.floor(F.col("id") / GRID) + 0.5) / float(GRID)
    return cell.select((F.col("id") + 1_000_000_000).alias("loc_id"), F.array(x, y).alias("coords"))


def _ordered1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.by_coordinate(points.pts1d(spark, sf_dir))


def _ordered2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.by_coordinate(points.pts2d(spark, sf_dir))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.union(points.pts2d(spark, sf_dir), grid_points(spark))


def _plan1(spark: SparkSession, sf_dir: str, m: int, cond_yz: str) -> tuple[Plan, DataFrame]:
    p = points.pts1d(spark, sf_dir)
    return specify(p, m, cond_yz=cond_yz, order="coord"), p


def _plan2(spark: SparkSession, sf_dir: str, m: int, predictions: bool = False, **options) -> tuple[Plan, DataFrame]:
    p = points.pts2d(spark, sf_dir)
    return specify(p, m, grid_points(spark) if predictions else None, **options), p


# Orderings


@query(f"WITH {P2} SELECT loc_id, pos FROM o2")
def order_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered2(spark, sf_dir).select("loc_id", "pos")


@query(f"WITH {P2} SELECT loc_id, row_number() OVER (ORDER BY sqrt((x - 0.3::DOUBLE) * (x - 0.3::DOUBLE) + (y - 4.7::DOUBLE) * (y - 4.7::DOUBLE)), loc_id) - 1 AS pos FROM p2")
def order_dist_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.by_distance(points.pts2d(spark, sf_dir), [0.3, 4.7]).select("loc_id", "pos")


_CENTER = f"WITH {P2}, c AS (SELECT avg(x) AS cx, avg(y) AS cy FROM p2), d AS (SELECT loc_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d FROM p2, c)"


@query(f"{_CENTER} SELECT loc_id, row_number() OVER (ORDER BY d, loc_id) - 1 AS pos FROM d")
def order_middleout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.middle_out(points.pts2d(spark, sf_dir)).select("loc_id", "pos")


@query(f"{_CENTER} SELECT loc_id, row_number() OVER (ORDER BY d DESC, loc_id DESC) - 1 AS pos FROM d")
def order_outsidein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.outside_in(points.pts2d(spark, sf_dir)).select("loc_id", "pos")


@query(
    f"""WITH {P2}, s AS (SELECT loc_id, radians(x * 300) AS l, radians(y * 7 + 90) AS p FROM p2),
    t AS (SELECT loc_id, sin(p) * cos(l) AS a, sin(p) * sin(l) AS b, cos(p) AS c FROM s),
    r AS (SELECT sin(radians(137.3::DOUBLE)) * cos(radians(11.7::DOUBLE)) AS ra, sin(radians(137.3::DOUBLE)) * sin(radians(11.7::DOUBLE)) AS rb, cos(radians(137.3::DOUBLE)) AS rc)
    SELECT loc_id, row_number() OVER (ORDER BY sqrt((a - ra) * (a - ra) + (b - rb) * (b - rb) + (c - rc) * (c - rc)), loc_id) - 1 AS pos FROM t, r"""
)
def order_lonlat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir).withColumn("coords", F.array(F.col("coords")[0] * 300, F.col("coords")[1] * 7))
    return ordering.by_distance(p, [11.7, 47.3], lonlat=True).select("loc_id", "pos")


@query(f"WITH {P1} SELECT loc_id, row_number() OVER (ORDER BY loc_id) - 1 AS pos FROM p1")
def order_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.as_given(points.pts1d(spark, sf_dir)).select("loc_id", "pos")


@query(f"{_MM} SELECT loc_id, pos FROM mm")
def order_maxmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.maxmin(points.pts2d(spark, sf_dir)).select("loc_id", "pos")


@query(f"{_MM_BOTH} SELECT loc_id, pos FROM mm")
def order_obs_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.maxmin_obs_pred(_both(spark, sf_dir)).select("loc_id", "pos")


@query(
    f"""WITH {P2}, g AS ({GRID_SQL.removeprefix("g AS (").removesuffix(")")}),
    u AS (SELECT loc_id, x, y, 0 AS p FROM p2 UNION ALL SELECT loc_id, x, y, 1 FROM g)
    SELECT loc_id, row_number() OVER (ORDER BY p, x + y, loc_id) - 1 AS pos FROM u"""
)
def order_observed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.observed_first(_both(spark, sf_dir), F.col("coords")[0] + F.col("coords")[1]).select("loc_id", "pos")


@query(f"WITH {P2}, n AS (SELECT count(*) AS n FROM p2) SELECT loc_id, CASE WHEN pos = 0 THEN 0 WHEN pos < 9 THEN pos + n - 9 ELSE pos - 8 END AS pos FROM o2, n")
def maxmin_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.rotated(_ordered2(spark, sf_dir)).select("loc_id", "pos")


# Neighbours


@query(
    f"""WITH {P2}, n AS (SELECT a.pos, b.pos AS nbr_pos, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS slot FROM o2 a JOIN o2 b ON b.pos < a.pos)
    SELECT pos, CAST(slot AS INTEGER) AS slot, nbr_pos FROM n WHERE slot <= 5 UNION ALL SELECT pos, 0, pos FROM o2"""
)
def nn_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.ordered_neighbors(materialise(_ordered2(spark, sf_dir)), 5)


@query(
    f"""WITH {P1}, s AS (SELECT unnest(range(4)) AS slot)
    SELECT o.pos, CAST(s.slot AS INTEGER) AS slot, o.pos - s.slot AS nbr_pos FROM o1 o JOIN s ON s.slot <= o.pos"""
)
def nn_ordered_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.line_neighbors(_ordered1(spark, sf_dir), 3)


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    n AS (SELECT a.vec_id AS query, b.vec_id AS nbr, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, nbr) AS slot FROM n)
    SELECT query, CAST(slot AS INTEGER) AS slot, nbr, round(d, 6) AS dist FROM r WHERE slot <= 5"""
)
def nn_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.plain_neighbors(points.ptsnd(spark, sf_dir), 5).withColumn("dist", six("dist"))


@query(
    f"""WITH {P2}, {GRID_SQL}, n AS (SELECT a.loc_id AS query, b.loc_id AS nbr, {D2} AS d FROM g a, p2 b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, nbr) AS slot FROM n)
    SELECT query, CAST(slot AS INTEGER) AS slot, nbr, round(d, 6) AS dist FROM r WHERE slot <= 4"""
)
def nn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = grid_points(spark).withColumnRenamed("loc_id", "query")
    return neighbors.query_neighbors(q, points.pts2d(spark, sf_dir), 4).withColumn("dist", six("dist"))


_OBS_FIRST = f"""WITH {P2}, {GRID_SQL}, u AS (SELECT loc_id, x, y, 0 AS p FROM p2 UNION ALL SELECT loc_id, x, y, 1 FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY p, x + y, loc_id) - 1 AS pos FROM u)"""


def _obs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(ordering.observed_first(_both(spark, sf_dir), F.col("coords")[0] + F.col("coords")[1]))


@query(
    f"""{_OBS_FIRST}, n AS (SELECT a.pos, b.pos AS nbr_pos, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k FROM o a JOIN o b ON a.p = 1 AND b.p = 0)
    SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY nbr_pos DESC) AS INTEGER) AS slot, nbr_pos FROM n WHERE k <= 6
    UNION ALL SELECT pos, 0, pos FROM o"""
)
def nn_independent_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obs_first(spark, sf_dir)
    return neighbors.independent_predictions(o, neighbors.no_neighbors(o), 6)


@query(
    f"""WITH {P2}, s AS (SELECT unnest(range(1, 5)) AS slot)
    SELECT o.pos, CAST(s.slot AS INTEGER) AS slot, least(o.pos, 4) - s.slot AS nbr_pos FROM o2 o JOIN s ON s.slot <= least(o.pos, 4)
    UNION ALL SELECT pos, 0, pos FROM o2"""
)
def nn_firstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.first_neighbors(_ordered2(spark, sf_dir), 4)


@query("SELECT CAST(p_size AS DOUBLE) / 50::DOUBLE AS x, (p_retailprice - 900) / 100::DOUBLE AS y, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def dup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.array(F.col("p_size") / 50.0, (F.col("p_retailprice") - 900) / 100).alias("coords"))
    return points.duplicates(part).select(F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), "n")


@query(f"WITH {P2} SELECT round(sum(-0.5 * (z * z / {1 + NUGGET}::DOUBLE + ln({1 + NUGGET}::DOUBLE) + ln(2 * pi()))), 6) AS loglik FROM p2")
def m0_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 0)
    return evaluate.loglik(plan, p, THETA2, NUGGET).select(six("loglik").alias("loglik"))


# Trees


# Binary trees: the parameters for m = 20 are those of choose() while a path has fewer than 20 levels.
_TREE = f"""WITH RECURSIVE {P2}, size AS (SELECT count(*) AS n FROM p2),
shape AS (SELECT (SELECT min(k) FROM range(1, 19) t(k) WHERE 20 * (1::BIGINT << k) > n * k) AS depth FROM size),
live AS (SELECT 0 AS d, 'r' AS node, pos, x, y FROM o2
  UNION ALL SELECT d + 1, node || CASE WHEN size = 1 OR c > cut OR (c = cut AND rank - above >= greatest(2 * above + level - size, 0) AND rank - above - greatest(2 * above + level - size, 0) < size // 2 - above) THEN '_0' ELSE '_1' END, pos, x, y
  FROM (SELECT *, count(*) FILTER (WHERE c > cut) OVER (PARTITION BY node) AS above, count(*) FILTER (WHERE c = cut) OVER (PARTITION BY node) AS level
    FROM (SELECT *, max(CASE WHEN rank = size // 2 THEN c END) OVER (PARTITION BY node) AS cut
      FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, pos) - 1 AS rank, count(*) OVER (PARTITION BY node) AS size
        FROM (SELECT live.*, CASE WHEN d % 2 = 0 THEN y ELSE x END AS c, depth, row_number() OVER (PARTITION BY node ORDER BY pos) - 1 AS place FROM live, shape) a
        WHERE d < depth AND place >= greatest(1, (20 + d) // (depth + 1))) b) e) f),
tree AS (SELECT * FROM (SELECT node AS node_id, CAST(d AS INTEGER) AS depth, shape.depth AS lowest, CAST(row_number() OVER (PARTITION BY node ORDER BY pos) - 1 AS INTEGER) AS place, pos FROM live, shape) a
  WHERE a.depth = lowest OR place < greatest(1, (20 + a.depth) // (lowest + 1)))"""


@query(f"{_TREE} SELECT node_id, depth, place, pos, CASE WHEN depth > 0 THEN regexp_replace(node_id, '_[^_]*$', '') END AS parent_id FROM tree")
def mra_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = materialise(_ordered2(spark, sf_dir))
    return mra.knot_table(o, mra.parameters(o.count(), 20)).withColumn("parent_id", mra.parent(F.col("node_id")))


@query(
    f"""{_TREE} SELECT a.pos, CAST(row_number() OVER (PARTITION BY a.pos ORDER BY b.depth DESC, b.place DESC) - 1 AS INTEGER) AS slot, b.pos AS nbr_pos
    FROM tree a JOIN tree b ON (b.node_id = a.node_id AND b.place <= a.place) OR starts_with(a.node_id, b.node_id || '_')"""
)
def mra_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = materialise(_ordered2(spark, sf_dir))
    return mra.ancestor_neighbors(materialise(mra.knot_table(o, mra.parameters(o.count(), 20))))


@query()
def mra_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 20, conditioning="mra")
    return evaluate.loglik(plan, p, THETA2, NUGGET).select(six("loglik").alias("loglik"))


# Conditioning rules

_LAGS = f"WITH {P1}, s AS (SELECT unnest(range(3)) AS slot), c AS (SELECT o.pos, CAST(s.slot AS INTEGER) AS slot, o.pos - s.slot AS nbr_pos FROM o1 o JOIN s ON s.slot <= o.pos)"


@query(f"{_LAGS} SELECT pos, slot, nbr_pos, true AS on_latent FROM c")
def cond_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan1(spark, sf_dir, 2, "y")[0].flags


@query(f"{_LAGS} SELECT pos, slot, nbr_pos, slot = 0 AS on_latent FROM c")
def cond_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan1(spark, sf_dir, 2, "z")[0].flags


def _response_first_sql(through: str, pred: str) -> str:
    return f"""{_OBS_FIRST},
    n AS (SELECT a.pos, b.pos AS nbr_pos, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k FROM o a JOIN o b ON a.p = 0 AND b.p = 0 AND a.pos <> b.pos),
    f AS (SELECT a.pos, b.pos AS nbr_pos, b.p, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k FROM o a JOIN o b ON a.p = 1 AND b.pos < a.pos)
    SELECT pos, 0 AS slot, pos AS nbr_pos, true AS on_latent FROM o
    UNION ALL SELECT pos, 1, pos, false FROM o WHERE p = 0
    UNION ALL SELECT pos, CAST(k + 1 AS INTEGER), nbr_pos, {through} FROM n WHERE k <= 3
    UNION ALL SELECT pos, CAST(k AS INTEGER), nbr_pos, {pred} FROM f WHERE k <= 4"""


def _response_first(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return specify(points.pts2d(spark, sf_dir), 4, grid_points(spark), order="coord", cond_yz=rule, order_pred="obspred").flags


@query(_response_first_sql("nbr_pos < pos", "true"))
def cond_zy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response_first(spark, sf_dir, "zy")


@query(_response_first_sql("nbr_pos < pos", "p = 1"))
def cond_rvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response_first(spark, sf_dir, "RVP")


@query(_response_first_sql("false", "p = 1"))
def cond_lk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _response_first(spark, sf_dir, "LK")


def _sgv_sql(order: str, m: int) -> str:
    """sgv (pos, slot, nbr_pos, on_latent) of points o (pos, x, y, p), for those with p = 0; the others are all latent."""
    return f"""{order},
    near AS (SELECT a.pos, b.pos AS nbr_pos, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS slot FROM o a JOIN o b ON b.pos < a.pos),
    sets AS (SELECT o.pos, any_value(o.p) AS p, list_prepend(o.pos, coalesce(list(nbr_pos ORDER BY slot) FILTER (WHERE slot <= {m}), [])) AS s FROM o LEFT JOIN near USING (pos) GROUP BY o.pos),
    walk AS (SELECT 0 AS k, [[0::BIGINT]] AS latent
      UNION ALL SELECT k + 1, list_append(latent, list_distinct(list_append(CASE WHEN list_max(common) > 0 THEN list_intersect(s, latent[s[1 + list_position(common, list_max(common))] + 1]) ELSE [] END, k + 1)))
      FROM (SELECT k, latent, s, list_transform(s[2:], lambda j: len(list_intersect(s, latent[j + 1]))) AS common FROM walk JOIN sets ON sets.pos = walk.k + 1 AND sets.p = 0) w),
    parts AS (SELECT unnest(range(len(latent))) AS pos, unnest(latent) AS own FROM (SELECT latent FROM walk ORDER BY k DESC LIMIT 1) l),
    each AS (SELECT pos, s, unnest(range(len(s))) AS slot, unnest(s) AS nbr_pos FROM sets)
    SELECT e.pos, CAST(e.slot AS INTEGER) AS slot, e.nbr_pos, coalesce(list_contains(own, e.nbr_pos), true) AS on_latent FROM each e LEFT JOIN parts USING (pos)"""


_ROTATED = f"{_MM}, o AS (SELECT CASE WHEN pos = 0 THEN 0 WHEN pos < least(n, 9) THEN pos + n - least(n, 9) ELSE pos - least(n, 9) + 1 END AS pos, x, y, 0 AS p FROM mm JOIN p2 USING (loc_id), center)"


@query(_sgv_sql(_ROTATED, 8))
def cond_sgv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan2(spark, sf_dir, 8, cond_yz="SGV")[0].flags


@query(_sgv_sql(f"{_MM_BOTH}, o AS (SELECT pos, x, y, p FROM mm JOIN u USING (loc_id))", 8))
def cond_sgvt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan2(spark, sf_dir, 8, predictions=True, cond_yz="SGVT")[0].flags


# Pattern

_INDEX = f"""WITH {P2}, {GRID_SQL}, u AS (SELECT loc_id, x, y, true AS is_obs FROM p2 UNION ALL SELECT loc_id, x, y, false FROM g),
o AS (SELECT *, row_number() OVER (ORDER BY x + y, loc_id) - 1 AS pos FROM u),
i AS (SELECT pos, is_obs, CAST(sum(1 + CAST(is_obs AS INTEGER)) OVER (ORDER BY pos) AS BIGINT) AS e FROM o),
ix AS (SELECT pos, e - 1 - CAST(is_obs AS INTEGER) AS latent_ix, CASE WHEN is_obs THEN e - 1 END AS obs_ix FROM i)"""


@query(f"{_INDEX} SELECT pos, latent_ix, obs_ix FROM ix")
def u_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.u_index(ordering.by_coordinate(_both(spark, sf_dir)))


@query(
    f"""{_INDEX}, n AS (SELECT pos, CAST(s AS INTEGER) AS slot, pos - s AS nbr_pos FROM o, range(3) r(s) WHERE s <= pos)
    SELECT CASE WHEN n.slot = 0 OR b.obs_ix IS NULL THEN b.latent_ix ELSE b.obs_ix END AS row, a.latent_ix AS col, n.pos, n.slot FROM n JOIN ix a ON a.pos = n.pos JOIN ix b ON b.pos = n.nbr_pos
    UNION ALL SELECT unnest([latent_ix, obs_ix]), obs_ix, pos, NULL FROM ix WHERE obs_ix IS NOT NULL"""
)
def u_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = materialise(ordering.by_coordinate(_both(spark, sf_dir)))
    sets = o.select("pos", F.explode(F.expr("sequence(0, least(cast(pos as int), 2))")).alias("slot")).withColumn("nbr_pos", F.col("pos") - F.col("slot"))
    return pattern.u_pattern(latent.all_response(sets, o), pattern.u_index(o))


# Kernels

_PAIRS = f"{_LAGS}, d AS (SELECT c.pos, c.slot, c.nbr_pos, sqrt((a.x - b.x) * (a.x - b.x)) AS d FROM c JOIN o1 a ON a.pos = c.pos JOIN o1 b ON b.pos = c.nbr_pos)"


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(d, 6) AS dist FROM d")
def dist_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 2, "y")
    a = plan.ordered.select("pos", F.col("coords").alias("a"))
    b = plan.ordered.select(F.col("pos").alias("nbr_pos"), F.col("coords").alias("b"))
    return plan.flags.join(a, "pos").join(b, "nbr_pos").select("pos", "slot", "nbr_pos", six(kernels.distance(F.col("a"), F.col("b"))).alias("dist"))


def _kernel(spark: SparkSession, sf_dir: str, model, parameters) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 2, "y")
    return evaluate.covariance_at_pattern(plan, model, parameters).withColumn("cov", six("cov"))


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(1.3::DOUBLE * exp(-d / 2::DOUBLE), 6) AS cov FROM d")
def matern_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, "matern", (1.3, 2.0, 0.5))


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(1.3::DOUBLE * (1 + sqrt(3::DOUBLE) * d / 2) * exp(-sqrt(3::DOUBLE) * d / 2), 6) AS cov FROM d")
def matern_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, "matern", (1.3, 2.0, 1.5))


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(1.3::DOUBLE * (1 + sqrt(5::DOUBLE) * d / 2 + 5 * d * d / 12) * exp(-sqrt(5::DOUBLE) * d / 2), 6) AS cov FROM d")
def matern_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, "matern", (1.3, 2.0, 2.5))


@query()
def matern_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, "matern", (1.3, 2.0, 0.8))


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(1.3::DOUBLE * (1 + d / 2 + (d / 2) * (d / 2) * 2 / 5 + (d / 2) * (d / 2) * (d / 2) / 15) * exp(-d / 2::DOUBLE), 6) AS cov FROM d")
def matern_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general smoothness, where it has a closed form."""
    return _kernel(spark, sf_dir, "matern", (1.3, 2.0, 3.5))


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(exp(-d / 2::DOUBLE) + 0.5::DOUBLE * exp(-(d / 3::DOUBLE) * (d / 3::DOUBLE)), 6) AS cov FROM d")
def esqe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, "esqe", (1.0, 2.0, 0.5, 3.0))


def _triangle(a, b):
    import numpy as np

    return np.maximum(0.0, 1 - np.abs(a - b).sum(-1) / 5)


@query(f"{_PAIRS} SELECT pos, slot, nbr_pos, round(greatest(0, 1 - d / 5), 6) AS cov FROM d")
def cov_function_at_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kernel(spark, sf_dir, _triangle, ())


_NN_E = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
n AS (SELECT a.pos, b.pos AS nbr_pos, a.v AS av, b.v AS bv, row_number() OVER (PARTITION BY a.pos ORDER BY list_distance(a.v, b.v), b.pos) AS slot FROM e a JOIN e b ON b.pos < a.pos),
c AS (SELECT pos, CAST(slot AS INTEGER) AS slot, nbr_pos, av, bv FROM n WHERE slot <= 4 UNION ALL SELECT pos, 0, pos, v, v FROM e)"""


def _plan_n(spark: SparkSession, sf_dir: str) -> tuple[Plan, DataFrame]:
    p = points.ptsnd(spark, sf_dir)
    return specify(p, 4, order="none", cond_yz="y"), p


@query(f"{_NN_E} SELECT pos, slot, nbr_pos, round(exp(-list_distance(av, bv)), 6) AS cov FROM c")
def cov_matrix_at_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan_n(spark, sf_dir)
    near = plan.flags.join(plan.ordered.select("pos", F.col("loc_id").alias("row_id"), F.col("coords").alias("a")), "pos")
    near = near.join(plan.ordered.select(F.col("pos").alias("nbr_pos"), F.col("loc_id").alias("col_id"), F.col("coords").alias("b")), "nbr_pos")
    table = near.select("row_id", "col_id", F.exp(-kernels.distance(F.col("a"), F.col("b"))).alias("value"))
    return evaluate.covariance_at_pattern(plan, table).withColumn("cov", six("cov"))


@query(f"{_NN_E} SELECT pos, slot, nbr_pos, round(list_inner_product(av, bv), 6) AS cov FROM c")
def cov_factor_at_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan_n(spark, sf_dir)
    factor = p.select(F.col("loc_id").alias("row_id"), F.posexplode("coords").alias("k", "value"))
    return evaluate.covariance_at_pattern(plan, factor, factor=True).withColumn("cov", six("cov"))


# U and likelihood

_V, _T = f"{THETA[0]}::DOUBLE", f"{NUGGET}::DOUBLE"
_M1 = f"""WITH {P1}, l AS (SELECT pos, z, lag(z) OVER (ORDER BY pos) AS z1, {_V} * exp(-(x - lag(x) OVER (ORDER BY pos)) / {THETA[1]}::DOUBLE) AS c FROM o1),
s AS (SELECT *, coalesce(c / ({_V} + {_T}), 0) AS b, {_V} - coalesce(c * c / ({_V} + {_T}), 0) AS s2 FROM l)"""


@query(f"{_M1} SELECT pos, 0 AS slot, pos AS nbr_pos, true AS on_latent, round(1 / sqrt(s2), 6) AS value FROM s UNION ALL SELECT pos, 1, pos - 1, false, round(-b / sqrt(s2), 6) FROM s WHERE pos > 0")
def u_entries_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 1, "z")
    return evaluate.u_entries(plan, THETA, NUGGET).withColumn("value", six("value"))


@query(
    f"""{_M1} SELECT 2 * pos AS row, 2 * pos AS col, round(1 / sqrt(s2), 6) AS value FROM s UNION ALL SELECT 2 * pos - 1, 2 * pos, round(-b / sqrt(s2), 6) FROM s WHERE pos > 0
    UNION ALL SELECT 2 * pos, 2 * pos + 1, round(-1 / sqrt({_T}), 6) FROM s UNION ALL SELECT 2 * pos + 1, 2 * pos + 1, round(1 / sqrt({_T}), 6) FROM s"""
)
def u_matrix_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 1, "z")
    return evaluate.u_table(plan, THETA, NUGGET).withColumn("value", six("value"))


def _chain_table(plan: Plan) -> DataFrame:
    """Covariances of events by id, of each with itself and with the one before."""
    a = plan.ordered.select("pos", F.col("loc_id").alias("row_id"), F.col("coords")[0].alias("x"))
    b = plan.ordered.select((F.col("pos") + 1).alias("pos"), F.col("loc_id").alias("col_id"), F.col("coords")[0].alias("x0"))
    pairs = a.join(b, "pos").select("row_id", "col_id", (F.lit(THETA[0]) * F.exp(-(F.col("x") - F.col("x0")) / THETA[1])).alias("value"))
    return pairs.unionByName(a.select("row_id", F.col("row_id").alias("col_id"), F.lit(THETA[0]).alias("value")))


@query(ORACLE_SQL["u_entries_m1"])
def u_entries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 1, "z")
    return evaluate.u_entries(plan, (), NUGGET, _chain_table(plan)).withColumn("value", six("value"))


@query(f"{_M1} SELECT round(sum(-0.5 * ((z - coalesce(b * z1, 0)) * (z - coalesce(b * z1, 0)) / (s2 + {_T}) + ln(s2 + {_T}) + ln(2 * pi()))), 4) AS loglik FROM s")
def loglik_m1_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 1, "z")
    return evaluate.loglik(plan, p, THETA, NUGGET).select(F.round("loglik", 4).alias("loglik"))


@query(
    f"""WITH {P1}, l AS (SELECT pos, z, x, lag(z) OVER w AS z1, lag(z, 2) OVER w AS z2, x - lag(x) OVER w AS d1, x - lag(x, 2) OVER w AS d2, lag(x) OVER w - lag(x, 2) OVER w AS d12 FROM o1 WINDOW w AS (ORDER BY pos)),
    k AS (SELECT *, {_V} + {_T} AS a, exp(-d1 / 2::DOUBLE) AS c1, exp(-d2 / 2::DOUBLE) AS c2, exp(-d12 / 2::DOUBLE) AS c12 FROM l),
    s AS (SELECT z, CASE WHEN pos = 0 THEN 0 WHEN pos = 1 THEN c1 / a * z1 ELSE ((a * c1 - c12 * c2) * z1 + (a * c2 - c12 * c1) * z2) / (a * a - c12 * c12) END AS mu,
      a - CASE WHEN pos = 0 THEN 0 WHEN pos = 1 THEN c1 * c1 / a ELSE (a * c1 * c1 - 2 * c12 * c1 * c2 + a * c2 * c2) / (a * a - c12 * c12) END AS v FROM k)
    SELECT round(sum(-0.5 * ((z - mu) * (z - mu) / v + ln(v) + ln(2 * pi()))), 4) AS loglik FROM s"""
)
def loglik_m2_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 2, "z")
    return evaluate.loglik(plan, p, THETA, NUGGET).select(F.round("loglik", 4).alias("loglik"))


@query()
def loglik_sgv(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 10, cond_yz="SGV")
    return evaluate.loglik(plan, p, THETA2, NUGGET).select(six("loglik").alias("loglik"))


@query()
def loglik_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 20, cond_yz="z")
    return evaluate.loglik(plan, p, THETA2, NUGGET).select(six("loglik").alias("loglik"))


def _kalman_sql(noise: float) -> str:
    """On a line the exponential kernel makes a Markov chain, and conditioning on the latent value before is exact."""
    ahead = "(e.a * e.a * s.p + 1 - e.a * e.a)"
    return f"""WITH {P1}, l AS (SELECT pos, z, coalesce(exp(-(x - lag(x) OVER (ORDER BY pos)) / {THETA[1]}::DOUBLE), 0) AS a FROM o1),
    f AS (SELECT list_reduce(list_prepend({{'a': 0::DOUBLE, 'z': 0::DOUBLE, 'm': 0::DOUBLE, 'p': 1::DOUBLE, 'll': 0::DOUBLE}}, list({{'a': a, 'z': z, 'm': 0::DOUBLE, 'p': 1::DOUBLE, 'll': 0::DOUBLE}} ORDER BY pos)),
      lambda s, e: {{'a': e.a, 'z': e.z, 'm': e.a * s.m + {ahead} / ({ahead} + {noise}::DOUBLE) * (e.z - e.a * s.m), 'p': {ahead} * {noise}::DOUBLE / ({ahead} + {noise}::DOUBLE),
        'll': s.ll - 0.5 * ((e.z - e.a * s.m) * (e.z - e.a * s.m) / ({ahead} + {noise}::DOUBLE) + ln({ahead} + {noise}::DOUBLE) + ln(2 * pi()))}}) AS r FROM l)
    SELECT round(r.ll, 4) AS loglik FROM f"""


@query(_kalman_sql(NUGGET))
def loglik_sgv_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 1, "SGV")
    return evaluate.loglik(plan, p, THETA, NUGGET).select(F.round("loglik", 4).alias("loglik"))


@query(_kalman_sql(NUGGET))
def table_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 1, "y")
    return evaluate.loglik(plan, p, (), NUGGET, _chain_table(plan)).select(F.round("loglik", 4).alias("loglik"))


@query(_kalman_sql(NUGGET))
def loglik_y_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 1, "y")
    return evaluate.loglik(plan, p, THETA, NUGGET).select(F.round("loglik", 4).alias("loglik"))


@query(
    f"""WITH {P1}, l AS (SELECT pos, {_V} * exp(-(x - lag(x) OVER (ORDER BY pos)) / {THETA[1]}::DOUBLE) AS c FROM o1),
    s AS (SELECT pos, coalesce(c / {_V}, 0) AS b, {_V} - coalesce(c * c / {_V}, 0) AS s2 FROM l),
    u AS (SELECT pos AS col, pos AS row, 1 / sqrt(s2) AS v FROM s UNION ALL SELECT pos, pos - 1, -b / sqrt(s2) FROM s WHERE pos > 0)
    SELECT a.row AS row, b.row AS col, round(sum(a.v * b.v), 4) AS value FROM u a JOIN u b ON a.col = b.col AND a.row <= b.row GROUP BY 1, 2"""
)
def w_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 1, "y")
    # Events at one time determine each other: their precision is infinite.
    return evaluate.precision(evaluate.u_entries(plan, THETA, NUGGET, form="limit")).withColumn("value", F.round("value", 4))


@query(
    """WITH m AS (SELECT event_id AS loc_id, CASE WHEN value < 5 THEN NULL ELSE ln(value) END AS z FROM events), s AS (SELECT avg(z) AS a, var_samp(z) AS v FROM m)
    SELECT loc_id, round(coalesce(z, a), 6) AS z, round(CASE WHEN z IS NULL THEN v * 1e8::DOUBLE ELSE 0.1::DOUBLE END, 2) AS nugget FROM m, s"""
)
def impute_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("loc_id"), F.when(F.col("value") >= 5, F.log("value")).alias("z"))
    return evaluate.impute_missing(e, 0.1).select("loc_id", six("z").alias("z"), F.round("nugget", 2).alias("nugget"))


@query(f"WITH {P2}, r AS (SELECT loc_id, z + 7 AS z FROM p2) SELECT loc_id, round(z - avg(z) OVER (), 6) AS z FROM r")
def detrend_const(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir).withColumn("z", F.col("z") + 7)
    return fitting.detrend(p)[0].select("loc_id", six("z").alias("z"))


@query(f"WITH {P2}, c AS (SELECT regr_slope(z, x) AS s, regr_intercept(z, x) AS i FROM p2) SELECT loc_id, round(z - i - s * x, 6) AS z FROM p2, c")
def detrend_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir).withColumn("x", F.array(F.lit(1.0), F.col("coords")[0]))
    return fitting.detrend(p, "linear")[0].select("loc_id", six("z").alias("z"))


@query()
def ichol(spark: SparkSession, sf_dir: str) -> DataFrame:
    # On the pattern of a tree the factor without fill always exists.
    plan, _ = _plan2(spark, sf_dir, 12, conditioning="mra")
    return evaluate.lower_factor(plan, "matern", THETA2).withColumn("value", six("value"))


def _half(a, b):
    """Less than half of the variance between points, so that the matrix cut to a forest is positive definite."""
    import numpy as np

    d = np.sqrt(((a - b) ** 2).sum(-1))
    return np.where(d == 0, 1.0, 0.4 * np.exp(-d / 0.3))


# Each point and its nearest earlier one: a forest, on which the factor is found from the roots on.
_FOREST = f"""WITH RECURSIVE {P2}, n AS (SELECT a.pos, a.loc_id, b.pos AS up, b.loc_id AS up_id, {D2} AS d, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k FROM o2 a JOIN o2 b ON b.pos < a.pos),
t AS (SELECT pos, loc_id, up, up_id, 0.4::DOUBLE * exp(-d / 0.3::DOUBLE) AS c FROM n WHERE k = 1),
f AS (SELECT pos, loc_id, NULL::BIGINT AS up_id, NULL::DOUBLE AS side, 1::DOUBLE AS own FROM o2 WHERE pos = 0
  UNION ALL SELECT t.pos, t.loc_id, t.up_id, c / f.own, sqrt(1 - c / f.own * (c / f.own)) FROM f JOIN t ON t.up = f.pos)"""


@query(f"{_FOREST} SELECT loc_id AS row_id, loc_id AS col_id, round(own, 6) AS value FROM f UNION ALL SELECT loc_id, up_id, round(side, 6) FROM f WHERE side IS NOT NULL")
def ichol_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan2(spark, sf_dir, 1, order="coord", cond_yz="y")
    return evaluate.lower_factor(plan, _half).withColumn("value", six("value"))


# The latent values' own precision is that of the chain, whose inverse is the covariance.
@query(f"WITH {P1} SELECT pos AS row, pos AS col, 1::DOUBLE AS value FROM o1 UNION ALL SELECT pos - 1, pos, round(exp(-(x - x0) / {THETA[1]}::DOUBLE), 6) FROM (SELECT pos, x, lag(x) OVER (ORDER BY pos) AS x0 FROM o1) WHERE pos > 0")
def selected_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = _plan1(spark, sf_dir, 1, "y")
    return evaluate.latent_inverse(plan, THETA).withColumn("value", six("value"))


# Prediction


# With m = 1 an observed value hangs on its response, and a predicted one on the nearest point before it.
def _nearest_sql(rule: str, noise: float = NUGGET, z: str = "z") -> str:
    through = "true" if rule == "zy" else "b.p = 1"
    return f"""WITH RECURSIVE {P2}, {GRID_SQL}, u AS (SELECT loc_id, x, y, {z} AS z, 0 AS p FROM p2 UNION ALL SELECT loc_id, x, y, NULL, 1 FROM g),
    o AS (SELECT *, row_number() OVER (ORDER BY p, x + y, loc_id) - 1 AS pos FROM u),
    n AS (SELECT a.pos, a.loc_id, b.pos AS up, b.p AS seen, exp(-{D2} / {THETA2[1]}::DOUBLE) AS c, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k, {through} AS latent, b.z AS z FROM o a JOIN o b ON a.p = 1 AND b.pos < a.pos),
    t AS (SELECT * FROM n WHERE k = 1),
    f AS (SELECT pos, loc_id, true AS is_obs, z / {1 + noise}::DOUBLE AS mean, {noise}::DOUBLE / {1 + noise}::DOUBLE AS var FROM o WHERE p = 0
      UNION ALL SELECT t.pos, t.loc_id, false, CASE WHEN latent THEN c * mean ELSE c * t.z / {1 + noise}::DOUBLE END, CASE WHEN latent THEN 1 - c * c + c * c * var ELSE 1 - c * c / {1 + noise}::DOUBLE END FROM f JOIN t ON t.up = f.pos)"""


def _nearest_plan(spark: SparkSession, sf_dir: str, rule: str) -> tuple[Plan, DataFrame]:
    p = points.pts2d(spark, sf_dir)
    return specify(p, 1, grid_points(spark), order="coord", cond_yz=rule, order_pred="obspred"), p


def _predict_nearest(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    plan, p = _nearest_plan(spark, sf_dir, rule)
    return evaluate.predict(plan, p, THETA2, NUGGET).withColumns({"mean": six("mean") + 0.0, "var": six("var")})  # no -0.0


@query(f"{_nearest_sql('zy')} SELECT loc_id, is_obs, round(mean, 6) + 0 AS mean, round(var, 6) AS var FROM f")
def predict_nearest_zy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict_nearest(spark, sf_dir, "zy")


@query(f"{_nearest_sql('RVP')} SELECT loc_id, is_obs, round(mean, 6) + 0 AS mean, round(var, 6) AS var FROM f")
def predict_nearest_rvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict_nearest(spark, sf_dir, "RVP")


@query(f"{_nearest_sql('LK')} SELECT loc_id, is_obs, round(mean, 6) + 0 AS mean, round(var, 6) AS var FROM f")
def predict_nearest_lk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predict_nearest(spark, sf_dir, "LK")


@query(
    f"""WITH {P2}, {GRID_SQL}, n AS (SELECT a.loc_id, b.z, exp(-{D2} / {THETA2[1]}::DOUBLE) AS c, row_number() OVER (PARTITION BY a.loc_id ORDER BY {D2}, b.pos) AS k FROM g a, o2 b)
    SELECT loc_id, true AS is_obs, round(z / {1 + NUGGET}::DOUBLE, 6) + 0 AS mean, round({NUGGET}::DOUBLE / {1 + NUGGET}::DOUBLE, 6) AS var FROM o2
    UNION ALL SELECT loc_id, false, round(c * z / {1 + NUGGET}::DOUBLE, 6) + 0, round(1 - c * c / {1 + NUGGET}::DOUBLE, 6) FROM n WHERE k = 1"""
)
def predict_rows_lk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that hang on their own rows only, in all tasks."""
    p = points.pts2d(spark, sf_dir)
    plan = specify(p, 1, grid_points(spark), order="coord", cond_yz="LK", order_pred="obspred", pred_cond="independent")
    return evaluate.predict(plan, p, THETA2, NUGGET).withColumns({"mean": six("mean") + 0.0, "var": six("var")})


@query(f"{_nearest_sql('zy')} SELECT loc_id AS comb_id, round(0.25::DOUBLE * var, 6) AS var FROM f WHERE NOT is_obs OR loc_id % 40 = 1 UNION ALL SELECT 0, round({NUGGET}::DOUBLE / {1 + NUGGET}::DOUBLE / count(*), 9) FROM f WHERE is_obs")
def lincomb_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _nearest_plan(spark, sf_dir, "zy")
    each = plan.ordered.select(F.col("loc_id").alias("comb_id"), "loc_id", F.lit(0.5).alias("weight")).where("comb_id >= 1000000000 or comb_id % 40 = 1")
    mean = p.select(F.lit(0).cast("long").alias("comb_id"), "loc_id", F.lit(1.0 / plan.n_obs).alias("weight"))
    return evaluate.combinations(plan, p, each.unionByName(mean), THETA2, NUGGET).withColumn("var", F.when(F.col("comb_id") == 0, F.round("var", 9)).otherwise(F.round("var", 6)))


@query()
def predict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 10, predictions=True)
    return evaluate.predict(plan, p, THETA2, NUGGET).withColumns({"mean": six("mean"), "var": six("var")})


@query()
def predict_mean_rvp(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 10, predictions=True, cond_yz="RVP")
    return evaluate.predict(plan, p, THETA2, NUGGET, returns="mean").withColumn("mean", six("mean"))


@query()
def lincomb_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan2(spark, sf_dir, 10, predictions=True)
    weights = grid_points(spark).select(F.floor((F.col("loc_id") - 1_000_000_000) / GRID).alias("comb_id"), "loc_id", F.lit(1.0 / GRID).alias("weight"))
    return evaluate.combinations(plan, p, weights, THETA2, NUGGET).withColumn("var", six("var"))


# Through the response the latent values are independent given the data: the matrix is diagonal.
@query(
    f"""WITH {GRID_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY x + y, loc_id) - 1 AS pos FROM g),
    n AS (SELECT a.pos, {D2} AS d, row_number() OVER (PARTITION BY a.pos ORDER BY {D2}, b.pos) AS k FROM o a JOIN o b ON b.pos < a.pos),
    w AS (SELECT o.loc_id, 1 / (1 - coalesce(exp(-2 * d / {THETA2[1]}::DOUBLE), 0) / {1 + NUGGET}::DOUBLE) + 1 / {NUGGET}::DOUBLE AS w FROM o LEFT JOIN n ON n.pos = o.pos AND n.k = 1)
    SELECT a.loc_id AS row_id, b.loc_id AS col_id, CASE WHEN a.loc_id = b.loc_id THEN round(1 / a.w, 6) ELSE 0 END AS cov FROM w a, w b"""
)
def covmat_nearest_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_points(spark)
    plan = specify(g, 1, order="coord", cond_yz="z")
    return evaluate.covariance_matrix(plan, g.withColumn("z", F.lit(0.0)), THETA2, NUGGET).withColumn("cov", six("cov") + 0.0)


@query()
def covmat(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid_points(spark)
    plan = specify(g, 10, cond_yz="SGV")
    return evaluate.covariance_matrix(plan, g.withColumn("z", F.lit(0.0)), THETA2, NUGGET).withColumn("cov", six("cov"))


# Families

_FAMILY = "SELECT id, round({llh}, 6) AS llh, round({score}, 6) AS score, round({hess}, 6) AS hess, round({link}, 6) AS link FROM r"


def _family(rows: DataFrame, name: str, **parameters: float) -> DataFrame:
    out = families.terms(rows, families.family(name, **parameters))
    return out.select("id", *[six(c).alias(c) for c in ("llh", "score", "hess", "link")])


@query(
    "WITH r AS (SELECT l.doc_id AS id, CAST(quality AS DOUBLE) AS z, ln(n_chars + 1) - 6 AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "
    + _FAMILY.format(llh="z * y - ln(1 + exp(y))", score="z - 1 / (1 + exp(-y))", hess="(1 / (1 + exp(-y))) * (1 - 1 / (1 + exp(-y)))", link="1 / (1 + exp(-y))")
)
def family_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "documents"))
    rows = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("z"), (F.log(F.col("n_chars") + 1.0) - 6).alias("y"))
    return _family(rows, "logistic")


@query(
    "WITH r AS (SELECT CAST(floor(epoch_us(ts) / 3.6e9::DOUBLE) AS BIGINT) AS id, CAST(count(*) AS DOUBLE) AS z, avg(value) / 100 AS y FROM events GROUP BY 1) "
    + _FAMILY.format(llh="z * y - exp(y) - lgamma(z + 1)", score="z - exp(y)", hess="exp(y)", link="exp(y)")
)
def family_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("id")).agg(F.count("*").cast("double").alias("z"), (F.avg("value") / 100).alias("y"))
    return _family(rows, "poisson")


@query(
    f"WITH {P1}, r AS (SELECT loc_id AS id, z, z / 2 AS y FROM p1) "
    + _FAMILY.format(llh="-(z - y) * (z - y) / 0.5::DOUBLE - ln(0.5::DOUBLE) - 0.5 * ln(2 * pi())", score="(z - y) / 0.25::DOUBLE", hess="1 / 0.25::DOUBLE", link="y")
)
def family_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(points.pts1d(spark, sf_dir).select(F.col("loc_id").alias("id"), "z", (F.col("z") / 2).alias("y")), "gauss", sigma=0.5)


_PRICE = "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice / 9973 AS z, l_discount AS y FROM lineitem) "


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") / 9973).alias("z"), F.col("l_discount").alias("y"))


_A = "2.5::DOUBLE"


@query(_PRICE + _FAMILY.format(llh=f"-{_A} * z * exp(-y) + ({_A} - 1) * ln(z) - {_A} * y + {_A} * ln({_A}) - lgamma({_A})", score=f"{_A} * (z * exp(-y) - 1)", hess=f"{_A} * z * exp(-y)", link="exp(y)"))
def family_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(_price(spark, sf_dir), "gamma", alpha=2.5)


@query(_PRICE + _FAMILY.format(llh=f"-z * exp(y) + ({_A} - 1) * ln(z) + {_A} * y - lgamma({_A})", score=f"{_A} - z * exp(y)", hess="z * exp(y)", link=f"{_A} / exp(y)"))
def family_gamma_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _family(_price(spark, sf_dir), "gamma_alt", alpha=2.5)


def _psi(x: str) -> str:
    """The digamma function: ten steps of the recurrence and the asymptotic series."""
    h = f"({x} + 10)"
    return f"(ln({h}) - 0.5 / {h} - 1 / (12 * {h} * {h}) + 1 / (120 * pow({h}, 4)) - 1 / (252 * pow({h}, 6)) + 1 / (240 * pow({h}, 8)) - {' - '.join(f'1 / ({x} + {k})' for k in range(10))})"


def _psi1(x: str) -> str:
    """The trigamma function, in the same way."""
    h = f"({x} + 10)"
    return f"(1 / {h} + 0.5 / ({h} * {h}) + 1 / (6 * pow({h}, 3)) - 1 / (30 * pow({h}, 5)) + 1 / (42 * pow({h}, 7)) - 1 / (30 * pow({h}, 9)) + {' + '.join(f'1 / (({x} + {k}) * ({x} + {k}))' for k in range(10))})"


_B = families.DEFAULTS["beta"]


@query(
    f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity / 51 AS z, {_B}::DOUBLE * exp(l_discount) AS a, {_B}::DOUBLE * (1 + exp(l_discount)) AS c, l_discount AS y FROM lineitem),
    s AS (SELECT *, a * (ln(z) - {_psi("a")} + {_psi("c")}) AS score FROM r)
    SELECT id, round((a - 1) * ln(z) + ({_B}::DOUBLE - 1) * ln(1 - z) - lgamma(a) - lgamma({_B}::DOUBLE) + lgamma(c), 6) AS llh, round(score, 6) AS score,
      round(-score - a * a * ({_psi1("c")} - {_psi1("a")}), 6) AS hess, round(1 / (1 + exp(-y)), 6) AS link FROM s"""
)
def family_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 51).alias("z"), F.col("l_discount").alias("y"))
    return _family(rows, "beta")


@query(
    """SELECT 'logistic' AS family, count(*) AS n, CAST(sum(CASE WHEN quality IN (0, 1) THEN 0 ELSE 1 END) AS BIGINT) AS bad FROM labels
    UNION ALL SELECT 'gamma', count(*), CAST(sum(CASE WHEN l_discount > 0 THEN 0 ELSE 1 END) AS BIGINT) FROM lineitem"""
)
def support_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, table, column in (("logistic", "labels", "quality"), ("gamma", "lineitem", "l_discount")):
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(column).cast("double").alias("z"))
        out.append(t.agg(F.count("*").alias("n"), F.sum(families.outside(families.family(name)).cast("int")).cast("long").alias("bad")).select(F.lit(name).alias("family"), "n", "bad"))
    return out[0].unionByName(out[1])


# Laplace, estimation, streams


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.pts2d(spark, sf_dir).withColumn("z", (F.col("z") > 0).cast("double"))


@query(f"{_nearest_sql('zy', 0.25)} SELECT f.loc_id, round(f.mean, 6) AS mean, round(u.z, 6) AS pseudo, 0.25::DOUBLE AS noise FROM f JOIN u USING (loc_id) WHERE is_obs")
def vl_posterior_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir)
    post = laplace.posterior(specify(p, 1, order="coord", cond_yz="zy"), p, "gauss", THETA2, sigma=0.5)
    return post.table.select("loc_id", *[six(c).alias(c) for c in ("mean", "pseudo", "noise")])


# Newton's steps of independent values, each given its own response only; as many as make the change vanish.
_NEWTON = f"""WITH RECURSIVE {P2}, b AS (SELECT loc_id, CASE WHEN z > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS z FROM p2),
y AS (SELECT loc_id, z, 0::DOUBLE AS y, 0 AS k, 0::DOUBLE AS t, 0::DOUBLE AS d
  UNION ALL SELECT loc_id, z, t_ / (1 + d_), k + 1, t_, d_ FROM (SELECT loc_id, z, k, 1 / (m * (1 - m)) AS d_, (z - m) / (m * (1 - m)) + y AS t_ FROM (SELECT *, 1 / (1 + exp(-y)) AS m FROM y) v) w WHERE k < 12)"""
_NEWTON = _NEWTON.replace("0::DOUBLE AS d\n", "0::DOUBLE AS d FROM b\n")


@query(f"{_NEWTON} SELECT loc_id, round(y, 6) AS mean, round(t, 6) AS pseudo, round(d, 6) AS noise FROM y WHERE k = 12")
def vl_posterior_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    post = laplace.posterior(specify(p, 1, order="coord", cond_yz="zy"), p, "logistic", THETA2, tolerance=1e-10)
    return post.table.select("loc_id", *[six(c).alias(c) for c in ("mean", "pseudo", "noise")])


@query(_kalman_sql(0.25))
def vl_loglik_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _plan1(spark, sf_dir, 1, "y")
    return laplace.laplace_loglik(plan, p, "gauss", THETA, sigma=0.5).select(F.round("loglik", 4).alias("loglik"))


@query(_kalman_sql(0.25))
def vl_loglik_own_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a response-first plan, which makes its own plan for the likelihood."""
    plan, p = _plan1(spark, sf_dir, 1, "zy")
    return laplace.laplace_loglik(plan, p, "gauss", THETA, sigma=0.5).select(F.round("loglik", 4).alias("loglik"))


_Q95 = "1.6448536269514722::DOUBLE"


@query(f"{_nearest_sql('zy', 0.25)} SELECT loc_id, is_obs, round(mean, 6) + 0 AS mean, round(var, 6) AS var, round(mean, 6) + 0 AS data_mean, round(mean - {_Q95} * sqrt(var), 6) AS lower, round(mean + {_Q95} * sqrt(var), 6) AS upper FROM f")
def vl_predict_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, p = _nearest_plan(spark, sf_dir, "zy")
    post = laplace.posterior(specify(p, 1, order="coord", cond_yz="zy"), p, "gauss", THETA2, sigma=0.5)
    out = laplace.laplace_predict(post, plan)
    return out.select("loc_id", "is_obs", *[(six(c) + 0.0).alias(c) for c in ("mean", "var", "data_mean", "lower", "upper")])


@query()
def vl_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    post = laplace.posterior(specify(p, 10, cond_yz="zy"), p, "logistic", THETA2)
    return post.table.select("loc_id", *[six(c).alias(c) for c in ("mean", "pseudo", "noise")])


@query()
def vl_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    return laplace.laplace_loglik(specify(p, 8, cond_yz="SGV"), p, "logistic", THETA2).select(six("loglik").alias("loglik"))


@query()
def vl_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _binary(spark, sf_dir)
    post = laplace.posterior(specify(p, 10, cond_yz="zy"), p, "logistic", THETA2)
    out = laplace.laplace_predict(post, specify(p, 10, grid_points(spark)))
    return out.select("loc_id", "is_obs", *[six(c).alias(c) for c in ("mean", "var", "data_mean", "lower", "upper")])


@query(
    f"""WITH {P2}, {GRID_SQL}, n AS (SELECT a.loc_id, b.z, exp(-{D2} / {THETA2[1]}::DOUBLE) AS c, row_number() OVER (PARTITION BY a.loc_id ORDER BY {D2}, b.loc_id) AS k FROM g a, p2 b)
    SELECT loc_id, round(c * z / {1 + NUGGET}::DOUBLE, 6) + 0 AS mean, round(1 - c * c / {1 + NUGGET}::DOUBLE, 6) AS var FROM n WHERE k = 1"""
)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid as a stream of files, scored from the nearest observation, a folder for each micro-batch."""
    p = materialise(points.pts2d(spark, sf_dir))
    source, out = shared_dir(spark), shared_dir(spark)
    grid_points(spark).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("loc_id long, coords array<double>").option("maxFilesPerTrigger", 2).parquet(source)
    sink = lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    score_stream(stream, p, p, THETA2, NUGGET, sink, shared_dir(spark), m=1, once=True).awaitTermination()
    return spark.read.parquet(out).select("loc_id", (six("mean") + 0.0).alias("mean"), six("var").alias("var"))


@query()
def estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir)
    fit = fitting.estimate(p, p, 5, cond_yz="z", start=[1.0, 0.3, 0.5, 0.1])
    return spark.createDataFrame([(k, v, fit.evaluations, fit.converged) for k, v in fit.named().items()], "parameter string, value double, evaluations long, converged boolean")


@query()
def predict_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points.pts2d(spark, sf_dir)
    fit = fitting.estimate(p, p, 5, cond_yz="z", start=[1.0, 0.3, 0.5, 0.1])
    out = fitting.predict_fit(fit, grid_points(spark), 10).withColumns({"mean": six("mean"), "var": six("var")})
    return out.withColumns({"evaluations": F.lit(fit.evaluations).cast("long"), "converged": F.lit(fit.converged)})


@query()
def gp_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.sample_gp(points.grid(spark, 20), "matern", (1.0, 0.25, 0.5), 0.1)

