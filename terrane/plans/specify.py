"""Plans: ordered points with conditioning sets, made once and evaluated for many parameters."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import latent, mra, neighbors, ordering, pattern
from ..sources.points import check_locations, check_predictions, union
from ..sources.storage import materialise


@dataclass
class Plan:
    """ordered: pos, loc_id, coords, is_obs; flags: pos, slot, nbr_pos, on_latent. Both are written tables."""

    ordered: DataFrame
    flags: DataFrame
    ordering: str
    conditioning: str
    cond_yz: str
    m: int
    n_obs: int
    n_pred: int
    ordering_pred: str | None = None
    tree: mra.Tree | None = None
    response_first: bool = False
    notes: list[str] = field(default_factory=list)

    @property
    def n(self) -> int:
        return self.n_obs + self.n_pred

    def packed(self) -> DataFrame:
        """pos, loc_id, is_obs, coords, nbr (array of pos), on_latent (array of boolean): a row for each point."""
        sets = self.flags.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("slot", "nbr_pos", "on_latent"))).alias("s"))
        rows = self.ordered.join(sets, "pos")
        return rows.select("pos", "loc_id", "is_obs", "coords", F.col("s.nbr_pos").alias("nbr"), F.col("s.on_latent").alias("on_latent"))

    def with_neighbors(self, values: DataFrame | None = None) -> DataFrame:
        """pos, loc_id, is_obs, s: array of (slot, nbr_pos, on_latent, coords[, z, nugget]) of each point's neighbours, itself
        first. values: (loc_id, z, nugget)."""
        far = self.ordered.select(F.col("pos").alias("nbr_pos"), "loc_id", "coords")
        names = ["slot", "nbr_pos", "on_latent", "coords"]
        if values is not None:
            far = far.join(values.select("loc_id", "z", "nugget"), "loc_id", "left")
            names += ["z", "nugget"]
        sets = self.flags.join(far.drop("loc_id"), "nbr_pos").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("s"))
        return self.ordered.select("pos", "loc_id", "is_obs").join(sets, "pos")

    def index(self) -> DataFrame:
        return pattern.u_index(self.ordered)

    def pattern(self) -> DataFrame:
        return pattern.u_pattern(self.flags, self.index())


def specify(
    points: DataFrame,
    m: int | None = None,
    predictions: DataFrame | None = None,
    order: str | None = None,
    cond_yz: str | None = None,
    order_pred: str | None = None,
    pred_cond: str = "general",
    conditioning: str | None = None,
    tree: dict | None = None,
) -> Plan:
    """A plan for observed points (loc_id, coords) and, optionally, predicted ones.

    order: coord, maxmin, outsidein, middleout or none (default: coord in one dimension, else maxmin; trees need maxmin).
    conditioning: NN, firstm or mra. cond_yz: SGV, SGVT, y, z, zy, RVP or LK (default: y for trees; SGV without predictions
    or in one dimension; else zy). order_pred: general (one order of all points) or obspred (observed first; default but for
    coord in one dimension). pred_cond: independent lets each predicted point condition on observed ones only. tree: r, J, M.
    m = 0: independent points. m above n - 1 is cut with a warning.
    """
    notes: list[str] = []
    dims = check_locations(points)
    n = points.count()
    n_pred = predictions.count() if predictions is not None else 0
    if n_pred:
        if check_locations(predictions) != dims:
            raise ValueError("predictions have another number of coordinates")
    m = neighbors.check_m(m, n, bool(tree and tree.get("r") is not None))
    every = union(points, predictions) if n_pred else points.select("loc_id", "coords", F.lit(True).alias("is_obs"))
    if n_pred:
        check_predictions(every)
    if m == 0:
        if n_pred:
            warnings.warn("m = 0: predictions are ignored", stacklevel=2)
        ordered = materialise(ordering.as_given(points.select("loc_id", "coords", F.lit(True).alias("is_obs"))))
        flags = latent.all_latent(neighbors.no_neighbors(ordered))
        return Plan(ordered, materialise(flags), "none", "NN", "false", 0, n, 0)
    conditioning = conditioning or ("mra" if tree else "NN")
    if conditioning not in ("NN", "firstm", "mra"):
        raise ValueError(f"conditioning {conditioning!r} isn't known")
    shape = dict(tree or {})
    if conditioning == "firstm":  # a tree of m common knots and single points below
        conditioning, shape = "mra", {"r": (m, 1)}
    if conditioning == "mra":
        if order not in (None, "maxmin"):
            warnings.warn("trees need the max-min ordering: it is used", stacklevel=2)
        order = "maxmin"
    order = order or ("coord" if dims == 1 else "maxmin")
    if order not in ("coord", "maxmin", "outsidein", "middleout", "none"):
        raise ValueError(f"ordering {order!r} isn't known")
    cond_yz = cond_yz or ("y" if conditioning == "mra" else "SGV" if not n_pred or dims == 1 else "zy")
    if cond_yz not in latent.RULES:
        raise ValueError(f"cond_yz {cond_yz!r} isn't known")
    if cond_yz == "SGVT" and not n_pred:
        cond_yz = "SGV"
    order_pred = (order_pred or ("general" if dims == 1 and order == "coord" else "obspred")) if n_pred else None
    if cond_yz in ("zy", "RVP", "LK") and order_pred == "general":
        warnings.warn("response-first conditioning needs observed points first: they are put first", stacklevel=2)
        order_pred = "obspred"

    if order_pred == "obspred" and order == "coord":
        ordered = ordering.observed_first(every, F.aggregate("coords", F.lit(0.0), lambda s, x: s + x))
    elif order_pred == "obspred" and order == "none":
        ordered = ordering.observed_first(every, F.lit(0))
    elif order_pred == "obspred":
        ordered = ordering.maxmin_obs_pred(every)
    elif order == "coord":
        ordered = ordering.by_coordinate(every)
    elif order in ("outsidein", "middleout"):
        ordered = ordering.middle_out(every, outside_in=order == "outsidein")
    elif order == "none":
        ordered = ordering.as_given(every)
    else:
        ordered = ordering.maxmin(every)
        if not n_pred:
            ordered = ordering.rotated(ordered)
    ordered = materialise(ordered.select("pos", "loc_id", "coords", "is_obs"))

    chosen = None
    if conditioning == "mra":
        chosen = mra.parameters(n + n_pred, m, shape.get("r"), shape.get("J"), shape.get("M"))
        table = materialise(mra.knot_table(ordered, chosen))
        sets = materialise(mra.ancestor_neighbors(table))
        widest = (sets.agg(F.max("slot")).first()[0] or 0) if n + n_pred else 0
        notes.append(f"MRA: J={','.join(map(str, chosen.J))}, M={chosen.M}, r={','.join(map(str, chosen.r))}, m={widest}")
        if widest > 100:
            notes.append(f"MRA: the effective m is {widest}: this may be slow")
        m = widest
    elif dims == 1 and order == "coord" and order_pred != "obspred":
        sets = neighbors.line_neighbors(ordered, m)
    else:
        sets = materialise(neighbors.ordered_neighbors(ordered, m))
    if n_pred and pred_cond == "independent":
        if order_pred == "obspred":
            sets = materialise(neighbors.independent_predictions(ordered, sets, m))
        else:
            warnings.warn("independent predictions need observed points first: ignored", stacklevel=2)
    if cond_yz == "y":
        flags = latent.all_latent(sets)
    elif cond_yz == "z":
        flags = latent.all_response(sets, ordered)
    elif cond_yz in ("SGV", "SGVT"):
        flags = latent.sgv(sets, n, treat_predictions=cond_yz == "SGVT")
    else:
        flags = latent.response_first(ordered, sets, m, cond_yz)
    first = cond_yz in ("zy", "RVP", "LK")
    return Plan(ordered, materialise(flags), order, conditioning, "zy" if first else cond_yz, m, n, n_pred, order_pred, chosen, first, notes)


def block_full_scale(points: DataFrame, m: int, **more) -> Plan:
    return specify(points, m, conditioning="mra", tree={"M": 1}, **more)


def predictive_process(points: DataFrame, m: int, **more) -> Plan:
    return specify(points, m, conditioning="mra", tree={"r": (m, 1)}, **more)


def independent_blocks(points: DataFrame, m: int, **more) -> Plan:
    return specify(points, m, conditioning="mra", tree={"r": (0, m)}, **more)


def full_tree(points: DataFrame, r: Sequence[int], J: int, M: int, **more) -> Plan:  # noqa: N803
    return specify(points, -1, conditioning="mra", tree={"r": tuple(r), "J": J, "M": M}, **more)
