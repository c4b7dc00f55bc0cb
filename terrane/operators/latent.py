"""Which neighbours are conditioned on through the latent value and which through the noisy response.

All take conditioning rows (pos, slot, nbr_pos) with slot 0 for the point itself and return them with on_latent.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import in_one_task
from .neighbors import nearest

RULES = ("SGV", "SGVT", "y", "z", "zy", "RVP", "LK")


def all_latent(conditioning: DataFrame) -> DataFrame:
    return conditioning.withColumn("on_latent", F.lit(True))


def all_response(conditioning: DataFrame, ordered: DataFrame) -> DataFrame:
    """Through the response, but for the point itself and predicted neighbours, which have none."""
    seen = ordered.select(F.col("pos").alias("nbr_pos"), F.col("is_obs").alias("_o"))
    return conditioning.join(seen, "nbr_pos").withColumn("on_latent", (F.col("slot") == 0) | ~F.col("_o")).select("pos", "slot", "nbr_pos", "on_latent")


def sgv_flags(sets: list[list[int]], first_pred: int) -> list[list[bool]]:
    """Flags for sets of neighbours, each with the point itself first.

    A point takes over the latent part of the neighbour whose latent part shares most with the point's own set (the
    first of equals; none if nothing is shared), so that the latent variables of each column are connected.
    """
    latent: list[set[int]] = []
    flags = []
    for k, s in enumerate(sets):
        mine = set(s)
        best, shared = 0, set()
        for nbr in s[1:]:
            if nbr < first_pred:
                common = mine & latent[nbr]
                if len(common) > best:
                    best, shared = len(common), common
        own = shared | {k} | {j for j in s if j >= first_pred}
        latent.append(own)
        flags.append([j in own for j in s])
    return flags


def sgv(conditioning: DataFrame, n_obs: int, treat_predictions: bool = False) -> DataFrame:
    """Sparse general conditioning. Each row needs those before it, so it runs in one task; treat_predictions: rows of
    predicted points (pos >= n_obs) are all latent."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["pos", "slot"], ignore_index=True)
        sets = p.groupby("pos", sort=True)["nbr_pos"].agg(list).tolist()
        p["on_latent"] = [f for row in sgv_flags(sets, n_obs) for f in row]
        if treat_predictions:
            p.loc[p["pos"] >= n_obs, "on_latent"] = True
        return p

    return in_one_task(conditioning.select("pos", "slot", "nbr_pos"), run, "pos long, slot int, nbr_pos long, on_latent boolean")


def response_first(ordered: DataFrame, conditioning: DataFrame, m: int, rule: str) -> DataFrame:
    """The rules zy, RVP and LK. An observed point conditions on its own response and its m - 1 nearest observed points,
    earlier or later: through the latent value of earlier ones (LK: through the response always). A predicted point
    keeps its set: all latent (zy), or observed ones through the response (RVP, LK). The point's own response is a row
    with nbr_pos = pos and slot 1."""
    if rule not in ("zy", "RVP", "LK"):
        raise ValueError(f"no response-first rule {rule!r}")
    seen = ordered.where("is_obs").select("pos", "coords")
    q = seen.select(F.col("pos").alias("query"), "coords", F.lit(None).cast("long").alias("before"))
    near = nearest(q, seen.select(F.col("pos").alias("nbr"), "coords"), m - 1) if m > 1 else None
    rows = seen.select("pos", F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.lit(True).alias("l")), F.struct(F.lit(1).alias("slot"), F.lit(False).alias("l")))).alias("s"))
    rows = rows.select("pos", "s.slot", F.col("pos").alias("nbr_pos"), F.col("s.l").alias("on_latent"))
    if near is not None:
        through = F.lit(False) if rule == "LK" else F.col("nbr") < F.col("query")
        rows = rows.unionByName(near.select(F.col("query").alias("pos"), (F.col("slot") + 1).alias("slot"), F.col("nbr").alias("nbr_pos"), through.alias("on_latent")))
    pred = conditioning.join(ordered.where(~F.col("is_obs")).select("pos"), "pos")
    pred = all_latent(pred) if rule == "zy" else all_response(pred, ordered)
    return rows.unionByName(pred.select("pos", "slot", "nbr_pos", "on_latent"))


def with_zero_nuggets(flags: DataFrame, nuggets: DataFrame) -> DataFrame:
    """Conditions on the latent value of points without noise; nuggets: (pos, nugget)."""
    free = nuggets.where("nugget = 0").select(F.col("pos").alias("nbr_pos"), F.lit(True).alias("_free"))
    return flags.join(free, "nbr_pos", "left").withColumn("on_latent", F.col("on_latent") | F.coalesce("_free", F.lit(False))).drop("_free").select("pos", "slot", "nbr_pos", "on_latent")
