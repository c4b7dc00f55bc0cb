"""The sparsity pattern of the factor U: indices of variables, and the rows of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import running_sum


def u_index(ordered: DataFrame) -> DataFrame:
    """pos, latent_ix, obs_ix: points in order take a place for the latent value and, if observed, one for the response."""
    width = F.lit(1) + F.col("is_obs").cast("int")
    rows = running_sum(ordered.select("pos", "is_obs"), "pos", width, "_end")
    return rows.select("pos", (F.col("_end") - width).alias("latent_ix"), F.when(F.col("is_obs"), F.col("_end") - 1).alias("obs_ix"))


def u_pattern(flags: DataFrame, index: DataFrame) -> DataFrame:
    """row, col, pos, slot of all entries of U: the column of a latent value has a row for each neighbour, that of a
    response the rows of its latent value and its own. slot is null in the latter."""
    mine = index.select("pos", F.col("latent_ix").alias("col"))
    other = index.select(F.col("pos").alias("nbr_pos"), F.col("latent_ix").alias("l"), F.col("obs_ix").alias("o"))
    latent = flags.join(mine, "pos").join(other, "nbr_pos").select(F.when(F.col("on_latent"), F.col("l")).otherwise(F.col("o")).alias("row"), "col", "pos", "slot")
    response = index.where("obs_ix is not null").select(F.explode(F.array("latent_ix", "obs_ix")).alias("row"), F.col("obs_ix").alias("col"), "pos", F.lit(None).cast("int").alias("slot"))
    return latent.unionByName(response)
