"""Per-dimension normalisation of feature vectors: fit over a corpus, apply per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the smallest variance used.
VARIANCE_FLOOR = 1e-20


def fit_cmvn(features: DataFrame, column: str = "mel") -> DataFrame:
    """dim, n, mean, istd over all frames; partial sums leave one row per dimension and task."""
    long = features.select(F.posexplode(column).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    sums = long.groupBy("dim").agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(VARIANCE_FLOOR))
    return sums.select("dim", "n", mean.alias("mean"), (F.lit(1.0) / F.sqrt(var)).alias("istd"))


def stat_vectors(stats: DataFrame, shift: str, scale: str):
    """The two vectors as a one-row scalar subquery; it is as long as one row's feature vector."""
    packed = stats.agg(F.sort_array(F.collect_list(F.struct("dim", F.col(shift).alias("a"), F.col(scale).alias("b")))).alias("v"))
    return packed.select("v").scalar()


def apply_cmvn(features: DataFrame, stats: DataFrame, mode: str = "subtract", shift: str = "mean", scale: str = "istd",
               column: str = "mel") -> DataFrame:
    """(x - shift) * scale, or (x + shift) * scale with mode="add"."""
    if mode not in ("subtract", "add"):
        raise ValueError(f"unknown mode {mode!r}")
    sign = -1.0 if mode == "subtract" else 1.0
    out = features.withColumn("_v", stat_vectors(stats, shift, scale))
    normed = F.zip_with(column, "_v", lambda x, v: (x.cast("double") + sign * v["a"]) * v["b"])
    return out.withColumn(column, normed).drop("_v")
