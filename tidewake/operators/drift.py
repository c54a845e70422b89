"""Distances between distributions of two groups of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.ranks import quantiles


def psi_quantile(df: DataFrame, value: str, reference: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability index over bins between the reference's quantiles, one row for each bin."""
    points = [i / bins for i in range(1, bins)]
    edges = quantiles(df.filter(reference), value, points)  # one row
    rows = df.withColumn("_ref", reference).crossJoin(F.broadcast(edges))
    placed = rows.withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(value))))
    return _psi(placed.groupBy("bin").agg(F.count_if("_ref").alias("n_ref"), F.count_if(~F.col("_ref")).alias("n_cur")), lambda n, t: F.greatest(n / t, F.lit(floor)))


def psi_fixed(df: DataFrame, value: str, reference: Column, edges: list[float], smoothing: float = 0.5) -> DataFrame:
    """The same over fixed bins, the last one closed on the right, with added counts."""
    k = len(edges) - 1
    bin_ = F.least(sum((F.col(value) >= e).cast("int") for e in edges[1:]), F.lit(k - 1))
    counts = df.withColumn("_ref", reference).withColumn("bin", bin_).groupBy("bin").agg(F.count_if("_ref").alias("n_ref"), F.count_if(~F.col("_ref")).alias("n_cur"))
    bins = df.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    counts = bins.join(counts, "bin", "left").na.fill(0)
    return _psi(counts, lambda n, t: (n + smoothing) / (t + smoothing * k))


def _psi(counts: DataFrame, share) -> DataFrame:
    all_ = Window.partitionBy()
    p, q = share(F.col("n_ref"), F.sum("n_ref").over(all_)), share(F.col("n_cur"), F.sum("n_cur").over(all_))
    return counts.withColumn("psi_part", (q - p) * F.ln(q / p))


def kl_divergence(df: DataFrame, value: str, reference: Column, low: float, high: float, bins: int = 20, smoothing: float = 0.5) -> DataFrame:
    """Kullback-Leibler divergence of current from reference counts over equal bins, one row for each bin."""
    width = (high - low) / bins
    out = psi_fixed(df, value, reference, [low + i * width for i in range(bins + 1)], smoothing)
    all_ = Window.partitionBy()
    p = (F.col("n_ref") + smoothing) / (F.sum("n_ref").over(all_) + smoothing * bins)
    q = (F.col("n_cur") + smoothing) / (F.sum("n_cur").over(all_) + smoothing * bins)
    return out.drop("psi_part").withColumn("kl_part", q * F.ln(q / p))


def share_shift(df: DataFrame, category: str, reference: Column) -> DataFrame:
    """Share of each category in both groups, and the largest difference of all."""
    counts = df.withColumn("_ref", reference).groupBy(category).agg(F.count_if("_ref").alias("n_ref"), F.count_if(~F.col("_ref")).alias("n_cur"))
    all_ = Window.partitionBy()
    counts = counts.withColumn("shift", F.col("n_cur") / F.sum("n_cur").over(all_) - F.col("n_ref") / F.sum("n_ref").over(all_))
    return counts.withColumn("largest", F.max(F.abs("shift")).over(all_))
