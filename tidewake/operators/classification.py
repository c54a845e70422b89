"""Agreement, discrimination and calibration of scored binary cases.

All measures come from counts for each distinct score or bin, never from pairs of cases.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.probability import clipped, log_loss, wilson
from tidewake.operators.ranks import positions, running


def agreement(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Raw and chance agreement of two binary raters, Cohen's kappa and Gwet's AC1."""
    x, y = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("raw"), x.alias("_x"), y.alias("_y"))
    out = out.withColumn("expected", F.col("_x") * F.col("_y") + (1 - F.col("_x")) * (1 - F.col("_y")))
    mean = (F.col("_x") + F.col("_y")) / 2
    gamma = 2 * mean * (1 - mean)
    over = lambda e: F.when(e < 1, (F.col("raw") - e) / (1 - e))
    return out.withColumn("excess", F.col("raw") - F.col("expected")).withColumn("kappa", over(F.col("expected"))).withColumn("ac1", over(gamma)).drop("_x", "_y")


def confusion(df: DataFrame, y: str, score: str, threshold: float, *by: str) -> DataFrame:
    """Counts at a threshold and the rates derived from them, with Brier score and log loss."""
    hit, true = F.col(score) >= threshold, F.col(y) == 1
    out = df.groupBy(*by).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"),
        F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"), F.avg(log_loss(F.col(y), F.col(score))).alias("log_loss"),
    )
    rate = lambda n, d: F.when(F.expr(d) > 0, F.expr(n) / F.expr(d))
    out = out.withColumns({"sensitivity": rate("tp", "tp + fn"), "specificity": rate("tn", "tn + fp"), "ppv": rate("tp", "tp + fp"), "npv": rate("tn", "tn + fn")})
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def by_score(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """Positives and negatives of each distinct score: what all rank measures need."""
    return df.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def rank_auc(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    counts = running(by_score(df, y, score, *by), by, score, {"below": F.col("neg")})
    area = F.sum(F.col("pos") * (F.col("below") + 0.5 * F.col("neg")))
    out = counts.groupBy(*by).agg(area.alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return out.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def average_precision(df: DataFrame, y: str, score: str, *by: str) -> DataFrame:
    """Precision at each distinct score, weighted by the recall that it adds."""
    counts = running(by_score(df, y, score, *by), by, score, {"tp": F.col("pos"), "taken": F.col("pos") + F.col("neg")}, descending=True)
    counts = counts.withColumn("tp", F.col("tp") + F.col("pos")).withColumn("taken", F.col("taken") + F.col("pos") + F.col("neg"))
    out = counts.groupBy(*by).agg(F.sum(F.col("pos") * F.col("tp") / F.col("taken")).alias("_s"), F.sum("pos").alias("n_pos"))
    return out.select(*by, "n_pos", F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos")).alias("average_precision"))


def equal_count_bin(position: Column, n: Column, bins: int) -> Column:
    """Bin of a 1-based position among n rows, bin i holding positions from i*n//bins; ``ntile`` puts remainders elsewhere."""
    return F.floor((position * bins - 1) / n).cast("int")


def in_equal_bins(df: DataFrame, score: str, tie: str, bins: int) -> DataFrame:
    """The rows with their bin of equal count by (score, tie)."""
    return positions(df, score, tie).withColumn("bin", equal_count_bin(F.col("_position"), F.col("_rows"), bins)).drop("_position", "_rows")


def reliability_bins(df: DataFrame, y: str, score: str, tie: str, bins: int) -> DataFrame:
    """Mean score and observed rate, with Wilson interval, in bins of equal count."""
    out = in_equal_bins(df, score, tie, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.sum(y).cast("long").alias("events"))
    low, high = wilson(F.col("events"), F.col("n"))
    return out.withColumns({"observed": F.col("events") / F.col("n"), "low": low, "high": high})


def calibration_error(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """Bins of equal width, the last one closed, and their part of the expected calibration error."""
    placed = df.withColumn("bin", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int"))
    out = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(y).cast("double")).alias("observed"))
    total = F.sum("n").over(Window.partitionBy())
    return out.withColumn("ece_part", F.col("n") / total * F.abs(F.col("mean_score") - F.col("observed")))


def decision_curve(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none, at each threshold; one pass over the cases."""
    cases = df.groupBy().agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("events"),
        *(x for i, t in enumerate(thresholds) for x in (F.count_if((F.col(score) >= t) & (F.col(y) == 1)).alias(f"tp{i}"), F.count_if((F.col(score) >= t) & (F.col(y) == 0)).alias(f"fp{i}"))),
    )
    points = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)))
    out = cases.select("n", "events", F.explode(points).alias("p")).select("n", "events", "p.*")
    odds = F.col("threshold") / (1 - F.col("threshold"))
    return out.select("threshold", "tp", "fp", ((F.col("tp") - F.col("fp") * odds) / F.col("n")).alias("model"), ((F.col("events") - (F.col("n") - F.col("events")) * odds) / F.col("n")).alias("treat_all"), F.lit(0.0).alias("treat_none"))


def logistic_calibration(df: DataFrame, y: str, score: str, steps: int = 100, tolerance: float = 1e-10) -> tuple[float, float] | None:
    """Intercept and slope of the outcome on the score's logit: Newton steps, each one aggregate of five sums."""
    p = clipped(F.col(score))
    counts = df.groupBy(F.ln(p / (1 - p)).alias("x")).agg(F.sum(y).alias("k"), F.count(F.lit(1)).alias("n")).cache()
    a, b = 0.0, 1.0
    try:
        for _ in range(steps):
            q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
            v, r, x = F.col("n") * q * (1 - q), F.col("k") - F.col("n") * q, F.col("x")
            g0, g1, h00, h01, h11 = counts.agg(F.sum(r), F.sum(r * x), F.sum(v), F.sum(v * x), F.sum(v * x * x)).first()
            det = h00 * h11 - h01 * h01 if h00 is not None else 0.0
            if abs(det) < 1e-12:
                return None
            da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
            a, b = a + da, b + db
            if max(abs(da), abs(db)) < tolerance:
                break
        return a, b
    finally:
        counts.unpersist()
