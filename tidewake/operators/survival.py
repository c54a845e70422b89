"""Kaplan-Meier estimates from counts for each distinct time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.operators.ranks import Ordered


def kaplan_meier(df: DataFrame, time: str, event: str, *by: str) -> DataFrame:
    """At-risk numbers, events, and survival before and after each distinct time."""
    counts = df.groupBy(*by, time).agg(F.count_if(F.col(event)).alias("d"), F.count(F.lit(1)).alias("c"))
    ordered = Ordered(counts, by, time)
    rows = ordered.before(ordered.rows, {"at_risk": F.col("c")}, descending=True).withColumn("at_risk", F.col("at_risk") + F.col("c"))
    step = 1 - F.col("d") / F.col("at_risk")
    return ordered.before(rows, {"before": step}, product=True).withColumn("survival", F.col("before") * step).drop("_part")


def restricted_mean(df: DataFrame, time: str, event: str, horizon: float, *by: str) -> DataFrame:
    """Area under the survival curve up to the horizon."""
    t = F.least(F.col(time).cast("double"), F.lit(float(horizon)))
    rows = df.withColumn("_e", F.col(event) & (F.col(time) <= horizon)).withColumn("_t", t)
    km = kaplan_meier(rows, "_t", "_e", *by)
    # area = horizon - sum of each time's drop of the curve over what is left of the horizon
    km = km.withColumn("_lost", F.col("before") * F.col("d") / F.col("at_risk") * (horizon - F.col("_t")))
    return km.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("d").alias("events"), (F.lit(float(horizon)) - F.sum("_lost")).alias("rmst"))
