"""Planning and monitoring summaries made of small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def before_after_snapshot(df: DataFrame, after: Column, measures: dict[str, Column]) -> DataFrame:
    """metric, before, after, shift: means of measures in both periods, one row each, from one pass."""
    aggs = [F.avg(F.when(after if t else ~after, c.cast("double"))).alias(f"m{i}_{t}") for i, c in enumerate(measures.values()) for t in (0, 1)]
    rows = F.array(*(F.struct(F.lit(name).alias("metric"), F.col(f"m{i}_0").alias("before"), F.col(f"m{i}_1").alias("after")) for i, name in enumerate(measures)))
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*").withColumn("shift", F.col("after") - F.col("before"))


def leakage_category(scored: Column, events: Sequence[tuple[str, Column]]) -> Column:
    """Which of a case's later facts were already known when it was scored: the latest of those that were."""
    known = [F.when(at <= scored, F.struct(at.alias("at"), F.lit(name).alias("name"))) for name, at in events]
    latest = F.greatest(*known) if len(known) > 1 else known[0]
    return F.when(scored.isNull(), "unscored").otherwise(F.coalesce(latest["name"], F.lit("clean")))


def component_plan(df: DataFrame, component: str, y: str, weeks: int, floor: int = 10) -> DataFrame:
    """Base rate and weekly volume of each component, with a floor on the volume; halves go to even."""
    out = df.groupBy(component).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("base_rate"))
    return out.withColumn("weekly", F.greatest(F.lit(floor), F.bround(F.col("n") / weeks).cast("int")))


def smallest_detectable(grid: DataFrame, by: str, effect: str, power: str, wanted: float) -> DataFrame:
    """The smallest effect of each design whose power suffices; null where none does."""
    return grid.groupBy(by).agg(F.min(F.when(F.col(power) >= wanted, F.abs(effect))).alias("smallest_effect"), F.max(power).alias("best_power"))


def sequential_boundaries(looks: DataFrame, share: str, critical: float) -> DataFrame:
    """Group-sequential limits: the final critical value over the root of the information so far."""
    return looks.withColumn("boundary", F.lit(critical) / F.sqrt(F.col(share)))


def gates(df: DataFrame, name: str, passed: str) -> DataFrame:
    """Each gate, and whether all hold."""
    return df.withColumn("all_pass", F.bool_and(passed).over(Window.partitionBy()))


def outcome_rates(df: DataFrame, category: str, baseline: float, factor: float) -> DataFrame:
    """Counts and shares of categories, flagged where they exceed a fixed baseline by a factor."""
    out = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return out.withColumn("share", share).withColumn("flagged", F.col("share") > baseline * factor)
