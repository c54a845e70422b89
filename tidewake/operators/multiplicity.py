"""Adjusted p-values; nulls stay in place and don't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, p: str, tie: str, by: tuple[str, ...]) -> DataFrame:
    known = Window.partitionBy(*by, F.col(p).isNull())
    return df.withColumn("_m", F.count(p).over(known)).withColumn("_i", F.row_number().over(known.orderBy(p, tie)))


def holm(df: DataFrame, p: str, tie: str, *by: str, out: str = "holm") -> DataFrame:
    """Step-down: the running maximum of (m - i + 1) p."""
    w = Window.partitionBy(*by, F.col(p).isNull()).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranked(df, p, tie, by)
    return rows.withColumn(out, F.when(F.col(p).isNotNull(), F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_i") + 1) * F.col(p))).over(w))).drop("_m", "_i")


def benjamini_yekutieli(df: DataFrame, p: str, tie: str, *by: str, out: str = "by") -> DataFrame:
    """Step-up under any dependence: the running minimum, from the largest, of p m H(m) / i."""
    w = Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    rows = _ranked(df, p, tie, by)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest("_m", F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return rows.withColumn("_h", harmonic).withColumn(out, F.when(F.col(p).isNotNull(), F.min(F.least(F.lit(1.0), F.col(p) * F.col("_m") * F.col("_h") / F.col("_i"))).over(w))).drop("_m", "_i", "_h")
