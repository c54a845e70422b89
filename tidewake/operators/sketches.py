"""Sketches that merge: distinct counts and quantiles of any set of partitions, from what was kept of each instead of its rows.

Each group holds a row count and, for each column, one sketch of bounded size, whatever the group's rows; partial
sketches are merged before they move. Nulls count for neither kind of sketch, and NaN for no quantile. Estimates are
whole up to a stated error, but may differ within it from run to run, since sketches depend on the order of their rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sketches:
    """Which columns are sketched: ``distinct`` (numbers or text) and ``quantiles`` (numbers), with the sizes of the sketches."""

    distinct: tuple[str, ...] = ()
    quantiles: tuple[str, ...] = ()
    lg_size: int = 12
    k: int = 800

    @property
    def distinct_error(self) -> float:
        """Relative error of a distinct count that three standard errors of a merged sketch allow."""
        return 3 * 1.04 / 2 ** (self.lg_size / 2)

    @property
    def rank_error(self) -> float:
        """Error of a quantile's rank, as a share of the rows: twice what 99 of 100 sketches keep."""
        return 2 * 2.296 / self.k**0.9021

    def build(self, df: DataFrame, by: Sequence[str]) -> DataFrame:
        """by, n, and a sketch ``c_distinct`` or ``c_quantiles`` for each column."""
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            *(F.hll_sketch_agg(c, self.lg_size).alias(f"{c}_distinct") for c in self.distinct),
            *(F.kll_sketch_agg_double(number(c), self.k).alias(f"{c}_quantiles") for c in self.quantiles),
        )

    def merge(self, sketches: DataFrame, by: Sequence[str]) -> DataFrame:
        """Sketches of coarser groups, or of several partitions: as ``build`` gives them for the rows of all."""
        return sketches.groupBy(*by).agg(
            F.sum("n").alias("n"),
            *(F.hll_union_agg(f"{c}_distinct").alias(f"{c}_distinct") for c in self.distinct),
            *(F.kll_merge_agg_double(f"{c}_quantiles", self.k).alias(f"{c}_quantiles") for c in self.quantiles),
        )

    def estimates(self, sketches: DataFrame, by: Sequence[str], fractions: dict[str, float]) -> DataFrame:
        """by, n, the distinct count of each column, and ``c_name`` for each named fraction: null for groups without a number."""

        def quantile(c: str, fraction: float) -> Column:
            held = F.col(f"{c}_quantiles")
            return F.when(F.kll_sketch_get_n_double(held) > 0, F.kll_sketch_get_quantile_double(held, F.lit(fraction)))

        return sketches.select(
            *by, "n", *(F.hll_sketch_estimate(f"{c}_distinct").alias(f"{c}_distinct") for c in self.distinct), *(quantile(c, f).alias(f"{c}_{name}") for c in self.quantiles for name, f in fractions.items())
        )


def trailing(df: DataFrame, week: str, weeks: int) -> DataFrame:
    """Each row once for each span of ``weeks`` weeks that it lies in, named by the span's last week."""
    ends = F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))
    return df.select("*", ends.alias("_ahead")).withColumn(week, F.date_add(F.col(week), F.col("_ahead") * 7)).drop("_ahead")
