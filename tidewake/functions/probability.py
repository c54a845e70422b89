"""Probabilities and small closed forms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value; Spark has no error function."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))


def clipped(p: Column, edge: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))


def logit(p: Column, edge: float = 1e-6) -> Column:
    q = clipped(p, edge)
    return F.ln(q / (1 - q))


def log_loss(y: Column, p: Column, edge: float = 1e-15) -> Column:
    q = clipped(p, edge)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def shifted_odds(p: Column, factor: Column | float) -> Column:
    """A probability whose odds are multiplied."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return f * p / (1 - p + f * p)


def exponential_rmst(p: Column, horizon: float, multiplier: Column | float = 1.0) -> Column:
    """Restricted mean of an exponential time with event probability p by the horizon and a multiplied hazard."""
    rate = -F.ln(1 - clipped(p)) / horizon * multiplier
    return (1 - F.exp(-rate * horizon)) / rate


def e_value(risk_ratio: Column) -> Column:
    rr = F.when(risk_ratio >= 1, risk_ratio).otherwise(1 / risk_ratio)
    return rr + F.sqrt(rr * (rr - 1))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval."""
    p, z2 = successes / n, z * z
    centre, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def two_proportion_z(x1: Column, n1: Column, x0: Column, n0: Column) -> Column:
    p = (x1 + x0) / (n1 + n0)
    return (x1 / n1 - x0 / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
