"""Estimators on small dense panels: one group, one small matrix, one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def project_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that sum to one."""
    down = np.sort(v)[::-1]
    over = (np.cumsum(down) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(down > over)[-1]], 0)


def synthetic_weights(donors: np.ndarray, target: np.ndarray, ridge: float = 0.0, steps: int = 2000) -> np.ndarray:
    """Weights on the simplex whose mix of donors (periods x donors) is nearest to the target; ``ridge`` times the mean square of the donors is added for each squared weight."""
    w = np.full(donors.shape[1], 1 / donors.shape[1])
    penalty = ridge * float((donors**2).mean()) * len(donors)
    scale = (np.linalg.norm(donors, 2) ** 2 + penalty) or 1.0
    for _ in range(steps):
        new = project_simplex(w - (donors.T @ (donors @ w - target) + penalty * w) / scale)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


#: Cells of a panel that is broadcast at most.
MOST_CELLS = 1_000_000


def synthetic_effects(panel: DataFrame, unit: str, period: str, value: str, after: str, ridge: float = 0.0) -> DataFrame:
    """unit, effect, fit, placebo_p: each unit in turn against a mix of all others, fitted before the switch.

    The others are a unit's placebos: ``placebo_p`` is the share of units, itself included, whose effect is as
    large. The panel is units x periods, its size is checked, and it goes to every task once; units are dealt to tasks.
    """
    rows = panel.select(F.col(unit).cast("string").alias("unit"), F.col(period).cast("string").alias("period"), F.col(value).cast("double").alias("value"), F.col(after).alias("after")).persist()
    try:
        if rows.count() > MOST_CELLS:
            raise ValueError(f"a panel of more than {MOST_CELLS} cells")
        pdf = rows.toPandas()
    finally:
        rows.unpersist()
    spark = panel.sparkSession
    schema = "unit string, effect double, fit double"
    if pdf.empty:
        return spark.createDataFrame([], f"{schema}, placebo_p double")
    wide = pdf.pivot_table(index=["period", "after"], columns="unit", values="value").dropna().sort_index()
    units, late, values = list(wide.columns), wide.index.get_level_values("after").to_numpy(bool), wide.to_numpy()
    shared = spark.sparkContext.broadcast((units, late, values))

    def run(batches):
        units, late, values = shared.value
        for b in batches:
            out = []
            for i in b["i"]:
                target, donors = values[:, i], np.delete(values, i, axis=1)
                if late.all() or not late.any() or not donors.shape[1]:
                    out.append((units[i], None, None))
                    continue
                gap = target - donors @ synthetic_weights(donors[~late], target[~late], ridge)
                out.append((units[i], gap[late].mean(), math.sqrt((gap[~late] ** 2).mean())))
            yield pd.DataFrame(out, columns=["unit", "effect", "fit"]).astype({"effect": float, "fit": float})

    found = spark.range(len(units)).select(F.col("id").cast("int").alias("i")).repartition(min(len(units), 200)).mapInPandas(run, schema)
    # one row for each unit
    return found.withColumn("placebo_p", F.when(F.col("effect").isNotNull(), F.cume_dist().over(Window.orderBy(F.abs("effect").desc_nulls_last()))))


def two_way_t(y: np.ndarray, d: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Two-way fixed-effects coefficient of d (units x periods) and its t with errors clustered by unit."""

    def inside(m: np.ndarray) -> np.ndarray:
        m = m.astype(float).copy()
        for _ in range(rounds):
            m -= m.mean(axis=1, keepdims=True)
            shift = m.mean(axis=0, keepdims=True)
            m -= shift
            if np.abs(shift).max() < 1e-13:
                break
        return m

    a, b = inside(y), inside(d)
    total = (b * b).sum()
    if total < 1e-12:
        return math.nan, math.nan
    beta = float((a * b).sum() / total)
    scores = (b * (a - beta * b)).sum(axis=1)
    k = len(y)
    se = math.sqrt((scores**2).sum() * k / max(k - 1, 1)) / total
    return beta, beta / se if se > 0 else math.nan


def two_way_effects(panel: DataFrame, group: str, unit: str, period: str, value: str, treated: str) -> DataFrame:
    """group, n_units, effect, t for balanced panels of each group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.pivot_table(index="unit", columns="period", values="value").dropna()
        d = pdf.pivot_table(index="unit", columns="period", values="treated").loc[y.index, y.columns]
        beta, t = two_way_t(y.to_numpy(), d.to_numpy()) if len(y) > 1 else (math.nan, math.nan)
        return pd.DataFrame({"grp": [str(pdf["grp"].iloc[0])], "n_units": [len(y)], "effect": [beta], "t": [t]})

    rows = panel.select(F.col(group).cast("string").alias("grp"), F.col(unit).cast("string").alias("unit"), F.col(period).cast("string").alias("period"), F.col(value).cast("double").alias("value"), F.col(treated).cast("double").alias("treated"))
    return rows.groupBy("grp").applyInPandas(one, "grp string, n_units long, effect double, t double")


@dataclass(frozen=True)
class Rollout:
    """A staggered rollout: units with base rates, weekly cases and strata, dealt to starting weeks within their stratum."""

    base: tuple[float, ...]
    cases: tuple[int, ...]
    strata: tuple[str, ...]
    starts: tuple[int, ...]
    weeks: int = 48
    wash_in: int = 2
    amplitude: float = 0.02
    correlation: float = 0.5
    shock_sd: float = 0.01
    policy_week: int | None = 24
    policy_effect: float = 0.01
    site_drift: float = 0.01


def two_way_many(y: np.ndarray, d: np.ndarray, seen: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """``two_way_t`` of many panels at once (panels x units x periods), with cells that weren't seen."""
    w = seen.astype(float)
    rows, columns = np.maximum(w.sum(axis=2, keepdims=True), 1), np.maximum(w.sum(axis=1, keepdims=True), 1)

    def inside(m: np.ndarray) -> np.ndarray:
        m = np.where(seen, m, 0.0)
        for _ in range(rounds):
            m = (m - m.sum(axis=2, keepdims=True) / rows) * w
            shift = m.sum(axis=1, keepdims=True) / columns
            m = (m - shift) * w
            if np.abs(shift).max() < 1e-10:
                break
        return m

    a, b = inside(y), inside(d)
    total = (b * b).sum(axis=(1, 2))
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = (a * b).sum(axis=(1, 2)) / total
        scores = (b * (a - beta[:, None, None] * b)).sum(axis=2)
        k = y.shape[1]
        t = beta / (np.sqrt((scores**2).sum(axis=1) * k / max(k - 1, 1)) / total)
    return beta, t


def simulate_rollouts(r: Rollout, effect: float, icc: float, simulations: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and t of simulated rollouts with seasons, unit shifts and slopes, serial shocks, a policy, and drift between strata."""
    units, weeks, week = len(r.base), r.weeks, np.arange(r.weeks)
    strata = np.array(r.strata)
    starts = np.empty((simulations, units), dtype=int)
    for s in sorted(set(r.strata)):
        mine = np.flatnonzero(strata == s)
        starts[:, mine] = rng.permuted(np.tile(np.sort(np.array(r.starts)[mine]), (simulations, 1)), axis=1)
    since = week[None, None, :] - starts[:, :, None]
    active, seen = (since >= r.wash_in).astype(float), (since < 0) | (since >= r.wash_in)
    base = np.array(r.base)[None, :, None]
    shift = rng.normal(0, 1, (simulations, units, 1)) * np.sqrt(icc * base * (1 - base))
    slope = rng.normal(0, math.sqrt(icc) * 0.02, (simulations, units, 1))
    serial = np.empty((simulations, units, weeks))
    now = rng.normal(0, r.shock_sd, (simulations, units))
    for t in range(weeks):
        now = r.correlation * now + rng.normal(0, r.shock_sd * math.sqrt(1 - r.correlation**2), (simulations, units))
        serial[:, :, t] = now
    far = week / max(weeks - 1, 1)
    side = np.where(strata == min(r.strata), -0.5, 0.5)[None, :, None]
    p = base + effect * active + r.amplitude * np.sin(2 * np.pi * week / 52) + shift + serial + slope * (far - 0.5) + side * r.site_drift * far
    if r.policy_week is not None:
        p = p + r.policy_effect * (week >= r.policy_week)
    p = np.clip(p, 0.005, 0.995)
    n = np.maximum(10, np.array(r.cases))[None, :, None]
    events = np.clip(np.round(n * p + rng.normal(0, 1, p.shape) * np.sqrt(n * p * (1 - p))), 0, n)
    return two_way_many(events / n, active, seen)


def rollout_power(spark: SparkSession, design: Rollout, effects: Sequence[float], iccs: Sequence[float], simulations: int, seed: int, alpha: float = 0.05, fixed: float = 2.364624, chunk: int = 100) -> DataFrame:
    """effect, icc, simulations, critical, power, fixed_power: the share of simulated rollouts that find a reduction.

    The critical value of each icc is the alpha / 2 quantile of as many simulations without an effect, drawn apart;
    ``fixed_power`` is by the t of a table. Chunks of simulations have seeds of their own and are dealt to tasks.
    """
    chunks = -(-simulations // chunk)
    plan = [(kind, float(e), float(i), c) for i in iccs for kind, e in [("null", 0.0), *(("power", x) for x in effects)] for c in range(chunks)]
    rows = spark.createDataFrame(plan, "kind string, effect double, icc double, chunk int").repartition(min(len(plan), 200), "kind", "effect", "icc", "chunk")

    def run(batches):
        for pdf in batches:
            for kind, effect, icc, c in pdf.itertuples(index=False):
                rng = np.random.default_rng([seed, kind == "null", int(round(1e6 * (effect + 1))), int(round(1e6 * icc)), c])
                beta, t = simulate_rollouts(design, effect, icc, min(chunk, simulations - c * chunk), rng)
                ok = np.isfinite(beta) & np.isfinite(t)
                yield pd.DataFrame({"kind": kind, "effect": effect, "icc": icc, "estimate": beta[ok], "t": t[ok]})

    found = rows.mapInPandas(run, "kind string, effect double, icc double, estimate double, t double")
    # both readers take the same simulations: the null ones of an icc are gathered as its critical value beside each effect's
    each = found.groupBy("icc").agg(F.percentile(F.when(F.col("kind") == "null", F.col("t")), F.lit(alpha / 2)).alias("critical"))
    power = found.filter("kind = 'power'").join(F.broadcast(each), "icc")
    hit = lambda c: F.avg(((F.col("estimate") < 0) & (F.col("t") <= c)).cast("double"))
    return power.groupBy("effect", "icc", "critical").agg(F.count(F.lit(1)).alias("simulations"), hit(F.col("critical")).alias("power"), hit(F.lit(-fixed)).alias("fixed_power"))
