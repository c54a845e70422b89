"""Effects of a switch between two arms: weighted rates, differences in differences, sensitivity grids.

Each estimator is one aggregation to cells, then arithmetic on the cells.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.probability import clipped, e_value, exponential_rmst, shifted_odds, two_proportion_z
from tidewake.operators.classification import in_equal_bins
from tidewake.operators.ranks import positions


def poststratified_rate(df: DataFrame, y: str, strata: Sequence[str], by: str) -> DataFrame:
    """Rates of each group, weighted to the strata of all rows; a stratum that a group lacks gets the group's own rate."""
    cells = df.groupBy(by, *strata).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))
    sizes = cells.groupBy(*strata).agg(F.sum("n").alias("size"))
    overall = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_group"), F.avg(F.col(y).cast("double")).alias("crude"))
    grid = overall.crossJoin(sizes)  # groups x strata cells
    full = grid.join(cells.select(by, *strata, "rate"), [by, *strata], "left")
    weighted = F.sum(F.coalesce("rate", "crude") * F.col("size")) / F.sum("size")
    return full.groupBy(by).agg(F.first("n_group").alias("n"), F.first("crude").alias("crude"), weighted.alias("poststratified"))


def did_cells(df: DataFrame, y: Column, service: str, arm: Column, after: Column) -> DataFrame:
    """Rates in the four cells of each service, and their difference in differences where all four have rows."""
    cell = lambda a, t: F.avg(F.when((arm if a else ~arm) & (after if t else ~after), y))
    n = lambda a, t: F.count_if((arm if a else ~arm) & (after if t else ~after))
    out = df.groupBy(service).agg(
        F.count(F.lit(1)).alias("n"), cell(1, 1).alias("r11"), cell(1, 0).alias("r10"), cell(0, 1).alias("r01"), cell(0, 0).alias("r00"), F.least(n(1, 1), n(1, 0), n(0, 1), n(0, 0)).alias("smallest")
    )
    return out.filter("smallest > 0").withColumn("did", F.col("r11") - F.col("r10") - (F.col("r01") - F.col("r00")))


def equal_weight_effect(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count(F.lit(1)).alias("n_services"), F.avg("did").alias("effect"), F.stddev_samp("did").alias("sd"), F.sum(F.col("did") * F.col("n")).alias("_w"), F.sum("n").alias("n")).select("n_services", "n", "effect", "sd", (F.col("_w") / F.col("n")).alias("weighted_effect"))


def leave_one_out(cells: DataFrame, service: str) -> DataFrame:
    """The mean effect without each service, from totals."""
    all_ = Window.partitionBy()
    total, k = F.sum("did").over(all_), F.count(F.lit(1)).over(all_)
    return cells.select(service, "did", (total / k).alias("effect"), F.when(k > 1, (total - F.col("did")) / (k - 1)).alias("without"))


def ipw_means(df: DataFrame, value: Column, selected: Column, stratum: Sequence[str], by: str) -> DataFrame:
    """Means of the selected rows, weighted by the inverse of their stratum's selection rate."""
    rate = df.groupBy(*stratum).agg(F.avg(selected.cast("double")).alias("p"))
    rows = df.filter(selected).join(rate, list(stratum))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value.cast("double")).alias("plain"), (F.sum(value / F.col("p")) / F.sum(1 / F.col("p"))).alias("weighted"))


def parse_predicate(text: str, columns: dict[str, str]) -> Column:
    """``name:value``, ``name<number``, ``name>=number`` and ``weekend:name`` parts, joined by ``|`` (all must hold), over an allow-list of names."""
    out = F.lit(True)
    for part in text.split("|"):
        m = re.fullmatch(r"(\w+)(:|<|>=)(.+)", part)
        if not m:
            raise ValueError(f"not a predicate: {part!r}")
        name, op, value = m.groups()
        known = value if name == "weekend" else name
        if known not in columns:
            raise ValueError(f"unknown name {known!r}")
        column = F.col(columns[known])
        if name == "weekend":
            term = F.weekday(column) >= 5
        else:
            term = column == value if op == ":" else column < float(value) if op == "<" else column >= float(value)
        out = out & term
    return out


def before_after(df: DataFrame, y: str, after: str, comparisons: Sequence[tuple[str, Column]]) -> DataFrame:
    """Two-proportion tests of many overlapping subgroups.

    Rows are first counted by the truth of every comparison, as one bit set, so that the rows are read once
    and a few distinct sets are left, however many comparisons there are.
    """
    mask = F.concat(*(F.when(keep, "1").otherwise("0") for _, keep in comparisons))
    few = df.groupBy(mask.alias("_in"), F.col(after).alias("_after")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == 1).alias("_x"))
    names = F.array(*(F.struct(F.lit(i + 1).alias("i"), F.lit(name).alias("comparison")) for i, (name, _) in enumerate(comparisons)))
    cell = few.select("*", F.explode(names).alias("c")).withColumn("_hit", F.substr("_in", F.col("c.i"), F.lit(1)) == "1")
    side = lambda t, v: F.coalesce(F.sum(F.when(F.col("_hit") & (F.col("_after") if t else ~F.col("_after")), F.col(v))), F.lit(0))
    out = cell.groupBy("c.comparison").agg(side(1, "_n").alias("n1"), side(1, "_x").alias("x1"), side(0, "_n").alias("n0"), side(0, "_x").alias("x0"))
    ok = (F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("x1") + F.col("x0") > 0) & (F.col("x1") + F.col("x0") < F.col("n1") + F.col("n0"))
    return out.withColumn("diff", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("x1") / F.col("n1") - F.col("x0") / F.col("n0"))).withColumn("z", F.when(ok, two_proportion_z(F.col("x1"), F.col("n1"), F.col("x0"), F.col("n0"))))


def ranked_gain(df: DataFrame, score: str, tie: str, y: str, treated: Column, fractions: Sequence[float]) -> DataFrame:
    """Responses of treated and untreated cases among the best fractions by score, and the uplift that they show; fractions are read off in one pass."""
    rows = positions(df, score, tie, descending=True).withColumnRenamed("_position", "_rank").withColumnRenamed("_rows", "_n")
    aggs = []
    for i, f in enumerate(fractions):
        keep = F.col("_rank") <= F.ceil(F.lit(f) * F.col("_n"))
        aggs += [F.count_if(keep & treated).alias(f"nt{i}"), F.count_if(keep & ~treated).alias(f"nc{i}"), F.sum(F.when(keep & treated, F.col(y)).otherwise(0)).alias(f"yt{i}"), F.sum(F.when(keep & ~treated, F.col(y)).otherwise(0)).alias(f"yc{i}")]
    points = F.array(*(F.struct(F.lit(float(f)).alias("fraction"), *(F.col(f"{c}{i}").alias(c) for c in ("nt", "nc", "yt", "yc"))) for i, f in enumerate(fractions)))
    out = rows.agg(*aggs).select(F.explode(points).alias("p")).select("p.*")
    return out.withColumn("gain", F.col("yt") - F.when(F.col("nc") > 0, F.col("yc") * F.col("nt") / F.col("nc")).otherwise(0))


def trapezoid(df: DataFrame, x: str, y: str) -> DataFrame:
    """Area under consecutive points, from (0, 0)."""
    w = Window.orderBy(x)
    step = (F.col(x) - F.coalesce(F.lag(x).over(w), F.lit(0.0))) * (F.col(y) + F.coalesce(F.lag(y).over(w), F.lit(0.0))) / 2
    return df.withColumn("_a", step).agg(F.sum("_a").alias("area"))


def uplift_bins(df: DataFrame, score: str, tie: str, y: str, treated: Column, bins: int) -> DataFrame:
    rows = in_equal_bins(df, score, tie, bins)
    rate = lambda t: F.avg(F.when(t, F.col(y).cast("double")))
    return rows.groupBy("bin").agg(F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"), (rate(treated) - rate(~treated)).alias("uplift"))


def missingness_grid(cells: DataFrame, observed: str, rate: str, n: str, factors: Sequence[float]) -> DataFrame:
    """Rates if the odds among unobserved cases are multiplied, for each factor and cell."""
    grid = F.explode(F.array(*map(F.lit, map(float, factors))))
    out = cells.withColumn("odds_factor", grid)
    missing = F.col(n) - F.col(observed)
    return out.withColumn("shifted", (F.col(observed) * F.col(rate) + missing * shifted_odds(F.col(rate), F.col("odds_factor"))) / F.col(n)).withColumn("lowest", F.col(observed) * F.col(rate) / F.col(n)).withColumn("highest", (F.col(observed) * F.col(rate) + missing) / F.col(n))


def bias_grid(effect: DataFrame, ratio: str, prevalences: Sequence[float], associations: Sequence[float]) -> DataFrame:
    """A risk ratio divided by the bias of an unmeasured binary confounder, over grids of its strength and prevalence gap."""
    out = effect.withColumn("prevalence_1", F.explode(F.array(*map(F.lit, map(float, prevalences))))).withColumn("prevalence_0", F.explode(F.array(*map(F.lit, map(float, prevalences)))))
    out = out.withColumn("association", F.explode(F.array(*map(F.lit, map(float, associations)))))
    bias = (F.col("prevalence_1") * (F.col("association") - 1) + 1) / (F.col("prevalence_0") * (F.col("association") - 1) + 1)
    return out.withColumn("bias", bias).withColumn("adjusted", F.col(ratio) / F.col("bias"))


def bias_ledger(effects: DataFrame, effect: str, risk: str, ratios: Sequence[float], shares: Sequence[float], odds: Sequence[float]) -> DataFrame:
    """method, exposure, outcome, setting, estimate: what unmeasured bias would have to be, or would leave, from rows of services' effects and treated risks.

    ``e_value`` is the smallest joint risk ratio that explains the mean effect away; ``bias_factor`` moves the risk ratio
    to the null by a confounder of the given risk ratios with exposure and outcome; ``partial_r2`` moves the effect to the
    null by a confounder that explains a share of the services' variance; ``selection_odds`` shifts the odds of an effect
    read as a share above one half. A risk ratio without a positive counterfactual risk is null, and what rests on it.
    """
    one = effects.agg(F.avg(effect).alias("_e"), F.avg(risk).alias("_r"), F.stddev_samp(effect).alias("_sd"))
    one = one.withColumn("_rr", F.when((F.col("_r") > 0) & (F.col("_r") - F.col("_e") > 0), F.col("_r") / (F.col("_r") - F.col("_e"))))
    e, rr = F.col("_e"), F.col("_rr")

    def row(method: str, estimate: Column, exposure: float | None = None, outcome: float | None = None, setting: float | None = None) -> Column:
        known = {k: F.lit(v).cast("double").alias(k) for k, v in (("exposure", exposure), ("outcome", outcome), ("setting", setting))}
        return F.struct(F.lit(method).alias("method"), *known.values(), estimate.alias("estimate"))

    rows = [row("e_value", e_value(rr))]
    for a in ratios:
        for b in ratios:
            factor = a * b / (a + b - 1)
            rows.append(row("bias_factor", F.when(rr < 1, rr * factor).otherwise(rr / factor), a, b, factor))
    rows += [row("partial_r2", e - F.signum(e) * (share / (1 - share)) ** 0.5 * F.col("_sd"), setting=share) for share in shares]
    rows += [row("selection_odds", F.when(e.isNotNull(), shifted_odds(clipped(e + 0.5, 1e-6), o) - 0.5), setting=o) for o in odds]
    return one.select(F.inline(F.array(*rows)))


def endpoint_sensitivity(df: DataFrame, endpoints: dict[str, Column], service: str, arm: Column, after: Column) -> DataFrame:
    """The effect under each definition of the endpoint, over the cases that have it: equal weights, with inference, and weighted by treated cases after the switch.

    All definitions are sums of one pass over the cases; a definition counts the services in which all four cells have cases of it.
    """
    sides = {f"{a}{t}": (arm if a else ~arm) & (after if t else ~after) for a in (1, 0) for t in (1, 0)}
    values = df.select(service, *(c.alias(f"_c{k}") for k, c in sides.items()), *(y.cast("double").alias(f"_y{i}") for i, y in enumerate(endpoints.values())))
    sums = values.groupBy(service).agg(*(f(F.when(F.col(f"_c{k}"), F.col(f"_y{i}"))).alias(f"{n}{i}_{k}") for i in range(len(endpoints)) for k in sides for n, f in (("k", F.count), ("s", F.sum))), F.count(F.lit(1)).alias("_n"))
    mean = lambda i, k: F.try_divide(F.col(f"s{i}_{k}"), F.col(f"k{i}_{k}"))

    def row(i: int, name: str) -> Column:
        observed = sum((F.col(f"k{i}_{k}") for k in sides), F.lit(0))
        return F.struct(F.lit(name).alias("endpoint"), observed.alias("n"), (F.col("_n") - observed).alias("missing"), F.col(f"k{i}_11").alias("treated"), (mean(i, "11") - mean(i, "10") - (mean(i, "01") - mean(i, "00"))).alias("did"))

    cells = sums.select(F.inline(F.array(*(row(i, name) for i, name in enumerate(endpoints))))).filter("did IS NOT NULL")
    out = cells.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_services"), F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.avg("did").alias("effect"), (F.stddev_samp("did") / F.sqrt(F.count(F.lit(1)))).alias("se"),
        (F.sum(F.col("did") * F.col("treated")) / F.sum("treated")).alias("weighted_effect"),
    )
    return out


def subgroup_rates(df: DataFrame, y: str, cluster: str, dimensions: dict[str, Column], least_clusters: int, least_rows: int) -> DataFrame:
    """Rates of every level of every dimension; levels of few clusters or rows keep their counts and lose their rate."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("level")) for d, c in dimensions.items())))
    out = df.select(y, cluster, pairs.alias("g")).groupBy("g.dimension", "g.level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(cluster).alias("n_clusters"), F.avg(F.col(y).cast("double")).alias("rate"))
    hidden = (F.col("n_clusters") < least_clusters) | (F.col("n") < least_rows)
    return out.withColumn("suppressed", hidden).withColumn("rate", F.when(~hidden, F.col("rate")))


def dense_panel(df: DataFrame, week: Column, site: str, service: str, y: str) -> DataFrame:
    """Every week, site and service, empty cells filled by the service's own mean; then the mean over services."""
    cells = df.groupBy(week.alias("week"), site, service).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    fallback = df.groupBy(site, service).agg(F.avg(F.col(y).cast("double")).alias("fallback"))
    weeks = cells.select("week").distinct()
    grid = fallback.crossJoin(weeks)  # services x weeks
    full = grid.join(cells, ["week", site, service], "left")
    return full.groupBy("week", site).agg(F.avg(F.coalesce("rate", "fallback")).alias("rate"), F.count("rate").alias("n_observed"), F.count(F.lit(1)).alias("n_services"))


def did_by(df: DataFrame, y: Column, service: str, arm: Column, after: Column, keys: Sequence[str]) -> DataFrame:
    """Differences in differences of each service within each combination of ``keys``, where all four cells have rows."""
    cell = lambda a, t: (arm if a else ~arm) & (after if t else ~after)
    mean = lambda a, t: F.avg(F.when(cell(a, t), y))
    out = df.groupBy(*keys, service).agg(F.count(F.lit(1)).alias("n"), (mean(1, 1) - mean(1, 0) - (mean(0, 1) - mean(0, 0))).alias("did"))
    return out.filter("did IS NOT NULL")


def clustered_effect(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal-weight mean effect over services for each combination of ``keys``, with its standard error and t."""
    out = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_services"), F.sum("n").alias("n"), F.avg("did").alias("effect"), (F.stddev_samp("did") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumn("t", F.when(F.col("se") > 0, F.col("effect") / F.col("se")))


def subgroup_effects(df: DataFrame, y: Column, service: str, arm: Column, after: Column, dimensions: dict[str, Column], least_services: int, least_rows: int) -> DataFrame:
    """Effects of every level of every dimension with inference, and their difference from the dimension's other levels (the interaction); levels of few services or rows are suppressed."""
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("level")) for d, c in dimensions.items())))
    rows = df.withColumn("_y", y).withColumn("_arm", arm).withColumn("_after", after).select(service, "_y", "_arm", "_after", pairs.alias("g")).select(service, "_y", "_arm", "_after", "g.*")
    cells = did_by(rows, F.col("_y"), service, F.col("_arm"), F.col("_after"), ["dimension", "level"])
    out = clustered_effect(cells, ["dimension", "level"])
    w = Window.partitionBy("dimension")  # levels of a dimension
    k, total, variance = F.count("effect").over(w), F.sum("effect").over(w), F.sum(F.col("se") * F.col("se")).over(w)
    others = (total - F.col("effect")) / (k - 1)
    spread = F.sqrt(F.col("se") * F.col("se") + (variance - F.col("se") * F.col("se")) / ((k - 1) * (k - 1)))
    out = out.withColumn("interaction", F.when(k > 1, F.col("effect") - others)).withColumn("interaction_z", F.when((k > 1) & (spread > 0), F.col("interaction") / spread))
    hidden = (F.col("n_services") < least_services) | (F.col("n") < least_rows)
    return out.withColumn("suppressed", hidden).withColumns({c: F.when(~hidden, F.col(c)) for c in ("effect", "se", "t", "interaction", "interaction_z")})


def shifted_switches(df: DataFrame, y: Column, service: str, arm: Column, when: str, switch: str, shifts: Sequence[int], horizons: Sequence[int]) -> DataFrame:
    """The effect if the switch were days earlier or later, and with only the days of a horizon on either side; 0 stands for all days.

    Rows become sums of each service, arm and day first; only these cells are copied for each variant that takes them.
    """
    days = F.datediff(F.to_date(when), F.lit(switch).cast("date"))
    cells = df.select(service, y.alias("_y"), arm.alias("_arm"), days.alias("_d")).groupBy(service, "_arm", "_d").agg(F.count(F.lit(1)).alias("_n"), F.count("_y").alias("_k"), F.sum("_y").alias("_s"))
    variants = F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), F.lit(h).alias("horizon")) for s in shifts for h in horizons)))
    cells = cells.withColumn("v", variants).select(service, "_arm", "_n", "_k", "_s", (F.col("_d") - F.col("v.shift")).alias("_d"), "v.*")
    cells = cells.filter((F.col("horizon") == 0) | F.col("_d").between(-F.col("horizon"), F.col("horizon") - 1))
    side = lambda a, t: F.col("_arm").eqNullSafe(F.lit(bool(a))) & (F.col("_d") >= 0 if t else F.col("_d") < 0)
    # no cell, no mean: try_divide is null then, and so is the difference
    mean = lambda a, t: F.try_divide(F.sum(F.when(side(a, t), F.col("_s"))), F.sum(F.when(side(a, t), F.col("_k"))))
    did = cells.groupBy("shift", "horizon", service).agg(F.sum("_n").alias("n"), (mean(1, 1) - mean(1, 0) - (mean(0, 1) - mean(0, 0))).alias("did"))
    return clustered_effect(did.filter("did IS NOT NULL"), ["shift", "horizon"])


def placebo_switch(df: DataFrame, y: Column, service: str, arm: Column, when: str, switch: str, placebo: str) -> DataFrame:
    """The effect of a switch that wasn't: only rows before the real one, split at an earlier date."""
    before = df.filter(F.to_date(when) < F.lit(switch).cast("date"))
    return clustered_effect(did_by(before, y, service, arm, F.to_date(when) >= F.lit(placebo).cast("date"), []), [])


def missingness_effects(cells: DataFrame, odds_factors: Sequence[float], horizon: float) -> DataFrame:
    """Effects over all cells (arm, after, n, observed, rate) if the odds, or the hazards, among unobserved cases are multiplied in the treated cell after the switch.

    ``effect`` is of event rates, ``rmst_effect`` of restricted means of exponential times with these rates by the horizon.
    """
    grid = cells.withColumn("factor", F.explode(F.array(*map(F.lit, map(float, odds_factors)))))
    treated = F.col("arm") & F.col("after")
    unseen = F.when(treated, shifted_odds(F.col("rate"), F.col("factor"))).otherwise(F.col("rate"))
    share = F.col("observed") / F.col("n")
    rate = share * F.col("rate") + (1 - share) * unseen
    hazard = F.when(treated, F.col("factor")).otherwise(F.lit(1.0))
    mean = share * exponential_rmst(F.col("rate"), horizon) + (1 - share) * exponential_rmst(F.col("rate"), horizon, hazard)
    sign = F.when(F.col("arm") == F.col("after"), 1).otherwise(-1)
    return grid.withColumn("_r", rate).withColumn("_m", mean).groupBy("factor").agg(F.sum(sign * F.col("_r")).alias("effect"), F.sum(sign * F.col("_m")).alias("rmst_effect"))
