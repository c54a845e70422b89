"""Weekly monitoring of scored cases with revisions, and an append-only alert ledger.

The core is a pure function from accepted rows to metrics and alerts; the streaming wrapper
applies it batch by batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify_replays(batch: DataFrame, accepted: DataFrame, event_id: str, content: Column, arrival: Sequence[str]) -> DataFrame:
    """Rows of a batch as new, replayed (same id and content) or in conflict (same id, other content).

    What was accepted before counts first, then what arrived first in the batch, by ``arrival`` and then by content.
    """
    rows = batch.withColumn("_hash", content)
    by = Window.partitionBy(event_id).orderBy(*(F.col(c).asc_nulls_last() for c in arrival), "_hash")
    known = accepted.select(F.col(event_id).alias("_known"), F.col("content_hash").alias("_old"))
    rows = rows.withColumn("_first", F.first("_hash").over(by)).withColumn("_n", F.row_number().over(by))
    rows = rows.join(known, F.col(event_id) == F.col("_known"), "left")
    base = F.coalesce("_old", "_first")
    status = F.when(F.col("_hash") != base, "conflict").when(F.col("_old").isNotNull() | (F.col("_n") > 1), "replayed").otherwise("new")
    return rows.withColumn("status", status).withColumnRenamed("_hash", "content_hash").drop("_first", "_n", "_known", "_old")


def check_revisions(df: DataFrame, case: str, revision: str, event_id: str, corrects: str) -> DataFrame:
    """Whether each revision follows the one before by one and names it; the first must be 1 and name none."""
    by = Window.partitionBy(case).orderBy(revision, event_id)
    before, named = F.lag(revision).over(by), F.lag(event_id).over(by)
    ok = F.when(before.isNull(), (F.col(revision) == 1) & F.col(corrects).isNull()).otherwise((F.col(revision) == before + 1) & F.col(corrects).eqNullSafe(named))
    return df.withColumn("sequence_ok", ok)


def follow_on(rows: DataFrame, accepted: DataFrame, case: Sequence[str], revision: str, event_id: str, corrects: str, arrival: Sequence[str]) -> DataFrame:
    """``sequence_ok`` for new rows: they continue what was accepted of their case, revision by revision, each naming the one before.

    Of rows with the same revision the first arrival counts; after a gap or a wrong link nothing of the case is taken.
    """
    latest = active_revisions(accepted, case, revision, event_id).select(*(F.col(c).alias(f"_{c}") for c in case), F.col(revision).alias("_base"), F.col(event_id).alias("_base_id"))
    same = Window.partitionBy(*case, revision).orderBy(*(F.col(c).asc_nulls_last() for c in arrival), event_id)
    out = rows.withColumn("_twin", F.row_number().over(same)).join(latest, [F.col(c) == F.col(f"_{c}") for c in case], "left")
    # one row for each revision is the chain; twins hang behind and are never taken
    by = Window.partitionBy(*case, F.col("_twin") == 1).orderBy(revision)
    before, named = F.coalesce(F.lag(revision).over(by), "_base", F.lit(0)), F.coalesce(F.lag(event_id).over(by), "_base_id")
    out = out.withColumn("_ok", (F.col("_twin") == 1) & (F.col(revision) == before + 1) & F.col(corrects).eqNullSafe(named))
    return out.withColumn("sequence_ok", F.bool_and("_ok").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_twin", "_ok", "_base", "_base_id", *(f"_{c}" for c in case))


def active_revisions(df: DataFrame, case: Sequence[str], revision: str, event_id: str) -> DataFrame:
    """The latest revision of every case."""
    by = Window.partitionBy(*case).orderBy(F.col(revision).desc_nulls_last(), F.col(event_id).desc_nulls_last())
    return df.withColumn("_nth", F.row_number().over(by)).filter("_nth = 1").drop("_nth")


def late_and_backfilled(df: DataFrame, scored: str, arrived: str, order: str, late_days: int, by: Sequence[str] = (), seen: Column | None = None) -> DataFrame:
    """Late: arrived more than ``late_days`` after scoring. Backfilled: scored before something that had arrived already.

    The running maximum is over the order of arrival within ``by``; without it, over all rows. ``seen`` is the
    largest that came before all of these rows.
    """
    w = Window.partitionBy(*by).orderBy(arrived, order).rowsBetween(Window.unboundedPreceding, -1)
    late = F.col(arrived) > F.col(scored) + F.make_dt_interval(F.lit(late_days))
    so_far = F.max(scored).over(w) if seen is None else F.greatest(F.max(scored).over(w), seen)
    return df.withColumn("is_late", late).withColumn("is_backfill", F.coalesce(F.col(scored) < so_far, F.lit(False)))


def weekly_metrics(df: DataFrame, week: str, segment: Sequence[str], score: str, outcome: str, matured: Column, baseline_weeks: int, edges: Sequence[float], least_outcomes: int = 1) -> DataFrame:
    """Five measures of each week and segment against the segment's ``baseline_weeks`` observed weeks before it.

    Weeks are summed once; baselines are sums of those sums over a frame of rows, so each case is read once.
    """
    k = len(edges) - 1
    bin_ = score_bin(score, edges)
    known = matured & F.col(outcome).isNotNull()
    sums = df.withColumn("_bin", bin_).groupBy(week, *segment).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(known).alias("n_mature"), F.sum(F.when(known, F.col(outcome)).otherwise(0)).cast("double").alias("events"),
        F.sum(F.when(known, F.col(score)).otherwise(0.0)).alias("score_sum"), F.sum(F.when(known, (F.col(score) - F.col(outcome)) * (F.col(score) - F.col(outcome))).otherwise(0.0)).alias("squares"),
        *(F.count_if(F.col("_bin") == i).alias(f"b{i}") for i in range(k)),
    )
    return metrics_of_sums(sums, week, segment, k, baseline_weeks, least_outcomes)


def score_bin(score: str, edges: Sequence[float]) -> Column:
    return F.least(sum((F.col(score) >= e).cast("int") for e in edges[1:]), F.lit(len(edges) - 2))


def metrics_of_sums(sums: DataFrame, week: str, segment: Sequence[str], k: int, baseline_weeks: int, least_outcomes: int = 1) -> DataFrame:
    """The measures from weekly sums: n, n_mature, events, score_sum, squares and the counts b0, b1, ... of ``k`` score bins."""
    out = sums
    before = Window.partitionBy(*segment).orderBy(week).rowsBetween(-baseline_weeks, -1)
    past = lambda c: F.sum(c).over(before)
    out = out.withColumns({"baseline_n": F.count(F.lit(1)).over(before), "past_mature": past("n_mature"), "past_events": past("events")} | {f"p{i}": past(f"b{i}") for i in range(k)})
    total = sum(F.col(f"p{i}") for i in range(k))
    share = lambda c, t: (c + 0.5) / (t + 0.5 * k)
    psi = sum((share(F.col(f"b{i}"), F.col("n")) - share(F.col(f"p{i}"), total)) * F.ln(share(F.col(f"b{i}"), F.col("n")) / share(F.col(f"p{i}"), total)) for i in range(k))
    enough = F.col("n_mature") >= least_outcomes
    rate = F.when(enough, F.col("events") / F.col("n_mature"))
    ready = F.col("baseline_n") == baseline_weeks
    return out.select(
        week, *segment, "n", "n_mature", ready.alias("ready"), F.when(ready, psi).alias("score_psi"), F.when(enough, F.col("squares") / F.col("n_mature")).alias("brier_score"),
        F.when(enough, F.abs(F.col("score_sum") - F.col("events")) / F.col("n_mature")).alias("calibration_gap"), rate.alias("mature_outcome_rate"),
        F.when(ready & (F.col("past_mature") > 0), rate - F.col("past_events") / F.col("past_mature")).alias("mature_outcome_rate_delta"),
    )


def streaks(df: DataFrame, key: Sequence[str], day: str, breach: str, direction: str | None = None, step: int = 7) -> DataFrame:
    """Length of the run of breaches that ends at each row; a run breaks where a period is missing, isn't a breach or turns."""
    by = Window.partitionBy(*key).orderBy(day)
    broken = ~F.col(breach) | ~F.lag(breach, 1, False).over(by) | (F.datediff(F.col(day), F.lag(day).over(by)) != step)
    if direction:
        broken = broken | (F.col(direction) != F.lag(direction).over(by))
    rows = df.withColumn("_island", F.sum(F.coalesce(broken, F.lit(True)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    nth = F.row_number().over(Window.partitionBy(*key, "_island").orderBy(day))
    return rows.withColumn("streak", F.when(F.col(breach), nth).otherwise(0)).drop("_island")


def dispatch_alerts(df: DataFrame, period: str, bundle: Sequence[str], severity: str, name: str, budget: int) -> DataFrame:
    """The worst of each bundle leads it; the worst leaders of a period fire, up to its budget."""
    inside = Window.partitionBy(period, *bundle).orderBy(F.desc(severity), name)
    rows = df.withColumn("_lead", F.row_number().over(inside) == 1)
    rank = F.row_number().over(Window.partitionBy(period, "_lead").orderBy(F.desc(severity), name))
    state = F.when(~F.col("_lead"), "bundled").when(rank <= budget, "fired").otherwise("over_budget")
    return rows.withColumn("state", state).drop("_lead")


def ledger_changes(previous: DataFrame, desired: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to append so that the ledger moves from the previous to the desired alerts: a changed alert is superseded and fired again."""
    a, b = previous.select(F.col(key).alias("_k"), F.col(content).alias("_old")), desired.select(F.col(key).alias("_j"), F.col(content).alias("_new"))
    both = a.join(b, F.col("_k") == F.col("_j"), "full_outer").select(F.coalesce("_k", "_j").alias(key), "_old", "_new")
    fired = lambda c: F.struct(F.lit(2).alias("step"), F.lit("fired").alias("action"), c.alias(content))
    gone = lambda action: F.struct(F.lit(1).alias("step"), F.lit(action).alias("action"), F.col("_old").alias(content))
    none = F.array().cast(f"array<struct<step:int,action:string,{content}:string>>")
    rows = F.when(F.col("_old").isNull(), F.array(fired(F.col("_new")))).when(F.col("_new").isNull(), F.array(gone("retracted"))).when(F.col("_old") != F.col("_new"), F.array(gone("superseded"), fired(F.col("_new")))).otherwise(none)
    return both.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def seasonal_shrinkage(df: DataFrame, service: str, week: str, month: Column, n: str, events: str, prior: float = 50.0) -> DataFrame:
    """z of each service and week against a rate shrunk from strictly earlier weeks: service plus calendar month minus global.

    Rows are weekly sums. Frames are over week numbers, so rows of the same week never see each other.
    """
    rows = df.withColumn("_w", F.floor(F.datediff(F.col(week), F.lit("1970-01-05").cast("date")) / 7).cast("int")).withColumn("_m", month)
    before = lambda *by: Window.partitionBy(*by).orderBy("_w").rangeBetween(Window.unboundedPreceding, -1)
    weekly = rows.groupBy("_w").agg(F.sum(n).alias("gn"), F.sum(events).alias("ge"))  # one row for each week
    monthly = rows.groupBy("_m", "_w").agg(F.sum(n).alias("mn"), F.sum(events).alias("me"))
    weekly = weekly.select("_w", F.sum("gn").over(before()).alias("gn"), F.sum("ge").over(before()).alias("ge"))
    monthly = monthly.select("_m", "_w", F.sum("mn").over(before("_m")).alias("mn"), F.sum("me").over(before("_m")).alias("me"))
    rows = rows.withColumn("sn", F.sum(n).over(before(service))).withColumn("se", F.sum(events).over(before(service)))
    rows = rows.join(weekly, "_w").join(monthly, ["_m", "_w"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    g = F.col("ge") / F.col("gn")
    s, m = ((zero(f"{x}e") + prior * g) / (zero(f"{x}n") + prior) for x in "sm")
    expected = F.when(F.col("gn") > 0, F.least(F.greatest(s + m - g, F.lit(0.001)), F.lit(0.999)))
    z = (F.col(events) / F.col(n) - F.col("expected")) / F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col(n))
    return rows.withColumn("expected", expected).withColumn("z", z).drop("_w", "_m", "sn", "se", "gn", "ge", "mn", "me")


def provenance(df: DataFrame, metric: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """The inputs of each metric by number, bounds and a digest that doesn't depend on their order.

    The digest is the sum of 64-bit parts of the inputs' hashes, so a metric of any number of inputs is one
    aggregation; ``provenance_inputs`` lists them as rows.
    """
    text = F.sha2(F.to_json(F.struct(*inputs)).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(text, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_d{i}") for i in range(4)]
    out = df.groupBy(*metric).agg(F.count(F.lit(1)).alias("n_inputs"), F.min(inputs[0]).alias("first_input"), F.max(inputs[0]).alias("last_input"), *parts)
    digest = F.sha2(F.concat_ws("|", F.col("n_inputs").cast("string"), *(F.col(f"_d{i}").cast("string") for i in range(4))).cast("binary"), 256)
    return out.select(*metric, "n_inputs", "first_input", "last_input", digest.alias("input_digest"))


def provenance_inputs(df: DataFrame, metric: Sequence[str], inputs: Sequence[str], wanted: dict[str, object] | None = None) -> DataFrame:
    """The exact inputs of metrics, a row for each; of one metric with ``wanted``."""
    rows = equal_filters(df, wanted or {}, metric)
    return rows.select(*metric, *inputs)


def by_kind(df: DataFrame, kinds: dict[str, Column], metric: Sequence[str]) -> DataFrame:
    """The rows, once for each kind of metric that takes them, with ``kind`` and the ``metric_id`` of kind and keys; a condition that is null doesn't hold."""
    taken = F.filter(F.array(*(F.when(takes, F.lit(kind)) for kind, takes in kinds.items())), lambda k: k.isNotNull())
    rows = df.withColumn("kind", F.explode(taken))
    return rows.withColumn("metric_id", F.concat_ws("/", "kind", *(F.col(c).cast("string") for c in metric)))


def find_metric(df: DataFrame, kinds: dict[str, Column], metric: Sequence[str], inputs: Sequence[str], metric_id: str) -> DataFrame:
    """The exact inputs of one metric of whatever kind by its id; the parts of the id are filters on the keys, which reach the scan. No rows for a metric that isn't there."""
    kind, *values = metric_id.split("/")
    if kind not in kinds or len(values) != len(metric):
        return by_kind(df.filter(F.lit(False)), kinds, metric).select("metric_id", "kind", *inputs)
    rows = df.filter(kinds[kind])
    for key, value in zip(metric, values, strict=True):
        rows = rows.filter(F.col(key) == F.lit(value).try_cast(df.schema[key].dataType))
    return by_kind(rows, {kind: F.lit(True)}, metric).select("metric_id", "kind", *inputs)


def retract(ledger: DataFrame, alert_ids: DataFrame, key: str, content: str) -> DataFrame:
    """Rows to append so that listed alerts that stand are retracted; unknown and already retracted ones give none."""
    standing = active_alerts(ledger, key, content)
    return standing.join(alert_ids.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi").select(key, F.lit(1).alias("step"), F.lit("retracted").alias("action"), content)


def active_alerts(ledger: DataFrame, key: str, content: str, order: Sequence[str] = ("batch", "step")) -> DataFrame:
    """The alerts of an append-only ledger whose last change fired them."""
    last = F.max_by(F.struct("action", content), F.struct(*order)).alias("r")
    return ledger.groupBy(key).agg(last).filter("r.action = 'fired'").select(key, f"r.{content}")


def daily_budget(df: DataFrame, at: str, severity: str, name: str, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Alerts of each day within a budget, the most severe first."""
    rank = F.row_number().over(Window.partitionBy(*by, F.to_date(at)).orderBy(F.desc(severity), name))
    return df.withColumn("within_budget", rank <= budget)


def weekly_monitor(df: DataFrame, service: str, week: str, month: Column, n: str, events: str, alpha: float = 0.05, budget: int = 2, prior: float = 50.0) -> DataFrame:
    """A weekly monitor from weekly sums: z against the shrunk seasonal rate, p adjusted within each week for all
    services (Benjamini-Yekutieli), a breach kept only in its second week running in the same direction, and of those the
    most extreme of a week up to the budget.
    """
    from tidewake.functions.probability import two_sided_p

    rows = seasonal_shrinkage(df, service, week, month, n, events, prior).filter("z IS NOT NULL").withColumn("p", two_sided_p(F.col("z")))
    # tests of a week: harmonic factor and step-up minimum, one partition for each week
    by, all_ = Window.partitionBy(week), F.count(F.lit(1))
    m, rank = all_.over(by), F.row_number().over(by.orderBy("p", service))
    rows = rows.withColumn("_m", m).withColumn("_i", rank)
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_m").cast("int")), F.lit(0.0), lambda t, x: t + 1.0 / x)
    rows = rows.withColumn("_q", F.least(F.lit(1.0), F.col("p") * F.col("_m") * harmonic / F.col("_i")))
    rows = rows.withColumn("p_adjusted", F.min("_q").over(by.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0))).drop("_m", "_i", "_q")
    rows = rows.withColumn("direction", F.when(F.col("z") > 0, "up").otherwise("down")).withColumn("breach", F.col("p_adjusted") <= alpha)
    rows = streaks(rows, [service], week, "breach", "direction")
    rows = rows.withColumn("persists", F.col("streak") >= 2).withColumn("_z", F.abs("z"))
    nth = F.row_number().over(Window.partitionBy(week, "persists").orderBy(F.desc("_z"), service))
    state = F.when(~F.col("breach"), "quiet").when(~F.col("persists"), "watch").when(nth <= budget, "fired").otherwise("over_budget")
    return rows.withColumn("state", state).drop("_z")


def equal_filters(df: DataFrame, wanted: dict[str, object], allowed: Sequence[str]) -> DataFrame:
    """Equality filters from a request; names outside the allow-list are refused."""
    for name, value in wanted.items():
        if name not in allowed:
            raise ValueError(f"unknown filter {name!r}")
        df = df.filter(F.col(name) == F.lit(value))
    return df
