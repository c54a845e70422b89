"""Queries for planning and monitoring summaries, filters and side-table reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import monitor, planning
from tidewake.plans.inputs import EVENTS_SQL, SCORED_SQL, STUDY_SQL, event_log, query, scored_cases, study, table
from tidewake.plans.score_queries import rounded


@query("before_after_snapshot", f"""WITH {STUDY_SQL}, m AS (SELECT after, avg(y) AS high, avg(CAST(c_acctbal < 0 AS INTEGER)) AS negative, avg(CAST(status = 'P' AS INTEGER)) AS pending FROM study GROUP BY 1), l AS (SELECT after, unnest([{{'k': 'high_price', 'v': high}}, {{'k': 'negative_balance', 'v': negative}}, {{'k': 'pending', 'v': pending}}]) AS x FROM m)
SELECT x.k AS metric, round(any_value(x.v) FILTER (NOT after), 6) AS before, round(any_value(x.v) FILTER (after), 6) AS after, round(any_value(x.v) FILTER (after) - any_value(x.v) FILTER (NOT after), 6) AS shift FROM l GROUP BY 1""")
def before_after_snapshot(spark, sf_dir):
    measures = {"high_price": F.col("y"), "negative_balance": (F.col("c_acctbal") < 0).cast("int"), "pending": (F.col("status") == "P").cast("int")}
    return rounded(planning.before_after_snapshot(study(spark, sf_dir), F.col("after"), measures), "before", "after", "shift")


@query("leakage_categories", f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS s, min(ts) FILTER (event_type = 'purchase') AS p, min(ts) FILTER (event_type = 'error') AS e, min(ts) + INTERVAL 36 HOUR AS scored FROM ev GROUP BY 1)
SELECT user_id, CASE WHEN greatest(CASE WHEN p <= scored THEN p END, CASE WHEN e <= scored THEN e END, CASE WHEN s <= scored THEN s END) IS NULL THEN 'clean' WHEN p <= scored AND p = greatest(CASE WHEN p <= scored THEN p END, CASE WHEN e <= scored THEN e END, CASE WHEN s <= scored THEN s END) THEN 'after_purchase'
    WHEN e <= scored AND e = greatest(CASE WHEN p <= scored THEN p END, CASE WHEN e <= scored THEN e END, CASE WHEN s <= scored THEN s END) THEN 'after_error' ELSE 'after_signup' END AS category FROM c""")
def leakage_categories(spark, sf_dir):
    first = lambda k: F.min(F.when(F.col("event_type") == k, F.col("ts"))).alias(k)
    cases = event_log(spark, sf_dir).groupBy("user_id").agg(first("signup"), first("purchase"), first("error"), (F.min("ts") + F.expr("interval 36 hours")).alias("scored"))
    events = [("after_purchase", F.col("purchase")), ("after_error", F.col("error")), ("after_signup", F.col("signup"))]
    return cases.select("user_id", planning.leakage_category(F.col("scored"), events).alias("category"))


@query("component_plan", f"""WITH {SCORED_SQL} SELECT source, count(*) AS n, round(avg(y), 6) AS base_rate, CAST(greatest(10, round_even(count(*) / 2.0::DOUBLE, 0)) AS INTEGER) AS weekly FROM scored GROUP BY 1""")
def component_plan(spark, sf_dir):
    return rounded(planning.component_plan(scored_cases(spark, sf_dir), "source", "y", 2), "base_rate")


_GRID = [("small", 0.1, 0.2), ("small", 0.3, 0.7), ("small", 0.5, 0.9), ("large", -0.1, 0.85), ("large", 0.05, 0.5), ("none", 0.9, 0.1)]


@query("smallest_detectable", "SELECT design, min(abs(effect)) FILTER (power >= 0.8) AS smallest_effect, max(power) AS best_power FROM (VALUES " + ", ".join(f"('{d}', {e}::DOUBLE, {p}::DOUBLE)" for d, e, p in _GRID) + ") g(design, effect, power) GROUP BY 1")
def smallest_detectable(spark, sf_dir):
    grid = spark.createDataFrame(_GRID, "design string, effect double, power double")
    return planning.smallest_detectable(grid, "design", "effect", "power", 0.8)


@query("sequential_boundaries", "SELECT CAST(look AS INTEGER) AS look, look / 4.0::DOUBLE AS share, round(1.959963984540054::DOUBLE / sqrt(look / 4.0::DOUBLE), 6) AS boundary FROM range(1, 5) r(look)")
def sequential_boundaries(spark, sf_dir):
    looks = spark.range(1, 5).select(F.col("id").cast("int").alias("look"), (F.col("id") / F.lit(4.0)).alias("share"))
    return rounded(planning.sequential_boundaries(looks, "share", 1.959963984540054), "boundary")


@query("release_gates", f"""WITH {SCORED_SQL}, g AS (SELECT 'enough_cases' AS gate, count(*) >= 50 AS passed FROM scored UNION ALL SELECT 'both_classes', count(DISTINCT y) = 2 FROM scored UNION ALL SELECT 'scores_bounded', bool_and(score BETWEEN 0 AND 1) FROM scored)
SELECT gate, passed, bool_and(passed) OVER () AS all_pass FROM g""")
def release_gates(spark, sf_dir):
    one = scored_cases(spark, sf_dir).agg((F.count(F.lit(1)) >= 50).alias("a"), (F.count_distinct("y") == 2).alias("b"), F.bool_and(F.col("score").between(0, 1)).alias("c"))
    rows = F.array(*(F.struct(F.lit(n).alias("gate"), F.col(c).alias("passed")) for n, c in (("enough_cases", "a"), ("both_classes", "b"), ("scores_bounded", "c"))))
    return planning.gates(one.select(F.explode(rows).alias("g")).select("g.*"), "gate", "passed")


@query("outcome_rates", f"WITH {EVENTS_SQL}, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share, n / CAST(sum(n) OVER () AS DOUBLE) > 0.1 * 2 AS flagged FROM c")
def outcome_rates(spark, sf_dir):
    return rounded(planning.outcome_rates(event_log(spark, sf_dir), "event_type", 0.1, 2.0), "share")


@query("filtered_alerts", f"WITH {EVENTS_SQL} SELECT event_id, service, cents FROM ev WHERE site = 'A' AND event_type = 'error'")
def filtered_alerts(spark, sf_dir):
    return monitor.equal_filters(event_log(spark, sf_dir), {"site": "A", "event_type": "error"}, ["site", "service", "event_type"]).select("event_id", "service", "cents")


@query("parameterized_window", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def parameterized_window(spark, sf_dir):
    sql = "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_orderdate >= cast(:first AS timestamp_ntz) AND o_orderdate < cast(:past AS timestamp_ntz) GROUP BY 1"
    return spark.sql(sql, args={"first": "1996-01-01", "past": "1997-01-01"}, orders=table(spark, sf_dir, "orders"))


@query("top_orders", "SELECT o_orderkey, o_custkey, rank FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 25")
def top_orders(spark, sf_dir):
    from pyspark.sql import Window

    best = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)  # the feature is a top 25
    return best.select("o_orderkey", "o_custkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rank"))


_PSI_SQL = "sum(((q + 0.5) / (nq + 2.5) - (p + 0.5) / (np + 2.5)) * ln(((q + 0.5) / (nq + 2.5)) / ((p + 0.5) / (np + 2.5))))"


@query("monitor_snapshot", f"""WITH {EVENTS_SQL}, e AS (SELECT *, ts < TIMESTAMP '2024-01-16' AS ref, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100.0::DOUBLE)) AS score, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS y FROM ev),
bins AS (SELECT b, count(*) FILTER (ref) AS p, count(*) FILTER (NOT ref) AS q FROM (SELECT least(CAST(floor(score * 5) AS INTEGER), 4) AS b, ref FROM e) GROUP BY 1), psi AS (SELECT {_PSI_SQL} AS v FROM (SELECT coalesce(p, 0)::DOUBLE AS p, coalesce(q, 0)::DOUBLE AS q, (SELECT sum(p) FROM bins)::DOUBLE AS np, (SELECT sum(q) FROM bins)::DOUBLE AS nq FROM range(5) r LEFT JOIN bins ON b = r.range)),
share AS (SELECT max(abs(q / nq - p / np)) AS v FROM (SELECT count(*) FILTER (ref)::DOUBLE AS p, count(*) FILTER (NOT ref)::DOUBLE AS q, sum(count(*) FILTER (ref)) OVER () AS np, sum(count(*) FILTER (NOT ref)) OVER () AS nq FROM e GROUP BY event_type))
SELECT 'brier' AS metric, round(avg((score - y) * (score - y)) FILTER (ref), 6) AS before, round(avg((score - y) * (score - y)) FILTER (NOT ref), 6) AS after, round(avg((score - y) * (score - y)) FILTER (NOT ref) - avg((score - y) * (score - y)) FILTER (ref), 6) AS shift FROM e
UNION ALL SELECT 'null_rate', round(avg(CAST(json_extract(props, '$.k') IS NULL OR user_id % 7 = 0 AS INTEGER)) FILTER (ref), 6), round(avg(CAST(json_extract(props, '$.k') IS NULL OR user_id % 7 = 0 AS INTEGER)) FILTER (NOT ref), 6), round(avg(CAST(json_extract(props, '$.k') IS NULL OR user_id % 7 = 0 AS INTEGER)) FILTER (NOT ref) - avg(CAST(json_extract(props, '$.k') IS NULL OR user_id % 7 = 0 AS INTEGER)) FILTER (ref), 6) FROM e
UNION ALL SELECT 'score_psi', NULL, NULL, round(v, 6) FROM psi UNION ALL SELECT 'kind_share', NULL, NULL, round(v, 6) FROM share""")
def monitor_snapshot(spark, sf_dir):
    """Brier score, rate of missing features, PSI of scores and the largest shift of a category, before and after a date."""
    from tidewake.operators import drift

    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.lit(100.0)))
    y = F.col("event_type").isin("error", "purchase").cast("int")
    e = event_log(spark, sf_dir).withColumns({"score": score, "y": y, "feature": F.when(F.col("user_id") % 7 != 0, F.get_json_object("props", "$.k"))})
    ref = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    means = planning.before_after_snapshot(e, ~ref, {"brier": (F.col("score") - F.col("y")) * (F.col("score") - F.col("y")), "null_rate": F.col("feature").isNull()})
    none = F.lit(None).cast("double")
    psi = drift.psi_fixed(e, "score", ref, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).agg(F.sum("psi_part").alias("shift"))
    share = drift.share_shift(e, "event_type", ref).agg(F.max("largest").alias("shift"))
    extra = psi.select(F.lit("score_psi").alias("metric"), none.alias("before"), none.alias("after"), "shift").unionByName(share.select(F.lit("kind_share").alias("metric"), none.alias("before"), none.alias("after"), "shift"))
    return rounded(means.unionByName(extra), "before", "after", "shift")
