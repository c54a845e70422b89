"""Queries over the scored-case stream, its alerts and the service graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions.identifiers import micros, week_start
from tidewake.operators import graph, monitor
from tidewake.plans.inputs import EVENTS_SQL, event_log, query, table
from tidewake.plans.score_queries import p_sql, rounded

#: Events as revisions: a user's events of a week revise each other; the score is the value, an error the outcome.
REV_SQL = """rev AS (SELECT *, CAST(date_trunc('week', ts) AS DATE) AS week, row_number() OVER (PARTITION BY user_id, CAST(date_trunc('week', ts) AS DATE) ORDER BY ts, event_id) AS revision,
    lag(event_id) OVER (PARTITION BY user_id, CAST(date_trunc('week', ts) AS DATE) ORDER BY ts, event_id) AS corrects, least(1.0::DOUBLE, greatest(0.0::DOUBLE, value / 100.0::DOUBLE)) AS score, CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(event_type IN ('error', 'purchase') AS INTEGER) END AS outcome FROM ev)"""


def revisions(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("week", week_start("ts"))
    by = Window.partitionBy("user_id", "week").orderBy("ts", "event_id")
    outcome = F.when(F.col("event_type") != "signup", F.col("event_type").isin("error", "purchase").cast("int"))
    return e.withColumns({"revision": F.row_number().over(by), "corrects": F.lag("event_id").over(by), "score": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / F.lit(100.0))), "outcome": outcome})


@query("active_revisions", f"""WITH {EVENTS_SQL}, {REV_SQL} SELECT user_id, CAST(week AS VARCHAR) AS week, event_id, CAST(revision AS INTEGER) AS revision, corrects FROM (SELECT *, row_number() OVER (PARTITION BY user_id, week ORDER BY revision DESC, event_id DESC) AS nth FROM rev) WHERE nth = 1""")
def active_revisions(spark, sf_dir):
    return monitor.active_revisions(revisions(spark, sf_dir), ["user_id", "week"], "revision", "event_id").select("user_id", F.col("week").cast("string").alias("week"), "event_id", "revision", "corrects")


@query("revision_sequence", f"""WITH {EVENTS_SQL}, {REV_SQL}, kept AS (SELECT * REPLACE (revision + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS revision) FROM rev),
checked AS (SELECT *, lag(revision) OVER w AS r0, lag(event_id) OVER w AS e0 FROM kept WINDOW w AS (PARTITION BY user_id, week ORDER BY revision, event_id))
SELECT event_id, CASE WHEN r0 IS NULL THEN revision = 1 AND corrects IS NULL ELSE revision = r0 + 1 AND corrects IS NOT DISTINCT FROM e0 END AS sequence_ok FROM checked""")
def revision_sequence(spark, sf_dir):
    # some revisions skip a number
    rows = revisions(spark, sf_dir).withColumn("revision", F.col("revision") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).withColumn("case", F.struct("user_id", "week"))
    return monitor.check_revisions(rows, "case", "revision", "event_id", "corrects").select("event_id", "sequence_ok")


@query("revisions_follow_on", f"""WITH {EVENTS_SQL}, {REV_SQL}, base AS (SELECT user_id, week, max(revision) AS r0, arg_max(event_id, revision) AS e0 FROM rev WHERE revision <= 2 GROUP BY ALL),
fresh AS (SELECT event_id, user_id, week, ts, corrects, revision + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS revision FROM rev WHERE revision > 2),
twins AS (SELECT *, row_number() OVER (PARTITION BY user_id, week, revision ORDER BY ts, event_id) AS twin FROM fresh),
chain AS (SELECT t.*, revision = coalesce(lag(revision) OVER w, r0) + 1 AND corrects IS NOT DISTINCT FROM coalesce(lag(event_id) OVER w, e0) AS ok FROM twins t JOIN base USING (user_id, week) WHERE twin = 1 WINDOW w AS (PARTITION BY user_id, week ORDER BY revision))
SELECT event_id, bool_and(ok) OVER (PARTITION BY user_id, week ORDER BY revision ROWS UNBOUNDED PRECEDING) AS sequence_ok FROM chain UNION ALL SELECT event_id, false FROM twins WHERE twin > 1""")
def revisions_follow_on(spark, sf_dir):
    """What a batch continues: two revisions of each case are accepted, later ones come with gaps and with two of a number."""
    rows = revisions(spark, sf_dir)
    fresh = rows.filter("revision > 2").withColumn("revision", F.col("revision") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    found = monitor.follow_on(fresh, rows.filter("revision <= 2"), ["user_id", "week"], "revision", "event_id", "corrects", ["ts"])
    return found.select("event_id", "sequence_ok")


@query("replay_conflicts", f"""WITH {EVENTS_SQL}, old AS (SELECT event_id, sha256(event_type || '|' || cents) AS h FROM ev WHERE event_id % 3 = 0),
sent AS (SELECT event_id, event_type, cents, 0 AS try FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT event_id, event_type, cents, 1 FROM ev WHERE event_id % 10 = 0 UNION ALL SELECT event_id, event_type, cents + 5, 2 FROM ev WHERE event_id % 14 = 0),
batch AS (SELECT event_id, try, sha256(event_type || '|' || (cents + CASE WHEN event_id % 12 = 0 THEN 1 ELSE 0 END)) AS h FROM sent),
based AS (SELECT b.*, o.h AS old, coalesce(o.h, first_value(b.h) OVER (PARTITION BY b.event_id ORDER BY try)) AS base, row_number() OVER (PARTITION BY b.event_id ORDER BY try) AS n FROM batch b LEFT JOIN old o ON o.event_id = b.event_id)
SELECT event_id, try, CASE WHEN h <> base THEN 'conflict' WHEN old IS NOT NULL OR n > 1 THEN 'replayed' ELSE 'new' END AS status FROM based""")
def replay_conflicts(spark, sf_dir):
    e = event_log(spark, sf_dir)
    content = F.sha2(F.concat_ws("|", "event_type", F.col("cents").cast("string")).cast("binary"), 256)
    accepted = e.filter("event_id % 3 = 0").select("event_id", content.alias("content_hash"))
    # events are sent, sent again as they are, and sent again with another amount
    times = F.filter(F.array(F.when(F.col("event_id") % 2 == 0, 0), F.when(F.col("event_id") % 10 == 0, 1), F.when(F.col("event_id") % 14 == 0, 2)), lambda x: x.isNotNull())
    batch = e.withColumn("try", F.explode(times)).withColumn("cents", F.col("cents") + F.when(F.col("event_id") % 12 == 0, 1).otherwise(0) + F.when(F.col("try") == 2, 5).otherwise(0))
    return monitor.classify_replays(batch, accepted, "event_id", content, ["try"]).select("event_id", "try", "status")


@query("backfill_late_flags", f"""WITH {EVENTS_SQL}, {REV_SQL} SELECT event_id, ingest_ts > ts + INTERVAL 9 DAY AS is_late, coalesce(ts < max(ts) OVER (PARTITION BY site, service ORDER BY ingest_ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_backfill FROM rev""")
def backfill_late_flags(spark, sf_dir):
    return monitor.late_and_backfilled(event_log(spark, sf_dir), "ts", "ingest_ts", "event_id", 9, ["site", "service"]).select("event_id", "is_late", "is_backfill")


_EDGES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
_B = range(5)
_SHARE = lambda c, t: f"(({c} + 0.5::DOUBLE) / ({t} + 2.5::DOUBLE))"
_PAST = "(" + " + ".join(f"p{i}" for i in _B) + ")"
WEEKLY_SQL = f"""wk AS (SELECT week, site, service, count(*) AS n, count(*) FILTER (mature AND outcome IS NOT NULL) AS n_mature, CAST(coalesce(sum(outcome) FILTER (mature), 0) AS DOUBLE) AS events, coalesce(sum(score) FILTER (mature AND outcome IS NOT NULL), 0) AS score_sum,
    coalesce(sum((score - outcome) * (score - outcome)) FILTER (mature), 0) AS squares, {', '.join(f'count(*) FILTER (bin = {i}) AS b{i}' for i in _B)}
    FROM (SELECT *, least(CAST(score >= 0.2 AS INTEGER) + CAST(score >= 0.4 AS INTEGER) + CAST(score >= 0.6 AS INTEGER) + CAST(score >= 0.8 AS INTEGER) + CAST(score >= 1.0 AS INTEGER), 4) AS bin, ingest_ts + INTERVAL 7 DAY <= (SELECT max(ingest_ts) FROM ev) AS mature FROM rev) GROUP BY 1, 2, 3),
based AS (SELECT *, count(*) OVER w AS baseline_n, sum(n_mature) OVER w AS past_mature, sum(events) OVER w AS past_events, {', '.join(f'CAST(sum(b{i}) OVER w AS BIGINT) AS p{i}' for i in _B)} FROM wk WINDOW w AS (PARTITION BY site, service ORDER BY week ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)),
weekly AS (SELECT CAST(week AS VARCHAR) AS week, site, service, n, n_mature, baseline_n = 2 AS ready,
    CASE WHEN baseline_n = 2 THEN {' + '.join(f"({_SHARE(f'b{i}', 'n')} - {_SHARE(f'p{i}', _PAST)}) * ln({_SHARE(f'b{i}', 'n')} / {_SHARE(f'p{i}', _PAST)})" for i in _B)} END AS score_psi,
    CASE WHEN n_mature >= 1 THEN squares / n_mature END AS brier_score, CASE WHEN n_mature >= 1 THEN abs(score_sum - events) / n_mature END AS calibration_gap, CASE WHEN n_mature >= 1 THEN events / n_mature END AS mature_outcome_rate,
    CASE WHEN baseline_n = 2 AND past_mature > 0 AND n_mature >= 1 THEN events / n_mature - past_events / CAST(past_mature AS DOUBLE) END AS mature_outcome_rate_delta FROM based)"""
_METRICS = ("score_psi", "brier_score", "calibration_gap", "mature_outcome_rate", "mature_outcome_rate_delta")


def weekly(spark, sf_dir):
    rows = revisions(spark, sf_dir)
    end = event_log(spark, sf_dir).agg(F.max("ingest_ts").alias("watermark"))  # one row
    rows = rows.crossJoin(F.broadcast(end))
    matured = F.col("ingest_ts") + F.expr("interval 7 days") <= F.col("watermark")
    return monitor.weekly_metrics(rows, "week", ["site", "service"], "score", "outcome", matured, 2, _EDGES)


@query("weekly_metrics", f"WITH {EVENTS_SQL}, {REV_SQL}, {WEEKLY_SQL} SELECT week, site, service, n, n_mature, ready, {', '.join(f'round({m}, 6) AS {m}' for m in _METRICS)} FROM weekly")
def weekly_metrics(spark, sf_dir):
    return rounded(weekly(spark, sf_dir), *_METRICS).withColumn("week", F.col("week").cast("string"))


_BREACH_SQL = "breaches AS (SELECT week, site, service, coalesce(mature_outcome_rate >= 0.4, false) AS breach, CASE WHEN mature_outcome_rate_delta > 0 THEN 'up' ELSE 'down' END AS direction, coalesce(mature_outcome_rate, 0) AS severity FROM weekly)"


def _breaches(spark, sf_dir):
    rate = F.col("mature_outcome_rate")
    return weekly(spark, sf_dir).select("week", "site", "service", F.coalesce(rate >= 0.4, F.lit(False)).alias("breach"), F.when(F.col("mature_outcome_rate_delta") > 0, "up").otherwise("down").alias("direction"), F.coalesce(rate, F.lit(0.0)).alias("severity"))


@query("persistence_streak", f"""WITH {EVENTS_SQL}, {REV_SQL}, {WEEKLY_SQL}, {_BREACH_SQL},
b AS (SELECT *, CASE WHEN breach AND lag(breach, 1, false) OVER w AND date_diff('day', CAST(lag(week) OVER w AS DATE), CAST(week AS DATE)) = 7 THEN 0 ELSE 1 END AS br FROM breaches WINDOW w AS (PARTITION BY site, service ORDER BY week)),
i AS (SELECT *, sum(br) OVER (PARTITION BY site, service ORDER BY week) AS island FROM b)
SELECT week, site, service, breach, CASE WHEN breach THEN row_number() OVER (PARTITION BY site, service, island ORDER BY week) ELSE 0 END AS streak FROM i""")
def persistence_streak(spark, sf_dir):
    out = monitor.streaks(_breaches(spark, sf_dir), ["site", "service"], "week", "breach")
    return out.select(F.col("week").cast("string").alias("week"), "site", "service", "breach", F.col("streak").cast("long").alias("streak"))


@query("alert_budget_bundles", f"""WITH {EVENTS_SQL}, {REV_SQL}, {WEEKLY_SQL}, {_BREACH_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY week, site ORDER BY severity DESC, service) = 1 AS lead FROM breaches WHERE severity > 0.2),
r AS (SELECT *, row_number() OVER (PARTITION BY week, lead ORDER BY severity DESC, service) AS rank FROM l)
SELECT week, site, service, round(severity, 6) AS severity, CASE WHEN NOT lead THEN 'bundled' WHEN rank <= 1 THEN 'fired' ELSE 'over_budget' END AS state FROM r""")
def alert_budget_bundles(spark, sf_dir):
    rows = _breaches(spark, sf_dir).filter("severity > 0.2").drop("breach", "direction")
    return rounded(monitor.dispatch_alerts(rows, "week", ["site"], "severity", "service", 1), "severity").withColumn("week", F.col("week").cast("string"))


@query("alert_ledger_diff", f"""WITH {EVENTS_SQL}, a AS (SELECT service AS alert_id, sha256(CAST(count(*) AS VARCHAR)) AS alert_hash FROM ev WHERE event_type IN ('error', 'view') AND ts < TIMESTAMP '2024-01-20' GROUP BY 1 HAVING service <> 'A-0'),
b AS (SELECT service AS alert_id, sha256(CAST(count(*) FILTER (service <> 'B-1' OR ts < TIMESTAMP '2024-01-20') AS VARCHAR)) AS alert_hash FROM ev WHERE event_type IN ('error', 'view') GROUP BY 1 HAVING service <> 'B-5'),
f AS (SELECT coalesce(a.alert_id, b.alert_id) AS alert_id, a.alert_hash AS o, b.alert_hash AS n FROM a FULL OUTER JOIN b ON a.alert_id = b.alert_id)
SELECT alert_id, 2 AS step, 'fired' AS action, n AS alert_hash FROM f WHERE n IS NOT NULL AND (o IS NULL OR o <> n) UNION ALL SELECT alert_id, 1, CASE WHEN n IS NULL THEN 'retracted' ELSE 'superseded' END, o FROM f WHERE o IS NOT NULL AND (n IS NULL OR o <> n)""")
def alert_ledger_diff(spark, sf_dir):
    e = event_log(spark, sf_dir).filter("event_type IN ('error', 'view')")
    early = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    snapshot = lambda df, n: df.groupBy(F.col("service").alias("alert_id")).agg(F.sha2(n.cast("string").cast("binary"), 256).alias("alert_hash"))
    previous = snapshot(e.filter(early & (F.col("service") != "A-0")), F.count(F.lit(1)))
    desired = snapshot(e.filter("service <> 'B-5'"), F.count_if((F.col("service") != "B-1") | early))
    return monitor.ledger_changes(previous, desired, "alert_id", "alert_hash")


@query("seasonal_shrinkage_monitor", f"""WITH {EVENTS_SQL}, w AS (SELECT service, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM ev GROUP BY 1, 2), m AS (SELECT *, month(week) AS mo FROM w),
s AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS sn, sum(e) OVER (PARTITION BY service ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS se,
    sum(n) OVER (PARTITION BY mo ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS mn, sum(e) OVER (PARTITION BY mo ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS me,
    sum(n) OVER (ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS gn, sum(e) OVER (ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS ge FROM m),
x AS (SELECT *, CAST(ge AS DOUBLE) / CAST(gn AS DOUBLE) AS g FROM s), y AS (SELECT *, least(greatest((coalesce(se, 0) + 50 * g) / CAST(coalesce(sn, 0) + 50 AS DOUBLE) + (coalesce(me, 0) + 50 * g) / CAST(coalesce(mn, 0) + 50 AS DOUBLE) - g, 0.001), 0.999) AS expected FROM x WHERE g IS NOT NULL)
SELECT service, CAST(week AS VARCHAR) AS week, n, e, round(expected, 6) AS expected, round((e / n - expected) / sqrt(expected * (1 - expected) / n), 6) AS z FROM y""")
def seasonal_shrinkage_monitor(spark, sf_dir):
    w = event_log(spark, sf_dir).groupBy("service", week_start("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    out = monitor.seasonal_shrinkage(w, "service", "week", F.month("week"), "n", "e").filter("expected IS NOT NULL AND z IS NOT NULL")
    return rounded(out, "expected", "z").withColumn("week", F.col("week").cast("string"))


@query("weekly_monitor", f"""WITH {EVENTS_SQL}, w AS (SELECT service, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, count(*) FILTER (event_type IN ('error', 'signup')) AS e FROM ev GROUP BY 1, 2), m AS (SELECT *, month(week) AS mo FROM w),
s AS (SELECT *, {', '.join(f"sum({c}) OVER ({p} ORDER BY week RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS {a}{c}" for a, p in (('s', 'PARTITION BY service'), ('m', 'PARTITION BY mo'), ('g', '')) for c in ('n', 'e'))} FROM m),
x AS (SELECT *, CAST(ge AS DOUBLE) / CAST(gn AS DOUBLE) AS g FROM s), y AS (SELECT *, least(greatest((coalesce(se, 0) + 50 * g) / CAST(coalesce(sn, 0) + 50 AS DOUBLE) + (coalesce(me, 0) + 50 * g) / CAST(coalesce(mn, 0) + 50 AS DOUBLE) - g, 0.001), 0.999) AS expected FROM x WHERE g IS NOT NULL),
z AS (SELECT service, week, n, e, (e / n - expected) / sqrt(expected * (1 - expected) / n) AS z FROM y), p AS (SELECT *, {p_sql('z')} AS p FROM z), r AS (SELECT *, count(*) OVER (PARTITION BY week) AS m, row_number() OVER (PARTITION BY week ORDER BY p, service) AS i FROM p),
a AS (SELECT *, min(least(1.0, p * m * list_sum(list_transform(range(1, m + 1), lambda k: 1.0::DOUBLE / k)) / i)) OVER (PARTITION BY week ORDER BY i DESC) AS pa, CASE WHEN z > 0 THEN 'up' ELSE 'down' END AS direction FROM r),
b AS (SELECT *, pa <= 0.9 AS breach FROM a), c AS (SELECT *, breach AND coalesce(lag(breach) OVER w, false) AND lag(direction) OVER w = direction AND date_diff('day', lag(week) OVER w, week) = 7 AS persists FROM b WINDOW w AS (PARTITION BY service ORDER BY week)),
d AS (SELECT *, row_number() OVER (PARTITION BY week, coalesce(persists, false) ORDER BY abs(z) DESC, service) AS nth FROM c)
SELECT service, CAST(week AS VARCHAR) AS week, n, e, round(z, 6) AS z, round(pa, 5) AS p_adjusted, direction, CASE WHEN NOT breach THEN 'quiet' WHEN NOT coalesce(persists, false) THEN 'watch' WHEN nth <= 1 THEN 'fired' ELSE 'over_budget' END AS state FROM d""")
def weekly_monitor(spark, sf_dir):
    w = event_log(spark, sf_dir).groupBy("service", week_start("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("error", "signup")).alias("e"))
    out = monitor.weekly_monitor(w, "service", "week", F.month("week"), "n", "e", alpha=0.9, budget=1)
    return out.select("service", F.col("week").cast("string").alias("week"), "n", "e", F.round("z", 6).alias("z"), F.round("p_adjusted", 5).alias("p_adjusted"), "direction", "state")


@query("ledger_state", """WITH c AS (SELECT user_id AS alert_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, event_id FROM events)
SELECT alert_id, event_id AS batch FROM c WHERE back = 1 AND event_type IN ('view', 'click', 'purchase')""")
def ledger_state(spark, sf_dir):
    """Events as changes of one alert for each user: errors and signups retract it, all others fire it."""
    e = table(spark, sf_dir, "events")
    ledger = e.select(F.col("user_id").alias("alert_id"), F.when(F.col("event_type").isin("error", "signup"), "retracted").otherwise("fired").alias("action"), F.col("event_id").cast("string").alias("alert_hash"), F.col("event_id").alias("batch"), F.lit(1).alias("step"))
    return monitor.active_alerts(ledger, "alert_id", "alert_hash").select("alert_id", F.col("alert_hash").cast("long").alias("batch"))


@query("daily_alert_budget", f"""WITH {EVENTS_SQL} SELECT event_id, row_number() OVER (PARTITION BY site, CAST(ts AS DATE) ORDER BY cents DESC, event_id) <= 5 AS within_budget FROM ev WHERE event_type = 'error'""")
def daily_alert_budget(spark, sf_dir):
    rows = event_log(spark, sf_dir).filter("event_type = 'error'")
    return monitor.daily_budget(rows, "ts", "cents", "event_id", 5, ["site"]).select("event_id", "within_budget")


@query("metric_provenance", f"""WITH {EVENTS_SQL}, {REV_SQL}, x AS (SELECT week, service, event_id, sha256('{{"event_id":' || event_id || ',"revision":' || revision || '}}') AS h FROM rev),
s AS (SELECT week, service, count(*) AS n_inputs, min(event_id) AS first_input, max(event_id) AS last_input, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS d{i}" for i in range(4))} FROM x GROUP BY 1, 2)
SELECT CAST(week AS VARCHAR) AS week, service, n_inputs, first_input, last_input, sha256(concat_ws('|', n_inputs, d0, d1, d2, d3)) AS input_digest FROM s""")
def metric_provenance(spark, sf_dir):
    return monitor.provenance(revisions(spark, sf_dir), ["week", "service"], ["event_id", "revision"]).withColumn("week", F.col("week").cast("string"))


@query("provenance_lookup", f"""WITH {EVENTS_SQL}, {REV_SQL} SELECT CAST(week AS VARCHAR) AS week, service, event_id, CAST(revision AS INTEGER) AS revision FROM rev WHERE service = 'A-2'""")
def provenance_lookup(spark, sf_dir):
    return monitor.provenance_inputs(revisions(spark, sf_dir), ["week", "service"], ["event_id", "revision"], {"service": "A-2"}).withColumn("week", F.col("week").cast("string"))


_KINDS = {"drift": "score IS NOT NULL", "calibration": "score IS NOT NULL AND outcome IS NOT NULL", "outcome": "outcome = 1 OR outcome = 0"}
_KIND_SQL = " UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM rev WHERE {c}" for k, c in _KINDS.items())


@query("provenance_kinds", f"""WITH {EVENTS_SQL}, {REV_SQL}, k AS ({_KIND_SQL}), x AS (SELECT kind || '/' || CAST(week AS VARCHAR) || '/' || service AS metric_id, kind, event_id, sha256('{{"event_id":' || event_id || ',"revision":' || revision || '}}') AS h FROM k),
s AS (SELECT metric_id, kind, count(*) AS n_inputs, min(event_id) AS first_input, max(event_id) AS last_input, {', '.join(f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR) AS d{i}" for i in range(4))} FROM x GROUP BY 1, 2)
SELECT metric_id, kind, n_inputs, first_input, last_input, sha256(concat_ws('|', n_inputs, d0, d1, d2, d3)) AS input_digest FROM s""")
def provenance_kinds(spark, sf_dir):
    """What every drift, calibration and outcome metric rests on, by its id, in one aggregation."""
    rows = monitor.by_kind(revisions(spark, sf_dir), {k: F.expr(c) for k, c in _KINDS.items()}, ["week", "service"])
    return monitor.provenance(rows, ["metric_id", "kind"], ["event_id", "revision"])


@query("provenance_by_id", f"""WITH {EVENTS_SQL}, {REV_SQL}, k AS ({_KIND_SQL}) SELECT metric_id, kind, event_id, CAST(revision AS INTEGER) AS revision FROM (SELECT *, kind || '/' || CAST(week AS VARCHAR) || '/' || service AS metric_id FROM k) WHERE metric_id = 'calibration/2024-01-15/A-2'""")
def provenance_by_id(spark, sf_dir):
    return monitor.find_metric(revisions(spark, sf_dir), {k: F.expr(c) for k, c in _KINDS.items()}, ["week", "service"], ["event_id", "revision"], "calibration/2024-01-15/A-2")


@query("last_write_wins", f"""WITH {EVENTS_SQL} SELECT user_id, first(event_type ORDER BY ingest_ts DESC, event_id DESC) AS event_type, first(cents ORDER BY ingest_ts DESC, event_id DESC) AS cents, epoch_us(max(ingest_ts)) AS arrived_us FROM ev GROUP BY 1""")
def last_write_wins(spark, sf_dir):
    latest = F.max_by(F.struct("event_type", "cents"), F.struct("ingest_ts", "event_id"))
    return event_log(spark, sf_dir).groupBy("user_id").agg(latest.alias("r"), micros(F.max("ingest_ts")).alias("arrived_us")).select("user_id", "r.*", "arrived_us")


#: Days on which the waves of ``merge_by_version`` end.
_WAVES = ("2024-01-12", "2024-01-25")


@query("merge_by_version", f"""WITH {EVENTS_SQL}, last AS (SELECT user_id, first(event_type ORDER BY ingest_ts DESC, event_id DESC) AS event_type, first(cents ORDER BY ingest_ts DESC, event_id DESC) AS cents FROM ev GROUP BY 1)
SELECT * FROM last WHERE user_id NOT IN (SELECT user_id FROM ev WHERE event_type = 'error' AND event_id % 50 = 0 AND ingest_ts >= TIMESTAMP '{_WAVES[1]}')""")
def merge_by_version(spark, sf_dir):
    """Three waves of arrivals merged into a versioned table, each into the buckets of its users; the last one takes some users out."""
    from tidewake.operators.graph import shared_dir
    from tidewake.sources.versioned import Snapshot, VersionedTable

    table_, at = VersionedTable(spark, f"{shared_dir(spark)}/merge-{uuid.uuid4().hex}", ["user_id"], "user_id bigint, event_type string, cents bigint"), Snapshot()
    log, day = event_log(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("bigint")), lambda d: F.lit(d).cast("timestamp_ntz")
    bounds = [F.lit(True), *(F.col("ingest_ts") >= day(d) for d in _WAVES)]
    for i, begins in enumerate(bounds):
        wave = log.filter(begins & (~bounds[i + 1] if i + 1 < len(bounds) else F.lit(True)))
        latest = wave.groupBy("user_id").agg(F.max_by(F.struct("event_type", "cents"), F.struct("ingest_ts", "event_id")).alias("r")).select("user_id", "r.*")
        gone = wave.filter("event_type = 'error' AND event_id % 50 = 0").select("user_id").distinct() if i + 1 == len(bounds) else None
        at = table_.commit(table_.merge(at, latest if gone is None else latest.join(gone, "user_id", "left_anti"), gone))
    return table_.read(at)


_GRAPH_SQL = """links AS (SELECT DISTINCT s_nationkey AS node, l_partkey AS via FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), stars AS (SELECT via, min(node) AS a FROM links GROUP BY 1),
edges AS (SELECT a, node AS b FROM links JOIN stars USING (via) UNION SELECT node, a FROM links JOIN stars USING (via)),
reach AS (SELECT DISTINCT node, node AS other FROM links UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""


def _labels(spark, sf_dir):
    li, s = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    links = li.join(s, li.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("node"), F.col("l_partkey").alias("via")).distinct()
    return graph.components(links.select("node"), graph.shared_edges(links, "node", "via"), "node")


@query("components", f"WITH RECURSIVE {_GRAPH_SQL} SELECT node, root FROM roots")
def components(spark, sf_dir):
    return _labels(spark, sf_dir)


@query("component_listing", f"""WITH RECURSIVE {_GRAPH_SQL} SELECT 'IC-' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), greatest(2, length(CAST(count(*) OVER () AS VARCHAR)))::INT, '0') AS component, root, array_to_string(list_sort(list(CAST(node AS VARCHAR))), ',') AS members, count(*) AS n FROM roots GROUP BY root""")
def component_listing(spark, sf_dir):
    return graph.component_listing(_labels(spark, sf_dir), "node")


@query("component_members", f"""WITH RECURSIVE {_GRAPH_SQL}, ids AS (SELECT root, 'IC-' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), greatest(2, length(CAST(count(*) OVER () AS VARCHAR)))::INT, '0') AS component FROM roots GROUP BY root)
SELECT component, root, node FROM roots JOIN ids USING (root)""")
def component_members(spark, sf_dir):
    return graph.component_members(_labels(spark, sf_dir).checkpoint(), "node")


_TWO_SQL = """near AS (SELECT DISTINCT s_suppkey AS node, 'n' || s_nationkey AS via FROM supplier WHERE s_acctbal > 5000 UNION SELECT DISTINCT l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R'), hubs AS (SELECT via, min(node) AS a FROM near GROUP BY 1),
links AS (SELECT a, node AS b FROM near JOIN hubs USING (via) UNION SELECT node, a FROM near JOIN hubs USING (via)), reach AS (SELECT DISTINCT node, node AS other FROM near UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""


def _two_kinds(spark, sf_dir):
    """Suppliers linked by a nation (those of large balances) or by a part (full, returned lines)."""
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    by_nation = s.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("via"))
    by_part = li.filter("l_quantity = 50 AND l_returnflag = 'R'").select(F.col("l_suppkey").alias("node"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("via"))
    near = by_nation.unionByName(by_part).distinct()
    return graph.components(near.select("node"), graph.shared_edges(near, "node", "via"), "node")


@query("components_two_kinds", f"WITH RECURSIVE {_TWO_SQL} SELECT node, root, sha256('IC|' || root) AS component_id FROM roots")
def components_two_kinds(spark, sf_dir):
    return _two_kinds(spark, sf_dir).withColumn("component_id", F.sha2(F.concat(F.lit("IC|"), F.col("root").cast("string")).cast("binary"), 256))


@query("component_sequences", f"""WITH RECURSIVE {_TWO_SQL}, c AS (SELECT root, count(*) AS n, root % 2 AS stratum FROM roots GROUP BY 1)
SELECT root, n, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed-7|' || root), root) - 1) % 4 + 1 AS INTEGER) AS sequence FROM c""")
def component_sequences(spark, sf_dir):
    found = _two_kinds(spark, sf_dir).groupBy("root").agg(F.count(F.lit(1)).alias("n")).withColumn("stratum", F.col("root") % 2)
    return graph.assign_sequences(found, "root", "stratum", 4, "seed-7").select("root", "n", "stratum", "sequence")


@query("component_assignment", """SELECT n_nationkey, n_regionkey, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY sha256('seed-7|' || n_nationkey), n_nationkey) - 1) % 3 + 1 AS INTEGER) AS sequence FROM nation""")
def component_assignment(spark, sf_dir):
    return graph.assign_sequences(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey", 3, "seed-7").select("n_nationkey", "n_regionkey", "sequence")
