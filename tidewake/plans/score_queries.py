"""Queries over scored cases, times to an event, and families of tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions.probability import two_sided_p
from tidewake.operators import classification as cl
from tidewake.operators import drift, multiplicity, survival
from tidewake.plans.inputs import ENDPOINT_SQL, EVENTS_SQL, SCORED_SQL, endpoints, event_log, query, scored_cases, study, STUDY_SQL, table

R = lambda c, n=6: F.round(F.col(c), n).alias(c)


def rounded(df, *cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


@query("reviewer_agreement", """
WITH a AS (SELECT count(*) AS n, avg(CAST(quality = toxic AS INTEGER)) AS raw, avg(quality) AS x, avg(toxic) AS y FROM labels), e AS (SELECT *, x * y + (1 - x) * (1 - y) AS expected, (x + y) / 2 AS m FROM a)
SELECT n, round(raw, 6) AS raw, round(expected, 6) AS expected, round(raw - expected, 6) AS excess, round((raw - expected) / (1 - expected), 6) AS kappa, round((raw - 2 * m * (1 - m)) / (1 - 2 * m * (1 - m)), 6) AS ac1 FROM e""")
def reviewer_agreement(spark, sf_dir):
    return rounded(cl.agreement(table(spark, sf_dir, "labels"), "quality", "toxic"), "raw", "expected", "excess", "kappa", "ac1")


@query("reviewer_classes", """
SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'good' WHEN quality = 1 THEN 'good_toxic' WHEN toxic = 0 THEN 'poor' ELSE 'poor_toxic' END AS reviewer_class, count(*) AS n FROM labels GROUP BY 1""")
def reviewer_classes(spark, sf_dir):
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    label = F.when(q & t, "good").when(q, "good_toxic").when(t, "poor").otherwise("poor_toxic")
    return table(spark, sf_dir, "labels").groupBy(label.alias("reviewer_class")).agg(F.count(F.lit(1)).alias("n"))


_RATES = ("brier", "log_loss", "sensitivity", "specificity", "ppv", "npv", "balanced_accuracy")


@query("confusion_metrics", f"""
WITH {SCORED_SQL}, c AS (SELECT service, count(*) FILTER (score >= 0.3 AND y = 1) AS tp, count(*) FILTER (score >= 0.3 AND y = 0) AS fp, count(*) FILTER (score < 0.3 AND y = 1) AS fn, count(*) FILTER (score < 0.3 AND y = 0) AS tn,
    avg((score - y) * (score - y)) AS brier, avg(-(y * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)))) AS log_loss FROM scored GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS sensitivity, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END AS specificity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS ppv, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END AS npv FROM c)
SELECT service, tp, fp, fn, tn, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, round(ppv, 6) AS ppv, round(npv, 6) AS npv, round((sensitivity + specificity) / 2, 6) AS balanced_accuracy FROM r""")
def confusion_metrics(spark, sf_dir):
    return rounded(cl.confusion(scored_cases(spark, sf_dir), "y", "score", 0.3, "service"), *_RATES)


@query("rank_auc", f"""
WITH {SCORED_SQL}, g AS (SELECT service, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1, 2),
w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY service ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT service, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE) END, 6) AS auc FROM w GROUP BY 1""")
def rank_auc(spark, sf_dir):
    return rounded(cl.rank_auc(scored_cases(spark, sf_dir), "y", "score", "service"), "auc")


@query("average_precision", f"""
WITH {SCORED_SQL}, g AS (SELECT service, score, count(*) FILTER (y = 1) AS pos, count(*) AS c FROM scored GROUP BY 1, 2),
w AS (SELECT *, sum(pos) OVER k AS tp, sum(c) OVER k AS taken FROM g WINDOW k AS (PARTITION BY service ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT service, CAST(sum(pos) AS BIGINT) AS n_pos, round(CASE WHEN sum(pos) > 0 THEN sum(pos * CAST(tp AS DOUBLE) / CAST(taken AS DOUBLE)) / CAST(sum(pos) AS DOUBLE) END, 6) AS average_precision FROM w GROUP BY 1""")
def average_precision(spark, sf_dir):
    return rounded(cl.average_precision(scored_cases(spark, sf_dir), "y", "score", "service"), "average_precision")


@query("reliability_bins_wilson", f"""
WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) - 1 AS i, count(*) OVER () AS n FROM scored),
b AS (SELECT CAST(floor(((i + 1) * 7 - 1) / n) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, CAST(sum(y) AS BIGINT) AS events FROM r GROUP BY 1), p AS (SELECT *, events / n AS p, 1.959963984540054::DOUBLE AS z FROM b)
SELECT bin, n, round(mean_score, 6) AS mean_score, events, round(p, 6) AS observed,
    round(greatest(0.0::DOUBLE, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low,
    round(least(1.0::DOUBLE, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM p""")
def reliability_bins_wilson(spark, sf_dir):
    return rounded(cl.reliability_bins(scored_cases(spark, sf_dir), "y", "score", "doc_id", 7), "mean_score", "observed", "low", "high")


@query("ece_calibration", f"""
WITH {SCORED_SQL}, b AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(y) AS observed FROM scored GROUP BY 1)
SELECT bin, n, round(mean_score, 6) AS mean_score, round(observed, 6) AS observed, round(n / CAST(sum(n) OVER () AS DOUBLE) * abs(mean_score - observed), 6) AS ece_part FROM b""")
def ece_calibration(spark, sf_dir):
    return rounded(cl.calibration_error(scored_cases(spark, sf_dir), "y", "score"), "mean_score", "observed", "ece_part")


_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query("decision_curve", f"""
WITH {SCORED_SQL}, t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _THRESHOLDS)}]) AS threshold), c AS (SELECT threshold, count(*) AS n, count(*) FILTER (y = 1) AS events, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp FROM scored, t GROUP BY 1)
SELECT threshold, tp, fp, round((tp - fp * threshold / (1 - threshold)) / n, 6) AS model, round((events - (n - events) * threshold / (1 - threshold)) / n, 6) AS treat_all, 0.0::DOUBLE AS treat_none FROM c""")
def decision_curve(spark, sf_dir):
    return rounded(cl.decision_curve(scored_cases(spark, sf_dir), "y", "score", _THRESHOLDS), "model", "treat_all")


def _logistic_sql(y: str) -> str:
    return f"""WITH RECURSIVE {SCORED_SQL}, x AS (SELECT ln(least(greatest(score, 1e-6), 1 - 1e-6) / (1 - least(greatest(score, 1e-6), 1 - 1e-6))) AS x, {y} AS y FROM scored), step AS (
    SELECT 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b
    UNION ALL
    SELECT i + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
        SELECT i, a, b, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) AS h11 FROM (SELECT *, 1 / (1 + exp(-(a + b * x))) AS q FROM step, x WHERE i < 30) GROUP BY i, a, b))
SELECT CASE WHEN isfinite(a) THEN round(a, 6) END AS intercept, CASE WHEN isfinite(b) THEN round(b, 6) END AS slope FROM step WHERE i = 30"""


def _logistic(spark, sf_dir, y):
    found = cl.logistic_calibration(scored_cases(spark, sf_dir), y, "score")
    return rounded(spark.createDataFrame([found or (None, None)], "intercept double, slope double"), "intercept", "slope")


@query("logistic_calibration", _logistic_sql("y"))
def logistic_calibration(spark, sf_dir):
    return _logistic(spark, sf_dir, "y")


@query("logistic_calibration_toxic", _logistic_sql("y2"))
def logistic_calibration_toxic(spark, sf_dir):
    return _logistic(spark, sf_dir, "y2")


_REF_SQL, _REF = "ts < TIMESTAMP '2024-01-16'", (lambda: F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))


@query("psi_quantile", f"""
WITH q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM events WHERE {_REF_SQL}),
c AS (SELECT CAST(len(list_filter(edges, lambda e: e < value)) AS INTEGER) AS bin, count(*) FILTER ({_REF_SQL}) AS n_ref, count(*) FILTER (NOT ({_REF_SQL})) AS n_cur FROM events, q GROUP BY 1),
s AS (SELECT *, greatest(n_ref / CAST(sum(n_ref) OVER () AS DOUBLE), 1e-6) AS p, greatest(n_cur / CAST(sum(n_cur) OVER () AS DOUBLE), 1e-6) AS q FROM c)
SELECT bin, n_ref, n_cur, round((q - p) * ln(q / p), 6) AS psi_part FROM s""")
def psi_quantile(spark, sf_dir):
    return rounded(drift.psi_quantile(event_log(spark, sf_dir), "value", _REF()), "psi_part")


@query("psi_fixed_smoothed", f"""
WITH b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(5)), c AS (SELECT CAST(least(floor(value / 20), 4) AS INTEGER) AS bin, count(*) FILTER ({_REF_SQL}) AS n_ref, count(*) FILTER (NOT ({_REF_SQL})) AS n_cur FROM (SELECT greatest(value, 0) AS value, ts FROM events) GROUP BY 1),
f AS (SELECT bin, coalesce(n_ref, 0) AS n_ref, coalesce(n_cur, 0) AS n_cur FROM b LEFT JOIN c USING (bin)), s AS (SELECT *, (n_ref + 0.5::DOUBLE) / CAST(sum(n_ref) OVER () + 2.5 AS DOUBLE) AS p, (n_cur + 0.5::DOUBLE) / CAST(sum(n_cur) OVER () + 2.5 AS DOUBLE) AS q FROM f)
SELECT bin, n_ref, n_cur, round((q - p) * ln(q / p), 6) AS psi_part FROM s""")
def psi_fixed_smoothed(spark, sf_dir):
    return rounded(drift.psi_fixed(event_log(spark, sf_dir), "value", _REF(), [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]), "psi_part")


@query("kl_drift", f"""
WITH b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)), c AS (SELECT CAST(least(floor(value / 5), 19) AS INTEGER) AS bin, count(*) FILTER ({_REF_SQL}) AS n_ref, count(*) FILTER (NOT ({_REF_SQL})) AS n_cur FROM (SELECT greatest(value, 0) AS value, ts FROM events) GROUP BY 1),
f AS (SELECT bin, coalesce(n_ref, 0) AS n_ref, coalesce(n_cur, 0) AS n_cur FROM b LEFT JOIN c USING (bin)), s AS (SELECT *, (n_ref + 0.5::DOUBLE) / CAST(sum(n_ref) OVER () + 10 AS DOUBLE) AS p, (n_cur + 0.5::DOUBLE) / CAST(sum(n_cur) OVER () + 10 AS DOUBLE) AS q FROM f)
SELECT bin, n_ref, n_cur, round(q * ln(q / p), 6) AS kl_part FROM s""")
def kl_drift(spark, sf_dir):
    return rounded(drift.kl_divergence(event_log(spark, sf_dir), "value", _REF(), 0.0, 100.0), "kl_part")


@query("category_share_shift", f"""
WITH {STUDY_SQL}, c AS (SELECT priority, count(*) FILTER (NOT after) AS n_ref, count(*) FILTER (after) AS n_cur FROM study GROUP BY 1), s AS (SELECT *, n_cur / CAST(sum(n_cur) OVER () AS DOUBLE) - n_ref / CAST(sum(n_ref) OVER () AS DOUBLE) AS shift FROM c)
SELECT priority, n_ref, n_cur, round(shift, 6) AS shift, round(max(abs(shift)) OVER (), 6) AS largest FROM s""")
def category_share_shift(spark, sf_dir):
    return rounded(drift.share_shift(study(spark, sf_dir), "priority", ~F.col("after")), "shift", "largest")


_H = 90 * 3600 * 1000000


@query("binary_endpoint", f"""
WITH {EVENTS_SQL}, {ENDPOINT_SQL}
SELECT event_id, service, wait_us <= {_H} IS TRUE OR follow_us >= {_H} AS observed, CASE WHEN wait_us <= {_H} THEN 1 WHEN follow_us >= {_H} THEN 0 END AS outcome FROM endpoints""")
def binary_endpoint(spark, sf_dir):
    e = endpoints(spark, sf_dir)
    hit, full = F.coalesce(F.col("wait_us") <= _H, F.lit(False)), F.col("follow_us") >= _H
    return e.select("event_id", "service", (hit | full).alias("observed"), F.when(hit, 1).when(full, 0).alias("outcome"))


_TTE_SQL = f"""tte AS (SELECT event_id, service, site, CASE WHEN wait_us <= {_H} THEN wait_us WHEN follow_us < {_H} THEN follow_us ELSE {_H} END / 3600000000.0::DOUBLE AS hours, coalesce(wait_us <= {_H}, false) AS event FROM endpoints)"""


def _tte(spark, sf_dir):
    e = endpoints(spark, sf_dir)
    hit = F.coalesce(F.col("wait_us") <= _H, F.lit(False))
    time = F.when(hit, F.col("wait_us")).otherwise(F.least("follow_us", F.lit(_H)))
    return e.select("event_id", "service", "site", (time / F.lit(3600000000.0)).alias("hours"), hit.alias("event"))


@query("time_to_event_endpoint", f"WITH {EVENTS_SQL}, {ENDPOINT_SQL}, {_TTE_SQL} SELECT event_id, service, site, round(hours, 6) AS hours, event FROM tte")
def time_to_event_endpoint(spark, sf_dir):
    return rounded(_tte(spark, sf_dir), "hours")


@query("km_rmst", f"""
WITH {EVENTS_SQL}, {ENDPOINT_SQL}, {_TTE_SQL}, c AS (SELECT service, hours, count(*) FILTER (event) AS d, count(*) AS c FROM tte GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY service ORDER BY hours DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM c),
s AS (SELECT *, product(1 - d / CAST(at_risk AS DOUBLE)) OVER (PARTITION BY service ORDER BY hours ROWS UNBOUNDED PRECEDING) AS s FROM r),
a AS (SELECT *, coalesce(lag(s) OVER w, 1) * (hours - coalesce(lag(hours) OVER w, 0)) + CASE WHEN lead(hours) OVER w IS NULL THEN s * (90 - hours) ELSE 0 END AS area FROM s WINDOW w AS (PARTITION BY service ORDER BY hours))
SELECT service, CAST(sum(c) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS events, round(sum(area), 4) AS rmst FROM a GROUP BY 1""")
def km_rmst(spark, sf_dir):
    return survival.restricted_mean(_tte(spark, sf_dir), "hours", "event", 90.0, "service").withColumn("rmst", F.round("rmst", 4))


_P_SQL = "p AS (SELECT n_nationkey, CASE WHEN n_nationkey % 9 = 4 THEN NULL ELSE ((n_nationkey * 37 + 11) % 100) / 1000.0::DOUBLE END AS p FROM nation)"


def _pvalues(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 9 != 4, ((k * 37 + 11) % 100) / F.lit(1000.0)).alias("p"))


@query("holm_adjust", f"""
WITH {_P_SQL}, r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, n_nationkey) AS i FROM p)
SELECT n_nationkey, p, CASE WHEN p IS NOT NULL THEN round(max(least(1.0, (m - i + 1) * p)) OVER (ORDER BY i), 6) END AS holm FROM r""")
def holm_adjust(spark, sf_dir):
    return rounded(multiplicity.holm(_pvalues(spark, sf_dir), "p", "n_nationkey"), "holm")


@query("by_adjust", f"""
WITH {_P_SQL}, r AS (SELECT *, count(p) OVER () AS m, row_number() OVER (ORDER BY p NULLS LAST, n_nationkey) AS i FROM p), h AS (SELECT *, list_sum(list_transform(range(1, m + 1), lambda x: 1.0::DOUBLE / x)) AS h FROM r)
SELECT n_nationkey, p, CASE WHEN p IS NOT NULL THEN round(min(least(1.0, p * m * h / i)) OVER (ORDER BY i DESC), 6) END AS by FROM h""")
def by_adjust(spark, sf_dir):
    return rounded(multiplicity.benjamini_yekutieli(_pvalues(spark, sf_dir), "p", "n_nationkey"), "by")


def p_sql(z: str) -> str:
    """Two-sided normal p of an expression in SQL, by the power series of the error function, each term from logarithms."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    term = f"exp(n * ln(2.0::DOUBLE) + (2 * n + 1) * ln({x}) - (lgamma(2.0::DOUBLE * n + 2) - n * ln(2.0::DOUBLE) - lgamma(n + 1.0::DOUBLE)) - {x} * {x})"
    return f"CASE WHEN {z} = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 300), lambda n: {term}))) END"


@query("two_sided_p_values", f"SELECT n_nationkey, z, round({p_sql('z')}, 6) AS p FROM (SELECT n_nationkey, (n_nationkey - 12) / 4.0::DOUBLE AS z FROM nation)")
def two_sided_p_values(spark, sf_dir):
    z = (F.col("n_nationkey") - 12) / F.lit(4.0)
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", z.alias("z"), two_sided_p(z).alias("p")), "p")
