"""Queries over a before/after study of orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewake.functions.identifiers import age_band, age_years, week_start
from tidewake.functions.probability import two_sided_p
from tidewake.operators import cohort
from tidewake.plans.inputs import SCORED_SQL, STUDY_SQL, query, scored_cases, study, table
from tidewake.plans.score_queries import p_sql, rounded

Y = lambda: F.col("y").cast("double")
#: The arm of an order, crossed with nation: order-key parity.
ARM, ARM_SQL = (lambda: F.col("o_orderkey") % 2 == 0), "o_orderkey % 2 = 0"


@query("cohort_episodes", """
SELECT o_orderkey, c_custkey, CAST(born AS VARCHAR) AS born, age, CASE WHEN age IS NULL OR age < 0 THEN 'unknown' WHEN age < 50 THEN '<50' WHEN age < 70 THEN '50-69' ELSE '70+' END AS age_band, CAST(least(90, greatest(0, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') + 1)) AS BIGINT) AS follow_up
FROM (SELECT *, CAST(year(o_orderdate) - year(born) - CASE WHEN month(o_orderdate) * 100 + day(o_orderdate) < month(born) * 100 + day(born) THEN 1 ELSE 0 END AS BIGINT) AS age
    FROM (SELECT *, CASE WHEN c_custkey % 17 <> 0 THEN DATE '1915-03-01' + CAST((c_custkey * 37) % 25000 AS INTEGER) END AS born FROM orders LEFT JOIN customer ON o_custkey = c_custkey))""")
def cohort_episodes(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    c = c.withColumn("born", F.when(F.col("c_custkey") % 17 != 0, F.date_add(F.lit("1915-03-01").cast("date"), ((F.col("c_custkey") * 37) % 25000).cast("int"))))
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn("age", age_years("born", "o_orderdate").cast("long"))
    left = F.datediff(F.lit("2001-08-01").cast("date"), F.to_date("o_orderdate")) + 1
    return rows.select("o_orderkey", "c_custkey", F.col("born").cast("string").alias("born"), "age", age_band("age").alias("age_band"), F.least(F.lit(90), F.greatest(F.lit(0), left)).cast("long").alias("follow_up"))


@query("poststratified_rate", f"""
WITH {STUDY_SQL}, cells AS (SELECT site, segment, priority, count(*) AS n, avg(y) AS rate FROM study GROUP BY 1, 2, 3), sizes AS (SELECT segment, priority, sum(n) AS size FROM cells GROUP BY 1, 2), o AS (SELECT site, count(*) AS n, avg(y) AS crude FROM study GROUP BY 1)
SELECT o.site, any_value(o.n) AS n, round(any_value(crude), 6) AS crude, round(sum(coalesce(rate, crude) * size) / CAST(sum(size) AS DOUBLE), 6) AS poststratified
FROM o CROSS JOIN sizes LEFT JOIN cells ON cells.site = o.site AND cells.segment = sizes.segment AND cells.priority = sizes.priority GROUP BY 1""")
def poststratified_rate(spark, sf_dir):
    return rounded(cohort.poststratified_rate(study(spark, sf_dir), "y", ["segment", "priority"], "site"), "crude", "poststratified")


_DID_SQL = f"""did AS (SELECT service, count(*) AS n, avg(y) FILTER ({ARM_SQL} AND after) AS r11, avg(y) FILTER ({ARM_SQL} AND NOT after) AS r10, avg(y) FILTER (NOT ({ARM_SQL}) AND after) AS r01, avg(y) FILTER (NOT ({ARM_SQL}) AND NOT after) AS r00,
    least(count(*) FILTER ({ARM_SQL} AND after), count(*) FILTER ({ARM_SQL} AND NOT after), count(*) FILTER (NOT ({ARM_SQL}) AND after), count(*) FILTER (NOT ({ARM_SQL}) AND NOT after)) AS smallest FROM study GROUP BY 1)"""


def _did(spark, sf_dir, y=None):
    return cohort.did_cells(study(spark, sf_dir), y if y is not None else Y(), "service", ARM(), F.col("after"))


@query("did_service_effects", f"WITH {STUDY_SQL}, {_DID_SQL} SELECT service, n, smallest, round(r11, 6) AS r11, round(r10, 6) AS r10, round(r01, 6) AS r01, round(r00, 6) AS r00, round(r11 - r10 - (r01 - r00), 6) AS did FROM did WHERE smallest > 0")
def did_service_effects(spark, sf_dir):
    return rounded(_did(spark, sf_dir), "r11", "r10", "r01", "r00", "did").select("service", "n", "smallest", "r11", "r10", "r01", "r00", "did")


@query("did_overall", f"""WITH {STUDY_SQL}, {_DID_SQL}, e AS (SELECT *, r11 - r10 - (r01 - r00) AS did FROM did WHERE smallest > 0)
SELECT count(*) AS n_services, CAST(sum(n) AS BIGINT) AS n, round(avg(did), 6) AS effect, round(stddev_samp(did), 6) AS sd, round(sum(did * n) / CAST(sum(n) AS DOUBLE), 6) AS weighted_effect FROM e""")
def did_overall(spark, sf_dir):
    return rounded(cohort.equal_weight_effect(_did(spark, sf_dir)), "effect", "sd", "weighted_effect")


@query("negative_control_did", f"""WITH {STUDY_SQL}, {_DID_SQL.replace('avg(y)', 'avg(CAST(c_acctbal > 0 AS INTEGER))')}
SELECT service, round(r11 - r10 - (r01 - r00), 6) AS did FROM did WHERE smallest > 0""")
def negative_control_did(spark, sf_dir):
    return rounded(_did(spark, sf_dir, (F.col("c_acctbal") > 0).cast("double")), "did").select("service", "did")


@query("sensitivity_leave_one_out", f"""WITH {STUDY_SQL}, {_DID_SQL}, e AS (SELECT service, r11 - r10 - (r01 - r00) AS did FROM did WHERE smallest > 0)
SELECT service, round(did, 6) AS did, round(sum(did) OVER () / count(*) OVER (), 6) AS effect, round(CASE WHEN count(*) OVER () > 1 THEN (sum(did) OVER () - did) / (count(*) OVER () - 1) END, 6) AS without FROM e""")
def sensitivity_leave_one_out(spark, sf_dir):
    return rounded(cohort.leave_one_out(_did(spark, sf_dir), "service"), "did", "effect", "without")


@query("ipw_service_agreement", f"""
WITH {SCORED_SQL}, r AS (SELECT *, score >= 0.2 AS selected FROM scored), p AS (SELECT service, source, avg(CAST(selected AS INTEGER)) AS p FROM r GROUP BY 1, 2)
SELECT r.service, count(*) AS n, round(avg(CAST(y = y2 AS INTEGER)), 6) AS plain, round(sum(CAST(y = y2 AS INTEGER) / p) / sum(1 / p), 6) AS weighted FROM r JOIN p ON r.service = p.service AND r.source = p.source WHERE selected GROUP BY 1""")
def ipw_service_agreement(spark, sf_dir):
    out = cohort.ipw_means(scored_cases(spark, sf_dir), (F.col("y") == F.col("y2")).cast("int"), F.col("score") >= 0.2, ["service", "source"], "service")
    return rounded(out, "plain", "weighted")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_STATES = ("F", "O", "P")
_COMPARISONS = [f"segment:{s}" for s in _SEGMENTS] + [f"status:{s}" for s in _STATES] + [f"segment:{s}|status:{t}" for s in _SEGMENTS for t in _STATES] + [f"balance<{b}" for b in range(-500, 9500, 1000)] + [f"status:{t}|balance<{b}" for t in _STATES for b in (0, 2000, 4000, 6000, 8000, 9000)]
_NAMES = {"segment": "segment", "status": "status", "balance": "c_acctbal"}


def _predicate_sql(text: str) -> str:
    return " AND ".join(f"{_NAMES[p.split(':')[0]]} = '{p.split(':')[1]}'" if ":" in p else f"{_NAMES[p.split('<')[0]]} < {p.split('<')[1]}" for p in text.split("|"))


def _comparisons(spark, sf_dir):
    return cohort.before_after(study(spark, sf_dir), "y", "after", [(c, cohort.parse_predicate(c, _NAMES)) for c in _COMPARISONS])


_Z_SQL = f"WITH {STUDY_SQL}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS comparison, count(*) FILTER (after) AS n1, count(*) FILTER (after AND y = 1) AS x1, count(*) FILTER (NOT after) AS n0, count(*) FILTER (NOT after AND y = 1) AS x0 FROM study WHERE {_predicate_sql(c)}" for c in _COMPARISONS) + """), p AS (SELECT *, (x1 + x0) / (n1 + n0) AS p FROM c),
tests AS (SELECT *, CASE WHEN n1 > 0 AND n0 > 0 THEN x1 / n1 - x0 / n0 END AS diff, CASE WHEN n1 > 0 AND n0 > 0 AND x1 + x0 > 0 AND x1 + x0 < n1 + n0 THEN (x1 / n1 - x0 / n0) / sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) END AS z FROM p)"""


@query("before_after_z51", f"{_Z_SQL} SELECT comparison, n1, x1, n0, x0, round(diff, 6) AS diff, round(z, 6) AS z FROM tests")
def before_after_z51(spark, sf_dir):
    return rounded(_comparisons(spark, sf_dir), "diff", "z")


@query("before_after_p51", f"{_Z_SQL} SELECT comparison, round(z, 6) AS z, round({p_sql('z')}, 6) AS p FROM tests")
def before_after_p51(spark, sf_dir):
    return rounded(_comparisons(spark, sf_dir).select("comparison", "z", two_sided_p(F.col("z")).alias("p")), "z", "p")


_FRACTIONS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
_UPLIFT_SQL = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, o_orderkey) AS rank, row_number() OVER (ORDER BY c_acctbal, o_orderkey) AS up, count(*) OVER () AS n FROM study),
gain AS (SELECT f AS fraction, count(*) FILTER (after) AS nt, count(*) FILTER (NOT after) AS nc, CAST(coalesce(sum(y) FILTER (after), 0) AS BIGINT) AS yt, CAST(coalesce(sum(y) FILTER (NOT after), 0) AS BIGINT) AS yc FROM ranked, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in _FRACTIONS)}]) AS f) WHERE rank <= ceil(f * n) GROUP BY 1),
points AS (SELECT *, yt - CASE WHEN nc > 0 THEN yc * nt / nc ELSE 0 END AS gain FROM gain)"""


def _gain(spark, sf_dir):
    return cohort.ranked_gain(study(spark, sf_dir), "c_acctbal", "o_orderkey", "y", F.col("after"), _FRACTIONS)


@query("uplift_curve", f"WITH {STUDY_SQL}, {_UPLIFT_SQL} SELECT fraction, nt, nc, yt, yc, round(gain, 6) AS gain FROM points")
def uplift_curve(spark, sf_dir):
    return rounded(_gain(spark, sf_dir), "gain")


@query("qini_area", f"WITH {STUDY_SQL}, {_UPLIFT_SQL} SELECT round(sum(a), 6) AS area FROM (SELECT (fraction - coalesce(lag(fraction) OVER w, 0)) * (gain + coalesce(lag(gain) OVER w, 0)) / 2 AS a FROM points WINDOW w AS (ORDER BY fraction))")
def qini_area(spark, sf_dir):
    return rounded(cohort.trapezoid(_gain(spark, sf_dir), "fraction", "gain"), "area")


@query("uplift_bins", f"WITH {STUDY_SQL}, {_UPLIFT_SQL} SELECT CAST(floor((up * 8 - 1) / n) AS INTEGER) AS bin, count(*) FILTER (after) AS n_treated, count(*) FILTER (NOT after) AS n_control, round(avg(y) FILTER (after) - avg(y) FILTER (NOT after), 6) AS uplift FROM ranked GROUP BY 1")
def uplift_bins(spark, sf_dir):
    return rounded(cohort.uplift_bins(study(spark, sf_dir), "c_acctbal", "o_orderkey", "y", F.col("after"), 8), "uplift")


_FACTORS = (0.25, 0.5, 1.0, 2.0, 4.0)


@query("missingness_grid", f"""WITH {STUDY_SQL}, c AS (SELECT site, after, count(*) AS n, count(*) FILTER (status <> 'P') AS observed, avg(y) FILTER (status <> 'P') AS rate FROM study GROUP BY 1, 2)
SELECT site, after, n, observed, round(rate, 6) AS rate, f AS odds_factor, round((observed * rate + (n - observed) * f * rate / (1 - rate + f * rate)) / n, 6) AS shifted, round(observed * rate / n, 6) AS lowest, round((observed * rate + n - observed) / n, 6) AS highest
FROM c, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in _FACTORS)}]) AS f)""")
def missingness_grid(spark, sf_dir):
    seen = F.col("status") != "P"
    cells = study(spark, sf_dir).groupBy("site", "after").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("observed"), F.avg(F.when(seen, Y())).alias("rate"))
    return rounded(cohort.missingness_grid(cells, "observed", "rate", "n", _FACTORS), "rate", "shifted", "lowest", "highest")


_PREV, _ASSOC = (0.1, 0.3, 0.5), (1.5, 2.0, 3.0)


@query("qba_grid", f"""WITH {STUDY_SQL}, e AS (SELECT avg(y) FILTER (after) / avg(y) FILTER (NOT after) AS ratio FROM study), g AS (SELECT ratio, p1, p0, a, (p1 * (a - 1) + 1) / (p0 * (a - 1) + 1) AS bias FROM e, (SELECT unnest({list(_PREV)}::DOUBLE[]) AS p1), (SELECT unnest({list(_PREV)}::DOUBLE[]) AS p0), (SELECT unnest({list(_ASSOC)}::DOUBLE[]) AS a))
SELECT round(ratio, 6) AS ratio, p1 AS prevalence_1, p0 AS prevalence_0, a AS association, round(bias, 6) AS bias, round(ratio / bias, 6) AS adjusted FROM g""")
def qba_grid(spark, sf_dir):
    rate = lambda t: F.avg(F.when(t, Y()))
    effect = study(spark, sf_dir).agg((rate(F.col("after")) / rate(~F.col("after"))).alias("ratio"))
    return rounded(cohort.bias_grid(effect, "ratio", _PREV, _ASSOC), "ratio", "bias", "adjusted")


#: The grids of the sensitivity analysis: fixed values.
_RATIOS, _SHARES, _ODDS = (1.25, 1.5, 2.0, 3.0), (0.01, 0.05, 0.10, 0.20), (1.25, 1.5, 2.0, 3.0)
_P_SQL = "least(greatest(e + 0.5, 1e-6), 1 - 1e-6)"


@query("bias_ledger", f"""WITH {STUDY_SQL}, {_DID_SQL}, o AS (SELECT avg(r11 - r10 - (r01 - r00)) AS e, avg(r11) AS r, stddev_samp(r11 - r10 - (r01 - r00)) AS sd FROM did WHERE smallest > 0),
x AS (SELECT *, CASE WHEN r > 0 AND r - e > 0 THEN r / (r - e) END AS rr FROM o), v AS (SELECT *, greatest(rr, 1 / rr) AS h FROM x), g AS (SELECT unnest({list(_RATIOS)}::DOUBLE[]) AS a), k AS (SELECT unnest({list(_RATIOS)}::DOUBLE[]) AS b)
SELECT method, exposure, outcome, round(setting, 6) AS setting, round(estimate, 6) AS estimate FROM (
    SELECT 'e_value' AS method, NULL::DOUBLE AS exposure, NULL::DOUBLE AS outcome, NULL::DOUBLE AS setting, h + sqrt(h * h - h) AS estimate FROM v
    UNION ALL SELECT 'bias_factor', a, b, a * b / (a + b - 1), rr * pow(a * b / (a + b - 1), CASE WHEN rr < 1 THEN 1 ELSE -1 END) FROM v, g, k
    UNION ALL SELECT 'partial_r2', NULL, NULL, q, CASE WHEN e > 0 THEN e - sqrt(q / (1 - q)) * sd WHEN e < 0 THEN e + sqrt(q / (1 - q)) * sd ELSE e END FROM v, (SELECT unnest({list(_SHARES)}::DOUBLE[]) AS q)
    UNION ALL SELECT 'selection_odds', NULL, NULL, q, CASE WHEN e IS NOT NULL THEN q * {_P_SQL} / (1 - {_P_SQL} + q * {_P_SQL}) - 0.5 END FROM v, (SELECT unnest({list(_ODDS)}::DOUBLE[]) AS q))""")
def bias_ledger(spark, sf_dir):
    effects = _did(spark, sf_dir)
    return rounded(cohort.bias_ledger(effects, "did", "r11", _RATIOS, _SHARES, _ODDS), "setting", "estimate")


_ENDPOINTS = {"event": "y", "snapshot_status": "CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END", "snapshot_balance": "CASE WHEN c_acctbal > 0 THEN c_acctbal END"}


@query("endpoint_sensitivity", f"""WITH {STUDY_SQL}, l AS ({' UNION ALL '.join(f"SELECT '{name}' AS endpoint, service, {ARM_SQL} AS arm, after, CAST({e} AS DOUBLE) AS v FROM study" for name, e in _ENDPOINTS.items())}),
m AS (SELECT endpoint, service, arm, after, avg(v) AS v, count(v) AS k, count(*) - count(v) AS gone FROM l GROUP BY ALL), d AS (SELECT endpoint, service, sum(k) AS n, sum(gone) AS missing, sum(k) FILTER (arm AND after) AS treated, sum(CASE WHEN arm = after THEN v ELSE -v END) AS did FROM m GROUP BY 1, 2 HAVING count(v) = 4)
SELECT endpoint, count(*) AS n_services, CAST(sum(n) AS BIGINT) AS n, CAST(sum(missing) AS BIGINT) AS missing, round(avg(did), 6) AS effect, round(stddev_samp(did) / sqrt(count(*)), 6) AS se, round(sum(did * treated) / CAST(sum(treated) AS DOUBLE), 6) AS weighted_effect FROM d GROUP BY 1""")
def endpoint_sensitivity(spark, sf_dir):
    """An outcome of the record of events beside two of the mutable snapshot, these over complete cases."""
    found = cohort.endpoint_sensitivity(study(spark, sf_dir), {name: F.expr(e) for name, e in _ENDPOINTS.items()}, "service", ARM(), F.col("after"))
    return rounded(found, "effect", "se", "weighted_effect")


@query("subgroup_suppression", f"""WITH {SCORED_SQL}, g AS (SELECT y, source, unnest([{{'d': 'service', 'l': service}}, {{'d': 'toxic', 'l': CAST(y2 AS VARCHAR)}}, {{'d': 'length', 'l': CASE WHEN score >= 0.9 THEN 'long' ELSE 'short' END}}, {{'d': 'source', 'l': source}}]) AS g FROM scored),
c AS (SELECT g.d AS dimension, g.l AS level, count(*) AS n, count(DISTINCT source) AS n_clusters, avg(y) AS rate FROM g GROUP BY 1, 2)
SELECT dimension, level, n, n_clusters, n_clusters < 5 OR n < 20 AS suppressed, round(CASE WHEN n_clusters >= 5 AND n >= 20 THEN rate END, 6) AS rate FROM c""")
def subgroup_suppression(spark, sf_dir):
    dims = {"service": F.col("service"), "toxic": F.col("y2"), "length": F.when(F.col("score") >= 0.9, "long").otherwise("short"), "source": F.col("source")}
    return rounded(cohort.subgroup_rates(scored_cases(spark, sf_dir), "y", "source", dims, 5, 20), "rate")


_CLUSTERED = "count(*) AS n_services, CAST(sum(n) AS BIGINT) AS n, avg(did) AS effect, stddev_samp(did) / sqrt(count(*)) AS se"
_DID_OF = f"avg(y) FILTER ({ARM_SQL} AND after) - avg(y) FILTER ({ARM_SQL} AND NOT after) - (avg(y) FILTER (NOT ({ARM_SQL}) AND after) - avg(y) FILTER (NOT ({ARM_SQL}) AND NOT after))"


@query("subgroup_effects", f"""WITH {STUDY_SQL}, g AS (SELECT *, unnest([{{'d': 'segment', 'l': segment}}, {{'d': 'priority', 'l': priority}}, {{'d': 'balance', 'l': CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'positive' END}}]) AS g FROM study),
d AS (SELECT g.d AS dimension, g.l AS level, service, count(*) AS n, {_DID_OF} AS did FROM g GROUP BY 1, 2, 3), e AS (SELECT dimension, level, {_CLUSTERED} FROM d WHERE did IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, count(effect) OVER x AS k, sum(effect) OVER x AS total, sum(se * se) OVER x AS variance FROM e WINDOW x AS (PARTITION BY dimension)),
i AS (SELECT *, CASE WHEN se > 0 THEN effect / se END AS t, CASE WHEN k > 1 THEN effect - (total - effect) / (k - 1) END AS interaction, sqrt(se * se + (variance - se * se) / ((k - 1) * (k - 1))) AS spread, n_services < 20 OR n < 400 AS suppressed FROM w WHERE k > 1)
SELECT dimension, level, n_services, n, suppressed, CASE WHEN NOT suppressed THEN round(effect, 6) END AS effect, CASE WHEN NOT suppressed THEN round(se, 6) END AS se, CASE WHEN NOT suppressed THEN round(t, 6) END AS t, CASE WHEN NOT suppressed THEN round(interaction, 6) END AS interaction, CASE WHEN NOT suppressed AND spread > 0 THEN round(interaction / spread, 6) END AS interaction_z FROM i""")
def subgroup_effects(spark, sf_dir):
    dims = {"segment": F.col("segment"), "priority": F.col("priority"), "balance": F.when(F.col("c_acctbal") < 0, "negative").otherwise("positive")}
    return rounded(cohort.subgroup_effects(study(spark, sf_dir), Y(), "service", ARM(), F.col("after"), dims, 20, 400), "effect", "se", "t", "interaction", "interaction_z")


_SHIFTS, _HORIZONS = (-60, -30, 0, 30, 60), (0, 180, 365)


@query("sensitivity_shifts", f"""WITH {STUDY_SQL}, v AS (SELECT * EXCLUDE (after), date_diff('day', DATE '1998-05-01', CAST(o_orderdate AS DATE)) - s AS d, CAST(s AS INTEGER) AS shift, CAST(h AS INTEGER) AS horizon FROM study, (SELECT unnest({list(_SHIFTS)}) AS s), (SELECT unnest({list(_HORIZONS)}) AS h)),
c AS (SELECT shift, horizon, service, count(*) AS n, {_DID_OF} AS did FROM (SELECT *, d >= 0 AS after FROM v WHERE horizon = 0 OR d BETWEEN -horizon AND horizon - 1) GROUP BY 1, 2, 3), e AS (SELECT shift, horizon, {_CLUSTERED} FROM c WHERE did IS NOT NULL GROUP BY 1, 2)
SELECT shift, horizon, n_services, n, round(effect, 6) AS effect, round(se, 6) AS se, round(CASE WHEN se > 0 THEN effect / se END, 6) AS t FROM e""")
def sensitivity_shifts(spark, sf_dir):
    return rounded(cohort.shifted_switches(study(spark, sf_dir), Y(), "service", ARM(), "o_orderdate", "1998-05-01", _SHIFTS, _HORIZONS), "effect", "se", "t")


@query("placebo_switch", f"""WITH {STUDY_SQL}, c AS (SELECT service, count(*) AS n, {_DID_OF} AS did FROM (SELECT * EXCLUDE (after), CAST(o_orderdate AS DATE) >= DATE '1996-09-01' AS after FROM study WHERE CAST(o_orderdate AS DATE) < DATE '1998-05-01') GROUP BY 1), e AS (SELECT {_CLUSTERED} FROM c WHERE did IS NOT NULL)
SELECT n_services, n, round(effect, 6) AS effect, round(se, 6) AS se, round(CASE WHEN se > 0 THEN effect / se END, 6) AS t FROM e""")
def placebo_switch(spark, sf_dir):
    return rounded(cohort.placebo_switch(study(spark, sf_dir), Y(), "service", ARM(), "o_orderdate", "1998-05-01", "1996-09-01"), "effect", "se", "t")


@query("missingness_effects", f"""WITH {STUDY_SQL}, c AS (SELECT {ARM_SQL} AS arm, after, count(*) AS n, count(*) FILTER (status <> 'P') AS observed, avg(y) FILTER (status <> 'P') AS rate FROM study GROUP BY 1, 2),
g AS (SELECT *, observed / n AS share, CASE WHEN arm AND after THEN f * rate / (1 - rate + f * rate) ELSE rate END AS unseen, -ln(1 - least(greatest(rate, 1e-6), 1 - 1e-6)) / 90 AS h, CASE WHEN arm AND after THEN f ELSE 1 END AS m FROM c, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in _FACTORS)}]) AS f)),
r AS (SELECT f, CASE WHEN arm = after THEN 1 ELSE -1 END AS sign, share * rate + (1 - share) * unseen AS r, share * (1 - exp(-h * 90)) / h + (1 - share) * (1 - exp(-h * m * 90)) / (h * m) AS mean FROM g)
SELECT f AS factor, round(sum(sign * r), 6) AS effect, round(sum(sign * mean), 6) AS rmst_effect FROM r GROUP BY 1""")
def missingness_effects(spark, sf_dir):
    seen = F.col("status") != "P"
    cells = study(spark, sf_dir).groupBy(ARM().alias("arm"), "after").agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("observed"), F.avg(F.when(seen, Y())).alias("rate"))
    return rounded(cohort.missingness_effects(cells, _FACTORS, 90.0), "effect", "rmst_effect")


@query("week_panel", f"""WITH {STUDY_SQL}, r AS (SELECT CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, site, segment, y FROM study), c AS (SELECT week, site, segment, avg(y) AS rate FROM r GROUP BY 1, 2, 3), f AS (SELECT site, segment, avg(y) AS fallback FROM r GROUP BY 1, 2)
SELECT w.week, f.site, round(avg(coalesce(rate, fallback)), 6) AS rate, count(rate) AS n_observed, count(*) AS n_services FROM f CROSS JOIN (SELECT DISTINCT week FROM r) w LEFT JOIN c ON c.week = w.week AND c.site = f.site AND c.segment = f.segment GROUP BY 1, 2""")
def week_panel(spark, sf_dir):
    return rounded(cohort.dense_panel(study(spark, sf_dir), week_start("o_orderdate").cast("string"), "site", "segment", "y"), "rate")


@query("legacy_period_query", """
SELECT CASE WHEN o_orderdate >= TIMESTAMP '1998-05-01' THEN 'after' ELSE 'before' END AS period, count(DISTINCT o_orderkey) AS n_cases, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 6) AS returned, round(avg(l_quantity), 6) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def legacy_period_query(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    period = F.when(F.col("o_orderdate") >= F.lit("1998-05-01").cast("timestamp_ntz"), "after").otherwise("before")
    rows = o.join(li, o.o_orderkey == li.l_orderkey)
    return rows.groupBy(period.alias("period")).agg(F.count_distinct("o_orderkey").alias("n_cases"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("returned"), F.round(F.avg("l_quantity"), 6).alias("quantity"))


_STAGE = "SELECT {i} AS stage, '{name}' AS label, avg(CAST({y} AS DOUBLE)) FILTER (o_orderdate >= TIMESTAMP '1998-05-01') - avg(CAST({y} AS DOUBLE)) FILTER (o_orderdate < TIMESTAMP '1998-05-01') AS diff FROM {src}"


@query("bias_audit_stages", f"""
WITH lines AS (SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey), cases AS (SELECT o_orderkey, any_value(o_orderdate) AS o_orderdate, any_value(o_custkey) AS o_custkey, bool_or(l_returnflag = 'R') AS ret FROM lines GROUP BY 1),
joined AS (SELECT * FROM cases JOIN customer ON o_custkey = c_custkey), per AS (SELECT c_nationkey, avg(CAST(ret AS INTEGER)) FILTER (o_orderdate >= TIMESTAMP '1998-05-01') AS a, avg(CAST(ret AS INTEGER)) FILTER (o_orderdate < TIMESTAMP '1998-05-01') AS b FROM joined GROUP BY 1),
stages AS ({_STAGE.format(i=1, name='rows', y="l_returnflag = 'R'", src='lines')} UNION ALL {_STAGE.format(i=2, name='cases', y='ret', src='cases')} UNION ALL {_STAGE.format(i=3, name='eligible', y='ret', src="(SELECT * FROM joined WHERE c_acctbal > 0)")} UNION ALL SELECT 4, 'equal_service', avg(a - b) FROM per)
SELECT stage, label, round(diff, 6) AS diff, round(diff - lag(diff) OVER (ORDER BY stage), 6) AS delta FROM stages""")
def bias_audit_stages(spark, sf_dir):
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    after = F.col("o_orderdate") >= F.lit("1998-05-01").cast("timestamp_ntz")
    lines = o.join(li, o.o_orderkey == li.l_orderkey)
    cases = lines.groupBy("o_orderkey", "o_orderdate", "o_custkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    joined = cases.join(c.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    # one pass over the lines: every stage is a ratio of sums of a few cells of nation and side
    returned, known, eligible = F.col("n_returned") > 0, F.col("c_custkey").isNotNull(), F.col("c_acctbal") > 0
    sides = joined.groupBy("c_nationkey", after.alias("after")).agg(
        F.sum("n_returned").alias("x1"), F.sum("n_lines").alias("n1"), F.count_if(returned).alias("x2"), F.count(F.lit(1)).alias("n2"),
        F.count_if(returned & eligible).alias("x3"), F.count_if(eligible).alias("n3"), F.count_if(returned & known).alias("x4"), F.count_if(known).alias("n4"),
    )
    rate = lambda i, t: F.try_divide(F.sum(F.when(F.col("after") == t, F.col(f"x{i}"))), F.sum(F.when(F.col("after") == t, F.col(f"n{i}"))))
    diff = lambda i: rate(i, True) - rate(i, False)
    per = sides.groupBy("c_nationkey").agg(diff(4).alias("d"))
    totals = sides.agg(*(diff(i).alias(f"d{i}") for i in (1, 2, 3))).crossJoin(per.agg(F.avg("d").alias("d4")))  # two rows of one
    stages = F.array(*(F.struct(F.lit(i).alias("stage"), F.lit(name).alias("label"), F.col(f"d{i}").alias("diff")) for i, name in enumerate(("rows", "cases", "eligible", "equal_service"), 1)))
    out = totals.select(F.inline(stages))
    return rounded(out.withColumn("delta", F.col("diff") - F.lag("diff").over(Window.orderBy("stage"))), "diff", "delta")


@query("diagnostics_scalars", """
SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_customers_with_orders, (SELECT count(*) FROM customer) AS n_customers,
    (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)) AS n_customer_states, (SELECT count(*) FROM orders WHERE o_orderpriority NOT LIKE '%-%') AS n_plain_priority""")
def diagnostics_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers_with_orders"), F.count_distinct("o_custkey", "o_orderstatus").alias("n_customer_states"), F.count_if(~F.col("o_orderpriority").like("%-%")).alias("n_plain_priority")
    )
    return o.crossJoin(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_customers")))  # two rows of one
