"""Queries that resample, fit small panels or keep books of numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions.identifiers import week_start
from tidewake.operators import matrix, registry, resample
from tidewake.plans.cohort_queries import _DID_SQL, _did
from tidewake.plans.inputs import SCORED_SQL, STUDY_SQL, query, scored_cases, study, table
from tidewake.plans.score_queries import rounded

DRAWS = 9999
_W = ", ".join(f"{w!r}::DOUBLE" for w in resample.SIX_POINTS)


@query("webb_bootstrap", f"""WITH {STUDY_SQL}, {_DID_SQL}, e AS (SELECT service, r11 - r10 - (r01 - r00) AS did FROM did WHERE smallest > 0), d AS (SELECT range AS draw FROM range({DRAWS})),
m AS (SELECT draw, avg(list_extract([{_W}], 1 + CAST(CAST('0x' || substr(md5('webb-1|' || draw || '|' || service), 1, 8) AS BIGINT) % 6 AS INTEGER)) * did) AS m FROM e, d GROUP BY 1), t AS (SELECT avg(did) AS estimate, count(*) AS n_clusters FROM e)
SELECT round(any_value(estimate), 6) AS estimate, any_value(n_clusters) AS n_clusters, count(*) AS draws, round((1 + count(*) FILTER (abs(m) >= abs(estimate))) / (1 + count(*)), 6) AS p, round(any_value(estimate) - quantile_cont(m, 0.975), 6) AS low, round(any_value(estimate) - quantile_cont(m, 0.025), 6) AS high FROM m, t""")
def webb_bootstrap(spark, sf_dir):
    return rounded(resample.wild_bootstrap(_did(spark, sf_dir).select("service", "did"), "service", "did", DRAWS, "webb-1"), "estimate", "p", "low", "high")


@query("cluster_bootstrap", f"""WITH {SCORED_SQL}, s AS (SELECT source, count(*) FILTER (y = 1 AND score >= 0.3) AS tp, count(*) FILTER (y = 1) AS pos FROM scored GROUP BY 1), c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM s),
p AS (SELECT d.range AS draw, CAST('0x' || substr(md5('boot-1|' || d.range || '|' || x.range), 1, 8) AS BIGINT) % k AS i FROM range({DRAWS}) d, (SELECT any_value(k) AS k FROM c) kk, range(1000) x WHERE x.range < k),
e AS (SELECT draw, sum(tp) / CAST(sum(pos) AS DOUBLE) AS r FROM p JOIN c USING (i) JOIN s USING (source) GROUP BY 1 HAVING sum(pos) > 0)
SELECT round((SELECT sum(tp) / CAST(sum(pos) AS DOUBLE) FROM s), 6) AS estimate, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.975), 6) AS high, count(*) AS draws FROM e""")
def cluster_bootstrap(spark, sf_dir):
    hit = (F.col("y") == 1) & (F.col("score") >= 0.3)
    stats = scored_cases(spark, sf_dir).groupBy("source").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("y") == 1).alias("pos"))
    return rounded(resample.cluster_bootstrap(stats, "source", "tp", "pos", DRAWS, "boot-1"), "estimate", "low", "high")


_TIMES_SQL = f"""c AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT source FROM scored)),
p AS (SELECT d.range AS draw, CAST('0x' || substr(md5('{{seed}}|' || d.range || '|' || x.range), 1, 8) AS BIGINT) % k AS i FROM range({DRAWS}) d, (SELECT any_value(k) AS k FROM c) kk, range(1000) x WHERE x.range < k),
times AS (SELECT draw, source, count(*) AS times FROM p JOIN c USING (i) GROUP BY 1, 2)"""
_ODDS = "0.3 / 0.7::DOUBLE"
_MEASURES_SQL = {
    "sensitivity": "tp / nullif(tp + fn, 0)", "specificity": "tn / nullif(tn + fp, 0)", "ppv": "tp / nullif(tp + fp, 0)", "npv": "tn / nullif(tn + fn, 0)", "balanced_accuracy": "(tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2",
    "auc": "wins / nullif((tp + fn) * (fp + tn), 0)", "brier": "squares / (tp + fp + fn + tn)", "log_loss": "losses / (tp + fp + fn + tn)", "net_benefit": f"(tp - fp * {_ODDS}) / (tp + fp + fn + tn)",
}
_AS_ROWS = " UNION ALL ".join(f"SELECT {{key}} '{m}' AS measure, CAST({e} AS DOUBLE) AS value FROM {{src}}" for m, e in _MEASURES_SQL.items())


@query("classification_bootstrap", f"""WITH {SCORED_SQL}, s AS (SELECT source, count(*) FILTER (y = 1 AND score >= 0.3) AS tp, count(*) FILTER (y = 0 AND score >= 0.3) AS fp, count(*) FILTER (y = 1 AND score < 0.3) AS fn, count(*) FILTER (y = 0 AND score < 0.3) AS tn,
    sum((score - y) * (score - y)) AS squares, sum(-(y * ln(least(greatest(score, 1e-12), 1 - 1e-12)) + (1 - y) * ln(1 - least(greatest(score, 1e-12), 1 - 1e-12)))) AS losses FROM scored GROUP BY 1),
w AS (SELECT a.source AS a, b.source AS b, sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS wins FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0 GROUP BY 1, 2),
{_TIMES_SQL.format(seed='joint-1')}, sums AS (SELECT draw, CAST(sum(times * tp) AS DOUBLE) AS tp, CAST(sum(times * fp) AS DOUBLE) AS fp, CAST(sum(times * fn) AS DOUBLE) AS fn, CAST(sum(times * tn) AS DOUBLE) AS tn, sum(times * squares) AS squares, sum(times * losses) AS losses FROM times JOIN s USING (source) GROUP BY 1),
won AS (SELECT x.draw, CAST(sum(x.times * z.times * wins) AS DOUBLE) AS wins FROM times x JOIN w ON w.a = x.source JOIN times z ON z.draw = x.draw AND z.source = w.b GROUP BY 1), drawn AS (SELECT sums.*, coalesce(wins, 0) AS wins FROM sums LEFT JOIN won USING (draw)),
total AS (SELECT CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(tn) AS DOUBLE) AS tn, sum(squares) AS squares, sum(losses) AS losses, (SELECT CAST(sum(wins) AS DOUBLE) FROM w) AS wins FROM s),
point AS ({_AS_ROWS.format(key='', src='total')}), each AS ({_AS_ROWS.format(key='draw,', src='drawn')})
SELECT p.measure, round(any_value(p.value), 6) AS estimate, round(quantile_cont(e.value, 0.025), 6) AS low, round(quantile_cont(e.value, 0.975), 6) AS high, count(e.value) AS draws FROM point p LEFT JOIN each e ON e.measure = p.measure GROUP BY 1""")
def classification_bootstrap(spark, sf_dir):
    return rounded(resample.classification_bootstrap(scored_cases(spark, sf_dir), "source", "y", "score", 0.3, DRAWS, "joint-1"), "estimate", "low", "high")


@query("reliability_bins_clustered", f"""WITH {SCORED_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS i, count(*) OVER () AS m FROM scored), cells AS (SELECT CAST(floor((i * 7 - 1) / m) AS INTEGER) AS bin, source, count(*) AS n, sum(y) AS events, sum(score) AS scores FROM r GROUP BY 1, 2),
{_TIMES_SQL.format(seed='bins-1')}, e AS (SELECT draw, bin, sum(times * events) / CAST(sum(times * n) AS DOUBLE) AS rate FROM times JOIN cells USING (source) GROUP BY 1, 2), q AS (SELECT bin, quantile_cont(rate, 0.025) AS low, quantile_cont(rate, 0.975) AS high FROM e GROUP BY 1)
SELECT bin, CAST(sum(n) AS BIGINT) AS n, round(sum(scores) / sum(n), 6) AS mean_score, round(sum(events) / CAST(sum(n) AS DOUBLE), 6) AS observed, count(*) AS n_clusters, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high FROM cells JOIN q USING (bin) GROUP BY 1""")
def reliability_bins_clustered(spark, sf_dir):
    out = resample.cluster_reliability(scored_cases(spark, sf_dir), "source", "y", "score", "doc_id", 7, DRAWS, "bins-1")
    return rounded(out, "mean_score", "observed", "low", "high")


def _panel(spark, sf_dir):
    rows = study(spark, sf_dir).withColumn("quarter", F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM"))
    return rows.groupBy("service", "site", "quarter", (F.col("quarter") >= "1998-07").alias("after")).agg(F.avg("o_totalprice").alias("value"))


@query("synthetic_control")
def synthetic_control(spark, sf_dir):
    return rounded(matrix.synthetic_effects(_panel(spark, sf_dir), "service", "quarter", "value", "after", ridge=0.01), "effect", "fit", "placebo_p")


@query("two_way_fixed_effects", f"""WITH {STUDY_SQL}, p AS (SELECT service, site, strftime(date_trunc('quarter', o_orderdate), '%Y-%m') AS quarter, avg(o_totalprice) AS y FROM study GROUP BY 1, 2, 3), kept AS (SELECT *, CAST(quarter >= '1998-07' AND site = 'A' AS DOUBLE) AS d FROM p QUALIFY count(*) OVER (PARTITION BY service) = (SELECT count(DISTINCT quarter) FROM p)),
c AS (SELECT service, y - avg(y) OVER u - avg(y) OVER t + avg(y) OVER () AS a, d - avg(d) OVER u - avg(d) OVER t + avg(d) OVER () AS b FROM kept WINDOW u AS (PARTITION BY service), t AS (PARTITION BY quarter)), e AS (SELECT sum(a * b) / sum(b * b) AS beta, sum(b * b) AS total FROM c),
s AS (SELECT service, sum(b * (a - beta * b)) AS score FROM c, e GROUP BY 1), k AS (SELECT count(*) AS k, sum(score * score) AS ss FROM s)
SELECT 'all' AS grp, k AS n_units, round(beta, 6) AS effect, round(beta / (sqrt(ss * k / (k - 1)) / total), 6) AS t FROM e, k""")
def two_way_fixed_effects(spark, sf_dir):
    panel = _panel(spark, sf_dir).withColumn("treated", (F.col("after") & (F.col("site") == "A")).cast("double")).withColumn("all", F.lit("all"))
    return rounded(matrix.two_way_effects(panel, "all", "service", "quarter", "value", "treated"), "effect", "t")


#: The grid of a planned rollout: fixed values.
EFFECTS, ICCS, SIMULATIONS = (0.0, -0.01, -0.02, -0.03, -0.04, -0.05, -0.06, -0.08, -0.10), (0.01, 0.03, 0.05), 2000
STARTS = (16, 24, 32, 40)


@query("rollout_power")
def rollout_power(spark, sf_dir):
    """Eight components of services, by site; rates and weekly cases are those of the orders."""
    weeks = F.count_distinct(week_start("o_orderdate"))
    cells = study(spark, sf_dir).groupBy(F.pmod("c_nationkey", F.lit(8)).alias("component"), F.when(F.col("c_nationkey") % 2 == 0, "A").otherwise("B").alias("site"))
    found = cells.agg(F.avg(F.col("y").cast("double")).alias("base"), (F.count(F.lit(1)) / weeks).alias("weekly")).orderBy("component").collect()  # eight rows
    starts = [STARTS[i // 2 % 4] for i in range(len(found))]
    design = matrix.Rollout(tuple(r.base for r in found), tuple(round(r.weekly) for r in found), tuple(r.site for r in found), tuple(starts))
    return rounded(matrix.rollout_power(spark, design, EFFECTS, ICCS, SIMULATIONS, 31082026), "critical", "power", "fixed_power")


@query("number_registry", f"""WITH {STUDY_SQL}, {_DID_SQL}, r AS (SELECT service, CAST(n AS DOUBLE) AS n, round(r11 - r10 - (r01 - r00), 6) AS did FROM did WHERE smallest > 0), u AS (UNPIVOT r ON did, n INTO NAME cell VALUE value)
SELECT 'did-' || lpad(CAST(row_number() OVER (ORDER BY service, cell) AS VARCHAR), 6, '0') AS number_id, 'did' AS source_table, service AS row_key, cell, value, CASE cell WHEN 'did' THEN 'rate' ELSE 'number' END AS unit, 'computed' AS status FROM u""")
def number_registry(spark, sf_dir):
    results = rounded(_did(spark, sf_dir), "did").select("service", "n", "did")
    return registry.number_registry(results, "did", ["service"], {"did": "rate"})


@query("exploded_defects", """SELECT c_custkey, defect FROM (SELECT c_custkey, unnest(list_filter(list_transform(string_split(CASE c_custkey % 4 WHEN 0 THEN 'late; missing' WHEN 1 THEN 'late' WHEN 2 THEN ';' ELSE '' END, ';'), lambda x: trim(x)), lambda x: x <> '')) AS defect FROM customer)""")
def exploded_defects(spark, sf_dir):
    k = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, "late; missing").when(k == 1, "late").when(k == 2, ";").otherwise("").alias("defects"))
    return registry.explode_listed(rows, "defects", "defect").select("c_custkey", "defect")


@query("comparison_ledger", """WITH a AS (SELECT r_name AS item, r_regionkey AS n FROM region), b AS (SELECT n_name AS item, n_regionkey AS region FROM nation)
SELECT source_table, item, n, region, row_number() OVER (ORDER BY source_table, item) AS row FROM (SELECT 'nations' AS source_table, item, NULL AS n, region FROM b UNION ALL SELECT 'regions', item, n, NULL FROM a)""")
def comparison_ledger(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_name").alias("item"), F.col("r_regionkey").alias("n"))
    b = table(spark, sf_dir, "nation").select(F.col("n_name").alias("item"), F.col("n_regionkey").alias("region"))
    return registry.stacked_ledger({"regions": a, "nations": b}, ["item"])
