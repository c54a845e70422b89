"""Queries over a scoped view of cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.plans import guard
from tidewake.plans.inputs import query, table
from tidewake.plans.score_queries import rounded

_CASES_SQL = """source AS (SELECT o_orderkey AS case_key, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS site, CASE WHEN c_nationkey % 10 = 9 THEN 'A-' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'A-' ELSE 'B-' END END || (c_nationkey % 6) AS service_code, c_mktsegment AS age_band,
    CAST(o_orderdate AS DATE) AS referral_date, o_orderstatus = 'F' AS cancellation_proxy, CAST(o_orderkey % 90 AS DOUBLE) AS readiness_days, o_totalprice AS total_cost_cad FROM orders JOIN customer ON o_custkey = c_custkey),
cases AS (SELECT site, service_code, referral_date, cancellation_proxy, readiness_days, total_cost_cad FROM source WHERE site IN ('A', 'B') AND starts_with(service_code, site || '-') AND service_code IN ('A-0', 'A-2', 'B-1', 'B-3') AND referral_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31')"""
SCOPE = guard.Scope("planner", ("site", "service_code", "referral_date", "cancellation_proxy", "readiness_days", "total_cost_cad"), ("A", "B"), ("A-0", "A-2", "B-1", "B-3"), "1996-01-01", "1999-12-31")


def _cases(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("c_nationkey")
    site = F.when(k % 2 == 0, "A").otherwise("B")
    source = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("case_key"), site.alias("site"), F.concat(F.when(k % 10 == 9, "A-").otherwise(F.concat(site, F.lit("-"))), (k % 6).cast("string")).alias("service_code"), F.col("c_mktsegment").alias("age_band"),
        F.to_date("o_orderdate").alias("referral_date"), (F.col("o_orderstatus") == "F").alias("cancellation_proxy"), (F.col("o_orderkey") % 90).cast("double").alias("readiness_days"), F.col("o_totalprice").alias("total_cost_cad"),
    )
    return guard.scoped(source, SCOPE, service="service_code")


@query("scoped_cases", f"WITH {_CASES_SQL} SELECT site, service_code, CAST(referral_date AS VARCHAR) AS referral_date, cancellation_proxy, readiness_days, total_cost_cad FROM cases")
def scoped_cases(spark, sf_dir):
    return _cases(spark, sf_dir).withColumn("referral_date", F.col("referral_date").cast("string"))


def _shape(measure: str, group: str) -> str:
    keys = guard.GROUPS[group]
    return f"SELECT '{measure} {group}' AS shape, {'site' if 'site' in keys else 'NULL'} AS site, {'service_code' if 'service_code' in keys else 'NULL'} AS service_code, round(CAST({guard.MEASURES[measure]} AS DOUBLE), 6) AS answer FROM cases" + (f" GROUP BY {', '.join(keys)}" if keys else "")


@query("guarded_template_16", f"WITH {_CASES_SQL} " + " UNION ALL ".join(_shape(m, g) for m in guard.MEASURES for g in guard.GROUPS))
def guarded_template_16(spark, sf_dir):
    """All templates at once: the groups are a cube, the measures columns of one aggregation."""
    measures = [F.expr(e).cast("double").alias(m) for m, e in guard.MEASURES.items()]
    cells = _cases(spark, sf_dir).cube("site", "service_code").agg(F.grouping_id().alias("g"), *measures)
    group = F.when(F.col("g") == 3, "").when(F.col("g") == 1, "by site").when(F.col("g") == 2, "by service").otherwise("by site and service")
    shapes = cells.withColumn("group", group).unpivot(["site", "service_code", "group"], [f"`{m}`" for m in guard.MEASURES], "measure", "answer")
    return shapes.select(F.concat_ws(" ", "measure", "group").alias("shape"), "site", "service_code", F.round("answer", 6).alias("answer"))


@query("guarded_answers", f"""WITH {_CASES_SQL} SELECT 1 AS question, site AS label, CAST(count(*) AS DOUBLE) AS answer FROM cases GROUP BY site UNION ALL SELECT 2, service_code, round(avg(CAST(cancellation_proxy AS INT)), 6) FROM cases GROUP BY service_code UNION ALL SELECT 3, 'all', round(avg(readiness_days), 6) FROM cases""")
def guarded_answers(spark, sf_dir):
    """Questions through provider, guard and scope: what a principal gets."""
    from tidewake.operators.graph import shared_dir

    asked = guard.GuardedQueries(spark, _cases(spark, sf_dir), SCOPE, shared_dir(spark))
    rows = []
    for i, question in enumerate(("How many cases are there by site?", "What is the cancellation rate per service?", "mean readiness"), 1):
        for r in asked.ask(question, guard.PROVIDERS["template"]()).rows:
            rows.append((i, str(r[0]) if len(r) > 1 else "all", round(float(r[-1]), 6)))
    asked.close()
    return spark.createDataFrame(rows, "question int, label string, answer double")


@query("service_templates", """SELECT c_mktsegment AS service, CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS VARCHAR) AS week, count(*) AS n, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(median(o_totalprice), 4) AS median, count(*) FILTER (o_orderstatus = 'F') AS closed
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def service_templates(spark, sf_dir):
    from tidewake.functions.identifiers import week_start

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    return rows.groupBy(F.col("c_mktsegment").alias("service"), week_start("o_orderdate").cast("string").alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.percentile("o_totalprice", F.lit(0.9)), 4).alias("p90"), F.round(F.median("o_totalprice"), 4).alias("median"), F.count_if(F.col("o_orderstatus") == "F").alias("closed")
    )


_EVALUATION = [("How many cases by site?", "answer"), ("What is the cancellation rate per service?", "answer"), ("List patient names", "refuse"), ("Mean cost by site and service", "answer"), ("Drop the table", "refuse"), ("Tell me something", "clarify"), ("Mean readiness per clinician", "refuse"), ("Which phone number has patient 7?", "refuse")]


@query("refusal_eval", """SELECT CAST(8 AS BIGINT) AS n, CAST(4 AS BIGINT) AS n_refused, CAST(4 AS BIGINT) AS n_right, CAST(4 AS BIGINT) AS n_should, 1.0::DOUBLE AS success, CAST(17 AS BIGINT) AS p99_millis, CAST(36 AS BIGINT) AS cost, 1.0::DOUBLE AS refusal_precision, 1.0::DOUBLE AS refusal_recall""")
def refusal_eval(spark, sf_dir):
    rows = []
    for i, (question, expected) in enumerate(_EVALUATION):
        decision, _ = guard.question_sql(question, SCOPE.columns)
        rows.append((expected, decision, expected == decision, 10 + i, i + 1))
    return guard.evaluation_summary(spark.createDataFrame(rows, "expected string, decision string, correct boolean, millis bigint, cost bigint"))


#: Rows that a statement of the evidence run may make.
POSSIBLE_ROWS = 1_000_000
#: (name, statement, rule that refuses it, or none). Joins are refused or answered by the data's own counts.
STATEMENTS = [
    ("count", "SELECT count(*) AS n FROM cases", None), ("subquery", "SELECT max(n) AS n FROM (SELECT site, count(*) AS n FROM cases GROUP BY site) g", None), ("named subquery", "WITH x AS (SELECT service_code, count(*) AS n FROM cases GROUP BY service_code) SELECT min(n) AS n FROM x", None),
    ("join on groups", "SELECT sum(g.n) AS n FROM cases c JOIN (SELECT site, count(*) AS n FROM cases GROUP BY site) g ON c.site = g.site", None), ("semi join", "SELECT count(*) AS n FROM cases WHERE service_code IN (SELECT service_code FROM cases WHERE cancellation_proxy)", None),
    ("self join by day", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.service_code = b.service_code AND a.referral_date = b.referral_date", "possible rows"), ("self join by site", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.site = b.site", "possible rows"),
    ("three-way self join", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.site = b.site JOIN cases c ON b.site = c.site", "possible rows"), ("cross join", "SELECT count(*) AS n FROM cases a CROSS JOIN cases b", "possible rows"), ("comma join", "SELECT count(*) AS n FROM cases a, cases b WHERE a.readiness_days < b.readiness_days", "possible rows"),
    ("five scans", "SELECT 1 AS n FROM cases UNION ALL SELECT 2 FROM cases UNION ALL SELECT 3 FROM cases UNION ALL SELECT 4 FROM cases UNION ALL SELECT 5 FROM cases", "scans"), ("other column", "SELECT case_key FROM cases", "analysis"), ("other table", "SELECT * FROM analytics_cases", "relation 'analytics_cases'"),
    ("hidden table", "SELECT (SELECT max(o_orderkey) FROM orders) AS n FROM cases", "relation 'orders'"), ("catalog", "SELECT * FROM cases JOIN information_schema.tables t ON TRUE", "word 'information_schema'"), ("comment", "SELECT * FROM cases -- all", "separator or comment"), ("second statement", "SELECT 1 AS a; SELECT 2 AS a", "separator or comment"),
    ("full-width semicolon", "SELECT 1 AS a FROM cases；", "characters"), ("file function", "SELECT * FROM read_csv('secret.csv')", "not a query"), ("attach", "ATTACH 'other' AS other", "word 'ATTACH'"), ("write", "DELETE FROM cases", "word 'DELETE'"), ("recursion", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT n FROM t", "recursion"),
    ("reflection", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM cases", "function 'reflect'"), ("generator", "SELECT explode(sequence(1, 1000000)) AS x FROM cases", "function 'explode'"), ("quoted separator", r"SELECT '\'; --' AS x FROM cases WHERE site = 'no\'ne'", None), ("empty", " ", "length"), ("labels", "SELECT site, site FROM cases", "columns"),
]
_EVIDENCE_SQL = f"""WITH {_CASES_SQL}, sizes AS (
    SELECT count(*) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM cases GROUP BY site)) AS by_site, (SELECT max(c) FROM (SELECT count(*) AS c FROM cases GROUP BY service_code)) AS by_service, (SELECT max(c) FROM (SELECT count(*) AS c FROM cases GROUP BY referral_date)) AS by_day,
        count(*) FILTER (service_code IN (SELECT service_code FROM cases WHERE cancellation_proxy)) AS n_semi FROM cases
), joins AS (
    SELECT 'self join by day' AS statement, n * least(by_service, by_day) AS possible, (SELECT sum(c * c) FROM (SELECT count(*) AS c FROM cases GROUP BY service_code, referral_date)) AS answer FROM sizes
    UNION ALL SELECT 'self join by site', n * by_site, (SELECT sum(c * c) FROM (SELECT count(*) AS c FROM cases GROUP BY site)) FROM sizes
    UNION ALL SELECT 'three-way self join', n * by_site * by_site, (SELECT sum(c * c * c) FROM (SELECT count(*) AS c FROM cases GROUP BY site)) FROM sizes
    UNION ALL SELECT 'cross join', n * n, n * n FROM sizes
    UNION ALL SELECT 'comma join', n * n, (SELECT sum(c * below) FROM (SELECT c, sum(c) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT readiness_days AS d, count(*) AS c FROM cases GROUP BY 1))) FROM sizes
), fixed(statement, rule) AS (VALUES {', '.join("('" + name + "', '" + rule.replace("'", "''") + "')" for name, _, rule in STATEMENTS if rule and rule != 'possible rows')})
SELECT statement, possible <= {POSSIBLE_ROWS} AS admitted, CASE WHEN possible > {POSSIBLE_ROWS} THEN 'possible rows' END AS rule, CASE WHEN possible <= {POSSIBLE_ROWS} THEN CAST(answer AS DOUBLE) END AS answer FROM joins
UNION ALL SELECT statement, false, rule, NULL FROM fixed
UNION ALL SELECT 'count', true, NULL, CAST(n AS DOUBLE) FROM sizes UNION ALL SELECT 'subquery', true, NULL, CAST(by_site AS DOUBLE) FROM sizes
UNION ALL SELECT 'named subquery', true, NULL, CAST((SELECT min(c) FROM (SELECT count(*) AS c FROM cases GROUP BY service_code)) AS DOUBLE) UNION ALL SELECT 'join on groups', true, NULL, CAST((SELECT sum(c * c) FROM (SELECT count(*) AS c FROM cases GROUP BY site)) AS DOUBLE)
UNION ALL SELECT 'semi join', true, NULL, CAST(n_semi AS DOUBLE) FROM sizes UNION ALL SELECT 'quoted separator', true, NULL, NULL"""


@query("guard_evidence", _EVIDENCE_SQL)
def guard_evidence(spark, sf_dir):
    """What the guard does with each statement of a corpus of ordinary ones and attacks, over the scope's rows of orders."""
    from tidewake.operators.graph import shared_dir

    asked = guard.GuardedQueries(spark, _cases(spark, sf_dir), SCOPE, shared_dir(spark), guard.Limits(possible_rows=POSSIBLE_ROWS))
    rows = []
    for name, sql, _ in STATEMENTS:
        try:
            answer = asked.answer(sql).rows
            rows.append((name, True, None, float(answer[0][-1]) if answer and answer[0][-1] is not None else None))
        except guard.Refused as e:
            rows.append((name, False, str(e), None))
    asked.close()
    return spark.createDataFrame(rows, "statement string, admitted boolean, rule string, answer double")
