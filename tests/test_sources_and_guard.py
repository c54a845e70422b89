import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewake.operators.contracts import ContractError
from tidewake.plans import guard
from tidewake.sources import event_log, incremental, publish
from tidewake.streaming import scored_cases


def write_month(folder, month, column="service_code", n=3):
    at = pa.array([datetime(2026, int(month[-2:]), 1 + i) for i in range(n)], pa.timestamp("ns"))
    text = lambda v: pa.array([v] * n)
    table = pa.table({"event_id": pa.array([f"{month}-{i}" for i in range(n)]), **{c: text("x") for c in ("case_id", "event_type", "site", "clinician_id", "ward_id", "event_ts", "source_system")}, column: text("s1"), "ingest_ts": at, "cost_cad": pa.array([1.5] * n), "tz_offset_hours": pa.array([None] * n, pa.float64())})
    pq.write_table(table, f"{folder}/ingest_month={month}.parquet")


def test_log_of_two_generations_and_nanoseconds(spark, tmp_path):
    write_month(tmp_path, "2026-01", "svc_code")
    write_month(tmp_path, "2026-02")
    write_month(tmp_path, "2026-03")
    files = event_log.month_files(spark, str(tmp_path), last="2026-02")
    assert list(files) == ["2026-01", "2026-02"]
    df = event_log.read_events(spark, [f[0] for f in files.values()])
    assert dict(df.dtypes)["ingest_ts"] == "timestamp_ntz" and df.count() == 6
    assert df.filter("svc_code = 's1' AND service_code IS NULL").count() == 3
    assert {r.source_partition for r in df.select("source_partition").distinct().collect()} == {"2026-01", "2026-02"}
    write_month(tmp_path, "2026-04", "other")
    with pytest.raises(ContractError, match="service_code"):
        event_log.read_events(spark, [f"{tmp_path}/ingest_month=2026-04.parquet"])


def test_texts_that_do_not_parse_are_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n 5 ,2026-1-1\nx,y\n")
    df = event_log.typed(event_log.read_texts(spark, str(tmp_path / "x.csv")), {"a": "int", "b": "date"})
    assert [(r.a, str(r.b)) for r in df.collect()] == [(5, "2026-01-01"), (None, "None")]


def test_only_changed_partitions_are_rebuilt_and_failures_resume(spark, tmp_path):
    where, made = str(tmp_path / "cache"), []

    def build(m):
        if m == "2026-03" and len(made) == 2:
            made.append("failed")
            raise RuntimeError("injected")
        made.append(m)
        return spark.range(2).withColumn("m", F.lit(m))

    inputs = {f"2026-0{i}": f"d{i}" for i in (1, 2, 3)}
    with pytest.raises(RuntimeError):
        incremental.refresh(spark, where, inputs, "v1", build)
    assert incremental.refresh(spark, where, inputs, "v1", build) == ["2026-03"]
    assert incremental.refresh(spark, where, inputs, "v1", build) == []
    assert incremental.refresh(spark, where, inputs | {"2026-02": "new"}, "v1", build) == ["2026-02"]
    assert incremental.refresh(spark, where, inputs | {"2026-02": "new"}, "v1", build, ("2026-01", "2026-01")) == ["2026-01"]
    del inputs["2026-01"]
    incremental.refresh(spark, where, inputs | {"2026-02": "new"}, "v1", build)
    assert incremental.read(spark, where).count() == 4


def test_publishing_is_atomic_and_content_addressed(spark, tmp_path):
    where = str(tmp_path / "out")
    df = spark.range(10).withColumn("x", F.col("id") * 0.5)
    first = publish.publish(spark, where, {"t": publish.Artifact(df, ("id",))}, {"in": 1})
    assert publish.publish(spark, where, {"t": publish.Artifact(df.repartition(3), ("id",))}, {"in": 1}) == first == publish.current(spark, where)
    assert publish.verify(spark, where) == []
    with pytest.raises(ContractError):
        publish.publish(spark, where, {"t": publish.Artifact(df.union(df), ("id",))}, {"in": 2})
    assert publish.current(spark, where) == first
    second = publish.publish(spark, where, {"t": publish.Artifact(df.limit(3), ("id",), kind="csv")}, {"in": 3})
    assert second != first and publish.current(spark, where) == second and publish.verify(spark, where, first) == []
    spark.range(1).write.mode("append").parquet(f"{where}/{first}/t")
    assert publish.verify(spark, where, first) == ["t"]


def test_ordered_artifacts_have_row_groups_of_fixed_rows_and_as_many_files_as_tasks(spark, tmp_path):
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_000).alias("k"))
    publish.write_ordered(df, str(tmp_path / "one"), ["k"], single=True)
    (file,) = (tmp_path / "one").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [publish.ROW_GROUP_ROWS, publish.ROW_GROUP_ROWS, 300_000 - 2 * publish.ROW_GROUP_ROWS]
    assert meta.row_group(0).column(0).compression == "ZSTD" and pq.read_table(file)["k"].to_pylist() == list(range(300_000))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        publish.write_csv(df, str(tmp_path / "many"), ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = [f.read_text().splitlines() for f in sorted((tmp_path / "many").glob("*.csv"))]
    assert len(files) > 1 and all(lines[0] == "k" for lines in files)
    assert [int(v) for lines in files for v in lines[1:]] == list(range(300_000))
    publish.write_csv(df.limit(0), str(tmp_path / "none"), ["k"])
    assert spark.read.csv(str(tmp_path / "none"), header=True).columns == ["k"]


CASES = [("A", "A-1", "2026-01-05", True, 3.0), ("A", "A-2", "2026-01-06", False, 5.0), ("B", "B-1", "2026-01-07", True, 7.0), ("A", "B-9", "2026-01-08", True, 9.0), ("A", "A-1", "2030-01-01", True, 1.0)]


@pytest.fixture(scope="module")
def guarded(spark, tmp_path_factory):
    source = spark.createDataFrame(CASES, "site string, service string, referral_date string, cancellation_proxy boolean, readiness_days double").withColumn("referral_date", F.col("referral_date").cast("date"))
    scope = guard.Scope("p", ("site", "service", "cancellation_proxy"), ("A",), None, "2026-01-01", "2026-12-31")
    rows = guard.scoped(source, scope)
    assert guard.scope_breaches(rows, scope).first() == (0, 0, 0)
    assert guard.scope_breaches(source, scope).first() == (1, 0, 1)
    assert guard.scoped(source, guard.Scope("none", ("site",), ())).count() == 0
    return guard.GuardedQueries(spark, rows, scope, str(tmp_path_factory.mktemp("scope")), guard.Limits(rows=1, possible_rows=7))


def test_admitted_statements(guarded):
    assert guarded.answer("SELECT count(*) AS n FROM cases").rows == [[2]]
    a = guarded.answer("WITH x AS (SELECT service FROM cases) SELECT a.service FROM x a JOIN x b ON a.service = b.service ORDER BY a.service")
    assert a.rows == [["A-1"]] and a.truncated
    for sql in (
        "SELECT site, count(*) AS n, avg(CAST(cancellation_proxy AS INT)) AS r FROM cases GROUP BY site HAVING count(*) > 0", "SELECT row_number() OVER (PARTITION BY site ORDER BY service DESC) AS nth FROM cases", "SELECT max(service) AS s FROM cases WHERE service LIKE 'A-%' AND site IN ('A', 'B') OR NOT cancellation_proxy",
        "SELECT CASE WHEN count(*) > 1 THEN 'many' ELSE upper('few') END AS x FROM cases", "SELECT service FROM cases WHERE service IN (SELECT service FROM cases) ORDER BY service", "SELECT COUNT(*) AS n, Sum(1) AS s, round(avg(length(service)) / 2.0, 2) AS m FROM cases UNION ALL SELECT 1 AS n, 2 AS s, 3.0 AS m",
        "SELECT concat('x', site) AS x FROM cases", "SELECT lag(service) OVER (ORDER BY service) AS before FROM cases", "SELECT coalesce(nullif(site, 'B'), 'x') AS y, if(cancellation_proxy, 1, 0) AS z FROM cases",
    ):
        assert guarded.answer(sql).rows, sql


@pytest.mark.parametrize("sql", [
    "", "DROP TABLE cases", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/etc`", "SELECT * FROM other", "SELECT reflect('java.lang.System', 'exit') AS x FROM cases", "SELECT readiness_days FROM cases", "SELECT (SELECT 1 FROM other) AS x FROM cases",
    "SELECT count(*) AS n FROM cases a CROSS JOIN cases b CROSS JOIN cases c", "SELECT /* x */ 1 AS a", "SET x = 1", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t) SELECT n FROM t", "SELECT explode(array(1)) AS x FROM cases", "SELECT * FROM range(5)", "SELECT site, site FROM cases", "SELECT ſite FROM cases",
    "SELECT REFLECT('java.lang.System','getProperty','user.home') AS x FROM cases", "SELECT JAVA_METHOD('java.lang.System','getenv','HOME') AS x FROM cases", "SELECT Version() AS x FROM cases", "SELECT Current_User() AS x FROM cases",
    "SELECT current_user AS x FROM cases", "SELECT CURRENT_DATE AS x FROM cases", "SELECT count(*) AS n FROM cases a JOIN cases b ON a.service < b.service JOIN cases c ON b.service < c.service", "SELECT count(*) AS n FROM cases a LEFT JOIN cases b ON true LEFT JOIN cases c ON true",
    "SELECT 'WITH other AS (' AS x FROM other", "SELECT (SELECT REFLECT('java.lang.System','getProperty','user.home')) AS x FROM cases", "SELECT service FROM cases WHERE site = (SELECT Input_File_Name())", "VALUES (1)", "SELECT count(*) AS `a b` FROM cases", "SELECT * FROM (VALUES (1)) AS t(x)",
    "SELECT max(site) FILTER (WHERE REFLECT('java.lang.System','getProperty','user.home') = 'x') AS x FROM cases", "SELECT site AS x FROM cases ORDER BY Rand()", "SELECT transform(array(1), x -> x) AS a FROM cases", "TABLE cases2",
])
def test_refused_statements(guarded, sql):
    with pytest.raises(guard.Refused):
        guarded.answer(sql)


def test_audit_rows_hold_no_text(spark, guarded, monkeypatch):
    seen = []
    monkeypatch.setattr(guarded, "audit", seen.append)
    guarded.answer("SELECT count(*) AS n FROM cases")
    with pytest.raises(guard.Refused):
        guarded.answer("SELECT count(*) AS n FROM secret_table")
    guarded.ask("how MANY?", guard.PROVIDERS["fixed"]({"How many?": "SELECT count(*) AS n FROM cases"}))
    with pytest.raises(guard.Refused, match="clarify"):
        guarded.ask("why?", guard.PROVIDERS["fixed"]({}))
    assert [r["admitted"] for r in seen] == [True, False, True] and seen[0]["rows_sha256"] == seen[2]["rows_sha256"] != seen[1]["rows_sha256"]
    assert "secret_table" not in json.dumps([{k: v for k, v in r.items() if k != "reason"} for r in seen]) and seen[1]["reason"] == "relation 'secret_table'"


def test_policies_are_strict():
    good = {"version": 1, "principals": {"p": {"columns": ["site"], "sites": ["A"], "services": ["A-1"], "first_day": "2026-01-01"}}}
    assert guard.load_policy(good)["p"] == guard.Scope("p", ("site",), ("A",), ("A-1",), "2026-01-01")
    for change in ({"extra": 1}, {"sites": []}, {"sites": "A"}, {"columns": ["site", "site"]}, {"services": ["B-1"]}, {"first_day": "x"}, {"last_day": "2025-01-01"}):
        with pytest.raises(ValueError):
            guard.load_policy({"version": 1, "principals": {"p": good["principals"]["p"] | change}})
    for bad in ({"version": 2, "principals": {}}, {"version": 1}, good | {"more": 1}):
        with pytest.raises(ValueError):
            guard.load_policy(bad)


def test_pointers_are_replaced_in_one_step(spark, tmp_path):
    from tidewake.sources.store import Store

    store = Store(spark, str(tmp_path))
    for value in (1, 2, 3):
        store.write_json("state.json", {"v": value})
        assert store.read_json("state.json") == {"v": value} and not store.exists("state.json.part")


def test_questions():
    allowed = ("site", "service_code", "cancellation_proxy")
    assert guard.question_sql("How many cases are there by site?", allowed) == ("answer", guard.template_sql("count", "by site"))
    assert guard.question_sql("mean cost by site", allowed)[0] == "refuse" and guard.question_sql("Hello", allowed)[0] == "clarify"


def event(i, week, outcome, case=None, revision=1, corrects=None, **more):
    day = f"2026-01-{5 + 7 * week:02d}"
    return {"event_id": f"e{i}", "case_id": case or f"c{i}", "service_code": "A-1", "site": "A", "revision": revision, "correction_of_event_id": corrects, "scored_at": f"{day}T10:00:00+00:00", "arrived_at": f"{day}T11:00:00+00:00",
            "outcome_observed_at": f"{day}T12:00:00+00:00", "score": 0.5, "threshold": 0.5, "outcome": outcome, "numeric_features": {"b": 1.0, "a": 2.0}, "data_version": "1", "model_version": "1", "prompt_version": "1", "policy_version": "1", "commit_sha": "0" * 40} | more


def test_stream_fires_retracts_and_ignores_replays(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    watch = scored_cases.ScoredCaseMonitor(spark, str(tmp_path / "state"), matured_days=0)

    def feed(name, events):
        (source / f"{name}.json").write_text("\n".join(map(json.dumps, events)))
        scored_cases.start(spark, str(source), watch, str(tmp_path / "cp")).awaitTermination()

    feed("1", [event(1, 0, 1), event(2, 1, 1), event(9, 1, 1, score=2.0)])
    feed("2", [event(1, 0, 1), event(2, 1, 0), event(3, 2, None)])
    feed("3", [event(4, 1, 0, case="c2", revision=2, corrects="e2")])
    actions = [(r.action, r.alert_id) for r in watch.history().collect()]
    assert actions == [("fired", "2026-01-12/A/A-1"), ("retracted", "2026-01-12/A/A-1")]
    rejected = spark.read.parquet(str(tmp_path / "state/rejected"))
    assert {r.event_id for r in rejected.collect()} == {"e9", "e2"}


def test_stream_takes_first_arrivals_and_revisions_in_sequence(spark, tmp_path):
    watch = scored_cases.ScoredCaseMonitor(spark, str(tmp_path / "state"), matured_days=0)
    later = {"arrived_at": "2026-01-05T11:30:00+00:00"}
    batches = [
        [event(1, 0, 1), event(1, 0, 0, **later), event(1, 0, 1), event(2, 0, 1, case="x"), event(3, 0, 0, case="x", revision=2, corrects="e2"), event(4, 0, 0, case="y", revision=2, corrects="e9")],
        [event(5, 0, 1, case="x", revision=3, corrects="e3"), event(6, 0, 1, case="x", revision=5, corrects="e5"), event(7, 0, 1, case="c1", revision=2, corrects="e2"), event(8, 0, 1, scored_at="2026-01-04T10:00:00+00:00", arrived_at="2026-01-20T10:00:00+00:00")],
    ]
    for i, rows in enumerate(batches):
        watch.apply(spark.read.schema(scored_cases.SCHEMA).json(spark.sparkContext.parallelize(map(json.dumps, rows))), i)
    accepted = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "state/accepted")).collect()}
    assert set(accepted) == {"e1", "e2", "e3", "e5", "e8"} and accepted["e1"].outcome == 1
    assert accepted["e8"].is_late and accepted["e8"].is_backfill and not accepted["e1"].is_late
    rejected = {(r.event_id, r.reason) for r in spark.read.parquet(str(tmp_path / "state/rejected")).collect()}
    assert rejected == {("e1", "conflict"), ("e4", "sequence"), ("e6", "sequence"), ("e7", "sequence")}
    assert {r.event_id for r in watch.provenance({"site": "A"}).collect()} == {"e1", "e5", "e8"} and [r.alert_id for r in watch.current_alerts().collect()] == ["2026-01-05/A/A-1"]  # the second week running above the threshold
    assert watch.current_metrics({"service_code": "A-1"}).agg(F.sum("n")).first()[0] == 3
    with pytest.raises(ValueError):
        watch.current_metrics({"secret": 1})


def test_catalogs_and_loaders(spark, tmp_path):
    from tidewake.sources import catalogs

    spark.range(3).write.parquet(str(tmp_path / "x.parquet"))
    (tmp_path / "y.csv").write_text("a,b\n1,\n")
    assert catalogs.attach(spark, str(tmp_path), "other") == ["other_x"] and spark.table("other_x").count() == 3
    with pytest.raises(Exception):
        spark.sql("INSERT INTO other_x VALUES (9)")
    assert catalogs.load_csvs(spark, str(tmp_path), "c") == ["c_y"] and spark.table("c_y").dtypes == [("a", "string"), ("b", "string")]
    (tmp_path / "q.csv").write_text("question_id,question,asker_role\n1, How many? ,planner\n")
    assert catalogs.read_questions(spark, str(tmp_path / "q.csv")).first().question == "How many?"
    (tmp_path / "q2.csv").write_text("question_id,question,asker_role\n1,a,x\n1,b,x\n")
    with pytest.raises(ValueError):
        catalogs.read_questions(spark, str(tmp_path / "q2.csv")).count()
    (tmp_path / "cases.json").write_text('{"question": "a", "expected": "refuse"}\n')
    assert catalogs.read_cases(spark, str(tmp_path / "cases.json")).count() == 1
    (tmp_path / "bad.json").write_text('{"question": "a", "expected": "maybe"}\n')
    with pytest.raises(ValueError):
        catalogs.read_cases(spark, str(tmp_path / "bad.json"))


def test_small_sinks_and_sources(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 0.5)], "k int, b double")
    stacked = publish.stack_by_name([a, b])
    assert stacked.columns == ["k", "a", "b"] and sorted((r.k, r.b) for r in stacked.collect()) == [(1, None), (2, 0.5)]
    publish.write_csv(stacked, str(tmp_path / "s"), ["k"])
    assert [r.k for r in event_log.read_inferred(spark, str(tmp_path / "s")).orderBy("k").collect()] == [1, 2] and event_log.read_inferred(spark, str(tmp_path / "s")).dtypes[0] == ("k", "int")
    publish.append_rows(a, str(tmp_path / "ledger"))
    publish.append_rows(a, str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 2
    assert sorted(publish.upsert(a, spark.createDataFrame([(1, "new"), (3, "y")], "k int, a string"), ["k"]).collect()) == [(1, "new"), (3, "y")]
    assert event_log.literal_table(spark, "a int, b string", [(1, "x")]).first() == (1, "x")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert event_log.footer_rows(spark, str(tmp_path / "p")) == 5
    import hashlib

    (tmp_path / "f").write_bytes(b"abc" * 1000)
    assert incremental.file_digest(spark, str(tmp_path / "f")) == hashlib.sha256(b"abc" * 1000).hexdigest()
    with pytest.raises(ContractError, match="null"):
        publish.publish(spark, str(tmp_path / "o"), {"t": publish.Artifact(spark.createDataFrame([(None, 1)], "k int, v int"), ("k",))}, {})
    weekly = scored_cases.weekly_counts(spark.createDataFrame([("2026-01-05T10:00:00+00:00", "A", "A-1", 0.5)], "scored_at string, site string, service_code string, score double"))
    assert weekly.select("n", "mean_score").first() == (1, 0.5)
