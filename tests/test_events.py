from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.operators import contracts, events, monitor

T0 = datetime(2026, 1, 1)
LOG = [
    ("e1", "c1", "open", "A", "A-1", 100, datetime(2026, 1, 1, 8), datetime(2026, 1, 1, 9)),
    ("e2", "c1", "open", "A", "A-1", 100, datetime(2026, 1, 1, 8), datetime(2026, 1, 2, 9)),
    ("e3", "c1", "close", "A", "A-2", 250, datetime(2026, 1, 3, 8), datetime(2026, 1, 3, 7)),
    ("e4", "c2", "open", "B", "B-1", None, datetime(2026, 1, 2, 8), datetime(2026, 1, 11, 9)),
    ("e5", "c2", "close", "B", "B-1", 50, datetime(2026, 1, 1, 8), datetime(2026, 1, 12, 9)),
]
SCHEMA = "id string, case string, kind string, site string, service string, cents bigint, at timestamp_ntz, arrived timestamp_ntz"


def flow(df):
    return events.case_workflow(df, "case", "at", "kind", ["open", "close"], F.when(F.col("kind") == "open", 1).otherwise(2), "site", "service", "cents", "id", ["arrived", "id"])


def test_retries_leave_one_row_with_their_statistics(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    out = events.survivors(df, ["case", "kind", "at"], [F.col("arrived").asc_nulls_last(), F.col("id")], "arrived", "site").collect()
    assert len(out) == 4
    first = next(r for r in out if r.id == "e1")
    assert (first.copies, first.first_seen, first.last_seen, first.n_sources) == (2, LOG[0][7], LOG[1][7], 1)


def test_case_state_follows_event_time_not_arrival(spark):
    out = {r.case: r for r in flow(spark.createDataFrame(LOG, SCHEMA)).collect()}
    assert out["c2"].last_state == "open" and out["c2"].inversions == 1 and out["c2"].total_cents == 50
    assert out["c1"].first_service == "A-1" and out["c1"].n_services == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(order=st.permutations(range(5)), parts=st.integers(1, 6))
def test_totals_ignore_order_and_partitioning(spark, order, parts):
    df = spark.createDataFrame([LOG[i] for i in order], SCHEMA).repartition(parts)
    assert {r.case: r.total_cents for r in flow(df).collect()} == {"c1": 450, "c2": 50}


def test_lateness_and_rejection(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    late = events.late_arrivals(df, "at", "arrived", F.date_format("arrived", "yyyy-MM"), "site", "2026-01-03").collect()
    assert {r.lag_days for r in late if r.is_late} == {9, 11}
    reason = events.first_reason(*events.ingest_lag_rules(F.col("at"), F.col("arrived"), 10))
    assert {r.id: r.r for r in df.select("id", reason.alias("r")).collect() if r.r} == {"e3": "ingest_before_event", "e5": "ingest_too_late"}


def test_contracts_fail_loudly(spark):
    df = spark.createDataFrame(LOG, SCHEMA)
    assert contracts.grain(df, ["id"]).first().passed
    with pytest.raises(contracts.ContractError, match="cases"):
        contracts.require(contracts.grain(df, ["case"], "cases"))
    right = spark.createDataFrame([("c1",), ("c1",)], "k string")
    failed = {r.contract for r in contracts.many_to_one(df, right, "case", "k", "j").collect() if not r.passed}
    assert failed == {"j.unique", "j.unmatched", "j.rows"}


def test_streaks_break_at_gaps_and_turns(spark):
    rows = [("2026-01-05", True, "up"), ("2026-01-12", True, "up"), ("2026-01-19", True, "down"), ("2026-02-02", True, "down"), ("2026-02-09", False, "down")]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, d string, b boolean, dir string").withColumn("d", F.col("d").cast("date"))
    assert [r.streak for r in monitor.streaks(df, ["k"], "d", "b", "dir").orderBy("d").collect()] == [1, 2, 1, 1, 0]


def test_same_week_rows_do_not_see_each_other(spark):
    rows = [("a", "2026-01-05", 10, 1), ("b", "2026-01-05", 10, 9), ("a", "2026-01-12", 10, 2)]
    df = spark.createDataFrame(rows, "s string, w string, n int, e int").withColumn("w", F.col("w").cast("date"))
    out = {(r.s, str(r.w)): r.expected for r in monitor.seasonal_shrinkage(df, "s", "w", F.month("w"), "n", "e").collect()}
    assert out["a", "2026-01-05"] is None and out["a", "2026-01-12"] == pytest.approx((1 + 50 * 0.5) / 60 + 0.5 - 0.5)


def test_study_windows_on_both_clocks(spark):
    # the night of the change in spring: 02:30 does not exist; the evening before the window starts is inside it in UTC
    rows = spark.createDataFrame([(0, "2026-03-08 02:30:00"), (1, "2026-03-07 19:00:00"), (2, None), (3, "2026-03-14 23:59:59"), (4, "2026-03-07 19:00:00")], "k int, w string").withColumn("w", F.col("w").cast("timestamp_ntz"))
    found = {r.k: r for r in events.window_labels(rows, "w", "America/Chicago", "2026-03-08", "2026-03-15", fixed_utc=F.when(F.col("k") == 4, True)).collect()}
    assert (found[0].resolution, found[0].local_window, found[0].utc_window) == ("nonexistent_local_time", "within", "unknown")
    assert (found[1].local_window, found[1].utc_window, found[1].offset) == ("before", "within", -21600)
    assert (found[2].local_window, found[2].utc_window) == ("unknown", "unknown")
    assert (found[3].local_window, found[3].utc_window) == ("within", "after")
    assert (found[4].local_window, found[4].utc_window, found[4].resolution) == ("before", "before", "fixed_utc")


def test_metrics_of_every_kind_are_found_by_id(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", "a", 0.5, 1), (2, "2024-01-01", "a", 0.5, None), (3, "2024-01-01", "a", None, 0), (4, "2024-01-08", "a", None, None)], "e int, w string, s string, score double, y int")
    rows = rows.withColumn("w", F.to_date("w"))
    kinds = {"drift": F.col("score").isNotNull(), "calibration": (F.col("score") > 0) & (F.col("y") >= 0), "outcome": F.col("y") >= 0}
    found = {}
    for r in monitor.by_kind(rows, kinds, ["w", "s"]).collect():
        found.setdefault(r.metric_id, set()).add(r.e)
    assert found == {"drift/2024-01-01/a": {1, 2}, "calibration/2024-01-01/a": {1}, "outcome/2024-01-01/a": {1, 3}}
    for metric_id, inputs in found.items():
        assert {(r.metric_id, r.e) for r in monitor.find_metric(rows, kinds, ["w", "s"], ["e"], metric_id).collect()} == {(metric_id, e) for e in inputs}
    for missing in ("drift/2024-01-08/a", "other/2024-01-01/a", "drift/2024-01-01", "drift/no day/a"):
        assert monitor.find_metric(rows, kinds, ["w", "s"], ["e"], missing).isEmpty()


def test_unanimous_values_move_once(spark):
    """Equal results for keys in sets and keys of many rows; rows aren't copied for each distinct count."""
    rows = [(k, v, w, c) for k in (1, 2, 3, None) for v, w, c in [("a", 0.0, 1), ("a", -0.0, 2), ("b" if k == 2 else "a", None, 2)]] + [(3, "a", 1.0, None)]
    df = spark.createDataFrame(rows, "k int, v string, w double, c int")
    want = {1: ("a", 1, 0.0, 1, 2), 2: (None, 2, 0.0, 1, 2), 3: ("a", 1, None, 2, 2), None: ("a", 1, 0.0, 1, 2)}
    for most in (10**6, 3, 0):
        out = events.resolve_unanimous(df, "k", ["v", "w"], counted={"n": F.col("c")}, most_rows=most)
        assert out.dtypes == [("k", "int"), ("v", "string"), ("n_v", "bigint"), ("w", "double"), ("n_w", "bigint"), ("n", "bigint")]
        assert {r.k: (r.v, r.n_v, r.w, r.n_w, r.n) for r in out.collect()} == want
    plan = events.resolve_unanimous(df, "k", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 0 and "collect_set" in plan


def test_coverage_is_one_aggregation(spark):
    left, right = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a int"), spark.createDataFrame([(2,), (3,), (3,), (None,)], "b int")
    out = contracts.coverage(left, right, "a", "b")
    assert sorted(out.collect(), key=str) == sorted([("left_only", 1), ("left_only", None), ("right_only", 3), ("right_only", None)], key=str)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
