"""Sketches by partition against exact figures, and refreshes that build what changed in one job."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.test_sources_and_guard import write_month
from tidewake.operators.sketches import Sketches, trailing
from tidewake.sources import event_log, incremental
from tidewake.sources.store import Store

KINDS = Sketches(distinct=("user",), quantiles=("x",))


def log(spark, n=60_000, months=3):
    """Users that come back in other months; a third of all rows are one user's and one value's."""
    i = F.col("id")
    rare, months_ = F.when(i % 3 == 0, F.lit(7)), F.concat(F.lit("2026-0"), (1 + i % months).cast("string"))
    return spark.range(n).select(months_.alias("month"), F.coalesce(rare, i % 9001).alias("user"), F.coalesce(rare, F.pmod(F.hash("id"), F.lit(10_000)) / 7).alias("x"))


def test_merged_sketches_are_within_their_bounds(spark):
    df = log(spark)
    months = KINDS.build(df, ["month"])
    for by, exact in ((["month"], df), ([], df)):
        found = KINDS.estimates(KINDS.merge(months, by), by, {"median": 0.5, "p90": 0.9})
        for r in found.collect():
            rows = exact.filter(F.col("month") == r["month"]) if by else exact
            n, users, *ranks = rows.agg(F.count("*"), F.count_distinct("user"), *(F.count_if(c) for q in ("median", "p90") for c in (F.col("x") < r[f"x_{q}"], F.col("x") <= r[f"x_{q}"]))).first()
            assert r["n"] == n and abs(r["user_distinct"] - users) <= KINDS.distinct_error * users
            for f, under, upto in ((0.5, *ranks[:2]), (0.9, *ranks[2:])):
                assert under <= (f + KINDS.rank_error) * n and upto >= (f - KINDS.rank_error) * n


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, float("nan")), ("b", 1, 2.0), ("b", 1, None)], "g string, user int, x double")
    found = KINDS.estimates(KINDS.merge(KINDS.build(df, ["g"]), ["g"]), ["g"], {"median": 0.5})
    assert sorted(map(tuple, found.collect())) == [("a", 2, 0, None), ("b", 2, 1, 2.0)]
    assert KINDS.estimates(KINDS.build(df.limit(0), ["g"]), ["g"], {}).count() == 0


def test_spans_of_weeks(spark):
    df = spark.sql("SELECT DATE'2026-01-05' AS week, 1 AS n UNION ALL SELECT DATE'2026-01-12', 2")
    got = {str(r.week): r.n for r in trailing(df, "week", 2).groupBy("week").agg(F.sum("n").alias("n")).collect()}
    assert got == {"2026-01-05": 1, "2026-01-12": 3, "2026-01-19": 2}


def test_a_refresh_builds_what_changed_in_one_step(spark, tmp_path):
    df, where, asked = log(spark, 900), str(tmp_path / "kept"), []

    def build(months):
        asked.append(months)
        return KINDS.build(df.filter(F.col("month").isin(months)), ["month"]).withColumn("partition", F.col("month"))

    refresh = lambda inputs, build_=build, **more: incremental.refresh_together(spark, where, inputs, "v1", build_, **more)
    schema = "month string, n bigint, user_distinct binary, x_quantiles binary"
    read = lambda *m: sorted(r.month for r in incremental.read_together(spark, where, schema, m or None).collect())
    assert read() == []
    inputs = incremental.row_digests(df, "month")
    assert inputs == incremental.row_digests(df.repartition(5), "month") and len(set(inputs.values())) == 3
    assert refresh(inputs) == sorted(inputs) == read() and len(asked) == 1  # three partitions, one build
    assert refresh(inputs) == [] and len(asked) == 1
    assert refresh(inputs | {"2026-02": "other"}) == ["2026-02"] == asked[-1] and read() == sorted(inputs)
    assert read("2026-02") == ["2026-02"]
    with pytest.raises(RuntimeError):
        refresh(inputs, lambda months: (_ for _ in ()).throw(RuntimeError("injected")))
    assert read() == sorted(inputs)  # the former state stands
    assert refresh(inputs, replay=("2026-01", "2026-01")) == ["2026-01", "2026-02"]
    assert refresh(inputs | {"2026-09": "none of its rows are there"}) == ["2026-09"] and read() == sorted(inputs)
    assert incremental.vacuum(spark, where) == 3 and incremental.vacuum(spark, where) == 0 and read() == sorted(inputs)
    del inputs["2026-01"]
    assert refresh(inputs) == [] and read() == ["2026-02", "2026-03"]
    with pytest.raises(ValueError):
        refresh({"a/b": "x"})


def test_rows_and_digests_of_many_files_take_one_job(spark, tmp_path, monkeypatch):
    for month, n in (("2026-01", 3), ("2026-02", 0), ("2026-03", 5)):
        write_month(tmp_path, month, n=n)
    (tmp_path / "odd name%20é.bin").write_bytes(b"abc" * 1000)
    paths = [f[0] for f in event_log.month_files(spark, str(tmp_path)).values()]
    assert list(event_log.rows_by_file(spark, paths).values()) == [3, 0, 5] and event_log.rows_by_file(spark, []) == {}
    want = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir() if not p.name.startswith(".")}
    store = Store(spark, str(tmp_path))
    assert incremental.file_digests(spark, store) == want
    monkeypatch.setattr(incremental, "IN_TASK_BYTES", 2999)
    assert incremental.file_digests(spark, store) == want
    assert incremental.file_digests(spark, Store(spark, str(tmp_path / "none"))) == {}
