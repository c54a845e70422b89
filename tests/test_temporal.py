"""Joins and windows along time against all pairs, and as streams with late rows."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewake.operators import temporal

START = datetime(2026, 1, 1)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("span, within", [(3_600, None), (30 * 86_400, None), (600, 7_200)])
def test_asof_against_all_pairs(spark, span, within):
    """One key holds most rows; ties of time, of time between both sides, nulls in keys and times, repeated rows."""
    rng = random.Random(span)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(i, key(), at(rng.choice([rng.randint(0, 4000), None]))) for i in range(150)] * 2
    right = [(key(), at(rng.choice([rng.randint(0, 4000), None])), rng.randint(1, 40)) for _ in range(120)]
    want = []
    for i, k, t in left:
        found = [(s, v) for kk, s, v in right if k is not None and kk == k and t is not None and s is not None and s <= t and (within is None or (t - s).total_seconds() <= within)]
        want.append((i, k, t, max(found)[1] if found else None))
    out = temporal.asof_join(spark.createDataFrame(left, "i int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, s timestamp_ntz, v int"), ["k"], "t", "s", ["v"], "v", span, within)
    assert rows(out) == sorted(want, key=str)


def test_asof_of_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", at(5))], "i int, k string, t timestamp_ntz"), spark.createDataFrame([], "k string, s timestamp_ntz, v int")
    assert rows(temporal.asof_join(left, right, ["k"], "t", "s", ["v"], "v")) == [(1, "a", at(5), None)]
    assert rows(temporal.asof_join(left.limit(0), right, ["k"], "t", "s", ["v"], "v")) == []


@pytest.mark.parametrize("base", [60, 3_600, 86_400])
def test_intervals_against_all_pairs(spark, base):
    """Lengths from a minute to years, bounds that meet, empty and null intervals: each pair once."""
    rng = random.Random(base)
    key = lambda: rng.choice(["hot"] * 8 + ["b", None])
    points = [(i, key(), at(rng.choice([rng.randint(-50, 3000), None]))) for i in range(120)]
    spans = []
    for j in range(80):
        begin = rng.randint(0, 3000)
        spans.append((key(), j, at(rng.choice([begin, begin, None])), at(begin + rng.choice([-5, 0, 1, 4, 16, 60, 64, 240, 1440, 1_000_000]))))
    out = temporal.interval_join(spark.createDataFrame(points, "i int, k string, t timestamp_ntz"), spark.createDataFrame(spans, "k string, j int, a timestamp_ntz, b timestamp_ntz"), ["k"], "t", "a", "b", base)
    want = [(i, k, t, j, a, b) for i, k, t in points for kk, j, a, b in spans if k is not None and k == kk and t and a and b and a <= t < b]
    assert rows(out) == sorted(want, key=str) and len(want) > 50


def test_intervals_of_any_length(spark):
    spans = spark.createDataFrame([("k", at(7), at(7 + m)) for m in (3, 10, 1_000, 100_000, 10_000_000)], "k string, a timestamp_ntz, b timestamp_ntz")
    plan = temporal.interval_join(spark.createDataFrame([("k", at(9))], "k string, t timestamp_ntz"), spans, ["k"], "t", "a", "b", 60)
    assert plan.count() == 5 and temporal.interval_join(spark.createDataFrame([("k", at(9))], "k string, t timestamp_ntz"), spans.limit(0), ["k"], "t", "a", "b").count() == 0


def test_sessions(spark):
    df = spark.createDataFrame([("u", at(m), 1) for m in (0, 29, 58, 89, 89)] + [("v", at(0), 5), (None, at(0), 7)], "u string, t timestamp, n int")
    out = temporal.sessions(df, ["u"], "t", "30 minutes", [F.sum("n").alias("n")])
    assert sorted((r.u, r.n) for r in out.filter("u IS NOT NULL").collect()) == [("u", 2), ("u", 3), ("v", 5)]


def feed(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(e | {k: v.isoformat() for k, v in e.items() if isinstance(v, datetime)}) for e in events))


def run(df, tmp_path, sink):
    query = df.writeStream.outputMode("append").foreachBatch(lambda batch, _: sink.extend(map(tuple, batch.collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()


def test_sessions_of_a_stream_close_at_the_watermark(spark, tmp_path):
    """A session is given once nothing can join it any more; what comes after that is dropped; a restart goes on from its state."""
    got: list = []
    stream = lambda: temporal.sessions(spark.readStream.schema("u string, t timestamp").json(str(tmp_path / "in")), ["u"], "t", "30 minutes", [F.count(F.lit(1)).alias("n")], late="60 minutes")
    feed(tmp_path / "in", "1", [{"u": "a", "t": at(0)}, {"u": "a", "t": at(20)}])
    run(stream(), tmp_path, got)
    assert got == []
    feed(tmp_path / "in", "2", [{"u": "a", "t": at(45)}, {"u": "b", "t": at(240)}])  # the first joins the session of before the restart
    run(stream(), tmp_path, got)
    feed(tmp_path / "in", "3", [{"u": "a", "t": at(50)}, {"u": "b", "t": at(250)}])  # too late for a
    run(stream(), tmp_path, got)
    assert [(r[0], (r[2] - r[1]).total_seconds() / 60, r[3]) for r in got] == [("a", 75.0, 3)]


def test_two_streams_meet_within_a_bound(spark, tmp_path):
    got: list = []

    def stream():
        scores = spark.readStream.schema("case string, scored timestamp").json(str(tmp_path / "scores"))
        outcomes = spark.readStream.schema("case string, seen timestamp, y int").json(str(tmp_path / "outcomes"))
        return temporal.followed_within(scores, outcomes, "case", "scored", "seen", "1 HOUR", late="30 minutes", how="left_outer")

    feed(tmp_path / "scores", "1", [{"case": c, "scored": at(0)} for c in "xyz"])
    feed(tmp_path / "outcomes", "1", [{"case": "x", "seen": at(60), "y": 1}, {"case": "y", "seen": at(61), "y": 0}])  # y's is a minute too late for the bound
    run(stream(), tmp_path, got)
    assert [(r[0], r[3]) for r in got] == [("x", 1)]
    feed(tmp_path / "scores", "2", [{"case": "w", "scored": at(600)}])
    feed(tmp_path / "outcomes", "2", [{"case": "w", "seen": at(600), "y": 1}])
    run(stream(), tmp_path, got)
    feed(tmp_path / "outcomes", "3", [{"case": "z", "seen": at(5), "y": 1}, {"case": "q", "seen": at(601), "y": 1}])  # in time for z, but it comes after the watermark
    feed(tmp_path / "scores", "3", [{"case": "v", "scored": at(601)}])
    run(stream(), tmp_path, got)
    assert sorted((r[0], r[3]) for r in got) == [("w", 1), ("x", 1), ("y", None), ("z", None)]
