"""Versioned tables, and the incremental monitor against its projection from all history."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources_and_guard import event
from tidewake.sources.versioned import Conflict, Snapshot, VersionedTable
from tidewake.streaming import scored_cases


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path), ["k"], "k bigint, v string", 8)


def test_a_merge_touches_its_buckets(spark, table):
    at = table.commit(table.append(Snapshot(), spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("v"))))
    assert set(at.parts) == set(range(8)) and table.latest() == at
    changes = spark.createDataFrame([(3, "new"), (1000, "more")], "k bigint, v string")
    gone = spark.createDataFrame([(4,)], "k bigint")
    touched = table.touched(changes.select("k").unionByName(gone))
    then = table.commit(table.merge(at, changes, gone))
    assert {b for b in range(8) if then.parts[b] != at.parts[b]} == set(touched) and len(touched) < 8
    assert rows(table.read(then)) == sorted([(k, "new" if k == 3 else "old") for k in range(200) if k != 4] + [(1000, "more")], key=str)
    assert table.read(at).count() == 200  # readers of the former snapshot are left alone
    assert len(table.read(then, touched).inputFiles()) < len(table.read(then).inputFiles())
    assert table.vacuum([then]) == 0 and table.vacuum([at]) == 1 and table.read(at).count() == 200


def test_of_two_writers_one_is_refused(spark, table):
    at = table.commit(table.append(Snapshot(), spark.createDataFrame([(1, "a")], "k bigint, v string")))
    one = table.merge(at, spark.createDataFrame([(1, "b")], "k bigint, v string"))
    two = table.merge(at, spark.createDataFrame([(1, "c")], "k bigint, v string"))
    table.commit(one)
    with pytest.raises(Conflict):
        table.commit(two)
    assert rows(table.read(table.latest())) == [(1, "b")]
    table.commit(table.merge(table.latest(), spark.createDataFrame([(1, "c")], "k bigint, v string")))
    assert rows(table.read(table.latest())) == [(1, "c")]


def test_appends_are_compacted(spark, table):
    at = Snapshot()
    for i in range(3):
        at = table.append(at, spark.createDataFrame([(k, str(i)) for k in range(20)], "k bigint, v string"))
    before = rows(table.read(at))
    assert max(map(len, at.parts.values())) == 3 and Snapshot.from_json(json.loads(json.dumps(at.to_json()))) == at
    then = table.compact(at, 2)
    assert {len(p) for p in then.parts.values()} == {1} and rows(table.read(then)) == before and table.compact(then, 2) is then
    assert rows(table.read(Snapshot())) == [] and rows(table.read(table.merge(then, table.read(then).limit(0), table.read(then)))) == []
    with pytest.raises(ValueError):
        table.replace(then, table.read(then), [0])


def stream(seed, batches=4, each=30):
    """Batches of events: new cases, corrections that change outcome, score or segment, replays, conflicts, gaps, late ones, bad ones."""
    rng, out, active, n = random.Random(seed), [], {}, 0
    for b in range(batches):
        batch = []
        for _ in range(each):
            n += 1
            week, kind = rng.randint(max(0, 3 * b - 2), 3 * b + 2), rng.random()
            site = rng.choice("AB")
            fields = {"site": site, "service_code": f"{site}-{rng.randint(1, 3)}", "score": rng.choice([0.1, 0.25, 0.5, 0.7, 0.99]), "outcome": rng.choice([0, 1, 1, None])}
            scored = f"2026-{1 + (4 + 7 * week) // 28:02d}-{1 + (4 + 7 * week) % 28:02d}T10:00:00+00:00"
            arrived = f"2026-{1 + (6 + 7 * (3 * b + 2)) // 28:02d}-{1 + (6 + 7 * (3 * b + 2)) % 28:02d}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00+00:00"
            fields |= {"scored_at": scored, "arrived_at": arrived, "outcome_observed_at": arrived if fields["outcome"] is not None else None}
            if kind < 0.3 and active:
                case = rng.choice(sorted(active))
                revision, last = active[case]
                skip = rng.random() < 0.15
                batch.append(event(n, 0, 0, case=case, revision=revision + 1 + skip, corrects=last, **{k: v for k, v in fields.items() if k != "outcome"}) | {"outcome": fields["outcome"]})
                if not skip:
                    active[case] = revision + 1, f"e{n}"
            elif kind < 0.4 and out:
                batch.append(rng.choice(rng.choice(out)) | ({"score": 0.33} if rng.random() < 0.5 else {}))
            elif kind < 0.44:
                batch.append(event(n, 0, 0, **{k: v for k, v in fields.items() if k != "outcome"}) | {"score": 7.0})
            else:
                batch.append(event(n, 0, 0, **{k: v for k, v in fields.items() if k != "outcome"}) | {"outcome": fields["outcome"]})
                active[f"c{n}"] = 1, f"e{n}"
        out.append(batch)
    return out


def frame(spark, batch):
    return spark.read.schema(scored_cases.SCHEMA).json(spark.sparkContext.parallelize(list(map(json.dumps, batch)), 2))


def measures(df):
    return {tuple(map(str, r[:3])): tuple(round(v, 8) if isinstance(v, float) else v for v in r[3:]) for r in df.select("week", "site", "service_code", *(c for c in df.columns if c not in ("week", "site", "service_code"))).collect()}


def test_increments_equal_the_projection_of_all_history(spark, tmp_path, monkeypatch):
    watch = scored_cases.ScoredCaseMonitor(spark, str(tmp_path), threshold=0.3, persistence=2, budget=1, buckets=8, most_parts=2)
    batches = stream(5, 3)
    for i, batch in enumerate(batches):
        if i == 1:  # the driver dies before the last step, and the batch comes again
            write = type(watch.store).write_json
            monkeypatch.setattr(type(watch.store), "write_json", lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                watch.apply(frame(spark, batch), i)
            monkeypatch.setattr(type(watch.store), "write_json", write)
            watch = scored_cases.ScoredCaseMonitor(spark, str(tmp_path), threshold=0.3, persistence=2, budget=1, buckets=8, most_parts=2)
        watch.apply(frame(spark, batch), i)
        accepted = watch._accepted(i)
        want, got = measures(watch.metrics(accepted)), measures(watch.current_metrics())
        assert got == want and len(want) > 5
        states = rows(watch.project(accepted))
        assert rows(watch.current_states().select("alert_id", "alert_hash", "state")) == states
        assert rows(watch.current_alerts()) == [s[:2] for s in states if s[2] == "fired"]
    before = watch.health()
    watch.apply(frame(spark, batches[-1]), len(batches) - 1)  # a batch that was applied is left alone
    assert watch.health() == before and before["batch"] == 2 and {"fired"} <= {r.action for r in watch.history().collect()}
    assert watch.snapshot().count() == watch.current_metrics().select("site", "service_code").distinct().count() and watch.catalog().count() == 5
    kept = {r.event_id for r in watch.provenance().collect()}
    assert kept == {r.event_id for r in scored_cases.monitor.active_revisions(accepted, ["case_id"], "revision", "event_id").collect()}


def test_a_batch_costs_its_own_segments(spark, tmp_path):
    watch = scored_cases.ScoredCaseMonitor(spark, str(tmp_path), matured_days=0, buckets=32)
    watch.apply(frame(spark, [event(i, i % 3, 1, site="A", service_code=f"A-{i % 12}") for i in range(60)]), 0)
    parts = lambda name: watch._state()["tables"][name]["parts"]
    weeks, cases = parts("weeks"), parts("cases")
    watch.apply(frame(spark, [event(900, 2, 0, site="A", service_code="A-5")]), 1)
    assert sum(weeks.get(b) != p for b, p in parts("weeks").items()) == 1 and sum(cases.get(b) != p for b, p in parts("cases").items()) == 1
