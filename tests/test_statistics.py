import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.operators import classification as cl
from tidewake.operators import cohort, drift, graph, matrix, multiplicity, resample, survival


def test_holm_keeps_nulls_in_place(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, None), (3, 0.03)], "i int, p double")
    assert [r.holm for r in multiplicity.holm(df, "p", "i").orderBy("i").collect()] == pytest.approx([0.03, 0.06, None, 0.06])


def test_restricted_mean(spark):
    df = spark.createDataFrame([(10.0, True), (90.0, False)], "t double, e boolean")
    assert survival.restricted_mean(df, "t", "e", 90.0).first().rmst == pytest.approx(50.0)


def test_all_die_at_the_last_time(spark):
    df = spark.createDataFrame([(10.0, True), (20.0, True)], "t double, e boolean")
    assert survival.restricted_mean(df, "t", "e", 90.0).first().rmst == pytest.approx(15.0)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert cl.rank_auc(df, "y", "s").first().auc == pytest.approx(0.875)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.9)], "y int, s double")
    assert cl.rank_auc(df, "y", "s").first().auc is None


def test_net_benefit(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.1), (0, 0.3)], "y int, s double")
    assert cl.decision_curve(df, "y", "s", [0.5]).first().model == pytest.approx(0.25)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 40), bins=st.integers(1, 9))
def test_equal_count_bins(spark, n, bins):
    found = [r.b for r in spark.range(1, n + 1).select(cl.equal_count_bin(F.col("id"), F.lit(n), bins).alias("b")).collect()]
    assert found == [next(b for b in range(bins) if b * n // bins <= i < (b + 1) * n // bins) for i in range(n)]


def test_psi_of_equal_groups_is_zero(spark):
    df = spark.range(200).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") < 100).alias("ref"))
    assert drift.psi_quantile(df, "x", F.col("ref")).agg(F.sum("psi_part")).first()[0] == pytest.approx(0)


def test_kappa_and_ac1_differ(spark):
    df = spark.createDataFrame([(1, 1)] * 90 + [(1, 0)] * 5 + [(0, 1)] * 5, "a int, b int")
    r = cl.agreement(df, "a", "b").first()
    assert r.kappa < 0 < r.ac1


def test_calibrated_scores_have_slope_one(spark):
    rows = [(1 if i < 10 * k else 0, k / 10) for k in range(1, 10) for i in range(100)]
    assert cl.logistic_calibration(spark.createDataFrame(rows, "y int, s double"), "y", "s") == pytest.approx((0, 1), abs=1e-6)


def test_simplex_and_synthetic_weights():
    assert matrix.project_simplex(np.array([-2.0, 3.0])) == pytest.approx([0, 1])
    donors = np.random.default_rng(1).normal(size=(20, 3))
    assert matrix.synthetic_weights(donors, donors @ np.array([0.2, 0.3, 0.5])) == pytest.approx([0.2, 0.3, 0.5], abs=1e-3)


def test_two_way_effect_is_recovered():
    rng = np.random.default_rng(3)
    d = np.zeros((8, 48))
    for i in range(8):
        d[i, 6 * (i // 2) + 6 :] = 1
    y = rng.normal(size=(8, 1)) + rng.normal(size=(1, 48)) - 0.04 * d + rng.normal(0, 1e-6, (8, 48))
    assert matrix.two_way_t(y, d)[0] == pytest.approx(-0.04, abs=1e-5)


def test_bootstraps_repeat_and_bracket(spark):
    e = spark.createDataFrame([(f"s{i}", 0.5 + 0.01 * i) for i in range(8)], "c string, e double")
    a, b = (resample.wild_bootstrap(df, "c", "e", 199, "x").first() for df in (e, e.repartition(7)))
    assert a == b and a.p < 0.05 and a.low < a.estimate < a.high
    s = spark.createDataFrame([(f"s{i}", i, 10) for i in range(8)], "c string, n int, d int")
    a, b = (resample.cluster_bootstrap(df, "c", "n", "d", 99, "x").first() for df in (s, s.repartition(5)))
    assert a == b and a.low <= a.estimate <= a.high


def test_power_grows_with_effect_and_ignores_partitioning(spark):
    design = matrix.Rollout((0.3,) * 8, (50,) * 8, ("A", "B") * 4, (4, 4, 8, 8, 4, 4, 8, 8), weeks=16, policy_week=None)
    run = lambda: {r.effect: r.power for r in matrix.rollout_power(spark, design, (0.0, -0.2), (0.01,), 60, 7, chunk=20).collect()}
    first = run()
    assert first[-0.2] > 0.9 > first[0.0]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert run() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_components_of_a_chain(spark):
    n = 40
    nodes, edges = spark.range(n + 1), spark.range(n - 1).select(F.col("id").alias("b"), (F.col("id") + 1).alias("a"))
    found = {r.id: r.root for r in graph.components(nodes, edges, "id").collect()}
    assert set(found[i] for i in range(n)) == {0} and found[n] == n


def test_unknown_predicate_names_are_refused():
    with pytest.raises(ValueError):
        cohort.parse_predicate("password:x", {"site": "site"})


def test_running_totals_of_many_parts(spark, monkeypatch):
    import random

    from tidewake.operators import ranks

    monkeypatch.setattr(ranks, "FEW_ROWS", 10)

    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), v, rng.randrange(5)) for v in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, v int, c int")
    for down in (False, True):
        for r in ranks.running(df, ["g"], "v", {"before": F.col("c")}, down).collect():
            assert r.before == sum(c for g, v, c in rows if g == r.g and (v > r.v if down else v < r.v))
    placed = ranks.positions(spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 9)], "i int, s int"), "s", "i", descending=True)
    assert {r.i: (r._position, r._rows) for r in placed.collect()} == {4: (1, 4), 1: (2, 4), 2: (3, 4), 3: (4, 4)}
    points = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert ranks.quantiles(df, "v", points).first().edges == pytest.approx(list(np.quantile([v for _, v, _ in rows], points)))
    assert ranks.quantiles(df.limit(0), "v", [0.5]).first().edges == [None]


def test_wins_are_those_of_all_pairs(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.randrange(2), rng.randrange(6) / 6) for _ in range(120)]
    df = spark.createDataFrame(rows, "c string, y int, s double")
    want = {}
    for c, y, s in rows:
        for d, z, t in rows:
            if y == 1 and z == 0:
                want[c, d] = want.get((c, d), 0) + (s > t) + 0.5 * (s == t)
    assert {(r.a, r.b): r.wins for r in resample.win_matrix(df, "c", "y", "s").collect() if r.wins or (r.a, r.b) in want} == want
    out = {r.measure: r for r in resample.classification_bootstrap(df, "c", "y", "s", 0.5, 50, "t").collect()}
    auc = sum(want.values()) / (sum(y for _, y, _ in rows) * sum(1 - y for _, y, _ in rows))
    assert out["auc"].estimate == pytest.approx(auc) and out["auc"].low <= auc <= out["auc"].high and len(out) == 9
    assert cl.rank_auc(df, "y", "s").first().auc == pytest.approx(auc)


def test_power_without_effect_is_half_alpha_and_grows(spark):
    design = matrix.Rollout((0.2,) * 8, (40,) * 8, ("A", "B") * 4, (16, 16, 24, 24, 32, 32, 40, 40))
    out = {r.effect: r for r in matrix.rollout_power(spark, design, (0.0, -0.05, -0.1), (0.03,), 600, 3).collect()}
    assert out[0.0].simulations == 600 and out[0.0].power < 0.06 and out[-0.1].power > out[-0.05].power > out[0.0].power and out[-0.1].power > 0.9


def test_panels_with_missing_cells_equal_dummies():
    rng = np.random.default_rng(5)
    y, d, seen = rng.normal(size=(1, 5, 9)), rng.integers(0, 2, (1, 5, 9)).astype(float), rng.random((1, 5, 9)) > 0.15
    beta, _ = matrix.two_way_many(y, d, seen)
    u, t = np.indices((5, 9))
    x = np.column_stack([d[0].ravel(), *(u.ravel() == i for i in range(5)), *(t.ravel() == j for j in range(1, 9))])[seen[0].ravel()]
    assert beta[0] == pytest.approx(np.linalg.lstsq(x.astype(float), y[0].ravel()[seen[0].ravel()], rcond=None)[0][0], abs=1e-6)


def test_predicates_and_their_refusals(spark):
    df = spark.createDataFrame([("a", 3.0, "2026-01-03"), ("a", 5.0, "2026-01-05")], "s string, v double, d string").withColumn("d", F.to_date("d"))
    names = {"s": "s", "v": "v", "d": "d"}
    keep = lambda text: [r.v for r in df.filter(cohort.parse_predicate(text, names)).collect()]
    assert keep("weekend:d") == [3.0] and keep("s:a|v>=4") == [5.0] and keep("v<4") == [3.0]
    for bad in ("x:1", "v=1", "weekend:x", "v"):
        with pytest.raises(ValueError):
            cohort.parse_predicate(bad, names)


def test_component_ids_stay_apart_beyond_two_digits(spark):
    labels = spark.range(150).select(F.col("id").alias("n"), F.col("id").alias("root"))
    ids = [r.component for r in graph.component_listing(labels, "n").orderBy("root").collect()]
    assert len(set(ids)) == 150 and ids[0] == "IC-001" and ids[-1] == "IC-150"


def test_hot_values_are_cut_by_their_ties(spark):
    """Nine of ten rows share a value: positions stay exact, and the sort deals the value to several tasks."""
    from tidewake.operators import ranks

    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("v"), F.spark_partition_id().alias("_p"))
        placed = ranks.positions(df, "v", "i").select("i", "v", "_position", "_rows").collect()
        order = sorted(((i if i % 10 == 0 else 7.0), i) for i in range(4000))
        assert [(r.v, r.i) for r in sorted(placed, key=lambda r: r._position)] == order and {r._rows for r in placed} == {4000}
        parts = df.orderBy("v", "i").filter("v = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("cells, counts, sent", [(7, 30, 1_000), (100_000, 1 << 20, 1_000), (7, 1, 0)])
def test_wins_and_draws_of_many_ranges_equal_pairs(spark, monkeypatch, cells, counts, sent):
    import random

    monkeypatch.setattr(resample, "RANGE_CELLS", cells)
    monkeypatch.setattr(resample, "STEP_COUNTS", counts)
    monkeypatch.setattr(resample, "MATRIX_CLUSTERS", sent)
    rng = random.Random(5)
    # a third of all rows in one cluster, half of the rows with one score, rows without score, ties, a cluster of one class
    rows = [("hot" if rng.random() < 0.33 else f"c{rng.randrange(5)}", rng.randrange(2), None if rng.random() < 0.02 else 0.5 if rng.random() < 0.5 else rng.randrange(90) / 90) for _ in range(600)]
    rows += [("one", 1, 0.4), ("one", 1, float("nan")), ("c1", 0, float("nan"))]
    df = spark.createDataFrame(rows, "c string, y int, s double").repartition(5)
    key = lambda s: (s != s, s if s == s else 0.0)  # noqa: E731  NaN is above all numbers
    want = {}
    for a, ya, sa in rows:
        for b, yb, sb in rows:
            if ya == 1 and yb == 0 and sa is not None and sb is not None:
                want[a, b] = want.get((a, b), 0) + (1.0 if key(sa) > key(sb) else 0.5 if key(sa) == key(sb) else 0.0)
    got = {(r.a, r.b): r.wins for r in resample.win_matrix(df, "c", "y", "s").collect()}
    assert got == {k: v for k, v in want.items() if v}
    stats = df.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    wins = spark.createDataFrame([(a, b, w) for (a, b), w in got.items()], "a string, b string, wins double")
    names = sorted({r[0] for r in rows})
    sizes = {c: sum(r[0] == c for r in rows) for c in names}
    times = {}
    for r in resample.cluster_multiplicities(stats, "c", 40, "t").collect():
        times.setdefault(r.draw, {})[r.c] = r.times
    for r in resample.resampled_sums(stats, "c", ["n"], 40, "t", wins).collect():
        t = times.pop(r.draw)
        assert sum(t.values()) == len(names) and r.n == sum(sizes[c] * x for c, x in t.items())
        assert r.wins == pytest.approx(sum(t.get(a, 0) * t.get(b, 0) * w for (a, b), w in got.items()))
    assert not times


def test_no_clusters_no_draws(spark):
    df = spark.createDataFrame([], "c string, y int, s double")
    assert resample.win_matrix(df, "c", "y", "s").isEmpty()
    assert resample.resampled_sums(df.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c", ["n"], 9, "t").isEmpty()
    found = resample.classification_bootstrap(df, "c", "y", "s", 0.5, 9, "t")
    assert {r.draws for r in found.collect()} == {None}


def test_bias_that_would_explain_an_effect(spark):
    df = spark.createDataFrame([("a", 0.10, 0.3), ("b", 0.20, 0.5)], "s string, did double, r double")
    found = {(r.method, r.exposure, r.setting): r.estimate for r in cohort.bias_ledger(df, "did", "r", [2.0], [0.5], [3.0]).collect()}
    ratio = 0.4 / (0.4 - 0.15)
    assert found["e_value", None, None] == pytest.approx(ratio + (ratio * (ratio - 1)) ** 0.5)
    assert found["bias_factor", 2.0, 4 / 3] == pytest.approx(ratio / (4 / 3))
    assert found["partial_r2", None, 0.5] == pytest.approx(0.15 - 0.1 / 2**0.5)
    assert found["selection_odds", None, 3.0] == pytest.approx(3 * 0.65 / (0.35 + 3 * 0.65) - 0.5)
    # no positive counterfactual risk: no ratio, and nothing made of it; no services: nothing known at all
    none = {r.method: r.estimate for r in cohort.bias_ledger(df.withColumn("r", F.lit(0.1)), "did", "r", [2.0], [0.5], [3.0]).collect()}
    assert none["e_value"] is None and none["bias_factor"] is None and none["partial_r2"] is not None
    assert [r.estimate for r in cohort.bias_ledger(df.limit(0), "did", "r", [2.0], [0.5], [3.0]).collect()] == [None] * 4


def test_endpoints_use_their_complete_cases(spark):
    rows = [("s", a, t, float(a and t), None if (a, t) == (1, 1) and i == 0 else 2.0 * a * t) for a in (0, 1) for t in (0, 1) for i in range(3)]
    rows += [("half", 1, t, 1.0, 1.0) for t in (0, 1)]  # one arm alone: no difference of differences
    df = spark.createDataFrame(rows, "s string, a int, t int, e double, snap double")
    ends = {"event": F.col("e"), "snapshot": F.col("snap"), "never": F.lit(None).cast("double")}
    found = {r.endpoint: r for r in cohort.endpoint_sensitivity(df, ends, "s", F.col("a") == 1, F.col("t") == 1).collect()}
    assert set(found) == {"event", "snapshot"}
    assert (found["event"].n, found["event"].missing, found["event"].effect, found["event"].se) == (12, 0, 1.0, None)
    assert (found["snapshot"].n, found["snapshot"].missing, found["snapshot"].effect, found["snapshot"].weighted_effect) == (11, 1, 2.0, 2.0)


def test_shifted_switches_equal_shifted_rows(spark):
    rows = [(f"s{i % 3}", i % 2, f"2024-01-{1 + i % 28:02d}", float(i * i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "s string, a int, d string, y double").withColumn("d", F.to_date("d"))
    found = {(r["shift"], r.horizon): r.effect for r in cohort.shifted_switches(df, F.col("y"), "s", F.col("a") == 1, "d", "2024-01-15", (-3, 0, 40), (0, 5)).collect()}
    for shift in (-3, 0):
        for horizon in (0, 5):
            at = F.datediff("d", F.lit("2024-01-15").cast("date")) - shift
            kept = df if not horizon else df.filter(at.between(-horizon, horizon - 1))
            want = cohort.clustered_effect(cohort.did_by(kept, F.col("y"), "s", F.col("a") == 1, at >= 0, []), []).first().effect
            assert found[shift, horizon] == pytest.approx(want)
    assert (40, 0) not in found  # no day after it
