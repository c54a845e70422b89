from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import queries, whitening


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").withColumns({"x": F.lit("a"), "n": F.lit(5), "whitened": F.lit(0)})


def reference(vectors):
    """Components by singular values, sums by fractions: nothing shared with the operator."""
    x = [[int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(d)]
    deviation = [sum((n * r[k] - sums[k]) ** 2 for k in range(d)) for r in x]
    centred = np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(d)] for r in x])
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    return deviation, centred @ vt.T / (s / np.sqrt(n)), s**2 / (s**2).sum()


def check(found, ids, vectors, used):
    deviation, white, share = reference(vectors)
    by = {(r.vec_id, r.component): r for r in found}
    assert len(found) == len(by) == len(ids) * used
    got = np.array([[by[i, k + 1].whitened for k in range(used)] for i in ids])
    signs = np.sign((got * white[:, :used]).sum(axis=0))
    assert np.allclose(got * signs, white[:, :used], rtol=1e-9, atol=1e-9)
    assert [int(by[i, 1].deviation) for i in ids] == deviation
    assert np.allclose([by[ids[0], k + 1].explained for k in range(used)], share[:used], rtol=1e-9)
    assert {r.n for r in found} == {len(ids)} and len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def test_against_singular_values(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.3, 0.2] + 5).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0]), (905, [])]
    check(whitening.whiten(frame(spark, rows).repartition(5)).collect(), list(range(300)), vectors, 6)


def test_no_more_components_than_asked_for(spark):
    vectors = np.random.default_rng(2).normal(size=(200, 40)).tolist()
    check(whitening.whiten(frame(spark, list(enumerate(vectors)), "double")).collect(), list(range(200)), vectors, 32)


def test_small_variance_beside_a_large_mean(spark):
    """Means of a billion would eat the digits of products that aren't centred first."""
    rng = np.random.default_rng(3)
    vectors = (2.0**30 + rng.integers(-3, 4, size=(400, 3)) / 64).tolist()
    check(whitening.whiten(frame(spark, list(enumerate(vectors)), "double")).collect(), list(range(400)), vectors, 3)


def test_deviation_beyond_a_long(spark):
    vectors = [[2.0**50, -(2.0**50)], [2.0**49, 3.0], [-(2.0**50), 2.0**50], [7.0, 8.0]]
    found = whitening.whiten(frame(spark, list(enumerate(vectors)), "double")).collect()
    assert [int(r.deviation) for r in sorted(found, key=lambda r: r.vec_id) if r.component == 1] == reference(vectors)[0]


def test_components_without_variance_are_left_out(spark):
    rng = np.random.default_rng(4)
    vectors = [[a, a, b] for a, b in rng.integers(-64, 64, size=(100, 2)) / 64.0]
    check(whitening.whiten(frame(spark, [(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "double")).collect(), list(range(100)), vectors, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]])
def test_nothing_to_scale(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.collect() == [] and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_rows_count(spark):
    vectors = [[0.0, 1.0], [0.0, 1.0], [3.0, -1.0], [0.5, 0.5]]
    found = whitening.whiten(frame(spark, [(1, vectors[0]), (1, vectors[1]), (2, vectors[2]), (None, vectors[3])], "double")).collect()
    assert len(found) == 8 and sum(r.vec_id == 1 for r in found) == 4 and sum(r.vec_id is None for r in found) == 2


def test_query(spark):
    from pathlib import Path

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    rows = [r for r in spark.read.parquet(str(data / "embeddings.parquet")).collect()]
    check(queries.op13_whitening(spark, str(data)).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)
