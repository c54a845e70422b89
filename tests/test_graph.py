"""Components against a union-find over collected edges: stars, paths, hubs on either side, and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import graph


def brute_force(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {n: top(n) for n in nodes}


def found(spark, nodes, edges):
    df = spark.createDataFrame([(n,) for n in nodes], "id long")
    labels = graph.components(df, spark.createDataFrame(list(edges), "a long, b long"), "id")
    rows = labels.collect()
    assert len(rows) == len(set(nodes))
    return {r.id: r.root for r in rows}


@pytest.mark.parametrize("hubs", [False, True])
def test_random_graphs(spark, monkeypatch, hubs):
    if hubs:  # every node with more than two edges is one
        monkeypatch.setattr(graph, "FEW_ROWS", 2)
    rng = random.Random(hubs)
    nodes = list(range(60)) + [3]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(38)] * 2 + [(5, 5), (None, 4), (4, None)]
    edges += [(59, i) for i in range(40, 52)] + [(0, i) for i in range(20, 28)]  # the largest and the smallest node of a star
    assert found(spark, nodes, edges) == brute_force(nodes, edges)


def test_without_edges_or_nodes(spark):
    assert found(spark, [3, 1, 2], []) == {1: 1, 2: 2, 3: 3} and found(spark, [], []) == {}


def test_a_path_in_any_order_takes_few_rounds(spark, monkeypatch):
    rounds = []
    with_one = graph.with_one
    monkeypatch.setattr(graph, "with_one", lambda *a: rounds.append(1) or with_one(*a))
    n, order = 500, list(range(500))
    for shuffled in (False, True):
        rounds.clear()
        if shuffled:
            random.Random(1).shuffle(order)
        labels = found(spark, range(n), zip(order, order[1:]))
        assert set(labels.values()) == {0} and len(rounds) / 2 <= 10


def test_a_star_of_many_leaves_leaves_its_hub_unmoved(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ROWS", 100)
    monkeypatch.setattr(graph, "HUBS", 10)
    spark_nodes = spark.range(20_000)
    # every second node hangs on node 19 999, which is tied to 1; the others share one value of ``via``
    links = spark.range(0, 19_998, 2).select(F.col("id").alias("a"), F.lit(19_999).alias("b")).union(spark.sql("SELECT 1L, 19999"))
    shared = graph.shared_edges(spark.range(3, 19_999, 2).select("id", F.lit("x").alias("via")), "id", "via")
    labels = graph.components(spark_nodes, links.unionByName(shared), "id").checkpoint()
    assert {(r.root, r["count"]) for r in labels.groupBy("root").count().collect()} == {(0, 10_001), (3, 9_998), (19_998, 1)}
    members = graph.component_members(labels, "id")
    assert {(r.component, r.root, r["count"]) for r in members.groupBy("component", "root").count().collect()} == {("IC-01", 0, 10_001), ("IC-02", 3, 9_998), ("IC-03", 19_998, 1)}
    plan = graph.with_one(links.select("b").checkpoint(), "b", spark.sql("SELECT 19999 AS b, 1 AS x"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_hubs_of_a_join_have_all_their_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_ROWS", 5)
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 3), ("b", 9), ("c", 8), (None, 7)) for i in range(n)], "k string, i int")
    one = spark.createDataFrame([("a", 1), ("b", 2), ("d", 4)], "k string, x int")
    for how in ("left", "inner"):
        want = sorted(map(tuple, rows.join(one, "k", how).collect()), key=str)
        assert sorted(map(tuple, graph.with_one(rows, "k", one, how).collect()), key=str) == want
