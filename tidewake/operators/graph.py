"""Connected components and what is built on them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where none is set and all runs on one machine, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidewake-"))
    return context.getCheckpointDir()


#: A key above a fifty-thousandth of the rows is a hub, so there can't be more hubs than that.
HUBS = 50_000
#: Rows of one key that a task may always take.
FEW_ROWS = 10_000


def with_one(rows: DataFrame, key: str, one: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` with the columns of the one row that ``one`` has for each key; the rows of a hub stay where they are, beside a broadcast of the hubs' rows of ``one``.

    ``rows`` should be written already: they are counted by key first.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    bound = max((total or 0) // HUBS, FEW_ROWS)
    if (most or 0) <= bound:
        return rows.join(one, key, how)
    hubs = counts.filter(F.col("_n") > bound).select(key).checkpoint()  # HUBS rows at most, since each has more than total / HUBS
    others = rows.join(F.broadcast(hubs), key, "left_anti").join(one, key, how)
    beside = one.join(F.broadcast(hubs), key, "left_semi")
    return others.unionByName(rows.join(F.broadcast(hubs), key, "left_semi").join(F.broadcast(beside), key, how))


def shared_edges(df: DataFrame, node: str, via: str) -> DataFrame:
    """Edges from the smallest node of each value of ``via`` to its others: connected as if all pairs were drawn."""
    shared_dir(df.sparkSession)
    pairs = df.select(node, via).dropna().distinct().checkpoint()
    smallest = pairs.groupBy(via).agg(F.min(node).alias("a"))
    return with_one(pairs, via, smallest, "inner").filter(F.col("a") != F.col(node)).select("a", F.col(node).alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """node, root: the smallest node that each can reach by edges (a, b) between nodes; edges of a node to itself or to none say nothing.

    Edges point from a node to a smaller one. In a round, each moves on to the smallest node that its target points to, and then
    all that one node points to is tied to the smallest of it. Both keep what is connected, and edges never grow in
    number beyond nodes and edges; rounds grow with the square of the logarithm of the nodes at most, a long path included.
    When every node points to one that points nowhere, that is its root. Each round is written to the checkpoint
    folder, so plans stay short and lost executors cost only their tasks.
    """
    shared_dir(nodes.sparkSession)
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct().checkpoint()
    while True:
        least = down.groupBy("node").agg(F.min("to").alias("least"), F.count(F.lit(1)).alias("n")).checkpoint()
        one_each = least.filter("n > 1").isEmpty()
        if one_each and down.select(F.col("to").alias("node")).distinct().join(least, "node", "left_semi").isEmpty():
            break
        onward = least.select(F.col("node").alias("to"), "least")
        down = with_one(down, "to", onward).select("node", F.coalesce("least", "to").alias("to")).distinct().checkpoint()
        tied = with_one(down, "node", down.groupBy("node").agg(F.min("to").alias("least")), "inner")
        pairs = F.explode(F.array(F.struct("node", F.col("least").alias("to")), F.struct(F.col("to").alias("node"), F.col("least").alias("to"))))
        down = tied.select(pairs.alias("e")).select("e.*").filter("node <> to").distinct().checkpoint()
    labels = nodes.select(F.col(node).alias("node")).distinct().join(least.select("node", "least"), "node", "left")
    return labels.select(F.col("node").alias(node), F.coalesce("least", "node").alias("root"))


def component_ids(labels: DataFrame, node: str, prefix: str = "IC") -> DataFrame:
    """component, root: stable ids by order of the components' smallest nodes; as wide as their number needs, two digits at least."""
    from tidewake.operators.ranks import positions

    placed = positions(labels.filter(F.col(node) == F.col("root")).select("root"), "root", "root")
    width = F.greatest(F.lit(2), F.length(F.col("_rows").cast("string")))
    return placed.select(F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("_position").cast("string"), width, F.lit("0"))).alias("component"), "root")


def component_members(labels: DataFrame, node: str, prefix: str = "IC") -> DataFrame:
    """component, root, node: a row for each member, for components of any size."""
    return with_one(labels, "root", component_ids(labels, node, prefix), "inner").select("component", "root", node)


def component_listing(labels: DataFrame, node: str, prefix: str = "IC") -> DataFrame:
    """component, root, members, n: a row for each component with its members as one text; where components are large, take ``component_members``."""
    groups = labels.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.col(node).cast("string"))), ",").alias("members"), F.count(F.lit(1)).alias("n"))
    return component_ids(labels, node, prefix).join(groups, "root").select("component", "root", "members", "n")


def assign_sequences(df: DataFrame, item: str, stratum: str, sequences: int, seed: str) -> DataFrame:
    """Items of each stratum dealt to sequences in an order drawn by a seeded hash."""
    draw: Column = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(item).cast("string")).cast("binary"), 256)
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, item))
    return df.withColumn("sequence", ((nth - 1) % sequences).cast("int") + 1)
