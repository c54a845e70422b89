"""Bootstraps with draws from hashes of (seed, draw, slot), so that partitioning can't change them.

Only sufficient statistics of clusters are resampled: cases are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.probability import log_loss
from tidewake.operators.classification import by_score, in_equal_bins
from tidewake.operators.graph import shared_dir

#: Counts of a score and a cluster that one range of scores holds, about.
RANGE_CELLS = 100_000
#: Running counts that a task makes at once.
STEP_COUNTS = 1 << 20
#: Clusters up to which a draw is a row of a matrix and the sums of clusters are sent to all tasks (8 MB for the wins); beyond, they are joined.
MATRIX_CLUSTERS = 1_000
#: The six-point wild bootstrap weights.
SIX_POINTS = (-(1.5**0.5), -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5)


def drawn(seed: str, *parts: Column) -> Column:
    """A non-negative number of 32 bits from a text seed and columns."""
    text = F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def wild_bootstrap(effects: DataFrame, cluster: str, effect: str, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Mean effect over clusters with a two-sided p-value and interval from sign-and-size flips of whole clusters."""
    numbers = effects.sparkSession.range(draws).select(F.col("id").alias("draw"))
    weight = F.element_at(F.array(*map(F.lit, SIX_POINTS)), (drawn(seed, F.col("draw"), F.col(cluster)) % 6).cast("int") + 1)
    means = effects.crossJoin(numbers).groupBy("draw").agg(F.avg(weight * F.col(effect)).alias("m"))  # clusters x draws
    estimate = effects.agg(F.avg(effect).alias("estimate"), F.count(F.lit(1)).alias("n_clusters"))
    out = means.crossJoin(F.broadcast(estimate)).groupBy("estimate", "n_clusters").agg(
        F.count(F.lit(1)).alias("draws"), F.count_if(F.abs("m") >= F.abs("estimate")).alias("as_large"), F.percentile("m", F.lit(1 - alpha / 2)).alias("_hi"), F.percentile("m", F.lit(alpha / 2)).alias("_lo")
    )
    return out.select("estimate", "n_clusters", "draws", ((1 + F.col("as_large")) / (1 + F.col("draws"))).alias("p"), (F.col("estimate") - F.col("_hi")).alias("low"), (F.col("estimate") - F.col("_lo")).alias("high"))


def cluster_multiplicities(clusters: DataFrame, cluster: str, draws: int, seed: str) -> DataFrame:
    """draw, cluster, times: clusters drawn with replacement, as many as there are, in each draw."""
    numbered = clusters.select(cluster).distinct().withColumn("_i", F.row_number().over(Window.orderBy(cluster)) - 1)
    k = numbered.agg(F.count(F.lit(1)).alias("_k"))
    slots = k.select("_k", F.explode(F.sequence(F.lit(0), F.col("_k").cast("int") - 1)).alias("slot")).crossJoin(clusters.sparkSession.range(draws).select(F.col("id").alias("draw")))
    picked = slots.select("draw", (drawn(seed, F.col("draw"), F.col("slot")) % F.col("_k")).alias("_p"))
    return picked.join(numbered, F.col("_p") == F.col("_i")).groupBy("draw", cluster).agg(F.count(F.lit(1)).alias("times"))


def resampled_sums(stats: DataFrame, cluster: str, columns: Sequence[str], draws: int, seed: str, wins: DataFrame | None = None) -> DataFrame:
    """draw, and the sums of columns over the clusters drawn, each as often as it was; with ``wins`` (a, b, wins) its sum over pairs of drawn clusters.

    A few clusters are a matrix that all tasks have, and draws a matrix each: no shuffle. Many are joined.
    """
    paired = wins is not None
    fields = ["draw", *(["wins"] if paired else []), *columns]
    schema = "draw bigint, " + ", ".join(f"{c} double" for c in fields[1:])
    known = stats.select(cluster, *columns).orderBy(cluster).limit(MATRIX_CLUSTERS + 1).toArrow()
    if known.num_rows > MATRIX_CLUSTERS:
        times = cluster_multiplicities(stats, cluster, draws, seed)
        sums = times.join(stats, cluster).groupBy("draw").agg(*(F.sum(F.col("times") * F.col(c)).cast("double").alias(c) for c in columns))
        if not paired:
            return sums
        left, right = times.select("draw", F.col(cluster).alias("a"), F.col("times").alias("ta")), times.select("draw", F.col(cluster).alias("b"), F.col("times").alias("tb"))
        won = left.join(wins, "a").join(right, ["draw", "b"]).groupBy("draw").agg(F.sum(F.col("ta") * F.col("tb") * F.col("wins")).alias("wins"))
        return sums.join(won, "draw", "left").withColumn("wins", F.coalesce("wins", F.lit(0.0)))
    names, k = known.column(0).to_pylist(), known.num_rows
    values = np.array([known.column(c).cast(pa.float64()).fill_null(0).to_numpy() for c in columns]).T.reshape(k, len(columns))
    matrix = np.zeros((k, k))
    if paired:
        at, found = {n: i for i, n in enumerate(names)}, wins.select("a", "b", "wins").toArrow()  # at most k x k rows
        a, b = ([at[x] for x in found.column(c).to_pylist()] for c in ("a", "b"))
        matrix[a, b] = found.column("wins").to_numpy()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            picked = np.array(batch.column(1).flatten().to_numpy(), dtype=np.int64).reshape(n, k)
            times = np.bincount((np.arange(n)[:, None] * k + picked).ravel(), minlength=n * k).reshape(n, k).astype(float)
            out = [*([np.einsum("ij,ij->i", times @ matrix, times)] if paired else []), *(times @ values).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=fields)

    spark = stats.sparkSession
    if not k:
        return spark.createDataFrame([], schema)
    slots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda slot: drawn(seed, F.col("id"), slot) % k)
    return spark.range(draws).select("id", slots).mapInArrow(run, schema)


def cluster_bootstrap(statistics: DataFrame, cluster: str, numerator: str, denominator: str, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """A ratio of sums with its percentile interval over resampled clusters."""
    sums = statistics.groupBy(cluster).agg(F.sum(numerator).alias("_n"), F.sum(denominator).alias("_d"))
    each = resampled_sums(sums, cluster, ["_n", "_d"], draws, seed)
    interval = each.filter("_d > 0").agg(F.percentile(F.col("_n") / F.col("_d"), F.lit(alpha / 2)).alias("low"), F.percentile(F.col("_n") / F.col("_d"), F.lit(1 - alpha / 2)).alias("high"), F.count(F.lit(1)).alias("draws"))
    return statistics.agg((F.sum(numerator) / F.sum(denominator)).alias("estimate")).crossJoin(interval)


def win_matrix(df: DataFrame, cluster: str, y: str, score: str) -> DataFrame:
    """a, b, wins: how often positives of cluster a score above negatives of cluster b, ties counting half.

    Counts of each score and cluster are cut into ranges of scores, as many as they need, and a range is
    walked once: it starts with each cluster's negatives of the ranges before, and keeps a running count
    of each cluster. Neither pairs of cases nor a table of scores by clusters are made; a task holds its
    range and a count for each pair of clusters. Cases without a score win nothing.
    """
    cells = by_score(df.filter(F.col(score).isNotNull()), y, score, cluster).select(F.col(cluster).alias("cluster"), F.col(score).cast("double").alias("score"), "pos", "neg")
    shared_dir(df.sparkSession)
    cells = cells.checkpoint()
    ranges = max(-(-cells.count() // RANGE_CELLS), 1)
    # equal scores share a range; written, as ranges come from samples
    cells = cells.repartitionByRange(ranges, "score").withColumn("part", F.spark_partition_id()).checkpoint()
    negatives = cells.filter("neg > 0").groupBy("cluster", "part").agg(F.sum("neg").alias("neg"))
    # a cluster's negatives up to a range count in the ranges after it, as far as its next ones
    within = Window.partitionBy("cluster").orderBy("part")
    upto = negatives.select("cluster", F.sum("neg").over(within).alias("neg"), F.col("part").alias("_from"), F.coalesce(F.lead("part").over(within), F.lit(ranges - 1)).alias("_to")).filter("_from < _to")
    before = upto.select("cluster", "neg", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("part"))
    kind = df.schema[cluster].dataType.simpleString()
    parts = cells.groupBy("part").cogroup(before.groupBy("part")).applyInPandas(_wins_of_range, f"a {kind}, b {kind}, wins double")
    return parts.groupBy("a", "b").agg(F.sum("wins").alias("wins"))


def _wins_of_range(cells: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """Wins of the positives of one range of scores, above the negatives of the ranges before it and of its own."""
    cells = cells.sort_values("score", kind="stable")
    code, names = pd.factorize(pd.concat([cells["cluster"], before["cluster"]]), use_na_sentinel=False)
    k, n = len(names), len(cells)
    below = np.bincount(code[n:], weights=before["neg"], minlength=k)
    code, pos, neg = code[:n], cells["pos"].to_numpy(dtype=float), cells["neg"].to_numpy(dtype=float)
    wins = np.zeros((k, k))
    score = cells["score"].to_numpy()
    same = (score[1:] == score[:-1]) | (np.isnan(score[1:]) & np.isnan(score[:-1]))
    edges, start = np.flatnonzero(np.concatenate([[True] * (n > 0), ~same, [True]])), 0
    while start < n:
        # whole scores, at most STEP_COUNTS counts at once, or one score
        first = np.searchsorted(edges, start)
        last = max(np.searchsorted(edges, start + STEP_COUNTS // k, side="right") - 1, first + 1)
        rows = slice(start, edges[last])
        level = np.repeat(np.arange(last - first), np.diff(edges[first : last + 1]))
        each = np.bincount(level * k + code[rows], weights=neg[rows], minlength=(last - first) * k).reshape(-1, k)
        upto = below + np.cumsum(each, axis=0)
        has = np.flatnonzero(pos[rows])
        has = has[np.argsort(code[rows][has], kind="stable")]
        if len(has):
            who = code[rows][has]
            starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            wins[who[starts]] += np.add.reduceat(pos[rows][has, None] * (upto - each / 2)[level[has]], starts, axis=0)
        below, start = upto[-1], edges[last]
    a, b = np.nonzero(wins)
    return pd.DataFrame({"a": names[a], "b": names[b], "wins": wins[a, b]})


def _measures(threshold: float) -> dict[str, Column]:
    over = lambda n, d: F.when(d > 0, n / d)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n, sensitivity, specificity = tp + fp + fn + tn, over(tp, tp + fn), over(tn, tn + fp)
    return {
        "sensitivity": sensitivity, "specificity": specificity, "ppv": over(tp, tp + fp), "npv": over(tn, tn + fn), "balanced_accuracy": (sensitivity + specificity) / 2,
        "auc": over(F.col("wins"), ((tp + fn) * (fp + tn)).cast("double")), "brier": over(F.col("squares"), n), "log_loss": over(F.col("losses"), n), "net_benefit": over(tp - fp * (threshold / (1 - threshold)), n),
    }


def classification_bootstrap(df: DataFrame, cluster: str, y: str, score: str, threshold: float, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """measure, estimate, low, high, draws: nine measures of a binary classifier with percentile intervals over resampled clusters.

    Cases are read for sums of each cluster and for its wins; a draw then costs clusters squared.
    """
    hit, true = F.col(score) >= threshold, F.col(y) == 1
    squares, losses = (F.col(score) - F.col(y)) * (F.col(score) - F.col(y)), log_loss(F.col(y), F.col(score), 1e-12)
    counts = [F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")]
    stats = df.groupBy(cluster).agg(*counts, F.sum(squares).alias("squares"), F.sum(losses).alias("losses"))
    shared_dir(df.sparkSession)
    stats, wins = stats.checkpoint(), win_matrix(df, cluster, y, score).checkpoint()
    names = ("tp", "fp", "fn", "tn", "squares", "losses")
    measures = _measures(threshold)
    table = lambda rows, keys: rows.select(*keys, *(m.alias(k) for k, m in measures.items())).unpivot(list(keys), list(measures), "measure", "value")
    drawn_ = table(resampled_sums(stats, cluster, names, draws, seed, wins), ["draw"]).filter("value IS NOT NULL")
    interval = drawn_.groupBy("measure").agg(F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"), F.count(F.lit(1)).alias("draws"))
    point = table(stats.agg(*(F.sum(c).alias(c) for c in names)).crossJoin(wins.agg(F.coalesce(F.sum("wins"), F.lit(0.0)).alias("wins"))), [])
    return point.withColumnRenamed("value", "estimate").join(interval, "measure", "left")


def cluster_reliability(df: DataFrame, cluster: str, y: str, score: str, tie: str, bins: int, draws: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """Bins of equal count, fixed once, whose observed rates have percentile intervals over resampled clusters."""
    cells = in_equal_bins(df, score, tie, bins).groupBy("bin", cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("events"), F.sum(score).alias("scores"))
    times = cluster_multiplicities(cells, cluster, draws, seed)
    each = times.join(cells, cluster).groupBy("draw", "bin").agg((F.sum(F.col("times") * F.col("events")) / F.sum(F.col("times") * F.col("n"))).alias("rate"))
    interval = each.groupBy("bin").agg(F.percentile("rate", F.lit(alpha / 2)).alias("low"), F.percentile("rate", F.lit(1 - alpha / 2)).alias("high"))
    point = cells.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum("scores") / F.sum("n")).alias("mean_score"), (F.sum("events") / F.sum("n")).alias("observed"), F.count(F.lit(1)).alias("n_clusters"))
    return point.join(interval, "bin", "left")
