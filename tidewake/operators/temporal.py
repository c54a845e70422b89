"""Joins and windows along time, where one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(at: Column | str) -> Column:
    """Microseconds of a wall clock or an instant since 1970."""
    at = F.col(at) if isinstance(at, str) else at
    return F.unix_micros(at.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, take: Sequence[str], tie: str, span: int = 30 * 86_400, within: int | None = None) -> DataFrame:
    """Left rows with the ``take`` columns of the latest right row of their key that isn't later; null where there is none.

    Both sides are laid on one line of time for each key, which is cut every ``span`` seconds: the latest right row
    inside a piece is a running value of the piece, and what comes from before it is carried over from the pieces'
    last rows, so that a common key is as many tasks' work as its line has pieces. Of right rows of one time, that with the
    largest ``tie`` counts. ``within`` seconds bound how old it may be. Keys that are null match nothing.
    """
    both_at = "_at"
    row = F.struct(_micros(right_at).alias("at"), F.col(tie).alias("tie"), F.struct(*take).alias("row"))
    own = [F.col(c) for c in left.columns]
    marks = right.filter(F.col(right_at).isNotNull()).select(*by, _micros(right_at).alias(both_at), F.lit(0).alias("_side"), row.alias("_row"))
    asked = left.select(*by, _micros(left_at).alias(both_at), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    line = marks.unionByName(asked, allowMissingColumns=True)
    line = line.withColumn("_piece", F.floor(F.col(both_at) / (span * 1_000_000)))
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    line = line.withColumn("_row", F.when(known, F.col("_row")))
    # right rows come before left rows of the same time, and the largest tie comes last
    order = Window.partitionBy(*by, "_piece").orderBy(both_at, "_side", F.col("_row.tie").asc_nulls_first())
    inside = F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = line.groupBy(*by, "_piece").agg(F.max("_row").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_piece").alias("_of"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    same = F.col("_piece").eqNullSafe(F.col("_of"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = line.withColumn("_inside", inside).filter("_side = 1").join(carried, same, "left")
    match = F.coalesce("_inside", "_carried")
    if within is not None:
        match = F.when(F.col(both_at) - match["at"] <= within * 1_000_000, match)
    return found.select("_left.*", match.alias("_match")).select(*left.columns, *(F.col(f"_match.row.{c}").alias(c) for c in take))


def interval_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], at: str, start: str, end: str, base: int = 86_400) -> DataFrame:
    """Points with the intervals of their key that hold them: start <= at < end.

    An interval goes to the level whose bins are the shortest that aren't shorter than it (``base`` seconds, then four times
    as long each), so it lies in two bins at most, whatever its length; a point looks into one bin of each level that
    occurs. Rows meet by key and bin, so a common key is dealt out by time. Empty intervals and nulls match nothing.
    """
    own, other = [c for c in points.columns], [c for c in intervals.columns if c not in by]
    length = (_micros(end) - _micros(start)) / F.lit(base * 1_000_000.0)
    spans = intervals.filter(F.col(start) < F.col(end)).withColumn("_level", F.greatest(F.ceil(F.log(4.0, length) - 1e-12), F.lit(0)).cast("int"))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # a few dozen at most, for lengths in microseconds
    width = F.lit(base * 1_000_000) * F.pow(F.lit(4), F.col("_level")).cast("long")
    bin_ = lambda m: F.floor(m / width).cast("long")
    spans = spans.withColumn("_bin", F.explode(F.sequence(bin_(_micros(start)), bin_(_micros(end) - 1))))
    spans = spans.select(*(F.col(c).alias(f"_by_{c}") for c in by), *other, F.col("_level").alias("_of_level"), F.col("_bin").alias("_of_bin"))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bin", bin_(_micros(at)))
    on = (F.col("_level") == F.col("_of_level")) & (F.col("_bin") == F.col("_of_bin")) & (F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))
    for c in by:
        on = on & (F.col(c) == F.col(f"_by_{c}"))
    return asked.join(spans, on).select(*own, *other)


def sessions(events: DataFrame, by: Sequence[str], at: str, gap: str, measures: Sequence[Column], late: str | None = None) -> DataFrame:
    """by, session_start, session_end and measures of runs of events no further apart than ``gap``; the end is the last event plus the gap.

    On a stream, a session is given once the watermark, ``late`` behind the latest event, has passed its end, and its state is dropped.
    """
    rows = events if late is None else events.withWatermark(at, late)
    out = rows.groupBy(*by, F.session_window(at, gap).alias("_w")).agg(*measures)
    return out.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *(c for c in out.columns if c not in (*by, "_w")))


def followed_within(first: DataFrame, second: DataFrame, key: str, first_at: str, second_at: str, within: str, late: str | None = None, how: str = "inner") -> DataFrame:
    """Rows of ``first`` with those of ``second`` of their key that come at the same time or up to ``within`` later.

    On two streams both watermarks bound the state: a row is dropped when nothing that it could meet is still to come,
    and with ``left_outer`` it is then given alone. Columns of ``second`` have names of their own.
    """
    if late is not None:
        first, second = first.withWatermark(first_at, late), second.withWatermark(second_at, late)
    second = second.withColumnRenamed(key, f"_{key}")
    on = (F.col(key) == F.col(f"_{key}")) & (F.col(second_at) >= F.col(first_at)) & (F.col(second_at) <= F.col(first_at) + F.expr(f"INTERVAL {within}"))
    return first.join(second, on, how).drop(f"_{key}")
