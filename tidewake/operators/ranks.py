"""Running totals along an order of any length.

The rows of an order (counts of distinct values, in most uses) are written once. Where they are few, one
window for each group does. Where they are many, they are sorted by all of their order, so that Spark's
range partitions cut a long group, or a value with many ties, wherever a task has enough; the partition
becomes a part of the order, parts are totalled, and what came before a row is the total of the parts
before its own and of the rows before it in its part. Parts are as many as the sort made tasks, and
totals of parts a row for each part and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.graph import shared_dir

#: Rows that one task may put in order; beyond, they are dealt to parts.
FEW_ROWS = 200_000
#: Bits of a row's number that count rows of its task.
_ROW_BITS = 33


def _checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Ordered:
    """Rows in the order of ``value`` within groups of ``by``, written once; (by, value) tells rows apart."""

    def __init__(self, df: DataFrame, by: Sequence[str], value: str):
        self.by, self.value = list(by), value
        self.rows = _checkpoint(df)
        self.few = self.rows.count() <= FEW_ROWS
        if not self.few:
            order = [F.col(c).asc_nulls_first() for c in (*self.by, value)]
            self.rows = _checkpoint(self.rows.orderBy(*order).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), _ROW_BITS)))

    def before(self, rows: DataFrame, totals: dict[str, Column], descending: bool = False, product: bool = False) -> DataFrame:
        """``rows`` (those of the order, with more columns) and, by name, the total of an expression over all rows before each one.

        With ``product`` the totals are products.
        """
        total, none = (F.product, 1.0) if product else (F.sum, 0)
        turn = F.desc if descending else F.asc
        parts = [] if self.few else ["_part"]
        within = Window.partitionBy(*self.by, *parts).orderBy(turn(self.value)).rowsBetween(Window.unboundedPreceding, -1)
        inside = {n: F.coalesce(total(c).over(within), F.lit(none)) for n, c in totals.items()}
        if self.few:
            return rows.withColumns(inside)
        names = {n: f"_{i}_" for i, n in enumerate(totals)}
        sums = rows.groupBy(*self.by, "_part").agg(*(total(c).alias(names[n]) for n, c in totals.items()))
        upto = Window.partitionBy(*self.by).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select(*(F.col(c).alias(f"_by_{c}") for c in self.by), F.col("_part").alias("_of"), *(F.coalesce(total(n).over(upto), F.lit(none)).alias(n) for n in names.values()))
        same = F.col("_part") == F.col("_of")
        for c in self.by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        out = rows.withColumns(inside).join(offsets, same)
        out = out.withColumns({n: F.col(n) * F.col(names[n]) if product else F.col(n) + F.col(names[n]) for n in totals})
        return out.drop("_of", *(f"_by_{c}" for c in self.by), *names.values())


def running(df: DataFrame, by: Sequence[str], value: str, totals: dict[str, Column], descending: bool = False, product: bool = False) -> DataFrame:
    """Adds, for each name, the total of an expression over the rows before this one in the order of ``value``; rows are unique in (by, value)."""
    ordered = Ordered(df, by, value)
    return ordered.before(ordered.rows, totals, descending, product).drop("_part")


def positions(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """Adds ``_position``, 1-based in the order of (value, tie), and ``_rows``, the number of all rows.

    Rows are sorted by both and written; a row's place is its number in its task after the rows of all tasks before.
    A value that most rows have is cut by its ties like any other stretch of the order.
    """
    order = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    rows = _checkpoint(df.orderBy(order, F.asc_nulls_first(tie)).withColumn("_id", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_id", _ROW_BITS).alias("_part")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("_part", before.alias("_before"), F.sum("_c").over(whole).alias("_rows"))  # a row for each task of the sort
    rows = rows.withColumn("_part", F.shiftright("_id", _ROW_BITS)).join(F.broadcast(parts), "_part")
    return rows.withColumn("_position", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).drop("_id", "_part", "_before")


def quantiles(df: DataFrame, value: str, points: Sequence[float]) -> DataFrame:
    """One row with ``edges``, the exact quantiles of the values that aren't null, interpolated between ranks."""
    ordered = Ordered(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")), [], value)
    placed = ordered.before(ordered.rows, {"_before": F.col("_c")}).crossJoin(F.broadcast(ordered.rows.agg(F.sum("_c").alias("_n"))))
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in points]
    pick = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")), F.col(value)))
    both = placed.agg(F.max("_n").alias("_n"), *(x for i, h in enumerate(at) for x in (pick(F.floor(h)).alias(f"lo{i}"), pick(F.ceil(h)).alias(f"hi{i}"))))
    edge = lambda i, h: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (h - F.floor(h))
    return both.select(F.array(*(edge(i, h) for i, h in enumerate(at))).alias("edges"))
