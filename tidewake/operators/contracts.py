"""Contracts as data: each check is a row (name, observed, expected, passed)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A required contract doesn't hold."""


def check(df: DataFrame, name: str, observed: Column, expected: Column | int) -> DataFrame:
    """A contract over a whole table: an aggregate and what it should be."""
    want = F.lit(expected) if isinstance(expected, int) else expected
    return df.agg(observed.cast("long").alias("observed"), want.cast("long").alias("expected")).select(F.lit(name).alias("contract"), "observed", "expected", (F.col("observed") == F.col("expected")).alias("passed"))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of more than one row."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def grain(df: DataFrame, key: Sequence[str], name: str = "grain") -> DataFrame:
    """Keys are unique and not null."""
    nulls = df.filter(" OR ".join(f"`{k}` IS NULL" for k in key)).select(F.lit(1).alias("n"))
    return check(repeated_keys(df, key).select("n").unionAll(nulls), name, F.count(F.lit(1)), 0)


def ranges(df: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """A contract for each rule of a dimension or snapshot: no row breaks it; a rule that is null is broken. One pass."""
    one = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"_{i}") for i, ok in enumerate(rules.values())))
    rows = F.array(*(F.struct(F.lit(f"{name}.{rule}").alias("contract"), F.col(f"_{i}").alias("observed")) for i, rule in enumerate(rules)))
    return one.select(F.explode(rows).alias("x")).select("x.*", F.lit(0).cast("long").alias("expected")).withColumn("passed", F.col("observed") == 0)


def many_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "many_to_one") -> DataFrame:
    """The join neither multiplies nor loses rows: right keys are unique, and every left key is known."""
    a = left.groupBy(F.col(left_key).alias("k")).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(F.col(right_key).alias("k")).agg(F.count(F.lit(1)).alias("_r"))
    # keys of both sides with their numbers of rows: one join answers all three; null keys match nothing
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = a.join(b, "k", "full_outer")
    one = both.agg(F.count_if(F.col("_r") > 1).alias("repeated"), F.sum(F.when(F.col("_r").isNull(), zero("_l")).otherwise(0)).alias("unmatched"), F.sum(zero("_l") * F.greatest(zero("_r"), F.lit(1))).alias("joined"), F.sum(zero("_l")).alias("rows"))
    row = lambda part, observed, expected: F.struct(F.lit(f"{name}.{part}").alias("contract"), F.coalesce(observed, F.lit(0)).cast("long").alias("observed"), F.coalesce(expected, F.lit(0)).cast("long").alias("expected"))
    rows = F.array(row("unique", F.col("repeated"), F.lit(0)), row("unmatched", F.col("unmatched"), F.lit(0)), row("rows", F.col("joined"), F.col("rows")))
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.col("observed") == F.col("expected"))


def one_to_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "one_to_one") -> DataFrame:
    """Keys are unique on both sides."""
    return grain(left, [left_key], f"{name}.left").unionAll(grain(right, [right_key], f"{name}.right"))


def coverage(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys that only one side has; a null key is on neither other side.

    One aggregation says for each key on which sides it is: neither side is sorted, joined or made distinct twice.
    """
    both = left.select(F.col(left_key).alias("key"), F.lit(1).alias("side")).unionAll(right.select(F.col(right_key).alias("key"), F.lit(2).alias("side")))
    on = both.groupBy("key").agg(F.bit_or("side").alias("on")).filter("on < 3 OR key IS NULL")
    only = lambda bit, side: F.when(F.col("on").bitwiseAND(bit) > 0, F.lit(side))
    return on.select(F.explode(F.array_compact(F.array(only(1, "left_only"), only(2, "right_only")))).alias("side"), "key")


def conservation(df: DataFrame, reason: str, raw_rows: DataFrame, contained: Sequence[str]) -> DataFrame:
    """Raw rows are all accepted or rejected, and no rejection is of a kind that isn't contained."""
    kept = df.select(F.lit(1).alias("side"), F.col(reason).alias("reason")).unionAll(raw_rows.select(F.lit(0), F.lit(None).cast("string")))
    rows = check(kept, "rows_conserved", F.count_if(F.col("side") == 1), F.count_if(F.col("side") == 0))
    fatal = F.col("reason").isNotNull() & ~F.col("reason").isin(*contained)
    return rows.unionAll(check(kept, "no_fatal_rejection", F.count_if(fatal), 0))


def require(results: DataFrame) -> DataFrame:
    """The results, if every contract passed; the failed ones are a few rows."""
    failed = results.filter("NOT passed").limit(20).collect()
    if failed:
        raise ContractError("; ".join(f"{r.contract}: {r.observed} is not {r.expected}" for r in failed))
    return results


def schema_errors(spark: SparkSession, df: DataFrame, wanted: dict[str, tuple[str, ...]], any_of: Sequence[str] = ()) -> list[str]:
    """Columns that are missing or of a type outside the accepted ones, before any row is read."""
    have = dict(df.dtypes)
    errors = [f"{c}: missing" if c not in have else f"{c}: {have[c]}" for c, kinds in wanted.items() if have.get(c) not in kinds]
    if any_of and not set(any_of) & set(have):
        errors.append(f"one of {', '.join(any_of)}: missing")
    return errors
