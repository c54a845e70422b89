"""A provenance row for each number of a result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_registry(results: DataFrame, table: str, key: Sequence[str], units: dict[str, str], status: str = "computed") -> DataFrame:
    """number_id, table, row_key, cell, value, unit, status; ids follow the row's key and the cell's name."""
    numbers = [c for c, t in results.dtypes if c not in key and (t in ("double", "float", "bigint", "int") or t.startswith("decimal"))]
    rows = results.select(F.concat_ws("|", *(F.col(k).cast("string") for k in key)).alias("row_key"), *(F.col(c).cast("double").alias(c) for c in numbers))
    cells = rows.unpivot(["row_key"], numbers, "cell", "value")
    unit = F.coalesce(*(F.when(F.col("cell") == c, F.lit(u)) for c, u in units.items()), F.lit("number"))
    nth = F.row_number().over(Window.orderBy("row_key", "cell"))
    width = F.greatest(F.lit(6), F.length(F.count(F.lit(1)).over(Window.partitionBy()).cast("string")))
    return cells.select(F.concat(F.lit(f"{table}-"), F.lpad(nth.cast("string"), width, F.lit("0"))).alias("number_id"), F.lit(table).alias("source_table"), "row_key", "cell", "value", unit.alias("unit"), F.lit(status).alias("status"))


def explode_listed(df: DataFrame, column: str, out: str, sep: str = ";") -> DataFrame:
    """One row for each part of a separated list; empty parts are left out."""
    parts = F.filter(F.transform(F.split(column, sep), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumn(out, F.explode(parts))


def stacked_ledger(tables: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Tables of different columns as one, with their name and a global row number."""
    out = None
    for name, df in tables.items():
        named = df.withColumn("source_table", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out.withColumn("row", F.row_number().over(Window.orderBy("source_table", *order)).cast("long"))
