"""Numbers inside JSON documents of any shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels that a document may have; deeper ones fail instead of losing numbers.
MOST_LEVELS = 64


def json_numbers(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """keys, path, number: every number of a JSON text, with its path (``a.b[0].c``); texts that aren't JSON, and null, give none.

    One level is opened at a time, as rows, until no row holds an object or a list.
    """
    rows = df.select(*keys, F.lit("").alias("path"), F.expr(f"try_parse_json(`{column}`)").alias("v"))
    kind = F.expr("schema_of_variant(v)")
    found = None
    for _ in range(MOST_LEVELS):
        told = rows.withColumn("_kind", kind)
        numbers = told.filter(F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")).select(*keys, "path", F.expr("variant_get(v, '$', 'double')").alias("number"))
        found = numbers if found is None else found.unionByName(numbers)
        nested = told.filter(F.col("_kind").rlike("^(OBJECT|ARRAY)"))
        if nested.isEmpty():
            return found
        opened = nested.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value")))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), F.col("key")))
        rows = opened.select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))
    raise ValueError(f"a document of more than {MOST_LEVELS} levels")
