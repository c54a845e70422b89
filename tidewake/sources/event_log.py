"""Readers of the event log and its side tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake.operators.contracts import ContractError, schema_errors
from tidewake.sources.store import Store, plain_path

_MONTH = re.compile(r"ingest_month=(\d{4}-(?:0[1-9]|1[0-2]))\.parquet\Z")
_TEXT = ("string",)
#: Columns of the log with the types that are accepted; timestamps in nanoseconds arrive as bigint.
COLUMNS = {
    "event_id": _TEXT, "case_id": _TEXT, "event_type": _TEXT, "site": _TEXT, "clinician_id": _TEXT, "ward_id": _TEXT, "event_ts": _TEXT, "source_system": _TEXT,
    "ingest_ts": ("timestamp_ntz", "timestamp", "bigint"), "cost_cad": ("double", "float", "int", "bigint"), "tz_offset_hours": ("double", "float", "int", "bigint"),
}
GENERATIONS = ("service_code", "svc_code")


def month_of(path: str) -> str:
    """The ingest month in a file's name."""
    m = _MONTH.search(path)
    if not m:
        raise ValueError(f"no ingest month in {path}")
    return m[1]


def month_files(spark: SparkSession, location: str, first: str = "0000-00", last: str = "9999-99") -> dict[str, tuple[str, int, int]]:
    """month → (path, bytes, modification time); the path list is cut to the months before Spark reads any."""
    store = Store(spark, location)
    out: dict[str, tuple[str, int, int]] = {}
    for name, size, changed in store.files():
        if _MONTH.search(name) and first <= month_of(name) <= last:
            if month_of(name) in out:
                raise ValueError(f"two files for {month_of(name)}")
            out[month_of(name)] = (store.at(name), size, changed)
    return dict(sorted(out.items()))


def _wall_clock(df: DataFrame, name: str) -> DataFrame:
    kind = dict(df.dtypes)[name]
    if kind == "bigint":  # nanoseconds
        return df.withColumn(name, F.timestamp_micros(F.expr(f"{name} div 1000")).cast("timestamp_ntz"))
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


def _schema(spark: SparkSession, path: str) -> T.StructType:
    """A file's columns; where timestamps are in nanoseconds, the session is set to read these as numbers."""
    try:
        return spark.read.parquet(path).schema
    except Exception as e:
        if "NANOS" not in str(e):
            raise
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        return spark.read.parquet(path).schema


def read_events(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files of a log as one table, columns by name, both generations of the service code, and the month of the file.

    Each footer is checked before any row is read. Files of the same columns are one scan, so the plan
    grows with the generations of the log and not with its files.
    """
    alike: dict[str, list[str]] = {}
    for path in paths:
        found = _schema(spark, path)
        if errors := schema_errors(spark, spark.createDataFrame([], found), COLUMNS, GENERATIONS):
            raise ContractError(f"{path}: {'; '.join(errors)}")
        month_of(path)
        alike.setdefault(found.json(), []).append(path)
    out = None
    for kind, files in alike.items():
        df = spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(*files)
        df = df.withColumn("source_partition", F.regexp_extract(F.col("_metadata.file_path"), _MONTH.pattern.replace("\\Z", "$"), 1))
        df = _wall_clock(df, "ingest_ts").withColumns({c: F.col(c).cast("double") for c in ("cost_cad", "tz_offset_hours")})
        df = df.withColumns({c: F.lit(None).cast("string") for c in GENERATIONS if c not in df.columns})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of a file, from its footer."""
    return spark.read.parquet(path).count()


def rows_by_file(spark: SparkSession, paths: Sequence[str]) -> dict[str, int]:
    """path → rows, for any number of files in one job that reads no column; a file without rows has 0."""
    plain = {plain_path(spark, p): p for p in paths}
    # a row for each file of a list that the driver holds
    found = spark.read.schema("event_id string").parquet(*paths).groupBy(F.col("_metadata.file_path").alias("path")).count().collect() if paths else []
    return dict.fromkeys(paths, 0) | {plain[plain_path(spark, r.path, escaped=True)]: r["count"] for r in found}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column text: types are tried where they are used."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and inferred types."""
    return spark.read.csv(path, header=True, inferSchema=True)


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as types; what doesn't parse is null."""
    return df.withColumns({c: F.trim(F.col(c)).try_cast(t) for c, t in types.items()})


def literal_table(spark: SparkSession, schema: T.StructType | str, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)
