"""Other catalogs, and loaders of question and case files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.event_log import read_texts
from tidewake.sources.store import Store

_NAME = re.compile(r"[A-Za-z_]\w*")


def _views(spark: SparkSession, location: str, suffix: str, alias: str, read) -> list[str]:
    store, names = Store(spark, location), set()
    for name, _, _ in store.files():
        top = name.split("/")[0]
        if top.endswith(suffix):
            names.add(top)
    out = []
    for name in sorted(names):
        table = name.removesuffix(suffix)
        if not _NAME.fullmatch(table):
            raise ValueError(f"not a table's name: {table!r}")
        df = read(store.at(name))
        # a view of a projection can't be written through
        df.select(*(F.col(f"`{c}`") for c in df.columns)).createOrReplaceTempView(f"{alias}_{table}" if alias else table)
        out.append(f"{alias}_{table}" if alias else table)
    return out


def attach(spark: SparkSession, location: str, alias: str) -> list[str]:
    """The parquet tables of a folder as views ``alias_table``: what is behind a view can be read and not written."""
    if not _NAME.fullmatch(alias):
        raise ValueError(f"not an alias: {alias!r}")
    return _views(spark, location, ".parquet", alias, spark.read.parquet)


def load_csvs(spark: SparkSession, location: str, alias: str = "") -> list[str]:
    """The CSV files of a folder as views of text columns."""
    return _views(spark, location, ".csv", alias, lambda path: read_texts(spark, path))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, question, asker_role; trimmed, rows without a question or with a repeated id refused."""
    df = read_texts(spark, path)
    missing = {"question_id", "question", "asker_role"} - set(df.columns)
    if missing:
        raise ValueError(f"{path}: {', '.join(sorted(missing))} missing")
    out = df.select(*(F.trim(c).alias(c) for c in ("question_id", "question", "asker_role")))
    bad = out.filter("coalesce(question_id, '') = '' OR coalesce(question, '') = ''").unionAll(out.groupBy("question_id").count().filter("count > 1").select("question_id", F.lit(None).cast("string"), F.lit(None).cast("string")))
    if not bad.isEmpty():
        raise ValueError(f"{path}: a question is empty or its id repeats")
    return out


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines: question, expected (answer, clarify or refuse) and the rows that an answer should have."""
    df = spark.read.schema("question string, expected string, rows array<string>").json(path)
    if not df.filter("question IS NULL OR expected IS NULL OR expected NOT IN ('answer', 'clarify', 'refuse')").isEmpty():
        raise ValueError(f"{path}: a case without question or with an unknown expectation")
    return df
