"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of the contracts: six ASCII characters, and what stands between them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]"


#: While a table is written: shuffle files go when it is written, as they aren't read again, and Python workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_ONE_BY_ONE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
#: Groups that are broadcast at most, the largest; all others are joined by a shuffle.
MOST_HOT = 50_000
#: Rows that a group may bring to one task in any case.
LEAST_HOT = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where none is set and all runs on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a statement."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def few(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker holds beside a batch stays small; freed memory goes back when the task ends."""
    try:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield b.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library can, its free memory too
            ctypes.CDLL(None).malloc_trim(0)


class Tables:
    """Intermediate tables in the shared folder.

    A written table cuts lineage: a lost executor costs the tasks that it ran, never the
    job, and every reader sees the same rows even where an expression isn't deterministic.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, partitions: Iterable[str] = (), large_rows: bool = False) -> DataFrame:
        """``large_rows``: rows of megabytes are read and passed to Python workers one by one."""
        path = f"{self.base}/{self.count}"
        self.count += 1
        with _settings(self.spark, _WRITING | (_ONE_BY_ONE if large_rows else {})):
            df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidewake_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self._delete(t._tidewake_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CAPITALS = re.compile("[A-Z]+").sub


def lower_az(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else _CAPITALS(lambda m: m[0].lower(), text)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of a frame, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def with_key(docs: DataFrame, id_col: str, label: str) -> tuple[DataFrame, str]:
    """The rows with a column that tells them apart: the id itself where it does, else a written row number."""
    if docs.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    row = free_name("_row", docs)
    return Tables(docs.sparkSession, label).write(docs.withColumn(row, F.monotonically_increasing_id())), row


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their group, on keys without nulls, where a group may hold any share of the rows.

    ``size`` is the column of ``groups`` with its number of rows, ``total`` the number of all rows. Groups of
    more than a ``MOST_HOT``-th of the rows are fewer than ``MOST_HOT`` and are broadcast, so that their rows
    stay where they are; the rows of the others are shuffled, a bounded number for each key.
    """
    least = max(total // MOST_HOT, LEAST_HOT)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    few = rows.join(F.broadcast(groups.filter(F.col(size) > least).select(*keys)), list(keys), "left_anti")
    return rows.join(hot, list(keys)).unionByName(few.join(groups.filter(F.col(size) <= least), list(keys)))


def join_spread(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with the one row of their key, where a key may hold any share of the rows.

    The row of a key with more than a ``MOST_HOT``-th of all ``total`` rows is copied, so that its rows meet it in
    several tasks; there are fewer than ``MOST_HOT`` such keys, and only they, with a number each, are broadcast.
    """
    limit = max(total // MOST_HOT, 8 * LEAST_HOT, 1)
    hot = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("_salts")).filter("_salts > 1")
    spread = many.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = one.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copied, [key, "_salt"]).drop("_salt")
