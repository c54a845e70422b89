"""Partitions that are rebuilt only where something changed."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.store import Store, plain_path

STATE = "state.json"
#: Files up to this size are digested in tasks, each in memory as a whole; larger ones are streamed.
IN_TASK_BYTES = 256 << 20
_NAME = re.compile(r"[0-9A-Za-z._-]+")


def file_digest(spark: SparkSession, path: str) -> str:
    """sha256 of a file's bytes, read as a stream: a file of any size."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_digests(spark: SparkSession, store: Store, name: str = "") -> dict[str, str]:
    """sha256 of the bytes of every data file below ``name``, by its path below the store's base: one job for all files, and a stream for each one above ``IN_TASK_BYTES``."""
    sizes = {path: size for path, size, _ in store.files(name)}
    small = [path for path, size in sizes.items() if size <= IN_TASK_BYTES]
    found = {path: file_digest(spark, store.at(path)) for path in sizes.keys() - set(small)}
    if small:
        # the list of files is on the driver already; a row is a path and 64 characters
        read = spark.read.format("binaryFile").load([store.at(path) for path in small])
        rows = read.select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("digest")).collect()
        plain = {plain_path(spark, store.at(path)): path for path in small}
        found |= {plain[plain_path(spark, r.path, escaped=True)]: r.digest for r in rows}
    return found


def row_digests(df: DataFrame, partition: str) -> dict[str, str]:
    """A digest of each partition's rows that their order can't change: their number, and four sums of parts of a sha256 of each."""
    text = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    parts = [F.conv(F.substring(F.col("_h"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(F.col(partition).cast("string").alias("_p"), F.sha2(text.cast("binary"), 256).alias("_h")).groupBy("_p").agg(F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"d{i}") for i, p in enumerate(parts)))
    joined = F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "d0", "d1", "d2", "d3")))
    return {r[0]: r[1] for r in sums.select("_p", F.sha2(joined.cast("binary"), 256)).collect()}  # a row for each partition


def plan(state: dict, inputs: dict[str, str], version: str, replay: tuple[str, str] | None = None) -> tuple[list[str], list[str]]:
    """(partitions to rebuild, partitions to drop): new or changed input, another version of the code, or within a replay window."""
    known = state.get("partitions", {})
    inside = lambda m: replay is not None and replay[0] <= m <= replay[1]
    rebuild = [m for m, digest in sorted(inputs.items()) if inside(m) or known.get(m) != {"input": digest, "version": version}]
    return rebuild, sorted(set(known) - set(inputs))


def refresh(spark: SparkSession, location: str, inputs: dict[str, str], version: str, build: Callable[[str], DataFrame], replay: tuple[str, str] | None = None) -> list[str]:
    """Bring the partitions below ``location`` up to date; returns the ones that were rebuilt.

    Each partition is written aside, renamed, then entered in the state: a failed run goes on
    where it stopped.
    """
    store = Store(spark, location)
    state = store.read_json(STATE, {"partitions": {}})
    rebuild, gone = plan(state, inputs, version, replay)
    for m in gone:
        store.delete(f"partition={m}")
        del state["partitions"][m]
        store.write_json(STATE, state)
    for m in rebuild:
        aside = f".building-{m}"
        store.delete(aside)
        build(m).write.parquet(store.at(aside))
        state["partitions"].pop(m, None)
        store.write_json(STATE, state)
        store.delete(f"partition={m}")
        store.rename(aside, f"partition={m}")
        state["partitions"][m] = {"input": inputs[m], "version": version}
        store.write_json(STATE, state)
    return rebuild


def refresh_together(spark: SparkSession, location: str, inputs: dict[str, str], version: str, build: Callable[[list[str]], DataFrame], replay: tuple[str, str] | None = None) -> list[str]:
    """As ``refresh``, in one job: ``build`` gives the rows of all the partitions that it is asked for, with their ``partition``.

    They are written to a folder of their own and entered in one step, so a reader sees all of a refresh or
    nothing, and a failed run leaves the former partitions. A partition may turn out without rows.
    """
    if bad := [m for m in inputs if not _NAME.fullmatch(m)]:
        raise ValueError(f"no names for folders: {bad}")
    store = Store(spark, location)
    state = store.read_json(STATE, {"partitions": {}})
    known = {m: {k: v for k, v in p.items() if k != "run"} for m, p in state["partitions"].items()}
    rebuild, gone = plan({"partitions": known}, inputs, version, replay)
    kept = {m: p for m, p in state["partitions"].items() if m not in gone}
    if rebuild:
        run = f"run={uuid.uuid4().hex}"
        build(rebuild).filter(F.col("partition").isin(rebuild)).repartition("partition").write.partitionBy("partition").parquet(store.at(run))
        for m in rebuild:
            kept[m] = {"input": inputs[m], "version": version, "run": run if store.exists(f"{run}/partition={m}") else None}
    if rebuild or gone:
        store.write_json(STATE, {"partitions": kept})
    return rebuild


def read_together(spark: SparkSession, location: str, schema: str, partitions: Sequence[str] | None = None) -> DataFrame:
    """All or some partitions of ``refresh_together``, whose rows have ``schema`` (DDL) and their ``partition``."""
    store = Store(spark, location)
    state = store.read_json(STATE, {"partitions": {}})["partitions"]
    paths = [store.at(f"{p['run']}/partition={m}") for m, p in sorted(state.items()) if p["run"] and (partitions is None or m in partitions)]
    if not paths:
        return spark.createDataFrame([], f"{schema}, partition string")
    return spark.read.schema(f"{schema}, run string, partition string").option("basePath", store.base).parquet(*paths).drop("run")


def vacuum(spark: SparkSession, location: str) -> int:
    """Delete what the present state of ``refresh_together`` doesn't name; to be run when nobody reads a former one. Returns the folders deleted."""
    store = Store(spark, location)
    named = {f"{p['run']}/partition={m}" for m, p in store.read_json(STATE, {"partitions": {}})["partitions"].items()}
    held = {"/".join(path.split("/")[:2]) for path, _, _ in store.files() if path.startswith("run=")}
    for folder in held - named:
        store.delete(folder)
    return len(held - named)


def read(spark: SparkSession, location: str) -> DataFrame:
    """All partitions; their number is a column, so filters on it prune folders."""
    store = Store(spark, location)
    months: Sequence[str] = sorted(store.read_json(STATE, {"partitions": {}})["partitions"])
    return spark.read.option("basePath", store.base).parquet(*(store.at(f"partition={m}") for m in months))


def version_of(*parts: object) -> str:
    return hashlib.sha256(repr(parts).encode()).hexdigest()
