"""Tables as checked, content-addressed artifact sets with a pointer to the current one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators.contracts import ContractError, repeated_keys
from tidewake.sources.store import Store


@dataclass(frozen=True)
class Artifact:
    df: DataFrame
    grain: tuple[str, ...]
    order: tuple[str, ...] = ()
    kind: str = "parquet"


#: Fixed value: rows of a row group in ordered artifacts.
ROW_GROUP_ROWS = 122_880


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows as a multiset: the same however they are ordered or split into files."""
    cells = [F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in sorted(df.columns)]
    row = F.xxhash64(F.concat_ws("\x1f", *cells))
    other = F.xxhash64(F.concat_ws("\x1e", *cells), F.lit(7))
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.sum(other.cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(json.dumps([sorted(df.dtypes), found.n, str(found.a), str(found.b)]).encode()).hexdigest()


def write_ordered(df: DataFrame, path: str, order: Sequence[str], single: bool = False) -> None:
    """Parquet with zstd, rows in a total order and row groups of ``ROW_GROUP_ROWS`` rows; one file only where a reader needs one."""
    out = df.orderBy(*(F.col(c).asc_nulls_last() for c in order)) if order else df
    (out.coalesce(1) if single else out).write.option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS).parquet(path)


def stack_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables below one another, columns in the order in which they are first seen, what a table lacks null."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, order: Sequence[str] = (), single: bool = False) -> None:
    """CSV in files that each have the header, rows in a total order from file to file; one file only where a reader needs one."""
    out = df.orderBy(*(F.col(c).asc_nulls_last() for c in order)) if order else df
    (out.coalesce(1) if single else out).write.csv(path, header=True)


def append_rows(df: DataFrame, path: str) -> None:
    """An append-only ledger of JSON lines."""
    df.write.mode("append").json(path)


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current rows without those that changes replace, and the changes."""
    return current.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def publish(spark: SparkSession, location: str, artifacts: dict[str, Artifact], inputs: dict) -> str:
    """Write all tables to a staging folder, check their grain, name the set by its content, and point to it.

    A reader sees the former set or the new one, never part of one. Publishing equal content
    again changes nothing.
    """
    store = Store(spark, location)
    staging = f".staging-{hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]}"
    store.delete(staging)
    entries = {}
    for name, a in artifacts.items():
        path = f"{staging}/{name}"
        if a.kind == "csv":
            write_csv(a.df, store.at(path), a.order or a.grain)
            written = spark.read.csv(store.at(path), header=True)
        else:
            write_ordered(a.df, store.at(path), a.order or a.grain)
            written = spark.read.parquet(store.at(path))
        if a.grain and not repeated_keys(written, a.grain).isEmpty():
            raise ContractError(f"{name}: rows repeat {', '.join(a.grain)}")
        if a.grain and not written.filter(" OR ".join(f"`{k}` IS NULL" for k in a.grain)).isEmpty():
            raise ContractError(f"{name}: null in {', '.join(a.grain)}")
        entries[name] = {"kind": a.kind, "grain": list(a.grain), "rows": written.count(), "digest": content_digest(written), "bytes": sum(size for _, size, _ in store.files(path))}
    manifest = {"artifacts": entries, "inputs": inputs}
    identity = hashlib.sha256(json.dumps({n: e["digest"] for n, e in sorted(entries.items())} | {"inputs": inputs}, sort_keys=True, default=str).encode()).hexdigest()
    store.write_json(f"{staging}/manifest.json", manifest)
    if store.exists(identity):
        store.delete(staging)
    else:
        store.rename(staging, identity)
    store.write_json("CURRENT", {"set": identity})
    return identity


def current(spark: SparkSession, location: str) -> str | None:
    found = Store(spark, location).read_json("CURRENT")
    return found and found["set"]


def verify(spark: SparkSession, location: str, identity: str | None = None) -> list[str]:
    """Names of tables of a set whose rows aren't those of its manifest."""
    store = Store(spark, location)
    identity = identity or current(spark, location)
    manifest = store.read_json(f"{identity}/manifest.json")
    if manifest is None:
        return ["manifest.json"]
    read = lambda n, e: spark.read.csv(store.at(f"{identity}/{n}"), header=True) if e["kind"] == "csv" else spark.read.parquet(store.at(f"{identity}/{n}"))
    return [n for n, e in manifest["artifacts"].items() if not store.exists(f"{identity}/{n}") or content_digest(read(n, e)) != e["digest"]]
