"""Tables of keyed rows whose changes cost what they touch.

Rows are dealt to buckets by a hash of their key. A snapshot says which folders hold each bucket; a
change reads and writes the buckets of its keys alone and gives a new snapshot, in which all other
buckets point to the folders that they had. Nothing that was written is altered, so a reader of a
snapshot always finds its rows, and a writer that fails leaves folders that no snapshot names.

``commit`` makes a snapshot the latest one of the table, unless another writer was faster: the
manifest of a version is created once. Whoever keeps snapshots elsewhere (a monitor that moves several
tables in one step) needs no commit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.sources.store import Store


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Snapshot:
    """Folders of each bucket, the oldest first."""

    version: int = 0
    parts: dict[int, tuple[str, ...]] = field(default_factory=dict)

    def to_json(self) -> dict:
        return {"version": self.version, "parts": {str(k): list(v) for k, v in self.parts.items()}}

    @staticmethod
    def from_json(value: dict | None) -> Snapshot:
        return Snapshot(value["version"], {int(k): tuple(v) for k, v in value["parts"].items()}) if value else Snapshot()


class VersionedTable:
    """``schema`` is DDL; ``buckets`` bounds what a key shares its files with and never changes for a table."""

    def __init__(self, spark: SparkSession, location: str, key: Sequence[str], schema: str, buckets: int = 64):
        self.spark, self.store, self.key, self.schema, self.buckets = spark, Store(spark, location), list(key), schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys; as many numbers at most as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())

    def read(self, at: Snapshot, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of all or some buckets."""
        wanted = at.parts if buckets is None else [b for b in buckets if b in at.parts]
        folders = [self.store.at(p) for b in wanted for p in at.parts[b]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Folder of each bucket that has rows; rows of a bucket meet in tasks of a bounded size."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*(F.col(f.name).cast(f.dataType) for f in self._fields()), self.bucket().alias("_bucket"))
        placed.hint("rebalance", F.col("_bucket")).write.partitionBy("_bucket").parquet(self.store.at(name))
        found = {int(path.partition("_bucket=")[2].partition("/")[0]) for path, _, _ in self.store.files(name) if "_bucket=" in path}
        return {b: f"{name}/_bucket={b}" for b in found}

    def _fields(self):
        return self.spark.createDataFrame([], self.schema).schema.fields

    def append(self, at: Snapshot, rows: DataFrame) -> Snapshot:
        """Rows beside those that are there; nothing is read."""
        return Snapshot(at.version + 1, at.parts | {b: (*at.parts.get(b, ()), p) for b, p in self._write(rows).items()})

    def replace(self, at: Snapshot, rows: DataFrame, touched: Iterable[int]) -> Snapshot:
        """``rows`` as all that the touched buckets hold."""
        new = self._write(rows)
        if stray := set(new) - set(touched):
            raise ValueError(f"rows of other buckets: {sorted(stray)}")
        return Snapshot(at.version + 1, {b: p for b, p in at.parts.items() if b not in set(touched)} | {b: (p,) for b, p in new.items()})

    def merge(self, at: Snapshot, changes: DataFrame, gone: DataFrame | None = None) -> Snapshot:
        """Changes in place of rows with their keys, and without the keys of ``gone``; keys of ``changes`` are distinct."""
        keys = changes.select(*self.key) if gone is None else changes.select(*self.key).unionByName(gone.select(*self.key))
        touched = self.touched(keys)
        kept = self.read(at, touched).join(keys.distinct(), self.key, "left_anti").select(*(f.name for f in self._fields()))
        return self.replace(at, kept.unionByName(changes.select(*kept.columns)), touched)

    def compact(self, at: Snapshot, most: int) -> Snapshot:
        """Buckets of more than ``most`` folders as one folder each."""
        many = [b for b, p in at.parts.items() if len(p) > most]
        return self.replace(at, self.read(at, many), many) if many else at

    # ---- a table of its own

    def latest(self) -> Snapshot:
        versions = [int(path.rpartition("/")[2].removesuffix(".json")) for path, _, _ in self.store.files("manifests")]
        return Snapshot.from_json(self.store.read_json(f"manifests/{max(versions):010d}.json")) if versions else Snapshot()

    def commit(self, snapshot: Snapshot) -> Snapshot:
        """The snapshot as the latest one; refused if its version is taken."""
        try:
            self.store.create_json(f"manifests/{snapshot.version:010d}.json", snapshot.to_json())
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {snapshot.version} is taken") from e
            raise
        return snapshot

    def vacuum(self, kept: Iterable[Snapshot]) -> int:
        """Deletes folders of writes that no kept snapshot reads; how many."""
        used = {p.split("/")[1] for s in kept for parts in s.parts.values() for p in parts}
        there = {path.split("/")[1] for path, _, _ in self.store.files("data")}
        for name in there - used:
            self.store.delete(f"data/{name}")
        return len(there - used)
