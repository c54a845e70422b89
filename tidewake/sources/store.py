"""Files of any store that Spark reads, through Hadoop's file system API."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession


def plain_path(spark: SparkSession, path: str, escaped: bool = False) -> str:
    """A path without scheme and host; ``escaped`` for those that Spark's file metadata give."""
    jvm = spark.sparkContext._jvm
    return jvm.java.net.URI(path).getPath() if escaped else jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.base}/{name}" if name else self.base

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def files(self, name: str = "") -> Iterator[tuple[str, int, int]]:
        """(path below the base, bytes, modification time) of every data file."""
        if not self.exists(name):
            return
        found = self._fs.listFiles(self._path(name), True)
        prefix = self._fs.makeQualified(self._path("")).toUri().getPath().rstrip("/") + "/"
        while found.hasNext():
            f = found.next()
            path = f.getPath().toUri().getPath().removeprefix(prefix)
            if not path.rpartition("/")[2].startswith(("_", ".")):
                yield path, f.getLen(), f.getModificationTime()

    def read_json(self, name: str, default=None):
        if not self.exists(name):
            return default
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value) -> None:
        """Canonical JSON: sorted keys, no spaces, a newline at the end; the file appears whole or not at all."""
        raw = (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()
        part = f"{name}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(raw)
        finally:
            stream.close()
        self.replace(part, name)

    def create_json(self, name: str, value) -> None:
        """JSON in a file that mustn't be there yet; of two that create it at once, one fails."""
        raw = (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False) + "\n").encode()
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(raw)
        finally:
            stream.close()

    def replace(self, old: str, new: str) -> None:
        """Rename over what is there, in one step where the store has one; readers see the former file or the new one."""
        fs = self._jvm.org.apache.hadoop.fs
        option = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        option[0] = fs.Options.Rename.OVERWRITE
        path = self._fs.makeQualified(self._path(new))
        fs.FileContext.getFileContext(path.toUri(), self._conf).rename(self._fs.makeQualified(self._path(old)), path, option)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.at(old)} couldn't become {self.at(new)}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
