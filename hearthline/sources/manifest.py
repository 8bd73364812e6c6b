"""Tables whose content changes by a commit.

Data files are written once, into folders of their own. A manifest names the
folders that make up the table; it is written beside the others and renamed to its
number, which either happens or does not. Readers take the newest manifest, so
a writer that stops half-way leaves the table as it was. Folders that no kept
manifest names are removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

MANIFESTS = "_manifests"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the number that this one wanted."""


class CommittedTable:
    """A table below ``path`` with the declared ``schema`` (DDL text), optionally split by partition columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path.rstrip("/"), schema, tuple(partition_by)

    # files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        """Paths below the table that match, relative to it."""
        found = self._fs().globStatus(self._path(f"{self.path}/{pattern}")) or []
        root = self._fs().makeQualified(self._path(self.path)).toString()
        return sorted(s.getPath().toString()[len(root) + 1 :] for s in found)

    # manifests

    def versions(self) -> list[int]:
        """Numbers of the finished manifests, oldest first."""
        return [int(n[len(MANIFESTS) + 1 : -5]) for n in self._names(f"{MANIFESTS}/*.json")]

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Part (the partition's path, '' without partitions) -> folders below the table; of the newest version if none is given."""
        if version is None:
            found = self.versions()
            if not found:
                return {}
            version = found[-1]
        jvm = self.spark.sparkContext._jvm
        stream = self._fs().open(self._path(f"{self.path}/{MANIFESTS}/{version:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, parts: dict[str, list[str]], version: int | None = None, replace: bool = False) -> int:
        """Make ``parts`` the content of the table. Without a number it is the next one; an existing number is an error unless ``replace`` is set."""
        if version is None:
            version = (self.versions() or [-1])[-1] + 1
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        waiting = self._path(f"{self.path}/{MANIFESTS}/.{uuid.uuid4().hex}.tmp")
        target = self._path(f"{self.path}/{MANIFESTS}/{version:012d}.json")
        stream = self._fs().create(waiting, True)
        try:
            stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        finally:
            stream.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(waiting, target, how)
        except Exception as failure:
            self._fs().delete(waiting, False)
            if self._fs().exists(target):
                raise ConcurrentCommit(f"{self.path}: version {version} is there already") from failure
            raise
        return version

    def drop(self, version: int) -> None:
        """Forget a version."""
        self.remove(f"{MANIFESTS}/{version:012d}.json")

    def remove(self, name: str) -> None:
        self._fs().delete(self._path(f"{self.path}/{name}"), True)

    # rows

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        """Write a folder of its own; its parts."""
        folder = f"_commit=c{uuid.uuid4().hex[:16]}"
        writer = df.write
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{folder}")
        if not self.partition_by:
            return {"": [folder]}
        found = self._names(f"{folder}/" + "/".join(f"{c}=*" for c in self.partition_by))
        return {n[len(folder) + 1 :]: [n] for n in found}

    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """Rows of the newest version, or of another one."""
        folders = [f for part in self.manifest(version).values() for f in part]
        if not folders:
            out = self.spark.createDataFrame([], self.schema)
        else:
            out = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])
            out = out.select(*StructType.fromDDL(self.schema).names)
        return out if where is None else out.where(where)

    def replace(self, df: DataFrame) -> int:
        """The rows of ``df`` become the whole table."""
        return self.commit(self._write(df))

    def replace_parts(self, df: DataFrame) -> int:
        """The partitions that ``df`` has become its rows; the others stay as they are, without being read or written."""
        return self.commit({**self.manifest(), **self._write(df)})

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df``."""
        parts = {k: list(v) for k, v in self.manifest().items()}
        for k, v in self._write(df).items():
            parts[k] = parts.get(k, []) + v
        return self.commit(parts)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` manifests, and the data folders that none of these names; how many folders went.

        No writer may be at work: a folder that is not committed yet looks like one that is not needed.
        """
        versions = self.versions()
        for old in versions[: max(len(versions) - max(keep, 1), 0)]:
            self.drop(old)
        named = {f.rstrip("/") for v in self.versions() for part in self.manifest(v).values() for f in part}
        pattern = "_commit=*" + "".join(f"/{c}=*" for c in self.partition_by)
        unused = [n for n in self._names(pattern) if n not in named]
        for name in unused:
            self.remove(name)
        for folder in self._names("_commit=*"):
            if not any(f == folder or f.startswith(folder + "/") for f in named):
                self.remove(folder)
        return len(unused)
