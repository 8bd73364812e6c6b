"""A keyed table in buckets that Spark knows, so that a join on the key moves only the other side.

Every bucket is a partition folder of its own and holds one set of files per
commit; a manifest names the commit that counts for each bucket. A commit writes
the buckets it touches and no others.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hearthline.sources.manifest import CommittedTable

#: Commit numbers per version: a version may be followed by steps of its own.
STEPS = 16


class BucketedState:
    """A table of rows with a unique ``key``. Rows are replaced bucket by bucket and never deleted, so a bucket that was written is never empty.

    The table is registered in the session's catalog over its folder and can be registered again by any session.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self.commits = CommittedTable(spark, path, schema)
        self.name = f"state_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"

    def _register(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(self.schema).fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, _bucket INT, _commit STRING) USING parquet PARTITIONED BY (_bucket, _commit) "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        if self.commits.exists():
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def bucket_of(self, key: Column | str) -> Column:
        """The bucket that Spark puts a key into."""
        return F.pmod(F.hash(key), F.lit(self.buckets))

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets of the given keys; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of(key)).distinct().collect())

    def _newest(self, before: int | None) -> dict[str, list[str]]:
        found = [v for v in self.commits.versions() if before is None or v < before * STEPS]
        return self.commits.manifest(found[-1]) if found else {}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of the newest version (below ``before``)."""
        by_commit: dict[str, list[int]] = {}
        for bucket, (commit,) in self._newest(before).items():
            if buckets is None or int(bucket) in buckets:
                by_commit.setdefault(commit, []).append(int(bucket))
        if not by_commit:
            return self.spark.createDataFrame([], self.schema)
        self._register()
        wanted = F.lit(False)
        for commit, members in sorted(by_commit.items()):
            wanted = wanted | ((F.col("_commit") == commit) & F.col("_bucket").isin(members))
        return self.spark.table(self.name).where(wanted).select(*StructType.fromDDL(self.schema).names)

    def write(self, rows: DataFrame, version: int | None = None, step: int = 0) -> None:
        """``rows`` are the whole content of the buckets they fall into. A version that is written again replaces what it wrote before."""
        self._register()
        commit = uuid.uuid4().hex[:16]
        before = self._newest(version)
        if version is not None and step:
            before = self.commits.manifest()
        out = rows.select(*StructType.fromDDL(self.schema).names, self.bucket_of(self.key).alias("_bucket"), F.lit(commit).alias("_commit"))
        out.write.format("parquet").mode("append").partitionBy("_bucket", "_commit").bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        written = self.commits._names(f"rows/_bucket=*/_commit={commit}")
        parts = {**before, **{n.split("/")[1][len("_bucket=") :]: [commit] for n in written}}
        if version is None:
            number = ((self.commits.versions() or [-1])[-1] // STEPS + 1) * STEPS
            self.commits.commit(parts, number)
            return
        self.commits.commit(parts, version * STEPS + step, replace=True)
        for late in [v for v in self.commits.versions() if version * STEPS + step < v < (version + 1) * STEPS]:
            self.commits.drop(late)  # steps that followed an earlier attempt of this version

    def vacuum(self, keep: int = 2) -> int:
        """Forget all but the newest ``keep`` commits and delete the files that only the others need; how many folders went. No writer may be at work."""
        versions = self.commits.versions()
        for old in versions[: max(len(versions) - max(keep, 1), 0)]:
            self.commits.drop(old)
        named = {f"rows/_bucket={b}/_commit={c}" for v in self.commits.versions() for b, (c,) in self.commits.manifest(v).items()}
        unused = [n for n in self.commits._names("rows/_bucket=*/_commit=*") if n not in named]
        self._register()
        for name in unused:
            bucket, commit = (x.split("=")[1] for x in name.split("/")[1:])
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (_bucket={bucket}, _commit='{commit}')")
            self.commits.remove(name)
        return len(unused)
