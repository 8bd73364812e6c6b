"""Structured Streaming jobs over the same transforms as the batch operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hearthline.functions.exprs import ts
from hearthline.plans.sweep import MARKS, SweepEvidence, apply_sweep, as_table, finish_sweep, first_per_hash, mark_items, reject_rows, repriced_since, run_status
from hearthline.schemas import SCRAPING_RUN
from hearthline.session import compiled, cut_lineage, growing
from hearthline.sources.bucketed import BucketedState
from hearthline.sources.payloads import parse_list

DONE = "_SUCCESS"
UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Zulu", "Z", "+00:00")


class VersionedTable:
    """A table to which each micro-batch adds a version, a folder of its own.

    The version number is the batch id, so a batch that is run again writes
    the same version again. ``compact`` puts old versions together.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, version: int, kind: str = "v") -> str:
        return f"{self.path}/{kind}={version:012d}"

    def _fs(self):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        found = self._fs().globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}=*/{DONE}")) or []
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found)

    def versions(self) -> list[int]:
        """Finished versions that are not put together yet, oldest first."""
        base = self._finished("c")
        return [v for v in self._finished("v") if not base or v > base[-1]]

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(version))

    def extend(self, df: DataFrame, version: int) -> None:
        """More rows for a finished version."""
        df.write.mode("append").parquet(self._folder(version))

    def all_versions(self, before: int | None = None) -> DataFrame:
        """All rows, or those of the versions below ``before``."""
        folders = [self._folder(c, "c") for c in self._finished("c")[-1:]] + [self._folder(v) for v in self.versions() if before is None or v < before]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def compact(self) -> int:
        """Put all versions but the newest (its batch may run again) into one folder and delete them; how many there were. Readers see the old
        folders until the new one is finished. Runs while the stream is stopped."""
        old = self.versions()[:-1]
        if not old:
            return 0
        self.all_versions(before=old[-1] + 1).coalesce(self.spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(self._folder(old[-1], "c"))
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for kind in ("c", "v"):
            for v in self._finished(kind):
                if v < old[-1] or (kind == "v" and v == old[-1]):
                    self._fs().delete(path(self._folder(v, kind)), True)
        return len(old)


def read_payload_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Landed payload files, one JSON document per line, below folders ``sweep=<id>``.

    ``line_at`` (file, start of the read block, number in it) orders the documents of a sweep by arrival, files by name.
    """
    file = F.col("_metadata.file_path")
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(path)
        .select(
            F.col("value").alias("payload"), F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
            F.regexp_extract(file, r"sweep=([^/]+)/", 1).try_cast("bigint").alias("sweep"),
            F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_at"),
        )
    )


SWEEP_PART = """
    run_id bigint, swept_at timestamp_ntz, payloads bigint, items_seen bigint, items_new bigint, items_updated bigint, items_removed bigint,
    error_count bigint, failed_pages bigint, finished boolean
"""
#: What is said about a sweep once all its pages are landed.
SWEEP_END = "sweep bigint, payloads bigint, full_sweep boolean, failed_pages int, gap_pct double"


def ingest_sweeps(
    payloads: DataFrame, state: BucketedState, history: VersionedTable, rejects: VersionedTable, parts: VersionedTable, checkpoint: str, order: list[str],
    ends=None, new_id=None,
) -> StreamingQuery:
    """Sweeps that land in any number of files.

    ``payloads`` has (payload, sweep, swept_at, the columns of ``order``); ``swept_at`` is one
    time for all payloads of a sweep. A listing counts once for each sweep, as it came first. Nothing is removed
    until ``ends()`` (a table like ``SWEEP_END``, read with each batch) declares a sweep, and as many
    payloads as it says have been applied; then the evidence decides. A sweep that is declared after its last file is ended by
    ``close_sweeps``. ``parts`` gets the counters of each batch and sweep; see ``sweep_runs``.
    """
    extra = {} if new_id is None else {"new_id": new_id}

    def one(batch: DataFrame, batch_id: int) -> None:
        # a landed file may be one task; its payloads are parsed by all of them, the bad ones too, once for all that follows
        marked = mark_items(batch.repartition(batch.sparkSession.sparkContext.defaultParallelism))
        parsed = parse_list(marked, keep=tuple(dict.fromkeys(("sweep", "swept_at", *order, *MARKS)))).persist()
        try:
            # one row for each sweep in the batch
            sweeps = parsed.groupBy("sweep").agg(F.min("swept_at").alias("at"), F.count("*").alias("n"), F.count_if(~F.col("_ok")).alias("wrong")).orderBy("at").collect()
            if not sweeps:
                return
            spark = batch.sparkSession
            items, bad = parsed.where("_ok").drop(*MARKS), reject_rows(parsed, batch_id)
            buckets = state.touched(items, "hash_id")
            current = state.read(before=batch_id, buckets=buckets)
            earlier = parts.all_versions(before=batch_id)
            so_far = {r.run_id: r for r in earlier.groupBy("run_id").agg(F.sum("payloads").alias("payloads"), F.max("finished").alias("finished"), F.min("swept_at").alias("swept_at")).collect()}
            histories, rows, applied = [], [], {r: v.payloads for r, v in so_far.items()}
            at = {r: v.swept_at for r, v in so_far.items()}
            for k, (sweep, now, n, wrong) in enumerate(sweeps):
                fresh = items.where(F.col("sweep").eqNullSafe(F.lit(sweep)))
                seen = current.where(F.col("last_seen_at") >= ts(now)).select("hash_id")
                fresh = first_per_hash(fresh.join(growing(seen), "hash_id", "left_anti"), order)
                counted = Observation()
                result = apply_sweep(current, fresh, now, None, bad.where(F.lit(False)), counted=counted, **extra)
                if k < len(sweeps) - 1:
                    after = cut_lineage(result.listing, "sweep-state")
                else:  # written where it belongs, at once
                    state.write(result.listing, batch_id)
                    after = state.read(before=batch_id + 1, buckets=buckets)
                histories.append(repriced_since(current, after, ts(now)))
                current, counts = after, Row(**counted.get)
                rows.append((sweep, now, n, counts.items_seen, counts.items_new, counts.items_updated, 0, wrong, 0, False))
                applied[sweep], at[sweep] = applied.get(sweep, 0) + n, now
            done, whole = [r for r, v in so_far.items() if v.finished], None
            for end in due([] if ends is None else ends().collect(), applied, done):
                after, row = ended(state.read(before=batch_id + 1) if whole is None else whole, at[end.sweep], end)
                rows.append(row)
                if after is not None:
                    whole = cut_lineage(after, "sweep-state") if whole is not None else after
            history.write(reduce(DataFrame.unionByName, histories).select(*StructType.fromDDL(history.schema).names), batch_id)
            rejects.write(bad, batch_id)
            if whole is not None:
                state.write(whole, batch_id, step=1)
            parts.write(spark.createDataFrame(rows, SWEEP_PART), batch_id)
        finally:
            parsed.unpersist()

    def each(batch: DataFrame, batch_id: int) -> None:
        # the projections of parsing and of the next state are large ones
        with compiled(batch.sparkSession):
            one(batch, batch_id)

    return payloads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due(ends: list, applied: dict, done) -> list:
    """Declared sweeps that are not ended yet and whose payloads have all been applied."""
    return [e for e in ends if e.sweep in applied and applied[e.sweep] >= e.payloads and e.sweep not in done]


def ended(state: DataFrame, swept_at, end) -> tuple[DataFrame | None, tuple]:
    """The state after a declared sweep (None if it stays as it is) and the row that says so."""
    evidence, after, removed = SweepEvidence(end.full_sweep, end.failed_pages, end.gap_pct), None, 0
    if evidence.allows_delisting():
        after = finish_sweep(state, swept_at, evidence)
        removed = state.where("is_active").count() - after.where("is_active").count()
    return after, (end.sweep, swept_at, 0, 0, 0, 0, removed, 0, end.failed_pages, True)


def close_sweeps(state: BucketedState, parts: VersionedTable, ends: DataFrame) -> int:
    """End the sweeps that were declared after their last file had been applied; how many.

    Runs while the stream is stopped. The state is committed before the row that
    says so: if a run stops between the two, the next one removes nothing more and writes the row.
    """
    versions = parts.versions()
    if not versions:
        return 0
    rows = parts.all_versions().groupBy("run_id").agg(F.sum("payloads").alias("payloads"), F.max("finished").alias("finished"), F.min("swept_at").alias("swept_at")).collect()
    at, applied, done = {r.run_id: r.swept_at for r in rows}, {r.run_id: r.payloads for r in rows}, [r.run_id for r in rows if r.finished]
    found, before, now = [], state.read(), None
    for end in sorted(due(ends.collect(), applied, done), key=lambda e: at[e.sweep]):
        after, row = ended(now if now is not None else before, at[end.sweep], end)
        now = now if after is None else cut_lineage(after, "sweep-state")
        found.append(row)
    if now is not None:
        state.write(now, versions[-1], step=1)
    if found:
        # beside the rows of the last batch, in a version of its own that the next batch does not touch
        parts.extend(state.spark.createDataFrame(found, SWEEP_PART), versions[-1])
    return len(found)


def sweep_runs(parts: DataFrame) -> DataFrame:
    """Rows of the run table from the counters of the batches: a sweep runs until its end is declared and applied."""
    sums = [F.sum(c).alias(c) for c in ("items_seen", "items_new", "items_updated", "items_removed", "error_count")]
    found = parts.groupBy(F.col("run_id").alias("id")).agg(*sums, F.sum("payloads").alias("pages_fetched"), F.max("failed_pages").alias("failed"), F.max("finished").alias("done"), F.min("swept_at").alias("started_at"))
    status = F.when(~F.col("done"), "running").when(F.col("failed") > 0, "partial").otherwise(run_status(F.col("items_seen"), F.col("error_count")))
    return as_table(
        found.withColumn("status", status).withColumn("run_type", F.lit("incremental")).withColumn("category", F.lit("all")).withColumn("finished_at", F.when(F.col("done"), F.col("started_at")))
        .withColumn("error_message", F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" pages failed")))),
        SCRAPING_RUN,
    )


def event_time(df: DataFrame, delay: str) -> DataFrame:
    """``df`` with a watermark on ``at``.

    Watermarks need a zoned timestamp. The zone-less time is read as UTC, so
    the session has to run in UTC for windows to start at midnight.
    """
    if df.sparkSession.conf.get("spark.sql.session.timeZone") not in UTC_NAMES:
        raise ValueError("event-time jobs need spark.sql.session.timeZone=UTC")
    return df.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)


def _plain(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def daily_statistics(observations: DataFrame, segment: Column | str, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Count and price statistics per segment and day.

    ``observations`` carries ``at`` (timestamp) and ``price``; on a stream the
    rows of a window appear once the watermark has passed it.
    """
    seg = F.col(segment) if isinstance(segment, str) else segment
    return (
        event_time(observations, delay)
        .groupBy(F.window("at", width).alias("w"), seg.alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("observations"), F.count_if("is_new").alias("new_count"), F.count_if("is_removed").alias("removed_count"),
            F.avg("price").alias("avg_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        )
        .select(_plain("w.start").alias("window_start"), "segment", "observations", "new_count", "removed_count", "avg_price", "min_price", "max_price")
    )


def presence_sessions(sightings: DataFrame, silence: str, delay: str = "0 seconds") -> DataFrame:
    """Removals by silence: a key not seen for ``silence`` after its last sighting.

    A session of sightings closes when the gap has passed, which on a stream
    is the moment the watermark passes ``removed_at``.
    """
    return (
        event_time(sightings, delay)
        .groupBy("key", F.session_window("at", silence).alias("s"))
        .agg(F.count(F.lit(1)).alias("sightings"), F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))
        .select(
            "key", "sightings", _plain("first_seen_at").alias("first_seen_at"), _plain("last_seen_at").alias("last_seen_at"),
            _plain("s.end").alias("removed_at"),
        )
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append a stream's rows to a Parquet folder until its input is used up."""
    return (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


