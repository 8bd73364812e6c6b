from datetime import datetime, timedelta

from pyspark.sql import Window, functions as F

from hearthline.streaming import jobs, stateful

T0 = datetime(2024, 1, 1)
SEEN = "key bigint, at timestamp_ntz"
PRICES = "key bigint, price double, at timestamp_ntz"


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(spark, make, schema, root):
    """All files landed so far that the checkpoint does not know, one in a batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.run_to_table(make(source), f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def test_price_changes_over_several_batches_and_restarts(spark, tmp_path):
    """Every batch is a new start of the query from its checkpoint; late and repeated prices are ignored."""
    batches = [[(1, 10.0, T0), (1, 12.0, T0 + timedelta(hours=5)), (2, 5.0, T0), (None, 1.0, T0), (3, None, T0)],
               [(1, 12.0, T0 + timedelta(hours=6)), (1, 9.0, T0 + timedelta(hours=8)), (1, 99.0, T0 + timedelta(hours=1)), (2, 7.0, T0)],
               [(2, 5.5, T0 + timedelta(days=2)), (3, 1.0, T0)],
               [(1, 9.0, T0 + timedelta(days=3)), (3, 1.0, T0 + timedelta(days=1)), (3, 2.0, T0 + timedelta(days=1))]]
    for rows in batches:
        land(spark, rows, PRICES, f"{tmp_path}/in")
        out = run(spark, stateful.price_changes, PRICES, str(tmp_path))
    got = sorted((r["key"], r["old_price"], r["new_price"], r["at"]) for r in out.collect())
    assert got == [(1, 10.0, 12.0, T0 + timedelta(hours=5)), (1, 12.0, 9.0, T0 + timedelta(hours=8)), (2, 5.0, 5.5, T0 + timedelta(days=2)), (3, 1.0, 2.0, T0 + timedelta(days=1))]
    assert spark.conf.get(stateful.STORE) == stateful.ROCKSDB


def test_price_state_has_one_row_per_key(spark, tables, tmp_path):
    events = tables.raw("events").select(F.col("user_id").alias("key"), F.col("value").alias("price"), F.col("ts").alias("at"))
    cuts = events.select(F.unix_micros(F.col("at").cast("timestamp")).alias("t")).approxQuantile("t", [0.2, 0.4, 0.6, 0.8], 0.001)
    edges = [F.timestamp_micros(F.lit(int(c))).cast("timestamp_ntz") for c in cuts]
    for low, high in zip([None, *edges], [*edges, None]):  # landed in order of time
        part = events if low is None else events.where(F.col("at") >= low)
        (part if high is None else part.where(F.col("at") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = run(spark, stateful.price_changes, events.schema, str(tmp_path))
    order = Window.partitionBy("key").orderBy("at", "price")
    steps = events.withColumn("old", F.lag("price").over(order)).where("old <> price")
    assert out.select("key", "old_price", "new_price", "at").exceptAll(steps.select("key", "old", "price", "at")).count() == 0 and out.count() == steps.count()
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/check")
    assert state.count() == events.select("key").distinct().count()


def test_presence_by_timers(spark, tmp_path):
    """A key is removed once after its silence, comes back, and is removed again; the query is started anew for each file."""
    h = lambda k: T0 + timedelta(hours=k)
    files = [[(1, h(0)), (2, h(0)), (1, h(3))], [(2, h(5)), (3, h(9))], [(1, h(14)), (3, h(15))], [(3, h(40))], [(4, h(41))]]
    for rows in files:
        land(spark, rows, SEEN, f"{tmp_path}/in")
        out = run(spark, lambda s: stateful.presence_events(s, 10), SEEN, str(tmp_path))
    got = sorted((r["key"], r["event"], r["sightings"], r["first_seen_at"], r["last_seen_at"], r["at"]) for r in out.collect())
    assert got == [
        (1, "removed", 1, h(14), h(14), h(24)), (1, "removed", 2, h(0), h(3), h(13)), (1, "returned", 1, h(14), h(14), h(14)), (2, "removed", 2, h(0), h(5), h(15)),
        (3, "removed", 2, h(9), h(15), h(25)), (3, "returned", 1, h(40), h(40), h(40)),
    ]
    state = spark.read.format("statestore").option("stateVarName", "stay").load(f"{tmp_path}/check")
    assert state.count() == 4  # keys, not sightings


def test_streamed_sessions_equal_batch_sessions(spark, tables, tmp_path):
    events = tables.raw("events")
    path = str(tmp_path / "in")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    pick = lambda df: df.select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    stream = jobs.presence_sessions(pick(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(path)), "30 hours")
    jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = set(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    whole = set(map(tuple, jobs.presence_sessions(pick(events), "30 hours").collect()))
    newest = events.agg(F.max("ts")).head()[0]
    assert got == {s for s in whole if s[4] <= newest.replace(microsecond=newest.microsecond // 1000 * 1000)}
