"""Tables changed by commits, and keyed state in buckets."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import AS_OF, listings
from hearthline.plans import recompute, sweep
from hearthline.schemas import LISTING
from hearthline.sources.bucketed import BucketedState
from hearthline.sources.manifest import CommittedTable, ConcurrentCommit

ROWS = "id bigint, day string, v double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_a_reader_sees_whole_commits_only(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), ROWS)
    assert not table.exists() and table.read().count() == 0
    table.replace(rows(spark, (1, "a", 1.0)))
    broken = rows(spark, (2, "a", 2.0), (3, "a", 3.0)).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.replace(broken)
    assert content(table.read()) == [(1, "a", 1.0)]
    # data written, manifest not: the writer died just before the commit
    table._write(rows(spark, (9, "z", 9.0)))
    assert content(table.read()) == [(1, "a", 1.0)]
    # a table may be rewritten from itself
    table.replace(table.read().withColumn("v", F.col("v") + 1))
    assert content(table.read()) == [(1, "a", 2.0)] and content(table.read(0)) == [(1, "a", 1.0)]
    assert table.vacuum(keep=1) == 3  # the old version and the folders of the two writers that stopped
    assert content(table.read()) == [(1, "a", 2.0)]
    table.append(rows(spark, (5, "b", 5.0)))
    assert content(table.read()) == [(1, "a", 2.0), (5, "b", 5.0)]


def test_only_named_partitions_are_replaced(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), ROWS, ("day",))
    table.replace_parts(rows(spark, (1, "a", 1.0), (2, "b", 2.0)))
    before = table.manifest()
    table.replace_parts(rows(spark, (3, "b", 3.0), (4, "c/d e", 4.0)))
    assert content(table.read()) == [(1, "a", 1.0), (3, "b", 3.0), (4, "c/d e", 4.0)]
    assert table.manifest()["day=a"] == before["day=a"]
    assert [r["id"] for r in table.read(where=F.col("day") == "b").collect()] == [3]
    assert table.vacuum(keep=1) == 1 and content(table.read()) == [(1, "a", 1.0), (3, "b", 3.0), (4, "c/d e", 4.0)]


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), ROWS)
    table.replace(rows(spark, (1, "a", 1.0)))
    with pytest.raises(ConcurrentCommit):
        table.commit({}, version=0)
    assert content(table.read()) == [(1, "a", 1.0)]


def test_a_stopped_recompute_leaves_tables_readable(spark, tables, tmp_path):
    out = str(tmp_path / "out")
    recompute.run_full_recompute(tables.listing, tables.listing_detail, tables.price_history, None, AS_OF, out, 0)
    before = content(recompute.stored_table(spark, out, "listing_anomaly").select("listing_id", "anomaly_score"))
    bad = tables.listing_detail.withColumn("floor_number", F.when(F.rand() >= 0, F.raise_error(F.lit("stop")).cast("int")))
    run = recompute.run_full_recompute(tables.listing, bad, tables.price_history, None, AS_OF + timedelta(days=1), out, 1)
    assert run.first()["status"] == "failed"
    assert content(recompute.stored_table(spark, out, "listing_anomaly").select("listing_id", "anomaly_score")) == before
    with pytest.raises(Exception, match="stop"):
        recompute.run_full_recompute(tables.listing, bad, tables.price_history, None, AS_OF + timedelta(days=1), out, 1, raise_failure=True)


def test_a_sweep_shuffles_its_batch_only(spark, tmp_path):
    state = BucketedState(spark, str(tmp_path / "s"), LISTING, "hash_id", buckets=8)
    state.write(listings(spark, [dict(id=k, hash_id=str(k)) for k in range(1, 200)]))
    batch = listings(spark, [dict(id=k, hash_id=str(k), price_czk=5) for k in range(150, 260)])
    joined = sweep.classify_sweep(state.read(), batch)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(b_hash_id") > 0
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    assert joined.where("change = 'new'").count() == 60 and joined.where("change = 'unseen'").count() == 149


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    schema = "key bigint, price double"
    state = BucketedState(spark, str(tmp_path / "t"), schema, "key", buckets=8)
    everything = spark.range(40).selectExpr("id AS key", "1.0D AS price")
    state.write(everything, 0)
    first = state.commits.manifest()
    wanted = state.touched(everything.where("key = 7"), "key")
    assert len(wanted) == 1
    part = state.read(before=1, buckets=wanted)
    assert {f.split("_bucket=")[1].split("/")[0] for f in part.inputFiles()} == {str(wanted[0])}
    for _ in range(2):  # a batch that is run again writes the same again
        state.write(part.selectExpr("key", "if(key = 7, 2.0D, price) AS price"), 1)
    second = state.commits.manifest()
    assert [b for b in first if first[b] != second[b]] == [str(wanted[0])]
    expected = {k: 2.0 if k == 7 else 1.0 for k in range(40)}
    assert {r["key"]: r["price"] for r in state.read().collect()} == expected
    assert {r["price"] for r in state.read(before=1).collect()} == {1.0}
    assert state.vacuum(keep=1) == 2 and {r["key"]: r["price"] for r in state.read().collect()} == expected
    # another session finds the table by its folder
    other = BucketedState(spark.newSession(), state.path, schema, "key", buckets=8)
    spark.sql(f"DROP TABLE {state.name}")
    assert {r["key"]: r["price"] for r in other.read().collect()} == expected
