"""Images and price records of listings in their order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

import catalog.listings  # noqa: F401
from catalog.registry import QUERIES
from conftest import SF
from hearthline.operators import listings as ops


@pytest.mark.parametrize("most", [50, 100_000])
def test_places_of_records_in_large_and_small_listings(spark, monkeypatch, most):
    """A listing with most of the records goes by days, the others are sorted whole; records without a time come last."""
    monkeypatch.setattr(ops, "MOST_TOGETHER", most)
    rng, start = random.Random(2), datetime(2020, 1, 1)
    at = lambda: None if rng.random() < 0.05 else start + timedelta(hours=rng.randrange(500))
    rows = [(k, 7 if k % 3 else 100 + k % 40, at()) for k in range(900)]
    df = spark.createDataFrame(rows, "id bigint, listing_id bigint, recorded_at timestamp_ntz").repartition(5)
    assert [r._bin for r in ops.crowded_bins(df).collect()] == ([df.where("listing_id = 7").select(ops.listing_bin()).first()[0]] if most == 50 else [])
    order = [F.col("recorded_at").asc_nulls_last(), "id"]
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("listing_id").orderBy(*order)).cast("bigint") - 1)
    found = ops.positions(df, F.to_date("recorded_at"), ["recorded_at", "id"])
    assert found.columns == want.columns and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_items_are_sorted_once(spark):
    """No hash table or second sort of the rows of each listing and day stands in the plan that ran."""
    items = QUERIES["listing_document_items"](spark, SF)
    items.collect()
    plan = items._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "HashAggregate(keys=[listing_id" not in plan and "HashAggregate(keys=[l_orderkey" not in plan
