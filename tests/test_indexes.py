"""Trigram index, clustered layout, positions."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hearthline.operators.listings import joined_listings, numbered, text_search, without_first
from hearthline.operators.suggest import location_suggest
from hearthline.operators.textindex import COLUMNS, PlaceIndex, TrigramIndex, folded, search_listings, trigrams
from hearthline.sources.layout import clustered


@pytest.fixture(scope="module")
def joined(tables):
    return joined_listings(tables.listing, tables.listing_detail, tables.location).cache()


@pytest.fixture(scope="module")
def index(spark, joined, tmp_path_factory):
    index = TrigramIndex(spark, str(tmp_path_factory.mktemp("trigrams")))
    index.build(joined, "id", COLUMNS)
    return index


@pytest.mark.parametrize("text", [" čtvrť 3 ", "KRAJ VYSO", "nation_1", "obec 12", "ctvrt 3", "xyzzy", "ab", "%", "", "_1", "Čtvrť"])
def test_indexed_search_equals_the_scan(joined, index, text):
    want = {r["id"] for r in joined.where(text_search(text)).select("id").collect()}
    assert {r["id"] for r in search_listings(index, joined, text).select("id").collect()} == want


def test_search_reads_few_rows_of_the_index(joined, index):
    everything = index.table.read().count()
    found = index.postings("čtvrť 3")
    assert 0 < found.count() < everything / 3
    buckets = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(buckets) <= 32
    assert found.where(~F.col("trigram").isin(["ctv", "tvr", "vrt", "rt ", "t 3"])).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [In(trigram" in plan


def test_texts_are_indexed_once(spark, joined, index):
    """A place name of many rows has its trigrams once, and no text is folded inside the function that cuts it."""
    texts = joined.select(F.explode(F.array_compact(F.array(*COLUMNS))).alias("t")).distinct()
    assert index.table.read().count() == texts.select(F.explode(trigrams(folded(F.col("t"))))).count()
    assert index.rows.read().select("key").distinct().count() == joined.count()
    plan = spark.createDataFrame([("a",)], "t string").select(trigrams(folded(F.col("t"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_suggestions_from_the_index(spark, tables, tmp_path):
    places = PlaceIndex(spark, str(tmp_path))
    places.build(tables.listing, tables.location)
    for text in ("obec 1", "er", " Kraj", "x", "zzzz", "čtvrť"):
        assert places.suggest(text).collect() == location_suggest(tables.listing, tables.location, text).collect()


def groups_met(path, box):
    """Row groups, and how many of them a filter on ranges cannot skip by their least and largest values."""
    met = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            stats = {c: meta.row_group(g).column(at[c]).statistics for c in box}
            total += 1
            met += all(s.has_min_max and s.min <= high and s.max >= low for (low, high), s in ((box[c], stats[c]) for c in box))
    return total, met


def test_clustered_rows_are_skipped_by_windows_and_ranges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, rng.uniform(48.6, 51) if k % 3 else 50.08, rng.uniform(12.1, 18.8) if k % 3 else 14.42, rng.randrange(10**6, 10**7)) for k in range(6000)] + [(9000 + k, None, None, None) for k in range(60)]
    df = spark.createDataFrame(rows, "id bigint, gps_lat double, gps_lon double, price_czk bigint")
    df.repartition(32).write.parquet(str(tmp_path / "plain"))
    clustered(df, ["gps_lat", "gps_lon", "price_czk"], 32).write.parquet(str(tmp_path / "z"))
    back = spark.read.parquet(str(tmp_path / "z"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    sizes = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 4 * len(rows) / 32  # a place with a third of all rows is in many files
    for box in ({"gps_lat": (49.0, 49.4), "gps_lon": (13.0, 14.0)}, {"price_czk": (2_000_000, 2_400_000)}, {"gps_lat": (50.0, 50.3), "price_czk": (9_000_000, 10_000_000)}):
        assert groups_met(tmp_path / "plain", box)[1] == 32
        assert groups_met(tmp_path / "z", box)[1] <= 16


def test_positions(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(k, rng.choice([1.0, 2.0, None])) for k in range(500)], "id bigint, v double").repartition(7)
    ordered = df.orderBy(F.col("v").asc_nulls_last(), "id")
    want = [r["id"] for r in ordered.collect()]
    assert [r["id"] for r in numbered(ordered).orderBy("position").collect()] == want
    assert sorted(r["position"] for r in numbered(ordered).collect()) == list(range(500))
    for skip in (0, 1, 123, 499, 500, 900):
        assert [r["id"] for r in without_first(ordered, skip).collect()] == want[skip:]
