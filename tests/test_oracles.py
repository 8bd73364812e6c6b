import os

import pytest

import __spark_entry__ as entry
from compare import connect, differences
from conftest import SF

ORACLES = entry.oracle_sql()
# All twins take some minutes; the default is one query per operator family.
SAMPLE = [
    "price_drops", "filter_price_drop", "text_search", "page_price_desc", "raw_listing_row", "listing_documents", "valuation_export", "location_suggest",
    "segment_all_dimensions", "dataset_counts", "region_resolution_stats", "latest_by_segment", "market_dynamics_snapshot", "grid_coarse_4", "heatmap_cached",
    "score_anomalies", "comparables", "valuation_area_only", "timeseries", "reconciliation_summary", "kpi_table_final", "invariant_violations", "parse_list", "parse_detail",
    "apply_sweep", "union_slices", "resolve_region", "harvest_links", "export_csv", "snapshot_table_rewrite", "full_recompute", "stream_daily_statistics",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("ALL_ORACLES") else SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLES[name]) == []


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["price_drops", "listing_read", "segment_all_dimensions", "market_dynamics_snapshot", "grid_metrics", "near_duplicates", "score_anomalies", "comparables", "resolve_region", "timeseries", "apply_sweep"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_reach_the_scan(spark, tmp_path):
    from hearthline.operators.listings import map_markers
    from hearthline.sources.tables import scan_table, write_table
    from hearthline.sources.adapter import DerivedListings

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    write_table(DerivedListings(spark, SF).listing, str(tmp_path), "listing")
    plan = map_markers(scan_table(spark, str(tmp_path), "listing"), south=49.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(gps_lat,49.0)" in plan and "locality_text" not in plan.split("ReadSchema")[1]
