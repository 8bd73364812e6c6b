"""Aggregates, market, spatial, anomaly, comparables, valuation, series, quality, KPI."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.listings import FEATURES_SQL, label_sql
from catalog.registry import query
from catalog.views import AS_OF as NOW, case_of, with_views
from hearthline.functions import codebooks as cb
from hearthline.functions.geo import haversine_km
from hearthline.functions.quantiles import exact_quantile
from hearthline.operators import aggregates as agg
from hearthline.operators import anomaly, comparables as comp, fitstate, kpi, market, quality, spatial, timeseries as series, valuation as val
from hearthline.operators.history import history_features
from hearthline.session import cut_lineage
from hearthline.sources.adapter import AS_OF

_D = "LEFT JOIN listing_detail d ON d.listing_id = l.id"
_FEATURES = FEATURES_SQL.strip()
U = cb.UNKNOWN_LABEL


def _loc_sql(extra: str = "") -> str:
    return f"""
SELECT coalesce(l.resolved_region_name, '{U}') AS region, o.district, o.municipality,
  round(nullif(avg(l.price_czk), 0), 6) AS avg_price_czk,
  round(nullif(avg(l.price_czk / nullif(d.usable_area, 0)::DOUBLE), 0), 6) AS avg_price_per_m2, count(*) AS listing_count
FROM listing l {_D} LEFT JOIN location o ON o.id = l.location_id WHERE l.is_active {extra} GROUP BY 1, 2, 3"""


@query("price_per_m2_by_location", with_views(_loc_sql()))
def _(t):
    return agg.price_per_m2_by_location(t.listing, t.listing_detail, t.location)


@query("price_per_m2_by_location_main", with_views(_loc_sql("AND l.category_main_cb = 2")))
def _(t):
    return agg.price_per_m2_by_location(t.listing, t.listing_detail, t.location, 2)


_INVENTORY = f"inventory AS (SELECT coalesce(resolved_region_name, '{U}') AS region, count(*) AS listing_count FROM listing WHERE is_active GROUP BY 1)"


@query("inventory_by_region", with_views("SELECT * FROM inventory", _INVENTORY))
def _(t):
    return agg.inventory_by_region(t.listing)


def _coded(book, column):
    return (f"coalesce({column}, 'unknown')",
            f"CASE WHEN coalesce({column}, '') IN ('', 'unknown') THEN '{U}' ELSE {label_sql(book, column)} END")


_DIMS = {
    "category_main_cb": ("category_main_cb", f"coalesce({case_of(cb.PROPERTY_TYPES, 'category_main_cb')}, CAST(category_main_cb AS VARCHAR))"),
    "category_type_cb": ("category_type_cb", f"coalesce({case_of(cb.DEAL_TYPES, 'category_type_cb')}, CAST(category_type_cb AS VARCHAR))"),
    "category_sub_cb": ("coalesce(category_sub_cb, -1)", f"coalesce({case_of(cb.ROOM_LAYOUTS, 'category_sub_cb')}, '{U}')"),
    "building_condition": _coded(cb.BUILDING_CONDITION, "building_condition"),
    "ownership": _coded(cb.OWNERSHIP, "ownership"),
    "energy_efficiency_rating": _coded(cb.ENERGY_RATING, "energy_efficiency_rating"),
    "region": (f"coalesce(resolved_region_name, '{U}')", f"coalesce(resolved_region_name, '{U}')"),
}


def _segment_sql(name: str, where: str = "") -> str:
    value, label = _DIMS[name]
    return f"""SELECT CAST({value} AS VARCHAR) AS value, {label} AS label, count(*) AS listing_count,
    round(nullif(avg(l.price_czk), 0), 6) AS avg_price_czk,
    round(nullif(avg(l.price_czk / nullif(d.usable_area, 0)::DOUBLE), 0), 6) AS avg_price_per_m2
    FROM listing l {_D} WHERE l.is_active {where} GROUP BY 1, 2"""


for _name in _DIMS:
    query(f"segment_{_name}", with_views(_segment_sql(_name)))(lambda t, n=_name: agg.segment_breakdown(t.listing, t.listing_detail, n))


@query("segment_ownership_main", with_views(_segment_sql("ownership", "AND l.category_main_cb = 1")))
def _(t):
    return agg.segment_breakdown(t.listing, t.listing_detail, "ownership", 1)


@query("segment_all_dimensions", with_views(" UNION ALL ".join(f"SELECT '{n}' AS dimension, * FROM ({_segment_sql(n)})" for n in _DIMS)))
def _(t):
    return agg.segment_breakdowns(t.listing, t.listing_detail)


_COUNTS = """
counts AS (SELECT count(*) FILTER (is_active) AS active_listing_count, count(*) AS total_listing_count,
  count(*) FILTER (is_active AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS active_with_gps_count,
  count(*) FILTER (is_active AND resolved_region_name IS NOT NULL) AS active_with_region_count,
  count(*) FILTER (is_active AND region_source IS NULL) AS unset_region_source_count FROM listing),
active_ids AS (SELECT id FROM listing WHERE is_active)"""
_COUNTS_SELECT = """
SELECT *, (SELECT count(*) FROM listing_detail WHERE listing_id IN (SELECT id FROM active_ids)) AS active_with_detail_count,
  (SELECT count(*) FROM listing_valuation WHERE listing_id IN (SELECT id FROM active_ids)) AS active_with_valuation_count,
  (SELECT count(*) FROM listing_anomaly WHERE listing_id IN (SELECT id FROM active_ids)) AS active_with_anomaly_count,
  active_listing_count - active_with_gps_count AS active_without_gps_count,
  active_listing_count - active_with_region_count AS active_without_region_count,
  active_listing_count AS inventory_region_listing_sum, unset_region_source_count > 0 AS needs_region_backfill FROM counts"""


@query("dataset_counts", with_views(_COUNTS_SELECT, _COUNTS.strip()))
def _(t):
    return agg.dataset_counts(t.listing, t.listing_detail, t.listing_valuation, t.listing_anomaly)


@query("new_vs_removed", with_views(
    f"""SELECT count(*) FILTER (first_seen_at >= {NOW} - INTERVAL 400 DAY) AS new_count,
    count(*) FILTER (removed_at >= {NOW} - INTERVAL 400 DAY) AS removed_count, 400 AS period_days FROM listing"""))
def _(t):
    return agg.new_vs_removed(t.listing, AS_OF, 400)


_VSUM = """SELECT coalesce(classification, 'unclassified') AS classification, count(*) AS listing_count,
  CAST(sum(count(*)) OVER () AS BIGINT) AS total_valued_listings
  FROM listing_valuation WHERE listing_id IN (SELECT id FROM listing WHERE is_active) GROUP BY 1"""


@query("valuation_summary", with_views(_VSUM))
def _(t):
    return agg.valuation_summary(t.listing, t.listing_valuation)


@query("anomaly_summary", with_views(
    """SELECT metric, count(*) AS listing_count FROM (
    SELECT 'total_scored_listings' AS metric FROM scored UNION ALL SELECT 'matching_min_score' FROM scored WHERE anomaly_score >= 30
    UNION ALL SELECT 'flag:' || unnest(anomaly_flags) FROM scored WHERE anomaly_score >= 30) GROUP BY 1""",
    "scored AS (SELECT * FROM listing_anomaly WHERE listing_id IN (SELECT id FROM listing WHERE is_active))"))
def _(t):
    return agg.anomaly_summary(t.listing, t.listing_anomaly, 30)


_SLICES = """slices AS (SELECT category_main_cb, category_type_cb, count(*) FILTER (is_active) AS active_count, count(*) AS total_count FROM listing GROUP BY 1, 2)"""


@query("category_slices", with_views("SELECT * FROM slices", _SLICES))
def _(t):
    return agg.category_slices(t.listing)


@query("active_slice_count", with_views("SELECT count(*) FILTER (active_count > 0) AS active_category_slice_count FROM slices", _SLICES))
def _(t):
    return agg.active_slice_count(t.listing)


@query("duplicate_keys", with_views(
    "SELECT count(*) AS duplicate_hash_ids FROM (SELECT listing_id FROM price_history GROUP BY 1 HAVING count(*) > 1)"))
def _(t):
    return agg.duplicate_keys(t.price_history.select(F.col("listing_id").cast("string").alias("hash_id")))


_UPDATE = """SELECT greatest((SELECT max(last_seen_at) FROM listing), (SELECT max(updated_at) FROM listing_detail),
  (SELECT first(started_at ORDER BY id DESC) FROM scraping_run WHERE status = 'running' AND run_type = 'incremental'),
  (SELECT first(started_at ORDER BY id DESC) FROM scraping_run WHERE status = 'running' AND run_type = 'detail_backfill')) AS last_dataset_update_at"""


@query("last_dataset_update", with_views(_UPDATE))
def _(t):
    return agg.last_dataset_update(t.listing, t.listing_detail, t.scraping_run)


@query("region_resolution_stats", with_views(
    """SELECT metric, count(*) AS listing_count FROM (
    SELECT 'active_total' AS metric FROM a UNION ALL SELECT 'with_region' FROM a WHERE resolved_region_name IS NOT NULL
    UNION ALL SELECT 'unknown_region' FROM a WHERE region_source = 'unknown' UNION ALL SELECT 'unset_region' FROM a WHERE region_source IS NULL
    UNION ALL SELECT 'source:' || coalesce(region_source, 'unset') FROM a
    UNION ALL SELECT 'reason:' || coalesce(region_unknown_reason, 'unset') FROM a WHERE region_source = 'unknown') GROUP BY 1""",
    "a AS (SELECT * FROM listing WHERE is_active)"))
def _(t):
    return agg.region_resolution_stats(t.listing)


_ROLLUP = """rollup_dates AS (SELECT snapshot_date, CAST(sum(listing_count) AS BIGINT) AS listing_count, CAST(sum(new_count) AS BIGINT) AS new_count,
  CAST(sum(removed_count) AS BIGINT) AS removed_count, avg(price_drop_share) AS avg_price_drop_share, avg(median_days_on_market) AS avg_median_days
  FROM analytic_snapshot GROUP BY 1)"""
_ROLLUP_COLS = """snapshot_date, listing_count, new_count, removed_count, round(avg_price_drop_share, 6) AS avg_price_drop_share,
  round(avg_median_days, 6) AS avg_median_days"""


@query("snapshot_rollup", with_views(f"SELECT {_ROLLUP_COLS} FROM rollup_dates", _ROLLUP))
def _(t):
    return agg.snapshot_rollup(t.analytic_snapshot)


@query("latest_two_dates", with_views(
    f"SELECT {_ROLLUP_COLS}, CAST(row_number() OVER (ORDER BY snapshot_date DESC) AS INTEGER) AS age FROM rollup_dates ORDER BY snapshot_date DESC LIMIT 2", _ROLLUP))
def _(t):
    return agg.latest_two_dates(agg.snapshot_rollup(t.analytic_snapshot))


_NEWEST = """newest AS (SELECT *, row_number() OVER (PARTITION BY category_main_cb, category_type_cb
  ORDER BY snapshot_date DESC, coalesce(location_id, -1)) AS rn FROM analytic_snapshot)"""


@query("latest_by_segment", with_views(
    """SELECT CAST(sum(listing_count) AS BIGINT) AS listing_count, round(avg(median_days_on_market), 6) AS avg_median_days,
    round(avg(price_drop_share), 6) AS avg_price_drop_share, round(avg(median_first_to_last_price_change_pct), 6) AS avg_price_change_pct
    FROM newest WHERE rn = 1""", _NEWEST))
def _(t):
    return agg.latest_by_segment(t.analytic_snapshot)


_SPREAD = f"""spread AS (SELECT CAST(sum(listing_count) AS BIGINT) AS total, first(region ORDER BY listing_count DESC, region) AS top_region,
  max(listing_count) / sum(listing_count)::DOUBLE * 100 AS top_share_pct,
  max(listing_count) FILTER (region = '{U}') / sum(listing_count)::DOUBLE * 100 AS unknown_share_pct,
  max(listing_count) AS max_count, min(listing_count) AS min_count FROM inventory)"""


@query("regional_spread", with_views(
    "SELECT * REPLACE (round(top_share_pct, 6) AS top_share_pct, round(unknown_share_pct, 6) AS unknown_share_pct) FROM spread", _INVENTORY, _SPREAD))
def _(t):
    return agg.regional_spread(agg.inventory_by_region(t.listing))


_PER_M2 = "nullif(l.price_czk, 0) / nullif(d.usable_area, 0)::DOUBLE"
_DAYS = lambda a, b: f"(epoch_us({b}) - epoch_us({a})) / 86400000000.0::DOUBLE"


def _market_sql(prev: str) -> str:
    return with_views(
        f"""SELECT CAST({NOW} AS DATE) AS snapshot_date, CAST(NULL AS BIGINT) AS location_id, category_main_cb, category_type_cb,
  count(*) FILTER (is_active) AS listing_count, round(avg(price), 6) AS avg_price_czk, round(median(price), 6) AS median_price_czk,
  round(avg(m2), 6) AS avg_price_per_m2, count(*) FILTER (first_seen_at >= ws) AS new_count, count(*) FILTER (removed_at >= ws) AS removed_count,
  round(median(dom), 6) AS median_days_on_market, round(avg(dom), 6) AS avg_days_on_market,
  round(avg(dropped), 6) AS price_drop_share, round(median(change), 6) AS median_first_to_last_price_change_pct
FROM base GROUP BY ALL""",
        _FEATURES,
        f"prev AS ({prev})",
        f"""base AS (SELECT l.*, coalesce(CAST(p.prev_date AS TIMESTAMP), {NOW} - INTERVAL 1 DAY) AS ws,
  CASE WHEN is_active THEN nullif(l.price_czk, 0)::DOUBLE END AS price, CASE WHEN is_active THEN {_PER_M2} END AS m2,
  CASE WHEN is_active THEN {_DAYS('first_seen_at', NOW)}
       WHEN removed_at >= {NOW} - INTERVAL 90 DAY THEN {_DAYS('first_seen_at', 'removed_at')} END AS dom,
  CASE WHEN is_active THEN (CASE WHEN coalesce(f.any_drop, false) THEN 1.0 ELSE 0.0 END)::DOUBLE END AS dropped,
  CASE WHEN is_active AND f.n >= 2 THEN (f.last_price - f.first_price) / nullif(f.first_price, 0)::DOUBLE * 100 END AS change
  FROM listing l {_D} LEFT JOIN features f ON f.listing_id = l.id
  LEFT JOIN prev p ON p.main IS NOT DISTINCT FROM l.category_main_cb AND p.deal IS NOT DISTINCT FROM l.category_type_cb)""",
    ).replace("GROUP BY ALL", "GROUP BY category_main_cb, category_type_cb")


@query("market_dynamics_snapshot", _market_sql("SELECT NULL::INTEGER AS main, NULL::INTEGER AS deal, NULL::DATE AS prev_date WHERE false"))
def market_snapshot(t):
    return market.market_dynamics_snapshot(t.listing, t.listing_detail, history_features(t.price_history, AS_OF), None, AS_OF)


@query("market_dynamics_snapshot_incremental", _market_sql(
    "SELECT category_main_cb AS main, category_type_cb AS deal, max(snapshot_date) AS prev_date FROM analytic_snapshot WHERE location_id IS NULL AND category_main_cb <> 4 GROUP BY 1, 2"))
def _(t):
    stored = t.analytic_snapshot.where("category_main_cb <> 4")
    return market.market_dynamics_snapshot(t.listing, t.listing_detail, history_features(t.price_history, AS_OF), stored, AS_OF)


@query("previous_snapshot_dates", with_views(
    "SELECT category_main_cb, category_type_cb, max(snapshot_date) AS prev_date FROM analytic_snapshot WHERE location_id IS NULL GROUP BY 1, 2"))
def _(t):
    return market.previous_snapshot_dates(t.analytic_snapshot)


@query("market_dynamics", with_views(
    """SELECT snapshot_date, location_id, category_main_cb, category_type_cb, listing_count, round(avg_price_czk, 6) AS avg_price_czk,
    round(price_drop_share, 6) AS price_drop_share FROM analytic_snapshot
    WHERE snapshot_date >= DATE '2001-12-01' - 2000 AND category_main_cb = 1 AND category_type_cb = 2"""))
def _(t):
    return market.market_dynamics(t.analytic_snapshot, AS_OF, 2000, 1, 2).select(
        "snapshot_date", "location_id", "category_main_cb", "category_type_cb", "listing_count", "avg_price_czk", "price_drop_share")


# A date with many recent listings, so that new counts and drops are not all zero.
BUSY = datetime(1997, 6, 1)
_BUSY = "TIMESTAMP '1997-06-01 00:00:00'"
_BUSY_FEATURES = _FEATURES.replace(NOW, _BUSY)


def _cells_sql(where: str, features_now: str, include_removed: bool = False) -> str:
    out = f"removed_at >= {features_now} - INTERVAL 30 DAY"
    keep = f"(is_active OR coalesce({out}, false))" if include_removed else "is_active"
    return f"""cells AS (
  SELECT *, lat_bin || '_' || lon_bin AS grid_id, (lat_bin + 0.5::DOUBLE) * 0.01::DOUBLE AS lat_center, (lon_bin + 0.5::DOUBLE) * 0.01::DOUBLE AS lon_center FROM (
  SELECT CAST(floor(gps_lat / 0.01::DOUBLE) AS BIGINT) AS lat_bin, CAST(floor(gps_lon / 0.01::DOUBLE) AS BIGINT) AS lon_bin,
    count(*) FILTER (is_active) AS listing_count, round_even(avg({_PER_M2}) FILTER (is_active), 0) AS avg_price_per_m2,
    round_even(count(*) FILTER (is_active AND coalesce(f.drop_90d, false)) / (count(*) FILTER (is_active))::DOUBLE, 3) AS price_drop_intensity,
    round_even((count(*) FILTER (is_active AND first_seen_at >= {features_now} - INTERVAL 30 DAY) + count(*) FILTER ({out})) / (count(*) FILTER (is_active))::DOUBLE, 3) AS turnover_rate,
    count({_PER_M2}) FILTER (is_active) AS priced_count
  FROM listing l {_D} LEFT JOIN features f ON f.listing_id = l.id
  WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND {keep} {where} GROUP BY 1, 2 HAVING count(*) FILTER (is_active) > 0))"""


_CELL_COLS = "grid_id, round(lat_center, 6) AS lat_center, round(lon_center, 6) AS lon_center, listing_count, avg_price_per_m2, price_drop_intensity, turnover_rate"


def _cells(t, now=AS_OF, **kw):
    return spatial.grid_metrics(t.listing, t.listing_detail, history_features(t.price_history, now), now, **kw)


@query("grid_metrics", with_views(f"SELECT {_CELL_COLS} FROM cells", _FEATURES, _cells_sql("", NOW)))
def grid(t):
    return _cells(t).select(*spatial.CELL_COLUMNS)


@query("grid_metrics_filtered", with_views(
    f"SELECT {_CELL_COLS}, priced_count FROM cells", _BUSY_FEATURES,
    _cells_sql("AND category_main_cb = 2 AND category_type_cb = 1 AND gps_lat BETWEEN 49 AND 50.5 AND gps_lon BETWEEN 12.5 AND 15", _BUSY)))
def _(t):
    return _cells(t, BUSY, main=2, deal=1, box=(49.0, 12.5, 50.5, 15.0))


@query("grid_metrics_with_removed", with_views(f"SELECT {_CELL_COLS} FROM cells", _BUSY_FEATURES, _cells_sql("", _BUSY, True)))
def _(t):
    return _cells(t, BUSY, include_removed=True).select(*spatial.CELL_COLUMNS)


def _coarse_sql(step: str, weight: str = "listing_count", name: str = "coarse", cells: str = "cells") -> str:
    return f"""{name} AS (
  SELECT 'a' || lat_bin || '_' || lon_bin || '_{step}' AS grid_id, (lat_bin + 0.5::DOUBLE) * {step}::DOUBLE AS lat_center,
    (lon_bin + 0.5::DOUBLE) * {step}::DOUBLE AS lon_center, listing_count, avg_price_per_m2, price_drop_intensity, turnover_rate FROM (
  SELECT CAST(floor(lat_center / {step}::DOUBLE) AS BIGINT) AS lat_bin, CAST(floor(lon_center / {step}::DOUBLE) AS BIGINT) AS lon_bin,
    CAST(sum(listing_count) AS BIGINT) AS listing_count,
    round_even(nullif(sum(coalesce(avg_price_per_m2, 0) * {weight}), 0) / nullif(sum({weight}), 0), 0) AS avg_price_per_m2,
    round_even(sum(price_drop_intensity * listing_count) / sum(listing_count), 3) AS price_drop_intensity,
    round_even(sum(turnover_rate * listing_count) / sum(listing_count), 3) AS turnover_rate
  FROM {cells} GROUP BY 1, 2))"""


@query("grid_coarse_4", with_views(f"SELECT {_CELL_COLS} FROM coarse", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.04")))
def _(t):
    return spatial.coarsen(_cells(t), 0.04)


@query("grid_coarse_10", with_views(f"SELECT {_CELL_COLS} FROM coarse", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.1")))
def _(t):
    """Steps at which cells of the test data merge."""
    return spatial.coarsen(_cells(t), 0.1)


@query("grid_coarse_25", with_views(f"SELECT {_CELL_COLS} FROM coarse", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.25")))
def _(t):
    return spatial.coarsen(_cells(t), 0.25)


@query("grid_coarse_25_priced", with_views(f"SELECT {_CELL_COLS} FROM coarse", _BUSY_FEATURES, _cells_sql("", _BUSY), _coarse_sql("0.25", "priced_count")))
def _(t):
    return spatial.coarsen(_cells(t, BUSY), 0.25, "priced_count")


@query("grid_coarse_2_priced", with_views(f"SELECT {_CELL_COLS} FROM coarse", _BUSY_FEATURES, _cells_sql("", _BUSY), _coarse_sql("0.02", "priced_count")))
def _(t):
    return spatial.coarsen(_cells(t, BUSY), 0.02, "priced_count")


@query("grid_in_box", with_views(
    f"SELECT {_CELL_COLS} FROM cells WHERE lat_center BETWEEN 49.2 AND 50.1 AND lon_center BETWEEN 13.1 AND 14.2", _FEATURES, _cells_sql("", NOW)))
def _(t):
    return spatial.cells_in_box(_cells(t), (49.2, 13.1, 50.1, 14.2)).select(*spatial.CELL_COLUMNS)


def _stored(t):
    """Stored cells: one row per customer position and order month."""
    rows = t.listing.where("gps_lat is not null").withColumn("day", F.last_day(F.col("first_seen_at").cast("date")))
    lat, lon = F.floor(F.col("gps_lat") / F.lit(0.01)), F.floor(F.col("gps_lon") / F.lit(0.01))
    return rows.groupBy(F.col("day").alias("metric_date"), lat.alias("y"), lon.alias("x")).agg(F.count(F.lit(1)).alias("listing_count")).select(
        "metric_date", F.concat_ws("_", "y", "x").alias("grid_id"), ((F.col("y") + 0.5) * F.lit(0.01)).alias("lat_center"),
        ((F.col("x") + 0.5) * F.lit(0.01)).alias("lon_center"), F.lit(None).cast("int").alias("category_main_cb"), F.lit(None).cast("int").alias("category_type_cb"),
        "listing_count", (F.col("listing_count") * 1000.0).alias("avg_price_per_m2"), F.lit(0.25).alias("price_drop_intensity"), F.lit(0.5).alias("turnover_rate"))


_STORED = """stored AS (
  SELECT metric_date, y || '_' || x AS grid_id, (y + 0.5::DOUBLE) * 0.01::DOUBLE AS lat_center, (x + 0.5::DOUBLE) * 0.01::DOUBLE AS lon_center, listing_count,
    listing_count * 1000.0::DOUBLE AS avg_price_per_m2, 0.25::DOUBLE AS price_drop_intensity, 0.5::DOUBLE AS turnover_rate
  FROM (SELECT last_day(first_seen_at) AS metric_date, CAST(floor(gps_lat / 0.01::DOUBLE) AS BIGINT) AS y, CAST(floor(gps_lon / 0.01::DOUBLE) AS BIGINT) AS x,
    count(*) AS listing_count FROM listing WHERE gps_lat IS NOT NULL GROUP BY 1, 2, 3)),
last_stored AS (SELECT * FROM stored WHERE metric_date = (SELECT max(metric_date) FROM stored))"""


def _after_stored(t) -> datetime:
    """Just after the newest stored date of the data set at hand."""
    last = _stored(t).agg(F.max("metric_date")).head()[0]
    return datetime(last.year, last.month, last.day, 12)


@query("heatmap_cached", with_views(
    f"SELECT {_CELL_COLS}, 'cache' AS source, 0.04::DOUBLE AS grid_step_degrees FROM coarse", _STORED, _coarse_sql("0.04", cells="last_stored")))
def _(t):
    return spatial.heatmap(_stored(t), _cells(t), _after_stored(t), zoom=6)


@query("heatmap_live", with_views(
    f"SELECT {_CELL_COLS}, 'live' AS source, 0.02::DOUBLE AS grid_step_degrees FROM coarse", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.02")))
def _(t):
    return spatial.heatmap(_stored(t), _cells(t), datetime(2030, 1, 1), zoom=8)


@query("grid_snapshot", with_views(
    f"SELECT CAST({NOW} AS DATE) AS metric_date, CAST(1 AS INTEGER) AS category_main_cb, CAST(NULL AS INTEGER) AS category_type_cb, {_CELL_COLS} FROM cells",
    _FEATURES, _cells_sql("AND category_main_cb = 1", NOW)))
def _(t):
    return spatial.grid_snapshot(_cells(t, main=1), AS_OF, 1, None)


@query("color_scale", with_views(
    """SELECT grid_id, avg_price_per_m2 AS value, low, high, CASE WHEN avg_price_per_m2 IS NOT NULL AND high > low THEN round(greatest(0, least(1, (avg_price_per_m2 - low) / (high - low))), 6) END AS t
    FROM coarse, (SELECT min(avg_price_per_m2) AS low, max(avg_price_per_m2) AS high FROM coarse)""", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.04")))
def _(t):
    return spatial.color_scale(spatial.coarsen(_cells(t), 0.04), "avg_price_per_m2")


@query("color_scale_25", with_views(
    """SELECT grid_id, avg_price_per_m2 AS value, low, high, CASE WHEN avg_price_per_m2 IS NOT NULL AND high > low THEN round(greatest(0, least(1, (avg_price_per_m2 - low) / (high - low))), 6) END AS t
    FROM coarse, (SELECT min(avg_price_per_m2) AS low, max(avg_price_per_m2) AS high FROM coarse)""", _FEATURES, _cells_sql("", NOW), _coarse_sql("0.25")))
def _(t):
    return spatial.color_scale(spatial.coarsen(_cells(t), 0.25), "avg_price_per_m2")


def hav_sql(a: str, b: str) -> str:
    return f"""2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2)
      + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"""


@query("haversine", with_views(
    f"SELECT id, round({hav_sql('p.', 'q.')}, 6) AS km FROM (SELECT id, gps_lat AS lat, gps_lon AS lon FROM listing WHERE gps_lat IS NOT NULL) p, (SELECT 50.0755::DOUBLE AS lat, 14.4378::DOUBLE AS lon) q"), digits=6)
def _(t):
    return t.listing.where("gps_lat is not null").select("id", haversine_km(F.col("gps_lat"), F.col("gps_lon"), F.lit(50.0755), F.lit(14.4378)).alias("km"))


_PAIRS = f"""located AS (
  SELECT l.id, l.gps_lat AS lat, l.gps_lon AS lon, l.category_sub_cb AS sub, d.usable_area::DOUBLE AS area FROM listing l JOIN listing_detail d ON d.listing_id = l.id
  WHERE l.is_active AND l.gps_lat IS NOT NULL AND l.gps_lon IS NOT NULL AND d.usable_area <> 0),
duplicates AS (
  SELECT DISTINCT a.id AS listing_id FROM located a JOIN located b ON a.id <> b.id AND a.sub IS NOT DISTINCT FROM b.sub
    AND floor(b.lat * 100) BETWEEN floor(a.lat * 100) - 1 AND floor(a.lat * 100) + 1
  WHERE abs(b.area - a.area) / a.area <= 0.05 AND {hav_sql('a.', 'b.')} <= 0.05)"""


@query("near_duplicates", with_views("SELECT listing_id FROM duplicates", _PAIRS))
def _(t):
    return anomaly.near_duplicates(t.listing, t.listing_detail)


def _jittered(t):
    """Listings moved by up to 60 m, so that partners lie at many distances."""
    k = F.col("id")
    return (
        t.listing.withColumn("gps_lat", F.lit(50.0) + (k * 7919 % 2003) / F.lit(100000.0))
        .withColumn("gps_lon", F.lit(14.0) + (k * 104729 % 2503) / F.lit(100000.0))
        .withColumn("category_sub_cb", F.when(k % 4 != 0, (k % 3).cast("int")))
    )


_JITTER = f"""moved AS (SELECT id, is_active, 50.0::DOUBLE + (id * 7919 % 2003) / 100000.0::DOUBLE AS lat, 14.0::DOUBLE + (id * 104729 % 2503) / 100000.0::DOUBLE AS lon,
    CASE WHEN id % 4 <> 0 THEN id % 3 END AS sub FROM listing),
spots AS (SELECT m.*, d.usable_area::DOUBLE AS area, CAST(floor(lat * 1000) AS BIGINT) AS cy FROM moved m JOIN listing_detail d ON d.listing_id = m.id WHERE is_active AND d.usable_area <> 0)"""


@query("near_duplicates_spread", with_views(
    f"""SELECT DISTINCT a.id AS listing_id FROM spots a JOIN (SELECT *, cy + unnest([-1, 0, 1]) AS ny FROM spots) b ON a.cy = b.ny AND a.id <> b.id
    AND a.sub IS NOT DISTINCT FROM b.sub WHERE abs(b.area - a.area) / a.area <= 0.05 AND {hav_sql('a.', 'b.')} <= 0.05""", _JITTER))
def _(t):
    return anomaly.near_duplicates(_jittered(t), t.listing_detail)


_SCORES = f"""rated AS (
  SELECT l.id AS listing_id, l.category_main_cb AS m, l.category_type_cb AS t, l.category_sub_cb AS s, d.usable_area AS area, {_PER_M2} AS m2, {_DAYS('first_seen_at', NOW)} AS age
  FROM listing l {_D} WHERE l.is_active),
ordered AS (SELECT *, row_number() OVER (PARTITION BY m, t, s ORDER BY age) AS rn, count(*) OVER (PARTITION BY m, t, s) AS cnt FROM rated),
segs AS (SELECT m, t, s, avg(m2) AS mean, stddev_pop(m2) AS dev, count(m2) AS n, max(cnt) AS cnt,
    greatest(1, least(max(cnt) - 1, 9 * (max(cnt) + 1) // 10)) AS j FROM ordered GROUP BY 1, 2, 3),
p90 AS (SELECT g.m, g.t, g.s, max(CASE WHEN o.rn = g.j THEN o.age END) AS xa, max(CASE WHEN o.rn = least(g.j + 1, g.cnt) THEN o.age END) AS xb
  FROM segs g JOIN ordered o ON g.m IS NOT DISTINCT FROM o.m AND g.t IS NOT DISTINCT FROM o.t AND g.s IS NOT DISTINCT FROM o.s GROUP BY 1, 2, 3),
stats AS (SELECT g.*, (xa * (10 - (9 * (cnt + 1) - 10 * j)) + xb * (9 * (cnt + 1) - 10 * j)) / 10.0::DOUBLE AS p90
  FROM segs g JOIN p90 p ON g.m IS NOT DISTINCT FROM p.m AND g.t IS NOT DISTINCT FROM p.t AND g.s IS NOT DISTINCT FROM p.s),
flagged AS (
  SELECT r.listing_id, g.n,
    coalesce(g.n >= 10 AND g.dev > 0 AND abs((r.m2 - g.mean) / nullif(g.dev, 0)) > 2.5, false) AS f1,
    coalesce(f.max_step_pct >= 30, false) AS f2,
    coalesce(nullif(r.area, 0) < {case_of(anomaly.MIN_AREA_BY_LAYOUT, 'r.s').replace("'", "")} * 0.5, false) AS f3,
    coalesce(CASE WHEN g.cnt >= 10 THEN r.age > g.p90 ELSE r.age > 180 END, false) AS f4,
    x.listing_id IS NOT NULL AS f5
  FROM rated r LEFT JOIN stats g ON g.m IS NOT DISTINCT FROM r.m AND g.t IS NOT DISTINCT FROM r.t AND g.s IS NOT DISTINCT FROM r.s
  LEFT JOIN features f ON f.listing_id = r.listing_id LEFT JOIN duplicates x ON x.listing_id = r.listing_id)"""


@query("score_anomalies", with_views(
    """SELECT listing_id, least(100.0::DOUBLE, (CASE WHEN f1 THEN 30 ELSE 0 END + CASE WHEN f2 THEN 25 ELSE 0 END + CASE WHEN f3 THEN 20 ELSE 0 END
      + CASE WHEN f4 THEN 15 ELSE 0 END + CASE WHEN f5 THEN 35 ELSE 0 END)::DOUBLE) AS anomaly_score,
    array_to_string(list_filter([CASE WHEN f3 THEN 'area_layout_mismatch' END, CASE WHEN f1 THEN 'extreme_price_per_m2' END,
      CASE WHEN f5 THEN 'possible_duplicate' END, CASE WHEN f4 THEN 'stale_listing' END, CASE WHEN f2 THEN 'unusual_price_change' END], lambda x: x IS NOT NULL), ',') AS anomaly_flags,
    round(least(1.0::DOUBLE, coalesce(n, 0) / 30.0::DOUBLE), 6) AS confidence_score FROM flagged""",
    _FEATURES, _PAIRS, _SCORES))
def score(t):
    scored = anomaly.score_anomalies(t.listing, t.listing_detail, history_features(t.price_history, AS_OF), AS_OF)
    return scored.withColumn("anomaly_flags", F.array_join("anomaly_flags", ","))


@query("segment_statistics", with_views(
    "SELECT m AS category_main_cb, t AS category_type_cb, s AS category_sub_cb, round(mean, 6) AS m2_mean, round(dev, 6) AS m2_dev, n AS m2_n, cnt AS age_n, round(p90, 6) AS age_p90 FROM stats",
    _FEATURES, _PAIRS, _SCORES))
def _(t):
    stats = anomaly.segment_stats(anomaly.with_age(anomaly.anomaly_inputs(t.listing, t.listing_detail), AS_OF))
    return stats.select(*[F.col(f"g_{c}").alias(c) for c in anomaly.SEGMENT], "m2_mean", "m2_dev", "m2_n", "age_n", "age_p90")


@query("exact_median_price", with_views(
    "SELECT category_main_cb, category_sub_cb, count(price_czk) AS n, round(median(price_czk), 6) AS q FROM listing WHERE price_czk IS NOT NULL GROUP BY 1, 2"))
def _(t):
    return exact_quantile(t.listing, ["category_main_cb", "category_sub_cb"], "price_czk", "median")


def _near_sql(move: str) -> str:
    return f"""
comp_rows AS ({move}),
comp_pairs AS (
  SELECT s.id AS subject_id, c.id AS listing_id, c.title, c.price_czk, nullif(c.price_czk, 0) / nullif(c.area, 0) AS m2, round_even({hav_sql('s.', 'c.')}, 2) AS km
  FROM comp_rows s JOIN comp_rows c ON s.id <> c.id AND s.main = c.main AND s.deal = c.deal
    AND c.lat BETWEEN s.lat - 0.19 AND s.lat + 0.19 AND c.lon BETWEEN s.lon - 0.3 AND s.lon + 0.3
  WHERE c.is_active AND c.has_detail AND (s.sub IS NULL OR c.sub BETWEEN s.sub - 1 AND s.sub + 1)
    AND (nullif(s.area, 0) IS NULL OR c.area BETWEEN s.area * 0.75 AND s.area * 1.25)),
comp_ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY km, listing_id) AS rn FROM comp_pairs WHERE km <= 20),
comp_top AS (SELECT *, CASE WHEN count(*) FILTER (km <= 5) OVER (PARTITION BY subject_id) >= 3 THEN 5
    WHEN count(*) FILTER (km <= 10) OVER (PARTITION BY subject_id) >= 3 THEN 10 ELSE 20 END AS radius FROM comp_ranked WHERE rn <= 8),
comp_sel AS (SELECT * FROM comp_top WHERE km <= radius)"""


_COMP_BASE = """SELECT l.id, l.title, l.price_czk, l.is_active, l.category_main_cb AS main, l.category_type_cb AS deal, {sub} AS sub, {lat} AS lat, {lon} AS lon,
  d.usable_area::DOUBLE AS area, d.listing_id IS NOT NULL AS has_detail FROM listing l LEFT JOIN listing_detail d ON d.listing_id = l.id"""
_COMP = _near_sql(_COMP_BASE.format(sub="l.category_sub_cb", lat="l.gps_lat", lon="l.gps_lon")).strip()
_COMP_MOVED = _near_sql(
    "SELECT * REPLACE (50.0::DOUBLE + (id * 7919 % 2003) / 10000.0::DOUBLE AS lat, 14.0::DOUBLE + (id * 104729 % 2503) / 10000.0::DOUBLE AS lon) FROM ("
    + _COMP_BASE.format(sub="l.category_sub_cb", lat="l.gps_lat", lon="l.gps_lon") + ")").strip()
_COMP_COLS = "SELECT subject_id, CAST(rn AS INTEGER) AS rank, listing_id, title, price_czk, round_even(m2, 0) AS price_per_m2, km AS distance_km FROM comp_sel"


@query("comparables", with_views(_COMP_COLS, _COMP))
def comparables(t):
    return comp.comparables(t.listing, t.listing_detail)


@query("comparables_spread", with_views(_COMP_COLS, _COMP_MOVED))
def _(t):
    k = F.col("id")
    moved = t.listing.withColumn("gps_lat", F.lit(50.0) + (k * 7919 % 2003) / F.lit(10000.0)).withColumn(
        "gps_lon", F.lit(14.0) + (k * 104729 % 2503) / F.lit(10000.0))
    return comp.comparables(moved, t.listing_detail)


@query("comparables_summary", with_views(
    """SELECT s.id AS subject_id, CAST(count(c.listing_id) AS INTEGER) AS comparable_count, median(nullif(c.price_czk, 0)::DOUBLE) AS median_comparable_price_czk,
    round_even(median(nullif(c.m2, 0)), 0) AS median_comparable_price_per_m2,
    round_even((nullif(any_value(s.price_czk), 0) - median(nullif(c.price_czk, 0)::DOUBLE)) / median(nullif(c.price_czk, 0)::DOUBLE) * 100, 1) AS deviation_from_comparables_pct,
    CASE WHEN any_value(s.lat) IS NULL THEN 'no_gps' WHEN count(c.listing_id) < 3 THEN 'too_few' END AS note
    FROM comp_rows s LEFT JOIN comp_sel c ON c.subject_id = s.id GROUP BY s.id""", _COMP))
def _(t):
    return comp.comparables_summary(t.listing, t.listing_detail)


@query("valuation_area_only", with_views(
    """SELECT listing_id, round(e, 2) AS expected_price_czk, round(e / area, 2) AS expected_price_per_m2, round(price - e, 2) AS residual_absolute,
    round((price - e) / e * 100, 2) AS residual_percent,
    CASE WHEN (price - e) / e * 100 <= -10 THEN 'under_market' WHEN (price - e) / e * 100 >= 10 THEN 'over_market' WHEN price IS NOT NULL AND e IS NOT NULL THEN 'near_market' END AS classification,
    CASE WHEN cnt < 30 THEN 'unavailable' WHEN n >= 100 AND r2 >= 0.4 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM est""",
    """fit_rows AS (SELECT l.id AS listing_id, l.category_main_cb AS m, l.category_type_cb AS t, nullif(l.price_czk, 0) AS price, d.usable_area::DOUBLE AS area,
      ln(d.usable_area::DOUBLE) AS lx, CASE WHEN l.price_czk > 0 THEN ln(l.price_czk::DOUBLE) END AS ly
      FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active AND d.usable_area > 0),
    fit AS (SELECT m, t, regr_slope(ly, lx) AS b, regr_intercept(ly, lx) AS a, regr_r2(ly, lx) AS r2, count(ly) AS n, count(*) AS cnt FROM fit_rows GROUP BY 1, 2),
    est AS (SELECT r.*, f.r2, f.n, f.cnt, CASE WHEN f.cnt >= 30 THEN exp(f.a + f.b * r.lx) END AS e FROM fit_rows r JOIN fit f USING (m, t))"""), digits=2)
def _(t):
    return val.area_only_valuation(t.listing, t.listing_detail)


@query("hedonic_valuation", digits=2)
def hedonic(t):
    return val.hedonic_valuation(t.listing, t.listing_detail, "v1")[1]


@query("hedonic_models", digits=6)
def _(t):
    models = val.hedonic_valuation(t.listing, t.listing_detail, "v1")[0]
    return models.select("version", "segment_key", F.size("feature_list").alias("features"), "r2", "n_samples")


_HEDONIC = """hed_base AS (SELECT l.id AS listing_id, coalesce(l.category_main_cb, -1) || '_' || coalesce(l.category_type_cb, -1) AS seg, ln(d.usable_area::DOUBLE) AS x,
      CASE WHEN l.price_czk > 0 THEN ln(l.price_czk::DOUBLE) END AS y, coalesce(l.category_sub_cb::VARCHAR, 'None') AS category_sub_cb, coalesce(nullif(d.building_condition, ''), 'unknown') AS building_condition,
      coalesce(nullif(d.ownership, ''), 'unknown') AS ownership, coalesce(nullif(d.energy_efficiency_rating, ''), 'unknown') AS energy_efficiency_rating,
      CASE WHEN l.gps_lat IS NOT NULL AND l.gps_lon IS NOT NULL THEN CAST(floor(l.gps_lat / 0.01::DOUBLE) AS BIGINT) || '_' || CAST(floor(l.gps_lon / 0.01::DOUBLE) AS BIGINT) ELSE 'unknown' END AS cell_raw
    FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active AND d.usable_area > 0),
  hed_rows AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY seg, cell_raw) < 3 THEN 'OTHER' ELSE cell_raw END AS cell, count(*) OVER (PARTITION BY seg) AS seg_n FROM hed_base)"""


@query("hedonic_model_sizes", with_views(
    """SELECT 'v1' AS version, seg AS segment_key, (count(DISTINCT category_sub_cb) + count(DISTINCT building_condition) + count(DISTINCT ownership) + count(DISTINCT energy_efficiency_rating) + 3)::BIGINT AS features,
    count(y) AS n_samples FROM hed_rows GROUP BY seg HAVING count(*) >= 30 AND count(y) > 0""", _HEDONIC))
def _(t):
    """Stored models by what can be counted: four codes without their first values, and seven numbers."""
    models = val.hedonic_valuation(t.listing, t.listing_detail, "v1")[0]
    return models.select("version", "segment_key", F.size("feature_list").cast("bigint").alias("features"), "n_samples")


@query("hedonic_models_updated", with_views(
    """SELECT seg AS segment_key, (count(DISTINCT category_sub_cb) + count(DISTINCT building_condition) + count(DISTINCT ownership) + count(DISTINCT energy_efficiency_rating) + 3)::BIGINT AS features,
    count(y) AS n_samples, true AS as_refitted FROM hed_rows GROUP BY seg HAVING count(*) >= 30 AND count(y) > 0""", _HEDONIC))
def _(t):
    """Stored sums of other prices and areas for a fifth of the listings, and without another fifth, brought up to date; then held against a fit of all rows."""
    changed, new = F.col("id") % 5 == 0, F.col("id") % 5 == 1
    old = t.listing.withColumn("price_czk", F.when(changed, F.col("price_czk") * 2 + 1).otherwise(F.col("price_czk")))
    state = cut_lineage(fitstate.fit_state(old.where(~new), t.listing_detail), "sums")
    state = fitstate.update_state(state, fitstate.fit_state(old.where(changed), t.listing_detail), fitstate.fit_state(t.listing.where(changed | new), t.listing_detail))
    updated = fitstate.solve_state(state)
    refit = val.hedonic_valuation(t.listing, t.listing_detail, "v1")[0].select(F.col("segment_key").alias("r_seg"), F.col("feature_list").alias("r_list"), F.col("r2").alias("r_r2"), F.col("n_samples").alias("r_n"))
    same = (F.col("feature_list") == F.col("r_list")) & (F.col("n_samples") == F.col("r_n")) & (F.abs(F.col("r2") - F.col("r_r2")) < 1e-6)
    return updated.join(refit, F.col("segment_key") == F.col("r_seg")).select("segment_key", F.size("feature_list").cast("bigint").alias("features"), "n_samples", same.alias("as_refitted"))



@query("hedonic_area_cell", with_views(
    """SELECT r.listing_id, r.seg AS segment_key, round(slope, 6) AS slope, round(coalesce(e.effect, b.base_effect) + slope * x, 6) AS fitted FROM hed_rows r
    LEFT JOIN slopes USING (seg) LEFT JOIN effects e ON e.seg = r.seg AND e.cell = r.cell LEFT JOIN base_effects b ON b.seg = r.seg""",
    _HEDONIC,
    """centred AS (SELECT *, x - avg(x) OVER (PARTITION BY seg, cell) AS dx, y - avg(y) OVER (PARTITION BY seg, cell) AS dy FROM hed_rows WHERE y IS NOT NULL AND seg_n >= 30),
    slopes AS (SELECT seg, sum(dx * dy) / sum(dx * dx) AS slope FROM centred GROUP BY seg),
    effects AS (SELECT seg, cell, avg(y) - any_value(slope) * avg(x) AS effect FROM centred JOIN slopes USING (seg) GROUP BY seg, cell),
    base_effects AS (SELECT e.seg, coalesce(max(CASE WHEN e.cell = f.first_cell THEN effect END), avg(effect)) AS base_effect
      FROM effects e JOIN (SELECT seg, min(cell) AS first_cell FROM hed_rows GROUP BY seg) f USING (seg) GROUP BY e.seg)"""))
def _(t):
    """Log area and one effect for each cell: the slope is a ratio of sums after taking out the cell means."""
    fit = val.fit_segments(t.listing, t.listing_detail, val.Features((), ("log_usable_area",)))
    return val.estimate(fit).select("listing_id", "segment_key", F.get("beta", F.lit(0)).alias("slope"), "fitted")


@query("hedonic_normal_equations", with_views(
    """SELECT seg AS segment_key, feature, n_samples, 0.0::DOUBLE AS product FROM
      (SELECT seg, feature FROM levels WHERE level > base UNION ALL SELECT seg, unnest(['log_usable_area', 'floor_number', 'balcony', 'terrace', 'loggia', 'cellar', 'garage']) FROM counts) JOIN counts USING (seg)""",
    _HEDONIC,
    """counts AS (SELECT seg, count(y) AS n_samples FROM hed_rows WHERE seg_n >= 30 GROUP BY seg),
    coded AS (SELECT seg, unnest(['category_sub_cb', 'building_condition', 'ownership', 'energy_efficiency_rating']) AS name, unnest([category_sub_cb, building_condition, ownership, energy_efficiency_rating]) AS level FROM hed_rows),
    levels AS (SELECT DISTINCT seg, name || '_' || level AS feature, level, min(level) OVER (PARTITION BY seg, name) AS base FROM coded)"""))
def _(t):
    """In a least-squares fit the residuals are orthogonal to every feature."""
    return val.normal_equations(val.fit_segments(t.listing, t.listing_detail))


@query("upsert_latest", with_views(
    """SELECT coalesce(f.listing_id, v.listing_id) AS listing_id, CASE WHEN f.listing_id IS NOT NULL THEN 'high' ELSE v.confidence END AS confidence
    FROM listing_valuation v FULL JOIN (SELECT id AS listing_id FROM listing WHERE category_main_cb = 3) f ON f.listing_id = v.listing_id"""))
def _(t):
    stored = t.listing_valuation.select("listing_id", "confidence")
    fresh = t.listing.where("category_main_cb = 3").select(F.col("id").alias("listing_id"), F.lit("high").alias("confidence"))
    return val.upsert_latest(stored, fresh)


_MONTHLY = """monthly AS (
  SELECT coalesce(s.location_id, -1) || '_' || coalesce(category_main_cb, -1) || '_' || coalesce(category_type_cb, -1) AS segment,
    coalesce(s.location_id, -1) AS location_id, coalesce(category_main_cb, -1) AS category_main_cb, coalesce(category_type_cb, -1) AS category_type_cb,
    strftime(snapshot_date, '%Y-%m') AS rok_mesic, coalesce(nullif(o.municipality, ''), nullif(o.district, ''), o.region) AS lokalita,
    avg(avg_price_per_m2) AS cena_za_m2, avg(avg_price_czk) AS prumerna_cena, avg(avg_days_on_market) AS prumerna_doba_inzerce,
    avg(listing_count) AS aktivnich_nabidek, CAST(sum(new_count) AS BIGINT) AS pocet_novych_nabidek
  FROM analytic_snapshot s LEFT JOIN location o ON o.id = s.location_id
  WHERE snapshot_date >= DATE '2001-12-01' - {days} {where} GROUP BY ALL)"""


def _series_sql(days: int, where: str = "", calendar: bool = False) -> str:
    def back(k: int) -> str:
        return f"max(x) OVER (PARTITION BY segment ORDER BY mno RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING)" if calendar else f"lag(x, {k}) OVER w"

    return with_views(
        f"""SELECT rok_mesic || '-01' AS datum, CAST(substr(rok_mesic, 1, 4) AS INTEGER) AS rok, CAST(substr(rok_mesic, 6, 2) AS INTEGER) AS mesic, rok_mesic, lokalita,
    {case_of(cb.PROPERTY_TYPES, 'category_main_cb')} AS typ, {case_of(cb.PROPERTY_TYPES, 'category_main_cb')} AS kategorie, 'aktivní' AS stav,
    {case_of(cb.DEAL_TYPES, 'category_type_cb')} AS transakce, round(cena_za_m2, 6) AS cena_za_m2, round(prumerna_cena, 6) AS prumerna_cena,
    round(prumerna_doba_inzerce, 6) AS prumerna_doba_inzerce, round(aktivnich_nabidek, 6) AS aktivnich_nabidek, pocet_novych_nabidek,
    'api_scrape' AS metoda_sberu, 'listing-portal' AS zdroj, segment, round(mom, 6) AS mom_change_pct, round(yoy, 6) AS yoy_change_pct,
    round(avg(cena_za_m2) OVER (PARTITION BY segment ORDER BY rok_mesic ROWS 2 PRECEDING), 6) AS rolling_3m_avg,
    round(avg(cena_za_m2) OVER y, 6) AS rolling_12m_avg,
    round(cena_za_m2 / nullif(first_value(cena_za_m2) OVER w, 0) * 100, 6) AS price_index_base_100,
    round(max(CASE WHEN category_type_cb = 1 THEN cena_za_m2 END) OVER p - max(CASE WHEN category_type_cb = 2 THEN cena_za_m2 END) OVER p, 6) AS spread_sale_vs_rent,
    round(CASE WHEN count(step) OVER y >= 2 THEN stddev_samp(step) OVER y END * 100, 6) AS volatility_12m
  FROM stepped WINDOW w AS (PARTITION BY segment ORDER BY rok_mesic), y AS (PARTITION BY segment ORDER BY rok_mesic ROWS 11 PRECEDING),
    p AS (PARTITION BY location_id, category_main_cb, rok_mesic)""",
        _MONTHLY.format(days=days, where=where),
        """carried AS (SELECT *, last_value(cena_za_m2 IGNORE NULLS) OVER (PARTITION BY segment ORDER BY rok_mesic) AS x,
          CAST(substr(rok_mesic, 1, 4) AS INTEGER) * 12 + CAST(substr(rok_mesic, 6, 2) AS INTEGER) AS mno FROM monthly)""",
        f"""stepped AS (SELECT *, (x / nullif({back(1)}, 0) - 1) * 100 AS mom, (x / nullif({back(12)}, 0) - 1) * 100 AS yoy, x / nullif(lag(x) OVER w, 0) - 1 AS step
          FROM carried WINDOW w AS (PARTITION BY segment ORDER BY rok_mesic))""",
    )


@query("timeseries", _series_sql(3000))
def timeseries(t):
    return series.timeseries(t.analytic_snapshot, t.location, AS_OF, 3000)


@query("timeseries_segment_calendar", _series_sql(2500, "AND category_main_cb = 1 AND category_type_cb = 1", True))
def _(t):
    return series.timeseries(t.analytic_snapshot, t.location, AS_OF, 2500, 1, 1, calendar=True)


@query("monthly_rollup", with_views(
    "SELECT * REPLACE (round(cena_za_m2, 6) AS cena_za_m2, round(prumerna_cena, 6) AS prumerna_cena, round(prumerna_doba_inzerce, 6) AS prumerna_doba_inzerce, round(aktivnich_nabidek, 6) AS aktivnich_nabidek) FROM monthly",
    _MONTHLY.format(days=3000, where="")))
def _(t):
    return series.monthly_rollup(t.analytic_snapshot, t.location, AS_OF, 3000)


@query("snapshots_with_location", with_views(
    "SELECT s.snapshot_date, s.location_id, s.category_main_cb, s.category_type_cb, s.listing_count, coalesce(nullif(o.municipality, ''), nullif(o.district, ''), o.region) AS lokalita FROM analytic_snapshot s LEFT JOIN location o ON o.id = s.location_id"))
def _(t):
    return series.snapshots_with_location(t.analytic_snapshot, t.location).select(
        "snapshot_date", "location_id", "category_main_cb", "category_type_cb", "listing_count", "lokalita")


# Full sweeps of the derived run log are day-sized, so the threshold is too.
MIN_ITEMS = 2
_STATE = f"""lookups AS (SELECT
    (SELECT id FROM scraping_run WHERE run_type = 'incremental' AND status = 'success' AND category = 'all' AND items_seen >= {MIN_ITEMS} ORDER BY finished_at DESC, id DESC LIMIT 1) AS full_id,
    (SELECT id FROM scraping_run WHERE run_type = 'incremental' AND status = 'success' AND items_seen > 0 ORDER BY finished_at DESC, id DESC LIMIT 1) AS ok_id,
    (SELECT max(id) FROM scraping_run WHERE run_type = 'incremental' AND status = 'running') AS sweep_id,
    (SELECT max(id) FROM scraping_run WHERE run_type = 'detail_backfill' AND status = 'running') AS detail_id,
    (SELECT count(*) FROM listing WHERE is_active) AS active_total, (SELECT count(*) FROM listing) AS all_total,
    (SELECT count(*) FILTER (active_count > 0) FROM slices) AS slice_count),
judged AS (SELECT *, CASE WHEN active_total = 0 THEN 'empty' WHEN full_id IS NOT NULL AND slice_count >= 18 THEN 'complete' ELSE 'partial' END AS comp FROM lookups),
state AS (SELECT *, CASE WHEN sweep_id IS NOT NULL THEN 'in_progress' WHEN detail_id IS NOT NULL THEN 'detail_enrichment' WHEN comp = 'empty' THEN 'empty'
    WHEN comp = 'complete' THEN 'final_complete' ELSE 'final_partial' END AS fresh FROM judged)"""
_STATE_COLS = """active_total, all_total, slice_count AS active_category_slice_count, 20 AS expected_category_slice_count, comp AS dataset_completeness,
  fresh AS dataset_freshness, fresh IN ('final_complete', 'final_partial', 'detail_enrichment') AS is_count_final, fresh = 'final_complete' AS safe_to_compare_total,
  fresh IN ('final_complete', 'final_partial', 'detail_enrichment') AS safe_to_compare_per_slice, coalesce(sweep_id, detail_id) AS snapshot_reference_run_id,
  (SELECT finished_at FROM scraping_run WHERE id = full_id) AS last_full_sweep_at, full_id AS last_full_sweep_run_id,
  (SELECT items_seen FROM scraping_run WHERE id = full_id) AS last_full_sweep_items_seen, (SELECT finished_at FROM scraping_run WHERE id = ok_id) AS last_successful_scrape_at,
  (SELECT items_seen FROM scraping_run WHERE id = sweep_id) AS run_items_seen"""


@query("dataset_state", with_views(f"SELECT {_STATE_COLS} FROM state", _SLICES, _STATE))
def _(t):
    return quality.dataset_state(t.listing, t.scraping_run, MIN_ITEMS)


def _finished(t):
    return t.scraping_run.where("status <> 'running'")


@query("dataset_state_final", with_views(f"SELECT {_STATE_COLS} FROM state", _SLICES, _STATE.replace("status = 'running'", "false")))
def _(t):
    return quality.dataset_state(t.listing, _finished(t), MIN_ITEMS)


@query("dataset_state_complete", with_views(
    f"SELECT {_STATE_COLS} FROM state", _SLICES.replace("category_main_cb, category_type_cb, count", "1 + id % 5 AS category_main_cb, 1 + id // 5 % 4 AS category_type_cb, count"), _STATE.replace("status = 'running'", "false")))
def _(t):
    """Listings spread over all twenty slices after a full sweep."""
    spread = t.listing.withColumn("category_main_cb", (1 + F.col("id") % 5).cast("int")).withColumn("category_type_cb", (1 + F.floor(F.col("id") / 5) % 4).cast("int"))
    return quality.dataset_state(spread, _finished(t), MIN_ITEMS)


@query("run_lookups", with_views("SELECT full_id AS full_sweep_id, ok_id AS last_success_id, sweep_id AS running_sweep_id, detail_id AS running_detail_id FROM lookups", _SLICES, _STATE))
def _(t):
    return quality.run_lookups(t.scraping_run, MIN_ITEMS).select(
        F.col("full_sweep.id").alias("full_sweep_id"), F.col("last_success.id").alias("last_success_id"),
        F.col("running_sweep.id").alias("running_sweep_id"), F.col("running_detail.id").alias("running_detail_id"))


@query("open_runs", with_views("SELECT id, status, items_seen, pages_fetched, finished_at FROM scraping_run WHERE status IN ('partial', 'running')"))
def _(t):
    return quality.open_runs(t.scraping_run)


def _report_sql(running: str) -> str:
    return f"""dim AS (SELECT p.k AS m, d.k AS t, p.v || ' - ' || d.v AS name FROM
    (VALUES {', '.join(f"({k}, '{v}')" for k, v in cb.PROPERTY_TYPES.items())}) p(k, v), (VALUES {', '.join(f"({k}, '{v}')" for k, v in cb.DEAL_TYPES.items())}) d(k, v)),
rep AS (SELECT name, m AS category_main_cb, t AS category_type_cb, coalesce(e.expected_total, 0) AS expected_total, coalesce(s.active_count, 0) AS active_count,
    coalesce(s.total_count, 0) AS total_count, {running} AS running FROM dim LEFT JOIN slices s ON s.category_main_cb = m AND s.category_type_cb = t
    LEFT JOIN expected_totals e ON e.category_main_cb = m AND e.category_type_cb = t),
report AS (SELECT name, category_main_cb, category_type_cb, expected_total, active_count, total_count, active_count - expected_total AS delta,
    (active_count - expected_total) / nullif(expected_total, 0)::DOUBLE * 100 AS delta_pct,
    CASE WHEN expected_total = 0 AND active_count = 0 THEN 'empty' WHEN active_count = 0 AND expected_total > 0 THEN CASE WHEN running THEN 'not_started' ELSE 'missing' END
      WHEN abs(active_count - expected_total) <= greatest(2, floor(expected_total * 0.025::DOUBLE)) THEN 'aligned'
      WHEN active_count < expected_total THEN CASE WHEN running THEN 'in_progress' ELSE 'coverage_gap' END ELSE 'over' END AS status FROM rep)"""


_IS_RUNNING = "(SELECT sweep_id IS NOT NULL FROM lookups)"


@query("reconciliation_report", with_views("SELECT * REPLACE (round(delta_pct, 6) AS delta_pct) FROM report", _SLICES, _STATE, _report_sql(_IS_RUNNING)))
def _(t):
    return quality.reconciliation_report(t.listing, t.scraping_run, t.expected_totals, MIN_ITEMS)


@query("reconciliation_report_final", with_views("SELECT * REPLACE (round(delta_pct, 6) AS delta_pct) FROM report", _SLICES, _STATE, _report_sql("false")))
def _(t):
    return quality.reconciliation_report(t.listing, _finished(t), t.expected_totals, MIN_ITEMS)


@query("reconciliation_summary", with_views(
    f"""SELECT {_STATE_COLS}, (SELECT count(*) FROM (SELECT hash_id FROM listing GROUP BY 1 HAVING count(*) > 1)) AS duplicate_hash_ids,
    (SELECT sum(listing_count) FROM inventory) = active_total AS inventory_sum_matches_active, ({_UPDATE}) AS last_dataset_update_at,
    (SELECT CAST(sum(expected_total) AS BIGINT) FROM report) AS expected_slice_sum, active_total - (SELECT CAST(sum(expected_total) AS BIGINT) FROM report) AS active_vs_expected_delta,
    active_total - (SELECT items_seen FROM scraping_run WHERE id = sweep_id) AS active_vs_run_items_seen_delta,
    (SELECT count(*) FROM report WHERE status = 'not_started') AS not_started_slice_count, (SELECT count(*) FROM report WHERE status = 'coverage_gap') AS coverage_gap_slice_count,
    fresh = 'in_progress' AND (SELECT count(*) FROM report WHERE status = 'not_started') > 0 AS delta_explainable_by_not_started FROM state""",
    _SLICES, _INVENTORY, _STATE, _report_sql(_IS_RUNNING)))
def _(t):
    return quality.reconciliation_summary(t.listing, t.listing_detail, t.scraping_run, t.expected_totals, MIN_ITEMS)


def _map_sql(column: str, where: str) -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT coalesce({column}, 'unset') AS k, count(*) AS n FROM listing WHERE is_active {where} GROUP BY 1))"


@query("dataset_summary", with_views(
    f"""SELECT c.*, s.* EXCLUDE (active_total, all_total), ({_UPDATE}) AS last_dataset_update_at, {_map_sql('region_source', '')} AS region_source_counts,
    {_map_sql('region_unknown_reason', "AND region_source = 'unknown'")} AS region_unknown_reason_counts FROM ({_COUNTS_SELECT}) c, (SELECT {_STATE_COLS} FROM state) s""",
    _COUNTS.strip(), _SLICES, _STATE))
def _(t):
    row = quality.dataset_summary(t.listing, t.listing_detail, t.listing_valuation, t.listing_anomaly, t.scraping_run, MIN_ITEMS)
    for c in ("region_source_counts", "region_unknown_reason_counts"):
        row = row.withColumn(c, F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))
    return row


@query("invariant_violations", with_views(
    f"""SELECT * FROM (
    SELECT 'inventory' AS invariant, (SELECT count(*) FROM listing WHERE is_active) AS expected, CAST(sum(listing_count) AS BIGINT) AS actual FROM inventory
    UNION ALL SELECT 'grid', (SELECT count(*) FROM listing WHERE is_active AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL), CAST(sum(listing_count) AS BIGINT) FROM cells
    UNION ALL SELECT 'valuation', (SELECT count(*) FROM listing_valuation WHERE listing_id IN (SELECT id FROM listing WHERE is_active)), CAST(sum(listing_count) AS BIGINT) FROM ({_VSUM})
    ) WHERE expected IS DISTINCT FROM actual""", _INVENTORY, _FEATURES, _cells_sql("", NOW)))
def _(t):
    return quality.invariant_violations(t.listing, t.listing_detail, _cells(t), t.listing_valuation)


@query("invariant_violations_planted", with_views(
    """SELECT 'inventory' AS invariant, count(*) FILTER (is_active) AS expected, (count(*) FILTER (is_active) + count(*) FILTER (is_active AND id % 50 = 0))::BIGINT AS actual FROM listing
    UNION ALL SELECT 'grid', count(*) FILTER (is_active AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL), count(*) FILTER (is_active AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL AND id % 5 <> 0) FROM listing
    UNION ALL SELECT 'valuation', (SELECT count(*) FROM listing_valuation WHERE listing_id IN (SELECT id FROM listing WHERE is_active)),
      (SELECT count(*) + count(*) FILTER (listing_id % 50 = 0) FROM listing_valuation WHERE listing_id IN (SELECT id FROM listing WHERE is_active))"""))
def _(t):
    """Aggregates made from other rows than the tables they are held against: copies of every fiftieth listing, cells without every fifth one."""
    twice = t.listing.unionByName(t.listing.where("id % 50 = 0"))
    fewer = t.listing.where("id % 5 <> 0")
    cells = spatial.grid_metrics(fewer, t.listing_detail, history_features(t.price_history, AS_OF), AS_OF)
    doubled = t.listing_valuation.unionByName(t.listing_valuation.where("listing_id % 50 = 0"))
    given = {"inventory": agg.inventory_by_region(twice), "grid": cells, "valuation": agg.valuation_summary(t.listing, doubled)}
    return quality.broken_sums(t.listing, t.listing_valuation, given)


def _analytics_runs(t):
    """Analytics runs: the sweeps of the run log that did not fail, later by a day."""
    return t.scraping_run.where("status <> 'running' and id % 2 = 0").select(
        "id", "status", "started_at", (F.col("finished_at") + F.make_dt_interval(F.lit(1))).alias("finished_at"), "items_seen", "error_count")


@query("analytics_staleness", with_views(
    f"""SELECT CASE WHEN fresh = 'in_progress' THEN 'ingest_in_progress' WHEN missing > 0 AND active_total > 0 THEN 'missing_details' WHEN g.finished_at IS NULL THEN 'none'
      WHEN g.status = 'partial' THEN 'partial' WHEN g.finished_at < dataset_at THEN 'stale' ELSE 'current' END AS analytics_state, missing AS missing_details,
      g.finished_at AS analytics_at, dataset_at
    FROM (SELECT *, greatest(0, active_total - (SELECT count(*) FROM listing_detail WHERE listing_id IN (SELECT id FROM listing WHERE is_active))) AS missing, ({_UPDATE.replace("status = 'running'", "false")}) AS dataset_at FROM state)
    LEFT JOIN (SELECT status, finished_at + INTERVAL 1 DAY AS finished_at FROM scraping_run WHERE status IN ('success', 'partial') AND id % 2 = 0 ORDER BY started_at DESC, id DESC LIMIT 1) g ON true""",
    _SLICES, _STATE.replace("status = 'running'", "false")))
def _(t):
    counts = agg.dataset_counts(t.listing, t.listing_detail, t.listing_valuation, t.listing_anomaly).select("active_listing_count", "active_with_detail_count")
    state = quality.dataset_state(t.listing, _finished(t), MIN_ITEMS)
    one = lambda c: state.select(c).scalar().alias(c)
    row = counts.select(
        "*", one("dataset_freshness"), one("last_full_sweep_at"), one("last_successful_scrape_at"),
        agg.last_dataset_update(t.listing, t.listing_detail, _finished(t)).scalar().alias("last_dataset_update_at"))
    return quality.analytics_staleness(row, _analytics_runs(t))


_FACTS = f"""pair AS (SELECT max(CASE WHEN a = 1 THEN listing_count END) AS cur_count, max(CASE WHEN a = 2 THEN listing_count END) AS prev_count,
    max(CASE WHEN a = 1 THEN avg_median_days END) AS cur_dom, max(CASE WHEN a = 2 THEN avg_median_days END) AS prev_dom,
    max(CASE WHEN a = 1 THEN avg_price_drop_share END) AS cur_drop, max(CASE WHEN a = 2 THEN avg_price_drop_share END) AS prev_drop
  FROM (SELECT *, row_number() OVER (ORDER BY snapshot_date DESC) AS a FROM rollup_dates)),
facts AS (SELECT *, (SELECT count(*) FROM listing_detail WHERE listing_id IN (SELECT id FROM listing WHERE is_active)) AS with_detail, active_total AS active,
    (SELECT count(*) FROM listing WHERE first_seen_at >= {NOW} - INTERVAL 30 DAY) AS new_30d, (SELECT count(*) FROM listing WHERE removed_at >= {NOW} - INTERVAL 30 DAY) AS removed_30d,
    (SELECT count(*) FROM kdrops WHERE raw_pct >= 5) AS drops, (SELECT count(*) FROM listing_valuation WHERE listing_id IN (SELECT id FROM listing WHERE is_active)) AS valued,
    (SELECT count(*) FROM listing_valuation WHERE classification = 'under_market' AND listing_id IN (SELECT id FROM listing WHERE is_active)) AS under,
    (SELECT top_share_pct FROM spread) AS top_share, (SELECT coalesce(unknown_share_pct, 0) FROM spread) AS unknown_share,
    (SELECT avg(median_first_to_last_price_change_pct) FROM newest WHERE rn = 1) AS cur_change,
    (cur_count - prev_count) / nullif(prev_count, 0)::DOUBLE * 100 AS d_count, (cur_dom - prev_dom) / nullif(prev_dom, 0) * 100 AS d_dom,
    (cur_drop - prev_drop) / nullif(prev_drop, 0) * 100 AS d_drop FROM state, pair),
kdrops AS (SELECT (p.price_czk - c.price_czk) / p.price_czk::DOUBLE * 100 AS raw_pct FROM kranked c JOIN kranked p ON p.listing_id = c.listing_id AND c.rn = 1 AND p.rn = 2 WHERE p.price_czk > 0),
kranked AS (SELECT h.listing_id, h.price_czk, row_number() OVER (PARTITION BY h.listing_id ORDER BY h.recorded_at DESC, h.id DESC) AS rn
  FROM price_history h JOIN listing l ON l.id = h.listing_id WHERE l.is_active)"""


def _metric(kpi_name, cur, prev, delta, watch, low):
    return f"""SELECT '{kpi_name}', {cur}, {prev}, {delta}, CASE WHEN {delta} IS NULL THEN 'insufficient_history' WHEN abs({delta}) > 40 THEN 'baseline' ELSE 'trend' END,
  CASE WHEN {delta} IS NOT NULL AND abs({delta}) <= 40 THEN 'medium' ELSE 'low' END,
  CASE WHEN {delta} IS NULL THEN CASE WHEN {cur} IS NULL THEN 'unavailable' ELSE 'neutral' END WHEN abs({delta}) > 40 THEN 'unavailable'
    WHEN abs({delta}) < 2 THEN 'stable' WHEN {delta} >= {watch} THEN 'watch' WHEN {delta} <= -{watch} THEN '{low}' ELSE 'neutral' END,
  CASE WHEN {delta} IS NULL THEN 'none' ELSE 'previous_snapshot' END FROM facts"""


def _kpi_sql(state: str) -> str:
    order = [x.strip() for x in [_SLICES, state, _ROLLUP, _NEWEST, _INVENTORY, _SPREAD]]
    facts = _FACTS.split("kdrops AS (SELECT (p.")
    drops = "kdrops AS (SELECT (p." + facts[1].split(",\nkranked AS")[0]
    ranked = "kranked AS" + facts[1].split(",\nkranked AS")[1]
    rows = " UNION ALL ".join([
        """SELECT 'active_listings' AS kpi, active::DOUBLE AS value, CASE WHEN fresh <> 'in_progress' THEN prev_count::DOUBLE END AS previous, CASE WHEN fresh <> 'in_progress' THEN d_count END AS delta_pct,
    CASE WHEN fresh = 'in_progress' THEN 'ingest_dominated' WHEN d_count IS NULL THEN 'insufficient_history' WHEN abs(d_count) > 40 THEN 'baseline' WHEN comp = 'partial' THEN 'informational' ELSE 'trend' END AS state,
    CASE WHEN fresh = 'in_progress' OR d_count IS NULL OR abs(d_count) > 40 OR comp = 'partial' THEN 'low' ELSE 'medium' END AS confidence,
    CASE WHEN fresh = 'in_progress' THEN 'partial' WHEN abs(d_count) > 40 THEN 'unavailable' WHEN d_count IS NULL THEN CASE WHEN comp = 'partial' THEN 'partial' ELSE 'unavailable' END
      WHEN comp = 'partial' THEN 'partial' WHEN abs(d_count) < 2 THEN 'stable' WHEN d_count >= 5 THEN 'watch' WHEN d_count <= -5 THEN 'concern' ELSE 'neutral' END AS sentiment,
    CASE WHEN fresh = 'in_progress' OR d_count IS NULL THEN 'none' ELSE 'previous_snapshot' END AS comparison_kind FROM facts""",
        """SELECT 'new_listings', new_30d, NULL, NULL, CASE WHEN fresh = 'in_progress' OR (active > 0 AND new_30d >= active * 0.8) THEN 'ingest_dominated' ELSE 'trend' END,
    CASE WHEN fresh = 'in_progress' OR (active > 0 AND new_30d >= active * 0.8) THEN 'low' ELSE 'medium' END,
    CASE WHEN fresh = 'in_progress' THEN 'partial' WHEN active > 0 AND new_30d >= active * 0.8 THEN 'neutral' WHEN new_30d - removed_30d > removed_30d * 0.2 AND new_30d > removed_30d THEN 'watch'
      WHEN new_30d < removed_30d AND removed_30d - new_30d > new_30d * 0.2 THEN 'concern' WHEN new_30d = 0 AND removed_30d = 0 THEN 'neutral' ELSE 'stable' END,
    CASE WHEN fresh = 'in_progress' OR (active > 0 AND new_30d >= active * 0.8) THEN 'none' ELSE 'period_flow' END FROM facts""",
        """SELECT 'removed_listings', removed_30d, NULL, NULL, CASE WHEN fresh = 'in_progress' THEN 'ingest_dominated' ELSE 'informational' END,
    CASE WHEN fresh = 'in_progress' OR new_30d + removed_30d = 0 THEN 'low' ELSE 'high' END,
    CASE WHEN fresh = 'in_progress' THEN 'partial' WHEN new_30d + removed_30d = 0 THEN 'neutral' WHEN removed_30d * 100.0 / (new_30d + removed_30d) > 55 THEN 'watch'
      WHEN removed_30d * 100.0 / (new_30d + removed_30d) < 35 THEN 'stable' ELSE 'neutral' END,
    CASE WHEN fresh = 'in_progress' OR new_30d + removed_30d = 0 THEN 'none' ELSE 'share_of_total' END FROM facts""",
        """SELECT 'price_drops', drops / nullif(active, 0)::DOUBLE * 100, NULL, NULL, 'informational', 'high',
    CASE WHEN drops * 100.0 / nullif(active, 0) >= 8 THEN 'watch' WHEN drops * 100.0 / nullif(active, 0) <= 2 THEN 'stable' ELSE 'neutral' END, 'share_of_total' FROM facts""",
        """SELECT 'under_market', under / nullif(valued, 0)::DOUBLE * 100, NULL, NULL, 'informational', CASE WHEN valued = 0 OR valued * 100.0 / active < 80 THEN 'low' ELSE 'high' END,
    CASE WHEN valued = 0 THEN 'unavailable' WHEN valued * 100.0 / active < 80 THEN 'partial' WHEN under * 100.0 / valued >= 25 THEN 'watch' WHEN under * 100.0 / valued <= 10 THEN 'stable' ELSE 'neutral' END,
    CASE WHEN valued = 0 THEN 'none' ELSE 'share_of_total' END FROM facts""",
        """SELECT 'regional_inventory', top_share, NULL, NULL, 'informational', CASE WHEN unknown_share > 15 THEN 'low' ELSE 'high' END,
    CASE WHEN unknown_share > 5 THEN 'watch' ELSE 'neutral' END, 'share_of_total' FROM facts""",
        """SELECT 'detail_coverage', with_detail / nullif(active, 0)::DOUBLE * 100, NULL, NULL, 'informational',
    CASE WHEN with_detail * 100.0 / active >= 90 THEN 'high' WHEN with_detail * 100.0 / active >= 70 THEN 'medium' ELSE 'low' END,
    CASE WHEN with_detail * 100.0 / active >= 90 THEN 'healthy' WHEN with_detail * 100.0 / active >= 70 THEN 'watch' ELSE 'concern' END, 'share_of_total' FROM facts""",
        _metric("median_dom", "cur_dom", "prev_dom", "d_dom", 10, "healthy"),
        _metric("drop_share", "cur_drop", "prev_drop", "d_drop", 15, "healthy"),
        _metric("price_change", "cur_change", "NULL::DOUBLE", "NULL::DOUBLE", 5, "concern"),
        """SELECT 'latest_drop_share', cur_drop, NULL, NULL, 'informational', CASE WHEN cur_drop IS NULL THEN 'low' ELSE 'high' END, 'neutral', 'none' FROM facts""",
    ])
    return with_views(
        f"SELECT kpi, round(value, 6) AS value, round(previous, 6) AS previous, round(delta_pct, 6) AS delta_pct, state, confidence, sentiment, comparison_kind FROM ({rows})",
        *order, ranked, drops, facts[0].rstrip().rstrip(","))


def _kpis(t, runs, snapshots):
    return kpi.kpi_table(t.listing, t.listing_detail, t.listing_valuation, t.listing_anomaly, snapshots, runs, t.price_history, AS_OF, MIN_ITEMS)


@query("kpi_table", _kpi_sql(_STATE))
def _(t):
    return _kpis(t, t.scraping_run, t.analytic_snapshot)


@query("kpi_table_final", _kpi_sql(_STATE.replace("status = 'running'", "false")))
def _(t):
    return _kpis(t, _finished(t), t.analytic_snapshot)


@query("period_change", with_views(
    """SELECT snapshot_date, round(d, 6) AS delta_pct, CASE WHEN d IS NULL THEN 'insufficient_history' WHEN abs(d) > 40 THEN 'baseline' ELSE 'trend' END AS state,
    CASE WHEN d IS NOT NULL AND abs(d) <= 40 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN abs(d) < 2 THEN 'stable' WHEN d >= 5 THEN 'watch' WHEN d <= -5 THEN 'concern' ELSE 'neutral' END AS sentiment
    FROM (SELECT snapshot_date, (listing_count - p) / nullif(p, 0)::DOUBLE * 100 AS d FROM
      (SELECT *, lag(listing_count) OVER (PARTITION BY day(snapshot_date) ORDER BY snapshot_date) AS p FROM rollup_dates))""", _ROLLUP))
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy(F.day("snapshot_date")).orderBy("snapshot_date")
    rows = agg.snapshot_rollup(t.analytic_snapshot).withColumn("p", F.lag("listing_count").over(w))
    change = kpi.period_change(F.col("listing_count"), F.col("p"))
    return rows.select(
        "snapshot_date", *[c.alias(n) for n, c in change.items()], kpi.delta_sentiment(change["delta_pct"], 5, concern=-5).alias("sentiment"))
