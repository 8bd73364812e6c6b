"""Listing reads, projections, joins, sorts, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import AS_OF as NOW, case_of, with_views
from hearthline.functions import codebooks as cb
from hearthline.functions import urls
from hearthline.operators import history as hist
from hearthline.operators import listings as ops
from hearthline.operators.suggest import location_suggest
from hearthline.operators.textindex import COLUMNS as SEARCHED, PlaceIndex, TrigramIndex, search_listings
from hearthline.session import cut_lineage, shared_folder
from hearthline.sources.adapter import AS_OF
from hearthline.sources.layout import clustered
from hearthline.sources.tables import scan_table, write_table

_JOINED = """
joined AS (
  SELECT l.*, d.* EXCLUDE (id, listing_id), d.listing_id AS detail_listing_id,
    o.region AS location_region, o.district, o.municipality, o.quarter
  FROM listing l LEFT JOIN listing_detail d ON d.listing_id = l.id LEFT JOIN location o ON o.id = l.location_id)"""

_FIRST = """
first_records AS (
  SELECT listing_id, count(*) AS n, first(price_czk ORDER BY recorded_at, id) AS first_price FROM price_history GROUP BY 1),
drop_ids AS (
  SELECT l.id AS drop_id FROM listing l JOIN first_records f ON f.listing_id = l.id WHERE f.n >= 2 AND l.price_czk < f.first_price)"""


def dom_sql(end: str = "removed_at") -> str:
    return f"(epoch_us(coalesce({end}, {NOW})) - epoch_us(first_seen_at)) / 86400000000.0::DOUBLE"


# Written out: the twin does not use the table of the code under test.
_SLUGS = """CASE {0} WHEN 2 THEN '1+kk' WHEN 3 THEN '1+1' WHEN 4 THEN '2+kk' WHEN 5 THEN '2+1' WHEN 6 THEN '3+kk' WHEN 7 THEN '3+1' WHEN 8 THEN '4+kk' WHEN 9 THEN '4+1'
  WHEN 10 THEN '5+kk' WHEN 11 THEN '5+1' WHEN 12 THEN '6-pokoju-a-vice' WHEN 16 THEN 'atypicke' WHEN 19 THEN 'stavebni-parcela' WHEN 23 THEN 'zahrada' WHEN 33 THEN 'chata'
  WHEN 36 THEN 'jine-nemovitosti' WHEN 37 THEN 'rodinny' WHEN 39 THEN 'vila' WHEN 47 THEN 'pronajem-pokoje' END"""


URL_SQL = f"""CASE WHEN source_url IS NOT NULL AND source_url <> '' AND NOT contains(source_url, '{urls.API_MARKERS[0]}')
    AND NOT contains(source_url, '{urls.API_MARKERS[1]}') THEN source_url
  ELSE '{urls.DEFAULT_HOST}/detail/' || {case_of(urls.DEAL_SLUGS, 'category_type_cb', "'prodej'")} || '/'
    || {case_of(urls.PROPERTY_SLUGS, 'category_main_cb', "'ostatni'")} || '/'
    || coalesce({_SLUGS.format('category_sub_cb')}, nullif(lower(regexp_extract(title, '(\\S*\\+\\S*)', 1)), ''), 'ostatni')
    || '/detail/' || hash_id END"""


def label_sql(book: dict, column: str) -> str:
    return f"CASE WHEN {column} <> '' THEN coalesce({case_of(book, f'TRY_CAST({column} AS INTEGER)')}, {column}) END"


def _filtered(t, **criteria):
    return ops.filter_listings(t.listing, t.listing_detail, t.location, t.price_history, ops.ListingCriteria(**criteria), AS_OF)


_ID = "SELECT id, hash_id, price_czk, usable_area, district FROM joined WHERE "


def _thin(df):
    return df.select("id", "hash_id", "price_czk", "usable_area", "district")


# (name, criteria, SQL condition)
_FILTERS = [
    ("filter_default_active", {}, "is_active"),
    ("filter_codes", dict(category_main_cb=1, category_type_cb=2, ownership="1", building_type="2"),
     "is_active AND category_main_cb = 1 AND category_type_cb = 2 AND ownership = '1' AND building_type = '2'"),
    ("filter_codes_hits", dict(category_main_cb=1, ownership="1", building_type="6"),
     "is_active AND category_main_cb = 1 AND ownership = '1' AND building_type = '6'"),
    ("filter_codes_detail", dict(is_active=None, category_sub_cb=4, building_condition="3", energy_efficiency_rating="5"),
     "category_sub_cb = 4 AND building_condition = '3' AND energy_efficiency_rating = '5'"),
    ("filter_equipment", dict(furnished="1", elevator="2", seller_type="soukroma_osoba"),
     "is_active AND furnished = '1' AND elevator = '2' AND seller_type = 'soukroma_osoba'"),
    ("filter_ranges", dict(price_min=20000, price_max=60000, usable_area_min=40, usable_area_max=90, floor_area_min=50, floor_area_max=90,
                           floor_number_min=1, floor_number_max=6),
     "is_active AND price_czk BETWEEN 20000 AND 60000 AND usable_area BETWEEN 40 AND 90 AND floor_area BETWEEN 50 AND 90 AND floor_number BETWEEN 1 AND 6"),
    ("filter_land_range", dict(land_area_min=200, land_area_max=600), "is_active AND land_area BETWEEN 200 AND 600"),
    ("filter_price_per_m2", dict(price_per_m2_min=500.5, price_per_m2_max=1200),
     "is_active AND price_czk / nullif(usable_area, 0)::DOUBLE >= 500.5 AND price_czk / nullif(usable_area, 0)::DOUBLE <= 1200"),
    ("filter_booleans", dict(balcony=False, terrace=False, cellar=True, is_active=None), "NOT balcony AND NOT terrace AND cellar"),
    ("filter_garage_garden", dict(garage=True, garden=False), "is_active AND garage AND NOT garden"),
    ("filter_has_parking", dict(has_parking=True), "is_active AND coalesce(parking_lots, 0) > 0"),
    ("filter_no_parking", dict(has_parking=False), "is_active AND coalesce(parking_lots, 0) = 0"),
    ("filter_days_on_market", dict(days_on_market_min=400, days_on_market_max=1500),
     f"is_active AND {dom_sql()} >= 400 AND {dom_sql()} <= 1500"),
    ("filter_inactive_days", dict(is_active=False, days_on_market_max=300), f"NOT is_active AND {dom_sql()} <= 300"),
    ("filter_price_drop", dict(has_price_drop=True), "is_active AND id IN (SELECT drop_id FROM drop_ids)"),
    ("filter_no_price_drop", dict(has_price_drop=False, category_main_cb=2), "is_active AND category_main_cb = 2 AND id NOT IN (SELECT drop_id FROM drop_ids)"),
    ("text_search", dict(search=" čtvrť 3 "),
     "is_active AND (coalesce(title ILIKE '%čtvrť 3%', false) OR coalesce(locality_text ILIKE '%čtvrť 3%', false) OR coalesce(resolved_region_name ILIKE '%čtvrť 3%', false) "
     "OR coalesce(location_region ILIKE '%čtvrť 3%', false) OR coalesce(district ILIKE '%čtvrť 3%', false) OR coalesce(municipality ILIKE '%čtvrť 3%', false) OR coalesce(quarter ILIKE '%čtvrť 3%', false))"),
    ("filter_region", dict(region="KRAJ VYSO"),
     "is_active AND (coalesce(coalesce(resolved_region_name, location_region) ILIKE '%kraj vyso%', false) OR coalesce(district ILIKE '%kraj vyso%', false) OR coalesce(locality_text ILIKE '%kraj vyso%', false))"),
    ("filter_district", dict(district="nation_1"),
     "is_active AND (contains(lower(coalesce(district, '')), 'nation_1') OR contains(lower(coalesce(quarter, '')), 'nation_1') OR contains(lower(coalesce(municipality, '')), 'nation_1') OR contains(lower(coalesce(locality_text, '')), 'nation_1'))"),
    ("filter_city", dict(city="house"),
     "is_active AND (coalesce(municipality ILIKE '%house%', false) OR coalesce(quarter ILIKE '%house%', false) OR coalesce(district ILIKE '%house%', false) OR coalesce(locality_text ILIKE '%house%', false))"),
]

@query("text_search_indexed", with_views(_ID + dict((n, w) for n, _, w in _FILTERS)["text_search"], _JOINED.strip()))
def text_search_indexed(t):
    """The rows of ``text_search``, found by trigrams."""
    joined = ops.joined_listings(t.listing, t.listing_detail, t.location)
    index = TrigramIndex(t.spark, shared_folder(t.spark, "trigrams"))
    index.build(joined, "id", SEARCHED)
    return _thin(search_listings(index, joined.where("is_active"), " čtvrť 3 "))


for _name, _criteria, _where in _FILTERS:
    query(_name, with_views(_ID + _where, _JOINED.strip(), _FIRST.strip()))(lambda t, c=_criteria: _thin(_filtered(t, **c)))


@query("table_scan_listing", with_views("SELECT * REPLACE (round(gps_lat, 6) AS gps_lat, round(gps_lon, 6) AS gps_lon) FROM listing"))
def _(t):
    return t.listing


@query("table_scan_detail", with_views("SELECT * FROM listing_detail"))
def _(t):
    return t.listing_detail.drop("meta_description", "no_barriers", "start_of_offer")


@query("table_scan_location", with_views("SELECT * FROM location"))
def _(t):
    return t.location.select("id", "region", "district", "municipality", "quarter", "country", "locality_region_id")


@query("joined_listings", with_views(
    "SELECT id, detail_listing_id, usable_area, location_region, district, municipality, quarter FROM joined", _JOINED.strip()))
def _(t):
    return ops.joined_listings(t.listing, t.listing_detail, t.location).select(
        "id", "detail_listing_id", "usable_area", "location_region", "district", "municipality", "quarter")


_PAGES = [
    ("page_default", {}, "last_seen_at DESC NULLS FIRST"),
    ("page_price_desc", dict(sort_by="price_czk"), "price_czk DESC NULLS FIRST"),
    ("page_price_asc", dict(sort_by="price_czk", sort_dir="asc"), "price_czk ASC NULLS LAST"),
    ("page_area_asc", dict(sort_by="usable_area", sort_dir="asc", page=3), "usable_area ASC NULLS LAST"),
    ("page_per_m2_desc", dict(sort_by="price_per_m2", page=2), "price_czk / nullif(usable_area, 0)::DOUBLE DESC NULLS FIRST"),
    ("page_first_seen_asc", dict(sort_by="first_seen_at", sort_dir="asc"), "first_seen_at ASC NULLS LAST"),
    ("page_days_on_market", dict(sort_by="days_on_market"), f"{dom_sql()} DESC NULLS FIRST"),
]
for _name, _args, _order in _PAGES:
    _offset = (_args.get("page", 1) - 1) * 50
    query(_name, with_views(
        f"SELECT id, hash_id, price_czk, usable_area, district FROM joined WHERE is_active ORDER BY {_order}, id LIMIT 50 OFFSET {_offset}", _JOINED.strip(),
    ))(lambda t, a=_args: _thin(ops.page(_filtered(t), AS_OF, **a)))


@query("page_total", with_views("SELECT count(*) AS total FROM joined WHERE is_active", _JOINED.strip()))
def _(t):
    return ops.total(_filtered(t))


_READ_SQL = f"""
SELECT id, hash_id, title, category_main_cb, category_type_cb, category_sub_cb, price_czk, round(gps_lat, 6) AS gps_lat, round(gps_lon, 6) AS gps_lon, is_active,
  first_seen_at, last_seen_at, last_updated_at, removed_at, locality_text, seller_type, usable_area, floor_area, land_area,
  floor, floor_number, total_floors, balcony, terrace, cellar, garage, garden, parking_lots, district,
  {label_sql(cb.OWNERSHIP, 'ownership')} AS ownership, {label_sql(cb.BUILDING_TYPE, 'building_type')} AS building_type,
  {label_sql(cb.BUILDING_CONDITION, 'building_condition')} AS building_condition,
  {label_sql(cb.ENERGY_RATING, 'energy_efficiency_rating')} AS energy_efficiency_rating,
  {label_sql(cb.FURNISHED, 'furnished')} AS furnished, {label_sql(cb.ELEVATOR, 'elevator')} AS elevator,
  round_even(nullif(price_czk, 0) / nullif(usable_area, 0)::DOUBLE, 0) AS price_per_m2,
  {URL_SQL} AS source_url,
  coalesce(nullif(resolved_region_name, ''), location_region) AS region, municipality AS city,
  CAST(greatest(0, floor({dom_sql()})) AS INTEGER) AS days_on_market,
  greatest(0, coalesce(f.n, 0) - 1) AS price_change_count,
  coalesce(f.n >= 2 AND price_czk < f.first_price, false) AS has_price_drop,
  coalesce(i.images, 0) AS image_count, length(nullif(description, '')) AS description_length
FROM joined LEFT JOIN first_records f ON f.listing_id = joined.id
LEFT JOIN (SELECT listing_id, count(*) AS images FROM image GROUP BY 1) i ON i.listing_id = joined.id
"""


@query("listing_read", with_views(_READ_SQL + "WHERE is_active", _JOINED.strip(), _FIRST.strip()))
def _(t):
    return ops.listing_read(_filtered(t), t.price_history, t.image, AS_OF)


_READ_PAGE = _READ_SQL + "WHERE is_active AND category_main_cb = 1 ORDER BY price_czk DESC NULLS FIRST, joined.id LIMIT 50"


@query("listing_read_page", with_views(_READ_PAGE, _JOINED.strip(), _FIRST.strip()))
def _(t):
    rows = ops.page(_filtered(t, category_main_cb=1), AS_OF, "price_czk")
    return ops.listing_read(rows, t.price_history, t.image, AS_OF, few=True)


_RAW_SQL = f"""
SELECT id, hash_id, title, category_main_cb, category_type_cb, category_sub_cb, price_czk, price_czk_unit, currency, round(gps_lat, 6) AS gps_lat, round(gps_lon, 6) AS gps_lon, locality_text, seller_type, is_active, first_seen_at, last_seen_at, removed_at, usable_area, floor_area, land_area,
  built_up_area, floor, floor_number, total_floors, material, balcony, terrace, loggia, cellar, garage, garden, parking_lots,
  broker_company, note_about_price, last_updated_at, resolved_region_name, resolved_region_id, region_source,
  region_unknown_reason, district, municipality, ownership AS ownership_cb, building_type AS building_type_cb,
  building_condition AS building_condition_cb, object_kind AS object_kind_cb,
  energy_efficiency_rating AS energy_efficiency_rating_cb, furnished AS furnished_cb, elevator AS elevator_cb,
  {URL_SQL} AS source_url, coalesce(nullif(resolved_region_name, ''), location_region) AS region,
  '{ops.DEFAULT_METHOD}' AS metoda_sberu, '{ops.DEFAULT_SOURCE}' AS zdroj
FROM joined"""


@query("raw_listing_row", with_views(_RAW_SQL, _JOINED.strip()))
def _(t):
    return ops.raw_listing_row(_filtered(t, is_active=None))


@query("export_limited", with_views("SELECT id, last_seen_at FROM listing WHERE is_active ORDER BY last_seen_at DESC, id LIMIT 100"))
def _(t):
    return ops.export_rows(_filtered(t), 100)[0].select("id", "last_seen_at")


@query("export_metadata", with_views(
    "SELECT count(*) AS total_matched, least(count(*), 100) AS returned_rows, count(*) > 100 AS truncated FROM listing WHERE is_active"))
def _(t):
    return ops.export_rows(_filtered(t), 100)[1]


_MARKER = f"SELECT id, round(gps_lat, 6) AS gps_lat, round(gps_lon, 6) AS gps_lon, price_czk, title, category_main_cb, category_type_cb, {URL_SQL} AS source_url FROM listing WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL"


@query("map_markers", with_views(_MARKER + " AND is_active"))
def _(t):
    return ops.map_markers(t.listing)


@query("map_markers_box", with_views(_MARKER + " AND is_active AND gps_lat >= 49.0 AND gps_lat <= 50.0 AND gps_lon >= 13.0 AND gps_lon <= 14.5"))
def _(t):
    return ops.map_markers(t.listing, 49.0, 13.0, 50.0, 14.5)


@query("map_markers_clustered", with_views(_MARKER + " AND is_active AND gps_lat >= 49.0 AND gps_lat <= 50.0 AND gps_lon >= 13.0 AND gps_lon <= 14.5"))
def _(t):
    """The window of ``map_markers_box`` on listings stored in Z-order of place and price."""
    root = shared_folder(t.spark, "clustered")
    write_table(clustered(t.listing, ["gps_lat", "gps_lon", "price_czk"], 16), root, "listing")
    return ops.map_markers(scan_table(t.spark, root, "listing"), 49.0, 13.0, 50.0, 14.5)


@query("map_markers_half_box", with_views(_MARKER + " AND NOT is_active AND gps_lat >= 50.0"))
def _(t):
    return ops.map_markers(t.listing, south=50.0, is_active=False)


_DROPS = """
ranked AS (
  SELECT h.listing_id, h.price_czk, row_number() OVER (PARTITION BY h.listing_id ORDER BY h.recorded_at DESC, h.id DESC) AS rn
  FROM price_history h JOIN listing l ON l.id = h.listing_id WHERE l.is_active),
drops AS (
  SELECT l.id AS listing_id, l.title, p.price_czk AS previous_price_czk, c.price_czk AS current_price_czk,
    (p.price_czk - c.price_czk) / p.price_czk::DOUBLE * 100 AS raw_pct
  FROM listing l JOIN ranked c ON c.listing_id = l.id AND c.rn = 1 JOIN ranked p ON p.listing_id = l.id AND p.rn = 2
  WHERE p.price_czk > 0)"""
_DROP_COLS = "SELECT listing_id, title, previous_price_czk, current_price_czk, round_even(raw_pct, 1) AS drop_pct FROM drops"


@query("price_drops", with_views(_DROP_COLS + " WHERE raw_pct >= 5.0", _DROPS.strip()))
def price_drops(t):
    return ops.price_drops(t.listing, t.price_history)


@query("price_drops_top", with_views(_DROP_COLS + " WHERE raw_pct >= 10.0 ORDER BY raw_pct DESC, listing_id LIMIT 25", _DROPS.strip()))
def _(t):
    return ops.price_drops(t.listing, t.price_history, 10.0, 25)


@query("latest_two_prices", with_views(
    """SELECT c.listing_id, c.price_czk AS current_price_czk, p.price_czk AS previous_price_czk FROM r c JOIN r p ON p.listing_id = c.listing_id
    WHERE c.rn = 1 AND p.rn = 2""",
    "r AS (SELECT listing_id, price_czk, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC, id DESC) AS rn FROM price_history)"))
def _(t):
    return hist.latest_two(t.price_history)


@query("first_price_and_count", with_views("SELECT * FROM first_records", _FIRST.strip()))
def _(t):
    return hist.first_and_count(t.price_history)


FEATURES_SQL = f"""
steps AS (
  SELECT listing_id, price_czk, recorded_at, id,
    lag(price_czk) OVER w AS prev, lag(recorded_at) OVER w AS prev_at
  FROM price_history WINDOW w AS (PARTITION BY listing_id ORDER BY recorded_at, id)),
features AS (
  SELECT listing_id, CAST(count(*) AS BIGINT) AS n, first(price_czk ORDER BY recorded_at, id) AS first_price,
    first(price_czk ORDER BY recorded_at DESC, id DESC) AS last_price,
    first(prev ORDER BY recorded_at DESC, id DESC) AS prev_price,
    bool_or(coalesce(price_czk < prev, false)) AS any_drop,
    bool_or(coalesce(price_czk < prev AND prev_at >= {NOW} - INTERVAL 90 DAY, false)) AS drop_90d,
    max(abs((price_czk - prev) / nullif(prev, 0)::DOUBLE) * 100) AS max_step_pct
  FROM steps GROUP BY 1)"""


@query("history_features", with_views(
    """SELECT listing_id, n, first_price, last_price, prev_price, any_drop, drop_90d, round(max_step_pct, 6) AS max_step_pct,
    round(CASE WHEN n >= 2 THEN (last_price - first_price) / nullif(first_price, 0)::DOUBLE * 100 END, 6) AS change_pct FROM features""",
    FEATURES_SQL.strip()))
def _(t):
    return hist.history_features(t.price_history, AS_OF)


@query("history_folded", with_views(
    """SELECT listing_id, n, first_price, last_price, prev_price, any_drop, drop_90d, round(max_step_pct, 6) AS max_step_pct,
    round(CASE WHEN n >= 2 THEN (last_price - first_price) / nullif(first_price, 0)::DOUBLE * 100 END, 6) AS change_pct FROM features""",
    FEATURES_SQL.strip()))
def _(t):
    """Summaries of the oldest records, then of two later stretches, then of records that come late, folded in one after the other."""
    history = t.price_history
    first, last = history.agg(F.min("recorded_at"), F.max("recorded_at")).first()
    middle, late = first + (last - first) / 2, F.col("id") % 97 == 0
    early = F.col("recorded_at") < middle
    parts = [early & ~late, ~early & (F.col("recorded_at") < middle + (last - middle) / 2) & ~late, (F.col("recorded_at") >= middle + (last - middle) / 2) & ~late, late]
    summary, seen = hist.history_summary(history.where(parts[0])), parts[0]
    for part in parts[1:]:
        seen = seen | part
        summary = cut_lineage(hist.update_summary(summary, history.where(part), history.where(seen)), "summary")
    return hist.features_of(summary, AS_OF)


@query("recent_drop_ids", with_views(
    "SELECT DISTINCT listing_id FROM slice WHERE price_czk < prev",
    f"""slice AS (SELECT listing_id, price_czk, lag(price_czk) OVER (PARTITION BY listing_id ORDER BY recorded_at, id) AS prev
    FROM price_history WHERE recorded_at >= {NOW} - INTERVAL 400 DAY)"""))
def _(t):
    return hist.history_features(t.price_history, AS_OF, 400).where("drop_90d").select("listing_id")


@query("price_evolution", with_views(
    f"""SELECT listing_id, price_czk, recorded_at FROM price_history WHERE recorded_at >= {NOW} - INTERVAL 900 DAY
    AND listing_id IN (SELECT id FROM listing WHERE category_main_cb = 1)"""))
def _(t):
    ids = t.listing.where("category_main_cb = 1").select(F.col("id").alias("listing_id"))
    return hist.price_evolution(t.price_history, ids, AS_OF, 900)


@query("listing_documents", with_views(
    """SELECT l.id, l.title, d.description, d.broker_company FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active
    UNION ALL SELECT l.id, l.title, NULL, NULL FROM listing l WHERE l.is_active AND l.id NOT IN (SELECT listing_id FROM listing_detail)"""))
def _(t):
    return ops.listing_documents(_filtered(t), t.price_history, t.image, AS_OF)[0].select("id", "title", "description", "broker_company")


@query("listing_document_items", with_views(
    """SELECT listing_id, 'image' AS kind, row_number() OVER (PARTITION BY listing_id ORDER BY position, id) - 1 AS position, url, NULL::BIGINT AS price_czk, NULL::TIMESTAMP AS recorded_at
    FROM image WHERE listing_id IN (SELECT id FROM listing WHERE is_active)
    UNION ALL SELECT listing_id, 'price', row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at, id) - 1, NULL, price_czk, recorded_at
    FROM price_history WHERE listing_id IN (SELECT id FROM listing WHERE is_active)"""))
def _(t):
    return ops.listing_documents(_filtered(t), t.price_history, t.image, AS_OF)[1]


@query("missing_details", with_views(
    "SELECT id AS listing_id, hash_id FROM listing WHERE is_active AND id NOT IN (SELECT listing_id FROM listing_detail)"))
def _(t):
    return ops.missing_details(t.listing, t.listing_detail)


_VAL_COLS = """listing_id, round(expected_price_czk, 8) AS expected_price_czk, round(expected_price_per_m2, 8) AS expected_price_per_m2,
  round(residual_absolute, 8) AS residual_absolute, round(residual_percent, 8) AS residual_percent, classification, confidence"""
_ACTIVE = "listing_id IN (SELECT id FROM listing WHERE is_active)"


@query("valuation_list", with_views(
    f"SELECT {_VAL_COLS} FROM listing_valuation WHERE {_ACTIVE} AND classification = 'under_market' AND confidence IN ('medium', 'high')"), digits=8)
def _(t):
    return ops.valuation_list(t.listing, t.listing_valuation, "under_market", "medium")


@query("valuation_list_page", with_views(
    f"SELECT {_VAL_COLS} FROM listing_valuation WHERE {_ACTIVE} ORDER BY listing_valuation.residual_percent, listing_id LIMIT 40 OFFSET 20"), digits=8)
def _(t):
    return ops.valuation_list(t.listing, t.listing_valuation, limit=40, offset=20)


_ANO_COLS = "listing_id, anomaly_score, nullif(array_to_string(anomaly_flags, ', '), '') AS anomaly_flags, round(confidence_score, 6) AS confidence_score"


def _flat(df):
    return df.withColumn("anomaly_flags", F.nullif(F.array_join("anomaly_flags", ", "), F.lit("")))


@query("anomaly_list", with_views(f"SELECT {_ANO_COLS} FROM listing_anomaly WHERE {_ACTIVE} AND anomaly_score >= 20"))
def _(t):
    return _flat(ops.anomaly_list(t.listing, t.listing_anomaly, 20))


@query("anomaly_list_flag", with_views(
    f"SELECT {_ANO_COLS} FROM listing_anomaly WHERE {_ACTIVE} AND list_contains(listing_anomaly.anomaly_flags, 'stale_listing') ORDER BY anomaly_score DESC, listing_id LIMIT 30 OFFSET 10"))
def _(t):
    return _flat(ops.anomaly_list(t.listing, t.listing_anomaly, 0, "stale_listing", 30, 10))


_EXPORT_SQL = f"""
SELECT l.id AS listing_id, l.hash_id, l.title, l.price_czk, round(v.expected_price_czk, 8) AS expected_price_czk,
  round(v.expected_price_per_m2, 8) AS expected_price_per_m2, round(v.residual_absolute, 8) AS residual_absolute,
  round(v.residual_percent, 8) AS residual_percent, v.classification, v.confidence AS valuation_confidence, a.anomaly_score,
  nullif(array_to_string(a.anomaly_flags, ', '), '') AS anomaly_flags, round(a.confidence_score, 8) AS anomaly_confidence,
  {URL_SQL} AS source_url, '{ops.DEFAULT_METHOD}' AS metoda_sberu, '{ops.DEFAULT_SOURCE}' AS zdroj
FROM listing l LEFT JOIN listing_valuation v ON v.listing_id = l.id LEFT JOIN listing_anomaly a ON a.listing_id = l.id
WHERE l.is_active"""


@query("valuation_export", with_views(_EXPORT_SQL), digits=8)
def _(t):
    return ops.valuation_export(t.listing, t.listing_valuation, t.listing_anomaly)


@query("valuation_export_filtered", with_views(_EXPORT_SQL + " AND v.classification = 'over_market' AND a.anomaly_score >= 30"), digits=8)
def _(t):
    return ops.valuation_export(t.listing, t.listing_valuation, t.listing_anomaly, "over_market", 30)


@query("page_after_key", with_views(
    "SELECT id, price_czk FROM listing WHERE is_active ORDER BY price_czk DESC NULLS FIRST, id LIMIT 50 OFFSET 150"))
def _(t):
    """Fourth page by price, each found from the last row of the one before."""
    rows, last = _filtered(t), None
    for _ in range(3):
        last = tuple(ops.page_after(rows, AS_OF, last, "price_czk").select("sort_key", "id").collect()[-1])
    return ops.page_after(rows, AS_OF, last, "price_czk").select("id", "price_czk")


@query("valuation_list_rest", with_views("SELECT v.listing_id FROM listing_valuation v JOIN listing l ON l.id = v.listing_id WHERE l.is_active ORDER BY residual_percent NULLS LAST, listing_id OFFSET 25"))
def _(t):
    return ops.valuation_list(t.listing, t.listing_valuation, offset=25).select("listing_id")


@query("map_markers_limited", with_views("SELECT count(*) AS total, least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM listing WHERE is_active AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL"))
def _(t):
    return ops.limited_markers(ops.map_markers(t.listing), 100)[1].select(F.col("total"), F.col("returned").cast("bigint").alias("returned"), "truncated")


@query("newest_runs", with_views("SELECT id, run_type, status, started_at, items_seen FROM scraping_run ORDER BY started_at DESC, id DESC"))
def _(t):
    return ops.newest_runs(t.scraping_run).select("id", "run_type", "status", "started_at", "items_seen")


def _suggest_sql(q: str, limit: int, per: int) -> str:
    return with_views(
        f"""SELECT label, kind, CASE WHEN target = 'region' THEN label END AS region, CASE WHEN target = 'district' THEN label END AS district,
        CASE WHEN target = 'city' THEN label END AS city, CASE WHEN target = 'search' THEN label END AS search
        FROM (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY src, label) AS rn FROM labels_all) WHERE rn = 1
        ORDER BY rank, length(label), label LIMIT {limit}""",
        _JOINED.strip(),
        "labels_all AS (" + " UNION ALL ".join(
            f"(SELECT label, '{kind}' AS kind, '{target}' AS target, {rank} AS rank, {i} AS src FROM (SELECT DISTINCT {expr} AS label FROM joined WHERE is_active) WHERE label ILIKE '%{q}%' ORDER BY label LIMIT {per})"
            for i, (kind, target, rank, expr) in enumerate([
                ("kraj", "region", 4, "coalesce(resolved_region_name, location_region)"), ("okres", "district", 1, "district"), ("obec", "city", 2, "municipality"),
                ("ctvrt", "search", 0, "quarter"), ("lokalita", "search", 3, "locality_text")])) + ")")


@query("location_suggest", _suggest_sql("er", 15, 5))
def _(t):
    return location_suggest(t.listing, t.location, "er")


@query("location_suggest_places", _suggest_sql("obec 1", 60, 20))
def _(t):
    return location_suggest(t.listing, t.location, " obec 1 ", 60, kind_quota=20)


@query("location_suggest_indexed", _suggest_sql("obec 1", 60, 20))
def _(t):
    index = PlaceIndex(t.spark, shared_folder(t.spark, "places"))
    index.build(t.listing, t.location)
    return index.suggest(" obec 1 ", 60, 20)
