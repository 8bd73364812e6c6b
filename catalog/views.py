"""The derived listing tables once more, as SQL text."""

from __future__ import annotations

from hearthline.functions.codebooks import REGION_NAMES

AS_OF = "TIMESTAMP '2001-12-01 00:00:00'"


def case_of(codebook: dict, expr: str, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in codebook.items())
    return f"CASE {expr} {arms} ELSE {default} END"


_MAIN = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"
_TYPE = "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END"

PRICE_HISTORY = """
price_history AS (
  SELECT CAST(l_linenumber AS BIGINT) * 1000000000000000000 + l_partkey * 100000000000
           + CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 + l_suppkey % 1000 AS id,
         l_orderkey AS listing_id, CAST(floor(l_extendedprice) AS BIGINT) AS price_czk,
         l_shipdate AS recorded_at
  FROM lineitem)"""

LISTING = f"""
shipped AS (
  SELECT listing_id AS ship_key, min(recorded_at) AS min_ship, max(recorded_at) AS max_ship,
         first(price_czk ORDER BY recorded_at DESC, id DESC) AS last_price
  FROM price_history GROUP BY 1),
listing AS (
  SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS hash_id,
    {_MAIN} AS category_main_cb, {_TYPE} AS category_type_cb,
    CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 2 + o_orderkey % 11 END AS INTEGER) AS category_sub_cb,
    o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title,
    CAST(CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN 0
         ELSE coalesce(last_price, CAST(floor(o_totalprice) AS BIGINT)) END AS BIGINT) AS price_czk,
    CASE WHEN o_orderstatus = 'O' THEN 'za měsíc' ELSE 'za nemovitost' END AS price_czk_unit,
    'CZK' AS currency,
    CASE WHEN o_orderkey % 31 = 0 THEN NULL
         ELSE 'Obec ' || CAST(o_custkey % 40 AS VARCHAR) || ' - Čtvrť ' || CAST(o_custkey % 9 AS VARCHAR) END AS locality_text,
    CASE o_orderkey % 3 WHEN 0 THEN 'realitni_kancelar' WHEN 1 THEN 'soukroma_osoba' END AS seller_type,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         ELSE 48.6::DOUBLE + (o_custkey * 7919 % 211) / 100.0::DOUBLE + 0.005::DOUBLE END AS gps_lat,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL
         ELSE 12.2::DOUBLE + (o_custkey * 104729 % 307) / 100.0::DOUBLE + 0.005::DOUBLE END AS gps_lon,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS location_id,
    o_orderkey % 7 <> 0 AS is_active,
    least(o_orderdate, min_ship) AS first_seen_at,
    coalesce(max_ship, o_orderdate) AS last_seen_at,
    CASE WHEN o_orderkey % 7 = 0 THEN coalesce(max_ship, o_orderdate) END AS removed_at,
    CASE WHEN o_orderkey % 29 = 0 THEN 'https://portal.example/offer/' || CAST(o_orderkey AS VARCHAR)
         WHEN o_orderkey % 31 = 0 THEN 'https://portal.example/api/v1/estates/' || CAST(o_orderkey AS VARCHAR) END AS source_url,
    CAST(CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1 + o_custkey % 14 END AS INTEGER) AS resolved_region_id,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {case_of(REGION_NAMES, '1 + o_custkey % 14')} END AS resolved_region_name,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'unknown'
         WHEN o_orderkey % 3 = 0 THEN 'detail' WHEN o_orderkey % 3 = 1 THEN 'locality_region_id' ELSE 'gps_polygon' END AS region_source,
    CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 19 = 0 THEN
         CASE o_orderkey % 3 WHEN 0 THEN 'missing_gps' WHEN 1 THEN 'polygon_miss' END END AS region_unknown_reason
  FROM orders LEFT JOIN shipped ON o_orderkey = ship_key)"""


def _flag(m: int) -> str:
    return f"CASE WHEN o_orderkey % {m} = 0 THEN NULL ELSE o_orderkey % {m} = 1 END"


DETAIL = f"""
listing_detail AS (
  SELECT o_orderkey AS id, o_orderkey AS listing_id,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Popis nabídky ' || CAST(o_orderkey AS VARCHAR) END AS description,
    CAST(CASE WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 0 ELSE 8 + o_orderkey % 120 END AS INTEGER) AS usable_area,
    CAST(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 13 + o_orderkey % 120 END AS INTEGER) AS floor_area,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN 20 + o_orderkey % 200 END AS INTEGER) AS built_up_area,
    CAST(CASE WHEN {_MAIN} IN (2, 3) THEN 100 + o_orderkey % 900 END AS INTEGER) AS land_area,
    CAST(o_orderkey % 9 AS VARCHAR) || '/9' AS floor,
    CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 9 END AS INTEGER) AS floor_number,
    9 AS total_floors,
    CAST(1 + o_orderkey % 5 AS VARCHAR) AS ownership,
    CAST(1 + o_orderkey % 10 AS VARCHAR) AS building_type,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 11 AS VARCHAR) END AS building_condition,
    CASE WHEN o_orderkey % 2 = 0 THEN 'beton' END AS material,
    CAST(1 + o_orderkey % 5 AS VARCHAR) AS object_kind,
    CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 9 AS VARCHAR) END AS energy_efficiency_rating,
    CAST(1 + o_orderkey % 4 AS VARCHAR) AS furnished,
    CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(1 + o_orderkey % 3 AS VARCHAR) END AS elevator,
    {_flag(4)} AS balcony, {_flag(5)} AS terrace, {_flag(6)} AS loggia, {_flag(3)} AS cellar,
    {_flag(7)} AS garage, {_flag(8)} AS garden, {_flag(9)} AS basin, {_flag(10)} AS low_energy,
    {_flag(11)} AS easy_access,
    CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 - 1 END AS INTEGER) AS parking_lots,
    CAST(o_orderkey % 50 AS VARCHAR) AS broker_id,
    CASE WHEN o_orderkey % 3 = 0 THEN 'Agency ' || CAST(o_orderkey % 20 AS VARCHAR) END AS broker_company,
    CASE WHEN o_orderkey % 12 = 0 THEN 'včetně provize' END AS note_about_price,
    CAST(o_orderkey AS VARCHAR) AS id_of_order,
    CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) END AS last_updated_at,
    o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS updated_at
  FROM orders WHERE o_orderkey % 13 <> 0)"""

LOCATION = """
location AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE r_name END AS region,
    n_name AS district, c_mktsegment AS municipality,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Quarter ' || CAST(c_custkey % 9 AS VARCHAR) END AS quarter,
    'Česká republika' AS country,
    CAST(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 1 + c_custkey % 16 END AS INTEGER) AS locality_region_id
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

IMAGE = """
image AS (
  SELECT id, listing_id, 'https://img.example/' || CAST(id AS VARCHAR) || '.jpg' AS url,
    CAST(id // 1000000000000000000 AS INTEGER) AS position
  FROM price_history)"""

SNAPSHOT = f"""
analytic_snapshot AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) + CAST((o_orderkey % 2) * 14 AS INTEGER) AS snapshot_date,
    CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 5 END AS location_id,
    {_MAIN} AS category_main_cb, {_TYPE} AS category_type_cb,
    count(*) AS listing_count, avg(floor(o_totalprice)) AS avg_price_czk, avg(floor(o_totalprice)) AS median_price_czk,
    avg(floor(o_totalprice) / (8 + o_orderkey % 120)::DOUBLE) AS avg_price_per_m2,
    count(*) FILTER (o_orderkey % 3 = 0) AS new_count, count(*) FILTER (o_orderkey % 7 = 0) AS removed_count,
    avg(CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 60)::DOUBLE END) AS median_days_on_market,
    avg((o_orderkey % 45)::DOUBLE) AS avg_days_on_market,
    avg(CASE WHEN o_orderkey % 13 <> 0 THEN (CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END)::DOUBLE END) AS price_drop_share,
    avg((o_orderkey % 21 - 10)::DOUBLE) AS median_first_to_last_price_change_pct
  FROM orders GROUP BY 1, 2, 3, 4)"""

RUNS = """
run_days AS (
  SELECT CAST(o_orderdate AS DATE) AS o_day, count(*) AS items_seen,
    count(*) FILTER (o_orderkey % 3 = 0) AS items_new, count(*) FILTER (o_orderkey % 5 = 0) AS items_updated,
    count(*) FILTER (o_orderkey % 7 = 0) AS items_removed
  FROM orders GROUP BY 1),
run_states AS (
  SELECT *, CASE WHEN day(o_day) % 11 = 0 THEN 'failed' WHEN day(o_day) % 6 = 0 THEN 'partial'
                 WHEN day(o_day) = 31 THEN 'running' ELSE 'success' END AS status FROM run_days),
scraping_run AS (
  SELECT CAST(o_day - DATE '1990-01-01' AS BIGINT) AS id,
    CASE WHEN day(o_day) % 5 = 0 THEN 'detail_backfill' ELSE 'incremental' END AS run_type, status,
    CASE WHEN day(o_day) % 4 = 0 THEN 'byt - prodej' ELSE 'all' END AS category,
    CAST(o_day AS TIMESTAMP) AS started_at,
    CASE WHEN status <> 'running' THEN CAST(o_day AS TIMESTAMP) + INTERVAL 5 HOUR END AS finished_at,
    CAST(ceil(items_seen / 10) AS BIGINT) AS pages_fetched, items_seen, items_new, items_updated, items_removed,
    CAST(CASE status WHEN 'partial' THEN 2 WHEN 'failed' THEN 5 ELSE 0 END AS BIGINT) AS error_count
  FROM run_states)"""

VALUATION = """
valuation_base AS (
  SELECT o_orderkey, floor(o_totalprice) AS price,
    CASE WHEN o_orderkey % 41 <> 0 THEN floor(o_totalprice) * (0.85::DOUBLE + (o_orderkey % 7) / 20.0::DOUBLE) END AS expected
  FROM orders WHERE o_orderkey % 13 <> 0),
listing_valuation AS (
  SELECT o_orderkey AS listing_id, expected AS expected_price_czk,
    expected / (8 + o_orderkey % 120)::DOUBLE AS expected_price_per_m2,
    price - expected AS residual_absolute, (price - expected) / expected * 100 AS residual_percent,
    CASE WHEN (price - expected) / expected * 100 <= -10 THEN 'under_market'
         WHEN (price - expected) / expected * 100 >= 10 THEN 'over_market'
         WHEN expected IS NOT NULL THEN 'near_market' END AS classification,
    CASE WHEN o_orderkey % 41 = 0 THEN 'unavailable' WHEN o_orderkey % 3 = 0 THEN 'high'
         WHEN o_orderkey % 3 = 1 THEN 'medium' ELSE 'low' END AS confidence
  FROM valuation_base)"""

ANOMALY = """
listing_anomaly AS (
  SELECT o_orderkey AS listing_id,
    (CASE WHEN o_orderkey % 4 = 0 THEN 30.0 ELSE 0.0 END + CASE WHEN o_orderkey % 5 = 0 THEN 35.0 ELSE 0.0 END
      + CASE WHEN o_orderkey % 6 = 0 THEN 15.0 ELSE 0.0 END)::DOUBLE AS anomaly_score,
    list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'extreme_price_per_m2' END,
      CASE WHEN o_orderkey % 5 = 0 THEN 'possible_duplicate' END,
      CASE WHEN o_orderkey % 6 = 0 THEN 'stale_listing' END], lambda x: x IS NOT NULL) AS anomaly_flags,
    (o_orderkey % 31) / 30.0::DOUBLE AS confidence_score
  FROM orders WHERE o_orderkey % 3 <> 1)"""

EXPECTED = """
expected_base AS (
  SELECT category_main_cb, category_type_cb, count(*) AS n, category_main_cb * 3 + category_type_cb AS slot
  FROM listing WHERE is_active GROUP BY 1, 2),
expected_totals AS (
  SELECT category_main_cb, category_type_cb,
    CAST(CASE WHEN slot % 4 = 0 THEN floor(n * 1.1::DOUBLE) WHEN slot % 4 = 1 THEN floor(n * 0.9::DOUBLE) ELSE n + 1 END AS BIGINT) AS expected_total
  FROM expected_base)"""

POLYGON = """
polygon_center AS (
  SELECT n_nationkey AS part_id, 1 + n_nationkey % 14 AS region_id,
    48.5::DOUBLE + (n_nationkey % 5) * 0.55::DOUBLE AS cy, 12.4::DOUBLE + (n_nationkey // 5) * 0.65::DOUBLE AS cx FROM nation),
ring_shape(ring, rx, ry) AS (VALUES (0, 0.4::DOUBLE, 0.35::DOUBLE), (1, 0.08::DOUBLE, 0.06::DOUBLE)),
corner(i, ux, uy) AS (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)),
polygon_edge AS (
  SELECT part_id, region_id, ring, cx + a.ux * rx AS x1, cy + a.uy * ry AS y1, cx + b.ux * rx AS x2, cy + b.uy * ry AS y2
  FROM polygon_center, ring_shape, corner a JOIN corner b ON a.i = (b.i + 1) % 4)"""

_ALL = [PRICE_HISTORY, LISTING, DETAIL, LOCATION, IMAGE, SNAPSHOT, RUNS, VALUATION, ANOMALY, EXPECTED, POLYGON]


def with_views(sql: str, *extra: str) -> str:
    """``sql`` behind the CTEs of all derived tables; ``extra`` adds further CTEs."""
    return "WITH " + ",".join([*_ALL, *[f"\n{e}" for e in extra]]) + "\n" + sql
