"""Payloads, sweeps, regions, links, sinks, recompute, streams."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from catalog.registry import query
from catalog.views import AS_OF as NOW, case_of, with_views
from hearthline.functions import codebooks as cb
from hearthline.functions import exprs as ex
from hearthline.functions import urls
from hearthline.functions.exprs import ts
from hearthline.functions.regions import region_id_from_name
from hearthline.operators import regions as reg
from hearthline.operators.listings import run_items
from hearthline.plans import recompute, sweep
from hearthline.schemas import LISTING, PRICE_HISTORY
from hearthline.session import cut_lineage, growing, shared_folder
from hearthline.sources import payloads as pay
from hearthline.sources.adapter import AS_OF
from hearthline.sources.links import harvest_links
from hearthline.sources.sinks import BOM, write_export
from hearthline.sources.bucketed import BucketedState
from hearthline.sources.tables import scan_table, write_table
from hearthline.streaming import jobs, stateful

def key() -> Column:
    return F.col("id")


def _opt(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def list_payloads(t) -> DataFrame:
    """One list payload per listing; odd ids use the older shape. Every 45th has no name."""
    coded = lambda c: F.struct(F.lit("x").alias("name"), F.col(c).alias("value")).alias(c)
    named = _opt(key() % 45 != 0, F.col("title"))
    new = F.struct(
        key().alias("hash_id"), named.alias("advert_name"), coded("category_main_cb"), coded("category_type_cb"), coded("category_sub_cb"),
        F.col("price_czk").alias("price_czk"),
        F.struct(
            _opt(key() % 4 == 0, F.concat(F.lit("Okres "), (key() % 20).cast("string"))).alias("district"),
            F.concat(F.lit("Obec "), (key() % 40).cast("string")).alias("city"),
            _opt(key() % 3 == 0, F.concat(F.lit("Část "), (key() % 5).cast("string"))).alias("citypart"),
            _opt(key() % 10 == 0, F.lit("Hlavní")).alias("street"),
            F.col("gps_lat"), F.col("gps_lon"), (1 + key() % 16).alias("region_id"),
            F.element_at(F.array(*[F.lit(n) for n in cb.REGION_NAMES.values()]), (1 + key() % 14).cast("int")).alias("region"),
            F.concat(F.lit("obec-"), (key() % 40).cast("string")).alias("city_seo_name"),
        ).alias("locality"),
    )
    old = F.struct(
        F.col("hash_id"), named.alias("name"),
        F.struct("category_main_cb", "category_type_cb", "category_sub_cb", F.concat(F.lit("misto-"), (key() % 7).cast("string")).alias("locality")).alias("seo"),
        F.struct(F.col("price_czk").alias("value_raw"), F.lit("za měsíc").alias("unit")).alias("price_czk"),
        F.struct(F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon")).alias("gps"),
        F.concat(F.lit("Místo "), (key() % 7).cast("string")).alias("locality"),
        (1 + key() % 16).alias("locality_region_id"),
    )
    # The test tables are one file each; payloads are spread over all cores.
    rows = t.listing.repartition(t.spark.sparkContext.defaultParallelism)
    return rows.select("id", F.when(key() % 2 == 0, F.to_json(new)).otherwise(F.to_json(old)).alias("payload"), F.col("last_seen_at").alias("fetched_at"))


_LIST_PRICE = "nullif(price_czk, 0)"
_PRIMARY = "coalesce(CASE WHEN id % 4 = 0 THEN 'Okres ' || id % 20 END, 'Obec ' || id % 40)"
_PART = "CASE WHEN id % 3 = 0 THEN 'Část ' || id % 5 END"
_PARSED = f"""parsed AS (SELECT id, hash_id, CASE WHEN id % 45 <> 0 THEN title END AS title, category_main_cb, category_type_cb, category_sub_cb, {_LIST_PRICE} AS price_czk,
  CASE WHEN id % 2 = 1 THEN 'za měsíc' END AS price_czk_unit, gps_lat, gps_lon,
  CASE WHEN id % 2 = 1 THEN 'Místo ' || id % 7 ELSE {_PRIMARY} || coalesce(' - ' || {_PART}, '') END AS locality_text,
  '{urls.DEFAULT_HOST}/detail/' || {case_of(urls.DEAL_SLUGS, 'CASE WHEN id % 2 = 0 THEN category_type_cb END', "'prodej'")} || '/'
    || {case_of(urls.PROPERTY_SLUGS, 'CASE WHEN id % 2 = 0 THEN category_main_cb END', "'ostatni'")} || '/'
    || CASE WHEN id % 2 = 0 THEN 'x' ELSE 'ostatni' END || '/' || CASE WHEN id % 2 = 1 THEN 'misto-' || id % 7 ELSE 'obec-' || id % 40 END || '/' || hash_id AS source_url
  FROM listing)"""
_PARSED_COLS = "SELECT * REPLACE (round(gps_lat, 6) AS gps_lat, round(gps_lon, 6) AS gps_lon) FROM parsed"


@query("parse_list", with_views(_PARSED_COLS, _PARSED))
def parse_list(t):
    return pay.parse_list(list_payloads(t), keep=("id",))


def detail_payloads(t) -> DataFrame:
    """One detail payload per detail row: wrapped and direct, or the older shape with an item table."""
    text = lambda c, unit: F.concat(F.col(c).cast("string"), F.lit(unit))
    coded = lambda c, name=None: F.struct(F.lit("x").alias("name"), F.col(c).alias("value")).alias(name or c)
    flags = ["garden", "terrace", "balcony", "loggia", "basin", "cellar", "garage", "low_energy", "easy_access"]
    codes = ["furnished", "elevator", "object_kind", "building_type", "building_condition", "ownership"]
    region = F.element_at(F.array(*[F.lit(n) for n in cb.REGION_NAMES.values()]), (1 + key() % 14).cast("int"))
    new = F.struct(
        F.struct(
            key().alias("hash_id"), F.col("description").alias("advert_description"), *[coded(c) for c in codes], *flags, "parking_lots",
            coded("energy_efficiency_rating", "energy_efficiency_rating_cb"), F.struct(F.col("broker_id").alias("ask_id"), F.col("broker_company").alias("name")).alias("premise"),
            "usable_area", text("floor_area", " m2").alias("floor_area"), text("land_area", ",5 m²").alias("land_area"), "floor_number", F.col("total_floors").alias("floors"),
            F.date_format("updated_at", "yyyy-MM-dd").alias("edited"),
            F.struct(region.alias("region"), F.struct(F.concat(F.lit(" Okres "), (key() % 20).cast("string")).alias("name")).alias("district"),
                     F.concat(F.lit("Obec "), (key() % 40).cast("string")).alias("city"), (1 + key() % 16).alias("region_id")).alias("locality"),
            F.array(F.struct(F.concat(F.lit("https://img.example/a"), key().cast("string")).alias("url")), F.struct(F.lit("").alias("url"))).alias("advert_images"),
        ).alias("result")
    )
    item = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    old = F.struct(
        F.col("id").cast("string").alias("hash_id"), F.struct(F.col("description").alias("value")).alias("text"),
        F.struct(*codes, *flags, "parking_lots", F.col("energy_efficiency_rating").alias("energy_efficiency_rating_cb"), (1 + key() % 16).alias("locality_region_id")).alias("recommendations_data"),
        F.array(item("Užitná plocha", F.lit("1 m²")), item("Užitná plocha", text("usable_area", " m²")), item("Podlaží", F.col("floor")), item("Stavba", F.col("material")),
                item("Vlastnictví", F.lit("Osobní")), item("Aktualizace", F.date_format("updated_at", "dd.MM.yyyy")), item("Neznámé", F.lit("?"))).alias("items"),
        F.struct(F.struct(F.array(F.struct(F.concat(F.lit("https://img.example/b"), key().cast("string")).alias("href"))).alias("images")).alias("_embedded")).alias("images"),
    )
    # The older shape nests its images below _embedded.images._embedded.images.
    images = F.concat(F.lit(',"_embedded":{"images":{"_embedded":{"images":[{"href":"https://img.example/b'), key().cast("string"), F.lit('"}]}}}}'))
    nested = F.element_at(F.transform(F.array(F.to_json(old)), lambda j: F.concat(F.substring(j, F.lit(1), F.length(j) - 1), images)), 1)
    rows = t.listing_detail.repartition(t.spark.sparkContext.defaultParallelism)
    return rows.select("id", F.col("id").alias("listing_id"), F.when(key() % 2 == 0, F.to_json(new)).otherwise(nested).alias("payload"))


_REGION_OF = case_of(cb.REGION_NAMES, "1 + id % 14")
_DETAIL_SQL = f"""SELECT listing_id, nullif(description, '') AS description, furnished, elevator, object_kind, building_type, building_condition,
  CASE WHEN id % 2 = 0 THEN ownership ELSE 'Osobní' END AS ownership, garden, terrace, balcony, loggia, basin, cellar, garage, low_energy, easy_access, CASE WHEN id % 2 = 0 THEN nullif(parking_lots, 0) ELSE parking_lots END AS parking_lots, energy_efficiency_rating,
  CASE WHEN id % 2 = 0 THEN broker_id END AS broker_id, CASE WHEN id % 2 = 0 THEN broker_company END AS broker_company,
  usable_area,
  CASE WHEN id % 2 = 0 THEN floor_area END AS floor_area, CASE WHEN id % 2 = 0 THEN land_area END AS land_area,
  CASE WHEN id % 2 = 1 THEN floor WHEN floor_number IS NOT NULL THEN floor_number || '/9' END AS floor,
  CAST(CASE WHEN id % 2 = 1 THEN id % 9 ELSE floor_number END AS INTEGER) AS floor_number, 9 AS total_floors, CASE WHEN id % 2 = 1 THEN material END AS material,
  CAST(CAST(updated_at AS DATE) AS TIMESTAMP) AS last_updated_at,
  CASE WHEN id % 2 = 0 THEN {_REGION_OF} END AS region, CASE WHEN id % 2 = 0 THEN 'Okres ' || id % 20 END AS district, CASE WHEN id % 2 = 0 THEN 'Obec ' || id % 40 END AS municipality,
  CAST(1 + id % 16 AS INTEGER) AS locality_region_id, 'https://img.example/' || CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END || id AS images
  FROM listing_detail"""


@query("parse_detail", with_views(_DETAIL_SQL))
def parse_detail(t):
    fields = (
        "description furnished elevator object_kind building_type building_condition ownership garden terrace balcony loggia basin cellar garage low_energy easy_access "
        "parking_lots energy_efficiency_rating broker_id broker_company usable_area floor_area land_area floor floor_number total_floors material last_updated_at"
    ).split()
    return pay.parse_detail(detail_payloads(t), keep=("listing_id",)).select(
        "listing_id", *fields, "location.region", "location.district", "location.municipality", "location.locality_region_id", F.array_join("images", " ").alias("images"))


@query("split_items_rejects", with_views(
    "SELECT 7::BIGINT AS run_id, hash_id, 'validate' AS stage, 'Missing required field(s) (hash_id=''' || hash_id || ''', name=None)' AS message, TIMESTAMP '2001-12-01' AS created_at FROM listing WHERE id % 45 = 0 AND id <> 0 UNION ALL "
    "SELECT 7, hash_id, 'validate', 'Missing required field(s) (hash_id=''0'', name=None)', TIMESTAMP '2001-12-01' FROM listing WHERE id = 0"))
def _(t):
    return sweep.split_items(list_payloads(t), 7, AS_OF)[1]


@query("split_items_valid", with_views("SELECT id FROM listing WHERE id % 45 <> 0"))
def _(t):
    return sweep.split_items(list_payloads(t))[0].select("id")


@query("run_items", with_views("SELECT 7::BIGINT AS run_id, hash_id, 'validate' AS stage FROM listing WHERE id % 45 = 0 "))
def _(t):
    log = sweep.split_items(list_payloads(t), 7, AS_OF)[1].withColumn("id", F.col("hash_id").cast("bigint"))
    return run_items(log, 7).select("run_id", "hash_id", "stage")


def batch_of(t) -> DataFrame:
    """A second sweep: a quarter unseen, every fifth re-priced, every sixth also listed anew."""
    base = t.listing.where(key() % 4 != 0).withColumn("price_czk", F.when(key() % 5 == 0, F.coalesce("price_czk", F.lit(0)) + 1000).when(key() % 11 == 0, None).otherwise(F.col("price_czk")))
    base = base.withColumn("gps_lat", F.when(key() % 9 != 0, F.col("gps_lat") + 0.5)).withColumn("source_url", F.when(key() % 2 == 0, F.concat(F.lit("https://new.example/"), key().cast("string"))))
    fresh = t.listing.where(key() % 6 == 0).withColumn("hash_id", (key() + 1_000_000_000).cast("string"))
    return base.select(*sweep.BATCH_COLUMNS).unionByName(fresh.select(*sweep.BATCH_COLUMNS))


_BATCH = """batch AS (
  SELECT hash_id, title, category_main_cb, category_type_cb, category_sub_cb, CASE WHEN id % 5 = 0 THEN coalesce(price_czk, 0) + 1000 WHEN id % 11 = 0 THEN NULL ELSE price_czk END AS price_czk,
    CASE WHEN id % 9 <> 0 THEN gps_lat + 0.5 END AS gps_lat, gps_lon, CASE WHEN id % 2 = 0 THEN 'https://new.example/' || id END AS source_url FROM listing WHERE id % 4 <> 0
  UNION ALL SELECT CAST(id + 1000000000 AS VARCHAR), title, category_main_cb, category_type_cb, category_sub_cb, price_czk, gps_lat, gps_lon, source_url FROM listing WHERE id % 6 = 0),
diff AS (SELECT l.id AS sid, l.hash_id AS sh, l.price_czk AS sp, l.is_active AS sa, l.first_seen_at AS sf, l.last_seen_at AS sl, l.removed_at AS sr, l.gps_lat AS slat, l.gps_lon AS slon,
    l.source_url AS su, b.*, CASE WHEN l.hash_id IS NULL THEN 'new' WHEN b.hash_id IS NULL AND l.is_active THEN 'unseen' WHEN b.hash_id IS NULL THEN 'gone'
      WHEN nullif(b.price_czk, 0) IS NOT NULL AND nullif(b.price_czk, 0) IS DISTINCT FROM l.price_czk THEN 'price_changed' WHEN NOT l.is_active THEN 'reactivated' ELSE 'unchanged' END AS change
  FROM listing l FULL JOIN batch b ON l.hash_id = b.hash_id)"""
_BY_HASH = lambda h: h.cast("bigint")
COMPLETE = sweep.SweepEvidence(True, 0, 0.0)


@query("classify_sweep", with_views("SELECT coalesce(sh, hash_id) AS hash_id, change FROM diff", _BATCH))
def _(t):
    return sweep.classify_sweep(t.listing, batch_of(t)).select(F.coalesce("s_hash_id", "b_hash_id").alias("hash_id"), "change")


_NEXT_SQL = f"""SELECT CASE WHEN change = 'new' THEN CAST(hash_id AS BIGINT) ELSE sid END AS id, coalesce(sh, hash_id) AS hash_id,
  CASE WHEN change = 'new' THEN price_czk ELSE coalesce(nullif(price_czk, 0), sp) END AS price_czk,
  CASE WHEN hash_id IS NOT NULL THEN true WHEN change = 'unseen' THEN false ELSE sa END AS is_active, CASE WHEN change = 'new' THEN {NOW} ELSE sf END AS first_seen_at,
  CASE WHEN hash_id IS NOT NULL THEN {NOW} ELSE sl END AS last_seen_at, CASE WHEN hash_id IS NULL THEN CASE WHEN change = 'unseen' THEN {NOW} ELSE sr END END AS removed_at,
  round(coalesce(gps_lat, slat), 6) AS gps_lat, round(coalesce(gps_lon, slon), 6) AS gps_lon, coalesce(source_url, su) AS source_url FROM diff"""
_NEXT_COLS = "id hash_id price_czk is_active first_seen_at last_seen_at removed_at gps_lat gps_lon source_url".split()


@query("apply_sweep", with_views(_NEXT_SQL, _BATCH))
def apply_sweep(t):
    return sweep.apply_sweep(t.listing, batch_of(t), AS_OF, COMPLETE, new_id=_BY_HASH).listing.select(*_NEXT_COLS)


@query("sweep_colocated", with_views(_NEXT_SQL, _BATCH))
def sweep_colocated(t):
    """The state is stored in buckets: the sweep shuffles its batch only, and the next state goes into the same buckets."""
    state = BucketedState(t.spark, shared_folder(t.spark, "state"), LISTING, "hash_id", buckets=16)
    state.write(t.listing)
    state.write(sweep.apply_sweep(state.read(), batch_of(t), AS_OF, COMPLETE, new_id=_BY_HASH).listing)
    return state.read().select(*_NEXT_COLS)


@query("sweep_incremental", with_views(_NEXT_SQL.replace("'unseen'", "'never'"), _BATCH))
def _(t):
    """A batch that proves nothing about unseen listings reads and writes only the buckets of its keys."""
    state = BucketedState(t.spark, shared_folder(t.spark, "state"), LISTING, "hash_id", buckets=16)
    state.write(t.listing)
    batch = batch_of(t)
    state.write(sweep.apply_sweep(state.read(buckets=state.touched(batch, "hash_id")), batch, AS_OF, new_id=_BY_HASH).listing)
    return state.read().select(*_NEXT_COLS)


@query("apply_sweep_partial", with_views(_NEXT_SQL.replace("'unseen'", "'never'"), _BATCH))
def _(t):
    return sweep.apply_sweep(t.listing, batch_of(t), AS_OF, sweep.SweepEvidence(True, 3, 0.0), new_id=_BY_HASH).listing.select(*_NEXT_COLS)


@query("sweep_history", with_views(
    f"SELECT CASE WHEN change = 'new' THEN CAST(hash_id AS BIGINT) ELSE sid END AS listing_id, price_czk, {NOW} AS recorded_at FROM diff WHERE (change = 'new' AND nullif(price_czk, 0) IS NOT NULL) OR change = 'price_changed'", _BATCH))
def _(t):
    appended = sweep.apply_sweep(t.listing, batch_of(t), AS_OF, new_id=_BY_HASH).history
    return sweep.new_history_only(t.price_history, appended).select("listing_id", "price_czk", "recorded_at")


@query("sweep_counters", with_views(
    """SELECT count(hash_id) AS items_seen, count(*) FILTER (change = 'new') AS items_new, count(*) FILTER (change = 'price_changed') AS items_updated,
    count(*) FILTER (change = 'unseen') AS items_removed, 0::BIGINT AS error_count FROM diff""", _BATCH))
def _(t):
    return sweep.apply_sweep(t.listing, batch_of(t), AS_OF, COMPLETE, new_id=_BY_HASH).counters


@query("sweep_delisted", with_views("SELECT sid AS id FROM diff WHERE change = 'unseen'", _BATCH))
def _(t):
    out = sweep.apply_sweep(t.listing, batch_of(t), AS_OF, COMPLETE, new_id=_BY_HASH).listing
    return out.where(~F.col("is_active") & (F.col("removed_at") == ex.ts(AS_OF))).select("id")


@query("sweep_from_payloads", with_views(
    f"""SELECT p.hash_id, p.price_czk, round(p.gps_lat, 6) AS gps_lat, p.locality_text, p.source_url, {NOW} AS first_seen_at, true AS is_active FROM parsed p WHERE p.id % 45 <> 0""", _PARSED))
def _(t):
    empty = t.listing.where(F.lit(False))
    out = sweep.sweep_payloads(empty, list_payloads(t), AS_OF, ["id"], new_id=_BY_HASH).listing
    return out.select("hash_id", "price_czk", "gps_lat", "locality_text", "source_url", "first_seen_at", "is_active")


@query("first_per_hash", with_views(
    "SELECT hash_id, id FROM (SELECT CAST(listing_id AS VARCHAR) AS hash_id, id, row_number() OVER (PARTITION BY listing_id ORDER BY id) AS rn FROM price_history) WHERE rn = 1"))
def _(t):
    return sweep.first_per_hash(t.price_history.select(F.col("listing_id").cast("string").alias("hash_id"), "id"), ["id"])


def _slices(t) -> tuple[DataFrame, DataFrame]:
    rows = t.listing.select(F.concat_ws("-", "category_main_cb", "category_type_cb").alias("category"), "id", "hash_id")
    part = lambda cond, no: rows.where(cond).select("category", F.lit(no).alias("slice_no"), key().alias("position"), "hash_id")
    batch = part(key() % 10 != 0, 1).unionByName(part(key() % 7 != 0, 2))
    return batch, rows.groupBy("category").agg(F.count(F.lit(1)).alias("probed_total"))


_SLICE_ROWS = """rows_cat AS (SELECT category_main_cb || '-' || category_type_cb AS category, id, hash_id FROM listing),
slice_rows AS (SELECT category, 1 AS slice_no, id AS position, hash_id FROM rows_cat WHERE id % 10 <> 0 UNION ALL SELECT category, 2, id, hash_id FROM rows_cat WHERE id % 7 <> 0)"""


@query("union_slices", with_views("SELECT category, hash_id, min(slice_no) AS slice_no, any_value(position) AS position FROM slice_rows GROUP BY 1, 2", _SLICE_ROWS))
def _(t):
    return sweep.union_slices(*_slices(t))[0]


@query("coverage_gaps", with_views(
    """SELECT category, 'coverage_gap' AS stage, total AS probed_total, got AS recovered, total - got AS gap, round((total - got) / total::DOUBLE * 100, 6) AS gap_pct
    FROM (SELECT category, count(*) AS total FROM rows_cat GROUP BY 1) JOIN (SELECT category, count(DISTINCT hash_id) AS got FROM slice_rows GROUP BY 1) USING (category) WHERE total > got""", _SLICE_ROWS))
def _(t):
    return sweep.union_slices(*_slices(t))[1]


_CAP = 80


@query("plan_slices", with_views(
    f"""SELECT category_main_cb, category_type_cb, NULL::INTEGER AS category_sub_cb, NULL::INTEGER AS region_id FROM totals WHERE total <= {_CAP}
    UNION ALL SELECT category_main_cb, category_type_cb, NULL, r.id FROM totals, (SELECT CAST(range AS INTEGER) AS id FROM range(1, 15)) r WHERE total > {_CAP}
    UNION ALL SELECT t.category_main_cb, t.category_type_cb, k.sub, NULL FROM totals t JOIN known k ON k.main = t.category_main_cb LEFT JOIN sub_totals s ON s.m = t.category_main_cb AND s.d = t.category_type_cb AND s.sub = k.sub
      WHERE t.total > {_CAP} AND coalesce(s.n, 0) <= {_CAP}
    UNION ALL SELECT t.category_main_cb, t.category_type_cb, k.sub, r.id FROM totals t JOIN known k ON k.main = t.category_main_cb JOIN sub_totals s ON s.m = t.category_main_cb AND s.d = t.category_type_cb AND s.sub = k.sub,
      (SELECT CAST(range AS INTEGER) AS id FROM range(1, 15)) r WHERE t.total > {_CAP} AND s.n > {_CAP}""",
    "totals AS (SELECT category_main_cb, category_type_cb, count(*) AS total FROM listing GROUP BY 1, 2)",
    "sub_totals AS (SELECT category_main_cb AS m, category_type_cb AS d, category_sub_cb AS sub, count(*) AS n FROM listing GROUP BY 1, 2, 3)",
    "known(main, sub) AS (VALUES " + ", ".join(f"({m}, {s})" for m, subs in cb.SUBCATEGORIES_BY_MAIN.items() for s in subs) + ")"))
def _(t):
    keys = ["category_main_cb", "category_type_cb"]
    totals = t.listing.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    subs = t.listing.groupBy(*keys, "category_sub_cb").agg(F.count(F.lit(1)).alias("total"))
    return sweep.plan_slices(totals, subs, _CAP)


def payload_archive(t) -> DataFrame:
    """Raw payloads: a list payload per price record, a detail payload per detail row."""
    h = t.price_history
    region = F.element_at(F.array(*[F.lit(n) for n in cb.REGION_NAMES.values()]), (1 + F.col("price_czk") % 14).cast("int"))
    lists = h.select(
        "id", "listing_id", F.col("listing_id").cast("string").alias("hash_id"), F.lit("list").alias("payload_type"),
        F.to_json(F.struct(F.col("listing_id").alias("hash_id"), F.struct(F.when(F.col("price_czk") % 3 != 0, region).alias("region"), F.concat(F.lit("Obec "), (F.col("price_czk") % 50).cast("string")).alias("city"),
                           (1 + F.col("price_czk") % 16).alias("region_id")).alias("locality"))).alias("payload"),
        F.col("recorded_at").alias("fetched_at"))
    details = detail_payloads(t).select(
        "id", "listing_id", F.col("listing_id").cast("string").alias("hash_id"), F.lit("detail").alias("payload_type"), "payload", ex.ts(AS_OF).alias("fetched_at"))
    return lists.unionByName(details)


_NEWEST_LIST = """newest_list AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at DESC, id DESC) AS rn FROM price_history) WHERE rn = 1)"""


@query("prune_payloads", with_views("SELECT id, 'list' AS payload_type, recorded_at AS fetched_at FROM newest_list UNION ALL SELECT id, 'detail', TIMESTAMP '2001-12-01' FROM listing_detail", _NEWEST_LIST))
def _(t):
    return pay.newest_list_payloads(payload_archive(t)).select("id", "payload_type", "fetched_at")


@query("prune_all_lists", with_views("SELECT id, 'detail' AS payload_type FROM listing_detail"))
def _(t):
    return pay.newest_list_payloads(payload_archive(t), True).select("id", "payload_type")


_HINTS = f"""hints AS (SELECT l.id AS listing_id, CASE WHEN d.id % 2 = 0 THEN {case_of(cb.REGION_NAMES, '1 + d.id % 14')} END AS detail_region_name,
  CAST(coalesce(1 + n.price_czk % 16, CASE WHEN d.id IS NOT NULL THEN 1 + d.id % 16 END) AS INTEGER) AS locality_region_id, d.id IS NOT NULL AS has_detail
  FROM listing l LEFT JOIN newest_list n ON n.listing_id = l.id LEFT JOIN listing_detail d ON d.listing_id = l.id)"""


@query("region_hints", with_views("SELECT * FROM hints", _NEWEST_LIST, _HINTS))
def _(t):
    return pay.region_hints(t.listing, t.listing_detail, payload_archive(t)).drop("gps_lat", "gps_lon")


_PLACES = f"""place_names AS (SELECT l.id, l.location_id, CASE WHEN d.id % 2 = 0 THEN {case_of(cb.REGION_NAMES, '1 + d.id % 14')} END AS dr, CASE WHEN d.id % 2 = 0 THEN 'Obec ' || d.id % 40 END AS dm,
    CASE WHEN n.price_czk % 3 <> 0 THEN {case_of(cb.REGION_NAMES, '1 + n.price_czk % 14')} END AS lr, 'Obec ' || n.price_czk % 50 AS lm
  FROM listing l JOIN location o ON o.id = l.location_id AND o.region IS NULL LEFT JOIN listing_detail d ON d.listing_id = l.id LEFT JOIN newest_list n ON n.listing_id = l.id),
merged_names AS (SELECT id, location_id, CASE WHEN dr IS NULL THEN lr ELSE dr END AS r, CASE WHEN dr IS NULL THEN coalesce(dm, lm) ELSE dm END AS m FROM place_names)"""


@query("backfill_location_names", with_views(
    """SELECT o.id, coalesce(b.r, o.region) AS region, coalesce(b.m, o.municipality) AS municipality FROM location o
    LEFT JOIN (SELECT location_id, arg_max(r, id) FILTER (r IS NOT NULL) AS r, arg_max(m, id) FILTER (m IS NOT NULL) AS m FROM merged_names GROUP BY 1) b ON b.location_id = o.id""", _NEWEST_LIST, _PLACES))
def _(t):
    return pay.backfill_location_names(t.listing, t.location, payload_archive(t))[0].select("id", "region", "municipality")


@query("backfill_location_counts", with_views(
    "SELECT count(*) FILTER (r IS NOT NULL OR m IS NOT NULL) AS updated, count(*) FILTER (r IS NULL AND m IS NULL) AS skipped FROM merged_names", _NEWEST_LIST, _PLACES))
def _(t):
    return pay.backfill_location_names(t.listing, t.location, payload_archive(t))[1]


def wandering(t) -> DataFrame:
    """Listings of which some have no, odd or foreign coordinates."""
    odd = lambda c, far: F.when(key() % 59 == 0, F.lit(0.0)).when(key() % 61 == 0, F.lit(far)).when(key() % 67 == 0, F.lit(200.0)).otherwise(F.col(c))
    return t.listing.withColumn("gps_lat", odd("gps_lat", 40.0)).withColumn("gps_lon", odd("gps_lon", 10.0))


_ODD = lambda c, far: f"CASE WHEN id % 59 = 0 THEN 0.0::DOUBLE WHEN id % 61 = 0 THEN {far}::DOUBLE WHEN id % 67 = 0 THEN 200.0::DOUBLE ELSE {c} END"
_CROSS = "((y1 > lat) <> (y2 > lat)) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1 + 1e-15::DOUBLE) + x1"
_POLY = f"""wander AS (SELECT * REPLACE ({_ODD('gps_lat', '40.0')} AS gps_lat, {_ODD('gps_lon', '10.0')} AS gps_lon) FROM listing),
usable AS (SELECT id, gps_lat AS lat, gps_lon AS lon FROM wander WHERE abs(gps_lat) <= 90 AND abs(gps_lon) <= 180 AND NOT (gps_lat = 0 AND gps_lon = 0) AND gps_lat BETWEEN 48 AND 51.2 AND gps_lon BETWEEN 12 AND 19),
crossings AS (SELECT id, part_id, region_id, ring, count(*) AS n FROM usable JOIN polygon_edge ON {_CROSS} GROUP BY 1, 2, 3, 4),
hit AS (SELECT id, region_id, part_id FROM crossings a WHERE ring = 0 AND n % 2 = 1 AND NOT EXISTS (SELECT 1 FROM crossings b WHERE b.id = a.id AND b.part_id = a.part_id AND b.ring = 1 AND b.n % 2 = 1)),
inside AS (SELECT id, CAST(first(region_id ORDER BY region_id, part_id) AS INTEGER) AS polygon_region_id FROM hit GROUP BY 1)"""


@query("point_in_polygon", with_views("SELECT w.id AS id, i.polygon_region_id FROM wander w LEFT JOIN inside i USING (id)", _POLY))
def _(t):
    points = wandering(t).select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    return reg.region_from_polygon(points, t.region_polygon).select("id", "polygon_region_id")


def free_text_names(t) -> DataFrame:
    """Hints with region names in many spellings."""
    name = F.element_at(F.array(*[F.lit(n) for n in cb.REGION_NAMES.values()]), (1 + key() % 14).cast("int"))
    spelled = F.when(key() % 6 == 0, F.upper(name)).when(key() % 6 == 1, F.concat(F.lit("  okres, "), name)).when(key() % 6 == 2, ex.strip_accents(name)).when(key() % 6 == 3, F.lit("Praha 5")).when(key() % 6 == 4, F.lit("Dubaj"))
    return t.listing.select(
        key().alias("listing_id"), spelled.alias("detail_region_name"), F.when(key() % 8 == 0, 1 + key() % 18).cast("int").alias("locality_region_id"),
        F.lit(None).cast("double").alias("gps_lat"), F.lit(None).cast("double").alias("gps_lon"), (key() % 10 != 0).alias("has_detail"))


# Written out: the twin does not use the table of the code under test.
_REGION_FRAGMENTS = [
    ("jihocesky kraj", 1), ("jihocesky", 1), ("plzensky kraj", 2), ("plzensky", 2), ("karlovarsky kraj", 3), ("karlovarsky", 3), ("ustecky kraj", 4), ("ustecky", 4),
    ("liberecky kraj", 5), ("liberecky", 5), ("kralovehradecky kraj", 6), ("kralovehradecky", 6), ("pardubicky kraj", 7), ("pardubicky", 7), ("olomoucky kraj", 8), ("olomoucky", 8),
    ("zlinsky kraj", 9), ("zlinsky", 9), ("hlavni mesto praha", 10), ("praha", 10), ("stredocesky kraj", 11), ("stredocesky", 11), ("moravskoslezsky kraj", 12), ("moravskoslezsky", 12),
    ("kraj vysocina", 13), ("jihomoravsky kraj", 14), ("jihomoravsky", 14)]
_NORM = "CASE " + " ".join(f"WHEN key = '{f}' THEN {i}" for f, i in _REGION_FRAGMENTS) + " " + " ".join(f"WHEN contains(key, '{f}') THEN {i}" for f, i in _REGION_FRAGMENTS) + " END"
_NAMES = f"""spelled AS (SELECT id AS listing_id, CASE id % 6 WHEN 0 THEN upper(n) WHEN 1 THEN '  okres, ' || n WHEN 2 THEN strip_accents(n) WHEN 3 THEN 'Praha 5' WHEN 4 THEN 'Dubaj' END AS hint_name,
    CASE WHEN id % 8 = 0 THEN 1 + id % 18 END AS hint_rid, id % 10 <> 0 AS has_detail FROM (SELECT id, {_REGION_OF} AS n FROM listing))"""


@query("normalize_region_name", with_views(
    f"SELECT listing_id, CAST({_NORM} AS INTEGER) AS region_id FROM (SELECT listing_id, strip_accents(lower(trim(hint_name))) AS key FROM spelled)", _NAMES))
def _(t):
    return free_text_names(t).select("listing_id", region_id_from_name(F.col("detail_region_name")).alias("region_id"))


_RESOLVE = f"""res_in AS (SELECT w.id AS listing_id, w.is_active, w.gps_lat AS lat, w.gps_lon AS lon, coalesce(o.region, s.hint_name) AS name, CAST(coalesce(o.locality_region_id, s.hint_rid) AS INTEGER) AS rid,
    s.has_detail, i.polygon_region_id, CASE WHEN w.id % 5 = 0 THEN 14 END AS mapped, abs(w.gps_lat) <= 90 AND abs(w.gps_lon) <= 180 AND NOT (w.gps_lat = 0 AND w.gps_lon = 0) AS plausible
  FROM wander w LEFT JOIN location o ON o.id = w.location_id LEFT JOIN spelled s ON s.listing_id = w.id LEFT JOIN inside i ON i.id = w.id),
res_try AS (SELECT *, CASE WHEN has_detail THEN {_NORM} END AS by_name, CASE WHEN rid BETWEEN 1 AND 14 THEN rid END AS by_code, CASE WHEN coalesce(plausible, false) THEN mapped END AS by_map
  FROM (SELECT *, strip_accents(lower(trim(name))) AS key FROM res_in)),
resolved AS (SELECT listing_id, is_active, CAST(coalesce(by_name, by_code, polygon_region_id, by_map) AS INTEGER) AS resolved_region_id,
    CASE WHEN by_name IS NOT NULL THEN 'detail' WHEN by_code IS NOT NULL THEN 'locality_region_id' WHEN polygon_region_id IS NOT NULL THEN 'gps_polygon' WHEN by_map IS NOT NULL THEN 'reverse_geocode' ELSE 'unknown' END AS region_source,
    CASE WHEN coalesce(by_name, by_code, polygon_region_id, by_map) IS NULL THEN CASE WHEN (lat IS NULL OR lon IS NULL) AND name IS NULL AND rid IS NULL THEN 'no_detail_no_region_no_gps' WHEN lat IS NULL OR lon IS NULL THEN 'missing_gps'
      WHEN NOT plausible THEN 'invalid_gps' WHEN NOT (lat BETWEEN 48 AND 51.2 AND lon BETWEEN 12 AND 19) THEN 'outside_czech_bounding_box' WHEN has_detail AND name IS NOT NULL THEN 'unresolved' ELSE 'polygon_miss' END END AS region_unknown_reason
  FROM res_try)"""


def _mapping(t) -> DataFrame:
    return t.listing.where(key() % 5 == 0).select(key().alias("listing_id"), F.lit(14).alias("region_id"))


def _resolved(t) -> DataFrame:
    return reg.resolve_region(wandering(t), t.location, t.region_polygon, free_text_names(t), _mapping(t))


@query("resolve_region", with_views(
    f"SELECT listing_id, resolved_region_id, {case_of(cb.REGION_NAMES, 'resolved_region_id')} AS resolved_region_name, region_source, region_unknown_reason FROM resolved", _POLY, _NAMES, _RESOLVE))
def resolve_region(t):
    return _resolved(t)


_STATS = """SELECT '{phase}' AS phase, metric, count(*) AS listing_count FROM (SELECT 'active_total' AS metric FROM {src} WHERE is_active UNION ALL SELECT 'with_region' FROM {src} WHERE is_active AND resolved_region_id IS NOT NULL
  UNION ALL SELECT 'unknown_region' FROM {src} WHERE is_active AND region_source = 'unknown' UNION ALL SELECT 'unset_region' FROM {src} WHERE is_active AND region_source IS NULL
  UNION ALL SELECT 'source:' || coalesce(region_source, 'unset') FROM {src} WHERE is_active UNION ALL SELECT 'reason:' || coalesce(region_unknown_reason, 'unset') FROM {src} WHERE is_active AND region_source = 'unknown') GROUP BY 2"""


@query("backfill_regions_stats", with_views(
    _STATS.format(phase="before", src="listing") + " UNION ALL " + _STATS.format(phase="after", src="resolved"), _POLY, _NAMES, _RESOLVE))
def _(t):
    return reg.backfill_regions(wandering(t), t.location, t.region_polygon, free_text_names(t), _mapping(t))[1]


_LEFT = "leftovers AS (SELECT l.id AS listing_id, l.hash_id, l.locality_text AS locality_string, o.country, 'foreign_or_incomplete_admin_area' AS reason_bucket FROM listing l LEFT JOIN location o ON o.id = l.location_id WHERE l.is_active AND l.resolved_region_name IS NULL)"


@query("region_leftovers", with_views("SELECT * FROM leftovers", _LEFT))
def _(t):
    return reg.region_leftovers(t.listing, t.location).select("listing_id", "hash_id", "locality_string", "country", "reason_bucket")


@query("reviewed_leftovers", with_views(
    "SELECT listing_id, locality_string, m.municipality AS suggested_municipality FROM leftovers LEFT JOIN (SELECT DISTINCT locality_text AS p, 'Česká republika' AS c, upper(locality_text) AS municipality FROM listing WHERE id % 2 = 0 AND locality_text IS NOT NULL) m ON m.p = locality_string AND m.c IS NOT DISTINCT FROM country", _LEFT))
def _(t):
    reviewed = t.listing.where("id % 2 = 0 and locality_text is not null").select(F.col("locality_text").alias("locality_string")).distinct().select(
        "locality_string", F.lit("Česká republika").alias("country"), F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("district"), F.upper("locality_string").alias("municipality"))
    return reg.apply_review(reg.region_leftovers(t.listing, t.location), reviewed).select("listing_id", "locality_string", "suggested_municipality")


@query("harvest_links", """
SELECT page_id, listing_url, min(pos) AS position FROM (
  SELECT page_id, CASE WHEN starts_with(href, 'http') THEN href ELSE 'https://listings.example' || href END AS listing_url, CAST(pos - 1 AS INTEGER) AS pos
  FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1) AS h FROM pages))
  WHERE contains(href, 'en')) GROUP BY 1, 2""")
def _(t):
    return harvest_links(t.raw("pages"), "https://listings.example", "en")


def _exported(t) -> DataFrame:
    return t.listing.select("id", "title", "price_czk", F.when(key() % 10 == 0, F.lit(float("nan"))).otherwise(F.col("gps_lat")).alias("gps_lat"), "locality_text", "is_active", "last_seen_at")


_EXPORTED = with_views("SELECT id, title, price_czk, CASE WHEN id % 10 <> 0 THEN round(gps_lat, 6) END AS gps_lat, locality_text, is_active, last_seen_at FROM listing")


def _round_trip(t, fmt: str) -> DataFrame:
    path = shared_folder(t.spark, f"export-{fmt}")
    rows = _exported(t)
    write_export(rows, path, fmt)
    if fmt == "parquet":
        return t.spark.read.parquet(path)
    if fmt == "json":
        return t.spark.read.schema(rows.schema).json(path)
    return t.spark.read.option("header", "true").schema(rows.schema).csv(path)


for _fmt in ("csv", "json", "parquet"):
    query(f"export_{_fmt}", _EXPORTED)(lambda t, f=_fmt: _round_trip(t, f))


@query("snapshot_table_rewrite", with_views(
    "SELECT snapshot_date, CAST(sum(listing_count) AS BIGINT) AS listing_count, count(*) AS segments FROM analytic_snapshot GROUP BY 1"))
def _(t):
    """Dates written twice still hold one set of rows."""
    root = shared_folder(t.spark, "snapshots")
    for rows in (t.analytic_snapshot, t.analytic_snapshot.where(F.month("snapshot_date") == 3)):
        write_table(rows, root, "analytic_snapshot", ("snapshot_date",))
    return scan_table(t.spark, root, "analytic_snapshot").groupBy("snapshot_date").agg(F.sum("listing_count").alias("listing_count"), F.count(F.lit(1)).alias("segments"))


@query("payload_archive", with_views("SELECT CAST(date_trunc('month', recorded_at) AS DATE) AS fetch_date, count(*) AS payloads FROM price_history GROUP BY 1"))
def _(t):
    """Two appends of monthly fetches."""
    path = shared_folder(t.spark, "archive")
    lists = payload_archive(t).where("payload_type = 'list'").withColumn("fetched_at", F.date_trunc("month", "fetched_at").cast("timestamp_ntz"))
    for rows in (lists.where("listing_id % 2 = 0"), lists.where("listing_id % 2 = 1")):
        pay.archive_payloads(rows, path)
    return t.spark.read.parquet(path).groupBy("fetch_date").agg(F.count("payload").alias("payloads"))


@query("apply_details", with_views(
    """SELECT l.id, CASE WHEN d.id IS NULL THEN l.seller_type WHEN d.id % 2 = 0 AND d.broker_company IS NOT NULL THEN 'realitni_kancelar' ELSE 'soukroma_osoba' END AS seller_type,
    CASE WHEN d.id IS NOT NULL THEN d.id ELSE l.location_id END AS location_id FROM listing l LEFT JOIN listing_detail d ON d.listing_id = l.id"""))
def _(t):
    parsed = pay.parse_detail(detail_payloads(t).withColumn("at", F.lit(1)), keep=("listing_id", "at"))
    return sweep.apply_details(t.listing, t.location, parsed, AS_OF, ["at"])["listing"].select("id", "seller_type", "location_id")


@query("detail_images", with_views("SELECT listing_id, 0 AS position, 'https://img.example/' || CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END || id AS url FROM listing_detail"))
def _(t):
    parsed = pay.parse_detail(detail_payloads(t).withColumn("at", F.lit(1)), keep=("listing_id", "at"))
    return sweep.apply_details(t.listing, t.location, parsed, AS_OF, ["at"])["image"].select("listing_id", "position", "url")


@query("apply_details_repeated", with_views(
    """SELECT l.id, CASE WHEN d.id IS NULL THEN NULL ELSE d.n END AS detail_rows, CASE WHEN d.id IS NOT NULL THEN 1 END AS image_rows, l.title FROM listing l
    LEFT JOIN (SELECT listing_id AS id, 1 AS n FROM listing_detail) d ON d.id = l.id"""))
def _(t):
    """Two payloads of each listing, stored twice: still one detail and one image row of each, the newer payload's."""
    payloads = detail_payloads(t).withColumn("at", F.lit(2))
    older = payloads.withColumn("at", F.lit(1)).withColumn("payload", F.lit('{"usable_area": 1, "advert_images": ["old"]}'))
    parsed = pay.parse_detail(payloads.unionByName(older), keep=("listing_id", "at"))
    tables = {"listing": t.listing, "location": t.location, "listing_detail": t.listing_detail.limit(0), "image": t.image.limit(0)}
    for _ in range(2):
        tables = sweep.apply_details(tables["listing"], tables["location"], parsed, AS_OF, ["at"], tables["listing_detail"], tables["image"])
    details = tables["listing_detail"].groupBy("listing_id").agg(F.count("*").cast("int").alias("detail_rows"))
    images = tables["image"].where("url <> 'old'").groupBy(F.col("listing_id").alias("i_id")).agg(F.count("*").cast("int").alias("image_rows"))
    return tables["listing"].join(growing(details), F.col("id") == F.col("listing_id"), "left").join(growing(images), F.col("id") == F.col("i_id"), "left").select("id", "detail_rows", "image_rows", "title")


@query("detail_rejects", with_views(
    f"""SELECT 9::BIGINT AS run_id, hash_id, 'detail' AS stage, CASE WHEN id % 13 = 0 THEN 'No detail payload' ELSE 'Unreadable detail payload' END AS message, {NOW} AS created_at
    FROM listing WHERE is_active AND (id % 13 = 0 OR id % 4 = 1)"""))
def _(t):
    broken = detail_payloads(t).withColumn("payload", F.when(key() % 4 == 1, F.lit("{")).otherwise(F.col("payload")))
    return sweep.detail_rejects(broken, t.listing.where("is_active").select(key().alias("listing_id"), "hash_id"), 9, AS_OF)


@query("sweep_run_rows", with_views(
    f"""SELECT 5::BIGINT AS id, 'incremental' AS run_type, 'success' AS status, 'all' AS category, {NOW} AS started_at, {NOW} AS finished_at, 12::BIGINT AS pages_fetched, count(hash_id) AS items_seen,
      count(*) FILTER (change = 'new') AS items_new, count(*) FILTER (change = 'price_changed') AS items_updated, count(*) FILTER (change = 'unseen') AS items_removed, 0::BIGINT AS error_count, NULL::VARCHAR AS error_message FROM diff
    UNION ALL SELECT 6, 'incremental', 'partial', 'all', {NOW}, {NOW}, 12, count(hash_id), count(*) FILTER (change = 'new'), count(*) FILTER (change = 'price_changed'), 0, 0, '1 pages failed' FROM diff""", _BATCH))
def _(t):
    """Run rows of a complete sweep and of one with a failed page."""
    whole = sweep.apply_sweep(t.listing, batch_of(t), AS_OF, COMPLETE, new_id=_BY_HASH)
    part = sweep.apply_sweep(t.listing, batch_of(t), AS_OF, sweep.SweepEvidence(True, 1, 0.0), new_id=_BY_HASH)
    return sweep.sweep_run_row(whole, 5, AS_OF, AS_OF, 12).unionByName(sweep.sweep_run_row(part, 6, AS_OF, AS_OF, 12, failed_pages=1))


@query("detail_run", with_views(
    """SELECT count(*) FILTER (id % 13 <> 0 AND id % 4 <> 1) AS items_seen, count(*) FILTER (id % 13 = 0 OR id % 4 = 1) AS error_count, 'partial' AS status FROM listing WHERE is_active"""))
def _(t):
    """Worklist of all active listings; some payloads are missing, some unreadable."""
    broken = detail_payloads(t).withColumn("payload", F.when(key() % 4 == 1, F.lit("{")).otherwise(F.col("payload")))
    return sweep.detail_run(broken, t.listing.where("is_active").select(key().alias("listing_id")))


@query("run_status", with_views(
    "SELECT id, CASE WHEN error_count = 0 THEN 'success' WHEN items_seen > 2 THEN 'partial' ELSE 'failed' END AS run_state FROM scraping_run"))
def _(t):
    return t.scraping_run.select("id", sweep.run_status(F.greatest(F.lit(0), F.col("items_seen") - 2), F.col("error_count")).alias("run_state"))


_CELL_COUNT = "(SELECT count(*) FROM (SELECT DISTINCT floor(gps_lat / 0.01::DOUBLE), floor(gps_lon / 0.01::DOUBLE) FROM listing WHERE is_active AND gps_lat IS NOT NULL))"


@query("full_recompute", with_views(
    f"""SELECT 'success' AS status, ((SELECT count(*) FROM (SELECT DISTINCT category_main_cb, category_type_cb FROM listing))
    + (SELECT count(*) FROM (SELECT 1 FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active AND d.usable_area > 0 GROUP BY category_main_cb, category_type_cb HAVING count(*) >= 30))
    + (SELECT count(*) FROM listing WHERE is_active) + {_CELL_COUNT})::BIGINT AS items_processed, 0::BIGINT AS error_count"""))
def full_recompute(t):
    out = shared_folder(t.spark, "recompute")
    run = recompute.run_full_recompute(t.listing, t.listing_detail, t.price_history, None, AS_OF, out)
    return run.select("status", "items_processed", "error_count")


@query("full_recompute_twice", with_views(
    f"""SELECT 'listing_anomaly' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS keys FROM listing WHERE is_active
    UNION ALL SELECT 'listing_valuation', count(*), CAST(sum(l.id) AS BIGINT) FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active AND d.usable_area > 0
    UNION ALL SELECT 'analytic_snapshot', 2 * count(*), CAST(2 * sum(n) AS BIGINT) FROM (SELECT count(*) FILTER (is_active) AS n FROM listing GROUP BY category_main_cb, category_type_cb)
    UNION ALL SELECT 'valuation_model', 2 * count(*), CAST(2 * sum(n) AS BIGINT) FROM (SELECT count(*) FILTER (l.price_czk > 0) AS n FROM listing l JOIN listing_detail d ON d.listing_id = l.id WHERE l.is_active AND d.usable_area > 0 GROUP BY category_main_cb, category_type_cb HAVING count(*) >= 30)
    UNION ALL SELECT 'spatial_grid_metric', 2 * {_CELL_COUNT}, CAST(2 * count(*) AS BIGINT) FROM listing WHERE is_active AND gps_lat IS NOT NULL
    UNION ALL SELECT 'analytics_run', 2, 2 FROM region WHERE r_regionkey = 0"""))
def full_recompute_twice(t):
    """Two runs a day apart, the later one twice, the first over half of the listings: contents by key of every table."""
    out = shared_folder(t.spark, "recompute")
    half = t.listing.where("id % 2 = 0")
    recompute.run_full_recompute(half, t.listing_detail, t.price_history, None, AS_OF + timedelta(days=3), out, 0)
    recompute.run_full_recompute(t.listing, t.listing_detail, t.price_history, None, AS_OF, out, 0)
    recompute.run_full_recompute(t.listing, t.listing_detail, t.price_history, None, AS_OF + timedelta(days=3), out, 1)
    keys = {
        "listing_anomaly": F.sum("listing_id"), "listing_valuation": F.sum("listing_id"), "analytic_snapshot": F.sum("listing_count"), "valuation_model": F.sum("n_samples"),
        "spatial_grid_metric": F.sum("listing_count"), "analytics_run": F.count_if(F.col("status") == "success"),
    }
    parts = [recompute.stored_table(t.spark, out, n).agg(F.count("*").alias("n"), k.cast("bigint").alias("keys")).select(F.lit(n).alias("name"), "n", "keys") for n, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


# Scalar functions over whole text columns.
@query("text_functions", with_views(
    r"""SELECT id, TRY_CAST(nullif(regexp_extract(txt, '^\s*(\d+)', 1), '') AS INTEGER) AS lead_int,
    TRY_CAST(nullif(regexp_extract(fl, '^\s*(-?\d+)\s*(?:/\s*(-?\d+))?', 1), '') AS INTEGER) AS floor_no,
    TRY_CAST(nullif(regexp_extract(fl, '^\s*(-?\d+)\s*(?:/\s*(-?\d+))?', 2), '') AS INTEGER) AS floors,
    CASE WHEN id % 4 = 0 THEN id % 2 = 1 WHEN id % 4 = 1 THEN true WHEN id % 4 = 2 THEN false END AS flag,
    CASE WHEN id % 3 <> 0 THEN CAST(strftime(first_seen_at, '%Y-%m-%d') AS TIMESTAMP) END AS cz_day,
    CASE WHEN id % 5 = 0 THEN 'A' WHEN id % 5 = 1 THEN 'B' END AS first_text FROM
    (SELECT id, first_seen_at, CASE WHEN id % 3 = 0 THEN ' ' || id || ',5 m2' WHEN id % 3 = 1 THEN 'cca ' || id ELSE id || ' m²' END AS txt,
      CASE id % 4 WHEN 0 THEN id % 9 || ' / 12' WHEN 1 THEN '-' || id % 3 WHEN 2 THEN 'přízemí' ELSE ' ' || id % 7 || '/x' END AS fl FROM listing)"""))
def _(t):
    s = lambda c: c.cast("string")
    txt = F.when(key() % 3 == 0, F.concat(F.lit(" "), s(key()), F.lit(",5 m2"))).when(key() % 3 == 1, F.concat(F.lit("cca "), s(key()))).otherwise(F.concat(s(key()), F.lit(" m²")))
    fl = F.when(key() % 4 == 0, F.concat(s(key() % 9), F.lit(" / 12"))).when(key() % 4 == 1, F.concat(F.lit("-"), s(key() % 3))).when(key() % 4 == 2, F.lit("přízemí")).otherwise(F.concat(F.lit(" "), s(key() % 7), F.lit("/x")))
    flag = F.when(key() % 4 == 0, s(key() % 2)).when(key() % 4 == 1, F.lit("ano")).when(key() % 4 == 2, F.lit("false"))
    day = F.when(key() % 3 == 0, F.lit("2001-02-30")).otherwise(F.date_format("first_seen_at", "dd.MM.yyyy"))
    number, floors = ex.floor_fraction(fl)
    pick = ex.first_text(F.when(key() % 5 == 0, F.lit("A")).when(key() % 5 == 1, F.lit("")), F.when(key() % 5 == 1, F.lit("B")))
    return t.listing.select("id", ex.leading_int(txt).alias("lead_int"), number.alias("floor_no"), floors.alias("floors"), ex.safe_bool(flag).alias("flag"), ex.czech_date(day).alias("cz_day"), pick.alias("first_text"))


# Streams over the event table: users stand for listings, values for prices.
def _events(t) -> DataFrame:
    schema = t.raw("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def _landed_in_order(t, root: str, *columns: Column, files: int = 4) -> DataFrame:
    """The events as a stream of files, one file in a batch, in order of time."""
    events = t.raw("events").select(*columns)
    first, end = events.agg(F.min("at"), F.max("at")).first()
    step = (end - first) / files
    for k in range(files):  # one after the other: the stream takes files by their time
        part = events.where((F.col("at") >= first + k * step) & ((F.col("at") < first + (k + 1) * step) | F.lit(k == files - 1)))
        part.coalesce(1).write.mode("append").parquet(f"{root}/landed")
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")


@query("stream_price_changes", """
SELECT key, old_price, new_price, round((new_price - old_price) / nullif(old_price, 0) * 100, 6) AS pct, "at" FROM (
  SELECT user_id AS key, value AS new_price, ts AS "at", lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS old_price FROM events)
WHERE old_price IS NOT NULL AND old_price <> new_price""")
def stream_price_changes(t):
    """Four files, landed in order of time, as four batches: prices of earlier batches come out of the state store."""
    root = shared_folder(t.spark, "changes")
    observations = _landed_in_order(t, root, F.col("user_id").alias("key"), F.col("value").alias("price"), F.col("ts").alias("at"))
    jobs.run_to_table(stateful.price_changes(observations), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@query("stream_daily_statistics", """
SELECT * FROM (SELECT date_trunc('day', ts) AS window_start, event_type AS segment, count(*) AS observations, count(*) FILTER (event_type = 'signup') AS new_count,
  count(*) FILTER (event_type = 'error') AS removed_count, round(avg(value), 10) AS avg_price, round(min(value), 6) AS min_price, round(max(value), 6) AS max_price FROM events GROUP BY 1, 2)
WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""", digits=10)
def _(t):
    root = shared_folder(t.spark, "daily")
    kind = F.col("event_type")
    source = _events(t).select(F.col("ts").alias("at"), F.col("value").alias("price"), kind, (kind == "signup").alias("is_new"), (kind == "error").alias("is_removed"))
    jobs.run_to_table(jobs.daily_statistics(source, "event_type"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


_SESSIONS = """
marked AS (SELECT user_id AS key, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 20 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS starts FROM events),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT key, count(*) AS sightings, min(ts) AS first_seen_at, max(ts) AS last_seen_at, max(ts) + INTERVAL 20 HOUR AS removed_at FROM numbered GROUP BY key, s"""


@query("stream_presence_timeout", f"WITH {_SESSIONS} HAVING max(ts) + INTERVAL 20 HOUR <= (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) FROM events)")
def _(t):
    root = shared_folder(t.spark, "presence")
    source = _events(t).select(F.col("user_id").alias("key"), F.col("ts").alias("at"))
    jobs.run_to_table(jobs.presence_sessions(source, "20 hours"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{root}/out")


@query("stream_presence_events", f"""
WITH {_SESSIONS[: _SESSIONS.rindex("SELECT key")]}, stays AS (SELECT key, s, count(*) AS sightings, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM numbered GROUP BY key, s)
SELECT key, 'removed' AS event, sightings, first_seen_at, last_seen_at, last_seen_at + INTERVAL 20 HOUR AS "at" FROM stays
WHERE last_seen_at + INTERVAL 20 HOUR <= (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) FROM events)
UNION ALL SELECT key, 'returned', NULL, first_seen_at, NULL, first_seen_at FROM stays WHERE s > 1""")
def _(t):
    """Removals by timers and returns, over four batches. What a return has seen so far depends on the batches, so it is left out."""
    root = shared_folder(t.spark, "presence-events")
    sightings = _landed_in_order(t, root, F.col("user_id").alias("key"), F.col("ts").alias("at"))
    jobs.run_to_table(stateful.presence_events(sightings, 20), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    removed = F.col("event") == "removed"
    rows = t.spark.read.parquet(f"{root}/out")
    return rows.select("key", "event", F.when(removed, F.col("sightings")).alias("sightings"), "first_seen_at", F.when(removed, F.col("last_seen_at")).alias("last_seen_at"), "at")


@query("presence_sessions", f"WITH {_SESSIONS}")
def _(t):
    return jobs.presence_sessions(t.raw("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at")), "20 hours")


REJECTS = "run_id bigint, hash_id string, stage string, message string, created_at timestamp_ntz"


def _sweep_tables(t, root: str) -> list:
    return [
        BucketedState(t.spark, f"{root}/state", LISTING, "hash_id", buckets=8), jobs.VersionedTable(t.spark, f"{root}/history", PRICE_HISTORY),
        jobs.VersionedTable(t.spark, f"{root}/rejects", REJECTS), jobs.VersionedTable(t.spark, f"{root}/parts", jobs.SWEEP_PART)]


def _landed(t, root: str) -> DataFrame:
    return t.spark.readStream.schema("id bigint, payload string, sweep bigint, swept_at timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{root}/landed")


def _payload_rows(t) -> DataFrame:
    """The list payloads, made by all tasks once; what lands is copied from them."""
    return cut_lineage(list_payloads(t).select("id", "payload"), "payloads")


@query("stream_sweep_ingest", with_views(
    f"""SELECT p.hash_id, p.price_czk, p.locality_text, p.source_url, true AS is_active, {NOW} AS last_seen_at FROM parsed p WHERE p.id % 45 <> 0""", _PARSED))
def stream_sweep_ingest(t):
    """One sweep of payload files, landed in several files and never declared complete."""
    root = shared_folder(t.spark, "sweeps")
    _payload_rows(t).select("id", "payload", F.lit(1).cast("bigint").alias("sweep"), ts(AS_OF).alias("swept_at")).repartition(3).write.parquet(f"{root}/landed")
    tables = _sweep_tables(t, root)
    jobs.ingest_sweeps(_landed(t, root), *tables, f"{root}/checkpoint", ["id"]).awaitTermination()
    return tables[0].read().select("hash_id", "price_czk", "locality_text", "source_url", "is_active", "last_seen_at")


_LATER = "(" + NOW + " + INTERVAL 1 DAY)"
_LAST = "(" + NOW + " + INTERVAL 2 DAY)"


def sweeps_in_files(t):
    """Three sweeps of three files each: all listings; without every fourth, complete; without every third, with a failed page."""
    root, rows = shared_folder(t.spark, "sweeps"), _payload_rows(t)
    for number, missing in ((1, 10**12), (2, 4), (3, 3)):
        own = rows.where(F.col("id") % missing != 0 if missing < 10**12 else F.lit(True))
        own = own.select("id", "payload", F.lit(number).cast("bigint").alias("sweep"), ts(AS_OF + timedelta(days=number - 1)).alias("swept_at"))
        for k in range(3):  # one after the other: files of a sweep land before those of the next
            own.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    n = {r["sweep"]: r["count"] for r in t.spark.read.parquet(f"{root}/landed").groupBy("sweep").count().collect()}
    ends = t.spark.createDataFrame([(1, n[1], True, 0, 0.0), (2, n[2], True, 0, 0.5), (3, n[3], True, 1, 0.0)], jobs.SWEEP_END)
    tables = _sweep_tables(t, root)
    jobs.ingest_sweeps(_landed(t, root), *tables, f"{root}/checkpoint", ["id"], ends=lambda: ends).awaitTermination()
    return tables


@query("stream_sweep_many_files", with_views(
    f"""SELECT hash_id, id % 4 <> 0 OR id % 3 <> 0 AS is_active, CASE WHEN id % 3 <> 0 THEN {_LAST} WHEN id % 4 <> 0 THEN {_LATER} ELSE {NOW} END AS last_seen_at,
      CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN {_LATER} END AS removed_at FROM listing WHERE id % 45 <> 0"""))
def _(t):
    """What the complete second sweep misses is removed, at its end only; what the third one misses stays."""
    return sweeps_in_files(t)[0].read().select("hash_id", "is_active", "last_seen_at", "removed_at")


@query("stream_sweep_closed_later", with_views(
    f"""SELECT hash_id, id % 3 <> 0 AS is_active, CASE WHEN id % 3 <> 0 THEN {_LATER} ELSE {NOW} END AS last_seen_at, CASE WHEN id % 3 = 0 THEN {_LATER} END AS removed_at FROM listing WHERE id % 45 <> 0"""))
def _(t):
    """The second sweep is declared complete only after its last file has been applied; it ends without a new one."""
    root, rows = shared_folder(t.spark, "sweeps"), _payload_rows(t)
    counts = {}
    for number, missing in ((1, 10**12), (2, 3)):
        own = rows.where(F.col("id") % missing != 0 if missing < 10**12 else F.lit(True))
        own.select("id", "payload", F.lit(number).cast("bigint").alias("sweep"), ts(AS_OF + timedelta(days=number - 1)).alias("swept_at")).coalesce(1).write.mode("append").parquet(f"{root}/landed")
        counts[number] = own.count()
    tables = _sweep_tables(t, root)
    jobs.ingest_sweeps(_landed(t, root), *tables, f"{root}/checkpoint", ["id"]).awaitTermination()
    ends = t.spark.createDataFrame([(2, counts[2], True, 0, 0.5)], jobs.SWEEP_END)
    jobs.close_sweeps(tables[0], tables[3], ends)
    return tables[0].read().select("hash_id", "is_active", "last_seen_at", "removed_at")


@query("stream_sweep_runs", with_views(
    f"""SELECT 1::BIGINT AS id, 'partial' AS status, count(*) AS pages_fetched, count(*) FILTER (id % 45 <> 0) AS items_seen, 0::BIGINT AS items_removed, count(*) FILTER (id % 45 = 0) AS error_count FROM listing
    UNION ALL SELECT 2, 'partial', count(*), count(*) FILTER (id % 45 <> 0), (SELECT count(*) FROM listing WHERE id % 4 = 0 AND id % 45 <> 0), count(*) FILTER (id % 45 = 0) FROM listing WHERE id % 4 <> 0
    UNION ALL SELECT 3, 'partial', count(*), count(*) FILTER (id % 45 <> 0), 0, count(*) FILTER (id % 45 = 0) FROM listing WHERE id % 3 <> 0"""))
def _(t):
    return jobs.sweep_runs(sweeps_in_files(t)[3].all_versions()).select("id", "status", "pages_fetched", "items_seen", "items_removed", "error_count")
