from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fixtures import AS_OF, listings, locations
from hearthline.functions import regions
from hearthline.operators import kpi, quality, regions as reg
from hearthline.operators.aggregates import dataset_counts, inventory_by_region
from hearthline.operators.listings import ListingCriteria, export_rows, filter_listings, page
from hearthline.operators.suggest import location_suggest
from hearthline.schemas import ANALYTICS_RUN, SCRAPING_RUN
from hearthline.sources.sinks import BOM, write_export


def square(x, y, r):
    return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [(10, 1, square(14.4, 50.1, 0.3), [square(14.6, 50.3, 0.05)]), (14, 2, square(16.6, 49.2, 0.3), [])]
    shape = "array<struct<x:double,y:double>>"
    return spark.createDataFrame(rows, f"region_id int, part_id int, exterior {shape}, holes array<{shape}>")


def test_priority_and_reasons(spark, polygons):
    cases = {
        1: (dict(gps_lat=50.0755, gps_lon=14.4378), None), 2: (dict(gps_lat=49.1951, gps_lon=16.6068), None), 3: (dict(gps_lat=0.0, gps_lon=0.0), None),
        4: (dict(gps_lat=40.0, gps_lon=10.0), None), 5: (dict(gps_lat=50.0, gps_lon=12.05), None), 6: ({}, None), 7: ({}, ("Dubaj", None)), 8: (dict(gps_lat=50.0, gps_lon=12.05), ("Dubaj", None)),
        9: (dict(gps_lat=50.0755, gps_lon=14.4378), ("Zlínský kraj", 3)), 10: (dict(gps_lat=50.0755, gps_lon=14.4378), (None, 3)), 11: (dict(gps_lat=50.3, gps_lon=14.6), None), 12: (dict(gps_lat=50.0, gps_lon=12.1), None),
    }
    listing = listings(spark, [dict(id=i, **c[0]) for i, c in cases.items()])
    hints = spark.createDataFrame([(i, h[0], h[1], None, None, True) for i, (_, h) in cases.items() if h], f"listing_id bigint, {reg.HINT_FIELDS}")
    mapping = spark.createDataFrame([(12, 2)], "listing_id bigint, region_id int")
    rows = reg.resolve_region(listing, locations(spark, []).limit(0), polygons, hints, mapping).collect()
    got = {r["listing_id"]: (r["resolved_region_id"], r["region_source"], r["region_unknown_reason"]) for r in rows}
    unknown = lambda reason: (None, "unknown", reason)
    assert got == {
        1: (10, "gps_polygon", None), 2: (14, "gps_polygon", None), 3: unknown("invalid_gps"), 4: unknown("outside_czech_bounding_box"), 5: unknown("polygon_miss"),
        6: unknown("no_detail_no_region_no_gps"), 7: unknown("missing_gps"), 8: unknown("unresolved"), 9: (9, "detail", None), 10: (3, "locality_region_id", None),
        11: unknown("polygon_miss"), 12: (2, "reverse_geocode", None)}


def test_unknown_region_comes_last(spark):
    rows = inventory_by_region(listings(spark, [dict(id=1), dict(id=2), dict(id=3, resolved_region_name=regions.REGION_NAMES[10])])).collect()
    assert [tuple(r) for r in rows] == [("Hlavní město Praha", 1), ("Neznámý", 2)]


@pytest.mark.parametrize("expected,actual,running,status", [
    (1000, 980, False, "aligned"), (1000, 900, False, "coverage_gap"), (1000, 900, True, "in_progress"), (1000, 0, True, "not_started"),
    (1000, 0, False, "missing"), (0, 0, False, "empty"), (1000, 1100, False, "over"), (10, 8, False, "aligned")])
def test_slice_status(spark, expected, actual, running, status):
    assert spark.range(1).select(quality.classify_slice(F.lit(expected), F.lit(actual), F.lit(running))).head()[0] == status


def runs(spark, *rows):
    names = "id run_type status category started_at finished_at items_seen".split()
    full = [dict(zip(names, r)) for r in rows]
    columns = [c.split()[0] for c in SCRAPING_RUN.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in full], SCRAPING_RUN)


def test_completeness_and_freshness(spark):
    slices = [dict(id=m * 10 + t, category_main_cb=m, category_type_cb=t) for m in range(1, 6) for t in range(1, 5)]
    full = (1, "incremental", "success", "all", AS_OF, AS_OF, 105_000)
    state = lambda rows, log: tuple(quality.dataset_state(listings(spark, rows), log, 50_000).select("dataset_completeness", "dataset_freshness").head())
    assert state([dict(id=1, is_active=False)], runs(spark, full)) == ("empty", "empty")
    assert state(slices[:1], runs(spark, full)) == ("partial", "final_partial")
    assert state(slices, runs(spark, full)) == ("complete", "final_complete")
    assert state(slices[2:], runs(spark, full)) == ("complete", "final_complete")
    assert state(slices, runs(spark, full[:-1] + (10,))) == ("partial", "final_partial")
    busy = (2, "incremental", "running", "all", AS_OF, None, 10)
    assert state(slices, runs(spark, full, busy)) == ("complete", "in_progress")
    assert state(slices, runs(spark, full, (3, "detail_backfill", "running", None, AS_OF, None, 1))) == ("complete", "detail_enrichment")


@pytest.mark.parametrize("cur,prev,state", [(105, 100, "trend"), (140, 100, "trend"), (140.01, 100, "baseline"), (105310, 1800, "baseline"), (50, 0, "insufficient_history"), (None, 5, "insufficient_history")])
def test_period_change(spark, cur, prev, state):
    change = kpi.period_change(F.lit(cur).cast("double"), F.lit(prev).cast("double"))
    assert spark.range(1).select(change["state"]).head()[0] == state


def test_staleness(spark):
    state = spark.createDataFrame([(10, 10, "final_complete", AS_OF, None, None)], "active_listing_count bigint, active_with_detail_count bigint, dataset_freshness string, last_dataset_update_at timestamp_ntz, last_full_sweep_at timestamp_ntz, last_successful_scrape_at timestamp_ntz")
    log = lambda *rows: spark.createDataFrame([(i, s, a, f, 0, 0, None) for i, (s, a, f) in enumerate(rows)], ANALYTICS_RUN)
    read = lambda df, *rows: quality.analytics_staleness(df, log(*rows)).head()["analytics_state"]
    later, earlier = AS_OF + timedelta(days=1), AS_OF - timedelta(days=1)
    assert read(state) == "none"
    assert read(state, ("success", later, later)) == "current"
    assert read(state, ("success", earlier, earlier)) == "stale"
    assert read(state, ("partial", later, later)) == "partial"
    assert read(state, ("running", later, None), ("success", earlier, later)) == "running"
    assert read(state.withColumn("active_with_detail_count", F.lit(7))) == "missing_details"
    assert read(state.withColumn("dataset_freshness", F.lit("in_progress"))) == "ingest_in_progress"


def test_filters_and_pages(spark):
    from fixtures import details, history

    loc = locations(spark, [dict(id=1, region="Praha", district="Praha 5", municipality="Praha"), dict(id=2, region="Jihomoravský", district="Brno-město", municipality="Brno")])
    listing = listings(spark, [dict(id=1, price_czk=3_000_000, location_id=1), dict(id=2, price_czk=8_000_000, category_main_cb=2, location_id=2, title="100% dům")])
    detail = details(spark, [dict(listing_id=1, usable_area=40), dict(listing_id=2, usable_area=200)])
    hist = history(spark, [(2, 9_500_000, AS_OF - timedelta(days=9)), (2, 8_000_000, AS_OF - timedelta(days=1)), (1, 3_000_000, AS_OF)])
    ids = lambda **c: [r["id"] for r in filter_listings(listing, detail, loc, hist, ListingCriteria(**c), AS_OF).collect()]
    assert ids(has_price_drop=True) == [2] and ids(has_price_drop=False) == [1]
    assert ids(search="BRNO") == [2] and ids(search="0%") == [2] and ids(search="%") == [2] and sorted(ids(search="")) == [1, 2]
    rows = filter_listings(listing, detail, loc, hist, ListingCriteria(), AS_OF)
    assert [r["id"] for r in page(rows, AS_OF, "price_per_m2", "desc").collect()] == [1, 2]
    with pytest.raises(ValueError):
        page(rows, AS_OF, "image_count")
    assert export_rows(rows, 1)[1].head().asDict() == dict(total_matched=2, returned_rows=1, truncated=True)
    assert [r["label"] for r in location_suggest(listing, loc, "br").collect()] == ["Brno-město", "Brno"]
    assert location_suggest(listing, loc, "b").count() == 0


def test_counts_are_one_row(spark, tables):
    assert dataset_counts(tables.listing, tables.listing_detail, tables.listing_valuation, tables.listing_anomaly).count() == 1


def test_csv_starts_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "Čtvrť", float("nan"))], "id int, name string, v double").coalesce(1)
    write_export(df, str(tmp_path / "x"), "csv")
    text = next((tmp_path / "x").glob("*.csv")).read_text(encoding="utf-8")
    assert text.startswith(BOM + "id,name,v") and "Čtvrť" in text and "NaN" not in text
    with pytest.raises(ValueError):
        write_export(df, str(tmp_path / "y"), "xlsx")


def test_unknown_dimension(spark, tables):
    from hearthline.operators.aggregates import segment_breakdown

    with pytest.raises(ValueError):
        segment_breakdown(tables.listing, tables.listing_detail, "title")


def test_documents_have_one_shape_at_every_size(spark):
    """More than ten thousand records of one listing come back whole and in order."""
    from fixtures import details, history
    from hearthline.operators.listings import listing_documents
    from hearthline.schemas import IMAGE

    listing, detail = listings(spark, [dict(id=1), dict(id=2)]), details(spark, [dict(listing_id=1)])
    n = 12_000
    hist = history(spark, [(1, i, AS_OF - timedelta(minutes=n - i)) for i in range(n)])
    image = spark.createDataFrame([(i, 1, f"u{i}", i, None) for i in range(35)], IMAGE)
    rows = filter_listings(listing, detail, locations(spark, []).limit(0), hist, ListingCriteria(), AS_OF)
    documents, items = listing_documents(rows, hist, image, AS_OF)
    assert sorted(d["id"] for d in documents.collect()) == [1, 2]
    found = items.orderBy("kind", "position").collect()
    assert [(r["listing_id"], r["url"]) for r in found if r["kind"] == "image"] == [(1, f"u{i}") for i in range(35)]
    assert [(r["position"], r["price_czk"]) for r in found if r["kind"] == "price"] == [(i, i) for i in range(n)]


def even_odd(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1 + 1e-15) + x1:
            inside = not inside
    return inside


def test_jagged_polygons_equal_the_plain_test(spark):
    """Rings of many corners with holes, a diamond through the corners of round squares, and points near the borders."""
    import math
    import random

    rng = random.Random(8)

    def star(x, y, r, n):
        return [(x + r * (1 + 0.4 * rng.random()) * math.cos(2 * math.pi * k / n), y + r * (1 + 0.4 * rng.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    shapes = [(1, 1, star(14.4, 50.1, 0.5, 1500), [star(14.4, 50.1, 0.2, 300), star(14.45, 50.1, 0.2, 40)]), (2, 1, [(16.0, 49.0), (17.0, 50.0), (18.0, 49.0), (17.0, 48.5)], []), (3, 7, star(14.8, 50.3, 0.4, 60), []), (4, 2, [(13.0, 49.0), (13.5, 49.0)], [])]
    shape = "array<struct<x:double,y:double>>"
    polygons = spark.createDataFrame(shapes, f"region_id int, part_id int, exterior {shape}, holes array<{shape}>")
    spots = [(rng.uniform(13.5, 18.2), rng.uniform(48.3, 51.0)) for _ in range(3000)]
    for _, _, ring, holes in shapes:
        spots += [(x + rng.gauss(0, 1e-3), y + rng.gauss(0, 1e-3)) for r in (ring, *holes) for x, y in rng.sample(r, min(len(r), 200))]
    spots += [(17.0, 49.5), (16.25, 49.25), (17.0, 49.0)]
    rows = [(k, y, x) for k, (x, y) in enumerate(spots)] + [(10_000 + k, None, None) for k in range(50)] + [(20_000, 0.0, 0.0), (20_001, 50.0, None)]
    cover = reg.polygon_cover(polygons, most_edges=8).cache()
    edges = lambda r: [len(g["edges"]) for s in r["shapes"] for g in s["rings"]]
    leaves = cover.collect()
    assert max(sum(edges(r)) for r in leaves if r["level"] < reg.DEEPEST) <= 8 and max(r["level"] for r in leaves) > 3
    assert any(r["shapes"] and sum(edges(r)) == 0 for r in leaves)  # squares inside a polygon
    assert sum(4.0 ** -r["level"] for r in leaves) == len({(r["cell_y"] >> r["level"], r["cell_x"] >> r["level"]) for r in leaves})  # they tile their roots
    found = reg.region_from_polygon(spark.createDataFrame(rows, "id bigint, lat double, lon double"), polygons, most_edges=8).collect()
    assert len(found) == len(rows)

    def region(x, y):
        if x is None or y is None:
            return None
        hits = [(len(ring), region, part) for region, part, ring, holes in shapes if len(ring) >= 3 and even_odd(ring, x, y) and not any(even_odd(h, x, y) for h in holes)]
        return min(hits)[1] if hits else None

    assert {r["id"]: r["polygon_region_id"] for r in found} == {k: region(x, y) for k, y, x in rows}
