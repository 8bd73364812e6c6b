import math
import random

from pyspark.sql import functions as F

from fixtures import AS_OF, details, history, listings
from hearthline.operators.anomaly import near_duplicates, score_anomalies
from hearthline.operators.comparables import comparables, comparables_summary
from hearthline.operators.history import history_features
from hearthline.operators.spatial import coarsen


def km(a, b):
    la, lo, lb, lp = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def scene(seed, n, spread):
    """A third of the listings on one spot, the rest around it."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        hot = rnd.random() < 0.34
        lat, lon = (50.08, 14.42) if hot else (50.08 + rnd.uniform(-spread, spread), 14.42 + rnd.uniform(-spread, spread))
        out.append(dict(id=i, lat=lat, lon=lon, sub=rnd.choice([None, 2, 3, 4, 6]), area=rnd.choice([0, None, 20, 30, 31, 33, 47, 48, 80, 120, 121]),
                        active=rnd.random() < 0.9, main=rnd.choice([1, 1, 2]), price=rnd.choice([None, 0, 1_000_000, 2_500_000, 7_000_000]), gps=rnd.random() < 0.95))
    return out


def frames(spark, rows):
    listing = listings(spark, [dict(id=r["id"], gps_lat=r["lat"] if r["gps"] else None, gps_lon=r["lon"] if r["gps"] else None, category_sub_cb=r["sub"],
                                    category_main_cb=r["main"], is_active=r["active"], price_czk=r["price"]) for r in rows])
    detail = details(spark, [dict(listing_id=r["id"], usable_area=r["area"]) for r in rows if r["id"] % 11])
    return listing, detail


def test_near_duplicates_match_all_pairs(spark):
    for seed, spread in ((1, 0.002), (2, 0.0006), (3, 0.02)):
        rows = scene(seed, 350, spread)
        usable = [r for r in rows if r["active"] and r["gps"] and r["id"] % 11 and r["area"]]
        want = {a["id"] for a in usable for b in usable if a is not b and a["sub"] == b["sub"]
                and abs(b["area"] - a["area"]) / a["area"] <= 0.05 and km((a["lat"], a["lon"]), (b["lat"], b["lon"])) <= 0.05}
        assert {r[0] for r in near_duplicates(*frames(spark, rows)).collect()} == want


def brute_comparables(rows, limit=8):
    out = {}
    for s in rows:
        if not s["gps"]:
            continue
        area = (s["area"] if s["id"] % 11 else None) or None
        found = []
        for c in rows:
            if c["id"] == s["id"] or not c["active"] or not c["gps"] or not c["id"] % 11 or c["main"] != s["main"]:
                continue
            if s["sub"] is not None and (c["sub"] is None or abs(c["sub"] - s["sub"]) > 1):
                continue
            if area and (c["area"] is None or not area * 0.75 <= c["area"] <= area * 1.25):
                continue
            found.append((round(km((s["lat"], s["lon"]), (c["lat"], c["lon"])), 2), c["id"]))
        found.sort()
        for radius in (5, 10, 20):
            chosen = [f for f in found if f[0] <= radius][:limit]
            if len(chosen) >= 3 or radius == 20:
                break
        out[s["id"]] = chosen
    return out


def test_comparables_match_brute_force(spark):
    for seed, spread in ((4, 0.001), (5, 0.3), (6, 0.05)):
        rows = scene(seed, 260, spread)
        got: dict[int, list] = {}
        for r in comparables(*frames(spark, rows)).orderBy("subject_id", "rank").collect():
            got.setdefault(r["subject_id"], []).append((r["distance_km"], r["listing_id"]))
        want = {k: v for k, v in brute_comparables(rows).items() if v}
        assert got == want


def test_summary_notes(spark):
    listing = listings(spark, [dict(id=1, gps_lat=50.0, gps_lon=14.0), dict(id=2, gps_lat=50.0, gps_lon=14.01, price_czk=4_000_000), dict(id=3)])
    rows = {r["subject_id"]: r for r in comparables_summary(listing, details(spark, [dict(listing_id=i) for i in (1, 2, 3)])).collect()}
    assert (rows[1]["note"], rows[1]["median_comparable_price_czk"], rows[1]["deviation_from_comparables_pct"]) == ("too_few", 4_000_000, 25.0)
    assert rows[3]["note"] == "no_gps"


def test_planted_anomalies(spark):
    from datetime import timedelta

    rnd = random.Random(9)
    rows = [dict(id=i, gps_lat=50.0 + i * 0.01, gps_lon=14.0, category_sub_cb=4, price_czk=0) for i in range(1, 36)]
    area = {i: rnd.randint(40, 90) for i in range(1, 36)}
    for r in rows:
        r["price_czk"] = int(area[r["id"]] * 90_000 * rnd.uniform(0.9, 1.1))
    rows += [dict(id=40, gps_lat=50.9, gps_lon=14.9, price_czk=5_000_000), dict(id=41, gps_lat=50.90009, gps_lon=14.90009, price_czk=5_000_000),
             dict(id=42, gps_lat=50.5, gps_lon=15.0, price_czk=720_000), dict(id=43, gps_lat=50.6, gps_lon=15.0, price_czk=60 * 300_000),
             dict(id=44, gps_lat=50.7, gps_lon=15.0, price_czk=5_400_000, first_seen_at=AS_OF - timedelta(days=300))]
    area.update({40: 60, 41: 61, 42: 7, 43: 60, 44: 60})
    hist = history(spark, [(1, 4_000_000, AS_OF - timedelta(days=9)), (1, 2_000_000, AS_OF - timedelta(days=5))])
    scored = score_anomalies(listings(spark, rows), details(spark, [dict(listing_id=i, usable_area=a) for i, a in area.items()]), history_features(hist, AS_OF), AS_OF)
    flags = {r["listing_id"]: r["anomaly_flags"] for r in scored.collect()}
    assert flags[40] == flags[41] == ["possible_duplicate"]
    assert flags[42] == ["area_layout_mismatch"] and flags[43] == ["extreme_price_per_m2"]
    assert flags[44] == ["stale_listing"] and flags[1] == ["unusual_price_change"]
    assert scored.where("listing_id = 44").head()["confidence_score"] == 1.0


def test_fine_cells_merge(spark):
    cells = spark.createDataFrame(
        [("a", 50.0, 14.0, 10, 100.0, 0.1, 0.2), ("b", 50.01, 14.01, 5, None, 0.4, 0.2)],
        "grid_id string, lat_center double, lon_center double, listing_count bigint, avg_price_per_m2 double, price_drop_intensity double, turnover_rate double")
    row = coarsen(cells, 0.04).collect()
    assert len(row) == 1 and row[0]["listing_count"] == 15 and row[0]["avg_price_per_m2"] == 67.0 and row[0]["price_drop_intensity"] == 0.2
    assert row[0]["grid_id"] == "a1250_350_0.04"
