import json
from datetime import timedelta

import pytest

from fixtures import AS_OF, listings
from hearthline.plans import sweep
from hearthline.schemas import IMAGE, LISTING, PRICE_HISTORY, RAW_PAYLOAD
from hearthline.sources import payloads as pay
from hearthline.sources.bucketed import BucketedState
from hearthline.streaming import jobs


def item(hash_id, price, name="Byt 2+kk", **extra):
    return {"hash_id": hash_id, "advert_name": name, "category_main_cb": {"name": "Byt", "value": 1}, "category_type_cb": {"name": "Prodej", "value": 1},
            "category_sub_cb": {"name": "2+kk", "value": 4}, "price_czk": price,
            "locality": {"city": "Praha", "citypart": "Smíchov", "gps_lat": 50.07, "gps_lon": 14.4}, **extra}


def docs(spark, items):
    return spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(items)], "pos int, payload string")


ROUND1 = [item(71, 6_150_000), item(72, 2_480_000), item(73, 9_900_000), item(71, 1)]
ROUND2 = [item(71, 5_870_000), item(73, 9_900_000), item(74, 3_310_000), item(75, 9, name=None)]


def test_two_sweeps(spark):
    empty = listings(spark, []).limit(0)
    one = sweep.sweep_payloads(empty, docs(spark, ROUND1), AS_OF, ["pos"])
    assert one.counters.head().asDict() == dict(items_seen=3, items_new=3, items_updated=0, items_removed=0, error_count=0)
    two = sweep.sweep_payloads(one.listing, docs(spark, ROUND2), AS_OF + timedelta(days=1), ["pos"], sweep.SweepEvidence(True, 0, 0.0), run_id=2)
    assert two.counters.head().asDict() == dict(items_seen=3, items_new=1, items_updated=1, items_removed=1, error_count=1)
    state = {r["hash_id"]: r for r in two.listing.collect()}
    assert state["71"]["price_czk"] == 5_870_000 and state["71"]["first_seen_at"] == AS_OF
    assert not state["72"]["is_active"] and state["72"]["removed_at"] == AS_OF + timedelta(days=1)
    assert state["74"]["locality_text"] == "Praha - Smíchov"
    assert state["71"]["source_url"].endswith("/detail/prodej/byt/2+kk/detail/71")
    ids = {h: r["id"] for h, r in state.items()}
    prices = one.history.unionByName(two.history)
    by = {h: [r["price_czk"] for r in prices.where(prices.listing_id == ids[h]).orderBy("recorded_at").collect()] for h in ids}
    assert by == {"71": [6_150_000, 5_870_000], "72": [2_480_000], "73": [9_900_000], "74": [3_310_000]}
    assert [(r["stage"], r["hash_id"]) for r in two.rejects.collect()] == [("validate", "75")]
    assert sweep.new_history_only(prices, two.history).count() == 0


def test_incomplete_sweep_removes_nothing(spark):
    state = listings(spark, [dict(id=1), dict(id=2)])
    batch = pay.parse_list(docs(spark, [item(1, 5)]))
    for evidence in (None, *[sweep.SweepEvidence(*args) for args in ((False, 0, 0.0), (True, 1, 0.0), (True, 0, 9.0))]):
        out = sweep.apply_sweep(state, batch, AS_OF, evidence)
        assert out.listing.where("is_active").count() == 2


def test_reactivated_listing(spark):
    state = listings(spark, [dict(id=1, is_active=False, removed_at=AS_OF)])
    row = sweep.apply_sweep(state, pay.parse_list(docs(spark, [item(1, None)])), AS_OF).listing.head()
    assert row["is_active"] and row["removed_at"] is None and row["price_czk"] == 5_000_000 and row["gps_lat"] == 50.07


def test_union_of_slices(spark):
    batch = spark.createDataFrame([("c", 1, 0, "a"), ("c", 1, 1, "b"), ("c", 2, 0, "b"), ("c", 2, 1, "c"), ("c", 2, 2, "d")], "category string, slice_no int, position int, hash_id string")
    unique, gaps = sweep.union_slices(batch, spark.createDataFrame([("c", 5)], "category string, probed_total bigint"))
    assert sorted(r["hash_id"] for r in unique.collect()) == ["a", "b", "c", "d"]
    assert [(g["recovered"], g["gap"], g["gap_pct"]) for g in gaps.collect()] == [(4, 1, 20.0)]


def test_older_list_shape(spark):
    old = {"hash_id": "77", "name": "Dům", "seo": {"category_main_cb": 2, "category_type_cb": 1, "category_sub_cb": 37, "locality": "brno-stred"},
           "price_czk": {"value_raw": 8_000_000, "unit": "za nemovitost"}, "gps": {"lat": 49.2, "lon": 16.6}, "locality": "Brno"}
    row = pay.parse_list(docs(spark, [old])).head()
    assert (row["category_main_cb"], row["price_czk"], row["price_czk_unit"], row["gps_lat"], row["locality_text"]) == (2, 8_000_000, "za nemovitost", 49.2, "Brno")
    assert row["source_url"].endswith("/detail/prodej/ostatni/ostatni/brno-stred/77")


def test_detail_shapes(spark):
    new = {"result": {"hash_id": 5, "usable_area": 65, "floor_number": 3, "floors": 5, "furnished": {"value": 2}, "balcony": True, "garage": 0, "edited": "2026-01-31",
                      "premise": {"ask_id": 12, "name": "RK"}, "locality": {"region": "Jihomoravský kraj", "city": " Brno ", "region_id": 14}, "advert_images": [{"url": "u1"}, "u2", {"href": "u3"}]}}
    old = {"text": {"value": "popis"}, "recommendations_data": {"ownership": 1, "locality_region_id": 10}, "edited": "2020-01-01",
           "items": [{"name": "Užitná plocha", "value": "40 m²"}, {"name": "Užitná plocha", "value": "41 m²"}, {"name": "Podlaží", "value": "2/4"}, {"name": "Aktualizace", "value": "3.1.2026"}],
           "_embedded": {"images": {"_embedded": {"images": [{"href": "h1"}, {}]}}}}
    rows = pay.parse_detail(docs(spark, [new, old, {}]), keep=("pos",)).orderBy("pos").collect()
    a, b, c = rows
    assert (a["usable_area"], a["floor"], a["floor_number"], a["total_floors"], a["furnished"], a["balcony"], a["garage"]) == (65, "3/5", 3, 5, "2", True, False)
    assert (a["broker_id"], a["broker_company"], a["images"], a["location"]["municipality"], str(a["last_updated_at"])[:10]) == ("12", "RK", ["u1", "u2", "u3"], "Brno", "2026-01-31")
    assert (b["description"], b["usable_area"], b["floor_number"], b["ownership"], b["images"], b["location"]["locality_region_id"], str(b["last_updated_at"])[:10]) == (
        "popis", 41, 2, "1", ["h1"], 10, "2026-01-03")
    assert c["usable_area"] is None and c["images"] == []


def test_prune_keeps_the_newest_list_payload(spark):
    rows = [(1, None, "a", "list", "{}", AS_OF), (2, None, "a", "list", "{}", AS_OF + timedelta(hours=1)), (3, 9, "a", "detail", "{}", AS_OF)]
    df = spark.createDataFrame(rows, RAW_PAYLOAD)
    assert sorted(r["id"] for r in pay.newest_list_payloads(df).collect()) == [2, 3]


REJECT = "run_id bigint, hash_id string, stage string, message string, created_at timestamp_ntz"
LANDED = "pos int, payload string, sweep bigint, swept_at timestamp_ntz"


def stream_tables(spark, root):
    return [BucketedState(spark, f"{root}/s", LISTING, "hash_id", buckets=8), *[jobs.VersionedTable(spark, f"{root}/{n}", s) for n, s in (("h", PRICE_HISTORY), ("r", REJECT), ("p", jobs.SWEEP_PART))]]


@pytest.mark.parametrize("restart", [False, True])
def test_streamed_sweeps_equal_batch_sweeps(spark, tmp_path, restart):
    """Two sweeps of two files each give the state of two batch sweeps; the end of the second is declared complete."""
    landed, tables = str(tmp_path / "landed"), stream_tables(spark, tmp_path)
    ends = spark.createDataFrame([(2, 4, True, 0, 0.0)], jobs.SWEEP_END)

    def land(number, items, at):
        rows = [(i, json.dumps(d), number, at) for i, d in enumerate(items)]
        for part in (rows[:2], rows[2:]):
            spark.createDataFrame(part, LANDED).coalesce(1).write.mode("append").parquet(landed)

    def run():
        source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.ingest_sweeps(source, *tables, str(tmp_path / "c"), ["pos"], ends=lambda: ends).awaitTermination()

    land(1, ROUND1, AS_OF)
    if restart:
        run()
    land(2, ROUND2, AS_OF + timedelta(days=1))
    run()
    one = sweep.sweep_payloads(listings(spark, []).limit(0), docs(spark, ROUND1), AS_OF, ["pos"])
    two = sweep.sweep_payloads(one.listing, docs(spark, ROUND2), AS_OF + timedelta(days=1), ["pos"], sweep.SweepEvidence(True, 0, 0.0))
    assert sorted(map(str, tables[0].read().collect())) == sorted(map(str, two.listing.collect()))
    assert tables[1].all_versions().count() == 5 and tables[2].all_versions().count() == 1
    runs = {r["id"]: (r["status"], r["items_seen"], r["items_new"], r["items_updated"], r["items_removed"], r["error_count"]) for r in jobs.sweep_runs(tables[3].all_versions()).collect()}
    assert runs == {1: ("running", 3, 3, 0, 0, 0), 2: ("partial", 3, 1, 1, 1, 1)}
    # old versions put together, old states forgotten: the same rows, and nothing is done twice when the stream goes on
    before = [sorted(map(str, x.collect())) for x in (tables[0].read(), *(x.all_versions() for x in tables[1:]))]
    assert all(x.compact() == 3 and x.compact() == 0 and len(x.versions()) == 1 for x in tables[1:]) and tables[0].vacuum() > 0
    run()
    assert [sorted(map(str, x.collect())) for x in (tables[0].read(), *(x.all_versions() for x in tables[1:]))] == before


def test_a_sweep_ends_without_a_new_file(spark, tmp_path):
    """Declared after its last file, the sweep is ended by a call of its own, once; later batches start from that state."""
    landed, tables = str(tmp_path / "landed"), stream_tables(spark, tmp_path)

    def land(number, items, at):
        spark.createDataFrame([(i, json.dumps(d), number, at) for i, d in enumerate(items)], LANDED).coalesce(1).write.mode("append").parquet(landed)
        source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(landed)
        jobs.ingest_sweeps(source, *tables, str(tmp_path / "c"), ["pos"]).awaitTermination()

    land(1, [item(500 + k, 10**6) for k in range(6)], AS_OF)
    land(2, [item(500 + k, 10**6) for k in range(4)], AS_OF + timedelta(days=1))
    assert jobs.close_sweeps(tables[0], tables[3], spark.createDataFrame([(2, 5, True, 0, 0.0), (7, 1, True, 0, 0.0)], jobs.SWEEP_END)) == 0  # a payload is missing
    assert jobs.close_sweeps(tables[0], tables[3], spark.createDataFrame([(1, 6, True, 2, 0.0)], jobs.SWEEP_END)) == 1  # failed pages: ends, removes nothing
    assert tables[0].read().where("is_active").count() == 6
    ends = spark.createDataFrame([(2, 4, True, 0, 0.0)], jobs.SWEEP_END)
    assert [jobs.close_sweeps(tables[0], tables[3], ends) for _ in range(2)] == [1, 0]
    gone = {r["hash_id"]: r["removed_at"] for r in tables[0].read().where("NOT is_active").collect()}
    assert gone == {"504": AS_OF + timedelta(days=1), "505": AS_OF + timedelta(days=1)}
    runs = {r["id"]: (r["status"], r["items_removed"]) for r in jobs.sweep_runs(tables[3].all_versions()).collect()}
    assert runs == {1: ("partial", 0), 2: ("success", 2)}
    land(3, [item(504, 10**6)], AS_OF + timedelta(days=2))
    assert tables[0].read().where("is_active").count() == 5


def test_open_sweep_removes_nothing(spark, tmp_path):
    """Nine listings landed in three files, sweep not declared: all stay active."""
    landed, tables = str(tmp_path / "landed"), stream_tables(spark, tmp_path)
    for k in range(3):
        rows = [(3 * k + i, json.dumps(item(500 + 3 * k + i, 1_000_000 + i)), 1, AS_OF) for i in range(3)]
        spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(landed)
    source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(landed)
    jobs.ingest_sweeps(source, *tables, str(tmp_path / "c"), ["pos"]).awaitTermination()
    assert tables[0].read().where("is_active").count() == 9


def test_details_of_one_listing_are_stored_once(spark):
    parsed = pay.parse_detail(spark.createDataFrame([(1, 1, '{"usable_area": 40, "advert_images": ["a"]}'), (1, 2, '{"usable_area": 44, "advert_images": ["b", "c"]}'), (2, 1, "{")], "listing_id bigint, at int, payload string"), keep=("listing_id", "at"))
    from fixtures import details, locations

    tables = {"listing": listings(spark, [dict(id=1), dict(id=2), dict(id=3)]), "location": locations(spark, []), "listing_detail": details(spark, [dict(listing_id=3)]), "image": spark.createDataFrame([(9, 3, "z", 0, None)], IMAGE)}
    for _ in range(2):
        tables = sweep.apply_details(tables["listing"], tables["location"], parsed, AS_OF, ["at"], tables["listing_detail"], tables["image"])
    assert tables["listing"].count() == 3
    assert sorted((r["listing_id"], r["usable_area"]) for r in tables["listing_detail"].where("listing_id <> 3").collect()) == [(1, 44), (2, None)]
    assert sorted((r["listing_id"], r["position"], r["url"]) for r in tables["image"].collect()) == [(1, 0, "b"), (1, 1, "c"), (3, 0, "z")]


def test_payloads_are_parsed_once(spark):
    good, bad = sweep.split_items(docs(spark, ROUND2))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (good, pay.parse_list(good), bad)]
    assert [p.count("from_json") for p in plans[1:]] == [2, 2] and plans[0].count("from_json") <= 2  # the document and its locality


def test_payload_files_are_read_line_by_line(spark, tmp_path):
    lines = [json.dumps(d, ensure_ascii=False) for d in ROUND1[:3]] + ["{broken"]
    (tmp_path / "a.json").write_text("\n".join(lines), encoding="utf-8")
    rows = pay.read_payloads(spark, str(tmp_path))
    assert rows.where("fetched_at is not null").count() == 4
    good, bad = sweep.split_items(rows)
    assert sorted(r["hash_id"] for r in pay.parse_list(good).collect()) == ["71", "72", "73"]
    assert bad.count() == 1
    out = str(tmp_path / "archive")
    pay.archive_payloads(rows, out)
    pay.archive_payloads(rows, out)
    assert spark.read.parquet(out).count() == 8
    stream = jobs.read_payload_stream(spark, str(tmp_path / "*.json"))
    assert stream.isStreaming and "payload" in stream.columns


def test_counters_come_with_the_written_listings(tables):
    """The counts that are observed while the next state is written are those of the separate job."""
    from pyspark.sql import Observation

    from catalog.ingest import _BY_HASH, COMPLETE, batch_of

    counted = Observation()
    result = sweep.apply_sweep(tables.listing, batch_of(tables), AS_OF, COMPLETE, new_id=_BY_HASH, counted=counted)
    result.listing.write.format("noop").mode("overwrite").save()
    want = result.counters.first().asDict()
    assert counted.get == {k: want[k] for k in ("items_seen", "items_new", "items_updated", "items_removed")} and want["items_new"] > 0


@pytest.mark.parametrize("files", [1, 9])
def test_a_batch_is_parsed_and_written_once(spark, tmp_path, monkeypatch, files):
    """A batch of one sweep writes its buckets once and parses nothing for the rejects; several sweeps in a batch give the same tables."""
    landed, tables, copies, written, plans = str(tmp_path / "landed"), stream_tables(spark, tmp_path), [], [], []
    cut, write, version = jobs.cut_lineage, BucketedState.write, jobs.VersionedTable.write
    monkeypatch.setattr(jobs, "cut_lineage", lambda df, name: copies.append(name) or cut(df, name))
    monkeypatch.setattr(BucketedState, "write", lambda self, rows, *a, **k: written.append(k) or write(self, rows, *a, **k))
    monkeypatch.setattr(jobs.VersionedTable, "write", lambda self, df, v: plans.append((self.path[-1], df._jdf.queryExecution().toString())) or version(self, df, v))
    for number, items in ((1, ROUND1), (2, ROUND2)):
        rows = [(i, json.dumps(d), number, AS_OF + timedelta(days=number - 1)) for i, d in enumerate(items)]
        for part in (rows[:2], rows[2:]):
            spark.createDataFrame(part, LANDED).coalesce(1).write.mode("append").parquet(landed)
    ends = spark.createDataFrame([(2, 4, True, 0, 0.0)], jobs.SWEEP_END)
    source = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).parquet(landed)
    jobs.ingest_sweeps(source, *tables, str(tmp_path / "c"), ["pos"], ends=lambda: ends).awaitTermination()
    assert (len(copies), len(written)) == ((0, 5) if files == 1 else (1, 2))
    assert all("InMemoryTableScan" in plan for kind, plan in plans if kind == "r")
    one = sweep.sweep_payloads(listings(spark, []).limit(0), docs(spark, ROUND1), AS_OF, ["pos"])
    two = sweep.sweep_payloads(one.listing, docs(spark, ROUND2), AS_OF + timedelta(days=1), ["pos"], sweep.SweepEvidence(True, 0, 0.0))
    text = lambda *frames: sorted(str(r.asDict()) for f in frames for r in f.collect())
    assert text(tables[0].read()) == text(two.listing)
    assert text(tables[1].all_versions()) == text(*[r.history.select(*tables[1].all_versions().columns) for r in (one, two)])


def test_history_is_found_from_the_states(tables):
    from catalog.ingest import _BY_HASH, COMPLETE, batch_of
    from hearthline.functions.exprs import ts
    from hearthline.session import cut_lineage

    result = sweep.apply_sweep(tables.listing, batch_of(tables), AS_OF, COMPLETE, new_id=_BY_HASH)
    found = sweep.repriced_since(tables.listing, cut_lineage(result.listing, "after"), ts(AS_OF))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, result.history.collect())) and found.count() > 0
