"""What a step does once, and not for each character, stay, or wide row."""

import pandas as pd

from hearthline.operators.listings import joined_listings
from hearthline.sources import payloads as pay
from hearthline.streaming.stateful import Presence, PriceChanges

HOUR = 3_600_000_000


class Value:
    def __init__(self, kept=None):
        self.kept, self.calls = kept, 0

    def get(self):
        self.calls += 1
        return self.kept

    def exists(self):
        self.calls += 1
        return self.kept is not None

    def update(self, value):
        self.kept = value


class Handle:
    def __init__(self, value):
        self.value, self.timers, self.calls = value, set(), 0

    def getValueState(self, name, schema):
        return self.value

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def seen(*hours):
    return iter([pd.DataFrame({"at": [h * HOUR for h in hours]})])


def test_presence_sets_one_timer_in_a_batch():
    handle, stays = Handle(Value()), Presence(20 * HOUR)
    stays.init(handle)
    (events,) = stays.handleInputRows((7,), seen(200, 0, 5, 50, 100), None)
    assert events["event"].tolist() == ["removed", "returned"] * 3 and events["sightings"].tolist() == [2, 1, 1, 1, 1, 1]
    assert handle.calls == 1 and handle.timers == {stays.due(200 * HOUR)}
    assert list(stays.handleInputRows((7,), seen(210), None)) == []
    assert handle.calls == 3 and handle.timers == {stays.due(210 * HOUR)}
    assert list(stays.handleInputRows((7,), seen(205), None)) == []
    assert handle.calls == 3 and handle.value.kept == (200 * HOUR, 210 * HOUR, 3, True) and handle.value.calls == 3


def test_a_price_without_a_step_makes_no_frame():
    prices = PriceChanges()
    prices.init(Handle(Value()))
    rows = lambda *p: iter([pd.DataFrame({"at": [a for a, _ in p], "price": [float(v) for _, v in p]})])
    assert list(prices.handleInputRows((1,), rows((2, 5), (1, 5)), None)) == []
    (steps,) = prices.handleInputRows((1,), rows((3, 6)), None)
    assert steps.values.tolist() == [[1, 5.0, 6.0, 3]]


def test_wide_rows_are_not_dealt_by_place(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined_listings(tables.listing, tables.listing_detail, tables.location)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(place_id" in plan and "hashpartitioning(location_id" not in plan


def test_only_json_is_parsed_as_json(spark, monkeypatch):
    docs, texts, parse = spark.createDataFrame([("{}",)], "payload string"), [], pay.F.from_json
    monkeypatch.setattr(pay.F, "from_json", lambda text, shape: texts.append(str(text).lower()) or parse(text, shape))
    pay.parse_detail(docs)
    assert len(texts) == 2 and "contains(payload" in texts[0] and "rlike(_d.locality" in texts[1]


def test_odd_wrappers_and_places(spark):
    payloads = [r'{"\u0072esult": {"usable_area": 5}}', '{"result": {"usable_area": 6}}', '{"result": null, "usable_area": 7}', '{"usable_area": 8, "description": "result"}']
    rows = spark.createDataFrame(list(enumerate(payloads)), "pos int, payload string")
    assert [r["usable_area"] for r in pay.parse_detail(rows, keep=("pos",)).orderBy("pos").collect()] == [5, 6, 7, 8]
    places = ['{"locality": "Praha"}', '{"locality": {"city": "Brno"}}', r'{"locality": "\n {\"city_seo_name\": \"brno\"}"}', '{"locality": 5}', "{}"]
    found, _ = pay.parsed_payloads(spark.createDataFrame(list(enumerate(places)), "pos int, payload string"), pay.LIST_SHAPE)
    assert [(r["_l"] or {})["city"] if r["_l"] else None for r in found.orderBy("pos").collect()] == [None, "Brno", None, None, None]
    assert found.orderBy("pos").collect()[2]["_l"]["city_seo_name"] == "brno"
