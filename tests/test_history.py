import random
from collections import defaultdict
from datetime import datetime, timedelta

from fixtures import AS_OF, history, listings
from hearthline.operators.history import history_features, latest_two
from hearthline.operators.listings import price_drops


def brute(rows, as_of):
    by = defaultdict(list)
    for i, (listing, price, at) in enumerate(rows):
        by[listing].append((at, i, price))
    out = {}
    for listing, recs in by.items():
        recs.sort()
        prices = [p for _, _, p in recs]
        steps = list(zip(recs, recs[1:]))
        out[listing] = (
            len(prices), prices[0], prices[-1], prices[-2] if len(prices) > 1 else None,
            any(b[2] < a[2] for a, b in steps),
            any(b[2] < a[2] and a[0] >= as_of - timedelta(days=90) for a, b in steps),
            max((abs(b[2] - a[2]) / a[2] * 100 for a, b in steps if a[2]), default=None),
        )
    return out


def test_features_match_brute_force_with_a_hot_listing(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(3000):
        listing = 1 if rnd.random() < 0.4 else rnd.randint(2, 400)
        rows.append((listing, rnd.choice([0, 100, 120, 90, 300]), AS_OF - timedelta(hours=rnd.randint(0, 4000))))
    got = {r["listing_id"]: tuple(r[c] for c in ("n", "first_price", "last_price", "prev_price", "any_drop", "drop_90d", "max_step_pct"))
           for r in history_features(history(spark, rows), AS_OF).collect()}
    want = brute(rows, AS_OF)
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key][:6] == value[:6]
        assert (got[key][6] is None) == (value[6] is None) and abs((got[key][6] or 0) - (value[6] or 0)) < 1e-9


def test_days_folded_in_any_grouping_equal_all_records(spark):
    """Days are merged one by one, in blocks, and with late and repeated records; the result is that of all records at once."""
    from pyspark.sql import functions as F

    from hearthline.operators.history import features_of, history_summary, merge_summaries, update_summary

    rnd = random.Random(6)
    rows = [(1 if rnd.random() < 0.3 else rnd.randint(2, 60), rnd.choice([0, 100, 120, 90, 300]), AS_OF - timedelta(hours=rnd.randint(0, 24 * 8))) for _ in range(900)]
    records = history(spark, rows).withColumn("day", F.datediff("recorded_at", F.lit((AS_OF - timedelta(days=10)).date()))).cache()
    whole = sorted(map(str, history_features(records, AS_OF).collect()))
    day = lambda a, b: records.where(F.col("day").between(a, b))
    one = history_summary(day(0, 4))
    for k in range(5, 12):
        one = merge_summaries(one, history_summary(day(k, k)))
    blocks = merge_summaries(history_summary(day(0, 3)), merge_summaries(history_summary(day(4, 6)), history_summary(day(7, 12))))
    assert sorted(map(str, features_of(one, AS_OF).collect())) == sorted(map(str, features_of(blocks, AS_OF).collect())) == whole
    late = records.where("id % 5 = 0")
    summary = history_summary(records.where("id % 5 <> 0"))
    for _ in range(2):
        summary = update_summary(summary, late, records)
    assert sorted(map(str, features_of(summary, AS_OF).collect())) == whole


def test_price_drop_of_ten_percent(spark):
    t0, t1 = AS_OF - timedelta(days=20), AS_OF - timedelta(days=2)
    hist = history(spark, [(1, 1_000_000, t0), (1, 900_000, t1), (2, 500_000, t0), (2, 500_000, t1), (3, 10, t0), (3, 5, t1)])
    rows = price_drops(listings(spark, [{"id": 1}, {"id": 2}, {"id": 3, "is_active": False}]), hist).collect()
    assert [(r["listing_id"], r["drop_pct"]) for r in rows] == [(1, 10.0)]


def test_top_two_is_cut_before_the_shuffle(spark):
    plan = latest_two(history(spark, [(1, 5, datetime(2020, 1, 1))]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
