"""Per-listing price history features.

A listing may own a large part of all records. Counts, first and last prices
are plain aggregates; steps between neighbours are taken per (listing, day)
first, so that one long history is spread over many tasks, and then between
the days of a listing.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions.exprs import div, pct_change, truthy, ts
from hearthline.session import cut_lineage, growing

DROP_LOOKBACK_DAYS = 90


def first_and_count(history: DataFrame) -> DataFrame:
    """First price and number of records per listing."""
    return history.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("price_czk", F.struct("recorded_at", "id")).alias("first_price"),
    )


def latest_two(history: DataFrame) -> DataFrame:
    """Latest and previous price per listing with at least two records.

    The rank filter is applied before the shuffle as well (window group
    limit), so at most two records per listing and task are moved.
    """
    newest = Window.partitionBy("listing_id").orderBy(F.col("recorded_at").desc(), F.col("id").desc())
    top = history.select("listing_id", "price_czk", "recorded_at", "id").withColumn("rn", F.row_number().over(newest)).where("rn <= 2")
    return (
        top.groupBy("listing_id")
        .agg(
            F.max(F.when(F.col("rn") == 1, F.col("price_czk"))).alias("current_price_czk"),
            F.max(F.when(F.col("rn") == 2, F.col("price_czk"))).alias("previous_price_czk"),
        )
        .where("previous_price_czk is not null")
    )


#: What is known of a listing's records without the records. Times and ids order records; ``drop_from`` is the time of the latest record that a lower price followed.
HISTORY_SUMMARY = """
    listing_id bigint, n bigint, first_price bigint, first_at timestamp_ntz, first_id bigint, last_price bigint, last_at timestamp_ntz, last_id bigint,
    prev_price bigint, max_step_pct double, drop_from timestamp_ntz
"""
_SUMMARY = ["n", "first_price", "first_at", "first_id", "last_price", "last_at", "last_id", "prev_price", "max_step_pct", "drop_from"]


def _step_pct(prev: Column, curr: Column) -> Column:
    return F.abs(div(curr - prev, truthy(prev))) * 100


def _drop_from(prev: Column, curr: Column, prev_at: Column) -> Column:
    """When the price stood that a lower one followed."""
    return F.when(F.coalesce(curr < prev, F.lit(False)), prev_at)


def history_summary(history: DataFrame) -> DataFrame:
    """One row like ``HISTORY_SUMMARY`` per listing. Summaries of records that follow each other can be merged."""
    in_day = Window.partitionBy("listing_id", "day").orderBy("recorded_at", "id")
    price = F.col("price_czk")
    days = (
        history.select("listing_id", "price_czk", "recorded_at", "id", F.to_date("recorded_at").alias("day"))
        .withColumn("prev", F.lag("price_czk").over(in_day))
        .withColumn("prev_at", F.lag("recorded_at").over(in_day))
        .groupBy("listing_id", "day")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("recorded_at", "id", "price_czk")).alias("first"),
            F.max(F.struct("recorded_at", "id", "price_czk", "prev")).alias("last"),
            F.max(_step_pct(F.col("prev"), price)).alias("max_step_pct"),
            F.max(_drop_from(F.col("prev"), price, F.col("prev_at"))).alias("drop_from"),
        )
        .select("*", F.col("first.price_czk").alias("first_price"), F.col("last.price_czk").alias("last_price"), F.col("last.prev").alias("day_prev"))
    )
    across = Window.partitionBy("listing_id").orderBy("day")
    before, before_at, first = F.col("before"), F.col("before_at"), F.col("first_price")
    joined = days.withColumn("before", F.lag("last_price").over(across)).withColumn("before_at", F.lag(F.col("last")["recorded_at"]).over(across))
    found = joined.groupBy("listing_id").agg(
        F.sum("n").alias("n"),
        F.min_by("first_price", "day").alias("first_price"), F.min("first").alias("first"),
        F.max_by("last_price", "day").alias("last_price"), F.max("last").alias("last"),
        F.max_by(F.when(F.col("n") > 1, F.col("day_prev")).otherwise(before), F.col("day")).alias("prev_price"),
        F.max(F.greatest("max_step_pct", _step_pct(before, first))).alias("max_step_pct"),
        F.max(F.greatest("drop_from", _drop_from(before, first, before_at))).alias("drop_from"),
    )
    parts = {"first_at": "first.recorded_at", "first_id": "first.id", "last_at": "last.recorded_at", "last_id": "last.id"}
    return found.select("listing_id", *[F.col(parts.get(c, c)).alias(c) for c in _SUMMARY])


def _side_by_side(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Two sets of summaries in one row per listing, columns prefixed ``a_`` and ``b_``."""
    a = earlier.select(F.col("listing_id").alias("a_listing_id"), *[F.col(c).alias(f"a_{c}") for c in _SUMMARY])
    b = later.select(F.col("listing_id").alias("b_listing_id"), *[F.col(c).alias(f"b_{c}") for c in _SUMMARY])
    return a.join(b, F.col("a_listing_id") == F.col("b_listing_id"), "full")


def _merged(both: DataFrame) -> DataFrame:
    old, new = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    none_old, none_new = old("listing_id").isNull(), new("listing_id").isNull()
    merged = {
        "n": F.coalesce(old("n"), F.lit(0)) + F.coalesce(new("n"), F.lit(0)),
        "prev_price": F.when(none_new, old("prev_price")).when(none_old | (new("n") > 1), new("prev_price")).otherwise(old("last_price")),
        "max_step_pct": F.greatest(old("max_step_pct"), new("max_step_pct"), _step_pct(old("last_price"), new("first_price"))),
        "drop_from": F.greatest(old("drop_from"), new("drop_from"), _drop_from(old("last_price"), new("first_price"), old("last_at"))),
    }
    for c in ("first_price", "first_at", "first_id"):
        merged[c] = F.when(none_old, new(c)).otherwise(old(c))
    for c in ("last_price", "last_at", "last_id"):
        merged[c] = F.when(none_new, old(c)).otherwise(new(c))
    return both.select(F.coalesce("a_listing_id", "b_listing_id").alias("listing_id"), *[merged[c].alias(c) for c in _SUMMARY])


def merge_summaries(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Summaries of two sets of records, of which for each listing the second ones follow the first. Associative, so days can be folded in any grouping."""
    return _merged(_side_by_side(earlier, later))


def update_summary(stored: DataFrame, appended: DataFrame, history: DataFrame) -> DataFrame:
    """The stored summaries with the ``appended`` records. Only these are read; of ``history`` (all records, the appended ones among them) just the records of
    listings that got one not newer than their last known record. So records that are appended twice count once. The appended records are
    summarised and joined to the stored summaries once; the joined rows are written, as both kinds of listings are read from them."""
    known = F.col("a_listing_id").isNotNull() & F.col("b_listing_id").isNotNull()
    late = F.coalesce(known & (F.struct("b_first_at", "b_first_id") <= F.struct("a_last_at", "a_last_id")), F.lit(False))
    both = cut_lineage(_side_by_side(stored, history_summary(appended)).withColumn("late", late), "both-summaries")
    again = both.where("late").select(F.col("a_listing_id").alias("listing_id"))
    return _merged(both.where("NOT late")).unionByName(history_summary(history.join(growing(again), "listing_id", "left_semi")))


def features_of(summary: DataFrame, as_of: datetime, lookback_days: int = DROP_LOOKBACK_DAYS) -> DataFrame:
    """n, first, last and previous price, change, drops and largest step per listing."""
    since = ts(as_of - timedelta(days=lookback_days))
    return summary.select(
        "listing_id", "n", "first_price", "last_price", "prev_price", F.col("drop_from").isNotNull().alias("any_drop"), F.coalesce(F.col("drop_from") >= since, F.lit(False)).alias("drop_90d"),
        "max_step_pct", F.when(F.col("n") >= 2, pct_change(F.col("last_price"), truthy(F.col("first_price")))).alias("change_pct"),
    )


def history_features(history: DataFrame, as_of: datetime, lookback_days: int = DROP_LOOKBACK_DAYS) -> DataFrame:
    """One row per listing: n, first/last/previous price, change, drops and largest step."""
    return features_of(history_summary(history), as_of, lookback_days)


def price_evolution(history: DataFrame, listing_ids: DataFrame | list[int], as_of: datetime, days: int = 365) -> DataFrame:
    """Records of the given listings since ``days`` before ``as_of``, oldest first."""
    recent = history.where(F.col("recorded_at") >= ts(as_of - timedelta(days=days)))
    if isinstance(listing_ids, DataFrame):
        recent = recent.join(listing_ids.select("listing_id").distinct(), "listing_id", "left_semi")
    else:
        recent = recent.where(F.col("listing_id").isin(list(listing_ids)))
    return recent.select("listing_id", "price_czk", "recorded_at", "id").orderBy("listing_id", "recorded_at", "id").drop("id")
