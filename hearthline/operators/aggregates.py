"""Grouped summaries of listings, estimates, scores and regions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions import codebooks as cb
from hearthline.functions.exprs import div, truthy, ts


def _nonzero_avg(x: Column) -> Column:
    """Mean, with a mean of exactly zero shown as missing."""
    return truthy(F.avg(x))


def with_area(listing: DataFrame, detail: DataFrame, *extra: str) -> DataFrame:
    """Listing columns plus usable area and ``extra`` detail columns."""
    d = detail.select(F.col("listing_id").alias("detail_key"), "usable_area", *extra)
    return listing.join(d, F.col("id") == F.col("detail_key"), "left").drop("detail_key")


def price_per_m2_by_location(listing: DataFrame, detail: DataFrame, location: DataFrame, main: int | None = None) -> DataFrame:
    """Mean price and price per m2 of active listings per region, district and municipality."""
    active = listing.where("is_active")
    if main:
        active = active.where(F.col("category_main_cb") == main)
    loc = location.select(F.col("id").alias("loc_id"), "district", "municipality")
    return (
        with_area(active, detail)
        .join(loc, F.col("location_id") == F.col("loc_id"), "left")
        .groupBy(F.coalesce("resolved_region_name", F.lit(cb.UNKNOWN_LABEL)).alias("region"), "district", "municipality")
        .agg(
            _nonzero_avg(F.col("price_czk")).alias("avg_price_czk"),
            _nonzero_avg(div(F.col("price_czk"), F.col("usable_area"))).alias("avg_price_per_m2"),
            F.count(F.lit(1)).alias("listing_count"),
        )
    )


def inventory_by_region(listing: DataFrame) -> DataFrame:
    """Active listings per region; the unknown bucket comes last."""
    region = F.coalesce("resolved_region_name", F.lit(cb.UNKNOWN_LABEL)).alias("region")
    counted = listing.where("is_active").groupBy(region).agg(F.count(F.lit(1)).alias("listing_count"))
    return counted.orderBy(F.col("region") == cb.UNKNOWN_LABEL, F.col("listing_count").desc(), "region")


def _known_or(book: dict, value: Column) -> Column:
    return F.coalesce(cb.lookup(book, value), value.cast("string"))


def _coded(book: dict, column: str) -> tuple[Column, Column]:
    value = F.coalesce(column, F.lit(cb.UNKNOWN_SEGMENT))
    known = (value != "") & (value != cb.UNKNOWN_SEGMENT)
    return value, F.when(known, cb.code_label(book, value)).otherwise(F.lit(cb.UNKNOWN_LABEL))


def dimensions() -> dict[str, tuple[Column, Column]]:
    """Allowed breakdown dimensions: (group value, label)."""
    main, deal = F.col("category_main_cb"), F.col("category_type_cb")
    sub = F.coalesce("category_sub_cb", F.lit(cb.UNKNOWN_SUB))
    region = F.coalesce("resolved_region_name", F.lit(cb.UNKNOWN_LABEL))
    return {
        "category_main_cb": (main, _known_or(cb.PROPERTY_TYPES, main)),
        "category_type_cb": (deal, _known_or(cb.DEAL_TYPES, deal)),
        "category_sub_cb": (sub, F.coalesce(cb.lookup(cb.ROOM_LAYOUTS, sub), F.lit(cb.UNKNOWN_LABEL))),
        "building_condition": _coded(cb.BUILDING_CONDITION, "building_condition"),
        "ownership": _coded(cb.OWNERSHIP, "ownership"),
        "energy_efficiency_rating": _coded(cb.ENERGY_RATING, "energy_efficiency_rating"),
        "region": (region, F.coalesce(F.nullif(region, F.lit("")), F.lit(cb.UNKNOWN_LABEL))),
    }


_DETAIL_DIMS = ("building_condition", "ownership", "energy_efficiency_rating")


def segment_breakdown(listing: DataFrame, detail: DataFrame, dimension: str, main: int | None = None) -> DataFrame:
    """Count and mean prices of active listings per value of one dimension."""
    allowed = dimensions()
    if dimension not in allowed:
        raise ValueError(f"unknown dimension {dimension!r}; allowed: {', '.join(allowed)}")
    return segment_breakdowns(listing, detail, [dimension], main).drop("dimension")


def segment_breakdowns(listing: DataFrame, detail: DataFrame, names: list[str] | None = None, main: int | None = None) -> DataFrame:
    """Several dimensions over one scan; values are text.

    Each row is counted once per dimension; the partial aggregate leaves one
    row per value and task before the shuffle.
    """
    allowed = dimensions()
    names = list(allowed) if names is None else names
    active = listing.where("is_active")
    if main is not None:
        active = active.where(F.col("category_main_cb") == main)
    cells = F.array(
        *[F.struct(F.lit(n).alias("dimension"), allowed[n][0].cast("string").alias("value"), allowed[n][1].alias("label")) for n in names]
    )
    return (
        with_area(active, detail, *_DETAIL_DIMS)
        .select(F.explode(cells).alias("d"), "price_czk", div(F.col("price_czk"), F.col("usable_area")).alias("m2"))
        .groupBy("d.dimension", "d.value", "d.label")
        .agg(
            F.count(F.lit(1)).alias("listing_count"),
            _nonzero_avg(F.col("price_czk")).alias("avg_price_czk"),
            _nonzero_avg(F.col("m2")).alias("avg_price_per_m2"),
        )
        .orderBy("dimension", F.col("listing_count").desc(), "value")
    )


def new_vs_removed(listing: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    since = ts(as_of - timedelta(days=days))
    return listing.agg(
        F.count_if(F.col("first_seen_at") >= since).alias("new_count"),
        F.count_if(F.col("removed_at") >= since).alias("removed_count"),
        F.lit(days).alias("period_days"),
    )


def _active_ids(listing: DataFrame) -> DataFrame:
    return listing.where("is_active").select(F.col("id").alias("listing_id"))


def valuation_summary(listing: DataFrame, valuation: DataFrame) -> DataFrame:
    """Stored estimates of active listings per class, with the total on each row."""
    by_class = (
        valuation.join(_active_ids(listing), "listing_id", "left_semi")
        .groupBy(F.coalesce(F.nullif("classification", F.lit("")), F.lit("unclassified")).alias("classification"))
        .agg(F.count(F.lit(1)).alias("listing_count"))
    )
    return by_class.select("*", by_class.agg(F.sum("listing_count")).scalar().alias("total_valued_listings"))


def anomaly_summary(listing: DataFrame, anomaly: DataFrame, min_score: float = 0) -> DataFrame:
    """Scored, matching and per-flag counts of active listings in long form."""
    scored = anomaly.join(_active_ids(listing), "listing_id", "left_semi")
    hit = F.col("anomaly_score") >= min_score
    names = F.concat(
        F.array(F.lit("total_scored_listings")),
        F.when(hit, F.concat(F.array(F.lit("matching_min_score")), F.transform(F.coalesce("anomaly_flags", F.array().cast("array<string>")), lambda f: F.concat(F.lit("flag:"), f)))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    return scored.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("listing_count"))


def category_slices(listing: DataFrame) -> DataFrame:
    """Active and total count per (main, type)."""
    return listing.groupBy("category_main_cb", "category_type_cb").agg(
        F.count_if("is_active").alias("active_count"), F.count(F.lit(1)).alias("total_count")
    )


def active_slice_count(listing: DataFrame) -> DataFrame:
    return category_slices(listing).agg(F.count_if(F.col("active_count") > 0).alias("active_category_slice_count"))


def duplicate_keys(listing: DataFrame) -> DataFrame:
    """How many hash ids occur more than once."""
    return (
        listing.groupBy("hash_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_hash_ids"))
    )


def last_dataset_update(listing: DataFrame, detail: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest of listing sightings, detail updates and starts of running runs."""
    moments = (
        listing.agg(F.max("last_seen_at").alias("at"))
        .unionByName(detail.agg(F.max("updated_at").alias("at")))
        .unionByName(runs.where("status = 'running'").groupBy("run_type").agg(F.max_by("started_at", "id").alias("at")).select("at"))
    )
    return moments.agg(F.max("at").alias("last_dataset_update_at"))


def region_resolution_stats(listing: DataFrame, active_only: bool = True) -> DataFrame:
    """Counts by source, by unknown reason and in total, in long form."""
    rows = listing.where("is_active") if active_only else listing
    unknown = F.col("region_source") == "unknown"
    names = F.array_compact(
        F.array(
            F.lit("active_total"),
            F.when(F.col("resolved_region_name").isNotNull(), F.lit("with_region")),
            F.when(unknown, F.lit("unknown_region")),
            F.when(F.col("region_source").isNull(), F.lit("unset_region")),
            F.concat(F.lit("source:"), F.coalesce("region_source", F.lit("unset"))),
            F.when(unknown, F.concat(F.lit("reason:"), F.coalesce("region_unknown_reason", F.lit("unset")))),
        )
    )
    return rows.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count(F.lit(1)).alias("listing_count"))


def dataset_counts(listing: DataFrame, detail: DataFrame, valuation: DataFrame, anomaly: DataFrame) -> DataFrame:
    """One row of coverage counts over the active listings."""
    base = listing.agg(
        F.count_if("is_active").alias("active_listing_count"),
        F.count(F.lit(1)).alias("total_listing_count"),
        F.count_if(F.col("is_active") & F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).alias("active_with_gps_count"),
        F.count_if(F.col("is_active") & F.col("resolved_region_name").isNotNull()).alias("active_with_region_count"),
        F.count_if(F.col("is_active") & F.col("region_source").isNull()).alias("unset_region_source_count"),
    )
    active = _active_ids(listing)
    joined = {
        f"active_with_{name}_count": table.select("listing_id").join(active, "listing_id", "left_semi").agg(F.count(F.lit(1))).scalar()
        for name, table in (("detail", detail), ("valuation", valuation), ("anomaly", anomaly))
    }
    return base.select(
        "*",
        *[count.alias(name) for name, count in joined.items()],
        (F.col("active_listing_count") - F.col("active_with_gps_count")).alias("active_without_gps_count"),
        (F.col("active_listing_count") - F.col("active_with_region_count")).alias("active_without_region_count"),
        F.col("active_listing_count").alias("inventory_region_listing_sum"),
        (F.col("unset_region_source_count") > 0).alias("needs_region_backfill"),
    )


def snapshot_rollup(snapshots: DataFrame) -> DataFrame:
    """Sums and means of the segment rows per snapshot date."""
    return snapshots.groupBy("snapshot_date").agg(
        F.sum("listing_count").alias("listing_count"),
        F.sum("new_count").alias("new_count"),
        F.sum("removed_count").alias("removed_count"),
        F.avg("price_drop_share").alias("avg_price_drop_share"),
        F.avg("median_days_on_market").alias("avg_median_days"),
    )


def latest_two_dates(rollup: DataFrame) -> DataFrame:
    """Newest and second newest row of :func:`snapshot_rollup`, ``age`` 1 and 2."""
    newest = rollup.orderBy(F.col("snapshot_date").desc()).limit(2)
    return newest.agg(F.array_sort(F.collect_list(F.struct(*rollup.columns))).alias("r")).select(
        F.posexplode(F.reverse("r")).alias("i", "s")
    ).select((F.col("i") + 1).alias("age"), "s.*")


def latest_by_segment(snapshots: DataFrame) -> DataFrame:
    """Unweighted KPI means over the newest row of each (main, type)."""
    picked = "listing_count median_days_on_market price_drop_share median_first_to_last_price_change_pct".split()
    # A tie inside one date goes to the smallest location, no location first.
    rank = F.struct("snapshot_date", (-F.coalesce("location_id", F.lit(-1))).alias("l"))
    newest = snapshots.groupBy("category_main_cb", "category_type_cb").agg(F.max_by(F.struct(*picked), rank).alias("s")).select("s.*")
    return newest.agg(
        F.sum("listing_count").alias("listing_count"),
        F.avg("median_days_on_market").alias("avg_median_days"),
        F.avg("price_drop_share").alias("avg_price_drop_share"),
        F.avg("median_first_to_last_price_change_pct").alias("avg_price_change_pct"),
    )


def regional_spread(inventory: DataFrame) -> DataFrame:
    """Total, top region, shares and extremes over :func:`inventory_by_region`."""
    unknown = F.max(F.when(F.col("region").isNull() | (F.col("region") == cb.UNKNOWN_LABEL), F.col("listing_count")))
    total = F.sum("listing_count")
    # Equal counts go to the name that sorts first.
    top = F.min_by("region", F.struct((-F.col("listing_count")).alias("c"), F.col("region")))
    return inventory.agg(
        total.alias("total"),
        top.alias("top_region"),
        (div(F.max("listing_count"), total) * 100).alias("top_share_pct"),
        (div(unknown, total) * 100).alias("unknown_share_pct"),
        F.max("listing_count").alias("max_count"),
        F.min("listing_count").alias("min_count"),
    ).where("total > 0")
