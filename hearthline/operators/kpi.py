"""KPI readings: raw value, comparison, state, confidence and sentiment."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.exprs import div, pct_change
from hearthline.operators.aggregates import (
    dataset_counts, inventory_by_region, latest_by_segment, latest_two_dates, new_vs_removed, regional_spread, snapshot_rollup, valuation_summary,
)
from hearthline.operators.listings import price_drops
from hearthline.operators.quality import dataset_state

# Thresholds in percent.
CHANGE_CEILING = 40.0
STABLE_WITHIN = 2.0


def period_change(current: Column, previous: Column, ceiling: float = CHANGE_CEILING) -> dict[str, Column]:
    """Change against the previous period and whether it can be read as a trend."""
    delta = pct_change(current, previous)
    state = F.when(delta.isNull(), "insufficient_history").when(F.abs(delta) > ceiling, "baseline").otherwise("trend")
    return {"delta_pct": delta, "state": state, "confidence": F.when(state == "trend", "medium").otherwise("low")}


def delta_sentiment(delta: Column, watch: float, healthy: float | None = None, concern: float | None = None) -> Column:
    out = F.when(F.abs(delta) < STABLE_WITHIN, "stable").when(delta >= watch, "watch")
    if healthy is not None:
        out = out.when(delta <= healthy, "healthy")
    if concern is not None:
        out = out.when(delta <= concern, "concern")
    return out.otherwise("neutral")


def _row(kpi: str, value: Column, state, confidence, sentiment, comparison, previous=None, delta=None) -> Column:
    text = lambda c: c if isinstance(c, Column) else F.lit(c)
    number = lambda c: F.lit(None).cast("double") if c is None else c.cast("double")
    return F.struct(
        F.lit(kpi).alias("kpi"), number(value).alias("value"), number(previous).alias("previous"), number(delta).alias("delta_pct"),
        text(state).alias("state"), text(confidence).alias("confidence"), text(sentiment).alias("sentiment"), text(comparison).alias("comparison_kind"),
    )


def active_listings() -> Column:
    change = period_change(F.col("cur_count"), F.col("prev_count"))
    busy, partial = F.col("freshness") == "in_progress", F.col("completeness") == "partial"
    state, trend = change["state"], change["state"] == "trend"
    gone = F.when(partial, "partial").otherwise("unavailable")
    return _row(
        "active_listings",
        F.col("active"),
        F.when(busy, "ingest_dominated").when(trend & partial, "informational").otherwise(state),
        F.when(busy | ~trend | partial, "low").otherwise("medium"),
        F.when(busy, "partial").when(state == "baseline", "unavailable").when(~trend, gone).when(partial, "partial").otherwise(
            delta_sentiment(change["delta_pct"], 5, concern=-5)
        ),
        F.when(busy | (state == "insufficient_history"), "none").otherwise("previous_snapshot"),
        F.when(~busy, F.col("prev_count")),
        F.when(~busy, change["delta_pct"]),
    )


def new_listings() -> Column:
    new, removed = F.col("new_30d"), F.col("removed_30d")
    net = new - removed
    busy = F.col("freshness") == "in_progress"
    ingest = busy | ((F.col("active") > 0) & (new >= F.col("active") * F.lit(0.8)))
    flow = (
        F.when((net > removed * F.lit(0.2)) & (net > 0), "watch")
        .when((net < 0) & (F.abs(net) > new * F.lit(0.2)), "concern")
        .when((new == 0) & (removed == 0), "neutral")
        .otherwise("stable")
    )
    return _row(
        "new_listings", new, F.when(ingest, "ingest_dominated").otherwise("trend"), F.when(ingest, "low").otherwise("medium"),
        F.when(busy, "partial").when(ingest, "neutral").otherwise(flow), F.when(ingest, "none").otherwise("period_flow"),
    )


def removed_listings() -> Column:
    new, removed = F.col("new_30d"), F.col("removed_30d")
    share = div(removed, new + removed) * 100
    busy = F.col("freshness") == "in_progress"
    return _row(
        "removed_listings", removed, F.when(busy, "ingest_dominated").otherwise("informational"),
        F.when(busy | share.isNull(), "low").otherwise("high"),
        F.when(busy, "partial").when(share > 55, "watch").when(share < 35, "stable").otherwise("neutral"),
        F.when(busy | share.isNull(), "none").otherwise("share_of_total"),
    )


def price_drop_share() -> Column:
    share = div(F.col("drops"), F.col("active")) * 100
    known = F.col("drops").isNotNull()
    return _row(
        "price_drops", share, "informational", F.when(known, "high").otherwise("low"),
        F.when(~known, "unavailable").when(share >= 8, "watch").when(share <= 2, "stable").otherwise("neutral"),
        F.when(known, "share_of_total").otherwise("none"),
    )


def under_market_share() -> Column:
    none = F.coalesce("valued", F.lit(0)) == 0
    share = div(F.coalesce("under", F.lit(0)), F.col("valued")) * 100
    limited = F.coalesce(div(F.col("valued"), F.col("active")) * 100, F.lit(0.0)) < 80
    return _row(
        "under_market", share, "informational", F.when(none | limited, "low").otherwise("high"),
        F.when(none, "unavailable").when(limited, "partial").when(share >= 25, "watch").when(share <= 10, "stable").otherwise("neutral"),
        F.when(none, "none").otherwise("share_of_total"),
    )


def regional_inventory() -> Column:
    none, unknown = F.col("region_total").isNull(), F.coalesce("unknown_share_pct", F.lit(0.0))
    return _row(
        "regional_inventory", F.col("top_share_pct"), "informational", F.when(none | (unknown > 15), "low").otherwise("high"),
        F.when(none, "unavailable").when(unknown > 5, "watch").otherwise("neutral"), F.when(none, "none").otherwise("share_of_total"),
    )


def detail_coverage() -> Column:
    share = F.coalesce(div(F.col("with_detail"), F.col("active")) * 100, F.lit(0.0))
    complete = (F.col("active") > 0) & (F.col("with_detail") >= F.col("active"))
    return _row(
        "detail_coverage", share, "informational", F.when(share >= 90, "high").when(share >= 70, "medium").otherwise("low"),
        F.when(complete | (share >= 90), "healthy").when(share >= 70, "watch").otherwise("concern"), "share_of_total",
    )


def advanced_metric(kpi: str, current: Column, previous: Column, watch: float, healthy: float | None = None, concern: float | None = None) -> Column:
    change = period_change(current, previous)
    state = change["state"]
    return _row(
        kpi, current, state, change["confidence"],
        F.when((state == "insufficient_history") & current.isNull(), "unavailable")
        .when(state == "insufficient_history", "neutral")
        .when(state == "baseline", "unavailable")
        .otherwise(delta_sentiment(change["delta_pct"], watch, healthy, concern)),
        F.when(state == "insufficient_history", "none").otherwise("previous_snapshot"),
        previous, change["delta_pct"],
    )


def latest_drop_share() -> Column:
    return _row("latest_drop_share", F.col("cur_drop"), "informational", F.when(F.col("cur_drop").isNull(), "low").otherwise("high"), "neutral", "none")


def kpi_rows(facts: DataFrame) -> DataFrame:
    """All readings from one row of facts (see :func:`kpi_facts`)."""
    readings = [
        active_listings(), new_listings(), removed_listings(), price_drop_share(), under_market_share(), regional_inventory(), detail_coverage(),
        advanced_metric("median_dom", F.col("cur_dom"), F.col("prev_dom"), 10, healthy=-10),
        advanced_metric("drop_share", F.col("cur_drop"), F.col("prev_drop"), 15, healthy=-15),
        advanced_metric("price_change", F.col("cur_change"), F.lit(None).cast("double"), 5, concern=-5),
        latest_drop_share(),
    ]
    return facts.select(F.explode(F.array(*readings)).alias("k")).select("k.*")


def kpi_facts(
    listing: DataFrame, detail: DataFrame, valuation: DataFrame, anomaly: DataFrame, snapshots: DataFrame, runs: DataFrame, history: DataFrame,
    as_of: datetime, min_items: int, min_drop_pct: float = 5.0,
) -> DataFrame:
    """One row with every input of the readings, each taken by its own operator."""
    one = lambda df, *cols: df.agg(F.struct(*cols)).scalar()
    first = lambda c: F.max(c).alias(c)
    two = latest_two_dates(snapshot_rollup(snapshots))
    at = lambda age, c: F.max(F.when(F.col("age") == age, F.col(c)))
    pair = one(
        two, at(1, "listing_count").alias("cur_count"), at(2, "listing_count").alias("prev_count"), at(1, "avg_median_days").alias("cur_dom"),
        at(2, "avg_median_days").alias("prev_dom"), at(1, "avg_price_drop_share").alias("cur_drop"), at(2, "avg_price_drop_share").alias("prev_drop"),
    )
    flow = one(new_vs_removed(listing, as_of), first("new_count"), first("removed_count"))
    values = one(
        valuation_summary(listing, valuation), F.sum("listing_count").alias("valued"),
        F.sum(F.when(F.col("classification") == "under_market", F.col("listing_count"))).alias("under"),
    )
    spread = one(regional_spread(inventory_by_region(listing)), first("total"), first("top_share_pct"), first("unknown_share_pct"))
    state = one(dataset_state(listing, runs, min_items), first("dataset_completeness"), first("dataset_freshness"))
    drops = price_drops(listing, history, min_drop_pct).agg(F.count(F.lit(1))).scalar()
    change = latest_by_segment(snapshots).select("avg_price_change_pct").scalar()
    counts = dataset_counts(listing, detail, valuation, anomaly)
    with_facts = counts.select(
        F.col("active_listing_count").alias("active"), F.col("active_with_detail_count").alias("with_detail"),
        pair.alias("p"), flow.alias("f"), values.alias("v"), spread.alias("r"), state.alias("s"), drops.alias("drops"), change.alias("cur_change"),
    )
    return with_facts.select(
        "active", "with_detail", "p.*", F.col("f.new_count").alias("new_30d"), F.col("f.removed_count").alias("removed_30d"), "v.valued", "v.under",
        F.col("r.total").alias("region_total"), "r.top_share_pct", "r.unknown_share_pct", F.col("s.dataset_completeness").alias("completeness"),
        F.col("s.dataset_freshness").alias("freshness"), "drops", "cur_change",
    )


def kpi_table(*args, **kwargs) -> DataFrame:
    """The KPI table; arguments as in :func:`kpi_facts`."""
    return kpi_rows(kpi_facts(*args, **kwargs))
