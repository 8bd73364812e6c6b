"""Completeness, freshness and reconciliation of the dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions import codebooks as cb
from hearthline.functions.exprs import div
from hearthline.operators.aggregates import (
    category_slices, dataset_counts, duplicate_keys, inventory_by_region, last_dataset_update, region_resolution_stats, segment_breakdowns,
    valuation_summary,
)

# What makes a sweep complete. From how many items on a sweep counts as full is a parameter of the functions below.
EXPECTED_SLICES = len(cb.PROPERTY_TYPES) * len(cb.DEAL_TYPES)
MISSING_SLICES_ALLOWED = 2


def full_sweeps(runs: DataFrame, min_items: int) -> DataFrame:
    return runs.where((F.col("run_type") == "incremental") & (F.col("status") == "success") & (F.col("category") == "all") & (F.col("items_seen") >= min_items))


def run_lookups(runs: DataFrame, min_items: int) -> DataFrame:
    """One row: last full sweep, last successful run, running sweep and running detail run."""
    sweep = (F.col("run_type") == "incremental") & (F.col("status") == "success")
    full = sweep & (F.col("category") == "all") & (F.col("items_seen") >= min_items)
    running = F.col("status") == "running"
    newest = lambda cond, by: F.max_by(F.when(cond, F.struct("id", "started_at", "finished_at", "items_seen", "pages_fetched", "items_new", "error_count")), F.when(cond, by))
    by_finish = F.struct("finished_at", "id")
    return runs.agg(
        newest(full, by_finish).alias("full_sweep"),
        newest(sweep & (F.col("items_seen") > 0), by_finish).alias("last_success"),
        newest(running & (F.col("run_type") == "incremental"), F.struct("id")).alias("running_sweep"),
        newest(running & (F.col("run_type") == "detail_backfill"), F.struct("id")).alias("running_detail"),
        newest((F.col("run_type") == "incremental") & F.col("status").isin("success", "partial", "failed") & F.col("finished_at").isNotNull(), by_finish).alias("last_finished"),
    )


def completeness_of(active: Column, slices: Column, has_full_sweep: Column) -> Column:
    return (
        F.when(active == 0, "empty")
        .when(has_full_sweep & (slices >= EXPECTED_SLICES - MISSING_SLICES_ALLOWED), "complete")
        .otherwise("partial")
    )


def freshness_of(sweep_running: Column, detail_running: Column, completeness: Column) -> Column:
    return (
        F.when(sweep_running, "in_progress")
        .when(detail_running, "detail_enrichment")
        .when(completeness == "empty", "empty")
        .when(completeness == "complete", "final_complete")
        .otherwise("final_partial")
    )


def dataset_state(listing: DataFrame, runs: DataFrame, min_items: int) -> DataFrame:
    """One row: counts, completeness, freshness and what may be compared."""
    slices = category_slices(listing).agg(
        F.struct(
            F.coalesce(F.sum("active_count"), F.lit(0)).alias("active"),
            F.coalesce(F.sum("total_count"), F.lit(0)).alias("total"),
            F.count_if(F.col("active_count") > 0).alias("n"),
        )
    ).scalar()
    found = run_lookups(runs, min_items).withColumn("s", slices)
    comp = completeness_of(F.col("s.active"), F.col("s.n"), F.col("full_sweep").isNotNull())
    fresh = freshness_of(F.col("running_sweep").isNotNull(), F.col("running_detail").isNotNull(), F.col("dataset_completeness"))
    return (
        found.withColumn("dataset_completeness", comp)
        .withColumn("dataset_freshness", fresh)
        .select(
            F.col("s.active").alias("active_total"),
            F.col("s.total").alias("all_total"),
            F.col("s.n").alias("active_category_slice_count"),
            F.lit(EXPECTED_SLICES).alias("expected_category_slice_count"),
            "dataset_completeness",
            "dataset_freshness",
            F.col("dataset_freshness").isin("final_complete", "final_partial", "detail_enrichment").alias("is_count_final"),
            (F.col("dataset_freshness") == "final_complete").alias("safe_to_compare_total"),
            F.col("dataset_freshness").isin("final_complete", "final_partial", "detail_enrichment").alias("safe_to_compare_per_slice"),
            F.coalesce("running_sweep.id", "running_detail.id").alias("snapshot_reference_run_id"),
            F.col("full_sweep.finished_at").alias("last_full_sweep_at"),
            F.col("full_sweep.id").alias("last_full_sweep_run_id"),
            F.col("full_sweep.items_seen").alias("last_full_sweep_items_seen"),
            F.col("last_success.finished_at").alias("last_successful_scrape_at"),
            F.col("running_sweep.items_seen").alias("run_items_seen"),
        )
    )


def classify_slice(expected: Column, actual: Column, running: Column) -> Column:
    tolerance = F.greatest(F.lit(2), F.floor(expected * F.lit(0.025)))
    return (
        F.when((expected == 0) & (actual == 0), "empty")
        .when((actual == 0) & (expected > 0), F.when(running, "not_started").otherwise("missing"))
        .when(F.abs(actual - expected) <= tolerance, "aligned")
        .when(actual < expected, F.when(running, "in_progress").otherwise("coverage_gap"))
        .otherwise("over")
    )


def slice_dimension(df: DataFrame) -> DataFrame:
    """The expected slices: every property type with every deal type."""
    rows = [(f"{p} - {d}", m, t) for m, p in cb.PROPERTY_TYPES.items() for t, d in cb.DEAL_TYPES.items()]
    return df.sparkSession.createDataFrame(rows, "name string, category_main_cb int, category_type_cb int")


def reconciliation_report(
    listing: DataFrame, runs: DataFrame, expected_totals: DataFrame | None, min_items: int
) -> DataFrame:
    """Expected and found counts per slice with a status; ``unknown`` without external totals."""
    keys = ["category_main_cb", "category_type_cb"]
    out = slice_dimension(listing).join(category_slices(listing), keys, "left")
    running = run_lookups(runs, min_items).agg(F.count("running_sweep") > 0).scalar()
    active = F.coalesce("active_count", F.lit(0))
    out = out.withColumn("active_count", active).withColumn("total_count", F.coalesce("total_count", F.lit(0)))
    if expected_totals is None:
        return out.select(
            "name", *keys, F.lit(0).cast("bigint").alias("expected_total"), "active_count", "total_count",
            F.lit(0).cast("bigint").alias("delta"), F.lit(None).cast("double").alias("delta_pct"), F.lit("unknown").alias("status"),
        )
    out = out.join(expected_totals, keys, "left").withColumn("expected_total", F.coalesce("expected_total", F.lit(0)))
    delta = F.col("active_count") - F.col("expected_total")
    return out.withColumn("running", running).select(
        "name", *keys, "expected_total", "active_count", "total_count", delta.alias("delta"),
        (div(delta, F.col("expected_total")) * 100).alias("delta_pct"),
        classify_slice(F.col("expected_total"), F.col("active_count"), F.col("running")).alias("status"),
    )


def reconciliation_summary(
    listing: DataFrame, detail: DataFrame, runs: DataFrame, expected_totals: DataFrame, min_items: int
) -> DataFrame:
    """One row over the report: totals, duplicate keys, sums and explanations."""
    report = reconciliation_report(listing, runs, expected_totals, min_items)
    totals = report.agg(
        F.struct(
            F.sum("expected_total").alias("expected"),
            F.count_if(F.col("status") == "not_started").alias("not_started"),
            F.count_if(F.col("status") == "coverage_gap").alias("gaps"),
        )
    ).scalar()
    inventory = inventory_by_region(listing).agg(F.coalesce(F.sum("listing_count"), F.lit(0))).scalar()
    return (
        dataset_state(listing, runs, min_items)
        .withColumn("t", totals)
        .withColumn("duplicate_hash_ids", duplicate_keys(listing).scalar())
        .withColumn("inventory_sum_matches_active", inventory == F.col("active_total"))
        .withColumn("last_dataset_update_at", last_dataset_update(listing, detail, runs).scalar())
        .withColumn("expected_slice_sum", F.col("t.expected"))
        .withColumn("active_vs_expected_delta", F.col("active_total") - F.col("t.expected"))
        .withColumn("active_vs_run_items_seen_delta", F.col("active_total") - F.col("run_items_seen"))
        .withColumn("not_started_slice_count", F.col("t.not_started"))
        .withColumn("coverage_gap_slice_count", F.col("t.gaps"))
        .withColumn("delta_explainable_by_not_started", (F.col("dataset_freshness") == "in_progress") & (F.col("t.not_started") > 0))
        .drop("t")
    )


def dataset_summary(
    listing: DataFrame, detail: DataFrame, valuation: DataFrame, anomaly: DataFrame, runs: DataFrame, min_items: int
) -> DataFrame:
    """One row: coverage counts, region source maps, completeness, freshness and run times."""
    stats = region_resolution_stats(listing)

    def counts_of(prefix: str) -> Column:
        rows = stats.where(F.startswith("metric", F.lit(prefix))).select(F.expr(f"substring(metric, {len(prefix) + 1})").alias("k"), "listing_count")
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "listing_count"))))).scalar()

    state = dataset_state(listing, runs, min_items).drop("active_total", "all_total")
    return (
        dataset_counts(listing, detail, valuation, anomaly)
        .withColumn("region_source_counts", counts_of("source:"))
        .withColumn("region_unknown_reason_counts", counts_of("reason:"))
        .withColumn("last_dataset_update_at", last_dataset_update(listing, detail, runs).scalar())
        .withColumn("state", state.agg(F.max(F.struct(*state.columns))).scalar())
        .select("*", "state.*")
        .drop("state")
    )


def open_runs(runs: DataFrame) -> DataFrame:
    """Partial and running runs, newest first."""
    return runs.where(F.col("status").isin("partial", "running")).select("id", "status", "items_seen", "pages_fetched", "finished_at").orderBy(F.col("id").desc())


def broken_sums(listing: DataFrame, valuation: DataFrame, aggregates: dict[str, DataFrame]) -> DataFrame:
    """Stored aggregates (``inventory``, ``grid``, ``valuation`` or ``segment:<dimension>``, each with ``listing_count``) whose sum is not the
    number of rows they stand for: (invariant, expected, actual)."""
    active = listing.where("is_active")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    expected = {
        "grid": lambda: count(active.where("gps_lat is not null and gps_lon is not null")),
        "valuation": lambda: count(valuation.join(active.select(F.col("id").alias("listing_id")), "listing_id", "left_semi")),
    }
    rows = [
        table.agg(F.coalesce(F.sum("listing_count"), F.lit(0)).alias("actual")).select(F.lit(name).alias("invariant"), expected.get(name, lambda: count(active))().alias("expected"), "actual")
        for name, table in aggregates.items()
    ]
    return reduce(DataFrame.unionByName, rows).where(~F.col("expected").eqNullSafe(F.col("actual")))


def invariant_violations(listing: DataFrame, detail: DataFrame, cells: DataFrame, valuation: DataFrame) -> DataFrame:
    """Sums that must agree but do not: (invariant, expected, actual)."""
    sums = segment_breakdowns(listing, detail).groupBy(F.concat(F.lit("segment:"), F.col("dimension")).alias("invariant")).agg(F.sum("listing_count").alias("actual"))
    segments = sums.select("invariant", listing.where("is_active").agg(F.count(F.lit(1))).scalar().alias("expected"), "actual").where(~F.col("expected").eqNullSafe(F.col("actual")))
    totals = {"inventory": inventory_by_region(listing), "grid": cells, "valuation": valuation_summary(listing, valuation)}
    return segments.unionByName(broken_sums(listing, valuation, totals))


def analytics_staleness(state: DataFrame, analytics_runs: DataFrame) -> DataFrame:
    """State of the stored analytics against the dataset.

    ``state`` is one row with active_listing_count, active_with_detail_count,
    dataset_freshness, last_dataset_update_at, last_full_sweep_at and
    last_successful_scrape_at.
    """
    good = F.col("status").isin("success", "partial")
    newest_good = F.max_by(F.when(good, F.struct("status", "finished_at")), F.when(good, F.struct("started_at", "id")))
    runs = analytics_runs.agg(F.struct((F.count_if(F.col("status") == "running") > 0).alias("running"), newest_good.alias("good"))).scalar()
    reference = F.coalesce("last_dataset_update_at", "last_full_sweep_at", "last_successful_scrape_at")
    missing = F.greatest(F.lit(0), F.col("active_listing_count") - F.col("active_with_detail_count"))
    status = (
        F.when(F.col("r.running"), "running")
        .when(F.col("dataset_freshness") == "in_progress", "ingest_in_progress")
        .when((missing > 0) & (F.col("active_listing_count") > 0), "missing_details")
        .when(F.col("r.good.finished_at").isNull(), "none")
        .when(reference.isNull(), None)
        .when(F.col("r.good.status") == "partial", "partial")
        .when(F.col("r.good.finished_at") < reference, "stale")
        .otherwise("current")
    )
    return state.withColumn("r", runs).select(
        status.alias("analytics_state"), missing.alias("missing_details"), F.col("r.good.finished_at").alias("analytics_at"), reference.alias("dataset_at")
    )
