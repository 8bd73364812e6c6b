"""Grid heatmap: cell metrics, coarser cells, stored snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.exprs import price_per_m2, truthy, ts
from hearthline.functions.geo import GRID_STEP, bin_center, bin_of, step_for_zoom

TURNOVER_DAYS = 30
CELL_COLUMNS = ["grid_id", "lat_center", "lon_center", "listing_count", "avg_price_per_m2", "price_drop_intensity", "turnover_rate"]

Box = tuple[float | None, float | None, float | None, float | None]


def _whole(box: Box | None) -> bool:
    return box is not None and all(edge is not None for edge in box)


def in_box(lat: Column, lon: Column, box: Box) -> Column:
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def cells_in_box(cells: DataFrame, box: Box | None) -> DataFrame:
    """Cells whose centre lies in (south, west, north, east); a partial box filters nothing."""
    return cells.where(in_box(F.col("lat_center"), F.col("lon_center"), box)) if _whole(box) else cells


def grid_metrics(
    listing: DataFrame,
    detail: DataFrame,
    features: DataFrame,
    as_of: datetime,
    main: int | None = None,
    deal: int | None = None,
    box: Box | None = None,
    include_removed: bool = False,
) -> DataFrame:
    """Metrics per 0.01 degree cell over active listings with coordinates.

    Removed listings are inactive, so the turnover counts only new ones
    unless ``include_removed`` adds the recently removed ones to it.
    """
    since = ts(as_of - timedelta(days=TURNOVER_DAYS))
    active = F.col("is_active")
    recent_out = F.coalesce(F.col("removed_at") >= since, F.lit(False))
    rows = listing.where(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull())
    rows = rows.where(active | recent_out) if include_removed else rows.where(active)
    if main is not None:
        rows = rows.where(F.col("category_main_cb") == main)
    if deal is not None:
        rows = rows.where(F.col("category_type_cb") == deal)
    if _whole(box):
        rows = rows.where(in_box(F.col("gps_lat"), F.col("gps_lon"), box))
    areas = detail.select(F.col("listing_id").alias("area_key"), "usable_area")
    drops = features.where("drop_90d").select(F.col("listing_id").alias("drop_key"))
    per_m2 = F.when(active, price_per_m2(F.col("price_czk"), F.col("usable_area")))
    count = F.count_if(active)
    return (
        rows.join(areas, F.col("id") == F.col("area_key"), "left")
        .join(drops, F.col("id") == F.col("drop_key"), "left")
        .groupBy(bin_of(F.col("gps_lat"), GRID_STEP).alias("lat_bin"), bin_of(F.col("gps_lon"), GRID_STEP).alias("lon_bin"))
        .agg(
            count.alias("listing_count"),
            F.avg(per_m2).alias("mean_m2"),
            F.count_if(active & F.col("drop_key").isNotNull()).alias("drops"),
            (F.count_if(active & (F.col("first_seen_at") >= since)) + F.count_if(recent_out)).alias("moves"),
            F.count(per_m2).alias("priced_count"),
        )
        .where("listing_count > 0")
        .select(
            F.concat_ws("_", F.col("lat_bin").cast("string"), F.col("lon_bin").cast("string")).alias("grid_id"),
            bin_center(F.col("lat_bin"), GRID_STEP).alias("lat_center"),
            bin_center(F.col("lon_bin"), GRID_STEP).alias("lon_center"),
            "listing_count",
            F.bround("mean_m2", 0).alias("avg_price_per_m2"),
            F.bround(F.col("drops") / F.col("listing_count"), 3).alias("price_drop_intensity"),
            F.bround(F.col("moves") / F.col("listing_count"), 3).alias("turnover_rate"),
            "priced_count",
        )
    )


def coarsen(cells: DataFrame, step: float, weight: str = "listing_count") -> DataFrame:
    """Merge fine cells into cells of ``step`` degrees with weighted means.

    ``weight="listing_count"`` divides the price by all listings of the cell,
    ``"priced_count"`` only by those that had a price per m2.
    """
    if step <= GRID_STEP + 1e-12:
        return cells.select(*CELL_COLUMNS)
    n, w = F.sum("listing_count"), F.sum(weight)
    weighted = lambda c, by: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col(by))
    merged = cells.groupBy(bin_of(F.col("lat_center"), step).alias("lat_bin"), bin_of(F.col("lon_center"), step).alias("lon_bin")).agg(
        n.alias("listing_count"),
        F.try_divide(truthy(weighted("avg_price_per_m2", weight)), w).alias("m2"),
        F.try_divide(weighted("price_drop_intensity", "listing_count"), n).alias("drop"),
        F.try_divide(weighted("turnover_rate", "listing_count"), n).alias("turn"),
    )
    return merged.where("listing_count > 0").select(
        F.concat(F.lit("a"), F.concat_ws("_", F.col("lat_bin").cast("string"), F.col("lon_bin").cast("string"), F.lit(f"{step:g}"))).alias("grid_id"),
        bin_center(F.col("lat_bin"), step).alias("lat_center"),
        bin_center(F.col("lon_bin"), step).alias("lon_center"),
        "listing_count",
        F.bround("m2", 0).alias("avg_price_per_m2"),
        F.bround("drop", 3).alias("price_drop_intensity"),
        F.bround("turn", 3).alias("turnover_rate"),
    )


def grid_snapshot(cells: DataFrame, as_of: datetime, main: int | None = None, deal: int | None = None) -> DataFrame:
    """Cells as rows of the stored metric table."""
    return cells.select(
        F.lit(as_of.date()).alias("metric_date"),
        *CELL_COLUMNS[:3],
        F.lit(main).cast("int").alias("category_main_cb"),
        F.lit(deal).cast("int").alias("category_type_cb"),
        *CELL_COLUMNS[3:],
    )


def stored_cells(
    snapshots: DataFrame, as_of: datetime, main: int | None = None, deal: int | None = None, box: Box | None = None, max_age_hours: int = 24
) -> DataFrame:
    """Cells of the newest stored date for exactly this filter, empty when too old."""
    cutoff = (as_of - timedelta(hours=max_age_hours)).date()
    newest = snapshots.agg(F.max("metric_date")).scalar()
    rows = (
        snapshots.where((F.col("metric_date") >= F.lit(cutoff)) & (F.col("listing_count") > 0))
        .where(F.col("category_main_cb").eqNullSafe(F.lit(main).cast("int")))
        .where(F.col("category_type_cb").eqNullSafe(F.lit(deal).cast("int")))
        .where(F.col("metric_date") == newest)
    )
    return cells_in_box(rows, box).select(*CELL_COLUMNS)


def heatmap(
    snapshots: DataFrame,
    live_cells: DataFrame,
    as_of: datetime,
    zoom: int | None = None,
    main: int | None = None,
    deal: int | None = None,
    box: Box | None = None,
    live: bool = False,
) -> DataFrame:
    """Cells for a viewport: stored ones when fresh, else ``live_cells``, at the zoom's step.

    ``live_cells`` is :func:`grid_metrics` for the same filter and box.
    """
    step = step_for_zoom(zoom)
    fresh = live_cells.select(*CELL_COLUMNS).withColumn("source", F.lit("live"))
    if live:
        chosen = fresh
    else:
        cached = stored_cells(snapshots, as_of, main, deal, box).withColumn("source", F.lit("cache"))
        chosen = cached.unionByName(fresh.where(~cached.exists()))
    source = chosen.agg(F.max("source")).scalar()
    return coarsen(chosen.drop("source"), step).select("*", source.alias("source"), F.lit(step).alias("grid_step_degrees"))


def color_scale(cells: DataFrame, metric: str) -> DataFrame:
    """Position of each cell's metric between the smallest and largest value, NULL when they agree."""
    span = cells.agg(F.struct(F.min(metric).alias("low"), F.max(metric).alias("high"))).scalar()
    share = F.try_divide(F.col(metric) - F.col("s.low"), F.col("s.high") - F.col("s.low"))
    t = F.when(share.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return cells.withColumn("s", span).select("grid_id", F.col(metric).alias("value"), "s.low", "s.high", t.alias("t"))
