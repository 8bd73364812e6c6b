"""Nearest comparable listings for many subjects at once.

Subjects are dealt into tiles, every candidate into all tiles that it can be
near to, and each tile is searched by itself (``nearest``). Of listings that
agree in position and attributes only the lowest ids can be among the nearest.
A tile with many subjects is dealt on to several blocks.

The narrow input and the sizes of the tiles are written to the shared folder
once; calling an operator here starts jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from hearthline.functions.exprs import pct_change, price_per_m2, truthy
from hearthline.functions.geo import bin_of, covering_bins, lat_reach, lon_reach
from hearthline.operators.aggregates import with_area
from hearthline.operators.nearest import REACH_KM, SLACK_KM, near_lists
from hearthline.session import cut_lineage, growing

# Bands, radii and counts of the comparison.
AREA_BAND = 0.25
SUB_BAND = 1
RADII_KM = (5, 10, 20)
MIN_COMPARABLES = 3
MAX_COMPARABLES = 8
NO_GPS = "no_gps"
TOO_FEW = "too_few"

# Degrees of latitude and longitude of a tile, subjects of a block, and tiles that may be sent to every task.
TILE = (0.36, 0.5)
BLOCK = 100_000
FEW_TILES = 50_000

POINT = ["lat", "lon", "main", "deal", "sub", "area"]


def _rows(listing: DataFrame, detail: DataFrame) -> DataFrame:
    return with_area(listing, detail.withColumn("has_detail", F.lit(True)), "has_detail").select(
        F.col("id").alias("listing_id"),
        "title",
        "price_czk",
        "is_active",
        F.coalesce("has_detail", F.lit(False)).alias("has_detail"),
        F.col("gps_lat").alias("lat"),
        F.col("gps_lon").alias("lon"),
        F.col("category_main_cb").alias("main"),
        F.col("category_type_cb").alias("deal"),
        F.col("category_sub_cb").alias("sub"),
        F.col("usable_area").cast("double").alias("area"),
    )


def _near(subjects: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """(subject_id, subject_price, near): the ``limit + 1`` nearest candidates of every subject, as an ordered list."""
    members = ["listing_id", "title", "price_czk", "per_m2"]
    at = subjects.select(
        F.col("listing_id").alias("subject_id"), F.col("price_czk").alias("subject_price"), *POINT, bin_of(F.col("lat"), TILE[0]).alias("ty"), bin_of(F.col("lon"), TILE[1]).alias("tx")
    )
    tile = ["main", "deal", "ty", "tx"]
    blocks = at.groupBy(*[F.col(k).alias(f"t_{k}") for k in tile]).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = cut_lineage(blocks, "comparable-tiles")
    blocks = F.broadcast(blocks) if blocks.count() <= FEW_TILES else growing(blocks)
    same_tile = [F.col(k) == F.col(f"t_{k}") for k in tile]
    reach = F.lit(REACH_KM[-1] + SLACK_KM)
    around = (
        candidates.withColumn("ty", F.explode(covering_bins(F.col("lat"), lat_reach(reach), F.lit(TILE[0]))))
        .withColumn("tx", F.explode(covering_bins(F.col("lon"), lon_reach(F.col("lat"), reach), F.lit(TILE[1]))))
        .join(blocks, same_tile)
        .select(*POINT, *members, "ty", "tx", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    dealt = at.join(blocks, same_tile).withColumn("block", F.pmod(F.xxhash64("subject_id"), F.col("blocks").cast("bigint")).cast("int"))
    schema = StructType([
        dealt.schema["subject_id"], dealt.schema["subject_price"],
        StructField("near", ArrayType(StructType([StructField("distance_km", DoubleType()), *[candidates.schema[m] for m in members]]))),
    ])
    key = [*tile, "block"]
    keep = ["lat", "lon", "sub", "area"]
    search = near_lists(limit + 1, AREA_BAND, SUB_BAND, members, to_arrow_schema(schema))
    # both sides come from one table: one of them gets columns of its own
    left, right = dealt.select(*key, *keep, "subject_id", "subject_price"), around.select(*[F.col(c).alias(c) for c in [*key, *keep, *members]])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def _selected(near: Column, subject: Column, limit: int) -> Column:
    """Own row out, first ``limit``, then the smallest radius with enough of them."""
    top = F.slice(F.filter(near, lambda c: c["listing_id"] != subject), 1, limit)
    within = lambda r: F.filter(top, lambda c: c["distance_km"] <= r)
    out = within(RADII_KM[-1])
    for radius in reversed(RADII_KM[:-1]):
        out = F.when(F.size(within(radius)) >= MIN_COMPARABLES, within(radius)).otherwise(out)
    return out


def _median(values: Column) -> Column:
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.element_at(ordered, low) + F.element_at(ordered, high)) / 2)


def _with_selection(listing: DataFrame, detail: DataFrame, subject_ids: DataFrame | None, limit: int) -> DataFrame:
    rows = cut_lineage(_rows(listing, detail), "comparable-rows")
    subjects = rows if subject_ids is None else rows.join(growing(subject_ids.select("listing_id").distinct()), "listing_id", "left_semi")
    # The subject's area counts as missing when it is 0.
    subjects = subjects.withColumn("area", truthy(F.col("area")))
    has_gps = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # Not a number and infinity are no position.
    somewhere = (F.abs("lat") < 1e9) & (F.abs("lon") < 1e9) & F.col("main").isNotNull() & F.col("deal").isNotNull()
    lowest = Window.partitionBy(*POINT).orderBy("listing_id")
    candidates = (
        rows.where("is_active and has_detail")
        .where(somewhere)
        .withColumn("per_m2", price_per_m2(F.col("price_czk"), F.col("area")))
        .withColumn("rn", F.row_number().over(lowest))
        .where(F.col("rn") <= limit + 1)
    )
    near = _near(subjects.where(somewhere), candidates, limit)
    none = F.array().cast(near.schema["near"].dataType)
    found = near.select("subject_id", "subject_price", F.lit(True).alias("has_gps"), _selected(F.col("near"), F.col("subject_id"), limit).alias("sel"))
    nowhere = subjects.where(~F.coalesce(somewhere, F.lit(False)))
    return found.unionByName(nowhere.select(F.col("listing_id").alias("subject_id"), F.col("price_czk").alias("subject_price"), has_gps.alias("has_gps"), none.alias("sel")))


def comparables(listing: DataFrame, detail: DataFrame, subject_ids: DataFrame | None = None, limit: int = MAX_COMPARABLES) -> DataFrame:
    """Ranked comparables per subject; ``subject_ids=None`` takes every listing as a subject."""
    chosen = _with_selection(listing, detail, subject_ids, limit)
    return chosen.select("subject_id", F.posexplode("sel").alias("pos", "c")).select(
        "subject_id", (F.col("pos") + 1).alias("rank"), "c.listing_id", "c.title", "c.price_czk",
        F.bround(truthy(F.col("c.per_m2")), 0).alias("price_per_m2"), "c.distance_km",
    )


def comparables_summary(listing: DataFrame, detail: DataFrame, subject_ids: DataFrame | None = None, limit: int = MAX_COMPARABLES) -> DataFrame:
    """Medians over the selected comparables and the subject's deviation from them."""
    chosen = _with_selection(listing, detail, subject_ids, limit)
    nonzero = lambda field: F.filter(F.transform("sel", lambda c: truthy(c[field].cast("double"))), lambda x: x.isNotNull())
    price, per_m2 = _median(nonzero("price_czk")), _median(nonzero("per_m2"))
    return chosen.select(
        "subject_id",
        F.size("sel").alias("comparable_count"),
        price.alias("median_comparable_price_czk"),
        F.bround(truthy(per_m2), 0).alias("median_comparable_price_per_m2"),
        F.when(truthy(price).isNotNull() & truthy(F.col("subject_price")).isNotNull(), F.bround(pct_change(F.col("subject_price"), price), 1)).alias(
            "deviation_from_comparables_pct"
        ),
        F.when(~F.col("has_gps"), NO_GPS).when(F.size("sel") < MIN_COMPARABLES, TOO_FEW).alias("note"),
    )
