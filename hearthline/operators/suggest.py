"""Place-name suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from hearthline.functions.exprs import ilike_any

# Kinds in source order with their filter column and sort rank.
KINDS = [("kraj", "region", 4), ("okres", "district", 1), ("obec", "city", 2), ("ctvrt", "search", 0), ("lokalita", "search", 3)]


def place_labels(listing: DataFrame, location: DataFrame, active_only: bool = True) -> DataFrame:
    """Distinct place names with the ``source`` (place in ``KINDS``) they come from."""
    rows = listing.where("is_active") if active_only else listing
    loc = location.select(F.col("id").alias("loc_id"), "region", "district", "municipality", "quarter")
    # Few distinct places remain of many listings before the labels are searched.
    joined = rows.select("location_id", "resolved_region_name").distinct().join(loc, F.col("location_id") == F.col("loc_id"), "left")
    sources = [
        joined.select(F.coalesce("resolved_region_name", "region").alias("label")),
        joined.select(F.col("district").alias("label")),
        joined.select(F.col("municipality").alias("label")),
        joined.select(F.col("quarter").alias("label")),
        rows.select(F.col("locality_text").alias("label")),
    ]
    return reduce(DataFrame.unionByName, [source.where("label <> ''").distinct().withColumn("source", F.lit(i)) for i, source in enumerate(sources)])


def suggest_from(labels: DataFrame, query: str, limit: int = 15, kind_quota: int = 5) -> DataFrame:
    """The first ``limit`` of the place names (see ``place_labels``) that contain ``query``.

    A kind of place gives ``kind_quota`` names at most, in alphabetical order, before the kinds are merged and ranked.
    """
    text = query.strip()
    named = lambda place, cast: F.element_at(F.array(*[F.lit(k[place]) for k in KINDS]), F.col("source") + 1).cast(cast)
    found = labels.where(ilike_any([F.col("label")], text) & F.lit(len(text) >= 2)).select("label", named(0, "string").alias("kind"), named(1, "string").alias("target"), named(2, "int").alias("rank"), "source")
    quota = F.row_number().over(Window.partitionBy("source").orderBy("label"))
    found = found.withColumn("rn", quota).where(F.col("rn") <= kind_quota)
    first = Window.partitionBy(F.lower("label")).orderBy("source", "label")
    items = found.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    hint = lambda c: F.when(F.col("target") == c, F.col("label")).alias(c)
    return (
        items.orderBy("rank", F.length("label"), "label")
        .limit(limit)
        .select("label", "kind", hint("region"), hint("district"), hint("city"), hint("search"))
    )


def location_suggest(listing: DataFrame, location: DataFrame, query: str, limit: int = 15, active_only: bool = True, kind_quota: int = 5) -> DataFrame:
    """The first ``limit`` distinct place names containing ``query``, with the filter each one stands for."""
    return suggest_from(place_labels(listing, location, active_only), query, limit, kind_quota)
