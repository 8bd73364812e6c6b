"""Listing links in stored search pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def harvest_links(pages: DataFrame, base_url: str, marker: str = "/detail/") -> DataFrame:
    """Distinct absolute anchor targets containing ``marker`` per page, with their first position."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))
    absolute = F.when(F.startswith("href", F.lit("http")), F.col("href")).otherwise(F.concat(F.lit(base_url), F.col("href")))
    return (
        pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))
        .where(F.contains("href", F.lit(marker)))
        .groupBy("page_id", absolute.alias("listing_url"))
        .agg(F.min("pos").alias("position"))
    )
