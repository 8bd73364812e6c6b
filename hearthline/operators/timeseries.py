"""Monthly series with change, rolling, index and volatility columns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.functions import codebooks as cb
from hearthline.functions.exprs import first_text, metadata, month_parts, segment_key
from hearthline.operators.listings import DEFAULT_METHOD, DEFAULT_SOURCE

KEYS = ["segment", "location_id", "category_main_cb", "category_type_cb", "rok_mesic", "lokalita"]
ACTIVE_STATE = "aktivní"


def snapshots_with_location(snapshots: DataFrame, location: DataFrame) -> DataFrame:
    """Snapshots with the name of their location, if any."""
    loc = location.select(
        F.col("id").alias("loc_id"),
        F.coalesce(first_text(F.col("municipality"), F.col("district")), F.col("region")).alias("lokalita"),
    )
    return snapshots.join(loc, F.col("location_id") == F.col("loc_id"), "left").drop("loc_id")


def monthly_rollup(
    snapshots: DataFrame, location: DataFrame, as_of: datetime, days: int = 730,
    main: int | None = None, deal: int | None = None, location_id: int | None = None,
) -> DataFrame:
    """Monthly means (sum of the new listings) per segment; missing keys become -1."""
    rows = snapshots.where(F.col("snapshot_date") >= F.lit((as_of - timedelta(days=days)).date()))
    for column, value in (("category_main_cb", main), ("category_type_cb", deal), ("location_id", location_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    named = snapshots_with_location(rows, location)
    key = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return named.groupBy(
        segment_key(F.col("location_id"), F.col("category_main_cb"), F.col("category_type_cb")).alias("segment"),
        *[key(c).alias(c) for c in ("location_id", "category_main_cb", "category_type_cb")],
        F.date_format("snapshot_date", "yyyy-MM").alias("rok_mesic"),
        "lokalita",
    ).agg(
        F.avg("avg_price_per_m2").alias("cena_za_m2"),
        F.avg("avg_price_czk").alias("prumerna_cena"),
        F.avg("avg_days_on_market").alias("prumerna_doba_inzerce"),
        F.avg("listing_count").alias("aktivnich_nabidek"),
        F.sum("new_count").alias("pocet_novych_nabidek"),
    )


def _change(x: Column, before: Column) -> Column:
    return F.try_divide(x, before) - 1


def derived_columns(monthly: DataFrame, forward_fill: bool = True, calendar: bool = False) -> DataFrame:
    """Change, rolling, index, volatility and sale-rent spread per segment.

    Offsets count rows; ``calendar`` compares with the month one or twelve
    months earlier instead. ``forward_fill`` computes changes on values
    carried over gaps.
    """
    seg = Window.partitionBy("segment").orderBy("rok_mesic")
    so_far = seg.rowsBetween(Window.unboundedPreceding, 0)
    month_no = F.substring("rok_mesic", 1, 4).cast("int") * 12 + F.substring("rok_mesic", 6, 2).cast("int")
    filled = F.last("cena_za_m2", ignorenulls=True).over(so_far) if forward_fill else F.col("cena_za_m2")
    df = monthly.withColumn("_x", filled).withColumn("_month", month_no)
    if calendar:
        by_month = Window.partitionBy("segment").orderBy("_month")
        earlier = lambda k: F.max("_x").over(by_month.rangeBetween(-k, -k))
    else:
        earlier = lambda k: F.lag("_x", k).over(seg)
    x = F.col("_x")
    df = df.withColumn("_step", _change(x, F.lag("_x", 1).over(seg)))
    year = seg.rowsBetween(-11, 0)
    first = F.first("cena_za_m2").over(so_far)
    df = (
        df.withColumn("mom_change_pct", _change(x, earlier(1)) * 100)
        .withColumn("yoy_change_pct", _change(x, earlier(12)) * 100)
        .withColumn("rolling_3m_avg", F.avg("cena_za_m2").over(seg.rowsBetween(-2, 0)))
        .withColumn("rolling_12m_avg", F.avg("cena_za_m2").over(year))
        .withColumn("price_index_base_100", F.try_divide(F.col("cena_za_m2"), first) * 100)
        .withColumn("volatility_12m", F.when(F.count("_step").over(year) >= 2, F.stddev_samp("_step").over(year)) * 100)
    )
    pair = Window.partitionBy("location_id", "category_main_cb", "rok_mesic")
    of_type = lambda t: F.max(F.when(F.col("category_type_cb") == t, F.col("cena_za_m2"))).over(pair)
    return df.withColumn("spread_sale_vs_rent", of_type(1) - of_type(2)).drop("_x", "_month", "_step")


SERIES_COLUMNS = (
    "datum rok mesic rok_mesic lokalita typ kategorie stav transakce cena_za_m2 prumerna_cena prumerna_doba_inzerce "
    "aktivnich_nabidek pocet_novych_nabidek metoda_sberu zdroj segment mom_change_pct yoy_change_pct rolling_3m_avg "
    "rolling_12m_avg price_index_base_100 spread_sale_vs_rent volatility_12m"
).split()


def timeseries(
    snapshots: DataFrame, location: DataFrame, as_of: datetime, days: int = 730,
    main: int | None = None, deal: int | None = None, location_id: int | None = None,
    source: str = DEFAULT_SOURCE, method: str = DEFAULT_METHOD, forward_fill: bool = True, calendar: bool = False,
) -> DataFrame:
    """The export series, 24 columns, ordered by segment and month."""
    monthly = monthly_rollup(snapshots, location, as_of, days, main, deal, location_id)
    df = derived_columns(monthly, forward_fill, calendar)
    day = F.to_date(F.concat("rok_mesic", F.lit("-01")))
    kind = cb.lookup(cb.PROPERTY_TYPES, F.col("category_main_cb"))
    extra = {
        **{n: c for n, c in month_parts(day).items() if n != "rok_mesic"},
        "typ": kind,
        "kategorie": kind,
        "transakce": cb.lookup(cb.DEAL_TYPES, F.col("category_type_cb")),
        "stav": F.lit(ACTIVE_STATE),
        **metadata(source, method),
    }
    for name, column in extra.items():
        df = df.withColumn(name, column)
    return df.select(*SERIES_COLUMNS).orderBy("segment", "rok_mesic")
