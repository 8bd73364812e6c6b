"""Listing tables derived from the order tables of the test data.

Every column is plain arithmetic on the keys, so the same tables can be
written once more as SQL text for checking.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.functions.codebooks import REGION_NAMES, lookup

AS_OF = datetime(2001, 12, 1)


def _unless(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


@dataclass
class DerivedListings:
    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")

    @cached_property
    def price_history(self) -> DataFrame:
        """Line items; the id repeats the order inside one ship date."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        number = (
            F.col("l_linenumber").cast("bigint") * F.lit(10**18)
            + F.col("l_partkey") * F.lit(10**11)
            + cents * 1000
            + F.col("l_suppkey") % 1000
        )
        return self.raw("lineitem").select(
            number.alias("id"),
            F.col("l_orderkey").alias("listing_id"),
            F.floor("l_extendedprice").cast("bigint").alias("price_czk"),
            F.col("l_shipdate").alias("recorded_at"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        shipped = self.price_history.groupBy(F.col("listing_id").alias("ship_key")).agg(
            F.min("recorded_at").alias("min_ship"),
            F.max("recorded_at").alias("max_ship"),
            F.max_by("price_czk", F.struct("recorded_at", "id")).alias("last_price"),
        )
        o = self.raw("orders").join(shipped, F.col("o_orderkey") == F.col("ship_key"), "left")
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        active = k % 7 != 0
        last_seen = F.coalesce("max_ship", "o_orderdate")
        region_id = _unless(k % 19 == 0, 1 + c % 14).cast("int")
        source = F.when(k % 23 == 0, None).when(k % 19 == 0, "unknown").otherwise(
            F.element_at(F.array(*map(F.lit, ["detail", "locality_region_id", "gps_polygon"])), (k % 3 + 1).cast("int"))
        )
        reason = F.when((k % 23 != 0) & (k % 19 == 0), F.when(k % 3 == 0, "missing_gps").when(k % 3 == 1, "polygon_miss"))
        price = (
            F.when(k % 89 == 0, None)
            .when(k % 83 == 0, F.lit(0))
            .otherwise(F.coalesce("last_price", F.floor("o_totalprice").cast("bigint")))
            .cast("bigint")
        )
        return o.select(
            k.alias("id"),
            k.cast("string").alias("hash_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("category_main_cb"),
            F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("category_type_cb"),
            _unless(k % 97 == 0, 2 + k % 11).cast("int").alias("category_sub_cb"),
            F.concat_ws(" ", "o_orderpriority", k.cast("string")).alias("title"),
            price.alias("price_czk"),
            F.when(F.col("o_orderstatus") == "O", "za měsíc").otherwise("za nemovitost").alias("price_czk_unit"),
            F.lit("CZK").alias("currency"),
            _unless(k % 31 == 0, F.concat(F.lit("Obec "), (c % 40).cast("string"), F.lit(" - Čtvrť "), (c % 9).cast("string"))).alias("locality_text"),
            F.when(k % 3 == 0, "realitni_kancelar").when(k % 3 == 1, "soukroma_osoba").alias("seller_type"),
            _unless(k % 53 == 0, F.lit(48.6) + (c * 7919 % 211) / F.lit(100.0) + F.lit(0.005)).alias("gps_lat"),
            _unless(k % 53 == 0, F.lit(12.2) + (c * 104729 % 307) / F.lit(100.0) + F.lit(0.005)).alias("gps_lon"),
            _unless(k % 17 == 0, c).alias("location_id"),
            active.alias("is_active"),
            F.least("o_orderdate", "min_ship").alias("first_seen_at"),
            last_seen.alias("last_seen_at"),
            F.when(~active, last_seen).alias("removed_at"),
            F.when(k % 29 == 0, F.concat(F.lit("https://portal.example/offer/"), k.cast("string")))
            .when(k % 31 == 0, F.concat(F.lit("https://portal.example/api/v1/estates/"), k.cast("string")))
            .alias("source_url"),
            region_id.alias("resolved_region_id"),
            lookup(REGION_NAMES, region_id).alias("resolved_region_name"),
            source.alias("region_source"),
            reason.alias("region_unknown_reason"),
        )

    @cached_property
    def listing_detail(self) -> DataFrame:
        k = F.col("o_orderkey")
        main = F.substring("o_orderpriority", 1, 1).cast("int")
        area = F.when(k % 103 == 0, None).when(k % 101 == 0, F.lit(0)).otherwise(8 + k % 120).cast("int")
        text = lambda x: x.cast("string")
        flag = lambda m: F.when(k % m == 0, None).otherwise(k % m == 1)
        floor_no = (k % 9).cast("int")
        return (
            self.raw("orders")
            .where(k % 13 != 0)
            .select(
                k.alias("id"),
                k.alias("listing_id"),
                _unless(k % 6 == 0, F.concat(F.lit("Popis nabídky "), text(k))).alias("description"),
                F.lit(None).cast("string").alias("meta_description"),
                area.alias("usable_area"),
                _unless(k % 4 == 0, 13 + k % 120).cast("int").alias("floor_area"),
                _unless(k % 5 != 0, 20 + k % 200).cast("int").alias("built_up_area"),
                F.when(main.isin(2, 3), 100 + k % 900).cast("int").alias("land_area"),
                F.concat(text(k % 9), F.lit("/9")).alias("floor"),
                _unless(k % 5 == 0, floor_no).alias("floor_number"),
                F.lit(9).alias("total_floors"),
                text(1 + k % 5).alias("ownership"),
                text(1 + k % 10).alias("building_type"),
                _unless(k % 10 == 0, text(1 + k % 11)).alias("building_condition"),
                F.when(k % 2 == 0, F.lit("beton")).alias("material"),
                text(1 + k % 5).alias("object_kind"),
                _unless(k % 8 == 0, text(1 + k % 9)).alias("energy_efficiency_rating"),
                text(1 + k % 4).alias("furnished"),
                F.when(k % 3 == 0, F.lit("")).otherwise(text(1 + k % 3)).alias("elevator"),
                flag(4).alias("balcony"),
                flag(5).alias("terrace"),
                flag(6).alias("loggia"),
                flag(3).alias("cellar"),
                flag(7).alias("garage"),
                flag(8).alias("garden"),
                flag(9).alias("basin"),
                flag(10).alias("low_energy"),
                flag(11).alias("easy_access"),
                _unless(k % 3 == 0, k % 3 - 1).cast("int").alias("parking_lots"),
                F.lit(None).cast("string").alias("no_barriers"),
                text(k % 50).alias("broker_id"),
                F.when(k % 3 == 0, F.concat(F.lit("Agency "), text(k % 20))).alias("broker_company"),
                F.when(k % 12 == 0, F.lit("včetně provize")).alias("note_about_price"),
                text(k).alias("id_of_order"),
                F.lit(None).cast("string").alias("start_of_offer"),
                _unless(k % 14 == 0, F.col("o_orderdate") + F.make_dt_interval((k % 20).cast("int"))).alias("last_updated_at"),
                (F.col("o_orderdate") + F.make_dt_interval((k % 30).cast("int"))).alias("updated_at"),
            )
        )

    @cached_property
    def location(self) -> DataFrame:
        c = F.col("c_custkey")
        nowhere = F.lit(None).cast("int")
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                c.alias("id"),
                _unless(c % 12 == 0, F.col("r_name")).alias("region"),
                F.col("n_name").alias("district"),
                F.col("c_mktsegment").alias("municipality"),
                _unless(c % 5 == 0, F.concat(F.lit("Quarter "), (c % 9).cast("string"))).alias("quarter"),
                F.lit("Česká republika").alias("country"),
                F.lit(None).cast("double").alias("gps_lat"),
                F.lit(None).cast("double").alias("gps_lon"),
                _unless(c % 4 == 0, 1 + c % 16).cast("int").alias("locality_region_id"),
                nowhere.alias("locality_district_id"),
                nowhere.alias("locality_municipality_id"),
                nowhere.alias("locality_ward_id"),
                nowhere.alias("locality_quarter_id"),
                nowhere.alias("locality_street_id"),
            )
        )

    @cached_property
    def image(self) -> DataFrame:
        return self.price_history.select(
            "id",
            "listing_id",
            F.concat(F.lit("https://img.example/"), F.col("id").cast("string"), F.lit(".jpg")).alias("url"),
            F.floor(F.col("id") / F.lit(10**18)).cast("int").alias("position"),
            F.lit(None).cast("string").alias("downloaded_path"),
        )

    @cached_property
    def analytic_snapshot(self) -> DataFrame:
        """Half-monthly segment metrics; a third of the rows span all locations."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        area = F.lit(8) + k % 120
        price = F.floor("o_totalprice").cast("double")
        day = F.date_add(F.trunc(F.col("o_orderdate").cast("date"), "month"), ((k % 2) * 14).cast("int"))
        return (
            self.raw("orders")
            .groupBy(
                day.alias("snapshot_date"),
                _unless(c % 3 == 0, c % 5).alias("location_id"),
                F.substring("o_orderpriority", 1, 1).cast("int").alias("category_main_cb"),
                F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("category_type_cb"),
            )
            .agg(
                F.count(F.lit(1)).alias("listing_count"),
                F.avg(price).alias("avg_price_czk"),
                F.avg(price).alias("median_price_czk"),
                F.avg(price / area).alias("avg_price_per_m2"),
                F.count_if(k % 3 == 0).alias("new_count"),
                F.count_if(k % 7 == 0).alias("removed_count"),
                F.avg(F.when(k % 11 != 0, (k % 60).cast("double"))).alias("median_days_on_market"),
                F.avg((k % 45).cast("double")).alias("avg_days_on_market"),
                F.avg(F.when(k % 13 != 0, (k % 5 == 0).cast("double"))).alias("price_drop_share"),
                F.avg((k % 21 - 10).cast("double")).alias("median_first_to_last_price_change_pct"),
            )
        )

    @cached_property
    def scraping_run(self) -> DataFrame:
        """One run per order day, with types and states by day of the month."""
        d = F.day("o_day")
        run_type = F.when(d % 5 == 0, "detail_backfill").otherwise("incremental")
        status = F.when(d % 11 == 0, "failed").when(d % 6 == 0, "partial").when(d == 31, "running").otherwise("success")
        day = F.col("o_orderdate").cast("date")
        return (
            self.raw("orders")
            .groupBy(day.alias("o_day"))
            .agg(F.count(F.lit(1)).alias("items_seen"), F.count_if(F.col("o_orderkey") % 3 == 0).alias("items_new"),
                 F.count_if(F.col("o_orderkey") % 5 == 0).alias("items_updated"), F.count_if(F.col("o_orderkey") % 7 == 0).alias("items_removed"))
            .select(
                F.datediff("o_day", F.lit("1990-01-01").cast("date")).cast("bigint").alias("id"),
                run_type.alias("run_type"),
                status.alias("status"),
                F.when(d % 4 == 0, "byt - prodej").otherwise("all").alias("category"),
                F.col("o_day").cast("timestamp_ntz").alias("started_at"),
                F.when(status != "running", F.col("o_day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(5))).alias("finished_at"),
                F.ceil(F.col("items_seen") / 10).cast("bigint").alias("pages_fetched"),
                "items_seen",
                "items_new",
                "items_updated",
                "items_removed",
                F.when(status == "partial", F.lit(2)).when(status == "failed", F.lit(5)).otherwise(0).cast("bigint").alias("error_count"),
                F.lit(None).cast("string").alias("error_message"),
            )
        )

    @cached_property
    def listing_valuation(self) -> DataFrame:
        """Stored estimates for listings with a detail."""
        k = F.col("o_orderkey")
        expected = F.when(k % 41 != 0, F.floor("o_totalprice") * (F.lit(0.85) + (k % 7) / F.lit(20.0)))
        price = F.floor("o_totalprice")
        residual = (price - expected) / expected * 100
        return (
            self.raw("orders")
            .where(k % 13 != 0)
            .select(
                k.alias("listing_id"),
                expected.alias("expected_price_czk"),
                (expected / (8 + k % 120)).alias("expected_price_per_m2"),
                (price - expected).alias("residual_absolute"),
                residual.alias("residual_percent"),
                F.when(residual <= -10, "under_market").when(residual >= 10, "over_market").when(residual.isNotNull(), "near_market").alias("classification"),
                F.when(k % 41 == 0, "unavailable").when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low").alias("confidence"),
            )
        )

    @cached_property
    def listing_anomaly(self) -> DataFrame:
        """Stored scores for two thirds of the listings."""
        k = F.col("o_orderkey")
        flags = F.array_compact(
            F.array(
                F.when(k % 4 == 0, F.lit("extreme_price_per_m2")),
                F.when(k % 5 == 0, F.lit("possible_duplicate")),
                F.when(k % 6 == 0, F.lit("stale_listing")),
            )
        )
        score = F.when(k % 4 == 0, 30.0).otherwise(0.0) + F.when(k % 5 == 0, 35.0).otherwise(0.0) + F.when(k % 6 == 0, 15.0).otherwise(0.0)
        return (
            self.raw("orders")
            .where(k % 3 != 1)
            .select(k.alias("listing_id"), score.alias("anomaly_score"), flags.alias("anomaly_flags"), ((k % 31) / F.lit(30.0)).alias("confidence_score"))
        )

    @cached_property
    def expected_totals(self) -> DataFrame:
        """External totals per slice: the active count, off by a planted amount."""
        key = F.col("category_main_cb") * 3 + F.col("category_type_cb")
        return (
            self.listing.where("is_active")
            .groupBy("category_main_cb", "category_type_cb")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(
                "category_main_cb",
                "category_type_cb",
                F.when(key % 4 == 0, F.floor(F.col("n") * F.lit(1.1)))
                .when(key % 4 == 1, F.floor(F.col("n") * F.lit(0.9)))
                .otherwise(F.col("n") + 1)
                .cast("bigint")
                .alias("expected_total"),
            )
        )

    @cached_property
    def region_polygon(self) -> DataFrame:
        """A diamond with a diamond hole per nation, in lon/lat vertices."""
        n = F.col("n_nationkey")
        lat = F.lit(48.5) + (n % 5) * F.lit(0.55)
        lon = F.lit(12.4) + F.floor(n / 5) * F.lit(0.65)

        def diamond(rx: float, ry: float) -> Column:
            pts = [(rx, 0.0), (0.0, ry), (-rx, 0.0), (0.0, -ry)]
            return F.array(*[F.struct((lon + F.lit(x)).alias("x"), (lat + F.lit(y)).alias("y")) for x, y in pts])

        return self.raw("nation").select(
            (1 + n % 14).cast("int").alias("region_id"),
            n.cast("int").alias("part_id"),
            diamond(0.4, 0.35).alias("exterior"),
            F.array(diamond(0.08, 0.06)).alias("holes"),
        )
