"""One ingest sweep: validate, dedupe, compare with the state, next state.

Everything is a join of the current listing table with the batch on
``hash_id``; the job writes the next state, the history rows and the rejects
once.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F
from pyspark.sql.types import StructType

from hearthline.functions.codebooks import REGION_NAMES, SUBCATEGORIES_BY_MAIN
from hearthline.functions.exprs import first_text, truthy, ts
from hearthline.schemas import SCRAPING_RUN
from hearthline.session import growing
from hearthline.sources.payloads import LIST_SHAPE, parse_list, parsed_payloads

OFFSET_CAP = 9900

BATCH_COLUMNS = (
    "hash_id title category_main_cb category_type_cb category_sub_cb price_czk price_czk_unit gps_lat gps_lon locality_text source_url"
).split()

#: Columns that ``mark_items`` adds.
MARKS = ("_ok", "_raw_hash", "_message")


def surrogate_id(hash_id: Column) -> Column:
    """A positive 64-bit id that is the same on every run."""
    return F.xxhash64(hash_id).bitwiseAND(F.lit(2**63 - 1))


def mark_items(payloads: DataFrame) -> DataFrame:
    """Payload rows with their parsed structs and ``_ok``, ``_raw_hash``, ``_message``: an item needs a hash id and a name."""
    rows, doc = parsed_payloads(payloads, LIST_SHAPE)
    hash_id = F.nullif(first_text(doc.plain("hash_id")), F.lit("0"))
    ok = hash_id.isNotNull() & first_text(doc.plain("name"), doc.plain("advert_name")).isNotNull()
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))
    message = F.concat(
        F.lit("Missing required field(s) (hash_id="), quoted(doc.plain("hash_id")), F.lit(", name="), quoted(doc.plain("name")), F.lit(")")
    )
    marked = rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_raw_hash", doc.plain("hash_id"))
    return marked.withColumn("_message", F.when(~F.col("_ok"), message))


def reject_rows(marked: DataFrame, run_id: int = 0, as_of: datetime | None = None) -> DataFrame:
    """Reject log rows of marked items."""
    return marked.where("not _ok").select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.col("_raw_hash").alias("hash_id"),
        F.lit("validate").alias("stage"),
        F.col("_message").alias("message"),
        (ts(as_of) if as_of else F.lit(None).cast("timestamp_ntz")).alias("created_at"),
    )


def split_items(payloads: DataFrame, run_id: int = 0, as_of: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid payload rows, reject log rows).

    The valid rows keep the parsed structs for ``parse_list``.
    """
    marked = mark_items(payloads)
    return marked.where("_ok").drop(*MARKS), reject_rows(marked, run_id, as_of)


def first_per_hash(batch: DataFrame, order: list[str]) -> DataFrame:
    """The first row of every hash id; a rank filter is cut per task before the shuffle."""
    w = Window.partitionBy("hash_id").orderBy(*order)
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def union_slices(batch: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique items of overlapping slices, shortfall per category).

    ``batch`` carries (category, slice_no, position, hash_id, ...), ``totals``
    (category, probed_total).
    """
    w = Window.partitionBy("category", "hash_id").orderBy("slice_no", "position")
    unique = batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    recovered = unique.groupBy("category").agg(F.count(F.lit(1)).alias("recovered"))
    gap = F.col("probed_total") - F.col("recovered")
    gaps = (
        totals.join(recovered, "category", "left")
        .withColumn("recovered", F.coalesce("recovered", F.lit(0)))
        .withColumn("gap", gap)
        .where("probed_total > 0 and gap > 0")
        .withColumn("gap_pct", F.col("gap") / F.col("probed_total") * 100)
        .withColumn("stage", F.lit("coverage_gap"))
    )
    return unique, gaps.select("category", "stage", "probed_total", "recovered", "gap", "gap_pct")


def plan_slices(totals: DataFrame, sub_totals: DataFrame, cap: int = OFFSET_CAP) -> DataFrame:
    """Worklist of slices so that none exceeds ``cap`` where a split exists.

    ``totals`` is (category_main_cb, category_type_cb, total), ``sub_totals``
    adds category_sub_cb. A slice over the cap is read by region and by
    sub-category, and a sub-category over the cap again by region.
    """
    regions = F.array(*map(F.lit, REGION_NAMES))
    known = F.create_map(*[c for m, subs in SUBCATEGORIES_BY_MAIN.items() for c in (F.lit(m), F.array(*map(F.lit, subs)))])
    none = F.array(F.lit(None).cast("int"))
    keys = ["category_main_cb", "category_type_cb"]
    big = totals.where(F.col("total") > cap)
    whole = totals.where(F.col("total") <= cap).select(*keys, F.lit(None).cast("int").alias("category_sub_cb"), F.lit(None).cast("int").alias("region_id"))
    by_region = big.select(*keys, F.lit(None).cast("int").alias("category_sub_cb"), F.explode(regions).alias("region_id"))
    subs = big.select(*keys, F.explode(known[F.col("category_main_cb")]).alias("category_sub_cb"))
    sized = subs.join(sub_totals.select(*keys, "category_sub_cb", F.col("total").alias("sub_total")), [*keys, "category_sub_cb"], "left")
    by_sub = sized.select(
        *keys, "category_sub_cb", F.explode(F.when(F.col("sub_total") > cap, regions).otherwise(none)).alias("region_id")
    )
    return whole.unionByName(by_region).unionByName(by_sub)


def classify_sweep(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Full outer join of the state and the batch with one ``change`` per hash id."""
    s = state.select(*[F.col(c).alias(f"s_{c}") for c in state.columns])
    b = batch.select(*[F.col(c).alias(f"b_{c}") for c in BATCH_COLUMNS])
    joined = s.join(b, F.col("s_hash_id") == F.col("b_hash_id"), "full")
    offered = truthy(F.col("b_price_czk"))
    repriced = offered.isNotNull() & ~offered.eqNullSafe(F.col("s_price_czk"))
    change = (
        F.when(F.col("s_hash_id").isNull(), "new")
        .when(F.col("b_hash_id").isNull() & F.col("s_is_active"), "unseen")
        .when(F.col("b_hash_id").isNull(), "gone")
        .when(repriced, "price_changed")
        .when(~F.col("s_is_active"), "reactivated")
        .otherwise("unchanged")
    )
    return joined.withColumn("change", change)


@dataclass
class SweepResult:
    listing: DataFrame
    history: DataFrame
    rejects: DataFrame
    counters: DataFrame


@dataclass(frozen=True)
class SweepEvidence:
    """What is known about a finished sweep. Only a complete one tells that an unseen listing is gone."""

    full_sweep: bool
    failed_pages: int
    gap_pct: float
    tolerance_pct: float = 2.5

    def allows_delisting(self) -> bool:
        return self.full_sweep and self.failed_pages == 0 and self.gap_pct <= self.tolerance_pct


def apply_sweep(
    state: DataFrame,
    batch: DataFrame,
    as_of: datetime | Column,
    evidence: SweepEvidence | None = None,
    rejects: DataFrame | None = None,
    new_id=surrogate_id,
    counted: Observation | None = None,
) -> SweepResult:
    """Next listing state, history rows to append, and run counters.

    ``batch`` holds valid parsed items, one per hash id. Unseen active
    listings are marked as removed only if ``evidence`` shows that the batch
    is a complete sweep. ``counted`` gets the run counters when ``listing`` is written, without another join.
    """
    delist = evidence is not None and evidence.allows_delisting()
    now = as_of if isinstance(as_of, Column) else ts(as_of)
    diff = classify_sweep(state, batch)
    is_new, seen = F.col("change") == "new", F.col("b_hash_id").isNotNull()
    removed = (F.col("change") == "unseen") & F.lit(delist)
    kept = lambda c: F.col(f"s_{c}")
    offered = truthy(F.col("b_price_czk"))
    values: dict[str, Column] = {c: kept(c) for c in state.columns}
    for c in BATCH_COLUMNS:
        values[c] = F.when(is_new, F.col(f"b_{c}")).otherwise(kept(c))
    values["id"] = F.when(is_new, new_id(F.col("b_hash_id"))).otherwise(kept("id")).cast("bigint")
    for c in ("gps_lat", "gps_lon"):
        values[c] = F.coalesce(f"b_{c}", f"s_{c}")
    values["source_url"] = F.coalesce(first_text(F.col("b_source_url")), F.col("s_source_url"))
    values["price_czk"] = F.when(is_new, F.col("b_price_czk")).otherwise(F.coalesce(offered, kept("price_czk")))
    values["currency"] = F.coalesce(kept("currency"), F.lit("CZK"))
    values["is_active"] = F.when(seen, True).when(removed, False).otherwise(kept("is_active"))
    values["first_seen_at"] = F.when(is_new, now).otherwise(kept("first_seen_at"))
    values["last_seen_at"] = F.when(seen, now).otherwise(kept("last_seen_at"))
    values["removed_at"] = F.when(~seen, F.when(removed, now).otherwise(kept("removed_at")))
    counts = [
        F.count_if(seen).alias("items_seen"),
        F.count_if(is_new).alias("items_new"),
        F.count_if(F.col("change") == "price_changed").alias("items_updated"),
        F.count_if(removed).alias("items_removed"),
    ]
    watched = diff if counted is None else diff.observe(counted, *counts)
    listing = watched.select(*[values[c].alias(c) for c in state.columns])
    priced = (is_new & offered.isNotNull()) | (F.col("change") == "price_changed")
    history = with_record_id(diff.where(priced).select(values["id"].alias("listing_id"), offered.alias("price_czk"), now.alias("recorded_at")))
    counters = diff.agg(*counts)
    if rejects is None:
        counters = counters.withColumn("error_count", F.lit(0).cast("bigint"))
        rejects = state.sparkSession.createDataFrame([], "run_id bigint, hash_id string, stage string, message string, created_at timestamp_ntz")
    else:
        counters = counters.withColumn("error_count", rejects.agg(F.count(F.lit(1))).scalar())
    return SweepResult(listing, history, rejects, counters)


def with_record_id(records: DataFrame) -> DataFrame:
    return records.select(F.xxhash64("listing_id", "recorded_at", "price_czk").bitwiseAND(F.lit(2**63 - 1)).alias("id"), "*")


def repriced_since(before: DataFrame, after: DataFrame, now: Column) -> DataFrame:
    """The history rows of a sweep from the states before and after it, which is the same as ``SweepResult.history`` without joining the batch again."""
    old = before.select(F.col("hash_id").alias("o_hash_id"), F.col("price_czk").alias("o_price"))
    new = after.select(F.col("hash_id"), F.col("id").alias("listing_id"), F.col("price_czk").alias("price_czk"))
    changed = truthy(F.col("price_czk")).isNotNull() & (F.col("o_hash_id").isNull() | ~F.col("price_czk").eqNullSafe(F.col("o_price")))
    joined = new.join(growing(old), F.col("hash_id") == F.col("o_hash_id"), "left")
    return with_record_id(joined.where(changed).select("listing_id", "price_czk", now.alias("recorded_at")))


def sweep_payloads(
    state: DataFrame, payloads: DataFrame, as_of: datetime, order: list[str], evidence: SweepEvidence | None = None, run_id: int = 0, new_id=surrogate_id
) -> SweepResult:
    """Raw list payloads to the next state; ``order`` names the columns that give arrival order."""
    good, bad = split_items(payloads, run_id, as_of)
    batch = first_per_hash(parse_list(good, keep=tuple(order)), order)
    return apply_sweep(state, batch, as_of, evidence, bad, new_id)


def new_history_only(history: DataFrame, appended: DataFrame) -> DataFrame:
    """Rows of ``appended`` not yet stored, so that a repeated sweep adds nothing."""
    since = appended.agg(F.min("recorded_at")).scalar()
    recent = history.where(F.col("recorded_at") >= since)
    return appended.join(recent, ["listing_id", "recorded_at", "price_czk"], "left_anti")


def finish_sweep(state: DataFrame, swept_at: datetime | Column, evidence: SweepEvidence | None) -> DataFrame:
    """State after a sweep that came in several parts: active listings not seen since ``swept_at`` are removed, if the evidence allows it."""
    if evidence is None or not evidence.allows_delisting():
        return state
    now = swept_at if isinstance(swept_at, Column) else ts(swept_at)
    gone = F.col("is_active") & (F.col("last_seen_at") < now)
    return state.withColumn("removed_at", F.when(gone, now).otherwise(F.col("removed_at"))).withColumn("is_active", F.col("is_active") & ~gone)


def sweep_run_row(result: SweepResult, run_id: int, started_at: datetime, finished_at: datetime, pages_fetched: int, failed_pages: int = 0, category: str = "all") -> DataFrame:
    """The row of the run table for a finished sweep."""
    status = F.when(F.lit(failed_pages) > 0, F.lit("partial")).otherwise(run_status(F.col("items_seen"), F.col("error_count")))
    values = {
        "id": F.lit(run_id), "run_type": F.lit("incremental"), "status": status, "category": F.lit(category), "started_at": ts(started_at), "finished_at": ts(finished_at),
        "pages_fetched": F.lit(pages_fetched), "error_message": F.when(F.lit(failed_pages) > 0, F.lit(f"{failed_pages} pages failed")),
    }
    return as_table(result.counters.withColumns(values), SCRAPING_RUN)


def as_table(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` with its types."""
    fields = StructType.fromDDL(schema).fields
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def run_status(items_ok: Column, items_failed: Column) -> Column:
    return F.when(items_failed == 0, "success").when(items_ok > 0, "partial").otherwise("failed")


def newest_per_listing(parsed: DataFrame, order: list[str]) -> DataFrame:
    """The last payload of each listing in arrival order; a rank filter is cut per task before the shuffle."""
    w = Window.partitionBy("listing_id").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return parsed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_details(
    listing: DataFrame, location: DataFrame, parsed: DataFrame, as_of: datetime, order: list[str],
    stored_detail: DataFrame | None = None, stored_image: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Store parsed detail payloads (see ``parse_detail`` with ``keep=("listing_id", *order)``).

    ``order`` names the columns that give arrival order; of several payloads of
    a listing the newest counts. Returns the next detail, location, image and
    listing tables: rows of other listings stay, those of the listings at hand are
    replaced, so a repeated run changes nothing. A place gets a row of its own
    per detail.
    """
    from hearthline.functions.exprs import seller_type
    from hearthline.operators.valuation import upsert_latest
    from hearthline.sources.payloads import has_place

    place = F.col("location")
    rows = newest_per_listing(parsed, order).withColumn("new_location_id", F.when(has_place(place), F.col("listing_id")))
    skipped = {"location", "images", "source_url", "new_location_id", *order} - {"last_updated_at"}
    detail = rows.select(F.col("listing_id").alias("id"), *[c for c in rows.columns if c not in skipped], ts(as_of).alias("updated_at"))
    places = rows.where("new_location_id is not null").select(F.col("new_location_id").alias("id"), "location.*", F.lit("Česká republika").alias("country"))
    images = rows.select("listing_id", F.posexplode("images").alias("position", "url")).select(
        F.xxhash64("listing_id", "position", "url").bitwiseAND(F.lit(2**63 - 1)).alias("id"), "listing_id", "url", "position",
        F.lit(None).cast("string").alias("downloaded_path"),
    )
    patch = rows.select(
        F.col("listing_id").alias("p_id"), F.col("source_url").alias("p_url"), "new_location_id", seller_type(F.col("broker_company")).alias("p_seller")
    )
    joined = listing.join(growing(patch), F.col("id") == F.col("p_id"), "left")
    updated = (
        joined.withColumn("source_url", F.coalesce("p_url", "source_url"))
        .withColumn("location_id", F.coalesce("new_location_id", "location_id"))
        .withColumn("seller_type", F.coalesce("p_seller", "seller_type"))
        .select(*listing.columns)
    )
    if stored_detail is not None:
        detail = upsert_latest(stored_detail, as_columns(detail, stored_detail))
    if stored_image is not None:
        kept = stored_image.join(growing(rows.select("listing_id")), "listing_id", "left_anti")
        images = kept.select(*stored_image.columns).unionByName(images.select(*stored_image.columns))
    return {"listing_detail": detail, "location": upsert_latest(location, as_columns(places, location), "id"), "image": images, "listing": updated}


def as_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, null where ``df`` has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def detail_states(payloads: DataFrame, worklist: DataFrame) -> DataFrame:
    """Worklist with ``state``: read, unreadable or missing."""
    found = payloads.groupBy("listing_id").agg(F.max(F.try_parse_json("payload").isNotNull()).alias("_ok"))
    state = F.when(F.col("_ok"), "read").when(F.col("_ok").isNotNull(), "unreadable").otherwise("missing")
    return worklist.join(found, "listing_id", "left").withColumn("state", state).drop("_ok")


def detail_rejects(payloads: DataFrame, worklist: DataFrame, run_id: int, as_of: datetime) -> DataFrame:
    """A row of the item log for each listing of the worklist (listing_id, hash_id) whose detail is missing or unreadable."""
    bad = detail_states(payloads, worklist).where("state <> 'read'")
    message = F.when(F.col("state") == "missing", F.lit("No detail payload")).otherwise(F.lit("Unreadable detail payload"))
    return bad.select(F.lit(run_id).cast("bigint").alias("run_id"), "hash_id", F.lit("detail").alias("stage"), message.alias("message"), ts(as_of).alias("created_at"))


def detail_run(payloads: DataFrame, worklist: DataFrame) -> DataFrame:
    """Counters and status of a detail run: listings without a readable payload count as failed."""
    return detail_states(payloads, worklist).agg(
        F.count_if(F.col("state") == "read").alias("items_seen"), F.count_if(F.col("state") != "read").alias("error_count")
    ).withColumn("status", run_status(F.col("items_seen"), F.col("error_count")))
