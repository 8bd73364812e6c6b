"""JSON payloads: scan, list items, detail objects, region hints, archive.

Two generations of shape are read side by side: each document is parsed once
with a declared schema, all fields are column expressions over the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hearthline.functions.exprs import czech_date, first_text, first_trimmed, floor_fraction, iso_date, leading_int, locality_text, safe_bool, truthy
from hearthline.functions.urls import DEFAULT_HOST, public_url
from hearthline.session import growing

# Names in the item table and the fields they fill.
ITEM_FIELDS = {
    "Poznámka k ceně": "note_about_price",
    "ID zakázky": "id_of_order",
    "Aktualizace": "last_update",
    "Stavba": "material",
    "Stav objektu": "building_condition",
    "Vlastnictví": "ownership",
    "Podlaží": "floor",
    "Užitná plocha": "usable_area",
    "Plocha podlahová": "floor_area",
    "Plocha pozemku": "land_area",
    "Bezbariérový": "no_barriers",
    "Datum zahájení prodeje": "start_of_offer",
}

# Locality slugs in URL order.
SEO_NAMES = [f"{n}_seo_name" for n in ("city", "citypart", "ward", "street", "municipality", "district", "quarter")]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line as text, with the file and its time."""
    return spark.read.text(path).select(
        F.col("value").alias("payload"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("fetched_at"),
    )


_CATEGORIES = "category_main_cb string, category_type_cb string, category_sub_cb string"
_CODED = "furnished string, elevator string, object_kind string, building_type string, building_condition string, ownership string, energy_efficiency_rating_cb string"
_FLAGS = "garden string, terrace string, balcony string, loggia string, basin string, cellar string, garage string, low_energy string, easy_access string"
_PLACES = "region string, district string, municipality string, city string, quarter string, citypart string, ward string, street string"
_PLACE_IDS = "district_id string, ward_id string, region_id string, quarter_id string, municipality_id string"
_PREMISE = "struct<ask_id: string, name: string>"

# Fields are read as text: a field that is a scalar in one shape and an object
# in the other comes as the object's JSON text.
LIST_SHAPE = f"""
    hash_id string, advert_name string, name string, {_CATEGORIES}, price_czk string, price string,
    seo struct<category_main_cb: string, category_type_cb: string, category_sub_cb: string, locality: string>,
    gps struct<lat: string, lon: string>, locality string, locality_gps_lat string, locality_gps_lon string,
    locality_region_id string
"""
DETAIL_SHAPE = f"""
    hash_id string, advert_name string, name string, {_CATEGORIES}, seo struct<locality: string>, locality string,
    advert_description string, description string, text struct<value: string>, meta_description string,
    {_CODED}, {_FLAGS}, parking_lots string, usable_area string, floor_area string, land_area string, building_area string,
    floor string, floor_number string, floors string, total_floors string, edited string, street_id string,
    premise {_PREMISE}, items array<struct<name: string, value: string>>, advert_images array<string>,
    recommendations_data struct<{", ".join(f.replace(" ", ": ") for f in f"{_CODED}, {_FLAGS}, {_PLACES}".split(", "))},
      parking_lots: string, locality_street_id: string, locality_district_id: string, locality_ward_id: string,
      locality_region_id: string, locality_quarter_id: string, locality_municipality_id: string,
      locality_gps_lat: string, locality_gps_lon: string>,
    _embedded struct<seller: struct<user_id: string, _embedded: struct<premise: {_PREMISE}>>,
      images: struct<_embedded: struct<images: array<struct<href: string>>>>>
"""
LOCALITY_SHAPE = f"{_PLACES}, {_PLACE_IDS}, gps_lat string, gps_lon string, " + ", ".join(f"{n} string" for n in SEO_NAMES)


def _is_object(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("{")), F.lit(False))


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


class Doc:
    """Fields of parsed payloads: ``top`` is the document, ``place`` its locality object."""

    def __init__(self, top: str, place: str):
        self.top, self.place = top, place

    def plain(self, path: str) -> Column:
        """The field as text; objects come as JSON text."""
        if path.startswith("locality."):
            return F.col(f"{self.place}.{path[9:]}")
        return F.col(f"{self.top}.{path}")

    def text(self, path: str) -> Column:
        """A scalar as text; NULL for objects."""
        raw = self.plain(path)
        return F.when(~_is_object(raw), raw)

    def _first(self, paths: tuple[str, ...], read) -> Column:
        return F.coalesce(*[truthy(read(self.plain(p))) for p in paths[:-1]], read(self.plain(paths[-1])))

    def integer(self, *paths: str) -> Column:
        """First non-zero whole number among ``paths``, else the last one."""
        return self._first(paths, _whole)

    def number(self, *paths: str) -> Column:
        return self._first(paths, lambda t: t.try_cast("double"))

    def is_object(self, path: str) -> Column:
        return _is_object(self.plain(path))

    def member(self, path: str, name: str) -> Column:
        """A field of an object that came as text."""
        raw = self.plain(path)
        return F.when(_is_object(raw), F.get_json_object(raw, f"$.{name}"))

    def code(self, *paths: str) -> Column:
        """``{value: x}`` or a scalar as text; empty and 0 give way to the next path."""

        def own(path: str) -> Column:
            raw = self.plain(path)
            keep = ~raw.isin("", "0") if path != paths[-1] else raw.isNotNull()
            return F.when(_is_object(raw), F.get_json_object(raw, "$.value")).when(keep, raw)

        return F.coalesce(*[own(p) for p in paths])

    def flag(self, *paths: str) -> Column:
        return safe_bool(F.coalesce(*[self.plain(p) for p in paths]))

    def name(self, path: str) -> Column:
        """A name given as text or as ``{name: ...}``."""
        raw = self.plain(path)
        return F.when(_is_object(raw), F.get_json_object(raw, "$.name")).otherwise(raw)


def parsed_payloads(payloads: DataFrame, shape: str, top: str = "_d", place: str = "_l") -> tuple[DataFrame, Doc]:
    """``payloads`` with the document and its locality as structs; a ``result`` wrapper is taken off.

    The structs come out of a generator, which the optimizer neither copies into
    later expressions nor filters through, so a document is parsed once.
    Payloads that have the structs already are returned as they are.
    """
    if top in payloads.columns:
        return payloads, Doc(top, place)
    once = lambda name, parsed: F.inline(F.array(F.struct(parsed.alias(name))))
    body = F.col("payload")
    if shape is DETAIL_SHAPE:
        # a name may be written with escapes
        wrapped = F.contains(body, F.lit('"result"')) | F.contains(body, F.lit("\\u"))
        body = F.coalesce(F.when(wrapped, F.get_json_object(body, "$.result")), body)
    rows = payloads.select("*", once(top, F.from_json(body, shape)))
    # a plain name is no JSON; the parser would fail on it, which costs more than all the rest
    locality = F.col(f"{top}.locality")
    return rows.select("*", once(place, F.from_json(F.when(locality.rlike(r"^\s*[\[{]"), locality), LOCALITY_SHAPE))), Doc(top, place)


def admin_names(doc: Doc, rec: str | None = None) -> dict[str, Column]:
    """Region, district, municipality and quarter with their fallbacks."""

    def pick(own: list[str], other: list[str]) -> Column:
        paths = [f"locality.{p}" for p in own] + ([f"{rec}.{p}" for p in other] if rec else [])
        return first_trimmed(*[doc.name(p) for p in paths])

    return {
        "region": pick(["region"], ["region"]),
        "district": pick(["district"], ["district"]),
        "municipality": pick(["municipality", "city"], ["municipality", "city"]),
        "quarter": pick(["quarter", "citypart", "ward"], ["quarter", "citypart"]),
    }


def _with_codes(rows: DataFrame, doc: Doc) -> DataFrame:
    """Adds ``_k``: the parts of the public URL."""
    code = lambda n: doc.code(n).try_cast("int")
    seo = first_text(doc.plain("seo.locality"))
    slugs = F.nullif(F.concat_ws("-", *[first_text(doc.plain(f"locality.{n}")) for n in SEO_NAMES]), F.lit(""))
    parts = {
        "main": code("category_main_cb"), "deal": code("category_type_cb"), "sub": code("category_sub_cb"),
        "title": first_text(doc.plain("advert_name"), doc.plain("name")), "place": F.coalesce(seo, slugs), "sub_name": doc.member("category_sub_cb", "name"),
    }
    return rows.withColumn("_k", F.struct(*[c.alias(n) for n, c in parts.items()]))


def _url(doc: Doc, host: str) -> Column:
    k = lambda n: F.col(f"_k.{n}")
    built = public_url(doc.plain("hash_id"), k("main"), k("deal"), k("sub"), k("title"), host, k("place"), k("sub_name"))
    return F.when(doc.plain("hash_id").isNotNull(), built)


def parse_list(payloads: DataFrame, host: str = DEFAULT_HOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """List payloads to listing columns; ``keep`` names input columns to carry along."""
    rows, doc = parsed_payloads(payloads, LIST_SHAPE)
    code = lambda n: doc.code(n, f"seo.{n}").try_cast("int")
    price = F.when(doc.is_object("price_czk"), truthy(_whole(doc.member("price_czk", "value_raw")))).otherwise(doc.integer("price_czk", "price"))
    # Used several times each, so they are columns of their own.
    part = first_text(doc.text("locality.citypart"), doc.text("locality.quarter"), doc.text("locality.ward"))
    names = {"district": doc.text("locality.district"), "city": doc.text("locality.city"), "part": part, "street": doc.text("locality.street")}
    rows = _with_codes(rows.withColumn("_p", F.struct(*[c.alias(n) for n, c in names.items()])), doc)
    place = locality_text(*[F.col(f"_p.{n}") for n in names])
    return rows.select(
        *keep,
        doc.plain("hash_id").alias("hash_id"),
        first_text(doc.plain("advert_name"), doc.plain("name")).alias("title"),
        F.coalesce(code("category_main_cb"), F.lit(0)).alias("category_main_cb"),
        F.coalesce(code("category_type_cb"), F.lit(0)).alias("category_type_cb"),
        code("category_sub_cb").alias("category_sub_cb"),
        price.alias("price_czk"),
        doc.member("price_czk", "unit").alias("price_czk_unit"),
        doc.number("gps.lat", "locality.gps_lat", "locality_gps_lat").alias("gps_lat"),
        doc.number("gps.lon", "locality.gps_lon", "locality_gps_lon").alias("gps_lon"),
        F.coalesce(doc.text("locality"), place).alias("locality_text"),
        _url(doc, host).alias("source_url"),
    )


def _place_struct(doc: Doc, rec: str) -> Column:
    whole = lambda path: _whole(doc.plain(path)).cast("int")
    place_id = lambda own, name: F.coalesce(truthy(whole(own)), whole(f"{rec}.{name}")).alias(name)
    return F.struct(
        *[c.alias(n) for n, c in admin_names(doc, rec).items()],
        place_id("street_id", "locality_street_id"),
        *[place_id(f"locality.{n}_id", f"locality_{n}_id") for n in ("district", "ward", "region", "quarter", "municipality")],
        doc.number("locality.gps_lat", f"{rec}.locality_gps_lat").alias("gps_lat"),
        doc.number("locality.gps_lon", f"{rec}.locality_gps_lon").alias("gps_lon"),
    )


def parse_detail(payloads: DataFrame, host: str = DEFAULT_HOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """Detail payloads to detail columns plus ``location`` (struct) and ``images`` (array)."""
    rows, doc = parsed_payloads(payloads, DETAIL_SHAPE)
    rec = "recommendations_data"
    label = {field: name for name, field in ITEM_FIELDS.items()}
    # Of several table entries of one name the last counts.
    named = lambda name: F.try_element_at(F.filter("_d.items", lambda e: e["name"] == name), F.lit(-1))
    entry = {field: named(name) for field, name in label.items()}
    rows = rows.withColumn("_t", F.struct(*[e.alias(f) for f, e in entry.items()]))
    item = lambda field: F.col(f"_t.{field}.value")
    has = lambda field: F.col(f"_t.{field}").isNotNull()
    both = lambda n: (n, f"{rec}.{n}")
    coded = lambda n: F.when(has(n), item(n)).otherwise(doc.code(*both(n))) if n in label else doc.code(*both(n))
    area = lambda n: F.coalesce(leading_int(first_text(item(n))), leading_int(doc.plain(n)))

    number = _whole(doc.plain("floor_number")).cast("int")
    floors = doc.integer("floors", "total_floors").cast("int")
    given = F.coalesce(
        first_text(doc.plain("floor")),
        F.when(number.isNotNull() & floors.isNotNull(), F.concat_ws("/", number.cast("string"), floors.cast("string"))),
    )
    rows = rows.withColumn("_f", F.struct(number.alias("number"), floors.alias("floors"), F.coalesce(first_text(item("floor")), given).alias("text")))
    rows = _with_codes(rows, doc)
    floor = F.col("_f.text")
    by_text = floor_fraction(floor)
    edited = first_text(doc.plain("edited"))
    seller = "_embedded.seller"
    premise = lambda n: F.when(doc.plain("premise").isNotNull(), doc.plain(f"premise.{n}")).otherwise(doc.plain(f"{seller}._embedded.premise.{n}"))
    direct = F.transform(
        "_d.advert_images",
        lambda e: F.when(
            F.startswith(e, F.lit("{")), F.coalesce(first_text(F.get_json_object(e, "$.url")), first_text(F.get_json_object(e, "$.href")))
        ).otherwise(first_text(e)),
    )
    embedded = F.transform("_d._embedded.images._embedded.images", lambda e: first_text(e["href"]))
    none = F.array().cast("array<string>")
    direct, embedded = [F.coalesce(F.array_compact(a), none) for a in (direct, embedded)]
    fields = {
        "description": F.coalesce(first_text(doc.plain("advert_description")), first_text(doc.plain("description")), doc.plain("text.value")),
        "meta_description": doc.plain("meta_description"),
        **{n: coded(n) for n in ("furnished", "elevator", "object_kind", "building_type", "building_condition", "ownership")},
        "energy_efficiency_rating": doc.code(*both("energy_efficiency_rating_cb")),
        **{
            n: doc.flag(*both(n))
            for n in ("garden", "terrace", "balcony", "loggia", "basin", "cellar", "garage", "low_energy", "easy_access")
        },
        "parking_lots": doc.integer("parking_lots", f"{rec}.parking_lots").cast("int"),
        "broker_id": first_text(F.coalesce(doc.plain(f"{seller}.user_id"), premise("ask_id"))),
        "broker_company": premise("name"),
        "usable_area": area("usable_area"),
        "floor_area": area("floor_area"),
        "land_area": area("land_area"),
        "built_up_area": leading_int(doc.plain("building_area")),
        "floor": floor,
        "floor_number": F.when(floor.isNotNull(), by_text[0]).otherwise(F.col("_f.number")),
        "total_floors": F.when(floor.isNotNull(), by_text[1]).otherwise(F.col("_f.floors")),
        **{n: item(n) for n in ("material", "note_about_price", "id_of_order", "no_barriers", "start_of_offer")},
        "last_updated_at": F.when(has("last_update"), czech_date(item("last_update"))).when(edited.isNotNull(), iso_date(edited)),
        "source_url": _url(doc, host),
        "location": _place_struct(doc, rec),
        "images": F.when(F.size(direct) > 0, direct).otherwise(embedded),
    }
    return rows.select(*keep, *[c.alias(n) for n, c in fields.items()])


def has_place(location: Column) -> Column:
    """True when a parsed location says anything."""
    names = "region district municipality quarter".split()
    ids = [f"locality_{n}_id" for n in ("street", "district", "ward", "region", "quarter", "municipality")]
    return F.coalesce(*[location[n].cast("string") for n in names], *[truthy(location[n]).cast("string") for n in ids], location["gps_lat"].cast("string"), location["gps_lon"].cast("string")).isNotNull()


def list_hints(payloads: DataFrame) -> DataFrame:
    """Region id and position of list payloads (hash_id, payload)."""
    rows, doc = parsed_payloads(payloads, LIST_SHAPE)
    return rows.select(
        "hash_id",
        doc.integer("locality.region_id", "locality_region_id").cast("int").alias("locality_region_id"),
        doc.number("gps.lat", "locality.gps_lat", "locality_gps_lat").alias("gps_lat"),
        doc.number("gps.lon", "locality.gps_lon", "locality_gps_lon").alias("gps_lon"),
    )


def latest_payloads(payloads: DataFrame, kind: str, key: str) -> DataFrame:
    """Newest payload per key."""
    rows = payloads.where((F.col("payload_type") == kind) & F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by("payload", F.struct("fetched_at", "id")).alias("payload"))


def region_hints(listing: DataFrame, detail: DataFrame, payloads: DataFrame) -> DataFrame:
    """Hints per listing from its newest list and detail payload, first one wins per field."""
    from_list = list_hints(latest_payloads(payloads, "list", "hash_id")).select(
        F.col("hash_id").alias("l_hash"), *[F.col(c).alias(f"l_{c}") for c in ("locality_region_id", "gps_lat", "gps_lon")]
    )
    parsed = parse_detail(latest_payloads(payloads, "detail", "listing_id"), keep=("listing_id",))
    from_detail = parsed.select(
        F.col("listing_id").alias("d_id"), F.col("location.region").alias("d_name"), F.col("location.locality_region_id").alias("d_rid"),
        F.col("location.gps_lat").alias("d_lat"), F.col("location.gps_lon").alias("d_lon"),
    )
    have = detail.select(F.col("listing_id").alias("have_id"))
    return (
        listing.select("id", "hash_id")
        .join(growing(from_list), F.col("hash_id") == F.col("l_hash"), "left")
        .join(growing(from_detail), F.col("id") == F.col("d_id"), "left")
        .join(growing(have), F.col("id") == F.col("have_id"), "left")
        .select(
            F.col("id").alias("listing_id"),
            F.col("d_name").alias("detail_region_name"),
            F.coalesce("l_locality_region_id", "d_rid").alias("locality_region_id"),
            F.coalesce("l_gps_lat", "d_lat").alias("gps_lat"),
            F.coalesce("l_gps_lon", "d_lon").alias("gps_lon"),
            (F.col("d_id").isNotNull() | F.col("have_id").isNotNull()).alias("has_detail"),
        )
    )


PLACE_FIELDS = ["region", "district", "municipality", "quarter"]


def backfill_location_names(listing: DataFrame, location: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(locations with names filled from payloads, one row of updated and skipped counts).

    Only locations without a region are touched. Names come from the newest
    detail payload; without a region there, the list payload fills the gaps.
    """
    from_detail = parse_detail(latest_payloads(payloads, "detail", "listing_id"), keep=("listing_id",)).select(
        F.col("listing_id").alias("d_id"), *[F.col(f"location.{f}").alias(f"d_{f}") for f in PLACE_FIELDS]
    )
    lists, doc = parsed_payloads(latest_payloads(payloads, "list", "hash_id"), LIST_SHAPE)
    names = admin_names(doc)
    from_list = lists.select(F.col("hash_id").alias("l_hash"), *[names[f].alias(f"l_{f}") for f in PLACE_FIELDS])
    open_places = location.where("region is null").select(F.col("id").alias("loc_id"))
    found = (
        listing.select("id", "hash_id", "location_id")
        .join(growing(open_places), F.col("location_id") == F.col("loc_id"))
        .join(growing(from_detail), F.col("id") == F.col("d_id"), "left")
        .join(growing(from_list), F.col("hash_id") == F.col("l_hash"), "left")
    )
    merged = {
        f: F.when(F.col("d_region").isNull(), F.coalesce(f"d_{f}", f"l_{f}")).otherwise(F.col(f"d_{f}")) for f in PLACE_FIELDS
    }
    found = found.select("id", "loc_id", *[c.alias(f"n_{f}") for f, c in merged.items()]).withColumn(
        "any_name", F.coalesce(*[f"n_{f}" for f in PLACE_FIELDS]).isNotNull()
    )
    counts = found.agg(F.count_if("any_name").alias("updated"), F.count_if(~F.col("any_name")).alias("skipped"))
    # Several listings may share a place; per field the one with the highest id wins.
    best = found.where("any_name").groupBy("loc_id").agg(
        *[F.max_by(f"n_{f}", F.when(F.col(f"n_{f}").isNotNull(), F.col("id"))).alias(f"n_{f}") for f in PLACE_FIELDS]
    )
    filled = location.join(best, F.col("id") == F.col("loc_id"), "left")
    for f in PLACE_FIELDS:
        filled = filled.withColumn(f, F.coalesce(f"n_{f}", f))
    return filled.select(*location.columns), counts


def newest_list_payloads(payloads: DataFrame, drop_lists: bool = False) -> DataFrame:
    """Archive after pruning: list payloads only in their newest version per hash, or not at all."""
    others = payloads.where("payload_type <> 'list'")
    if drop_lists:
        return others
    newest = Window.partitionBy("hash_id").orderBy(F.col("fetched_at").desc(), F.col("id").desc())
    lists = payloads.where("payload_type = 'list' and hash_id is not null")
    return others.unionByName(lists.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn"))


def archive_payloads(payloads: DataFrame, path: str) -> None:
    """Append verbatim payloads, partitioned by fetch date."""
    payloads.withColumn("fetch_date", F.to_date("fetched_at")).write.mode("append").partitionBy("fetch_date").parquet(path)
