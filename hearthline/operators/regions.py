"""Region resolution: name, id, polygon, mapping table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.exprs import first_text
from hearthline.functions.geo import inside_box, plausible_gps
from hearthline.functions.regions import region_id_from_code, region_id_from_name, region_name
from hearthline.session import cut_lineage

# Coordinate guard in degrees (south, west, north, east).
GUARD_BOX = (48.0, 12.0, 51.2, 19.0)
#: Squares of the cover: side of the largest ones in degrees, how often they may be quartered, edges up to which a square is left whole.
ROOT, DEEPEST, MOST_EDGES = 1.0, 12, 16
# The grid lies beside round coordinates, differently in both directions, so no edge of a polygon goes through a corner of a square.
OFFSET_X, OFFSET_Y = 0.000737119, 0.000412953
_EPS = 1e-15


def _named(**columns: Column) -> Column:
    """A struct whose field names stay, also inside a lambda or beside a generator."""
    return F.named_struct(*[c for name, value in columns.items() for c in (F.lit(name), value)])


def _at(degrees: Column, offset: float, level: Column | int) -> Column:
    """Number of the square of a level that a coordinate falls into."""
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level) / ROOT
    return F.floor((degrees - offset) * scale).cast("bigint")


def _odd(edges: Column, test) -> Column:
    return F.size(F.filter(edges, test)) % 2 == 1


def _crossing(e: Column, lon: Column, lat: Column) -> Column:
    """Half-open test: a ray to the east crosses the edge."""
    cut = (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"] + F.lit(_EPS)) + e["x1"]
    return ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < cut)


def _inside_ring(ring: Column, lon: Column, lat: Column, east: Column, south: Column) -> Column:
    """Even-odd rule with the edges of one square: from the point to the square's eastern border, then along
    it to the south-eastern corner, of which ``corner`` tells whether it is inside."""

    def along(e: Column) -> Column:
        cut = (e["y2"] - e["y1"]) * (east - e["x1"]) / (e["x2"] - e["x1"]) + e["y1"]
        return ((e["x1"] > east) != (e["x2"] > east)) & ((cut > lat) != (cut > south))

    to_border = _odd(ring["edges"], lambda e: _crossing(e, lon, lat)) != _odd(ring["edges"], lambda e: _crossing(e, east, lat))
    return (ring["corner"] != to_border) != _odd(ring["edges"], along)


def _inside(shape: Column, lon: Column, lat: Column, east: Column, south: Column) -> Column:
    """Inside the outer ring and in no hole."""
    ring = lambda r: _inside_ring(r, lon, lat, east, south)
    return F.exists(shape["rings"], lambda r: ~r["hole"] & ring(r)) & ~F.exists(shape["rings"], lambda r: r["hole"] & ring(r))


def _meets(e: Column, west: Column, south: Column, side: Column) -> Column:
    """The edge may meet the square: their boxes do, and the corners are not all on one side of its line."""
    margin = side * 1e-9 + 1e-9
    left, right, low, high = west - margin, west + side + margin, south - margin, south + side + margin
    turn = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    corners = [turn(x, y) for x in (left, right) for y in (low, high)]
    boxes = (F.least(e["x1"], e["x2"]) <= right) & (F.greatest(e["x1"], e["x2"]) >= left) & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["y1"], e["y2"]) >= low)
    return boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def _narrowed(shapes: Column, west: Column, south: Column, side: Column, corner) -> Column:
    """Shapes as one square sees them: the edges that may meet it, and ``corner(ring)``. Rings that miss the square go; so do
    shapes that the square is outside of."""

    def ring(r: Column) -> Column:
        return _named(hole=r["hole"], edges=F.filter(r["edges"], lambda e: _meets(e, west, south, side)), corner=corner(r))

    def shape(s: Column) -> Column:
        rings = F.filter(F.transform(s["rings"], ring), lambda r: (F.size(r["edges"]) > 0) | r["corner"])
        return _named(vertices=s["vertices"], region_id=s["region_id"], part_id=s["part_id"], rings=rings)

    gone = lambda s: ~F.exists(s["rings"], lambda r: ~r["hole"]) | F.exists(s["rings"], lambda r: r["hole"] & (F.size(r["edges"]) == 0))
    return F.filter(F.transform(shapes, shape), lambda s: ~gone(s))


def polygon_cover(polygons: DataFrame, most_edges: int = MOST_EDGES, deepest: int = DEEPEST) -> DataFrame:
    """Squares ``level, cell_y, cell_x`` that tile the polygons' surroundings, each with the ``shapes`` it is not outside of.

    Input rows are (region_id, part_id, exterior, holes) with vertex arrays
    of struct(x, y). A square with more than ``most_edges`` edges is quartered, so a
    point meets few edges however detailed a polygon is; a square inside a polygon has none.
    Only where many edges meet in one spot squares of the ``deepest`` level may have more.
    """

    def edges(pts) -> Column:
        """From each vertex to the one before it."""

        def edge(p, i) -> Column:
            q = F.get(pts, F.when(i == 0, F.size(pts) - 1).otherwise(i - 1))
            return _named(x1=p["x"].cast("double"), y1=p["y"].cast("double"), x2=q["x"].cast("double"), y2=q["y"].cast("double"))

        return F.transform(pts, edge)

    all_rings = F.concat(F.array("exterior"), F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType)))
    rings = F.transform(all_rings, lambda pts, k: _named(hole=k > 0, edges=edges(pts), corner=F.lit(False)))
    shape = _named(vertices=F.size("exterior"), region_id=F.col("region_id"), part_id=F.col("part_id"), rings=rings)
    xs, ys = F.transform("exterior", lambda p: p["x"]), F.transform("exterior", lambda p: p["y"])
    span = lambda v, offset: F.sequence(_at(F.array_min(v), offset, 0), _at(F.array_max(v), offset, 0))
    side = lambda level: F.lit(ROOT / 2**level)
    south, west = lambda level: F.col("cell_y") * side(level) + OFFSET_Y, lambda level: F.col("cell_x") * side(level) + OFFSET_X
    squares = polygons.where(F.size("exterior") >= 3).select(shape.alias("shape"), F.explode(span(ys, OFFSET_Y)).alias("cell_y"), span(xs, OFFSET_X).alias("xs")).select("shape", "cell_y", F.explode("xs").alias("cell_x"))
    whole = lambda r: _odd(r["edges"], lambda e: _crossing(e, west(0) + side(0), south(0)))
    squares = squares.withColumn("shapes", _narrowed(F.array("shape"), west(0), south(0), side(0), whole)).groupBy("cell_y", "cell_x").agg(F.flatten(F.collect_list("shapes")).alias("shapes"))
    leaves, level = [], 0
    many = F.aggregate("shapes", F.lit(0), lambda n, s: F.aggregate(s["rings"], n, lambda m, r: m + F.size(r["edges"]))) > most_edges
    while True:
        squares = cut_lineage(squares, f"polygon-squares-{level}")
        leaves.append(squares.where(~many if level < deepest else F.lit(True)).select(F.lit(level).alias("level"), "cell_y", "cell_x", "shapes"))
        if level == deepest or squares.where(many).isEmpty():
            break
        quarter = F.array(*[_named(cell_y=F.col("cell_y") * 2 + dy, cell_x=F.col("cell_x") * 2 + dx) for dy in (0, 1) for dx in (0, 1)])
        parts = squares.where(many).select((west(level) + side(level)).alias("east"), south(level).alias("south"), "shapes", F.explode(quarter).alias("q")).select("east", "south", "shapes", "q.*")
        level += 1
        inside = lambda r: _inside_ring(r, west(level) + side(level), south(level), F.col("east"), F.col("south"))  # noqa: B023, E731
        squares = parts.select("cell_y", "cell_x", _narrowed(F.col("shapes"), west(level), south(level), side(level), inside).alias("shapes"))
    return reduce(DataFrame.unionByName, leaves)


def region_from_polygon(points: DataFrame, polygons: DataFrame, lat: str = "lat", lon: str = "lon", box=GUARD_BOX, most_edges: int = MOST_EDGES) -> DataFrame:
    """Adds ``polygon_region_id``; of overlapping parts the one with the fewest vertices wins.

    A point finds the levels of the squares in its root square, then the one
    square it lies in. Points without usable coordinates get keys of their own, spread out, that no square has.
    """
    # Written, so that the planner knows its size and does not shuffle the points if it is small.
    cover = cut_lineage(polygon_cover(polygons, most_edges), "polygon-cover")
    root = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    roots = cut_lineage(cover.groupBy(root("cell_y").alias("root_y"), root("cell_x").alias("root_x")).agg(F.collect_set("level").alias("levels")), "polygon-roots")
    y, x = F.col(lat), F.col(lon)
    usable = plausible_gps(y, x) & inside_box(y, x, *box)
    nowhere = F.lit(-(10**9)) - F.pmod(F.monotonically_increasing_id(), F.lit(1024))
    keyed = points.withColumn("root_y", F.when(usable, _at(y, OFFSET_Y, 0)).otherwise(nowhere)).withColumn("root_x", F.when(usable, _at(x, OFFSET_X, 0)))
    keyed = keyed.join(roots, ["root_y", "root_x"], "left").select("*", F.explode_outer("levels").alias("level"))
    keyed = keyed.withColumn("cell_y", F.coalesce(_at(y, OFFSET_Y, F.col("level")), "root_y")).withColumn("cell_x", F.when(F.col("level").isNotNull(), _at(x, OFFSET_X, F.col("level"))))
    side = F.lit(ROOT) / F.pow(F.lit(2.0), F.col("level"))
    east, south = (F.col("cell_x") + 1) * side + OFFSET_X, F.col("cell_y") * side + OFFSET_Y
    best = F.array_min(F.transform(F.filter("shapes", lambda s: _inside(s, x, y, east, south)), lambda s: _named(v=s["vertices"], region_id=s["region_id"], p=s["part_id"])))
    # the squares tile their root, so of a point's levels one has a square
    found = keyed.join(cover, ["level", "cell_y", "cell_x"], "left").where(F.col("levels").isNull() | F.col("shapes").isNotNull())
    return found.withColumn("polygon_region_id", best["region_id"]).drop("root_y", "root_x", "levels", "level", "cell_y", "cell_x", "shapes")


HINT_FIELDS = "detail_region_name string, locality_region_id int, gps_lat double, gps_lon double, has_detail boolean"


def resolve_region(
    listing: DataFrame, location: DataFrame, polygons: DataFrame, hints: DataFrame | None = None,
    mapping: DataFrame | None = None, box=GUARD_BOX,
) -> DataFrame:
    """Region per listing: detail name, then region id, polygon, mapping table, else a reason.

    ``hints`` holds (listing_id, detail_region_name, locality_region_id,
    gps_lat, gps_lon, has_detail) read from payloads. ``mapping`` holds
    (listing_id, region_id) for places only a person or a service can name.
    """
    loc = location.select(
        F.col("id").alias("loc_id"), F.col("region").alias("loc_region"), F.col("locality_region_id").alias("loc_rid"),
        F.col("gps_lat").alias("loc_lat"), F.col("gps_lon").alias("loc_lon"),
    )
    rows = listing.select("id", "location_id", F.col("gps_lat").alias("own_lat"), F.col("gps_lon").alias("own_lon")).join(
        loc, F.col("location_id") == F.col("loc_id"), "left"
    )
    if hints is None:
        for field in HINT_FIELDS.split(", "):
            name, kind = field.split()
            rows = rows.withColumn(f"h_{name}", F.lit(None).cast(kind))
    else:
        h = hints.select(F.col("listing_id").alias("h_id"), *[F.col(f.split()[0]).alias(f"h_{f.split()[0]}") for f in HINT_FIELDS.split(", ")])
        rows = rows.join(h, F.col("id") == F.col("h_id"), "left")
    # The location speaks first, then payload hints; of positions the listing's own.
    m_lat, m_lon = F.coalesce("loc_lat", "h_gps_lat"), F.coalesce("loc_lon", "h_gps_lon")
    own = F.col("own_lat").isNotNull() & F.col("own_lon").isNotNull()
    merged = m_lat.isNotNull() & m_lon.isNotNull()
    partial = F.col("own_lat").isNotNull() | F.col("own_lon").isNotNull()
    pick = lambda mine, other: F.when(own, mine).when(merged, other).when(partial, mine).otherwise(other)
    rows = rows.select(
        F.col("id").alias("listing_id"),
        first_text(F.col("loc_region"), F.col("h_detail_region_name")).alias("name"),
        F.coalesce("loc_rid", "h_locality_region_id").alias("rid"),
        pick(F.col("own_lat"), m_lat).alias("lat"),
        pick(F.col("own_lon"), m_lon).alias("lon"),
        F.coalesce("h_has_detail", F.lit(False)).alias("has_detail"),
    )
    rows = region_from_polygon(rows, polygons, box=box)
    if mapping is not None:
        m = mapping.select(F.col("listing_id").alias("map_id"), F.col("region_id").alias("mapped"))
        rows = rows.join(m, F.col("listing_id") == F.col("map_id"), "left")
    else:
        rows = rows.withColumn("mapped", F.lit(None).cast("int"))
    lat, lon = F.col("lat"), F.col("lon")
    tried_name = F.col("has_detail") & F.col("name").isNotNull()
    rows = rows.select(
        "listing_id", "name", "rid", "lat", "lon", tried_name.alias("tried_name"), "polygon_region_id",
        F.when(tried_name, region_id_from_name(F.col("name"))).alias("by_name"),
        region_id_from_code(F.col("rid")).alias("by_code"),
        F.when(plausible_gps(lat, lon), F.col("mapped")).alias("by_map"),
    )
    chain = [("by_name", "detail"), ("by_code", "locality_region_id"), ("polygon_region_id", "gps_polygon"), ("by_map", "reverse_geocode")]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(s)) for c, s in chain], F.lit("unknown"))
    region_id = F.coalesce(*[F.col(c) for c, _ in chain]).cast("int")
    no_gps = lat.isNull() | lon.isNull()
    reason = (
        F.when(no_gps & F.col("name").isNull() & F.col("rid").isNull(), "no_detail_no_region_no_gps")
        .when(no_gps, "missing_gps")
        .when(~plausible_gps(lat, lon), "invalid_gps")
        .when(~inside_box(lat, lon, *box), "outside_czech_bounding_box")
        .when(F.col("tried_name"), "unresolved")
        .otherwise("polygon_miss")
    )
    return rows.select(
        "listing_id",
        region_id.alias("resolved_region_id"),
        region_name(region_id).alias("resolved_region_name"),
        source.alias("region_source"),
        F.when(region_id.isNull(), reason).alias("region_unknown_reason"),
    )


def apply_regions(listing: DataFrame, resolved: DataFrame, active_only: bool = True) -> DataFrame:
    """Listings with the newly resolved region; inactive ones keep theirs by default."""
    names = [c for c in resolved.columns if c != "listing_id"]
    fresh = resolved.select(F.col("listing_id").alias("res_id"), *[F.col(n).alias(f"new_{n}") for n in names])
    joined = listing.join(fresh, F.col("id") == F.col("res_id"), "left")
    use = F.col("res_id").isNotNull()
    if active_only:
        use = use & F.col("is_active")
    for n in names:
        joined = joined.withColumn(n, F.when(use, F.col(f"new_{n}")).otherwise(F.col(n)))
    return joined.select(*listing.columns)


def backfill_regions(
    listing: DataFrame, location: DataFrame, polygons: DataFrame, hints: DataFrame | None = None, mapping: DataFrame | None = None,
    active_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(listings after, stats in long form with phase before and after)."""
    from hearthline.operators.aggregates import region_resolution_stats

    rows = listing.where("is_active") if active_only else listing
    after = apply_regions(listing, resolve_region(rows, location, polygons, hints, mapping), active_only)
    stats = region_resolution_stats(listing, active_only).withColumn("phase", F.lit("before")).unionByName(
        region_resolution_stats(after, active_only).withColumn("phase", F.lit("after"))
    )
    return after, stats


# Fixed value: the bucket of places without an administrative area.
LEFTOVER_BUCKET = "foreign_or_incomplete_admin_area"


def region_leftovers(listing: DataFrame, location: DataFrame) -> DataFrame:
    """Active listings without a region, with empty columns for a reviewer."""
    loc = location.select(F.col("id").alias("loc_id"), "country")
    blank = lambda n: F.lit(None).cast("string").alias(n)
    return (
        listing.where("is_active and resolved_region_name is null")
        .join(loc, F.col("location_id") == F.col("loc_id"), "left")
        .select(
            F.col("id").alias("listing_id"), "hash_id", F.col("locality_text").alias("locality_string"), "country",
            F.lit(LEFTOVER_BUCKET).alias("reason_bucket"), blank("suggested_region"), blank("suggested_district"),
            blank("suggested_municipality"), blank("confidence"), blank("reviewer_notes"),
        )
    )


def apply_review(leftovers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Fill reviewed names by (locality_string, country)."""
    fields = ["region", "district", "municipality"]
    m = mapping.select(F.col("locality_string").alias("m_place"), F.col("country").alias("m_country"), *[F.col(f).alias(f"m_{f}") for f in fields])
    joined = leftovers.join(
        m, (F.col("locality_string") == F.col("m_place")) & F.col("country").eqNullSafe(F.col("m_country")), "left"
    )
    for f in fields:
        joined = joined.withColumn(f"suggested_{f}", F.coalesce(f"m_{f}", f"suggested_{f}"))
    return joined.select(*leftovers.columns)
