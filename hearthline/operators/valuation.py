"""Hedonic price estimates: one log-linear least-squares fit per segment.

The fit is done with normal equations. The effect of the grid cell is taken
out by demeaning inside the cell, which gives the same fitted values as one
dummy per cell. Sums of squares are accumulated per partition and added up;
only matrices of one row per segment are solved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.functions.exprs import floor_fraction, pct_change, segment_key, truthy, ts
from hearthline.functions.geo import grid_id
from hearthline.functions.quantiles import exact_quantile
from hearthline.session import cut_lineage, growing

# Sample sizes and class limits.
MIN_TRAINING = 30
MIN_CELL = 3
HIGH_SAMPLES = 100
HIGH_R2 = 0.4
UNDER_PCT = -10.0
OVER_PCT = 10.0
OTHER_CELL = "OTHER"
TARGET = "log_price_czk"

CATEGORICAL = ["category_sub_cb", "building_condition", "ownership", "energy_efficiency_rating"]
AMENITIES = ["balcony", "terrace", "loggia", "cellar", "garage"]
NUMERIC = ["log_usable_area", "floor_number"]

def model_inputs(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Active listings with an area and what the model takes from each row alone; a missing floor stays null."""
    d = detail.select(
        F.col("listing_id").alias("detail_key"), "usable_area", "floor", F.col("floor_number").alias("floor_raw"),
        *CATEGORICAL[1:], *AMENITIES,
    ).where("usable_area > 0")
    rows = listing.where("is_active").join(d, F.col("id") == F.col("detail_key"))
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))
    return rows.select(
        F.col("id").alias("listing_id"),
        segment_key(F.col("category_main_cb"), F.col("category_type_cb")).alias("segment_key"),
        "price_czk",
        F.col("usable_area").cast("double").alias("usable_area"),
        F.when(F.col("price_czk") > 0, F.ln(F.col("price_czk").cast("double"))).alias("y"),
        F.ln(F.col("usable_area").cast("double")).alias("log_usable_area"),
        F.coalesce(F.col("floor_raw"), floor_fraction(F.col("floor"))[0]).cast("double").alias("floor_number"),
        F.coalesce(F.col("category_sub_cb").cast("string"), F.lit("None")).alias("category_sub_cb"),
        *[unknown(c).alias(c) for c in CATEGORICAL[1:]],
        *[F.coalesce(c, F.lit(False)).cast("double").alias(c) for c in AMENITIES],
        F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), grid_id(F.col("gps_lat"), F.col("gps_lon")))
        .otherwise(F.lit("unknown"))
        .alias("cell_raw"),
    )


def segment_rows(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Active listings with an area, with model inputs; cells below three rows become OTHER."""
    base = cut_lineage(model_inputs(listing, detail), "segment-base")
    # Only cells that are too small are joined: the more rows there are, the fewer of them. Written, so that the planner knows how few;
    # the cell of unknown places, that may have most rows, is hardly ever one of them.
    small = base.groupBy(F.col("segment_key").alias("s_seg"), F.col("cell_raw").alias("s_cell")).agg(F.count(F.lit(1)).alias("cell_n")).where(F.col("cell_n") < MIN_CELL)
    small = cut_lineage(small, "small-cells")
    middle = exact_quantile(base, ["segment_key"], "floor_number", "median", "floor_mid").select(F.col("segment_key").alias("f_seg"), "floor_mid")
    totals = base.groupBy(F.col("segment_key").alias("t_seg")).agg(
        F.count(F.lit(1)).alias("segment_n"), F.count("y").alias("train_n")
    )
    # Written, so that the planner knows how few rows these are and does not shuffle the listings on the segment.
    totals = cut_lineage(totals.join(middle, F.col("t_seg") == F.col("f_seg"), "left").drop("f_seg"), "segment-totals")
    return (
        base.join(small, (F.col("segment_key") == F.col("s_seg")) & (F.col("cell_raw") == F.col("s_cell")), "left")
        .join(totals, F.col("segment_key") == F.col("t_seg"))
        .withColumn("cell", F.when(F.col("cell_n").isNotNull(), F.lit(OTHER_CELL)).otherwise(F.col("cell_raw")))
        .withColumn("floor_number", F.coalesce("floor_number", "floor_mid", F.lit(0.0)))
        .drop("s_seg", "s_cell", "cell_raw", "cell_n", "t_seg", "floor_mid")
    )


@dataclass(frozen=True)
class Features:
    """Columns of the fit: codes that become one column for each value but the first, and numbers."""

    categorical: tuple[str, ...] = tuple(CATEGORICAL)
    numeric: tuple[str, ...] = tuple(NUMERIC + AMENITIES)


def feature_index(rows: DataFrame, features: Features) -> DataFrame:
    """Per segment the names of its features in order: each column's codes sorted, without the first, then the numbers.

    The position of a name is its place in the design of that segment alone.
    """
    pairs = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("name"), F.col(c).alias("level")) for k, c in enumerate(features.categorical)]
    segments = rows.select("segment_key").distinct()
    plain = F.array(*map(F.lit, features.numeric)).cast("array<string>")
    if not pairs:
        return segments.withColumn("feature_list", plain)
    found = rows.select("segment_key", F.explode(F.array(*pairs)).alias("p")).select("segment_key", "p.*").distinct()
    first = found.groupBy("segment_key", "place").agg(F.min("level").alias("base"))
    others = found.join(first, ["segment_key", "place"]).where("level > base")
    names = others.groupBy("segment_key").agg(F.array_sort(F.collect_list(F.struct("place", "level", F.concat_ws("_", "name", "level").alias("feature")))).alias("own"))
    dummies = F.coalesce(F.transform("own", lambda e: e["feature"]), F.array().cast("array<string>"))
    return segments.join(names, "segment_key", "left").select("segment_key", F.concat(dummies, plain).alias("feature_list"))


def _vectors(rows: DataFrame, features: Features, index: DataFrame) -> DataFrame:
    """Adds ``x``, the non-zero features of a row as (i, v) pairs with positions in its segment's list, and ``p``, the length of that list.

    Positions are looked up once for each combination of codes, not for each row; numbers stand at the end of every list.
    """
    listed = index.select(
        F.col("segment_key").alias("i_seg"), F.size("feature_list").alias("p"),
        F.map_from_arrays("feature_list", F.sequence(F.lit(0), F.size("feature_list") - 1)).alias("position"),
    )
    codes = ["segment_key", *features.categorical]
    dummy = lambda n: F.struct(F.try_element_at("position", F.concat_ws("_", F.lit(n), F.col(n))).alias("i"), F.lit(1.0).alias("v"))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, v: DOUBLE>>)")
    dummies = F.filter(F.array(*[dummy(n) for n in features.categorical]), lambda e: e["i"].isNotNull()) if features.categorical else none
    known = rows.select(*codes).distinct().join(listed, F.col("segment_key") == F.col("i_seg"))
    known = cut_lineage(known.select(*[F.col(c).alias(f"k_{c}") for c in codes], "p", dummies.alias("dummies")), "segment-codes")
    joined = rows.join(known, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"k_{c}") for c in codes])).drop(*[f"k_{c}" for c in codes])
    first = F.col("p") - len(features.numeric)
    plain = [F.struct((first + k).alias("i"), F.col(n).cast("double").alias("v")) for k, n in enumerate(features.numeric)]
    numbers = F.filter(F.array(*plain), lambda e: e["v"] != 0) if plain else none
    return joined.withColumn("x", F.concat("dummies", numbers)).drop("dummies")


def _gram_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lists = batch.column("z")
        pairs = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        at, value = pairs.field("i").to_numpy(zero_copy_only=False), pairs.field("v").to_numpy(zero_copy_only=False)
        weight, p = batch.column("w").to_numpy(zero_copy_only=False), batch.column("p").to_numpy(zero_copy_only=False)
        segments = batch.column("segment_key").dictionary_encode()
        codes = segments.indices.to_numpy(zero_copy_only=False)
        for k, seg in enumerate(segments.dictionary.to_pylist()):
            own = np.flatnonzero(codes == k)
            place = np.full(len(codes), -1)
            place[own] = np.arange(len(own))
            here = place[row] >= 0
            z = np.zeros((len(own), int(p[own[0]]) + 2))
            z[place[row[here]], at[here]] = value[here]  # negative positions count from the end
            sums[seg] = sums.get(seg, 0.0) + (z * weight[own, None]).T @ z
    for seg, total in sums.items():
        yield pa.RecordBatch.from_pydict({"segment_key": [seg], "g": pa.array([total.ravel()], pa.list_(pa.float64()))})


def _gram(df: DataFrame) -> DataFrame:
    """Sum of ``w * z z'`` per segment as one flat array."""
    parts = df.select("segment_key", "z", "w", "p").mapInArrow(_gram_of, "segment_key string, g array<double>")
    return (
        parts.select("segment_key", F.posexplode("g").alias("i", "v"))
        .groupBy("segment_key", "i")
        .agg(F.sum("v").alias("v"))
        .groupBy("segment_key")
        .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
        .select("segment_key", F.transform("c", lambda e: e["v"]).alias("g"))
    )


def _cell_sums(train: DataFrame, features: Features) -> DataFrame:
    """Per cell the sums of all columns as pairs ``z``; the last two are target and constant, which counts rows. Numbers are added up
    beside each other, so only codes make rows of their own."""
    cell, first = ["segment_key", "cell"], F.col("p") - len(features.numeric)
    sums = [F.sum(F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias(f"s{k}") for k, n in enumerate(features.numeric)]
    plain = train.groupBy(*cell, "p").agg(*sums, F.sum("y").alias("y_sum"), F.count(F.lit(1)).cast("double").alias("n"))
    own = [F.struct((first + k).alias("i"), F.col(f"s{k}").alias("v")) for k in range(len(features.numeric))]
    own += [F.struct(F.lit(i).alias("i"), F.col(v).alias("v")) for i, v in ((-2, "y_sum"), (-1, "n"))]
    z = F.array(*own)
    if features.categorical:
        codes = (
            train.select(*cell, F.explode(F.filter("x", lambda e: e["i"] < first)["i"]).alias("i"))
            .groupBy(*cell, "i").agg(F.count(F.lit(1)).cast("double").alias("v"))
            .groupBy(*[F.col(c).alias(f"c_{c}") for c in cell]).agg(F.collect_list(F.struct("i", "v")).alias("codes"))
        )
        plain = plain.join(growing(codes), (F.col("segment_key") == F.col("c_segment_key")) & (F.col("cell") == F.col("c_cell")), "left")
        z = F.concat(F.coalesce("codes", F.expr("CAST(array() AS ARRAY<STRUCT<i: INT, v: DOUBLE>>)")), z)
    return plain.select(*cell, "p", z.alias("z"), (1 / F.col("n")).alias("w"), "y_sum")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = int(round(len(row["total"]) ** 0.5))
            total = np.array(row["total"]).reshape(size, size)
            within = total - np.array(row["between"]).reshape(size, size)
            # Column order: features, target, constant.
            p = size - 2
            scale = np.sqrt(np.clip(np.diag(total)[:p], 1e-300, None))
            xx = within[:p, :p] / np.outer(scale, scale)
            beta = np.linalg.pinv(xx, rcond=1e-10, hermitian=True) @ (within[:p, p] / scale) / scale
            n = total[-1, -1]
            sst = total[p, p] - total[p, -1] ** 2 / n
            sse = within[p, p] - beta @ within[:p, p]
            r2 = 1 - sse / sst if sst > 0 else (1.0 if abs(sse) < 1e-9 else 0.0)
            yield pa.RecordBatch.from_pydict(
                {
                    "segment_key": [row["segment_key"]],
                    "beta": pa.array([beta], pa.list_(pa.float64())),
                    "r2": [float(r2)],
                    "n_samples": pa.array([int(round(n))], pa.int64()),
                }
            )


def _dot(pairs: Column, beta: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["v"] * F.get(beta, e["i"]))


def classify(valued: DataFrame) -> DataFrame:
    """Residuals and class from ``expected_price_czk`` and ``price_czk``."""
    price, expected = truthy(F.col("price_czk")), truthy(F.col("expected_price_czk"))
    pct = pct_change(price, expected)
    return (
        valued.withColumn("residual_absolute", (price - expected).cast("double"))
        .withColumn("residual_percent", pct)
        .withColumn(
            "classification",
            F.when(pct <= UNDER_PCT, "under_market").when(pct >= OVER_PCT, "over_market").when(pct.isNotNull(), "near_market"),
        )
    )


def confidence(train_n: Column, r2: Column) -> Column:
    return (
        F.when((train_n >= HIGH_SAMPLES) & (r2 >= HIGH_R2), "high").when(train_n >= MIN_TRAINING, "medium").otherwise("low")
    )


VALUATION_COLUMNS = [
    "listing_id", "expected_price_czk", "expected_price_per_m2", "residual_absolute", "residual_percent", "classification", "confidence",
]


@dataclass(frozen=True)
class HedonicFit:
    """Intermediate tables of a fit: rows with their features, fits per segment, effects per (segment, cell)."""

    rows: DataFrame
    models: DataFrame
    effects: DataFrame


def fit_segments(listing: DataFrame, detail: DataFrame, features: Features = Features()) -> HedonicFit:
    rows = cut_lineage(segment_rows(listing, detail), "segment-rows")
    index = cut_lineage(feature_index(rows, features), "segment-features")
    vectors = cut_lineage(_vectors(rows, features, index), "segment-vectors")
    fit = vectors.where(F.col("segment_n") >= MIN_TRAINING)
    at = lambda i, v: F.struct(F.lit(i).alias("i"), v.alias("v"))
    # The last two columns of every segment: target, constant.
    train = fit.where("y is not null").withColumn("z", F.concat("x", F.array(at(-2, F.col("y")), at(-1, F.lit(1.0))))).withColumn("w", F.lit(1.0))
    sums = cut_lineage(_cell_sums(train, features), "cell-sums")
    total = _gram(train).withColumnRenamed("g", "total")
    between = _gram(sums).withColumnRenamed("g", "between")
    solved = total.join(between, "segment_key").mapInArrow(_solve, "segment_key string, beta array<double>, r2 double, n_samples bigint")
    solved = cut_lineage(solved, "segment-fits")
    own = F.filter("z", lambda e: e["i"] >= 0)
    effects = cut_lineage(
        sums.join(solved.select("segment_key", "beta"), "segment_key").select(
            "segment_key", "cell", ((F.col("y_sum") - _dot(own, F.col("beta"))) * F.col("w")).alias("effect")
        ),
        "cell-effects",
    )
    # Cells without a training row take the effect of the first cell by name,
    # or the plain mean of all cells when that one has no training row either.
    first_cell = fit.groupBy(F.col("segment_key").alias("b_seg")).agg(F.min("cell").alias("b_cell"))
    fallback = (
        effects.join(first_cell, F.col("segment_key") == F.col("b_seg"))
        .groupBy("segment_key")
        .agg(F.coalesce(F.max(F.when(F.col("cell") == F.col("b_cell"), F.col("effect"))), F.avg("effect")).alias("base_effect"))
    )
    models = cut_lineage(solved.join(fallback, "segment_key").join(index, "segment_key"), "segment-models")
    return HedonicFit(vectors, models, effects)


def estimate(fit: HedonicFit) -> DataFrame:
    """Rows of the fit with ``fitted``, the estimated log price, null in segments without a model."""
    coefs = fit.models.select(F.col("segment_key").alias("m_seg"), "beta", "r2", "n_samples", "base_effect")
    by_cell = fit.effects.select(F.col("segment_key").alias("e_seg"), F.col("cell").alias("e_cell"), "effect")
    return (
        fit.rows.join(coefs, F.col("segment_key") == F.col("m_seg"), "left")
        .join(by_cell, (F.col("segment_key") == F.col("e_seg")) & (F.col("cell") == F.col("e_cell")), "left")
        .withColumn("fitted", F.coalesce("effect", "base_effect") + _dot(F.col("x"), F.col("beta")))
    )


def normal_equations(fit: HedonicFit) -> DataFrame:
    """Per fitted segment and feature the mean product of the feature with the residual, |sum x (y - fitted)| / n: zero in a least-squares fit."""
    rows = estimate(fit).where("y IS NOT NULL AND beta IS NOT NULL")
    each = rows.select("segment_key", (F.col("y") - F.col("fitted")).alias("left"), F.explode("x").alias("e"))
    sums = each.groupBy("segment_key", F.col("e.i").alias("i")).agg(F.sum(F.col("left") * F.col("e.v")).alias("s"))
    names = fit.models.select("segment_key", "n_samples", F.posexplode("feature_list").alias("i", "feature"))
    return names.join(sums, ["segment_key", "i"], "left").select("segment_key", "feature", "n_samples", F.coalesce(F.abs(F.col("s")) / F.col("n_samples"), F.lit(0.0)).alias("product"))


def hedonic_valuation(listing: DataFrame, detail: DataFrame, version: str, features: Features = Features(), trained_at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, valuations) for all segments.

    ``models`` has one row per fitted segment; the cell effects are not part
    of its coefficients. ``valuations`` has one row per active listing with
    an area; segments below 30 rows get no estimate.
    """
    fit = fit_segments(listing, detail, features)
    scored = (
        estimate(fit)
        .withColumn("expected_price_czk", F.exp("fitted"))
        .withColumn("expected_price_per_m2", F.col("expected_price_czk") / F.col("usable_area"))
        .withColumn("confidence", F.when(F.col("beta").isNull(), "unavailable").otherwise(confidence(F.col("n_samples"), F.col("r2"))))
    )
    models = fit.models.select(
        F.lit(version).alias("version"), "segment_key", (ts(trained_at) if trained_at else F.lit(None).cast("timestamp_ntz")).alias("trained_at"), F.lit(TARGET).alias("target"),
        "feature_list", F.map_from_arrays("feature_list", "beta").alias("coefficients"), F.col("base_effect").alias("intercept"), "r2", "n_samples",
    )
    return models, classify(scored).select(*VALUATION_COLUMNS)


def area_only_valuation(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """The one-feature case: log price on log area per segment, built-in regression aggregates."""
    d = detail.where("usable_area > 0").select(F.col("listing_id").alias("detail_key"), F.col("usable_area").cast("double").alias("usable_area"))
    rows = listing.where("is_active").join(d, F.col("id") == F.col("detail_key")).select(
        F.col("id").alias("listing_id"),
        segment_key(F.col("category_main_cb"), F.col("category_type_cb")).alias("segment_key"),
        "price_czk",
        "usable_area",
        F.ln("usable_area").alias("lx"),
        F.when(F.col("price_czk") > 0, F.ln(F.col("price_czk").cast("double"))).alias("ly"),
    )
    fit = rows.groupBy(F.col("segment_key").alias("m_seg")).agg(
        F.regr_slope("ly", "lx").alias("slope"),
        F.regr_intercept("ly", "lx").alias("intercept"),
        F.regr_r2("ly", "lx").alias("r2"),
        F.count("ly").alias("n_samples"),
        F.count(F.lit(1)).alias("segment_n"),
    )
    enough = F.col("segment_n") >= MIN_TRAINING
    scored = (
        rows.join(fit, F.col("segment_key") == F.col("m_seg"))
        .withColumn("expected_price_czk", F.when(enough, F.exp(F.col("intercept") + F.col("slope") * F.col("lx"))))
        .withColumn("expected_price_per_m2", F.col("expected_price_czk") / F.col("usable_area"))
        .withColumn("confidence", F.when(~enough, "unavailable").otherwise(confidence(F.col("n_samples"), F.col("r2"))))
    )
    return classify(scored).select(*VALUATION_COLUMNS)


def upsert_latest(current: DataFrame, fresh: DataFrame, key: str = "listing_id") -> DataFrame:
    """Latest row per key: fresh rows replace stored ones, other stored rows stay."""
    kept = current.join(growing(fresh.select(key)), key, "left_anti")
    return kept.unionByName(fresh.select(*current.columns))
