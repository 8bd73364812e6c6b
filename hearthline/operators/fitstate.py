"""The hedonic fit from stored sums that can be updated.

All the fit needs of the rows are sums: products of their features per segment, sums of their features per grid cell, and counts of
cells, codes and floors. They are kept by name, so codes that appear later need no new numbering.
Listings that changed are taken out with their old values and put in with the
new ones; nothing else is read. What depends on all rows (the median floor, which cells are
too small, the first code of each column) is decided when the sums are solved: a missing floor is a
column of its own, and the median is its weight.

Sums of rows are made by the JVM; products of the cells' sums are added up in numpy, and a task solves one matrix of a segment's features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.operators.valuation import AMENITIES, CATEGORICAL, MIN_CELL, MIN_TRAINING, NUMERIC, OTHER_CELL, _gram, model_inputs
from hearthline.session import cut_lineage, growing

#: ``kind``: product (a, b: two columns; with the constant for each cell, else for the segment, cell ''), rows (of a cell), code (a: column, b: code), floor (a: the number).
FIT_STATE = "segment_key string, cell string, kind string, a string, b string, v double"
KEYS = ["segment_key", "cell", "kind", "a", "b"]
ONE, TARGET, MISSING = "1", "y", "floor_missing"
NUMBERS = [*NUMERIC, *AMENITIES]


def _numbers() -> dict[str, Column]:
    """The numeric columns of a training row by name, 0 where it has none."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return {**{c: zero(F.col(c)) for c in NUMBERS}, MISSING: F.col("floor_number").isNull().cast("double"), TARGET: zero(F.col("y"))}


def _unpivoted(sums: DataFrame, keys: list[str], values: list[tuple[Column, Column, Column]]) -> DataFrame:
    """Rows (keys, a, b, v) of aggregates that stand beside each other; ``values`` are aggregates with the names of their two columns in order."""
    wide = sums.groupBy(*keys).agg(*[v.alias(f"v{k}") for k, (_, _, v) in enumerate(values)])
    entries = F.array(*[F.struct(a.alias("a"), b.alias("b"), F.col(f"v{k}").alias("v")) for k, (a, b, _) in enumerate(values)])
    return wide.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")


def _products(train: DataFrame) -> DataFrame:
    """Products of all pairs of columns (a <= b by name) per segment; those with the constant, the sums of a column, per cell.

    Numbers are multiplied row by row without a row for each pair; codes are counted.
    """
    numbers, lit = _numbers(), F.lit
    train = train.select("segment_key", F.col("cell_raw").alias("cell"), F.array(*[F.concat_ws("_", lit(c), F.col(c)) for c in CATEGORICAL]).alias("codes"), *[c.alias(n) for n, c in numbers.items()])
    names = sorted(numbers)
    each = train.withColumn("code", F.explode("codes"))
    two = [F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for k in range(len(CATEGORICAL)) for m in range(k, len(CATEGORICAL)) for a, b in [(F.get("codes", lit(k)), F.get("codes", lit(m)))]]
    by_segment = [
        _unpivoted(train, ["segment_key"], [(lit(a), lit(b), F.sum(F.col(a) * F.col(b))) for k, a in enumerate(names) for b in names[k:]]),
        _unpivoted(each, ["segment_key", "code"], [(F.least("code", lit(n)), F.greatest("code", lit(n)), F.sum(n)) for n in names]).drop("code"),
        train.select("segment_key", F.explode(F.array(*two)).alias("e")).groupBy("segment_key", "e.a", "e.b").agg(F.count(lit(1)).cast("double").alias("v")),
    ]
    by_cell = [
        _unpivoted(train, ["segment_key", "cell"], [(lit(ONE), lit(n), F.sum(n)) for n in names] + [(lit(ONE), lit(ONE), F.count(lit(1)).cast("double"))]),
        each.groupBy("segment_key", "cell", lit(ONE).alias("a"), F.col("code").alias("b")).agg(F.count(lit(1)).cast("double").alias("v")),
    ]
    order = ["segment_key", "cell", lit("product").alias("kind"), "a", "b", "v"]
    return reduce(DataFrame.unionByName, [df.withColumn("cell", lit("")).select(*order) for df in by_segment] + [df.select(*order) for df in by_cell]).where("v <> 0")


def fit_state(listing: DataFrame, detail: DataFrame) -> DataFrame:
    """Sums like ``FIT_STATE`` over the active listings with an area. The rows are written once, because each kind of sum reads them."""
    rows = cut_lineage(model_inputs(listing, detail), "fit-rows")
    row = lambda kind, a, b, cell=F.lit(""): rows.select("segment_key", cell.alias("cell"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), F.lit(1.0).alias("v"))
    none = F.lit("")
    counts = [row("rows", none, none, F.col("cell_raw")), row("floor", F.col("floor_number").cast("string"), none).where("a IS NOT NULL")]
    counts += [row("code", F.lit(c), F.col(c)) for c in CATEGORICAL]
    return merged(reduce(DataFrame.unionByName, [*counts, _products(rows.where("y IS NOT NULL"))]))


def merged(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*KEYS).agg(F.sum("v").alias("v"))


def update_state(state: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """``state`` without the sums of the rows in ``removed`` (``fit_state`` of the old values) and with those in ``added``."""
    out = merged(state.unionByName(removed.withColumn("v", -F.col("v"))).unionByName(added))
    # counts are whole numbers; a sum or product of rows that are all gone is what rounding leaves of 0
    out = cut_lineage(out.where("v <> 0"), "fit-state-updated")
    product, by_cell = F.col("kind") == "product", F.col("cell") != ""
    cells = out.where("kind = 'product' AND a = '1' AND b = '1' AND v > 0.5").select("segment_key", "cell")
    sums = out.where(product & by_cell).join(cells, ["segment_key", "cell"], "left_semi").select(*KEYS, "v")
    # columns that a row of the segment still has; numbers whose sums may be 0 stay as long as the segment has rows
    left = sums.select("segment_key", F.col("b").alias("name")).distinct()
    left = left.unionByName(cells.select("segment_key", F.explode(F.array(*map(F.lit, [*NUMERIC, TARGET]))).alias("name"))).distinct()
    products = out.where(product & ~by_cell)
    for side in ("a", "b"):
        products = products.join(left.withColumnRenamed("name", side), ["segment_key", side], "left_semi")
    return out.where(~product).unionByName(sums).unionByName(products.select(*KEYS, "v"))


def _solve_named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            names = row["feature_list"]
            place = {n: k for k, n in enumerate([*names, TARGET, ONE])}
            size, p = len(place), len(names)
            total, between = np.zeros((size, size)), np.array(row["between"]).reshape(size, size)

            def put(out: np.ndarray, a: str, b: str, v: float) -> None:
                # a missing floor stands for the median one
                for x, wx in ((a, 1.0), ("floor_number", row["floor_mid"])) if a == MISSING else ((a, 1.0),):
                    for y, wy in ((b, 1.0), ("floor_number", row["floor_mid"])) if b == MISSING else ((b, 1.0),):
                        if x in place and y in place:
                            out[place[x], place[y]] += v * wx * wy
                            if a != b:
                                out[place[y], place[x]] += v * wx * wy

            for e in row["sums"]:
                put(total, e["a"], e["b"], e["total"])
            within = total - between
            scale = np.sqrt(np.clip(np.diag(total)[:p], 1e-300, None))
            beta = np.linalg.pinv(within[:p, :p] / np.outer(scale, scale), rcond=1e-10, hermitian=True) @ (within[:p, p] / scale) / scale
            n = total[-1, -1]
            sst, sse = total[p, p] - total[p, -1] ** 2 / n, within[p, p] - beta @ within[:p, p]
            r2 = 1 - sse / sst if sst > 0 else (1.0 if abs(sse) < 1e-9 else 0.0)
            yield pa.RecordBatch.from_pydict(
                {"segment_key": [row["segment_key"]], "feature_list": [names], "beta": pa.array([beta], pa.list_(pa.float64())), "r2": [float(r2)], "n_samples": pa.array([round(n)], pa.int64())}
            )


def solve_state(state: DataFrame) -> DataFrame:
    """``segment_key, feature_list, beta, r2, n_samples`` of the segments with rows enough, as ``hedonic_valuation`` fits them."""
    state = cut_lineage(state, "fit-state")
    cells = state.where("kind = 'rows'")
    enough = cells.groupBy("segment_key").agg(F.sum("v").alias("n")).where(F.col("n") >= MIN_TRAINING).select("segment_key")
    # features: every column's codes but the first, then the numbers
    codes = state.where("kind = 'code'").withColumn("place", F.array_position(F.array(*map(F.lit, CATEGORICAL)), F.col("a")))
    later = codes.withColumn("first", F.min("b").over(Window.partitionBy("segment_key", "a"))).where("b > first")
    names = later.groupBy("segment_key").agg(F.array_sort(F.collect_list(F.struct("place", "b", F.concat_ws("_", "a", "b").alias("feature")))).alias("own"))
    # median floor: the middle of the counted values
    floors = state.where("kind = 'floor'").select("segment_key", F.col("a").cast("double").alias("f"), F.col("v").cast("bigint").alias("k"))
    by_floor = Window.partitionBy("segment_key").orderBy("f")
    floors = floors.withColumn("upto", F.sum("k").over(by_floor)).withColumn("all", F.sum("k").over(Window.partitionBy("segment_key")))
    middle = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("f")))
    middles = floors.groupBy("segment_key").agg(((middle(F.floor((F.col("all") + 1) / 2)) + middle(F.floor((F.col("all") + 2) / 2))) / 2).alias("floor_mid"))
    listed = F.concat(F.coalesce(F.transform("own", lambda e: e["feature"]), F.array().cast("array<string>")), F.array(*map(F.lit, NUMBERS)))
    index = enough.join(names, "segment_key", "left").join(middles, "segment_key", "left").select("segment_key", listed.alias("feature_list"), F.coalesce("floor_mid", F.lit(0.0)).alias("floor_mid"))
    # Written, so that the planner knows how few rows these are.
    index = cut_lineage(index, "fit-features")
    products = state.where("kind = 'product'").join(enough, "segment_key", "left_semi")
    totals = products.groupBy("segment_key", "a", "b").agg(F.sum("v").alias("total")).groupBy("segment_key").agg(F.collect_list(F.struct("a", "b", "total")).alias("sums"))  # features x features
    # cells of few rows are one; its sums are the sums of theirs
    sizes = cells.select(F.col("segment_key").alias("c_seg"), F.col("cell").alias("c_cell"), F.col("v").alias("c_n"))
    sums = products.where("cell <> ''").join(growing(sizes), (F.col("segment_key") == F.col("c_seg")) & (F.col("cell") == F.col("c_cell")))
    sums = sums.select("segment_key", F.when(F.col("c_n") < MIN_CELL, F.lit(OTHER_CELL)).otherwise(F.col("cell")).alias("cell"), F.col("b").alias("name"), "v")
    # a missing floor stands for the median one
    at = lambda name, i, factor=F.lit(1.0): F.struct(name.alias("name"), i.cast("int").alias("i"), factor.alias("factor"))
    floor = F.array_position("feature_list", F.lit("floor_number")) - 1
    places = F.concat(F.transform("feature_list", lambda n, k: at(n, k)), F.array(at(F.lit(MISSING), floor, F.col("floor_mid")), at(F.lit(TARGET), F.lit(-2)), at(F.lit(ONE), F.lit(-1))))
    columns = index.select(F.col("segment_key").alias("p_seg"), F.size("feature_list").alias("p"), F.explode(places).alias("e")).select("p_seg", "p", "e.*")
    placed = sums.join(F.broadcast(columns.withColumnRenamed("name", "p_name")), (F.col("segment_key") == F.col("p_seg")) & (F.col("name") == F.col("p_name")))  # a segment's features only
    whole = placed.groupBy("segment_key", "cell", "p", "i").agg(F.sum(F.col("v") * F.col("factor")).alias("v")).groupBy("segment_key", "cell", "p").agg(
        F.collect_list(F.struct("i", "v")).alias("z"), (1 / F.max(F.when(F.col("i") == -1, F.col("v")))).alias("w"))
    between = _gram(whole).withColumnRenamed("g", "between")
    ready = totals.join(between, "segment_key").join(index, "segment_key").select("segment_key", "feature_list", "floor_mid", "sums", "between")
    return ready.mapInArrow(_solve_named, "segment_key string, feature_list array<string>, beta array<double>, r2 double, n_samples bigint")
