"""Exact order statistics per group without sorting a group in one task.

Values are counted per ``(group, value)``, so partial aggregation runs before
the shuffle and a big group is spread over many tasks. A histogram over
order-preserving bins then tells in which bin each wanted rank lies, and only
those bins are ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS_PER_E = 1024
_OFFSET = 1_000_000


def value_bin(x: Column) -> Column:
    """Monotone bin number: logarithmic on both sides of zero."""
    size = F.floor(F.ln(F.abs(x)) * F.lit(float(BINS_PER_E))) + F.lit(_OFFSET)
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("bigint")


def _median_ranks(n: Column) -> list[Column]:
    return [F.floor((n + 1) / 2), F.floor((n + 2) / 2)]


def _p90_ranks(n: Column) -> list[Column]:
    low = F.greatest(F.lit(1), F.least(n - 1, F.floor(9 * (n + 1) / 10)))
    return [low, F.least(n, low + 1)]


def _median_value(n: Column, a: Column, b: Column) -> Column:
    return (a + b) / 2


def _p90_value(n: Column, a: Column, b: Column) -> Column:
    """Exclusive method: interpolates, and may extrapolate, between two neighbours."""
    delta = 9 * (n + 1) - 10 * _p90_ranks(n)[0]
    return (a * (10 - delta) + b * delta) / 10


KINDS = {"median": (_median_ranks, _median_value), "p90_exclusive": (_p90_ranks, _p90_value)}


def same_keys(keys: list[str], prefix: str) -> Column:
    """Null-safe equality of ``k`` and ``prefix + k`` for every key."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def exact_quantile(df: DataFrame, keys: list[str], value: str, kind: str = "median", name: str = "q") -> DataFrame:
    """One row per group: the keys, ``n`` (non-null values) and the quantile."""
    ranks, combine = KINDS[kind]
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", value_bin(F.col("_v")))
    )
    by_group = Window.partitionBy(*keys)
    running = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(running))
        .withColumn("n", F.sum("_bc").over(by_group))
        .withColumn("_rank", F.array(*[r.cast("bigint") for r in ranks(F.col("n"))]))
        .select(*keys, "_b", "n", (F.col("_upto") - F.col("_bc")).alias("_before"), "_upto", F.posexplode("_rank").alias("_i", "_r"))
        .where((F.col("_before") < F.col("_r")) & (F.col("_r") <= F.col("_upto")))
        .select(
            *[F.col(k).alias(f"_h_{k}") for k in [*keys, "_b"]],
            "n",
            "_i",
            (F.col("_r") - F.col("_before")).alias("_off"),
        )
    )
    inside = Window.partitionBy(*keys, "_b", "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        counted.join(hits, same_keys([*keys, "_b"], "_h_"))
        .withColumn("_cum", F.sum("_c").over(inside))
        .where((F.col("_cum") - F.col("_c") < F.col("_off")) & (F.col("_off") <= F.col("_cum")))
    )
    pick = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v")))
    return (
        found.groupBy(*keys)
        .agg(F.max("n").alias("n"), pick(0).alias("_a"), pick(1).alias("_z"))
        .select(*keys, "n", combine(F.col("n"), F.col("_a"), F.col("_z")).alias(name))
    )
