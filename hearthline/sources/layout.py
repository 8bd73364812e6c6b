"""Clustered layout: rows that are near in several columns stand in the same files.

Every column is cut into ranges of about equal numbers of rows, the numbers of the
ranges are interleaved bit by bit (Z-order), and the rows are sorted by the result. Parquet keeps the
least and largest value of each column per row group, so a filter on some of the columns, a map window and a price
range say, skips most row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BITS = 6  # ranges per column: 2 ** BITS
ACCURACY = 10_000


def range_bounds(df: DataFrame, columns: list[str], bits: int = BITS) -> dict[str, list]:
    """Upper bounds of all ranges but the last, from approximate quantiles: at most 2 ** bits values for each column."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY).alias(c) for c in columns]).first()
    return {c: found[c] or [] for c in columns}


def z_value(bounds: dict[str, list], bits: int = BITS) -> Column:
    """Interleaved range numbers; a null value is in the first range."""
    out = F.lit(0).cast("bigint")
    for k, (name, upper) in enumerate(bounds.items()):
        limits = F.array(*[F.lit(float(u)) for u in upper]).cast("array<double>")
        # the bounds are sorted, so the number of those below the value is its range
        place = F.size(F.filter(limits, lambda u: u < F.col(name).cast("double"))).cast("bigint")  # noqa: B023
        for bit in range(bits):
            out = out + F.shiftleft(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("bigint")), bit * len(bounds) + k)
    return out


def clustered(df: DataFrame, columns: list[str], parts: int, bits: int = BITS) -> DataFrame:
    """``df`` in Z-order of ``columns``, dealt into ``parts`` partitions; a hot place is spread by the hash of its row."""
    if not columns or bits * len(columns) > 62:
        raise ValueError("between one column and 62 bits in all")
    rows = df.withColumn("_z", z_value(range_bounds(df, columns, bits), bits)).withColumn("_tie", F.xxhash64(*columns, F.monotonically_increasing_id()))
    return rows.repartitionByRange(parts, "_z", "_tie").sortWithinPartitions("_z", "_tie").drop("_z", "_tie")
