"""Export files: CSV, JSON lines, Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

BOM = "\ufeff"
FORMATS = ("csv", "json", "parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is not a value in the exports."""

    def clean(field) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            return F.when(~F.isnan(c), c).alias(field.name)
        return c

    return df.select(*[clean(f) for f in df.schema.fields])


def write_export(df: DataFrame, path: str, fmt: str, bom: bool = True) -> None:
    """Write ``df`` in one of the export formats, one file per partition.

    CSV files start with a byte-order mark when ``bom`` is set. The mark is
    part of the first column name, so it is in every part file's header.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported export format {fmt!r}; allowed: {', '.join(FORMATS)}")
    rows = without_nan(df)
    writer = rows.write.mode("overwrite")
    if fmt == "json":
        writer.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        if bom:
            first = rows.columns[0]
            writer = rows.withColumnRenamed(first, BOM + first).write.mode("overwrite")
        writer.option("header", "true").option("encoding", "UTF-8").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
