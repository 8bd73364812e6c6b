"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from hearthline.sources.adapter import DerivedListings

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables)``; doubles are rounded to ``digits`` so that both engines agree."""

    def wrap(fn: Callable[[DerivedListings], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(DerivedListings(spark, sf_dir)), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def rounded(df: DataFrame, digits: int) -> DataFrame:
    def shown(field):
        c = F.col(f"`{field.name}`")
        return F.round(c, digits).alias(field.name) if isinstance(field.dataType, DoubleType) else c

    return df.select(*[shown(f) for f in df.schema.fields])
