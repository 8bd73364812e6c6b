import math
import random
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthline.functions import codebooks as cb, exprs as ex, geo, regions, urls
from hearthline.functions.quantiles import exact_quantile


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("r")).head()[0]


def many(spark, make, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t"))).collect()]


def test_leading_int(spark):
    assert many(spark, ex.leading_int, ["65 m²", "65,5 m²", "65 m2", " 7", "cca 5", "", None]) == [65, 65, 65, 7, None, None, None]


def test_floor_fraction(spark):
    pairs = lambda t: F.array(*ex.floor_fraction(t))
    assert many(spark, pairs, ["3/5", "2", "-1/4", "junk", None]) == [[3, 5], [2, None], [-1, 4], [None, None], [None, None]]


def test_bool_and_dates(spark):
    assert many(spark, ex.safe_bool, ["1", "0", "true", "false", "ano", "", None]) == [True, False, True, False, True, False, None]
    assert many(spark, ex.czech_date, ["31.12.2025", "2025-12-31", "31.2.2025", None]) == [datetime(2025, 12, 31), None, None, None]


def test_code_labels(spark):
    label = lambda t: cb.code_label(cb.OWNERSHIP, t)
    assert many(spark, label, ["1", "99", "abc", "", None]) == ["Osobní", "99", "abc", None, None]


def test_region_names(spark):
    ids = many(spark, regions.region_id_from_name, ["Hlavní město Praha", "praha 5", "JIHOMORAVSKY KRAJ", "okres Zlínský", "Dubaj", " ", None])
    assert ids == [10, 10, 14, 9, None, None, None]
    assert one(spark, regions.region_id_from_code(F.col("a")), a=15) is None


def test_urls(spark):
    df = spark.createDataFrame(
        [("7", 1, 1, 4, "Byt", None), ("8", 2, 2, 37, "x", "https://p.example/api/v1/estates/8"), ("9", 1, 1, 99, "Prodej bytu 3+KK 60 m²", None), ("10", 9, 9, None, "x", "https://a.example/z")],
        "h string, m int, d int, s int, t string, u string")
    got = [r[0] for r in df.select(urls.resolved_url(*[F.col(c) for c in "uhmdst"], host="https://h.example")).collect()]
    assert got == ["https://h.example/detail/prodej/byt/2+kk/detail/7", "https://h.example/detail/pronajem/dum/rodinny/detail/8",
                   "https://h.example/detail/prodej/byt/3+kk/detail/9", "https://a.example/z"]
    assert many(spark, urls.slugify, ["3+kk", "Činžovní dům", "a/b"]) == ["3+kk", "cinzovni-dum", "a%2Fb"]


def test_distance(spark):
    km = one(spark, geo.haversine_km(F.lit(50.0755), F.lit(14.4378), F.lit(49.1951), F.lit(16.6068)), a=1)
    assert 180 < km < 190
    assert one(spark, geo.haversine_km(F.lit(50.0), F.lit(14.0), F.lit(50.0), F.lit(14.0)), a=1) == 0


@pytest.mark.parametrize("n", [2, 3, 10, 23, 200])
def test_exact_quantiles_match_the_statistics_module(spark, n):
    rnd = random.Random(n)
    values = [rnd.choice([0.0, -5.5, 3.25, rnd.lognormvariate(3, 2), float(rnd.randint(-100, 100))]) for _ in range(n)]
    df = spark.createDataFrame([("a" if i % 2 else None, v) for i, v in enumerate(values * 2)], "k string, v double")
    for kind, want in (("median", statistics.median), ("p90_exclusive", lambda x: statistics.quantiles(x, n=10)[8])):
        got = {r["k"]: r["q"] for r in exact_quantile(df, ["k"], "v", kind).collect()}
        for key in ("a", None):
            mine = [v for i, v in enumerate(values * 2) if ("a" if i % 2 else None) == key]
            assert math.isclose(got[key], want(mine), rel_tol=1e-12, abs_tol=1e-12)


def test_quantile_of_one_hot_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") % 1000).cast("double").alias("v"))
    row = exact_quantile(df, ["k"], "v").head()
    assert (row["n"], row["q"]) == (200_000, 499.5)


def test_locality_text(spark):
    rows = [("Praha 5", "Praha", "Smíchov", "Nádražní"), (None, "Brno", None, "Veveří"), (None, None, "Bory", "Bory"), (None, None, "Bory", "U lesa"), (None, None, None, "Dlouhá"), (None, None, None, None), ("", "Brno", "Střed", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, c string, p string, s string")
    got = [r[0] for r in df.orderBy("i").select(ex.locality_text(*[F.col(c) for c in "dcps"])).collect()]
    assert got == ["Praha 5 - Smíchov", "Brno", "Bory", "Bory - U lesa", "Dlouhá", None, "Brno - Střed"]
