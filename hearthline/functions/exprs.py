"""Scalar column expressions shared by all operators."""

from __future__ import annotations

import unicodedata
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F

DAY_US = 86_400_000_000


def ts(value: datetime) -> Column:
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def truthy(x: Column) -> Column:
    """A number with 0 read as missing."""
    return F.nullif(x, F.lit(0))


def div(a: Column, b: Column) -> Column:
    """Fractional division, NULL for a zero or missing divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_change(new: Column, old: Column) -> Column:
    return div(new - old, old) * 100


def days_between(start: Column, end: Column) -> Column:
    """Fractional days between two zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(float(DAY_US))


def whole_days_on_market(first_seen: Column, removed: Column, as_of: Column) -> Column:
    days = F.floor(days_between(first_seen, F.coalesce(removed, as_of)))
    return F.when(first_seen.isNotNull(), F.greatest(F.lit(0), days)).cast("int")


def price_per_m2(price: Column, area: Column) -> Column:
    """Price per square metre over non-zero prices and areas."""
    return div(truthy(price), truthy(area))


def leading_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def floor_fraction(text: Column) -> tuple[Column, Column]:
    """'3/5' gives (3, 5), '2' gives (2, NULL), anything else (NULL, NULL)."""
    pattern = r"^\s*(-?\d+)\s*(?:/\s*(-?\d+))?"
    part = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("int") for i in (1, 2)]
    return part[0], part[1]


def safe_bool(text: Column) -> Column:
    """Digits mean non-zero, the JSON literals their value, other text is true unless empty."""
    return (
        F.when(text.rlike(r"^\d+$"), text.try_cast("decimal(38,0)") != 0)
        .when(text.isin("false", ""), F.lit(False))
        .when(text.isNotNull(), F.lit(True))
    )


def czech_date(text: Column) -> Column:
    """A dd.MM.yyyy date as midnight, NULL for anything else."""
    day = F.trim(text)
    ok = day.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$")
    return F.when(ok, F.try_to_timestamp(day, F.lit("d.M.yyyy"))).cast("timestamp_ntz")


def iso_date(text: Column) -> Column:
    day = F.trim(text)
    ok = day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(ok, F.try_to_timestamp(day, F.lit("yyyy-M-d"))).cast("timestamp_ntz")


def first_text(*candidates: Column) -> Column:
    """First candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def first_trimmed(*candidates: Column) -> Column:
    return first_text(*[F.trim(c) for c in candidates])


def locality_text(district: Column, city: Column, part: Column, street: Column) -> Column:
    """'primary - secondary' from the parts that are present."""
    primary = first_text(district, city, part, street)
    second = F.when(part.isNull() | (primary != part), part).otherwise(street)
    return F.nullif(F.concat_ws(" - ", primary, F.when(second != primary, first_text(second))), F.lit(""))


def seller_type(broker_company: Column) -> Column:
    # Agency and private seller.
    return F.when(first_text(broker_company).isNotNull(), F.lit("realitni_kancelar")).otherwise(
        F.lit("soukroma_osoba")
    )


def month_parts(day: Column) -> dict[str, Column]:
    return {
        "rok_mesic": F.date_format(day, "yyyy-MM"),
        "datum": F.date_format(day, "yyyy-MM-01"),
        "rok": F.year(day),
        "mesic": F.month(day),
    }


def segment_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[F.coalesce(p, F.lit(-1)).cast("string") for p in parts])


def flags_text(flags: Column) -> Column:
    return F.nullif(F.array_join(flags, ", "), F.lit(""))


def residual_pct(price: Column, expected: Column) -> Column:
    return pct_change(price, expected)


def metadata(source: str, method: str) -> dict[str, Column]:
    return {"metoda_sberu": F.lit(method), "zdroj": F.lit(source)}


def _accent_pairs() -> tuple[str, str]:
    src, dst = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(ch for ch in base if not unicodedata.combining(ch))
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENTED, PLAIN = _accent_pairs()


def strip_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def ilike_any(columns: list[Column], text: str, raw_pattern: bool = False) -> Column:
    """True when any column contains ``text``, ignoring case.

    ``raw_pattern`` leaves ``%`` and ``_`` in the text as wildcards.
    """
    needle = text.strip()
    if not raw_pattern:
        for ch in ("\\", "%", "_"):
            needle = needle.replace(ch, "\\" + ch)
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{needle}%"), F.lit(False)) for c in columns])
