"""Region names: canonical table, text matching, id lookup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hearthline.functions.codebooks import REGION_NAMES, lookup
from hearthline.functions.exprs import strip_accents

# Full and short region names without accents, in the order in which free text is searched for them.
PLAIN_NAMES = [
    (1, "jihocesky kraj"), (1, "jihocesky"), (2, "plzensky kraj"), (2, "plzensky"), (3, "karlovarsky kraj"), (3, "karlovarsky"),
    (4, "ustecky kraj"), (4, "ustecky"), (5, "liberecky kraj"), (5, "liberecky"), (6, "kralovehradecky kraj"), (6, "kralovehradecky"),
    (7, "pardubicky kraj"), (7, "pardubicky"), (8, "olomoucky kraj"), (8, "olomoucky"), (9, "zlinsky kraj"), (9, "zlinsky"),
    (10, "hlavni mesto praha"), (10, "praha"), (11, "stredocesky kraj"), (11, "stredocesky"), (12, "moravskoslezsky kraj"),
    (12, "moravskoslezsky"), (13, "kraj vysocina"), (14, "jihomoravsky kraj"), (14, "jihomoravsky"),
]


def region_id_from_name(name: Column) -> Column:
    """Region id of free text: an exact name first, else the first fragment it contains."""
    key = strip_accents(F.lower(F.trim(name)))
    exact = F.create_map(*[F.lit(x) for i, n in PLAIN_NAMES for x in (n, i)])[key]
    contained = F.coalesce(*[F.when(F.contains(key, F.lit(f)), F.lit(i)) for i, f in PLAIN_NAMES])
    return F.when(key != "", F.coalesce(exact, contained))


def region_id_from_code(code: Column) -> Column:
    return F.when(code.between(1, len(REGION_NAMES)), code).cast("int")


def region_name(region_id: Column) -> Column:
    return lookup(REGION_NAMES, region_id)
