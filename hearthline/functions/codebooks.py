"""Code tables and label lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Labels of the published codebooks.
DEAL_TYPES = {1: "prodej", 2: "pronájem", 3: "dražba", 4: "prodej podílu"}
PROPERTY_TYPES = {
    1: "byt",
    2: "dům",
    3: "pozemek",
    4: "komerční nemovitost a nebytový prostor",
    5: "ostatní",
}
ROOM_LAYOUTS = {
    1: "N/A", 2: "1+kk", 3: "1+1", 4: "2+kk", 5: "2+1", 6: "3+kk", 7: "3+1", 8: "4+kk", 9: "4+1",
    10: "5+kk", 11: "5+1", 12: "6 pokojů a více", 16: "atypické", 19: "stavební parcela",
    23: "zahrada", 33: "chata", 37: "rodinný", 39: "vila", 47: "pronájem pokoje",
}
BUILDING_TYPE = {
    1: "Dřevostavba", 2: "Cihlová", 3: "Kamenná", 4: "Montovaná", 5: "Panelová", 6: "Skeletová",
    7: "Smíšená", 8: "Modulární",
}
BUILDING_CONDITION = {
    1: "Velmi dobrý", 2: "Dobrý", 3: "Špatný", 4: "Ve výstavbě", 5: "Projekt", 6: "Novostavba",
    7: "K demolici", 8: "Před rekonstrukcí", 9: "Po rekonstrukci", 10: "V rekonstrukci",
}
OWNERSHIP = {1: "Osobní", 2: "Družstevní", 3: "Státní/obecní"}
ENERGY_RATING = {
    1: "A - Mimořádně úsporná", 2: "B - Velmi úsporná", 3: "C - Úsporná", 4: "D - Méně úsporná",
    5: "E - Nehospodárná", 6: "F - Velmi nehospodárná", 7: "G - Mimořádně nehospodárná",
}
OBJECT_KIND = {1: "Řadový", 2: "Rohový", 3: "V bloku", 4: "Samostatný"}
FURNISHED = {1: "Ano", 2: "Ne", 3: "Částečně"}
ELEVATOR = {1: "Ano", 2: "Ne"}

# Region ids and names, in id order.
REGION_NAMES = {
    1: "Jihočeský kraj", 2: "Plzeňský kraj", 3: "Karlovarský kraj", 4: "Ústecký kraj",
    5: "Liberecký kraj", 6: "Královéhradecký kraj", 7: "Pardubický kraj", 8: "Olomoucký kraj",
    9: "Zlínský kraj", 10: "Hlavní město Praha", 11: "Středočeský kraj", 12: "Moravskoslezský kraj",
    13: "Kraj Vysočina", 14: "Jihomoravský kraj",
}

# Sub-categories that subdivide an oversized slice.
SUBCATEGORIES_BY_MAIN = {
    1: [2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 16, 47],
    2: [33, 37, 39],
    3: [19, 23],
}

# Bucket labels for missing dimension values.
UNKNOWN_LABEL = "Neznámý"
UNKNOWN_SEGMENT = "unknown"
UNKNOWN_SUB = -1


def code_map(codebook: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(codebook.items())])


def lookup(codebook: dict, code: Column) -> Column:
    """Label of an integer code, NULL when the code is not in the book."""
    return code_map(codebook)[code.cast("int")]


def code_label(codebook: dict, raw: Column) -> Column:
    """Label of a code kept as text: unknown codes stay visible, '' and NULL give NULL."""
    known = code_map(codebook)[raw.try_cast("int")]
    return F.when(raw != "", F.coalesce(known, raw))
