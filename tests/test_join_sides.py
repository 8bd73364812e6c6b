"""Joins whose sides grow with the input go through a shuffle, however small the planner takes them for."""

import re

import pytest

import __spark_entry__ as entry
from conftest import SF
from hearthline.llm import spelling_variants
from hearthline.operators import comparables
from hearthline.session import cut_lineage


def broadcast_keys(df) -> set[str]:
    """Names of the columns by which the plan broadcasts a side of a join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    sides = re.findall(r"BroadcastHashJoin \[(.*?)\], \[(.*?)\], \w+, Build(Left|Right)", plan)
    return {k for left, right, side in sides for k in re.findall(r"([a-z_]+)#", right if side == "Right" else left)}


@pytest.mark.parametrize("name", ["apply_details", "apply_details_repeated", "region_hints", "backfill_location_names", "backfill_location_counts"])
def test_parsed_payloads_are_not_broadcast(spark, name):
    assert not broadcast_keys(entry.queries()[name](spark, SF)) & {"p_id", "d_id", "l_hash", "have_id", "listing_id", "i_id", "location_id"}


def test_candidates_of_comparables_are_not_broadcast(spark, tables, monkeypatch):
    found = set()

    def written(df, name):
        found.update(broadcast_keys(df))
        return cut_lineage(df, name)

    monkeypatch.setattr(comparables, "cut_lineage", written)
    found.update(broadcast_keys(comparables.comparables(tables.listing, tables.listing_detail)))
    assert not found & {"level", "gid", "pid", "b_pid", "n_pid", "main", "deal", "cy", "cx", "e_level", "k_main", "n_main"}


def test_words_and_their_neighbourhoods_are_not_broadcast(spark, monkeypatch):
    found, stored = [], spelling_variants.stored

    def written(df, name):
        found.append(broadcast_keys(df))
        return stored(df, name)

    monkeypatch.setattr(spelling_variants, "stored", written)
    docs = spark.createDataFrame([(k, f"alternate alternatf everything everythink word{k}") for k in range(40)], "doc_id long, text string")
    out = spelling_variants.group_variants(docs)
    found.append(broadcast_keys(out))
    assert out.count() and len(found) > spelling_variants.SLICES + 3 and not set().union(*found)
