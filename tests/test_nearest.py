"""The search for comparables inside a block."""

import numpy as np
import pytest

from hearthline.operators import comparables as comp, nearest
from test_spatial_operators import brute_comparables, frames, scene


def sides(rnd, n, lat, lon, spread):
    column = lambda *values: rnd.choice(np.array(values, float), n)
    return lat + rnd.uniform(-spread, spread, n).round(2), lon + rnd.uniform(-spread, spread, n).round(2), column(2, 3, 4, 6), column(np.nan, 20, 30, 31, 47, 48)


@pytest.mark.parametrize("lat,lon,spread", [(50, 14, 0.02), (50, 14, 0.6), (-0.01, 0.01, 0.1), (79.5, -120, 0.4)])
def test_search_matches_all_pairs(lat, lon, spread):
    rnd = np.random.default_rng(1)
    subjects, candidates, rank = sides(rnd, 120, lat, lon, spread), sides(rnd, 400, lat, lon, spread), rnd.permutation(400)
    s, c, km = nearest.search(subjects, candidates, rank, 9, 0.25, (-1, 0, 1))
    got = {}
    for row in zip(s.tolist(), km.tolist(), rank[c].tolist()):
        got.setdefault(row[0], []).append(row[1:])
    want = {}
    for k in range(120):
        la, lo, sub, area = (x[k] for x in subjects)
        alike = (abs(candidates[2] - sub) <= 1) & (np.isnan(area) | (candidates[3] >= area * 0.75) & (candidates[3] <= area * 1.25))
        far = np.rint(nearest.kilometres(la, lo, candidates[0], candidates[1]) * 100)
        found = sorted((int(far[j]), int(rank[j])) for j in np.flatnonzero(alike & (far <= 2000)))[:9]
        if found:
            want[k] = found
    assert {k: sorted(v) for k, v in got.items()} == want


def test_a_subject_meets_few_candidates_at_any_density(monkeypatch):
    """Just too few in the squares of one radius must not make it meet all within a radius many times larger."""
    met, measure = [], nearest.kilometres
    monkeypatch.setattr(nearest, "kilometres", lambda *a: met.append(len(a[0])) or measure(*a))
    for apart in (0.002, 0.004, 0.008, 0.016):
        met.clear()
        grid = np.arange(-0.4, 0.4, apart)
        lat, lon = (50 + v.ravel() for v in np.meshgrid(grid, grid))
        same = np.full(len(lat), 3.0)
        middle = (abs(lat - 50) < 0.1) & (abs(lon - 50) < 0.1)
        all_of = (lat, lon, same, same)
        s, _, _ = nearest.search(tuple(v[middle] for v in all_of), all_of, np.arange(len(lat)), 9, 0.25, (-1, 0, 1))
        assert len(s) == 9 * middle.sum() and sum(met) < 200 * middle.sum()


def test_a_full_tile_is_dealt_to_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(comp, "BLOCK", 10)
    rows = scene(7, 150, 0.3)
    got = {}
    for r in comp.comparables(*frames(spark, rows)).orderBy("subject_id", "rank").collect():
        got.setdefault(r["subject_id"], []).append((r["distance_km"], r["listing_id"]))
    assert got == {k: v for k, v in brute_comparables(rows).items() if v}
