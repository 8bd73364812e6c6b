"""Nearest neighbours of like attributes, one block of listings at a time.

A block holds subjects of one tile and all candidates that can lie within the
largest radius of them. Search radii grow step by step: the candidates of the
nine squares around a subject (squares as wide as the radius) come out of one
sorted array, those within the radius are counted, and a subject that has
enough of them is done. So a subject meets a bounded number of candidates
beyond those it needs, in dense places as in empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearthline.functions.geo import EARTH_RADIUS_KM, KM_PER_DEGREE

# Search radii in km; the last one is the end of the search.
REACH_KM = (0.05, 0.4, 0.8, 1.6, 3.2, 6.4, 12.0, 20.0)
#: Rounded distances reach half a unit of the last digit further.
SLACK_KM = 0.0051
#: Pairs of subject and candidate that are measured in one step, and subjects whose squares are looked up in one.
PAIRS, SUBJECTS = 1_000_000, 1 << 15


def kilometres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """As ``haversine_km``."""
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    a = half_lat**2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon**2
    with np.errstate(invalid="ignore"):
        return 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the runs that begin at ``starts``."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of subjects with about ``PAIRS`` pairs; one with more stands alone."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, side="right"))
        yield first, (first := max(last, first + 1))


def search(subjects: tuple, candidates: tuple, rank: np.ndarray, most: int, band: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subject, candidate, hundredths of km): of every subject the first ``most`` candidates by rounded distance and rank.

    Both sides are (lat, lon, sub, area); ``steps`` are the differences in ``sub`` that are alike. A subject's area that is NaN
    is like all areas, a candidate's that is NaN like no other.
    """
    (lat, lon, sub, area), (c_lat, c_lon, c_sub, c_area) = subjects, candidates
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    if not len(lat) or not len(c_lat):
        return found[0]
    areas = np.unique(c_area[~np.isnan(c_area)])
    c_code = np.where(np.isnan(c_area), len(areas), np.searchsorted(areas, c_area))
    low = np.where(np.isnan(area), 0, np.searchsorted(areas, area * (1 - band), side="left"))
    high = np.where(np.isnan(area), len(areas) + 1, np.searchsorted(areas, area * (1 + band), side="right"))
    subs = np.unique(c_sub)
    wanted = sub[:, None] + np.array(steps)
    layer = np.minimum(np.searchsorted(subs, wanted), len(subs) - 1)
    known = subs[layer] == wanted
    c_layer = np.searchsorted(subs, c_sub)
    by_rank = np.empty(len(rank), np.int64)
    by_rank[rank] = np.arange(len(rank))
    pending = np.arange(len(lat))
    for r in REACH_KM:
        final = r == REACH_KM[-1]
        tall = (r + SLACK_KM) * 1.000001 / KM_PER_DEGREE
        wide = min(180.0, tall / np.cos(np.radians(min(89.9, np.abs(lat).max() + tall))))
        cy, cx = np.floor(c_lat / tall).astype(np.int64), np.floor(c_lon / wide).astype(np.int64)
        bottom, left, columns = cy.min(), cx.min(), cx.max() - cx.min() + 1
        key = (((cy - bottom) * columns + cx - left) * len(subs) + c_layer) * (len(areas) + 1) + c_code
        order = np.argsort(key)
        key = key[order]
        rows = cy.max() - bottom + 1
        left_over = []
        for at in range(0, len(pending), SUBJECTS):
            now = pending[at : at + SUBJECTS]
            y = np.floor(lat[now] / tall).astype(np.int64)[:, None] - bottom + np.array([-1, 0, 1])
            x = np.floor(lon[now] / wide).astype(np.int64)[:, None] - left + np.array([-1, 0, 1])
            inside = ((y >= 0) & (y < rows))[:, :, None, None] & ((x >= 0) & (x < columns))[:, None, :, None] & known[now][:, None, None, :]
            cell = ((y[:, :, None] * columns + x[:, None, :])[:, :, :, None] * len(subs) + layer[now][:, None, None, :]) * (len(areas) + 1)
            which = np.broadcast_to(np.arange(len(now))[:, None, None, None], inside.shape)[inside]
            cell = cell[inside]
            begin = np.searchsorted(key, cell + low[now][which])
            size = np.maximum(np.searchsorted(key, cell + high[now][which]) - begin, 0)
            total = np.bincount(which, size, len(now)).astype(np.int64)
            enough = (total > 0) if final else (total >= most)
            if not final:
                left_over.append(now[~enough])
            keep = enough[which]
            which, begin, size = which[keep], begin[keep], size[keep]
            subject = np.flatnonzero(enough)
            edge = np.searchsorted(which, np.append(subject, len(now)))
            for first, last in _pieces(total[subject]):
                part = slice(edge[first], edge[last])
                own = np.repeat(which[part], size[part])
                other = order[_runs(begin[part], size[part])]
                who = now[own]
                km = np.rint(kilometres(lat[who], lon[who], c_lat[other], c_lon[other]) * 100)
                near = km <= r * 100
                own, other, km = own[near], other[near], km[near].astype(np.int64)
                if not final:
                    some = np.bincount(own, minlength=len(now)) >= most
                    tried = subject[first:last]
                    left_over.append(now[tried[~some[tried]]])
                    near = some[own]
                    own, other, km = own[near], other[near], km[near]
                packed = np.sort((own << 44) | (km << 32) | rank[other])
                own = packed >> 44
                place = np.arange(len(own)) - np.searchsorted(own, own)
                packed = packed[place < most]
                found.append((now[packed >> 44], by_rank[packed & 0xFFFFFFFF], (packed >> 32) & 0xFFF))
        if final:
            break
        pending = np.sort(np.concatenate([none, *left_over]))
        if not len(pending):
            break
    return tuple(np.concatenate(part) for part in zip(*found))


def _numbers(table: pa.Table, names: list[str]) -> tuple[np.ndarray, ...]:
    return tuple(pc.fill_null(table[n].cast(pa.float64()), float("nan")).to_numpy() for n in names)


def _ranks(candidates: pa.Table, columns: list[str]) -> np.ndarray:
    """Place of every candidate in the order of its id; rows with one id by their other columns."""
    ids = candidates[columns[0]]
    keys = columns if pc.count_distinct(ids).as_py() < len(ids) else columns[:1]
    order = pc.sort_indices(candidates.select(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def near_lists(most: int, band: float, sub_band: int, members: list[str], schema: pa.Schema):
    """(subjects, candidates) of a block -> a row (subject_id, subject_price, near) for each subject. ``members`` are the candidate's columns in the list, its id first."""
    point = ["lat", "lon", "sub", "area"]

    def lists(subjects: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(subjects):
            return schema.empty_table()
        own, theirs = _numbers(subjects, point), _numbers(candidates, point)
        # equal subjects share a search, and neighbours in place are looked up one after the other
        order = np.lexsort(own[::-1])
        own = tuple(c[order] for c in own)
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([(c[1:] != c[:-1]) & ~(np.isnan(c[1:]) & np.isnan(c[:-1])) for c in own], axis=0)
        own = tuple(c[fresh] for c in own)
        shared = np.empty(len(order), np.int64)
        shared[order] = np.cumsum(fresh) - 1
        rank, open_ended = _ranks(candidates, members), np.isnan(own[2])
        parts = []
        for chosen, others, steps in ((~open_ended, ~np.isnan(theirs[2]), tuple(range(-sub_band, sub_band + 1))), (open_ended, np.ones(len(rank), bool), (0,))):
            mine, them = np.flatnonzero(chosen), np.flatnonzero(others)
            flat = lambda cols, at: tuple(np.zeros(len(at)) if k == 2 and steps == (0,) else c[at] for k, c in enumerate(cols))  # noqa: B023
            places = np.empty(len(them), np.int64)
            places[np.argsort(rank[them])] = np.arange(len(them))
            s, c, km = search(flat(own, mine), flat(theirs, them), places, most, band, steps)
            parts.append((mine[s], them[c], km))
        s, c, km = (np.concatenate(p) for p in zip(*parts))
        by_subject = np.argsort(s, kind="stable")
        c, km = c[by_subject], km[by_subject]
        sizes = np.bincount(s, minlength=int(fresh.sum()))
        starts = np.cumsum(sizes) - sizes
        picked = _runs(starts[shared], sizes[shared])
        taken = candidates.select(members).take(pa.array(c[picked])).combine_chunks()
        kind = schema.field("near").type.value_type
        columns = [pa.array(km[picked] / 100.0), *[taken[m].combine_chunks() for m in members]]
        rows = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], fields=list(kind))
        offsets = np.concatenate([[0], np.cumsum(sizes[shared])]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(offsets), rows, type=schema.field("near").type)
        return pa.Table.from_arrays([subjects["subject_id"], subjects["subject_price"], near], schema=schema)

    return lists
