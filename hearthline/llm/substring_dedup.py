"""Removal of passages that an earlier document has already (operator 5).

Every run of ``window`` words is hashed (Rabin-Karp). The hashes travel as
packed blocks, one per slice of the hash space and chunk of text, so one row
carries thousands of windows and a passage found in a third of all documents
costs one entry per chunk. Each slice finds the hashes that occur in several
documents and names, per document, those that a smaller ``doc_id`` has too.
A last pass over the texts merges the named windows into maximal intervals
of words to remove.

Windows are told apart by 64 bits of one hash and the slice number, taken
from a second, independent hash.

* null or empty text: no words, nothing removed
* null ``doc_id``: has no order, so nothing is removed from it and it removes nothing
* repeated ``doc_id``: rows of one id do not remove each other's words
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_class, inner_windows, mix64, row_chunks, stored, text_bytes, window_hashes, word_hashes, word_spans

WINDOW = 13
#: Windows that one slice of the hash space holds on average; with their ids about 50 MB in a task.
SLICE_WINDOWS = 3_000_000
SECOND_BASE = 0xA24BAED4963EE407
PACKED = "slice int, hashes binary, ids binary, counts binary, done boolean"


def row_words(column: pa.Array, member: np.ndarray):
    data, offsets = text_bytes(column)
    starts, stops, counts = word_spans(data, offsets, member)
    return data, starts, stops, counts, word_hashes(data, starts, stops, member)


def by_document(doc: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of each document; ``doc`` is sorted."""
    cuts = np.flatnonzero(np.diff(doc)) + 1
    for first, last in zip(np.append(0, cuts), np.append(cuts, len(doc))):
        if last > first:
            yield int(doc[first]), hashes[first:last]


def blocks(to: np.ndarray, doc: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """One block for each value of ``to``: hashes in order of their documents, the documents, and how many hashes each has."""
    order = np.lexsort((doc, to))
    to, doc, hashes = to[order], doc[order], hashes[order]
    edges = np.flatnonzero(np.diff(to)) + 1
    for a, b in zip(np.append(0, edges), np.append(edges, len(to))):
        if b > a:
            cut = np.append(0, np.flatnonzero(np.diff(doc[a:b])) + 1)
            yield int(to[a]), hashes[a:b].tobytes(), doc[a:b][cut].tobytes(), np.diff(np.append(cut, b - a)).tobytes()


def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for h, i, n in zip(*(table.column(c).to_pylist() for c in ("hashes", "ids", "counts"))):
        yield np.repeat(np.frombuffer(i, np.int64), np.frombuffer(n, np.int64)), np.frombuffer(h, np.uint64)


def joined(pairs) -> tuple[np.ndarray, np.ndarray]:
    docs, hashes = zip(*pairs) if pairs else ((), ())
    return np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def packer(window: int, slices: int):
    """Chunks of documents -> packed window hashes per slice. Rows marked ``done`` are named windows already."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, schema = byte_class("space"), pa.schema([("slice", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary()), ("done", pa.bool_())])
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                _, _, _, counts, words = row_words(part.column("text"), member)
                whole, row = inner_windows(counts, window)
                if not whole.any():
                    continue
                hashes, doc = window_hashes(words, window)[whole], ids[row[whole]]
                to = (window_hashes(words, window, SECOND_BASE)[whole] % np.uint64(slices)).astype(np.int32)
                order = np.lexsort((to, hashes)) if slices > 1 else np.argsort(hashes, kind="stable")
                hashes, to, doc = hashes[order], to[order], doc[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (to[1:] != to[:-1])
                smallest = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
                here = doc > smallest  # a smaller id of this chunk has the window
                out = [(*block, True) for block in blocks(np.full(here.sum(), int(to[0]), np.int32), doc[here], hashes[here])]
                out += [(*block, False) for block in blocks(to[new], smallest[new], hashes[new])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return pack


def namer(groups: int):
    def name_repeated(table: pa.Table) -> pa.Table:
        """Of one slice: the windows of each document that a smaller id has as well, per group of documents."""
        named = list(unpacked(table.filter(table.column("done"))))
        docs, hashes = joined(list(unpacked(table.filter(pc.invert(table.column("done"))))))
        if len(docs):
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            runs = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            later = docs > np.repeat(np.minimum.reduceat(docs, runs), np.diff(np.append(runs, len(docs))))
            named.append((docs[later], hashes[later]))
        docs, hashes = joined(named)
        out = list(blocks((mix64(docs.astype(np.uint64)) % np.uint64(groups)).astype(np.int32), docs, hashes))
        schema = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, schema.types)], schema=schema)

    return name_repeated


def merge_names(table: pa.Table) -> pa.Table:
    """Of one group of documents: all hashes named for each."""
    docs, hashes = joined(list(unpacked(table)))
    order = np.argsort(docs, kind="stable")
    found = list(by_document(docs[order], hashes[order]))
    return pa.table({"doc_id": pa.array([d for d, _ in found], pa.int64()), "named": pa.array([h.tobytes() for _, h in found], pa.binary())})


def remover(window: int, keep_text: bool):
    """Texts with the hashes named for them -> what is left."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = byte_class("space")
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                named = part.column("named").to_pylist()
                data, starts, stops, counts, words = row_words(part.column("text"), member)
                hashes, at = window_hashes(words, window), np.concatenate(([0], np.cumsum(counts)))
                removed, kept = [], []
                for k, own in enumerate(named):
                    lo, hi = at[k], at[k + 1]
                    drop = np.zeros(hi - lo + 1, np.int64)
                    if own and hi - lo >= window:
                        hit = np.flatnonzero(np.isin(hashes[lo : hi - window + 1], np.frombuffer(own, np.uint64)))
                        np.add.at(drop, hit, 1)
                        np.add.at(drop, hit + window, -1)
                    drop = np.cumsum(drop)[:-1] > 0
                    removed.append(int(drop.sum()))
                    stay = np.flatnonzero(~drop) + lo
                    kept.append(b" ".join([data[a:b].tobytes() for a, b in zip(starts[stay], stops[stay])]) if removed[-1] else b" ".join(data[starts[lo] : stops[hi - 1]].tobytes().split()) if hi > lo else b"")
                out = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    out.append(pa.array(kept, pa.binary()).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return remove


def remove_repeated(docs: DataFrame, window: int = WINDOW, slice_windows: int = SLICE_WINDOWS, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``kept_text`` (kept words joined by a blank) per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / 6 / slice_windows))  # about six bytes a word
    packed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(packer(window, slices), PACKED)
    named = packed.groupBy("slice").applyInArrow(namer(slices), "part int, hashes binary, ids binary, counts binary")
    named = stored(named.groupBy("part").applyInArrow(merge_names, "doc_id bigint, named binary"), "op5-named")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else "")
    return docs.join(named, "doc_id", "left").mapInArrow(remover(window, keep_text), schema)
