"""Self-join of documents on the Jaccard similarity of their word n-grams (operator 9).

1. Every text becomes the set of its n-gram hashes and its MinHash bands. Rows per
   band and number of bands follow from the wanted recall at the threshold.
2. Equal sets form one class (copies are counted, not paired), known by 64 bits of its set; ids take part only in the results.
3. A shuffle on (band, hash) ties each class to the smallest class of its
   bucket; connected components of these ties hold all candidate pairs.
4. Components are dealt out to tiles of bounded size: small ones together, a
   large one cut into parts so that each pair of parts meets in one tile.
   A tile reads the texts of its classes once and compares full n-gram sets by
   inverted lists. It gives the number of links of each class and a spanning
   forest of its links, never the pairs.
5. Connected components of the forests are the groups of near duplicates.

Words are runs of letters and digits, lower-cased in ASCII; a text of fewer words
than an n-gram has one n-gram of all its words.

* null text, or text without words: no n-gram, no link, a group of its own
* null ``doc_id``: the row has links like any other; ``class_id`` of a group without any id is null
* repeated rows: each row counts as a copy; several texts under one id are compared each, and groups that have their smallest id in common
  have the same ``class_id`` (``keep_one`` tells them apart)
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_class, inner_windows, mix64, row_chunks, stored, text_bytes, window_hashes, word_hashes, word_spans

SIZE = 5
THRESHOLD = 0.8
RECALL = 0.9999
BAND_ROWS = 5
#: Parts over which the rows of a hot key are spread in a join.
SALTS = 8
#: n-grams in one tile: some 200 MB of working memory in a task.
TILE_GRAMS = 2_000_000


def band_count(recall: float, threshold: float, rows: int) -> int:
    """Bands of ``rows`` values so that a pair at ``threshold`` meets in one of them with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(column: pa.Array, size: int):
    """Distinct n-gram hashes of each row: concatenated, and their counts."""
    member, fold = byte_class("alnum"), np.arange(256)
    fold[ord("A") : ord("Z") + 1] += 32
    data, offsets = text_bytes(column)
    starts, stops, counts = word_spans(data, offsets, member)
    words = word_hashes(data, starts, stops, member, fold)
    whole, row = inner_windows(counts, size)
    grams, row = window_hashes(words, size)[whole], row[whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = np.cumsum(counts) - counts
        own = [mix64(window_hashes(words[at[k] : at[k] + counts[k]], int(counts[k])) + np.uint64(counts[k])) for k in short]
        grams, row = np.concatenate([grams, *own]), np.concatenate([row, short])
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.bincount(row[new], minlength=len(column))


def sketcher(size: int, bands: int, rows: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                grams, counts = gram_sets(part.column("text"), size)
                full = np.flatnonzero(counts)
                at = (np.cumsum(counts) - counts)[full]
                value = np.zeros((len(full), bands), np.uint64)
                if len(full):
                    for band in range(bands):
                        joined = np.zeros(len(full), np.uint64)
                        for r in range(rows):
                            least = np.minimum.reduceat((grams ^ seeds[band * rows + r]) * seeds[band * rows + r] >> np.uint64(16), at)
                            joined = mix64(joined * np.uint64(31) + least + np.uint64(1))
                        value[:, band] = joined
                keys, sketches = [None] * len(part), [None] * len(part)
                for k, a in zip(full, at):
                    keys[k] = hashlib.md5(grams[a : a + counts[k]].tobytes()).digest()
                for k, v in zip(full, value.view(np.int64).tolist()):
                    sketches[k] = v
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "set_key", "grams", "bands"],
                )

    return sketch


def salt_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def salted(df: DataFrame) -> DataFrame:
    """A copy of each row for every salt: the side of a join that has one row for a key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` of an undirected graph given as ``a, b`` with a > b; root is the smallest node. Nodes without edge are absent.

    Alternating large-star and small-star steps; every round halves the
    paths at least, and each is written to the shared folder, so the rounds grow with the logarithm of the longest path. Stars are built by
    grouping on the smaller ends, where partial sums keep a hot node small, and a hot node's edges are spread over salts.
    """
    edges = stored(edges.where("a > b").distinct(), f"{name}-edges")
    before = None
    for k in count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        # large star: neighbours above a node go to the node's smallest neighbour
        large = edges.withColumn("salt", salt_of("a")).join(salted(least.withColumnRenamed("n", "b")), ["b", "salt"]).select("a", F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.join(low, large["a"] == low["n"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = stored(small.where("a > b").distinct(), f"{name}-{k}")
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def compare_tile(threshold: float, size: int):
    """Texts of one tile -> links of each class within it, and a parent in the spanning forest of its links."""

    def compare(rows: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("parent", pa.int64())])
        rows = rows.combine_chunks().sort_by([("root", "ascending"), ("node", "ascending")])
        node, root, side, copies = (rows.column(c).to_numpy() for c in ("node", "root", "side", "copies"))
        n = len(node)
        sets, counts = [], np.zeros(n, np.int64)
        text = rows.column("text").combine_chunks() if rows.column("text").num_chunks != 1 else rows.column("text").chunk(0)
        for first, last in row_chunks(text):
            g, c = gram_sets(text.slice(first, last - first), size)
            sets.append(g)
            counts[first:last] = c
        grams, row = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(n), counts)
        order = np.lexsort((row, grams, root[row]))  # an n-gram only meets others of its component
        g, r = grams[order], row[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (root[r[1:]] != root[r[:-1]])
        run = np.cumsum(new) - 1
        bounds = np.append(np.flatnonzero(new), len(g))
        place = np.empty(len(g), np.int64)
        place[order] = np.arange(len(g))  # where each n-gram of a row stands in the lists
        stop = bounds[run + 1] if len(g) else bounds
        at = np.cumsum(counts) - counts
        links, label = np.zeros(n, np.int64), np.arange(n)

        for i in range(n):
            here = place[at[i] : at[i] + counts[i]]
            lengths = stop[here] - here - 1  # rows after this one in each list
            total = int(lengths.sum())
            if not total:
                continue
            lo = here + 1
            index = np.arange(total) + np.repeat(lo - (np.cumsum(lengths) - lengths), lengths)
            met = r[index] - i
            shared = np.bincount(met)
            other = np.flatnonzero(shared) + i
            shared = shared[other - i]
            ok = (shared >= threshold * (counts[i] + counts[other] - shared) - 1e-9) & ((side[other] != side[i]) | (side[i] < 0))
            other = other[ok]
            if len(other):
                links[i] += copies[other].sum()
                links[other] += copies[i]
                own = label[other]
                if (own != label[i]).any():
                    joined = np.unique(np.append(own, label[i]))
                    label[np.isin(label, joined)] = joined[0]
        return pa.table([pa.array(node), pa.array(links), pa.array(node[label])], schema=schema)

    return compare


def grouped(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = BAND_ROWS, tile_grams: int = TILE_GRAMS) -> DataFrame:
    """The columns of ``near_duplicates`` and ``group``, a key of the group of near duplicates (null without words)."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    bands = band_count(recall, threshold, rows)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sketches = docs.mapInArrow(sketcher(size, bands, rows), "doc_id bigint, text_hash bigint, set_key binary, grams bigint, bands array<bigint>")
    sketches = stored(sketches, "op9-sketches")

    # one row speaks for a class: that of the smallest id, a row without id only where there is none
    speaker = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    sets = sketches.where("set_key IS NOT NULL").groupBy("set_key").agg(speaker.alias("s"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands"))
    sets = stored(sets.select("set_key", F.xxhash64("set_key").alias("node"), "copies", "grams", "bands", F.col("s.doc_id").alias("speaker"), F.col("s.text_hash").alias("text_hash")), "op9-classes")
    members = sets.select("node", F.posexplode("bands").alias("band", "hash"))
    least = members.groupBy("band", "hash").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    ties = members.withColumn("salt", salt_of("node")).join(salted(least), ["band", "hash", "salt"]).where("node > b").select(F.col("node").alias("a"), "b")
    ties = components(ties, "op9-ties")

    # tiles: (component of many n-grams, pair of its parts) or a bin of small components
    tied = sets.select("node", "grams", "copies", "speaker", "text_hash").join(ties, "node")
    weight = tied.groupBy("root").agg(F.sum("grams").alias("weight"))
    total = weight.agg(F.sum("weight")).first()[0] or 0
    bins = max(1, math.ceil(2 * total / tile_grams))
    parts = F.greatest(F.lit(1), F.ceil(2 * F.col("weight") / tile_grams)).cast("int")
    placed = stored(tied.join(weight, "root").withColumn("parts", F.when(F.col("weight") * 2 > tile_grams, parts).otherwise(1)), "op9-placed")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    small = F.col("weight") * 2 <= tile_grams
    tile = F.when(small, F.struct(F.pmod(F.xxhash64("root"), F.lit(bins)).alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("c"))).otherwise(F.struct(F.col("root").alias("a"), low.alias("b"), high.alias("c")))
    # within a tile of two different parts only pairs across count
    placed = placed.select("node", "root", "copies", "speaker", F.col("text_hash").alias("hash"), tile.alias("tile"), F.when(small | (F.col("part") == F.col("other")), -1).otherwise(F.col("part")).alias("side"))
    # the placed classes grow with the documents: never broadcast, however few they are
    alone = docs.where("doc_id IS NULL").dropDuplicates(["text_hash"])  # many copies without id are one row of the join
    same = F.col("doc_id").eqNullSafe(F.col("speaker")) & (F.col("text_hash") == F.col("hash"))
    texts = docs.where("doc_id IS NOT NULL").union(alone).join(placed.hint("merge"), same).dropDuplicates(["tile", "node"])
    found = texts.select("node", "root", "copies", "side", "text", "tile").groupBy("tile").applyInArrow(compare_tile(threshold, size), "node bigint, links bigint, parent bigint")
    found = stored(found, "op9-links")
    groups = components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")), "op9-groups")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # ids come back in: the smallest of each group
    tops = groups.join(sets.select("node", "speaker"), "node").groupBy("root").agg(F.min("speaker").alias("least"))
    joined = links.join(groups, "node", "left").join(tops, "root", "left")
    classes = sets.select("set_key", "node", "speaker", "copies").join(joined, "node", "left").select(
        "set_key", F.coalesce("root", "node").alias("group"), F.col("speaker").alias("text_class"), F.when(F.col("root").isNull(), F.col("speaker")).otherwise(F.col("least")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = sketches.select("doc_id", "text_hash", "set_key").join(classes, "set_key", "left")
    return out.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("text_class", "doc_id").alias("text_class"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "group")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: ``doc_id``; ``text_hash``; ``class_id``, the smallest id of its group of near duplicates; ``text_class``, the smallest id
    with the same n-gram set; ``n_links``, the number of other rows at ``threshold`` or more. ``options`` as in ``grouped``."""
    return grouped(docs, **options).drop("group")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id, one without id only where the group has none. Rows
    without words stay, once for each id and text. Of rows with equal id and text one stays, chosen by a hash of the other columns."""
    near = grouped(docs, **options)
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    stay = near.where("group IS NOT NULL").groupBy("group").agg(F.min(row).alias("r")).select("r.id", "r.hash")
    stay = stay.union(near.where("group IS NULL").select("doc_id", "text_hash")).distinct().select(F.col("id").alias("stay_id"), F.col("hash").alias("stay_hash"))
    # the columns travel inside one struct, so their names clash with none used here
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.xxhash64(F.to_json(F.struct(*rest))).alias("tie"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"))
    rows = rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("hash") == F.col("stay_hash")), "left_semi")
    return rows.groupBy("id", "hash").agg(F.min_by("kept", "tie").alias("kept")).select(*[F.col(f"kept.`{c}`") for c in docs.columns])
