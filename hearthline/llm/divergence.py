"""How the sources of a language differ in their words (operator 11).

Terms are counted per language and source inside Arrow batches and summed by
Spark. A language keeps the terms found in enough of its documents. Shares
are whole numbers of ``SCALE`` with a constant added to every count, computed
exactly.

* Terms that a source uses more than its language are ranked by the
  difference of the two shares. The difference can only grow with the count in the group
  and fall with the count in the language, so a term that ``top`` others
  dominate (group count not lower, language count not higher, earlier in
  UTF-8) cannot be among the first ``top``. Partitions keep
  their skyband, the terms with fewer dominators; skybands of partitions are
  merged, and what is left is ranked exactly.
* Pairs of sources are compared over all kept terms in tiles of sources: a
  tile pair and a share of the terms make a stream of rows, in which a block of
  terms is one dense table. Terms that neither source of a pair has add a
  constant, so they are counted only.

* null text, language and source read as ''; a text without terms still makes its group occur
* repeated rows count again; ``doc_id`` and other columns are not read
* empty table: an empty result; very long texts and terms are taken whole
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import lower_ascii, mask_spans, row_chunks, stored, strings_at, text_bytes

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
TILE = 128  # sources of a tile
TERM_PARTS = 16  # streams into which the terms of a tile pair are dealt
MERGE_PARTS = 16  # parts of a group whose skybands are merged before the ranking
COUNT_BYTES = 8_000_000
COUNTS = "lang string, source string, term string, n long, docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per language, source and term, once per chunk of text; a row without term for every group."""
    lower = lower_ascii()
    member = np.arange(256) >= 0x80
    member[ord("a") : ord("z") + 1] = True
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        for first, last in row_chunks(batch.column("text"), COUNT_BYTES):
            part = batch.slice(first, last - first)
            data, offsets = text_bytes(part.column("text"))
            data = lower[data]
            starts, stops, per_row = mask_spans(member[data], offsets)
            terms = strings_at(data, starts, stops).dictionary_encode()
            lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
            sources, n_terms = len(source.dictionary), len(terms.dictionary)
            groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy(), return_inverse=True)
            row = np.repeat(np.arange(len(part)), per_row)
            per_doc, n = np.unique(row * max(n_terms, 1) + terms.indices.to_numpy(), return_counts=True)
            key = group[per_doc // max(n_terms, 1)] * n_terms + per_doc % max(n_terms, 1)
            keys, place = np.unique(key, return_inverse=True)
            occurrences, docs = np.bincount(place, n, len(keys)).astype(np.int64), np.bincount(place, minlength=len(keys))
            of, term = keys // max(n_terms, 1), keys % max(n_terms, 1)
            of = np.concatenate([np.arange(len(groups)), of])
            none = np.zeros(len(groups), np.int64)
            term = pa.array(np.concatenate([none, term]), mask=np.arange(len(of)) < len(groups))
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(groups[of] // sources)).cast(pa.string()), source.dictionary.take(pa.array(groups[of] % sources)).cast(pa.string()),
                    terms.dictionary.take(term).cast(pa.string()), pa.array(np.concatenate([none, occurrences])), pa.array(np.concatenate([none, docs])),
                ], schema=schema,
            )


def share(count: Column, total: Column, terms: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * terms)) in whole numbers."""
    above = F.lit(scale).cast("decimal(12,0)") * (count + prior).cast("decimal(18,0)")
    return F.call_function("div", above, (total + terms * prior).cast("decimal(19,0)")) + 1


def undominated(here: np.ndarray, lang: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the terms that fewer than ``k`` others dominate. ``name`` is the place of the term in UTF-8 order.

    In order of the group count, then language count and name, dominators come
    first; of them it is enough to count those that were kept, because a term's first ``k`` dominators
    in this order have fewer than ``k`` themselves.
    """
    order = np.lexsort((name, lang, -here))
    kept: list[np.ndarray] = []
    kept_lang, kept_name = lang[:0], name[:0]
    for first in range(0, len(order), 256):
        at = order[first : first + 256]
        low, early = lang[at], name[at]
        above = ((kept_lang[None, :] <= low[:, None]) & (kept_name[None, :] < early[:, None])).sum(1)
        before = np.tri(len(at), k=-1, dtype=bool)
        above += (before & (low[None, :] <= low[:, None]) & (early[None, :] < early[:, None])).sum(1)
        at = at[above < k]
        kept.append(at)
        kept_lang, kept_name = np.concatenate([kept_lang, lang[at]]), np.concatenate([kept_name, name[at]])
    return np.concatenate([order[:0], *kept])


def runs(batch: pa.RecordBatch, by: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of a sorted batch with equal values in ``by``."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for name in by:
        codes = batch.column(name).dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    edges = np.append(np.flatnonzero(new), len(batch))
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)


def skyband(k: int, most: int = 20_000):
    """Per group of sorted rows (``lang, source, term, here, there``): its skyband. A group is reduced whenever ``most`` rows wait."""

    def reduced(table: pa.Table) -> pa.Table:
        name = np.empty(len(table), np.int64)
        name[pa.compute.sort_indices(table.column("term")).to_numpy()] = np.arange(len(table))
        return table.take(pa.array(undominated(table.column("here").to_numpy(), table.column("there").to_numpy(), name, k)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for run in runs(batch, ["lang", "source"]):
                key = (run.column("lang")[0].as_py(), run.column("source")[0].as_py())
                if key != group and held:
                    yield from reduced(pa.Table.from_batches(held)).to_batches()
                    held, size = [], 0
                group = key
                held.append(run)
                size += len(run)
                if size > most:
                    table = reduced(pa.Table.from_batches(held)).combine_chunks()
                    held, size = table.to_batches(), 0  # the next reduction waits for as many new rows
        if held:
            yield from reduced(pa.Table.from_batches(held)).to_batches()

    return scan


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lang, low, high, part), one per term with the sources of two tiles that use it (``place``) and their shares
    (``p``) -> per pair of sources of the tiles ``low`` and ``high``: sum of the absolute differences over these terms, and
    how many these are. The first row of a stream is its head: all sources of the tiles with their shares at count 0."""
    schema = pa.schema([("lang", pa.string()), ("one", pa.int64()), ("two", pa.int64()), ("value", pa.int64()), ("seen", pa.int64())])
    by = ["lang", "low", "high", "part"]

    def result(key, ids, sums, seen):
        one, two = np.nonzero((ids[:, None] // TILE == key[1]) & (ids[None, :] // TILE == key[2]) & (ids[:, None] < ids[None, :]))
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(one), pa.string()), pa.array(ids[one]), pa.array(ids[two]), pa.array(sums[one, two]), pa.array(np.full(len(one), seen))], schema=schema)

    key = None
    for batch in batches:
        for run in runs(batch, by):
            place, value = (run.column(c).flatten().to_numpy() for c in ("place", "p"))
            size = run.column("place").value_lengths().to_numpy()
            now = tuple(run.column(c)[0].as_py() for c in by)
            if now != key:
                if key is not None:
                    yield result(key, ids, sums, seen)
                key, seen = now, 0
                order = np.argsort(place[: size[0]])
                ids, base = place[: size[0]][order], value[: size[0]][order]
                sums = np.zeros((len(ids), len(ids)), np.int64)
                place, value, size = place[size[0] :], value[size[0] :], size[1:]
            at, ends = np.searchsorted(ids, place), np.append(0, np.cumsum(size))
            for first in range(0, len(size), 512):
                last = min(first + 512, len(size))
                here = slice(ends[first], ends[last])
                block = np.repeat(base[:, None], last - first, axis=1)
                block[at[here], np.repeat(np.arange(last - first), size[first:last])] = value[here]
                for k in np.flatnonzero(ids // TILE == key[1]):
                    sums[k] += np.abs(block - block[k]).sum(axis=1)
            seen += len(size)
    if key is not None:
        yield result(key, ids, sums, seen)


def kept_terms(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the kept terms (``lang, source, term, here, there``: in the group and in its language), and the groups
    (``lang, source, place, total, terms, lang_total``; sources of a language are numbered from 0)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = docs.select(text("text"), text("lang"), text("source")).mapInArrow(count_terms, COUNTS)
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("here"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.select("lang", "source", "term", "here", F.sum("here").over(of_term).alias("there"), F.sum("docs").over(of_term).alias("lang_docs"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    counts = stored(counts.where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs)), "op11-terms")
    terms = counts.where("term IS NOT NULL")
    langs = terms.groupBy("lang").agg(F.sum(F.col("first").cast("bigint")).alias("terms"), F.sum("here").alias("lang_total"))
    totals = terms.groupBy("lang", "source").agg(F.sum("here").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("place"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    return terms.select("lang", "source", "term", "here", "there"), stored(groups, "op11-groups")


def typical_terms(rows: DataFrame, top: int) -> DataFrame:
    """Rows (``lang, source, term, here, there, value``) of the ``top`` largest values per group, with ``rank``."""
    group = ["lang", "source"]
    band = lambda df: df.sortWithinPartitions(*group).mapInArrow(skyband(top), rows.schema)
    merged = band(band(rows).repartition(*group, F.pmod(F.xxhash64("term"), F.lit(MERGE_PARTS))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "term"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= top)


def source_distances(rows: DataFrame, groups: DataFrame, zero: Column) -> DataFrame:
    """Per ordered pair of sources of a language: ``lang, source, item, value``, the sum of the differences over all kept terms."""
    tiles = groups.groupBy("lang").agg((F.max("place") / TILE).cast("bigint").alias("last"))
    tile = (F.col("place") / TILE).cast("bigint")

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(tiles, "lang").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))))
        return df.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))

    by = ["lang", "low", "high"]
    both = lambda df, *more: df.groupBy(*by, *more).agg(F.collect_list(F.struct("place", "p")).alias("x"))  # noqa: E731  at most two tiles
    heads = both(dealt(groups.select("lang", "place", zero.alias("p")))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(TERM_PARTS - 1)))).withColumn("head", F.lit(0))
    each = both(dealt(rows.select("lang", "term", "place", "p")), "term").withColumn("part", F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int")).withColumn("head", F.lit(1))
    columns = [*by, "part", "head", F.col("x.place").alias("place"), F.col("x.p").alias("p")]
    streams = heads.select(*columns).unionByName(each.select(*columns)).repartition(*by, "part").sortWithinPartitions(*by, "part", "head")
    sums = streams.mapInArrow(tile_sums, "lang string, one long, two long, value long, seen long").groupBy("lang", "one", "two").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one = groups.select("lang", F.col("place").alias("one"), F.col("source").alias("a"), zero.alias("zero_a"), "terms")
    two = groups.select("lang", F.col("place").alias("two"), F.col("source").alias("b"), zero.alias("zero_b"))
    sums = sums.join(one, ["lang", "one"]).join(two, ["lang", "two"])
    unseen = F.coalesce((F.col("terms") - F.col("seen")) * F.abs(F.col("zero_a") - F.col("zero_b")), F.lit(0).cast("bigint"))
    sums = sums.withColumn("value", F.col("value") + unseen)
    ends = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", F.explode(ends).alias("e"), "value").select("lang", "e.source", "e.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``term``, the terms that a source uses more than its language (the first ``top``); part
    ``pair``, all other sources of the language by distance."""
    terms, groups = kept_terms(docs, min_docs)
    n = F.col("terms")
    # without kept terms there is nothing to divide by, and every difference is 0
    zero = F.when(n > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.greatest(n, F.lit(1).cast("bigint")), prior, scale)).otherwise(F.lit(0).cast("bigint"))
    rows = terms.join(groups, ["lang", "source"])
    rows = stored(rows.select("lang", "source", "place", "term", "here", "there", share(F.col("here"), F.col("total"), n, prior, scale).alias("p"), share(F.col("there"), F.col("lang_total"), n, prior, scale).alias("q")), "op11-shares")
    typical = typical_terms(rows.where("p > q").select("lang", "source", "term", "here", "there", (F.col("p") - F.col("q")).alias("value")), top)
    pairs = source_distances(rows, groups, zero)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return typical.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank").unionByName(pairs.withColumn("part", F.lit("pair")).select(*columns))
