"""Spelling variants of words (operator 12).

Words are counted over all texts. Letters are hashed to a few symbols, and of
every distinct reduced word the full neighbourhood of one edit (the word
itself, deletions, replacements, insertions) is generated as 64-bit keys. Two
words that differ by one code point have reduced words that are equal or
neighbours, so a join of the neighbourhoods with the reduced vocabulary finds
all of them; a key that agrees by chance only adds a candidate. Candidates
are verified on the original strings. Neighbourhoods are symmetric, so each
pair of keys travels once, and one slice of the keys after the other, so the
shuffle never holds more than a slice.

A word's form is its most frequent near word if that is frequent enough;
roots are found by pointer doubling over the words that have a form.

* null and empty text: no words; null ``doc_id`` reads as '' where the id is hashed
* repeated rows and ids: every row counts
* empty table: an empty result; other columns are not read
* very long texts and runs are taken whole
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.session import growing

from .common import lower_ascii, mask_spans, mix64, powers, row_chunks, stored, strings_at, text_bytes

LENGTH, LEAST, SHARE = 7, 2, 10
#: One run in so many loses a code point.
DAMAGED = 31
SYMBOLS = 4
SLICES = 4
COUNT_BYTES = 8_000_000
BASE = 0x9E3779B97F4A7C15
#: Runs of more bytes are hashed one by one.
LONG_RUN = 48
LETTERS = "".join(chr(c) for c in [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])


def crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


def run_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, before: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """CRC-32 of every run, going on from the values in ``before``: all runs advance byte by byte, the longest first."""
    order = np.argsort(starts - stops, kind="stable")
    at, size = starts[order], (stops - starts)[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    first = int(np.searchsorted(-size, -LONG_RUN))  # runs before this one are longer
    for k in range(first):
        state[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes(), int(before[order[k]])) ^ 0xFFFFFFFF
    active = np.searchsorted(-size, -np.arange(1, LONG_RUN + 1), side="right")
    for k, last in enumerate(active):
        if last <= first:
            break
        now = state[first:last]
        state[first:last] = steps[(now ^ data[at[first:last] + k]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def word_counter(length: int, damaged: int):
    """Words of the texts with their counts, once per chunk of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, lower, steps = pa.schema([("word", pa.string()), ("n", pa.int64())]), lower_ascii(), crc_table()
        ascii_letter = np.zeros(256, bool)
        ascii_letter[ord("a") : ord("z") + 1] = True
        for batch in batches:
            for first, last in row_chunks(batch.column("text"), COUNT_BYTES):
                part = batch.slice(first, last - first)
                data, offsets = text_bytes(part.column("text"))
                data = lower[data]
                lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
                second = np.zeros(len(data), bool)
                second[1:] = lead[:-1]
                starts, stops, _ = mask_spans(ascii_letter[data] | lead | second, offsets)
                points = np.concatenate([[0], np.cumsum(~second)])
                long = points[stops] - points[starts] >= length
                starts, stops = starts[long], stops[long]
                row = np.searchsorted(offsets, starts, side="right") - 1
                ids = np.array([zlib.crc32(f"{i or ''}:".encode()) for i in part.column("id").to_pylist()], np.uint32)
                hashes = run_hashes(data, starts, stops, ids[row], steps)
                hit = hashes % np.uint32(damaged) == 0
                words = [strings_at(data, starts[~hit], stops[~hit])]
                cut = []
                for a, b, h in zip(starts[hit], stops[hit], hashes[hit]):
                    run = data[a:b].tobytes().decode()
                    k = int(h) % len(run)
                    if len(run) > length:
                        cut.append(run[:k] + run[k + 1 :])
                words = pa.chunked_array([*words, pa.array(cut, pa.large_string())]).combine_chunks().dictionary_encode()
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n, pa.int64())], schema=schema)

    return count


def count_words(docs: DataFrame, length: int = LENGTH, least: int = LEAST, damaged: int = DAMAGED) -> DataFrame:
    """``word, n``: all words of ``length`` code points or more that occur at least ``least`` times."""
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(word_counter(length, damaged), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def symbol_of(letter: str, symbols: int) -> str:
    return chr(ord("0") + zlib.crc32(letter.encode()) % symbols)


def neighbourhoods(symbols: int, slices: int, part: int | None):
    """Reduced words -> keys. With ``part`` None the key of the word itself; else pairs (a, b) of its key and the keys at most one
    edit away, smaller key first, as far as b falls into this slice."""
    inverse = pow(BASE, -1, 1 << 64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for first, last in row_chunks(batch.column("reduced"), 200_000):
                rows = batch.slice(first, last - first)
                data, offsets = text_bytes(rows.column("reduced"))
                digit = data.astype(np.uint64) - np.uint64(ord("0"))
                row = np.repeat(np.arange(len(rows)), np.diff(offsets))
                place = np.arange(len(data)) - offsets[row]
                power = powers(BASE, int(place.max(initial=0)) + 2)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((digit + np.uint64(1)) * power[place], dtype=np.uint64)])
                ahead = sums[:-1] - sums[offsets[row]]  # value of what stands before each letter
                total = sums[offsets[1:]] - sums[offsets[:-1]]
                yield rows, digit, row, power[place], ahead, total

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, *_, total in parts(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(mix64(total).astype(np.int64))], names=[*rows.schema.names, "key"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, digit, row, power, ahead, total in parts(batches):
            whole, base = total[row], np.uint64(BASE)
            value = (digit + np.uint64(1)) * power
            last = np.append(row[1:] != row[:-1], True)
            same_next = np.append(digit[1:] == digit[:-1], False) & ~last
            drop = ~same_next  # of a run of equal symbols one deletion is enough
            found = [(np.arange(len(total)), total), (row[drop], (ahead + (whole - ahead - value) * np.uint64(inverse))[drop])]
            for s in range(symbols):
                other = digit != np.uint64(s)
                here = np.uint64(s + 1) * power
                found.append((row[other], (whole - value + here)[other]))
                found.append((row[other], (ahead + here + (whole - ahead) * base)[other]))  # before a letter of another symbol
                found.append((row[last], (whole + here * base)[last]))  # at the end
            row_of = np.concatenate([f[0] for f in found])
            a, b = mix64(total)[row_of].view(np.int64), mix64(np.concatenate([f[1] for f in found])).view(np.int64)
            # both ends of a pair generate it: the pair goes with the smaller key first, from that end
            keep = (a <= b) & (b.view(np.uint64) % np.uint64(slices) == np.uint64(part))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return own if part is None else near


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, slices: int = SLICES) -> DataFrame:
    """All pairs of ``words`` (``word, n``) that differ by one inserted, deleted or replaced code point, each once: ``word, n, other, other_n``.
    Each slice of the keys is written by itself."""
    spark = words.sparkSession
    reduced = F.translate("word", LETTERS, "".join(symbol_of(c, symbols) for c in LETTERS))
    keyed = words.withColumn("reduced", reduced).mapInArrow(neighbourhoods(symbols, slices, None), "word string, n long, reduced string, key long")
    keyed = stored(keyed, "op12-vocabulary")
    distinct = stored(keyed.select("reduced").distinct(), "op12-reduced")
    one, two = keyed.select(F.col("key").alias("a"), "word", "n"), keyed.select(F.col("key").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    paths = []
    for part in range(slices):
        pairs = distinct.mapInArrow(neighbourhoods(symbols, slices, part), "a long, b long")
        # a row of ``pairs`` is made some fifty times from a reduced word, which the planner does not see
        found = pairs.join(growing(two), "b").join(growing(one), "a").where((F.col("a") != F.col("b")) | (F.col("word") < F.col("other")))
        found = found.where(F.expr("levenshtein(word, other, 1) = 1")).select("word", "n", "other", "other_n")
        paths += stored(found, f"op12-pairs-{part}").inputFiles()
    schema = "word string, n long, other string, other_n long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def group_variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, share: int = SHARE, damaged: int = DAMAGED, symbols: int = SYMBOLS, slices: int = SLICES) -> DataFrame:
    """``word, n, n_near, form, form_n, root``, one row per word."""
    words = stored(count_words(docs, length, least, damaged), "op12-words")
    pairs = near_pairs(words, symbols, slices)
    ends = F.array(
        F.struct("word", F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")).alias("best")),
        F.struct(F.col("other").alias("word"), F.struct((-F.col("n")).alias("n"), F.col("word")).alias("best")),
    )
    near = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    sized = words.join(growing(near), "word", "left").withColumn("is_form", -F.col("best.n") >= share * F.col("n"))
    sized = stored(
        sized.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(F.col("is_form"), F.col("best.word")).alias("form"), F.when(F.col("is_form"), -F.col("best.n")).alias("form_n")),
        "op12-forms",
    )
    # a step multiplies n by ``share`` at least, so the largest n bounds the chains; each round doubles the steps taken
    most = sized.agg(F.max("n")).first()[0] or 1
    links = sized.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for k in range(math.ceil(math.log2(max(2, math.log(max(most, 2)) / math.log(share) + 1)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(growing(onward), "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"op12-roots-{k}")
    return sized.join(growing(links), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
