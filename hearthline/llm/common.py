"""Helpers shared by the operators: stored tables and hashing of words inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hearthline.session import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Text bytes that one step of the vectorised code handles at a time.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    """Shuffle files of the statements run inside go as soon as the statement has ended."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str = "snappy", dictionary: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors. Without ``dictionary`` columns of
    values that hardly repeat are written as they are."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with shuffle_files_removed(spark):
        df.write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once everything read from it is written itself."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null reads as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def without_texts(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose text has its ``key`` in ``gone``. Only the keys are written, before the join, so the planner sees how few they are."""
    gone = stored(gone.select("key").distinct(), name)
    return docs.join(gone, text_key(docs["text"]) == gone["key"], "left_anti")


def byte_class(members: str) -> np.ndarray:
    """Table of 256 booleans: which bytes belong to a word. ``members``: ``space`` (all but blanks and controls
    from tab to carriage return) or ``alnum`` (ASCII letters, digits and every byte of other characters)."""
    out = np.ones(256, dtype=bool)
    if members == "space":
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif members == "alnum":
        out[:0x80] = False
        for first, last in (("0", "9"), ("A", "Z"), ("a", "z")):
            out[ord(first) : ord(last) + 1] = True
    else:
        raise ValueError(members)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of the public splitmix64 generator)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n] if n else out[:0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null reads as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text; a longer row stands alone."""
    _, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each row."""
    return mask_spans(member[data], offsets)


def mask_spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_spans``; ``mask`` tells of each byte whether it belongs to a word."""
    inside = np.zeros(len(mask) + 2, dtype=bool)
    inside[1:-1] = mask
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(mask))]
    begins[edges] = inside[1:-1][edges]  # a word does not run on into the next row
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, stops, counts


def strings_at(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array, without a Python object for any of them."""
    sizes = stops - starts
    at = np.concatenate([[0], np.cumsum(sizes)])
    picked = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], sizes)] if len(sizes) else data[:0]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(picked)))


def lower_ascii() -> np.ndarray:
    """Table of 256 bytes that folds A-Z."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, member: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit polynomial hash of every word; ``fold`` maps bytes first (lower case, say).

    Works through the bytes in steps, so a very long row needs no more
    memory than its own bytes and 8 bytes for each word.
    """
    weight = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    weight = weight if fold is None else weight[fold]
    base = 0x9E3779B97F4A7C15
    out = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(stops, starts[first] + CHUNK_BYTES, side="right")))
        lo, hi = starts[first], stops[last - 1]
        piece, s, n = data[lo:hi], starts[first:last] - lo, stops[first:last] - starts[first:last]
        at = np.arange(len(piece)) - np.repeat(s, np.diff(np.append(s, len(piece))))
        value = weight[piece] * powers(base, int(at.max()) + 1)[at]
        value[~member[piece]] = 0
        out[first:last] = np.add.reduceat(value, s) + n.astype(np.uint64)
        first = last
    return mix64(out)


def window_hashes(words: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` words, from differences of prefix sums modulo 2^64.

    ``base`` is odd, so a power of it can be divided out again.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, step = np.empty(n, np.uint64), 1 << 18
    up, down = powers(base, min(len(words), step + size - 1)), powers(pow(base, -1, 1 << 64), min(n, step))
    for first in range(0, n, step):
        piece = words[first : first + step + size - 1]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        m = len(piece) - size + 1
        out[first : first + m] = (sums[size:] - sums[:m]) * down[:m]
    return mix64(out)


def inner_windows(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows over the concatenated words of several rows: which lie within one row, and of which row."""
    row = np.repeat(np.arange(len(counts)), counts)
    n = len(row) - size + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.int64)
    return row[:n] == row[size - 1 :], row[:n]
