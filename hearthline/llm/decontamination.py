"""Finding and removing benchmark passages in training text (operator 3). DataFrame functions only.

Words are runs of ASCII letters (folded to lower case), digits and characters
beyond ASCII. A pass over the documents hashes every run of words and looks it
up in the broadcast hash set of the benchmark's windows, 64 bits for each. Only what is
found goes on with its words, and is compared with the benchmark word by word in a
join on the hash. The hash set of a broadcast has a bounded number of windows; a
larger benchmark is looked up slice by slice, over documents that are numbered and written once.

* null text has no words, and an empty document has no hit
* an item of fewer words than a window is one window; an item without words has none
* null ``item_id`` counts as an item and is left out of the digest; repeated items count once
* repeated rows of ``docs`` are judged one by one; every column is kept apart from the results
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_key, without_texts

WINDOW = 10
#: Windows of the benchmark in one broadcast hash set (some 50 bytes each in memory).
SLICE_WINDOWS = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")


def with_run_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``r1, r2, r4, ..``: hashes of the runs of so many words from each word of ``words`` on (the last ones run over the end)."""
    df = df.withColumn("r1", F.transform("words", lambda w: F.xxhash64(w)))
    size = 1
    while size * 2 <= max(lengths, default=1):
        one = F.col(f"r{size}")
        df = df.withColumn(f"r{size * 2}", F.zip_with(one, F.slice(one, F.lit(size + 1), F.greatest(F.col("n") - size, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return df


def windows_of_length(length: int) -> Column:
    """Hash of every run of ``length`` words, put together from runs whose lengths are powers of two."""
    count = F.greatest(F.col("n") - (length - 1), F.lit(0)).cast("int")
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    at, out = 0, None
    for part in parts:
        run = F.slice(F.col(f"r{part}"), F.lit(at + 1), count)
        out = F.transform(run, lambda a: F.xxhash64(F.lit(length), a)) if out is None else F.zip_with(out, run, lambda a, b: F.xxhash64(a, b))
        at += part
    return out


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``win`` (words), ``length`` and the sorted ``items`` with that window; once per sequence of words."""
    items = benchmark.select(F.col("item_id").cast("string"), words(F.col("text").cast("string")).alias("w")).withColumn("m", F.least(F.size("w"), F.lit(window))).where("m > 0")
    starts = F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("m")))).alias("win"))
    # a struct counts null ids too
    return each.groupBy("win").agg(F.array_sort(F.collect_set(F.struct("item_id"))).alias("items")).withColumn("length", F.size("win"))


def hashed_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, dict[int, int]]:
    """``hash, win, length, items`` of every window, and how many there are of each length."""
    tests = stored(benchmark_windows(benchmark, window), "op3-windows")
    counted = {r.length: r["count"] for r in tests.groupBy("length").count().collect()}  # at most ``window`` lengths
    lengths = sorted(counted, reverse=True)
    tests = with_run_hashes(tests.withColumnRenamed("win", "words").withColumn("n", F.col("length")), lengths)
    key = reduce(lambda a, n: F.when(F.col("length") == n, F.get(windows_of_length(n), F.lit(0))).otherwise(a), lengths, F.lit(None).cast("bigint"))
    return tests.select(key.alias("hash"), F.col("words").alias("win"), "length", "items"), counted


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, carry: list[str] = (), slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, ``spans`` (first word, end word)
    and ``kept`` (a struct of the columns named in ``carry``)."""
    tests, counted = hashed_windows(benchmark, window)
    lengths = sorted(counted, reverse=True)
    slices = max(1, math.ceil(sum(counted.values()) / slice_windows))

    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0).alias("none")]).alias("kept"))
    if slices > 1:
        base = stored(base, "op3-numbered")
    base = base.withColumn("words", words(F.col("text"))).drop("text")
    base = with_run_hashes(base.withColumn("n", F.size("words")), lengths)
    # the element before the windows stands for the row itself
    every = F.concat(F.array(F.lit(None).cast("bigint")), *[windows_of_length(n) for n in lengths])
    runs = base.select("row", "doc_id", "n", "words", "kept", F.posexplode(every).alias("p", "hash"))
    ahead, offset, size = F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")
    for n in lengths:
        # places ahead .. of the array hold the windows of n words
        size = F.when(F.col("p") >= ahead, n).otherwise(size)
        offset = F.when(F.col("p") >= ahead, ahead).otherwise(offset)
        ahead = ahead + F.greatest(F.col("n") - (n - 1), F.lit(0))
    itself, first = F.col("p") == 0, F.col("p") - offset
    scanned = []
    for k in range(slices):
        keys = tests.select("hash") if slices == 1 else tests.select("hash").where(F.pmod("hash", F.lit(slices)) == k)
        found = runs.join(F.broadcast(keys.distinct().withColumn("known", F.lit(True))), "hash", "left").where(F.coalesce("known", F.lit(False)) | (itself if k == 0 else F.lit(False)))
        found = found.select(
            "row", F.when(itself, F.col("doc_id")).alias("doc_id"), F.when(itself, F.col("n")).alias("n"), F.when(itself, F.col("kept")).alias("kept"),
            F.when(~itself, F.col("hash")).alias("hash"), F.when(~itself, first).alias("first"), F.when(~itself, F.slice("words", first + 1, size)).alias("run"),
        )
        scanned.append(stored(found, f"op3-scan-{k}"))
    scanned = reduce(DataFrame.union, scanned)
    # rows that stand for documents take no part in the comparison, so no key of theirs meets
    hits = scanned.where("hash IS NOT NULL").select("row", "hash", "first", "run").join(tests, "hash").where("run = win")
    hits = hits.select("row", F.struct(F.col("first"), (F.col("first") + F.col("length")).alias("end")).alias("span"), "items")
    nothing = lambda name: F.lit(None).cast(hits.schema[name].dataType).alias(name)
    rows = scanned.where("hash IS NULL").select("row", "doc_id", "n", "kept", nothing("span"), nothing("items"))
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("doc_id", "n", "kept")]
    found = rows.union(hits.select("row", *empty, "span", "items"))
    per_doc = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n").cast("bigint").alias("n_words"), F.first("kept", ignorenulls=True).alias("kept"),
        F.array_sort(F.collect_list("span")).alias("windows"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    merged = F.aggregate(
        "windows",
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach"), F.expr("CAST(array() AS ARRAY<STRUCT<first: INT, end: INT>>)").alias("spans")),
        lambda a, x: F.when(x["end"] <= a["reach"], a).otherwise(
            F.struct(
                (a["total"] + x["end"] - F.greatest(x["first"], a["reach"])).alias("total"), x["end"].alias("reach"),
                F.concat(a["spans"], F.array(F.struct(F.greatest(x["first"], a["reach"]).alias("first"), x["end"].alias("end")))).alias("spans"),
            )
        ),
    )
    per_doc = per_doc.withColumn("merged", merged)
    ids = F.array_sort(F.filter(F.transform("items", lambda i: i["item_id"]), lambda i: i.isNotNull()))
    return per_doc.select(
        "doc_id", "n_words", F.col("merged.total").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (F.col("merged.total") > 0).alias("contaminated"), F.col("merged.spans").alias("spans"), "kept",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove='spans'``) with the hit words and what stands before each of them taken out."""
    if remove == "documents":
        # the text alone decides, so keys of texts are written and shuffled and no documents
        found = find_hits(docs.select("doc_id", "text", text_key(F.col("text")).alias("key")), benchmark, window, carry=["key"])
        return without_texts(docs, found.where("contaminated").select("kept.key"), "op3-contaminated")
    found = find_hits(docs, benchmark, window, carry=docs.columns)
    if remove != "spans":
        raise ValueError(remove)
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    text = F.col("kept.text").cast("string")
    pieces = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.col("n_words").cast("int")), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, word: F.concat(gap, word)
    )
    stays = F.filter(pieces, lambda x, i: ~F.exists("spans", lambda s: (i >= s["first"]) & (i < s["end"])))
    tail = F.element_at(F.split(text, pattern, -1), -1)
    clean = F.when(F.col("contaminated"), F.concat(F.array_join(stays, ""), tail)).otherwise(text)
    return found.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == "text" else F.col(f"kept.`{c}`") for c in docs.columns])
