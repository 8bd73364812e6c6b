"""Quality by importance resampling (operator 8).

Two generative models over hashed character n-grams, one of the target (documents
labelled good) and one of the raw corpus (all documents). A document's
weight is the ratio of its probabilities; Gumbel noise on the log weights and the
``k`` largest keys draw a sample without replacement in proportion to the weights.

``k`` follows from the labels: the upper confidence bound of the share of good
documents, times the number of documents that have text. The counts of the raw
model and the ``k``-th key come from all documents.

* null text, or one without n-grams: log weight null, not sampled
* without good labels both models are equal and all documents with text are sampled
* equal keys at the border are all sampled, so repeated rows stay together
* null ``doc_id``: gets noise like any value
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_chunks, stored, text_bytes

GRAM = 4  # bytes
BITS = 16  # buckets of the models: 2^16
#: Bound of the labelled sample from which the target model is fitted.
TARGET_DOCS = 20_000
CONFIDENCE = 0.999
SEED = 8


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every byte, whether it lies within one row, and the number of n-grams of each row."""
    n = max(len(data) - GRAM + 1, 0)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(offsets) - 1, np.int64)
    value = np.zeros(n, np.uint32)
    for k in range(GRAM):
        value |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    whole = np.ones(n, bool)
    edges = offsets[1:-1]
    for back in range(1, GRAM):
        at = edges - back
        whole[at[(at >= 0) & (at < n)]] = False
    return ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), whole, np.maximum(np.diff(offsets) - GRAM + 1, 0)


def gram_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the whole task: a row for each bucket seen."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for first, last in row_chunks(batch.column("text")):
            part = batch.slice(first, last - first)
            data, offsets = text_bytes(part.column("text"))
            at, whole, _ = buckets(data, offsets)
            total[0] += np.bincount(at[whole], minlength=1 << BITS)
            good = np.repeat(part.column("target").to_numpy(zero_copy_only=False), np.diff(offsets))[: len(at)]
            total[1] += np.bincount(at[whole & good], minlength=1 << BITS)
    seen = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["bucket", "raw", "target"])


def weigher(ratio: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                data, offsets = text_bytes(part.column("text"))
                at, whole, n = buckets(data, offsets)
                value = np.where(whole, ratio[at], 0.0)
                sums = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64), np.zeros(GRAM)))
                edges = np.minimum(offsets, len(at))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums[edges[1:]] - sums[edges[:-1]], mask=n == 0)], names=["doc_id", "log_weight"])

    return weigh


def upper_share(good: int, n: int, confidence: float) -> float:
    """Upper confidence bound of a share (Wilson's interval)."""
    if not n:
        return 1.0
    z = math.sqrt(2) * _inverse_erf(2 * confidence - 1)
    p = good / n
    return min(1.0, (p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def _inverse_erf(y: float) -> float:
    lo, hi = 0.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return lo


def kth_largest(keys: DataFrame, k: int, column: str = "key", bins: int = 4096, few: int = 20_000) -> float | None:
    """The ``k``-th largest value of a column, by counting in ever narrower bins; null values do not count."""
    keys = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    low, high, n = keys.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        if n <= few:
            return sorted((r["v"] for r in keys.where(F.col("v").between(low, high)).collect()), reverse=True)[k - 1]
        width = (high - low) / bins
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        inside = keys.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()  # at most ``bins``
        for r in sorted(inside, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    return low


def log_ratio(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, with one added to every count in proportion to the raw model."""
    raw = counts[0] + 1.0
    p_raw = raw / raw.sum()
    target = counts[1] + p_raw * len(p_raw)
    return np.log(target / target.sum()) - np.log(p_raw)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, target_docs: int = TARGET_DOCS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``doc_id, log_weight, key, sampled``. ``share``: of the documents with text, how many to sample."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    good, n = labels.agg(F.sum((F.col("quality") == 1).cast("int")), F.count("*")).first()
    good = good or 0
    part = 1.0 if not good else min(1.0, target_docs / good)
    chosen = labels.where((F.col("quality") == 1) & (F.pmod(F.xxhash64("label_id", F.lit(seed)), F.lit(1_000_000)) < int(part * 1_000_000))).select("label_id")
    marked = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"), "left").select("text", F.col("label_id").isNotNull().alias("target"))
    sums = marked.mapInArrow(gram_counter, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most 2^BITS
    counts = np.zeros((2, 1 << BITS))
    for r in sums:
        counts[:, r["bucket"]] = r["raw"], r["target"]
    if not counts[1].any():
        counts[1] = counts[0]
    ratio = log_ratio(counts).astype(np.float32)

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.mapInArrow(weigher(ratio), f"doc_id {kind}, log_weight double")
    u = (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = stored(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "op8-weights")
    share = upper_share(good, n, CONFIDENCE) if share is None else share
    if not good:
        share = 1.0
    limit = kth_largest(weighed, math.ceil(share * weighed.where("key IS NOT NULL").count()))
    return weighed.withColumn("sampled", F.coalesce(F.col("key") >= F.lit(limit), F.lit(False)) if limit is not None else F.lit(False))
