"""Quality rules whose cutoffs are chosen under a risk limit (operator 6).

Six shares of a text (per mille) are compared with cutoffs. Per stratum (the
language label) half of the labelled documents proposes a row of settings, from lenient to strict:
each cuts every share at a quantile of the good documents. The other half
tests them in that order: a setting stands while the exact binomial test rejects, at the
level left after Bonferroni over the strata, that more than ``risk`` of the good documents are
turned away by any rule. Testing in a fixed order needs no further
correction. Of the settings that stand, the one with the best balance on
the proposing half is used; a stratum with too few labels has no rule beyond the base.

* null text has no words and fails the base
* a null language is a stratum of its own; labels without id or quality are ignored, a document labelled twice counts as bad if either is
* repeated rows are judged alike; ``doc_id`` is passed on, null too
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_class, inner_windows, mix64, row_chunks, stored, text_bytes, window_hashes, word_hashes, word_spans

LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
RISK, ERROR = 0.02, 0.05
#: Shares of good documents that the proposed settings cut off by each rule.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.005, 0.01)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct"]
RULES = ["symbols", "dup_lines", "repeats", "capitals", "marks", "same_words"]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values."""
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[offsets])


def counter(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, line = byte_class("space"), np.ones(256, bool)
        line[0x0A] = False
        symbol, upper, mark = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        symbol[list(b"#*$%&|<>")] = True
        upper[ord("A") : ord("Z") + 1] = True
        mark[list(b"!?;:~^=+_@\\/")] = True
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                data, offsets = text_bytes(part.column("text"))
                starts, stops, n = word_spans(data, offsets, word)
                words = word_hashes(data, starts, stops, word)
                rows = np.arange(len(part))
                salt = mix64(rows.astype(np.uint64) + np.uint64(1))
                row = np.repeat(rows, n)

                distinct = np.bincount(row[np.unique(words ^ salt[row], return_index=True)[1]], minlength=len(part))
                l0, l1, lines = word_spans(data, offsets, line)
                line_row, inside = np.repeat(rows, lines), np.concatenate(([0], np.cumsum(word[data])))
                full = inside[l1] > inside[l0]
                # a hash runs on to the next start it is given: all lines are hashed, then those with a word taken
                keys, line_row = word_hashes(data, l0, l1, line)[full], line_row[full]
                keys ^= salt[line_row]
                lines = np.bincount(line_row, minlength=len(part))
                own = np.bincount(line_row[np.unique(keys, return_index=True)[1]], minlength=len(part))

                whole, at = inner_windows(n, window)
                spots = np.flatnonzero(whole)
                _, which, times = np.unique(window_hashes(words, window)[spots] ^ salt[at[spots]], return_inverse=True, return_counts=True)
                again = spots[times[which] > 1]
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, again, 1)
                np.add.at(cover, again + window, -1)
                repeated = np.bincount(row[np.cumsum(cover)[:-1] > 0], minlength=len(part))

                letters = word[data] & ((data & 0xC0) != 0x80)
                out = [n, sums(letters, offsets), sums(symbol[data], offsets), lines - own, repeated, lines, sums(upper[data], offsets), sums(mark[data], offsets), distinct]
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(x, pa.int64()) for x in out], names=rest + COUNTS)

    return count


def measure(docs: DataFrame, window: int = 8) -> DataFrame:
    """``doc_id, stratum``, the counts of ``COUNTS``, ``base_failed`` and the ``shares`` (per mille, in the order of ``RULES``)."""
    picked = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, stratum string, " + ", ".join(f"{c} bigint" for c in COUNTS)
    out = picked.mapInArrow(counter(window), schema)
    share = lambda a, b: F.when(F.col(b) > 0, F.floor(F.least(F.lit(1000), 1000 * F.col(a) / F.col(b)))).otherwise(0).cast("int")
    same = F.when(F.col("n_words") > 0, 1000 - F.ceil(1000 * F.col("n_distinct") / F.col("n_words"))).otherwise(0).cast("int")
    shares = [share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_upper", "word_chars"), share("n_marks", "word_chars"), same]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("shares", F.array(*shares))


def tail_probability(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial distribution, exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def first_level(cuts: Column, shares: Column) -> Column:
    """Number (from 1) of the most lenient setting that turns the text away, 0 for none."""
    return F.array_position(F.transform(cuts, lambda c: F.exists(F.zip_with(c, shares, lambda a, b: b > a), lambda x: x)), True)


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, levels: tuple[float, ...] = LEVELS) -> dict[str | None, list[int]]:
    """Per stratum the cutoffs of the chosen setting; strata without a setting that stands are absent."""
    spark = measured.sparkSession
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    known = measured.where("NOT base_failed").join(labels, F.col("doc_id") == F.col("label_id")).withColumn("proposes", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)) == 0)
    known = stored(known.select("stratum", "shares", "quality", "proposes"), "op6-known")

    # proposals: quantiles of the good documents from counts per value
    bins = known.where("proposes AND quality = 1").select("stratum", F.posexplode("shares").alias("rule", "value")).groupBy("stratum", "rule", "value").count().collect()  # at most strata x rules x 1001
    held: dict = defaultdict(lambda: defaultdict(dict))
    for r in bins:
        held[r["stratum"]][r["rule"]][r["value"]] = r["count"]
    proposed = {}
    for stratum, by_rule in held.items():
        settings = []
        for level in levels:
            row = []
            for rule in range(len(RULES)):
                values, left = by_rule[rule], sum(by_rule[rule].values()) * level
                for cut in sorted(values, reverse=True):
                    left -= values[cut]
                    if left < 0:
                        break
                row.append(cut)
            settings.append(row)
        proposed[stratum] = settings
    if not proposed:
        return {}

    cuts = spark.createDataFrame([(s, c) for s, c in proposed.items()], "of string, cuts array<array<int>>")
    tested = known.join(cuts, F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", "quality", "proposes", first_level(F.col("cuts"), F.col("shares")).alias("level"))
    seen: dict = defaultdict(int)
    for r in tested.groupBy("stratum", "quality", "proposes", "level").count().collect():  # at most strata x 4 x settings
        seen[r["stratum"], r["quality"], r["proposes"], r["level"]] = r["count"]
    chosen = {}
    for stratum, settings in proposed.items():
        away = lambda quality, proposes, level: sum(seen[stratum, quality, proposes, k] for k in range(1, level + 1))  # noqa: B023,E731
        good = sum(seen[stratum, 1, False, k] for k in range(len(levels) + 1))
        best, most = None, 0
        for level in range(1, len(levels) + 1):
            if tail_probability(away(1, False, level), good, risk) > error / len(proposed):
                break
            balance = away(0, True, level) - away(1, True, level)
            if best is None or balance > most:
                best, most = level, balance
        if best is not None:
            chosen[stratum] = settings[best - 1]
    return chosen


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``broken`` (names of the rules it breaks) and ``kept``."""
    measured = stored(measure(docs), "op6-measured")
    chosen = choose_cutoffs(measured, labels, risk, error)
    cuts = measured.sparkSession.createDataFrame([(s, c) for s, c in chosen.items()], "of string, cuts array<int>")
    rules = F.array(*[F.lit(r) for r in RULES])
    broken = F.filter(F.zip_with(rules, F.zip_with("cuts", "shares", lambda a, b: b > a), lambda name, over: F.when(over, name)), lambda x: x.isNotNull())
    out = measured.join(F.broadcast(cuts), F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn("broken", F.coalesce(broken, F.expr("CAST(array() AS ARRAY<STRING>)")))
    return out.select("doc_id", *COUNTS, "base_failed", "broken", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))
