"""Language identification (operator 7).

One interpolated Kneser-Ney character model for each language, over the
letters of a word and its two borders. The models are learnt from a bounded
sample of labelled documents, every one of them counted by Spark, and kept as arrays sorted by
n-gram hash: for every n-gram known to any language the discounted
probability and, for every context, the weight of the shorter context, one column per
language. A text is scored word by word (each distinct word of a batch once);
its language is the one with the lowest cross-entropy per character.

A prediction is rejected if the cross-entropy of the best language is above
what labelled texts of that language and like length reach: the limit is an order
statistic over all labelled texts. Those of the sample are scored fold by fold with the counts
of the other folds, all others with the whole model, in the one pass that also predicts them. A length class with too few texts for its order
statistic takes in its neighbours; should all texts together be too few, the limit lies above the largest value.

* null text, or no letter: ``und``, score 0, rejected
* empty table or no labelled text: every prediction is ``und``
* every labelled language with a letter has a model, however few or long its texts; one of a single text has no limit of its own: only what is
  worse than a uniform alphabet is rejected
* letters no language knows get the uniform share of the alphabet
* repeated rows are predicted alike; ``doc_id`` is passed on, null too
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructType

from .common import mix64, row_chunks, stored, text_key, without_texts

ORDER = 4
#: Bound of the labelled sample: documents of each language (about; drawn by hash).
SAMPLE_DOCS = 3000
FOLDS = 3
DISCOUNT = 0.75
#: Of the texts of a language, the share that its rejection limit may turn away.
REJECT = 0.001
#: Lower bound of letters for each class of text length.
LENGTHS = (1, 4, 8, 16, 32, 64, 128, 512)
#: Steps of a bit in which the cross-entropies of all labelled texts are counted (rounded up).
STEPS = 1024
LEAST_SCALE = 0.1  # bits; least scale of the tail that a limit above the largest value assumes
BORDER = 1  # code for the place before and after a word


def letters_of(texts: list[str | None], letter: np.ndarray):
    """Lower-cased code points of all texts: per word its start and length, per text the number of words."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = letter[code] > 0
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    stops = np.flatnonzero(inside[:-1] & ~inside[1:])
    lengths = np.array([len(t) for t in low], np.int64)
    edges = np.concatenate(([0], np.cumsum(lengths + 1)))
    counts = np.diff(np.searchsorted(starts, edges))
    return code, starts, stops - starts, counts


def letter_table() -> np.ndarray:
    """Kind of each code point: 2 for letters, 1 for marks that belong to letters, else 0."""
    import unicodedata

    kinds = {"L": 2, "M": 1}
    return np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.int8, 0x110000)


def distinct_words(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Index of a first occurrence of each distinct word, and for every word which of them it is."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(starts, sizes) + at
    weight = np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64)
    weight[0] = 1
    value = mix64(code[place].astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) * np.cumprod(weight)[at]
    key = mix64(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first, which


def grams_of_words(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int):
    """For every predicted place of the words (each letter, then the end): hashes of its n-grams of length 1 to ``order`` (0 where the
    word has no so long context) and the word it belongs to. A context starts at the border before the word."""
    n = sizes + 1
    word = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.full(len(word) + len(sizes), BORDER, np.uint64)  # border, letters, and the next word's border as the end
    first = np.cumsum(n) - n + np.arange(len(sizes))
    index = np.repeat(first, n) + at + 1
    inner = at < sizes[word]
    padded[index[inner]] = code[starts[word[inner]] + at[inner]].astype(np.uint64) + np.uint64(2)
    ends = ~inner
    spread = mix64(padded + np.uint64(0x2545F4914F6CDD1D))
    end_value = mix64(np.array([0x1F], np.uint64))[0]
    hashes = np.zeros((order, len(word)), np.uint64)
    last = np.where(ends, end_value, spread[index])
    context = np.zeros(len(word), np.uint64)
    contexts = np.zeros((order, len(word)), np.uint64)
    for length in range(1, order + 1):
        if length > 1:
            back = index - (length - 1)
            has = at + 1 >= length - 1
            context = np.where(has, mix64(context * np.uint64(31) + spread[np.maximum(back, 0)] + np.uint64(length)), 0)
        else:
            has = np.ones(len(word), bool)
            context = np.full(len(word), 7, np.uint64)
        contexts[length - 1] = np.where(has, context, 0)
        hashes[length - 1] = np.where(has, mix64(context ^ (last * np.uint64(0x9E3779B97F4A7C15))), 0)
    return hashes, contexts, word


def gram_counter(order: int):
    """Labelled texts -> counts of the n-grams of full length or at the start of a word (``lang, n, gram, context, shorter, shorter_context, k``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letter_table()
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    code, starts, sizes, _ = letters_of([t for t, own in zip(texts, langs) if own == lang], letter)
                    if not len(starts):
                        continue
                    firsts, which = distinct_words(code, starts, sizes)
                    times = np.bincount(which)
                    hashes, contexts, word = grams_of_words(code, starts[firsts], sizes[firsts], order)
                    for n in range(1, order + 1):
                        has = hashes[n - 1] != 0
                        # a longer n-gram tells what stands before a shorter one; only the longest at a place is counted itself
                        longest = has & ((hashes[n] == 0) if n < order else True)
                        if not longest.any():
                            continue
                        grams, at, of = np.unique(hashes[n - 1][longest], return_index=True, return_inverse=True)
                        place = np.flatnonzero(longest)[at]
                        k = np.bincount(of, weights=times[word[longest]]).astype(np.int64)
                        columns = [np.ascontiguousarray(hashes[m - 1][place]).view(np.int64) for m in range(1, order + 1)] + [np.ascontiguousarray(contexts[m - 1][place]).view(np.int64) for m in range(1, order + 1)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), n, np.int32)), pa.array(k), *[pa.array(c) for c in columns]],
                            names=["lang", "n", "k", *[f"g{m}" for m in range(1, order + 1)], *[f"c{m}" for m in range(1, order + 1)]],
                        )

    return count


def gram_types(counted: DataFrame, order: int, counts: list[str]) -> list[DataFrame]:
    """Per n-gram length the types with their Kneser-Ney counts: occurrences for the longest n-grams and those at the start of a word, else
    the number of different characters before. ``counts`` names the columns of occurrences, in the whole sample and without each fold."""
    levels = [None] * order
    above = None
    for n in range(order, 0, -1):
        rest = [f"{x}{m}" for m in range(1, n + 1) for x in "gc"]
        own = counted.where(F.col("n") == n).groupBy("lang", *rest).agg(*[F.sum(c).alias(c) for c in counts])
        if above is not None:
            own = own.union(above.groupBy("lang", *rest).agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in counts]))
        levels[n - 1] = above = own
    return levels


class Model:
    """Sorted hash arrays of all languages together."""

    def __init__(self, langs: list[str], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], alphabet: int):
        """``levels``: per n-gram length the arrays language number, n-gram, context, count."""
        self.langs, self.uniform, self.levels = langs, 1.0 / max(alphabet, 2), []
        for lang, gram, context, k in levels:
            grams, contexts = np.unique(gram), np.unique(context)
            total, types, share = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs))), np.zeros((len(grams), len(langs)), np.float32)
            at = np.searchsorted(contexts, context)
            np.add.at(total, (at, lang), k)
            np.add.at(types, (at, lang), 1)
            share[np.searchsorted(grams, gram), lang] = (k - DISCOUNT) / total[at, lang]
            left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0).astype(np.float32)
            self.levels.append((grams, share, contexts, left))


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = default
    return out


def cross_entropies(model: Model, texts: list[str | None], letter: np.ndarray):
    """Bits per character of each text under each language, and the number of letters of each text."""
    code, starts, sizes, counts = letters_of(texts, letter)
    first, which = distinct_words(code, starts, sizes)
    hashes, contexts, word = grams_of_words(code, starts[first], sizes[first], len(model.levels))
    p = np.full((len(word), len(model.langs)), model.uniform, np.float32)
    for n, (grams, share, known, left) in enumerate(model.levels):
        has = hashes[n] != 0
        lower = look_up(known, left, contexts[n], 1.0) * p
        p = np.where(has[:, None], look_up(grams, share, hashes[n], 0.0) + lower, p)
    bits = -np.log2(p.astype(np.float64))
    of_word = np.zeros((len(first), len(model.langs)))
    if len(first):
        of_word = np.add.reduceat(bits, np.flatnonzero(np.diff(word, prepend=-1)), axis=0)
    sums = np.concatenate([np.zeros((1, len(model.langs))), np.cumsum(of_word[which], axis=0)])
    chars = np.concatenate(([0], np.cumsum(sizes)))
    edges = np.concatenate(([0], np.cumsum(counts)))
    letters = np.diff(chars[edges])
    # a text of marks only has no letter
    real = np.concatenate(([0], np.cumsum(letter[code] == 2)))
    of_words = np.concatenate(([0], np.cumsum(real[starts + sizes] - real[starts])))
    letters[np.diff(of_words[edges]) == 0] = 0
    places = letters + counts  # the end of a word is predicted too
    return np.diff(sums[edges], axis=0) / np.maximum(places, 1)[:, None], letters


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(LENGTHS), letters, side="right") - 1


def predictor(model: Model, limits: dict, sharpness: float, detail: bool, keep_text: bool):
    """Adds ``lang_pred, score, entropy, letters, rejected`` (``detail``: and all cross-entropies) to the columns, of which ``text`` may go."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter, mean, bound = letter_table(), np.array([limits["mean"].get(x, 0.0) for x in model.langs]), np.array(limits["bound"])
        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                n = len(part)
                rest = [c for c in part.schema.names if c != "text" or keep_text]
                if not model.langs:
                    added = [pa.array(["und"] * n), pa.array(np.zeros(n)), pa.array([None] * n, pa.float64()), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool))]
                    entropy = np.zeros((n, 0))
                else:
                    entropy, letters = cross_entropies(model, part.column("text").to_pylist(), letter)
                    best, none = entropy.argmin(axis=1), letters == 0
                    least = entropy[np.arange(n), best]
                    score = 1 / np.exp2(-sharpness * (entropy - least[:, None]) * np.minimum(letters, 64)[:, None]).sum(axis=1)
                    rejected = none | (least - mean[best] > bound[np.maximum(length_class(letters), 0)]) | (least > -math.log2(model.uniform))
                    pred = [model.langs[b] if not empty else "und" for b, empty in zip(best, none)]
                    added = [pa.array(pred), pa.array(np.where(none, 0.0, score)), pa.array(np.where(none, np.nan, least), mask=none), pa.array(letters), pa.array(rejected)]
                names = rest + ["lang_pred", "score", "entropy", "letters", "rejected"]
                added = [part.column(c) for c in rest] + added
                if detail:
                    added.append(pa.array(entropy.tolist(), pa.list_(pa.float64())))
                    names.append("entropies")
                yield pa.RecordBatch.from_arrays(added, names=names)

    return predict


def apply_model(docs: DataFrame, model: Model, limits: dict, sharpness: float, detail: bool = False, keep_text: bool | None = None) -> DataFrame:
    keep_text = not detail if keep_text is None else keep_text
    schema = StructType([f for f in docs.schema.fields if f.name != "text" or keep_text]).add("lang_pred", StringType()).add("score", DoubleType()).add("entropy", DoubleType())
    schema = schema.add("letters", LongType()).add("rejected", BooleanType())
    if detail:
        schema = schema.add("entropies", ArrayType(DoubleType()))
    return docs.mapInArrow(predictor(model, limits, sharpness, detail, keep_text), schema)


def length_kind() -> Column:
    """``length_class`` of the column ``letters``."""
    return sum((F.when(F.col("letters") >= least, 1).otherwise(0) for least in LENGTHS[1:]), F.lit(0))


def is_rejected(model: Model, limits: dict) -> Column:
    """What ``predictor`` says of a row, from its columns ``lang_pred, entropy, letters``."""
    mean = F.lit(0.0)
    if limits["mean"]:
        mean = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(limits["mean"].items()) for x in pair]), F.col("lang_pred")), mean)
    bound = F.get(F.array(*[F.lit(float(b)) for b in limits["bound"]]), length_kind())
    return F.col("entropy").isNull() | (F.col("entropy") - mean > bound) | (F.col("entropy") > -math.log2(model.uniform))


NO_LIMITS = {"mean": {}, "bound": [float("inf")] * len(LENGTHS)}


def rejection_bounds(bins: list[tuple[int, int, int]], reject: float) -> list[float]:
    """Limit of each length class from counted values ``(class, step, count)``: what is above the mean of its language, in ``STEPS`` of a bit.

    A class with too few values takes in the next ones on both sides. The spread shrinks with the square root of the length at most: values of
    longer texts are scaled up accordingly, those of shorter ones count as they are. Where all are too few an exponential
    tail goes on from the largest value to the wanted share.
    """
    need, bounds = math.ceil(1 / reject) - 1, []
    for k in range(len(LENGTHS)):
        for reach in range(len(LENGTHS)):
            pool = [(step / STEPS * (math.sqrt(LENGTHS[c] / LENGTHS[k]) if c > k and step > 0 else 1.0), n) for c, step, n in bins if abs(c - k) <= reach]
            if sum(n for _, n in pool) >= need:
                break
        if not pool:
            return [float("inf")] * len(LENGTHS)  # no text tells anything: only the uniform alphabet limits
        values, times = (np.array(x) for x in zip(*sorted(pool)))
        upto, total = np.cumsum(times), int(times.sum())
        rank = math.ceil((total + 1) * (1 - reject))
        if rank <= total:
            bounds.append(float(values[np.searchsorted(upto, rank)]))
        else:
            middle = values[np.searchsorted(upto, (total + 1) // 2)]
            upper = values >= middle
            scale = max(LEAST_SCALE, float(np.average(values[upper] - middle, weights=times[upper])))
            bounds.append(float(values[-1]) + scale * math.log(1 / reject / (total + 1)))
    return bounds


@dataclass(frozen=True)
class Learnt:
    """The whole model, the sharpness of its score, which labelled rows it has not seen (a condition on ``doc_id, text, lang``, strings all), and
    the texts of the sample as the models without their fold see them (None if these tell nothing)."""

    model: Model
    sharpness: float
    unseen: Column
    seen: DataFrame | None


def labelled() -> Column:
    return F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")


def learn(docs: DataFrame, order: int, sample_docs: int) -> Learnt:
    """From labelled rows of ``docs`` (``doc_id, text, lang``)."""
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    docs = docs.where(labelled()).select("lang", "text", hashed.alias("draw"))
    found = docs.groupBy("lang").agg(F.count("*").alias("n"), F.min("draw").alias("least")).collect()  # one row for each language
    if not found:
        return Learnt(Model([], [], 0), 1.0, F.lit(False), None)
    # the smallest draw is in, so no language is left out
    share = F.create_map(*[F.lit(x) for r in sorted(found) for x in (r["lang"], max(int(min(1.0, sample_docs / r["n"]) * 1_000_000), r["least"] + 1))])
    in_sample = lambda draw: draw < F.try_element_at(share, F.col("lang"))
    unseen = F.coalesce(labelled() & ~in_sample(hashed), F.lit(False))
    # copies of a text are in one fold; a language of two texts has two folds
    fold = F.dense_rank().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"))) % FOLDS
    drawn = stored(docs.where(in_sample(F.col("draw"))).select("lang", "text", fold.alias("fold")), "op7-sample")
    names = [f"g{m}" for m in range(1, order + 1)] + [f"c{m}" for m in range(1, order + 1)]
    counted = drawn.select(F.concat(F.col("fold").cast("string"), "lang").alias("lang"), "text").mapInArrow(gram_counter(order), "lang string, n int, k bigint, " + ", ".join(f"{c} bigint" for c in names))
    counted = counted.withColumn("fold", F.substring("lang", 1, 1).cast("int")).withColumn("lang", F.expr("substring(lang, 2)"))
    without = [F.sum(F.when(F.col("fold") != f, F.col("k")).otherwise(0)).alias(f"k{f}") for f in range(FOLDS)]
    counted = stored(counted.groupBy("lang", "n", *names).agg(F.sum("k").alias("k"), *without), "op7-grams")
    langs, kinds = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()], ["k", *[f"k{f}" for f in range(FOLDS)]]
    number, types, alphabet = {x: k for k, x in enumerate(langs)}, [], 0
    for n, level in enumerate(gram_types(counted, order, kinds), 1):
        got = level.select("lang", F.col(f"g{n}").alias("g"), F.col(f"c{n}").alias("c"), *kinds).toArrow()  # bounded by the sample
        lang = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
        gram, context = (np.asarray(got.column(c).to_numpy()).astype(np.int64).view(np.uint64) for c in ("g", "c"))
        types.append((lang, gram, context, {c: got.column(c).to_numpy().astype(np.float64) for c in kinds}))
        alphabet = alphabet or len(np.unique(gram)) + 1

    def model_of(kind: str) -> Model:
        own = np.unique(types[0][0][types[0][3][kind] > 0])
        there = [k[kind] > 0 for _, _, _, k in types]
        return Model([langs[k] for k in own], [(np.searchsorted(own, lang[x]), gram[x], context[x], k[kind][x]) for (lang, gram, context, k), x in zip(types, there)], alphabet)

    model, part_models = model_of("k"), [model_of(f"k{f}") for f in range(FOLDS)]
    # a text whose language only its own fold holds tells nothing
    seen = [apply_model(drawn.where((F.col("fold") == f) & F.col("lang").isin(m.langs)), m, NO_LIMITS, 1.0, detail=True) for f, m in enumerate(part_models) if m.langs]
    if not seen:
        return Learnt(model, 1.0, unseen, None)
    seen = stored(reduce(DataFrame.union, seen).where("letters > 0"), "op7-seen")
    sharpness, lowest = 1.0, float("inf")
    sample = seen.select("lang", "fold", "letters", "entropies").toArrow().to_pydict()  # bounded by the sample
    fold, letters = np.array(sample["fold"], np.int64), np.array(sample["letters"], np.int64)
    for tried in (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0) if len(fold) else ():
        loss = 0.0
        for f, m in enumerate(part_models):
            rows = np.flatnonzero(fold == f)
            if not len(rows):
                continue
            truth = np.array([m.langs.index(sample["lang"][r]) for r in rows])
            logit = -tried * np.array([sample["entropies"][r] for r in rows]) * np.minimum(letters[rows], 64)[:, None]
            logit -= logit.max(axis=1, keepdims=True)
            loss += float((np.log2(np.exp2(logit).sum(axis=1)) - logit[np.arange(len(rows)), truth]).sum())
        if loss < lowest:
            sharpness, lowest = tried, loss
    return Learnt(model, sharpness, unseen, seen)


def limits_of(learnt: Learnt, others: DataFrame, reject: float = REJECT) -> dict:
    """Rejection limits from the sample and from ``others``, the predictions of all labelled rows that the model has not seen."""
    if learnt.seen is None:
        return {"mean": {}, "bound": [float("inf")] * len(LENGTHS)}
    columns, bounds = ["lang_pred", "entropy", "letters"], [float("inf")] * len(LENGTHS)
    measured = learnt.seen.select(*columns).union(others.where("letters > 0").select(*columns))
    mean = {r["lang_pred"]: r["mean"] for r in measured.groupBy("lang_pred").agg(F.avg("entropy").alias("mean")).collect()}
    if mean:
        means = F.create_map(*[F.lit(x) for pair in sorted(mean.items()) for x in pair])
        over = F.ceil((F.col("entropy") - F.element_at(means, F.col("lang_pred"))) * STEPS)
        bins = measured.groupBy(length_kind().alias("kind"), over.alias("step")).agg(F.count("*").alias("n")).collect()  # at most classes x steps of some 20 bits
        bounds = rejection_bounds([(r["kind"], r["step"], r["n"]) for r in bins], reject)
    return {"mean": {x: mean.get(x, -math.log2(learnt.model.uniform)) for x in learnt.model.langs}, "bound": bounds}


def text_columns() -> list[Column]:
    return [F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")]


def train(docs: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, reject: float = REJECT) -> tuple[Model, dict, float]:
    """Model, rejection limits and the sharpness of the score, from labelled rows of ``docs`` (``doc_id, text, lang``)."""
    docs = docs.select(*text_columns())
    learnt = learn(docs, order, sample_docs)
    others = stored(apply_model(docs.where(learnt.unseen).select("text"), learnt.model, NO_LIMITS, learnt.sharpness, keep_text=False), "op7-measured")
    return learnt.model, limits_of(learnt, others, reject), learnt.sharpness


def identify(docs: DataFrame, carry: list[str] = (), keep_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, text, lang_pred, score, entropy, letters, rejected`` and ``kept``, a struct of the columns named in
    ``carry``; without ``keep_text`` no ``text``. Rows whose ``crc32(doc_id) mod 4`` is 2 are never learnt from.

    Every text is predicted once, by the whole model; the rejection limits come out of these predictions and are held against them."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    held_out = F.coalesce(fold == 2, F.lit(False))
    learnt = learn(docs.where(~held_out).select(*text_columns()), ORDER, SAMPLE_DOCS)
    named = docs.select(F.col("doc_id").alias("own_id"), held_out.alias("held_out"), *text_columns(), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept")] if carry else []))
    picked = named.select(F.col("own_id").alias("doc_id"), "held_out", "text", *(["kept"] if carry else []), (learnt.unseen & ~F.col("held_out")).alias("unseen"))
    scored = stored(apply_model(picked, learnt.model, NO_LIMITS, learnt.sharpness, keep_text=keep_text), "op7-scored")
    limits = limits_of(learnt, scored.where("unseen"))
    return scored.withColumn("rejected", is_rejected(learnt.model, limits)).drop("unseen")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected. The text alone decides, so keys of texts are written and no documents."""
    found = identify(docs.select("doc_id", "text", "lang", text_key(F.col("text")).alias("key")), ["key"], keep_text=False)
    return without_texts(docs, found.where("rejected").select("kept.key"), "op7-rejected")
