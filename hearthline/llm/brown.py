"""Scores by a class-based bigram model (operator 13).

Texts are cut into chunks of bounded size and stored once as numbers into the
chunk's own dictionary. Everything the model needs is counted from these chunks over the whole
training part: words by sums over the dictionaries, and per round of the exchange
clustering how often each word stands before and after each class. A round
lets every second word (by hash) move to the class that raises the likelihood of
the class bigrams most; the words start in the class of their ending. The
classes with the best likelihood are used. Between rounds a word's class is
a row of a table that is joined to the dictionaries of the chunks, so nothing
that grows with the corpus is broadcast or gathered; the driver sees one
matrix of classes by classes. Words are told apart by 64-bit hashes.

A token's probability is that of its class after the class before
(interpolated with the classes' own shares) times the word's share of its class. All words that
the training part does not have are one word in a class of its own, with the mass of the words seen once. The end of
a text is a word and a class of its own and stands before its first token.

* null and empty text: one token, the end; null ``doc_id`` reads as '' where the id is hashed
* repeated rows and ids: each row is counted and scored
* empty table: an empty result. No training row: every token is unknown and has probability 1 in the base model
* very long texts are scored whole, in a chunk of their own; extra columns are not read
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_class, discard, lower_ascii, mask_spans, mix64, row_chunks, stored, strings_at, text_bytes, word_hashes

CLASSES, ROUNDS = 32, 4
HELD_OUT = 10  # one document in so many is scored only
CHUNK_TEXT = 12_000_000
BASE_ADD = 0.1
#: Packs counts with the slot they belong to; above the number of pairs of classes.
SLOTS = 1 << 14
#: Words that the exchange looks at in one step.
ROWS = 4096
#: Weight of the classes' own shares, in counts, when a class follows another.
BACK_OFF = 8.0


def coder(doc_type: pa.DataType, classes: int):
    """Texts -> one row per chunk: its rows, the words of the chunk (hash, class at the start, count in training rows) and the tokens as
    places in that list; the place after the last word is the end of a text."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, member = lower_ascii(), byte_class("space")
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, last in row_chunks(batch.column("text"), CHUNK_TEXT):
                part = batch.slice(first, last - first)
                data, offsets = text_bytes(part.column("text"))
                data = lower[data]
                starts, stops, per_row = mask_spans(member[data], offsets)
                words = strings_at(data, starts, stops).dictionary_encode()
                held = np.array([zlib.crc32((i or "").encode()) % HELD_OUT == 0 for i in part.column("id").to_pylist()])
                sizes = per_row + 1
                ends = np.cumsum(sizes) - 1
                tokens = np.empty(sizes.sum(), np.int32)
                inside = np.ones(len(tokens), bool)
                inside[ends] = False
                tokens[inside] = words.indices.to_numpy()
                tokens[ends] = len(words.dictionary)
                counts = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(words.dictionary) + 1)
                letters, at = text_bytes(words.dictionary)
                hashes = word_hashes(letters, at[:-1], at[1:], member) if len(words.dictionary) else np.zeros(0, np.uint64)
                ending = letters[at[1:] - 1].astype(np.uint64) * np.uint64(257) + letters[np.maximum(at[1:] - 2, at[:-1])]
                start = (mix64(ending) % np.uint64(classes)).astype(np.int32)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()), one(part.column("doc_id").cast(doc_type)), one(pa.array(held)), one(pa.array(sizes, pa.int64())), pa.array([planes(tokens)], pa.binary()),
                        one(pa.array(hashes.view(np.int64))), one(pa.array(start)), one(pa.array(counts[:-1], pa.int64())),
                    ], names=["chunk", "doc_ids", "held", "sizes", "tokens", "ids", "starts", "counts"],
                )
                chunk += 1

    return code


def planes(tokens: np.ndarray) -> bytes:
    """The lower halves of the numbers, then the upper ones, which are mostly zero."""
    return tokens.view(np.uint16).reshape(-1, 2).T.tobytes()


def opened(chunk: pa.Table, words: pa.Table, *names: str) -> tuple:
    """Tokens, row sizes and held-out rows of a chunk, then columns of its words by place: 0 for a word not seen in training, and for the end of a text."""
    halves = np.frombuffer(chunk.column("tokens")[0].as_buffer(), np.uint16).reshape(2, -1)
    tokens = np.ascontiguousarray(halves.T).view(np.int32)[:, 0]
    place, out = words.column("place").to_numpy(), []
    for name in names:
        column = np.zeros(int(tokens[-1]) + 1, np.int64)  # the last token is an end, which has the last place
        column[place] = words.column(name).to_numpy()
        out.append(column)
    return tokens, chunk.column("sizes")[0].values.to_numpy(), chunk.column("held")[0].values.to_numpy(zero_copy_only=False), *out


def class_counter(classes: int, moving: int | None):
    """A chunk and its words -> rows ``id, cls, around``. The row without id counts pairs of classes; a row of a word that may move in this round
    counts the classes after it and before it. A count n in slot s (after: class; before: width + class; pairs: before * width + after) is packed as n * SLOTS + s."""
    width = classes + 1
    schema = pa.schema([("id", pa.int64()), ("cls", pa.int32()), ("around", pa.binary())])

    def count(chunk: pa.Table, words: pa.Table) -> pa.Table:
        if not len(chunk):
            return schema.empty_table()
        tokens, sizes, held, cls = opened(chunk, words, "cls")
        places, ids = len(cls), np.append(chunk.column("ids")[0].values.to_numpy(), 0)
        cls[-1] = classes
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.cumsum(sizes) - sizes] = places - 1  # the end stands before the first token
        train = np.repeat(~held, sizes)
        tokens, before = tokens[train].astype(np.int64), before[train].astype(np.int64)
        pairs = np.bincount(cls[before] * width + cls[tokens], minlength=width * width)
        slot = np.flatnonzero(pairs)
        out = [pa.table([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([(pairs[slot] * SLOTS + slot).tobytes()], pa.binary())], schema=schema)]
        if moving is not None:
            free = (ids & 1) == moving
            free[-1] = False
            keys = [word[free[word]] * (2 * width) + cls[other[free[word]]] + shift for word, other, shift in ((before, tokens, 0), (tokens, before, width))]
            # half as wide numbers sort twice as fast; only a very long text needs the wide ones
            keys = np.concatenate(keys).astype(np.int32 if places * 2 * width < 1 << 31 else np.int64)
            keys, n = np.unique(keys, return_counts=True)
            keys = keys.astype(np.int64)
            word = keys // (2 * width)
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else word
            ends = (np.append(at, len(word)) * 8).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(n * SLOTS + keys % (2 * width))])
            out.append(pa.table([pa.array(ids[word[at]]), pa.array(cls[word[at]].astype(np.int32)), packed], schema=schema))
        return pa.concat_tables(out)

    return count


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    return float(plogp(pairs).sum() - plogp(pairs.sum(0)).sum() - plogp(pairs.sum(1)).sum())


def exchanger(pairs: np.ndarray, classes: int):
    """Words with the classes around them -> ``id, cls``, the class with the best likelihood. A word is taken out of its own class first; the others stay where they are."""
    width, few = classes + 1, 9
    size = np.arange(few, dtype=np.float64)[:, None, None]
    # what n more pairs (c, b) add, [side, n, c, b]: the word before is of class b, then the word after
    table = np.stack([pairs.T[None] + size, pairs[None] + size])
    table = (plogp(table) - plogp(table[:, :1]))[:, :, :, :classes].copy()
    sides = np.stack([pairs.T, pairs])  # [side, c, b]
    rows, columns = pairs.sum(1)[:classes], pairs.sum(0)[:classes]

    def best(own: np.ndarray, word: np.ndarray, slots: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; entries are sorted by word."""
        side, c = slots // width, slots % width
        gain = np.zeros((len(own), classes))
        for first in range(0, len(word), 1 << 16):
            here = slice(first, first + (1 << 16))
            w, s, k, m = word[here], side[here], c[here], n[here].astype(np.float64)
            more = table[s, np.minimum(n[here], few - 1), k]
            big = m >= few
            if big.any():
                now = sides[s[big], k[big], :classes]
                more[big] = plogp(now + m[big][:, None]) - plogp(now)
            now = sides[s, k, own[w]]
            more[np.arange(len(w)), own[w]] = plogp(now) - plogp(np.maximum(now - m, 0))
            at = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            gain[w[at]] += np.add.reduceat(more, at, axis=0)
        after, before = np.bincount(word, n * (side == 0), len(own)), np.bincount(word, n * (side == 1), len(own))
        gain -= plogp(rows + after[:, None]) - plogp(rows) + plogp(columns + before[:, None]) - plogp(columns)
        k = np.arange(len(own))
        r, q = rows[own], columns[own]
        gain[k, own] += plogp(r + after) + plogp(np.maximum(r - after, 0)) - 2 * plogp(r) + plogp(q + before) + plogp(np.maximum(q - before, 0)) - 2 * plogp(q)
        top = gain.argmax(1)
        return np.where(gain[k, top] > gain[k, own] + 1e-9, top, own), after.astype(np.int64)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by id. The last word of a batch waits for the next one, as one sum per slot."""
        wait = None
        for batch in (whole.slice(first, ROWS) for whole in batches for first in range(0, len(whole), ROWS)):
            ids, packed = batch.column("id").to_numpy(), batch.column("around")
            offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1] // 8
            values = np.frombuffer(packed.buffers()[2], np.int64, count=int(offsets[-1]))[offsets[0] :]
            new = np.append(True, ids[1:] != ids[:-1])
            word, names, own = np.repeat(np.cumsum(new) - 1, np.diff(offsets)), ids[new], batch.column("cls").to_numpy()[new].astype(np.int64)
            slots, n = values % SLOTS, values // SLOTS
            if wait is not None:
                if wait[0] != names[0]:
                    names, own, word = np.append(wait[0], names), np.append(wait[1], own), word + 1
                at = np.flatnonzero(wait[2])
                word, slots, n = np.append(np.zeros(len(at), np.int64), word), np.append(at, slots), np.append(wait[2][at], n)
            # rows are sorted by word and their slots by number, so this sorts long runs
            keys = (word * SLOTS + slots).astype(np.int32)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n, word, slots = np.add.reduceat(n, at), keys[at].astype(np.int64) // SLOTS, keys[at].astype(np.int64) % SLOTS
            last = word == len(names) - 1
            sums = np.zeros(2 * width, np.int64)
            sums[slots[last]] = n[last]
            wait = (names[-1], own[-1], sums)
            yield from result(names[:-1], own[:-1], word[~last], slots[~last], n[~last])
        if wait is not None:
            at = np.flatnonzero(wait[2])
            yield from result(np.array([wait[0]]), np.array([wait[1]]), np.zeros(len(at), np.int64), at, wait[2][at])

    def result(names, own, word, slots, n):
        if len(names):
            cls, c = best(own, word, slots, n)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(cls, pa.int32()), pa.array(c)], names=["id", "cls", "c"])

    return move


def scorer(pairs: np.ndarray, classes: int, total: int, kinds: int, once: int, doc_type: pa.DataType):
    """Chunks -> a row for each of their rows."""
    width = classes + 1
    missing = (once + 0.5) / (total + 1.0)  # share of words not seen in training
    sums = pairs.sum(0)
    shares = np.append(sums / max(total, 1) * (1 - missing), missing)
    seen = np.zeros((width + 1, width + 1))
    seen[:width, :width] = pairs
    follow = (seen + BACK_OFF * shares) / (seen.sum(1) + BACK_OFF)[:, None]
    with np.errstate(divide="ignore"):
        follow = np.log10(follow)

    schema = pa.schema([("doc_id", doc_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(chunk: pa.Table, words: pa.Table) -> pa.Table:
        if not len(chunk):
            return schema.empty_table()
        tokens, sizes, held, counts, cls = opened(chunk, words, "c", "cls")
        counts[-1], cls[-1] = sums[classes], classes
        known = counts > 0
        cls[~known] = width
        emit = np.zeros(len(counts))
        emit[known] = np.log10(counts[known] / sums[cls[known]])
        base = np.log10((counts + BASE_ADD) / (total + BASE_ADD * (kinds + 1)))
        starts = np.cumsum(sizes) - sizes
        before = np.empty(len(tokens), np.int64)
        before[1:] = cls[tokens[:-1]]
        before[starts] = classes
        add = lambda x: np.add.reduceat(x, starts)
        columns = [held, sizes, add(known[tokens].astype(np.int64)), add(base[tokens]), add(follow[before, cls[tokens]] + emit[tokens])]
        return pa.table([chunk.column("doc_ids")[0].values.cast(doc_type), *[pa.array(c) for c in columns]], schema=schema)

    return score


def score_texts(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` (log10 probabilities of the text) and ``perplexity``."""
    width, kind = classes + 1, docs.schema["doc_id"].dataType
    name, doc_type = kind.simpleString(), to_arrow_type(kind)
    texts = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    ddl = f"chunk long, doc_ids array<{name}>, held array<boolean>, sizes array<long>, tokens binary, ids array<long>, starts array<int>, counts array<long>"
    coded = stored(texts.mapInArrow(coder(doc_type, classes), ddl), "op13-chunks")
    entries = coded.select("chunk", F.posexplode(F.arrays_zip("ids", "starts", "counts")).alias("place", "x")).select("chunk", "place", "x.*")
    words = entries.where("counts > 0").groupBy(F.col("ids").alias("id")).agg(F.min("starts").alias("cls"), F.sum("counts").alias("c"))
    words = stored(words, "op13-words")
    seen, kinds, once = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1))).first()
    places = coded.select("chunk", F.posexplode("ids").alias("place", "id"))

    def with_classes(table: DataFrame, per_chunk, ddl: str, of_chunk: list[str], of_word: list[str]) -> DataFrame:
        own = places.join(table.hint("shuffle_hash"), "id").select(F.col("chunk").alias("of"), "place", *of_word)
        return coded.select("chunk", "held", "sizes", "tokens", *of_chunk).groupBy("chunk").cogroup(own.groupBy("of")).applyInArrow(per_chunk, ddl)

    # words with even and with odd hashes move in turn, so a round replaces one of two tables
    halves, best = [words.where("id & 1 = 0"), words.where("id & 1 = 1")], None
    for k in range(rounds + 1):
        moving = None if k == rounds else k % 2
        now = halves[0].union(halves[1])
        counted = stored(with_classes(now, class_counter(classes, moving), "id long, cls int, around binary", ["ids"], ["cls"]), f"op13-round-{k}", dictionary=False)
        pairs = class_pairs(counted, width)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = (value, now, pairs)
        if moving is not None:
            around = counted.where("id IS NOT NULL").repartition("id").sortWithinPartitions("id")
            halves[moving] = stored(around.mapInArrow(exchanger(pairs, classes), "id long, cls int, c long"), f"op13-classes-{k}")
        discard(counted)
    _, now, pairs = best
    ends = int(pairs[:, classes].sum())
    per_chunk = scorer(pairs, classes, seen + ends, kinds + (ends > 0), once + (ends == 1), doc_type)
    out = with_classes(now, per_chunk, f"doc_id {name}, held_out boolean, n_tokens long, n_known long, base_score double, score double", ["doc_ids"], ["cls", "c"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(seen + ends).cast("bigint").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def class_pairs(counted: DataFrame, width: int) -> np.ndarray:
    """Pairs of classes over all chunks: the rows of the chunks are summed inside tasks, a row of the matrix per task comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width * width, np.int64)
        for batch in batches:
            for packed in batch.column("around"):
                values = np.frombuffer(packed.as_buffer(), np.int64)
                sums[values % SLOTS] += values // SLOTS
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(sums)], names=["slot", "n"])

    rows = counted.where("id IS NULL").select("around").mapInArrow(add, "slot long, n long").where("n > 0").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # width x width at most
    out = np.zeros(width * width)
    for r in rows:
        out[r["slot"]] = r["n"]
    return out.reshape(width, width)
