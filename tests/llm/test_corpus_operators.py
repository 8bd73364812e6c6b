"""Operators 11 to 13 against brute force, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearthline.llm import brown, divergence, spelling_variants
from hearthline.llm.common import byte_class, lower_ascii, mix64, text_bytes, word_hashes

DOCS = "doc_id bigint, text string, lang string, source string"
LONG = " ".join(f"word{k % 977}x{k}" for k in range(30_000))
ODD = [
    (1, "Plain words stand here, one after the other.", "en", "a"), (1, "Plain words stand here, one after the other.", "en", "a"), (2, None, "en", "b"), (3, "", None, None), (4, " \n\t ", "de", "b"),
    (5, "...", "de", ""), (None, "A text without id, plainer words.", "en", None), (None, None, None, None), (6, LONG, "en", "b"), (7, "é\u0000ß İ \U0001f600 straße ×÷ Ångström", "fr", "ä"), (8, "x", "en", "Z"),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def clashing(spark, rows):
    """The rows with extra columns whose names the operators use inside."""
    extra = ["term string", "here bigint", "there bigint", "word string", "n bigint", "id string", "chunk bigint", "place bigint", "cls int", "p bigint", "part int", "reduced string", "key bigint"]
    return spark.createDataFrame([(*r, "t", 1, 2, "w", 3, "i", 4, 5, 6, 7, 8, "r", 9) for r in rows], f"{DOCS}, {', '.join(extra)}")


# operator 11


def brute_audit(rows, min_docs, prior, scale, top):
    here, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups.add((lang, source))
        here[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        all_terms = sum((here[lang, s] for s in own), Counter())
        share = lambda counts: {t: 1 + scale * (counts[t] + prior) // (sum(counts[k] for k in kept) + prior * len(kept)) for t in kept}
        q, p = share(all_terms), {s: share(here[lang, s]) for s in own}
        for s in own:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, k) for k, (v, o) in enumerate(pairs, 1)]
            terms = sorted(((p[s][t] - q[t], t) for t in kept if here[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, "term", t, v, k) for k, (v, t) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile", [2, 128])
def test_audit_equals_brute_force(spark, monkeypatch, tile):
    """Five sources of skewed words; also with so small tiles that sources fall into several, ties and groups without kept terms."""
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "abcdé" for b in ("a", "zz", "ö", "q")]
    rows = [(k, " ".join(rng.choices(words, weights=[1 + (j * (k % 5)) % 7 for j in range(20)], k=rng.randrange(30))), rng.choice(["en", "en", None]), f"s{k % 5}") for k in range(200)]
    rows += [(900, "rare", "en", "lonely"), (901, None, "xx", "one"), (902, "only", "xx", "two")]
    out = divergence.audit(spark.createDataFrame(rows, DOCS), min_docs=20, top=4)
    assert sorted(map(tuple, out.collect())) == brute_audit(rows, 20, 5, 10**9, 4)


def test_skyband_keeps_what_can_be_first():
    rng = np.random.default_rng(2)
    for n, k in ((3000, 50), (40, 1), (700, 7)):
        here, lang = rng.integers(1, 30, n), rng.integers(1, 40, n)
        name = rng.permutation(n)
        kept = set(divergence.undominated(here, lang, name, k).tolist())
        above = [int(((here >= here[i]) & (lang <= lang[i]) & (name < name[i])).sum()) for i in range(n)]
        assert kept == {i for i in range(n) if above[i] < k}


def test_audit_of_odd_rows(spark):
    out = divergence.audit(clashing(spark, ODD), min_docs=1)
    assert sorted(map(tuple, out.collect())) == brute_audit(ODD, 1, 5, 10**9, 50)
    assert divergence.audit(clashing(spark, ODD).limit(0)).count() == 0
    none = {tuple(r) for r in divergence.audit(spark.createDataFrame(ODD, DOCS)).collect()}  # no term is in 30 documents
    assert ("en", "a", "pair", "b", 0, 3) in none and not any(r[2] == "term" for r in none)


# operator 12


def brute_variants(rows, length=7, least=2, share=10, damaged=31):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % damaged else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, n_near = {}, Counter()
    for a in words:
        best = [b for b in words if abs(len(a) - len(b)) <= 1 and a != b and near(a, b)]
        n_near[a] = len(best)
        if best:
            b = min(best, key=lambda b: (-words[b], b))
            form[a] = b if words[b] >= share * words[a] else None

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted((w, n, n_near[w], form.get(w), words[form[w]] if form.get(w) else None, root(w)) for w, n in words.items())


def variant_rows(seed):
    """Frequent words, chains of ever rarer variants, repeated letters and letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 10))) for _ in range(12)] + ["aaaaaaaa", "abababab", "Àÿéàõüß", "running"]
    rows = []
    for w in base:
        times = 600
        while times >= 1:
            rows.append((rng.randrange(50) if rng.random() < 0.95 else None, " ".join([w if rng.random() < 0.7 else w.upper()] * times)))
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            times //= rng.choice([4, 12, 25])
    return rows


@pytest.mark.parametrize("symbols,slices", [(4, 4), (1, 1), (9, 2)])
def test_variants_equal_brute_force(spark, symbols, slices):
    rows = variant_rows(1)
    got = spelling_variants.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), symbols=symbols, slices=slices)
    got = sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()), key=str)
    want = sorted(brute_variants(rows), key=str)
    assert got == want
    assert any(r[5] != (r[3] or r[0]) for r in want)  # some roots are two steps away


def test_variants_of_odd_rows(spark):
    rows = [*ODD, (9, "a" * 5000 + " " + "a" * 5000 + " " + "a" * 4999, None, None), (9, "Straßen straßen STRAßEN strasßen strasßen", None, None)]
    got = spelling_variants.group_variants(clashing(spark, rows)).collect()
    assert sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got), key=str) == sorted(brute_variants(rows), key=str)
    assert spelling_variants.group_variants(clashing(spark, rows).limit(0)).count() == 0


def test_run_hashes_are_crc32(spark):
    rng = random.Random(3)
    runs = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 5, 47, 48, 49, 300]))) for _ in range(500)]
    data = np.frombuffer(b"".join(runs), np.uint8)
    ends = np.cumsum([len(r) for r in runs])
    before = np.array([rng.randrange(2**32) for _ in runs], np.uint32)
    got = spelling_variants.run_hashes(data, ends - [len(r) for r in runs], ends, before, spelling_variants.crc_table())
    assert got.tolist() == [zlib.crc32(r, int(b)) for r, b in zip(runs, before)]


# operator 13


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [""]


def brute_scores(rows, classes, rounds):
    """Base and model scores by plain counting; the exchange follows the same rules word by word."""
    import pyarrow as pa

    train = [tokens_of(t) for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
    count = Counter(w for d in train for w in d)
    member = byte_class("space")

    def known(word):
        data, at = text_bytes(pa.array([word], pa.large_string()))
        data = lower_ascii()[data]
        b = data[-1].astype(np.uint64) * np.uint64(257) + data[max(len(data) - 2, 0)]
        return int(word_hashes(data, at[:-1], at[1:], member).view(np.int64)[0]), int(mix64(np.array([b], np.uint64))[0] % np.uint64(classes))

    facts = {w: known(w) for w in count if w}
    cls = {w: f[1] for w, f in facts.items()} | {"": classes}
    pairs = [(a, b) for d in train for a, b in zip(["", *d], d)]
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    best = None
    for k in range(rounds + 1):
        m = np.zeros((classes + 1, classes + 1))
        for a, b in pairs:
            m[cls[a], cls[b]] += 1
        value = sum(f(x) for x in m.flat) - sum(f(x) for x in m.sum(0)) - sum(f(x) for x in m.sum(1))
        if best is None or value > best[0] + 1e-7:
            best = (value, dict(cls), m)
        if k == rounds:
            break
        after, before = defaultdict(Counter), defaultdict(Counter)
        for a, b in pairs:
            after[a][cls[b]] += 1
            before[b][cls[a]] += 1
        row, column, moved = m.sum(1), m.sum(0), {}
        for w, (h, _) in facts.items():
            if h & 1 != k % 2:
                continue
            own, n = cls[w], count[w]
            gain = []
            for b in range(classes):
                s = -1 if b == own else 1
                g = sum(s * (f(m[b, c] + s * x) - f(m[b, c])) for c, x in after[w].items()) + sum(s * (f(m[c, b] + s * x) - f(m[c, b])) for c, x in before[w].items())
                gain.append(g - s * (f(row[b] + s * n) - f(row[b])) - s * (f(column[b] + s * n) - f(column[b])))
            top = int(np.argmax(gain))
            moved[w] = top if gain[top] > gain[own] + 1e-9 else own
        cls |= moved
    _, cls, m = best
    total, once = sum(count.values()), sum(n == 1 for n in count.values())
    sums, missing = m.sum(0), (once + 0.5) / (total + 1.0)
    shares = np.append(sums / max(total, 1) * (1 - missing), missing)
    out = []
    for i, text, *_ in rows:
        base = score = 0.0
        last, tokens = classes, tokens_of(text)
        for w in tokens:
            base += math.log10((count[w] + 0.1) / (total + 0.1 * (len(count) + 1)))
            c = cls[w] if count[w] else classes + 1
            seen = m[last, c] if last <= classes and c <= classes else 0
            size = m[last].sum() if last <= classes else 0
            score += math.log10((seen + brown.BACK_OFF * shares[c]) / (size + brown.BACK_OFF)) + (math.log10(count[w] / sums[c]) if count[w] else 0)
            last = c
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, len(tokens), sum(count[w] > 0 for w in tokens), total, base, score))
    return out


def same_scores(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[5], 4))
    got, want = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    np.testing.assert_allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("chunk", [300, 12_000_000])
def test_class_model_equals_brute_force(spark, monkeypatch, chunk):
    """Also with chunks of a few texts, so that words meet from many of them."""
    monkeypatch.setattr(brown, "CHUNK_TEXT", chunk)
    rng = random.Random(4)
    kinds = [[f"{p}{k}{e}" for k in range(12)] for p, e in (("the", "x"), ("n", "ou"), ("v", "erb"), ("é", "ß"))]
    rows = []
    for k in range(150):
        words, at = [], rng.randrange(4)
        for _ in range(rng.randrange(1, 25)):
            words.append(rng.choice(kinds[at]) if rng.random() < 0.97 else f"odd{rng.randrange(10**6)}")
            at = (at + rng.choice([1, 1, 1, 2])) % 4
        rows.append((k, " ".join(words)))
    out = brown.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), classes=5, rounds=4).collect()
    same_scores(out, brute_scores(rows, 5, 4))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)


def test_class_model_on_odd_rows(spark):
    docs = clashing(spark, ODD)
    same_scores(brown.score_texts(docs, classes=3, rounds=2).collect(), brute_scores(ODD, 3, 2))
    assert brown.score_texts(docs.limit(0)).count() == 0
    held = [(i, "some words") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    out = brown.score_texts(spark.createDataFrame(held, "doc_id bigint, text string"), classes=3, rounds=1).collect()
    assert {(r.train_tokens, r.base_score, r.n_known) for r in out} == {(0, 0.0, 0)} and all(math.isfinite(r.score) for r in out)
    named = brown.score_texts(spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string"), classes=2, rounds=1)
    assert dict(named.dtypes)["doc_id"] == "string" and {r.doc_id for r in named.collect()} == {"a", "b"}
