"""Secrets in text (operator 10).

An Aho-Corasick automaton finds the keywords of all kinds in one pass over
the text; an anchored pattern is tried only where its keyword stands. Long
runs of hexadecimal digits have no keyword: they are found by their length.
Tokens that carry a checksum count only if it is right.

Kinds, in order of report for equal starts (fixed values):
``assign`` a key word with an assigned value of six characters or more;
``access`` access key ids of 20 characters or more; ``hex`` 24 or more hexadecimal
digits; ``github`` and ``npm`` tokens whose last six characters are the base-62
CRC-32 of the 30 before; ``jwt`` three base64url parts whose first decodes to a JSON object
with ``alg``; ``pem`` a private key block of valid base64.

Spans are ``kind:start:end`` in code points, end exclusive.

* null and empty text: no spans
* repeated rows: each is scanned
* very long texts, also of one repeated keyword: time grows with the length, not with its square
* ``doc_id`` is passed on as it is, null too
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import row_chunks, text_bytes, word_spans

KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
BASE_KINDS = 3
HEX_DIGITS = 24
#: keyword (lower case) -> kind
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "github": r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "npm": r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])",
    "jwt": r"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++",
    "pem": r"-----BEGIN ((?:[A-Z0-9]++ ){0,4})PRIVATE KEY-----(\s[A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----",
}
#: Where a pattern fails because of what follows a run of characters, it fails for every keyword inside that run.
RUNS = {"jwt": r"[A-Za-z0-9_-]++"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, digits: int = 6) -> str:
    out = ""
    while number or not out:
        number, rest = divmod(number, 62)
        out = BASE62[rest] + out
    return out.rjust(digits, "0")


def checksum_holds(token: str) -> bool:
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def jwt_holds(token: str) -> bool:
    head = token.partition(".")[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except ValueError:
        return False
    return isinstance(value, dict) and "alg" in value


def pem_holds(body: str) -> bool:
    try:
        return len(base64.b64decode("".join(body.split()), validate=True)) > 0
    except (binascii.Error, ValueError):
        return False


ACCEPTS = {
    "assign": lambda m: len(m.group(1)) >= 6,
    "access": lambda m: len(m.group()) >= 20,
    "github": lambda m: checksum_holds(m.group()),
    "npm": lambda m: checksum_holds(m.group()),
    "jwt": lambda m: jwt_holds(m.group()),
    "pem": lambda m: pem_holds(m.group(2)),
}


def folded(text: str) -> str:
    """Lower case with every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def hex_runs(data: np.ndarray, offsets: np.ndarray, least: int = HEX_DIGITS) -> dict[int, list[tuple[int, int]]]:
    """Per row the byte spans (within the row) of runs of at least ``least`` lower-case hexadecimal digits."""
    digit = np.zeros(256, bool)
    digit[list(b"0123456789abcdef")] = True
    starts, stops, _ = word_spans(data, offsets, digit)
    out: dict[int, list[tuple[int, int]]] = {}
    for k in np.flatnonzero(stops - starts >= least):
        row = int(np.searchsorted(offsets, starts[k], side="right")) - 1
        out.setdefault(row, []).append((int(starts[k] - offsets[row]), int(stops[k] - offsets[row])))
    return out


def keyword_spans(text: str, automaton, patterns: dict, runs: dict) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind; those that fail their test take up their place but are not reported. A run of characters is read
    once for each part of a pattern, however many keywords it holds."""
    ends: dict[str, int] = {}
    found = []
    for last, (word, kind) in sorted(automaton.iter(folded(text)), key=lambda hit: hit[0] - len(hit[1][0])):
        start = last - len(word) + 1
        if start < ends.get(kind, 0):
            continue
        m = patterns[kind].match(text, start)
        if m:
            ends[kind] = m.end()
            if ACCEPTS[kind](m):
                found.append((kind, start, m.end()))
        elif kind in runs:
            run = runs[kind].match(text, start)
            ends[kind] = run.end() if run else start + 1
    return found


def scanner(redact: str | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            automaton.add_word(word, (word, kind))
        automaton.make_automaton()
        patterns = {kind: re.compile(p, re.ASCII) for kind, p in PATTERNS.items()}
        inside = {kind: re.compile(p, re.ASCII) for kind, p in RUNS.items()}
        order = {kind: k for k, kind in enumerate(KINDS)}

        def joined(spans) -> str:
            return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)

        for batch in batches:
            for first, last in row_chunks(batch.column("text")):
                part = batch.slice(first, last - first)
                data, offsets = text_bytes(part.column("text"))
                runs = hex_runs(data, offsets)
                out = []
                for k, given in enumerate(part.column("text").to_pylist()):
                    text = given or ""
                    spans = keyword_spans(text, automaton, patterns, inside)
                    if k in runs:
                        points = np.append(0, np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80))
                        spans += [("hex", int(points[a]), int(points[b])) for a, b in runs[k]]
                    spans.sort(key=lambda s: (s[1], order[s[0]]))
                    base = [s for s in spans if order[s[0]] < BASE_KINDS]
                    counts = [sum(s[0] == kind for s in base) for kind in KINDS[:BASE_KINDS]]
                    line = [*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)]
                    if redact is not None:
                        pieces, done = [], 0
                        for _, a, b in spans:
                            if b > done:
                                pieces += [text[done:a], redact] if a >= done else []
                                done = b
                        line.append(None if given is None else "".join(pieces) + text[done:])
                    out.append(line)
                columns = list(zip(*out))
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["clean_text"] * (redact is not None)
                types = [pa.int64()] * 3 + [pa.string()] * (len(names) - 3)
                rest = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(c, t) for c, t in zip(columns, types)], names=rest + names)

    return scan


def find_secrets(docs: DataFrame, redact: str | None = None, carry: list[str] = ()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, counts of the base kinds, ``base_sha256``, ``spans``; with ``redact`` also ``clean_text``, in which each span
    (overlapping ones together) is replaced by that string, and ``kept``, a struct of the columns named in ``carry``."""
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept")] if carry else []))
    schema = StructType([f for f in picked.schema.fields if f.name != "text"])
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, LongType())
    for name in ("base_sha256", "spans") + (("clean_text",) if redact is not None else ()):
        schema = schema.add(name, StringType())
    return picked.mapInArrow(scanner(redact), schema)


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; ``n_chars``, if there, follows a changed text. A null text stays null."""
    found = find_secrets(docs, mark, [c for c in docs.columns if c != "text"] or ["doc_id"])
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("spans") != "", F.length("clean_text").cast(kind)).otherwise(F.col("kept.n_chars"))
    return found.select(*[new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
