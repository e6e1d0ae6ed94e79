"""Secret scans: base patterns plus two character Markov models compared by log-likelihood ratio.

Base kinds: ``assign`` (name, separator, value), ``access`` (key ids), ``hex`` (long hexadecimal runs).
Method kind ``markov``: a stretch of a token, outside the base spans, that is better explained by the model of random strings
than by the model of ordinary identifiers: by ``MIN_RATIO`` nats a character, and by as much in all as a stretch
of ``MIN_TOKEN`` characters needs, so shorter ones need a higher ratio. A token, or what the base spans leave of it, is
taken whole if it meets this; else it is cut at / = _ - and the run of parts that exceeds ``MIN_RATIO`` by most is taken, and so
on left and right of it; if that run is too short, each part is judged alone.

Both models are first-order chains over 64 characters plus the token's edges, with add-one smoothing. The labelled samples:
random = values that the base patterns find in the corpus and strings drawn from seeded hashes over
hexadecimal, base32, base62 and base64 alphabets; ordinary = words of the corpus outside base spans, alone and joined
into identifiers (camel, snake, kebab and upper case, with acronyms, numbers and years), and numbers. The corpus part comes from a bounded sample of about
``TRAIN_ROWS`` documents, chosen by hash.

Spans are code points, end exclusive. Defined cases: null text counts as empty; empty texts and texts without
secrets give zeros and the hash of the empty string; repeated rows are scanned each; an empty table gives an empty
result (and models of drawn strings alone are never applied to anything); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_fraction, kinds_of, read_table, texts_for

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
NAMES = (b"password", b"passwd", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "markov")

MIN_TOKEN = 16
MIN_RATIO = 2.0  # nats per character in favour of random
MIN_NATS = MIN_RATIO * MIN_TOKEN
TRAIN_ROWS = 4000
DRAWN = 4000
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SIZE = len(ALPHABET) + 2  # one more class for other token characters, one for the edges
EDGE = SIZE - 1

_CODE = np.full(256, SIZE - 2, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(len(ALPHABET))
_TOKEN_CODE = np.full(256, EDGE, np.int64)  # the same, but what is no token character is an edge
_TOKEN_CODE[list((ALPHABET + "_=-").encode())] = _CODE[list((ALPHABET + "_=-").encode())]
_CUT = np.zeros(SIZE, bool)  # tokens may be cut at / and at _ = -
_CUT[[ALPHABET.index("/"), SIZE - 2]] = True
# Byte classes as marks for quick tests: hexadecimal digits.
_HEX_MARK = bytes(49 if chr(b) in "0123456789abcdef" else 48 for b in range(256))


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches; ``raw`` is the text in UTF-8."""
    out = []
    small = raw.lower()
    if any(n in small for n in NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    if b"1" * MIN_HEX in raw.translate(_HEX_MARK):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(token: str) -> np.ndarray:
    code = np.concatenate(([EDGE], _CODE[np.frombuffer(token.encode("utf-8", "replace"), np.uint8)], [EDGE]))
    return code[:-1] * SIZE + code[1:]


def _count(tokens: list[str]) -> np.ndarray:
    if not tokens:
        return np.zeros(SIZE * SIZE, np.int64)
    return np.bincount(np.concatenate([_pairs(t) for t in tokens]), minlength=SIZE * SIZE)


def drawn_strings(n: int = DRAWN) -> list[str]:
    """Random strings of 16 to 64 characters from seeded hashes, over four alphabets in turn."""
    out = []
    for k in range(n):
        letters = ("0123456789abcdef", ALPHABET[:26] + "234567", ALPHABET[:62], ALPHABET)[k % 4]
        stream = b"".join(hashlib.sha512(f"drawn:{k}:{j}".encode()).digest() for j in range(2))
        size = 16 + stream[0] % 49
        out.append("".join(letters[(stream[1 + 1 * i] + 256 * (i % 3)) % len(letters)] for i in range(size)))
    return out


def _ordinary(words: list[str]) -> list[str]:
    """The words and, from each three in a row, one identifier."""
    out = list(words)
    for k in range(0, len(words) - 2, 3):
        a, b, c = words[k:k + 3]
        out.append((f"{a}{b.title()}{c.title()}", f"{a}_{b}_{c}", f"{a}-{b}-{k % 100}", f"{a}{b.title()}{k % 10}",
                    f"{a.upper()}_{b.upper()}", f"{a.title()}{b[:5].upper()}{c.title()}{1990 + k % 40}")[k // 3 % 6])
    return out


_WORD = re.compile(r"[A-Za-z][A-Za-z0-9_]+")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9]+(?![A-Za-z0-9])")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of every pair of character classes."""
    total = docs.count()
    share = min(1.0, train_rows / max(1, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, SIZE * SIZE), np.int64)
        for b in batches:
            for text in b["text"]:
                spans, at, rest = base_spans(text, text.encode("utf-8", "replace")), 0, []
                for start, kind, end in spans:
                    value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
                    counts[0] += _count([value])
                    rest.append(text[at:start])
                    at = max(at, end)
                rest.append(text[at:])
                left = " ".join(rest)
                counts[1] += _count(_ordinary(_WORD.findall(left)) + _NUMBER.findall(left))
        pair = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"pair": pair, "random": counts[0][pair], "ordinary": counts[1][pair]})

    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("id")).filter(
        hashed_fraction(F.col("id"), F.col("text")) < share).select("text")
    summed = sample.mapInPandas(run, "pair long, random long, ordinary long").groupBy("pair").agg(
        F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).collect()  # SIZE ** 2 rows at most
    counts = np.zeros((2, SIZE * SIZE))
    for r in summed:
        counts[:, r["pair"]] = r["random"], r["ordinary"]
    counts[0] += _count(drawn_strings())
    chance = (counts + 1).reshape(2, SIZE, SIZE)
    chance /= chance.sum(axis=2, keepdims=True)
    return np.log(chance[0] / chance[1]).ravel()


def _stretches(code: np.ndarray, model: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the random stretches of one token, given as character classes."""
    out, todo = [], [(0, len(code))]
    inner = np.concatenate(([0.0], np.cumsum(model[code[:-1] * SIZE + code[1:]])))  # up to each character
    first, last = model[EDGE * SIZE + code], model[code * SIZE + EDGE]
    solid = np.concatenate(([False], ~_CUT[code], [False]))
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])

    def ratio(a, b):
        return first[a] + inner[b - 1] - inner[a] + last[b - 1]

    while todo:
        lo, hi = todo.pop()
        if lo >= hi:
            continue
        if ratio(lo, hi) >= max(MIN_NATS, MIN_RATIO * (hi - lo)):
            out.append((lo, hi))
            continue
        k = slice(np.searchsorted(starts, lo), np.searchsorted(ends, hi, "right"))
        a, b = starts[k], ends[k]
        if not len(a):
            continue
        head, tail = first[a] - inner[a] + MIN_RATIO * a, inner[b - 1] + last[b - 1] - MIN_RATIO * b
        j = int(np.argmax(np.maximum.accumulate(head) + tail))
        i = int(np.argmax(head[:j + 1]))
        if ratio(a[i], b[j]) >= max(MIN_NATS, MIN_RATIO * (b[j] - a[i])):
            out.append((int(a[i]), int(b[j])))
            todo += [(lo, int(a[i])), (int(b[j]), hi)]
        else:
            alone = ratio(a, b) >= np.maximum(MIN_NATS, MIN_RATIO * (b - a))
            out += zip(a[alone].tolist(), b[alone].tolist())
    return out


def markov_spans(text: str, raw: bytes, taken: list[tuple[int, int, int]], model: np.ndarray) -> list[tuple[int, int, int]]:
    byte = np.frombuffer(raw, np.uint8)
    lead = None if len(raw) == len(text) else np.append(np.flatnonzero(byte & 0xC0 != 0x80), len(raw))  # of each code point
    code = np.concatenate(([EDGE], _TOKEN_CODE[byte], [EDGE]))
    for s, _, e in taken:
        code[1 + (s if lead is None else lead[s]):1 + (e if lead is None else lead[e])] = EDGE
    # tokens that cannot reach MIN_NATS even by their positive pairs alone, and the best edges at cuts, are out
    inside = code != EDGE
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    most = np.concatenate(([0.0], np.cumsum(np.maximum(model[code[:-1] * SIZE + code[1:]], 0))))
    cuts = np.concatenate(([0], np.cumsum(_CUT[code[1:-1] % EDGE] & inside[1:-1])))
    edges = max(0.0, model[EDGE * SIZE:].max()) + max(0.0, model[EDGE::SIZE].max())
    may = most[end + 1] - most[start] + np.where(cuts[end] > cuts[start], edges, 0.0) >= MIN_NATS
    out = []
    for i, j in zip(start[may].tolist(), end[may].tolist()):
        for a, b in _stretches(code[i + 1:j + 1], model):
            s, e = i + a, i + b
            out.append((s, 3, e) if lead is None else (int(np.searchsorted(lead, s)), 3, int(np.searchsorted(lead, e))))
    return sorted(out)


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    model = fit(docs, id_col, text_col) if model is None else model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b["doc_id"], b["text"]):
                raw = text.encode("utf-8", "replace")
                base = base_spans(text, raw)
                more = markov_spans(text, raw, base, model)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                rows.append((i, *n, len(more), hashlib.sha256(_join(base).encode()).hexdigest(), _join(sorted(base + more))))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])
            yield out

    named = texts_for(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ("doc_id",))
    found = named.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
    return kinds_of(found, docs, {"doc_id": id_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
