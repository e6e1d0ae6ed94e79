"""Quality classifier from weak labels.

Eight overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation over the counts of vote patterns (all documents; at most 3**8 patterns) estimates each
labeller's accuracy on good and on bad documents and the share of good ones, hence a posterior for
every pattern. No vote counts as missing, not as evidence. A bounded sample of about ``TRAIN_ROWS`` documents, chosen by hash and labelled with
these posteriors, trains a logistic scorer over hashed features: byte trigrams of
the whole text and the levels of the labellers' signals. The scorer then judges every whole text.

Defined cases: null text counts as empty; an empty text has no features but the bias and
the levels of its signals; repeated rows get equal scores; an empty table gives an empty
result; extra columns are passed through by ``keep_good`` and ignored by ``classify``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_fraction, read_table

TRAIN_ROWS = 3000
DIMENSIONS = 4096
THRESHOLD = 0.5  # documents that score less are rejected
LEVELS = 8
EM_ROUNDS = 60
CHUNK = 1 << 20

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to a in is it that for on with as was be by are this at from or an have not
der die das und in zu den ist von mit sich des auf für nicht ein eine im dem als auch
le la les de et des un une du que qui en dans est pour pas sur au par avec
el los las y que en un una por con no se para su al lo como mi
""".split())
SYMBOLS = b"#*$%&|<>~^_={}[]\\@"
_CAPS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_EDGES = re.compile(r"^\W+|\W+$")


def signals(text: str) -> np.ndarray:
    """Shares in [0, 1] that the labellers look at: symbols, capitals, words equal to the word before,
    words that are no stop words, repeated lines, words that end in odd marks, what compression
    saves, words equal to the two before; and the word count."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(9)
    dense = sum(map(len, words))
    caps = len(raw) - len(raw.translate(None, _CAPS))
    small = len(raw) - len(raw.translate(None, _SMALL))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    same = list(map(str.__eq__, words, words[1:]))
    again, thrice = sum(same), sum(map(bool.__and__, same, same[1:]))
    stops = sum(w.lower() in STOP_WORDS for w in words if len(w) < 6)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    odd = sum(w[-1] in "!#*$%&|<>~^=" for w in words)
    return np.array([symbols / dense, caps / max(1, caps + small), again / max(1, n - 1), 1 - stops / n,
                     1 - len(set(lines)) / max(1, len(lines)), odd / n,
                     max(0.0, 1 - len(zlib.compress(raw, 1)) / len(raw)), thrice / max(1, n - 2), n])


#: (signal, good at or below, bad above, least number of words)
LABELLERS = [("symbols", 0, 0.02, 0.08, 1), ("capitals", 1, 0.3, 0.6, 4), ("repeats", 2, 0.05, 0.2, 4),
             ("no_stop_words", 3, 0.93, 0.99, 20), ("same_lines", 4, 0.1, 0.4, 30), ("odd_ends", 5, 0.1, 0.4, 4),
             ("compresses", 6, 0.7, 0.85, 30), ("runs", 7, 0.02, 0.1, 6)]


def votes(s: np.ndarray) -> int:
    """The pattern of votes as a base-3 number: 0 bad, 1 none, 2 good per labeller."""
    out = 0
    for _, k, good, bad, least in LABELLERS:
        v = 1 if s[-1] < least else 2 if s[k] <= good else 0 if s[k] > bad else 1
        out = out * 3 + v
    return out


def features(text: str, s: np.ndarray) -> np.ndarray:
    """Hashed features: trigram counts, damped and scaled to length 1, and the signals' levels."""
    counts = np.zeros(DIMENSIONS, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    for at in range(0, max(0, len(raw) - 2), CHUNK):
        b = raw[at:at + CHUNK + 2].astype(np.uint32)
        code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
        counts += np.bincount(code, minlength=DIMENSIONS)[:DIMENSIONS]
    v = np.log1p(counts)
    v /= max(1e-9, float(np.sqrt((v * v).sum())))
    for name, k, _, _, least in LABELLERS:
        level = min(LEVELS, int(s[k] * 2 * LEVELS)) if s[-1] >= least else -1
        v[zlib.crc32(f"{name}:{level}".encode()) % DIMENSIONS] += 0.5
    return v


def fit_labellers(patterns: dict[int, int]) -> tuple[dict[int, float], list[dict]]:
    """Posterior of good for every pattern, and each labeller's estimated accuracies."""
    codes = np.array(sorted(patterns))
    n = np.array([patterns[c] for c in codes], float)
    digits = np.array([[c // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))] for c in codes])
    balance = (digits == 2).sum(1) - 4.0 * (digits == 0).sum(1)  # a bad vote outweighs good ones at the start
    post = 1 / (1 + np.exp(-np.clip(balance, -20, 20)))
    right = np.full((2, len(LABELLERS)), 0.5)  # P(vote is right | there is one) on bad and on good documents
    for _ in range(EM_ROUNDS):
        good = float((post * n).sum() + 1) / (n.sum() + 2)
        odds = np.full(len(codes), np.log(good / (1 - good)))
        for k in range(len(LABELLERS)):
            for c, w in enumerate(((1 - post) * n, post * n)):
                hit, miss = w[digits[:, k] == 2 * c].sum(), w[digits[:, k] == 2 - 2 * c].sum()
                right[c, k] = (hit + 1) / (hit + miss + 2)
            odds += np.where(digits[:, k] == 2, np.log(right[1, k] / (1 - right[0, k])), 0)
            odds += np.where(digits[:, k] == 0, np.log((1 - right[1, k]) / right[0, k]), 0)
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    report = [{"labeller": x[0], "accuracy_good": float(right[1, k]), "accuracy_bad": float(right[0, k])}
              for k, x in enumerate(LABELLERS)]
    return dict(zip(codes.tolist(), post.tolist())), report


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and bias of a logistic scorer for soft targets; both classes weigh the same."""
    share = min(0.99, max(0.01, float(target.mean()))) if len(target) else 0.5
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))
    # single precision throughout: a wider vector would copy the whole matrix at every product
    target, weight = target.astype(np.float32), weight.astype(np.float32)
    w, moved = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    for k in range(rounds if len(x) else 0):  # Nesterov's accelerated gradient
        ahead = w + np.float32(k / (k + 3)) * moved
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        miss = weight * (p - target) / np.float32(len(x))
        step = np.append(x.T @ miss, miss.sum()) + np.float32(l2) * ahead
        new = ahead - step
        moved, w = new - w, new
    return w


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        train_rows: int = TRAIN_ROWS) -> tuple[dict[int, float], np.ndarray, list[dict]]:
    """(posterior of each vote pattern, the scorer's weights, labeller report) from all documents."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = pd.Series([votes(signals(t)) for t in b["text"]], dtype="int64").value_counts()
            yield pd.DataFrame({"pattern": p.index.astype("int64"), "n": p.to_numpy("int64")})

    counted = docs.select(text).mapInPandas(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    patterns = {r["pattern"]: r["n"] for r in counted.collect()}  # 6,561 rows at most
    if not patterns:
        return {}, np.zeros(DIMENSIONS + 1), []
    posterior, report = fit_labellers(patterns)
    share = min(1.0, train_rows / sum(patterns.values()))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                s = signals(t)
                v = features(t, s)
                at = np.flatnonzero(v)
                rows.append((posterior[votes(s)], at.astype(np.int32), v[at]))
            yield pd.DataFrame(rows, columns=["target", "at", "value"])

    chosen = docs.select(F.col(id_col).alias("id"), text).filter(hashed_fraction(F.col("id"), F.col("text")) < share)
    # the limit only acts when one repeated row was drawn over and over
    got = chosen.select("text").mapInPandas(sample, "target double, at array<int>, value array<float>").limit(
        2 * train_rows).toPandas()
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for k, (at, value) in enumerate(zip(got["at"], got["value"])):
        x[k, np.asarray(at, int)] = value
    return posterior, fit_scorer(x, got["target"].to_numpy(float)), report


def _judged(docs: DataFrame, model: tuple, text_col: str, threshold: float, name: str) -> DataFrame:
    """``docs`` with the struct column ``name``: n_votes, posterior, score, kept. Only texts go to Python, and only
    the four values come back; the other columns stay in the JVM."""
    posterior, weights, _ = model
    w, bias = weights[:-1].astype(np.float32), float(weights[-1])

    @F.pandas_udf("n_votes long, posterior double, score double, kept boolean")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                s = signals(t)
                p = votes(s)
                score = 1 / (1 + np.exp(-np.clip(float(features(t, s) @ w) + bias, -30, 30)))
                rows.append((sum(p // 3 ** k % 3 != 1 for k in range(len(LABELLERS))), posterior[p], score, score >= threshold))
            yield pd.DataFrame(rows, columns=["n_votes", "posterior", "score", "kept"])

    return docs.withColumn(name, judge(F.coalesce(F.col(text_col), F.lit(""))))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_votes, posterior (of its votes), score, kept."""
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = _judged(thin, fit(thin, train_rows=train_rows), "text", threshold, "is")
    return out.select("doc_id", "is.n_votes", "is.posterior", "is.score", "is.kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS,
              threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that the classifier accepts."""
    out = _judged(docs, fit(docs, id_col, text_col, train_rows), text_col, threshold, "__is")
    return out.filter("__is.kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"))
