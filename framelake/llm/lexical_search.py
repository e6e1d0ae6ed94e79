"""Ranked lexical search: the best documents for each query item, by presence masks.

Terms are runs of ASCII digits, letters (A-Z lower-cased) and characters beyond ASCII. The score of a document is the sum, over the
item's terms with repeats, of the term's weight times its saturated frequency, in whole numbers (``term_weight``, ``saturated``).

Pass 1 reads every whole text once and writes an index of the items' terms only: per block of ``BLOCK`` documents the ids,
term counts, and for each term its documents and frequencies. The totals that weights need (documents and terms of the
corpus, documents per term) are summed per task and then over tasks.

Pass 2 reads the index. In each block an item's terms are rows of presence bits over the documents; turned by bit packing, they give every
document its mask of matched terms, and documents with equal masks form a group. A mask's maximum score takes each of its terms at
the term's highest saturated frequency in the block. Masks are evaluated by descending maximum, ``STEP`` at a time, until the next
maximum is below the worst of the best ``TOP`` found so far in this task: then no document left can enter. (A maximum equal to it is
still evaluated, as ties go to the smaller id.) Each task hands on ``TOP`` rows an item at most; a window picks the best over tasks.

Items are the query set. They are dealt by hash into batches of about ``BATCH_CHARS`` characters; a batch's terms go to the tasks
with the code, so this is the bound of what is sent, and each batch is one run of both passes.

Defined cases: null text has no terms and such a document counts nowhere; an item without known terms has no rows; rows that repeat
an item id are items of their own; rows that repeat a doc_id are documents of their own; a null doc_id comes after all others of equal score; an empty
table gives an empty result; extra columns are ignored; texts have no length limit.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

TOP = 20
BLOCK = 2048
STEP = 64
BATCH_CHARS = 1 << 23

# Bytes that end a term become spaces, A-Z become a-z; bytes beyond ASCII are parts of characters of terms.
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

INDEX = "ids array<string>, n array<long>, terms array<int>, ends array<int>, docs array<int>, tf array<long>, " \
        "with_terms long, all_terms long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The saturated frequency of terms met ``tf`` times in documents of ``n`` terms."""
    # 25 * n * n_docs may pass 64 bits: Python's integers, once per document length
    sizes, back = np.unique(n, return_inverse=True)
    m = np.array([75 + 25 * int(x) * n_docs // all_terms for x in sizes], np.int64)[back]
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _index_block(ids: list, texts: list, number: dict[bytes, int]) -> dict:
    """One row of the index: the postings of a block of documents, by term."""
    terms, docs, tf, sizes = [], [], [], []
    for k, text in enumerate(texts):
        found = terms_of(text)
        sizes.append(len(found))
        counts = Counter(found)
        # the smaller of the two is walked
        for w in (counts.keys() & number.keys()):
            terms.append(number[w])
            docs.append(k)
            tf.append(counts[w])
    terms, docs, tf = np.array(terms, np.int32), np.array(docs, np.int32), np.array(tf, np.int64)
    order = np.lexsort((docs, terms))
    known, first = np.unique(terms[order], return_index=True)
    return {"ids": ids, "n": sizes, "terms": known, "ends": np.append(first[1:], len(order)).astype(np.int32) if len(known) else [],
            "docs": docs[order], "tf": tf[order], "with_terms": sum(x > 0 for x in sizes), "all_terms": sum(sizes)}


_ARROW = pa.schema([("ids", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("terms", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
                    ("docs", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64())), ("with_terms", pa.int64()), ("all_terms", pa.int64())])


def build_index(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per block of documents: their ids and term counts, and the postings of the vocabulary's terms."""
    number = {w: k for k, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars = [], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                ids += part.column(0).to_pylist()
                texts += part.column(1).to_pylist()
                chars += part.column(1).nbytes
                if len(ids) >= block or chars > 1 << 24:
                    yield pa.RecordBatch.from_pylist([_index_block(ids, texts, number)], _ARROW)
                    ids, texts, chars = [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_index_block(ids, texts, number)], _ARROW)

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


class _Best:
    """The best rows of one item so far in a task: (-score, no id, id, id as text). ``whole``: ids are whole numbers."""

    def __init__(self, top: int, whole: bool = True):
        self.top, self.whole, self.rows = top, whole, []

    def floor(self) -> int:
        """A score below this cannot enter."""
        return -self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        for score, i in zip(scores.tolist(), ids):
            self.rows.append((-score, i is None, 0 if i is None else int(i) if self.whole else i, i))
        self.rows.sort(key=lambda r: r[:3])
        del self.rows[self.top:]


def best_of_block(terms: np.ndarray, weights: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: list,
                  best: _Best, step: int = STEP) -> int:
    """Enter a block's best documents for one item. postings: (documents, saturated frequencies) of each of its terms.
    Returns the number of documents evaluated."""
    present, value = np.zeros((len(terms), n_docs), bool), np.zeros((len(terms), n_docs), np.int64)
    for k, (docs, f) in enumerate(postings):
        present[k, docs], value[k, docs] = True, f
    packed = np.packbits(present, axis=0)  # a column is a document's mask
    masks, group = np.unique(np.ascontiguousarray(packed.T).view([("", np.uint8)] * packed.shape[0]).ravel(), return_inverse=True)
    bits = np.unpackbits(masks.view(np.uint8).reshape(len(masks), -1), axis=1)[:, :len(terms)].astype(np.int64)
    most = bits @ (weights * np.array([f.max() for _, f in postings]))
    order = np.argsort(-most, kind="stable")
    by_mask = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=len(masks)))
    done = 0
    for at in range(0, len(order), step):
        some = order[at:at + step]
        some = some[most[some] >= max(best.floor(), 1)]
        if not len(some):
            break
        docs = np.concatenate([by_mask[(ends[m - 1] if m else 0):ends[m]] for m in some.tolist()])
        done += len(docs)
        scores = weights @ value[:, docs]
        may = scores >= max(best.floor(), 1)
        docs, scores = docs[may], scores[may]
        if len(docs) > best.top:  # ties at the edge stay in, for their ids
            may = scores >= np.partition(scores, len(scores) - best.top)[len(scores) - best.top]
            docs, scores = docs[may], scores[may]
        best.add(scores, [ids[d] for d in docs.tolist()])
    return done


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", top: int = TOP, batch_chars: int = BATCH_CHARS, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    named = items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    total = named.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, -(-total // batch_chars))
    named = named.withColumn("batch", F.pmod(F.xxhash64("item", "text"), F.lit(batches)))
    results = [_rank_batch(docs, [(r.item, r.text) for r in named.filter(F.col("batch") == k).orderBy("item", "text").collect()],
                           id_col, text_col, top, block) for k in range(batches)]
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").cast(item_kind).alias("item_id"), F.col("rank"), F.col("doc").cast(kind).alias("doc_id"), "score")


def _rank_batch(docs: DataFrame, items: list[tuple[str | None, str]], id_col: str, text_col: str, top: int, block: int) -> DataFrame:
    """(item, rank, doc, score) for one batch of items."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    wanted = [Counter(terms_of(text)) for _, text in items]
    vocabulary = sorted(set().union(*wanted))
    number = {w: k for k, w in enumerate(vocabulary)}
    index = staged(build_index(docs, vocabulary, id_col, text_col, block), "search-index")
    n_docs, all_terms = (x or 0 for x in index.agg(F.sum("with_terms"), F.sum("all_terms")).first())
    # documents per term: a block's ends are running counts; summed per task before the shuffle
    sizes = F.transform("ends", lambda e, i: e - F.when(i == 0, 0).otherwise(F.get("ends", i - 1)))
    counted = index.select(F.explode(F.arrays_zip(F.col("terms").alias("t"), sizes.alias("d"))).alias("x")).groupBy("x.t").agg(F.sum("x.d"))
    df = dict(map(tuple, counted.collect()))  # one row per term of the batch
    weight = {k: term_weight(n_docs, d) for k, d in df.items()}
    plans = []  # per item: its known terms with a weight, and weight times repeats
    for counts in wanted:
        known = sorted((number[w], c) for w, c in counts.items() if weight.get(number[w], 0) > 0)
        plans.append((np.array([t for t, _ in known], np.int64), np.array([weight[t] * c for t, c in known], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top, whole) for _ in plans]
        for b in batches:
            for k in range(b.num_rows):
                one = {c: b.column(c)[k] for c in ("ids", "n", "terms", "ends", "docs", "tf")}
                ids = one["ids"].as_py()
                n, terms, ends, at, tf = (np.asarray(one[c].values) for c in ("n", "terms", "ends", "docs", "tf"))
                if not len(terms):
                    continue
                f = saturated(tf, n[at], n_docs, all_terms)
                place = dict(zip(terms.tolist(), range(len(terms))))
                for (wants, weights), mine in zip(plans, best):
                    have = [j for j, t in enumerate(wants.tolist()) if t in place]
                    if have:
                        spans = [(ends[p - 1] if p else 0, ends[p]) for p in (place[t] for t in wants[have].tolist())]
                        best_of_block(wants[have], weights[have], [(at[s:e], f[s:e]) for s, e in spans], len(ids), ids, mine)
        rows = [(k, r[3], -r[0]) for k, mine in enumerate(best) for r in mine.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["k", "doc", "score"])

    found = index.select("ids", "n", "terms", "ends", "docs", "tf").mapInArrow(run, "k int, doc string, score long")
    order = Window.partitionBy("k").orderBy(F.desc("score"), F.col("doc").cast(kind).asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], "k int, item string")
    return ranked.join(names, "k").select("item", "rank", "doc", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
totals AS (SELECT count(*) AS n_docs, sum(len(ws)) AS all_terms FROM d WHERE len(ws) > 0),
tf AS (SELECT r, doc_id, n, w, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, totals GROUP BY w, n_docs),
i AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT k, item_id, w, count(*) AS c FROM (SELECT k, item_id, unnest(ws) AS w FROM i) GROUP BY ALL),
s AS (SELECT k, item_id, doc_id, r, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // all_terms)))) AS score
  FROM q JOIN df USING (w) JOIN tf USING (w), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 20
"""
