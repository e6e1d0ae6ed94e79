"""Quality rules with host-level verdicts, in DataFrame functions only.

Per document, over the whole text: counts of words, symbols, repeated lines and words in repeated
8-word windows, and which rules the document fails. Per host: failures of every rule are summed, and
the failure rates are shrunk with a beta prior fitted to all hosts by moments (mean, and variance
beyond binomial noise), so that a host with few documents is judged mostly by the corpus.
A host with a shrunk rate over ``HOST_LIMIT`` for some rule is rejected, and the verdict is joined back:
a document is kept unless it fails a base rule itself or its host is rejected.

Windows are compared by chained 64-bit hashes; only for texts where two hashes agree are the
windows sorted, and their words compared. Texts never shuffle: one pass writes the counts, and
host sums combine before their shuffle, so a host with a third of all rows is one row per task.

Defined cases: null text has no words and fails the base; documents without a host get no host verdict;
an empty table gives an empty result; repeated rows count and are judged each; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table, staged

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
HOST_LIMIT = 0.5
SYMBOL = r"[^#*$%&|<>]+"

#: rule -> SQL condition under which a document fails it
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}


def _chain(prev: str, n: str, step: int) -> Column:
    """Hash pairs (x[i], x[i + step]); ``n`` is the size of the result."""
    size = F.greatest(F.expr(n), F.lit(0))
    return F.zip_with(F.slice(prev, 1, size), F.slice(F.col(prev), F.lit(step + 1), size),
                      lambda a, b: F.xxhash64(a, b))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    host_col: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.select("*", F.array_remove(F.split("text", f"{SPACE}+"), "").alias("words"),
                 F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    t = t.select("doc_id", "host", "words", F.size("words").alias("n"),
                 F.length(F.array_join("words", "")).alias("word_chars"),
                 F.length(F.regexp_replace("text", SYMBOL, "")).alias("n_symbols"),
                 F.size("lines").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"))
    t = t.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    for last, new, n, step in (("h1", "h2", "n - 1", 1), ("h2", "h4", "n - 3", 2), ("h4", "h8", "n - 7", 4)):
        t = t.withColumn(new, _chain(last, n, step)).drop(last)
    # only texts with two equal hashes go on; the others have no repeated window
    some = F.size("h8") > F.size(F.array_distinct("h8"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    t = t.withColumn("s", F.when(some, F.array_sort(F.transform(
        "h8", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))).otherwise(none)).drop("h8")
    t = t.withColumn("at", F.expr(f"""array_sort(transform(filter(s, (x, k) ->
        (k > 0 AND s[k - 1].h = x.h AND slice(words, s[k - 1].i, {WINDOW}) = slice(words, x.i, {WINDOW})) OR
        (k + 1 < size(s) AND s[k + 1].h = x.h AND slice(words, s[k + 1].i, {WINDOW}) = slice(words, x.i, {WINDOW}))),
        x -> x.i))""")).drop("s", "words")
    covered = F.expr(f"""if(size(at) = 0, 0, aggregate(zip_with(slice(at, 2, size(at)), slice(at, 1, size(at) - 1),
        (b, a) -> least({WINDOW}, b - a)), {WINDOW}, (x, y) -> x + y))""")
    longs = {"n_words": F.col("n"), "word_chars": F.col("word_chars"), "n_symbols": F.col("n_symbols"),
             "n_lines": F.col("n_lines"), "n_dup_lines": F.col("n_dup_lines"), "n_repeat_words": covered}
    return t.select("doc_id", "host", *[c.cast("long").alias(k) for k, c in longs.items()])


def host_rates(counts: DataFrame) -> DataFrame:
    """(host, docs, one shrunk failure rate per rule) of all hosts."""
    fails = [F.sum(F.when(F.expr(e), 1).otherwise(0)).alias(f"f_{k}") for k, e in RULES.items()]
    hosts = staged(counts.filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *fails),
                   "quality-hosts")
    prior = {}
    stats = [F.sum("docs"), F.count(F.lit(1))]
    for k in RULES:
        stats += [F.sum(f"f_{k}"), F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("docs"))]
    row = hosts.agg(*stats).first()  # one row of sums
    for i, k in enumerate(RULES):
        prior[k] = beta_prior(row[0] or 0, row[1], row[2 + 2 * i] or 0, row[3 + 2 * i] or 0.0)
    return hosts.select("host", "docs", *[((F.col(f"f_{k}") + F.lit(a)) / (F.col("docs") + F.lit(a + b))).alias(k)
                                          for k, (a, b) in prior.items()])


def beta_prior(docs: int, hosts: int, fails: float, squares: float) -> tuple[float, float]:
    """Alpha and beta by moments, from the sums over hosts of documents, failures and failures**2 / documents."""
    if not docs:
        return 1.0, 1.0
    mean = min(max(fails / docs, 1e-6), 1 - 1e-6)
    spread = squares / docs - mean * mean  # variance of host rates, weighted by documents
    beyond = max(spread - mean * (1 - mean) * hosts / docs, 1e-9)
    size = min(max(mean * (1 - mean) / beyond - 1, 1.0), 1e6)
    return mean * size, (1 - mean) * size


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its counts, base_failed, host_rejected and kept."""
    counts = staged(document_counts(docs, id_col, text_col, host_col), "quality-counts")
    rejected = host_rates(counts).filter(F.greatest(*RULES) > host_limit).select(F.col("host").alias("__host"))
    base = F.expr(f"({RULES['few_words']}) OR ({RULES['repeats']})")
    out = counts.join(rejected, F.col("host") == F.col("__host"), "left").withColumn("base_failed", base)
    out = out.withColumn("host_rejected", F.col("__host").isNotNull())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "host_rejected", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    rules = RULES
    fails = ", ".join(f"sum(CASE WHEN {e} THEN 1 ELSE 0 END) AS f_{k}" for k, e in rules.items())
    rates = []
    for k in rules:
        mean = f"least(greatest(sum(f_{k}) OVER () / sum(docs) OVER (), 1e-6), 1 - 1e-6)"
        spread = f"(sum(f_{k} * f_{k} / docs) OVER () / sum(docs) OVER () - {mean} * {mean})"
        beyond = f"greatest({spread} - {mean} * (1 - {mean}) * count(*) OVER () / sum(docs) OVER (), 1e-9)"
        size = f"least(greatest({mean} * (1 - {mean}) / {beyond} - 1, 1.0), 1e6)"
        rates.append(f"(f_{k} + {mean} * {size}) / (docs + {size})")
    return rf"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt, i + 8) - i)) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY 1),
c AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN cov USING (doc_id)),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS docs, {fails} FROM c WHERE host IS NOT NULL GROUP BY 1),
r AS (SELECT host, greatest({", ".join(rates)}) > {HOST_LIMIT} AS host_rejected FROM h),
v AS (SELECT c.*, ({rules['few_words']}) OR ({rules['repeats']}) AS base_failed,
    coalesce(host_rejected, false) AS host_rejected FROM c LEFT JOIN r ON c.host = r.host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM v
"""


ORACLE = _oracle()
