"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over all word windows.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all other characters beyond ASCII. A window is
``WINDOW`` consecutive words of an item; an item with fewer words is one window of all of them.

The scan is one narrow pass. Every window has an anchor, its longest word. In a text, only the windows around words that are
some window's anchor can be in the set; the others are passed over by one lookup a word. The windows around anchors meet the set of hashes
in a broadcast join. Only hits, and one row per document, leave the pass. A hit carries its words, which are
verified against the items' windows, so a hash collision hits nothing. Anchors are looked up in lower case of all letters, which
merges more words than the lower case of A-Z does and so loses none; windows are taken from the latter.

The set is broadcast: ``MAX_WINDOWS`` hashes and as many anchors at most, under 16 MB. More windows are dealt by hash into
several sets, one pass each; the rows are then numbered once, in a written table, so that all passes agree.

Which items a document holds is found once per distinct set of verified windows, not once per document: documents that
share one passage, a third of all rows perhaps, share that work and no (document, item) pair is made for them.

Defined cases: null text has no words; an item without words has no window and a null item is such an item; items
that share an id are one item; an item id that is null is the empty string; rows that repeat an id are judged each; an empty
table gives an empty result, and without items nothing is hit. Extra columns are ignored by ``judge`` and passed
through by ``remove_documents`` and ``remove_spans``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, read_table, staged

WINDOW = 10
MAX_WINDOWS = 1 << 16
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIGMA, SMALL_SIGMA = "\u03a3", "\u03c3"  # the one letter whose lower case depends on the letters beside it


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def _folded(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(SIGMA), F.lit(SMALL_SIGMA)))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(gram, size, anchor, at, item): the distinct windows of every item; a gram is its words with single spaces, the anchor its
    longest word (the first of equals), at its place."""
    n = F.size("words")
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.array_join(
        F.slice("words", i + 1, window), " "))).when(n > 0, F.array(F.array_join("words", " ")))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("item", F.explode(grams).alias("gram")).distinct().withColumn("words", F.split("gram", " "))
    best = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return rows.select("gram", F.size("words").alias("size"), best["w"].alias("anchor"), (-best["i"]).alias("at"), "item")


def _scan(rows: DataFrame, windows: DataFrame, window: int, every_row: bool) -> DataFrame:
    """(__row, __n, start, size, gram) of the texts' windows whose hash is in the set; ``every_row``: and one row each with a null start."""
    anchors = [r[0] for r in windows.select(_folded(F.col("anchor"))).distinct().collect()]  # MAX_WINDOWS at most
    places = windows.select(F.col("anchor").alias("__anchor"), "at", "size").distinct()
    hashes = windows.select(F.xxhash64("gram").alias("__set")).distinct()
    # the class of gaps names A-Z too, which the lower-cased text does not have
    t = rows.select("__row", "__text", F.array_remove(F.split(_folded(F.col("__text")), GAP), "").alias("__low"))
    t = t.withColumn("__n", F.size("__low"))
    # words have no quotes or backslashes; as one text the list is parsed once, not sent literal by literal
    known = ", ".join(f"'{w}'" for w in anchors) or "NULL"
    seen = F.expr(f"filter(sequence(0, __n - 1), i -> __low[i] IN ({known}))")
    t = t.withColumn("__seen", F.when(F.col("__n") > 0, seen)).drop("__low")
    t = t.withColumn("__words", F.when(F.size("__seen") > 0, words_of(F.col("__text")))).drop("__text")
    # an anchor and the words that its windows may reach, so that no row carries a whole text
    # (a column named twice is computed once, before the lambda, not for each of its elements)
    around = F.when(F.col("__words").isNotNull(), F.transform("__seen", lambda p: F.struct(
        p.alias("p"), F.least(p, F.lit(window - 1)).alias("a"), F.slice("__words", F.greatest(p - (window - 2), F.lit(1)), 2 * window - 1).alias("near"))))
    kind = "array<struct<p:int,a:int,near:array<string>>>"
    t = t.withColumn("__around", F.concat(F.array(F.lit(None)).cast(kind), F.coalesce(around, F.array().cast(kind))))
    # outer: else the planner guards the explode by a filter on the array's size and computes the whole array twice, word by word
    t = t.select("__row", "__n", F.explode_outer("__around").alias("c"))
    met = t.join(F.broadcast(places), F.get("c.near", F.col("c.a")) == F.col("__anchor"), "left")
    inside = (F.col("c.a") >= F.col("at")) & (F.size("c.near") >= F.col("c.a") - F.col("at") + F.col("size"))
    gram = F.when(inside, F.array_join(F.slice("c.near", F.col("c.a") - F.col("at") + 1, F.col("size")), " "))
    met = met.select("__row", "__n", (F.col("c.p") - F.col("at")).alias("start"), "size", gram.alias("gram"), F.col("c").isNull().alias("row"))
    met = met.filter("row OR gram IS NOT NULL").join(F.broadcast(hashes), F.xxhash64("gram") == F.col("__set"), "left")
    return met.filter("row OR __set IS NOT NULL" if every_row else "__set IS NOT NULL").select("__row", "__n", "start", "size", "gram")


def find(docs: DataFrame, items: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: ``columns``, n_words, spans (sorted [start, end) in words, verified), n_hit, n_items, items_sha256."""
    windows = staged(item_windows(items, item_col, item_text, window), "leak-windows")
    grams = windows.drop("item").distinct()
    passes = -(-grams.count() // max_windows) or 1
    rows = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.monotonically_increasing_id().alias("id")).alias("__row"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if passes > 1:
        # twice as many sets as full ones would be, so that sets dealt by hash stay under the bound
        rows, passes = staged(rows, "leak-texts"), 2 * passes
        sets = staged(grams.withColumn("p", F.pmod(F.xxhash64("gram"), F.lit(passes))), "leak-sets")
        found = [_scan(rows, sets.filter(F.col("p") == p), window, p == 0) for p in range(passes)]
        hits = found[0]
        for other in found[1:]:
            hits = hits.unionByName(other)
    else:
        hits = _scan(rows, grams, window, True)
    hits = staged(hits, "leak-hits")
    seen = hits.filter("gram IS NOT NULL").join(grams.select("gram"), "gram", "left_semi")  # verified
    kept = hits.filter("gram IS NULL").select("__row", "__n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"),
                                               F.lit(None).cast("string").alias("gram"))
    every = kept.unionByName(seen.select("__row", F.lit(None).cast("int").alias("__n"), "start", (F.col("start") + F.col("size")).alias("end"), "gram"))
    # collect_list and collect_set leave nulls out; both are bounded by the document's own windows
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    per = every.groupBy("__row").agg(F.max("__n").alias("n_words"), F.sort_array(F.collect_list(span)).alias("spans"),
                                     F.sort_array(F.collect_set("gram")).alias("grams"))
    covered = F.expr("""aggregate(spans, struct(0L AS n, 0 AS last),
        (a, s) -> struct(a.n + greatest(0, s.end - greatest(s.start, a.last)) AS n, greatest(a.last, s.end) AS last), a -> a.n)""")
    mark = F.when(F.size("grams") > 0, F.sha2(F.array_join("grams", "\n"), 256))
    per = staged(per.select("__row", "n_words", "spans", covered.alias("n_hit"), "grams", mark.alias("mark")), "leak-rows")
    # one row per distinct set of windows: which items it means
    marks = per.filter("mark IS NOT NULL").groupBy("mark").agg(F.first("grams").alias("grams"))
    held = marks.select("mark", F.explode("grams").alias("gram")).join(windows.select("gram", "item"), "gram")
    held = held.groupBy("mark").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held = staged(held.select(F.col("mark").alias("__mark"), F.size("items").cast("long").alias("held"),
                              F.sha2(F.array_join("items", ","), 256).alias("digest")), "leak-items")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return per.join(held, F.col("mark") == F.col("__mark"), "left").select(
        *[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(columns)], F.col("n_words").cast("long").alias("n_words"), "spans", "n_hit",
        F.coalesce("held", F.lit(0).cast("long")).alias("n_items"), F.coalesce("digest", nothing).alias("items_sha256"))


def judge(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return find(docs, items, (id_col,), text_col, window=window).select(
        F.col(id_col).alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def _hit_texts(docs: DataFrame, items: DataFrame, text_col: str, **options) -> DataFrame:
    """(__of, __spans) by digest of every distinct text with a hit."""
    named = docs.select(F.sha2(F.col(text_col).cast("binary"), 256).alias("of"), F.col(text_col).alias("text"))
    hit = find(named, items, ("of",), **options).filter("n_hit > 0")
    return staged(hit.groupBy("of").agg(F.first("spans").alias("__spans")).withColumnRenamed("of", "__of"), "leak-texts")


def remove_documents(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents without a hit, all columns."""
    texts = _hit_texts(docs, items, text_col, **options).select("__of")
    return docs.join(texts, F.sha2(F.col(text_col).cast("binary"), 256) == F.col("__of"), "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, all columns; hit words are cut out, each with what stands between it and the word before it."""
    texts = _hit_texts(docs, items, text_col, **options)
    met = docs.withColumn("__digest", F.sha2(F.col(text_col).cast("binary"), 256)).join(texts, F.col("__digest") == F.col("__of"), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(rf"(?s)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{word}"), F.lit(0))
    tail = F.regexp_extract(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    met = met.withColumn("__pieces", F.when(F.col("__of").isNotNull(), pieces))
    left = F.filter("__pieces", lambda x, i: ~F.exists("__spans", lambda s: (s["start"] <= i) & (i < s["end"])))
    text = F.when(F.col("__of").isNull(), F.col(text_col)).otherwise(F.concat(F.array_join(left, ""), tail))
    return met.withColumn(text_col, text).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH it AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(ws[i:i + 9], ' ') AS gram, least(len(ws), 10) AS size
  FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM it WHERE len(ws) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
pos AS (SELECT r, size, i, array_to_string(ws[i:i + size - 1], ' ') AS gram
  FROM (SELECT r, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM doc, sizes WHERE len(ws) >= size)),
hit AS (SELECT r, i, size, gram FROM pos WHERE gram IN (SELECT gram FROM win)),
cov AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS w FROM hit) GROUP BY 1),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT r, item FROM hit JOIN win USING (gram)) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
