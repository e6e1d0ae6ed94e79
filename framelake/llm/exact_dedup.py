"""Exact deduplication with a two-pass Bloom filter over text digests.

Pass 1 hashes every text to two slots of a bit table and keeps the slots that
two or more rows hit. Pass 2 tests each row: only a row whose two slots were both
hit repeatedly can have a copy. Those rows shuffle by digest; all others pass
straight through. A copy always hits its twin's slots, so the filter never
loses one, and a false alarm only costs a shuffled row.

The filter is a table of 4 KB bitmaps, at most ``MAX_BITS / 8`` bytes in all, which
is the proven bound for broadcasting it. With more rows than the filter has room
for, more rows shuffle and the results stay the same.

Defined cases: a null text counts as empty; of equal texts the row with the smallest
id stays; a null id is greater than any id (it stays only in a group of null ids);
rows that repeat an id and its text are one document and share its verdict
(``drop_copies`` returns it once). An empty table gives an empty result. Extra columns
are ignored by ``copy_groups`` and passed through by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_spaces, read_table, staged

BITS_PER_ROW = 16
MIN_BITS = 1 << 15
MAX_BITS = 1 << 29  # 64 MB of bitmaps
BUCKET_BITS = 1 << 15  # bits of one bitmap, fixed by bitmap_construct_agg


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space as one space."""
    return F.sha2(even_spaces(text).cast("binary"), 256)


def _slots(digest: Column, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    return [F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)), h.bitwiseAND(F.lit(bits - 1))]


def _filter_bits(rows: int) -> int:
    return max(MIN_BITS, min(MAX_BITS, 1 << (rows * BITS_PER_ROW - 1).bit_length() if rows else MIN_BITS))


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: (bucket, bitmap) of the slots hit by at least two rows of ``digest``."""
    hits = digests.select(F.explode(F.array(*_slots(F.col("digest"), bits))).alias("slot"))
    twice = hits.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (twice.groupBy(F.shiftright("slot", 15).alias("bucket"))
            .agg(F.expr(f"bitmap_construct_agg(slot & {BUCKET_BITS - 1})").alias("bitmap")))


def _has_bit(bitmap: str, slot: Column) -> Column:
    pos = slot.bitwiseAND(F.lit(BUCKET_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(pos, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, pos.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
    return F.coalesce(bit == 1, F.lit(False))


def possibly_repeated(df: DataFrame, digest: str, repeated: DataFrame, bits: int, flag: str) -> DataFrame:
    """Pass 2: add the boolean column ``flag``, false only where no other row has the digest."""
    one, two = _slots(F.col(digest), bits)
    out = df
    for k, slot in enumerate((one, two)):
        side = repeated.select(F.col("bucket").alias(f"__bucket{k}"), F.col("bitmap").alias(f"__bitmap{k}"))
        out = out.join(F.broadcast(side), F.shiftright(slot, 15) == F.col(f"__bucket{k}"), "left")
    out = out.withColumn(flag, _has_bit("__bitmap0", one) & _has_bit("__bitmap1", two))
    return out.drop("__bucket0", "__bitmap0", "__bucket1", "__bitmap1")


def _groups(rows: DataFrame) -> DataFrame:
    """Of possibly repeated (doc_id, digest) rows: the id that stays and the group's size."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    thin = staged(docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest")),
                  "exact-digests")
    bits = _filter_bits(thin.count())
    marked = possibly_repeated(thin, "digest", staged(repeated_slots(thin, bits), "exact-filter"), bits, "maybe")
    alone = marked.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"))
    maybe = marked.filter("maybe").select("doc_id", "digest")
    # a written table has no partitioning of its own: both sides are exchanged for the join alone, so that
    # AQE can split the partition of a hot digest
    several = maybe.join(staged(_groups(maybe), "exact-groups"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))
    return alone.unionByName(several)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each group of equal texts. Whole rows shuffle only
    where the filter found a possible copy, and by (digest, id), so that a hot text spreads."""
    named = docs.withColumn("__digest", text_digest(F.col(text_col)))
    thin = staged(named.select(F.col(id_col).alias("doc_id"), F.col("__digest").alias("digest")), "exact-digests")
    bits = _filter_bits(thin.count())
    repeated = staged(repeated_slots(thin, bits), "exact-filter")
    groups = _groups(possibly_repeated(thin, "digest", repeated, bits, "maybe").filter("maybe"))
    groups = staged(groups.select(F.col("digest").alias("__of"), F.col("keep_id").alias("__keep")), "exact-groups")
    marked = possibly_repeated(named, "__digest", repeated, bits, "__maybe")
    stays = marked.filter("__maybe").join(
        groups, (F.col("__digest") == F.col("__of")) & F.col(id_col).eqNullSafe(F.col("__keep")), "left_semi")
    stays = stays.dropDuplicates(["__digest", id_col])
    return marked.filter(~F.col("__maybe")).unionByName(stays).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
