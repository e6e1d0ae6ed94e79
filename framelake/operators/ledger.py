"""Memory ledger as an event table: running total, peak, admission, per-tag state.

Ledger rows: seq (unique, increasing), tag, op ('alloc' | 'dealloc'), bytes.
A total that clamps at zero on every deallocation is the reflected running
sum  S_t = C_t - least(0, min_{u<=t} C_u)  with C the plain running sum of
signed bytes, so the clamp needs no sequential loop. Running sums and minima
are segmented and fused into two window passes
(``ordered.clamped_running_total``): the global ledger has no key, and a plain
``Window.orderBy(seq)`` would put every event into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.plans import ordered

MIB = 1024 * 1024


def _signed(df: DataFrame) -> DataFrame:
    return df.withColumn("_x", F.when(F.col("op") == "alloc", F.col("bytes")).otherwise(-F.col("bytes")))


def _reflected(df: DataFrame, keys: list[str], out: str, peak: str | None = None) -> DataFrame:
    """Adds ``out`` = clamp-at-zero running total within ``keys`` (needs _x, _seg)
    and, if asked, its running peak."""
    return ordered.clamped_running_total(df, keys, ["seq"], "_x", out, peak)


def ledger_running(ledger: DataFrame, limit_bytes: int | None = None,
                   required_bytes: int = 0, span: int | None = None) -> DataFrame:
    """W5 + W6 + W7: total after each event (clamped at 0), peak so far (starts
    at 0, never falls) and, if a limit is given, whether ``required_bytes``
    more would still fit (current + required <= limit)."""
    df = ordered.with_segments(_signed(ledger), ordered.span_segments("seq", span))
    df = _reflected(df, [], "total", peak="peak").drop("_x", ordered.SEG)
    if limit_bytes is not None:
        df = df.withColumn("admit", (F.col("total") + F.lit(required_bytes)) <= F.lit(limit_bytes))
    return df


def ledger_by_tag(ledger: DataFrame, span: int | None = None) -> DataFrame:
    """Bytes per tag after the last event.

    A deallocation clamps the tag at 0 and removes it when it reaches 0; a
    deallocation of an absent tag is ignored (same value as clamping at 0); an
    allocation (even of 0 bytes) makes the tag present. So a tag is present at
    the end iff its final value is > 0 or its last event is an allocation.
    """
    df = ordered.with_segments(_signed(ledger), ordered.span_segments("seq", span))
    df = _reflected(df, ["tag"], "value")
    last = df.groupBy("tag").agg(F.max_by(F.struct("value", "op"), F.col("seq")).alias("_l"))
    return (last.filter((F.col("_l.value") > 0) | (F.col("_l.op") == "alloc"))
            .select("tag", F.col("_l.value").alias("bytes")))


def ledger_report(by_tag: DataFrame) -> DataFrame:
    """MB per tag (integer division) plus a total row."""
    per = by_tag.select("tag", "bytes", F.expr(f"bytes div {MIB}").alias("mb"))
    total = by_tag.agg(F.lit("__total__").alias("tag"), F.sum("bytes").alias("bytes")).select(
        "tag", F.coalesce(F.col("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.expr(f"coalesce(bytes, 0) div {MIB}").alias("mb"))
    return per.unionByName(total)
