"""Batch ids, device assignment, frame ranks and count-based chunks.

All of these number rows in order. Positions come from the segmented
``dense_positions`` (never one task per key), after which every rule is plain
column arithmetic on the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.plans import ordered

MEMORY_PER_VIDEO_MB = 256


def batch_size(total: Column, max_memory_mb: int, num_threads: int) -> Column:
    """I8: min(max(1, memory / 256 MiB), threads, count), floored at 1."""
    by_mem = max(1, max_memory_mb // MEMORY_PER_VIDEO_MB)
    return F.greatest(F.least(F.lit(by_mem), F.lit(num_threads), total), F.lit(1))


def assign_batches(items: DataFrame, order_col: str, max_memory_mb: int, num_threads: int,
                   keys: list[str] | None = None) -> DataFrame:
    """I8: batch id = position div batch size, positions in ``order_col`` order."""
    keys = keys or []
    df = ordered.with_segments(items, ordered.span_segments(order_col))
    df = ordered.dense_positions(df, keys, [order_col], out="pos").drop(ordered.SEG)
    if keys:
        counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        df = df.join(counts, keys)
    else:
        df = df.withColumn("_n", F.lit(items.count()))  # one scalar, computed by Spark
    size = batch_size(F.col("_n"), max_memory_mb, num_threads)
    return df.withColumn("batch_size", size).withColumn(
        "batch_id", (F.col("pos") / F.col("batch_size")).cast("long")).drop("_n")


def assign_round_robin(with_pos: DataFrame, n_devices: int, pos: str = "pos") -> DataFrame:
    """device = position mod n."""
    return with_pos.withColumn("device", F.pmod(F.col(pos), F.lit(n_devices)))


def frame_rank(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """1-based labels 'Frame i' and 'i of n' (frame_idx is already dense)."""
    j = frames.join(sizes, "video_id")
    i = F.col("frame_idx") + 1
    return j.select("video_id", "frame_idx",
                    F.concat(F.lit("Frame "), i.cast("string")).alias("label"),
                    F.concat(i.cast("string"), F.lit(" of "), F.col("total_frames").cast("string")).alias("of_n"))


def chunk_by_count(frames: DataFrame, n: int, pos: str = "frame_idx") -> DataFrame:
    """Consecutive chunks of n frames per video; the last partial chunk is kept."""
    return (frames.withColumn("chunk", F.expr(f"`{pos}` div {n}"))
            .withColumn("chunk_pos", F.expr(f"pmod(`{pos}`, {n})")))
