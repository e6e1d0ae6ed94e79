"""Rollups of per-frame analysis rows: per video, per batch, latency, summaries.

Input rows follow the ``analyses`` shape: video_id, frame_idx, success,
description, error, processing_time, model_used. Every per-video aggregate
here is a partial (map-side combined) aggregate -- counts, sums, bool_or,
max_by -- so a video holding a third of all rows is reduced before the
shuffle. The one order-dependent string aggregate (A2) joins parts of consecutive
frames first and then the parts of a video, and the per-frame details stay a
table keyed by video instead of a nested array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.plans import ordered
from framelake.plans.joins import materialize

# Texts and thresholds of the reference's summaries.
NO_FRAMES = "No frames were successfully analyzed."
NO_MEANINGFUL = "Video analysis completed but no meaningful descriptions were generated."
CPU_HEAD = "Video analysis of {n} frames completed."
GPU_HEAD = "GPU-analyzed video with {n} frames processed successfully."
PRIMARY = "Primary content: "
CPU_GENERIC = "Video contains visual content that was analyzed frame by frame."
GPU_GENERIC = "Video contains visual content analyzed via GPU acceleration."
NO_DESCRIPTION = "No description available"
OBSERVATION_SEP = " | "
LONG_ENOUGH = 50        # longest description used only if longer than this
GPU_MEANINGFUL = 10     # GPU path keeps descriptions longer than this
SUMMARY_FAILED = "Failed to generate video summary."
THEMES = {
    "person": ["person", "people", "man", "woman", "individual"],
    "action": ["showing", "demonstrating", "performing", "doing", "using"],
    "object": ["object", "item", "tool", "device", "equipment"],
    "setting": ["room", "indoor", "outdoor", "background", "environment"],
}

# Python's str.strip() whitespace for the texts we see; spelled out so every
# engine agrees (a bare \s differs on vertical tab).
WS_CHARS = " \t\n\r\f\x0b"

# Frames per part of the joined observation text (A2).
OBSERVATION_PART_FRAMES = 4096


def strip_ws(c: Column) -> Column:
    """Both-sides trim of the whitespace set (linear, no regex)."""
    return F.trim(c, F.lit(WS_CHARS))


def filter_successful(df: DataFrame) -> DataFrame:
    """Rows with success (missing = false)."""
    return df.filter(F.coalesce(F.col("success"), F.lit(False)))


def meaningful_cpu(desc: Column) -> Column:
    """P12 (CPU): stripped description non-empty and not the placeholder text."""
    s = strip_ws(F.coalesce(desc, F.lit("")))
    return (F.length(s) > 0) & (s != F.lit(NO_DESCRIPTION))


def meaningful_gpu(desc: Column) -> Column:
    """P12 (GPU): raw description longer than 10 characters."""
    return F.length(F.coalesce(desc, F.lit(""))) > GPU_MEANINGFUL


def summary_parts(df: DataFrame, carry: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """Per-video pieces both fallback summaries need (all partial aggregates).

    The per-row texts (stripped, lower-cased) and keyword flags are computed
    once in a projection, so long descriptions are scanned a fixed number of
    times whatever the number of keywords. ``more`` aggregates over the ``carry``
    columns (and ``_ok``) are computed in the same pass.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    rows = df.select(
        "video_id", "frame_idx", ok.alias("_ok"),
        strip_ws(F.coalesce(F.col("description"), F.lit(""))).alias("_s"),
        F.coalesce(F.col("description"), F.lit("")).alias("_raw"), *carry)
    rows = rows.select(
        "video_id", "frame_idx", "_ok", "_s", "_raw", *carry,
        (F.col("_ok") & (F.length("_s") > 0) & (F.col("_s") != F.lit(NO_DESCRIPTION))).alias("_cpu"),
        (F.col("_ok") & (F.length("_raw") > GPU_MEANINGFUL)).alias("_gpu"),
        F.length("_s").alias("_ls"), F.length("_raw").alias("_lr"), F.lower("_s").alias("_low"))
    rows = rows.select("*", *[
        (F.col("_cpu") & F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: F.contains(F.col("_low"), k)))
        .alias(f"_t_{name}") for name, kws in THEMES.items()])
    neg = -F.col("frame_idx")
    return rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("_ok").alias("n_success"),
        F.count_if("_cpu").alias("n_cpu_meaningful"),
        F.count_if("_gpu").alias("n_gpu_meaningful"),
        # O3: longest kept description, the first in frame order wins ties
        F.max_by(F.when(F.col("_cpu"), F.col("_s")), F.when(F.col("_cpu"), F.struct("_ls", neg))).alias("cpu_longest"),
        F.max_by(F.when(F.col("_gpu"), F.col("_raw")), F.when(F.col("_gpu"), F.struct("_lr", neg))).alias("gpu_longest"),
        *[F.bool_or(f"_t_{name}").alias(f"theme_{name}") for name in THEMES], *more)


def fallback_summary_cpu(parts: DataFrame) -> DataFrame:
    """A3: CPU fallback summary per video."""
    return parts.select("video_id", cpu_summary_text().alias("summary"))


def cpu_summary_text() -> Column:
    """A3 as a column over ``summary_parts``."""
    n = F.col("n_success")
    longest = F.col("cpu_longest")
    body = F.when(F.length(longest) > LONG_ENOUGH, F.concat(F.lit(PRIMARY), longest)).otherwise(F.lit(CPU_GENERIC))
    return (F.when(n == 0, F.lit(NO_FRAMES))
            .when(F.col("n_cpu_meaningful") == 0, F.lit(NO_MEANINGFUL))
            .otherwise(F.concat(F.lit("Video analysis of "), n.cast("string"),
                                F.lit(" frames completed. "), body)))


def fallback_summary_gpu(parts: DataFrame) -> DataFrame:
    """A4: GPU fallback summary per video (after the no-success check of the caller)."""
    n = F.col("n_success")
    longest = F.col("gpu_longest")
    head = F.concat(F.lit("GPU-analyzed video with "), n.cast("string"), F.lit(" frames processed successfully."))
    body = F.when(F.length(longest) > LONG_ENOUGH, F.concat(F.lit(PRIMARY), longest)).otherwise(F.lit(GPU_GENERIC))
    text = (F.when(n == 0, F.lit(NO_FRAMES))
            .when(F.col("n_gpu_meaningful") == 0, head)
            .otherwise(F.concat(head, F.lit(" "), body)))
    return parts.select("video_id", text.alias("summary"))


def theme_tags(parts: DataFrame) -> DataFrame:
    """A5: categories whose keywords occur (substring) in the meaningful texts."""
    tags = F.filter(F.array(*[F.when(F.col(f"theme_{k}"), F.lit(k)) for k in THEMES]), lambda x: x.isNotNull())
    return parts.select("video_id", tags.alias("themes"))


def join_observations(df: DataFrame, part_frames: int = OBSERVATION_PART_FRAMES) -> DataFrame:
    """A2: stripped successful descriptions joined by ' | ' in frame order, one text per
    video (video_id, first_frame, text).

    Two levels: parts of ``part_frames`` consecutive frames are joined first (so a hot
    video's rows spread over tasks), then the parts in part order.
    """
    ok = filter_successful(df).withColumn("_d", strip_ws(F.coalesce(F.col("description"), F.lit(""))))
    parts = (ok.withColumn("part", F.expr(f"frame_idx div {part_frames}"))
             .groupBy("video_id", "part")
             .agg(F.min("frame_idx").alias("first_frame"),
                  F.expr(f"listagg(_d, '{OBSERVATION_SEP}') WITHIN GROUP (ORDER BY frame_idx)").alias("_t")))
    return parts.groupBy("video_id").agg(
        F.min("first_frame").alias("first_frame"),
        F.expr(f"listagg(_t, '{OBSERVATION_SEP}') WITHIN GROUP (ORDER BY part)").alias("text"))


NO_FRAMES_ERROR = "No frames could be extracted from video"


def video_rollup(df: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """A1: one result per video (frame details stay in the frame table).

    success = any success; frames_analyzed = successful frames;
    total_frames_extracted = all frames; total_processing_time = sum rounded to 2;
    model = model of the first frame; summary = CPU fallback summary.
    With ``requested`` (video_id), requested videos without any frame row get
    the error result (success false, error 'No frames could be extracted from
    video').
    """
    if requested is not None:
        done = video_rollup(df)
        missing = requested.select("video_id").distinct().join(done.select("video_id"), "video_id", "left_anti")
        err = missing.select(
            "video_id", F.lit(False).alias("success"), F.lit(0).cast("long").alias("frames_analyzed"),
            F.lit(0).cast("long").alias("total_frames_extracted"),
            F.lit(None).cast("double").alias("total_processing_time"), F.lit(None).cast("string").alias("model_used"),
            F.lit(None).cast("string").alias("summary"), F.lit(NO_FRAMES_ERROR).alias("error"))
        return done.withColumn("error", F.lit(None).cast("string")).unionByName(err)
    parts = summary_parts(df, ("processing_time", "model_used"), (
        F.round(F.sum("processing_time"), 2).alias("total_processing_time"),
        F.min_by("model_used", "frame_idx").alias("model_used")))
    return parts.select(
        "video_id", (F.col("n_success") > 0).alias("success"), F.col("n_success").alias("frames_analyzed"),
        F.col("n_rows").alias("total_frames_extracted"), "total_processing_time", "model_used",
        cpu_summary_text().alias("summary"))


def frame_details(df: DataFrame, part_frames: int = OBSERVATION_PART_FRAMES) -> DataFrame:
    """A1's frame details, in order: (video_id, part, first_frame, n_frames, details) with the details of ``part_frames``
    consecutive frames as one array, so that no row grows with its video. A detail has what a frame's result
    has: success, timestamp, description or error, processing_time, the frame's label and its model."""
    detail = F.struct(F.col("frame_idx"), F.coalesce(F.col("success"), F.lit(False)).alias("success"), F.col("timestamp"), F.col("description"), F.col("error"),
                      F.col("processing_time"), F.concat(F.lit("Frame "), (F.col("frame_idx") + 1).cast("string")).alias("frame_description"),
                      F.col("model_used"))
    return df.groupBy("video_id", F.expr(f"frame_idx div {part_frames}").alias("part")).agg(
        F.min("frame_idx").alias("first_frame"), F.count(F.lit(1)).alias("n_frames"), F.sort_array(F.collect_list(detail)).alias("details"))


def batch_stats(results: DataFrame) -> DataFrame:
    """A6 + A7 + A8 over per-video results (success, total_processing_time).

    Time and average over successful videos only; pass rate in integer percent
    with the grade of the test script (all / mostly / attention).
    """
    ok = F.col("success")
    s = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.sum(F.when(ok, F.col("total_processing_time"))), F.lit(0.0)).alias("total_time"))
    rate = F.expr("if(total = 0, NULL, (successful * 100) div nullif(total, 0))")
    return s.select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
        F.round("total_time", 6).alias("total_time"),
        F.round(F.coalesce(F.try_divide("total_time", "successful"), F.lit(0.0)), 6).alias("avg_per_success"),
        F.round(F.try_divide("successful", "total"), 6).alias("success_ratio"),
        (F.col("successful") == F.col("total")).alias("all_passed"),
        rate.alias("pass_rate"),
        F.when(F.col("successful") == F.col("total"), F.lit("all"))
        .when(rate >= 80, F.lit("mostly")).otherwise(F.lit("attention")).alias("grade"))


def dedupe_results(results: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """A10: one row per key, the last one in input order wins (partial max_by)."""
    cols = [c for c in results.columns if c != key]
    last = F.max_by(F.struct(*cols), F.col(order)).alias("_r")
    return results.groupBy(key).agg(last).select(key, "_r.*")


def throughput(frames: Column, elapsed: Column, videos: Column) -> tuple[Column, Column]:
    """Frames per second and seconds per video (NULL on zero)."""
    return F.try_divide(frames, elapsed), F.try_divide(elapsed, videos)


def latency_profile(df: DataFrame, by: str = "model_used", approx: bool = False, memory: str | None = None) -> DataFrame:
    """Average, P95, P99 of frame time, success rate, frames per second, and with ``memory`` (a column of bytes in use)
    its peak.

    Exact: rows are counted per distinct value first (map-side), the counts are range-partitioned by
    (key, value), and a value's rank is the prefix within its partition plus the totals of
    earlier partitions of its key. No buffer holds the values of a key, however many
    there are. ``approx=True`` uses ``percentile_approx`` in one aggregation instead.
    """
    ok = F.coalesce(F.col("success"), F.lit(False))
    used = F.max(memory if memory else F.lit(None).cast("long"))
    peak = ["peak_memory"] if memory else []
    if approx:
        a = df.groupBy(by).agg(
            F.count(F.lit(1)).alias("frames"), F.avg("processing_time").alias("avg_time"),
            F.percentile_approx("processing_time", [0.95, 0.99], 10000).alias("_p"),
            F.avg(ok.cast("double")).alias("success_rate"), F.sum("processing_time").alias("_total"),
            used.alias("peak_memory"))
        return a.select(by, "frames", "avg_time", F.col("_p")[0].alias("p95_time"), F.col("_p")[1].alias("p99_time"),
                        "success_rate", F.try_divide(F.col("frames"), F.col("_total")).alias("frames_per_sec"), *peak)
    t = F.col("processing_time")
    counted = df.groupBy(by, t.alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.sum(ok.cast("long")).alias("_ok"), used.alias("_mem"))
    # written with their partition's id: ranks and totals below must see the same ids
    placed = materialize(counted.withColumn("_m", F.when(F.col("_t").isNotNull(), F.col("_n")).otherwise(0))
                         .repartitionByRange(by, "_t").withColumn(ordered.SEG, F.spark_partition_id().cast("long")), "latency")
    upto = Window.partitionBy(by, ordered.SEG).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    segs = placed.groupBy(by, ordered.SEG).agg(F.sum("_m").alias("_seg_m"))
    offsets = ordered.segment_prefix(segs, [by], "_seg_m", "_off").select(by, ordered.SEG, "_off")
    totals = placed.groupBy(by).agg(
        F.sum("_n").alias("frames"), F.sum("_m").alias("_all"), F.sum(F.col("_t") * F.col("_n")).alias("_total"),
        (F.sum("_ok") / F.sum("_n")).alias("success_rate"), F.max("_mem").alias("peak_memory"))
    ranked = ordered.null_safe_join(placed.withColumn("_c", F.sum("_m").over(upto)), offsets, [by, ordered.SEG])
    ranked = ordered.null_safe_join(ranked.select(by, "_t", (F.col("_off") + F.col("_c")).alias("_hi"), "_m"), totals, [by])

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_hi") - F.col("_m") <= rank) & (rank < F.col("_hi")), F.col("_t")))

    def percentile(p: float) -> Column:
        rank = F.lit(p) * (F.col("_all") - 1)
        part = F.first(rank - F.floor(rank))
        return at(F.floor(rank)) * (1 - part) + at(F.ceil(rank)) * part

    names = ["frames", "_all", "_total", "success_rate", "peak_memory"]
    a = ranked.groupBy(by).agg(percentile(0.95).alias("p95_time"), percentile(0.99).alias("p99_time"),
                               *[F.first(c).alias(c) for c in names])
    return a.select(by, "frames", F.try_divide("_total", "_all").alias("avg_time"), "p95_time", "p99_time", "success_rate",
                    F.try_divide("frames", "_total").alias("frames_per_sec"), *peak)
