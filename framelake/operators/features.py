"""Per-frame features, frame-to-frame differences and per-video feature rollups.

Frame tables here carry small pixel arrays (``pixels array<int>``, BGR
interleaved for colour). Per-frame features are higher-order SQL functions
evaluated inside the row (JVM side); nothing is
exploded to one row per pixel. Frame-to-frame differences use the segmented
previous-row helper, so a long video is never one window partition. Histograms, and
decoded frames, use the Arrow kernels in ``framelake.functions.images``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import images
from framelake.operators.sampling import gray_of
from framelake.plans import ordered

# Fixed values from the reference's feature code.
FEATURE_FALLBACK = [0.5, 0.2, 0.3, 0.4, 0.35, 0.2, 0.5, 0.5]
FRAME_COUNT_NORM = 32.0
VALUE_LIMIT = 100.0             # |x| > 100 counts as extreme
SANITIZE_LIMIT = 30.0           # clamp range [-30, 30]


def arr_sum(arr: Column, zero: Column | None = None) -> Column:
    return F.aggregate(arr, zero if zero is not None else F.lit(0).cast("long"), lambda a, x: a + x)


def arr_mean(arr: Column) -> Column:
    return arr_sum(arr) / F.size(arr)


def gray_levels(pixels: Column, channels: int) -> Column:
    """Per-pixel gray level: the value itself (1 channel) or 0.299R+0.587G+0.114B."""
    if channels == 1:
        return F.transform(pixels, lambda x: x.cast("double"))
    n = F.size(pixels) / 3
    return F.transform(
        F.sequence(F.lit(0), (n - 1).cast("int")),
        lambda j: gray_of(F.element_at(pixels, j * 3 + 1), F.element_at(pixels, j * 3 + 2),
                          F.element_at(pixels, j * 3 + 3)))


def brightness(pixels: Column, channels: int = 1) -> Column:
    """Mean gray level of a frame."""
    return arr_sum(gray_levels(pixels, channels), F.lit(0.0)) / (F.size(pixels) / F.lit(channels))


def abs_diff_mean(cur: Column, prev: Column) -> Column:
    """Mean |a - b| over two equally sized arrays."""
    return arr_sum(F.zip_with(cur, prev, lambda a, b: F.abs(a - b)), F.lit(0.0)) / F.size(cur)


def with_motion(frames: DataFrame, pos: str = "frame_idx", channels: int = 1, span: int = ordered.FRAME_SPAN) -> DataFrame:
    """Per frame, mean |gray_k - gray_{k-1}|; the first frame of a video gets 0.

    ``pos`` must be dense within the video (frame_idx, or sample_pos of a sample). Frames are sorted with their pixels, and the
    difference is taken on the two neighbours: no second copy of the levels is carried. ``span`` frames are one
    window task's share of a video (8 frames of 1080p are 50 MB: set it from the frames' bytes).
    """
    g = ordered.with_previous(frames, ["video_id"], pos, ["pixels"], prefix="_prev_", span=span)
    now, before = gray_levels(F.col("pixels"), channels), gray_levels(F.col("_prev_pixels"), channels)
    return g.withColumn("motion", F.when(F.col("_prev_pixels").isNull(), F.lit(0.0)).otherwise(abs_diff_mean(now, before))).drop("_prev_pixels")


def with_color_entropy(frames: DataFrame, out: str = "entropy", image: str = "pixels") -> DataFrame:
    """-sum p*log2(p) over the 32-bin histograms of the 3 channels,
    p = count / (rows*cols); ``image`` is a column of BGR levels or an image struct."""
    f = images.with_level_counts(frames, image, "_counts")
    return f.withColumn(out, images.entropy_of_counts(F.col("_counts"))).drop("_counts")


def channel_histogram(frames: DataFrame, image: str = "pixels") -> DataFrame:
    """(video_id, frame_idx, channel, bin, count) with count > 0.

    Levels are counted in one pass inside the row, then the bins are exploded: at most 32 rows per
    frame and channel, never one row per pixel.
    """
    f = images.with_level_counts(frames.select("video_id", "frame_idx", image), image, "_counts")
    return (f.select("video_id", "frame_idx", F.posexplode("_counts").alias("code", "count")).filter("count > 0")
            .select("video_id", "frame_idx", F.expr(f"CAST(code div {images.HIST_BINS} AS INT)").alias("channel"),
                    (F.col("code") % images.HIST_BINS).alias("bin"), "count"))


def video_features(per_frame: DataFrame) -> DataFrame:
    """A17 (+A18): per-video means over frames.

    Input rows: video_id, brightness, motion, and optional entropy / edge
    columns. brightness/(n*255); motion/((n-1)*255) (NULL for n=1, 0/0 in the
    reference); entropy/n; edge/n; complexity = (entropy+edge)/2; the 8-vector
    repeats motion and brightness and ends with n/32. Aggregates are partial
    (map-side combined), so a hot video is fine.
    """
    cols = set(per_frame.columns)
    ent = F.sum("entropy") if "entropy" in cols else F.lit(0.0)
    edge = F.sum("edge") if "edge" in cols else F.lit(0.0)
    agg = per_frame.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum("brightness").alias("_b"), F.sum("motion").alias("_m"),
        ent.alias("_e"), edge.alias("_d"))
    n = F.col("n_frames")
    b = F.col("_b") / (n * 255.0)
    m = F.try_divide(F.col("_m"), (n - 1) * 255.0)
    e = F.col("_e") / n
    d = F.col("_d") / n
    cx = (e + d) / 2
    return agg.select(
        "video_id", "n_frames",
        b.alias("avg_brightness"), m.alias("motion_intensity"), e.alias("color_diversity"),
        d.alias("edge_density"), cx.alias("scene_complexity"),
        F.array(b, m, e, d, cx, m, b, n / FRAME_COUNT_NORM).alias("features"))


def feature_fallback(features: Column) -> Column:
    """Fixed vector when features could not be computed: no vector, or one with a missing value."""
    failed = features.isNull() | F.exists(features, lambda x: x.isNull())
    return F.when(failed, F.array(*[F.lit(v) for v in FEATURE_FALLBACK])).otherwise(features)


def frame_memory(frames: DataFrame) -> DataFrame:
    """Bytes (= elements, uint8) per video and in total."""
    return frames.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.sum(F.col("height") * F.col("width") * F.col("channels")).cast("long").alias("bytes"))


def content_check(pixels: Column, channels: int) -> Column:
    """Frame non-empty (some channel mean > 0) and all values in [0, 255]."""
    in_range = F.forall(pixels, lambda x: (x >= 0) & (x <= 255))
    # for any channel count, some channel mean is > 0 iff some value is > 0
    nonempty = F.exists(pixels, lambda x: x > 0)
    return nonempty & in_range


def normalize_pixels(pixels: Column) -> Column:
    """uint8 * 1/255 as float (same product the reference computes)."""
    return F.transform(pixels, lambda x: (x.cast("float") * F.lit(1.0 / 255.0).cast("float")).cast("float"))


def fit_dimensions(h: Column, w: Column, target: int = 384) -> tuple[Column, Column]:
    """scale = target / max(h, w); new w, h truncated (also upscales)."""
    scale = F.lit(float(target)) / F.greatest(h, w)
    return (w * scale).cast("int"), (h * scale).cast("int")


# --- vector hygiene ----------------------------------------------------------------

def tensor_stats(vec: Column) -> Column:
    """Counts of NaN, +-Inf and |x| > 100 (exclusive, in that order) and the
    valid flag; min/max/mean/population std over the finite values (the
    reference's NaN-poisoned statistics are only logged). One pass (Welford)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
                    F.lit(0).alias("nan"), F.lit(0).alias("inf"), F.lit(0).alias("big"),
                    F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def step(a, x):
        is_nan = F.isnan(x)
        is_inf = ~is_nan & (F.abs(x) == F.lit(float("inf")))
        fin = ~is_nan & ~is_inf
        n1 = a["n"] + 1
        d = x - a["mean"]
        mean1 = a["mean"] + d / n1
        return F.struct(
            F.when(fin, n1).otherwise(a["n"]).alias("n"),
            F.when(fin, mean1).otherwise(a["mean"]).alias("mean"),
            F.when(fin, a["m2"] + d * (x - mean1)).otherwise(a["m2"]).alias("m2"),
            (a["nan"] + is_nan.cast("int")).alias("nan"), (a["inf"] + is_inf.cast("int")).alias("inf"),
            (a["big"] + (fin & (F.abs(x) > VALUE_LIMIT)).cast("int")).alias("big"),
            F.when(fin, F.least(a["lo"], x)).otherwise(a["lo"]).alias("lo"),
            F.when(fin, F.greatest(a["hi"], x)).otherwise(a["hi"]).alias("hi"))

    r = F.aggregate(vec, zero, step)
    return F.struct(
        r["lo"].alias("min"), r["hi"].alias("max"),
        F.when(r["n"] > 0, r["mean"]).alias("mean"), F.when(r["n"] > 0, F.sqrt(r["m2"] / r["n"])).alias("std"),
        r["nan"].alias("nan_count"), r["inf"].alias("inf_count"), r["big"].alias("extreme_count"),
        ((r["nan"] + r["inf"] + r["big"]) == 0).alias("valid"))


def sanitize_vector(vec: Column, limit: float = SANITIZE_LIMIT) -> Column:
    """NaN/+-Inf -> 0, others clamped to [-limit, limit]; counts of both."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    fixed = F.transform(vec, lambda x: F.when(bad(x), F.lit(0.0))
                        .otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x))))
    return F.struct(
        fixed.alias("values"),
        F.size(F.filter(vec, bad)).alias("invalid_count"),
        F.size(F.filter(vec, lambda x: ~bad(x) & (F.abs(x) > limit))).alias("clamped_count"))


def resize_vector(vec: Column, length: int, fill: float = 0.0) -> Column:
    """Truncate or pad with ``fill`` to ``length``."""
    return F.slice(F.concat(vec, F.array_repeat(F.lit(fill), length)), 1, length)


def combine_embeddings(text: Column, n_tokens: Column, hidden: int = 1536) -> Column:
    """Zeros of n_tokens*hidden with the text embedding over the prefix."""
    total = (n_tokens * hidden).cast("int")
    head = F.slice(text, 1, total)
    return F.concat(head, F.array_repeat(F.lit(0.0), total - F.size(head)))
