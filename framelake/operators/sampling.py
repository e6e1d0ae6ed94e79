"""Frame sampling per video (uniform, midpoint, linspace, times, keyframes).

All index rules are evaluated exactly as the reference writes them: doubles in
the written order, then truncation.

Plan shape. A sampler needs ``total_frames`` of the video, so frames are joined
to the per-video size table (one row per video; the planner broadcasts it if its bytes
are few). Each frame then works out which sample positions ``i`` select it: the
index rules are monotone and close to linear in ``i``, so only a handful of
candidates around ``idx / slope`` can hit a frame, and the exact rule is
re-evaluated on each candidate. Selection is therefore a map-side
join + filter + explode: the frame pixels never cross a shuffle just to pick N
frames out of a long video, and a hot video costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.plans import ordered


# --- index rules, as columns of (i, total_frames) --------------------------------

def uniform_index(n: int, i: Column, t: Column) -> Column:
    """trunc((i / (N-1)) * (T-1)); N=1 -> 0 (0/0 in the reference)."""
    if n == 1:
        return F.lit(0).cast("long")
    return ((i.cast("double") / F.lit(float(n - 1))) * (t - 1)).cast("long")


def midpoint_index(n: int, i: Column, t: Column) -> Column:
    """N=1 -> T div 2; else clamp(int(((i+0.5)/N)*T), 0, T-1)."""
    if n == 1:
        return F.floor(t / 2).cast("long")
    raw = (((i.cast("double") + 0.5) / F.lit(float(n))) * t).cast("long")
    return F.least(F.greatest(raw, F.lit(0).cast("long")), (t - 1).cast("long"))


def linspace_index(n: int, i: Column, t: Column) -> Column:
    """int(linspace(0, T-1, N)) = trunc(i * ((T-1)/(N-1))), last = T-1."""
    if n == 1:
        return F.lit(0).cast("long")
    step = (t - 1).cast("double") / F.lit(float(n - 1))
    return F.when(i == n - 1, (t - 1).cast("long")).otherwise((i.cast("double") * step).cast("long"))


_RULES = {"uniform": uniform_index, "midpoint": midpoint_index, "linspace": linspace_index}


def _candidates(n: int, idx: Column, t: Column, rule: str) -> Column:
    """Candidate sample positions that can select frame ``idx`` (superset, small)."""
    if rule == "midpoint":
        # ((i+0.5)/N)*T in [idx, idx+1)  =>  i in [idx*N/T - 0.5, (idx+1)*N/T - 0.5)
        lo = F.floor(idx * F.lit(float(n)) / t - 0.5) - 1
        hi = F.ceil((idx + 1) * F.lit(float(n)) / t - 0.5) + 1
    else:
        # (i/(N-1))*(T-1) in [idx, idx+1)  =>  i in [idx*(N-1)/(T-1), (idx+1)*(N-1)/(T-1))
        span = F.greatest(t - 1, F.lit(1)).cast("double")
        lo = F.floor(idx * F.lit(float(max(n - 1, 1))) / span) - 1
        hi = F.ceil((idx + 1) * F.lit(float(max(n - 1, 1))) / span) + 1
        if rule == "uniform":
            # T=1: every i maps to frame 0
            lo = F.when(t <= 1, F.lit(0)).otherwise(lo)
            hi = F.when(t <= 1, F.lit(n - 1)).otherwise(hi)
    lo = F.greatest(lo.cast("long"), F.lit(0).cast("long"))
    hi = F.least(hi.cast("long"), F.lit(n - 1).cast("long"))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def with_sizes(frames: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attach ``total_frames``; the planner broadcasts the per-video table if its bytes are few."""
    return frames.join(sizes.select("video_id", "total_frames"), "video_id")


def sample_by_rule(frames: DataFrame, sizes: DataFrame, n: int, rule: str = "uniform") -> DataFrame:
    """Frames selected by an index rule, one row per (video, sample_pos).

    Repeats are kept (N > T selects some frames several times). N <= 0 -> none.
    Output keeps every frame column plus ``sample_pos`` and ``total_frames``.
    """
    if n <= 0:
        return frames.withColumn("sample_pos", F.lit(0).cast("long")).limit(0)
    fn = _RULES[rule]
    j = with_sizes(frames, sizes)
    t = F.col("total_frames")
    cand = F.filter(_candidates(n, F.col("frame_idx"), t, rule),
                    lambda i: fn(n, i, t) == F.col("frame_idx"))
    return j.withColumn("sample_pos", F.explode(cand))


def sample_uniform(frames: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    return sample_by_rule(frames, sizes, n, "uniform")


def sample_midpoint(frames: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    return sample_by_rule(frames, sizes, n, "midpoint")


def sample_linspace(frames: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    return sample_by_rule(frames, sizes, n, "linspace")


def sample_times(frames: DataFrame, sizes: DataFrame, n: int, fps: float) -> DataFrame:
    """P3 + J6: t_i = (i+0.5)*duration/N, duration = T/fps; the frame shown at t_i
    is the first frame with ts >= t_i (forward as-of seek). Frames are at a
    constant rate (ts = idx/fps), so frame idx answers the i with
    ts(idx-1) < t_i <= ts(idx); candidates come from inverting t_i. A t_i past
    the last frame selects nothing, like a failed seek.
    """
    if n <= 0:
        return frames.withColumn("sample_pos", F.lit(0).cast("long")).limit(0)
    if fps <= 0:  # no duration: every seek goes to the first frame
        return frames.filter("frame_idx = 0").withColumn("sample_pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    j = with_sizes(frames, sizes)
    t = F.col("total_frames")
    duration = t / F.lit(fps)
    idx = F.col("frame_idx")
    # t_i in (ts(idx-1), ts(idx)]  =>  i in (ts(idx-1)*N/D - 0.5, ts(idx)*N/D - 0.5]
    per_i = duration / F.lit(float(n))
    lo = F.greatest(F.floor((idx - 1) / F.lit(fps) / per_i - 0.5) - 1, F.lit(0)).cast("long")
    hi = F.least(F.ceil(idx / F.lit(fps) / per_i - 0.5) + 1, F.lit(n - 1)).cast("long")

    def t_of(i: Column) -> Column:
        return (i.cast("double") + 0.5) * duration / F.lit(float(n))

    prev_ts = F.when(idx > 0, (idx - 1) / F.lit(fps))
    hits = F.filter(
        F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")),
        lambda i: (t_of(i) <= F.col("ts")) & (prev_ts.isNull() | (t_of(i) > prev_ts)))
    return (j.withColumn("sample_pos", F.explode(hits))
            .withColumn("t", t_of(F.col("sample_pos"))))


# --- seeks on real timestamps ----------------------------------------------------

def midpoint_time(n: int, i: Column, duration: Column) -> Column:
    """t_i = (i + 0.5) * duration / N."""
    return (i.cast("double") + 0.5) * duration / F.lit(float(n))


def linspace_time(n: int, i: Column, duration: Column) -> Column:
    """P4, time form: t_i = i * duration / (N - 1); N=1 -> 0."""
    return i.cast("double") * duration / F.lit(float(n - 1)) if n > 1 else F.lit(0.0)


def seek_times(durations: DataFrame, n: int, rule: str = "midpoint") -> DataFrame:
    """(video_id, sample_pos, t): the N seek times of every video (video_id, duration in seconds)."""
    time = {"midpoint": midpoint_time, "linspace": linspace_time}[rule]
    at = durations.select("video_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("sample_pos")) \
        if n > 0 else durations.select("video_id", "duration", F.lit(0).cast("long").alias("sample_pos")).limit(0)
    return at.select("video_id", "sample_pos", time(n, F.col("sample_pos"), F.col("duration")).alias("t"))


def seek_frames(seeks: DataFrame, frames: DataFrame) -> DataFrame:
    """For each seek (video_id, sample_pos, t) the first frame (video_id, frame_idx, ts) of its video with ts >= t.

    Frames may come at any rate: no range join, but one sort of seeks and frames together and the next frame
    carried back to each seek (``ordered.next_match``). Only index and time are sorted; join other columns by (video_id,
    frame_idx). Of frames with equal ts the smallest index is the first; a seek past the last frame, or with a null t, selects nothing.
    """
    none = F.lit(None)
    frame = F.struct(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("ts").cast("double").alias("ts"))
    both = seeks.filter("t IS NOT NULL").select(
        "video_id", F.col("t").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("sample_pos").cast("long").alias("n"),
        none.cast("struct<frame_idx:bigint,ts:double>").alias("frame"))
    both = both.unionByName(frames.filter("ts IS NOT NULL").select(
        "video_id", F.col("ts").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("frame_idx").cast("long").alias("n"), frame.alias("frame")))
    met = ordered.next_match(both, ["video_id"], ["at", "kind", "n"], "frame", "hit")
    return met.filter("kind = 0 AND hit IS NOT NULL").select(
        "video_id", F.col("n").alias("sample_pos"), F.col("at").alias("t"), F.col("hit.frame_idx").alias("frame_idx"), F.col("hit.ts").alias("ts"))


def sample_times_asof(frames: DataFrame, n: int, rule: str = "midpoint", durations: DataFrame | None = None) -> DataFrame:
    """P3 / P4 + J6 on frames with real timestamps; durations default to the last timestamp of each video."""
    if durations is None:
        durations = frames.groupBy("video_id").agg(F.max("ts").alias("duration"))
    return seek_frames(seek_times(durations, n, rule), frames)


def frame_timestamps(pos: Column, fps: Column) -> Column:
    """P10: pos/fps if fps > 0 else pos."""
    return F.when(fps > 0, pos / fps).otherwise(pos.cast("double"))


def cap_frames(sampled: DataFrame, k: int = 16) -> DataFrame:
    """First k frames by sample position (positions are dense, no window)."""
    return sampled.filter(F.col("sample_pos") < k)


# --- keyframes -------------------------------------------------------------------

def gray_of(b: Column, g: Column, r: Column) -> Column:
    """BGR -> gray with the ITU-R 601 weights, as an exact double."""
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


def mean_gray_absdiff(cur: Column, prev: Column, pixels: int) -> Column:
    """Mean over pixels of gray(|BGR_k - BGR_prev|) (gray of the difference)."""
    def px(arr, j, c):
        return F.element_at(arr, j * 3 + c + 1)

    diffs = F.transform(
        F.sequence(F.lit(0), F.lit(pixels - 1)),
        lambda j: gray_of(F.abs(px(cur, j, 0) - px(prev, j, 0)),
                          F.abs(px(cur, j, 1) - px(prev, j, 1)),
                          F.abs(px(cur, j, 2) - px(prev, j, 2))))
    return F.aggregate(diffs, F.lit(0.0), lambda a, x: a + x) / F.lit(float(pixels))


def sample_keyframes(frames: DataFrame, sizes: DataFrame, n: int, pixels: int,
                     threshold: float = 30.0) -> DataFrame:
    """P5 + P6 + U1: change-detected keyframes, then uniform fill.

    stride r = max(1, T div 3N); visit r, 2r, ... < T; a visited frame is kept
    when its change vs the previous *visited* frame is > threshold (the first
    visited frame has no previous); at most N-1 kept after frame 0, which is
    always first. Fill: next = last + T div N while fewer than N and next < T
    (step 0 repeats the last index up to N).

    Visited frames are at most ~6N per video, so every per-video step after the
    map-side stride filter works on a bounded group.
    Output: video_id, sample_pos, frame_idx, kind ('first'|'change'|'fill'), change.
    """
    if n <= 0:
        return frames.select("video_id", F.lit(0).cast("long").alias("sample_pos"),
                             "frame_idx", F.lit("").alias("kind"),
                             F.lit(None).cast("double").alias("change")).limit(0)
    j = with_sizes(frames, sizes)
    r = F.greatest(F.lit(1), F.expr(f"total_frames div {3 * n}"))
    visited = (j.withColumn("stride", r)
               .filter((F.col("frame_idx") >= F.col("stride")) & (F.col("frame_idx") % F.col("stride") == 0))
               .withColumn("vpos", (F.col("frame_idx") / F.col("stride")).cast("long") - 1))
    visited = ordered.with_previous(visited, ["video_id"], "vpos", ["pixels"], prefix="prev_", span=ordered.FRAME_SPAN)
    scored = visited.withColumn(
        "change", F.when(F.col("prev_pixels").isNotNull(),
                         mean_gray_absdiff(F.col("pixels"), F.col("prev_pixels"), pixels)))
    changed = scored.filter(F.col("change") > threshold)
    # at most N-1 change keyframes: rank among changed by position (<= 6N rows per video)
    from pyspark.sql import Window
    kept = (changed.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx")))
            .filter(F.col("k") <= n - 1)
            .select("video_id", F.col("k").cast("long").alias("sample_pos"), "frame_idx",
                    F.lit("change").alias("kind"), "change", "total_frames"))
    first = sizes.select("video_id", F.lit(0).cast("long").alias("sample_pos"),
                         F.lit(0).cast("long").alias("frame_idx"), F.lit("first").alias("kind"),
                         F.lit(None).cast("double").alias("change"), "total_frames")
    picked = first.unionByName(kept)
    tail = picked.groupBy("video_id").agg(
        F.max("sample_pos").alias("last_pos"), F.max("frame_idx").alias("last_idx"),
        F.first("total_frames").alias("total_frames"))
    step = F.expr(f"total_frames div {n}")
    room = F.lit(n - 1) - F.col("last_pos")
    m = F.when(step == 0, room).otherwise(
        F.least(room, F.expr(f"(total_frames - last_idx - 1) div greatest(total_frames div {n}, 1)")))
    fill = (tail.withColumn("m", m).filter(F.col("m") > 0)
            .withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))))
            .select("video_id", (F.col("last_pos") + F.col("j")).alias("sample_pos"),
                    (F.col("last_idx") + F.col("j") * step).cast("long").alias("frame_idx"),
                    F.lit("fill").alias("kind"), F.lit(None).cast("double").alias("change")))
    return picked.drop("total_frames").unionByName(fill)


def sample_frames(frames: DataFrame, sizes: DataFrame, n: int, strategy: str, pixels: int = 0) -> DataFrame:
    """P8: 'keyframe' -> keyframes, anything else (incl. 'adaptive') -> uniform."""
    if strategy == "keyframe":
        picks = sample_keyframes(frames, sizes, n, pixels)
        return pick_frames_by_index(picks.select("video_id", "sample_pos", "frame_idx"), frames)
    return sample_uniform(frames, sizes, n)


def sample_frames_by_strategy(frames: DataFrame, sizes: DataFrame, n: int, pixels: int = 0) -> DataFrame:
    """P8 with a strategy per video (column ``strategy`` of ``sizes``): (video_id, sample_pos, frame_idx)."""
    by_change = F.coalesce(F.col("strategy") == "keyframe", F.lit(False))
    cols = ["video_id", "sample_pos", "frame_idx"]
    changes = sample_keyframes(frames, sizes.filter(by_change).drop("strategy"), n, pixels).select(cols)
    evenly = sample_uniform(frames.select("video_id", "frame_idx"), sizes.filter(~by_change).drop("strategy"), n)
    return changes.unionByName(evenly.select(cols))


def pick_frames_by_index(index: DataFrame, frames: DataFrame) -> DataFrame:
    """Ordered fetch by an index list; duplicates kept, missing frames dropped.

    The planner decides from bytes whether the index list (N rows per video) is broadcast.
    """
    return index.join(frames, ["video_id", "frame_idx"], "inner")
