"""Sampling rules against hand-computed indices (reference test configurations)."""

import pytest
from pyspark.sql import functions as F

from framelake.operators import sampling as smp


def frames_of(spark, sizes: dict[int, int], pixels=None):
    rows = [(v, i, i / 10.0, pixels(v, i) if pixels else [i % 256] * 3)
            for v, t in sizes.items() for i in range(t)]
    f = spark.createDataFrame(rows, "video_id long, frame_idx long, ts double, pixels array<int>")
    s = spark.createDataFrame(list(sizes.items()), "video_id long, total_frames int")
    return f, s


def picked(df):
    rows = df.select("video_id", "sample_pos", "frame_idx").collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.video_id, r.sample_pos)):
        out.setdefault(r.video_id, []).append(r.frame_idx)
    return out


def test_uniform_matches_hand_computed(spark):
    f, s = frames_of(spark, {1: 20, 2: 50})
    got = picked(smp.sample_uniform(f, s, 8))
    assert got[1] == [0, 2, 5, 8, 10, 13, 16, 19]
    assert got[2] == [0, 7, 14, 21, 28, 35, 42, 49]


@pytest.mark.parametrize("n", [1, 4, 8, 16, 32])
def test_uniform_counts(spark, n):
    f, s = frames_of(spark, {1: 50})
    assert smp.sample_uniform(f, s, n).count() == min(n, 50)


def test_uniform_repeats_and_edges(spark):
    f, s = frames_of(spark, {1: 3, 2: 1})
    got = picked(smp.sample_uniform(f, s, 5))
    assert got[1] == [0, 0, 1, 1, 2]
    assert got[2] == [0, 0, 0, 0, 0]
    assert picked(smp.sample_uniform(f, s, 1)) == {1: [0], 2: [0]}
    assert smp.sample_uniform(f, s, 0).count() == 0


def test_midpoint_matches_hand_computed(spark):
    f, s = frames_of(spark, {1: 198, 2: 7})
    got = picked(smp.sample_midpoint(f, s, 10))
    assert got[1] == [9, 29, 49, 69, 89, 108, 128, 148, 168, 188]
    assert picked(smp.sample_midpoint(f, s, 1)) == {1: [99], 2: [3]}


def test_linspace_ends_at_last_frame(spark):
    f, s = frames_of(spark, {1: 10})
    assert picked(smp.sample_linspace(f, s, 4))[1] == [0, 3, 6, 9]


def test_sample_times_forward_seek(spark):
    f, s = frames_of(spark, {1: 20})   # fps 10, duration 2.0 s
    got = smp.sample_times(f, s, 4, 10.0).orderBy("sample_pos").collect()
    # t_i = (i + 0.5) * 2.0 / 4 = 0.25, 0.75, 1.25, 1.75 -> first frame with ts >= t
    assert [r.frame_idx for r in got] == [3, 8, 13, 18]


def test_keyframes_change_fill_and_repeats(spark):
    # 30 frames of 2 BGR pixels; frames 6k (k>=1) jump to a bright level
    def px(v, i):
        lvl = 200 if (i % 6 == 0 and i > 0) else 10
        return [lvl] * 6
    f, s = frames_of(spark, {1: 30}, px)
    k = smp.sample_keyframes(f, s, 4, 2).orderBy("sample_pos").collect()
    # stride = max(1, 30 div 12) = 2; visited 2,4,...; change > 30 at 6, 8 (back to dark), 12 ...
    assert [r.frame_idx for r in k][:1] == [0]
    assert [r.kind for r in k] == ["first", "change", "change", "change"]
    assert [r.frame_idx for r in k] == [0, 6, 8, 12]
    # N > T: stride 1, nothing changes -> fill step 0 repeats frame 0
    f2, s2 = frames_of(spark, {2: 3}, lambda v, i: [5] * 6)
    k2 = smp.sample_keyframes(f2, s2, 5, 2).orderBy("sample_pos").collect()
    assert [r.frame_idx for r in k2] == [0, 0, 0, 0, 0]


def test_keyframe_fill_stops_at_end(spark):
    f, s = frames_of(spark, {1: 10}, lambda v, i: [5] * 6)
    k = smp.sample_keyframes(f, s, 4, 2).orderBy("sample_pos").collect()
    # no changes; step = 10 div 4 = 2 -> 0, 2, 4, 6
    assert [r.frame_idx for r in k] == [0, 2, 4, 6]


def plain_seeks(seeks, frames):
    out = []
    for v, i, t in seeks:
        ahead = sorted((ts, k) for w, k, ts in frames if w == v and t is not None and ts is not None and ts >= t)
        if ahead:
            out.append((v, i, t, ahead[0][1], ahead[0][0]))
    return sorted(out, key=str)


def test_seek_at_real_times(spark):
    """Uneven gaps, equal times, frames without a video, a hot video over many partitions, seeks past the end."""
    import random
    rnd = random.Random(1)
    frames = [(v, k, round(rnd.expovariate(1) * 10 ** rnd.randint(-2, 2), 3)) for v in (1, 2, None) for k in range(30)]
    frames += [(3, k, float(k // 7)) for k in range(3000)] + [(4, 0, None), (5, 7, 0.0)]
    seeks = [(v, i, rnd.random() * 60) for v in (1, 2, None, 9) for i in range(20)]
    seeks += [(3, i, i * 9.5) for i in range(60)] + [(3, 100, 428.0), (3, 101, 428.01), (4, 0, 0.0), (5, 0, 0.0), (5, 1, 0.1), (1, 50, None)]
    f = spark.createDataFrame(frames, "video_id long, frame_idx long, ts double").repartition(5)
    s = spark.createDataFrame(seeks, "video_id long, sample_pos long, t double")
    got = sorted(map(tuple, smp.seek_frames(s, f).select("video_id", "sample_pos", "t", "frame_idx", "ts").collect()), key=str)
    assert got == plain_seeks(seeks, frames)
    assert smp.seek_frames(s, f.limit(0)).collect() == [] and smp.seek_frames(s.limit(0), f).collect() == []


def test_linspace_times(spark):
    f = spark.createDataFrame([(1, k, t) for k, t in enumerate([0.0, 0.5, 2.0, 2.1, 9.0])], "video_id long, frame_idx long, ts double")
    got = sorted((r.sample_pos, r.t, r.frame_idx) for r in smp.sample_times_asof(f, 4, "linspace").collect())
    assert got == [(0, 0.0, 0), (1, 3.0, 4), (2, 6.0, 4), (3, 9.0, 4)]
    assert [(r.sample_pos, r.t, r.frame_idx) for r in smp.sample_times_asof(f, 1, "linspace").collect()] == [(0, 0.0, 0)]
    assert smp.sample_times_asof(f, 0).collect() == []
