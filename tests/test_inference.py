"""Model stages: plug-in factories, error rows, timeouts, retries, fallbacks."""

import pandas as pd
from pyspark.sql import functions as F

from framelake.operators import inference as inf


def scripted_model():
    """Frame model whose answer depends on sample_pos: 0 ok, 1 HTTP 503, 2 slow,
    3 transient once then ok, 4 transient on every attempt. Defined in a
    function so the class is shipped to the Python workers by value."""

    class ScriptedModel:
        def describe(self, batch, attempt):
            rows = []
            for p in batch["sample_pos"]:
                p = int(p)
                rows.append({"status": 503 if p == 1 else 200, "response": f"  frame {p}  ",
                             "latency": 400.0 if p == 2 else 1.5,
                             "transient": (p == 3 and attempt == 0) or p == 4})
            return pd.DataFrame(rows)
    return ScriptedModel


def broken_model():
    class BrokenModel:
        def describe(self, batch, attempt):
            raise ValueError("no weights")
    return BrokenModel


def frames(spark):
    return spark.createDataFrame([(7, p, p * 10, [1, 2, 3]) for p in range(5)],
                                 "video_id long, sample_pos long, frame_idx long, pixels array<int>")


def test_error_rows_timeouts_and_retries(spark):
    got = {r.sample_pos: r for r in inf.describe_frames(frames(spark), sleep=False, model_spec=scripted_model(),
                                                         timeout_s=300.0).collect()}
    assert got[0].success and got[0].description == "frame 0" and got[0].attempts == 1
    assert got[0].frame_description == "Frame 1" and got[0].processing_time == 1.5
    assert not got[1].success and got[1].error == "HTTP 503"
    assert not got[2].success and got[2].error == "Timeout after 300 seconds" and got[2].processing_time == 300.0
    assert got[3].success and got[3].attempts == 2
    assert not got[4].success and got[4].attempts == 3 and got[4].error.startswith("Processing error")


def test_model_exception_becomes_rows(spark):
    got = inf.describe_frames(frames(spark), model_spec=broken_model()).collect()
    assert len(got) == 5 and all(not r.success and r.error == "Processing error: no weights" for r in got)
    assert all(r.processing_time == 0.0 for r in got)


def test_retry_wait_bounds():
    assert [inf.retry_wait(a) for a in range(4)] == [4.0, 4.0, 8.0, 10.0]


def test_summary_fallback_chain(spark):
    parts = spark.createDataFrame([(1, "a | b"), (5, "x"), (7, "y")], "video_id long, text string")
    fb = spark.createDataFrame([(1, "fb1"), (5, "fb5"), (7, "fb7"), (9, "none")], "video_id long, summary string")
    got = {r.video_id: (r.summary, r.source) for r in inf.summarize_videos(parts, fb).collect()}
    assert got[1] == ("Summary of 2 observations", "model")
    assert got[5] == ("Failed to generate video summary.", "http_error")
    assert got[7] == ("fb7", "fallback")
    assert got[9] == ("No frames were successfully analyzed.", "none")


def test_group_model_failure_row(spark):
    class Failing:
        def analyze(self, frames, prompt):
            raise RuntimeError("boom")
    got = inf.describe_frame_groups(frames(spark), "p", model_spec=Failing).collect()[0]
    assert got.description == "Analysis failed: boom" and got.confidence == 0.0 and got.n_frames == 5


def test_prompt_timestamp_and_measured_time(spark):
    import time

    class Slow:
        def describe(self, batch, attempt):
            time.sleep(0.3 if batch["sample_pos"].iloc[0] == 4 else 0)
            return pd.DataFrame({"status": 200, "response": batch["prompt"], "transient": False}, index=batch.index)
    df = frames(spark).withColumn("ts", F.col("frame_idx") / 2.0)
    one = inf.describe_frames(df.filter("sample_pos < 2"), model_spec=Slow, prompt=F.concat(F.lit("p"), F.col("sample_pos")))
    assert sorted((r.description, r.timestamp) for r in one.collect()) == [("p0", 0.0), ("p1", 5.0)]
    slow = inf.describe_frames(df.filter("sample_pos = 4"), model_spec=Slow, prompt="x", timeout_s=0.2).first()
    assert not slow.success and slow.error.startswith("Timeout") and slow.timestamp == 20.0


def test_group_result_has_all_fields(spark):
    class Full:
        def analyze(self, frames, prompt):
            return {"description": prompt, "confidence": 0.5, "objects": ["a"], "actions": ["b"], "scene_context": "c",
                    "temporal_events": ["d"]}
    r = inf.describe_frame_groups(frames(spark), "p", model_spec=Full).first()
    assert (r.objects, r.actions, r.scene_context, r.temporal_events) == (["a"], ["b"], "c", ["d"])
    assert r.processing_time >= 0 and r.error is None


def test_deadline_is_real(spark):
    """A hanging call is one timeout row; its neighbours succeed and the task ends in time."""
    import time

    class Sleeper:
        def describe(self, batch, attempt):
            if batch["sample_pos"].iloc[0] in (1, 3):
                time.sleep(600)
            return pd.DataFrame({"status": 200, "response": [f"f{p}" for p in batch["sample_pos"]], "transient": False})

    for at_once in (1, 3):
        began = time.monotonic()
        got = {r.sample_pos: r for r in inf.describe_frames(frames(spark).coalesce(1), model_spec=Sleeper, timeout_s=1.0, calls_at_once=at_once).collect()}
        assert time.monotonic() - began < 30
        assert {p: r.success for p, r in got.items()} == {0: True, 1: False, 2: True, 3: False, 4: True}
        assert got[1].error == "Timeout after 1 seconds" and got[1].processing_time == 1.0 and got[1].attempts == 1
        assert got[4].description == "f4" and got[4].processing_time < 1.0


def test_long_call_is_not_shared_out(spark):
    """A call of several frames has one deadline, and fails frame by frame."""
    class Picky:
        def describe(self, batch, attempt):
            if (batch["sample_pos"] == 2).any():
                raise ValueError("bad frame")
            return pd.DataFrame({"status": 200, "response": "ok", "transient": False}, index=batch.index)
    got = inf.describe_frames(frames(spark).coalesce(1), model_spec=Picky, frames_per_call=3).collect()
    assert sorted((r.sample_pos, r.success, r.error) for r in got) == [
        (p, p != 2, None if p != 2 else "Processing error: bad frame") for p in range(5)]


def test_null_and_large_ids(spark):
    rows = [(2**60 + 1, 0, 2**60 + 3, [1]), (None, 1, None, [2]), (2**60 + 3, None, 5, [3])]
    df = spark.createDataFrame(rows, "video_id long, sample_pos long, frame_idx long, pixels array<int>").coalesce(1)

    class Ok:
        def describe(self, batch, attempt):
            return pd.DataFrame({"status": 200, "response": [str(v) for v in batch["video_id"]], "transient": False})

        def analyze(self, frames, prompt):
            return {"description": str(len(frames)), "confidence": 1.0}
    got = inf.describe_frames(df, model_spec=Ok).collect()
    assert {(r.video_id, r.sample_pos, r.frame_idx) for r in got} == {r[:3] for r in rows}
    assert {r.description for r in got} == {str(2**60 + 1), "<NA>", str(2**60 + 3)}
    groups = inf.describe_frame_groups(df, "p", model_spec=Ok).collect()
    assert {(r.video_id, r.n_frames, r.error) for r in groups} == {(2**60 + 1, 1, None), (None, 1, None), (2**60 + 3, 1, None)}


def test_heavy_groups_are_refused(spark):
    rows = [(1, p, p, [0] * 100) for p in range(5)] + [(2, 0, 0, [0] * 10)]
    df = spark.createDataFrame(rows, "video_id long, sample_pos long, frame_idx long, pixels array<int>")
    got = {r.video_id: r for r in inf.describe_frame_groups(df, "p", max_bytes=400).collect()}
    assert got[1].n_frames == 5 and got[1].error == "500 levels of pixels are over the limit of 400" and got[2].error is None
