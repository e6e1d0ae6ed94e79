"""Results stay whole at any size: long videos and conversations, many images, NULL keys, empty batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions import images
from framelake.functions import prompts as pr
from framelake.operators import features, inference, rollups, sampling
from framelake.plans import ordered
from framelake.streaming import chunks


def test_one_text_per_video(spark):
    df = spark.range(4097).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_idx"), F.lit(True).alias("success"),
                                  F.concat(F.lit(" d"), "id").alias("description"))
    rows = rollups.join_observations(df).collect()
    assert len(rows) == 1 and rows[0].text == " | ".join(f"d{i}" for i in range(4097))


def test_one_template_per_conversation(spark):
    parts = spark.range(4097).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.lit(0).alias("ppos"), F.lit("text").alias("kind"), F.concat(F.lit("t"), "id").alias("text"))
    text = pr.chat_template(parts).first().text
    assert text.count("<|im_start|>user") == 4097 and text.endswith("t4096<|im_end|>\n<|im_start|>assistant\n")


def test_other_roles_and_media_numbers(spark):
    parts = spark.createDataFrame(
        [(1, 0, "tool", 0, "text", "x"), (2, 0, "tool", 0, "image", None), (2, 1, "user", 0, "image", None),
         (3, 0, "user", 70_000, "image", None), (3, 1, "user", 0, "image", None)],
        "conv_id int, turn long, role string, ppos long, kind string, text string")
    got = {r.conv_id: r.text for r in pr.chat_template(parts).collect()}
    assert got[1] == "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>assistant\n"
    assert "Picture 1: " in got[2] and "Picture 2: " not in got[2]
    assert got[3].index("Picture 1: ") < got[3].index("Picture 2: ")


def test_all_images_reach_the_model(spark):
    class Count:
        def analyze(self, frames, prompt):
            return {"description": str(len(frames)), "confidence": 1.0}
    df = spark.range(20).select(F.lit(1).alias("video_id"), F.col("id").alias("sample_pos"), F.array(F.lit(1)).alias("pixels"))
    assert inference.describe_frame_groups(df, "p", model_spec=Count).first().n_frames == 20


def test_one_bad_frame_is_one_error(spark):
    class Picky:
        def describe(self, pdf, attempt):
            if (pdf["frame_idx"] == 3).any():
                raise RuntimeError("frame 3")
            n = len(pdf)
            return pd.DataFrame({"status": [200] * n, "response": ["ok"] * n, "latency": [0.1] * n, "transient": [False] * n})
    df = spark.range(6).select(F.col("id").alias("video_id"), F.lit(0).alias("sample_pos"), F.col("id").alias("frame_idx"),
                               F.array(F.lit(1)).alias("pixels"))
    rows = inference.describe_frames(df.coalesce(1), model_spec=Picky).collect()
    assert [r.frame_idx for r in rows if not r.success] == [3] and len(rows) == 6
    assert next(r.error for r in rows if not r.success) == "Processing error: frame 3"


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1)], "k string, pos long, v long")
    df = ordered.with_segments(df, ordered.span_segments("pos", 2))
    got = ordered.running_sum(df, ["k"], ["pos"], "v", "s").collect()
    assert sorted((r.k or "", r.s) for r in got) == [("", 5), ("", 12), ("a", 1)]


def test_empty_batch_and_no_frame_rate(spark):
    none = spark.createDataFrame([], "success boolean, total_processing_time double")
    r = rollups.batch_stats(none).first()
    assert (r.total, r.successful, r.pass_rate, r.success_ratio) == (0, 0, None, None)
    frames = spark.createDataFrame([(1, 0), (1, 1)], "video_id int, frame_idx long")
    got = sampling.sample_times(frames, frames.groupBy("video_id").agg(F.lit(2).alias("total_frames")), 3, 0.0).collect()
    assert [(r.frame_idx, r.sample_pos) for r in got] == [(0, 0), (0, 1), (0, 2)]


def test_feature_fallback_acts(spark):
    df = spark.createDataFrame([([1.0, None],), (None,), ([1.0, 2.0],)], "f array<double>")
    got = [r[0] for r in df.select(features.feature_fallback(F.col("f"))).collect()]
    assert got[0] == got[1] == list(features.FEATURE_FALLBACK) and got[2] == [1.0, 2.0]


@pytest.mark.parametrize("flip", [False, True])
def test_diagonal_edges_are_thin_and_whole(flip):
    y, x = np.mgrid[0:16, 0:16]
    step = 255 / (1 + np.exp(-(x + y - 15) / 1.0))
    edges = images.canny_edges(step[:, ::-1] if flip else step)
    edges = edges[:, ::-1] if flip else edges
    assert all(edges[k].any() for k in range(2, 14)) and edges.sum() <= 40
    assert np.abs((x + y)[edges] - 15).max() <= 1


def test_repeated_frames_count_once():
    class State:
        exists, hasTimedOut, value = False, False, None
        get = property(lambda self: self.value)

        def update(self, v):
            self.value, self.exists = v, True

        def setTimeoutTimestamp(self, t):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    pdf = pd.DataFrame({"frame_idx": [0, 1, 1, 2], "brightness": [0.0, 3.0, 9.0, 3.0], "total_frames": [9] * 4,
                        "arrival": pd.Timestamp("2024-01-01")})
    out = pd.concat(chunks.chunker(3)((1, 0), iter([pdf]), State()))
    assert len(out) == 1 and out.n_frames[0] == 3 and out.brightness[0] == 2.0


def test_result_json_from_parts_of_a_video(spark):
    import json

    from framelake import queries
    rows = [(1, k, k % 3 > 0, f'd "{k}"' if k % 4 else None, 0.5, f"m{k}") for k in range(11)] + [(2, 0, None, "x", 1.0, None)]
    df = spark.createDataFrame(rows[::-1], "video_id long, frame_idx long, success boolean, description string, "
                                           "processing_time double, model_used string")
    got = {r.video_id: r.json for r in queries._result_json(df, 3).collect()}
    assert got == {r.video_id: r.json for r in queries._result_json(df, 4096).collect()}
    one = json.loads(got[1])
    assert one["frame_details"] == [{"success": k % 3 > 0, "description": f'd "{k}"' if k % 4 else ""} for k in range(11)]
    assert (one["frames_analyzed"], one["total_frames_extracted"], one["total_processing_time"], one["model_used"]) == (7, 11, 5.5, "m0")
    assert json.loads(got[2])["model_used"] is None and not json.loads(got[2])["success"]
