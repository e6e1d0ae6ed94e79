"""Ordered documents over many part files, ordered frame details, table functions, peak memory, config overlay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from framelake.functions import table_functions as tf
from framelake.operators import rollups
from framelake.operators import sampling as smp
from framelake.sources import json_io
from framelake.sources import requests as rq


def batch(spark, paths):
    rows = [(p, f"d {p}", ["a", 'q"uote'], [], "s\n", [], k / 7, k) for k, p in enumerate(paths)]
    return spark.createDataFrame(rows, "path string, description string, objects array<string>, actions array<string>, scene_context string, "
                                       "temporal_events array<string>, confidence_score double, processing_time_ms long")


def put_together(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_one_object_in_many_parts(spark, tmp_path):
    rnd = random.Random(3)
    paths = [f"{rnd.choice('abZé/')}{k}.mp4" for k in range(5000)] + ['with "quotes" and \\.mp4', "", "ünï.mp4"]
    df = batch(spark, paths).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        json_io.write_document(json_io.batch_document(df), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "out").glob("part-*"))) > 4
    pairs = json.loads(put_together(tmp_path / "out"), object_pairs_hook=list)
    assert [k for k, _ in pairs] == sorted(paths, key=str.encode)
    got = {k: dict(v) for k, v in pairs}
    assert all(got[p]["description"] == f"d {p}" and got[p]["confidence_score"] == k / 7 for k, p in enumerate(paths))
    assert [k for k, _ in pairs[0][1]] == sorted(got[paths[0]])


@pytest.mark.parametrize("paths", [[], ["only.mp4"]])
def test_small_documents(spark, tmp_path, paths):
    json_io.write_document(json_io.batch_document(batch(spark, paths) if paths else batch(spark, ["x"]).limit(0)), str(tmp_path / "out"))
    got = json.loads(put_together(tmp_path / "out"))
    assert got is None if not paths else list(got) == paths


def test_report_in_order(spark, tmp_path):
    rows = [(k, f"v{k}", k % 3 > 0, 1, 2, 1.5, "cpu", "sum", "err") for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, video_path string, success boolean, frames_analyzed long, total_frames_extracted long, "
                                     "total_processing_time double, acceleration_method string, video_summary string, error string").repartition(5)
    json_io.write_text_report(json_io.batch_report(df), str(tmp_path / "out"))
    text = put_together(tmp_path / "out")
    assert text.startswith(json_io.REPORT_TITLE) and text.rstrip().endswith("Average per video: 1.5s")
    assert [ln for ln in text.splitlines() if ln.startswith("Video ")] == [f"Video {k + 1}: v{k}" for k in range(300)]


def test_frame_details_in_bounded_parts(spark):
    rows = [(v, k, k % 2 == 0, float(k), f"d{k}" if k % 2 == 0 else None, None if k % 2 == 0 else "e", 0.5, "m") for v in (1, None) for k in range(10)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, success boolean, timestamp double, description string, error string, "
                                     "processing_time double, model_used string").repartition(4)
    got = {(r.video_id, r.part): r for r in rollups.frame_details(df, 4).collect()}
    assert sorted(got, key=str) == sorted([(v, p) for v in (1, None) for p in range(3)], key=str)
    assert [d.frame_idx for d in got[1, 1].details] == [4, 5, 6, 7] and got[None, 2].n_frames == 2
    assert got[1, 0].details[1].error == "e" and got[1, 0].details[2].frame_description == "Frame 3"


def test_peak_memory(spark):
    df = spark.createDataFrame([("a", 1.0, True, 5), ("a", 1.0, True, 9), ("a", 3.0, False, None), ("b", None, True, None)],
                               "model_used string, processing_time double, success boolean, used long")
    for approx in (False, True):
        got = {r.model_used: r for r in rollups.latency_profile(df, approx=approx, memory="used").collect()}
        assert got["a"].peak_memory == 9 and got["b"].peak_memory is None and got["a"].frames == 3


@pytest.mark.parametrize("rule", tf.RULES)
@pytest.mark.parametrize("n", [1, 2, 7, 30])
def test_table_function_is_the_sampler(spark, rule, n):
    sizes = {1: 1, 2: 2, 3: 13, 4: 200}
    f = spark.createDataFrame([(v, k, f"x{k}") for v, t in sizes.items() for k in range(t)], "video_id long, frame_idx long, note string")
    s = spark.createDataFrame(list(sizes.items()), "video_id long, total_frames int")
    tf.register(spark)
    got = spark.sql("SELECT * FROM sample_frames(TABLE({f}), {n}, {rule})", f=f.join(s, "video_id"), n=n, rule=rule)
    assert got.columns == ["video_id", "frame_idx", "note", "total_frames", "sample_pos"]
    cols = ["video_id", "frame_idx", "sample_pos", "note"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, smp.sample_by_rule(f, s, n, rule).select(cols).collect()))


def test_table_function_refuses(spark):
    tf.register(spark)
    f = spark.createDataFrame([(1, 0)], "video_id long, frame_idx long")
    with pytest.raises(Exception, match="total_frames"):
        spark.sql("SELECT * FROM sample_frames(TABLE({f}), 3, 'uniform')", f=f).collect()
    with pytest.raises(Exception, match="one of"):
        spark.sql("SELECT * FROM sample_frames(TABLE({f}), 3, 'best')", f=f.withColumn("total_frames", F.lit(1))).collect()


def test_config_overlay(spark):
    keys = {"a": 1, "b": 2, "c": 3}
    texts = ['{"a": 9, "c": 8}', '{"a": 9, "b": "x", "c": 8}', '{"b": null, "c": 8}', '{"a": 1.5, "b": 7}', "not json", "[1]", None, "{}", '{"b": {"a": 5}, "c": 4}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, js string")
    got = {r.k: tuple(r.config) for r in rq.overlay_configs(df, F.col("js"), keys).collect()}
    assert got == {0: (9, 2, 8), 1: (9, 2, 3), 2: (1, 2, 8), 3: (1, 2, 3), 4: (1, 2, 3), 5: (1, 2, 3), 6: (1, 2, 3), 7: (1, 2, 3), 8: (1, 2, 3)}
