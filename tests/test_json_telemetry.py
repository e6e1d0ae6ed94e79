"""JSON readers/writers and telemetry gates on hand-written lines."""

import json

from pyspark.sql import functions as F

from framelake.functions import telemetry as tm
from framelake.sources import json_io, requests as rq


def test_loose_scan_cases(spark):
    df = spark.createDataFrame([
        ('{"success": true, "video_path": "a.mp4", "frames_analyzed": 3, "total_frames_extracted": 4, '
         '"total_processing_time": 1.5}',),
        ('{"success": true}',)], "j string")
    r = json_io.scan_result_json(df, "j").select("r").collect()
    assert r[0].r.video_path == "a.mp4" and r[0].r.frames_analyzed == 3 and r[0].r.success
    assert r[0].r.total_processing_time == 1.5 and r[0].r.error == ""
    assert not r[1].r.success and r[1].r.error == "JSON parsing error"


def test_strict_reader(spark):
    df = spark.createDataFrame([('{"success": false}',), ('{"success": false, "error": "boom"}',),
                                ('{"success": tr',), ('{"success": true, "frames_analyzed": 2}',)], "j string")
    got = [r.s for r in df.select(json_io.read_results_json_strict(F.col("j")).alias("s")).collect()]
    assert [g.error for g in got] == ["Unknown error", "boom", "JSON parse error", None]
    assert got[3].success and got[3].frames_analyzed == 2


def test_writers_and_fourcc(spark, tmp_path):
    cat = spark.createDataFrame([(1, 20, 15.0, 20 / 15.0, 320, 240, "MJPG")],
                                "video_id long, total_frames int, fps double, duration double, width int, height int, codec string")
    info = json.loads(cat.select(json_io.info_json(cat).alias("j")).first().j)
    assert info["frame_size"] == [320, 240] and info["total_frames"] == 20
    assert spark.range(1).select(json_io.decode_fourcc(F.lit(1196444237)).alias("c")).first().c == "MJPG"
    assert spark.range(1).select(json_io.decode_fourcc(F.lit(0x00004241)).alias("c")).first().c == "AB"
    res = spark.createDataFrame([("b.mp4", "d", ["o"], ["a"], "s", ["e"], 0.5, 10), ("a.mp4", "d2", [], [], "s", [], 0.75, 3)],
                                "path string, description string, objects array<string>, actions array<string>, "
                                "scene_context string, temporal_events array<string>, confidence_score double, "
                                "processing_time_ms long")
    lines = [json.loads(r.json) for r in json_io.batch_json(res).collect()]
    assert list(lines[0]) == ["a.mp4"] and lines[1]["b.mp4"]["confidence_score"] == 0.5
    json_io.write_json_lines(json_io.batch_json(res), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_probe_parsing(spark):
    df = spark.createDataFrame([
        ('{"streams": [{"codec_type": "video", "r_frame_rate": "30000/1001", "duration": "2.0"}]}',),
        ('{"streams": [{"codec_type": "audio"}]}',), ("garbage",),
        ('{"streams": [{"codec_type": "video", "nb_frames": "12"}]}',)], "p string")
    got = [r.x for r in df.select(json_io.parse_probe(F.col("p")).alias("x")).collect()]
    assert got[0].frames == int(30000 / 1001 * 2.0) and abs(got[0].fps - 29.97002997) < 1e-6
    assert (got[1].frames, got[1].fps, got[1].duration) == (100, 25.0, 4.0)
    assert (got[2].frames, got[2].fps) == (100, 25.0)
    assert (got[3].frames, got[3].fps, got[3].duration) == (12, 25.0, 0.0)


def test_host_and_gpu_gates(spark):
    lines = spark.createDataFrame([
        ("h1", 1, "10:00 up 2 days, load average: 9.5, 1.0, 1.0"),
        ("h1", 2, "u 1 120.0 x OLLAMA RUNNER"), ("h1", 3, "u 2 300.0 ollama runner"),
        ("h1", 4, "GPU[0] 40% x"), ("h1", 5, "GPU[0] 85% x"), ("h1", 6, "card0,45"),
        ("h2", 1, "load average: bad"), ("h2", 2, "GPU use (%): 3"), ("h2", 3, "card0,N/A")],
        "host string, line_no long, line string")
    g = {r.host: r for r in tm.host_gate(lines).collect()}
    assert g["h1"].system_load == 9.5 and g["h1"].ollama_cpu_usage == 120.0
    assert not g["h1"].can_process and g["h1"].recommendation == "wait_or_restart"
    assert g["h2"].can_process and g["h2"].recommendation == "normal"
    dec = spark.createDataFrame([("h1", True), ("h2", True), ("h3", False)], "host string, available boolean")
    s = {r.host: r for r in tm.gpu_status(lines, dec).collect()}
    assert s["h1"].gpu_utilization == 85.0 and not s["h1"].can_process and s["h1"].status == "GPU_READY"
    assert s["h2"].recommendation == "fallback_cpu" and s["h2"].status == "GPU_STATUS_ERROR"
    assert s["h3"].status == "CPU_FALLBACK"


def test_responses_and_overlay(spark):
    df = spark.createDataFrame([(200, '{"response": "  hi \\n"}'), (404, "x")], "s int, b string")
    got = [r.r for r in df.select(rq.parse_response(F.col("s"), F.col("b")).alias("r")).collect()]
    assert got[0].description == "hi" and got[0].model == "" and got[0].eval_count == 0
    assert got[1].error == "HTTP 404"
    js = spark.createDataFrame([('{"a": 1, "b": "x", "c": 3}',), ("nope",)], "j string")
    o = [r.o for r in js.select(rq.overlay_config(F.col("j"), {"a": 10, "b": 20, "c": 30}).alias("o")).collect()]
    assert (o[0].a, o[0].b, o[0].c) == (1, 20, 30) and (o[1].a, o[1].b, o[1].c) == (10, 20, 30)


def test_loose_scan_of_all_keys_is_the_scan_of_each(spark):
    """Two passes over the text find what a scan per key finds, on broken texts as well."""
    import random
    rnd = random.Random(1)
    bits = ['"success": ', '"video_path": ', '"frames_analyzed": 1', '"error": ', '"total_frames_extracted": 2,', '"total_processing_time": 3.5}', "true", "false",
            '"a b"', '"x', "12", ",", "}", "{", "\n", " ", '"', '"gpu_accelerated": ', '"model_used": "m"']
    df = spark.createDataFrame([("".join(rnd.choices(bits, k=rnd.randint(0, 14))),) for _ in range(1500)], "js string")
    rows = json_io.scan_result_json(df, "js").select("js", "r.*", *[json_io.scan_json_key(F.col("js"), k).alias(f"one_{k}") for k in json_io.SCAN_KEYS]).collect()
    whole = 0
    for r in rows:
        if r.error != "JSON parsing error":
            whole += 1
            assert (r.video_path, r.model_used, r.error, r.success) == (r.one_video_path, r.one_model_used, r.one_error, r.one_success == "true"), r.js
    assert whole > 20
