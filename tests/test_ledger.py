"""Memory-ledger rules, cases from the reference's memory manager tests."""

import pytest

from framelake.operators import ledger as lg

MIB = 1024 * 1024


def ledger_df(spark, events):
    rows = [(i, tag, op, b) for i, (tag, op, b) in enumerate(events)]
    return spark.createDataFrame(rows, "seq long, tag string, op string, bytes long")


@pytest.mark.parametrize("span", [None, 2])
def test_totals_follow_allocations(spark, span):
    ev = [("test1", "alloc", 1024), ("test2", "alloc", 2048), ("test1", "dealloc", 1024), ("test2", "dealloc", 2048)]
    got = lg.ledger_running(ledger_df(spark, ev), span=span).orderBy("seq").collect()
    assert [r.total for r in got] == [1024, 3072, 2048, 0]
    assert [r.peak for r in got] == [1024, 3072, 3072, 3072]


@pytest.mark.parametrize("span", [None, 2])
def test_per_tag_and_same_tag(spark, span):
    ev = [("video_frames", "alloc", 1000), ("ml_model", "alloc", 2000), ("video_frames", "alloc", 500)]
    got = {r.tag: r.bytes for r in lg.ledger_by_tag(ledger_df(spark, ev), span=span).collect()}
    assert got == {"video_frames": 1500, "ml_model": 2000}
    ev2 = ev + [("video_frames", "dealloc", 500)]
    got2 = {r.tag: r.bytes for r in lg.ledger_by_tag(ledger_df(spark, ev2), span=span).collect()}
    assert got2 == {"video_frames": 1000, "ml_model": 2000}
    ev3 = [("t", "alloc", 1000), ("t", "alloc", 2000), ("t", "alloc", 1500), ("t", "dealloc", 1000)]
    assert [r.bytes for r in lg.ledger_by_tag(ledger_df(spark, ev3), span=span).collect()] == [3500]


def test_clamp_removal_and_zero_entries(spark):
    ev = [("a", "alloc", 100), ("a", "dealloc", 500),       # clamps at 0 and removes a
          ("b", "dealloc", 50),                             # unknown tag: ignored
          ("c", "alloc", 0),                                # zero-byte alloc leaves a 0 entry
          ("d", "alloc", 10), ("d", "dealloc", 10), ("d", "dealloc", 5)]
    got = {r.tag: r.bytes for r in lg.ledger_by_tag(ledger_df(spark, ev), span=2).collect()}
    assert got == {"c": 0}
    run = lg.ledger_running(ledger_df(spark, ev), span=2).orderBy("seq").collect()
    assert [r.total for r in run] == [100, 0, 0, 0, 10, 0, 0]
    assert run[-1].peak == 100


def test_admission_limit_and_boundary(spark):
    ev = [("x", "alloc", 8 * MIB)]
    r = lg.ledger_running(ledger_df(spark, ev), limit_bytes=10 * MIB, required_bytes=1 * MIB).collect()[0]
    assert r.admit
    r = lg.ledger_running(ledger_df(spark, ev), limit_bytes=10 * MIB, required_bytes=5 * MIB).collect()[0]
    assert not r.admit
    full = [("x", "alloc", 5 * MIB)]
    assert lg.ledger_running(ledger_df(spark, full), limit_bytes=5 * MIB, required_bytes=0).collect()[0].admit
    assert not lg.ledger_running(ledger_df(spark, full), limit_bytes=5 * MIB, required_bytes=1).collect()[0].admit


def test_peak_does_not_fall_and_zero_ops(spark):
    ev = [("p", "alloc", 5000), ("p", "dealloc", 5000), ("z", "alloc", 0), ("z", "dealloc", 0)]
    got = lg.ledger_running(ledger_df(spark, ev)).orderBy("seq").collect()
    assert [r.total for r in got] == [5000, 0, 0, 0]
    assert [r.peak for r in got] == [5000, 5000, 5000, 5000]


def test_report_integer_mb(spark):
    ev = [("a", "alloc", 3 * MIB + 5), ("b", "alloc", MIB - 1)]
    rep = {r.tag: r.mb for r in lg.ledger_report(lg.ledger_by_tag(ledger_df(spark, ev))).collect()}
    assert rep == {"a": 3, "b": 0, "__total__": 4}


def test_video_rollup_error_rows(spark):
    from framelake.operators import rollups
    a = spark.createDataFrame([(1, 0, True, "a person walks", None, 1.234, "m"), (1, 1, False, None, "HTTP 500", 2.0, "m")],
                              "video_id long, frame_idx long, success boolean, description string, error string, "
                              "processing_time double, model_used string")
    req = spark.createDataFrame([(1,), (2,)], "video_id long")
    got = {r.video_id: r for r in rollups.video_rollup(a, req).collect()}
    assert got[1].success and got[1].frames_analyzed == 1 and got[1].total_frames_extracted == 2
    assert got[1].total_processing_time == 3.23 and got[1].error is None
    assert not got[2].success and got[2].error == "No frames could be extracted from video"
