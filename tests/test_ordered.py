"""Segmented ordered primitives equal plain window functions, on a skewed key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.plans import ordered


def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        k = 0 if i % 3 else rnd.randint(1, 5)          # key 0 holds two thirds of the rows
        rows.append((k, i * 3 + rnd.randint(0, 2), rnd.randint(-50, 50)))
    return spark.createDataFrame(rows, "k long, o long, x long")


def test_positions_running_and_previous(spark):
    df = skewed(spark)
    seg = ordered.with_segments(df, ordered.span_segments("o", 7))
    got = ordered.dense_positions(seg, ["k"], ["o"], out="pos")
    got = ordered.running_sum(got, ["k"], ["o"], "x", "rs")
    got = ordered.running_extreme(got, ["k"], ["o"], "rs", "rmin", how="min")
    got = ordered.running_extreme(got, ["k"], ["o"], "rs", "rmax", how="max").drop(ordered.SEG)
    got = ordered.with_previous(got, ["k"], "pos", ["x"], span=5)
    w = Window.partitionBy("k").orderBy("o")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("rs", F.sum("x").over(wr))
    ref = ref.withColumn("rmin", F.min("rs").over(wr)).withColumn("rmax", F.max("rs").over(wr)) \
             .withColumn("prev_x", F.lag("x").over(w))
    cols = ["k", "o", "x", "pos", "rs", "rmin", "rmax", "prev_x"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())


def test_global_positions(spark):
    df = skewed(spark)
    got = ordered.global_positions(df, [F.col("x").desc(), F.col("o").asc()], out="pos")
    ref = df.withColumn("pos", (F.row_number().over(Window.orderBy(F.col("x").desc(), "o")) - 1).cast("long"))
    assert sorted(got.select("o", "pos").collect()) == sorted(ref.select("o", "pos").collect())


def test_two_level_segment_prefix(spark, monkeypatch):
    """Force several super-segments so both prefix levels are exercised."""
    monkeypatch.setattr(ordered, "SUPER_SPAN", 4)
    df = skewed(spark)
    seg = ordered.with_segments(df, ordered.span_segments("o", 5))
    got = ordered.dense_positions(seg, ["k"], ["o"], out="pos")
    got = ordered.running_sum(got, ["k"], ["o"], "x", "rs")
    got = ordered.running_extreme(got, ["k"], ["o"], "rs", "rmin", how="min").drop(ordered.SEG)
    w = Window.partitionBy("k").orderBy("o")
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("rs", F.sum("x").over(wr))
    ref = ref.withColumn("rmin", F.min("rs").over(wr))
    cols = ["k", "o", "x", "pos", "rs", "rmin"]
    assert sorted(got.select(cols).collect()) == sorted(ref.select(cols).collect())
    g = ordered.with_segments(df, ordered.span_segments("o", 5))
    gl = ordered.running_sum(g, [], ["o"], "x", "rs").drop(ordered.SEG)
    gref = df.withColumn("rs", F.sum("x").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(gl.select("o", "rs").collect()) == sorted(gref.select("o", "rs").collect())
