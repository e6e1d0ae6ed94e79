"""Driver tables and the fixtures derived from them.

Every fixture here is a Spark job over the driver's parquet tables, so its work
grows with them. The SQL oracle in ``framelake.oracle`` restates the same
definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans import ordered

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed values of the frame fixture: frames come at a constant rate.
FRAME_FPS = 10.0
GRAY_SIDE = 8            # 64 elements -> 8x8 single-channel tile
COLOR_PIXELS = 22        # 64 elements and two zeros -> 22 BGR pixels, 2 rows x 11 columns
COLOR_H, COLOR_W = 2, 11

# Minutes of event time per ordering segment for the analyses fixture.
ANALYSIS_SEGMENT_MINUTES = 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, with the partitions of its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_values(arr: Column | str) -> Column:
    """float embedding element -> uint8 level: clamp(floor((e + 0.5) * 255))."""
    return F.transform(
        arr, lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255)))
        .cast("int"))


def frames_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames(video_id, frame_idx, ts, height, width, channels, pixels array<int>).

    video = ``label``; ``frame_idx`` = 0-based position by ``vec_id`` within the
    label, computed with segmented positions (a hot label never lands in one task).
    """
    emb = read(spark, sf_dir, "embeddings").select(
        F.col("label").cast("int").alias("video_id"), "vec_id",
        pixel_values("embedding").alias("pixels"))
    emb = ordered.with_segments(emb, ordered.span_segments("vec_id"))
    pos = ordered.dense_positions(emb, ["video_id"], ["vec_id"], out="frame_idx")
    return pos.select(
        "video_id", "frame_idx", "vec_id",
        (F.col("frame_idx") / F.lit(FRAME_FPS)).alias("ts"),
        F.lit(GRAY_SIDE).alias("height"), F.lit(GRAY_SIDE).alias("width"),
        F.lit(1).alias("channels"), "pixels")


def frames_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour frames: pixel j of channel c (B=0, G=1, R=2) = element 3j+c, 22 pixels; all 64
    elements are used, elements 64 and 65 are zero."""
    f = frames_gray(spark, sf_dir)
    return f.select(
        "video_id", "frame_idx", "vec_id", "ts",
        F.lit(COLOR_H).alias("height"), F.lit(COLOR_W).alias("width"), F.lit(3).alias("channels"),
        padded(F.col("pixels")).alias("pixels"))


def padded(pixels: Column) -> Column:
    """Levels filled up with zeros to whole BGR pixels."""
    return F.concat(pixels, F.array_repeat(F.lit(0), F.lit(3 * COLOR_PIXELS) - F.size(pixels)))


def frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames without pixels: positions are found on (label, vec_id) alone."""
    return frames_gray(spark, sf_dir).drop("pixels")


def with_pixels(picked: DataFrame, spark: SparkSession, sf_dir: str, color: bool = False) -> DataFrame:
    """Attach the pixels of picked frames (rows of ``frame_index``) by ``vec_id``."""
    pixels = pixel_values("embedding")
    emb = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("_vec"), (padded(pixels) if color else pixels).alias("pixels"))
    return picked.join(emb, F.col("vec_id") == F.col("_vec")).drop("_vec")


def video_sizes(frames: DataFrame) -> DataFrame:
    """(video_id, total_frames): partial aggregation, so skew-safe."""
    return frames.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("total_frames"))


def frame_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per video of the frame fixture, read from the one column it
    needs (the label), without deriving frame positions first."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("video_id"))
    return video_sizes(e)


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame analysis rows from ``events``.

    video = user_id; frame_idx = position by (ts, event_id); success = not an
    error event; processing_time = value; model = event_type; description =
    event_type + ' ' + props (NULL for failures, which carry an error text).
    """
    ev = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    # segment = event-time minute bucket, computed on the zone-less timestamp so
    # it is monotone in ts whatever the session time zone (no DST jumps)
    minute = (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 1440
              + F.hour("ts") * 60 + F.minute("ts"))
    ev = ordered.with_segments(ev, F.floor(minute / F.lit(ANALYSIS_SEGMENT_MINUTES)))
    pos = ordered.dense_positions(ev, ["user_id"], ["ts", "event_id"], out="frame_idx")
    ok = F.col("event_type") != F.lit("error")
    return pos.select(
        F.col("user_id").alias("video_id"), "frame_idx", "event_id",
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        ok.alias("success"),
        F.when(ok, F.concat("event_type", F.lit(" "), "props")).alias("description"),
        F.when(~ok, F.concat(F.lit("Processing error: "), F.col("props"))).alias("error"),
        F.col("value").alias("processing_time"),
        F.col("event_type").alias("model_used"),
        "props")


def timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at real, uneven times: video = user_id, frame_idx = event_id, ts = seconds since the video's first event."""
    ev = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = ev.groupBy("video_id").agg(F.min("us").alias("_first"))
    return ordered.null_safe_join(ev, first, ["video_id"]).select("video_id", "frame_idx", ((F.col("us") - F.col("_first")) / F.lit(1e6)).alias("ts"))


def long_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long descriptions: video = source, frame_idx = position by doc_id,
    description = text, success = the document is not labelled toxic."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    toxic = (read(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
             .select("doc_id").distinct().withColumn("_toxic", F.lit(True)))
    docs = docs.join(toxic, "doc_id", "left")
    docs = ordered.with_segments(docs, ordered.span_segments("doc_id"))
    pos = ordered.dense_positions(docs, ["source"], ["doc_id"], out="frame_idx")
    return pos.select(F.col("source").alias("video_id"), "frame_idx", "doc_id",
                      F.col("_toxic").isNull().alias("success"), F.col("text").alias("description"),
                      F.lit(None).cast("string").alias("error"),
                      F.length("text").cast("double").alias("processing_time"),
                      F.lit("text").alias("model_used"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch results in input order: path per user, seq = event_id,
    confidence = fractional part of value, success = not an error event."""
    ev = read(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("video_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("path"),
        F.col("event_id").alias("seq"), (F.col("value") % 1).alias("confidence"),
        (F.col("event_type") != "error").alias("success"), F.col("event_type").alias("model_used"),
        F.col("value").alias("processing_time"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory ledger from events: seq = event_id, tag = event_type,
    alloc on even / dealloc on odd event_id, bytes = props.k * 1024."""
    ev = read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("tag"),
        F.when(F.col("event_id") % 2 == 0, F.lit("alloc")).otherwise(F.lit("dealloc")).alias("op"),
        (k * 1024).alias("bytes"))


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat content parts from ``conversations``: every turn has its text
    (ppos 2); a user turn also carries an image (ppos 0) when
    (conv_id + turn) mod 3 = 0 and a video (ppos 1) when (conv_id + turn) mod 4 = 0."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = F.col("role") == "user"
    k = F.col("conv_id") + F.col("turn")
    parts = F.filter(F.array(
        F.when(user & (F.pmod(k, F.lit(3)) == 0), F.struct(F.lit(0).alias("ppos"), F.lit("image").alias("kind"))),
        F.when(user & (F.pmod(k, F.lit(4)) == 0), F.struct(F.lit(1).alias("ppos"), F.lit("video").alias("kind"))),
        F.struct(F.lit(2).alias("ppos"), F.lit("text").alias("kind"))), lambda x: x.isNotNull())
    e = c.select("conv_id", "turn", "role", "text", F.explode(parts).alias("p"))
    return e.select("conv_id", "turn", "role", F.col("p.ppos").alias("ppos"), F.col("p.kind").alias("kind"),
                    F.when(F.col("p.kind") == "text", F.col("text")).alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with injected bad values: element vec_id % 64 becomes NaN when
    vec_id % 7 = 0, +Inf when vec_id % 11 = 0, x1000 when vec_id % 5 = 0
    (first rule wins). Values are doubles."""
    e = read(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    vec = F.transform("embedding", lambda x, i: F.when(
        i == F.pmod(vid, F.lit(64)),
        F.when(vid % 7 == 0, F.lit(float("nan"))).when(vid % 11 == 0, F.lit(float("inf")))
        .when(vid % 5 == 0, x.cast("double") * 1000).otherwise(x.cast("double"))).otherwise(x.cast("double")))
    return e.select("vec_id", "label", vec.alias("vec"), "embedding")


def telemetry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines per host from events (host = user_id mod 16, line_no = event_id):
    view -> uptime line, click -> process line, purchase -> GPU use line,
    signup -> utilisation CSV line, error -> noise. Some users get malformed
    variants (see the rules below) so every failure branch is exercised."""
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    u = F.col("user_id")
    s = lambda c: c.cast("string")
    line = (F.when(F.col("event_type") == "view",
                   F.when(u % 13 == 0, F.lit(" 10:01  up 3 days, load average: n/a"))
                   .otherwise(F.concat(F.lit(" 10:01  up 3 days,  2 users,  load average: "), s((k / 10).cast("long")),
                                       F.lit("."), s(k % 10), F.lit("0, 0.50, 0.25"))))
            .when(F.col("event_type") == "click",
                  F.when(u % 5 == 0, F.concat(F.lit("root "), s(F.col("event_id")), F.lit(" "), s(k), F.lit(".5 ollama serve")))
                  .otherwise(F.concat(F.lit("user  "), s(F.col("event_id")), F.lit("  "), s(k * 2), F.lit(".5  1.0 /usr/bin/Ollama Runner --port 11434"))))
            .when(F.col("event_type") == "purchase",
                  F.when(u % 7 == 0, F.concat(F.lit("GPU use (%): "), s(k)))
                  .otherwise(F.concat(F.lit("GPU["), s(u % 4), F.lit("]   "), s(k), F.lit("%   busy"))))
            .when(F.col("event_type") == "signup",
                  F.when(u % 9 == 0, F.lit("card0,N/A")).otherwise(F.concat(F.lit("card"), s(u % 4), F.lit(","), s(k))))
            .otherwise(F.concat(F.lit("error: "), F.col("props"))))
    return ev.select(F.concat(F.lit("host"), s(u % 16)).alias("host"), F.col("event_id").alias("line_no"),
                     line.alias("line"))


def gpu_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoder availability per host: host number not divisible by 3."""
    ev = read(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("h")).distinct()
    return ev.select(F.concat(F.lit("host"), F.col("h").cast("string")).alias("host"),
                     (F.col("h") % 3 != 0).alias("available"))


def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe metadata JSON per event: an audio stream, then a video stream
    (absent for signup). Rate '0/0' for errors, '30000/1001' for clicks,
    else (20 + 5*(user_id mod 4))/1; duration text absent for views; nb_frames
    only for purchases."""
    ev = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    et = F.col("event_type")
    rate = (F.when(et == "error", F.lit("0/0")).when(et == "click", F.lit("30000/1001"))
            .otherwise(F.concat((F.lit(20) + (F.col("user_id") % 4) * 5).cast("string"), F.lit("/1"))))
    video = F.concat(
        F.lit('{"codec_type": "video", "r_frame_rate": "'), rate, F.lit('"'),
        F.when(et != "view", F.concat(F.lit(', "duration": "'), F.col("value").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.when(et == "purchase", F.concat(F.lit(', "nb_frames": "'), k, F.lit('"'))).otherwise(F.lit("")),
        F.lit("}"))
    js = F.concat(F.lit('{"streams": [{"codec_type": "audio", "duration": "1.0"}'),
                  F.when(et != "signup", F.concat(F.lit(", "), video)).otherwise(F.lit("")), F.lit("]}"))
    return ev.select("event_id", js.alias("probe"))
