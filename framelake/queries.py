"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or fixtures Spark derives from them) in
full. Floating outputs are rounded to 6 digits so the DuckDB oracle in
``framelake.oracle`` can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import features as feat
from framelake.operators import sampling as smp
from framelake.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    """Round a double to 6 digits and normalise -0.0."""
    x = F.round(c, 6)
    return F.when(x == 0, F.lit(0.0)).otherwise(x)


# Fixed parameters of the registered queries (reference test configuration).
CAP_FROM = 32
UNIFORM_N = 8
MIDPOINT_N = 10
KEYFRAME_N = 8
TIMES_N = 10


# --- frames: sampling and features --------------------------------------------------

@query("frame_motion_brightness")
def frame_motion_brightness(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: P1 uniform sample -> N15 brightness -> W1 motion -> A17 per video."""
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N)
    s = tb.with_pixels(s, spark, sf)
    s = s.withColumn("brightness", feat.brightness(F.col("pixels")))
    s = feat.with_motion(s, pos="sample_pos")
    v = feat.video_features(s)
    return v.select("video_id", F.col("n_frames").cast("long").alias("n_frames"),
                    r6(F.col("avg_brightness")).alias("avg_brightness"),
                    r6(F.col("motion_intensity")).alias("motion_intensity"),
                    r6(F.col("features")[7]).alias("frames_norm"))


def _sampled(rows: DataFrame) -> DataFrame:
    return rows.select("video_id", F.col("sample_pos").cast("long").alias("sample_pos"),
                       F.col("frame_idx").cast("long").alias("frame_idx"),
                       r6(F.col("ts")).alias("ts"))


@query("frame_sample_uniform")
def frame_sample_uniform(spark, sf):
    frames = tb.frames_gray(spark, sf)
    return _sampled(smp.sample_uniform(frames, tb.frame_sizes(spark, sf), UNIFORM_N))


@query("frame_cap")
def frame_cap(spark, sf):
    """The first 16 of 32 sampled frames of every video."""
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), CAP_FROM)
    return smp.cap_frames(s).select("video_id", "sample_pos", "frame_idx")


@query("frame_sample_strategy")
def frame_sample_strategy(spark, sf):
    """P8 with a strategy per video: keyframes for even video ids, else uniform."""
    sizes = tb.frame_sizes(spark, sf).withColumn(
        "strategy", F.when(F.col("video_id") % 2 == 0, "keyframe").otherwise("adaptive"))
    return smp.sample_frames_by_strategy(tb.frames_color(spark, sf), sizes, KEYFRAME_N, tb.COLOR_PIXELS)


@query("frame_sample_midpoint")
def frame_sample_midpoint(spark, sf):
    frames = tb.frames_gray(spark, sf)
    return _sampled(smp.sample_midpoint(frames, tb.frame_sizes(spark, sf), MIDPOINT_N))


@query("frame_sample_linspace")
def frame_sample_linspace(spark, sf):
    frames = tb.frames_gray(spark, sf)
    return _sampled(smp.sample_linspace(frames, tb.frame_sizes(spark, sf), UNIFORM_N))


@query("frame_sample_times")
def frame_sample_times(spark, sf):
    frames = tb.frames_gray(spark, sf)
    s = smp.sample_times(frames, tb.frame_sizes(spark, sf), TIMES_N, tb.FRAME_FPS)
    return s.select(
        "video_id", F.col("sample_pos").cast("long").alias("sample_pos"),
        r6(F.col("t")).alias("t"), "frame_idx", r6(F.col("ts")).alias("ts"))


@query("frame_seek_times")
def frame_seek_times(spark, sf):
    """P3 + J6 on the uneven timestamps of ``events``: the first frame at or after each of 10 midpoints of its video."""
    s = smp.sample_times_asof(tb.timed_frames(spark, sf), TIMES_N)
    return s.select("video_id", "sample_pos", "t", "frame_idx", "ts")  # equal doubles: the same operations in the same order


@query("frame_sample_sql")
def frame_sample_sql(spark, sf):
    """the uniform sampler as a table function, from SQL."""
    from framelake.functions import table_functions
    table_functions.register(spark)
    frames = tb.frame_index(spark, sf).join(tb.frame_sizes(spark, sf), "video_id").select("video_id", "frame_idx", "ts", "total_frames")
    picked = spark.sql("SELECT * FROM sample_frames(TABLE({frames}), {n}, 'uniform')", frames=frames, n=UNIFORM_N)
    return _sampled(picked)


@query("frame_linspace_times")
def frame_linspace_times(spark, sf):
    """P4, time form, + J6: t_i = i * duration / (N - 1), from the first frame to the last."""
    s = smp.sample_times_asof(tb.timed_frames(spark, sf), TIMES_N, "linspace")
    return s.select("video_id", "sample_pos", "t", "frame_idx", "ts")  # equal doubles: the same operations in the same order


@query("frame_sample_keyframes")
def frame_sample_keyframes(spark, sf):
    frames = tb.frames_color(spark, sf)
    k = smp.sample_keyframes(frames, tb.frame_sizes(spark, sf), KEYFRAME_N, tb.COLOR_PIXELS)
    return k.select("video_id", "sample_pos", "frame_idx", "kind", r6(F.col("change")).alias("change"))


@query("frame_color_entropy")
def frame_color_entropy(spark, sf):
    """A16 + N15 per colour frame."""
    f = feat.with_color_entropy(tb.frames_color(spark, sf))
    return f.select("video_id", "frame_idx", r6(F.col("entropy")).alias("entropy"),
                    r6(feat.brightness(F.col("pixels"), 3)).alias("brightness"))


@query("frame_histogram")
def frame_histogram(spark, sf):
    """Non-empty (channel, bin) counts per colour frame."""
    return feat.channel_histogram(tb.frames_color(spark, sf))


@query("frame_features_color")
def frame_features_color(spark, sf):
    """A17 over a uniform sample of colour frames: brightness, motion (gray of
    each frame), colour entropy and edge density (N16)."""
    from framelake.functions import images as im
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), 16)
    s = im.with_edge_density(tb.with_pixels(s, spark, sf, color=True), tb.COLOR_H, tb.COLOR_W)
    s = feat.with_color_entropy(s.withColumn("brightness", feat.brightness(F.col("pixels"), 3)))
    s = feat.with_motion(s, pos="sample_pos", channels=3)
    v = feat.video_features(s)
    return v.select("video_id", F.col("n_frames").cast("long").alias("n_frames"),
                    F.transform(feat.feature_fallback(F.col("features")), lambda x: r6(x)).alias("features"))


@query("frame_features_fallback")
def frame_features_fallback(spark, sf):
    """A18 acting: of videos with odd ids one frame is sampled, so that their motion is undefined and the fixed vector stands in."""
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N)
    s = s.filter((F.col("video_id") % 2 == 0) | (F.col("sample_pos") == 0))
    s = tb.with_pixels(s, spark, sf)
    v = feat.video_features(feat.with_motion(s.withColumn("brightness", feat.brightness(F.col("pixels"))), pos="sample_pos"))
    return v.select("video_id", F.col("n_frames").cast("long").alias("n_frames"),
                    F.transform(feat.feature_fallback(F.col("features")), lambda x: r6(x)).alias("features"))


@query("frame_chunks")
def frame_chunks(spark, sf):
    """Chunks of 3 consecutive frames per video, last partial kept."""
    from framelake.operators import batches
    f = batches.chunk_by_count(tb.frames_gray(spark, sf), 3)
    return f.groupBy("video_id", "chunk").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("frame_idx").alias("first_idx"),
        F.max("frame_idx").alias("last_idx"),
        r6(F.avg(feat.brightness(F.col("pixels")))).alias("brightness"))


@query("frame_rank")
def frame_rank(spark, sf):
    from framelake.operators import batches
    f = tb.frames_gray(spark, sf)
    r = batches.frame_rank(f.select("video_id", "frame_idx"), tb.frame_sizes(spark, sf))
    return r.withColumn("ts", r6(smp.frame_timestamps(F.col("frame_idx"), F.lit(tb.FRAME_FPS))))


@query("video_catalog")
def video_catalog(spark, sf):
    """S3 + S9: per-video header info and the --info JSON line."""
    from framelake.sources import json_io
    f = tb.frames_gray(spark, sf)
    cat = json_io.video_catalog(f, fps=tb.FRAME_FPS, codec_code=1196444237)
    return cat.select("video_id", "total_frames", "fps", r6(F.col("duration")).alias("duration"),
                      "width", "height", "codec")


@query("frame_memory")
def frame_memory(spark, sf):
    return feat.frame_memory(tb.frames_color(spark, sf))


@query("frame_content")
def frame_content(spark, sf):
    """N19 content check and N10 normalisation per gray frame."""
    f = tb.frames_gray(spark, sf)
    norm = feat.normalize_pixels(F.col("pixels"))
    return f.select("video_id", "frame_idx", feat.content_check(F.col("pixels"), 1).alias("content_ok"),
                    F.size(norm).alias("n_values"),
                    r6(F.aggregate(norm, F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("norm_sum"))


@query("fit_dimensions")
def fit_dimensions(spark, sf):
    """N14 over order-derived frame sizes (height 1..1080, width 1..1920)."""
    o = tb.read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 1080 + 1).cast("int").alias("h"),
        (F.col("o_orderkey") % 1920 + 1).cast("int").alias("w"))
    nw, nh = feat.fit_dimensions(F.col("h"), F.col("w"))
    return o.select("o_orderkey", "h", "w", nw.alias("new_w"), nh.alias("new_h"))


# --- batches -------------------------------------------------------------------------

@query("batch_assignment")
def batch_assignment(spark, sf):
    """I8 (1024 MB, 2 threads) and I9 (4 devices) over orders by key."""
    from framelake.operators import batches
    o = tb.read(spark, sf, "orders").select("o_orderkey")
    b = batches.assign_batches(o, "o_orderkey", max_memory_mb=1024, num_threads=2)
    b = batches.assign_round_robin(b, 4)
    return b.select("o_orderkey", "pos", "batch_size", "batch_id", "device")


# --- ledger --------------------------------------------------------------------------

LEDGER_LIMIT = 8 * 1024 * 1024
LEDGER_REQUIRED = 1024 * 1024


@query("ledger_running")
def ledger_running(spark, sf):
    from framelake.operators import ledger
    return ledger.ledger_running(tb.ledger(spark, sf), LEDGER_LIMIT, LEDGER_REQUIRED).select(
        "seq", "tag", "op", "bytes", "total", "peak", "admit")


@query("ledger_by_tag")
def ledger_by_tag(spark, sf):
    from framelake.operators import ledger
    return ledger.ledger_by_tag(tb.ledger(spark, sf))


@query("ledger_report")
def ledger_report(spark, sf):
    from framelake.operators import ledger
    return ledger.ledger_report(ledger.ledger_by_tag(tb.ledger(spark, sf)))


# --- analyses rollups ----------------------------------------------------------------

@query("video_rollup")
def video_rollup(spark, sf):
    from framelake.operators import rollups
    return rollups.video_rollup(tb.analyses(spark, sf))


@query("video_rollup_requested")
def video_rollup_requested(spark, sf):
    """A1 with a request list: every customer is asked for; those without an event get the no-frames error row."""
    from framelake.operators import rollups
    asked = tb.read(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    done = rollups.video_rollup(tb.analyses(spark, sf), asked)
    return done.select("video_id", "success", "frames_analyzed", "total_frames_extracted", "total_processing_time", "model_used", "error")


@query("video_frame_details")
def video_frame_details(spark, sf):
    """A1's ordered frame details, in parts of 16 frames here."""
    from framelake.operators import rollups
    d = rollups.frame_details(tb.analyses(spark, sf), 16)
    return d.select("video_id", "part", "first_frame", "n_frames", F.transform("details", lambda x: F.concat_ws(
        "|", x["frame_idx"].cast("string"), x["success"].cast("string"), F.coalesce(x["description"], x["error"]), x["frame_description"], x["model_used"])).alias("details"))


@query("batch_stats")
def batch_stats(spark, sf):
    from framelake.operators import rollups
    return rollups.batch_stats(rollups.video_rollup(tb.analyses(spark, sf)))


@query("batch_dedupe")
def batch_dedupe(spark, sf):
    from framelake.operators import rollups
    d = rollups.dedupe_results(tb.results(spark, sf))
    return d.select("path", "seq", r6(F.col("confidence")).alias("confidence"), "success", "model_used")


@query("throughput_stats")
def throughput_stats(spark, sf):
    """Frames per second over all analyses, seconds per video, and mean
    confidence over distinct paths (after A10)."""
    from framelake.operators import rollups
    a = tb.analyses(spark, sf).select(
        F.lit(1).alias("f"), F.col("processing_time").alias("e"), "video_id",
        F.lit(None).cast("double").alias("c"))
    conf = rollups.dedupe_results(tb.results(spark, sf)).select(
        F.lit(0).alias("f"), F.lit(0.0).alias("e"), F.lit(None).cast(a.schema["video_id"].dataType).alias("video_id"),
        F.col("confidence").alias("c"))
    both = a.unionByName(conf).agg(
        F.sum("f").cast("long").alias("frames"), F.sum("e").alias("elapsed"),
        F.count_distinct("video_id").alias("videos"), F.avg("c").alias("mean_confidence"))
    fps, per_video = rollups.throughput(F.col("frames"), F.col("elapsed"), F.col("videos"))
    return both.select(
        "frames", "videos", r6(fps).alias("frames_per_sec"), r6(per_video).alias("sec_per_video"),
        r6(F.col("mean_confidence")).alias("mean_confidence"))


@query("latency_profile")
def latency_profile(spark, sf):
    from framelake.operators import rollups
    p = rollups.latency_profile(tb.analyses(spark, sf))
    return p.select("model_used", "frames", *[r6(F.col(c)).alias(c) for c in
                    ("avg_time", "p95_time", "p99_time", "success_rate", "frames_per_sec")])


@query("latency_memory")
def latency_memory(spark, sf):
    """A11 with peak memory: the bytes in use are those of the ledger's event."""
    from framelake.operators import rollups
    a = tb.analyses(spark, sf).withColumn("used", F.get_json_object("props", "$.k").cast("long") * 1024)
    p = rollups.latency_profile(a, memory="used")
    return p.select("model_used", "frames", r6(F.col("p95_time")).alias("p95_time"), "peak_memory")


@query("observation_text")
def observation_text(spark, sf):
    from framelake.operators import rollups
    return rollups.join_observations(tb.long_analyses(spark, sf))


@query("fallback_summary_cpu")
def fallback_summary_cpu(spark, sf):
    from framelake.operators import rollups
    return rollups.fallback_summary_cpu(rollups.summary_parts(tb.long_analyses(spark, sf)))


@query("fallback_summary_gpu")
def fallback_summary_gpu(spark, sf):
    from framelake.operators import rollups
    return rollups.fallback_summary_gpu(rollups.summary_parts(tb.long_analyses(spark, sf)))


@query("theme_tags")
def theme_tags(spark, sf):
    from framelake.operators import rollups
    return rollups.theme_tags(rollups.summary_parts(tb.long_analyses(spark, sf)))


# --- tokens ----------------------------------------------------------------------------

def _vocab(spark, sf):
    """The vocabulary, computed once per query (it is read several times)."""
    from framelake.functions import tokens as tk
    from framelake.plans.joins import materialize
    return materialize(tk.build_vocab(spark, tb.read(spark, sf, "benchmark")))


@query("vocab_table")
def vocab_table(spark, sf):
    """S13/J2 source: ranked vocabulary built from ``benchmark``."""
    return _vocab(spark, sf)


@query("token_lookup")
def token_lookup(spark, sf):
    """T11 both ways: the words of ``conversations`` and ``benchmark`` and the special texts to ids, and back."""
    from framelake.functions import tokens as tk
    vocab = _vocab(spark, sf)
    texts = tb.read(spark, sf, "conversations").select("text").unionByName(tb.read(spark, sf, "benchmark").select("text"))
    words = texts.select(F.explode(tk.words(F.col("text"))).alias("token"))
    words = words.unionByName(spark.range(1).select(F.explode(F.map_values(tk.special_text_map())).alias("token"))).distinct()
    to_id = words.join(vocab.select("token", F.col("id").alias("_id")), "token", "left").select(
        "token", tk.string_to_token(F.col("token"), F.col("_id")).alias("token_id"))
    back = vocab.select(F.col("id").alias("token_id"), F.col("token").alias("_token"))
    return to_id.join(back, "token_id", "left").select(
        "token", "token_id", tk.token_to_string(F.col("token_id"), F.col("_token")).alias("back"))


@query("tokenize_docs")
def tokenize_docs(spark, sf):
    """T1 + J2 over every document."""
    from framelake.functions import tokens as tk
    docs = tb.read(spark, sf, "documents").select("doc_id", "text")
    t = tk.tokenize(docs, _vocab(spark, sf), "doc_id")
    return t.select("doc_id", F.size("input_ids").cast("long").alias("n_tokens"), "input_ids")


@query("tokenize_fallback")
def tokenize_fallback(spark, sf):
    """T2 over every document."""
    from framelake.functions import tokens as tk
    d = tb.read(spark, sf, "documents")
    return d.select("doc_id", tk.tokenize_fallback(F.col("text")).alias("ids"))


@query("token_padding")
def token_padding(spark, sf):
    """T3-T7 over conversation texts: padding, truncation, byte encodings."""
    from framelake.functions import tokens as tk
    c = tb.read(spark, sf, "conversations").select(
        "conv_id", "turn", "text", tk.tokenize_fallback(F.col("text")).alias("_fb"),
        tk.signed_bytes(F.col("text")).alias("_b"))
    fb, b = F.col("_fb"), F.col("_b")
    return c.select(
        "conv_id", "turn",
        tk.pad_or_truncate(fb, 1024, tk.SPACE_ID).alias("padded_1024"),
        F.size(tk.truncate_tokens(fb, tk.QWEN_MAX_TOKENS)).alias("n_2048"),
        F.size(tk.truncate_tokens(b, tk.LLAMA_MAX_TOKENS)).alias("n_4096"),
        tk.ascii_padded(F.col("text")).alias("ascii_16"),
        tk.prompt_bytes_512(F.col("text")).alias("bytes_512"),
        F.size(b).alias("n_bytes"),
        F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes_sum"))


@query("detokenize_docs")
def detokenize_docs(spark, sf):
    """T8-T11 + J3: decode the T1 ids of every document, specials skipped."""
    from framelake.functions import tokens as tk
    docs = tb.read(spark, sf, "documents").select("doc_id", "text")
    vocab = _vocab(spark, sf)
    t = tk.tokenize(docs, vocab, "doc_id")
    t = t.select("doc_id", "input_ids",
                 F.size(F.filter("input_ids", lambda x: tk.is_special(x))).alias("n_special"),
                 F.size(tk.strip_special(F.col("input_ids"))).alias("n_plain"),
                 tk.token_to_string(F.get(F.col("input_ids"), 0), F.lit(None).cast("string")).alias("first_special"))
    return tk.detokenize(t, vocab, "doc_id", carry=("n_special", "n_plain", "first_special"))


# --- prompts and model inputs --------------------------------------------------------

@query("chat_template")
def chat_template(spark, sf):
    from framelake.functions import prompts as pr
    return pr.chat_template(tb.chat_parts(spark, sf))


def _conv_counts(c):
    return c.withColumn("n_img", F.pmod(F.col("turn"), F.lit(4))).withColumn("n_vid", F.pmod(F.col("conv_id"), F.lit(3)))


@query("vision_prompts")
def vision_prompts(spark, sf):
    """T14-T21 per conversation message (n images = turn mod 4, n videos = conv_id mod 3)."""
    from framelake.functions import prompts as pr
    c = _conv_counts(tb.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    n = F.col("n_img") + F.col("n_vid")
    return c.select(
        "conv_id", "turn",
        pr.vision_prompt(F.col("text"), F.col("n_img"), F.col("n_vid")).alias("vision_prompt"),
        pr.video_chat_prompt(n).alias("video_chat"),
        pr.llama_vision_prompt(F.col("text"), n).alias("llama_prompt"),
        pr.describe_prompt(F.col("role")).alias("describe"),
        pr.analysis_prompt(F.col("role")).alias("analysis"),
        pr.extraction_prompt(F.col("role")).alias("extraction"),
        pr.multipart_prompt(F.col("role")).alias("multipart"),
        pr.chat_message(F.col("role"), F.col("text")).alias("chat_message"),
        pr.default_prompt(F.when(F.col("role") != "system", F.col("text")).otherwise(F.lit(""))).alias("prompt"),
        pr.placeholder_description(F.col("text"), n).alias("placeholder"),
        pr.scene_context(n).alias("scene"),
        pr.vision_tokens(F.col("n_img"), F.col("n_vid")).alias("vision_ids"))


@query("model_inputs")
def model_inputs(spark, sf):
    """Vision tokens + fallback text ids -> model input arrays."""
    from framelake.functions import prompts as pr
    from framelake.functions import tokens as tk
    c = _conv_counts(tb.read(spark, sf, "conversations").select("conv_id", "turn", "text"))
    ids = F.concat(pr.vision_tokens(F.col("n_img"), F.col("n_vid")), tk.tokenize_fallback(F.col("text")))
    m = c.select("conv_id", "turn", tk.truncate_tokens(ids, tk.QWEN_MAX_TOKENS).alias("_ids"))
    m = m.select("conv_id", "turn", pr.model_input(F.col("_ids")).alias("m"))
    n = F.col("m.sequence_length")
    mm = pr.multimodal_positions(n, F.col("m.image_positions"), F.col("m.video_positions"))
    return m.select(
        "conv_id", "turn", F.col("m.input_ids").alias("input_ids"), "m.sequence_length",
        F.size("m.attention_mask").alias("mask_len"), "m.image_positions", "m.video_positions",
        F.aggregate(pr.mask_float(F.col("m.attention_mask")), F.lit(0.0), lambda a, x: a + x).alias("mask_sum"),
        F.size(pr.batched_positions(n, 2)).alias("batched_len"),
        mm["mrope_deltas"][0].alias("mrope_delta"),
        F.size(pr.position_tensor_3d(n)).alias("pos3d_len"))


@query("placeholder_analysis")
def placeholder_analysis(spark, sf):
    """I5 + T19 + T20 per conversation: n frames = turns, prompt = first user text."""
    from framelake.functions import prompts as pr
    c = tb.read(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"),
                                 F.min_by(F.when(F.col("role") == "user", F.col("text")),
                                          F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))
    a = g.select("conv_id", "n", pr.placeholder_analysis(pr.default_prompt(F.col("prompt")), F.col("n")).alias("r"))
    return a.select("conv_id", "n", "r.description", "r.objects", "r.actions", "r.scene_context",
                    "r.temporal_events", "r.confidence_score")


# --- vectors ----------------------------------------------------------------------------

@query("vector_sanitize")
def vector_sanitize(spark, sf):
    """N6 over vectors with injected NaN / Inf / extreme values."""
    v = tb.vectors(spark, sf).select("vec_id", feat.sanitize_vector(F.col("vec")).alias("s"))
    return v.select("vec_id", F.col("s.values").alias("values"), "s.invalid_count", "s.clamped_count")


@query("vector_stats")
def vector_stats(spark, sf):
    """A14 per vector."""
    v = tb.vectors(spark, sf).select("vec_id", feat.tensor_stats(F.col("vec")).alias("t"))
    return v.select("vec_id", *[r6(F.col(f"t.{c}")).alias(c) for c in ("min", "max", "mean", "std")],
                    "t.nan_count", "t.inf_count", "t.extreme_count", "t.valid")


@query("vector_resize")
def vector_resize(spark, sf):
    """N17 (truncate to 48 / pad to 80) and N18 (label+1 tokens x 1536)."""
    v = tb.vectors(spark, sf)
    comb = feat.combine_embeddings(F.transform("embedding", lambda x: x.cast("double")), F.col("label") + 1)
    return v.select("vec_id", feat.resize_vector(F.col("embedding").cast("array<double>"), 48).alias("v48"),
                    feat.resize_vector(F.col("embedding").cast("array<double>"), 80).alias("v80"),
                    F.size(comb).alias("combined_len"),
                    r6(F.aggregate(comb, F.lit(0.0), lambda a, x: a + x)).alias("combined_sum"))


@query("vector_half_bits")
def vector_half_bits(spark, sf):
    """float16 bits by truncation, back to float, sanitised bits (Arrow UDFs)."""
    from framelake.functions import halfprec as hp
    v = tb.vectors(spark, sf).select("vec_id", F.col("vec").cast("array<float>").alias("v"))
    b = v.select("vec_id", hp.to_half_bits(F.col("v")).alias("bits"))
    r = b.select("vec_id", "bits", hp.from_half_bits(F.col("bits")).alias("back"),
                 hp.sanitize_half(F.col("bits")).alias("s"))
    return r.select("vec_id", "bits", "back", F.col("s.bits").alias("sanitized_bits"),
                    F.col("s.invalid_count").alias("invalid_count"), F.col("s.clamped_count").alias("clamped_count"))


# --- telemetry -----------------------------------------------------------------------

@query("host_gate")
def host_gate(spark, sf):
    from framelake.functions import telemetry as tm
    return tm.host_gate(tb.telemetry_lines(spark, sf))


@query("gpu_status")
def gpu_status(spark, sf):
    from framelake.functions import telemetry as tm
    return tm.gpu_status(tb.telemetry_lines(spark, sf), tb.gpu_decoders(spark, sf))


# --- JSON sources and sinks ------------------------------------------------------------

@query("fourcc_codes")
def fourcc_codes(spark, sf):
    """S4 over event-derived 32-bit codes."""
    from framelake.sources import json_io
    ev = tb.read(spark, sf, "events").select(
        "event_id", F.pmod(F.col("event_id") * 7919 + F.col("user_id"), F.lit(4294967296)).alias("code"))
    return ev.select("event_id", "code", json_io.decode_fourcc(F.col("code")).alias("codec"))


@query("probe_metadata")
def probe_metadata(spark, sf):
    """S5 + S6 over probe JSON built from events."""
    from framelake.sources import json_io
    p = tb.probe_json(spark, sf).select("event_id", F.from_json("probe", json_io.PROBE_SCHEMA).alias("_pj"))
    p = p.select("event_id", json_io.parse_probe(F.col("_pj"), parsed=True).alias("p"),
                 json_io.parse_probe_lenient(F.col("_pj"), parsed=True).alias("l"))
    return p.select("event_id", F.col("p.frames").alias("frames"), r6(F.col("p.fps")).alias("fps"),
                    r6(F.col("p.duration")).alias("duration"), r6(F.col("l.fps")).alias("lenient_fps"),
                    r6(F.col("l.duration")).alias("lenient_duration"))


def _result_json(a, part_frames):
    """(video_id, json): Python-style result text of every video. Two levels: the frames' JSON of ``part_frames``
    consecutive frames first (so a hot video's rows spread over tasks), then the parts in part order."""
    from framelake.sources import json_io
    ok = F.coalesce(F.col("success"), F.lit(False))
    frames = F.sort_array(F.collect_list(F.struct("frame_idx", ok.alias("success"),
                                                  F.coalesce(F.col("description"), F.lit("")).alias("description"))))
    details = F.to_json(F.transform(frames, lambda f: F.struct(f["success"].alias("success"),
                                                               f["description"].alias("description"))))
    parts = a.withColumn("part", F.expr(f"frame_idx div {part_frames}")).groupBy("video_id", "part").agg(
        F.bool_or(ok).alias("success"), F.count_if(ok).alias("ok"), F.count(F.lit(1)).alias("n"),
        F.sum("processing_time").alias("t"), F.min("frame_idx").alias("first_frame"),
        F.min_by("model_used", "frame_idx").alias("model_used"), details.alias("_d"))
    parts = parts.withColumn("_d", F.expr("substring(_d, 2, length(_d) - 2)"))
    g = parts.groupBy("video_id").agg(
        F.bool_or("success").alias("success"), F.sum("ok").alias("frames_analyzed"),
        F.sum("n").alias("total_frames_extracted"), F.round(F.sum("t"), 2).alias("total_processing_time"),
        F.min_by("model_used", "first_frame").alias("model_used"),
        F.expr("listagg(_d, ',') WITHIN GROUP (ORDER BY part)").alias("_d"))
    head = json_io.py_json(
        success=F.col("success"),
        video_path=F.concat(F.lit("video_"), F.col("video_id").cast("string")),
        frames_analyzed=F.col("frames_analyzed"), total_frames_extracted=F.col("total_frames_extracted"),
        total_processing_time=F.col("total_processing_time"),
        video_summary=F.concat(F.lit("video "), F.col("video_id").cast("string")))
    tail = json_io.py_json(model_used=F.col("model_used"))
    js = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "frame_details": ['), F.col("_d"), F.lit("], "),
                  F.substring(tail, F.lit(2), F.length(tail) - 1))
    return g.select("video_id", js.alias("json"))


def _result_docs(spark, sf):
    """One result object per video as Python-style JSON text; every 7th video's is cut
    to 20 characters (malformed)."""
    from framelake.operators import rollups
    js = _result_json(tb.analyses(spark, sf), rollups.OBSERVATION_PART_FRAMES)
    bad = F.pmod(F.col("video_id"), F.lit(7)) == 0
    return js.select("video_id", F.when(bad, F.substring("json", 1, 20)).otherwise(F.col("json")).alias("json"))


@query("result_json_roundtrip")
def result_json_roundtrip(spark, sf):
    """S10 + S11 over result JSON text (some malformed)."""
    from framelake.sources import json_io
    d = _result_docs(spark, sf).select("video_id", json_io.read_results_json(F.col("json")).alias("r"),
                                       json_io.read_results_json_strict(F.col("json")).alias("s"))
    return d.select("video_id", "r.success", "r.video_path", "r.frames_analyzed",
                    "r.total_frames_extracted", r6(F.col("r.total_processing_time")).alias("total_processing_time"),
                    "r.video_summary", "r.model_used", "r.error", "r.frame_descriptions",
                    F.col("s.success").alias("strict_success"), F.col("s.error").alias("strict_error"))


@query("loose_json_keys")
def loose_json_keys(spark, sf):
    """The loose key scanner over the same result texts."""
    from framelake.sources import json_io
    d = json_io.scan_result_json(_result_docs(spark, sf), "json").select("video_id", "r")
    return d.select("video_id", "r.success", "r.video_path", "r.frames_analyzed",
                    "r.total_frames_extracted", r6(F.col("r.total_processing_time")).alias("total_processing_time"),
                    "r.video_summary", "r.model_used", "r.error")


@query("batch_report")
def batch_report(spark, sf):
    """S20 over per-video results (A1) in video order."""
    from framelake.operators import rollups
    from framelake.sources import json_io
    from framelake.plans.joins import materialize
    # one row per video, read several times below: computed once
    v = materialize(rollups.video_rollup(tb.analyses(spark, sf)), "rollup")
    res = v.select(F.col("video_id").alias("seq"),
                   F.concat(F.lit("video_"), F.col("video_id").cast("string")).alias("video_path"),
                   "success", "frames_analyzed", "total_frames_extracted", "total_processing_time",
                   F.lit("cpu").alias("acceleration_method"), F.col("summary").alias("video_summary"),
                   F.lit("No frames could be extracted from video").alias("error"))
    return json_io.batch_report(res)


# --- requests and responses ----------------------------------------------------------

@query("inference_requests")
def inference_requests(spark, sf):
    """S15 + S16 for the uniform sample of every video."""
    from framelake.functions import prompts as pr
    from framelake.sources import requests as rq
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N)
    s = tb.with_pixels(s, spark, sf)
    return s.select("video_id", "sample_pos", rq.frame_request(
        F.lit(rq.CPU_MODEL), F.lit(pr.FRAME_PROMPT), F.array(rq.pixels_base64(F.col("pixels")))).alias("request"))


@query("summary_requests")
def summary_requests(spark, sf):
    """T17 + S17: summary prompt over the joined observations (A2), one per video, CPU and GPU forms."""
    from framelake.functions import prompts as pr
    from framelake.operators import rollups
    from framelake.sources import requests as rq
    parts = rollups.join_observations(tb.analyses(spark, sf))
    return parts.select("video_id",
                        rq.summary_request(F.lit(rq.CPU_MODEL), pr.summary_prompt(F.col("text"))).alias("cpu_request"),
                        rq.summary_request(F.lit(rq.GPU_MODEL), pr.summary_prompt(F.col("text"), gpu=True), gpu=True)
                        .alias("gpu_request"))


@query("parse_responses")
def parse_responses(spark, sf):
    """S18 over response rows built from events (errors answer 500-503)."""
    from framelake.sources import requests as rq
    ev = tb.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    status = F.when(F.col("event_type") == "error", F.lit(500) + F.pmod(k.cast("int"), F.lit(4))).otherwise(F.lit(200))
    body = F.when(F.col("event_type") == "view", F.concat(F.lit('{"response": "  seen '), k, F.lit('\\n"}'))) \
        .otherwise(F.concat(F.lit('{"response": " '), F.col("event_type"), F.lit(" "), k,
                            F.lit('", "model": "m'), k, F.lit('", "done": true, "total_duration": '),
                            (k.cast("long") * 1000).cast("string"), F.lit(', "eval_count": '), k, F.lit("}")))
    r = ev.select(F.col("event_id").alias("request_id"), rq.parse_response(status, body).alias("r"))
    return r.select("request_id", "r.*")


@query("missing_inputs")
def missing_inputs(spark, sf):
    """Requested per-user videos vs the ones that exist (users with a purchase)."""
    from framelake.sources import requests as rq
    ev = tb.read(spark, sf, "events")
    path = F.concat(F.lit("video_"), F.col("user_id").cast("string"), F.lit(".mp4")).alias("path")
    requested = ev.select(path).distinct()
    existing = ev.filter(F.col("event_type") == "purchase").select(path)
    return rq.split_missing_inputs(requested, existing)


@query("first_available")
def first_available(spark, sf):
    """Per user, the first of 3 model candidates that exists."""
    from framelake.sources import requests as rq
    ev = tb.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    users = ev.select("user_id").distinct()
    cand = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("priority")).select(
        "user_id", "priority", F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string"), F.lit("_"),
                                        F.col("priority").cast("string"), F.lit(".onnx")).alias("path"))
    avail = ev.filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("model_"), (F.col("user_id") % 10).cast("string"), F.lit("_"),
                 (k % 3).cast("string"), F.lit(".onnx")).alias("path")).distinct()
    return rq.first_available(cand, avail, "user_id")


# The tokenizer configuration's keys and defaults.
CONFIG_DEFAULTS = {"bos_token_id": 151643, "eos_token_id": 151645, "image_token_id": 151655, "video_token_id": 151656,
                   "vision_start_token_id": 151652, "vision_end_token_id": 151653, "vision_token_id": 151654,
                   "vocab_size": 151936}


@query("config_overlay")
def config_overlay(spark, sf):
    """Per-event tokenizer config JSON overlaid on the defaults."""
    from framelake.sources import requests as rq
    ev = tb.read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    et = F.col("event_type")
    js = (F.when(et == "click", F.concat(F.lit('{"bos_token_id": '), k, F.lit("}")))
          .when(et == "view", F.concat(F.lit('{"eos_token_id": '), k, F.lit(', "vocab_size": 1000}')))
          .when(et == "purchase", F.concat(F.lit('{"bos_token_id": '), k, F.lit(', "eos_token_id": "x", "vocab_size": 5}')))
          .when(et == "signup", F.concat(F.lit('{"vocab_size": '), k, F.lit(', "image_token_id": '), k, F.lit(
              ', "vision_end_token_id": 7, "vision_token_id": 8}')))
          .otherwise(F.lit("not json")))
    return rq.overlay_configs(ev.select("event_id", js.alias("js")), F.col("js"), CONFIG_DEFAULTS).select("event_id", "config.*")


@query("vocab_json")
def vocab_json(spark, sf):
    """A tokenizer JSON per benchmark item (words -> first position), parsed
    back; every 4th item has no model section and yields nothing."""
    from framelake.functions import tokens as tk
    b = tb.read(spark, sf, "benchmark")
    w = b.select("item_id", F.posexplode(tk.words(F.col("text"))).alias("pos", "word"))
    firsts = w.groupBy("item_id", "word").agg(F.min("pos").cast("long").alias("pos"))
    per = firsts.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "pos"))).alias("m"))
    js = F.when(F.col("item_id") % 4 == 0, F.to_json(F.struct(F.col("m").alias("vocab")))) \
        .otherwise(F.to_json(F.struct(F.struct(F.col("m").alias("vocab")).alias("model"))))
    parsed = per.select("item_id", tk.vocab_from_json(js).alias("v"))
    return parsed.select("item_id", F.explode("v").alias("token", "id"))


# --- inference (deterministic stub models) ---------------------------------------------

@query("describe_frames_stub")
def describe_frames_stub(spark, sf):
    """I1 + I6 + I7 over the uniform sample of every video."""
    from framelake.functions import prompts as pr
    from framelake.operators import inference as inf
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N)
    s = tb.with_pixels(s, spark, sf)
    s = s.withColumn("ts", F.col("frame_idx") / F.lit(tb.FRAME_FPS))
    return inf.describe_frames(s, timeout_s=300.0, sleep=False, prompt=pr.FRAME_PROMPT)


class LevelCounter:
    """A frame model that does what its prompt asks: 'over N' counts the pixel levels above N; other prompts are HTTP 400."""

    def describe(self, batch, attempt):
        import numpy as np
        import pandas as pd
        rows = []
        for prompt, pixels in zip(batch["prompt"], batch["pixels"]):
            word, _, number = prompt.partition(" ")
            good = word == "over" and number.isdigit()
            rows.append((200, f" {int((np.asarray(pixels) > int(number)).sum())} of {len(pixels)} ", False) if good else (400, "", False))
        return pd.DataFrame(rows, columns=["status", "response", "transient"])


@query("describe_frames_prompt")
def describe_frames_prompt(spark, sf):
    """F4 + I1: a prompt per frame that the answer depends on; every third sample position asks what the model refuses."""
    from framelake.operators import inference as inf
    s = tb.with_pixels(smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N), spark, sf)
    asks = F.when(F.col("sample_pos") % 3 == 2, F.lit("describe it")).otherwise(
        F.concat(F.lit("over "), (F.col("sample_pos") * 20 + 30).cast("string")))
    d = inf.describe_frames(s, model_spec=LevelCounter, model_name="level-counter", prompt=asks, calls_at_once=2)
    return d.select("video_id", "sample_pos", "frame_idx", "success", "description", "error", "model_used", "attempts")


@query("describe_frame_groups")
def describe_frame_groups(spark, sf):
    """All sampled frames of a video, one prompt, one answer."""
    from framelake.functions import prompts as pr
    from framelake.operators import inference as inf
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), UNIFORM_N)
    s = tb.with_pixels(s, spark, sf)
    return inf.describe_frame_groups(s, pr.FRAME_PROMPT).select(
        "video_id", "n_frames", "description", "confidence", "error")


class FlakyGroupModel:
    """Group stub that fails for video_id % 6 == 0 (exercises I4's error path)."""

    def analyze(self, frames, prompt):
        from framelake.operators.inference import StubGroupModel
        vid = int(frames["video_id"].iloc[0])
        if vid % 6 == 0:
            raise RuntimeError(f"model rejected video {vid}")
        return StubGroupModel().analyze(frames, prompt)


@query("analyze_videos")
def analyze_videos(spark, sf):
    """I4: P8 (strategy 'adaptive' -> uniform, 16 frames) -> model -> result;
    a failing model gives 'Analysis failed: ...' with confidence 0."""
    from framelake.functions import prompts as pr
    from framelake.operators import inference as inf
    s = smp.sample_frames(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), 16, "adaptive")
    s = tb.with_pixels(s, spark, sf)
    return inf.describe_frame_groups(s, pr.DEFAULT_VIDEO_PROMPT, model_spec=FlakyGroupModel).drop("processing_time")


class ColourModel:
    """A group model that measures what it gets: the sums of red, green and blue levels of frames of 6 x 14 RGB pixels."""

    def analyze(self, frames, prompt):
        import numpy as np
        levels = np.stack([np.frombuffer(p, np.uint8).reshape(6, 14, 3) for p in frames["pixels"]]).astype(np.int64)
        r, g, b = levels.sum(axis=(0, 1, 2)).tolist()
        if r == max(r, g, b) and r > g:
            raise RuntimeError(f"too red: {r}")
        return {"description": f"{len(frames)} frames: {r} {g} {b}", "confidence": 1.0, "objects": ["green" if g >= b else "blue"],
                "temporal_events": [str(int(f.sum())) for f in levels]}


@query("analyze_videos_rgb")
def analyze_videos_rgb(spark, sf):
    """I4 with its whole chain: 16 uniform frames, resized and turned to RGB before the model; a failing model is an error row,
    and so is a video without a readable frame (here: video 3 has no images)."""
    from framelake.functions import images as im
    from framelake.functions import prompts as pr
    from framelake.operators import inference as inf
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), 16)
    s = tb.with_pixels(s.drop("height", "width", "channels"), spark, sf, color=True)
    image = im.image_struct(F.col("pixels"), F.lit(tb.COLOR_H), F.lit(tb.COLOR_W), F.lit(3))
    s = s.withColumn("image", F.when(F.col("video_id") != 3, image)).drop("pixels")
    return inf.analyze_videos(s, pr.DEFAULT_VIDEO_PROMPT, ColourModel, 6, 14).drop("processing_time")


@query("summarize_stub")
def summarize_stub(spark, sf):
    """Observations of a video -> stub summariser, HTTP failure text, or the A3 fallback."""
    from framelake.operators import inference as inf
    from framelake.operators import rollups
    a = tb.analyses(spark, sf)
    parts = rollups.join_observations(a)
    fb = rollups.fallback_summary_cpu(rollups.summary_parts(a))
    return inf.summarize_videos(parts, fb)


# --- decoded images ----------------------------------------------------------------------

def _image_frames(spark, sf):
    from framelake.functions import images as im
    f = tb.frames_color(spark, sf)
    return f.select("video_id", "frame_idx",
                    im.image_struct(F.col("pixels"), F.col("height"), F.col("width"), F.col("channels")).alias("image"),
                    "pixels")


@query("image_preprocess")
def image_preprocess(spark, sf):
    """N10 + N12 + N13 (2x11 -> 6x14) + N16 + N19 on image structs of the colour frames."""
    from framelake.functions import images as im
    p = im.preprocess_images(_image_frames(spark, sf), 6, 14)
    return p.select("video_id", "frame_idx", "out_height", "out_width",
                    r6(F.col("rgb_norm_sum")).alias("rgb_norm_sum"), "placed_sum",
                    r6(F.col("edge_density")).alias("edge_density"),
                    "content_ok")


@query("pixel_tensor")
def pixel_tensor(spark, sf):
    """N11 per video over its uniform 16-frame sample."""
    from framelake.functions import images as im
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), 16)
    s = tb.with_pixels(s.drop("height", "width", "channels"), spark, sf, color=True)
    t = im.pixel_tensor(s.withColumn("image", im.image_struct(
        F.col("pixels"), F.lit(tb.COLOR_H), F.lit(tb.COLOR_W), F.lit(3))))
    return t.select("video_id", "n_frames", "shape", "level_sum", "placed_sum", "nonzero")


BLOCK_STEP = 9973  # every so many values of a block are shown


@query("pixel_blocks")
def pixel_blocks(spark, sf):
    """N11 as data: a block per (video, frame, channel) of the uniform 16-frame sample; its size, checksums and some of its values."""
    from framelake.functions import images as im
    s = smp.sample_uniform(tb.frame_index(spark, sf), tb.frame_sizes(spark, sf), 16)
    s = tb.with_pixels(s.drop("height", "width", "channels"), spark, sf, color=True)
    b = im.pixel_blocks(s.withColumn("image", im.image_struct(F.col("pixels"), F.lit(tb.COLOR_H), F.lit(tb.COLOR_W), F.lit(3))))
    places = list(range(0, im.TENSOR_SIDE ** 2, BLOCK_STEP))
    return b.select("video_id", "sample_pos", "channel", F.octet_length("block").alias("n_bytes"), "level_sum", "placed_sum", "nonzero",
                    im.block_values(F.col("block"), places).alias("levels"))


@query("image_histogram")
def image_histogram(spark, sf):
    """A15 + A16 on image structs: non-empty (channel, bin) counts in one pass over the bytes, and the frame's entropy."""
    from framelake.functions import images as im
    f = im.with_level_counts(_image_frames(spark, sf).drop("pixels"))
    f = f.select("video_id", "frame_idx", r6(im.entropy_of_counts(F.col("counts"))).alias("entropy"), F.posexplode("counts").alias("code", "count"))
    return f.filter("count > 0").select("video_id", "frame_idx", F.expr(f"CAST(code div {im.HIST_BINS} AS INT)").alias("channel"),
                                        (F.col("code") % im.HIST_BINS).alias("bin"), "count", "entropy")


@query("frame_gray_fixed")
def frame_gray_fixed(spark, sf):
    """N15 in 8-bit arithmetic: sum, mean and highest of the rounded gray levels of a colour frame."""
    from framelake.functions import images as im
    px = F.col("pixels")
    g = F.transform(F.sequence(F.lit(0), F.lit(tb.COLOR_PIXELS - 1)), lambda j: im.gray_level(*[F.get(px, j * 3 + k) for k in range(3)]))
    f = tb.frames_color(spark, sf).select("video_id", "frame_idx", g.alias("g"))
    total = feat.arr_sum(F.col("g"))
    return f.select("video_id", "frame_idx", total.alias("gray_sum"), r6(total / F.lit(float(tb.COLOR_PIXELS))).alias("gray_mean"),
                    F.array_max("g").cast("long").alias("gray_max"))


# --- streaming ---------------------------------------------------------------------------

STREAM_CHUNK = 3


def _stream_files(spark, sf, name):
    """The gray frame table as files of a stream: (work folder, schema)."""
    from framelake.session import ensure_checkpoint_dir
    from framelake.streaming import chunks as ch
    frames = tb.frames_gray(spark, sf)
    src = frames.join(tb.frame_sizes(spark, sf), "video_id").select(
        F.col("video_id").cast("long"), "frame_idx", F.col("total_frames").cast("long"),
        feat.brightness(F.col("pixels")).alias("brightness"))
    work = ch.new_work_dir(ensure_checkpoint_dir(spark), name)
    src.write.mode("overwrite").parquet(work + "/frames")
    return work, src.schema


@query("stream_chunks")
def stream_chunks(spark, sf):
    """K1-K4: the gray frame table is written as files, read back as a stream,
    chunked by 3 per video with the stateful operator (availableNow) and the
    sink is returned. Same rows as ``frame_chunks`` plus final/result."""
    from framelake.streaming import chunks as ch
    work, schema = _stream_files(spark, sf, "stream_chunks")
    out = ch.run_available_now(spark, work + "/frames", schema, STREAM_CHUNK, work)
    return spark.read.schema(ch.CHUNK_SCHEMA).parquet(out).select(
        "video_id", "chunk", "n_frames", "first_idx", "last_idx", r6(F.col("brightness")).alias("brightness"),
        "final", "result", "late_frames")


def _frame_files(spark, sf, name):
    """The colour frames of ``embeddings`` as BMP files in a fresh shared folder."""
    from framelake.session import ensure_checkpoint_dir
    from framelake.sources import frame_files as ff
    from framelake.streaming import chunks as ch
    root = ch.new_work_dir(ensure_checkpoint_dir(spark), name) + "/frames"
    ff.write_frames(tb.frames_color(spark, sf), root)
    return root


def rgb_sums(video_id, chunk, frames):
    """An analysis of real frames: the sums of their red, green and blue levels."""
    return " ".join(str(sum(int(f[..., c].sum()) for f in frames)) for c in range(3))


@query("stream_image_chunks")
def stream_image_chunks(spark, sf):
    """K1-K4 on image files: read as a stream, decoded, resized to 6 x 14, RGB, chunked by 3 per video, analysed."""
    from framelake.plans.joins import materialize
    from framelake.sources import frame_files as ff
    from framelake.streaming import chunks as ch
    root = _frame_files(spark, sf, "stream_image_chunks")
    # every micro-batch joins the sizes: written once, or each would list all files again
    sizes = materialize(ff.list_frames(spark, root).groupBy("video_id").agg(F.count(F.lit(1)).alias("total_frames")), "sizes")
    chunks = ch.stream_image_chunks(ch.image_stream(spark, root, 6, 14), sizes, STREAM_CHUNK, 6, 14, rgb_sums)
    out = ch.write_available_now(chunks, root.removesuffix("/frames"))
    return spark.read.schema(ch.CHUNK_SCHEMA).parquet(out).select(
        "video_id", "chunk", "n_frames", "first_idx", "last_idx", r6(F.col("brightness")).alias("brightness"), "final", "result", "late_frames")


@query("frame_files_sample")
def frame_files_sample(spark, sf):
    """S1 + S2 + P1 + P7: frames as image files; listed, sampled by name, and only the picked files opened."""
    from framelake.sources import frame_files as ff
    listed = ff.list_frames(spark, _frame_files(spark, sf, "frame_files"))
    picks = smp.sample_uniform(listed, tb.video_sizes(listed), UNIFORM_N)
    f = ff.fetch_frames(picks.select(F.col("video_id").cast("int").alias("video_id"), F.col("sample_pos").cast("long"), "frame_idx", "bytes", "path"))
    levels = F.transform(F.regexp_extract_all(F.hex("data"), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    return f.select("video_id", "sample_pos", "frame_idx", "bytes", "height", "width", "channels", levels.alias("pixels"))


@query("frame_source_filter")
def frame_source_filter(spark, sf):
    """S2 through the Python data source, with filters on video and frame index pushed into its planning."""
    from framelake.sources import frame_files as ff
    f = ff.read_frame_source(spark, _frame_files(spark, sf, "frame_source"), unreadable="fail")
    f = f.filter(F.col("video_id").isin("1", "3", "4", "7") & (F.col("frame_idx") >= 2) & (F.col("frame_idx") < 12) & (F.col("height") > 1))
    return f.select("video_id", "frame_idx", "height", "width", "channels", F.sha2("data", 256).alias("data_sha256"))


@query("missing_frame_files")
def missing_frame_files(spark, sf):
    """S19 + J5 + P13 against a file listing: which requested frames have a file, and the best one of each video that has
    (the highest index asked for). Two frames more than there are are requested of every video."""
    from framelake.sources import frame_files as ff, requests as rq
    root = _frame_files(spark, sf, "missing_frames")
    asked = tb.frame_sizes(spark, sf).select("video_id", F.explode(F.sequence(
        F.greatest(F.col("total_frames") - 3, F.lit(0)).cast("long"), F.col("total_frames").cast("long") + 1)).alias("frame_idx"))
    found = ff.existing(asked, spark, root)
    name = F.concat(F.col("video_id").cast("string"), F.lit("/frame_"), F.col("frame_idx").cast("string")).alias("path")
    best = rq.first_available(found.select("video_id", name, (-F.col("frame_idx")).alias("priority")), found.filter("found").select(name), "video_id")
    return found.join(best, "video_id").select("video_id", "frame_idx", "found", F.col("chosen").alias("best"))


@query("stream_callback")
def stream_callback(spark, sf):
    """The chunks of every micro-batch go to a callback, which writes them; per video the chunks and frames."""
    from framelake.streaming import chunks as ch
    work, schema = _stream_files(spark, sf, "stream_callback")
    # a repeated batch overwrites its own folder
    ch.run_available_now(spark, work + "/frames", schema, STREAM_CHUNK, work,
                         callback=lambda df, k: df.write.mode("overwrite").parquet(f"{work}/called/batch={k}"))
    got = spark.read.schema(ch.CHUNK_SCHEMA).parquet(work + "/called/batch=*")
    return got.groupBy("video_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_frames").alias("n_frames"),
                                       F.count_if("final").alias("partial_chunks"))


@query("stream_frames_seen")
def stream_frames_seen(spark, sf):
    """K5: frames seen per video, as the last update of the running count."""
    from framelake.streaming import chunks as ch
    work, schema = _stream_files(spark, sf, "stream_frames_seen")
    counts = ch.frames_seen(spark.readStream.schema(schema).parquet(work + "/frames"))
    run = (counts.writeStream.outputMode("update").option("checkpointLocation", work + "/checkpoint")
           .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{work}/seen/batch={k}"))
           .trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema("video_id long, frames_seen long").parquet(work + "/seen/batch=*").groupBy("video_id").agg(
        F.max("frames_seen").alias("frames_seen"))


# --- sinks and plug-ins ------------------------------------------------------------------

@query("video_info_json")
def video_info_json(spark, sf):
    """The --info object per video."""
    from framelake.sources import json_io
    cat = json_io.video_catalog(tb.frames_gray(spark, sf), fps=tb.FRAME_FPS, codec_code=1196444237)
    return cat.select("video_id", json_io.info_json(cat).alias("info_json"))


@query("result_json_write")
def result_json_write(spark, sf):
    """One result object per conversation (placeholder analysis, I5) with
    video_path, processing_time_ms and total_time_ms."""
    from framelake.functions import prompts as pr
    from framelake.sources import json_io
    c = tb.read(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"),
                                 F.min_by(F.when(F.col("role") == "user", F.col("text")),
                                          F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"))
    a = g.select("conv_id", "n", pr.placeholder_analysis(pr.default_prompt(F.col("prompt")), F.col("n")).alias("r"))
    rows = a.select("conv_id", F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".mp4")).alias("video_path"),
                    "r.*", (F.col("n") * 100).alias("processing_time_ms"), (F.col("n") * 100 + 5).alias("total_time_ms"))
    return rows.select("conv_id", json_io.result_json(rows).alias("json"))


@query("batch_json")
def batch_json(spark, sf):
    """S8 (+A10): last result per path as {"<path>": {...}} lines, key-sorted."""
    from framelake.operators import rollups
    from framelake.sources import json_io
    d = rollups.dedupe_results(tb.results(spark, sf))
    none = F.array().cast("array<string>")
    return json_io.batch_json(d.select(
        "path", F.col("model_used").alias("description"), F.array("model_used").alias("objects"), none.alias("actions"),
        F.lit("scene").alias("scene_context"), none.alias("temporal_events"), F.round("confidence", 6).alias("confidence_score"),
        (F.col("processing_time") * 1000).cast("long").alias("processing_time_ms")))


@query("batch_document")
def batch_document(spark, sf):
    """S8 + O2: the batch's one JSON object, keyed and sorted by path: its lines, numbered in their order."""
    from framelake.operators import rollups
    from framelake.plans import ordered
    from framelake.sources import json_io
    d = rollups.dedupe_results(tb.results(spark, sf))
    none = F.array().cast("array<string>")
    lines = json_io.batch_document(d.select(
        "path", F.col("model_used").alias("description"), F.array("model_used").alias("objects"), none.alias("actions"),
        F.lit("scene").alias("scene_context"), none.alias("temporal_events"), F.round("confidence", 6).alias("confidence_score"),
        (F.col("processing_time") * 1000).cast("long").alias("processing_time_ms")))
    return ordered.global_positions(lines, ["place", "path"], out="line_no").select("line_no", "text")


@query("keyframe_frames")
def keyframe_frames(spark, sf):
    """P8 ('keyframe') -> P7/J1 ordered fetch of the picked colour frames."""
    frames = tb.frames_color(spark, sf)
    picked = smp.sample_frames(frames, tb.frame_sizes(spark, sf), KEYFRAME_N, "keyframe", pixels=tb.COLOR_PIXELS)
    return picked.select("video_id", "sample_pos", "frame_idx",
                         r6(feat.brightness(F.col("pixels"), 3)).alias("brightness"))


@query("frame_processor_plugin")
def frame_processor_plugin(spark, sf):
    """the frame-processor plug-in (normalise to [0, 1]) through an Arrow UDF."""
    from framelake.operators import inference as inf
    f = inf.process_frames(tb.frames_gray(spark, sf))
    return f.select("video_id", "frame_idx", F.size("processed").alias("n_values"),
                    r6(F.aggregate("processed", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("norm_sum"))


@query("round_robin")
def round_robin(spark, sf):
    """Uniform-sampled frames dealt to 3 devices in (video, sample) order."""
    from framelake.operators import batches
    from framelake.plans import ordered
    frames = tb.frames_gray(spark, sf)
    s = smp.sample_uniform(frames, tb.frame_sizes(spark, sf), UNIFORM_N).select(
        "video_id", "sample_pos", (F.col("video_id").cast("long") * UNIFORM_N + F.col("sample_pos")).alias("_o"))
    s = ordered.with_segments(s, ordered.span_segments("_o"))
    s = ordered.dense_positions(s, [], ["_o"], out="pos").drop(ordered.SEG, "_o")
    return batches.assign_round_robin(s, 3)


@query("ledger_admission")
def ledger_admission(spark, sf):
    """Would each allocation fit under a 4 MiB limit given the total before it?"""
    from framelake.operators import ledger
    run = ledger.ledger_running(tb.ledger(spark, sf))
    before = F.col("total") - F.when(F.col("op") == "alloc", F.col("bytes")).otherwise(F.lit(0))
    return run.filter(F.col("op") == "alloc").select(
        "seq", "bytes", before.alias("current"), ((before + F.col("bytes")) <= F.lit(4 * 1024 * 1024)).alias("admit"))


@query("multimodal_positions")
def multimodal_positions(spark, sf):
    """N4/N5 over the model inputs of every conversation message."""
    from framelake.functions import prompts as pr
    from framelake.functions import tokens as tk
    c = _conv_counts(tb.read(spark, sf, "conversations").select("conv_id", "turn", "text"))
    ids = F.concat(pr.vision_tokens(F.col("n_img"), F.col("n_vid")), tk.tokenize_fallback(F.col("text")))
    m = c.select("conv_id", "turn", tk.truncate_tokens(ids, tk.QWEN_MAX_TOKENS).alias("_ids"))
    m = m.select("conv_id", "turn", pr.model_input(F.col("_ids")).alias("m"))
    n = F.col("m.sequence_length")
    mm = m.select("conv_id", "turn", n.alias("n"),
                  pr.multimodal_positions(n, F.col("m.image_positions"), F.col("m.video_positions")).alias("p"))
    return mm.select("conv_id", "turn", F.col("p.temporal").alias("temporal"), F.col("p.height").alias("height"),
                     F.col("p.width").alias("width"), F.col("p.mrope_deltas").alias("mrope_deltas"),
                     pr.position_tensor_3d(F.col("n")).alias("position_3d"))


@query("image_resize")
def image_resize(spark, sf):
    """N10 + N12 + N13 (2x11 -> 6x14 bilinear, BGR -> RGB, / 255) and N19 on image structs."""
    from framelake.functions import images as im
    p = im.preprocess_images(_image_frames(spark, sf), 6, 14)
    return p.select("video_id", "frame_idx", "out_height", "out_width",
                    r6(F.col("rgb_norm_sum")).alias("rgb_norm_sum"), "content_ok")
