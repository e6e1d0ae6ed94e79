"""Prompt texts, chat templates, vision markers and model-input arrays.

All row-local work is built-in string/array functions. The chat template is
the one multi-row operator: per-turn pieces are rendered in place, media
counters across a conversation are a segmented running sum, and the pieces
are joined per conversation in bounded parts of consecutive turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import tokens as tk
from framelake.plans import ordered

# Chat-template markers and prompt texts of the reference.
SYSTEM_START = "<|im_start|>system\n"
SYSTEM_END = "<|im_end|>\n"
USER_START = "<|im_start|>user\n"
USER_END = "<|im_end|>\n"
ASSISTANT_START = "<|im_start|>assistant\n"
ASSISTANT_END = "<|im_end|>\n"
VISION_START = "<|vision_start|>"
VISION_END = "<|vision_end|>"
IMAGE_PAD = "<|image_pad|>"
VIDEO_PAD = "<|video_pad|>"
DEFAULT_SYSTEM = "You are a helpful assistant."
DEFAULT_VIDEO_PROMPT = (
    "\n            Analyze this video sequence and provide:\n"
    "            1. A detailed description of what's happening\n"
    "            2. Key objects and people identified  \n"
    "            3. Actions and activities taking place\n"
    "            4. Scene context and environment\n"
    "            5. Any notable events or changes over time\n"
    "            \n"
    "            Be specific and comprehensive in your analysis.\n        ")
VIDEO_CHAT_SYSTEM = ("<|im_start|>system\nYou are a helpful assistant that describes video content in detail."
                     "<|im_end|>\n<|im_start|>user\n")
VIDEO_CHAT_FRAME = "<|vision_start|><|image_pad|><|vision_end|>"
VIDEO_CHAT_BODY = ("\n\nPlease describe what you see in this video in detail. Focus on:\n"
                   "- Objects and people present\n"
                   "- Actions and activities\n"
                   "- Scene setting and environment\n"
                   "- Any interesting details\n\n"
                   "Video description:<|im_end|>\n<|im_start|>assistant\n")
LLAMA_HEAD = ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
              "You are a helpful AI assistant that can analyze videos and describe their content in detail."
              "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n")
LLAMA_IMAGE = "<|image|>"
LLAMA_TAIL = "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
DESCRIBE_PREFIX = "Describe this image in detail. "
ANALYSIS_PREFIX = "Analyze the content of this image/video and "
EXTRACT_PREFIX, EXTRACT_SUFFIX = "Extract ", " from this image/video."
MULTIPART_PREFIX = "Describe this video: "
FRAME_PROMPT = "Describe what you see in this image concisely."
SUMMARY_PROMPT_CPU = "Create a brief video summary from these observations:\n\n{obs}\n\nSummary (1-2 sentences):"
SUMMARY_PROMPT_GPU = ("Create a brief video summary from these GPU-analyzed observations:\n\n{obs}\n\n"
                      "Summary (1-2 sentences):")
PLACEHOLDER_HEAD = "Placeholder analysis of "
PLACEHOLDER_DETAILED = "Detailed scene analysis with multiple objects and activities detected. "
PLACEHOLDER_BASIC = "Basic scene analysis with recognizable elements. "
SCENE_EXTENDED = "Extended sequence - comprehensive scene analysis"
SCENE_MEDIUM = "Medium sequence - moderate scene coverage"
SCENE_SHORT = "Short sequence - focused scene analysis"
PLACEHOLDER_OBJECTS = ["person", "object", "background", "furniture"]
PLACEHOLDER_ACTIONS = ["walking", "sitting", "interacting", "moving"]
PLACEHOLDER_EVENTS = ["scene_change", "object_appearance", "action_sequence"]
PLACEHOLDER_CONFIDENCE = 0.75
EMBED_HIDDEN = 1536

TEMPLATE_PART_TURNS = 4096


def _fmt(template: str, obs: Column) -> Column:
    head, tail = template.split("{obs}")
    return F.concat(F.lit(head), obs, F.lit(tail))


def summary_prompt(observations: Column, gpu: bool = False) -> Column:
    """Text-only summary prompt around the joined observations."""
    return _fmt(SUMMARY_PROMPT_GPU if gpu else SUMMARY_PROMPT_CPU, observations)


def default_prompt(prompt: Column) -> Column:
    """Empty prompt -> the default video prompt."""
    return F.when(F.coalesce(prompt, F.lit("")) == "", F.lit(DEFAULT_VIDEO_PROMPT)).otherwise(prompt)


def describe_prompt(q: Column) -> Column:
    return F.concat(F.lit(DESCRIBE_PREFIX), q)


def analysis_prompt(task: Column) -> Column:
    return F.concat(F.lit(ANALYSIS_PREFIX), task)


def extraction_prompt(target: Column) -> Column:
    return F.concat(F.lit(EXTRACT_PREFIX), target, F.lit(EXTRACT_SUFFIX))


def multipart_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(MULTIPART_PREFIX), prompt)


def vision_prompt(text: Column, n_images: Column, n_videos: Column) -> Column:
    """N image markers, m video markers, then the text."""
    return F.concat(F.repeat(F.lit(VISION_START + IMAGE_PAD + VISION_END), F.greatest(n_images, F.lit(0))),
                    F.repeat(F.lit(VISION_START + VIDEO_PAD + VISION_END), F.greatest(n_videos, F.lit(0))), text)


def video_chat_prompt(n_frames: Column) -> Column:
    """Fixed system text + one marker per frame + fixed instructions."""
    return F.concat(F.lit(VIDEO_CHAT_SYSTEM), F.repeat(F.lit(VIDEO_CHAT_FRAME), F.greatest(n_frames, F.lit(0))),
                    F.lit(VIDEO_CHAT_BODY))


def llama_vision_prompt(prompt: Column, n_frames: Column) -> Column:
    """Header tokens + n image tokens + prompt."""
    return F.concat(F.lit(LLAMA_HEAD), F.repeat(F.lit(LLAMA_IMAGE), F.greatest(n_frames, F.lit(0))),
                    F.lit("\n"), prompt, F.lit(LLAMA_TAIL))


def placeholder_description(prompt: Column, n_frames: Column) -> Column:
    """Case-sensitive 'detailed' picks the long sentence."""
    return F.concat(F.lit(PLACEHOLDER_HEAD), n_frames.cast("string"), F.lit(" frames: "),
                    F.when(F.contains(prompt, F.lit("detailed")), F.lit(PLACEHOLDER_DETAILED))
                    .otherwise(F.lit(PLACEHOLDER_BASIC)))


def scene_context(n_frames: Column) -> Column:
    """>12 extended, >8 medium, else short."""
    return (F.when(n_frames > 12, F.lit(SCENE_EXTENDED)).when(n_frames > 8, F.lit(SCENE_MEDIUM))
            .otherwise(F.lit(SCENE_SHORT)))


def placeholder_analysis(prompt: Column, n_frames: Column) -> Column:
    """The fixed analysis result of the model-less path."""
    return F.struct(
        placeholder_description(prompt, n_frames).alias("description"),
        F.array(*[F.lit(x) for x in PLACEHOLDER_OBJECTS]).alias("objects"),
        F.array(*[F.lit(x) for x in PLACEHOLDER_ACTIONS]).alias("actions"),
        scene_context(n_frames).alias("scene_context"),
        F.array(*[F.lit(x) for x in PLACEHOLDER_EVENTS]).alias("temporal_events"),
        F.lit(PLACEHOLDER_CONFIDENCE).alias("confidence_score"))


def vision_tokens(n_images: Column, n_videos: Column) -> Column:
    """N x (start, image, end) then m x (start, video, end)."""
    img = F.array(*[F.lit(x).cast("long") for x in (tk.VISION_START_ID, tk.IMAGE_ID, tk.VISION_END_ID)])
    vid = F.array(*[F.lit(x).cast("long") for x in (tk.VISION_START_ID, tk.VIDEO_ID, tk.VISION_END_ID)])
    return F.concat(F.flatten(F.array_repeat(img, F.greatest(n_images, F.lit(0)).cast("int"))),
                    F.flatten(F.array_repeat(vid, F.greatest(n_videos, F.lit(0)).cast("int"))))


def positions(n: Column) -> Column:
    """0..n-1, empty for n <= 0 (``sequence`` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).otherwise(
        F.array().cast("array<bigint>"))


def index_of(ids: Column, value: int) -> Column:
    """Positions (0-based) where ``ids`` equals ``value``."""
    return F.filter(F.transform(ids, lambda x, i: F.when(x == value, i.cast("long"))), lambda x: x.isNotNull())


def model_input(ids: Column, max_length: int = tk.QWEN_MAX_TOKENS) -> Column:
    """Truncate, mask of ones, positions, image and video token positions."""
    t = tk.truncate_tokens(ids, max_length)
    n = F.size(t)
    return F.struct(
        t.alias("input_ids"), F.array_repeat(F.lit(1).cast("long"), n.cast("int")).alias("attention_mask"),
        positions(n).alias("position_ids"), index_of(t, tk.IMAGE_ID).alias("image_positions"),
        index_of(t, tk.VIDEO_ID).alias("video_positions"), n.cast("long").alias("sequence_length"))


def mask_float(mask: Column) -> Column:
    """Integer mask -> float."""
    return F.transform(mask, lambda x: x.cast("float"))


def batched_positions(n: Column, batch: int) -> Column:
    """0..n-1 repeated ``batch`` times."""
    return F.flatten(F.array_repeat(positions(n), F.lit(batch)))


def multimodal_positions(n: Column, image_pos: Column, video_pos: Column) -> Column:
    """Three copies of 0..n-1 and one delta (= number of vision tokens)."""
    p = positions(n)
    delta = (n - 1) + 1 - n + F.size(image_pos) + F.size(video_pos)
    return F.struct(p.alias("temporal"), p.alias("height"), p.alias("width"),
                    F.array(delta.cast("long")).alias("mrope_deltas"))


def position_tensor_3d(n: Column) -> Column:
    """3 x n row-major positions."""
    return F.flatten(F.array_repeat(positions(n), F.lit(3)))


# --- chat template ----------------------------------------------------------------

def content_markup(kind: Column, text: Column, image_no: Column, video_no: Column, vision_ids: bool) -> Column:
    """Rendering of one user content part (text, image or video)."""
    img = F.concat(F.lit(VISION_START + IMAGE_PAD + VISION_END))
    vid = F.concat(F.lit(VISION_START + VIDEO_PAD + VISION_END))
    if vision_ids:
        img = F.concat(F.lit("Picture "), image_no.cast("string"), F.lit(": "), img)
        vid = F.concat(F.lit("Video "), video_no.cast("string"), F.lit(": "), vid)
    return (F.when(kind == "text", F.coalesce(text, F.lit(""))).when(kind == "image", img)
            .when(kind == "video", vid).otherwise(F.lit("")))


def chat_template(parts: DataFrame, add_generation_prompt: bool = True, add_vision_id: bool = True,
                  part_turns: int = TEMPLATE_PART_TURNS) -> DataFrame:
    """T12 + W4 + T13.

    Input: one row per content part: conv_id, turn, role, ppos (part position
    within the turn), kind ('text' | 'image' | 'video'), text. Non-user turns
    use only their text. A default system turn is added when the conversation
    has none; roles other than system/user/assistant are dropped (a conversation
    of such turns keeps the default system turn and the open assistant turn); image/video
    numbers count the user's media across the whole conversation (segmented running sums).
    Output: conv_id, text -- one template per conversation, put together in two levels
    (runs of ``part_turns`` turns, then the runs).
    """
    mine = F.col("role") == "user"
    p = parts.withColumn("_img", F.coalesce((mine & (F.col("kind") == "image")).cast("long"), F.lit(0))) \
             .withColumn("_vid", F.coalesce((mine & (F.col("kind") == "video")).cast("long"), F.lit(0)))
    p = ordered.with_segments(p, ordered.span_segments("turn"))
    p = ordered.running_sums(p, ["conv_id"], ["turn", "ppos"], {"_img": "image_no", "_vid": "video_no"}).drop(ordered.SEG)
    user_piece = content_markup(F.col("kind"), F.col("text"), F.col("image_no"), F.col("video_no"), add_vision_id)
    piece = F.when(F.col("role") == "user", user_piece).otherwise(F.coalesce(F.col("text"), F.lit("")))
    per_turn = (p.withColumn("_piece", piece).groupBy("conv_id", "turn", "role")
                .agg(F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY ppos)").alias("_body")))
    wrapped = (F.when(F.col("role") == "system", F.concat(F.lit(SYSTEM_START), "_body", F.lit(SYSTEM_END)))
               .when(F.col("role") == "user", F.concat(F.lit(USER_START), "_body", F.lit(USER_END)))
               .when(F.col("role") == "assistant", F.concat(F.lit(ASSISTANT_START), "_body", F.lit(ASSISTANT_END)))
               .otherwise(F.lit("")))
    runs = (per_turn.withColumn("_w", wrapped).withColumn("_run", F.expr(f"turn div {part_turns}"))
            .groupBy("conv_id", "_run").agg(F.expr("listagg(_w, '') WITHIN GROUP (ORDER BY turn)").alias("_t"),
                                            F.bool_or(F.col("role") == "system").alias("_sys")))
    conv = runs.groupBy("conv_id").agg(F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY _run)").alias("_t"),
                                       F.coalesce(F.bool_or("_sys"), F.lit(False)).alias("_sys"))
    head = F.when(F.col("_sys"), F.lit("")).otherwise(F.lit(SYSTEM_START + DEFAULT_SYSTEM + SYSTEM_END))
    tail = F.lit(ASSISTANT_START if add_generation_prompt else "")
    return conv.select("conv_id", F.concat(head, "_t", tail).alias("text"))


def chat_message(role: Column, content: Column) -> Column:
    """Wrap by role; unknown role -> content unchanged."""
    return (F.when(role == "system", F.concat(F.lit(SYSTEM_START), content, F.lit(SYSTEM_END)))
            .when(role == "user", F.concat(F.lit(USER_START), content, F.lit(USER_END)))
            .when(role == "assistant", F.concat(F.lit(ASSISTANT_START), content, F.lit(ASSISTANT_END)))
            .otherwise(content))
