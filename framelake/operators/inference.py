"""Batch model inference as a map stage.

A model is a plug-in object loaded once per Python worker (``load_model``
caches it by spec) and called on Arrow batches inside ``mapInPandas`` (one
row per frame) or ``applyInPandas`` (several frames, one answer). Groups
handed to a model are bounded: the caller samples/caps frames per video first.
A failing frame becomes an error row; it never fails the task or the video.

The deterministic stub models below stand in for a vision model in tests and
registered queries: their answers depend only on the frame pixels, so a SQL
oracle can recompute them.
"""

from __future__ import annotations

import hashlib
import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Retry policy and texts of the reference pipeline.
MAX_ATTEMPTS = 3
WAIT_MIN_S, WAIT_MAX_S = 4.0, 10.0
DEFAULT_TIMEOUT_S = 300.0
ANALYSIS_FAILED = "Analysis failed: "
SUMMARY_FAILED = "Failed to generate video summary."
NO_FRAMES_EXTRACTED = "No frames extracted from video"


class FrameModel(Protocol):
    """one answer per frame. ``describe`` gets a few frames (one, unless ``frames_per_call`` says otherwise) with
    ``pixels``, ``prompt`` and the frames' keys and returns columns status (int), response (str), transient (bool) and,
    if the model's server reports it, latency (seconds); otherwise the call is timed. It runs on a thread
    of the Python worker: with ``calls_at_once`` above 1, or after a timeout, there are several threads, each with a model of its own."""

    def describe(self, batch: pd.DataFrame, attempt: int) -> pd.DataFrame: ...


class GroupModel(Protocol):
    """several frames, one prompt -> one answer (I2/I4): description and confidence, and
    optionally objects, actions, temporal_events (lists) and scene_context."""

    def analyze(self, frames: pd.DataFrame, prompt: str) -> dict: ...


class StubFrameModel:
    """Deterministic frame model. level = sum of pixel values, n = pixel count.

    status 500 when level % 17 == 0; a transient failure (retried) on attempt a
    when (level + a) % 11 == 0; simulated latency = level % 400 seconds.
    """

    def describe(self, batch: pd.DataFrame, attempt: int) -> pd.DataFrame:
        level = np.array([int(np.sum(p)) for p in batch["pixels"]], dtype=np.int64)
        n = np.array([len(p) for p in batch["pixels"]], dtype=np.int64)
        status = np.where(level % 17 == 0, 500, 200)
        transient = (level + attempt) % 11 == 0
        resp = [f"Frame {int(i) + 1}: mean level {int(lv // max(k, 1))} over {int(k)} pixels"
                for i, lv, k in zip(batch["sample_pos"], level, n)]
        return pd.DataFrame({"status": status, "response": resp, "latency": (level % 400).astype(float),
                             "transient": transient})


class StubGroupModel:
    """Deterministic multi-frame model: answer from the pixel totals of the group."""

    def analyze(self, frames: pd.DataFrame, prompt: str) -> dict:
        total = int(sum(int(np.sum(p)) for p in frames["pixels"]))
        n_px = int(sum(len(p) for p in frames["pixels"]))
        return {"description": f"{len(frames)} frames, mean level {total // max(n_px, 1)}",
                "confidence": round(min(1.0, len(frames) / 16.0), 6),
                "objects": ["bright area" if total >= 128 * n_px else "dark area"],
                "scene_context": f"{len(frames)} frames of {n_px // max(len(frames), 1)} pixels"}


class StubSummarizer:
    """Deterministic summariser: HTTP 500 for video_id % 5 == 0, an exception
    for video_id % 7 == 0 (so the fallback summary is used), else a text."""

    def summarize(self, video_id: int, observations: str) -> tuple[int, str]:
        if video_id % 7 == 0:
            raise RuntimeError("summary model unavailable")
        if video_id % 5 == 0:
            return 500, ""
        n = len(observations.split(" | ")) if observations else 0
        return 200, f"Summary of {n} observations"


_MODELS: dict[str, object] = {}
_FACTORIES = {"stub-frame": StubFrameModel, "stub-group": StubGroupModel, "stub-summary": StubSummarizer}


def register_model(spec: str, factory) -> None:
    """Make a model factory available to ``load_model`` on the workers."""
    _FACTORIES[spec] = factory


def new_model(spec):
    """A model of its own for the caller: from a registered name, or a factory (class)."""
    return (_FACTORIES[spec] if isinstance(spec, str) else spec)()


def load_model(spec):
    """Load a model once per Python worker process and reuse it.

    ``spec`` is a registered name or the factory (class) itself; a factory is
    shipped to the workers with the task closure, a name must be registered
    in the worker processes (built-in stubs always are)."""
    # two local classes of one name are different models: their pickles tell them apart
    key = spec if isinstance(spec, str) else hashlib.sha256(cloudpickle.dumps(spec)).hexdigest()
    m = _MODELS.get(key)
    if m is None:
        m = _MODELS[key] = new_model(spec)
    return m


class _Caller:
    """A thread with a model of its own that answers one call after another."""

    def __init__(self, make: Callable[[], FrameModel], answers: queue.SimpleQueue):
        self.jobs: queue.SimpleQueue = queue.SimpleQueue()
        self.make, self.answers = make, answers
        threading.Thread(target=self._work, daemon=True).start()

    def _work(self) -> None:
        model = None
        while (job := self.jobs.get()) is not None:
            number, batch, attempt = job
            began = time.monotonic()
            try:
                if model is None:
                    model = self.make()
                out = pd.DataFrame(model.describe(batch, attempt))
                if len(out) != len(batch):
                    raise ValueError(f"{len(out)} answers for {len(batch)} frames")
            except Exception as e:  # noqa: BLE001 - model errors become rows
                out = e
            self.answers.put((self, number, out, time.monotonic() - began))


class CallPool:
    """Calls of a model with a deadline each, a bounded number at once.

    A call that has not answered after ``timeout_s`` is given up: its frames are timeouts, and a new thread with a new model
    takes its place at once, so the other frames and the task go on. A thread cannot be stopped from outside; the one given up
    holds its own frames and ends when its call does. Threads are kept from batch to batch; ``close`` ends those that wait."""

    def __init__(self, make: Callable[[], FrameModel], at_once: int = 1):
        self.make, self.at_once, self.idle = make, max(1, at_once), []
        self.answers: queue.SimpleQueue = queue.SimpleQueue()

    def run(self, calls: list[pd.DataFrame], attempt: int, timeout_s: float) -> list[tuple[pd.DataFrame | Exception | None, float]]:
        """For each call its answer, an exception, or None after the deadline; and its seconds."""
        out: list = [(None, timeout_s)] * len(calls)
        todo, busy = deque(range(len(calls))), {}
        while todo or busy:
            while todo and len(busy) < self.at_once:
                caller = self.idle.pop() if self.idle else _Caller(self.make, self.answers)
                busy[caller] = (todo[0], time.monotonic() + timeout_s)
                caller.jobs.put((todo[0], calls[todo.popleft()], attempt))
            try:
                caller, number, answer, seconds = self.answers.get(timeout=max(0.0, min(d for _, d in busy.values()) - time.monotonic()))
            except queue.Empty:
                now = time.monotonic()
                for caller in [c for c, (_, deadline) in busy.items() if deadline <= now]:
                    del busy[caller]
                    caller.jobs.put(None)
                continue
            if busy.get(caller, (None,))[0] == number:  # else one that was given up answers late
                del busy[caller]
                self.idle.append(caller)
                out[number] = (answer, seconds)
        return out

    def close(self) -> None:
        for caller in self.idle:
            caller.jobs.put(None)


DESCRIBE_SCHEMA = T.StructType([
    T.StructField("video_id", T.LongType()), T.StructField("sample_pos", T.LongType()),
    T.StructField("frame_idx", T.LongType()), T.StructField("success", T.BooleanType()),
    T.StructField("description", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("processing_time", T.DoubleType()), T.StructField("frame_description", T.StringType()),
    T.StructField("model_used", T.StringType()), T.StructField("attempts", T.IntegerType()),
    T.StructField("timestamp", T.DoubleType())])


def retry_wait(attempt: int) -> float:
    """Exponential wait between attempts, bounded to [4, 10] seconds."""
    return float(min(WAIT_MAX_S, max(WAIT_MIN_S, 2.0 ** (attempt + 1))))


def _whole(values: pd.Series) -> pd.Series:
    """Whole numbers from text, null as null: pandas would turn longs beside nulls into doubles."""
    return pd.Series(pd.array([None if v is None else int(v) for v in values], dtype="Int64"), index=values.index)


def describe_frames(frames: DataFrame, model_spec: str = "stub-frame", model_name: str = "stub",
                    timeout_s: float = DEFAULT_TIMEOUT_S, sleep: bool = True,
                    prompt: str | Column = "", frames_per_call: int = 1, calls_at_once: int = 1) -> DataFrame:
    """I1 + I6 + I7 + F4: one analysis row per frame (frames need video_id, sample_pos,
    frame_idx, pixels; ``ts`` is handed on as timestamp if there is one). Any of the numbers may be null.

    ``prompt`` is a text for all frames or a column of ``frames``.
    status 200 -> stripped response; other status -> 'HTTP <code>'. A call without an answer after ``timeout_s`` seconds is given
    up (``CallPool``) -> 'Timeout after <t> seconds' with processing_time = timeout, and so is a frame whose model
    reports that much latency; processing_time is else the call's seconds over its frames, unless the model reports its own.
    Transient failures are retried up to 3 attempts (waits 4-10 s; ``sleep=False`` skips them for models that
    have nothing to wait for); an exception becomes 'Processing error: ...' with processing_time 0 (a failing
    call of several frames is repeated frame by frame, so that one bad frame is one error row).
    """
    keys = ["video_id", "sample_pos", "frame_idx"]
    cols = frames.select(*[F.col(c).cast("long").cast("string").alias(c) for c in keys], "pixels",
                         (prompt if isinstance(prompt, Column) else F.lit(prompt)).alias("prompt"),
                         (F.col("ts") if "ts" in frames.columns else F.lit(None)).cast("double").alias("timestamp"))

    def answers(pool: CallPool, pdf: pd.DataFrame, idx: np.ndarray, attempt: int) -> dict[int, object]:
        """Per frame: an answer (a row with latency), an exception, or None after the deadline."""
        groups, out, again = [idx[k:k + frames_per_call] for k in range(0, len(idx), frames_per_call)], {}, []
        for g, (got, seconds) in zip(groups, pool.run([pdf.iloc[g].reset_index(drop=True) for g in groups], attempt, timeout_s)):
            if isinstance(got, Exception) and len(g) > 1:
                again += list(g)
            elif got is None or isinstance(got, Exception):
                out.update({j: got for j in g})
            else:
                got = got if "latency" in got else got.assign(latency=seconds / len(g))
                out.update({j: got.iloc[k] for k, j in enumerate(g)})
        for j, (got, seconds) in zip(again, pool.run([pdf.iloc[[j]].reset_index(drop=True) for j in again], attempt, timeout_s)):
            out[j] = got if got is None or isinstance(got, Exception) else (got if "latency" in got else got.assign(latency=seconds)).iloc[0]
        return out

    def row(got) -> tuple:
        """(success, description, error, processing_time) of a frame's last answer."""
        if isinstance(got, Exception):
            return False, None, f"Processing error: {got}", 0.0
        if got is None or float(got["latency"]) >= timeout_s:
            return False, None, f"Timeout after {int(timeout_s)} seconds", float(timeout_s)
        if int(got["status"]) == 200:
            return True, str(got["response"]).strip(), None, round(float(got["latency"]), 2)
        return False, None, f"HTTP {int(got['status'])}", round(float(got["latency"]), 2)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = CallPool(lambda: new_model(model_spec), calls_at_once)
        for pdf in it:
            batch = pdf.assign(**{c: _whole(pdf[c]) for c in keys})
            attempts, last = np.ones(len(pdf), dtype=np.int32), {}
            pending = np.arange(len(pdf))
            for a in range(MAX_ATTEMPTS):
                attempts[pending] = a + 1
                last.update(answers(pool, batch, pending, a))
                pending = np.array([j for j in pending if isinstance(last[j], pd.Series) and bool(last[j]["transient"])], dtype=int)
                if not len(pending):
                    break
                if sleep and a + 1 < MAX_ATTEMPTS:
                    time.sleep(retry_wait(a))
            last.update({j: RuntimeError(f"transient failure after {MAX_ATTEMPTS} attempts") for j in pending})
            ok, desc, err, spent = zip(*[row(last[j]) for j in range(len(pdf))]) if len(pdf) else ((), (), (), ())
            yield pd.DataFrame({
                "video_id": pdf["video_id"], "sample_pos": pdf["sample_pos"], "frame_idx": pdf["frame_idx"],
                "success": ok, "description": desc, "error": err, "processing_time": spent,
                "frame_description": [None if i is None else f"Frame {int(i) + 1}" for i in pdf["sample_pos"]],
                "model_used": model_name, "attempts": attempts, "timestamp": pdf["timestamp"]})
        pool.close()

    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType) for f in DESCRIBE_SCHEMA])
    return cols.mapInPandas(run, text).withColumns({c: F.col(c).cast("long") for c in keys})


GROUP_SCHEMA = ("video_id long, n_frames long, description string, confidence double, error string, objects array<string>, "
                "actions array<string>, scene_context string, temporal_events array<string>, processing_time double")


# Bytes of pixels that one group call may get.
MAX_GROUP_BYTES = 256 << 20


def describe_frame_groups(frames: DataFrame, prompt: str, model_spec="stub-group", max_frames: int | None = None,
                          max_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """I2 (+ I4 error rows): all frames of a video, one prompt -> one answer.

    Every result has the fields of a full analysis; what the model does not answer, and all lists of
    a failed call, are empty. processing_time is the measured time of the call.
    A group is what one model call gets: sample the frames before. ``max_frames`` (P9)
    keeps the first sample positions only, before grouping. A video whose frames still hold over ``max_bytes`` levels is
    never gathered: it gets an error row. Frames without a video id are a group of their own.
    """
    from framelake.operators.sampling import cap_frames
    from framelake.plans.joins import materialize
    capped = (frames if max_frames is None else cap_frames(frames, max_frames)).select(
        F.col("video_id").cast("long").cast("string").alias("video_id"), F.col("sample_pos").cast("long").cast("string").alias("sample_pos"), "pixels")
    packed = isinstance(capped.schema["pixels"].dataType, T.BinaryType)  # bytes, or an array of levels
    size = F.octet_length("pixels") if packed else F.size("pixels")
    weights = capped.groupBy("video_id").agg(F.sum(size.cast("long")).alias("_bytes"), F.count(F.lit(1)).alias("n_frames"))
    heavy = materialize(weights.filter(F.col("_bytes") > max_bytes), "heavy-groups")  # its written size decides how it is joined
    light = capped.join(heavy.select(F.col("video_id").alias("_heavy")), F.col("video_id").eqNullSafe(F.col("_heavy")), "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model = load_model(model_spec)
        vid = pdf["video_id"].iloc[0]
        pdf = pdf.assign(video_id=_whole(pdf["video_id"]), sample_pos=_whole(pdf["sample_pos"]))
        pdf, began = pdf.sort_values("sample_pos"), time.monotonic()
        try:
            r = {"error": None, **model.analyze(pdf, prompt)}
        except Exception as e:  # noqa: BLE001
            r = {"description": f"{ANALYSIS_FAILED}{e}", "confidence": 0.0, "error": str(e)}
        return pd.DataFrame([{
            "video_id": vid, "n_frames": len(pdf), "description": r["description"], "confidence": float(r["confidence"]),
            "error": r["error"], "objects": list(r.get("objects", ())), "actions": list(r.get("actions", ())),
            "scene_context": r.get("scene_context", ""), "temporal_events": list(r.get("temporal_events", ())),
            "processing_time": time.monotonic() - began}])

    answered = light.groupBy("video_id").applyInPandas(run, GROUP_SCHEMA.replace("video_id long", "video_id string"))
    error = F.concat(F.col("_bytes").cast("string"), F.lit(f" levels of pixels are over the limit of {max_bytes}"))
    none = F.array().cast("array<string>")
    refused = heavy.select("video_id", "n_frames", F.concat(F.lit(ANALYSIS_FAILED), error).alias("description"), F.lit(0.0).alias("confidence"),
                           error.alias("error"), none.alias("objects"), none.alias("actions"), F.lit("").alias("scene_context"),
                           none.alias("temporal_events"), F.lit(0.0).alias("processing_time"))
    return answered.unionByName(refused).withColumn("video_id", F.col("video_id").cast("long"))


def analyze_videos(frames: DataFrame, prompt: str, model_spec, height: int, width: int, max_frames: int | None = None) -> DataFrame:
    """I4: the whole chain on sampled frames with an ``image`` struct: resize and channel swap, then one model call per video. Videos of
    which no frame has an image get the error result 'Analysis failed: No frames extracted from video'."""
    from framelake.functions.images import model_frames
    some = frames.filter(F.col("image").isNotNull())
    answered = describe_frame_groups(model_frames(some, height, width), prompt, model_spec, max_frames)
    empty = frames.select(F.col("video_id").cast("long")).distinct().exceptAll(some.select(F.col("video_id").cast("long")).distinct())
    none = F.array().cast("array<string>")
    failed = empty.select("video_id", F.lit(0).cast("long").alias("n_frames"), F.lit(ANALYSIS_FAILED + NO_FRAMES_EXTRACTED).alias("description"),
                          F.lit(0.0).alias("confidence"), F.lit(NO_FRAMES_EXTRACTED).alias("error"), none.alias("objects"), none.alias("actions"),
                          F.lit("").alias("scene_context"), none.alias("temporal_events"), F.lit(0.0).alias("processing_time"))
    return answered.unionByName(failed)


# Fixed value: the summary of a video without a successful frame.
NO_FRAMES = "No frames were successfully analyzed."
SUMMARY_SCHEMA = "video_id long, summary string, source string"


def summarize_videos(texts: DataFrame, fallback: DataFrame, model_spec: str = "stub-summary") -> DataFrame:
    """Observations of a video (video_id, text) -> one model summary; a video of ``fallback`` without
    observations -> 'No frames were successfully analyzed.'; HTTP failure -> the literal
    'Failed to generate video summary.'; an exception -> the fallback summary
    (A3/A4) computed by Spark and joined in beforehand."""
    j = fallback.select("video_id", F.col("summary").alias("fallback")).join(
        texts.select("video_id", "text"), "video_id", "left").select(F.col("video_id").cast("long").cast("string").alias("video_id"), "text", "fallback")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model(model_spec)
        for pdf in it:
            out, src = [], []
            for vid, text, fb in zip(_whole(pdf["video_id"]), pdf["text"], pdf["fallback"]):
                if text is None:
                    out.append(NO_FRAMES), src.append("none")
                    continue
                try:
                    status, s = model.summarize(int(vid), text)
                    if status == 200:
                        out.append(s.strip()), src.append("model")
                    else:
                        out.append(SUMMARY_FAILED), src.append("http_error")
                except Exception:  # noqa: BLE001
                    out.append(fb), src.append("fallback")
            yield pd.DataFrame({"video_id": pdf["video_id"], "summary": out, "source": src})

    return j.mapInPandas(run, SUMMARY_SCHEMA.replace("video_id long", "video_id string")).withColumn("video_id", F.col("video_id").cast("long"))


class FrameProcessor(Protocol):
    """frame-processor plug-in: a batch of uint8 arrays -> float arrays."""

    def process(self, frames: list[np.ndarray]) -> list[np.ndarray]: ...


class NormalizeProcessor:
    def process(self, frames: list[np.ndarray]) -> list[np.ndarray]:
        return [np.asarray(f, dtype=np.float32) * np.float32(1.0 / 255.0) for f in frames]


def process_frames(frames: DataFrame, processor: FrameProcessor | None = None) -> DataFrame:
    """F2 applied with an Arrow UDF (one call per batch)."""
    proc = processor or NormalizeProcessor()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _run(s: pd.Series) -> pd.Series:
        return pd.Series([a.tolist() for a in proc.process([np.asarray(x) for x in s])])

    return frames.withColumn("processed", _run(F.col("pixels")))
