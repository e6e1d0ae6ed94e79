"""Model requests and responses as tables.

Requests are JSON strings built with ``to_json``; responses are parsed with
``from_json`` and explicit schemas. Existence checks are semi/anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Request options of the reference pipelines.
FRAME_OPTIONS = {"temperature": 0.3, "num_predict": 60, "top_k": 10, "top_p": 0.9}
SUMMARY_OPTIONS_CPU = {"temperature": 0.3, "num_predict": 50, "top_k": 10, "top_p": 0.9, "repeat_penalty": 1.1}
SUMMARY_OPTIONS_GPU = {"temperature": 0.3, "num_predict": 50, "top_k": 10, "top_p": 0.9}
CPU_MODEL = "llama3.2-vision:11b"
GPU_MODEL = "llava:7b"
BRIDGE_MODEL = "llama3.2-vision:11b"


def pixels_base64(pixels: Column) -> Column:
    """uint8 pixel array -> bytes -> base64 text."""
    hexs = F.array_join(F.transform(pixels, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    # Spark chunks base64 text with CRLF every 76 characters; the reference's encoder does not
    return F.regexp_replace(F.base64(F.unhex(hexs)), "[\r\n]", "")


def _options(opts: dict) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in opts.items()])


def frame_request(model: Column, prompt: Column, images: Column) -> Column:
    """Per-frame generate request."""
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), images.alias("images"),
                              F.lit(False).alias("stream"), _options(FRAME_OPTIONS).alias("options")))


def summary_request(model: Column, prompt: Column, gpu: bool = False) -> Column:
    """Text-only summary request (repeat_penalty only on the CPU path)."""
    return F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), F.lit(False).alias("stream"),
                              _options(SUMMARY_OPTIONS_GPU if gpu else SUMMARY_OPTIONS_CPU).alias("options")))


RESPONSE_SCHEMA = T.StructType([
    T.StructField("response", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("done", T.BooleanType()), T.StructField("total_duration", T.LongType()),
    T.StructField("eval_count", T.LongType())])

WS = "[ \\t\\n\\r\\f\\x0B]"
WS_CHARS = " \t\n\r\f\x0b"


def parse_response(status: Column, body: Column) -> Column:
    """200 -> stripped response text; otherwise an 'HTTP <code>' error.
    Bridge fields come with their defaults (model '', done false, 0, 0)."""
    r = F.from_json(body, RESPONSE_SCHEMA)
    ok = status == 200
    return F.struct(
        ok.alias("success"),
        F.when(ok, F.trim(F.coalesce(r["response"], F.lit("")), F.lit(" \t\n\r\f\x0b"))).alias("description"),
        F.when(~ok, F.concat(F.lit("HTTP "), status.cast("string"))).alias("error"),
        F.when(ok, F.coalesce(r["model"], F.lit(""))).alias("model"),
        F.when(ok, F.coalesce(r["done"], F.lit(False))).alias("done"),
        F.when(ok, F.coalesce(r["total_duration"], F.lit(0).cast("long"))).alias("total_duration"),
        F.when(ok, F.coalesce(r["eval_count"], F.lit(0).cast("long"))).alias("eval_count"))


def split_missing_inputs(requested: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Requested keys that exist (left semi) and that do not (left anti).
    Returns (key, found)."""
    found = requested.join(existing, key, "left_semi").withColumn("found", F.lit(True))
    missing = requested.join(existing, key, "left_anti").withColumn("found", F.lit(False))
    return found.unionByName(missing)


def first_available(candidates: DataFrame, available: DataFrame, group: str,
                    item: str = "path", priority: str = "priority") -> DataFrame:
    """Per group, the available candidate with the best (lowest) priority, else ''."""
    avail = candidates.join(available, item, "left_semi").withColumn("_ok", F.lit(True))
    both = candidates.join(avail.select(group, item, "_ok"), [group, item], "left")
    ok = F.col("_ok").isNotNull()
    return both.groupBy(group).agg(
        F.coalesce(F.min_by(F.when(ok, F.col(item)), F.when(ok, F.col(priority))), F.lit("")).alias("chosen"))


def overlay_config(js: Column, defaults: dict[str, int]) -> Column:
    """JSON keys applied over defaults in order. A present key with a
    non-integer value stops the overlay there (earlier keys stay applied);
    unparsable JSON -> all defaults."""
    schema = T.StructType([T.StructField(k, T.LongType()) for k in defaults])
    parsed = F.from_json(js, schema)
    valid_doc = F.get_json_object(js, "$").isNotNull() & F.trim(js).startswith("{")
    fields = []
    ok_so_far = F.lit(True)
    for k, v in defaults.items():
        present = F.get_json_object(js, f"$.{k}").isNotNull()
        good = parsed[k].isNotNull()
        use = valid_doc & ok_so_far & present & good
        fields.append(F.when(use, parsed[k]).otherwise(F.lit(v).cast("long")).alias(k))
        ok_so_far = ok_so_far & (~present | good)
    return F.struct(*fields)


def overlay_configs(df: DataFrame, js: Column, defaults: dict[str, int], out: str = "config") -> DataFrame:
    """``overlay_config`` of a table's texts, as a struct ``out``.

    The text is parsed once as numbers and once as text (which tells presence), and the place of the first bad key
    is found once, each in a projection of its own."""
    whole = T.StructType([T.StructField(k, T.LongType()) for k in defaults])
    named = T.StructType([T.StructField(k, T.StringType()) for k in defaults])
    cols = df.columns
    d = df.select(*cols, js.alias("_js"))
    d = d.select(*cols, F.from_json("_js", whole).alias("_n"), F.from_json("_js", named).alias("_t"),
                 (F.get_json_object("_js", "$").isNotNull() & F.trim("_js").startswith("{")).alias("_valid"))
    bad = F.array_position(F.array(*[F.col("_t")[k].isNotNull() & F.col("_n")[k].isNull() for k in defaults]), True)
    d = d.select(*cols, "_n", F.when(~F.coalesce("_valid", F.lit(False)), F.lit(1).cast("long")).otherwise(F.coalesce(bad, F.lit(0).cast("long"))).alias("_stop"))
    fields = [F.when((F.col("_stop") == 0) | (F.col("_stop") > i), F.coalesce(F.col("_n")[k], F.lit(v).cast("long"))).otherwise(F.lit(v).cast("long")).alias(k)
              for i, (k, v) in enumerate(defaults.items(), 1)]
    return d.select(*cols, F.struct(*fields).alias(out))
