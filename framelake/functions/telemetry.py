"""Telemetry log lines -> host load / GPU gates (M1-M6).

Input: a line table (host, line_no, line). Each rule is a per-line
expression plus a per-host partial aggregate (min_by / max_by on line_no),
so a host with a huge log still reduces map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and texts of the reference gates.
LOAD_LIMIT = 8.0
CPU_LIMIT = 150.0
GPU_UTIL_LIMIT = 80.0
GPU_READY_BELOW = 50
GPU_BUSY_BELOW = 80
LOAD_MARKER = "load average:"
RUNNER_MARKER = "ollama runner"

WS = "[ \\t\\n\\r\\f\\x0B]"
WS_CHARS = " \t\n\r\f\x0b"


def py_split(line: Column) -> Column:
    """str.split(): fields separated by whitespace runs, no empty fields."""
    return F.filter(F.split(F.trim(line, F.lit(WS_CHARS)), f"{WS}+"), lambda x: x != "")


def py_float(s: Column) -> Column:
    """float(s) for plain decimal texts (surrounding whitespace allowed); NULL if invalid."""
    t = F.trim(s, F.lit(WS_CHARS))
    ok = t.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(ok, t.try_cast("double"))


def load_values(line: Column) -> Column:
    """M1 helper: the comma list after 'load average:' as doubles (NULL entry = bad)."""
    rest = F.substring(line, F.instr(line, LOAD_MARKER) + len(LOAD_MARKER), 1 << 30)
    after = F.substring_index(rest, LOAD_MARKER, 1)
    return F.transform(F.split(after, ","), lambda x: py_float(x))


def host_gate(lines: DataFrame) -> DataFrame:
    """M1 + M2 + M3 per host.

    load  = first value of the comma list after 'load average:' in the host's
            last uptime line (0 when there is none);
    cpu   = 3rd field of the first line containing 'ollama runner'
            (case-insensitive) that has more than two fields (0 when none or bad);
    can_process = load < 8 and cpu < 150; recommendation by load only.
    A bad load number makes the whole check fall back to the permissive default.
    """
    is_up = F.contains(F.col("line"), F.lit(LOAD_MARKER))
    fields = py_split(F.col("line"))
    is_run = F.contains(F.lower(F.col("line")), F.lit(RUNNER_MARKER)) & (F.size(fields) > 2)
    g = lines.groupBy("host").agg(
        F.max_by(F.when(is_up, F.col("line")), F.when(is_up, F.col("line_no"))).alias("_up"),
        F.min_by(F.when(is_run, fields[2]), F.when(is_run, F.col("line_no"))).alias("_cpu_txt"))
    vals = load_values(F.col("_up"))
    load_bad = F.col("_up").isNotNull() & F.exists(vals, lambda v: v.isNull())
    load = F.when(F.col("_up").isNull(), F.lit(0.0)).otherwise(F.get(vals, 0))
    cpu = F.coalesce(py_float(F.col("_cpu_txt")), F.lit(0.0))
    return g.select(
        "host",
        F.when(load_bad, F.lit(0.0)).otherwise(load).alias("system_load"),
        F.when(load_bad, F.lit(0.0)).otherwise(cpu).alias("ollama_cpu_usage"),
        F.when(load_bad, F.lit(True)).otherwise((load < LOAD_LIMIT) & (cpu < CPU_LIMIT)).alias("can_process"),
        F.when(load_bad | (load < LOAD_LIMIT), F.lit("normal")).otherwise(F.lit("wait_or_restart"))
        .alias("recommendation"))


def gpu_util_value(line: Column) -> Column:
    """M4 helper: the first '%' field with '%' removed, as float (NULL = parse error)."""
    first = F.get(F.filter(py_split(line), lambda p: F.contains(p, F.lit("%"))), 0)
    return py_float(F.regexp_replace(first, "%", ""))


def gpu_status(lines: DataFrame, decoder: DataFrame) -> DataFrame:
    """M4 + M5 + M6 per host.

    M4: over lines containing 'GPU' and '%', the last one wins; a bad number
        fails the whole probe (decoder off, util 0, fallback_cpu).
    M5: can_process = decoder available and util < 80.
    M6: CPU_FALLBACK without acceleration; else the leading integer of the
        first CSV utilisation line: <50 GPU_READY, <80 GPU_BUSY, else
        GPU_OVERLOADED; no integer -> GPU_STATUS_ERROR; no lines -> GPU_UNKNOWN.
    ``decoder``: host, available (bool).
    """
    is_gpu = F.contains(F.col("line"), F.lit("GPU")) & F.contains(F.col("line"), F.lit("%"))
    is_csv = F.col("line").startswith("card")
    csv_val = F.element_at(F.split(F.col("line"), ","), 2)
    g = lines.groupBy("host").agg(
        F.max_by(F.when(is_gpu, gpu_util_value(F.col("line"))), F.when(is_gpu, F.col("line_no"))).alias("_util"),
        F.count_if(is_gpu & gpu_util_value(F.col("line")).isNull()).alias("_bad"),
        F.count_if(is_gpu).alias("_n_gpu"),
        F.min_by(F.when(is_csv, csv_val), F.when(is_csv, F.col("line_no"))).alias("_csv"))
    j = g.join(decoder, "host", "right").fillna({"_bad": 0, "_n_gpu": 0})
    avail = F.coalesce(F.col("available"), F.lit(False))
    failed = F.col("_bad") > 0
    util = F.when(failed, F.lit(0.0)).otherwise(F.coalesce(F.col("_util"), F.lit(0.0)))
    lead = F.regexp_extract(F.coalesce(F.col("_csv"), F.lit("")), f"^{WS}*([+-]?[0-9]+)", 1)
    u = lead.try_cast("long")
    status = (F.when(~avail, F.lit("CPU_FALLBACK"))
              .when(F.col("_csv").isNull(), F.lit("GPU_UNKNOWN"))
              .when(u.isNull(), F.lit("GPU_STATUS_ERROR"))
              .when(u < GPU_READY_BELOW, F.lit("GPU_READY"))
              .when(u < GPU_BUSY_BELOW, F.lit("GPU_BUSY"))
              .otherwise(F.lit("GPU_OVERLOADED")))
    return j.select(
        "host", (avail & ~failed).alias("decoder_available"), util.alias("gpu_utilization"),
        (avail & ~failed & (util < GPU_UTIL_LIMIT)).alias("can_process"),
        F.when(avail & ~failed, F.lit("gpu_ready")).otherwise(F.lit("fallback_cpu")).alias("recommendation"),
        status.alias("status"))
