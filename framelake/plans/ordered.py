"""Skew-safe ordered computations: positions, previous row, running aggregates.

A plain ``Window.partitionBy(video).orderBy(idx)`` sends every row of a video to
one task; a video (or a memory-ledger tag, or the global ledger, which has no
key at all) holding a third of the data would then run in a single task.
Everything here instead windows over ``(keys, segment)``, where a segment is a
bounded range of the ordering key, and stitches segments together with a
small per-segment table:

* positions      local ``row_number`` + count of all earlier segments
* running sum    local running sum + sum of all earlier segments
* running min/max local running extreme combined with the extreme of all
                 earlier segments
* previous row   the last row of each segment is copied into the next one
* next match     the first matching row of later segments is handed back to
                 rows with no match left in their own

Each step is one shuffle of the data on ``(keys, segment)``; later steps on the
same segments reuse that partitioning, so only the per-segment table (rows /
span) is shuffled again. The prefix over the per-segment table is itself
two-level (``segment_prefix``), so no window anywhere sees an unbounded group.
The per-segment table is joined back without a broadcast hint: its size is
rows/span, which grows with the data, so Spark/AQE decide from measured sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key per segment (upper bound when the ordering key is unique
# per key). Bounded window partitions whatever the skew.
SEGMENT_SPAN = 1 << 16

# Frames of one video per window task where the rows carry pixels.
FRAME_SPAN = 1 << 9

SEG = "_seg"


def with_segments(df: DataFrame, seg_expr: Column | str, name: str = SEG) -> DataFrame:
    """Attach a segment id. ``seg_expr`` must be monotone in the ordering."""
    e = F.expr(seg_expr) if isinstance(seg_expr, str) else seg_expr
    return df.withColumn(name, e.cast("long"))


def span_segments(order_col: str, span: int | None = None) -> Column:
    """Segment = integer ordering key ``div span`` (default ``SEGMENT_SPAN``)."""
    return F.expr(f"`{order_col}` div {int(span or SEGMENT_SPAN)}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join on ``keys`` that keeps rows with a NULL key (NULL meets NULL)."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, on, "inner").drop(*[f"_r_{k}" for k in keys])


def _local_window(keys: Sequence[str], order: Sequence[str | Column], seg: str = SEG):
    return Window.partitionBy(*keys, seg).orderBy(*order)


# Segments per super-segment in the two-level prefix over segment tables.
SUPER_SPAN = 1 << 12


def segment_prefix(table: DataFrame, keys: Sequence[str], value: str, out: str, how: str = "sum",
                   seg: str = SEG) -> DataFrame:
    """Exclusive prefix (over earlier segments of the same key) of a per-segment value.

    Two levels, so no window is unbounded even for a key with billions of rows
    or for the key-less global case: a prefix within (key, super-segment) of at
    most ``SUPER_SPAN`` segments, plus a prefix over super-segment totals
    (rows / (span * SUPER_SPAN) per key). ``how``: sum, min or max. NULL when
    there is no earlier segment (min/max) or 0 (sum).
    """
    keys = list(keys)
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    comb = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
            "min": F.least, "max": F.greatest}[how]
    t = table.withColumn("_super", F.col(seg).bitwiseAND(F.lit(-SUPER_SPAN)))
    w_in = Window.partitionBy(*keys, "_super").orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    local = t.withColumn("_pin", agg(value).over(w_in))
    sup = t.groupBy(*keys, "_super").agg(agg(value).alias("_sv"))
    w_sup = (Window.partitionBy(*keys) if keys else Window).orderBy("_super") \
        .rowsBetween(Window.unboundedPreceding, -1)
    sup = sup.select(*keys, "_super", agg("_sv").over(w_sup).alias("_psup"))
    res = null_safe_join(local, sup, keys + ["_super"]).withColumn(out, comb(F.col("_psup"), F.col("_pin")))
    if how == "sum":
        res = res.withColumn(out, F.col(out).cast(table.schema[value].dataType))
    return res.drop("_super", "_pin", "_psup")


def dense_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                    out: str = "pos", seg: str = SEG) -> DataFrame:
    """0-based position within ``keys`` ordered by ``order`` (needs a segment column).

    ``order`` must be a total order within a key, consistent with the segments.
    """
    keys = list(keys)
    local = df.withColumn("_lrn", F.row_number().over(_local_window(keys, order, seg)))
    seg_counts = local.groupBy(*keys, seg).agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = segment_prefix(seg_counts, keys, "_cnt", "_off", "sum", seg).select(*keys, seg, "_off")
    return (null_safe_join(local, offsets, keys + [seg])
            .withColumn(out, (F.col("_off") + F.col("_lrn") - 1).cast("long"))
            .drop("_lrn", "_off"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                value: str, out: str, seg: str = SEG) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` (segmented)."""
    keys = list(keys)
    w = _local_window(keys, order, seg).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_lsum", F.sum(value).over(w))
    seg_tot = local.groupBy(*keys, seg).agg(F.sum(value).alias("_tot"))
    offsets = segment_prefix(seg_tot, keys, "_tot", "_off", "sum", seg).select(*keys, seg, "_off")
    return (null_safe_join(local, offsets, keys + [seg])
            .withColumn(out, F.col("_off") + F.col("_lsum"))
            .drop("_lsum", "_off"))


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                 values: dict[str, str], seg: str = SEG) -> DataFrame:
    """Several inclusive running sums ``{value: out}`` in one window pass and
    one per-segment table (instead of chaining ``running_sum`` calls)."""
    keys = list(keys)
    w = _local_window(keys, order, seg).rowsBetween(Window.unboundedPreceding, 0)
    local = df
    for v in values:
        local = local.withColumn(f"_l_{v}", F.sum(v).over(w))
    seg_tot = local.groupBy(*keys, seg).agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    for v in values:
        seg_tot = segment_prefix(seg_tot, keys, f"_t_{v}", f"_o_{v}", "sum", seg)
    seg_tot = seg_tot.select(*keys, seg, *[f"_o_{v}" for v in values])
    res = null_safe_join(local, seg_tot, keys + [seg])
    for v, o in values.items():
        res = res.withColumn(o, F.col(f"_o_{v}") + F.col(f"_l_{v}")).drop(f"_o_{v}", f"_l_{v}")
    return res


def running_extreme(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                    value: str, out: str, how: str = "min", seg: str = SEG) -> DataFrame:
    """Inclusive running min or max of ``value`` within ``keys`` (segmented)."""
    keys = list(keys)
    agg = F.min if how == "min" else F.max
    comb = F.least if how == "min" else F.greatest
    w = _local_window(keys, order, seg).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_lext", agg(value).over(w))
    seg_ext = local.groupBy(*keys, seg).agg(agg(value).alias("_sext"))
    prior = segment_prefix(seg_ext, keys, "_sext", "_prior", how, seg).select(*keys, seg, "_prior")
    # least/greatest skip NULLs, so the first segment keeps its local value.
    return (null_safe_join(local, prior, keys + [seg])
            .withColumn(out, comb(F.col("_prior"), F.col("_lext")))
            .drop("_lext", "_prior"))


def clamped_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str,
                          out: str, peak: str | None = None, seg: str = SEG) -> DataFrame:
    """Running total of ``value`` that clamps at zero, and optionally its running peak.

    S_t = C_t - least(0, min_{u<=t} C_u) with C the plain running sum.

    round 1: one window pass over (keys, segment) gives the local running sum
    lc, the local running min of lc, and per segment the total and the minimum
    of lc. The per-segment table (one row per segment) gets its two-level
    prefixes -- offset = sum of earlier totals, minimum of C over earlier
    segments -- and is written once to the shared checkpoint folder, then joined
    back (broadcast by the planner from the written file size when small).
    round 2 (only for ``peak``): the same for the running max of S; the peak
    starts at 0.
    The data is read once per round plus once for the result, whatever the
    key skew, instead of once per branch of a long lineage.
    """
    from framelake.plans.joins import materialize
    keys = list(keys)
    w = _local_window(keys, order, seg)
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    ws = Window.partitionBy(*keys, seg)
    r1 = (df.withColumn("_lc", F.sum(value).over(wr))
          .withColumn("_lm", F.min("_lc").over(wr))
          .withColumn("_M", F.min("_lc").over(ws)))
    segt = r1.groupBy(*keys, seg).agg(F.sum(value).alias("_T"), F.first("_M").alias("_M"))
    segt = segment_prefix(segt, keys, "_T", "_off", "sum", seg)
    segt = segment_prefix(segt.withColumn("_offM", F.col("_off") + F.col("_M")), keys, "_offM", "_pm", "min", seg)
    segt = materialize(segt.select(*keys, seg, "_off", "_pm"))
    # segt is a written parquet table: the planner sees its file size and
    # broadcasts it when small (no extra counting job)
    j = null_safe_join(r1.drop("_M"), segt, keys + [seg])
    c = F.col("_off") + F.col("_lc")
    run_min = F.least(F.col("_pm"), F.col("_off") + F.col("_lm"))
    j = j.withColumn(out, c - F.least(F.lit(0), run_min)).drop("_lc", "_lm", "_off", "_pm")
    if peak is None:
        return j
    r2 = j.withColumn("_ls", F.max(out).over(wr))
    segx = r2.groupBy(*keys, seg).agg(F.max(out).alias("_X"))
    segx = materialize(segment_prefix(segx, keys, "_X", "_px", "max", seg).select(*keys, seg, "_px"))
    res = null_safe_join(r2, segx, keys + [seg])
    return res.withColumn(peak, F.greatest(F.col("_px"), F.col("_ls"), F.lit(0))).drop("_ls", "_px")


def with_previous(df: DataFrame, keys: Sequence[str], pos: str, cols: Sequence[str],
                  prefix: str = "prev_", span: int | None = None) -> DataFrame:
    """Attach the previous row's ``cols`` (row at ``pos - 1`` of the same key).

    ``pos`` must be dense (0, 1, 2, ...) within each key. The last row of every
    position segment is copied into the next segment so ``lag`` never needs a
    window wider than ``span`` rows.
    """
    keys = list(keys)
    span = int(span or SEGMENT_SPAN)
    seg = F.expr(f"`{pos}` div {span}")
    # one pass: a segment's last row is emitted twice, the second copy tagged
    # as the carry into the next segment (no union, no second scan)
    segs = F.when(F.expr(f"pmod(`{pos}`, {span}) = {span - 1}"), F.array(seg, seg + 1)).otherwise(F.array(seg))
    both = df.select("*", F.posexplode(segs).alias("_copy", "_pseg"))
    w = Window.partitionBy(*keys, "_pseg").orderBy(pos)
    both = both.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    return both.filter(F.col("_copy") == 0).drop("_pseg", "_copy")


def global_positions(df: DataFrame, order: Sequence[str | Column], out: str = "pos") -> DataFrame:
    """0-based position over the whole table in ``order`` (no key).

    A global sort range-partitions the rows, so the partition id after the sort
    is monotone in the order and serves as the segment; each range partition is
    bounded by the sort's sampling, and the per-segment table has one row per
    partition. The sorted rows are written with their partition id, because ranks and
    per-segment counts must see the same ids however each of them is planned.
    """
    from framelake.plans.joins import materialize
    s = materialize(df.orderBy(*order).withColumn(SEG, F.spark_partition_id().cast("long")), "sorted")
    return dense_positions(s, [], order, out=out).drop(SEG)


def next_match(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The first non-null ``value`` at or after each row, within ``keys`` in ascending ``order`` (NULLs first).

    A forward as-of join is this over the union of both sides. Rows are sorted globally, so a segment
    is one range partition: bounded by the sort's sampling, whatever the gaps in the order and
    however many rows a key has. A row without a match left in its segment takes the first one of later
    segments, from a table with one row per key and range partition.
    """
    from framelake.plans.joins import materialize
    keys = list(keys)
    s = materialize(df.orderBy(*keys, *order).withColumn(SEG, F.spark_partition_id().cast("long")), "sorted")
    # backwards, so that the frame only grows: the latest non-null value is the nearest one ahead
    back = Window.partitionBy(*keys, SEG).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    local = s.withColumn("_here", F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v"))))
    heads = s.groupBy(*keys, SEG).agg(first.alias("_head"))
    later = Window.partitionBy(*keys).orderBy(F.col(SEG).desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_ahead", F.last("_head", ignorenulls=True).over(later)).select(*keys, SEG, "_ahead")
    return (null_safe_join(local, heads, keys + [SEG])
            .withColumn(out, F.coalesce("_here", F.col("_ahead")["_v"])).drop("_here", "_ahead", SEG))
