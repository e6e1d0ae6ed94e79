"""DuckDB oracle SQL for every registered query that SQL can express.

The fixture definitions (``FRAMES``, ``ANALYSES``, ...) restate the ones in
``framelake.sources.tables`` as plain window/aggregate SQL. The SQL runs on
the driver's views (region nation customer supplier part orders lineitem
events documents embeddings pages benchmark labels conversations).
"""

from __future__ import annotations

from framelake import queries as q
from framelake.functions.images import CANNY_HIGH, CANNY_LOW
from framelake.functions.tokens import SPECIAL_TEXT

# Fixture CTEs --------------------------------------------------------------------

FRAMES = """
frames AS (
  SELECT label AS video_id,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame_idx,
         vec_id,
         (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 10.0 AS ts,
         list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS INTEGER)) AS pixels
  FROM embeddings),
sizes AS (SELECT video_id, CAST(count(*) AS INTEGER) AS total_frames FROM frames GROUP BY video_id)"""

CFRAMES = FRAMES + """,
cframes AS (SELECT video_id, frame_idx, vec_id, ts, list_concat(pixels, [0, 0]) AS pixels FROM frames)"""


def r6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END)"


def positions(n: int) -> str:
    return f"(SELECT CAST(i AS BIGINT) AS i FROM range(0, {n}) t(i))"


SQL: dict[str, str] = {}

SQL["frame_motion_brightness"] = f"""
WITH {FRAMES},
samp AS (
  SELECT s.video_id, p.i AS sample_pos,
         CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(q.UNIFORM_N)} p),
sf AS (
  SELECT m.video_id, m.sample_pos, f.pixels,
         lag(f.pixels) OVER (PARTITION BY m.video_id ORDER BY m.sample_pos) AS prev
  FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx),
per AS (
  SELECT video_id,
         list_sum(pixels) / len(pixels) AS brightness,
         CASE WHEN prev IS NULL THEN 0.0
              ELSE list_sum(list_transform(pixels, lambda x, k: abs(x - prev[k]))) / len(pixels) END AS motion
  FROM sf)
SELECT video_id, CAST(count(*) AS BIGINT) AS n_frames,
       {r6("sum(brightness) / (count(*) * 255.0)")} AS avg_brightness,
       {r6("CASE WHEN count(*) > 1 THEN sum(motion) / ((count(*) - 1) * 255.0) END")} AS motion_intensity,
       {r6("count(*) / 32.0")} AS frames_norm
FROM per GROUP BY video_id"""


def _sample_sql(idx_expr: str, n: int) -> str:
    return f"""
WITH {FRAMES},
samp AS (SELECT s.video_id, s.total_frames AS t, p.i AS sample_pos FROM sizes s, {positions(n)} p)
SELECT m.video_id, m.sample_pos, f.frame_idx, {r6("f.ts")} AS ts
FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = ({idx_expr})"""


SQL["frame_sample_uniform"] = _sample_sql(
    f"CAST(trunc((CAST(m.sample_pos AS DOUBLE) / {q.UNIFORM_N - 1}) * (m.t - 1)) AS BIGINT)", q.UNIFORM_N)

SQL["frame_cap"] = f"""
SELECT video_id, sample_pos, frame_idx FROM ({_sample_sql(
    f"CAST(trunc((CAST(m.sample_pos AS DOUBLE) / {q.CAP_FROM - 1}) * (m.t - 1)) AS BIGINT)", q.CAP_FROM)}) WHERE sample_pos < 16"""

SQL["frame_sample_midpoint"] = _sample_sql(
    f"least(greatest(CAST(trunc(((m.sample_pos + 0.5) / {q.MIDPOINT_N}) * m.t) AS BIGINT), 0), m.t - 1)",
    q.MIDPOINT_N)

SQL["frame_sample_linspace"] = _sample_sql(
    f"CASE WHEN m.sample_pos = {q.UNIFORM_N - 1} THEN m.t - 1 "
    f"ELSE CAST(trunc(m.sample_pos * (CAST(m.t - 1 AS DOUBLE) / {q.UNIFORM_N - 1})) AS BIGINT) END",
    q.UNIFORM_N)

SQL["frame_sample_times"] = f"""
WITH {FRAMES},
req AS (SELECT s.video_id, p.i AS sample_pos, (p.i + 0.5) * (s.total_frames / 10.0) / {q.TIMES_N} AS t
        FROM sizes s, {positions(q.TIMES_N)} p),
hit AS (SELECT r.video_id, r.sample_pos, r.t, min(f.frame_idx) AS frame_idx
        FROM req r JOIN frames f ON f.video_id = r.video_id AND f.ts >= r.t
        GROUP BY r.video_id, r.sample_pos, r.t)
SELECT h.video_id, h.sample_pos, {r6("h.t")} AS t, h.frame_idx, {r6("f.ts")} AS ts
FROM hit h JOIN frames f ON f.video_id = h.video_id AND f.frame_idx = h.frame_idx"""

TIMED = """
timed AS (SELECT user_id AS video_id, event_id AS frame_idx,
                 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS ts FROM events),
firsts AS (SELECT video_id, ts, min(frame_idx) AS frame_idx FROM timed GROUP BY video_id, ts),
durations AS (SELECT video_id, max(ts) AS duration FROM timed GROUP BY video_id)"""


def _seek_sql(time: str) -> str:
    return f"""
WITH {TIMED},
req AS (SELECT d.video_id, p.i AS sample_pos, {time} AS t FROM durations d, {positions(q.TIMES_N)} p)
SELECT r.video_id, r.sample_pos, r.t, f.frame_idx, f.ts
FROM req r ASOF JOIN firsts f ON r.video_id IS NOT DISTINCT FROM f.video_id AND r.t <= f.ts"""


SQL["frame_seek_times"] = _seek_sql(f"(p.i + 0.5) * d.duration / {q.TIMES_N}.0")
SQL["frame_linspace_times"] = _seek_sql(f"p.i * d.duration / {q.TIMES_N - 1}.0")

_KN = q.KEYFRAME_N
SQL["frame_sample_keyframes"] = f"""
WITH RECURSIVE {CFRAMES},
visited AS (
  SELECT f.video_id, f.frame_idx, f.pixels, s.total_frames,
         lag(f.pixels) OVER (PARTITION BY f.video_id ORDER BY f.frame_idx) AS prev
  FROM cframes f JOIN sizes s USING (video_id)
  WHERE f.frame_idx >= greatest(1, s.total_frames // {3 * _KN})
    AND f.frame_idx % greatest(1, s.total_frames // {3 * _KN}) = 0),
scored AS (
  SELECT video_id, frame_idx, total_frames,
         CASE WHEN prev IS NOT NULL THEN
           list_sum([0.299 * abs(pixels[3*j+3] - prev[3*j+3]) + 0.587 * abs(pixels[3*j+2] - prev[3*j+2])
                     + 0.114 * abs(pixels[3*j+1] - prev[3*j+1]) FOR j IN range(0, 22)]) / 22.0 END AS change
  FROM visited),
kept AS (
  SELECT video_id, frame_idx, change,
         row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k
  FROM scored WHERE change > 30.0),
picked AS (
  SELECT video_id, CAST(0 AS BIGINT) AS sample_pos, CAST(0 AS BIGINT) AS frame_idx, 'first' AS kind, CAST(NULL AS DOUBLE) AS change FROM sizes
  UNION ALL
  SELECT video_id, CAST(k AS BIGINT), frame_idx, 'change', change FROM kept WHERE k <= {_KN - 1}),
tail AS (
  SELECT p.video_id, max(p.sample_pos) AS last_pos, max(p.frame_idx) AS last_idx, s.total_frames
  FROM picked p JOIN sizes s USING (video_id) GROUP BY p.video_id, s.total_frames),
fill(video_id, sample_pos, frame_idx, total_frames) AS (
  SELECT video_id, last_pos + 1, last_idx + total_frames // {_KN}, total_frames FROM tail
  WHERE last_pos + 1 < {_KN} AND last_idx + total_frames // {_KN} < total_frames
  UNION ALL
  SELECT video_id, sample_pos + 1, frame_idx + total_frames // {_KN}, total_frames FROM fill
  WHERE sample_pos + 1 < {_KN} AND frame_idx + total_frames // {_KN} < total_frames)
SELECT video_id, sample_pos, frame_idx, kind, {r6("change")} AS change FROM picked
UNION ALL
SELECT video_id, sample_pos, frame_idx, 'fill', NULL FROM fill"""


ANALYSES = """
analyses AS (
  SELECT user_id AS video_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx,
         event_id, event_type <> 'error' AS success,
         CASE WHEN event_type <> 'error' THEN event_type || ' ' || props END AS description,
         CASE WHEN event_type = 'error' THEN 'Processing error: ' || props END AS error,
         value AS processing_time, event_type AS model_used
  FROM events)"""

LONG = """
long_analyses AS (
  SELECT d.source AS video_id,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) - 1 AS BIGINT) AS frame_idx,
         d.doc_id, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS success,
         d.text AS description
  FROM documents d)"""

LEDGER = """
led AS (
  SELECT event_id AS seq, event_type AS tag,
         CASE WHEN event_id % 2 = 0 THEN 'alloc' ELSE 'dealloc' END AS op,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 1024 AS bytes
  FROM events)"""

RESULTS = """
results AS (
  SELECT 'video_' || CAST(user_id AS VARCHAR) || '.mp4' AS path, event_id AS seq, value % 1 AS confidence,
         event_type <> 'error' AS success, event_type AS model_used, value AS processing_time
  FROM events)"""

WS = "[ \\t\\n\\r\\f\\x0B]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


COLOR_BRIGHT = ("list_sum([0.299 * pixels[3*j+3] + 0.587 * pixels[3*j+2] + 0.114 * pixels[3*j+1] "
                "FOR j IN range(0, 22)]) / 22.0")

HIST = f"""
codes AS (SELECT video_id, frame_idx,
                 unnest(list_transform(pixels, lambda x, k: CAST(((k - 1) % 3) * 32 + x // 8 AS INTEGER))) AS code
          FROM cframes),
cnt AS (SELECT video_id, frame_idx, code, count(*) AS n FROM codes GROUP BY ALL),
ent AS (SELECT video_id, frame_idx, sum(-(n / 22.0) * log2(n / 22.0)) AS entropy FROM cnt GROUP BY ALL)"""

SQL["frame_color_entropy"] = f"""
WITH {CFRAMES}, {HIST}
SELECT f.video_id, f.frame_idx, {r6("e.entropy")} AS entropy, {r6(COLOR_BRIGHT.replace("pixels", "f.pixels"))} AS brightness
FROM cframes f JOIN ent e USING (video_id, frame_idx)"""

SQL["frame_histogram"] = f"""
WITH {CFRAMES}, {HIST}
SELECT video_id, frame_idx, CAST(code // 32 AS INTEGER) AS channel, CAST(code % 32 AS INTEGER) AS bin,
       CAST(n AS BIGINT) AS count
FROM cnt"""

# Edge density per frame in whole numbers: needs RECURSIVE, cframes.
GRAY8 = "(({b} * 3735 + {g} * 19235 + {r} * 9798 + 16384) >> 15)"
CANNY = f"""
cell AS (SELECT y, x FROM range(0, 2) a(y), range(0, 11) b(x)),
gray AS (SELECT vec_id, y, x, {GRAY8.format(b="CAST(pixels[(y * 11 + x) * 3 + 1] AS BIGINT)", g="pixels[(y * 11 + x) * 3 + 2]",
                                            r="pixels[(y * 11 + x) * 3 + 3]")} AS g FROM cframes, cell),
rows3 AS (SELECT vec_id, y, list(g ORDER BY x) AS l FROM gray GROUP BY vec_id, y),
imgs AS (SELECT vec_id, list(l ORDER BY y) AS i FROM rows3 GROUP BY vec_id),
nb AS (SELECT vec_id, y, x, i[greatest(y, 1)] AS u, i[y + 1] AS m, i[least(y + 2, 2)] AS d,
              greatest(x, 1) AS w, x + 1 AS o, least(x + 2, 11) AS e FROM imgs, cell),
sob AS (SELECT vec_id, y, x, (u[e] + 2 * m[e] + d[e]) - (u[w] + 2 * m[w] + d[w]) AS gx,
               (d[w] + 2 * d[o] + d[e]) - (u[w] + 2 * u[o] + u[e]) AS gy FROM nb),
mag AS (SELECT *, abs(gx) + abs(gy) AS mg, abs(gy) * 32768 AS rise, abs(gx) * 13573 AS flat FROM sob),
dirs AS (SELECT *, CASE WHEN rise < flat THEN 0 ELSE 1 END AS dy,
                CASE WHEN rise < flat THEN 1 WHEN rise > flat + abs(gx) * 65536 THEN 0 WHEN (gx < 0) <> (gy < 0) THEN -1 ELSE 1 END AS dx FROM mag),
peak AS (SELECT a.vec_id, a.y, a.x, a.mg FROM dirs a
         LEFT JOIN mag p ON p.vec_id = a.vec_id AND p.y = a.y - a.dy AND p.x = a.x - a.dx
         LEFT JOIN mag q ON q.vec_id = a.vec_id AND q.y = a.y + a.dy AND q.x = a.x + a.dx
         WHERE a.mg > coalesce(p.mg, 0) AND a.mg > {CANNY_LOW}
           AND (a.mg > coalesce(q.mg, 0) OR a.mg = coalesce(q.mg, 0) AND NOT (a.dy = 1 AND a.dx <> 0))),
edge AS (SELECT vec_id, y, x FROM peak WHERE mg > {CANNY_HIGH}
         UNION
         SELECT k.vec_id, k.y, k.x FROM edge e JOIN peak k ON k.vec_id = e.vec_id AND abs(k.y - e.y) <= 1 AND abs(k.x - e.x) <= 1),
dens AS (SELECT vec_id, count(*) / 22.0 AS edge_density FROM edge GROUP BY vec_id)"""


def places(axis: str, size: int, out: int) -> str:
    """Source places and 11-bit weights of every output place along x (beyond the outer centres the edge alone) or y."""
    beyond = f"low < 0 OR low >= {size - 1}" if axis == "x" else "false"
    return f"""
{axis}s AS (
  SELECT {axis}, least(greatest(low, 0), {size - 1}) AS {axis}0, least(greatest({"least(greatest(low, 0), %d)" % (size - 1) if axis == "x" else "low"} + 1, 0), {size - 1}) AS {axis}1,
         CAST(round_even((1 - part) * 2048, 0) AS BIGINT) AS {axis}a, CAST(round_even(part * 2048, 0) AS BIGINT) AS {axis}b
  FROM (SELECT {axis}, low, CASE WHEN {beyond} THEN 0.0 ELSE pt - low END AS part
        FROM (SELECT {axis}, pt, CAST(floor(pt) AS BIGINT) AS low
              FROM (SELECT {axis}, ({axis} + 0.5) * ({size}.0 / {out}) - 0.5 AS pt FROM range(0, {out}) t({axis})))))"""


def down(top: str, bottom: str) -> str:
    """The level of two intermediate sums."""
    return f"((({top} * ya) >> 16) + (({bottom} * yb) >> 16) + 2) >> 2"


def across(row: str, px: str = "f.pixels") -> str:
    return f"(({px}[({row} * 11 + x0) * 3 + c + 1] * xa + {px}[({row} * 11 + x1) * 3 + c + 1] * xb) >> 4)"


RESIZED = f"""{places("y", 2, 6)},{places("x", 11, 14)},
px AS (SELECT f.video_id, f.frame_idx, f.vec_id, y, x, c, {down(across("y0"), across("y1"))} AS v
       FROM cframes f, ys, xs, range(0, 3) t3(c))"""

SQL["frame_features_color"] = f"""
WITH RECURSIVE {CFRAMES}, {HIST}, {CANNY},
samp AS (
  SELECT s.video_id, p.i AS sample_pos,
         CAST(trunc((CAST(p.i AS DOUBLE) / 15) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(16)} p),
sf AS (
  SELECT m.video_id, m.sample_pos, f.pixels, e.entropy, coalesce(d.edge_density, 0.0) AS edge,
         list_transform(range(0, 22), lambda j: 0.299 * f.pixels[3*j+3] + 0.587 * f.pixels[3*j+2] + 0.114 * f.pixels[3*j+1]) AS gray
  FROM samp m JOIN cframes f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx
  JOIN ent e ON e.video_id = m.video_id AND e.frame_idx = m.frame_idx
  LEFT JOIN dens d ON d.vec_id = f.vec_id),
lagged AS (SELECT *, lag(gray) OVER (PARTITION BY video_id ORDER BY sample_pos) AS prev FROM sf),
per AS (
  SELECT video_id, {COLOR_BRIGHT} AS brightness, entropy, edge,
         CASE WHEN prev IS NULL THEN 0.0
              ELSE list_sum(list_transform(gray, lambda g, k: abs(g - prev[k]))) / 22.0 END AS motion
  FROM lagged),
agg AS (
  SELECT video_id, count(*) AS n, sum(brightness) / (count(*) * 255.0) AS b,
         CASE WHEN count(*) > 1 THEN sum(motion) / ((count(*) - 1) * 255.0) END AS m,
         sum(entropy) / count(*) AS e, sum(edge) / count(*) AS d
  FROM per GROUP BY video_id)
SELECT video_id, CAST(n AS BIGINT) AS n_frames,
       list_transform([b, m, e, d, (e + d) / 2, m, b, n / 32.0], lambda x: {r6("x")}) AS features
FROM agg"""

SQL["frame_chunks"] = f"""
WITH {FRAMES}
SELECT video_id, frame_idx // 3 AS chunk, count(*) AS n_frames, min(frame_idx) AS first_idx,
       max(frame_idx) AS last_idx, {r6("avg(list_sum(pixels) / len(pixels))")} AS brightness
FROM frames GROUP BY video_id, frame_idx // 3"""

SQL["frame_rank"] = f"""
WITH {FRAMES}
SELECT f.video_id, f.frame_idx, 'Frame ' || CAST(f.frame_idx + 1 AS VARCHAR) AS label,
       CAST(f.frame_idx + 1 AS VARCHAR) || ' of ' || CAST(s.total_frames AS VARCHAR) AS of_n,
       {r6("f.frame_idx / 10.0")} AS ts
FROM frames f JOIN sizes s USING (video_id)"""

SQL["video_catalog"] = f"""
WITH {FRAMES}
SELECT video_id, total_frames, 10.0::DOUBLE AS fps, {r6("total_frames / 10.0")} AS duration,
       8::INTEGER AS width, 8::INTEGER AS height, 'MJPG' AS codec
FROM sizes"""

SQL["frame_memory"] = f"""
WITH {FRAMES}
SELECT video_id, count(*) AS frames, CAST(sum(2 * 11 * 3) AS BIGINT) AS bytes FROM frames GROUP BY video_id"""

SQL["frame_content"] = f"""
WITH {FRAMES}
SELECT video_id, frame_idx,
       list_bool_or(list_transform(pixels, lambda x: x > 0)) AND list_bool_and(list_transform(pixels, lambda x: x BETWEEN 0 AND 255)) AS content_ok,
       CAST(len(pixels) AS INTEGER) AS n_values,
       {r6("list_sum(list_transform(pixels, lambda x: CAST(CAST(x AS FLOAT) * CAST(1.0 / 255.0 AS FLOAT) AS DOUBLE)))")} AS norm_sum
FROM frames"""

SQL["fit_dimensions"] = """
WITH o AS (SELECT o_orderkey, CAST(o_custkey % 1080 + 1 AS INTEGER) AS h, CAST(o_orderkey % 1920 + 1 AS INTEGER) AS w FROM orders)
SELECT o_orderkey, h, w,
       CAST(trunc(w * (CAST(384 AS DOUBLE) / greatest(h, w))) AS INTEGER) AS new_w,
       CAST(trunc(h * (CAST(384 AS DOUBLE) / greatest(h, w))) AS INTEGER) AS new_h
FROM o"""

SQL["batch_assignment"] = """
WITH p AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos,
                  count(*) OVER () AS n FROM orders),
s AS (SELECT *, CAST(greatest(least(4, 2, n), 1) AS BIGINT) AS batch_size FROM p)
SELECT o_orderkey, pos, batch_size, pos // batch_size AS batch_id, pos % 4 AS device FROM s"""

# Clamped running total computed the plain sequential way (recursive CTE).
SQL["ledger_running"] = f"""
WITH RECURSIVE {LEDGER},
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn,
                    CASE WHEN op = 'alloc' THEN bytes ELSE -bytes END AS x FROM led),
walk(rn, total) AS (
  SELECT rn, greatest(0, x) FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.rn, greatest(0, w.total + n.x) FROM walk w JOIN numbered n ON n.rn = w.rn + 1)
SELECT n.seq, n.tag, n.op, n.bytes, CAST(w.total AS BIGINT) AS total,
       CAST(greatest(0, max(w.total) OVER (ORDER BY n.seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS peak,
       w.total + {q.LEDGER_REQUIRED} <= {q.LEDGER_LIMIT} AS admit
FROM numbered n JOIN walk w USING (rn)"""

LEDGER_TAG_WALK = f"""
WITH RECURSIVE {LEDGER},
numbered AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS rn,
                    count(*) OVER (PARTITION BY tag) AS cnt FROM led),
walk(tag, rn, present, val) AS (
  SELECT tag, rn, op = 'alloc', CASE WHEN op = 'alloc' THEN bytes ELSE 0 END FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.tag, n.rn,
         CASE WHEN n.op = 'alloc' THEN true
              WHEN NOT w.present THEN false
              ELSE greatest(0, w.val - n.bytes) > 0 END,
         CASE WHEN n.op = 'alloc' THEN w.val + n.bytes
              WHEN NOT w.present THEN w.val
              ELSE greatest(0, w.val - n.bytes) END
  FROM walk w JOIN numbered n ON n.tag = w.tag AND n.rn = w.rn + 1),
final AS (SELECT w.tag, CAST(w.val AS BIGINT) AS bytes FROM walk w JOIN numbered n USING (tag, rn)
          WHERE n.rn = n.cnt AND w.present)"""

SQL["ledger_by_tag"] = LEDGER_TAG_WALK + "\nSELECT tag, bytes FROM final"

SQL["ledger_report"] = LEDGER_TAG_WALK + """
SELECT tag, bytes, bytes // 1048576 AS mb FROM final
UNION ALL
SELECT '__total__', CAST(coalesce(sum(bytes), 0) AS BIGINT), CAST(coalesce(sum(bytes), 0) // 1048576 AS BIGINT) FROM final"""


def _cpu_summary(src: str) -> str:
    d = strip("coalesce(description, '')")
    return f"""
parts AS (
  SELECT video_id, count(*) FILTER (WHERE success) AS n_success,
         count(*) FILTER (WHERE success AND length({d}) > 0 AND {d} <> 'No description available') AS n_mean,
         arg_max({d}, struct_pack(l := length({d}), f := -frame_idx))
           FILTER (WHERE success AND length({d}) > 0 AND {d} <> 'No description available') AS longest
  FROM {src} GROUP BY video_id),
summ AS (
  SELECT video_id,
         CASE WHEN n_success = 0 THEN 'No frames were successfully analyzed.'
              WHEN n_mean = 0 THEN 'Video analysis completed but no meaningful descriptions were generated.'
              ELSE 'Video analysis of ' || CAST(n_success AS VARCHAR) || ' frames completed. ' ||
                   CASE WHEN length(longest) > 50 THEN 'Primary content: ' || longest
                        ELSE 'Video contains visual content that was analyzed frame by frame.' END END AS summary
  FROM parts)"""


SQL["video_rollup"] = f"""
WITH {ANALYSES}, {_cpu_summary("analyses")}
SELECT a.video_id, bool_or(a.success) AS success, count(*) FILTER (WHERE a.success) AS frames_analyzed,
       count(*) AS total_frames_extracted, round(sum(a.processing_time), 2) AS total_processing_time,
       arg_min(a.model_used, a.frame_idx) AS model_used, s.summary
FROM analyses a JOIN summ s USING (video_id) GROUP BY a.video_id, s.summary"""

SQL["batch_stats"] = f"""
WITH {ANALYSES},
v AS (SELECT video_id, bool_or(success) AS success, round(sum(processing_time), 2) AS t FROM analyses GROUP BY video_id),
s AS (SELECT count(*) AS total, count(*) FILTER (WHERE success) AS successful,
             coalesce(sum(t) FILTER (WHERE success), 0.0) AS tt FROM v)
SELECT total, successful, total - successful AS failed, {r6("tt")} AS total_time,
       {r6("CASE WHEN successful > 0 THEN tt / successful ELSE 0.0 END")} AS avg_per_success,
       {r6("successful / total")} AS success_ratio, successful = total AS all_passed,
       (successful * 100) // total AS pass_rate,
       CASE WHEN successful = total THEN 'all' WHEN (successful * 100) // total >= 80 THEN 'mostly' ELSE 'attention' END AS grade
FROM s"""

SQL["batch_dedupe"] = f"""
WITH {RESULTS}
SELECT path, max(seq) AS seq, {r6("arg_max(confidence, seq)")} AS confidence,
       arg_max(success, seq) AS success, arg_max(model_used, seq) AS model_used
FROM results GROUP BY path"""

SQL["throughput_stats"] = f"""
WITH {ANALYSES}, {RESULTS},
a AS (SELECT count(*) AS frames, sum(processing_time) AS elapsed, count(DISTINCT video_id) AS videos FROM analyses),
c AS (SELECT avg(confidence) AS mc FROM (SELECT arg_max(confidence, seq) AS confidence FROM results GROUP BY path))
SELECT frames, videos, {r6("frames / elapsed")} AS frames_per_sec, {r6("elapsed / videos")} AS sec_per_video,
       {r6("mc")} AS mean_confidence
FROM a, c"""

SQL["latency_profile"] = f"""
WITH {ANALYSES}
SELECT model_used, count(*) AS frames, {r6("avg(processing_time)")} AS avg_time,
       {r6("quantile_cont(processing_time, 0.95)")} AS p95_time,
       {r6("quantile_cont(processing_time, 0.99)")} AS p99_time,
       {r6("avg(CAST(success AS DOUBLE))")} AS success_rate,
       {r6("count(*) / sum(processing_time)")} AS frames_per_sec
FROM analyses GROUP BY model_used"""

SQL["observation_text"] = f"""
WITH {LONG}
SELECT video_id, min(frame_idx) AS first_frame,
       string_agg({strip("coalesce(description, '')")}, ' | ' ORDER BY frame_idx) AS text
FROM long_analyses WHERE success GROUP BY video_id"""

SQL["fallback_summary_cpu"] = f"""
WITH {LONG}, {_cpu_summary("long_analyses")}
SELECT video_id, summary FROM summ"""

SQL["fallback_summary_gpu"] = f"""
WITH {LONG},
parts AS (
  SELECT video_id, count(*) FILTER (WHERE success) AS n_success,
         count(*) FILTER (WHERE success AND length(coalesce(description, '')) > 10) AS n_mean,
         arg_max(description, struct_pack(l := length(description), f := -frame_idx))
           FILTER (WHERE success AND length(coalesce(description, '')) > 10) AS longest
  FROM long_analyses GROUP BY video_id)
SELECT video_id,
       CASE WHEN n_success = 0 THEN 'No frames were successfully analyzed.'
            WHEN n_mean = 0 THEN 'GPU-analyzed video with ' || CAST(n_success AS VARCHAR) || ' frames processed successfully.'
            ELSE 'GPU-analyzed video with ' || CAST(n_success AS VARCHAR) || ' frames processed successfully. ' ||
                 CASE WHEN length(longest) > 50 THEN 'Primary content: ' || longest
                      ELSE 'Video contains visual content analyzed via GPU acceleration.' END END AS summary
FROM parts"""

_THEMES = {
    "person": ["person", "people", "man", "woman", "individual"],
    "action": ["showing", "demonstrating", "performing", "doing", "using"],
    "object": ["object", "item", "tool", "device", "equipment"],
    "setting": ["room", "indoor", "outdoor", "background", "environment"],
}


def _theme_cond(kws):
    d = strip("coalesce(description, '')")
    return " OR ".join(f"contains(lower({d}), '{k}')" for k in kws)


SQL["theme_tags"] = f"""
WITH {LONG},
m AS (SELECT * FROM long_analyses
      WHERE success AND length({strip("coalesce(description, '')")}) > 0
        AND {strip("coalesce(description, '')")} <> 'No description available'),
t AS (SELECT v.video_id,
             {", ".join(f"coalesce(bool_or({_theme_cond(k)}), false) AS {n}" for n, k in _THEMES.items())}
      FROM (SELECT DISTINCT video_id FROM long_analyses) v LEFT JOIN m USING (video_id) GROUP BY v.video_id)
SELECT video_id, list_filter([{", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in _THEMES)}], lambda x: x IS NOT NULL) AS themes
FROM t"""


def words_sql(col: str) -> str:
    return f"list_filter(regexp_split_to_array({col}, '{WS}+'), lambda w: w <> '')"


VOCAB = f"""
vwords AS (SELECT unnest({words_sql("text")}) AS token FROM benchmark),
vocab AS (
  SELECT token, CAST(999 + row_number() OVER (ORDER BY freq DESC, token) AS BIGINT) AS id
  FROM (SELECT token, count(*) AS freq FROM vwords WHERE NOT regexp_full_match(token, '[a-z]') GROUP BY token)
  UNION ALL
  SELECT chr(CAST(96 + i AS INTEGER)), CAST(i AS BIGINT) FROM range(1, 27) t(i))"""

TOKENIZE = VOCAB + f""",
dwords AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS wpos
           FROM (SELECT doc_id, {words_sql("text")} AS ws FROM documents)),
misses AS (SELECT DISTINCT d.word FROM dwords d LEFT JOIN vocab v ON v.token = d.word WHERE v.id IS NULL),
cmap AS (SELECT token, min(id) AS id FROM vocab WHERE length(token) = 1 AND ascii(token) < 128 GROUP BY token),
wchars AS (SELECT word, unnest(string_split(word, '')) AS ch, generate_subscripts(string_split(word, ''), 1) AS cpos FROM misses),
cids AS (SELECT c.word, c.cpos,
                CASE WHEN ascii(c.ch) < 128 THEN [CAST(coalesce(m.id, 100) AS BIGINT)]
                     ELSE list_transform(range(strlen(c.ch)), lambda b: CAST(100 AS BIGINT)) END AS ids
         FROM wchars c LEFT JOIN cmap m ON m.token = c.ch),
fallback AS (SELECT word, flatten(list(ids ORDER BY cpos)) AS ids FROM cids GROUP BY word),
placed AS (SELECT d.doc_id, d.wpos, coalesce(CASE WHEN v.id IS NOT NULL THEN [v.id] END, f.ids) AS ids
           FROM dwords d LEFT JOIN vocab v ON v.token = d.word LEFT JOIN fallback f ON f.word = d.word),
per_doc AS (SELECT doc_id, flatten(list(ids ORDER BY wpos)) AS ids FROM placed GROUP BY doc_id),
tok AS (SELECT doc.doc_id,
               CASE WHEN len(coalesce(p.ids, [])) > 0 THEN list_prepend(CAST(151643 AS BIGINT), p.ids)
                    ELSE CAST([] AS BIGINT[]) END AS input_ids
        FROM documents doc LEFT JOIN per_doc p USING (doc_id))"""

SQL["vocab_table"] = f"WITH {VOCAB}\nSELECT token, id FROM vocab"

SQL["token_lookup"] = f"""
WITH {VOCAB},
special AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {i})" for i, t in SPECIAL_TEXT.items())}) x(token, id)),
w AS (SELECT DISTINCT unnest({words_sql("text")}) AS token
      FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark)
      UNION SELECT token FROM special),
i AS (SELECT w.token, CAST(coalesce(s.id, v.id, -1) AS BIGINT) AS token_id
      FROM w LEFT JOIN special s USING (token) LEFT JOIN vocab v ON v.token = w.token)
SELECT i.token, i.token_id, coalesce(s.token, v.token) AS back
FROM i LEFT JOIN special s ON s.id = i.token_id LEFT JOIN vocab v ON v.id = i.token_id"""

SQL["tokenize_docs"] = f"""
WITH {TOKENIZE}
SELECT doc_id, CAST(len(input_ids) AS BIGINT) AS n_tokens, input_ids FROM tok"""


def fallback_ids(col: str) -> str:
    return (f"CAST(list_transform(list_filter(string_split({col}, ''), lambda ch: ascii(ch) BETWEEN 32 AND 126), "
            f"lambda ch: CASE WHEN ch = ' ' THEN 220 ELSE ascii(ch) + 1000 END) AS BIGINT[])")


SQL["tokenize_fallback"] = f"SELECT doc_id, {fallback_ids('text')} AS ids FROM documents"


def signed_bytes_sql(col: str) -> str:
    return (f"CAST(list_transform(regexp_extract_all(hex(encode({col})), '..'), "
            f"lambda x: CASE WHEN CAST('0x' || x AS INTEGER) >= 128 THEN CAST('0x' || x AS INTEGER) - 256 "
            f"ELSE CAST('0x' || x AS INTEGER) END) AS BIGINT[])")


SQL["token_padding"] = f"""
WITH c AS (SELECT conv_id, turn, {fallback_ids('text')} AS fb, {signed_bytes_sql('text')} AS b FROM conversations),
a AS (SELECT *, list_transform(b, lambda x: CASE WHEN x BETWEEN 32 AND 126 THEN x ELSE 32 END) AS asc16 FROM c)
SELECT conv_id, turn,
       list_concat(fb, list_transform(range(1024), lambda i: CAST(220 AS BIGINT)))[1:1024] AS padded_1024,
       CAST(least(len(fb), 2048) AS INTEGER) AS n_2048,
       CAST(least(len(b), 4096) AS INTEGER) AS n_4096,
       list_concat(asc16, list_transform(range(greatest(0, 16 - len(asc16))), lambda i: CAST(32 AS BIGINT))) AS ascii_16,
       list_concat(b, list_transform(range(512), lambda i: CAST(0 AS BIGINT)))[1:512] AS bytes_512,
       CAST(len(b) AS INTEGER) AS n_bytes, CAST(coalesce(list_sum(b), 0) AS BIGINT) AS bytes_sum
FROM a"""

_SPECIALS = "[151643, 151645, 151655, 151656, 151652, 151653, 151654]"
_SPECIAL_TEXT = ("CASE {x} WHEN 151643 THEN '<|endoftext|>' WHEN 151645 THEN '<|im_end|>' "
                 "WHEN 151655 THEN '<|image|>' WHEN 151656 THEN '<|video|>' WHEN 151652 THEN '<|vision_start|>' "
                 "WHEN 151653 THEN '<|vision_end|>' WHEN 151654 THEN '<|vision|>' END")

SQL["detokenize_docs"] = f"""
WITH {TOKENIZE},
ex AS (SELECT doc_id, unnest(input_ids) AS tid, generate_subscripts(input_ids, 1) AS ipos FROM tok),
rev AS (SELECT id, min(token) AS token FROM vocab GROUP BY id),
pieces AS (
  SELECT e.doc_id, e.ipos, r.token IS NOT NULL AS from_vocab,
         coalesce(r.token, {_SPECIAL_TEXT.format(x="e.tid")},
                  CASE WHEN e.tid >= 0 AND e.tid < 50000 THEN '[' || CAST(e.tid AS VARCHAR) || ']' ELSE '<unk>' END) AS piece
  FROM ex e LEFT JOIN rev r ON r.id = e.tid
  WHERE NOT list_contains({_SPECIALS}, e.tid)),
flags AS (
  SELECT *, from_vocab AND starts_with(piece, 'Ġ') AS bpe,
         CASE WHEN from_vocab AND starts_with(piece, 'Ġ') THEN length(piece) > 1 ELSE length(piece) > 0 END AS writes
  FROM pieces),
firsts AS (SELECT *, min(ipos) FILTER (WHERE writes) OVER (PARTITION BY doc_id) AS first_w FROM flags),
folded AS (
  SELECT doc_id,
         string_agg(CASE WHEN bpe THEN (CASE WHEN first_w IS NOT NULL AND ipos > first_w THEN ' ' ELSE '' END) || substr(piece, 2)
                         ELSE piece END, '' ORDER BY ipos) AS raw
  FROM firsts GROUP BY doc_id),
dec AS (SELECT t.doc_id, regexp_replace(regexp_replace(coalesce(f.raw, ''), '^ +', ''), ' +', ' ', 'g') AS text
        FROM tok t LEFT JOIN folded f USING (doc_id))
SELECT d.doc_id, d.text,
       CAST(len(list_filter(t.input_ids, lambda x: list_contains({_SPECIALS}, x))) AS INTEGER) AS n_special,
       CAST(len(list_filter(t.input_ids, lambda x: NOT list_contains({_SPECIALS}, x))) AS INTEGER) AS n_plain,
       {_SPECIAL_TEXT.format(x="t.input_ids[1]")} AS first_special
FROM dec d JOIN tok t USING (doc_id)"""

CHAT_PARTS = """
cparts AS (
  SELECT conv_id, turn, role, 0 AS ppos, 'image' AS kind, CAST(NULL AS VARCHAR) AS text FROM conversations
  WHERE role = 'user' AND (conv_id + turn) % 3 = 0
  UNION ALL
  SELECT conv_id, turn, role, 1, 'video', NULL FROM conversations WHERE role = 'user' AND (conv_id + turn) % 4 = 0
  UNION ALL
  SELECT conv_id, turn, role, 2, 'text', text FROM conversations)"""

SQL["chat_template"] = f"""
WITH {CHAT_PARTS},
numbered AS (
  SELECT *, sum(CASE WHEN role = 'user' AND kind = 'image' THEN 1 ELSE 0 END) OVER w AS image_no,
            sum(CASE WHEN role = 'user' AND kind = 'video' THEN 1 ELSE 0 END) OVER w AS video_no
  FROM cparts WINDOW w AS (PARTITION BY conv_id ORDER BY turn, ppos ROWS UNBOUNDED PRECEDING)),
pieces AS (
  SELECT conv_id, turn, role, ppos,
         CASE WHEN role <> 'user' THEN coalesce(text, '')
              WHEN kind = 'text' THEN coalesce(text, '')
              WHEN kind = 'image' THEN 'Picture ' || CAST(image_no AS VARCHAR) || ': <|vision_start|><|image_pad|><|vision_end|>'
              ELSE 'Video ' || CAST(video_no AS VARCHAR) || ': <|vision_start|><|video_pad|><|vision_end|>' END AS piece
  FROM numbered),
turns AS (
  SELECT conv_id, turn, role, string_agg(piece, '' ORDER BY ppos) AS body FROM pieces GROUP BY conv_id, turn, role),
wrapped AS (
  SELECT conv_id, turn,
         CASE role WHEN 'system' THEN '<|im_start|>system' || chr(10) || body || '<|im_end|>' || chr(10)
                   WHEN 'user' THEN '<|im_start|>user' || chr(10) || body || '<|im_end|>' || chr(10)
                   WHEN 'assistant' THEN '<|im_start|>assistant' || chr(10) || body || '<|im_end|>' || chr(10) END AS w
  FROM turns),
conv AS (SELECT conv_id, coalesce(bool_or(role = 'system'), false) AS has_sys FROM conversations GROUP BY conv_id)
SELECT c.conv_id,
       CASE WHEN NOT c.has_sys
            THEN '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) ELSE '' END
       || coalesce(string_agg(w.w, '' ORDER BY w.turn) FILTER (WHERE w.w IS NOT NULL), '')
       || '<|im_start|>assistant' || chr(10) AS text
FROM conv c LEFT JOIN wrapped w ON w.conv_id = c.conv_id
GROUP BY c.conv_id, c.has_sys"""

NL = "chr(10)"


def _rep(s: str, n: str) -> str:
    return f"repeat('{s}', greatest({n}, 0))"


SQL["vision_prompts"] = f"""
WITH c AS (SELECT conv_id, turn, role, text, turn % 4 AS n_img, conv_id % 3 AS n_vid FROM conversations)
SELECT conv_id, turn,
       {_rep('<|vision_start|><|image_pad|><|vision_end|>', 'n_img')} || {_rep('<|vision_start|><|video_pad|><|vision_end|>', 'n_vid')} || text AS vision_prompt,
       '<|im_start|>system' || {NL} || 'You are a helpful assistant that describes video content in detail.<|im_end|>' || {NL}
         || '<|im_start|>user' || {NL} || {_rep('<|vision_start|><|image_pad|><|vision_end|>', 'n_img + n_vid')}
         || {NL} || {NL} || 'Please describe what you see in this video in detail. Focus on:' || {NL}
         || '- Objects and people present' || {NL} || '- Actions and activities' || {NL}
         || '- Scene setting and environment' || {NL} || '- Any interesting details' || {NL} || {NL}
         || 'Video description:<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL} AS video_chat,
       '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || {NL} || {NL}
         || 'You are a helpful AI assistant that can analyze videos and describe their content in detail.<|eot_id|>'
         || '<|start_header_id|>user<|end_header_id|>' || {NL} || {NL} || {_rep('<|image|>', 'n_img + n_vid')}
         || {NL} || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {NL} || {NL} AS llama_prompt,
       'Describe this image in detail. ' || role AS describe,
       'Analyze the content of this image/video and ' || role AS analysis,
       'Extract ' || role || ' from this image/video.' AS extraction,
       'Describe this video: ' || role AS multipart,
       CASE role WHEN 'system' THEN '<|im_start|>system' || {NL} || text || '<|im_end|>' || {NL}
                 WHEN 'user' THEN '<|im_start|>user' || {NL} || text || '<|im_end|>' || {NL}
                 WHEN 'assistant' THEN '<|im_start|>assistant' || {NL} || text || '<|im_end|>' || {NL}
                 ELSE text END AS chat_message,
       CASE WHEN role = 'system' OR coalesce(text, '') = '' THEN
         {NL} || '            Analyze this video sequence and provide:' || {NL}
         || '            1. A detailed description of what''s happening' || {NL}
         || '            2. Key objects and people identified  ' || {NL}
         || '            3. Actions and activities taking place' || {NL}
         || '            4. Scene context and environment' || {NL}
         || '            5. Any notable events or changes over time' || {NL}
         || '            ' || {NL}
         || '            Be specific and comprehensive in your analysis.' || {NL} || '        '
         ELSE text END AS prompt,
       'Placeholder analysis of ' || CAST(n_img + n_vid AS VARCHAR) || ' frames: ' ||
         CASE WHEN contains(text, 'detailed') THEN 'Detailed scene analysis with multiple objects and activities detected. '
              ELSE 'Basic scene analysis with recognizable elements. ' END AS placeholder,
       CASE WHEN n_img + n_vid > 12 THEN 'Extended sequence - comprehensive scene analysis'
            WHEN n_img + n_vid > 8 THEN 'Medium sequence - moderate scene coverage'
            ELSE 'Short sequence - focused scene analysis' END AS scene,
       CAST(flatten(list_transform(range(n_img), lambda i: [151652, 151655, 151653])
                    || list_transform(range(n_vid), lambda i: [151652, 151656, 151653])) AS BIGINT[]) AS vision_ids
FROM c"""

SQL["model_inputs"] = f"""
WITH c AS (SELECT conv_id, turn, text, turn % 4 AS n_img, conv_id % 3 AS n_vid FROM conversations),
ids AS (SELECT conv_id, turn,
               (CAST(flatten(list_transform(range(n_img), lambda i: [151652, 151655, 151653])
                             || list_transform(range(n_vid), lambda i: [151652, 151656, 151653])) AS BIGINT[])
                || {fallback_ids('text')})[1:2048] AS input_ids
        FROM c)
SELECT conv_id, turn, input_ids, CAST(len(input_ids) AS BIGINT) AS sequence_length,
       CAST(len(input_ids) AS INTEGER) AS mask_len,
       CAST(list_filter(list_transform(input_ids, lambda x, i: CASE WHEN x = 151655 THEN i - 1 END), lambda x: x IS NOT NULL) AS BIGINT[]) AS image_positions,
       CAST(list_filter(list_transform(input_ids, lambda x, i: CASE WHEN x = 151656 THEN i - 1 END), lambda x: x IS NOT NULL) AS BIGINT[]) AS video_positions,
       CAST(len(input_ids) AS DOUBLE) AS mask_sum,
       CAST(2 * len(input_ids) AS INTEGER) AS batched_len,
       CAST(len(list_filter(input_ids, lambda x: x IN (151655, 151656))) AS BIGINT) AS mrope_delta,
       CAST(3 * len(input_ids) AS INTEGER) AS pos3d_len
FROM ids"""

SQL["placeholder_analysis"] = """
WITH g AS (SELECT conv_id, count(*) AS n, arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS prompt
           FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, n, CASE WHEN coalesce(prompt, '') = '' THEN 'default' ELSE prompt END AS prompt FROM g)
SELECT conv_id, n,
       'Placeholder analysis of ' || CAST(n AS VARCHAR) || ' frames: ' ||
         CASE WHEN contains(prompt, 'detailed') THEN 'Detailed scene analysis with multiple objects and activities detected. '
              ELSE 'Basic scene analysis with recognizable elements. ' END AS description,
       ['person', 'object', 'background', 'furniture'] AS objects,
       ['walking', 'sitting', 'interacting', 'moving'] AS actions,
       CASE WHEN n > 12 THEN 'Extended sequence - comprehensive scene analysis'
            WHEN n > 8 THEN 'Medium sequence - moderate scene coverage'
            ELSE 'Short sequence - focused scene analysis' END AS scene_context,
       ['scene_change', 'object_appearance', 'action_sequence'] AS temporal_events,
       0.75 AS confidence_score
FROM p"""


def py_float(x: str) -> str:
    t = strip(x)
    return (f"(CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN CAST({t} AS DOUBLE) END)")


VECTORS = """
vectors AS (
  SELECT vec_id, label, embedding,
         list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN
             CASE WHEN vec_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN vec_id % 11 = 0 THEN 'Infinity'::DOUBLE
                  WHEN vec_id % 5 = 0 THEN CAST(x AS DOUBLE) * 1000 ELSE CAST(x AS DOUBLE) END
           ELSE CAST(x AS DOUBLE) END) AS vec
  FROM embeddings)"""

SQL["vector_sanitize"] = f"""
WITH {VECTORS}
SELECT vec_id,
       list_transform(vec, lambda x: CASE WHEN isnan(x) OR isinf(x) THEN 0.0 ELSE greatest(-30.0, least(30.0, x)) END) AS values,
       CAST(len(list_filter(vec, lambda x: isnan(x) OR isinf(x))) AS INTEGER) AS invalid_count,
       CAST(len(list_filter(vec, lambda x: NOT isnan(x) AND NOT isinf(x) AND abs(x) > 30)) AS INTEGER) AS clamped_count
FROM vectors"""

SQL["vector_stats"] = f"""
WITH {VECTORS},
f AS (SELECT vec_id, vec, list_filter(vec, lambda x: NOT isnan(x) AND NOT isinf(x)) AS fin FROM vectors),
m AS (SELECT *, CASE WHEN len(fin) > 0 THEN list_sum(fin) / len(fin) END AS mean FROM f)
SELECT vec_id, {r6("CASE WHEN len(fin) > 0 THEN list_min(fin) END")} AS min,
       {r6("CASE WHEN len(fin) > 0 THEN list_max(fin) END")} AS max, {r6("mean")} AS mean,
       {r6("sqrt(list_sum(list_transform(fin, lambda x: (x - mean) * (x - mean))) / len(fin))")} AS std,
       CAST(len(list_filter(vec, lambda x: isnan(x))) AS INTEGER) AS nan_count,
       CAST(len(list_filter(vec, lambda x: isinf(x))) AS INTEGER) AS inf_count,
       CAST(len(list_filter(fin, lambda x: abs(x) > 100)) AS INTEGER) AS extreme_count,
       len(list_filter(vec, lambda x: isnan(x) OR isinf(x))) + len(list_filter(fin, lambda x: abs(x) > 100)) = 0 AS valid
FROM m"""

SQL["vector_resize"] = f"""
WITH {VECTORS}
SELECT vec_id, CAST(embedding AS DOUBLE[])[1:48] AS v48,
       list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(80), lambda i: 0.0))[1:80] AS v80,
       CAST((label + 1) * 1536 AS INTEGER) AS combined_len,
       {r6("list_sum(CAST(embedding AS DOUBLE[]))")} AS combined_sum
FROM vectors"""

LINES = """
lines AS (
  SELECT 'host' || CAST(user_id % 16 AS VARCHAR) AS host, event_id AS line_no,
    CASE event_type
      WHEN 'view' THEN CASE WHEN user_id % 13 = 0 THEN ' 10:01  up 3 days, load average: n/a'
           ELSE ' 10:01  up 3 days,  2 users,  load average: ' || CAST(k // 10 AS VARCHAR) || '.' || CAST(k % 10 AS VARCHAR) || '0, 0.50, 0.25' END
      WHEN 'click' THEN CASE WHEN user_id % 5 = 0 THEN 'root ' || CAST(event_id AS VARCHAR) || ' ' || CAST(k AS VARCHAR) || '.5 ollama serve'
           ELSE 'user  ' || CAST(event_id AS VARCHAR) || '  ' || CAST(k * 2 AS VARCHAR) || '.5  1.0 /usr/bin/Ollama Runner --port 11434' END
      WHEN 'purchase' THEN CASE WHEN user_id % 7 = 0 THEN 'GPU use (%): ' || CAST(k AS VARCHAR)
           ELSE 'GPU[' || CAST(user_id % 4 AS VARCHAR) || ']   ' || CAST(k AS VARCHAR) || '%   busy' END
      WHEN 'signup' THEN CASE WHEN user_id % 9 = 0 THEN 'card0,N/A' ELSE 'card' || CAST(user_id % 4 AS VARCHAR) || ',' || CAST(k AS VARCHAR) END
      ELSE 'error: ' || props END AS line
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
fl AS (SELECT *, list_filter(regexp_split_to_array(""" + strip("line") + f""", '{WS}+'), lambda x: x <> '') AS f FROM lines)"""

SQL["host_gate"] = f"""
WITH {LINES},
g AS (SELECT host,
             arg_max(line, line_no) FILTER (WHERE contains(line, 'load average:')) AS up,
             arg_min(f[3], line_no) FILTER (WHERE contains(lower(line), 'ollama runner') AND len(f) > 2) AS cpu_txt
      FROM fl GROUP BY host),
v AS (SELECT *, list_transform(string_split(split_part(up, 'load average:', 2), ','), lambda x: {py_float("x")}) AS vals FROM g),
c AS (SELECT host, up IS NOT NULL AND list_bool_or(list_transform(vals, lambda x: x IS NULL)) AS bad,
             CASE WHEN up IS NULL THEN 0.0 ELSE vals[1] END AS load,
             coalesce({py_float("cpu_txt")}, 0.0) AS cpu FROM v)
SELECT host, CASE WHEN bad THEN 0.0 ELSE load END AS system_load,
       CASE WHEN bad THEN 0.0 ELSE cpu END AS ollama_cpu_usage,
       CASE WHEN bad THEN true ELSE load < 8.0 AND cpu < 150.0 END AS can_process,
       CASE WHEN bad OR load < 8.0 THEN 'normal' ELSE 'wait_or_restart' END AS recommendation
FROM c"""

SQL["gpu_status"] = f"""
WITH {LINES},
u AS (SELECT *, contains(line, 'GPU') AND contains(line, '%') AS is_gpu,
             {py_float("replace(list_filter(f, lambda p: contains(p, '%'))[1], '%', '')")} AS util,
             starts_with(line, 'card') AS is_csv FROM fl),
g AS (SELECT host, arg_max(util, line_no) FILTER (WHERE is_gpu) AS util,
             count(*) FILTER (WHERE is_gpu AND util IS NULL) AS bad,
             arg_min(split_part(line, ',', 2), line_no) FILTER (WHERE is_csv) AS csv
      FROM u GROUP BY host),
d AS (SELECT DISTINCT 'host' || CAST(user_id % 16 AS VARCHAR) AS host, (user_id % 16) % 3 <> 0 AS available FROM events),
j AS (SELECT d.host, d.available, coalesce(g.bad, 0) > 0 AS failed, g.util, g.csv,
             TRY_CAST(regexp_extract(coalesce(g.csv, ''), '^{WS}*([+-]?[0-9]+)', 1) AS BIGINT) AS lead
      FROM d LEFT JOIN g USING (host))
SELECT host, available AND NOT failed AS decoder_available,
       CASE WHEN failed THEN 0.0 ELSE coalesce(util, 0.0) END AS gpu_utilization,
       available AND NOT failed AND (CASE WHEN failed THEN 0.0 ELSE coalesce(util, 0.0) END) < 80.0 AS can_process,
       CASE WHEN available AND NOT failed THEN 'gpu_ready' ELSE 'fallback_cpu' END AS recommendation,
       CASE WHEN NOT available THEN 'CPU_FALLBACK' WHEN csv IS NULL THEN 'GPU_UNKNOWN'
            WHEN lead IS NULL THEN 'GPU_STATUS_ERROR' WHEN lead < 50 THEN 'GPU_READY'
            WHEN lead < 80 THEN 'GPU_BUSY' ELSE 'GPU_OVERLOADED' END AS status
FROM j"""


def _fourcc(code: str) -> str:
    b = [f"CAST(({code} >> {8 * k}) & 255 AS INTEGER)" for k in range(4)]
    out = "''"
    for k in reversed(range(4)):
        out = f"(CASE WHEN {b[k]} = 0 THEN '' ELSE chr({b[k]}) || {out} END)"
    return out


SQL["fourcc_codes"] = f"""
WITH c AS (SELECT event_id, (event_id * 7919 + user_id) % 4294967296 AS code FROM events)
SELECT event_id, code, {_fourcc("code")} AS codec FROM c"""

SQL["probe_metadata"] = f"""
WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                  CASE WHEN event_type = 'click' THEN CAST(30000 AS DOUBLE) / 1001
                       ELSE CAST(20 + 5 * (user_id % 4) AS DOUBLE) END AS fps,
                  CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS dur
           FROM events)
SELECT event_id,
       CASE WHEN event_type IN ('signup', 'error') THEN 100 WHEN event_type = 'purchase' THEN k
            ELSE CAST(trunc(fps * dur) AS BIGINT) END AS frames,
       {r6("CASE WHEN event_type IN ('signup', 'error') THEN 25.0 ELSE fps END")} AS fps,
       {r6("CASE WHEN event_type IN ('signup', 'error') THEN 4.0 ELSE dur END")} AS duration,
       {r6("CASE WHEN event_type IN ('signup', 'error') THEN 25.0 ELSE fps END")} AS lenient_fps,
       {r6("CASE WHEN event_type IN ('signup', 'error') OR event_type = 'view' THEN 10.0 ELSE value END")} AS lenient_duration
FROM e"""

RESULT_CHUNKS = f"""
{ANALYSES},
rc AS (
  SELECT video_id, bool_or(success) AS success,
         count(*) FILTER (WHERE success) AS frames_analyzed, count(*) AS total_frames_extracted,
         round(sum(processing_time), 2) AS total_processing_time, arg_min(model_used, frame_idx) AS model_used,
         coalesce(list(coalesce(description, '') ORDER BY frame_idx) FILTER (WHERE success), []) AS descs,
         video_id % 7 = 0 AS bad
  FROM analyses GROUP BY video_id)"""

SQL["result_json_roundtrip"] = f"""
WITH {RESULT_CHUNKS}
SELECT video_id,
       CASE WHEN bad THEN false ELSE success END AS success,
       CASE WHEN bad THEN '' ELSE 'video_' || CAST(video_id AS VARCHAR) END AS video_path,
       CASE WHEN bad THEN 0 ELSE frames_analyzed END AS frames_analyzed,
       CASE WHEN bad THEN 0 ELSE total_frames_extracted END AS total_frames_extracted,
       {r6("CASE WHEN bad THEN 0.0 ELSE total_processing_time END")} AS total_processing_time,
       CASE WHEN bad THEN '' ELSE 'video ' || CAST(video_id AS VARCHAR) END AS video_summary,
       CASE WHEN bad THEN '' ELSE model_used END AS model_used,
       CASE WHEN bad THEN 'JSON parsing error' ELSE '' END AS error,
       CASE WHEN bad THEN CAST([] AS VARCHAR[]) ELSE descs END AS frame_descriptions,
       NOT bad AND success AS strict_success,
       CASE WHEN bad THEN 'JSON parse error' WHEN NOT success THEN 'Unknown error' END AS strict_error
FROM rc"""

SQL["loose_json_keys"] = f"""
WITH {RESULT_CHUNKS}
SELECT video_id,
       CASE WHEN bad THEN false ELSE success END AS success,
       CASE WHEN bad THEN '' ELSE 'video_' || CAST(video_id AS VARCHAR) END AS video_path,
       CASE WHEN bad THEN 0 ELSE frames_analyzed END AS frames_analyzed,
       CASE WHEN bad THEN 0 ELSE total_frames_extracted END AS total_frames_extracted,
       {r6("CASE WHEN bad THEN 0.0 ELSE total_processing_time END")} AS total_processing_time,
       CASE WHEN bad THEN '' ELSE 'video ' || CAST(video_id AS VARCHAR) END AS video_summary,
       CASE WHEN bad THEN '' ELSE model_used END AS model_used,
       CASE WHEN bad THEN 'JSON parsing error' ELSE '' END AS error
FROM rc"""

SQL["batch_report"] = f"""
WITH {ANALYSES}, {_cpu_summary("analyses")},
v AS (SELECT a.video_id, bool_or(a.success) AS success, count(*) FILTER (WHERE a.success) AS fa,
             count(*) AS tf, round(sum(a.processing_time), 2) AS t, s.summary
      FROM analyses a JOIN summ s USING (video_id) GROUP BY a.video_id, s.summary),
n AS (SELECT *, row_number() OVER (ORDER BY video_id) AS no FROM v)
SELECT 'title' AS section, CAST(0 AS BIGINT) AS item_no,
       'GPU-Accelerated Video Analysis Batch Report' || {NL} || repeat('=', 44) || {NL} || {NL} AS text
UNION ALL
SELECT 'item' AS section, CAST(no AS BIGINT) AS item_no,
       'Video ' || CAST(no AS VARCHAR) || ': video_' || CAST(video_id AS VARCHAR) || {NL} ||
       CASE WHEN success THEN 'Status: SUCCESS' || {NL} || 'Frames: ' || CAST(fa AS VARCHAR) || '/' || CAST(tf AS VARCHAR)
                 || {NL} || 'Time: ' || CAST(round(t, 2) AS VARCHAR) || 's' || {NL} || 'Method: cpu' || {NL}
                 || 'Summary: ' || summary || {NL}
            ELSE 'Status: FAILED' || {NL} || 'Error: No frames could be extracted from video' || {NL} END
       || {NL} || repeat('-', 50) || {NL} AS text
FROM n
UNION ALL
SELECT 'summary', NULL,
       'SUMMARY' || {NL} || '=======' || {NL} || 'Total videos: ' || CAST(count(*) AS VARCHAR) || {NL}
       || 'Successful: ' || CAST(count(*) FILTER (WHERE success) AS VARCHAR) || {NL}
       || 'Failed: ' || CAST(count(*) - count(*) FILTER (WHERE success) AS VARCHAR) || {NL}
       || 'Total processing time: ' || CAST(round(coalesce(sum(t) FILTER (WHERE success), 0.0), 2) AS VARCHAR) || 's' || {NL}
       || 'Average per video: ' || CAST(round(CASE WHEN count(*) FILTER (WHERE success) > 0
                THEN coalesce(sum(t) FILTER (WHERE success), 0.0) / count(*) FILTER (WHERE success) ELSE 0.0 END, 2) AS VARCHAR)
       || 's' || {NL}
FROM v"""

SQL["inference_requests"] = f"""
WITH {FRAMES},
samp AS (
  SELECT s.video_id, p.i AS sample_pos,
         CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(q.UNIFORM_N)} p)
SELECT m.video_id, m.sample_pos,
       '{{"model":"llama3.2-vision:11b","prompt":"Describe what you see in this image concisely.","images":["'
       || to_base64(unhex(array_to_string(list_transform(f.pixels, lambda x: lpad(hex(x), 2, '0')), '')))
       || '"],"stream":false,"options":{{"temperature":0.3,"num_predict":60,"top_k":10,"top_p":0.9}}}}' AS request
FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx"""

SQL["summary_requests"] = f"""
WITH {ANALYSES},
parts AS (SELECT video_id,
                 string_agg({strip("coalesce(description, '')")}, ' | ' ORDER BY frame_idx) AS text
          FROM analyses WHERE success GROUP BY video_id)
SELECT video_id,
       '{{"model":"llama3.2-vision:11b","prompt":' || to_json('Create a brief video summary from these observations:' || {NL} || {NL} || text || {NL} || {NL} || 'Summary (1-2 sentences):')
       || ',"stream":false,"options":{{"temperature":0.3,"num_predict":50,"top_k":10,"top_p":0.9,"repeat_penalty":1.1}}}}' AS cpu_request,
       '{{"model":"llava:7b","prompt":' || to_json('Create a brief video summary from these GPU-analyzed observations:' || {NL} || {NL} || text || {NL} || {NL} || 'Summary (1-2 sentences):')
       || ',"stream":false,"options":{{"temperature":0.3,"num_predict":50,"top_k":10,"top_p":0.9}}}}' AS gpu_request
FROM parts"""

SQL["parse_responses"] = """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id AS request_id, event_type <> 'error' AS success,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 'seen ' || CAST(k AS VARCHAR)
            ELSE event_type || ' ' || CAST(k AS VARCHAR) END AS description,
       CASE WHEN event_type = 'error' THEN 'HTTP ' || CAST(500 + k % 4 AS VARCHAR) END AS error,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE 'm' || CAST(k AS VARCHAR) END AS model,
       CASE WHEN event_type = 'error' THEN NULL ELSE event_type <> 'view' END AS done,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0 ELSE k * 1000 END AS total_duration,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN 0 ELSE k END AS eval_count
FROM e"""

SQL["missing_inputs"] = """
WITH r AS (SELECT DISTINCT 'video_' || CAST(user_id AS VARCHAR) || '.mp4' AS path FROM events),
x AS (SELECT DISTINCT 'video_' || CAST(user_id AS VARCHAR) || '.mp4' AS path FROM events WHERE event_type = 'purchase')
SELECT path, path IN (SELECT path FROM x) AS found FROM r"""

SQL["first_available"] = """
WITH u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, p AS priority, 'model_' || CAST(user_id % 10 AS VARCHAR) || '_' || CAST(p AS VARCHAR) || '.onnx' AS path
      FROM u, range(0, 3) t(p)),
a AS (SELECT DISTINCT 'model_' || CAST(user_id % 10 AS VARCHAR) || '_' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS VARCHAR) || '.onnx' AS path
      FROM events WHERE event_type = 'signup')
SELECT user_id, coalesce(arg_min(path, priority) FILTER (WHERE path IN (SELECT path FROM a)), '') AS chosen
FROM c GROUP BY user_id"""

SQL["config_overlay"] = """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id,
       CASE WHEN event_type IN ('click', 'purchase') THEN k ELSE 151643 END AS bos_token_id,
       CASE WHEN event_type = 'view' THEN k ELSE 151645 END AS eos_token_id,
       CASE WHEN event_type = 'view' THEN 1000 WHEN event_type = 'signup' THEN k ELSE 151936 END AS vocab_size,
       CASE WHEN event_type = 'signup' THEN k ELSE 151655 END AS image_token_id, 151656 AS video_token_id,
       151652 AS vision_start_token_id, CASE WHEN event_type = 'signup' THEN 7 ELSE 151653 END AS vision_end_token_id,
       CASE WHEN event_type = 'signup' THEN 8 ELSE 151654 END AS vision_token_id
FROM e"""

SQL["vocab_json"] = f"""
WITH w AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos
           FROM (SELECT item_id, {words_sql("text")} AS ws FROM benchmark))
SELECT item_id, word AS token, CAST(min(pos) AS BIGINT) AS id FROM w WHERE item_id % 4 <> 0 GROUP BY item_id, word"""


UNIFORM_SAMPLE = f"""
samp AS (
  SELECT s.video_id, p.i AS sample_pos,
         CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(q.UNIFORM_N)} p),
sf AS (SELECT m.video_id, m.sample_pos, m.frame_idx, f.pixels, list_sum(f.pixels) AS level, len(f.pixels) AS npx
       FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx)"""

SQL["describe_frames_stub"] = f"""
WITH {FRAMES}, {UNIFORM_SAMPLE}
SELECT CAST(video_id AS BIGINT) AS video_id, sample_pos, frame_idx,
       level % 400 < 300 AND level % 17 <> 0 AS success,
       CASE WHEN level % 400 < 300 AND level % 17 <> 0
            THEN 'Frame ' || CAST(sample_pos + 1 AS VARCHAR) || ': mean level ' || CAST(level // npx AS VARCHAR)
                 || ' over ' || CAST(npx AS VARCHAR) || ' pixels' END AS description,
       CASE WHEN level % 400 >= 300 THEN 'Timeout after 300 seconds'
            WHEN level % 17 = 0 THEN 'HTTP 500' END AS error,
       CASE WHEN level % 400 >= 300 THEN 300.0 ELSE CAST(level % 400 AS DOUBLE) END AS processing_time,
       'Frame ' || CAST(sample_pos + 1 AS VARCHAR) AS frame_description,
       'stub' AS model_used,
       CASE WHEN level % 11 = 0 THEN 2 ELSE 1 END AS attempts, frame_idx / 10.0::DOUBLE AS timestamp
FROM sf"""

SQL["describe_frames_prompt"] = f"""
WITH {FRAMES},
samp AS (SELECT s.video_id, p.i AS sample_pos,
                CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
         FROM sizes s, {positions(q.UNIFORM_N)} p)
SELECT CAST(m.video_id AS BIGINT) AS video_id, m.sample_pos, m.frame_idx, m.sample_pos % 3 <> 2 AS success,
       CASE WHEN m.sample_pos % 3 <> 2 THEN CAST(len(list_filter(f.pixels, lambda x: x > m.sample_pos * 20 + 30)) AS VARCHAR)
            || ' of ' || CAST(len(f.pixels) AS VARCHAR) END AS description,
       CASE WHEN m.sample_pos % 3 = 2 THEN 'HTTP 400' END AS error, 'level-counter' AS model_used, 1 AS attempts
FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx"""

SQL["describe_frame_groups"] = f"""
WITH {FRAMES}, {UNIFORM_SAMPLE}
SELECT CAST(video_id AS BIGINT) AS video_id, count(*) AS n_frames,
       CAST(count(*) AS VARCHAR) || ' frames, mean level ' || CAST(sum(level) // sum(npx) AS VARCHAR) AS description,
       round(least(1.0, count(*) / 16.0), 6) AS confidence, CAST(NULL AS VARCHAR) AS error
FROM sf GROUP BY video_id"""

SQL["analyze_videos"] = f"""
WITH {FRAMES},
samp AS (
  SELECT s.video_id, p.i AS sample_pos,
         CAST(trunc((CAST(p.i AS DOUBLE) / 15) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(16)} p),
sf AS (SELECT m.video_id, list_sum(f.pixels) AS level, len(f.pixels) AS npx
       FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx)
SELECT CAST(video_id AS BIGINT) AS video_id, count(*) AS n_frames,
       CASE WHEN video_id % 6 = 0 THEN 'Analysis failed: model rejected video ' || CAST(video_id AS VARCHAR)
            ELSE CAST(count(*) AS VARCHAR) || ' frames, mean level ' || CAST(sum(level) // sum(npx) AS VARCHAR) END AS description,
       CASE WHEN video_id % 6 = 0 THEN 0.0 ELSE round(least(1.0, count(*) / 16.0), 6) END AS confidence,
       CASE WHEN video_id % 6 = 0 THEN 'model rejected video ' || CAST(video_id AS VARCHAR) END AS error,
       CASE WHEN video_id % 6 = 0 THEN CAST([] AS VARCHAR[]) WHEN sum(level) >= 128 * sum(npx) THEN ['bright area']
            ELSE ['dark area'] END AS objects,
       CAST([] AS VARCHAR[]) AS actions,
       CASE WHEN video_id % 6 = 0 THEN '' ELSE CAST(count(*) AS VARCHAR) || ' frames of ' ||
            CAST(CAST(sum(npx) // count(*) AS BIGINT) AS VARCHAR) || ' pixels' END AS scene_context,
       CAST([] AS VARCHAR[]) AS temporal_events
FROM sf GROUP BY video_id"""

SQL["summarize_stub"] = f"""
WITH {ANALYSES}, {_cpu_summary("analyses")},
oparts AS (SELECT video_id,
                  string_agg({strip("coalesce(description, '')")}, ' | ' ORDER BY frame_idx) AS text
           FROM analyses WHERE success GROUP BY video_id)
SELECT CAST(s.video_id AS BIGINT) AS video_id,
       CASE WHEN p.text IS NULL THEN 'No frames were successfully analyzed.'
            WHEN p.video_id % 7 = 0 THEN s.summary
            WHEN p.video_id % 5 = 0 THEN 'Failed to generate video summary.'
            ELSE 'Summary of ' || CAST(len(string_split(p.text, ' | ')) AS VARCHAR) || ' observations' END AS summary,
       CASE WHEN p.text IS NULL THEN 'none' WHEN p.video_id % 7 = 0 THEN 'fallback' WHEN p.video_id % 5 = 0 THEN 'http_error' ELSE 'model' END AS source
FROM summ s LEFT JOIN oparts p ON p.video_id = s.video_id"""

SQL["stream_chunks"] = f"""
WITH {FRAMES},
c AS (SELECT video_id, frame_idx // 3 AS chunk, count(*) AS n_frames, min(frame_idx) AS first_idx,
             max(frame_idx) AS last_idx, avg(list_sum(pixels) / len(pixels)) AS b
      FROM frames GROUP BY video_id, frame_idx // 3)
SELECT CAST(video_id AS BIGINT) AS video_id, chunk, n_frames, first_idx, last_idx, {r6("b")} AS brightness,
       n_frames < 3 AS final,
       CASE WHEN (video_id + chunk) % 9 = 0 THEN
              CASE WHEN n_frames < 3 THEN 'Final chunk analysis error: ' ELSE 'Streaming analysis error: ' END
              || 'chunk ' || CAST(chunk AS VARCHAR) || ' rejected'
            ELSE 'chunk ' || CAST(chunk AS VARCHAR) || ': ' || CAST(n_frames AS VARCHAR) || ' frames' END AS result,
       CAST(0 AS BIGINT) AS late_frames
FROM c"""

SQL["stream_callback"] = f"""
SELECT video_id, count(*) AS chunks, CAST(sum(n_frames) AS BIGINT) AS n_frames, count(*) FILTER (WHERE final) AS partial_chunks
FROM ({SQL["stream_chunks"]}) GROUP BY video_id"""

SQL["stream_frames_seen"] = f"""
WITH {FRAMES}
SELECT CAST(video_id AS BIGINT) AS video_id, count(*) AS frames_seen FROM frames GROUP BY video_id"""


SQL["video_info_json"] = f"""
WITH {FRAMES}
SELECT video_id, to_json(struct_pack(video_path := 'video_' || CAST(video_id AS VARCHAR), total_frames := total_frames,
       fps := 10.0::DOUBLE, duration := total_frames / 10.0, frame_size := [8::INTEGER, 8::INTEGER], codec := 'MJPG')) AS info_json
FROM sizes"""

SQL["result_json_write"] = """
WITH g AS (SELECT conv_id, count(*) AS n, arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS prompt
           FROM conversations GROUP BY conv_id)
SELECT conv_id, to_json(struct_pack(
  video_path := 'conv_' || CAST(conv_id AS VARCHAR) || '.mp4',
  description := 'Placeholder analysis of ' || CAST(n AS VARCHAR) || ' frames: ' ||
    CASE WHEN contains(coalesce(prompt, ''), 'detailed') THEN 'Detailed scene analysis with multiple objects and activities detected. '
         ELSE 'Basic scene analysis with recognizable elements. ' END,
  objects := ['person', 'object', 'background', 'furniture'],
  actions := ['walking', 'sitting', 'interacting', 'moving'],
  scene_context := CASE WHEN n > 12 THEN 'Extended sequence - comprehensive scene analysis'
                        WHEN n > 8 THEN 'Medium sequence - moderate scene coverage'
                        ELSE 'Short sequence - focused scene analysis' END,
  temporal_events := ['scene_change', 'object_appearance', 'action_sequence'],
  confidence_score := 0.75::DOUBLE, processing_time_ms := n * 100, total_time_ms := n * 100 + 5)) AS json
FROM g"""

SQL["batch_json"] = f"""
WITH {RESULTS},
d AS (SELECT path, arg_max(model_used, seq) AS m, arg_max(confidence, seq) AS c, arg_max(processing_time, seq) AS t
      FROM results GROUP BY path)
SELECT path, to_json(MAP {{path: struct_pack(description := m, objects := [m], actions := CAST([] AS VARCHAR[]),
                                            scene_context := 'scene', temporal_events := CAST([] AS VARCHAR[]), confidence_score := round(c, 6),
                                            processing_time_ms := CAST(trunc(t * 1000) AS BIGINT))}}) AS json
FROM d"""

SQL["keyframe_frames"] = f"""
WITH {CFRAMES}
SELECT k.video_id, k.sample_pos, k.frame_idx, {r6(COLOR_BRIGHT.replace("pixels", "f.pixels"))} AS brightness
FROM ({SQL["frame_sample_keyframes"]}) k JOIN cframes f ON f.video_id = k.video_id AND f.frame_idx = k.frame_idx"""

SQL["frame_sample_strategy"] = f"""
SELECT video_id, sample_pos, frame_idx FROM ({SQL["frame_sample_keyframes"]}) WHERE video_id % 2 = 0
UNION ALL
SELECT video_id, sample_pos, frame_idx FROM ({_sample_sql(
    f"CAST(trunc((CAST(m.sample_pos AS DOUBLE) / {q.KEYFRAME_N - 1}) * (m.t - 1)) AS BIGINT)", q.KEYFRAME_N)}) WHERE video_id % 2 <> 0"""

SQL["frame_processor_plugin"] = f"""
WITH {FRAMES}
SELECT video_id, frame_idx, CAST(len(pixels) AS INTEGER) AS n_values,
       {r6("list_sum(list_transform(pixels, lambda x: CAST(CAST(x AS FLOAT) * CAST(1.0 / 255.0 AS FLOAT) AS DOUBLE)))")} AS norm_sum
FROM frames"""

SQL["round_robin"] = f"""
WITH {FRAMES}, {UNIFORM_SAMPLE}
SELECT video_id, sample_pos, CAST(row_number() OVER (ORDER BY video_id, sample_pos) - 1 AS BIGINT) AS pos,
       CAST((row_number() OVER (ORDER BY video_id, sample_pos) - 1) % 3 AS BIGINT) AS device
FROM sf"""

SQL["ledger_admission"] = f"""
WITH RECURSIVE {LEDGER},
numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn,
                    CASE WHEN op = 'alloc' THEN bytes ELSE -bytes END AS x FROM led),
walk(rn, total) AS (
  SELECT rn, greatest(0, x) FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.rn, greatest(0, w.total + n.x) FROM walk w JOIN numbered n ON n.rn = w.rn + 1)
SELECT n.seq, n.bytes, CAST(w.total - n.bytes AS BIGINT) AS current, w.total <= 4194304 AS admit
FROM numbered n JOIN walk w USING (rn) WHERE n.op = 'alloc'"""

SQL["multimodal_positions"] = f"""
WITH c AS (SELECT conv_id, turn, text, turn % 4 AS n_img, conv_id % 3 AS n_vid FROM conversations),
ids AS (SELECT conv_id, turn,
               (CAST(flatten(list_transform(range(n_img), lambda i: [151652, 151655, 151653])
                             || list_transform(range(n_vid), lambda i: [151652, 151656, 151653])) AS BIGINT[])
                || {fallback_ids('text')})[1:2048] AS input_ids
        FROM c),
p AS (SELECT conv_id, turn, input_ids, CAST(range(0, len(input_ids)) AS BIGINT[]) AS pos FROM ids)
SELECT conv_id, turn, pos AS temporal, pos AS height, pos AS width,
       [CAST(len(list_filter(input_ids, lambda x: x IN (151655, 151656))) AS BIGINT)] AS mrope_deltas,
       pos || pos || pos AS position_3d
FROM p"""

# float16 by mantissa truncation, computed arithmetically (independent of the
# bit manipulation in the Arrow UDFs)
SQL["vector_half_bits"] = f"""
WITH {VECTORS},
e AS (SELECT vec_id, unnest(CAST(vec AS FLOAT[])) AS x, generate_subscripts(vec, 1) AS i FROM vectors),
a AS (SELECT vec_id, i, x, CASE WHEN x < 0 THEN 1 ELSE 0 END AS s, abs(CAST(x AS DOUBLE)) AS ax FROM e),
g AS (SELECT *, CASE WHEN isnan(x) OR isinf(x) OR ax = 0 THEN 0 ELSE CAST(floor(log2(ax)) AS INTEGER) END AS e0 FROM a),
h AS (SELECT *, CASE WHEN ax = 0 OR isnan(x) OR isinf(x) THEN e0
                     WHEN pow(2.0, e0) > ax THEN e0 - 1 WHEN pow(2.0, e0 + 1) <= ax THEN e0 + 1 ELSE e0 END AS ex FROM g),
bits AS (
  SELECT vec_id, i,
         CAST(CASE WHEN isnan(x) THEN 32256
                   WHEN isinf(x) THEN s * 32768 + 31744
                   WHEN ax < pow(2.0, -126) THEN s * 32768
                   WHEN ex + 15 <= 0 THEN s * 32768
                   WHEN ex + 15 >= 31 THEN s * 32768 + 31744
                   ELSE s * 32768 + (ex + 15) * 1024 + CAST(floor((ax / pow(2.0, ex) - 1) * 1024) AS INTEGER) END AS INTEGER) AS b
  FROM h),
d AS (SELECT vec_id, i, b, b // 32768 AS hs, (b // 1024) % 32 AS he, b % 1024 AS hm FROM bits),
v AS (SELECT *, CAST(CASE WHEN he = 31 AND hm = 0 THEN (CASE WHEN hs = 1 THEN '-Infinity' ELSE 'Infinity' END)::DOUBLE
                          WHEN he = 31 THEN 'NaN'::DOUBLE
                          WHEN he = 0 THEN CAST(1 - 2 * hs AS DOUBLE) * hm * pow(2.0, -24)
                          ELSE (1 - 2 * hs) * pow(2.0, he - 15) * (1 + hm / 1024.0) END AS FLOAT) AS back FROM d),
z AS (SELECT *, isnan(back) OR isinf(back) AS bad, NOT (isnan(back) OR isinf(back)) AND abs(back) > 50 AS big FROM v)
SELECT vec_id, list(b ORDER BY i) AS bits, list(back ORDER BY i) AS back,
       list(CASE WHEN bad THEN 0 WHEN big THEN CAST(hs * 32768 + 21056 AS INTEGER) ELSE b END ORDER BY i) AS sanitized_bits,
       CAST(count(*) FILTER (WHERE bad) AS INTEGER) AS invalid_count,
       CAST(count(*) FILTER (WHERE big) AS INTEGER) AS clamped_count
FROM z GROUP BY vec_id"""

# Bilinear resize with half-pixel centres, in whole numbers.
SQL["image_resize"] = f"""
WITH {CFRAMES}, {RESIZED}
SELECT video_id, frame_idx, 6 AS out_height, 14 AS out_width,
       {r6("sum(CAST(CAST(v AS FLOAT) * CAST(1.0 / 255.0 AS FLOAT) AS DOUBLE))")} AS rgb_norm_sum,
       max(v) > 0 AS content_ok
FROM px GROUP BY video_id, frame_idx"""

# 16 uniform frames, bilinear resize to 336 x 336 from 2 x 11, channels R, G, B; levels before the division
# by 255. Columns and rows are interpolated from few distinct positions, so the grid is one row per output pixel.
TENSOR = f"""
samp AS (
  SELECT s.video_id, p.i AS pos, CAST(trunc((CAST(p.i AS DOUBLE) / 15) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
  FROM sizes s, {positions(16)} p),{places("y", 2, 336)},{places("x", 11, 336)},
cols AS (
  SELECT f.video_id, s.pos, 2 - c AS c, x, {across("0")} AS top, {across("1")} AS bottom
  FROM samp s JOIN cframes f ON f.video_id = s.video_id AND f.frame_idx = s.frame_idx, xs, range(0, 3) c(c)),
px AS (SELECT video_id, pos, c, y, x, CAST({down("(CASE y0 WHEN 0 THEN top ELSE bottom END)", "(CASE y1 WHEN 0 THEN top ELSE bottom END)")} AS BIGINT) AS v
       FROM ys, cols)"""

SQL["pixel_tensor"] = f"""
WITH {CFRAMES}, {TENSOR},
n AS (SELECT video_id, count(*) AS n FROM samp GROUP BY 1)
SELECT video_id, CAST(any_value(n.n) AS INTEGER) AS n_frames, CAST([1, any_value(n.n), 3, 336, 336] AS INTEGER[]) AS shape,
       CAST(sum(v) AS BIGINT) AS level_sum,
       CAST(sum(v * ((pos + 1) * 7 + (c + 1) * 5 + (y + 1) * 3 + x + 1)) AS BIGINT) AS placed_sum,
       count(*) FILTER (WHERE v > 0) AS nonzero
FROM px JOIN n USING (video_id) GROUP BY video_id"""

SQL["pixel_blocks"] = f"""
WITH {CFRAMES}, {TENSOR}
SELECT video_id, pos AS sample_pos, CAST(c AS INTEGER) AS channel, CAST(4 * count(*) AS INTEGER) AS n_bytes,
       CAST(sum(v) AS BIGINT) AS level_sum, CAST(sum(v * ((pos + 1) * 7 + (c + 1) * 5 + (y + 1) * 3 + x + 1)) AS BIGINT) AS placed_sum,
       count(*) FILTER (WHERE v > 0) AS nonzero,
       list(CAST(v AS INTEGER) ORDER BY y, x) FILTER (WHERE (y * 336 + x) % {q.BLOCK_STEP} = 0) AS levels
FROM px GROUP BY video_id, pos, c"""

# Sobel with repeated borders, suppression along the gradient, hysteresis as reachability over weak pixels;
# with the resize of image_resize, its levels weighted by RGB channel, row and column.
SQL["image_preprocess"] = f"""
WITH RECURSIVE {CFRAMES},
{CANNY}, {RESIZED}
SELECT video_id, frame_idx, 6 AS out_height, 14 AS out_width,
       {r6("sum(CAST(CAST(v AS FLOAT) * CAST(1.0 / 255.0 AS FLOAT) AS DOUBLE))")} AS rgb_norm_sum,
       CAST(sum(CAST(v AS BIGINT) * ((3 - c) * 5 + (y + 1) * 3 + x + 1)) AS BIGINT) AS placed_sum,
       {r6("any_value(coalesce(edge_density, 0.0))")} AS edge_density,
       max(v) > 0 AS content_ok
FROM px LEFT JOIN dens USING (vec_id) GROUP BY video_id, frame_idx"""

SQL["image_histogram"] = f"""
WITH {CFRAMES}, {HIST}
SELECT video_id, frame_idx, CAST(code // 32 AS INTEGER) AS channel, CAST(code % 32 AS INTEGER) AS bin, CAST(n AS BIGINT) AS count,
       {r6("entropy")} AS entropy
FROM cnt JOIN ent USING (video_id, frame_idx)"""

SQL["frame_gray_fixed"] = f"""
WITH {CFRAMES}
SELECT video_id, frame_idx, CAST(list_sum(g) AS BIGINT) AS gray_sum, {r6("list_sum(g) / 22.0")} AS gray_mean,
       CAST(list_max(g) AS BIGINT) AS gray_max
FROM (SELECT video_id, frame_idx, list_transform(range(0, 22), lambda j: {GRAY8.format(
    b="CAST(pixels[3*j+1] AS BIGINT)", g="pixels[3*j+2]", r="pixels[3*j+3]")}) AS g FROM cframes)"""

SQL["stream_image_chunks"] = f"""
WITH {CFRAMES}, {RESIZED},
cells AS (SELECT video_id, frame_idx, y, x, max(v) FILTER (WHERE c = 0) AS b, max(v) FILTER (WHERE c = 1) AS g, max(v) FILTER (WHERE c = 2) AS r
          FROM px GROUP BY ALL),
per AS (SELECT video_id, frame_idx, avg({GRAY8.format(b="b", g="g", r="r")}) AS bright, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM cells GROUP BY ALL)
SELECT CAST(video_id AS BIGINT) AS video_id, frame_idx // 3 AS chunk, count(*) AS n_frames, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx,
       {r6("avg(bright)")} AS brightness, count(*) < 3 AS final,
       CAST(CAST(sum(r) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(sum(g) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(sum(b) AS BIGINT) AS VARCHAR) AS result,
       CAST(0 AS BIGINT) AS late_frames
FROM per GROUP BY video_id, frame_idx // 3"""

SQL["frame_files_sample"] = f"""
WITH {CFRAMES},
samp AS (SELECT s.video_id, p.i AS sample_pos,
                CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
         FROM sizes s, {positions(q.UNIFORM_N)} p)
SELECT m.video_id, m.sample_pos, m.frame_idx, CAST(126 AS BIGINT) AS bytes, 2 AS height, 11 AS width, 3 AS channels, f.pixels
FROM samp m JOIN cframes f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx"""

SQL["frame_source_filter"] = f"""
WITH {CFRAMES}
SELECT CAST(video_id AS VARCHAR) AS video_id, frame_idx, 2 AS height, 11 AS width, 3 AS channels,
       sha256(unhex(array_to_string(list_transform(pixels, lambda x: printf('%02x', x)), ''))) AS data_sha256
FROM cframes WHERE video_id IN (1, 3, 4, 7) AND frame_idx >= 2 AND frame_idx < 12"""

SQL["missing_frame_files"] = f"""
WITH {FRAMES},
asked AS (SELECT video_id, total_frames, unnest(generate_series(greatest(total_frames - 3, 0), total_frames + 1)) AS frame_idx FROM sizes)
SELECT video_id, CAST(frame_idx AS BIGINT) AS frame_idx, frame_idx < total_frames AS found,
       CAST(video_id AS VARCHAR) || '/frame_' || CAST(total_frames - 1 AS VARCHAR) AS best
FROM asked"""

SQL["frame_sample_sql"] = SQL["frame_sample_uniform"]

SQL["video_rollup_requested"] = f"""
WITH {ANALYSES}
SELECT coalesce(a.video_id, c.c_custkey) AS video_id, coalesce(bool_or(a.success), false) AS success, count(*) FILTER (WHERE a.success) AS frames_analyzed,
       count(a.video_id) AS total_frames_extracted, round(sum(a.processing_time), 2) AS total_processing_time,
       arg_min(a.model_used, a.frame_idx) AS model_used,
       CASE WHEN count(a.video_id) = 0 THEN 'No frames could be extracted from video' END AS error
FROM analyses a FULL JOIN (SELECT DISTINCT c_custkey FROM customer) c ON a.video_id = c.c_custkey GROUP BY 1"""

SQL["video_frame_details"] = f"""
WITH {ANALYSES}
SELECT video_id, frame_idx // 16 AS part, min(frame_idx) AS first_frame, count(*) AS n_frames,
       list(concat_ws('|', CAST(frame_idx AS VARCHAR), CAST(success AS VARCHAR), coalesce(description, error),
                      'Frame ' || CAST(frame_idx + 1 AS VARCHAR), model_used) ORDER BY frame_idx) AS details
FROM analyses GROUP BY video_id, frame_idx // 16"""

SQL["latency_memory"] = f"""
WITH {ANALYSES}
SELECT a.model_used, count(*) AS frames, {r6("quantile_cont(a.processing_time, 0.95)")} AS p95_time,
       max(CAST(json_extract_string(e.props, '$.k') AS BIGINT) * 1024) AS peak_memory
FROM analyses a JOIN events e ON e.event_id = a.event_id GROUP BY a.model_used"""

SQL["frame_features_fallback"] = f"""
WITH {FRAMES},
samp AS (SELECT s.video_id, p.i AS sample_pos,
                CAST(trunc((CAST(p.i AS DOUBLE) / {q.UNIFORM_N - 1}) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
         FROM sizes s, {positions(q.UNIFORM_N)} p WHERE s.video_id % 2 = 0 OR p.i = 0),
sf AS (SELECT m.video_id, m.sample_pos, f.pixels, lag(f.pixels) OVER (PARTITION BY m.video_id ORDER BY m.sample_pos) AS prev
       FROM samp m JOIN frames f ON f.video_id = m.video_id AND f.frame_idx = m.frame_idx),
per AS (SELECT video_id, list_sum(pixels) / len(pixels) AS brightness,
               CASE WHEN prev IS NULL THEN 0.0 ELSE list_sum(list_transform(pixels, lambda x, k: abs(x - prev[k]))) / len(pixels) END AS motion FROM sf),
agg AS (SELECT video_id, count(*) AS n, sum(brightness) / (count(*) * 255.0) AS b,
               CASE WHEN count(*) > 1 THEN sum(motion) / ((count(*) - 1) * 255.0) END AS m FROM per GROUP BY video_id)
SELECT video_id, CAST(n AS BIGINT) AS n_frames,
       CASE WHEN m IS NULL THEN [0.5::DOUBLE, 0.2, 0.3, 0.4, 0.35, 0.2, 0.5, 0.5]
            ELSE list_transform([b, m, 0.0, 0.0, 0.0, m, b, n / 32.0], lambda x: {r6("x")}) END AS features
FROM agg"""

SQL["batch_document"] = f"""
WITH {RESULTS},
d AS (SELECT path, arg_max(model_used, seq) AS m, arg_max(confidence, seq) AS c, arg_max(processing_time, seq) AS t FROM results GROUP BY path),
lines AS (
  SELECT 1 AS place, path, '  ' || to_json(path) || ': ' || to_json(struct_pack(
           actions := CAST([] AS VARCHAR[]), confidence_score := round(c, 6), description := m, objects := [m],
           processing_time_ms := CAST(trunc(t * 1000) AS BIGINT), scene_context := 'scene', temporal_events := CAST([] AS VARCHAR[])))
           || CASE WHEN path = (SELECT max(path) FROM d) THEN '' ELSE ',' END AS text FROM d
  UNION ALL SELECT 0, NULL, '{{' UNION ALL SELECT 2, NULL, '}}')
SELECT CAST(row_number() OVER (ORDER BY place, path) - 1 AS BIGINT) AS line_no, text FROM lines"""

SQL["analyze_videos_rgb"] = f"""
WITH {CFRAMES}, {RESIZED},
samp AS (SELECT s.video_id, p.i AS sample_pos, CAST(trunc((CAST(p.i AS DOUBLE) / 15) * (s.total_frames - 1)) AS BIGINT) AS frame_idx
         FROM sizes s, {positions(16)} p),
per AS (SELECT video_id, frame_idx, CAST(sum(v) FILTER (WHERE c = 2) AS BIGINT) AS r, CAST(sum(v) FILTER (WHERE c = 1) AS BIGINT) AS g,
               CAST(sum(v) FILTER (WHERE c = 0) AS BIGINT) AS b FROM px GROUP BY ALL),
vid AS (SELECT m.video_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b,
               list(CAST(r + g + b AS VARCHAR) ORDER BY m.sample_pos) AS events FROM samp m JOIN per USING (video_id, frame_idx) GROUP BY 1),
j AS (SELECT *, CASE WHEN video_id = 3 THEN 'No frames extracted from video' WHEN r >= b AND r > g THEN 'too red: ' || CAST(r AS VARCHAR) END AS error FROM vid)
SELECT CAST(video_id AS BIGINT) AS video_id, CASE WHEN video_id = 3 THEN 0 ELSE n END AS n_frames,
       CASE WHEN error IS NOT NULL THEN 'Analysis failed: ' || error
            ELSE CAST(n AS VARCHAR) || ' frames: ' || CAST(r AS VARCHAR) || ' ' || CAST(g AS VARCHAR) || ' ' || CAST(b AS VARCHAR) END AS description,
       CASE WHEN error IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS confidence, error,
       CASE WHEN error IS NOT NULL THEN CAST([] AS VARCHAR[]) WHEN g >= b THEN ['green'] ELSE ['blue'] END AS objects,
       CAST([] AS VARCHAR[]) AS actions, '' AS scene_context, CASE WHEN error IS NULL THEN events ELSE CAST([] AS VARCHAR[]) END AS temporal_events
FROM j"""
