"""DuckDB SQL of the registered queries, written apart from the Spark plans."""

from __future__ import annotations

#: Words that mark an error line, and what counts as a URL.
ERROR = r"\b(error|errors|failed|failure|exception|invalid|denied|forbidden|unauthorized|cannot|unable|traceback)\b"
URL = r"(https?://\S+|www\.\S+|[\w-]+\.(?:com|org|io|net|dev|app|gov|edu)\b\S*)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z]+', ' ', 'g'))"


def line_set(x: str) -> str:
    return f"list_distinct(list_filter(list_transform({x}, lambda l: {norm('l')}), lambda l: l <> ''))"


def sim(a: str, b: str) -> str:
    x, y = line_set(a), line_set(b)
    return f"(CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1.0 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END)"


def surplus(a: str, b: str) -> str:
    own, other = f"list_transform({a}, lambda q: {norm('q')})", f"list_transform({b}, lambda q: {norm('q')})"
    return f"list_filter({a}, lambda l, i: {norm('l')} <> '' AND len(list_filter({own}[1:i], lambda z: z = {norm('l')})) > len(list_filter({other}, lambda z: z = {norm('l')})))"


FRAMES = """
frames AS (
  SELECT user_id AS rec, row_number() OVER w - 1 AS pos,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t,
         list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))) AS lines,
         value, abs(value - lag(value) OVER w) / 500 AS moved, event_type, props
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

SEGMENTS = f"""{FRAMES},
seen AS (SELECT *, (pos = 0 OR coalesce(moved, 0) >= 0.1) AS seen FROM frames),
prevs AS (SELECT *, lag(lines) OVER (PARTITION BY rec, seen ORDER BY pos) AS before FROM seen),
splits AS (SELECT *, CASE WHEN seen AND before IS NOT NULL AND {sim('before', 'lines')} < 0.8 THEN 1 ELSE 0 END AS split FROM prevs),
segged AS (SELECT *, (sum(split) OVER (PARTITION BY rec ORDER BY pos))::BIGINT AS seg FROM splits),
segments AS (
  SELECT rec, seg, min(t) AS t_start, max(t) AS t_end, arg_max(lines, pos) FILTER (WHERE seen) AS lines, max(pos) AS keyframe
  FROM segged GROUP BY rec, seg)"""

STATES = f"""{SEGMENTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY seg) AS k FROM segments),
fold AS (
  SELECT rec, k, seg AS idx, t_start, t_end, lines, keyframe, 0::BIGINT AS pos FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.rec, n.k, CASE WHEN n.m THEN n.f_idx ELSE n.seg END, CASE WHEN n.m THEN n.f_start ELSE n.t_start END, n.t_end,
         CASE WHEN n.m THEN n.f_lines ELSE n.lines END, CASE WHEN n.m THEN n.f_key ELSE n.keyframe END, CASE WHEN n.m THEN n.f_pos ELSE n.f_pos + 1 END
  FROM (SELECT n.*, f.idx AS f_idx, f.t_start AS f_start, f.lines AS f_lines, f.keyframe AS f_key, f.pos AS f_pos, {sim('f.lines', 'n.lines')} >= 0.95 AS m
        FROM fold f JOIN numbered n ON n.rec = f.rec AND n.k = f.k + 1) n),
merged AS (SELECT rec, pos, any_value(idx) AS idx, any_value(t_start) AS t_start, max(t_end) AS t_end, any_value(lines) AS lines, any_value(keyframe) AS keyframe FROM fold GROUP BY rec, pos),
lagged AS (SELECT *, coalesce(lag(lines) OVER (PARTITION BY rec ORDER BY pos), []) AS prev_lines FROM merged),
diffed AS (SELECT *, {surplus('lines', 'prev_lines')} AS added, {surplus('prev_lines', 'lines')} AS removed FROM lagged),
typed AS (
  SELECT *, list_filter(added, lambda l: regexp_matches(l, '{ERROR}', 'i'))[1] AS error_line,
         list_filter(list_transform(added, lambda l: regexp_extract(l, '{URL}', 1, 'i')), lambda u: u <> '')[1] AS url,
         CASE WHEN len(prev_lines) > 0 THEN len(removed)::DOUBLE / len(prev_lines) ELSE 0 END AS gone
  FROM diffed),
evented AS (
  SELECT *, CASE WHEN pos = 0 THEN NULL WHEN error_line IS NOT NULL THEN 'error' WHEN gone >= 0.6 THEN 'navigate' WHEN len(added) > 0 OR len(removed) > 0 THEN 'edit' END AS event_type,
         CASE WHEN pos > 0 AND error_line IS NOT NULL THEN error_line END AS event_label,
         (len(added) + len(removed))::DOUBLE AS change
  FROM typed),
states AS (
  SELECT *, round(0.6 * (CASE WHEN max(change) OVER p > min(change) OVER p THEN (change - min(change) OVER p) / (max(change) OVER p - min(change) OVER p) ELSE 0 END)
                  + 0.3 * 0.0 + 0.1 * (CASE WHEN event_type IS NOT NULL THEN 1 ELSE 0 END), 4) AS salience
  FROM evented WINDOW p AS (PARTITION BY rec)),
totals AS (SELECT rec, count(*) AS n FROM states GROUP BY rec),
shared AS (
  SELECT rec, list_sort(list(line)) AS persistent
  FROM (SELECT rec, line, count(*) AS k FROM (SELECT rec, unnest(list_distinct(lines)) AS line FROM states) GROUP BY rec, line) JOIN totals USING (rec)
  WHERE k = n AND n > 1 GROUP BY rec),
persistent AS (SELECT rec, coalesce(persistent, []) AS persistent FROM totals LEFT JOIN shared USING (rec))"""

GRAY = """
pictures AS (
  SELECT label AS rec, vec_id, list_transform(embedding, lambda x: floor(greatest(0.0, least(255.0, (x::DOUBLE + 0.5) * 255)))::INTEGER) AS gray FROM embeddings),
gray AS (SELECT *, lag(gray) OVER (PARTITION BY rec ORDER BY vec_id) AS prev FROM pictures)"""


def states(select: str) -> str:
    return f"WITH RECURSIVE {STATES} {select}"


def segments(select: str) -> str:
    return f"WITH {SEGMENTS} {select}"


def frames(select: str) -> str:
    return f"WITH {FRAMES} {select}"


def gray(select: str) -> str:
    return f"WITH {GRAY} {select}"


CAPTION = """CASE event_type WHEN 'navigate' THEN CASE WHEN url IS NOT NULL THEN '➡ Navigated to ' || url ELSE '➡ Navigated' END
  WHEN 'error' THEN '⚠ Error: ' || event_label WHEN 'edit' THEN '✏ Edited' ELSE '' END"""


def clock(x: str) -> str:
    s = f"round_even({x}, 0)::BIGINT"
    return f"(({s}) // 60)::VARCHAR || ':' || lpad((({s}) % 60)::VARCHAR, 2, '0')"


def stamp(x: str, sep: str) -> str:
    ms = f"round_even(greatest({x}, 0.0) * 1000, 0)::BIGINT"
    return f"printf('%02d:%02d:%02d{sep}%03d', ({ms}) // 3600000, (({ms}) // 60000) % 60, (({ms}) // 1000) % 60, ({ms}) % 1000)"


BODY = "concat_ws(' — ', nullif(" + CAPTION + ", ''), nullif(array_to_string(lines, ' · '), ''))"


# ---- the full index

_WIDE = "CASE kind WHEN 'view' THEN 8 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'error' THEN 2 ELSE 1 END"
_HIGH = "CASE kind WHEN 'view' THEN 8 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 3 ELSE 2 END"
_PIXEL = "CASE WHEN i % 8 >= x0 AND i % 8 < x0 + wide AND i // 8 >= y0 AND i // 8 < y0 + high THEN 200 ELSE (i * 37 + rec * 11) % 120 END"


def masked(x: str) -> str:
    """Masks the two kinds of secrets that the made-up texts have."""
    return rf"regexp_replace(replace({x}, '4111 1111 1111 1111', '[REDACTED:credit_card]'), 'u\d+@ex\.com', '[REDACTED:email]', 'g')"


SHOTS = """
raw AS (
  SELECT user_id AS rec, event_id, ts, event_type AS kind, value, event_id % 97 AS k,
         CASE event_type WHEN 'view' THEN 'www.ex.com/' || (event_id % 97) % 9 WHEN 'click' THEN 'Open item ' || (event_id % 97) % 4 WHEN 'signup' THEN 'Mail u' || (event_id % 97) % 5 || '@ex.com'
           WHEN 'purchase' THEN CASE WHEN (event_id % 97) % 3 = 0 THEN 'Card 4111 1111 1111 1111' ELSE 'Buy ' || (event_id % 97) % 5 END
           ELSE CASE WHEN (event_id % 97) % 4 = 0 THEN 'Error ' || (event_id % 97) % 6 || ' denied' ELSE 'Note ' || (event_id % 97) % 3 END END AS said
  FROM events),
shots AS (
  SELECT rec, row_number() OVER w - 1 AS pos, ((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY rec)) // 1000) / 1000.0 AS t,
         abs(value - lag(value) OVER w) / 500 AS moved, kind, k, value,
         list({'text': said, 'x': (k * 3 % 8)::INTEGER, 'y': (k * 5 % 8)::INTEGER, 'w': (1 + k % 3)::INTEGER, 'h': (1 + k % 2)::INTEGER}) OVER (PARTITION BY rec ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS given
  FROM raw WINDOW w AS (PARTITION BY rec ORDER BY ts, event_id)),
read AS (
  SELECT * EXCLUDE given, list_transform(list_sort(list_transform(given, lambda b, i: {'y': b['y'], 'x': b['x'], 'i': i, 'text': b['text'], 'w': b['w'], 'h': b['h']})), lambda b: {'text': b['text'], 'x': b['x'], 'y': b['y'], 'w': b['w'], 'h': b['h']}) AS boxes FROM shots),
shown AS (SELECT *, list_transform(boxes, lambda b: b['text']) AS lines FROM read)"""

def _blur(side: int) -> str:
    """The picture ``raw`` with the boxes ``hidden`` blurred one after the other, each by itself, its borders mirrored; sides under six."""
    fold = lambda at, n: f"(CASE WHEN {n} = 1 THEN 0 WHEN {at} < 0 THEN -({at}) WHEN {at} >= {n} THEN 2 * {n} - 2 - ({at}) ELSE {at} END)"
    x0, y0, x1, y1 = "greatest(0, b['x'])", "greatest(0, b['y'])", f"least({side}, b['x'] + b['w'])", f"least({side}, b['y'] + b['h'])"
    kernel = f"(CASE WHEN least({x1} - {x0}, {y1} - {y0}) < 4 THEN [0.25, 0.5, 0.25]::DOUBLE[] ELSE [0.0625, 0.25, 0.375, 0.25, 0.0625]::DOUBLE[] END)"
    n = f"len({kernel})"
    dx, dy = f"(i % {side} - {x0} + j % {n} - {n} // 2)", f"(i // {side} - {y0} + j // {n} - {n} // 2)"
    value = f"a['g'][1 + ({y0} + {fold(dy, f'({y1} - {y0})')}) * {side} + {x0} + {fold(dx, f'({x1} - {x0})')}]"
    one = f"floor(list_sum(list_transform(range(0, {n} * {n}), lambda j: {kernel}[j % {n} + 1] * {kernel}[j // {n} + 1] * {value})) + 0.5)::INTEGER"
    inside = f"i % {side} >= {x0} AND i % {side} < {x1} AND i // {side} >= {y0} AND i // {side} < {y1}"
    none = "'x': 0, 'y': 0, 'w': 0, 'h': 0"
    boxes = "list_transform(hidden, lambda b: {'g': []::INTEGER[], 'x': b['x'], 'y': b['y'], 'w': b['w'], 'h': b['h']})"
    turn = f"{{'g': list_transform(range(0, {side * side}), lambda i: CASE WHEN {inside} THEN {one} ELSE a['g'][i + 1] END), {none}}}"
    return f"CASE WHEN len(hidden) = 0 THEN raw ELSE list_reduce(list_prepend({{'g': raw, {none}}}, {boxes}), lambda a, b: {turn})['g'] END"


def index_sql(shots: str, side: int, drawn: str, points: str) -> str:
    """All tables of a whole index: ``shots`` ends in shown (rec, pos, t, moved, kind, k, boxes, lines), ``drawn`` gives each state's raw picture, ``points`` (rec, t, x, y)."""
    n, cells = side, side * side
    return f"""{shots},
seen AS (SELECT *, (pos = 0 OR coalesce(moved, 0) >= 0.05) AS seen FROM shown),
prevs AS (SELECT *, lag(lines) OVER (PARTITION BY rec, seen ORDER BY pos) AS before FROM seen),
splits AS (SELECT *, CASE WHEN seen AND before IS NOT NULL AND {sim('before', 'lines')} < 0.8 THEN 1 ELSE 0 END AS split FROM prevs),
segged AS (SELECT *, (sum(split) OVER (PARTITION BY rec ORDER BY pos))::BIGINT AS seg FROM splits),
segments AS (
  SELECT rec, seg, min(t) AS t_start, max(t) AS t_end, arg_max(kind, pos) AS kind, arg_max(k, pos) AS k,
         list_transform(arg_max(boxes, pos), lambda b: {{'text': {masked("b['text']")}, 'hit': {masked("b['text']")} <> b['text'], 'x': b['x'], 'y': b['y'], 'w': b['w'], 'h': b['h']}}) AS boxes
  FROM segged GROUP BY rec, seg),
numbered AS (SELECT *, list_transform(boxes, lambda b: b['text']) AS lines, row_number() OVER (PARTITION BY rec ORDER BY seg) AS n FROM segments),
fold AS (
  SELECT rec, n, n AS keep, 0::BIGINT AS pos, lines, t_end FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.rec, x.n, CASE WHEN x.m THEN x.f_keep ELSE x.n END, CASE WHEN x.m THEN x.f_pos ELSE x.f_pos + 1 END, CASE WHEN x.m THEN x.f_lines ELSE x.lines END, x.t_end
  FROM (SELECT s.rec, s.n, s.lines, s.t_end, f.keep AS f_keep, f.pos AS f_pos, f.lines AS f_lines, {sim('f.lines', 's.lines')} >= 0.95 AS m
        FROM fold f JOIN numbered s ON s.rec = f.rec AND s.n = f.n + 1) x),
merged AS (
  SELECT f.rec, f.pos, s.seg AS idx, round(s.t_start, 3) AS t_start, round(f.t_end, 3) AS t_end, s.kind, s.k, s.boxes, s.lines
  FROM (SELECT rec, pos, any_value(keep) AS keep, max(t_end) AS t_end FROM fold GROUP BY rec, pos) f JOIN numbered s ON s.rec = f.rec AND s.n = f.keep),
{drawn},
pictured AS (SELECT *, {_blur(side)} AS gray FROM (SELECT *, list_filter(boxes, lambda b: b['hit']) AS hidden FROM drawn)),
lagged AS (SELECT *, coalesce(lag(lines) OVER w, []) AS prev_lines, lag(gray) OVER w AS prev FROM pictured WINDOW w AS (PARTITION BY rec ORDER BY pos)),
diffed AS (SELECT *, {surplus('lines', 'prev_lines')} AS added, {surplus('prev_lines', 'lines')} AS removed, list_filter(range(0, {cells}), lambda i: abs(gray[i + 1] - prev[i + 1]) > 25) AS hit FROM lagged),
bound AS (
  SELECT *, list_min(list_transform(hit, lambda i: i % {n})) AS bx, list_max(list_transform(hit, lambda i: i % {n})) AS cx, list_min(list_transform(hit, lambda i: i // {n})) AS by_, list_max(list_transform(hit, lambda i: i // {n})) AS cy FROM diffed),
shaped AS (
  SELECT *, CASE WHEN prev IS NULL OR len(hit) = 0 THEN NULL WHEN len(hit) / {cells}.0 >= 0.45 THEN 'full' WHEN (cy - by_ + 1) / {n}.0 >= 0.5 AND (cx - bx + 1) / {n}.0 >= 0.5 THEN 'band' WHEN len(hit) / {cells}.0 <= 0.08 THEN 'local' ELSE 'overlay' END AS shape,
         CASE WHEN prev IS NULL OR len(hit) = 0 THEN '0,0,0,0' ELSE bx || ',' || by_ || ',' || (cx - bx + 1) || ',' || (cy - by_ + 1) END AS region FROM bound),
{points},
inside AS (
  SELECT s.rec, s.idx, list(p.x ORDER BY p.t DESC, p.x DESC, p.y DESC)[1:5] AS xs, list(p.y ORDER BY p.t DESC, p.x DESC, p.y DESC)[1:5] AS ys
  FROM merged s JOIN points p ON p.rec = s.rec AND p.t >= s.t_start AND p.t <= s.t_end GROUP BY 1, 2),
touched AS (SELECT s.*, list_sort(i.xs)[len(i.xs) // 2 + 1] AS px, list_sort(i.ys)[len(i.ys) // 2 + 1] AS py FROM shaped s LEFT JOIN inside i ON i.rec = s.rec AND i.idx = s.idx),
labelled AS (
  SELECT *, list_min(list_transform(boxes, lambda b, i: {{'d': (b['x'] + b['w'] / 2.0 - px) * (b['x'] + b['w'] / 2.0 - px) + (b['y'] + b['h'] / 2.0 - py) * (b['y'] + b['h'] / 2.0 - py), 'i': i, 'text': b['text']}})) AS near,
         list_filter(list_transform(boxes, lambda b, i: {{'i': i, 'b': b}}), lambda z: {norm("z['b']['text']")} = {norm('added[1]')})[1] AS goal,
         list_transform(prev_lines, lambda l: {norm('l')}) AS known
  FROM touched),
fielded AS (
  SELECT *, CASE WHEN px IS NOT NULL AND sqrt(near['d']) <= 0.15 * sqrt({2 * cells}.0) THEN near['text'] END AS label,
         list_min(list_filter(list_transform(boxes, lambda b, i: CASE WHEN i <> goal['i'] AND list_contains(known, {norm("b['text']")}) AND b['y'] <= goal['b']['y'] + goal['b']['h']
           THEN {{'d': (b['x'] - goal['b']['x']) * (b['x'] - goal['b']['x']) + (b['y'] - goal['b']['y']) * (b['y'] - goal['b']['y']), 'i': i, 'text': b['text']}} END), lambda z: z IS NOT NULL))['text'] AS field
  FROM labelled),
typed AS (
  SELECT *, list_filter(added, lambda l: regexp_matches(l, '{ERROR}', 'i'))[1] AS error_line,
         list_filter(list_transform(added, lambda l: regexp_extract(l, '{URL}', 1, 'i')), lambda u: u <> '')[1] AS url,
         CASE WHEN len(prev_lines) > 0 THEN len(removed)::DOUBLE / len(prev_lines) ELSE 0 END AS gone
  FROM fielded),
kinds AS (
  SELECT *, CASE WHEN pos = 0 THEN NULL WHEN error_line IS NOT NULL THEN 'error' WHEN coalesce(shape, '') = 'full' OR gone >= 0.6 THEN 'navigate' WHEN shape = 'overlay' AND len(added) > 0 THEN 'open_dialog'
    WHEN shape = 'band' THEN 'scroll' WHEN len(added) > 0 AND coalesce(field, '') <> '' THEN 'type' WHEN px IS NOT NULL AND (shape IS NULL OR shape = 'local') THEN 'click'
    WHEN len(added) > 0 OR len(removed) > 0 OR shape = 'local' THEN 'edit' END AS event_type,
    list_transform(range(0, {cells}), lambda i: (CASE WHEN i // {n} = 0 THEN gray[i + 1 + {n}] ELSE gray[i + 1 - {n}] END) + (CASE WHEN i // {n} = {n - 1} THEN gray[i + 1 - {n}] ELSE gray[i + 1 + {n}] END)
      + (CASE WHEN i % {n} = 0 THEN gray[i + 2] ELSE gray[i] END) + (CASE WHEN i % {n} = {n - 1} THEN gray[i] ELSE gray[i + 2] END) - 4 * gray[i + 1]) AS edges,
    (len(added) + len(removed))::DOUBLE AS change
  FROM typed),
scored AS (
  SELECT *, list_var_pop(list_transform(edges, lambda x: x::DOUBLE)) AS sharp,
         CASE event_type WHEN 'error' THEN 0.8 WHEN 'navigate' THEN 0.7 WHEN 'open_dialog' THEN 0.6 WHEN 'scroll' THEN 0.5 WHEN 'type' THEN 0.6 WHEN 'click' THEN 0.6 WHEN 'edit' THEN 0.4 END AS confidence,
         CASE event_type WHEN 'error' THEN error_line WHEN 'open_dialog' THEN added[1] WHEN 'click' THEN label END AS event_label,
         CASE event_type WHEN 'type' THEN field END AS event_field,
         CASE event_type WHEN 'navigate' THEN url WHEN 'type' THEN added[1] END AS event_value
  FROM kinds),
states AS (
  SELECT *, round(0.6 * (CASE WHEN max(change) OVER p > min(change) OVER p THEN (change - min(change) OVER p) / (max(change) OVER p - min(change) OVER p) ELSE 0 END)
                + 0.3 * (CASE WHEN max(sharp) OVER p > min(sharp) OVER p THEN (sharp - min(sharp) OVER p) / (max(sharp) OVER p - min(sharp) OVER p) ELSE 0 END)
                + 0.1 * (CASE WHEN event_type IS NOT NULL THEN 1 ELSE 0 END), 4) AS salience,
         'frames/' || lpad(idx::VARCHAR, 5, '0') || '.png' AS keyframe, 'frames/' || lpad(idx::VARCHAR, 5, '0') || '_thumb.png' AS thumbnail
  FROM scored WINDOW p AS (PARTITION BY rec)),
totals AS (SELECT rec, count(*) AS n FROM states GROUP BY rec),
shared AS (
  SELECT rec, list_sort(list(line)) AS persistent
  FROM (SELECT rec, line, count(*) AS c FROM (SELECT rec, unnest(list_distinct(lines)) AS line FROM states) GROUP BY rec, line) JOIN totals USING (rec)
  WHERE c = n AND n > 1 GROUP BY rec),
speech AS (SELECT rec, pos AS n, round(t, 3) AS start_t, round(t + 60, 3) AS end_t, 'step ' || k || ' of [REDACTED:email]' AS text FROM shots WHERE kind = 'error'),
noted AS (SELECT rec, note, count(*) AS n, min(pos) AS first FROM (SELECT rec, pos, CASE WHEN k % 31 = 0 THEN 'text reading failed: blurred' WHEN k % 47 = 1 THEN 'low light' END AS note FROM shots) WHERE note IS NOT NULL GROUP BY rec, note),
recordings AS (SELECT rec, 'rec' || rec || '.mp4' AS video, round(greatest(max(t), max(last)), 3) AS duration FROM shots JOIN (SELECT rec, max(t_end) AS last FROM states GROUP BY rec) USING (rec) GROUP BY rec)"""


PLACED = f"placed AS (SELECT *, {_WIDE} AS wide, {_HIGH} AS high, CASE WHEN kind = 'view' THEN 0 ELSE k % 8 END AS x0, CASE WHEN kind = 'view' THEN 0 ELSE k // 8 % 8 END AS y0 FROM merged), drawn AS (SELECT *, list_transform(range(0, 64), lambda i: {_PIXEL}) AS raw FROM placed)"
POINTS = "points AS (SELECT rec, t, k % 8 AS x, k // 3 % 8 AS y FROM shots WHERE kind IN ('click', 'purchase'))"
FULL = index_sql(SHOTS, 8, PLACED, POINTS)

#: The same recordings on screens of 24 x 24: a panel whose brightness tells the kind, and a cursor of 2 x 2 beside it.
_PANEL = "CASE kind WHEN 'view' THEN 220 WHEN 'click' THEN 60 WHEN 'signup' THEN 100 WHEN 'purchase' THEN 140 WHEN 'error' THEN 180 ELSE 20 END"
SCREENS = index_sql(
    SHOTS.replace("'x': (k * 3 % 8)::INTEGER, 'y': (k * 5 % 8)::INTEGER, 'w': (1 + k % 3)::INTEGER, 'h': (1 + k % 2)::INTEGER", "'x': (k * 3 % 21)::INTEGER, 'y': (k * 5 % 23)::INTEGER, 'w': (1 + k % 5)::INTEGER, 'h': (2 + k % 4)::INTEGER"),
    24,
    f"drawn AS (SELECT *, list_transform(range(0, 576), lambda i: CASE WHEN i % 24 >= 12 THEN {_PANEL} + i // 24 WHEN i % 24 - k * 5 % 10 IN (0, 1) AND i // 24 - k * 7 % 22 IN (0, 1) THEN 255 ELSE 10 END) AS raw FROM merged)",
    # Two squares of 2 x 2 change where the cursor was and is, if they do not touch; the upper one, or the left one, is found.
    """went AS (SELECT rec, pos, t, k * 5 % 10 AS cx, k * 7 % 22 AS cy, lag(k * 5 % 10) OVER w AS ox, lag(k * 7 % 22) OVER w AS oy FROM shots WINDOW w AS (PARTITION BY rec ORDER BY pos)),
points AS (SELECT rec, t, CASE WHEN (oy, ox) < (cy, cx) THEN ox ELSE cx END AS x, CASE WHEN (oy, ox) < (cy, cx) THEN oy ELSE cy END AS y FROM went WHERE greatest(abs(cx - ox), abs(cy - oy)) >= 3)""",
)


def full(select: str) -> str:
    return f"WITH RECURSIVE {FULL} {select}"


def screens(select: str) -> str:
    return f"WITH RECURSIVE {SCREENS} {select}"


FULL_CAPTION = """CASE event_type WHEN 'click' THEN CASE WHEN event_label IS NOT NULL THEN '👆 Clicked “' || event_label || '”' ELSE '👆 Clicked' END
  WHEN 'type' THEN '⌨ Typed “' || event_value || '”' || CASE WHEN event_field IS NOT NULL THEN ' into ' || event_field ELSE '' END
  WHEN 'navigate' THEN CASE WHEN event_value IS NOT NULL THEN '➡ Navigated to ' || event_value ELSE '➡ Navigated' END
  WHEN 'open_dialog' THEN CASE WHEN event_label IS NOT NULL THEN '🪟 Opened dialog: ' || event_label ELSE '🪟 Opened dialog' END
  WHEN 'error' THEN '⚠ Error: ' || event_label WHEN 'scroll' THEN '↕ Scrolled' WHEN 'edit' THEN '✏ Edited' ELSE '' END"""
FULL_BODY = "coalesce(nullif(concat_ws(' — ', nullif(" + FULL_CAPTION + ", ''), nullif(array_to_string(lines, ' · '), '')), ''), 'State ' || idx)"


_LIT = "i % 24 >= {x0} AND i % 24 < {x0} + {w} AND i // 24 >= {y0} AND i // 24 < {y0} + {h}"
_DOT = " OR ".join("(" + _LIT.format(x0=f"(vec_id * {a} % 24)", y0=f"(vec_id * {b} % 24)", w=w, h=h) + ")" for a, b, w, h in ((7, 11, 2, "(2 + vec_id % 2)"), (13, 5, 1, 4), (3, 17, 5, 3)))


def dots(select: str) -> str:
    return f"""WITH RECURSIVE bright AS (SELECT label AS rec, vec_id, list_transform(range(0, 576), lambda i: CASE WHEN {_DOT} THEN 255 ELSE 10 END) AS g FROM embeddings),
dots AS (SELECT *, lag(g) OVER (PARTITION BY rec ORDER BY vec_id) AS prev FROM bright) {select}"""


# ---- secrets

#: Kinds and patterns in priority order.
KINDS = (
    ("private_key", r"-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api_key", r"\b(?:sk|pk|rk|ghp|gho|ghu|ghs|xox[baprs]|AIza)[-_][A-Za-z0-9-_]{8,}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b"),
)


def _found(rank: int, kind: str, pattern: str) -> str:
    """Matches of a kind by line: places add up from the pieces between matches."""
    p = pattern.replace("'", "''")
    # A letter beyond ASCII is part of a word, which this engine's \\b does not know: next to digits an underscore stands for it.
    seen = r"regexp_replace(line, '[^\x00-\x7F]', '_', 'g')" if kind in ("aws_key", "ssn", "credit_card") else "line"
    return f"""SELECT doc_id, n, line, unnest(list_transform(m, lambda x, i: {{'s': list_sum(list_transform(p[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0), 't': x}})) AS f, {rank} AS rank, '{kind}' AS k
  FROM (SELECT doc_id, n, line, regexp_extract_all({seen}, '{p}') AS m, string_split_regex({seen}, '{p}') AS p FROM lines WHERE regexp_matches({seen}, '{p}'))"""


_CORE = "trim(f.t, '.,;:!?()[]{}''\"')"
_LUHN = "list_reverse(regexp_extract_all(f.t, '\\d'))"
SECRETS = f"""
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
every AS ({" UNION ALL ".join(_found(i, k, p) for i, (k, p) in enumerate(KINDS))} UNION ALL {_found(len(KINDS), "secret", "[^ \\t\\n\\x0b\\f\\r]+")}),
fit AS (
  SELECT doc_id, n, line, f.s::BIGINT AS s, (f.s + length(f.t))::BIGINT AS e, rank, k FROM every
  WHERE CASE k WHEN 'credit_card' THEN len({_LUHN}) BETWEEN 13 AND 19 AND list_sum(list_transform({_LUHN}, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER < 5 THEN x::INTEGER * 2 ELSE x::INTEGER * 2 - 9 END)) % 10 = 0
    WHEN 'secret' THEN CASE WHEN length({_CORE}) >= 20 AND regexp_matches({_CORE}, '\\p{{L}}') AND regexp_matches({_CORE}, '\\p{{Nd}}')
      THEN -list_sum(list_transform(list_transform(list_distinct(string_split({_CORE}, '')), lambda x: len(list_filter(string_split({_CORE}, ''), lambda z: z = x))::DOUBLE / length({_CORE})), lambda q: q * log2(q))) >= 3.5 ELSE false END
    ELSE true END),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY s, e DESC, rank) AS i FROM fit),
greedy AS (
  SELECT doc_id, n, i, e AS until, true AS kept FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.doc_id, o.n, o.i, CASE WHEN o.s >= g.until THEN o.e ELSE g.until END, o.s >= g.until FROM greedy g JOIN ordered o ON o.doc_id = g.doc_id AND o.n = g.n AND o.i = g.i + 1),
spans AS (SELECT o.doc_id, o.n, o.line, o.s, o.e, o.k FROM ordered o JOIN greedy g ON g.doc_id = o.doc_id AND g.n = o.n AND g.i = o.i WHERE g.kept)"""


def secrets(select: str) -> str:
    return f"WITH RECURSIVE {SECRETS} {select}"
