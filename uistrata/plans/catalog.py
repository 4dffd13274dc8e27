"""All registered queries and the SQL that checks them.

A query takes (spark, sf_dir) and runs over whole tables.  Arrays and structs
are shown as text or single columns so that results compare by value.
"""

from __future__ import annotations

import importlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels, redact, text
from ..operators import document, events, index, manifest, recording, sequence
from ..sources import stores
from ..streaming import incremental, segments, windows
from . import adapters as A
from . import evalqa, sql, views
from .registry import QUERIES, SQL, query

def queries() -> dict:
    importlib.import_module(f"{__package__}.files")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module(f"{__package__}.files")
    return dict(SQL)


def shown(c) -> F.Column:
    return F.array_join(c, "|")


# ---- text scalars


@query(f"SELECT conv_id, turn, i - 1 AS n, {sql.norm('x')} AS norm FROM (SELECT conv_id, turn, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split(text, chr(10)) AS l FROM conversations))")
def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("n", "x")).select("conv_id", "turn", "n", text.normalize_line(F.col("x")).alias("norm"))


@query(sql.frames(f", p AS (SELECT *, lag(lines) OVER (PARTITION BY rec ORDER BY pos) AS before FROM frames) SELECT rec, pos, array_to_string({sql.surplus('lines', 'before')}, '|') AS added, array_to_string({sql.surplus('before', 'lines')}, '|') AS removed FROM p WHERE before IS NOT NULL"))
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir).withColumn("before", F.lag("lines").over(W.partitionBy("rec").orderBy("pos"))).where("before is not null")
    return f.select("rec", "pos", shown(text.surplus(F.col("lines"), F.col("before"))).alias("added"), shown(text.surplus(F.col("before"), F.col("lines"))).alias("removed"))


@query(sql.frames(f", p AS (SELECT *, lag(lines) OVER (PARTITION BY rec ORDER BY pos) AS before FROM frames) SELECT rec, pos, round({sql.sim('before', 'lines')}, 6) AS similarity FROM p WHERE before IS NOT NULL"))
def text_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir).withColumn("before", F.lag("lines").over(W.partitionBy("rec").orderBy("pos"))).where("before is not null")
    return f.select("rec", "pos", F.round(text.text_similarity(F.col("before"), F.col("lines")), 6).alias("similarity"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), '|') AS tokens FROM benchmark")
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", shown(F.array_sort(text.token_set(F.col("text")))).alias("tokens"))


@query("SELECT doc_id, round_even(length(text) / 4.0, 0)::BIGINT AS cost_tokens, length(text) // 4 AS report_tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("cost_tokens"), text.token_estimate(F.col("text"), False).alias("report_tokens"))


@query(r"SELECT item_id, regexp_replace(' ' || chr(65 + item_id % 4) || ') ' || text, '^\s*[A-Za-z][).:]\s*', '') AS plain FROM (SELECT item_id::INTEGER AS item_id, text FROM benchmark)")
def strip_choice_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("item_id"), "text")
    labelled = F.concat(F.lit(" "), F.char(65 + F.col("item_id") % 4), F.lit(") "), "text")
    return b.select("item_id", text.strip_choice_label(labelled).alias("plain"))


@query(f"SELECT page_id, nullif(regexp_extract(url, '{sql.URL}', 1, 'i'), '') AS found FROM pages")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", text.first_url(F.array("url")).alias("found"))


@query(
    "SELECT item_id, CASE WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in text.COUNT_WORDS)
    + " THEN 'count' WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in text.ACTION_WORDS)
    + " THEN 'action' WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in text.VISUAL_WORDS)
    + " THEN 'visual' ELSE 'state' END AS bucket FROM benchmark"
)
def classify_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", text.classify_bucket(F.col("text")).alias("bucket"))


@query(f"SELECT event_id, event_type AS line FROM events WHERE regexp_matches(event_type, '{sql.ERROR}', 'i')")
def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", text.first_error(F.array("event_type")).alias("line"))
    return e.where("line is not null")


@query("SELECT doc_id, CASE WHEN lower(trim(coalesce(CASE doc_id % 3 WHEN 0 THEN ' iOS' WHEN 1 THEN 'Android' ELSE source END, ''))) IN ('ios', 'android') THEN 'mobile' ELSE 'desktop' END AS domain FROM documents")
def domain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.when(F.col("doc_id") % 3 == 0, " iOS").when(F.col("doc_id") % 3 == 1, "Android").otherwise(F.col("source"))
    return A.table(spark, sf_dir, "documents").select("doc_id", text.domain_of(system).alias("domain"))


# ---- sources and sequences


@query(sql.frames("SELECT rec, pos // 3 AS out_idx, pos, round(t, 3) AS t FROM frames WHERE pos % 3 = 0"))
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.sampled(A.frames(spark, sf_dir), 15.0, 5.0).select("rec", "out_idx", "pos", F.round("t", 3).alias("t"))


@query(sql.frames("SELECT rec, count(*) AS frames, round(max(t), 3) AS duration, round(CASE WHEN max(t) > 0 THEN (count(*) - 1) / max(t) ELSE 0 END, 6) AS fps FROM frames GROUP BY rec"))
def recording_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = F.when(F.max("t") > 0, (F.count(F.lit(1)) - 1) / F.max("t")).otherwise(0.0)
    return A.frames(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("frames"), F.round(F.max("t"), 3).alias("duration"), F.round(fps, 6).alias("fps"))


_FLAGS = ", flagged AS (SELECT *, pos - row_number() OVER (PARTITION BY rec ORDER BY pos) AS run FROM frames WHERE value >= 100), runs AS (SELECT rec, run, min(t) AS t_start, max(t) AS t_end, max(value) AS peak_score FROM flagged GROUP BY rec, run), isl AS (SELECT r.rec, t_start, t_end, min(f.pos) AS peak_frame, peak_score FROM runs r JOIN flagged f ON f.rec = r.rec AND f.run = r.run AND f.value = r.peak_score GROUP BY ALL)"


@query(sql.frames("SELECT rec, pos, value >= 100 AS flag FROM frames"))
def flag_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frames(spark, sf_dir).select("rec", "pos", (F.col("value") >= 100).alias("flag"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.islands(A.frames(spark, sf_dir).withColumn("score", F.col("value")), 100)


@query(sql.frames(f"{_FLAGS} SELECT rec, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, peak_frame, peak_score FROM isl"))
def group_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir).withColumns({"t_start": F.round("t_start", 3), "t_end": F.round("t_end", 3)})


@query(sql.frames(f"{_FLAGS}, s AS (SELECT i.*, least(f.moved, 1.0) AS sim FROM isl i JOIN frames f ON f.rec = i.rec AND f.pos = i.peak_frame WHERE f.moved IS NOT NULL) SELECT rec, peak_frame, CASE WHEN sim < 0.5 THEN 'cut' ELSE 'motion' END AS type, round(CASE WHEN sim < 0.5 THEN (0.5 - sim) / 0.5 ELSE (sim - 0.5) / (1 - 0.5) END, 3) AS confidence FROM s"))
def classify_cut_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir).select("rec", F.col("pos").alias("peak_frame"), F.when(F.col("moved").isNotNull(), F.least("moved", F.lit(1.0))).alias("sim")).where("sim is not null")
    kind = sequence.cut_or_motion(F.col("sim"))
    return _islands(spark, sf_dir).join(f, ["rec", "peak_frame"]).select("rec", "peak_frame", kind["type"].alias("type"), kind["confidence"].alias("confidence"))


@query(sql.segments("SELECT rec, seg, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, array_to_string(lines, '|') AS lines, keyframe FROM segments"))
def segment_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.segments(spark, sf_dir).select("rec", "seg", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), shown("lines").alias("lines"), "keyframe")


@query(
    "WITH RECURSIVE "
    + sql.FRAMES
    + """, walk AS (
  SELECT rec, pos, value AS prev, value AS anchor, 0::BIGINT AS seg FROM frames WHERE pos = 0
  UNION ALL
  SELECT f.rec, f.pos, f.value, CASE WHEN abs(f.value - w.prev) >= 120 OR abs(f.value - w.anchor) >= 120 THEN f.value ELSE w.anchor END,
         w.seg + CASE WHEN abs(f.value - w.prev) >= 120 OR abs(f.value - w.anchor) >= 120 THEN 1 ELSE 0 END
  FROM walk w JOIN frames f ON f.rec = w.rec AND f.pos = w.pos + 1)
SELECT rec, pos, seg FROM walk"""
)
def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.segment_by_motion(A.frames(spark, sf_dir).select("rec", "pos", F.col("value").alias("x")), 120.0).select("rec", "pos", F.col("seg").cast("bigint").alias("seg"))


@query(sql.states("SELECT rec, pos, idx, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, array_to_string(lines, '|') AS lines FROM merged"))
def dedupe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sequence.merge_near(A.segments(spark, sf_dir), A.MERGE)
    return s.select("rec", "pos", "idx", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), shown("lines").alias("lines"))


@query(sql.states("SELECT rec, idx, array_to_string(added, '|') AS added, array_to_string(removed, '|') AS removed FROM states"))
def state_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.states(spark, sf_dir).select("rec", "idx", shown("added").alias("added"), shown("removed").alias("removed"))


@query(sql.states("SELECT rec, idx, event_type, event_label FROM states WHERE event_type IS NOT NULL"))
def classify_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.states(spark, sf_dir).where("event is not null").select("rec", "idx", F.col("event.type").alias("event_type"), F.col("event.label").alias("event_label"))


_STATE = (
    "SELECT rec, pos, idx, t_start, t_end, keyframe, thumbnail, array_to_string(lines, '|') AS lines, array_to_string(added, '|') AS added, array_to_string(removed, '|') AS removed, px AS x, py AS y, label, "
    "event_type, CASE WHEN event_type IS NOT NULL THEN region END AS region, event_label, event_field, event_value, confidence, salience FROM states"
)


def _state_rows(s: DataFrame) -> DataFrame:
    return s.select(
        "rec",
        "pos",
        "idx",
        "t_start",
        "t_end",
        "keyframe",
        "thumbnail",
        shown("lines").alias("lines"),
        shown("added").alias("added"),
        shown("removed").alias("removed"),
        F.col("interaction.x").cast("bigint").alias("x"),
        F.col("interaction.y").cast("bigint").alias("y"),
        F.col("interaction.label").alias("label"),
        F.col("event.type").alias("event_type"),
        F.array_join(F.col("event.region").cast("array<string>"), ",").alias("region"),
        F.col("event.label").alias("event_label"),
        F.col("event.field").alias("event_field"),
        F.col("event.value").alias("event_value"),
        F.col("event.confidence").alias("confidence"),
        "salience",
    )


@query(sql.full(_STATE))
def ui_state_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: text masked, states merged, interactions, typed events, sharpness and salience."""
    return _state_rows(A.full_states(spark, sf_dir))


@query(sql.screens(_STATE))
def pictured_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build from pictures and texts alone: the cursor is found in the pictures, masked text is blurred in them."""
    return _state_rows(A.screen_states(spark, sf_dir))


@query(sql.screens("SELECT rec, t, x::INTEGER AS x, y::INTEGER AS y FROM points"))
def tracked_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each frame shows the cursor against the one before: a pass that carries the last picture."""
    f = A.screens(spark, sf_dir)
    return sequence.tracked_cursor(f.select("rec", "pos", "t", A.screen(F.col("kind"), F.col("k")).alias("gray")), A.SCREEN)


@query(sql.screens("SELECT rec, idx, array_to_string(gray, ',') AS gray FROM states"))
def blurred_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyframes with every box of masked text blurred, and no pixel beside them changed."""
    return A.screen_states(spark, sf_dir, with_gray=True).select("rec", "idx", F.array_join(F.col("gray").cast("array<string>"), ",").alias("gray"))


@query(sql.full("SELECT rec, idx, b.i - 1 AS n, b.box['text'] AS text, b.box['x'] || ',' || b.box['y'] || ',' || b.box['w'] || ',' || b.box['h'] AS box FROM (SELECT rec, idx, unnest(list_transform(boxes, lambda b, i: {'i': i, 'box': b})) AS b FROM states)"))
def state_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of masked text in reading order."""
    each = A.full_states(spark, sf_dir).select("rec", "idx", F.posexplode("boxes").alias("n", "b"))
    return each.select("rec", "idx", F.col("n").cast("bigint").alias("n"), F.col("b.text").alias("text"), F.array_join(F.col("b.box").cast("array<string>"), ",").alias("box"))


@query(sql.full("SELECT rec, idx, round(sharp + 0.0001, 3) AS sharpness, change FROM states"))
def state_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness of each state's keyframe beside its change of text."""
    s = A.full_states(spark, sf_dir, with_gray=True)
    sharp = F.round(pixels.sharpness(F.col("gray"), F.lit(A.WIDTH)) + 0.0001, 3)
    return s.select("rec", "idx", sharp.alias("sharpness"), (F.size("added") + F.size("removed")).cast("double").alias("change"))


# ---- queries on the index

_FOUND = "SELECT rec, idx, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, event_type, "


def _found(df: DataFrame) -> DataFrame:
    return df.select("rec", "idx", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), "event_type", shown("matches").alias("matches"))


@query(sql.states(f"{_FOUND} array_to_string(list_filter(lines, lambda l: contains(lower(l), 'sign')), '|') AS matches FROM states WHERE len(list_filter(lines, lambda l: contains(lower(l), 'sign'))) > 0"))
def search_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(index.search_index(A.states(spark, sf_dir), pattern="SIGN"))


@query(sql.states(f"{_FOUND} '' AS matches FROM states WHERE t_end >= 100000 AND t_start <= 900000"))
def search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(index.search_index(A.states(spark, sf_dir), since=100000.0, until=900000.0))


@query(sql.states(f"{_FOUND} '' AS matches FROM states WHERE event_type = 'error'"))
def search_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(index.search_index(A.states(spark, sf_dir), event_type="error"))


_EVENTS = "(SELECT string_agg(event_type || ':' || c, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS c FROM states e WHERE e.rec = r.rec AND event_type IS NOT NULL GROUP BY 1))"


@query(
    sql.full(
        f"SELECT video, round(duration + 0.000001, 2) AS duration_s, 0.001::DOUBLE AS sampled_fps, (SELECT count(*) FROM states s WHERE s.rec = r.rec) AS states, (SELECT sum(len(lines))::BIGINT FROM states s WHERE s.rec = r.rec) AS ocr_lines, "
        f"coalesce({_EVENTS}, '') AS events, (SELECT count(*) FROM speech n WHERE n.rec = r.rec) AS narration_segments, (SELECT count(*) FROM noted w WHERE w.rec = r.rec) AS warnings, coalesce((SELECT len(persistent) FROM shared p WHERE p.rec = r.rec), 0) AS persistent_ui_lines, "
        "(SELECT bool_or(salience <> 0) FROM states s WHERE s.rec = r.rec) AS has_curated_keyframes FROM recordings r"
    )
)
def summarize_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document.summarize(A.stored_index(spark, sf_dir))
    counts = F.array_join(F.transform(F.map_entries("events"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.withColumns({"events": counts, **{c: F.col(c).cast("bigint") for c in ("states", "ocr_lines", "narration_segments", "warnings", "persistent_ui_lines")}})


@query(sql.full("SELECT video, coalesce((SELECT string_agg(note || CASE WHEN n > 1 THEN ' (' || n || ' frames, the first ' || first || ')' ELSE '' END, '|' ORDER BY first) FROM noted w WHERE w.rec = r.rec), '') AS warnings FROM recordings r"))
def index_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers had to say of a recording's frames: each note once, in the order of its first frame."""
    return A.stored_index(spark, sf_dir).select("video", shown("warnings").alias("warnings"))


@query(sql.full("SELECT video, idx, t_start, t_end, event_type AS event, array_to_string(list_filter(lines, lambda l: contains(lower(l), 'open')), '|') AS matches FROM states JOIN recordings USING (rec) WHERE len(list_filter(lines, lambda l: contains(lower(l), 'open'))) > 0 AND t_end >= 1000 AND t_start <= 1500000 AND event_type = 'edit'"))
def search_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters at once, on documents."""
    return document.search(A.stored_index(spark, sf_dir), "OPEN", 1000.0, 1500000.0, "edit").withColumn("matches", shown("matches"))


@query(sql.states("SELECT rec, event_type, count(*) AS n FROM states WHERE event_type IS NOT NULL GROUP BY 1, 2"))
def event_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.event_histogram(A.states(spark, sf_dir))


@query(sql.full("SELECT video, array_to_string(coalesce(persistent, []), '|') AS persistent FROM recordings LEFT JOIN shared USING (rec)"))
def persistent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stored_index(spark, sf_dir).select("video", shown(document.persistent(F.col("states"))).alias("persistent"))


@query(sql.full("SELECT video, idx, array_to_string(list_filter(lines, lambda l: NOT list_contains(coalesce(persistent, []), l)), '|') AS own_lines, array_to_string(added, '|') AS added, event_type, salience FROM states JOIN recordings USING (rec) LEFT JOIN shared USING (rec)"))
def compact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States as the compact view has them, with the differences that it drops by default."""
    each = document.compact(A.stored_index(spark, sf_dir), drop_diffs=False).select("video", F.explode("view.states").alias("s"))
    return each.select("video", "s.idx", shown("s.ocr_text").alias("own_lines"), shown("s.text_added").alias("added"), F.col("s.event.type").alias("event_type"), "s.salience")


@query(sql.states("SELECT rec, bool_or(len(lines) > 0) AS has_text FROM states GROUP BY rec"))
def index_has_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.states(spark, sf_dir).groupBy("rec").agg(F.bool_or(F.size("lines") > 0).alias("has_text"))


@query(sql.states("SELECT rec, idx, salience FROM states"))
def salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.states(spark, sf_dir).select("rec", "idx", "salience")


@query(
    sql.states(
        """, picks AS (
  SELECT rec, [arg_max(pos, (salience, -pos))] AS chosen, 1 AS k FROM states GROUP BY rec
  UNION ALL
  SELECT rec, list_append(chosen, best), k + 1 FROM (
    SELECT c.rec, c.chosen, c.k, arg_max(s.pos, (s.salience + 0.15 * (1 - 1 / (1 + list_min(list_transform(c.chosen, lambda x: abs(s.pos - x)))::DOUBLE)), -s.pos)) AS best
    FROM picks c JOIN states s ON s.rec = c.rec AND NOT list_contains(c.chosen, s.pos) WHERE c.k < 5 GROUP BY c.rec, c.chosen, c.k))
SELECT s.rec, s.pos, s.idx, round(s.t_start, 3) AS t_start, s.salience FROM states s JOIN (SELECT rec, arg_max(chosen, k) AS chosen FROM picks GROUP BY rec) c ON c.rec = s.rec AND list_contains(c.chosen, s.pos)"""
    )
)
def curated_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.curated(A.states(spark, sf_dir), 5).withColumn("t_start", F.round("t_start", 3))


_NARRATION = ", narration AS (SELECT rec, pos AS n, t AS start_t, t + 60 AS end_t, props AS text FROM frames WHERE event_type = 'error')"
_SAID = f"{_NARRATION}, said AS (SELECT s.rec, s.idx, string_agg(n.text, ' ' ORDER BY n.n) AS said FROM states s JOIN narration n ON n.rec = s.rec AND n.start_t < s.t_end AND n.end_t > s.t_start GROUP BY 1, 2)"


@query(sql.states(f"{_SAID} SELECT rec, idx, said FROM said"))
def narration_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.narration_of(A.states(spark, sf_dir), A.narration(spark, sf_dir))


def _cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir)
    return f.select("rec", "t", F.floor(F.col("value") % 97).cast("int").alias("x"), F.floor(F.col("value") % 61).cast("int").alias("y"))


_CURSOR = ", cursor AS (SELECT rec, t, floor(value % 97)::INTEGER AS x, floor(value % 61)::INTEGER AS y FROM frames), inside AS (SELECT s.rec, s.idx, c.t, c.x, c.y FROM states s JOIN cursor c ON c.rec = s.rec AND c.t >= s.t_start AND c.t <= s.t_end)"


@query(sql.states(f"{_CURSOR} SELECT rec, idx, count(*) AS n FROM inside GROUP BY 1, 2"))
def cursor_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.cursor_of(A.states(spark, sf_dir), _cursor(spark, sf_dir)).select("rec", "idx", F.size("xs").cast("bigint").alias("n"))


@query(sql.states(f"{_CURSOR}, last AS (SELECT rec, idx, list(x ORDER BY t DESC, x DESC, y DESC)[1:5] AS xs, list(y ORDER BY t DESC, x DESC, y DESC)[1:5] AS ys FROM inside GROUP BY 1, 2) SELECT rec, idx, list_sort(xs)[len(xs) // 2 + 1] AS x, list_sort(ys)[len(ys) // 2 + 1] AS y FROM last"))
def hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = events.hotspot(F.col("xs"), F.col("ys"))
    return index.cursor_of(A.states(spark, sf_dir), _cursor(spark, sf_dir)).select("rec", "idx", at["x"].alias("x"), at["y"].alias("y"))


# ---- pixels


@query(sql.gray("SELECT rec, vec_id, round(list_sum(list_transform(list_zip(prev, gray), lambda z: abs(z[1] - z[2])))::DOUBLE / len(gray) / 255, 6) AS score FROM gray WHERE prev IS NOT NULL"))
def motion_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gray(spark, sf_dir).where("prev is not null").select("rec", "vec_id", F.round(pixels.motion_score(F.col("prev"), F.col("gray")), 6).alias("score"))


@query(
    sql.gray(
        """, h AS (SELECT rec, vec_id, list_transform(range(0, 64), lambda b: len(list_filter(prev, lambda v: v // 4 = b))::DOUBLE) AS a, list_transform(range(0, 64), lambda b: len(list_filter(gray, lambda v: v // 4 = b))::DOUBLE) AS b FROM gray WHERE prev IS NOT NULL),
m AS (SELECT *, list_sum(list_transform(a, lambda x: x * x)) - 64.0 * 64 / 64 AS va, list_sum(list_transform(b, lambda x: x * x)) - 64.0 * 64 / 64 AS vb, list_dot_product(a, b) - 64.0 * 64 / 64 AS cov FROM h)
SELECT rec, vec_id, round(CASE WHEN a = b THEN 1.0 WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE greatest(0.0, cov / sqrt(va * vb)) END, 6) AS similarity FROM m"""
    )
)
def histogram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.gray(spark, sf_dir).where("prev is not null").select("rec", "vec_id", pixels.compared(F.col("prev"), F.col("gray")).alias("c"))
    return g.select("rec", "vec_id", F.round("c.similarity", 6).alias("similarity"))


@query(
    sql.gray(
        """, c AS (SELECT rec, vec_id, list_filter(range(0, 64), lambda i: abs(gray[i + 1] - prev[i + 1]) > 80) AS hit FROM gray WHERE prev IS NOT NULL),
b AS (SELECT *, len(hit) / 64.0 AS cov, list_min(list_transform(hit, lambda i: i % 8)) AS x0, list_max(list_transform(hit, lambda i: i % 8)) AS x1, list_min(list_transform(hit, lambda i: i // 8)) AS y0, list_max(list_transform(hit, lambda i: i // 8)) AS y1 FROM c WHERE len(hit) > 0)
SELECT rec, vec_id, x0 || ',' || y0 || ',' || (x1 - x0 + 1) || ',' || (y1 - y0 + 1) AS box, round(cov, 4) AS coverage,
 CASE WHEN cov >= 0.45 THEN 'full' WHEN (y1 - y0 + 1) / 8.0 >= 0.5 AND (x1 - x0 + 1) / 8.0 >= 0.5 THEN 'band' WHEN cov <= 0.08 THEN 'local' ELSE 'overlay' END AS shape FROM b"""
    )
)
def changed_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pixels.changed_region(F.col("prev"), F.col("gray"), F.lit(A.WIDTH), F.lit(A.HEIGHT), A.PIXELS_DELTA)
    g = A.gray(spark, sf_dir).where("prev is not null").select("rec", "vec_id", r.alias("r")).where("r is not null")
    return g.select("rec", "vec_id", F.array_join(F.col("r.box").cast("array<string>"), ",").alias("box"), F.col("r.coverage").alias("coverage"), F.col("r.shape").alias("shape"))


@query(sql.gray(", l AS (SELECT rec, vec_id, array_to_string(list_transform(gray, lambda v: substr(' .:-=+*#%@', (1 + v * 9 // 255)::BIGINT, 1)), '') AS s FROM gray) SELECT rec, vec_id, array_to_string(list_transform(range(0, 8), lambda y: s[y * 8 + 1:y * 8 + 8]), chr(10)) AS picture FROM l"))
def ascii_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gray(spark, sf_dir).select("rec", "vec_id", pixels.ascii_frame(F.col("gray"), A.WIDTH, A.HEIGHT).alias("picture"))


_BOXES = "list_transform(range(0, 4), lambda i: {'x': (vec_id * (i + 3)) % 50, 'y': (vec_id * (i + 7)) % 50, 'i': i})"


@query(
    f"""WITH b AS (SELECT vec_id, (vec_id % 50)::DOUBLE AS x, (vec_id % 37)::DOUBLE AS y, {_BOXES} AS boxes FROM embeddings),
d AS (SELECT vec_id, list_min(list_transform(boxes, lambda z: {{'d': (z['x'] + 5 - x) * (z['x'] + 5 - x) + (z['y'] + 4 - y) * (z['y'] + 4 - y), 'i': z['i']}})) AS m FROM b)
SELECT vec_id, CASE WHEN sqrt(m['d']) <= 0.15 * sqrt(60.0 * 60 + 60 * 60) THEN 'box' || m['i'] END AS label FROM d"""
)
def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    boxes = F.array(*[F.struct(F.lit(f"box{i}").alias("text"), F.array((v * (i + 3)) % 50, (v * (i + 7)) % 50, F.lit(10).cast("bigint"), F.lit(8).cast("bigint")).alias("box")) for i in range(4)])
    return e.select("vec_id", events.nearest_label((v % 50).cast("double"), (v % 37).cast("double"), boxes, F.lit(60), F.lit(60)).alias("label"))


@query("SELECT vec_id, greatest(1, round_even(40 * ((vec_id % 9 + 1)::DOUBLE / (vec_id % 5 + 1)) / 2.0, 0)::INTEGER) AS n_rows FROM embeddings")
def auto_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return A.table(spark, sf_dir, "embeddings").select("vec_id", pixels.auto_rows(v % 5 + 1, v % 9 + 1, 40).alias("n_rows"))


@query(
    sql.gray(
        """, d AS (SELECT rec, vec_id, list_transform(range(0, 64), lambda i: CASE i % 8 WHEN 0 THEN (gray[i + 2] - gray[i + 1])::DOUBLE WHEN 7 THEN (gray[i + 1] - gray[i])::DOUBLE ELSE (gray[i + 2] - gray[i]) / 2.0 END) AS dx,
  list_transform(range(0, 64), lambda i: CASE i // 8 WHEN 0 THEN (gray[i + 9] - gray[i + 1])::DOUBLE WHEN 7 THEN (gray[i + 1] - gray[i - 7])::DOUBLE ELSE (gray[i + 9] - gray[i - 7]) / 2.0 END) AS dy FROM gray),
m AS (SELECT rec, vec_id, list_transform(list_zip(dx, dy), lambda z: sqrt(z[1] * z[1] + z[2] * z[2])) AS m FROM d)
SELECT rec, vec_id, array_to_string(list_transform(m, lambda x: CASE WHEN list_max(m) > 0 THEN trunc(x * (255.0::DOUBLE / list_max(m)))::INTEGER ELSE 0 END), ',') AS edges FROM m"""
    )
)
def edge_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gray(spark, sf_dir).select("rec", "vec_id", F.array_join(pixels.edge_magnitude(F.col("gray"), F.lit(A.WIDTH)).cast("array<string>"), ",").alias("edges"))


@query(
    sql.dots(
        """, s AS (SELECT rec, vec_id, list_transform(range(0, 72), lambda i: round_even((g[1 + i // 12 * 96 + i % 12 * 2] + g[2 + i // 12 * 96 + i % 12 * 2] + g[25 + i // 12 * 96 + i % 12 * 2] + g[26 + i // 12 * 96 + i % 12 * 2]
  + g[49 + i // 12 * 96 + i % 12 * 2] + g[50 + i // 12 * 96 + i % 12 * 2] + g[73 + i // 12 * 96 + i % 12 * 2] + g[74 + i // 12 * 96 + i % 12 * 2]) / 8.0, 0)::INTEGER) AS g FROM dots),
c AS (SELECT rec, vec_id, array_to_string(list_transform(g, lambda v: substr(' .:-=+*#%@', (1 + v * 9 // 255)::BIGINT, 1)), '') AS s FROM s)
SELECT rec, vec_id, array_to_string(list_transform(range(0, 6), lambda y: s[y * 12 + 1:y * 12 + 12]), chr(10)) AS picture FROM c"""
    )
)
def frame_to_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shrunk by area to 12 columns, then as characters."""
    return pixels.with_ascii(A.dots(spark, sf_dir), 24, 24, 12).select("rec", "vec_id", F.col("ascii").alias("picture"))


@query(
    sql.gray(
        """, n AS (SELECT rec, vec_id, gray, list_transform(range(0, 64), lambda i: (CASE WHEN i // 8 = 0 THEN gray[i + 9] ELSE gray[i - 7] END) + (CASE WHEN i // 8 = 7 THEN gray[i - 7] ELSE gray[i + 9] END)
 + (CASE WHEN i % 8 = 0 THEN gray[i + 2] ELSE gray[i] END) + (CASE WHEN i % 8 = 7 THEN gray[i] ELSE gray[i + 2] END) - 4 * gray[i + 1]) AS l FROM gray)
SELECT rec, vec_id, round(list_var_pop(list_transform(l, lambda x: x::DOUBLE)) + 0.001, 2) AS sharpness FROM n"""
    )
)
def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gray(spark, sf_dir).select("rec", "vec_id", F.round(pixels.sharpness(F.col("gray"), F.lit(A.WIDTH)) + 0.001, 2).alias("sharpness"))


@query(
    sql.dots(
        """, hit AS (SELECT rec, vec_id, unnest(list_filter(range(0, 576), lambda i: abs(g[i + 1] - prev[i + 1]) > 25)) AS i FROM dots WHERE prev IS NOT NULL),
walk AS (
  SELECT rec, vec_id, i, i AS root FROM hit
  UNION
  SELECT h.rec, h.vec_id, h.i, w.root FROM walk w JOIN hit h ON h.vec_id = w.vec_id AND abs(h.i % 24 - w.i % 24) <= 1 AND abs(h.i // 24 - w.i // 24) <= 1 AND w.root < h.i),
named AS (SELECT rec, vec_id, i, min(root) AS root FROM walk GROUP BY ALL),
part AS (SELECT rec, vec_id, root, count(*) AS area, trunc(avg(i % 24))::INTEGER AS x, trunc(avg(i // 24))::INTEGER AS y FROM named GROUP BY ALL HAVING count(*) >= 4 AND count(*) <= 5.76),
best AS (SELECT vec_id, arg_max({'x': x, 'y': y}, (area, -root)) AS spot FROM part GROUP BY vec_id)
SELECT d.rec, d.vec_id, b.spot['x'] AS x, b.spot['y'] AS y FROM dots d LEFT JOIN best b USING (vec_id) WHERE prev IS NOT NULL"""
    )
)
def cursor_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.dots(spark, sf_dir).where("prev is not null")
    return d.select("rec", "vec_id", pixels.estimate_cursor(F.col("prev"), F.col("gray"), F.lit(24)).alias("at")).select("rec", "vec_id", "at.x", "at.y")


@query("SELECT vec_id, CASE WHEN x1 > x0 AND y1 > y0 THEN x0 || ',' || y0 || ',' || x1 || ',' || y1 END AS box, CASE WHEN x1 > x0 AND y1 > y0 THEN greatest(3, least(x1 - x0, y1 - y0) // 2 * 2 + 1) END AS kernel FROM (SELECT vec_id, greatest(vec_id % 40 - 10, 0) AS x0, greatest(vec_id % 30 - 10, 0) AS y0, least(vec_id % 40 - 10 + vec_id % 17, 24) AS x1, least(vec_id % 30 - 10 + vec_id % 13, 20) AS y1 FROM embeddings)")
def blur_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a blur covers: the box inside the frame and the side of its kernel."""
    v = F.col("vec_id")
    box = pixels.clamp_box(v % 40 - 10, v % 30 - 10, v % 17, v % 13, F.lit(24).cast("bigint"), F.lit(20).cast("bigint"))
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", box.alias("b"))
    return e.select("vec_id", F.array_join(F.col("b").cast("array<string>"), ",").alias("box"), F.when(F.col("b").isNotNull(), pixels.blur_kernel(F.col("b"))).cast("bigint").alias("kernel"))


# ---- the older path


_SCORES = """, s AS (SELECT rec, vec_id, row_number() OVER (PARTITION BY rec ORDER BY vec_id) - 1 AS pos, gray, prev FROM gray),
h AS (SELECT *, list_transform(range(0, 64), lambda b: len(list_filter(coalesce(prev, gray), lambda v: v // 4 = b))::DOUBLE) AS a, list_transform(range(0, 64), lambda b: len(list_filter(gray, lambda v: v // 4 = b))::DOUBLE) AS b FROM s),
m AS (SELECT *, list_sum(list_transform(a, lambda x: x * x)) - 64.0 AS va, list_sum(list_transform(b, lambda x: x * x)) - 64.0 AS vb, list_dot_product(a, b) - 64.0 AS cov FROM h),
scores AS (
  SELECT rec, pos, round(pos * 0.2, 3) AS t, CASE WHEN prev IS NULL THEN 0.0 ELSE round(list_sum(list_transform(list_zip(prev, gray), lambda z: abs(z[1] - z[2])))::DOUBLE / 64 / 255, 4) END AS score,
         CASE WHEN prev IS NULL THEN 1.0 WHEN a = b THEN 1.0 WHEN va <= 0 OR vb <= 0 THEN 0.0 ELSE greatest(0.0, cov / sqrt(va * vb)) END AS similarity FROM m),
flagged AS (SELECT *, pos - row_number() OVER (PARTITION BY rec ORDER BY pos) AS run FROM scores WHERE score >= 0.16),
runs AS (SELECT rec, run, min(t) AS t_start, max(t) AS t_end, arg_max({'pos': pos, 'score': score, 'sim': similarity}, (score, -pos)) AS peak FROM flagged GROUP BY rec, run)"""


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.gray(spark, sf_dir).select("rec", (F.row_number().over(W.partitionBy("rec").orderBy("vec_id")) - 1).cast("bigint").alias("pos"), "gray")
    return manifest.frame_times(g.withColumn("container_ms", F.when(F.col("pos") % 2 == 0, F.col("pos") * 200).otherwise(0)), 5.0).drop("container_ms")


@query(sql.gray(f"{_SCORES} SELECT rec, pos, t, score, round(similarity, 6) AS similarity, score >= 0.16 AS event FROM scores"))
def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their times, container or computed, and both scores."""
    return manifest.scored(_pictures(spark, sf_dir), 0.16).select("rec", "pos", "t", "score", F.round("similarity", 6).alias("similarity"), "event")


@query(sql.gray(f"{_SCORES} SELECT rec, t_start, t_end, peak.pos AS peak_frame, peak.score AS peak_score, CASE WHEN peak.sim < 0.5 THEN 'cut' ELSE 'motion' END AS type, round(CASE WHEN peak.sim < 0.5 THEN (0.5 - peak.sim) / 0.5 ELSE (peak.sim - 0.5) / 0.5 END, 3) AS confidence FROM runs"))
def motion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.motion_events(manifest.scored(_pictures(spark, sf_dir), 0.16), 0.16)


@query(sql.gray(f"{_SCORES}, f AS (SELECT rec, max(t) AS last, count(*) AS frames, sum(CASE WHEN score >= 0.16 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM scores GROUP BY rec) SELECT 'clip' || rec AS video, round(greatest(last, 30.0), 3) AS duration, frames, flagged, (SELECT count(*) FROM runs r WHERE r.rec = f.rec) AS events FROM f"))
def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of all recordings, counted."""
    g = _pictures(spark, sf_dir)
    recs = g.select("rec").distinct().select("rec", F.concat(F.lit("clip"), F.col("rec").cast("string")).alias("video"), F.lit(30.0).alias("duration"))
    m = manifest.manifests(g, recs, sensitivity=0.16)
    return m.select("video", "duration", F.size("frames").cast("bigint").alias("frames"), F.size(F.filter("frames", lambda f: f["event"])).cast("bigint").alias("flagged"), F.size("events").cast("bigint").alias("events"))


@query("SELECT user_id AS rec, 10.0::DOUBLE AS fps, count(*) AS count, 8 AS width, 8 AS height, count(*) / 10.0::DOUBLE AS duration FROM events GROUP BY user_id")
def video_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), F.lit(A.WIDTH).alias("width"), F.lit(A.HEIGHT).alias("height"))
    return manifest.recording_info(frames, 10.0)


@query("SELECT user_id AS rec, CASE WHEN least(count(*) * 2.0, 400.0) > 150 THEN '~' || floor(least(count(*) * 2.0, 400.0))::BIGINT || ' frames to read as text: this can take minutes; segment by motion alone or limit the frames to speed it up' END AS hint FROM events GROUP BY user_id")
def slow_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec")).agg(F.count(F.lit(1)).cast("double").alias("duration"))
    return n.select("rec", recording.slow_warning(F.col("duration"), 2.0, max_frames=400).alias("hint"))


@query(
    "WITH RECURSIVE "
    + sql.GRAY
    + """, f AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY vec_id) - 1 AS pos, gray FROM pictures),
walk AS (
  SELECT rec, pos, gray AS prev, gray AS anchor, 0 AS seg FROM f WHERE pos = 0
  UNION ALL
  SELECT rec, pos, gray, CASE WHEN cut THEN gray ELSE anchor END, seg + CASE WHEN cut THEN 1 ELSE 0 END
  FROM (SELECT f.rec, f.pos, f.gray, w.anchor, w.seg, list_sum(list_transform(list_zip(w.prev, f.gray), lambda z: abs(z[1] - z[2])))::DOUBLE / 64 / 255 >= 0.17 OR list_sum(list_transform(list_zip(w.anchor, f.gray), lambda z: abs(z[1] - z[2])))::DOUBLE / 64 / 255 >= 0.17 AS cut
        FROM walk w JOIN f ON f.rec = w.rec AND f.pos = w.pos + 1))
SELECT rec, pos, seg FROM walk"""
)
def segment_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion segmentation on gray pictures, by the frame before and by the anchor."""
    return sequence.segment_by_motion(_pictures(spark, sf_dir), 0.17, "gray").select("rec", "pos", "seg")


# ---- secrets


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(sql.secrets("SELECT doc_id, n, s AS start, e AS \"end\", k AS kind FROM spans"))
def find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).select("doc_id", "n", F.explode(redact.find_secrets(F.col("line"))).alias("s"))
    return found.select("doc_id", "n", "s.start", "s.end", "s.kind")


@query(
    sql.secrets(
        """, cut AS (SELECT doc_id, n, line, s, e, k, coalesce(lag(e) OVER w, 0) AS since, row_number() OVER w AS i FROM spans WINDOW w AS (PARTITION BY doc_id, n ORDER BY s))
SELECT doc_id, n, string_agg(substr(line, since + 1, s - since) || '[REDACTED:' || k || ']', '' ORDER BY i) || substr(any_value(line), max(e) + 1) AS line, string_agg(k, '|' ORDER BY i) AS kinds FROM cut GROUP BY doc_id, n"""
    )
)
def redact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Out of a generator, spans are computed once: no filter on them goes below it.
    found = _lines(spark, sf_dir).select("doc_id", "n", "line", F.explode(F.array(redact.find_secrets(F.col("line")))).alias("spans")).where(redact.has_secret(F.col("spans")))
    return found.select("doc_id", "n", redact.redact_line(F.col("line"), F.col("spans")).alias("line"), shown(F.transform("spans", lambda s: s["kind"])).alias("kinds"))


@query(sql.secrets("SELECT k AS kind, count(*) AS n FROM spans GROUP BY k"))
def redaction_kinds_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_RUN = r"\b(?:\d[ -]?){13,16}\b"


@query(
    rf"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM documents),
d AS (SELECT doc_id, run, list_reverse(regexp_extract_all(run, '\d')) AS g FROM c),
l AS (SELECT doc_id, run, len(g) AS n, list_sum(list_transform(g, lambda x, i: CASE WHEN i % 2 = 1 THEN x::INTEGER WHEN x::INTEGER < 5 THEN x::INTEGER * 2 ELSE x::INTEGER * 2 - 9 END)) AS s FROM d)
SELECT doc_id, rtrim(run) AS run, n BETWEEN 13 AND 19 AND s % 10 = 0 AS ok FROM l"""
)
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias("run"))
    return d.select("doc_id", F.rtrim("run").alias("run"), redact.luhn_ok(F.col("run")).alias("ok"))


@query(
    r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '\S+')) AS w FROM benchmark),
c AS (SELECT DISTINCT item_id, w, string_split(w, '') AS g FROM w),
p AS (SELECT item_id, w, list_transform(list_distinct(g), lambda x: len(list_filter(g, lambda z: z = x))::DOUBLE / len(g)) AS p FROM c)
SELECT item_id, w AS token, abs(round(list_sum(list_transform(p, lambda x: x * log2(x))), 6)) AS entropy FROM p"""
)
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("token")).distinct()
    return b.select("item_id", "token", F.round(redact.shannon_entropy(F.col("token")), 6).alias("entropy"))


# ---- views and evaluation

_HEARD = ", said AS (SELECT s.rec, s.idx, string_agg(n.text, ' ' ORDER BY n.n) AS said FROM states s JOIN speech n ON n.rec = s.rec AND n.start_t < s.t_end AND n.end_t > s.t_start GROUP BY 1, 2)"
_MD = f"""{_HEARD}, b AS (
  SELECT s.rec, s.pos, concat_ws(chr(10), '## ' || {sql.clock('t_start')} || '–' || {sql.clock('t_end')} || '  ·  State ' || (pos + 1), nullif({sql.FULL_CAPTION}, ''), nullif(array_to_string(lines, ' · '), ''),
    CASE WHEN len(added) > 0 THEN '**Appeared:** ' || array_to_string(added, ', ') END, CASE WHEN len(removed) > 0 THEN '**Gone:** ' || array_to_string(removed, ', ') END,
    CASE WHEN px IS NOT NULL THEN '👆 interacted' || coalesce(' near “' || label || '”', '') || ' (≈' || px || ',' || py || ')' END,
    CASE WHEN said IS NOT NULL THEN '🗣 said: ' || said END, '') AS block
  FROM states s LEFT JOIN said USING (rec, idx))
SELECT video, '# Transcript — ' || video || '  (' || {sql.clock('any_value(duration)')} || ')' || chr(10) || chr(10) || rtrim(string_agg(block, chr(10) ORDER BY pos), chr(10)) || chr(10) AS doc FROM b JOIN recordings USING (rec) GROUP BY video"""


@query(sql.full(_MD))
def transcript_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.render(A.stored_index(spark, sf_dir), "md")


@query(sql.full(f", b AS (SELECT rec, pos, (pos + 1) || chr(10) || {sql.stamp('t_start', ',')} || ' --> ' || {sql.stamp('t_end', ',')} || chr(10) || {sql.FULL_BODY} || chr(10) AS block FROM states) SELECT video, string_agg(block, chr(10) ORDER BY pos) AS doc FROM b JOIN recordings USING (rec) GROUP BY video"))
def transcript_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.render(A.stored_index(spark, sf_dir), "srt")


@query(sql.full(f", b AS (SELECT rec, pos, {sql.stamp('t_start', '.')} || ' --> ' || {sql.stamp('t_end', '.')} || chr(10) || {sql.FULL_BODY} || chr(10) AS block FROM states) SELECT video, 'WEBVTT' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY pos) AS doc FROM b JOIN recordings USING (rec) GROUP BY video"))
def transcript_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.render(A.stored_index(spark, sf_dir), "vtt")


def _json_field(name: str, value: str) -> str:
    """``,"name":value`` where there is a value."""
    return f"""coalesce(',"{name}":' || {value}, '')"""


_JSON = f""", e AS (
  SELECT s.*, video, duration, coalesce(persistent, []) AS shared_lines, CASE WHEN event_type IS NULL THEN '' ELSE '"type":"' || event_type || '"' || ',"t":' || t_start || ',"region":[' || region || '],"confidence":' || confidence
      || {_json_field("label", "to_json(event_label)::VARCHAR")} || {_json_field("field", "to_json(event_field)::VARCHAR")} || {_json_field("value", "to_json(event_value)::VARCHAR")} END AS event
  FROM states s JOIN recordings USING (rec) LEFT JOIN shared USING (rec)),
b AS (
  SELECT rec, pos, '{{"idx":' || idx || ',"t_start":' || t_start || ',"t_end":' || t_end || ',"thumbnail":"' || thumbnail || '","keyframe":"' || keyframe || '","ocr_text":' || to_json(list_filter(lines, lambda l: NOT list_contains(shared_lines, l)))::VARCHAR
      || ',"event":{{' || event || '}},"salience":' || salience || '}}' AS block FROM e),
w AS (SELECT rec, string_agg('"' || note || CASE WHEN n > 1 THEN ' (' || n || ' frames, the first ' || first || ')' ELSE '' END || '"', ',' ORDER BY first) AS said FROM noted GROUP BY rec),
n AS (SELECT rec, string_agg('{{"start":' || start_t || ',"end":' || end_t || ',"text":"' || text || '"}}', ',' ORDER BY n) AS told FROM speech GROUP BY rec)
SELECT video, '{{"schema_version":2,"video":"' || video || '","duration":' || any_value(duration) || ',"sampled_fps":0.001,"states":[' || string_agg(block, ',' ORDER BY pos) || '],"narration":[' || coalesce(any_value(told), '') || '],"warnings":[' || coalesce(any_value(w.said), '') || ']'
  || coalesce(',"persistent_ui":' || any_value(CASE WHEN len(p.persistent) > 0 THEN to_json(p.persistent)::VARCHAR END), '') || '}}' AS doc
FROM b JOIN recordings USING (rec) LEFT JOIN n USING (rec) LEFT JOIN w USING (rec) LEFT JOIN shared p USING (rec) GROUP BY video"""


@query(sql.full(_JSON))
def transcript_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.render(A.stored_index(spark, sf_dir), "json")
    # A number as its shortest decimal, without an exponent: texts compare by value.
    return out.withColumn("doc", F.regexp_replace("doc", r'"sampled_fps":1\.0E-3', '"sampled_fps":0.001'))


_CURATED = """, picks AS (
  SELECT rec, [arg_max(pos, (salience, -pos))] AS chosen, 1 AS k FROM states GROUP BY rec
  UNION ALL
  SELECT rec, list_append(chosen, best), k + 1 FROM (
    SELECT c.rec, c.chosen, c.k, arg_max(s.pos, (s.salience + 0.15 * (1 - 1 / (1 + list_min(list_transform(c.chosen, lambda x: abs(s.pos - x)))::DOUBLE)), -s.pos)) AS best
    FROM picks c JOIN states s ON s.rec = c.rec AND NOT list_contains(c.chosen, s.pos) WHERE c.k < 3 GROUP BY c.rec, c.chosen, c.k)),
final AS (SELECT rec, arg_max(chosen, k) AS chosen FROM picks GROUP BY rec)
SELECT video, string_agg(idx || '@' || t_start || ':' || keyframe || '=' || salience, ' ' ORDER BY pos) AS curated FROM states s JOIN final f ON f.rec = s.rec AND list_contains(f.chosen, s.pos) JOIN recordings r ON r.rec = s.rec GROUP BY video"""


@query(sql.full(_CURATED))
def curated_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyframes that a compact view names under a budget."""
    out = document.compact(A.stored_index(spark, sf_dir), keyframe_budget=3)
    line = F.transform("view.curated_keyframes", lambda c: F.concat(c["idx"].cast("string"), F.lit("@"), c["t_start"].cast("string"), F.lit(":"), c["keyframe"], F.lit("="), c["salience"].cast("string")))
    return out.select("video", F.array_join(line, " ").alias("curated"))


@query(
    sql.full(
        """, c AS (SELECT rec, count(*) AS states, sum(length(array_to_string(lines, chr(10))))::BIGINT AS text_chars FROM states GROUP BY rec),
d AS (SELECT *, round_even(text_chars / 4.0, 0)::BIGINT AS text_tokens, greatest(states, round_even(duration * 0.001, 0)::BIGINT) AS sampled_frames FROM c JOIN recordings USING (rec))
SELECT video, round(duration + 0.000001, 2) AS duration_s, states, sampled_frames, text_chars, text_tokens, least(3, states) AS escalated_images, text_tokens + least(3, states) * 1500 AS index_tokens, sampled_frames * 1500 AS baseline_tokens,
 round((text_tokens + least(3, states) * 1500)::DOUBLE / (sampled_frames * 1500), 4) AS cost_ratio FROM d"""
    )
)
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.cost_estimate(A.stored_index(spark, sf_dir), fps=0.001)


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on recordings, some of which have no index."""
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"))
    choices = F.array(F.concat(F.lit("A) open item "), (F.col("i") % 4).cast("string")), F.concat(F.lit("B) note "), (F.col("i") % 3).cast("string")), F.lit("C) error denied"))
    answer = F.when(F.col("i") % 3 == 0, "A").when(F.col("i") % 3 == 1, "b").otherwise("error denied")
    kind = F.expr("CASE i % 5 WHEN 0 THEN 'action' WHEN 1 THEN 'state' WHEN 2 THEN 'count' WHEN 3 THEN 'visual' END")
    return d.select(F.concat(F.lit("rec"), (F.col("i") % 200).cast("string"), F.lit(".mp4")).alias("clip"), F.concat(F.lit("Which "), F.col("i").cast("string")).alias("question"), choices.alias("choices"), answer.alias("answer"), kind.alias("type"))


_QA = """, qa AS (SELECT 'rec' || doc_id % 200 || '.mp4' AS clip, 'Which ' || doc_id AS question, ['A) open item ' || doc_id % 4, 'B) note ' || doc_id % 3, 'C) error denied'] AS choices,
  CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE 'error denied' END AS answer, coalesce(CASE doc_id % 5 WHEN 0 THEN 'action' WHEN 1 THEN 'state' WHEN 2 THEN 'count' WHEN 3 THEN 'visual' END, 'other') AS type, doc_id FROM documents)"""
_ARMS = (
    sql.full(_MD.replace("SELECT video, '# Transcript", f"{_QA}, v AS (SELECT video, '# Transcript") + ")").replace("GROUP BY video)", "GROUP BY video)")
    + """, t AS (SELECT v.video, doc, list_distinct(regexp_extract_all(lower(doc), '[a-z0-9]+')) AS seen, greatest((SELECT count(*) FROM states s WHERE s.rec = r.rec), round_even(duration * 0.001, 0)::BIGINT) AS total FROM v JOIN recordings r USING (video)),
n AS (SELECT q.*, doc, total, [len(list_intersect(list_distinct(regexp_extract_all(regexp_replace(lower(choices[1]), '^[a-z][)] ', ''), '[a-z0-9]+')), seen)), len(list_intersect(list_distinct(regexp_extract_all(regexp_replace(lower(choices[2]), '^[a-z][)] ', ''), '[a-z0-9]+')), seen)),
  len(list_intersect(['error', 'denied'], seen))] AS hits FROM qa q JOIN t ON t.video = q.clip),
p AS (SELECT *, list_position(hits, list_max(hits)) - 1 AS pick FROM n),
arms AS (SELECT clip, question, type, CASE WHEN length(answer) = 1 THEN chr((65 + pick)::INTEGER) = upper(answer) ELSE pick = 2 END AS idx_ok, length(doc) // 4 AS idx_tok,
  CASE WHEN length(answer) = 1 THEN upper(answer) = 'A' ELSE false END AS fr_ok, least(8, total) * 1500 AS fr_tok FROM p)"""
)


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.stored_index(spark, sf_dir)
    return evalqa.answered(_qa(spark, sf_dir), docs, views.render_view(docs, "transcript"), evalqa.get_answerer("mock"), fps=0.001)


@query(_ARMS + " SELECT * FROM arms")
def qa_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question answered from its index and from frames."""
    return _answered(spark, sf_dir)


@query(
    _ARMS
    + """, g AS (SELECT type, count(*) AS n, sum(idx_ok::INTEGER)::BIGINT AS i, sum(fr_ok::INTEGER)::BIGINT AS f, sum(idx_tok)::BIGINT AS index_tokens, sum(fr_tok)::BIGINT AS frames_tokens, grouping(type) AS total FROM arms GROUP BY ROLLUP (type))
SELECT CASE WHEN total = 1 THEN '**TOTAL**' ELSE type END AS bucket, n, round_even(100.0 * i / n, 0)::INTEGER || '%' AS index_acc, round_even(100.0 * f / n, 0)::INTEGER || '%' AS frames_acc, index_tokens, frames_tokens,
 CASE WHEN total = 1 THEN 99 WHEN type = 'other' THEN 50 ELSE list_position(['action', 'state', 'count', 'visual'], type) END AS place FROM g WHERE n > 0"""
)
def qa_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.two_arms(_answered(spark, sf_dir))


@query("SELECT DISTINCT 'rec' || doc_id % 200 || '.mp4' AS clip, 'no index of this clip' AS reason FROM documents WHERE doc_id % 200 NOT IN (SELECT user_id FROM events)")
def qa_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.skipped(_qa(spark, sf_dir), A.stored_index(spark, sf_dir))


@query("SELECT event_id, array_to_string(CASE WHEN user_id > 0 AND event_id % 9 > 0 THEN list_transform(range(0, least(event_id % 9, ceil(user_id / greatest(1, user_id // (event_id % 9)))::BIGINT)), lambda i: i * greatest(1, user_id // (event_id % 9))) ELSE [] END, ',') AS places FROM events")
def frame_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events").select("event_id", evalqa.frame_choice(F.col("user_id").cast("int"), (F.col("event_id") % 9).cast("int")).alias("places"))
    return e.select("event_id", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


_TYPE = "CASE doc_id % 5 WHEN 0 THEN 'action' WHEN 1 THEN 'state' WHEN 2 THEN 'count' WHEN 3 THEN 'visual' ELSE 'other' END"


@query(
    f"""WITH r AS (SELECT {_TYPE} AS type, CASE WHEN l.quality = l.toxic THEN 0 ELSE 1 END AS ok, length(d.text) // 4 AS tokens FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT type, count(*) AS n, sum(ok)::BIGINT AS hits, sum(tokens)::BIGINT AS tokens, grouping(type) AS total FROM r GROUP BY ROLLUP (type))
SELECT CASE WHEN total = 1 THEN '**TOTAL**' ELSE type END AS bucket, n, hits, round_even(100.0 * hits / n, 0)::INTEGER || '%' AS accuracy, tokens,
 CASE WHEN total = 1 THEN 99 WHEN type = 'other' THEN 50 ELSE list_position(['action', 'state', 'count', 'visual'], type) END AS place FROM g"""
)
def accuracy_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "labels").join(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return evalqa.accuracy(rows.select(F.expr(_TYPE).alias("type"), (F.col("quality") != F.col("toxic")).alias("ok"), text.token_estimate(F.col("text"), False).alias("tokens")))


_OPTIONS = "CASE doc_id % 4 WHEN 0 THEN '[\"one\", \" two \", \"\"]' WHEN 1 THEN '{\"B\": \"two\", \"A\": \"one\"}' WHEN 2 THEN '[\"one\"]' ELSE 'none' END"


_CONVERTED = """SELECT source AS clip, 'How many ' || lang AS question, CASE doc_id % 4 WHEN 0 THEN 'one|two' WHEN 1 THEN 'A) one|B) two' END AS choices, lang AS answer, 'count' AS type, doc_id % 4 >= 2 AS skipped, doc_id AS place
FROM documents WHERE doc_id % 5 <> 0"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    system = F.when(F.col("doc_id") % 5 == 0, "iOS").otherwise("Windows")
    return d.select(F.col("doc_id").alias("place"), F.col("source").alias("video_path"), system.alias("system"), F.concat(F.lit("How many "), "lang").alias("question"), F.expr(_OPTIONS).alias("options"), F.col("lang").alias("answer"))


@query(_CONVERTED)
def mcq_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.convert(_rows(spark, sf_dir)).withColumn("choices", shown("choices"))


@query(f"SELECT clip, question, choices, answer, type FROM ({_CONVERTED}) WHERE NOT skipped ORDER BY place LIMIT 25")
def mcq_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.converted(evalqa.convert(_rows(spark, sf_dir)), 25).withColumn("choices", shown("choices"))


@query(f"WITH c AS ({_CONVERTED}), l AS (SELECT max(place) AS last FROM (SELECT place FROM c WHERE NOT skipped ORDER BY place LIMIT 25)) SELECT count(*) FILTER (NOT skipped) AS emitted, count(*) FILTER (skipped) AS skipped FROM c, l WHERE place <= last")
def mcq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evalqa.convert_stats(evalqa.convert(_rows(spark, sf_dir)), 25)


@query("SELECT doc_id, q.question AS question, q.options AS options, q.answer AS answer FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN [{'question': 'How many ' || lang, 'options': '[\"1\", \"2\"]', 'answer': 'A'}] WHEN 1 THEN [{'question': 'What ' || source, 'options': '{\"a\": \"x\"}', 'answer': 'x'}, {'question': 'Which ' || lang, 'options': NULL, 'answer': NULL}] END) AS q FROM documents)")
def questions_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of rows by a table function in SQL: none, one or several for each."""
    evalqa.register_questions(spark)
    A.table(spark, sf_dir, "documents").createOrReplaceTempView("question_rows")
    made = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN to_json(named_struct('Question', concat('How many ', lang), 'Options', array('1', '2'), 'Correct Answer', 'A'))
      WHEN 1 THEN concat('[', to_json(named_struct('Question', concat('What ', source), 'Options', map('a', 'x'), 'Correct Answer', 'x')), ',', to_json(named_struct('Question', concat('Which ', lang))), ', 7]')
      WHEN 2 THEN 'no json' END AS mcqa FROM question_rows"""
    return spark.sql(f"SELECT r.doc_id, q.question, q.options, q.answer FROM ({made}) r, LATERAL questions_of(r.mcqa) q")


_CHOICES = ["A) the of and to", "B) der die und das", "C) le la les des", "D) el los que una"]


@query(
    """WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM documents),
n AS (SELECT doc_id, [len(list_intersect(['the', 'of', 'and', 'to'], s)), len(list_intersect(['der', 'die', 'und', 'das'], s)), len(list_intersect(['le', 'la', 'les', 'des'], s)), len(list_intersect(['el', 'los', 'que', 'una'], s))] AS n FROM t)
SELECT doc_id, (list_position(n, list_max(n)) - 1)::INTEGER AS pick FROM n"""
)
def mock_answerer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    answer = evalqa.get_answerer("mock").answer(F.lit("Which language?"), F.array(*map(F.lit, _CHOICES)), F.col("text"))
    return d.select("doc_id", answer.cast("int").alias("pick"))


# ---- streams, run to the end of what is there


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, sum(round(value * 100))::BIGINT AS cents FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.finished(windows.tumbling(windows.read_events(spark, sf_dir)), "complete")


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(windows.batch_events(spark, sf_dir))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions on a stream: state of a session goes when the watermark passes its gap."""
    return windows.finished(windows.sessions(windows.read_events(spark, sf_dir).withWatermark("ts", "1 hour")), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.finished(windows.first_seen(windows.read_events(spark, sf_dir)), "append")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the instant of each."""
    return A.frames(spark, sf_dir).withColumn("ts", F.timestamp_micros((F.lit(1.5e15) + F.round(F.col("t") * 1e6)).cast("bigint")))


_YEARS = 3650 * 86_400.0


def _motion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _timed(spark, sf_dir).withColumns({"moved": F.col("value"), "lines": F.array().cast("array<string>")})
    return segments.run_states(frames, rules=segments.MotionSegmenter(120.0), slices=2, slot_seconds=3600.0, idle_seconds=_YEARS)


@query(SQL["segment_stream"].replace("SELECT rec, pos, seg FROM walk", "SELECT rec, max(seg) + 1 AS segments, count(*) AS frames FROM walk GROUP BY rec"))
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by motion that a stream gave, and frames, a row for each recording."""
    return _motion_states(spark, sf_dir).groupBy("rec").agg(F.count(F.lit(1)).alias("segments"), (F.max("keyframe") + 1).alias("frames"))


@query(SQL["segment_stream"].replace("SELECT rec, pos, seg FROM walk", "SELECT rec, seg, min(pos) AS first_pos, max(pos) AS keyframe FROM walk GROUP BY rec, seg").replace("SELECT rec, seg, min(pos) AS first_pos", "SELECT rec, seg::BIGINT AS seg, min(pos) AS first_pos"))
def stream_motion_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments by motion themselves, each by its first and last frame."""
    s = _motion_states(spark, sf_dir).select("rec", F.col("idx").alias("seg"), "keyframe")
    before = F.lag("keyframe").over(W.partitionBy("rec").orderBy("seg"))
    return s.select("rec", "seg", F.coalesce(before + 1, F.lit(0)).cast("bigint").alias("first_pos"), "keyframe")


@query(sql.segments("SELECT rec, idx, t_start, t_end, lines, keyframe FROM (SELECT rec, seg AS idx, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, array_to_string(lines, '|') AS lines, keyframe FROM segments)"))
def stream_text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by text of frames that arrive out of order, in several queries that go on where the last one ended."""
    out = segments.run_states(_timed(spark, sf_dir), threshold=A.SPLIT, motion=A.MOTION, merge=None, slices=2, slot_seconds=3600.0, idle_seconds=_YEARS)
    return out.select("rec", "idx", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), shown("lines").alias("lines"), "keyframe")


@query(sql.states("SELECT rec, pos, idx, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, array_to_string(lines, '|') AS lines, keyframe FROM states"))
def stream_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, each segment held against the last state kept: near duplicates extend it."""
    out = segments.run_states(_timed(spark, sf_dir), threshold=A.SPLIT, motion=A.MOTION, merge=A.MERGE, slices=2, slot_seconds=3600.0, idle_seconds=_YEARS)
    return out.select("rec", "pos", "idx", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), shown("lines").alias("lines"), "keyframe")


@query(sql.states("SELECT rec, pos, idx, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, array_to_string(lines, '|') AS lines, keyframe FROM states"))
def grown_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of recordings whose frames were appended in three parts: only what the new ones change is made."""
    f = A.frames(spark, sf_dir).select("rec", "pos", "t", "lines", "moved")
    grown = incremental.GrowingStates(spark, f"{stores.shared_dir(spark)}/grown_{uuid.uuid4().hex}", A.SPLIT, A.MOTION, A.MERGE)
    for n, part in enumerate(("pos < 20", "pos >= 20 and pos < 45", "pos >= 45")):
        grown.append(n, f.where(part))
    return grown.states().select("rec", "pos", "idx", F.round("t_start", 3).alias("t_start"), F.round("t_end", 3).alias("t_end"), shown("lines").alias("lines"), "keyframe")


# ---- extras on the generic tables, beyond the UI-state engine


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, sum(round(l_extendedprice * 100))::BIGINT AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def extra_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100)).cast("bigint").alias("cents"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY CUBE (n_name, o_orderpriority)")
def extra_order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (A.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), n.n_nationkey == c.c_nationkey)  # nation is a fixed list
    return j.cube("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").cast("bigint").alias("g"))
