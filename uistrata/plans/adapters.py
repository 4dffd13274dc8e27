"""The given tables as recordings: frames with text lines, gray frames, scores, cursors, narration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels, redact
from ..operators import document, events, index, recording, sequence
from ..sources import stores

WIDTH = HEIGHT = 8
PIXELS_DELTA = 80
SPLIT, MOTION, MERGE = 0.8, 0.1, 0.95


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, pos, t (seconds), lines: distinct event types of the last five rows; moved: change of value over 500."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", "ts", "event_type", "value")
    by = W.partitionBy("rec").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        "rec",
        (F.row_number().over(by) - 1).cast("bigint").alias("pos"),
        ((us - F.min(us).over(W.partitionBy("rec"))) / 1e6).alias("t"),
        F.array_sort(F.collect_set("event_type").over(by.rowsBetween(-4, 0))).alias("lines"),
        F.col("value"),
        (F.abs(F.col("value") - F.lag("value").over(by)) / 500).alias("moved"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.segment_by_text(frames(spark, sf_dir), SPLIT, MOTION)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a table: segments merged, compared, typed and scored."""
    s = sequence.with_diffs(sequence.merge_near(segments(spark, sf_dir), MERGE))
    event = F.when(F.col("pos") > 0, events.classify_event(F.col("prev_lines"), F.col("added"), F.col("removed"), F.lit(None).cast("string")))
    return index.with_salience(s.withColumn("event", event))


def narration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, n, start, end, text: a minute of speech after each error row."""
    f = frames(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    kind = e.select(F.col("user_id").alias("rec"), (F.row_number().over(by) - 1).cast("bigint").alias("pos"), "event_type", "props")
    return f.join(kind, ["rec", "pos"]).where("event_type = 'error'").select("rec", F.col("pos").alias("n"), F.col("t").alias("start"), (F.col("t") + 60).alias("end"), F.col("props").alias("text"))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, vec_id, gray and the gray before: an embedding as an 8 x 8 picture."""
    e = table(spark, sf_dir, "embeddings")
    g = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") + 0.5) * 255))).cast("int"))
    rows = e.select(F.col("label").alias("rec"), "vec_id", g.alias("gray"))
    return rows.withColumn("prev", F.lag("gray").over(W.partitionBy("rec").orderBy("vec_id")))


# ---- whole recordings: boxes, pictures, cursors, speech and secrets, made of the events

#: What the full index is built with.
FULL = recording.Options(fps=0.001, text_threshold=0.8, motion_epsilon=0.05, dedupe_threshold=0.95, boxes=True, redact=True, interactions=True, events=True, keyframe_budget=3)
_CARD = "4111 1111 1111 1111"


def shots(spark: SparkSession, sf_dir: str, place: F.Column | None = None, height: int = HEIGHT) -> DataFrame:
    """rec, pos, t, moved, boxes, kind, k, value: six boxes of text a frame, in reading order, of the last six rows; ``place``: a box by ``k``."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), "event_id", "ts", F.col("event_type").alias("kind"), "value", (F.col("event_id") % 97).alias("k"))
    by = W.partitionBy("rec").orderBy("ts", "event_id")
    us, k = F.unix_micros(F.col("ts").cast("timestamp")), F.col("k")

    def joined(*parts) -> F.Column:
        return F.concat(*[p.cast("string") if isinstance(p, F.Column) else F.lit(p) for p in parts])

    said = (
        F.when(F.col("kind") == "view", joined("www.ex.com/", k % 9))
        .when(F.col("kind") == "click", joined("Open item ", k % 4))
        .when(F.col("kind") == "signup", joined("Mail u", k % 5, "@ex.com"))
        .when((F.col("kind") == "purchase") & (k % 3 == 0), joined("Card ", _CARD))
        .when(F.col("kind") == "purchase", joined("Buy ", k % 5))
        .when(k % 4 == 0, joined("Error ", k % 6, " denied"))
        .otherwise(joined("Note ", k % 3))
    )
    place = F.array(k * 3 % 8, k * 5 % 8, 1 + k % 3, 1 + k % 2).cast("array<int>") if place is None else place
    box = F.struct(said.alias("text"), place.alias("box"))
    return e.select(
        "rec",
        (F.row_number().over(by) - 1).cast("bigint").alias("pos"),
        (F.floor((us - F.min(us).over(W.partitionBy("rec"))) / 1000) / 1000.0).alias("t"),
        (F.abs(F.col("value") - F.lag("value").over(by)) / 500).alias("moved"),
        recording.reading_order(F.collect_list(box).over(by.rowsBetween(-5, 0)), F.lit(height)).alias("boxes"),
        "kind",
        "k",
        "value",
    )


def _java_mod(a: np.ndarray, n: int) -> np.ndarray:
    """The remainder with the sign of ``a``, as in SQL."""
    return np.fmod(a, n)


def _of_kind(kinds: pa.Array, values: dict[str, int], other: int) -> np.ndarray:
    """A column of the value of each kind."""
    return np.array([values.get(k, other) for k in kinds.to_pylist()], np.int64)[:, None]


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Columns (value, is null)."""
    none = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[:, None], none[:, None]


def _grays(pixels: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    """A list of pixels for each row of a matrix."""
    values = pa.array(pixels.reshape(-1).astype(np.int32), mask=None if none is None else none.reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, pixels.size + 1, pixels.shape[1], np.int32)), values)


def _picture(recs: pa.Array, kinds: pa.Array, ks: pa.Array) -> pa.Array:
    (rec, no_rec), (k, no_k) = _numbers(recs), _numbers(ks)
    wide = _of_kind(kinds, {"view": 8, "purchase": 5, "signup": 4, "error": 2}, 1)
    high = _of_kind(kinds, {"view": 8, "purchase": 5, "signup": 3}, 2)
    whole = _of_kind(kinds, {"view": 1}, 0) == 1
    x0, y0 = np.where(whole, 0, _java_mod(k, 8)), np.where(whole, 0, _java_mod(k // 8, 8))
    i = np.arange(WIDTH * HEIGHT)[None, :]
    x, y = i % WIDTH, i // WIDTH
    inside = (x >= x0) & (x < x0 + wide) & (y >= y0) & (y < y0 + high) & (whole | ~no_k)
    return _grays(np.where(inside, 200, _java_mod(i * 37 + rec * 11, 120)), no_rec & ~inside)


def picture(rec: F.Column, kind: F.Column, k: F.Column) -> F.Column:
    """Gray array of a frame: the recording's ground, and a bright patch whose place and size tell the event."""
    return F.arrow_udf(_picture, "array<int>")(rec, kind, k)


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, t, x, y: a position at each click and purchase."""
    s = shots(spark, sf_dir).where("kind in ('click', 'purchase')")
    return s.select("rec", "t", (F.col("k") % 8).cast("int").alias("x"), (F.floor(F.col("k") / 3) % 8).cast("int").alias("y"))


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, n, start, end, text: a minute after each error, with an address that must not be kept."""
    s = shots(spark, sf_dir).where("kind = 'error'")
    said = F.concat(F.lit("step "), F.col("k").cast("string"), F.lit(" of u1@ex.com"))
    return s.select("rec", F.col("pos").alias("n"), F.round("t", 3).alias("start"), F.round(F.col("t") + 60, 3).alias("end"), redact.masked(said).alias("text"))


def full_states(spark: SparkSession, sf_dir: str, options: recording.Options = FULL, with_gray: bool = False) -> DataFrame:
    shown = shots(spark, sf_dir).withColumn("owner", F.col("rec"))
    return recording.build(shown, options, cursor(spark, sf_dir), WIDTH, HEIGHT, lambda s: picture(s["owner"], s["kind"], s["k"]), with_gray)


#: Side of the larger screens.
SCREEN = 24


def _screen(kinds: pa.Array, ks: pa.Array) -> pa.Array:
    k, no_k = _numbers(ks)
    panel = _of_kind(kinds, {"view": 220, "click": 60, "signup": 100, "purchase": 140, "error": 180}, 20)
    i = np.arange(SCREEN * SCREEN)[None, :]
    x, y = i % SCREEN, i // SCREEN
    dx, dy = x - _java_mod(k * 5, 10), y - _java_mod(k * 7, 22)
    lit = (dx >= 0) & (dx <= 1) & (dy >= 0) & (dy <= 1) & ~no_k
    return _grays(np.where(x >= 12, panel + y, np.where(lit, 255, 10)))


def screen(kind: F.Column, k: F.Column) -> F.Column:
    """Gray array of 24 x 24: on the right a panel whose brightness tells the kind, on the left a cursor of 2 x 2."""
    return F.arrow_udf(_screen, "array<int>")(kind, k)


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, pos, t, moved, boxes, kind, k: the recordings on larger screens, whose only trace of a cursor is in their pictures."""
    k = F.col("k")
    box = F.array(k * 3 % 21, k * 5 % 23, 1 + k % 5, 2 + k % 4).cast("array<int>")
    return shots(spark, sf_dir, box, SCREEN)


def screen_states(spark: SparkSession, sf_dir: str, with_gray: bool = False) -> DataFrame:
    """The index of recordings made from their pictures and texts alone."""
    return recording.build(screens(spark, sf_dir), FULL, None, SCREEN, SCREEN, lambda s: screen(s["kind"], s["k"]), with_gray)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, pos, note: what readers had to say of some frames."""
    said = F.when(F.col("k") % 31 == 0, "text reading failed: blurred").when(F.col("k") % 47 == 1, "low light")
    return shots(spark, sf_dir).select("rec", "pos", said.alias("note"))


def full_index(spark: SparkSession, sf_dir: str, options: recording.Options = FULL) -> DataFrame:
    """A document per recording."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lasts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("rec")).agg((F.floor((F.max(us) - F.min(us)) / 1000) / 1000.0).alias("duration"))
    lasts = lasts.withColumn("video", F.concat(F.lit("rec"), F.col("rec").cast("string"), F.lit(".mp4")))
    return document.documents(full_states(spark, sf_dir, options), lasts, speech(spark, sf_dir), options.fps, recording.warnings(notes(spark, sf_dir)))


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``full_index`` written once a session for a state of the events' files: views and reports read the fields that they ask for."""
    key = ("index", stores.state_of_files(spark, f"{sf_dir}/events.parquet"), repr(FULL))
    return stores.kept(spark, key, lambda: full_index(spark, sf_dir))


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, vec_id, gray and the gray before, 24 x 24: three bright patches, of which small ones may be a cursor."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("rec"), "vec_id")
    v = F.col("vec_id")

    def pixel(i: F.Column) -> F.Column:
        x, y = i % 24, F.floor(i / 24)
        lit = F.lit(False)
        for a, b, w, h in ((7, 11, 2, 2 + v % 2), (13, 5, 1, 4), (3, 17, 5, 3)):
            x0, y0 = v * a % 24, v * b % 24
            lit = lit | ((x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h))
        return F.when(lit, 255).otherwise(10).cast("int")

    rows = e.withColumn("gray", F.transform(F.sequence(F.lit(0), F.lit(24 * 24 - 1)), pixel))
    return rows.withColumn("prev", F.lag("gray").over(W.partitionBy("rec").orderBy("vec_id")))
