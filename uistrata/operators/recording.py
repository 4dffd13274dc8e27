"""From frames to the states of an index: the whole build, each part by choice.

``frames``: rec, pos, t, moved (change against the frame before), boxes (text
and place of each line) or lines, and a picture for keyframes.  ``cursor``: rec,
t, x, y.  The order of the parts matters: text is masked before states are
compared, states are merged before they are told apart, events read regions,
interactions and boxes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels, redact
from . import events, index, sequence

SLOW_FRAMES = 150
FORMATS = ("png", "jpg", "jpeg")


def bounded(name: str, value: float, low: float, high: float) -> float:
    """``value`` as a number; ValueError outside the closed range."""
    value = float(value)
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def positive(name: str, value: float, kind: type = float) -> float:
    value = kind(value)
    if value <= 0:
        raise ValueError(f"{name} must be greater than 0")
    return value


def not_negative(name: str, value: float, kind: type = float) -> float:
    value = kind(value)
    if value < 0:
        raise ValueError(f"{name} must be 0 or greater")
    return value


@dataclass(frozen=True)
class Options:
    """What a build does; values out of range raise ValueError."""

    fps: float = 2.0
    change_threshold: float = 0.04
    text_threshold: float = 0.80
    motion_epsilon: float = 0.003
    dedupe_threshold: float = 0.95
    fast: bool = False
    boxes: bool = False
    redact: bool = False
    interactions: bool = False
    events: bool = False
    keyframe_budget: int | None = None
    max_frames: int | None = None
    keyframe_format: str = "png"
    keyframe_quality: int = 90
    thumb_width: int = 320
    ocr_threads: int = 2
    pixel_delta: int = pixels.PIXEL_DELTA

    def __post_init__(self):
        positive("fps", self.fps)
        for name in ("change_threshold", "text_threshold", "motion_epsilon"):
            bounded(name.replace("_", " "), getattr(self, name), 0.0, 1.0)
        not_negative("dedupe threshold", self.dedupe_threshold)
        not_negative("ocr threads", self.ocr_threads, int)
        positive("thumb width", self.thumb_width, int)
        bounded("keyframe quality", self.keyframe_quality, 1, 100)
        for name in ("keyframe_budget", "max_frames"):
            if getattr(self, name) is not None:
                positive(name.replace("_", " "), getattr(self, name), int)
        if self.keyframe_format.lower().lstrip(".") not in FORMATS:
            raise ValueError(f"unsupported keyframe format: {self.keyframe_format} (use png or jpg)")

    @property
    def needs_boxes(self) -> bool:
        return self.boxes or self.redact or self.interactions or self.events


def slow_warning(duration: Column, fps: float, fast: bool = False, max_frames: int | None = None, threshold: int = SLOW_FRAMES) -> Column:
    """A hint where many frames would have to be read as text; NULL otherwise."""
    frames = duration * fps
    if max_frames:
        frames = F.least(frames, F.lit(float(max_frames)))
    said = F.concat(F.lit("~"), F.floor(frames).cast("string"), F.lit(" frames to read as text: this can take minutes; segment by motion alone or limit the frames to speed it up"))
    return F.when(F.lit(not fast) & (frames > threshold), said)


def reading_order(boxes: Column, height: Column) -> Column:
    """Boxes from top to bottom, then left to right: rows of 1.5 % of the height; blank texts go, others are trimmed."""
    bucket = F.greatest(F.lit(1.0), height * 0.015)
    keyed = F.transform(boxes, lambda b, i: F.struct(F.bround(b["box"][1] / bucket).alias("row"), b["box"][0].alias("x"), i.alias("i"), F.trim(b["text"]).alias("text"), b["box"].alias("box")))
    return F.transform(F.filter(F.sort_array(keyed), lambda k: k["text"] != ""), lambda k: F.struct(k["text"].alias("text"), k["box"].alias("box")))


def corners_to_box(points: Column) -> Column:
    """[x, y, w, h] in whole pixels of a region given by its corner points [[x, y], ...]."""
    xs, ys = F.transform(points, lambda p: p[0].cast("double")), F.transform(points, lambda p: p[1].cast("double"))
    x, y = F.array_min(xs), F.array_min(ys)
    side = lambda hi, lo: F.greatest(F.lit(0), (hi - lo).cast("int"))
    return F.array(x.cast("int"), y.cast("int"), side(F.array_max(xs), x), side(F.array_max(ys), y))


def build(frames: DataFrame, options: Options = Options(), cursor: DataFrame | None = None, width: int = 0, height: int = 0, picture=None, with_gray: bool = False) -> DataFrame:
    """(rec, pos, idx, t_start, t_end, thumbnail, keyframe, lines, added, removed, boxes, interaction, event, salience).

    ``picture``: gray array of a frame from its columns (the column ``gray`` where
    there is one): read for keyframes alone, and for all frames if the cursor is
    to be found in them, which it is where interactions are asked for and no
    ``cursor`` is given.  Text that is masked is blurred in its keyframe, so
    regions, sharpness and files are those of what may be seen.
    ``interaction`` and ``event`` are NULL where there is none; ``with_gray`` adds
    the keyframes' pictures.
    """
    o = options
    has_boxes = "boxes" in frames.columns
    has_gray = bool(width and height) and (picture is not None or "gray" in frames.columns)  # without a size there are no pictures
    if o.interactions and cursor is None and not has_gray:
        raise ValueError("interactions need cursor positions, or pictures with a size to find the cursor in")
    if o.needs_boxes and not has_boxes and (o.boxes or o.interactions or o.events):
        raise ValueError("boxes, interactions and events need frames with boxes")
    f = frames
    if "lines" not in f.columns:
        f = f.withColumn("lines", F.transform("boxes", lambda b: b["text"]))
    if o.max_frames:
        f = f.where(F.col("pos") < o.max_frames)
    others = [c for c in f.columns if c not in ("rec", "pos", "t", "moved", "lines")]
    f = f.withColumn("shot", F.struct(*others, F.lit(0).alias("none")))
    if o.interactions and cursor is None:
        cursor = sequence.tracked_cursor(f.select("rec", "pos", "t", (picture(F.col("shot")) if picture is not None else F.col("gray")).alias("gray")), width)
    segments = sequence.settled(sequence.segment_by_motion(f, o.change_threshold, "gray"), ("shot",)) if o.fast else sequence.segment_by_text(f, o.text_threshold, o.motion_epsilon, ("shot",))
    empty = F.array().cast("array<struct<text:string,box:array<int>>>")
    boxes = F.transform("shot.boxes", lambda b: F.struct(b["text"].alias("text"), b["box"].cast("array<int>").alias("box"))) if has_boxes else empty
    segments = segments.withColumn("boxes", boxes)
    if o.needs_boxes and has_boxes:
        segments = segments.withColumn("lines", F.transform("boxes", lambda b: b["text"]))
    hidden = F.array().cast("array<array<int>>")
    if o.redact:
        segments = segments.withColumn("masked", redact.masked_lines(F.col("lines")))
        if has_boxes:
            hidden = F.transform(F.filter("boxes", lambda b, i: F.get(F.col("masked"), i) != F.get(F.col("lines"), i)), lambda b: b["box"]) if o.needs_boxes else hidden
            segments = segments.withColumn("hidden", hidden)
            segments = segments.withColumn("boxes", F.zip_with("boxes", "masked", lambda b, x: F.struct(x.alias("text"), b["box"].alias("box"))))
        segments = segments.withColumn("lines", F.col("masked")).drop("masked")
    states = sequence.with_diffs(sequence.merge_near(segments, o.dedupe_threshold))
    states = states.withColumns({"t_start": F.round("t_start", 3), "t_end": F.round("t_end", 3)})
    gray = None
    if has_gray:
        gray = picture(F.col("shot")) if picture is not None else F.col("shot.gray")
        states = states.withColumn("gray", gray.cast("array<int>"))
        if "hidden" in states.columns:
            states = states.withColumn("gray", pixels.blurred(F.col("gray"), F.lit(width), F.col("hidden")))
    none = F.lit(None).cast("struct<t:double,x:int,y:int,label:string>")
    if o.interactions and cursor is not None:
        states = index.with_cursor(states, cursor).withColumn("at", events.hotspot(F.col("xs"), F.col("ys")))
        near = events.nearest_label(F.col("at.x"), F.col("at.y"), F.col("boxes"), F.lit(width), F.lit(height))
        states = states.withColumn("interaction", F.when(F.col("at").isNotNull(), F.struct(F.col("t_end").alias("t"), F.col("at.x").cast("int").alias("x"), F.col("at.y").cast("int").alias("y"), near.alias("label"))))
    else:
        states = states.withColumn("interaction", none)
    if o.events:
        states = with_events(states, width, height, o.pixel_delta)
    else:
        states = states.withColumn("event", F.lit(None).cast("struct<type:string,t:double,region:array<int>,confidence:double,label:string,field:string,value:string>"))
    if o.keyframe_budget:
        sharp = F.coalesce(pixels.sharpness(F.col("gray"), F.lit(width)), F.lit(0.0)) if gray is not None else None
        states = index.with_salience(states.withColumn("sharp", sharp) if sharp is not None else states, F.col("sharp") if sharp is not None else None)
    else:
        states = states.withColumn("salience", F.lit(0.0))
    name = F.concat(F.lit("frames/"), F.lpad(F.col("idx").cast("string"), 5, "0"))
    ext = o.keyframe_format.lower().lstrip(".")
    states = states.withColumns({"keyframe": F.concat(name, F.lit(f".{ext}")), "thumbnail": F.concat(name, F.lit(f"_thumb.{ext}"))})
    shown = F.col("boxes") if o.boxes else empty
    more = ["gray"] if with_gray and has_gray else []
    return states.select("rec", "pos", "idx", "t_start", "t_end", "thumbnail", "keyframe", "lines", "added", "removed", shown.alias("boxes"), "interaction", "event", "salience", *more)


def until_failure(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames before the first that could not be decoded, notes (rec, pos, note)); ``frames``: rec, pos, failed."""
    first = frames.where("failed").groupBy("rec").agg(F.min("pos").alias("stop"))
    kept = frames.join(first, "rec", "left").where("stop is null or pos < stop").drop("stop", "failed")
    said = F.concat(F.lit("decoding stopped early at frame "), F.col("stop").cast("string"))
    return kept, first.select("rec", F.col("stop").alias("pos"), said.alias("note"))


def warnings(notes: DataFrame) -> DataFrame:
    """(rec, warnings): each distinct note of a recording once, by its first frame, with how often it was made.

    Equal notes are counted map-side, so a recording whose every frame failed in
    one way has one warning.
    """
    each = notes.where("note is not null").groupBy("rec", "note").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    said = F.when(F.col("n") > 1, F.concat("note", F.lit(" ("), F.col("n").cast("string"), F.lit(" frames, the first "), F.col("pos").cast("string"), F.lit(")"))).otherwise(F.col("note"))
    rows = each.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"))
    return rows.select("rec", F.transform("all", lambda z: z["said"]).alias("warnings"))


def with_events(states: DataFrame, width: int, height: int, delta: int) -> DataFrame:
    """``states`` with ``event``, the typed transition from the state before: NULL for the first.

    Regions and fields are columns of their own, so each is computed once.
    """
    by = W.partitionBy("rec").orderBy("pos")
    region = F.lit(None).cast("struct<box:array<int>,coverage:double,shape:string>")
    if "gray" in states.columns:
        states = states.withColumn("gray_before", F.lag("gray").over(by))
        region = pixels.changed_region(F.col("gray_before"), F.col("gray"), F.lit(width), F.lit(height), delta)
    states = states.withColumns({"region": region, "field": events.field_for(F.get("added", 0), F.col("prev_lines"), F.col("boxes"))})
    kind = events.classify_event(F.col("prev_lines"), F.col("added"), F.col("removed"), F.col("region.shape"), F.col("field"), F.col("interaction").isNotNull(), F.col("interaction.label"))
    states = states.withColumn("kind", kind)
    place = F.coalesce(F.transform("region.box", lambda x: x.cast("int")), F.array(*[F.lit(0)] * 4))
    made = F.struct(*[F.col(f"kind.{c}").alias(c) if c not in ("t", "region") else (F.col("t_start") if c == "t" else place).alias(c) for c in ("type", "t", "region", "confidence", "label", "field", "value")])
    return states.withColumn("event", F.when((F.col("pos") > 0) & F.col("kind").isNotNull(), made))
