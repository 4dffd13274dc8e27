"""The older path: every sampled frame scored against the one before, runs of motion as events, one manifest a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pixels
from . import sequence

SENSITIVITY, CUT = 0.06, 0.5


def frame_times(frames: DataFrame, native_fps: float) -> DataFrame:
    """``frames`` (pos, container_ms) with ``t``: the container's time where it has one, else the place over the rate."""
    return frames.withColumn("t", F.when(F.col("container_ms") > 0, F.col("container_ms") / 1000.0).otherwise(F.col("pos") / F.lit(float(native_fps))))


def recording_info(frames: DataFrame, native_fps: float) -> DataFrame:
    """(rec, fps, count, width, height, duration) of raw frames (rec, pos, width, height); duration 0 for a rate of 0."""
    duration = F.count(F.lit(1)) / F.lit(float(native_fps)) if native_fps else F.lit(0.0)
    return frames.groupBy("rec").agg(F.lit(float(native_fps)).alias("fps"), F.count(F.lit(1)).alias("count"), F.first("width").alias("width"), F.first("height").alias("height"), duration.alias("duration"))


def scored(frames: DataFrame, sensitivity: float = SENSITIVITY) -> DataFrame:
    """(rec, pos, t, score, similarity, event, ascii, png) of frames (rec, pos, t, gray).

    The first frame has score 0 and similarity 1; scores are rounded before they are held against the sensitivity.
    """
    by = W.partitionBy("rec").orderBy("pos")
    f = frames.withColumn("prev", F.lag("gray").over(by))
    f = f.select("rec", "pos", "t", pixels.compared(F.col("prev"), F.col("gray")).alias("c"))  # one pass over the pixels
    first = F.col("c.score").isNull()
    score, alike = F.round(F.when(first, 0.0).otherwise(F.col("c.score")), 4), F.when(first, 1.0).otherwise(F.col("c.similarity"))
    name = F.concat(F.lit("frames/"), F.lpad(F.col("pos").cast("string"), 5, "0"))
    f = f.select("rec", "pos", F.round("t", 3).alias("t"), score.alias("score"), alike.alias("similarity"))
    return f.withColumns({"event": F.col("score") >= sensitivity, "ascii": F.concat(name, F.lit(".txt")), "png": F.concat(name, F.lit(".png"))})



def motion_events(scores: DataFrame, sensitivity: float = SENSITIVITY, cut: float = CUT) -> DataFrame:
    """(rec, t_start, t_end, peak_frame, peak_score, type, confidence) of runs of flagged frames, typed at their peak.

    Similarities ride with the frames, so runs need no join with them.
    """
    flagged = scores.where(F.col("score") >= sensitivity)
    run = F.col("pos") - F.row_number().over(W.partitionBy("rec").orderBy("pos"))
    peak = F.max(F.struct("score", (-F.col("pos")).alias("back"), "similarity"))
    out = flagged.withColumn("run", run).groupBy("rec", "run").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), peak.alias("peak"))
    kind = sequence.cut_or_motion(F.col("peak.similarity"), cut)
    return out.select("rec", "t_start", "t_end", (-F.col("peak.back")).alias("peak_frame"), F.col("peak.score").alias("peak_score"), kind["type"].alias("type"), kind["confidence"].alias("confidence"))


def manifests(frames: DataFrame, recordings: DataFrame, fps: float = 5.0, cols: int = 120, sensitivity: float = SENSITIVITY, cut: float = CUT) -> DataFrame:
    """(video, duration, sampled_fps, cols, frames, events): the document of each recording.  ``recordings``: rec, video, duration."""
    scores = scored(frames, sensitivity)
    one = F.struct(F.col("pos").cast("int").alias("idx"), "t", "score", "event", "ascii", "png")
    shown = scores.groupBy("rec").agg(F.array_sort(F.collect_list(one)).alias("frames"), F.max("t").alias("last"))
    run = F.struct("t_start", "t_end", F.col("peak_frame").cast("int").alias("peak_frame"), "peak_score", "type", "confidence")
    runs = motion_events(scores, sensitivity, cut).groupBy("rec").agg(F.array_sort(F.collect_list(run)).alias("events"))
    none = F.array().cast("array<struct<t_start:double,t_end:double,peak_frame:int,peak_score:double,type:string,confidence:double>>")
    out = shown.join(runs, "rec", "left").join(recordings, "rec")
    return out.select("video", F.round(F.greatest("duration", "last"), 3).alias("duration"), F.lit(float(fps)).alias("sampled_fps"), F.lit(cols).alias("cols"), "frames", F.coalesce("events", none).alias("events"))
