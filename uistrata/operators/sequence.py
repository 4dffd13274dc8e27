"""Sequence operators: segmentation, merging, islands.  All are partitioned by ``rec``, so one exchange serves those that follow one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import pixels, text


def sampled(frames: DataFrame, native_fps: float, sample_fps: float, limit: int | None = None) -> DataFrame:
    """Every step-th frame of a recording, numbered anew; all frames for a rate of 0."""
    step = max(1, round(native_fps / sample_fps)) if sample_fps else 1
    out = frames.where(F.col("pos") % step == 0).withColumn("out_idx", (F.col("pos") / step).cast("bigint"))
    return out.where(F.col("out_idx") < limit) if limit else out


def segment_by_text(frames: DataFrame, threshold: float = 0.8, motion: float = 0.003, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rec, seg, t_start, t_end, lines, keyframe, *keep): a segment ends where the text of a moved frame is unlike the last moved one's.

    ``frames``: rec, pos, t, lines, moved (change against the frame before), and
    columns to ``keep`` of each segment's last frame, its keyframe.  Frames that
    did not move keep the segment, so windows of one partition and order suffice.
    """
    by = W.partitionBy("rec").orderBy("pos")
    seen = (F.col("pos") == 0) | (F.col("moved") >= motion)
    f = frames.withColumns({"seen": seen, "line_set": text.line_set(F.col("lines"))})
    before = F.last(F.when(F.col("seen"), F.col("line_set")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1))
    f = f.withColumn("before", before)
    unlike = text.similarity_of_sets(F.col("before"), F.col("line_set")) < threshold
    f = f.withColumn("split", F.when(F.col("seen") & F.col("before").isNotNull() & unlike, 1).otherwise(0)).withColumn("seg", F.sum("split").over(by))
    last = F.max(F.when(F.col("seen"), F.struct("pos", "lines")))
    end = F.max_by(F.struct("pos", *keep), "pos")
    out = f.groupBy("rec", "seg").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), last.alias("last"), end.alias("end"))
    return out.select("rec", "seg", "t_start", "t_end", F.col("last.lines").alias("lines"), F.col("end.pos").alias("keyframe"), *[F.col(f"end.{c}").alias(c) for c in keep])


def _jaccard(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def merge_near(segments: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Segments like the last *kept* one extend it: what is kept depends on what was kept.

    A pass over sorted batches that carries one segment, the last that was kept
    and may still grow, so a recording of any length takes the memory of a batch.
    Returns the columns of ``segments``, with ``seg`` as ``idx`` and ``pos``, the
    number of a kept one.
    """

    def made(rows: pa.RecordBatch, ends: list[float], places: list[int]) -> pa.RecordBatch:
        at = rows.schema.get_field_index("t_end")
        columns = [pa.array(ends, pa.float64()) if i == at else c for i, c in enumerate(rows.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int64())], [*rows.schema.names, "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, last, number, held, held_end = None, None, -1, None, 0.0
        for batch in batches:
            rows = batch.drop_columns(["line_set"])
            kept, ends, places = [], [], []
            for i, (own, lines, end) in enumerate(zip(batch.column("rec").to_pylist(), batch.column("line_set").to_pylist(), batch.column("t_end").to_pylist())):
                lines, new = frozenset(lines or ()), own != rec or number < 0
                if not new and _jaccard(last, lines) >= threshold:
                    if kept:
                        ends[-1] = end
                    else:
                        held_end = end
                    continue
                rec, last, number = own, lines, 0 if new else number + 1
                kept.append(i)
                ends.append(end)
                places.append(number)
            if kept:
                if held is not None:
                    yield made(held[0], [held_end], [held[1]])
                if len(kept) > 1:
                    yield made(rows.take(pa.array(kept[:-1], pa.int64())), ends[:-1], places[:-1])
                held, held_end = (rows.slice(kept[-1], 1), places[-1]), ends[-1]
        if held is not None:
            yield made(held[0], [held_end], [held[1]])

    schema = T.StructType([*segments.schema, T.StructField("pos", T.LongType())])
    rows = segments.withColumn("line_set", text.line_set(F.col("lines")))
    out = rows.repartition("rec").sortWithinPartitions("rec", "seg").mapInArrow(run, schema)
    return out.withColumnRenamed("seg", "idx")


def segment_by_motion(frames: DataFrame, threshold: float = 0.04, column: str = "x") -> DataFrame:
    """``frames`` with ``seg``: splits by motion against the frame before or drift against the segment's first frame.

    ``frames``: rec, pos and a picture in ``column``: a gray array, of which the
    mean absolute difference over 255 is taken, or a number that stands for it,
    whose difference is taken as it is.  Frames stream through a partition sorted
    by recording, so a recording of any length takes the memory of a batch.
    """
    numbers = not isinstance(frames.schema[column].dataType, T.ArrayType)

    def change(a, b) -> float:
        if numbers:
            return abs(a - b)
        return float(np.abs(a - b).mean()) / 255.0 if a.shape == b.shape else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, seg, prev, anchor = None, 0, None, None
        for batch in batches:
            segs = []
            for own, x in zip(batch.column("rec").to_pylist(), batch.column(column)):
                x = x.as_py() if numbers else np.asarray(x.values, np.int16)
                if prev is None or own != rec:
                    rec, seg, anchor = own, 0, x
                elif change(prev, x) >= threshold or change(anchor, x) >= threshold:
                    seg, anchor = seg + 1, x
                prev = x
                segs.append(seg)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.int32())], [*batch.schema.names, "seg"])

    schema = T.StructType([*frames.schema, T.StructField("seg", T.IntegerType())])
    return frames.repartition("rec").sortWithinPartitions("rec", "pos").mapInArrow(run, schema)


#: Frames of a recording that follow the cursor together.
CURSOR_FRAMES = 2048


def with_chunks(frames: DataFrame, size: int) -> DataFrame:
    """``frames`` (rec, pos) with ``chunk`` and ``lead``: runs of ``size`` places, each led by the last frame of the run before.

    So a pass that looks one frame back needs no whole recording in one task.  A
    frame that leads a run stands twice; which ones do is known from numbers alone.
    """
    placed = frames.withColumn("chunk", F.floor(F.col("pos") / size).cast("bigint"))
    ends = placed.groupBy("rec", "chunk").agg(F.max("pos").alias("pos"))
    after = F.lead("chunk").over(W.partitionBy("rec").orderBy("chunk"))
    ends = ends.withColumn("next", after).where("next is not null").select("rec", "pos", "next")
    runs = F.array(F.struct("chunk", F.lit(False).alias("lead")), F.struct(F.col("next").alias("chunk"), F.lit(True).alias("lead")))
    own = F.array(F.struct("chunk", F.lit(False).alias("lead")))
    both = placed.join(ends, ["rec", "pos"], "left").withColumn("run", F.explode(F.when(F.col("next").isNull(), own).otherwise(runs)))
    return both.withColumns({"chunk": F.col("run.chunk"), "lead": F.col("run.lead")}).drop("run", "next")


def tracked_cursor(frames: DataFrame, width: int, size: int = CURSOR_FRAMES) -> DataFrame:
    """(rec, t, x, y): where each frame's picture shows the cursor against the one before, if it does.

    ``frames``: rec, pos, t, gray (NULL where a frame has no picture: it is passed
    over).  A pass over sorted batches that carries the last picture; recordings
    are cut into runs, so a long one is many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prev = None, None
        for batch in batches:
            recs, chunks, leads = batch.column("rec").to_pylist(), batch.column("chunk").to_pylist(), batch.column("lead").to_pylist()
            values, ends = pixels.gray_values(batch.column("gray"))
            grays, alike = [values[a:b] for a, b in zip(ends, ends[1:])], {}
            for i, own in enumerate(zip(recs, chunks)):
                before = grays[i - 1] if i else prev
                if own == key and not leads[i] and len(before) == len(grays[i]) and len(before):
                    alike.setdefault(len(before), []).append((i, before))
                key = own
            if grays:
                prev = grays[-1].copy()
            spots = []
            # Pictures of one size are compared together, some at a time.
            for size, pairs in alike.items():
                step = max(1, pixels.AT_ONCE // size)
                for some in (pairs[j : j + step] for j in range(0, len(pairs), step)):
                    a, b = np.stack([before for _, before in some]), np.stack([grays[i] for i, _ in some])
                    found = pixels.cursors_between(a.reshape(len(some), -1, width), b.reshape(len(some), -1, width))
                    spots += [(i, *spot) for (i, _), spot in zip(some, found) if spot]
            at, xs, ys = zip(*sorted(spots)) if spots else ((), (), ())
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("rec"), rows.column("t"), pa.array(xs, pa.int32()), pa.array(ys, pa.int32())], ["rec", "t", "x", "y"])

    kind = frames.schema["rec"].dataType.simpleString()
    shown = frames.where("gray is not null").select("rec", "pos", F.col("t").cast("double").alias("t"), "gray")
    cut = with_chunks(shown, size)
    return cut.repartition("rec", "chunk").sortWithinPartitions("rec", "chunk", "pos").mapInArrow(run, f"rec {kind}, t double, x int, y int")


def settled(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(rec, seg, t_start, t_end, lines, keyframe, *keep) of frames with ``seg``; text and ``keep`` are the last frame's."""
    end = F.max_by(F.struct("pos", "lines", *keep), "pos")
    out = frames.groupBy("rec", "seg").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), end.alias("end"))
    return out.select("rec", "seg", "t_start", "t_end", F.col("end.lines").alias("lines"), F.col("end.pos").alias("keyframe"), *[F.col(f"end.{c}").alias(c) for c in keep])


def with_diffs(states: DataFrame) -> DataFrame:
    """Lines added and removed against the state before; the first one adds all."""
    by, none = W.partitionBy("rec").orderBy("pos"), F.array().cast("array<string>")
    out = states.withColumn("norms", text.normalize_lines(F.col("lines")))
    out = out.withColumns({"prev_lines": F.coalesce(F.lag("lines").over(by), none), "prev_norms": F.coalesce(F.lag("norms").over(by), none)})
    now, before = (F.col("lines"), F.col("norms")), (F.col("prev_lines"), F.col("prev_norms"))
    sides = {"added": text.surplus(now[0], before[0], now[1], before[1]), "removed": text.surplus(before[0], now[0], before[1], now[1])}
    return out.withColumns(sides).drop("norms", "prev_norms")


def islands(scores: DataFrame, threshold: float) -> DataFrame:
    """Runs of flagged frames: t_start, t_end, the first of the highest scores.  ``scores``: rec, pos, t, score."""
    flagged = scores.where(F.col("score") >= threshold)
    run = F.col("pos") - F.row_number().over(W.partitionBy("rec").orderBy("pos"))
    peak = F.max(F.struct("score", (-F.col("pos")).alias("back")))
    out = flagged.withColumn("run", run).groupBy("rec", "run").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"), peak.alias("peak"))
    return out.select("rec", "t_start", "t_end", (-F.col("peak.back")).alias("peak_frame"), F.col("peak.score").alias("peak_score"))


def cut_or_motion(similarity: Column, cut: float = 0.5) -> Column:
    """struct(type, confidence) of an island from the similarity at its peak."""
    below = F.when(F.lit(cut) == 0, 1.0).otherwise((cut - similarity) / cut)
    above = F.when(F.lit(cut) == 1, 1.0).otherwise((similarity - cut) / (1 - cut))
    is_cut = similarity < cut
    return F.struct(F.when(is_cut, "cut").otherwise("motion").alias("type"), F.round(F.when(is_cut, below).otherwise(above), 3).alias("confidence"))


def normalized(value: Column, by: W) -> Column:
    """Min-max to 0..1 within a partition; all equal gives 0."""
    lo, hi = F.min(value).over(by), F.max(value).over(by)
    return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)
