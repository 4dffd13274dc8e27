"""States of a recording from a stream of its frames: segmentation by text and merging of near duplicates, in event time.

Recordings are dealt to a fixed number of groups by a hash of their names; a group
is what state and timers are kept for, so that many short recordings cost their
frames and not a call of state each.  Frames may come in any order within the
watermark.  They wait as sorted runs of ``RUN`` frames at most, by the time slot
of the first; when the watermark passes that slot's end, the group's one timer
takes the frames of all slots that are over in order through the segmenter, whose
few values for each recording are a state of their own, so what is held in memory
is the runs that overlap in time.  A state is emitted when the next one begins, or
when the recording has been idle for ``idle`` and the slot in which that was is
over, which ends it and drops all that was kept of it.  State lives in RocksDB and
is checkpointed: a query that starts again goes on where it was.

Defined results: a frame later than the watermark is dropped, and counted by
Spark; frames of one time go by their place; a recording that goes on after its
idle time is a new one; NULL lines are none.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.stores import shared_dir

#: Frames that wait as one value, at most; as many times that are sorted together when they come.
RUN, SORTED = 4096, 16
#: Rows of a batch that is emitted, at most about.
ROWS = 8192
#: Groups of recordings; a table of more than so many frames a group has more of them.
GROUPS, GROUP_FRAMES = 1024, 16_384
STATES = "rec {rec}, pos bigint, idx bigint, t_start double, t_end double, lines array<string>, keyframe bigint"
_OTHER = re.compile("[^0-9a-z]+")


@lru_cache(1 << 14)
def _normalized(line: str) -> str:
    return _OTHER.sub(" ", line.lower()).strip(" ")


def line_set(lines) -> frozenset:
    """Distinct normalised lines that are not blank, as ``text.line_set`` has them."""
    return frozenset(x for x in map(_normalized, lines) if x)


#: Frames (instant, place, recording, t, lines, moved) in time, those of one instant by their place.
_in_order = itemgetter(0, 1)


def likeness(a: frozenset, b: frozenset) -> float:
    return 1.0 if not a and not b else len(a & b) / len(a | b)


class Segmenter:
    """The rules, frame by frame: ``segment_by_text`` and, with a ``merge`` threshold, ``merge_near``."""

    def __init__(self, threshold: float, motion: float, merge: float | None):
        self.threshold, self.motion, self.merge = threshold, motion, merge

    def frame(self, now: tuple | None, pos: int, t: float, lines: list, moved: float | None) -> tuple[tuple, tuple | None]:
        """(segment that goes on, segment that ended or None).  Remembered: the text of the last frame that moved."""
        seen = pos == 0 or (moved is not None and moved >= self.motion)
        if now is None:
            return (0, t, t, lines if seen else None, pos, lines if seen else None), None
        seg, t_start, t_end, text, keyframe, before = now
        split = seen and before is not None and likeness(line_set(before), line_set(lines)) < self.threshold
        before = lines if seen else before
        if split:
            return (seg + 1, t, t, lines, pos, before), (seg, t_start, t_end, text, keyframe)
        return (seg, min(t_start, t), max(t_end, t), lines if seen else text, max(keyframe, pos), before), None

    def ended(self, kept: tuple | None, segment: tuple) -> tuple[tuple, tuple | None]:
        """(kept state, state to emit or None) once a segment has ended."""
        seg, t_start, t_end, lines, keyframe = segment
        if kept is None:
            return (0, seg, t_start, t_end, lines, keyframe), None
        if self.merge is not None and likeness(line_set(kept[4] or []), line_set(lines or [])) >= self.merge:
            return (*kept[:3], t_end, *kept[4:]), None
        return (kept[0] + 1, seg, t_start, t_end, lines, keyframe), kept


class MotionSegmenter(Segmenter):
    """Splits by a number's change against the frame before, or its drift against the segment's first one, as ``segment_by_motion`` has it.

    The number comes where text rules have how far a frame moved.  Remembered: the last number, and the segment's first.
    """

    def __init__(self, threshold: float):
        super().__init__(threshold, 0.0, None)

    def frame(self, now: tuple | None, pos: int, t: float, lines: list, value: float) -> tuple[tuple, tuple | None]:
        if now is None:
            return (0, t, t, lines, pos, [value, value]), None
        seg, t_start, t_end, text, keyframe, (prev, anchor) = now
        if abs(value - prev) >= self.threshold or abs(value - anchor) >= self.threshold:
            return (seg + 1, t, t, lines, pos, [value, value]), (seg, t_start, t_end, text, keyframe)
        return (seg, min(t_start, t), max(t_end, t), lines, max(keyframe, pos), [value, anchor]), None


class StatesOfStream(StatefulProcessor):
    """A key is a group of recordings, each frame's in ``rec``; without that column the key is the recording."""

    def __init__(self, rules: Segmenter, slot_ms: int, idle_ms: int):
        self.rules, self.slot_ms, self.idle_ms = rules, slot_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Values are pickled here: one string of bytes crosses to the JVM, not a row for every frame.
        self.waiting = handle.getMapState("waiting", "first bigint, n bigint", "frames binary")
        # By recording: the segment that goes on (its number, times, text, keyframe, what the rules remember), the kept state that it may join, the last frame's instant.
        self.going = handle.getValueState("going", "now binary")
        self.due = handle.getValueState("due", "at bigint, runs bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due, runs = self.due.get() or (None, 0)
        first, frames = None, self._frames(key, rows)
        while some := list(islice(frames, SORTED * RUN)):
            some.sort(key=_in_order)
            for i in range(0, len(some), RUN):
                slot = self._slot(some[i])
                self._wait(slot, runs, some[i : i + RUN])
                first, runs = slot if first is None else min(first, slot), runs + 1
        if first is not None:
            self._wake(due, (first + 1) * self.slot_ms, runs)
        yield from ()

    def _frames(self, key, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Frames as tuples; equal texts and names are one object."""
        texts, names = {}, {}
        for part in rows:
            recs = part["rec"].tolist() if "rec" in part else [key[0]] * len(part)
            for at, p, rec, t, x, m in zip(part["at"].tolist(), part["pos"].tolist(), recs, part["t"].tolist(), part["lines"].tolist(), part["moved"].tolist()):
                if p is None or t is None or p != p or t != t:
                    continue
                if len(texts) > RUN:
                    texts.clear()
                lines = () if x is None else tuple(map(str, x))
                yield int(at), int(p), names.setdefault(rec, rec), float(t), texts.setdefault(lines, lines), None if m is None or m != m else float(m)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        going, (_, runs) = self.going.get(), self.due.get()
        going = pickle.loads(going[0]) if going else {}
        # Runs in the order of their first slots: frames before the next one's first are taken, so what is held is runs that overlap.
        heads, held = sorted(tuple(k) for k in self.waiting.keys()), []
        over, slots = [h for h in heads if (h[0] + 1) * self.slot_ms <= mark], mark // self.slot_ms
        for i, head in enumerate(over):
            held = [*held, *pickle.loads(bytes(self.waiting.getValue(head)[0]))]
            self.waiting.removeKey(head)
            stop = over[i + 1][0] if i + 1 < len(over) else slots
            if stop == head[0]:
                continue  # the next run begins in the same slot
            held.sort(key=_in_order)
            ready = bisect_left(held, stop, key=self._slot)
            for at, pos, rec, t, lines, moved in held[:ready]:
                now, kept, last = going.get(rec, (None, None, None))
                if last is not None and at - last >= self.idle_ms:
                    kept, now = self._end(rec, kept, now, out)
                now, segment = self.rules.frame(now, pos, t, lines, moved)
                if segment:
                    kept, state = self.rules.ended(kept, segment)
                    out += [(rec, *state)] if state else []
                going[rec] = now, kept, at
            held = held[ready:]
            if len(out) >= ROWS:
                yield self._rows(out)
                out = []
        rest = [h[0] for h in heads[len(over) :]]
        for i in range(0, len(held), RUN):
            rest.append(self._slot(held[i]))
            self._wait(rest[-1], runs, held[i : i + RUN])
            runs += 1
        # Every frame before the mark's slot was taken: what waits or may come is no earlier than that, and a recording idle until then has ended.
        for rec, (now, kept, last) in list(going.items()):
            if last + self.idle_ms <= slots * self.slot_ms:
                self._end(rec, kept, now, out)
                del going[rec]
        if going:
            self.going.update((pickle.dumps(going, pickle.HIGHEST_PROTOCOL),))
        else:
            self.going.clear()
        wakes = [(min(rest) + 1) * self.slot_ms] if rest else []
        if going:
            idle = min(last for _, _, last in going.values()) + self.idle_ms
            wakes.append(-(-idle // self.slot_ms) * self.slot_ms)
        if wakes:
            self._wake(None, min(wakes), runs)
        else:
            self.due.clear()
        if out:
            yield self._rows(out)

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["rec", "pos", "idx", "t_start", "t_end", "lines", "keyframe"])

    def _slot(self, frame: tuple) -> int:
        return frame[0] // self.slot_ms

    def _wait(self, slot: int, n: int, frames: list[tuple]) -> None:
        self.waiting.updateValue((slot, n), (pickle.dumps(frames, pickle.HIGHEST_PROTOCOL),))

    def _wake(self, due: int | None, at: int, runs: int) -> None:
        """One timer a group, the earliest: ``due`` is the one that it has."""
        if due is None or at < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(at)
            due = at
        self.due.update((due, runs))

    def _end(self, rec, kept, now, out: list) -> tuple[None, None]:
        """The recording is over: what went on is emitted."""
        if now:
            kept, state = self.rules.ended(kept, now[:5])
            out += [(rec, *state)] if state else []
        out += [(rec, *kept)] if kept else []
        return None, None


def states_of_stream(frames: DataFrame, threshold: float = 0.8, motion: float = 0.003, merge: float | None = 0.95, late: str = "1 minute", slot_seconds: float = 60.0, idle_seconds: float = 3600.0, rules: Segmenter | None = None, groups: int = GROUPS) -> DataFrame:
    """(rec, pos, idx, t_start, t_end, lines, keyframe) of a stream of frames (rec, pos, t, ts, lines, moved).

    ``merge=None`` gives every segment.  ``late``: how far behind the latest frame
    one may come.  ``rules``: others than those for text.  ``groups``: among how
    many keys of state recordings are dealt; it stays as it is for a checkpoint.
    A recording's name is of a type that a string can be cast to.
    """
    kind = frames.schema["rec"].dataType.simpleString()
    group = F.when(F.col("rec").isNotNull(), F.pmod(F.xxhash64("rec"), F.lit(groups))).otherwise(-1).alias("group")
    rec = F.col("rec").cast("string").alias("rec")
    rows = frames.withWatermark("ts", late).select(group, rec, "pos", F.col("t").cast("double").alias("t"), "ts", F.unix_millis("ts").alias("at"), "lines", F.col("moved").cast("double").alias("moved"))
    processor = StatesOfStream(rules or Segmenter(threshold, motion, merge), int(slot_seconds * 1000), int(idle_seconds * 1000))
    states = rows.groupBy("group").transformWithStateInPandas(processor, STATES.format(rec="string"), "Append", "EventTime")
    return states.withColumn("rec", F.col("rec").cast(kind))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, in two partitions a core at most: each has a worker of its own."""
    most = 2 * spark.sparkContext.defaultParallelism
    given = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.shuffle.partitions": str(min(most, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {k: spark.conf.get(k, None) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def arriving(frames: DataFrame, folder: str, slices: int = 4, jitter_seconds: int = 86_400, end: str = "2100-01-01") -> tuple[int, list[DataFrame]]:
    """The number of frames (rec, pos, t, ts, lines, moved) of a table, and slices of them, one after the other, in an order of arrival that is not theirs.

    A frame comes up to ``jitter_seconds`` after its time, by a hash of it.  The
    last slice holds one frame at ``end``, of no recording: it lets all others end.
    The frames are made once, in ``folder``.
    """
    columns, spark = ["rec", "pos", "t", "ts", "lines", "moved"], frames.sparkSession
    frames.select(*columns, (F.unix_millis("ts") + F.pmod(F.xxhash64("rec", "pos"), F.lit(jitter_seconds * 1000))).alias("arrives")).write.parquet(folder)
    dealt = spark.read.schema(frames.select(*columns).schema.add("arrives", "long")).parquet(folder)
    turn = F.lit(0)
    for c in dealt.approxQuantile("arrives", [i / slices for i in range(1, slices)], 0.01):
        turn = turn + (F.col("arrives") > c).cast("int")
    last = {"ts": F.lit(end), "lines": F.array()}
    closing = spark.range(1).select(*[last.get(c, F.lit(None)).cast(frames.schema[c].dataType).alias(c) for c in columns])
    return dealt.count(), [*[dealt.where(turn == i).select(*columns) for i in range(slices)], closing]


def run_states(frames: DataFrame, slices: int = 4, jitter_seconds: int = 86_400, **options) -> DataFrame:
    """``states_of_stream`` run over a table's frames as they arrive: a query for each slice, each going on where the last one ended."""
    spark, folder = frames.sparkSession, f"{shared_dir(frames.sparkSession)}/arriving_{uuid.uuid4().hex}"
    schema = frames.select("rec", "pos", "t", "ts", "lines", "moved").schema
    incoming = f"{folder}/in"
    spark.createDataFrame([], schema).write.parquet(f"{incoming}/none")
    stream = spark.readStream.schema(schema).parquet(f"{incoming}/*")
    n, parts = arriving(frames, f"{folder}/dealt", slices, jitter_seconds)
    states = states_of_stream(stream, late=f"{jitter_seconds} seconds", **{"groups": max(GROUPS, n // GROUP_FRAMES)} | options)
    spark.createDataFrame([], states.schema).write.parquet(f"{folder}/out/batch=-1")

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    with rocksdb(spark):
        for i, part in enumerate(parts):
            part.write.parquet(f"{incoming}/{i}")
            query = states.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write)
            query.start().awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{folder}/out").select(*states.columns)
