"""Substring dedup: repeated word windows, found level by level.

A level looks at windows of one length (9, 18, then 35 words).  Only windows
that hold a window repeated at the level before are extended to about twice its
length, and the work ends when no candidates survive or the full length is
reached.  Below the full length a window need not be looked at by all its
parts: of the short windows inside a full one only the least by hash stands for
it (a minimiser), and equal full windows have the same one, so a level ships
one row in a dozen words and loses nothing.

1. Exact copies are set aside by 128 bits of their words: all windows of such a
   document repeat, and one copy stands in for the rest with weight two.  Groups
   that hold a ``HEAVY``-th of the rows are few, so they go to the rows.
2. Level 1: (hash) is counted map-side and shuffled; repeated hashes are joined
   back to (hash, document, place).  Both exchanges are plain join inputs, which
   adaptive execution may split, so one hot passage is no single task.
3. Later levels read the text of documents with candidates only.
4. Full windows are equal if 128 bits of their words are: the 64 that named the
   candidates and 64 over a second hash of each word's bytes, which knows nothing
   of the first, so that 10^13 windows hold no false pair (one in 10^12 such
   tables would).
5. Repeated full windows are merged to word ranges per document, and the kept
   words are written out.

Defined results: null, empty and blank texts have no words; a document of fewer
than 35 words keeps all; two rows with the same id and text are two documents,
whose windows repeat; a text of any length is read whole; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

FULL = 35
#: Window lengths of the levels; the last is the full length.
LEVELS = (9, 18, FULL)
#: A group of copies is heavy if it holds one in so many rows: there are no more of them than that.
HEAVY = 4096
_KEY = "k_id bigint, k_text bigint"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def least_of_runs(values: np.ndarray, run: int) -> np.ndarray:
    """Place of the least value in every ``run`` consecutive ones (the first of equals)."""
    n = len(values) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = values, np.arange(len(values)), 1
    while width < run:
        step = min(width, run - width)
        a, b = best[: len(best) - step], best[step:]
        right = b < a
        best, at, width = np.where(right, b, a), np.where(right, at[step:], at[: len(at) - step]), width + step
    return at


def chosen(h: np.ndarray, size: int, starts: np.ndarray | None = None, full: int = FULL) -> tuple[np.ndarray, np.ndarray]:
    """(windows of ``size``, place of the one that stands for each full window).

    ``h`` are the word hashes of one document, ``starts`` the full windows that
    are candidates (None: all).
    """
    parts = kernels.window_hashes(h, size)
    at = least_of_runs(kernels.mix(parts), full - size + 1)
    return parts, at if starts is None else at[starts]


def whole_hash(h: np.ndarray) -> np.uint64:
    """One number for a sequence of word hashes."""
    return np.bitwise_xor.reduce(kernels.mix(h + kernels.mix(np.arange(len(h), dtype=np.uint64)))) if len(h) else np.uint64(0)


def _words(column: pa.Array):
    w = kernels.words(*kernels.column_bytes(column), twice=True)
    return w, w.first.tolist()


def _first_level(size: int, full: int):
    """Documents to (key, n_words, two whole hashes, hashes, checks and places of the windows that stand for full ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                w, first = _words(part.column("text"))
                whole, again, hashes, checks, places = [], [], [], [], []
                for a, b in zip(first, first[1:]):
                    h = w.hash[a:b]
                    whole.append(whole_hash(h))
                    again.append(whole_hash(w.again[a:b]))
                    parts, at = chosen(h, size, None, full)
                    at = np.unique(at)
                    hashes.append(parts[at])
                    checks.append(_checks(w.again[a:b], at, size, full))
                    places.append(at)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k_id"),
                        part.column("k_text"),
                        pa.array(np.diff(w.first)),
                        pa.array(np.array(whole, np.uint64).view(np.int64)),
                        pa.array(np.array(again, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes).view(np.int64))),
                        _check_lists(checks, ends, size, full),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places).astype(np.int32))),
                    ],
                    ["k_id", "k_text", "n_words", "whole", "again", "hashes", "checks", "places"],
                )

    return run


def _checks(again: np.ndarray, at: np.ndarray, size: int, full: int) -> np.ndarray:
    """Hashes of full windows over the second hashes of their words; short ones need none."""
    return kernels.window_hashes(again, full)[at] if size == full and len(at) else np.zeros(0, np.uint64)


def _check_lists(checks: list[np.ndarray], ends: np.ndarray, size: int, full: int) -> pa.Array:
    if size == full:
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(checks).view(np.int64)))
    return pa.nulls(len(ends) - 1, pa.list_(pa.int64()))


def _flat(runs: np.ndarray) -> np.ndarray:
    """[first, last, first, last ...] to all numbers in those ranges."""
    return kernels.ranges(runs[0::2], runs[1::2] - runs[0::2] + 1)


def to_ranges(numbers: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers to [first, last, first, last ...]."""
    if not len(numbers):
        return numbers
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return np.stack([numbers[np.concatenate([[0], cut + 1])], numbers[np.concatenate([cut, [len(numbers) - 1]])]], 1).reshape(-1)


def _next_level(before: int, size: int, full: int):
    """(key, weight, text, survivors, starts) to a row per candidate window of ``size``.

    ``starts``: ranges of full windows that were candidates (null: all);
    ``survivors``: places of repeated windows of the level before.  A full window
    stays a candidate if the window that stood for it is a survivor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                w, first = _words(part.column("text"))
                survivors, ranges, ids = [part.column(c) for c in ("survivors", "starts", "weight")]
                hashes, checks, places, spans = [], [], [], []
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    h = w.hash[a:b]
                    starts = np.arange(len(h) - full + 1) if not ranges[i].is_valid else _flat(np.array(ranges[i].as_py(), np.int64))
                    _, at = chosen(h, before, starts, full)
                    starts = starts[np.isin(at, np.array(survivors[i].as_py(), np.int64))]
                    parts, at = chosen(h, size, starts, full)
                    at = np.unique(at)
                    hashes.append(parts[at])
                    checks.append(_checks(w.again[a:b], at, size, full))
                    places.append(at)
                    spans.append(to_ranges(starts).astype(np.int32))
                take = pa.array(np.arange(len(spans)))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in places])]).astype(np.int32)
                runs = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("k_id").take(take),
                        part.column("k_text").take(take),
                        ids.take(take),
                        pa.ListArray.from_arrays(pa.array(runs), pa.array(np.concatenate(spans).astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes).view(np.int64))),
                        _check_lists(checks, ends, size, full),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places).astype(np.int32))),
                    ],
                    ["k_id", "k_text", "weight", "starts", "hashes", "checks", "places"],
                )

    return run


def _cut(full: int):
    """(doc_id, text, n_words, survivors) to the result; survivors: starts of repeated full windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, off = kernels.column_bytes(part.column("text"))
                start, end = kernels.word_spans(data, off)
                first = np.searchsorted(start, off).tolist()
                n_removed, texts = [], []
                raw = data.tobytes()
                found, all_gone = part.column("survivors"), part.column("all_gone").to_pylist()
                for i, (a, b) in enumerate(zip(first, first[1:])):
                    gone = np.zeros(b - a + 1, np.int64)
                    if all_gone[i]:
                        gone[0] = 1
                    elif found[i].is_valid:
                        at = np.array(found[i].as_py(), np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + full, -1)
                    keep = np.cumsum(gone[:-1]) == 0
                    n_removed.append(int((~keep).sum()))
                    k = a + np.flatnonzero(keep)
                    texts.append(b" ".join([raw[s:e] for s, e in zip(start[k].tolist(), end[k].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first).astype(np.int64)),
                        pa.array(n_removed, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                        pa.array([x.decode() for x in texts], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def _repeated(rows: DataFrame, exact: bool) -> DataFrame:
    """Rows (key, weight, hashes, checks, places) to (key, survivors), stored: places of windows that repeat, in both hashes if ``exact``.

    A hash whose windows all have one check stands for it, so checks are only
    counted with the hashes and not joined; windows whose hash has several checks,
    if there are any, are counted anew by both.
    """
    lists = ["hashes", "checks", "places"] if exact else ["hashes", "places"]
    each = rows.select("k_id", "k_text", "weight", F.explode(F.arrays_zip(*lists)).alias("w"))
    each = each.select("k_id", "k_text", "weight", F.col("w.hashes").alias("h"), *([F.col("w.checks").alias("check")] if exact else []), F.col("w.places").alias("at"))
    one = (F.min("check") == F.max("check")) if exact else F.lit(True)
    # Stored, so that the join reads two plain exchanges, whose large partitions adaptive execution splits.
    again = common.stored(each.groupBy("h").agg(F.sum("weight").alias("n"), one.alias("one")).where("n > 1").select("h", "one"), "again")
    met = each.drop("check").join(again.where("one").select("h"), "h").select("k_id", "k_text", "at")
    if exact and again.where("not one").limit(1).count():
        apart = each.join(again.where("not one").select("h"), "h")
        both = apart.groupBy("h", "check").agg(F.sum("weight").alias("n")).where("n > 1").select("h", "check")
        met = met.unionByName(apart.join(both, ["h", "check"]).select("k_id", "k_text", "at"))
    alive = common.stored(met.groupBy("k_id", "k_text").agg(F.collect_list("at").alias("survivors")), "alive")
    common.discard(again)
    return alive


def _copies(rows: DataFrame, full: int) -> DataFrame:
    """(key, stands), stored: documents with a whole copy, and whether a row stands for its group.

    Groups are counted map-side first.  Heavy ones, ``HEAVY`` at most by their
    definition, are broadcast to the rows; the others take an ordinary join.
    """
    key = ["whole", "again", "n_words"]
    long = rows.where(F.col("n_words") >= full).select("k_id", "k_text", *key)
    counted = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k_id", "k_text")).alias("one")).where("n > 1")
    groups = common.stored(counted, "groups")
    least = max(64, -(-rows.count() // HEAVY))
    heavy, light = groups.where(F.col("n") >= least), groups.where(F.col("n") < least)
    marks = F.broadcast(heavy)
    met = long.join(marks, key).unionByName(long.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key))
    copies = common.stored(met.select("k_id", "k_text", F.struct("k_id", "k_text").eqNullSafe(F.col("one")).alias("stands")).distinct(), "copies")
    common.discard(groups)
    return copies


def repeated_windows(docs: DataFrame, *, full: int = FULL, levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(key, all_gone: whole copies) and (key, survivors: starts of repeated full windows)."""
    spark = docs.sparkSession
    keyed = docs.select(*common.row_key(), F.coalesce("text", F.lit("")).alias("text"))
    lists = "hashes array<bigint>, checks array<bigint>, places array<int>"
    rows = common.stored(keyed.mapInArrow(_first_level(levels[0], full), f"{_KEY}, n_words bigint, whole bigint, again bigint, {lists}"), "level")
    # Copies: one stands in for all, with weight two.
    copies = _copies(rows, full)
    joined = rows.join(copies, ["k_id", "k_text"], "left").where("stands is null or stands")
    joined = joined.withColumn("weight", F.when(F.col("stands"), 2).otherwise(1))
    level = joined.select("k_id", "k_text", "weight", "hashes", "checks", "places", F.lit(None).cast("array<int>").alias("starts"))
    for size, longer in zip(levels, (*levels[1:], None)):
        alive = _repeated(level, size == full)
        common.release(spark)
        if longer is None or not alive.limit(1).count():
            break
        info = alive.join(level.select("k_id", "k_text", "weight", "starts").distinct(), ["k_id", "k_text"])
        with_text = keyed.join(info, ["k_id", "k_text"])
        level = common.stored(with_text.mapInArrow(_next_level(size, longer, full), f"{_KEY}, weight int, starts array<int>, {lists}"), "level")
        common.discard(rows, alive)  # what this level was made of
        rows = level
        common.release(spark)
    return copies.select("k_id", "k_text").distinct().withColumn("all_gone", F.lit(True)), alive


def remove_repeats(docs: DataFrame, *, full: int = FULL, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text for every row."""
    copies, alive = repeated_windows(docs, full=full, levels=levels)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *common.row_key())
    marks = alive.join(copies, ["k_id", "k_text"], "full").select("k_id", "k_text", "survivors", F.coalesce("all_gone", F.lit(False)).alias("all_gone"))
    marked = keyed.join(marks, ["k_id", "k_text"], "left").select("doc_id", "text", "survivors", F.coalesce("all_gone", F.lit(False)).alias("all_gone"))
    return marked.mapInArrow(_cut(full), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return remove_repeats(docs).drop("kept_text")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT p.doc_id, p.i, md5(array_to_string(d.w[p.i:p.i + 34], ' ')) AS h FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, i FROM h JOIN (SELECT h FROM h GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r),
a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(d.w) AS n_words, len(coalesce(a.gone, [])) AS n_removed,
         list_filter(d.w, lambda x, i: NOT list_contains(coalesce(a.gone, []), i)) AS kept
  FROM d LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
