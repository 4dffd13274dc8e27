"""Rendered views of index documents: one text per recording, from its arrays, without an exchange."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import document


#: The captions below.
def event_caption(e: Column) -> Column:
    """A line for an event; empty for an unknown or missing one."""
    q = lambda c: F.concat(F.lit("“"), c, F.lit("”"))
    typed = F.concat(F.lit("⌨ Typed "), q(F.coalesce(e["value"], F.lit("None"))))
    return (
        F.when(e["type"] == "click", F.when(e["label"].isNotNull(), F.concat(F.lit("👆 Clicked "), q(e["label"]))).otherwise("👆 Clicked"))
        .when(e["type"] == "type", F.when(e["field"].isNotNull(), F.concat(typed, F.lit(" into "), e["field"])).otherwise(typed))
        .when(e["type"] == "navigate", F.when(e["value"].isNotNull(), F.concat(F.lit("➡ Navigated to "), e["value"])).otherwise("➡ Navigated"))
        .when(e["type"] == "open_dialog", F.when(e["label"].isNotNull(), F.concat(F.lit("🪟 Opened dialog: "), e["label"])).otherwise("🪟 Opened dialog"))
        .when(e["type"] == "error", F.when(e["label"].isNotNull(), F.concat(F.lit("⚠ Error: "), e["label"])).otherwise("⚠ Error"))
        .when(e["type"] == "scroll", "↕ Scrolled")
        .when(e["type"] == "edit", "✏ Edited")
        .otherwise("")
    )


def _some(value: Column, shown: Column) -> Column:
    """``shown`` where there is something, else NULL, which concat_ws passes over."""
    return F.when(F.coalesce(value, F.lit("")) != "", shown)


def _numbered(block) -> Column:
    """``block(state, number)`` of every state, numbers from 1."""
    return F.transform("states", lambda s, i: block(s, i + 1))


def _heard(starts: pa.Array, ends: pa.Array, begun: pa.Array, ended: pa.Array) -> pa.Array:
    """Of each document, the places of the narration that each state overlaps (both ends open), in its order.

    Narration is sorted by its start.  What a state hears lies between the first
    whose end, or an end before it, is late enough and the last that begins in
    time: two searches a state and what lies between, not every pair.
    """
    t0, t1, n0, n1 = (_numbers(c) for c in (starts, ends, begun, ended))
    found, sizes = [], []
    for s0, s1, a, b in zip(t0, t1, n0, n1):
        b = np.where(np.isnan(b), -np.inf, b)
        order = np.argsort(a, kind="stable")
        lo, hi = np.searchsorted(np.maximum.accumulate(b[order]), s0, "right"), np.searchsorted(a[order], np.where(np.isnan(s1), -np.inf, s1), "left")
        many = np.maximum(hi - lo, 0)
        own = np.repeat(np.arange(len(s0)), many)
        at = order[np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        late = b[at] > s0[own]
        own, at = own[late], at[late]
        found.append(at[np.lexsort((at, own))])
        sizes.append(np.bincount(own, minlength=len(s0)))
    each = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, []]))]).astype(np.int32)
    docs = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(each), pa.array(np.concatenate([*found, []]).astype(np.int32)))
    return pa.ListArray.from_arrays(pa.array(docs), places)


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each row of a list column, NaN for NULL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(size)[:-1]) if len(size) else []


def with_heard(docs: DataFrame) -> DataFrame:
    """``docs`` with ``heard``: for each state the texts of the narration that overlaps it."""
    times = [F.col(c).cast("array<double>") for c in ("states.t_start", "states.t_end", "narration.start", "narration.end")]
    places = docs.withColumn("heard", F.arrow_udf(_heard, "array<array<int>>")(*times))
    return places.withColumn("heard", F.transform("heard", lambda p: F.array_join(F.transform(p, lambda i: F.get(F.col("narration"), i)["text"]), " ")))


def _touched(it: Column) -> Column:
    where = F.when(F.coalesce(it["label"], F.lit("")) != "", F.concat(F.lit(" near “"), it["label"], F.lit("”"))).otherwise("")
    return F.concat(F.lit("👆 interacted"), where, F.lit(" (≈"), it["x"].cast("string"), F.lit(","), it["y"].cast("string"), F.lit(")"))


def markdown(docs: DataFrame) -> DataFrame:
    """(video, doc): a heading for each state, then what it shows, what changed, what was done and said."""

    def block(s: Column, n: Column) -> Column:
        head = F.concat(F.lit("## "), text.clock(s["t_start"]), F.lit("–"), text.clock(s["t_end"]), F.lit("  ·  State "), n.cast("string"))
        caption, body, said = event_caption(s["event"]), F.array_join(s["ocr_text"], " · "), F.get(F.col("heard"), n - 1)
        added, removed = F.array_join(s["text_added"], ", "), F.array_join(s["text_removed"], ", ")
        touched = F.array_join(F.transform(s["interactions"], _touched), "\n")
        return F.concat_ws(
            "\n",
            head,
            _some(caption, caption),
            F.when(F.size(s["ocr_text"]) > 0, body),
            F.when(F.size(s["text_added"]) > 0, F.concat(F.lit("**Appeared:** "), added)),
            F.when(F.size(s["text_removed"]) > 0, F.concat(F.lit("**Gone:** "), removed)),
            _some(touched, touched),
            _some(said, F.concat(F.lit("🗣 said: "), said)),
            F.lit(""),
        )

    top = F.concat(F.lit("# Transcript — "), F.col("video"), F.lit("  ("), text.clock(F.col("duration")), F.lit(")\n\n"))
    whole = F.concat(top, F.array_join(_numbered(block), "\n"))
    return with_heard(docs).select("video", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("doc"))


def state_caption(s: Column) -> Column:
    caption, body = event_caption(s["event"]), F.array_join(s["ocr_text"], " · ")
    both = F.concat_ws(" — ", _some(caption, caption), _some(body, body))
    return F.when(both == "", F.concat(F.lit("State "), s["idx"].cast("string"))).otherwise(both)


def _cue(s: Column, sep: str) -> Column:
    return F.concat(text.timestamp(s["t_start"], sep), F.lit(" --> "), text.timestamp(s["t_end"], sep), F.lit("\n"), state_caption(s), F.lit("\n"))


def srt(docs: DataFrame) -> DataFrame:
    return docs.select("video", F.array_join(_numbered(lambda s, n: F.concat(n.cast("string"), F.lit("\n"), _cue(s, ","))), "\n").alias("doc"))


def webvtt(docs: DataFrame) -> DataFrame:
    whole = F.concat(F.lit("WEBVTT\n\n"), F.array_join(_numbered(lambda s, n: _cue(s, ".")), "\n"))
    return docs.select("video", F.concat(F.regexp_replace(whole, r"\s+$", ""), F.lit("\n")).alias("doc"))


FORMATTERS = {"md": markdown, "srt": srt, "vtt": webvtt, "json": document.compact_json}


def render(docs: DataFrame, fmt: str) -> DataFrame:
    """(video, doc) of index documents in one of the formats."""
    if fmt not in FORMATTERS:
        raise ValueError(f"unknown format {fmt!r}; one of {sorted(FORMATTERS)}")
    return FORMATTERS[fmt](docs)


def render_view(docs: DataFrame, view: str) -> DataFrame:
    """(video, doc) as an answerer reads it: ``transcript``, or the compact view as JSON."""
    return markdown(docs) if view == "transcript" else document.compact_json(docs)
