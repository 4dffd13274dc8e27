"""Index documents: one row per recording with its states and narration as arrays.

Everything here is a projection of that row, without an exchange: summaries,
searches, compact views and transcripts read one recording's arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import index

SCHEMA_VERSION = 2
_EVENT = "struct<type:string,t:double,region:array<int>,confidence:double,label:string,field:string,value:string>"


def documents(states: DataFrame, recordings: DataFrame, narration: DataFrame | None = None, fps: float = 2.0, warned: DataFrame | None = None) -> DataFrame:
    """(rec, schema_version, video, duration, sampled_fps, states, narration, warnings).

    ``recordings``: rec, video, duration.  ``narration``: rec, n, start, end, text.
    ``warned``: rec, warnings.
    A document lasts as long as its recording, or to its last state if that is later.
    """
    one = F.struct(
        "pos",
        "idx",
        "t_start",
        "t_end",
        "thumbnail",
        "keyframe",
        F.col("lines").alias("ocr_text"),
        F.col("added").alias("text_added"),
        F.col("removed").alias("text_removed"),
        "boxes",
        F.when(F.col("interaction").isNotNull(), F.array("interaction")).otherwise(F.array().cast("array<struct<t:double,x:int,y:int,label:string>>")).alias("interactions"),
        F.col("event").cast(_EVENT).alias("event"),
        "salience",
    )
    grouped = states.groupBy("rec").agg(F.sort_array(F.collect_list(one)).alias("s"), F.max("t_end").alias("last"))
    out = grouped.join(recordings.select("rec", "video", "duration"), "rec")
    spoken = F.array().cast("array<struct<start:double,end:double,text:string>>")
    if narration is not None:
        told = narration.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("n", "start", "end", "text"))).alias("told"))
        out = out.join(told, "rec", "left")
        spoken = F.coalesce(F.transform("told", lambda n: F.struct(n["start"].alias("start"), n["end"].alias("end"), n["text"].alias("text"))), spoken)
    told_of = F.array().cast("array<string>")
    if warned is not None:
        out = out.join(warned.select("rec", F.col("warnings").alias("warned")), "rec", "left")
        told_of = F.coalesce("warned", told_of)
    return out.select(
        "rec",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "video",
        F.round(F.greatest("duration", "last"), 3).alias("duration"),
        F.lit(float(fps)).alias("sampled_fps"),
        F.transform("s", lambda s: s.dropFields("pos")).alias("states"),
        spoken.alias("narration"),
        told_of.alias("warnings"),
    )


def persistent(states: Column) -> Column:
    """Distinct lines that every state has, in code-point order; none for fewer than two states."""
    rest = F.slice(states, 2, F.greatest(F.size(states) - 1, F.lit(0)))
    shared = F.aggregate(rest, F.array_distinct(F.get(states, 0)["ocr_text"]), lambda a, s: F.array_intersect(a, s["ocr_text"]))
    return F.when(F.size(states) > 1, F.array_sort(shared)).otherwise(F.array().cast("array<string>"))


def event_counts(states: Column) -> Column:
    """Map of event type to number of states, types in order."""
    types = F.filter(F.transform(states, lambda s: s["event"]["type"]), lambda t: t.isNotNull())
    keys = F.array_sort(F.array_distinct(types))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(types, lambda t: t == k))))


def summarize(docs: DataFrame) -> DataFrame:
    """The ten fields of a summary, a row per document."""
    rows = docs.withColumnsRenamed({"states": "each", "narration": "told", "warnings": "warned"})  # fields have names of columns
    return rows.select(
        "video",
        F.round("duration", 2).alias("duration_s"),
        "sampled_fps",
        F.size("each").alias("states"),
        F.aggregate("each", F.lit(0), lambda n, s: n + F.size(s["ocr_text"])).alias("ocr_lines"),
        event_counts(F.col("each")).alias("events"),
        F.size("told").alias("narration_segments"),
        F.size("warned").alias("warnings"),
        F.size(persistent(F.col("each"))).alias("persistent_ui_lines"),
        F.exists("each", lambda s: F.coalesce(s["salience"], F.lit(0.0)) != 0).alias("has_curated_keyframes"),
    )


def search(docs: DataFrame, pattern: str | None = None, since: float | None = None, until: float | None = None, event_type: str | None = None) -> DataFrame:
    """(video, idx, t_start, t_end, event, matches) of the states that meet every filter given."""
    rows = docs.select("video", F.explode("states").alias("s")).select(F.col("video").alias("rec"), "s.idx", "s.t_start", "s.t_end", "s.event", F.col("s.ocr_text").alias("lines"))
    return index.search_index(rows, pattern, since, until, event_type).withColumnsRenamed({"rec": "video", "event_type": "event"})


def curated_keyframes(states: Column, budget: int) -> Column:
    """Up to ``budget`` of {idx, t_start, keyframe, salience}, greedily by salience and distance to those chosen, in order."""
    chosen = index.greedy(F.transform(states, lambda s: s["salience"]), budget)
    pick = lambda i: F.get(states, i)
    return F.transform(F.array_sort(chosen), lambda i: F.struct(pick(i)["idx"].alias("idx"), pick(i)["t_start"].alias("t_start"), pick(i)["keyframe"].alias("keyframe"), pick(i)["salience"].alias("salience")))


def compact(docs: DataFrame, *, drop_diffs: bool = True, factor_persistent: bool = True, drop_boxes: bool = True, drop_interactions: bool = True, keyframe_budget: int | None = None) -> DataFrame:
    """(video, view): a struct for JSON without what can be told from the rest.

    Lines that all states share stand once, in ``persistent_ui``, where there are any; order and duplicates of the others stay.
    """
    no_event = F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("type", "string"), ("t", "double"), ("region", "array<int>"), ("confidence", "double"), ("label", "string"), ("field", "string"), ("value", "string"))])
    shared = persistent(F.col("states")) if factor_persistent else F.array().cast("array<string>")

    def shown(s: Column, common: Column) -> Column:
        own = F.filter(s["ocr_text"], lambda x: ~F.array_contains(common, x))
        parts = [s[c].alias(c) for c in ("idx", "t_start", "t_end", "thumbnail", "keyframe")] + [own.alias("ocr_text")]
        parts += [] if drop_diffs else [s["text_added"].alias("text_added"), s["text_removed"].alias("text_removed")]
        parts += [] if drop_boxes else [s["boxes"].alias("boxes")]
        parts += [] if drop_interactions else [s["interactions"].alias("interactions")]
        return F.struct(*parts, F.coalesce(s["event"], no_event).alias("event"), s["salience"].alias("salience"))

    rows = docs.withColumn("shared", shared)
    # Held in an array of one: a column that is read in one place would be put there, and made again for every line of every state.
    states = F.get(F.transform(F.array("shared"), lambda common: F.transform("states", lambda s: shown(s, common))), 0)
    fields = ["schema_version", "video", "duration", "sampled_fps", states.alias("states"), "narration", "warnings", F.when(F.size("shared") > 0, F.col("shared")).alias("persistent_ui")]
    if keyframe_budget:
        fields.append(curated_keyframes(F.col("states"), keyframe_budget).alias("curated_keyframes"))
    return rows.select("video", F.struct(*fields).alias("view"))


def compact_json(docs: DataFrame, **options) -> DataFrame:
    """(video, doc): the compact view as JSON text, an event that is missing as {}."""
    return compact(docs, **options).select("video", F.to_json("view").alias("doc"))
