"""The functions that a person, a command line or a tool server calls: build, info, search, transcript, evaluate, convert.

Each takes a session and paths that Spark reads; results are small and plain
(dicts, lists, text), rendered from a few recordings.  Tables stay tables in
``operators`` and ``plans``.
"""

from __future__ import annotations

import importlib
import json
import os
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import pictures, pixels, redact
from .operators import document, manifest, recording
from .plans import evalqa, views
from .sources import documents, seams, sinks, stores

GUIDE = "GUIDE.md"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A table of frames; FileNotFoundError without one, ValueError if it cannot be read as one."""
    try:
        frames = spark.read.parquet(path)
    except Exception as e:  # what the reader says, as the errors a caller knows
        kind = getattr(e, "getCondition", lambda: "")() or ""
        if "PATH_NOT_FOUND" in kind:
            raise FileNotFoundError(path) from e
        raise ValueError(f"cannot read frames from {path}") from e
    missing = {"rec", "pos", "t"} - set(frames.columns)
    if missing:
        raise ValueError(f"{path} is no table of frames: {', '.join(sorted(missing))} missing")
    return frames


def _recordings(frames: DataFrame) -> DataFrame:
    return frames.groupBy("rec").agg(F.col("rec").cast("string").alias("video"), F.max("t").alias("duration"))


def _folder() -> Column:
    """Folder of a recording's files."""
    return F.translate("video", "/\\", "__")


def _picture_files(shown: DataFrame, width: int, options: recording.Options) -> DataFrame:
    """(name, content) of keyframes (video, keyframe, thumbnail, gray) and their thumbnails."""
    ending, quality = options.keyframe_format.lower().lstrip("."), options.keyframe_quality
    shown = shown.where("gray is not null")
    small_width, rows = F.lit(options.thumb_width), F.greatest(F.lit(1), F.floor(F.size("gray") / width * options.thumb_width / width).cast("int"))
    small = shown.withColumn("small", pixels.shrunk(F.col("gray"), F.lit(width), small_width, rows))
    return shown.select(F.concat_ws("/", _folder(), "keyframe").alias("name"), pictures.encoded(F.col("gray"), F.lit(width), ending, quality).alias("content")).unionByName(
        small.select(F.concat_ws("/", _folder(), "thumbnail").alias("name"), pictures.encoded(F.col("small"), small_width, ending, quality).alias("content"))
    )


def _size(frames: DataFrame, width: int, height: int) -> tuple[int, int]:
    """Width and height of the pictures of a table: those given, else those of a frame."""
    if not width and {"width", "height"} <= set(frames.columns) and (size := frames.select("width", "height").where("width is not null").first()):
        return size[0], size[1]
    return width, height


def build_index(spark: SparkSession, frames_path: str, out: str, options: recording.Options = recording.Options(), cursor: DataFrame | None = None, narration: DataFrame | None = None, width: int = 0, height: int = 0) -> dict:
    """Build the index of all recordings in a table of frames and write its files; their path, summaries and hints.

    A recording has a folder with ``index.json`` and, if frames have pictures,
    every keyframe and thumbnail that it names; all appear together.  Frames may
    have ``note`` (what a reader had to say of them) and ``failed`` (not decoded:
    the recording ends there), which become warnings.  Without a cursor,
    interactions are sought in the pictures; narration is masked with the text.
    """
    frames, notes = read_frames(spark, frames_path), None
    if "note" in frames.columns:
        notes = frames.select("rec", "pos", "note")
    if "failed" in frames.columns:
        frames, stops = recording.until_failure(frames)
        notes = stops if notes is None else notes.unionByName(stops)
    width, height = _size(frames, width, height)
    recordings = _recordings(frames)
    seen = Observation("states")
    states = recording.build(frames, options, cursor, width, height, with_gray=True)
    states = stores.stored(states.observe(seen, F.count(F.lit(1)).alias("states"), F.count_if(F.size("lines") > 0).alias("with_text")), "states")
    if options.redact and narration is not None:
        narration = narration.withColumn("text", redact.masked(F.col("text")))
    docs = document.documents(states, recordings, narration, options.fps, recording.warnings(notes) if notes is not None else None)
    files = documents.index_json(docs).select(F.concat(_folder(), F.lit("/index.json")).alias("name"), F.col("value").cast("binary").alias("content"))
    if "gray" in states.columns:
        files = files.unionByName(_picture_files(states.join(recordings.select("rec", "video"), "rec"), width, options))
    sinks.write_files(files, out)
    lasts = recordings.select("video", recording.slow_warning(F.col("duration"), options.fps, options.fast, options.max_frames).alias("hint"))
    hints = [f"{r['video']}: {r['hint']}" for r in lasts.where("hint is not null").collect()]
    summaries = info(spark, out)
    for s in summaries:
        if not s["ocr_lines"]:
            hints.append(f"{s['video']}: no text on any screen; segment by motion instead")
        elif s["states"] == 1 and s["duration_s"] > 3:
            hints.append(f"{s['video']}: one state only; try a lower text threshold or more frames a second")
        if s["warnings"]:
            hints.append(f"{s['video']}: {s['warnings']} warning(s)")
    return {"index_path": out, "summary": summaries, "hints": hints, "counts": seen.get}


def analyze(spark: SparkSession, frames_path: str, out: str, fps: float = 5.0, cols: int = 120, sensitivity: float = manifest.SENSITIVITY, cut_threshold: float = manifest.CUT, max_frames: int | None = None, edge: bool = False, width: int = 0, height: int = 0) -> dict:
    """Score the frames of all recordings against the ones before; write manifests, and each frame as PNG and as characters."""
    recording.positive("fps", fps)
    recording.positive("cols", cols, int)
    recording.bounded("sensitivity", sensitivity, 0.0, 1.0)
    recording.bounded("cut threshold", cut_threshold, 0.0, 1.0)
    frames = read_frames(spark, frames_path)
    if max_frames is not None:
        frames = frames.where(F.col("pos") < recording.positive("max frames", max_frames, int))
    recordings = _recordings(frames)
    found = manifest.manifests(frames, recordings, fps, cols, sensitivity, cut_threshold)
    files = documents.manifest_json(found).select(F.concat(_folder(), F.lit("/manifest.json")).alias("name"), F.col("value").cast("binary").alias("content"))
    width, height = _size(frames, width, height)
    if not width:
        raise ValueError("frames need a width and a height to be shown")
    shown = frames.where("gray is not null").join(recordings.select("rec", "video"), "rec")
    name = F.concat(_folder(), F.lit("/frames/"), F.lpad(F.col("pos").cast("string"), 5, "0"))
    shown = shown.select(name.alias("name"), F.col("gray").cast("array<int>").alias("gray"))
    marks = pixels.with_ascii(shown, width, height, cols, edge).select(F.concat("name", F.lit(".txt")).alias("name"), F.col("ascii").cast("binary").alias("content"))
    plain = shown.select(F.concat("name", F.lit(".png")).alias("name"), pictures.encoded(F.col("gray"), F.lit(width), "png").alias("content"))
    sinks.write_files(files.unionByName(marks).unionByName(plain), out)
    counts = documents.read_manifest(spark, f"{out}/*/manifest.json").select("video", F.size("frames").alias("frames"), F.size("events").alias("events"))
    return {"manifest_path": out, "recordings": [r.asDict() for r in counts.orderBy("video").collect()]}


def capture(spark: SparkSession, out: str, grab: str, seconds: float, fps: float = 10.0) -> dict:
    """Record a device into a table of frames; ``grab`` names a function, module:function, of the frame's number."""
    module, _, function = grab.partition(":")
    if not function:
        raise ValueError("a device is named module:function")
    try:
        device = getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError) as e:
        raise RuntimeError(f"no such device: {grab}") from e
    return {"frames_path": out, "frames": seams.recorded(spark, device, seconds, fps, out)}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Index documents of a file, of a folder that ``build_index`` wrote, or of one from ``documents.write_index``."""
    if path.endswith(".json"):
        return documents.read_index(spark, path)
    try:
        return documents.read_index(spark, f"{path}/*/index.json")
    except AnalysisException:
        return documents.read_index(spark, f"{path}/*")


def info(spark: SparkSession, path: str) -> list[dict]:
    return [r.asDict() for r in document.summarize(load(spark, path)).orderBy("video").collect()]


def search(spark: SparkSession, path: str, pattern: str | None = None, since: float | None = None, until: float | None = None, event_type: str | None = None) -> list[dict]:
    found = document.search(load(spark, path), pattern, since, until, event_type)
    return [r.asDict() for r in found.orderBy("video", "idx").collect()]


def transcript(spark: SparkSession, path: str, fmt: str = "md") -> dict[str, str]:
    """Text by recording."""
    return {r["video"]: r["doc"] for r in views.render(load(spark, path), fmt).collect()}


def evaluate(spark: SparkSession, qa_path: str, index_path: str, view: str = "compact", answerer: str = "mock", fps: float = 2.0, frames: int = 8, per_image: int = evalqa.TOKENS_PER_IMAGE) -> dict:
    """Both arms on a set of questions: report, clips without an index, who answered."""
    qa, docs, who = documents.read_qa(spark, qa_path), load(spark, index_path), evalqa.get_answerer(answerer)
    rows = evalqa.answered(qa, docs, views.render_view(docs, view), who, fps, frames, per_image)
    left = [r.asDict() for r in evalqa.skipped(qa, docs).orderBy("clip").collect()]
    return {"table": evalqa.table_lines(evalqa.two_arms(rows)), "skipped": left, "answerer": who.name}


def cost(spark: SparkSession, index_path: str, fps: float = 2.0, escalate: int = 3, per_image: int = evalqa.TOKENS_PER_IMAGE) -> list[dict]:
    return [r.asDict() for r in evalqa.cost_estimate(load(spark, index_path), fps, escalate, per_image).orderBy("video").collect()]


def convert(spark: SparkSession, rows_path: str, out: str, domain: str = "desktop", limit: int | None = None) -> dict:
    """Question rows to items for ``evaluate``; counts of emitted and skipped ones."""
    rows = evalqa.convert(documents.read_rows(spark, rows_path).withColumn("place", F.monotonically_increasing_id()), domain)
    documents.write_qa(evalqa.converted(rows, limit), out)
    return evalqa.convert_stats(rows, limit).first().asDict()


TOOLS = (build_index, info, search, transcript)


def server(spark: SparkSession):
    """A tool server over standard input and output; RuntimeError without the package for it."""
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as e:
        raise RuntimeError("a tool server needs the package 'mcp'") from e
    made = FastMCP("uistrata")

    @made.tool()
    def build_index_tool(frames: str, out: str, fps: float = 2.0, fast: bool = False, events: bool = False, keyframe_budget: int | None = None) -> dict:
        """Build an index from a table of frames."""
        return build_index(spark, frames, out, recording.Options(fps=fps, fast=fast, events=events, keyframe_budget=keyframe_budget))

    @made.tool()
    def info_tool(index_path: str) -> list[dict]:
        """Summaries of an index."""
        return info(spark, index_path)

    @made.tool()
    def search_tool(index_path: str, pattern: str | None = None, since: float | None = None, until: float | None = None, event_type: str | None = None) -> list[dict]:
        """States by text, time window and event."""
        return search(spark, index_path, pattern, since, until, event_type)

    @made.tool()
    def transcript_tool(index_path: str, fmt: str = "md") -> dict[str, str]:
        """An index as md, json, srt or vtt."""
        return transcript(spark, index_path, fmt)

    return made


def guide_text() -> str:
    with open(os.path.join(os.path.dirname(__file__), GUIDE), encoding="utf-8") as f:
        return f.read()


def install_guide(folder: str) -> str:
    """Write the guide for agents into a folder; the path of the file."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, GUIDE)
    with open(path, "w", encoding="utf-8") as f:
        f.write(guide_text())
    return path


def guide_status(folder: str) -> str:
    """missing, current or stale."""
    path = os.path.join(folder, GUIDE)
    if not os.path.exists(path):
        return "missing"
    with open(path, encoding="utf-8") as f:
        return "current" if f.read() == guide_text() else "stale"


def shown(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


def with_defaults(options: recording.Options, **given) -> recording.Options:
    """``options`` with the values that are not None."""
    return replace(options, **{k: v for k, v in given.items() if v is not None})
