"""Where models, codecs and devices plug in: each takes a factory, made once per worker, and gives a table.

None of them is built here: the engine starts at their output.  A failure in one
frame or recording gives an empty result and a note, never the end of a build.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pictures as files
from ..functions import pixels
from ..operators import recording
from . import sinks
from .documents import thumbnail_size

_engines: dict = {}


def engine_of(factory: Callable, *key):
    """The engine of a factory and its arguments, one per worker process."""
    name = (factory.__module__, factory.__qualname__, key)
    if name not in _engines:
        _engines[name] = factory(*key)
    return _engines[name]


def text_boxes(frames: DataFrame, factory: Callable, lang: str | None = None, threads: int = 2) -> DataFrame:
    """``frames`` (rec, pos, gray, width, height) with ``boxes`` in reading order and ``note``.

    ``factory(lang, threads)`` gives an engine that takes a gray picture (height x
    width) and returns [(corner points, text), ...].
    """
    found = "array<struct<points:array<array<double>>,text:string>>"

    @F.pandas_udf(f"found {found}, note string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        engine = engine_of(factory, lang, threads)
        for gray, width in batches:
            out = []
            for g, w in zip(gray, width):
                try:
                    out.append(([{"points": [list(map(float, p)) for p in points], "text": str(text)} for points, text in engine(np.asarray(g, np.uint8).reshape(-1, int(w)))], None))
                except Exception as e:  # noqa: BLE001 - one bad frame is noted, not fatal
                    out.append(([], f"text reading failed: {type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["found", "note"])

    rows = frames.withColumn("read", read("gray", "width"))
    boxes = F.transform("read.found", lambda b: F.struct(b["text"].alias("text"), recording.corners_to_box(b["points"]).alias("box")))
    return rows.withColumn("boxes", recording.reading_order(boxes, F.col("height"))).withColumn("note", F.col("read.note")).drop("read")


def texts(boxes) -> F.Column:
    """Texts of boxes, in their order."""
    return F.transform(boxes, lambda b: b["text"])


def speech(recordings: DataFrame, factory: Callable, model: str = "base") -> DataFrame:
    """(rec, n, start, end, text) of recordings (rec, path): ``factory(model)`` gives an engine that takes a path and yields (start, end, text)."""

    def hear(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = engine_of(factory, model)
        for part in batches:
            out = []
            for rec, path in zip(part["rec"], part["path"]):
                try:
                    said = [(rec, round(float(a), 3), round(float(b), 3), t.strip()) for a, b, t in engine(path) if t.strip()]
                except Exception:  # noqa: BLE001 - a recording without sound has no narration
                    said = []
                out += [(r, i, *rest) for i, (r, *rest) in enumerate(said)]
            yield pd.DataFrame(out, columns=["rec", "n", "start", "end", "text"])

    kind = recordings.schema["rec"].dataType.simpleString()
    return recordings.select("rec", "path").mapInPandas(hear, f"rec {kind}, n bigint, start double, end double, text string")


def captured(spark: SparkSession, grab: Callable[[int], np.ndarray], seconds: float, fps: float) -> DataFrame:
    """(pos, t, gray, width, height) of pictures that ``grab(n)`` takes on the driver's device: a short clip, held in memory."""
    recording.positive("seconds", seconds)
    recording.positive("fps", fps)
    rows = []
    for n in range(max(1, round(seconds * fps))):
        g = np.asarray(grab(n), np.uint8)
        rows.append((n, n / fps, g.reshape(-1).astype(int).tolist(), int(g.shape[1]), int(g.shape[0])))
    return spark.createDataFrame(rows, "pos bigint, t double, gray array<int>, width int, height int")


def recorded(spark: SparkSession, grab: Callable[[int], np.ndarray], seconds: float, fps: float, path: str, rec: str = "capture", at_once: int = 64) -> int:
    """Append what a device shows to a table of frames at ``path``, ``at_once`` pictures at a time; the number of frames."""
    recording.positive("seconds", seconds)
    total = max(1, round(seconds * recording.positive("fps", fps)))
    for start in range(0, total, at_once):
        part = captured(spark, lambda n, start=start: grab(start + n), min(at_once, total - start) / fps, fps)
        pos = (F.col("pos") + start).alias("pos")
        part.select(F.lit(rec).alias("rec"), pos, ((F.col("pos") + start) / fps).alias("t"), "gray", "width", "height").write.mode("append").parquet(path)
    return total


def _of_png(path: str, content: bytes) -> tuple | None:
    try:
        gray = files.unpng(content)
    except (ValueError, IndexError):
        return None
    return path, gray.reshape(-1), gray.shape[1], gray.shape[0]


def read_pictures(spark: SparkSession, path: str, below: str | None = None) -> DataFrame:
    """(path, gray, width, height) of picture files; undecodable ones are left out.

    ``below``: names (``*.png``) of files at any depth below ``path``.  PNG files
    are then listed and read by tasks, however many there are; the list of others,
    and what a pattern in ``path`` finds, is held by the driver.
    """
    if below and below.endswith(".png"):
        return sinks.read_below(spark, path, below, _of_png, "path string, gray array<int>, width int, height int")
    source = spark.read.format("image").option("dropInvalid", True)
    if below:
        source = source.option("recursiveFileLookup", True).option("pathGlobFilter", below)
    image = source.load(path).select("image.*")

    @F.pandas_udf("array<int>")
    def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, channels):
            x = np.frombuffer(raw, np.uint8).reshape(-1, int(n)).astype(np.float64)
            out.append((x[:, 0] if n == 1 else np.rint(x[:, :3] @ [0.114, 0.587, 0.299])).astype(np.int32))
        return pd.Series(out)

    return image.select(F.col("origin").alias("path"), gray("data", "nChannels").alias("gray"), "width", "height")


def thumbnails(pictures: DataFrame, width: int, height: int, thumb_width: int = 320) -> DataFrame:
    """(name, gray, width) of pictures of one size, shrunk by area to ``thumb_width``; names get _thumb before their ending."""
    w, h = thumbnail_size(width, height, thumb_width)
    name = F.regexp_replace("name", r"(\.[^.]*)$", "_thumb$1")
    return pictures.select(name.alias("name"), pixels.shrunk(F.col("gray"), F.lit(width), F.lit(w), F.lit(h)).alias("gray"), F.lit(w).alias("width"))


def write_keyframes(pictures: DataFrame, folder: str) -> int:
    """Write (name, gray, width) as PNG files into ``folder``, a path that all executors mount; the number written.

    A task that runs again writes the same files again.
    """
    import os

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, g, w in zip(part["name"], part["gray"], part["width"]):
                path = os.path.join(folder, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(files.png(np.asarray(g, np.uint8).reshape(-1, int(w))))
                os.replace(f"{path}.part", path)
            yield pd.DataFrame({"n": [len(part)]})

    return pictures.select("name", "gray", "width").mapInPandas(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
