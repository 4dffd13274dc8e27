"""Index, manifest and question documents: read with fixed schemas, validated, written back."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

SCHEMA_VERSION = 2
_STATE = (
    "idx int, t_start double, t_end double, thumbnail string, keyframe string, ocr_text array<string>, text_added array<string>, text_removed array<string>, "
    "boxes array<struct<text:string,box:array<int>>>, interactions array<struct<t:double,x:int,y:int,label:string>>, "
    "event struct<type:string,t:double,region:array<int>,confidence:double,label:string,field:string,value:string>, salience double"
)
INDEX = f"schema_version int, video string, duration double, sampled_fps double, states array<struct<{', '.join(':'.join(x.split(' ', 1)) for x in _STATE.split(', '))}>>, narration array<struct<start:double,end:double,text:string>>, warnings array<string>"
MANIFEST = "video string, duration double, sampled_fps double, cols int, frames array<struct<idx:int,t:double,score:double,event:boolean,ascii:string,png:string>>, events array<struct<t_start:double,t_end:double,peak_frame:int,peak_score:double,type:string,confidence:double>>"
QA = "clip string, question string, choices array<string>, answer string, type string"


def _required(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        missing = F.raise_error(F.lit(f"required key {n!r} is missing"))
        df = df.withColumn(n, F.when(F.col(n).isNull(), missing.cast(df.schema[n].dataType)).otherwise(F.col(n)))
    return df


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Recordings of index documents; newer versions and missing keys raise, absent optional lists become empty."""
    raw = spark.read.schema(INDEX).option("multiLine", True).option("mode", "FAILFAST").json(path)
    version = F.coalesce("schema_version", F.lit(1))
    too_new = F.raise_error(F.concat(F.lit("unsupported schema version "), version.cast("string"))).cast("int")
    raw = raw.withColumn("schema_version", F.when(version > SCHEMA_VERSION, too_new).otherwise(version))
    raw = _required(raw, ["video", "duration", "sampled_fps", "states"])
    return raw.withColumns({c: F.coalesce(c, F.array().cast(raw.schema[c].dataType)) for c in ("narration", "warnings")})


def states_of(index: DataFrame) -> DataFrame:
    """A row per state, in order."""
    rows = index.select("video", F.posexplode("states").alias("pos", "s")).select("video", "pos", "s.*")
    rows = _required(rows, ["idx", "t_start", "t_end", "thumbnail", "keyframe"])
    lists = ("ocr_text", "text_added", "text_removed", "boxes", "interactions")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in lists})
    return rows.withColumn("salience", F.coalesce("salience", F.lit(0.0)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    raw = _required(raw, ["video", "duration", "sampled_fps", "cols"])
    filled = F.transform("events", lambda e: e.withField("type", F.coalesce(e["type"], F.lit("motion"))).withField("confidence", F.coalesce(e["confidence"], F.lit(0.0))))
    return raw.withColumn("events", filled)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """Question items, one JSON object a line; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", QA, {"mode": "FAILFAST"}).alias("q")).select("q.*")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Question rows of a JSON list, or of an object that wraps one under data, rows, train or test (the first there is)."""
    row = "array<struct<video_path:string,system:string,app:string,MCQA:string>>"
    whole = spark.read.text(path, wholetext=True)
    wrapped = [F.from_json(F.get_json_object("value", f"$.{k}"), row) for k in ("data", "rows", "train", "test")]
    found = F.when(F.ltrim("value").startswith("["), F.from_json("value", row)).otherwise(F.coalesce(*wrapped))
    found = F.when(found.isNull(), F.raise_error(F.lit("neither a list of rows nor an object that wraps one")).cast(row)).otherwise(found)
    each = whole.select(F.explode(found).alias("r")).select("r.*")
    one = "struct<Question:string,Options:string,`Correct Answer`:string>"
    asked = F.when(F.ltrim("MCQA").startswith("["), F.from_json("MCQA", f"array<{one}>")).otherwise(F.array(F.from_json("MCQA", one)))
    return each.select("video_path", "system", F.explode(asked).alias("q")).select("video_path", "system", F.col("q.Question").alias("question"), F.col("q.Options").alias("options"), F.col("q.`Correct Answer`").alias("answer"))


#: JSON as a person reads it, with ASCII characters only.
PRETTY = {"pretty": "true", "writeNonAsciiCharacterAsCodePoint": "true"}


def index_json(docs: DataFrame) -> DataFrame:
    """(video, value): index documents as JSON text; a missing event is an empty object."""
    no_event = F.struct(*[F.lit(None).cast(k).alias(n) for n, k in (("type", "string"), ("t", "double"), ("region", "array<int>"), ("confidence", "double"), ("label", "string"), ("field", "string"), ("value", "string"))])
    states = F.transform("states", lambda s: s.withField("event", F.coalesce(s["event"], no_event)))
    return docs.select("video", F.to_json(F.struct("schema_version", "video", "duration", "sampled_fps", states.alias("states"), "narration", "warnings"), PRETTY).alias("value"))


def manifest_json(manifests: DataFrame) -> DataFrame:
    """(video, value): manifests as JSON text."""
    return manifests.select("video", F.to_json(F.struct("video", "duration", "sampled_fps", "cols", "frames", "events"), PRETTY).alias("value"))


#: What a folder's name has as %XX, as in Spark's own partitioned writers.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def _folders(values: pa.Array) -> pa.Array:
    return pa.array([_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) if v else "__HIVE_DEFAULT_PARTITION__" for v in values.to_pylist()], pa.string())


def write_texts(texts: DataFrame, path: str, by: str = "video") -> None:
    """(by, value) to a text file for each, in a folder that bears its name; refuses a path that exists."""
    store, root = sinks.filesystem(path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    folder = F.concat(F.lit(f"{by}="), F.arrow_udf(_folders, "string")(F.col(by).cast("string")))
    name = F.concat(folder, F.lit("/part-"), F.uuid(), F.lit(".txt"))
    sinks.write_files(texts.select(name.alias("name"), F.concat(F.coalesce("value", F.lit("")), F.lit("\n")).cast("binary").alias("content")), path)


def _of_text(path: str, content: bytes) -> tuple:
    return path, content.decode("utf-8", "replace")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of the whole text files (``*.txt``) at any depth below a path, listed and read by tasks."""
    return sinks.read_below(spark, path, "*.txt", _of_text, "path string, value string")


def name_of(path: Column, by: str = "video") -> Column:
    """What ``write_texts`` wrote a file for, by the file's path."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(path, f"/{by}=([^/]*)/", 1), r"\+", "%2B"))


def write_index(docs: DataFrame, path: str) -> None:
    """A JSON file per index document; ``read_index(path + "/*")`` reads them back.  Parquet is the form to query."""
    write_texts(index_json(docs), path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    write_texts(manifest_json(manifests), path)


def write_transcripts(rendered: DataFrame, path: str) -> None:
    """(video, doc) of a view to a text file for each."""
    write_texts(rendered.withColumnRenamed("doc", "value"), path)


def write_ascii(frames: DataFrame, path: str) -> None:
    """(name, ascii) to a text file for each frame."""
    write_texts(frames.withColumnRenamed("ascii", "value"), path, "name")


def write_qa(items: DataFrame, path: str) -> None:
    """Question items as JSON, one a line, letters as they are."""
    items.select("clip", "question", "choices", "answer", "type").write.mode("errorifexists").json(path)


MARKER = ".uistrata-frames"
_OWN_FILE = re.compile(r"\d{5}(_thumb)?\.(png|jpe?g|txt)", re.IGNORECASE)


def clean_frames_dir(folder: str) -> None:
    """Make a local output folder of frames empty and mark it; refuse one that holds anything but frames of ours."""
    names = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    foreign = [n for n in names if n != MARKER and not (_OWN_FILE.fullmatch(n) and os.path.isfile(os.path.join(folder, n)))]
    if foreign:
        raise FileExistsError(f"{folder} holds files that are not frames: {', '.join(foreign[:3])}")
    for n in names:
        os.unlink(os.path.join(folder, n))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, MARKER), "w", encoding="utf-8") as f:
        f.write("frames of an index; emptied by the next build\n")


def thumbnail_size(width: int, height: int, thumb_width: int) -> tuple[int, int]:
    return thumb_width, max(1, int(height * thumb_width / width))
