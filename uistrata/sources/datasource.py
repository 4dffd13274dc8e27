"""Index documents as a data source: ``spark.read.format("uiindex").load(path)``, ``df.write.format("uiindex").mode("append").save(path)``.

Reading: a partition for each run of files of about ``SLICE`` bytes; a document of
a newer version, without a required key or with a narration key that is not known
fails with its file's name, absent optional keys are filled in.  Writing: a folder
for each recording, put in place when all tasks have succeeded, as in ``sinks``.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .documents import INDEX, SCHEMA_VERSION
from .sinks import STAGING, FilesWriter, filesystem

#: Bytes of documents that a task reads, about.
SLICE = 32 << 20
REQUIRED = ("video", "duration", "sampled_fps", "states")
REQUIRED_OF_STATES = ("idx", "t_start", "t_end", "thumbnail", "keyframe")
#: What an optional key of a state is where it is absent.
FILLED = {"ocr_text": [], "text_added": [], "text_removed": [], "boxes": [], "interactions": [], "salience": 0.0}
_NARRATION = {"start", "end", "text"}


class BadIndex(ValueError):
    """A document that is none of an index."""


def checked(doc: dict, name: str) -> dict:
    """The fields of a document in the order of the schema; ``BadIndex`` says what is wrong with it."""

    def need(there: dict, keys: tuple[str, ...], what: str) -> None:
        if missing := [k for k in keys if there.get(k) is None]:
            raise BadIndex(f"{name}: {what} lacks {', '.join(missing)}")

    version = doc.get("schema_version") or 1
    if version > SCHEMA_VERSION:
        raise BadIndex(f"{name}: unsupported schema version {version}")
    need(doc, REQUIRED, "the document")
    states = []
    for i, s in enumerate(doc["states"]):
        need(s, REQUIRED_OF_STATES, f"state {i}")
        event = s.get("event") or None
        states.append({k: s.get(k) for k in REQUIRED_OF_STATES} | {k: v if s.get(k) is None else s[k] for k, v in FILLED.items()} | {"event": event})
    narration = doc.get("narration") or []
    for n in narration:
        if odd := set(n) - _NARRATION:
            raise BadIndex(f"{name}: narration has unknown keys {', '.join(sorted(odd))}")
    return {"schema_version": version, **{k: doc[k] for k in ("video", "duration", "sampled_fps")}, "states": states, "narration": narration, "warnings": doc.get("warnings") or []}


def index_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the documents at a path: itself, or every ``index.json`` below it that is not being written."""
    store, root = filesystem(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    every = store.get_file_info(fs.FileSelector(root, recursive=True))
    found = [(f.path, f.size) for f in every if f.type == fs.FileType.File and posixpath.basename(f.path) == "index.json"]
    return sorted((p, n) for p, n in found if STAGING not in p[len(root) :])


class Slice(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class IndexReader(DataSourceReader):
    def __init__(self, path: str, schema: pa.Schema):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Slice]:
        parts, size = [[]], 0
        for p, n in index_files(self.path):
            if parts[-1] and size + n > SLICE:
                parts.append([])
                size = 0
            parts[-1].append(p)
            size += n
        return [Slice(p) for p in parts]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        for p in partition.paths:
            with store.open_input_stream(p) as f:
                raw = f.read()
            try:
                doc = json.loads(raw)
            except ValueError as e:
                raise BadIndex(f"{p}: no JSON document") from e
            if not isinstance(doc, dict):
                raise BadIndex(f"{p}: no JSON document")
            yield pa.RecordBatch.from_pylist([checked(doc, p)], self.schema)


def document_text(row: dict) -> bytes:
    """A document as ``index_json`` writes it: indented, ASCII, absent keys left out, a missing event as {}."""
    plain = lambda x: {k: plain(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x
    states = [plain(s) | {"event": plain(s.get("event") or {})} for s in row["states"]]
    return json.dumps(plain(row) | {"states": states}, indent=2).encode()


class IndexWriter(FilesWriter):
    def write(self, batches: Iterator[pa.RecordBatch]):
        def files() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):  # one document at a time: a batch may have thousands
                    row = batch.slice(i, 1).to_pylist()[0]
                    name = row["video"].replace("/", "_").replace("\\", "_")
                    yield pa.RecordBatch.from_pydict({"name": [f"{name}/index.json"], "content": [document_text(row)]}, pa.schema([("name", pa.string()), ("content", pa.binary())]))

        return super().write(files())


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "uiindex"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> IndexReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return IndexReader(self.options["path"], to_arrow_schema(schema))

    def writer(self, schema: StructType, overwrite: bool) -> IndexWriter:
        if overwrite:
            raise ValueError("documents of an index are appended; empty the folder first")
        return IndexWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(IndexSource)
