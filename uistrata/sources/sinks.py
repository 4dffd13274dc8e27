"""Files of an index as a data source: each row (name, content) becomes a file, and all of them appear at the end or none does.

``df.write.format("uifiles").mode("append").save(path)``: tasks write below a
folder of their own in ``path``; when all have succeeded, the driver moves the
files to their names, and a task that failed, ran twice or was lost leaves no
file that a reader sees: its folder is hidden by its name, and goes with the job's.  Paths are those of any file system that pyarrow knows (a plain path,
file:, hdfs:, s3:), so no folder needs to be mounted.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

STAGING = "_staging-"
#: Folders or files that the driver moves at a time, and those that wait for it.
MOVERS, MOVED = 16, 10_000
#: File systems that move a folder as one.
RENAMES = ("local", "hdfs")


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    local = re.sub("^file:(//)?(?=/)", "", path)
    if "://" in local:
        return fs.FileSystem.from_uri(quote(local, safe="/:@?=&%"))
    return fs.LocalFileSystem(), posixpath.abspath(local)


def checked_name(name: str) -> str:
    """A relative name that stays below its folder; ValueError for any other."""
    parts = name.split("/")
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts) or parts[0].startswith(STAGING):
        raise ValueError(f"no name for a file of an index: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its folder, and the first parts of the names in it."""

    folder: str
    tops: list[str]


def _below(store: fs.FileSystem, folder: str) -> Iterator[str]:
    """Names of the files below a folder, one subfolder after the other."""
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.type == fs.FileType.Directory:
            yield from (f"{info.base_name}/{name}" for name in _below(store, info.path))
        else:
            yield info.base_name


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        folder, names, made = f"{self.staging}/{uuid.uuid4().hex}", set(), None
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                target = f"{root}/{folder}/{checked_name(name)}"
                if name in names:
                    raise ValueError(f"two files of one name: {name}")
                names.add(name)
                if posixpath.dirname(target) != made:
                    made = posixpath.dirname(target)
                    store.create_dir(made, recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
        return Written(folder, sorted({name.partition("/")[0] for name in names}))

    def commit(self, messages: list[Written | None]) -> None:
        """Whole folders are moved where one task wrote them and none is there, so the driver holds their names, not those of all files."""
        store, root = filesystem(self.path)
        wrote: dict[str, list[str]] = {}
        for m in messages:
            for top in m.tops if m else []:
                wrote.setdefault(top, []).append(f"{root}/{m.folder}")
        for top, folders in wrote.items():
            if len(folders) > 1:
                self._refuse_twice(store, top, folders, messages)
        if wrote:
            store.create_dir(root, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            tops = iter(wrote.items())
            while some := list(islice(tops, MOVED)):
                list(pool.map(lambda one: self._move(store, root, *one), some))
        self._clear(store, root)

    def _refuse_twice(self, store: fs.FileSystem, top: str, folders: list[str], messages: list[Written | None]) -> None:
        """Nothing is moved if two tasks wrote a file of one name, or one a file where another wrote a folder."""
        seen: set[str] = set()
        infos = [store.get_file_info(f"{folder}/{top}") for folder in folders]
        for info in infos:
            for name in [top] if info.type == fs.FileType.File else (f"{top}/{x}" for x in _below(store, info.path)):
                if name in seen:
                    self.abort(messages)
                    raise ValueError(f"two files of one name: {name}")
                seen.add(name)

    def _move(self, store: fs.FileSystem, root: str, top: str, folders: list[str]) -> None:
        """A folder at once if its file system can, and it is new and of one task; else file by file."""
        for folder in folders:
            source, target = f"{folder}/{top}", f"{root}/{top}"
            if store.get_file_info(source).type == fs.FileType.File:
                store.move(source, target)
            elif len(folders) == 1 and store.type_name in RENAMES and store.get_file_info(target).type == fs.FileType.NotFound:
                store.move(source, target)
            else:
                made = None
                for name in _below(store, source):
                    if posixpath.dirname(name) != made:
                        made = posixpath.dirname(name)
                        store.create_dir(posixpath.join(target, made), recursive=True)
                    store.move(f"{source}/{name}", f"{target}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class Files(DataSource):
    """The sink for spark.write.format("uifiles")."""

    @classmethod
    def name(cls) -> str:
        return "uifiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("files of an index are appended; empty the folder first")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write (name, content) below ``path``, all or none."""
    files.sparkSession.dataSource.register(Files)
    files.select("name", "content").write.format("uifiles").mode("append").save(path)


def read_below(spark: SparkSession, path: str, pattern: str, of_file: Callable[[str, bytes], tuple | None], schema: str, keep: int = 256) -> DataFrame:
    """A row ``of_file(path, content)`` of each file at any depth below ``path`` whose name has the pattern; none where it is None.

    The driver lists the names in ``path`` itself; tasks list what lies below each
    and read it, so no list of all files is ever made.  Hidden files and folders
    are passed over, as Spark's own readers do.
    """
    store, root = filesystem(path)
    shown = lambda name: name[0] not in "_."
    base = path.rstrip("/") if "://" in path else f"file://{root}"
    tops = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(root)) if shown(i.base_name)]
    slices = max(1, min(len(tops), max(4 * spark.sparkContext.defaultParallelism, len(tops) // 4096)))
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def files(store: fs.FileSystem, info: fs.FileInfo) -> Iterator[str]:
        if info.type == fs.FileType.File:
            if fnmatchcase(info.base_name, pattern):
                yield info.path
        elif info.type == fs.FileType.Directory:
            for x in store.get_file_info(fs.FileSelector(info.path)):
                if shown(x.base_name):
                    yield from files(store, x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystem(path)
        rows = []
        for batch in batches:
            for top in batch.column(0).to_pylist():
                for found in files(store, store.get_file_info(f"{root}/{top}")):
                    with store.open_input_stream(found) as f:
                        row = of_file(base + found[len(root) :], f.read())
                    rows += [] if row is None else [row]
                    if len(rows) == keep:
                        yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*rows))), kinds)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, zip(*rows))), kinds)

    return spark.createDataFrame(tops, "top string").repartition(slices).mapInArrow(read, schema)


def missing_files(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Those of ``names`` (name) that are no files below ``path``."""
    _, root = filesystem(path)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    from pyspark.sql import functions as F

    return names.join(there.select(F.substring_index("path", f"{root}/", -1).alias("name")), "name", "left_anti")
