"""Tables kept in the folder that all executors share: written once, read by what follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one, one a session, only in a local session that names none."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='uistrata-')}")
        known = context.getCheckpointDir()
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what it was made of is not computed again, nor lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of_files(spark: SparkSession, path: str) -> tuple:
    """(path, length, time of change) of the files below a path: another table there is another state."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


_kept: dict = {}


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """The table of ``make()``, stored once a session for a key; ``key`` says all that it depends on."""
    name = (spark.sparkContext.applicationId, *key)
    if name not in _kept:
        _kept[name] = stored(make(), "kept")
    return _kept[name]
