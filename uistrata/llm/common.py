"""Session, table and small-plan helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of Long.MIN_VALUE: stands for a null document id where a join needs a value.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in a local session that names none."""
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='uistrata-')}"
        context.setCheckpointDir(known)
        known = context.getCheckpointDir()
    return known


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later plan reads."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_stored_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are out of reach."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, so that no name of theirs meets one of ours."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns])


def unpacked(df: DataFrame, struct: str, columns: list[str]) -> DataFrame:
    return df.select([F.col(f"{struct}.{quoted(c)}").alias(c) for c in columns])


def carried(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc, text, *more): the columns of ``docs`` but the text as one struct, which Arrow functions pass on whole."""
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others, F.lit(0).alias(fresh("none", docs.columns))).alias("doc"), "text", *more)


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``carried`` documents as they were."""
    return df.select([F.col("text") if c == "text" else F.col(f"doc.{quoted(c)}").alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Key of a document that is the same in every scan: its id and a hash of its text."""
    return [F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("k_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k_text")]
