"""Structured Streaming forms: windows, sessions, dedupe, late rows; ``segments`` has the states of recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import shared_dir


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; time stamps as instants, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame) -> DataFrame:
    out = events.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Gap-delimited runs of a user; the same expression runs on a stream."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), "n")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (user, type) once for as long as its state lives.

    A pair's state goes when the watermark, ``late`` behind the latest row, has
    passed it by ``late``; a pair that comes again afterwards is new, and rows
    behind the watermark are dropped.  Within one batch a pair is told once.
    """
    return events.withWatermark("ts", late).select("user_id", "event_type", "ts").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there now and read its result.

    Each batch is written once, under its number, as Parquet, so a repeated batch
    replaces itself and nothing passes through the driver.  A complete result
    replaces the batches before it.
    """
    spark = stream.sparkSession
    folder = f"{shared_dir(spark)}/stream_{uuid.uuid4().hex}"
    path = f"{folder}/rows"
    empty = spark.createDataFrame([], stream.schema)
    empty.write.parquet(f"{path}/batch=-1")

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={n}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).select(*stream.columns)


def progress(query) -> list[dict]:
    """What a stream reports of its batches: rows in and out, state kept and rows dropped as late."""
    out = []
    for p in query.recentProgress:
        state = p["stateOperators"]
        out.append({"batch": p["batchId"], "rows_in": p["numInputRows"], "state_rows": sum(s["numRowsTotal"] for s in state), "late_rows": sum(s["numRowsDroppedByWatermark"] for s in state)})
    return out


def split_late(events: DataFrame, seen_until) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows of a batch against an instant that a watermark has reached: late ones go to a side output."""
    late = F.col("ts") < F.lit(seen_until)
    return events.where(~late), events.where(late)
