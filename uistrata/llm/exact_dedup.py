"""Exact duplicates: a heavy-hitter split.

1. Every row is reduced to (id, digest, length) and stored; texts never move.
2. Misra-Gries counters, one bounded summary per task, merged by a sum, name
   the digests that may be frequent.
3. Their exact counts and winners are aggregated (a row per digest and task is
   shuffled at most) and the verified winners, ``heavy`` at most, broadcast:
   rows of frequent digests are decided map-side.
4. All other digests take an ordinary shuffled aggregate and join.

Defined results: null text counts as empty; an empty text is a text like any
other; a null id sorts after all others; of rows that tie in length and id one
stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Counters of a Misra-Gries summary, so also the most digests ever broadcast.
HEAVY = 1024
BLANKS = " \t\n\x0b\x0c\r"


def misra_gries(counters: dict, values: list, counts: list, k: int) -> dict:
    """Merge counted values into a summary of ``k`` counters (mergeable-summaries form)."""
    for v, n in zip(values, counts):
        counters[v] = counters.get(v, 0) + n
    if len(counters) > k:
        cut = int(np.partition(np.fromiter(counters.values(), np.int64, len(counters)), -(k + 1))[-(k + 1)])
        counters = {v: n - cut for v, n in counters.items() if n > cut}
    return counters


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            counters = misra_gries(counters, seen.field(0).to_pylist(), seen.field(1).to_pylist(), k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.binary()), pa.array(list(counters.values()), pa.int64())], ["digest", "n"])

    return run


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_code, row): one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("digest"),
        F.length(text).alias("n_code"),
        F.monotonically_increasing_id().alias("row"),
    )


def winners(rows: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays."""
    first = F.min(F.struct((-F.col("n_code")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first.alias("w")).select("digest", "group_size", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = common.stored(digests(docs, id_col, text_col), "digests")
    named = rows.select("digest").mapInArrow(_summaries(heavy), "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    frequent = named.orderBy(F.desc("n"), "digest").limit(heavy).select("digest")
    verified = winners(rows.join(F.broadcast(frequent), "digest")).where("group_size > 1")
    top = common.stored(verified, "heavy-digests")  # read twice; at most `heavy` rows
    decided = rows.join(F.broadcast(top), "digest")
    light = rows.join(F.broadcast(top.select("digest")), "digest", "left_anti")
    ordinary = light.join(winners(light), "digest")
    both = decided.unionByName(ordinary)
    return both.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame, *, heavy: int = HEAVY) -> DataFrame:
    """``docs`` without exact copies: the rows that stay, all columns.

    Rows of one id and one normalised text are one document: the longest text
    stays, of texts that tie in length the one of the largest hash, and of rows
    whose other columns alone differ the last by those columns as JSON.  Null
    texts count as empty and a null id as an id; columns of any type and name are
    kept; long texts move once; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(common.quoted(c)) for c in docs.columns if c != "text"]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    own = docs.select(
        F.coalesce("doc_id", F.lit(common.NO_ID)).alias("id"),
        F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("sha"),
        F.struct(F.length(text).alias("n"), F.xxhash64(text).alias("h"), rest.alias("rest")).alias("rank"),
        common.packed(docs).alias("doc"),
    )
    # Copies of one row meet map-side first; grouped and joined by the same key, so the texts move once.
    best = own.groupBy("id", "sha").agg(F.max_by("doc", "rank").alias("doc"))
    kept = exact_groups(docs, heavy=heavy).where("kept").select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    return common.unpacked(best.join(kept, ["id", "sha"], "left_semi"), "doc", docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id AS kept, d.text_sha256
FROM d JOIN w USING (text_sha256)
"""
