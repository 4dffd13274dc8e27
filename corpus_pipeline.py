"""Training-data pipeline: language ID, exact dedup, near dedup, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from uistrata.llm import common, exact_dedup, language_id, minhash, packing, source_mix


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, in an unknown script or without a language that outweighs all others go.

    Null and empty texts go; long texts are judged by all their windows; repeated
    rows are judged alike; an empty table, or one without labels, gives an empty
    one; other columns are kept, whatever their names and types.
    """
    return language_id.keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest, then the one of the smallest id.

    Null and empty texts are one group; of repeated rows one stays; a text of any
    length is one digest; an empty table gives an empty one; other columns are
    kept, whatever their names and types.
    """
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id.

    Null, empty and blank texts link with nothing and stay; rows of one id and
    text are one document; a text of any length is one set; an empty table gives
    an empty one; other columns are kept, whatever their names and types.
    """
    return minhash.drop_near(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Parts of documents, drawn to the target weights of their sources, shard after shard.

    Null and empty texts are not drawn; a null source is a source; long documents
    are cut into blocks; repeated rows are taken alike; an empty table gives an
    empty one; other columns go with each part, whatever their names and types.
    """
    return source_mix.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts are an end token; a long text is cut; repeated rows are
    documents; an empty table gives an empty one; other columns are not read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("packing", pack_stage),
]

#: SQL cannot express a trained classifier, a random mix or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
