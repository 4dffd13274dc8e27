"""The pipeline's stages: columns, order and what they keep."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from uistrata.llm import exact_dedup, language_id, minhash, source_mix

SMALL = "/root/testdata/sf0.001/documents.parquet"
#: Names that the stages use for columns of their own.
INNER = "id sha rank doc k_id k_text s shard place words turn a b size source2 last label order digest row h letters known run key _id _n _keep _shard _a _b _sha task before".split()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, before = docs.columns, docs
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(out.count())
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        if name == "exact_dedup":
            assert counts[-1] == exact_dedup.exact_groups(before).where("kept").count()
        if name == "near_dedup":
            assert counts[-1] == minhash.near_duplicates(before).where("kept").count()
        before = out
    assert counts[0] >= 198 and counts[0] > counts[1] >= counts[2]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == counts[-1]


def test_empty(spark):
    none = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every column name of the stages, a map and awkward rows: nulls, blanks, a long text, ties, repeats."""
    docs = spark.read.parquet(SMALL)
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").limit(30).collect() if r["text"]) * 8
    rows = docs.limit(60).collect()
    a, b = (r for r in rows if r["lang"] == "en" and 500 < r["n_chars"] < 4000 and r["text"].strip()).__next__, None
    first = a()
    near = first["text"].replace(first["text"].split()[20], "otherword", 1)
    extra = [(900001, None, "en", "s", 0), (900002, "", None, None, 0), (900003, " \t\n ", "en", "s", 4), (900004, long, "en", "s", len(long))]
    extra += [(900005, first["text"], "en", "s", 1), (900005, first["text"], "en", "t", 1), (900005, near, "en", "s", 1), (900006, first["text"] + " ", "en", None, 1), (None, first["text"], "en", "s", 1), (None, None, None, None, None)]
    df = docs.limit(60).unionByName(spark.createDataFrame(extra, docs.schema))
    df = df.unionByName(df.limit(5))  # repeated rows
    taken = {c.lower() for c in df.columns}
    names = [n for n in INNER if n not in taken]
    return df.select("*", F.create_map(F.lit("k"), F.col("doc_id")).alias("map"), F.array(F.struct(F.lit(1).alias("x"))).alias("with.dot"), *[F.lit(f"own {n}").alias(n) for n in names]).cache()


def plain(row):
    return tuple((tuple(sorted(v.items())) if isinstance(v, dict) else tuple(map(tuple, v)) if isinstance(v, list) else v) for v in row)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_columns_and_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, "")
    rows, before = out.collect(), Counter(plain(r) for r in odd.collect())
    if name == "packing":
        assert len(rows) >= odd.count()
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    ids = Counter(r["doc_id"] for r in rows)
    if name == "source_mix":
        words = re.compile(r"[^\x20\x09-\x0D]+")
        taken, own = Counter(), {r["doc_id"]: r["taken"] for r in source_mix.mix_report(odd).collect()}
        for r in rows:
            assert r["map"] == {"k": r["doc_id"]} and r["shard"] == "own shard" and r["n_chars"] == len(r["text"])
            taken[r["doc_id"]] += len(words.findall(r["text"]))
        report = Counter()
        for r in source_mix.mix_report(odd).collect():
            report[r["doc_id"]] += r["taken"]
        assert +taken == +report and len(own) == len({r["doc_id"] for r in odd.collect()})
        return
    # The other stages let rows go and change none.
    assert not Counter(plain(r) for r in rows) - before
    if name == "language_id":
        assert not {900001, 900002, 900003} & set(ids) and 900004 in ids
    if name == "exact_dedup":
        assert len({(r["doc_id"], exact_dedup_text(r["text"])) for r in rows}) == len(rows) == len({exact_dedup_text(r["text"]) for r in odd.collect()})
    if name == "near_dedup":
        assert len({(r["doc_id"], r["text"] or "") for r in rows}) == len(rows)
        kept = minhash.near_duplicates(odd).where("kept and n_shingles > 0").select("component_id").distinct().count()
        assert len([r for r in rows if (r["text"] or "").split()]) == kept
        assert {900001, 900002, 900003, None} <= set(ids) and ids[900005] == 0


def exact_dedup_text(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(SMALL)
    more = spark.createDataFrame([(800001, "中文文本没有标签。" * 40, None, "s", 1), (800002, "12 34 !!", "en", "s", 1)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), "").collect()}
    assert not {800001, 800002} & kept and len(kept) >= 0.99 * docs.count()
    net = language_id.fit(docs, ~language_id.held_out())
    scores = {r["doc_id"]: r["score"] for r in language_id.identify(docs, net).collect()}
    assert all(scores[i] >= language_id.LEAST_SCORE - 0.2 for i in kept)
