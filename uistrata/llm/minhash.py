"""Near duplicates: circulant MinHash, banding, exact Jaccard on full sets.

Signature.  ``sigma`` and ``pi`` are two permutations of 32-bit numbers.
Coordinate k of a set is the minimum of ``pi(sigma(x) + k)`` over its shingles:
one permutation, circularly shifted, stands for all of them (C-MinHash).

Plan.  Documents with the same shingle set form a class and one row stands for
it.  Classes meet in buckets of banded signatures.  In a bucket every member is
compared with one leader only, never all pairs: the member that has the most
company over all its buckets, the centre of a family of copies.  Verified links
go through connected components.  Members of buckets whose components still
differ then go through an exact prefix index: of two sets that are alike enough,
the smaller has one of its rarest seventh of shingles among the larger's rarest
quarter.  Families that share one long passage but are not alike have their own
words there, so they do not meet again, however many they are.  Pairs are ruled
out early by size and by a 128-bit sketch (a bit of each coordinate; a pair at
the threshold fails it about once in a million).  All links are confirmed on
whole sets.

Odd sketch.  A third sketch is a row of ``ODD`` bits of which every shingle flips
one.  Where two of them differ, so many shingles at least are in one set only, so
more than a seventh of both sizes rules a pair out without a loss.  It tells
families just under the threshold, whose texts share all their frequent shingles,
from links before any set is read; texts of some thousands of words fill it, and
for those the bits of the coordinates decide alone.

Defined results: null and empty texts, and texts of blanks only, have an empty
set and link with nothing; a document of fewer than five words has one shingle,
its whole sequence; rows with the same id and text are copies; a null id sorts
last; a text of any length is one set; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels
from .components import components

WIDTH = 5
BANDS, ROWS = 32, 4
PERCENT = 75
#: Of 128 sketch bits: 16 differ on average at the threshold, standard deviation 3.7.
MOST_BITS = 34
#: Bits of the odd sketch, a multiple of 64.
ODD = 1024
ODD_COLS = [f"o{i}" for i in range(ODD // 64)]
_SIGN = "doc_id bigint, k_text bigint, n_shingles bigint, f1 bigint, f2 bigint, s1 bigint, s2 bigint, bands array<bigint>"
_ROW = ["cid", "m", "s1", "s2"]


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, and where each document begins."""
    w = kernels.words(*kernels.column_bytes(column), table=kernels.LOWER)
    runs = kernels.window_hashes(w.hash, width)
    sets, first = [], w.first.tolist()
    for lo, hi in zip(first, first[1:]):
        if hi - lo >= width:
            sets.append(np.unique(runs[lo : hi - width + 1]))
        elif hi > lo:
            sets.append(kernels.window_hashes(w.hash[lo:hi], hi - lo))
        else:
            sets.append(w.hash[:0])
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else w.hash[:0]), np.concatenate([[0], np.cumsum(size)])


def signatures(values: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands) and sketches (documents x 2) of non-empty sets."""
    sigma = (kernels.mix(values) >> np.uint64(32)).astype(np.uint32)
    heads = first[:-1]
    out = np.empty((len(heads), bands), np.uint64)
    sketch = np.zeros((len(heads), 2), np.uint64)
    for band in range(bands):
        key = np.full(len(heads), band + 1, np.uint64)
        for row in range(rows):
            low = np.minimum.reduceat(_pi(sigma + np.uint32(band * rows + row)), heads)
            low = low.astype(np.uint64)
            key = kernels.join(key, low)
            side, bit = divmod((band * rows + row) % 128, 64)
            sketch[:, side] ^= (low & np.uint64(1)) << np.uint64(bit)
        out[:, band] = key
    return out, sketch


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in kernels.slices(batch.column("text")):
            values, first = shingle_sets(batch.column("text").slice(lo, hi - lo))
            size = np.diff(first)
            some = np.flatnonzero(size)
            f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
            keys, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((len(size), 2), np.uint64)
            if len(some):
                heads = first[:-1][some]
                f1[some] = np.add.reduceat(kernels.mix(values), heads)
                f2[some] = np.add.reduceat(kernels.mix(values ^ np.uint64(0xABCDEF)), heads)
                keys, sketch[some] = signatures(values, np.append(heads, len(values)))
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), batch.column("k_text").slice(lo, hi - lo), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in sketch.T), bands],
                ["doc_id", "k_text", "n_shingles", "f1", "f2", "s1", "s2", "bands"],
            )


def odd_sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets x words) bits: each value of a set flips one.  Some sets at a time: a set takes a counter for each bit."""
    n = len(first) - 1
    out = np.zeros((n, ODD // 64), np.int64)
    for lo in range(0, n, 2048):
        part = first[lo : lo + 2049]
        row = np.repeat(np.arange(len(part) - 1), np.diff(part)) * ODD
        cell = row + (kernels.mix(values[part[0] : part[-1]] ^ np.uint64(0x5EED)) % np.uint64(ODD)).astype(np.int64)
        odd = (np.bincount(cell, minlength=(len(part) - 1) * ODD) & 1).astype(np.uint8)
        out[lo : lo + len(part) - 1] = np.packbits(odd.reshape(-1, ODD), axis=1, bitorder="little").view(np.int64)
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, f1, text) to (cid, shingles, odd sketch), where the set is the class's."""
    for batch in batches:
        for lo, hi in kernels.slices(batch.column("text"), 1 << 20):
            part = batch.slice(lo, hi - lo)
            values, first = shingle_sets(part.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
            size = np.diff(first)
            f1 = np.zeros(len(size), np.uint64)
            if (some := np.flatnonzero(size)).size:
                f1[some] = np.add.reduceat(kernels.mix(values), first[:-1][some])
            same = pa.array(f1.view(np.int64) == part.column("f1").to_numpy(zero_copy_only=False))
            bits = [pa.array(np.ascontiguousarray(x)) for x in odd_sketches(values, first).T]
            yield pa.RecordBatch.from_arrays([part.column("cid"), lists, *bits], ["cid", "shingles", *ODD_COLS]).filter(same)


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, k_text, n_shingles, component_id and ``label`` (of the component, null for an empty set) for every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_text"), "text")
    signed = common.stored(docs.mapInArrow(_sign, _SIGN), "signatures")
    key = ["n_shingles", "f1", "f2"]
    classes = signed.where("n_shingles > 0").groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), F.col("k_text").alias("rep_text"))).alias("r"), *[F.first(c).alias(c) for c in ("s1", "s2", "bands")])
    classes = common.stored(classes.select("*", "r.rep", "r.rep_text").drop("r").withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = classes.select(F.explode("bands").alias("key"), "cid", F.col("n_shingles").alias("m"), "s1", "s2")
    members = common.stored(_met(rows), "buckets")
    common.release(docs.sparkSession)
    labels = _linked(docs, classes, members)
    # Class labels to the smallest document id of their component.
    named = classes.select(*key, "cid", "rep").join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    final = named.join(least, "label").select(*[F.col(c).alias(f"c_{c}") for c in key], "component_id", "label")
    same = [signed[c] == final[f"c_{c}"] for c in key]
    out = signed.drop("bands", "s1", "s2").join(final, same, "left")
    return out.select("doc_id", "k_text", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    out = _grouped(docs)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _met(rows: DataFrame) -> DataFrame:
    """Rows (key, cid, m, s1, s2) of keys with company, and each cid's company over all its keys."""
    met = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    return met.join(met.groupBy("cid").agg(F.sum("n").alias("score")), "cid").select("key", *_ROW, "score")


def _linked(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(v, label) of the classes that have a link, stored."""
    spark = docs.sparkSession
    involved = members.select("cid").distinct().join(classes.select("cid", "rep", "rep_text", "f1"), "cid")
    # By id and text: rows of one id, null ones too, are as many as they are, not each with each.
    same = [F.coalesce("doc_id", F.lit(common.NO_ID)) == F.coalesce("rep", F.lit(common.NO_ID)), F.col("k_text") == F.col("rep_text")]
    texts = docs.join(involved, same)
    schema = f"cid bigint, shingles array<bigint>, {', '.join(f'{c} bigint' for c in ODD_COLS)}"
    sets = common.stored(texts.select("cid", "f1", "text").mapInArrow(_sets, schema).dropDuplicates(["cid"]), "sets")
    common.release(spark)
    return linked_sets(members, sets)


def linked_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(v, label), stored, of the classes that have a link; ``members`` (key, cid, m, s1, s2, score) and ``sets`` are spent.

    ``sets``: stored (cid, shingles, odd sketch).  Links between members of one key are found.
    """
    spark = sets.sparkSession
    none = spark.createDataFrame([], "v bigint, label bigint")
    placed = _placed(members, none)
    state = placed.groupBy("key").agg(F.max(F.struct("score", *_ROW)).alias("lead"))
    pairs = placed.join(state, "key").where((F.col("cid") != F.col("lead.cid")) & _likely("", "lead."))
    edges = _links(pairs.select("cid", F.col("lead.cid").alias("other")), sets)
    labels = components(edges) if edges.limit(1).count() else none
    placed = _placed(members, labels)
    state = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
    open_keys = state.where((F.col("lo") != F.col("hi")) & (F.col("n") > 2)).select("key")
    apart = common.stored(placed.join(open_keys, "key", "left_semi").select("comp", *_ROW).distinct(), "apart")
    common.release(spark)
    if apart.limit(1).count():
        pairs, prefixes = _prefix_pairs(apart, sets)
        more = _links(pairs, sets)
        common.discard(prefixes)
        if more.limit(1).count():
            first, labels = labels, components(edges.unionByName(more))
            common.discard(first)
        common.discard(more)
    common.discard(sets, members, edges, apart)
    return labels


def _prefix_pairs(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cid, other) of different components: every pair that is alike enough, and few others; and the stored table that they come from.

    Shingles are put in order of their frequency in these sets, rarest first.  Of
    m shingles the larger set shows m - ceil(3m/4) + 1 and the smaller one
    m - ceil(6m/7) + 1; alike sets have one of those in common.  Shingles of one
    set alone take their places and are then left out.
    """
    each = rows.join(sets.select("cid", "shingles"), "cid").select("cid", "m", "comp", F.explode("shingles").alias("key"))
    ranked = each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "key")
    ranked = ranked.groupBy("cid", "m", "comp").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("o"))
    m = F.col("m")
    probe, index = (m - F.ceil(m * 3 / 4) + 1).cast("int"), m - F.ceil(m * 6 / 7) + 1
    shown = ranked.select(F.posexplode(F.slice("o", 1, probe)).alias("at", "k"), "cid", "m", "comp", index.alias("short")).where("k.df > 1")
    shown = shown.select(F.col("k.key").alias("key"), (F.col("at") < F.col("short")).alias("short"), (F.col("m") - F.col("at")).alias("rest"), "cid", "comp")
    marks = rows.select(*_ROW).join(sets.select("cid", *ODD_COLS), "cid")
    shown = common.stored(shown.join(marks, "cid"), "prefixes")
    one = shown.where("short").select("key", F.struct("comp", "rest", *_ROW, *ODD_COLS).alias("a"))
    two = shown.select("key", F.struct("comp", "rest", *_ROW, *ODD_COLS).alias("b"))
    # Shingles from a shared one on: alike sets have 3/7 of both sizes in common, so each has as many left.
    room = 7 * F.least("a.rest", "b.rest") >= 3 * (F.col("a.m") + F.col("b.m"))
    smaller = F.struct("a.m", "a.cid") < F.struct("b.m", "b.cid")
    pairs = one.join(two, (one["key"] == two["key"]) & (F.col("a.comp") != F.col("b.comp")) & smaller & room & _likely("a.", "b.") & _apart("a.", "b."))
    return pairs.select(F.col("a.cid").alias("cid"), F.col("b.cid").alias("other")), shown


def _apart(a: str, b: str):
    """Whether the odd sketches leave room for a link: alike sets differ in a seventh of both sizes at most."""
    bits = sum(F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ODD_COLS)
    return 7 * bits <= F.col(f"{a}m") + F.col(f"{b}m")


def _likely(a: str, b: str):
    """Whether two rows (structs with m, s1, s2) can be alike enough."""
    m_a, m_b = F.col(f"{a}m"), F.col(f"{b}m")
    bits = sum(F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in ("s1", "s2"))
    return (100 * F.least(m_a, m_b) >= PERCENT * F.greatest(m_a, m_b)) & (bits <= MOST_BITS)


def _placed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (cid, other) that are links, each once, stored."""
    pairs = common.stored(pairs.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct(), "pairs")
    found = common.stored(_verified(pairs, sets), "links")
    common.discard(pairs)
    common.release(pairs.sparkSession)
    return found


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    one = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("set_b")), "b")
    two = one.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("set_a")), "a")
    na, nb = F.size("set_a"), F.size("set_b")
    two = two.where((100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return two.withColumn("both", both).where(100 * F.col("both") >= PERCENT * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def drop_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns.

    A document is an id with a text: of rows that agree in both one stays (the
    last by the other columns as JSON).  Of a group the smallest id stays, of its
    texts the one of the smallest hash; a null id comes last.  Null, empty and
    blank texts link with nothing, so each of their ids stays.  Columns of any
    type and name are kept, and an empty table gives an empty one.
    """
    rows = _grouped(docs).select(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(common.NO_ID)).alias("id"), "k_text", "label")
    first = rows.where("label is not null").groupBy("label").agg(F.min(F.struct("last", "id", "k_text")).alias("w")).select("w.id", "w.k_text")
    keep = first.unionByName(rows.where("label is null").select("id", "k_text").distinct())
    others = [F.col(common.quoted(c)) for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(common.NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("k_text"),
        (F.to_json(F.struct(*others)) if others else F.lit("")).alias("rank"),
        common.packed(docs).alias("doc"),
    )
    best = own.groupBy("id", "k_text").agg(F.max_by("doc", "rank").alias("doc"))
    return common.unpacked(best.join(keep, ["id", "k_text"], "left_semi"), "doc", docs.columns)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


#: Every pair of documents, so for small tables only.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d),
n AS (SELECT doc_id, len(g) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.both >= 75 * (x.n_shingles + y.n_shingles - p.both)),
m AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (
  SELECT doc_id AS v, doc_id AS c FROM n
  UNION
  SELECT m.b, r.c FROM r JOIN m ON m.a = r.v WHERE r.c < m.b)
SELECT n.doc_id, n.n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
