"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is an anchor (a common word of one of a few languages) and the next
``CHAIN`` content words after it; common words in between are passed over.  The
fingerprint of a text is the set of its signatures, as sorted 32-bit numbers in
hex; a text without any anchored chain takes a chain at every content word, and
one too short for that its words as a whole.

``likeness`` is the Jaccard index of two fingerprints, pruned by their lengths
where a threshold is asked for.  ``near_classes`` partitions fingerprints by set
length, so only partitions whose lengths allow the threshold meet, and within
them only the rarest signatures are looked up.

Edited texts need the next document.  Rows are dealt by ranges of doc_id whose
bounds are fixed beforehand; the first row of each range is sent to its
neighbour too, so every task has what it needs after one exchange of the texts.

Defined results: null text counts as empty; two empty fingerprints have likeness
1; a null doc_id comes last; rows of one doc_id are put in order by a hash of
their texts; a table of one row is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels, minhash

#: Common words that anchor chains.
ANCHORS = (
    "a an and are as at be by for from he in is it of on or that the this to was which with you "
    "der die das den dem des ein eine und ist im in mit von zu auf nicht sich es "
    "au de des du elle en est et il la le les mais ou par pas pour que qui sur un une "
    "al con de del el en es la las lo los no o para por que se su un una y"
).split()
CHAIN = 3
ROWS_PER_RANGE = 1000


def _anchor_hashes() -> np.ndarray:
    data = pa.array(sorted(set(ANCHORS)))
    return np.sort(kernels.words(*kernels.column_bytes(data)).hash)


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values




def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct signatures of all texts, where each text's begin)."""
    global _anchors
    if _anchors is None:
        _anchors = _anchor_hashes()
    w = kernels.words(*kernels.column_bytes(column), sep=_SEP, table=kernels.LOWER)
    n = len(w.count)
    doc = w.doc()
    anchor = _is_in(w.hash, _anchors)
    content = np.flatnonzero(~anchor)
    h = w.hash[content]
    chains = kernels.window_hashes(h, CHAIN)
    whole = doc[content][CHAIN - 1 :] == doc[content][: len(chains)] if len(chains) else np.zeros(0, bool)
    at = np.flatnonzero(anchor)
    after = np.searchsorted(content, at)
    fits = after < len(chains)
    at, after = at[fits], after[fits]
    good = whole[after] & (doc[content[after]] == doc[at]) if len(at) else np.zeros(0, bool)
    at, after = at[good], after[good]
    sigs, owner = kernels.join(w.hash[at], chains[after]), doc[at]
    # Texts without an anchored chain: every chain, else all their words as one.
    bare = np.bincount(owner, minlength=n) == 0
    own = np.flatnonzero(whole & bare[doc[content[: len(chains)]]]) if len(chains) else np.zeros(0, np.int64)
    sigs, owner = np.concatenate([sigs, chains[own]]), np.concatenate([owner, doc[content[own]]])
    bare = np.flatnonzero((np.bincount(owner, minlength=n) == 0) & (w.count > 0))
    last = [kernels.window_hashes(w.hash[a:b], int(b - a))[0] for a, b in zip(w.first[bare], w.first[bare + 1])]
    sigs, owner = np.concatenate([sigs, np.array(last, np.uint64)]), np.concatenate([owner, bare])
    packed = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (sigs >> np.uint64(32)))
    owner = (packed >> np.uint64(32)).astype(np.int64)
    return packed.astype(np.uint32), np.searchsorted(owner, np.arange(n + 1))


_anchors: np.ndarray | None = None
#: Words are runs of letters and digits, in either case.
_SEP = kernels.NOT_ALNUM.copy()
_SEP[0x41:0x5B] = False


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard index of two sorted sets; 0 if their lengths alone keep it under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _hex(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, str, str]]:
    """([doc_id], text, next text) of a range in order; rows with ``tail`` only serve as next."""
    held = None
    for batch in batches:
        for part, doc_id, tail, text in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("tail").to_pylist(), batch.column("text").to_pylist()):
            if held is not None:
                if held[0] == part:
                    yield held[1], held[2], text
                held = None
            if not tail:
                held = (part, doc_id, text)
    if held is not None:  # the only row of the table
        yield held[1], held[2], held[2]


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, nexts, size = [], [], [], 0

    def flush():
        edited = []
        for t, x in zip(texts, nexts):
            half = len(t) // 2
            edited.append(t[: len(t) - half] + x[:half])
        sets = []
        for column in (texts, edited, nexts):
            sigs, first = signatures(pa.array(column, pa.large_string()))
            sets.append([sigs[a:b] for a, b in zip(first, first[1:])])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([_hex(s) for s in sets[0]], pa.string()),
                pa.array([_hex(s) for s in sets[1]], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(sets[0], sets[1])], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(sets[0], sets[2])], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for doc_id, text, after in _pairs(batches):
        ids.append(doc_id)
        texts.append(text)
        nexts.append(after)
        size += len(text) + len(after)
        if size > 2 << 20:
            yield flush()
            ids, texts, nexts, size = [], [], [], 0
    if ids:
        yield flush()


def fingerprint_edits(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.coalesce("doc_id", F.lit(common.NO_ID)).alias("at"), F.xxhash64("text").alias("h"))
    total = rows.select("at").count()
    n = max(1, min(-(-total // rows_per_range), 100_000))
    size = -(-total // n)
    # Bounds of the ranges, from above; range i holds bounds[i - 1] >= at > bounds[i] (descending).
    cuts = set(rows.approxQuantile("at", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 and total else set()
    # An id with the rows of several ranges is a range of its own, cut further by the hash of the text; there are n such ids at most.
    hot = {r["at"]: -(-r["count"] // size) for r in rows.groupBy("at").count().where(F.col("count") > 2 * size).collect()} if n > 1 else {}
    cuts = sorted({*map(int, cuts), *hot, *(at - 1 for at in hot if at != common.NO_ID)}, reverse=True)
    if hot:
        known = F.broadcast(spark.createDataFrame(sorted(hot.items()), "at bigint, pieces bigint"))
        rows = rows.join(known, "at", "left")
        piece = F.coalesce(F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("pieces")), F.lit(0))
    else:
        piece = F.lit(0)
    rows = rows.withColumn("part", _range_of(cuts).cast("bigint") * (1 << 32) + piece).drop("pieces")
    first = F.max(F.struct("at", F.bitwise_not("h").alias("back"))).alias("first")
    firsts = {r["part"]: (r["first"]["at"], ~r["first"]["back"]) for r in rows.groupBy("part").agg(first).collect()}  # a row per range
    parts = sorted(firsts)
    if not parts:
        return rows.select("doc_id").mapInArrow(_edited, _RESULT)
    # Who else needs the first row of a range: the range before it; the very first one closes the ring.
    needed = [(*firsts[p], before) for p, before in zip(parts, [parts[-1], *parts[:-1]])]
    lookup = F.broadcast(spark.createDataFrame(needed, "at bigint, h bigint, before bigint"))
    tails = rows.join(lookup, ["at", "h"]).select(F.col("before").alias("part"), F.lit(1).alias("tail"), "at", "h", "doc_id", "text")
    own = rows.select("part", F.lit(0).alias("tail"), "at", "h", "doc_id", "text")
    # Ranges are dealt to tasks in turn, not by hash, so that tasks get as many each.
    n = common.partitions(spark)
    turn = F.pmod(F.shiftright("part", 32) + F.col("part").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(n)).cast("int")
    dealt = own.unionByName(tails).repartitionById(n, turn)
    ordered = dealt.sortWithinPartitions("part", "tail", F.desc("at"), "h")
    return ordered.select("part", "doc_id", F.col("tail").cast("boolean").alias("tail"), "text").mapInArrow(_edited, _RESULT)


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _range_of(cuts: list[int]):
    """Number of cuts >= at: a binary search over batches of ids."""
    table = np.sort(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def place(at):
        return pd.Series((len(table) - np.searchsorted(table, at.to_numpy(), side="left")).astype("int32"))

    return place(F.col("at"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, length, sigs): the signature set of every text."""

    def run(batches):
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text")):
                sigs, first = signatures(batch.column("text").slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sigs.astype(np.int64)))], ["doc_id", "length", "sigs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, length bigint, sigs array<bigint>")


def _with_odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sigs) with the odd sketch of each set."""
    for batch in batches:
        sigs = batch.column("sigs")
        first = sigs.offsets.to_numpy().astype(np.int64)
        values = sigs.values.to_numpy()[first[0] : first[-1]].astype(np.uint64) if len(first) else np.zeros(0, np.uint64)
        bits = minhash.odd_sketches(values, first - first[0])
        yield pa.RecordBatch.from_arrays([batch.column("cid"), sigs, *(pa.array(np.ascontiguousarray(x)) for x in bits.T)], ["cid", "shingles", *minhash.ODD_COLS])


def near_classes(prints: DataFrame, percent: int = minhash.PERCENT) -> DataFrame:
    """(doc_id, class_id) for rows of ``fingerprints``: the smallest doc_id that a chain of alike fingerprints reaches.

    Equal fingerprints are one class.  A class of length m lies in the partition
    floor(log m / log(100 / percent)) of lengths; alike sets lie in one partition
    or in neighbours, so each class is looked up in its own and the next.  There,
    signatures are ordered rarest first and each set shows its first
    m - ceil(percent m / 100) + 1: alike sets show one in common.  Sets that show
    a signature are compared with one leader, those still apart by the exact
    prefix index, pruned by length and sketch before sets are read, so a family
    of copies never makes all its pairs.  Empty fingerprints are classes of one.
    """
    if percent != minhash.PERCENT:
        raise ValueError(f"sketches are made for {minhash.PERCENT} percent")
    some = prints.where("length > 0")
    classes = common.stored(some.groupBy("length", "sigs").agg(F.min("doc_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    sets = common.stored(classes.select("cid", "sigs").mapInArrow(_with_odd, f"cid bigint, shingles array<bigint>, {', '.join(f'{c} bigint' for c in minhash.ODD_COLS)}"), "sets")
    each = classes.select("cid", F.col("length").alias("m"), F.explode("sigs").alias("sig"))
    ranked = each.join(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "sig")
    ranked = ranked.groupBy("cid", "m").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("o"))
    show = (F.col("m") - F.ceil(F.col("m") * percent / 100.0) + 1).cast("int")
    zone = F.floor(F.log(F.col("m").cast("double")) / F.log(F.lit(100.0 / percent)))
    shown = ranked.select("cid", "m", zone.alias("zone"), F.explode(F.slice("o", 1, show)).alias("k")).where("k.df > 1")
    rows = shown.select(F.explode(F.array("zone", F.col("zone") + 1)).alias("zone"), "cid", "m", "k.sig")
    rows = rows.select(F.xxhash64("zone", "sig").alias("key"), "cid", "m", F.lit(0).cast("bigint").alias("s1"), F.lit(0).cast("bigint").alias("s2"))
    labels = minhash.linked_sets(common.stored(minhash._met(rows), "buckets"), sets)
    named = classes.join(labels.withColumnRenamed("v", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    by_print = named.join(least, "label").select(F.col("length").alias("l"), F.col("sigs").alias("s"), "class_id")
    out = prints.join(by_print, (prints["length"] == by_print["l"]) & (prints["sigs"] == by_print["s"]), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.documents(spark, sf_dir))
