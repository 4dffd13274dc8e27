"""Target-distribution importance resampling over bucket-partitioned inverted postings.

1. Every document becomes postings: words and pairs of neighbouring words are
   hashed into ``BUCKETS`` buckets and counted.  The postings of a document that
   lie in one of ``RANGES`` ranges of buckets are one record: bucket numbers of two
   bytes and counts of one (a count above 255 is several postings).
2. Records are shuffled by range of buckets.  In front of the postings of a range
   stand its totals in both corpora, so each task computes the gains of its own
   buckets, streams its postings and emits one contribution a record.
3. Contributions are summed map-side, shuffled by document and reduced.

A record holds at most a range of buckets, so a bucket that all documents have
adds one posting to each record and no task grows with it; ranges are salted, so
tasks grow in number with the input.  Totals are sums per task, then per bucket.
Ranks come from a range sort and the counts of its partitions.

Defined results: null and blank texts, and texts without a word, have no features
and weight 0; a null id hashes as the empty one and ranks last among ties; repeated rows are
documents of their own, each counted and ranked; a text of any length is counted
whole, long ones in pieces; without targets every t is 0; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

BUCKETS, RANGES = 10_000, 16
WIDTH = -(-BUCKETS // RANGES)
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Words hashed at once.
CHUNK = 1 << 18
#: Bytes beyond which a word is hashed by itself.
LONG = 24
_RECORD = "uid bigint, doc_id bigint, n_words bigint, n_features bigint, r int, buckets binary, counts binary"


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span, carried on from ``before`` (CRC-32 of what stands in front)."""
    state = (np.zeros(len(start), np.uint32) if before is None else before) ^ _FULL
    size = end - start
    order = np.argsort(size, kind="stable")
    by_size = size[order]
    for at in range(int(min(by_size[-1], LONG)) if len(order) else 0):
        some = order[np.searchsorted(by_size, at, side="right") : np.searchsorted(by_size, LONG, side="right")]
        now = state[some]
        state[some] = _TABLE[(now ^ data[start[some] + at]) & np.uint32(255)] ^ (now >> np.uint32(8))
    state ^= _FULL
    for i in order[np.searchsorted(by_size, LONG, side="right") :]:
        state[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), 0 if before is None else int(before[i]))
    return state


def feature_buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of the pairs that begin at the words marked by ``pair``; ``data`` is in lower case."""
    one = crc32_spans(data, start, end)
    lead = np.flatnonzero(pair)
    state = one[lead] ^ _FULL
    spaced = (_TABLE[(state ^ np.uint32(32)) & np.uint32(255)] ^ (state >> np.uint32(8))) ^ _FULL
    two = crc32_spans(data, start[lead + 1], end[lead + 1], spaced)
    return (one % np.uint32(BUCKETS)).astype(np.int64), (two % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document; row, bucket and count of every posting, in that order)."""
    data, off = kernels.column_bytes(column)
    data = kernels.LOWER[data]
    start, end = kernels.word_spans(data, off, kernels.NOT_ALNUM)
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    pair = np.zeros(len(start), bool)
    pair[:-1] = row[1:] == row[:-1]
    keys, sums = [], []
    for lo in range(0, len(start), CHUNK):
        hi = min(lo + CHUNK, len(start))
        more = min(hi + 1, len(start))  # the second word of the last pair
        marks = pair[lo:more].copy()
        marks[hi - lo :] = False
        one, two = feature_buckets(data, start[lo:more], end[lo:more], marks)
        key = np.concatenate([row[lo:hi] * BUCKETS + one[: hi - lo], row[lo:hi][marks[: hi - lo]] * BUCKETS + two])
        key, n = np.unique(key, return_counts=True)
        keys.append(key)
        sums.append(n)
    if len(keys) > 1:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(sums)).astype(np.int64)
    else:
        key, n = (keys[0], sums[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.diff(first), key // BUCKETS, key % BUCKETS, n


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, doc_id, text) to records; a document without features has one empty record."""
    for batch in batches:
        for lo, hi in kernels.slices(batch.column("text")):
            words, row, bucket, n = bucket_counts(batch.column("text").slice(lo, hi - lo))
            parts = -(-n // 255)
            count = np.full(int(parts.sum()), 255, np.uint8)
            count[np.cumsum(parts) - 1] = (n - 255 * (parts - 1)).astype(np.uint8)
            row, bucket = np.repeat(row, parts), np.repeat(bucket, parts)
            group = row * RANGES + bucket // WIDTH
            heads = np.flatnonzero(np.diff(group, prepend=-1))
            none = np.flatnonzero(words == 0)
            ends = np.concatenate([heads, np.full(len(none) + 1, len(group))]).astype(np.int32)
            of = np.concatenate([group[heads] // RANGES, none])
            sizes = 2 * words - (words > 0)
            take = pa.array(lo + of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid").take(take),
                    batch.column("doc_id").take(take),
                    pa.array(words[of].astype(np.int64)),
                    pa.array(sizes[of].astype(np.int64)),
                    pa.array(np.concatenate([group[heads] % RANGES, none * 0]).astype(np.int32)),
                    _binary(ends * 2, bucket.astype(np.uint16)),
                    _binary(ends, count),
                ],
                ["uid", "doc_id", "n_words", "n_features", "r", "buckets", "counts"],
            )


def _binary(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each of its rows begins."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind) if len(raw) else np.zeros(0, kind), (off - off[0]) // np.dtype(kind).itemsize


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records to (bucket, n), one row a bucket and task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        bucket, _ = _numbers(batch.column("buckets"), np.uint16)
        count, _ = _numbers(batch.column("counts"), np.uint8)
        total += np.bincount(bucket, weights=count, minlength=BUCKETS).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])


def gains(s: np.ndarray, t: np.ndarray, s_all: int, t_all: int) -> np.ndarray:
    """Gain of each bucket in whole thousandths, from its counts and those of all buckets."""
    return np.floor(1000 * np.log((t + 1.0) * (s_all + float(BUCKETS)) / ((s + 1.0) * (t_all + float(BUCKETS))))).astype(np.int64)


def _contributions(s_all: int, t_all: int):
    """A stream of (r, salt) groups, totals in front, to (uid, doc_id, n_words, n_features, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = None, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            r = batch.column("r").to_numpy()
            totals = batch.column("totals")
            for i in np.flatnonzero(totals.is_valid().to_numpy(zero_copy_only=False)):
                if r[i] != known:
                    known = int(r[i])
                    pairs = np.frombuffer(totals[int(i)].as_py(), np.int64).reshape(2, -1)
                    at = slice(known * WIDTH, known * WIDTH + pairs.shape[1])
                    gain[at] = gains(pairs[0], pairs[1], s_all, t_all)
            rows = batch.filter(pa.array(~totals.is_valid().to_numpy(zero_copy_only=False)))
            if not len(rows):
                continue
            bucket, first = _numbers(rows.column("buckets"), np.uint16)
            count, _ = _numbers(rows.column("counts"), np.uint8)
            sums = np.concatenate([[0], np.cumsum(gain[bucket] * count.astype(np.int64))])
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("uid", "doc_id", "n_words", "n_features")), pa.array(sums[first[1:]] - sums[first[:-1]])], ["uid", "doc_id", "n_words", "n_features", "part"])

    return run


def _packed_totals(pdf):
    """The totals of one range, (bucket, s, t), as one value; at most ``WIDTH`` rows."""
    r = int(pdf["r"].iloc[0])
    width = min(WIDTH, BUCKETS - r * WIDTH)
    pairs = np.zeros((2, width), np.int64)
    pairs[0, pdf["bucket"] - r * WIDTH] = pdf["s"]
    pairs[1, pdf["bucket"] - r * WIDTH] = pdf["t"]
    return pdf.iloc[:1].assign(totals=pairs.tobytes())[["r", "totals"]]


def _postings(rows: DataFrame, key: str) -> DataFrame:
    """Records of the texts of ``rows``; uid tells its rows apart."""
    plain = rows.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("doc_id"), "text")
    return plain.mapInArrow(_records, _RECORD)


def weights(docs: DataFrame, targets: DataFrame, target_key: str = "item_id") -> DataFrame:
    """uid, doc_id, n_words, n_features, weight for every row of ``docs``, stored."""
    spark = docs.sparkSession
    records = common.stored(_postings(docs, "doc_id"), "postings")
    own = records.mapInArrow(_sums, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("s"))
    theirs = _postings(targets, target_key).mapInArrow(_sums, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("t"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    totals = every.join(own, "bucket", "left").join(theirs, "bucket", "left").select(
        F.floor(F.col("bucket") / WIDTH).cast("int").alias("r"), "bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")
    )
    totals = common.stored(totals, "totals")
    s_all, t_all = totals.agg(F.sum("s"), F.sum("t")).first()
    salts = -(-common.partitions(spark) // 4)
    front = totals.groupBy("r").applyInPandas(_packed_totals, "r int, totals binary")
    front = front.select("r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "totals")
    rows = records.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    both = front.unionByName(rows, allowMissingColumns=True)
    grouped = both.repartition(common.partitions(spark), "r", "salt").sortWithinPartitions("r", F.col("totals").isNull())
    parts = grouped.mapInArrow(_contributions(s_all, t_all), "uid bigint, doc_id bigint, n_words bigint, n_features bigint, part bigint")
    summed = parts.groupBy("uid").agg(*[F.min(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("part").alias("total"))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("total div n_features - if(total % n_features < 0, 1, 0)"))
    out = common.stored(summed.select("uid", "doc_id", "n_words", "n_features", mean.cast("bigint").alias("weight")), "weights")
    common.discard(records, totals)
    common.release(spark)
    return out


def resampled(docs: DataFrame, targets: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: the draw without replacement by weights with Gumbel noise of the id."""
    spark = docs.sparkSession
    rows = weights(docs, targets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("bigint"))
    fit = rows.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("uid")]
    dealt = common.stored(fit.select("uid", "score", "doc_id").repartitionByRange(common.partitions(spark), *order).withColumn("pid", F.spark_partition_id()), "ranked")
    counts = dict(dealt.groupBy("pid").count().collect())  # one row a partition
    draw, before, offsets = percent * sum(counts.values()) // 100, 0, {}
    for pid in sorted(counts):
        offsets[pid], before = before, before + counts[pid]
    starts = spark.createDataFrame([(k, v) for k, v in offsets.items() if v < draw], "pid int, before bigint")
    at = (F.row_number().over(Window.partitionBy("pid").orderBy(*order)) + F.col("before")).cast("bigint")
    ranks = dealt.join(F.broadcast(starts), "pid").select("uid", at.alias("rank")).where(F.col("rank") <= draw)
    return rows.join(ranks, "uid", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The byte table of CRC-32 and its fold over the bytes of every distinct feature.
ORACLE_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS uid, text FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark),
w AS (
  SELECT side, id, uid, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts),
f AS (
  SELECT side, uid, x, count(*) AS n FROM (
    SELECT side, uid, unnest(w) AS x FROM w
    UNION ALL SELECT side, uid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
  GROUP BY ALL),
codes AS (SELECT x, hex(encode(x)) AS hx FROM (SELECT DISTINCT x FROM f)),
b AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i:
         ((instr('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', hx[2 * i + 2]) - 1)::BIGINT)),
         lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM codes, crc),
p AS (SELECT side, uid, bucket, sum(n) AS n FROM f JOIN b USING (x) GROUP BY ALL),
g AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM p GROUP BY bucket),
a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM g),
k AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000)))) AS gain FROM g, a),
m AS (SELECT uid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM p JOIN k USING (bucket) WHERE side = 0 GROUP BY uid),
r AS (
  SELECT w.id AS doc_id, w.uid, len(w.w) AS n_words, coalesce(m.n_features, 0) AS n_features, coalesce(m.weight, 0) AS weight,
         (coalesce(m.weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(w.id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM w LEFT JOIN m USING (uid) WHERE w.side = 0),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS pos FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN pos <= 25 * (SELECT count(*) FROM r WHERE n_words >= 20) // 100 THEN pos END AS rank FROM o
"""
