"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Every document is cut into blocks of its source's block size (``BLOCK`` words, or
fewer in a source so small that a block would be more than a 1,024th of it).  A
pass over a source draws its blocks in the order of a keyed hash; a second pass
has another key.  A source's quota is the number of draws, first pass then
second, that reaches its target; the last block drawn is cut, so the target is
met to a word.  The quotas of all sources are split exactly among output shards
by a binary tree: each node divides its draws between its two sides by a
multivariate hypergeometric draw.  A leaf so gets a run of each source's draws:
disjoint, permuted blocks.  Every shard is shuffled locally.  The number of
shards grows with the mix, so that a shard stays small enough to sort in a task.

Plan.  Texts are read to count words; then only numbers move: (source, hash) of
all blocks in one range exchange, running totals within a task plus the totals of
the tasks before it, and the hashes that stand at the tree's bounds, a table of
shards and sources that goes to the tasks.  With it, each task of a second scan
knows the shard of each of its blocks and cuts the texts; they move once, to
their shards.  A hot source is spread over many tasks.  To the driver come sums
per (task, source): at most tasks + sources, and sources are held to
``MAX_SOURCES``.

Defined results: null text has size 0 and is not drawn; a null source is a source
and comes last; a source without words has target 0; the result depends on the
rows only, not on their order; rows that agree in id, source and text have the
same hashes, so they are taken alike (a block that their target cuts is cut in
each); a document of any length is cut into blocks; an empty table gives an
empty mix; other columns are carried, whatever their types and names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

#: Weights repeat in this order; the mix is this share of all words; a target stops at so many times its source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, and how many blocks a source has at least before it gets blocks of that size.
BLOCK, LEAST_BLOCKS, SEED = 256, 1024, 77
#: Least number of shards; words that a shard holds beyond it; most cells of the table of shards and sources (32 MB).
SHARDS, SHARD_WORDS, MAX_CELLS = 64, 1 << 20, 1 << 22
MAX_SOURCES = 100_000
#: Populations from this size on are beyond numpy's own multivariate draw.
NUMPY_TOTAL = 10**9
WORD = r"[^\x20\x09-\x0D]+"
#: Most blocks of a batch of numbers.
BATCH = 1 << 18
#: Stands after all hashes of blocks.
NEVER = np.uint64(2**64 - 1)


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target of each source: shares by weight, none above ``most`` sizes, what is over shared again."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, total, left = [0.0] * len(sizes), sum(weight), share * sum(sizes)
    # Those with the least size for their weight meet their limit first; each that does leaves the others more.
    order = sorted(range(len(sizes)), key=lambda i: sizes[i] / weight[i])
    for at, i in enumerate(order):
        if left * weight[i] / total <= most * sizes[i]:
            for j in order[at:]:
                out[j] = left * weight[j] / total
            break
        out[i] = float(most * sizes[i])
        left, total = left - out[i], total - weight[i]
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw, exact at any size: inversion over ten standard deviations around the mean."""
    total = good + bad
    lo, hi = max(0, draws - bad), min(good, draws)
    if lo == hi:
        return lo
    p = good / total
    spread = int(10 * np.sqrt(max(draws * p * (1 - p) * (total - draws) / max(total - 1, 1), 1))) + 2
    mode = min(hi, max(lo, int((draws + 1) * (good + 1) / (total + 2))))
    k = np.arange(max(lo, mode - spread), min(hi, mode + spread) + 1, dtype=np.float64)
    step = np.log((good - k[:-1]) / (k[:-1] + 1)) + np.log((draws - k[:-1]) / (bad - draws + k[:-1] + 1))
    log_p = np.concatenate([[0], np.cumsum(step)])
    mass = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[np.searchsorted(mass, rng.random() * mass[-1])])


def split(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws of each source in each shard (shards x sources); rows sum to nearly one size."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(lo: int, hi: int, q: list[int]) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = sum(q)
        room = total * (mid - lo) // (hi - lo)
        if total < NUMPY_TOTAL:
            left = rng.multivariate_hypergeometric(q, room, method="marginals").tolist()
        else:
            left = []
            for x in q:
                take = hypergeometric(rng, x, total - x, room)
                left.append(take)
                total, room = total - x, room - take
        node(lo, mid, left)
        node(mid, hi, [x - y for x, y in zip(q, left)])

    if quotas:
        node(0, shards, [int(x) for x in quotas])
    return out


def block_size(words: int) -> int:
    return max(1, min(BLOCK, words // LEAST_BLOCKS))


def block_keys(document: np.ndarray, block: np.ndarray, turn: int) -> np.ndarray:
    """Place of blocks in a pass, as numbers that sort: the pass, then a hash of the document and the block."""
    h = kernels.mix(document + kernels.mix(block.astype(np.uint64) * np.uint64(MOST) + np.uint64(turn + SEED)))
    return (h >> np.uint64(1)) | (np.uint64(turn) << np.uint64(63))


def document_keys(source: np.ndarray, k_id: np.ndarray, k_text: np.ndarray) -> np.ndarray:
    """A number for (source, id, text)."""
    return kernels.join(kernels.join(source.astype(np.uint64), k_id.view(np.uint64)), k_text.view(np.uint64))


class Sources:
    """Names in code-point order, null last, with sizes, targets and block sizes; ``turns``: passes that draw from a source."""

    def __init__(self, names: list, sizes: list[int]):
        order = sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or ""))
        self.names = [names[i] for i in order]
        self.sizes = np.array([sizes[i] for i in order], np.int64)
        self.targets = np.array(targets(self.sizes.tolist()), np.float64)
        self.block = np.array([block_size(n) for n in self.sizes.tolist()], np.int64)
        self.turns = np.where(self.targets > self.sizes, MOST, 1)
        self.index = {name: i for i, name in enumerate(self.names)}

    def numbers(self, column: pa.Array) -> np.ndarray:
        return np.array([self.index[x] for x in column.to_pylist()], np.int64)


class Plan:
    """Where the tree's bounds lie: ``bounds[i, s]`` is the hash from which on draws of source s are past shard i.

    ``cut_key`` and ``cut`` give the block of a source that its target cuts, and the words that are taken of it.
    """

    def __init__(self, sources: Sources, bounds: np.ndarray, cut_key: np.ndarray, cut: np.ndarray):
        self.sources, self.bounds, self.cut_key, self.cut = sources, bounds, cut_key, cut

    def shard(self, source: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Leaf of blocks: the first one whose bound is after the hash; ``len(bounds)`` if none is, so not drawn."""
        out = np.zeros(len(source), np.int64)
        order = np.argsort(source, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(source[order])) + 1):
            if len(at):
                out[at] = np.searchsorted(self.bounds[:, source[at[0]]], key[at], side="right")
        return out

    def pieces(self, source: np.ndarray, document: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, turn, shard, first word, word after the last) of what is drawn: runs of neighbouring blocks that go to one shard."""
        width = self.sources.block[source]
        count = -(-size // width)
        row = np.repeat(np.arange(len(size)), count)
        block = kernels.ranges(np.zeros(len(size), np.int64), count)
        parts = []
        for turn in range(MOST):
            some = self.sources.turns[source[row]] > turn
            r, k = row[some], block[some]
            key = block_keys(document[r], k, turn)
            shard = self.shard(source[r], key)
            lo, hi = k * width[r], np.minimum((k + 1) * width[r], size[r])
            hi = np.where(key == self.cut_key[source[r]], lo + self.cut[source[r]], hi)
            drawn = (shard < len(self.bounds)) & (hi > lo)
            r, shard, lo, hi = r[drawn], shard[drawn], lo[drawn], hi[drawn]
            if len(r):
                new = np.concatenate([[True], (r[1:] != r[:-1]) | (shard[1:] != shard[:-1]) | (lo[1:] != hi[:-1])])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(r)) - 1
                parts.append((r[head], np.full(len(head), turn), shard[head], lo[head], hi[tail]))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5


def shards_of(quotas: np.ndarray, words: int) -> int:
    return max(SHARDS, min(words // SHARD_WORDS, MAX_CELLS // max(len(quotas), 1)))


def _blocks(sources):
    """(source, k_id, k_text, size) to (s, key, words) of the blocks of every pass that draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sources.value
        for batch in batches:
            source, size = plan.numbers(batch.column("source")), batch.column("size").to_numpy()
            document = document_keys(source, batch.column("k_id").to_numpy(), batch.column("k_text").to_numpy())
            width = plan.block[source]
            count = -(-size // width)
            total = np.concatenate([[0], np.cumsum(count)])
            for lo in range(0, int(total[-1]), BATCH):
                n = np.arange(lo, min(lo + BATCH, int(total[-1])))
                row = np.searchsorted(total, n, side="right") - 1
                block = n - total[row]
                words = np.minimum(width[row], size[row] - block * width[row])
                for turn in range(MOST):
                    some = plan.turns[source[row]] > turn
                    key = block_keys(document[row[some]], block[some], turn)
                    yield pa.RecordBatch.from_arrays([pa.array(source[row[some]]), pa.array(_ordered(key)), pa.array(words[some])], ["s", "key", "words"])

    return run


def _ordered(key: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones in the same order."""
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def _unsigned(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint64) ^ np.uint64(1 << 63)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (s, key, words, task) to the same rows with the draws and words before them in task and source."""
    last, draws, words = -1, 0, 0
    for batch in batches:
        s, n = batch.column("s").to_numpy(), batch.column("words").to_numpy()
        if not len(s):
            continue
        total = np.cumsum(n)
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(s))))
        before = total - n - (total - n)[head][run]
        place = np.arange(len(s)) - head[run]
        if s[0] == last:
            before[run == 0] += words
            place[run == 0] += draws
        last, draws, words = s[-1], place[-1] + 1, before[-1] + n[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before)], [*batch.schema.names, "place", "before"])


def _at(base, wanted, column: str):
    """Laid rows to those (s, key, words, draws, words before) whose place among a source's draws is asked for.

    ``wanted[s]``: sorted places; a row holds those from its own to the next row's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, draws, words = base.value
        asked = wanted.value
        for batch in batches:
            s, n = batch.column("s").to_numpy(), batch.column("words").to_numpy()
            at = np.searchsorted(keys, s * (1 << 32) + batch.column("task").to_numpy())
            place, before = batch.column("place").to_numpy() + draws[at], batch.column("before").to_numpy() + words[at]
            lo, step = (place, 1) if column == "place" else (before, n)
            hit = np.zeros(len(s), bool)
            cuts = np.flatnonzero(np.diff(s)) + 1
            for part in np.split(np.arange(len(s)), cuts):
                if len(part):
                    w = asked[s[part[0]]]
                    a, b = lo[part], lo[part] + (step if column == "place" else step[part])
                    hit[part] = np.searchsorted(w, b, side="left") > np.searchsorted(w, a, side="left")
            hit = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(s[hit]), batch.column("key").take(pa.array(hit)), pa.array(n[hit]), pa.array(place[hit]), pa.array(before[hit])], ["s", "key", "words", "place", "before"])

    return run


_LAID = "s bigint, key bigint, words bigint, task int, place bigint, before bigint"
_FOUND = "s bigint, key bigint, words bigint, place bigint, before bigint"


def planned(docs: DataFrame) -> tuple[DataFrame, Plan]:
    """Stored sizes (k_id, k_text, doc_id, source, size) of all documents, and the plan of the mix."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sizes = common.stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), *common.row_key(), size.alias("size")), "sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources = Sources([r["source"] for r in found], [r["n"] for r in found])
    n = len(sources.names)
    blocks = sizes.where("size > 0").mapInArrow(_blocks(broadcast(sources)), "s bigint, key bigint, words bigint")
    # Repeated rows have keys in common: a number of each row lets a range end among them.
    apart = blocks.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)).cast("int"))
    dealt = apart.repartitionByRange(common.partitions(spark), "s", "key", "copy").drop("copy").sortWithinPartitions("s", "key").withColumn("task", F.spark_partition_id())
    laid = common.stored(dealt.mapInArrow(_running, _LAID), "laid")
    sums = sorted(tuple(r) for r in laid.groupBy("s", "task").agg(F.count(F.lit(1)), F.sum("words")).collect())  # tasks + sources rows at most
    keys, draws, words, total = [], [], [], {}
    for s, task, k, w in sums:
        keys.append(s * (1 << 32) + task)
        a, b = total.get(s, (0, 0))
        draws.append(a)
        words.append(b)
        total[s] = (a + k, b + w)
    base = broadcast(tuple(np.array(x, np.int64) for x in (keys, draws, words)))

    def asked(wanted: list, column: str) -> DataFrame:
        return laid.mapInArrow(_at(base, broadcast([np.asarray(w, np.int64) for w in wanted]), column), _FOUND)

    # The block that a target cuts, and rows of that hash, which repeated rows share.
    goal = np.rint(sources.targets).astype(np.int64)
    cuts = {r["s"]: r["key"] for r in asked([[g] for g in goal], "before").select("s", "key").collect()}
    cut_key, cut, quotas = np.full(n, NEVER), np.zeros(n, np.int64), np.array([total.get(s, (0, 0))[0] for s in range(n)], np.int64)
    if cuts:
        same = spark.createDataFrame(sorted(cuts.items()), "s bigint, key bigint")
        rows = laid.join(F.broadcast(same), ["s", "key"])  # a row per source, or as many as there are repeated rows
        alike = rows.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("key"), F.min(F.struct("task", "place", "before")).alias("w"))
        index = {k: i for i, k in enumerate(keys)}
        for r in alike.collect():
            s, i = r["s"], index[r["s"] * (1 << 32) + r["w"]["task"]]
            first, before = r["w"]["place"] + draws[i], r["w"]["before"] + words[i]
            each = int(goal[s] - before) // r["m"]
            quotas[s] = first + (r["m"] if each else 0)
            if each:
                cut_key[s], cut[s] = _unsigned(np.array([r["key"]], np.int64))[0], each
    shards = shards_of(quotas, int(goal.sum()))
    ends = np.cumsum(split(quotas.tolist(), shards), axis=0)
    bounds = np.full((shards, n), NEVER)
    places = [np.unique(ends[:, s]) for s in range(n)]
    got = asked(places, "place").select("s", "place", "key").toArrow()
    s, place, key = (got.column(c).to_numpy() for c in ("s", "place", "key"))
    order = np.lexsort((place, s))
    s, place, key = s[order], place[order], _unsigned(key[order])
    for i in range(n):
        lo, hi = np.searchsorted(s, [i, i + 1])
        at = np.searchsorted(place[lo:hi], ends[:, i])
        there = at < hi - lo
        bounds[there, i] = key[lo:hi][at[there]]
    common.discard(laid)
    return sizes, Plan(sources, bounds, cut_key, cut)


def mixed(docs: DataFrame) -> tuple[DataFrame, DataFrame, Sources]:
    """(mix, sizes, sources).  A row of the mix: ``doc`` (the columns of ``docs``, ``text`` the part drawn), keys, s, shard, place and words of the part.

    Rows of a shard lie together, in shuffled order; ``place`` counts them.
    """
    sizes, plan = planned(docs)
    spark = docs.sparkSession
    plan_b = spark.sparkContext.broadcast(plan)
    packed = common.carried(docs, F.col("source").cast("string").alias("source"), *common.row_key())
    names = ["doc", "text", "k_id", "k_text", "s", "shard", "turn", "a"]
    kinds = [packed.schema["doc"].dataType, T.StringType(), *[T.LongType()] * 6]
    cut = packed.mapInArrow(_cut(plan_b), T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]))
    # Shards are dealt to tasks in turn, not by hash, so that tasks get as many each.
    dealt = cut.repartitionById(common.partitions(spark), F.col("shard").cast("int"))
    order = F.xxhash64("k_id", "k_text", "turn", "a", F.lit(SEED))
    rows = dealt.withColumn("order", order).sortWithinPartitions("shard", "order", "k_id", "a").drop("order")
    schema = T.StructType([*(f for f in rows.schema if f.name not in ("turn", "a")), T.StructField("place", T.LongType()), T.StructField("words", T.LongType())])
    return rows.mapInArrow(_counted, schema), sizes, plan.sources


def _cut(plan):
    """Documents to the parts drawn of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = plan.value
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                data, off = kernels.column_bytes(part.column("text"))
                start, end = kernels.word_spans(data, off)
                first = np.searchsorted(start, off)
                size = np.diff(first)
                source = mix.sources.numbers(part.column("source"))
                document = document_keys(source, part.column("k_id").to_numpy(), part.column("k_text").to_numpy())
                row, turn, shard, a, b = mix.pieces(source, document, size)
                whole = (a == 0) & (b == size[row])
                left = np.where(whole, off[:-1][row], start[np.minimum(first[row] + a, len(start) - 1)] if len(row) else 0)
                right = np.where(whole, off[1:][row], end[first[row] + b - 1] if len(row) else 0)
                length = right - left
                ends = np.concatenate([[0], np.cumsum(length)])
                raw = data[kernels.ranges(left, length)]
                text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(take), text, part.column("k_id").take(take), part.column("k_text").take(take), *map(pa.array, (source[row], shard, turn.astype(np.int64), a))],
                    ["doc", "text", "k_id", "k_text", "s", "shard", "turn", "a"],
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards in their order, with their place in the shard and the words of their texts."""
    last, place = -1, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        data, off = kernels.column_bytes(batch.column("text"))
        words = np.diff(np.searchsorted(kernels.word_spans(data, off)[0], off))
        head = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(shard))))
        at = np.arange(len(shard)) - head[run]
        if shard[0] == last:
            at[run == 0] += place
        last, place = shard[-1], at[-1] + 1
        kept = [i for i, n in enumerate(batch.schema.names) if n not in ("turn", "a")]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(at), pa.array(words)], [*(batch.schema.names[i] for i in kept), "place", "words"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, columns of ``docs``: a row per part of a document that one pass puts in one shard.

    ``text`` is the part of the document from its first word to its last; a
    document that is taken whole keeps its text.  ``n_chars`` follows the text.
    Rows of a shard lie together, in shuffled order.
    """
    rows, sizes, _ = mixed(docs)
    common.discard(sizes)  # the plan has all that the mix needs of them

    def column(c: str):
        if c == "text":
            return F.col("text")
        if c == "n_chars":
            return F.length("text").cast(docs.schema["n_chars"].dataType).alias(c)
        return F.col(f"doc.{common.quoted(c)}").alias(c)

    return rows.select([column(c) for c in docs.columns])


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row, and where the mix has it: n_parts, first_shard, first_place.

    What is taken is counted in the texts of the mix.  Rows that agree in id,
    source and text are taken alike, so each has its share of what they take.
    """
    rows, sizes, sources = mixed(docs.select("doc_id", "source", "text"))
    spark = docs.sparkSession
    key = ["k_id", "k_text", "s"]
    first = F.min(F.struct("shard", "place")).alias("first")
    drawn = rows.groupBy(*key).agg(F.sum("words").alias("drawn"), F.count(F.lit(1)).alias("n_parts"), first)
    table = [(i, name, int(n), float(t)) for i, (name, n, t) in enumerate(zip(sources.names, sources.sizes, sources.targets))]
    named = F.broadcast(spark.createDataFrame(table, "s bigint, name string, source_size bigint, target double"))  # MAX_SOURCES rows at most
    own = sizes.join(named, F.col("source").eqNullSafe(F.col("name")))
    alike = own.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    shares = alike.join(drawn, key).withColumn("taken", F.floor(F.col("drawn") / F.col("m")).cast("bigint"))
    out = own.join(shares, key, "left")
    return out.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("n_parts", F.lit(0)).cast("bigint").alias("n_parts"),
        F.col("first.shard").alias("first_shard"),
        F.col("first.place").alias("first_place"),
    )


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(common.documents(spark, sf_dir))
