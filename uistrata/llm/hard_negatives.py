"""Hard negatives by exact inner product, found through a table of pivot distances.

Augmentation.  With M the largest squared norm, a row x becomes (x, sqrt(M - |x|^2))
and an anchor q becomes (q, 0); then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the order
of inner products is that of Euclidean distances.

Pivot table.  Every row keeps its distances to ``PIVOTS`` pivots (farthest-first
among ``SAMPLE`` rows) and belongs to the cell of the nearest.  For a pivot p the
triangle inequality puts the distance of q and x between |d(q,p) - d(x,p)| and
d(q,p) + d(x,p), which brackets the score; only rows whose bracket meets what is
asked for are checked exactly, in whole numbers.  Brackets have room for rounding.

Plan.  Cells are cut into parts of bounded bytes by a hash of the row, so a common
vector or label makes parts, not a long task.  Anchors are the query set: they go
to the parts in a sorted stream behind the rows of each, so a task holds one part
and a batch of anchors.  The first search returns each part's best positives, the
second, from the positives' scores, its best negatives for each; a part whose own
range of distances rules an anchor out does not get it.  Each search is reduced by
a ranked window whose limit is applied before the exchange.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; a shorter vector has zeros at its end; a null id is no
anchor, keeps its label and ranks last among ties; repeated rows are rows of their own, as anchors too; an anchor
without positives, or a positive without negatives, gives no row; an empty table
gives an empty result; a table whose largest squared norm passes 2^62 raises, as
its scores are no longs; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
PIVOTS, SAMPLE = 16, 2048
#: Bytes of vectors and distances that a part holds at most, about; parts that a small table is dealt to.
PART_BYTES, MOST_SMALL_PARTS = 128 << 20, 256
#: Share of M that brackets are widened by: far above the rounding of distances.
SLACK = 1e-6
_RESULT = "a_uid bigint, anchor_id bigint, positive_id bigint, p_uid bigint, positive_score bigint, negative_id bigint, n_uid bigint, negative_score bigint"


def usable(rows: DataFrame, vector: str, label: str) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False)))


def farthest_first(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points, each the farthest from those before; the first is the farthest from the origin."""
    taken, gap = [], (points**2).sum(axis=1)
    while len(taken) < min(most, len(points)):
        best = int(gap.argmax())
        if taken and gap[best] <= 0:
            break
        taken.append(best)
        away = ((points - points[best]) ** 2).sum(axis=1)
        gap = away if len(taken) == 1 else np.minimum(gap, away)
    return points[taken]


def pivot_distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of (v, extra) to the pivots, whose last coordinate is the augmented one."""
    own, theirs = (v**2).sum(axis=1) + extra**2, (pivots**2).sum(axis=1)
    cross = v @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(own[:, None] + theirs - 2 * cross, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _placed(pivots: np.ndarray, most: float, dim: int):
    """(uid, id, label, anchor, v) with |v|^2, distances as a row, distances as an anchor and the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dim).astype(np.float64)
            n2 = (v**2).sum(axis=1)
            far = pivot_distances(v, np.sqrt(np.maximum(most - n2, 0)), pivots)
            asked = pivot_distances(v, np.zeros(len(v)), pivots)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(pivots))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))) for x in (far, asked)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "id", "label", "anchor", "v")), pa.array(n2), *lists, pa.array(far.argmin(axis=1).astype(np.int32))], ["uid", "id", "label", "anchor", "v", "n2", "d", "qd", "cell"])

    return run


class Part:
    """The rows of a part, and the searches in it."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, pivots: int, most: float):
        whole = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        self.uid, self.label = whole("uid"), whole("label")
        ids = [b.column("id") for b in batches]
        self.no_id = np.concatenate([x.is_null().to_numpy(zero_copy_only=False) for x in ids])
        self.id = np.concatenate([x.fill_null(0).to_numpy(zero_copy_only=False) for x in ids])
        self.v = np.concatenate([_matrix(b.column("v"), dim) for b in batches])
        self.far = np.concatenate([_matrix(b.column("d"), pivots) for b in batches])
        self.most, self.exact = most, np.float64 if most < 2**52 else np.int64  # sums of products below 2^53 are exact as doubles
        self.v = self.v.astype(self.exact)
        order = np.argsort(self.label, kind="stable")
        values, first = np.unique(self.label[order], return_index=True)
        self.of_label = dict(zip(values.tolist(), np.split(order, first[1:])))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (self.v[rows] @ q.astype(self.exact)).astype(np.int64)

    def brackets(self, rows: np.ndarray, n2: float, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of each row that its pivot distances allow."""
        far = self.far[rows]
        low, high = np.abs(far - near).max(axis=1), (far + near).min(axis=1)
        slack = SLACK * (self.most + 1)
        return (n2 + self.most - high**2) / 2 - slack, (n2 + self.most - low**2) / 2 + slack

    def best(self, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """Places of the first ``k``: higher scores, then smaller ids."""
        if len(rows) > 4 * k:
            keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            return keep[self.best(rows[keep], score[keep], k)] if len(keep) < len(rows) else self._sorted(rows, score)[:k]
        return self._sorted(rows, score)[:k]

    def _sorted(self, rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.lexsort((self.uid[rows], self.id[rows], self.no_id[rows], -score))

    def positives(self, label: int, uid: int, q: np.ndarray, n2: float, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` other rows of the label and their scores: best brackets first, then all that may still be better."""
        rows = self.of_label.get(label, np.zeros(0, np.int64))
        rows = rows[self.uid[rows] != uid]
        if len(rows) > 4 * k:
            _, top = self.brackets(rows, n2, near)
            first = np.argpartition(-top, 2 * k)[: 2 * k]
            reached = np.sort(self.scores(rows[first], q))[-k]
            rows = rows[top >= reached]
        score = self.scores(rows, q)
        at = self.best(rows, score, k)
        return rows[at], score[at]

    def negatives(self, label: int, q: np.ndarray, n2: float, near: np.ndarray, positive: np.ndarray, k: int, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each positive score the best ``k`` rows of other labels within its limits."""
        other = np.concatenate([np.zeros(0, np.int64), *(v for x, v in self.of_label.items() if x != label)])
        least, top = self.brackets(other, n2, near)
        rows = other[(100 * top >= low * float(positive.min())) & (100 * least <= high * float(positive.max()))]
        score = self.scores(rows, q)
        found = []
        for p in positive.tolist():
            fit = np.array([low * p <= 100 * s <= high * p for s in score.tolist()], bool) if self.exact is np.int64 else (low * p <= 100 * score) & (100 * score <= high * p)
            mine = np.flatnonzero(fit)
            at = mine[self.best(rows[mine], score[mine], k)]
            found.append((rows[at], score[at]))
        return found


def _searched(dim: int, pivots: int, most: float, emit):
    """A stream sorted by (part, anchors last) to what ``emit(part, anchor row)`` yields for each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, part = None, [], None
        for batch in batches:
            numbers, asks = batch.column("part").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if lo == hi:
                    continue
                piece = batch.slice(lo, hi - lo)
                if numbers[lo] != number:
                    number, rows, part = numbers[lo], [], None
                if not asks[lo]:
                    rows.append(piece)
                elif rows:
                    part = part or Part(rows, dim, pivots, most)
                    yield emit(part, piece)

    return run


def _positives(dim: int, pivots: int, k: int):
    def emit(part: Part, asked: pa.RecordBatch) -> pa.RecordBatch:
        q, near, n2 = _matrix(asked.column("v"), dim), _matrix(asked.column("d"), pivots), asked.column("n2").to_numpy()
        of, rows, score = [], [], []
        for i, (uid, label) in enumerate(zip(asked.column("uid").to_pylist(), asked.column("label").to_pylist())):
            at, s = part.positives(label, uid, q[i], n2[i], near[i], k)
            of.append(np.full(len(at), i))
            rows.append(at)
            score.append(s)
        of, rows = np.concatenate(of), np.concatenate(rows)
        ids = pa.array(part.id[rows], pa.int64(), mask=part.no_id[rows])
        return pa.RecordBatch.from_arrays([asked.column("uid").take(pa.array(of)), ids, pa.array(part.uid[rows]), pa.array(np.concatenate(score))], ["a_uid", "positive_id", "p_uid", "positive_score"])

    return emit


def _negatives(dim: int, pivots: int, k: int, low: int, high: int):
    def emit(part: Part, asked: pa.RecordBatch) -> pa.RecordBatch:
        q, near, n2 = _matrix(asked.column("v"), dim), _matrix(asked.column("d"), pivots), asked.column("n2").to_numpy()
        out: list[list] = [[] for _ in range(5)]
        for i, (label, positives) in enumerate(zip(asked.column("label").to_pylist(), asked.column("positives").to_pylist())):
            found = part.negatives(label, q[i], n2[i], near[i], np.array([p["positive_score"] for p in positives], np.int64), k, low, high)
            for p, (at, s) in zip(positives, found):
                for column, value in zip(out, (np.full(len(at), i), [p["positive_id"]] * len(at), [p["p_uid"]] * len(at), [p["positive_score"]] * len(at), at)):
                    column.extend(value)
                out.append(s)
        of, rows = np.array(out[0], np.int64), np.array(out[4], np.int64)
        ids = pa.array(part.id[rows], pa.int64(), mask=part.no_id[rows])
        take, score = pa.array(of), np.concatenate([np.zeros(0, np.int64), *out[5:]])
        lists = [pa.array(x, pa.int64()) for x in out[1:4]]
        return pa.RecordBatch.from_arrays([asked.column("uid").take(take), asked.column("id").take(take), *lists, ids, pa.array(part.uid[rows]), pa.array(score)], ["a_uid", "anchor_id", "positive_id", "p_uid", "positive_score", "negative_id", "n_uid", "negative_score"])

    return emit


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id bigint, v array<bigint> without nulls, label bigint, anchor boolean.
    """
    spark = rows.sparkSession
    names = "anchor_id, positive_id, rank, negative_id, positive_score, negative_score".split(", ")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, most, dim = rows.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if most >= 2.0**62:
        raise ValueError("the largest squared norm passes 2^62: scores are no longs")
    dim = max(dim, 1)
    padded = rows.withColumn("v", F.slice(F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), dim)), 1, dim))
    sample = padded.select("v", F.xxhash64("v", "id", "label").alias("h")).orderBy("h", "v").limit(SAMPLE).collect()
    v = np.array([r.v for r in sample], np.float64)
    pivots = farthest_first(np.column_stack([v, np.sqrt(np.maximum(most - (v**2).sum(axis=1), 0))]), PIVOTS)
    keyed = padded.select(F.monotonically_increasing_id().alias("uid"), "id", "label", "anchor", "v")
    schema = "uid bigint, id bigint, label bigint, anchor boolean, v array<bigint>, n2 double, d array<double>, qd array<double>, cell int"
    table = common.stored(keyed.mapInArrow(_placed(pivots, most, dim), schema), "pivots")
    # Parts: numbered, cell by cell.
    of_cell = dict(table.groupBy("cell").count().collect())  # one row a pivot
    size = max(1, min(PART_BYTES // (8 * (dim + len(pivots))), -(-n // min(common.partitions(spark), MOST_SMALL_PARTS))))
    salts, number, base = {}, 0, {}
    for cell in sorted(of_cell):
        salts[cell], base[cell] = -(-of_cell[cell] // size), number
        number += salts[cell]
    look = lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in x.items() for y in kv]), F.col("cell"))
    dealt = table.withColumn("part", (look(base) + F.pmod(F.xxhash64("uid"), look(salts))).cast("int"))
    near = F.array(*[F.struct(F.min(F.element_at("d", j + 1)).alias("lo"), F.max(F.element_at("d", j + 1)).alias("hi")) for j in range(len(pivots))])
    parts = common.stored(dealt.groupBy("part").agg(near.alias("near")), "parts")
    stream = dealt.select("part", F.lit(False).alias("ask"), "uid", "id", "label", "v", "n2", "d")
    asked = table.where("anchor").select("uid", "id", "label", "v", "n2", F.col("qd").alias("d"))
    to_all = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(number - 1)))).withColumn("ask", F.lit(True))

    def searched(anchors: DataFrame, emit, out: str) -> DataFrame:
        both = stream.unionByName(anchors, allowMissingColumns=True)
        return both.repartition(common.partitions(spark), "part").sortWithinPartitions("part", "ask").mapInArrow(_searched(dim, len(pivots), most, emit), out)

    found = searched(to_all, _positives(dim, len(pivots), positives), "a_uid bigint, positive_id bigint, p_uid bigint, positive_score bigint")
    found = _first(found, ["a_uid"], [F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), F.col("p_uid")], positives)
    known = common.stored(found.groupBy("a_uid").agg(F.collect_list(F.struct("positive_id", "p_uid", "positive_score")).alias("positives")), "positives")
    common.release(spark)
    wanted = to_all.join(known.withColumnRenamed("a_uid", "uid"), "uid").join(parts, "part")
    gap = F.array_max(F.zip_with("d", "near", lambda d, x: F.greatest(d - x.hi, x.lo - d, F.lit(0.0))))
    most_score = (F.col("n2") + F.lit(float(most)) - gap * gap) / 2 + F.lit(SLACK * (most + 1))
    least = F.array_min(F.transform("positives", lambda p: p.positive_score)).cast("double")
    found = searched(wanted.where(100 * most_score >= low * least).drop("near"), _negatives(dim, len(pivots), negatives, low, high), _RESULT)
    found = _first(found, ["a_uid", "p_uid"], [F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), F.col("n_uid")], negatives)
    return found.select(*names)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "label")
    label = F.col("label").cast("bigint")
    noisy = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (label + 1) % 10).otherwise(label)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return hard_negatives(rows.select(F.col("vec_id").cast("bigint").alias("id"), vector.alias("v"), noisy.alias("label"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)).alias("anchor")))


ORACLE_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.uid AS b, b.vec_id AS other,
         list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
  FROM e a JOIN e b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, anchor_id, b, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other NULLS LAST, b) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other NULLS LAST, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
