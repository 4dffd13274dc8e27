"""Language ID: a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps
its maximum over a window of fixed length, and a softmax reads those maxima.
A text is cut into windows all through (the last one is moved back to end with
the text); its scores are the mean of its windows' probabilities.

Training rows are a bounded sample (``PER_LANG`` documents a language, chosen
by a hash of their content, ``PER_DOC`` windows of each, ``MOST_TEXTS`` documents
in all; more than ``MOST_LANGS`` languages raise); every document of the
table is then predicted, whole.  Only the text is an input of a prediction.

Defined results: null text, and text without a letter, is ``und`` with score 0;
if there is nothing to learn from, every text is ``und``; rows without a
language are predicted but not learnt from; of equal probabilities the first
language by name is predicted; repeated rows are predicted alike and learnt from
once; a text of any length is read whole, a slice of its windows at a time; an
empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, kernels

#: Bounds of the training sample.
PER_LANG, PER_DOC = 400, 4
#: Most languages, beyond which fitting raises, and most documents of the whole sample (100 MB of windows): with many languages each gives fewer.
MOST_LANGS, MOST_TEXTS = 1024, 1 << 17
#: Bytes of a window, size of an embedded byte, filters of each width.
WINDOW, DEPTH, WIDTHS, FILTERS = 192, 6, (2, 3, 4), 8
SPAN = max(WIDTHS)
EPOCHS, STEP, BATCH, SEED = 12, 0.01, 64, 20240
#: The pipeline keeps a document if one language is likelier than all others together, and
#: no more than this share of its bytes beyond ASCII are of values that no training window has: another script.
LEAST_SCORE, MOST_STRANGE = 0.5, 0.5
UND = "und"


class ByteNet:
    """Parameters and arithmetic of the network."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32)
        #: A filter of width w is one of width SPAN whose other taps stay zero.
        self.mask = np.zeros((SPAN, DEPTH, n), np.float32)
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(SPAN * DEPTH, n)
        self.kernel = rng.normal(0, 0.3, (SPAN * DEPTH, n)).astype(np.float32) * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = np.zeros((n, len(langs)), np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        #: Byte values of the training windows.
        self.known = np.zeros(256, bool)

    def _columns(self, x: np.ndarray) -> np.ndarray:
        """Embedded windows (n, WINDOW) as rows of SPAN neighbouring bytes."""
        e = self.embed[x].reshape(len(x), WINDOW * DEPTH)
        view = np.lib.stride_tricks.sliding_window_view(e, SPAN * DEPTH, axis=1)[:, ::DEPTH]
        return np.ascontiguousarray(view)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(x)
        y = cols.reshape(-1, SPAN * DEPTH) @ self.kernel
        y = y.reshape(len(x), -1, len(self.bias))
        return cols, y, y.max(axis=1) + self.bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x)[2], 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> ByteNet:
        """Adam on cross-entropy."""
        self.known[np.unique(x)] = True
        rng = np.random.default_rng(SEED + 1)
        names = ["embed", "kernel", "bias", "out", "out_bias"]
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                part = order[lo : lo + BATCH]
                t += 1
                for k, g in self._gradient(x[part], y[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    step = first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - STEP * step).astype(np.float32))
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, conv, pool = self.pooled(x)
        act = np.maximum(pool, 0)
        z = act @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        d_pool = (p @ self.out.T) * (pool > 0)
        at = conv.argmax(axis=1)
        rows = np.arange(len(x))[:, None]
        picked = cols[rows, at]  # (n, filters, SPAN * DEPTH)
        d_kernel = np.einsum("nf,nfk->kf", d_pool, picked) * self.mask
        d_cols = d_pool[:, :, None] * self.kernel.T[None]
        d_embed = np.zeros_like(self.embed)
        bytes_at = x[rows[:, :, None], at[:, :, None] + np.arange(SPAN)]
        np.add.at(d_embed, bytes_at.reshape(-1), d_cols.reshape(-1, DEPTH))
        return {"embed": d_embed, "kernel": d_kernel, "bias": d_pool.sum(axis=0), "out": act.T @ p, "out_bias": p.sum(axis=0)}


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows of WINDOW bytes over all texts, text of each); short texts are filled up with blanks."""
    size = np.diff(off)
    count = np.maximum(-(-size // WINDOW), (size > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(size)), count)
    turn = kernels.ranges(np.zeros(len(size), np.int64), count)
    begin = off[:-1][owner] + np.minimum(turn * WINDOW, np.maximum(size[owner] - WINDOW, 0))
    padded = np.concatenate([data, np.full(WINDOW, 32, np.uint8)])
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin] if len(begin) else np.zeros((0, WINDOW), np.uint8)
    short = size[owner] < WINDOW
    if short.any():
        x = x.copy()
        x[short] = np.where(np.arange(WINDOW) < size[owner][short][:, None], x[short], 32)
    return x, owner


def means(net: ByteNet, column: pa.Array) -> np.ndarray:
    """Mean window probabilities (texts x languages)."""
    x, owner = windows(*kernels.column_bytes(column))
    total = np.zeros((len(column), len(net.langs)))
    for lo in range(0, len(x), 512):
        np.add.at(total, owner[lo : lo + 512], net.probabilities(x[lo : lo + 512]))
    return total / np.maximum(np.bincount(owner, minlength=len(column)), 1)[:, None]


def strange(net: ByteNet, column: pa.Array) -> np.ndarray:
    """Share of a text's bytes beyond ASCII whose values the network has not seen; 0 without such bytes."""
    data, off = kernels.column_bytes(column)
    beyond = np.concatenate([[0], np.cumsum(data >= 128)])
    new = np.concatenate([[0], np.cumsum((data >= 128) & ~net.known[data])])
    return (new[off[1:]] - new[off[:-1]]) / np.maximum(beyond[off[1:]] - beyond[off[:-1]], 1)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, lang, text) to a few windows of each, spread over the text."""
    for batch in batches:
        lang, h = batch.column("lang").to_pylist(), batch.column("h").to_pylist()
        data, off = kernels.column_bytes(batch.column("text"))
        x, owner = windows(data, off)
        first = np.searchsorted(owner, np.arange(len(lang) + 1))
        out = []
        for i, (a, b) in enumerate(zip(first, first[1:])):
            out += [(h[i], lang[i], x[a + (b - a) * k // PER_DOC].tobytes()) for k in range(PER_DOC)][: b - a]
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary()))], ["h", "lang", "x"])


def fit(docs: DataFrame, learn: Column) -> ByteNet | None:
    """Train on a bounded sample of the labelled rows that ``learn`` lets in."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.xxhash64("text").alias("h"), "lang", "text")
    # Distinct texts are counted, as only they are let in below; their hashes alone are shuffled.
    sizes = {r["lang"]: r["count"] for r in rows.select("h", "lang").distinct().groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    each = max(1, min(PER_LANG, MOST_TEXTS // len(sizes)))
    # A hash threshold for each language lets in about twice as many as are used; the least hashes are.
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * each / n)) for lang, n in sizes.items()], "lang string, share double")
    part = F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20)
    # Copies of one text count once, dropped map-side first: however many there are, no more rows than that reach the driver.
    near = rows.join(F.broadcast(shares), "lang").where(part < F.col("share")).drop("share").dropDuplicates(["h", "lang"])
    least = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    found = near.mapInArrow(_samples, "h bigint, lang string, x binary").withColumn("least", least).where(F.col("least") <= each)
    langs = sorted(sizes)
    sample = found.select("lang", "h", "x").toArrow().group_by(["lang", "h", "x"]).aggregate([])
    sample = sample.sort_by([(name, "ascending") for name in ("lang", "h", "x")])
    x = np.frombuffer(b"".join(sample["x"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    return ByteNet(langs).train(x, pc.index_in(sample["lang"], pa.array(langs)).to_numpy())


def _predict(net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = net.value if hasattr(net, "value") else net
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                p = means(model, part.column("text"))
                letters = part.column("letters").to_numpy(zero_copy_only=False)
                names = np.array([*model.langs, UND], dtype=object)
                best = np.where(letters, p.argmax(axis=1), len(model.langs))
                score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                rest = [part.column(i) for i, n in enumerate(part.schema.names) if n not in ("text", "letters")]
                kept = [n for n in part.schema.names if n not in ("text", "letters")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), letters.alias("letters"), "text")
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _accept(net: ByteNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                keep = (means(net, part.column("text")).max(axis=1) >= LEAST_SCORE) & (strange(net, part.column("text")) <= MOST_STRANGE)
                yield part.filter(pa.array(keep))

    return run


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without documents of no recognised language, all columns.  Narrow: no shuffle.

    A null text and one without a letter go, and so do texts in which no language
    outweighs the others and texts in a script that no training text has.  If
    there is nothing to learn from, all go.  Repeated rows are judged alike;
    columns of any type and name are kept.
    """
    net = fit(docs, ~held_out())
    if net is None:
        return docs.limit(0)
    rows = common.carried(docs.where(F.col("text").rlike(r"\p{L}")))
    return common.restored(rows.mapInArrow(_accept(net), rows.schema), docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, fit(docs, ~held_out()))
