"""LM scoring: a gated recurrent language model in numpy, class-factored output.

Counts.  Every training token of the corpus is counted: hashes are summed
map-side and shuffled.  The most frequent words (``HEAD`` in all) are broadcast;
the counts of all others are joined by hash.

Model.  The ``SHORT`` most frequent words form classes of ``CLASS`` words by
rank; the end token and the tail (all other words, unknown ones too) are classes
of their own.  p(word) = p(class | state) * p(word | class, state); within the
tail, words follow their smoothed counts over the whole corpus, so the model is
a distribution over the same events as the base.  Output biases begin at the
corpus counts.

Training.  Every training document is learnt from once.  Documents are written
as token numbers, two bytes each; a hash of id and text gives each its round, one
of ``ROUNDS``, and its replica.  In a round each replica trains on its documents
in the order of that hash, by truncated backpropagation with the state carried
from window to window and reset at documents.  Replicas, their sums of squared
gradients too, are averaged by their tokens, in order, over a tree of ``FAN`` to one.  Their number follows from the
number of training tokens alone, so the model is a function of the rows, however
they are laid out.

Replicas of a task go side by side: one call of numpy serves a step of all.

Scoring.  Whole documents run through parallel streams in windows; the state is
carried across windows to the document's end.

Defined results: null and blank texts are the end token alone; a null id is a
training document; without training documents every token is unknown and the
score is the base score; repeated rows are documents; a text of any length is one
document, and memory grows with its length, not with the streams beside it; words
of equal count rank by hash; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

SHORT, CLASS, HIDDEN = 2048, 64, 32
CLASSES = SHORT // CLASS
TAIL_CLASS, END_CLASS = CLASSES, CLASSES + 1
TAIL, END = SHORT, SHORT + 1
#: Most words broadcast with their counts (16 bytes each).
HEAD = 1 << 18
#: Each training document is learnt from in one of so many rounds.
ROUNDS = 16
#: Tokens that a replica learns from in a round, before there are ``MOST_REPLICAS`` of them; replicas that one average takes.
REPLICA_TOKENS, MOST_REPLICAS, FAN = 1 << 17, 8192, 16
STREAMS, STEPS, TRAIN_STREAMS, TRAIN_STEPS = 256, 64, 32, 32
RATE, CLIP, SEED = 0.2, 5.0, 11
#: Most replicas that learn side by side in a task; rows of an id that are added one by one; steps whose inputs are read at once.
TOGETHER, LAYERS, BLOCK = 16, 8, 8
SLICE = 6 << 20
#: Tokens that a replica deals to its streams at once, beyond the last document.
SLICE_TOKENS = 1 << 20
#: Tokens scored at once, beyond the last document.
SCORE_TOKENS = 1 << 22
LN10 = math.log(10)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def _words(column: pa.Array) -> kernels.Words:
    return kernels.words(*kernels.column_bytes(column), table=kernels.LOWER)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(_words(batch.column("text").slice(lo, hi - lo)).hash, return_counts=True) for lo, hi in kernels.slices(batch.column("text"), SLICE)]
        h, n = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], ["h", "n"])


class Lexicon:
    """Corpus totals, and the frequent words: ``hash`` sorted, ``count`` and ``rank`` (by count) beside."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_words: int, v_words: int, n_docs: int):
        order = np.lexsort((hashes, -counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_hash = np.argsort(hashes)
        self.hash, self.count, self.rank = hashes[by_hash], counts[by_hash], rank[by_hash]
        self.short = np.zeros(SHORT, np.int64)
        self.short[: min(SHORT, len(order))] = counts[order][:SHORT]
        self.docs = n_docs
        self.n, self.v = n_words + n_docs, v_words + (n_docs > 0)
        n_short = min(SHORT, len(order))
        #: Smoothed mass of the tail, unknown words included.
        self.tail = (n_words - int(self.short.sum())) + 0.5 * (v_words - n_short + 1)

    def base(self, count):
        """log10 of the base probability of tokens with these counts."""
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, rank) of hashes; -1 and -1 if not among the frequent words."""
        if not len(self.hash):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        there = self.hash[at] == h
        return np.where(there, self.count[at], -1), np.where(there, self.rank[at], -1)


class Gru:
    """Parameters, scoring and training."""

    NAMES = ("wx", "u", "b", "wc", "bc", "wo", "bo")

    def __init__(self, lexicon: Lexicon, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.wx = rng.normal(0, 0.1, (SHORT + 2, 3 * HIDDEN)).astype(f)
        self.u = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)).astype(f)
        self.b = np.zeros(3 * HIDDEN, f)
        self.wc = np.zeros((HIDDEN, CLASSES + 2), f)
        self.wo = np.zeros((CLASSES, HIDDEN, CLASS), f)
        short = lexicon.short + 0.5
        self.bc = np.log(np.concatenate([short.reshape(CLASSES, CLASS).sum(axis=1), [lexicon.tail], [lexicon.docs + 0.5]])).astype(f)
        self.bo = np.log(short.reshape(CLASSES, CLASS)).astype(f)
        #: Sums of squared gradients, by which steps shrink.
        self.memory = {k: np.full(getattr(self, k).shape, 1e-6, f) for k in self.NAMES}

    def pack(self) -> bytes:
        """Weights, then the squared gradients of their steps."""
        return b"".join(x.tobytes() for x in (*(getattr(self, k) for k in self.NAMES), *(self.memory[k] for k in self.NAMES)))

    def unpack(self, raw: bytes | np.ndarray) -> Gru:
        flat = np.frombuffer(raw, np.float32) if isinstance(raw, bytes) else raw
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        for k in self.NAMES:
            old = self.memory[k]
            self.memory[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return self

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step (steps, streams, HIDDEN) from tokens; END as input starts a document afresh.

        With ``keep`` also what the way back needs: the state before, both gates, the candidate, and the candidate's share of the state.
        """
        out, h, trace, live = Replicas([self]).states(inputs[:, None], h[None], keep)
        return out[:, 0], h[0], trace, live

    def log_p(self, s: np.ndarray, target: np.ndarray, grad: bool = False):
        """ln p of targets (ids) given states; with ``grad`` also the gradients of the negative sum."""
        out, grads, ds = Replicas([self]).log_p(s, target, np.zeros(len(target), np.int64), 1.0 if grad else None)
        if not grad:
            return out
        classes = grads.pop("classes")
        for k in ("wo", "bo"):
            whole = np.zeros_like(getattr(self, k))
            whole[classes], grads[k] = grads[k], whole
        return out, {k: g if k in ("wo", "bo") else g[0] for k, g in grads.items()}, ds

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """ln p of whole documents (ids, END last): of words short-listed, tail class and end."""
        total = np.zeros(len(docs))
        for inputs, target, owner, h in windows(docs, STREAMS, STEPS):
            s, last, _, _ = self.states(inputs, h["h"])
            h["h"] = last
            some = np.flatnonzero(owner >= 0)
            p = self.log_p(s.reshape(-1, HIDDEN).take(some, axis=0), target.reshape(-1)[some])
            total += np.bincount(owner.reshape(-1)[some], weights=p, minlength=len(docs))
        return total

    def train(self, docs: list[np.ndarray]) -> int:
        """Adagrad over the documents once."""
        return train([self], [docs])[0]

    def _back(self, inputs, trace, live, d_out) -> dict:
        """Gradients through time; of ``wx`` for the rows in ``rows`` alone."""
        grads = Replicas([self]).back(inputs[:, None], trace, live, d_out[:, None])
        return {k: g if k in ("rows", "wx") else g[0] for k, g in grads.items()}


class Replicas:
    """Models as stacks (models, ...), which the models then share.

    A step of one replica is little work for a call, so that replicas go side by
    side; each is computed from its own rows alone.
    """

    def __init__(self, models: list[Gru]):
        self.n, self.w, self.memory = len(models), {}, {}
        for k in Gru.NAMES if models else ():
            found = [getattr(m, k) for m in models]
            self.w[k] = found[0][None] if self.n == 1 else np.stack(found)
            found = [m.memory[k] for m in models]
            self.memory[k] = found[0][None] if self.n == 1 else np.stack(found)
            for i, m in enumerate(models):
                setattr(m, k, self.w[k][i])
                m.memory[k] = self.memory[k][i]

    def first(self, n: int) -> Replicas:
        """The first ``n``, of the same arrays."""
        some = copy.copy(self)
        some.n, some.w, some.memory = n, {k: x[:n] for k, x in self.w.items()}, {k: x[:n] for k, x in self.memory.items()}
        return some

    def rows(self, inputs: np.ndarray) -> np.ndarray:
        """Places of tokens (steps, models, streams) in the rows of all ``wx``."""
        return inputs + (np.arange(self.n) * (SHORT + 2))[:, None]

    def states(self, inputs: np.ndarray, h: np.ndarray, keep: bool = False):
        """``Gru.states`` of all: inputs (steps, models, streams), states (steps, models, streams, HIDDEN)."""
        steps, m, n = inputs.shape
        # Gates are 1 / (1 + exp(-x)) and the candidate 2 / (1 + exp(-2 x)) - 1: all shares of x are kept negative.
        u, b, wx, rows = -self.w["u"], -self.w["b"][:, None], self.w["wx"].reshape(-1, 3 * HIDDEN), self.rows(inputs)
        x = np.empty((steps if keep else BLOCK, 3, m, n, HIDDEN), np.float32)
        live = inputs != END
        whole = live.all(axis=(1, 2)).tolist()
        live = live.astype(np.float32)[..., None]
        out = np.empty((steps, m, n, HIDDEN), np.float32)
        before, hun, c = (np.empty_like(out) for _ in range(3)) if keep else [np.empty((1, m, n, HIDDEN), np.float32)] * 3
        share = np.empty((m, n, 3 * HIDDEN), np.float32)
        shares = _gates(share)
        with np.errstate(over="ignore"):
            for t in range(steps):
                here = t if keep else t % BLOCK
                if t % BLOCK == 0:
                    for k, read in enumerate(_gates(wx.take(rows[t : t + BLOCK], axis=0))):
                        np.subtract(_gates(b)[k], read, out=x[here : here + len(read), k])
                if not whole[t]:
                    h = h * live[t]
                np.matmul(h, u, out=share)
                gates, new, ct = x[here, :2], out[t], c[t if keep else 0]
                gates[0] += shares[0]
                gates[1] += shares[1]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                if keep:
                    before[t], hun[t] = h, shares[2]
                np.multiply(gates[1], shares[2], out=ct)
                ct += x[here, 2]
                ct += ct
                np.exp(ct, out=ct)
                ct += 1
                np.divide(2, ct, out=ct)
                ct -= 1
                np.subtract(h, ct, out=new)
                new *= gates[0]
                new += ct
                h = new
        return out, h, (before, x[:, 0], x[:, 1], c, hun) if keep else None, live

    def log_p(self, s: np.ndarray, target: np.ndarray, model: np.ndarray, scale: float | None = None):
        """ln p of targets (ids) given states, in order of their models; with ``scale`` also the gradients of the negative sum, times it.

        Of ``wo`` and ``bo`` there are gradients for the classes in ``classes`` alone, counted over all models.
        """
        kind = np.where(target < SHORT, target // CLASS, target - SHORT + CLASSES)
        every = np.arange(len(target))
        bounds = np.searchsorted(model, np.arange(self.n + 1)).tolist()
        spans = list(zip(range(self.n), bounds, bounds[1:]))
        p = np.empty((CLASSES + 2, len(target)), np.float32)
        for i, a, b in spans:
            np.add(np.matmul(self.w["wc"][i].T, s[a:b].T), self.w["bc"][i][:, None], out=p[:, a:b])
        if _steep(p):
            p -= p.max(axis=0)
        out = p[kind, every]
        np.exp(p, out=p)
        total = p.sum(axis=0)
        out -= np.log(total)
        grads = ds = None
        if scale:
            p *= np.float32(scale) / total
            p[kind, every] -= scale
            grads, ds = {"wc": np.empty_like(self.w["wc"]), "bc": np.empty_like(self.w["bc"])}, np.empty_like(s)
            for i, a, b in spans:
                grads["wc"][i], grads["bc"][i] = np.matmul(p[:, a:b], s[a:b]).T, p[:, a:b].sum(axis=1)
                np.matmul(p[:, a:b].T, self.w["wc"][i].T, out=ds[a:b])
        # Words of a class stand together, classes of about as many side by side; zeros fill them up.
        short = np.flatnonzero(target < SHORT)
        classes, tiers, order, place, size = _tiers((model * CLASSES + kind)[short])
        short = short[order]
        word = np.zeros(size, np.int64)
        word[place] = target[short] % CLASS
        # A column of ones takes the biases through the same products.
        x = np.zeros((size, HIDDEN + 1), np.float32)
        x[place, :HIDDEN], x[place, HIDDEN] = s.take(short, axis=0), 1
        w = np.empty((len(classes), HIDDEN + 1, CLASS), np.float32)
        w[:, :HIDDEN] = self.w["wo"].reshape(-1, HIDDEN, CLASS).take(classes, axis=0)
        w[:, HIDDEN] = self.w["bo"].reshape(-1, CLASS).take(classes, axis=0)
        e = np.empty((size, CLASS), np.float32)
        for k, i, j, a, b in tiers:
            np.matmul(x[a:b].reshape(-1, k, HIDDEN + 1), w[i:j], out=e[a:b].reshape(-1, k, CLASS))
        if _steep(e):
            e -= e.max(axis=1, keepdims=True)
        every = np.arange(size)
        mine = e[every, word]
        np.exp(e, out=e)
        total = e @ np.ones(CLASS, np.float32)
        mine -= np.log(total)
        out[short] += mine[place]
        if scale:
            e *= (np.float32(scale) / total)[:, None]
            e[every, word] -= scale
            dw, dx = np.empty_like(w), np.empty((size, HIDDEN), np.float32)
            for k, i, j, a, b in tiers:
                those = e[a:b].reshape(-1, k, CLASS)
                np.matmul(x[a:b].reshape(-1, k, HIDDEN + 1).swapaxes(1, 2), those, out=dw[i:j])
                np.matmul(those, w[i:j, :HIDDEN].swapaxes(1, 2), out=dx[a:b].reshape(-1, k, HIDDEN))
            ds[short] += dx.take(place, axis=0)
            grads |= {"classes": classes, "wo": dw[:, :HIDDEN].copy(), "bo": dw[:, HIDDEN]}
        return out, grads, ds

    def back(self, inputs, trace, live, d_out) -> dict:
        """Gradients through time; of ``wx`` for the rows in ``rows`` alone, counted over all models. ``d_out`` is overwritten."""
        h, z, r, c, hun = trace
        steps, m, n = inputs.shape
        g = np.empty((m, steps, n, 3 * HIDDEN), np.float32)
        gates = g.reshape(m, steps, n, 3, HIDDEN)
        by_c = np.empty_like(c)
        u = np.ascontiguousarray(self.w["u"].swapaxes(1, 2))
        whole = (live > 0).all(axis=(1, 2, 3)).tolist()
        dh = np.zeros((m, n, HIDDEN), np.float32)
        one, by_z, by_r, by_h, share = (np.empty_like(dh) for _ in range(5))
        for t in range(steps - 1, -1, -1):
            d, by, zt, rt, ct = d_out[t], by_c[t], z[t], r[t], c[t]
            np.subtract(1, zt, out=one)
            np.subtract(h[t], ct, out=by_z)
            by_z *= zt
            by_z *= one
            np.multiply(ct, ct, out=by)
            np.subtract(1, by, out=by)
            by *= one
            np.multiply(by, rt, out=by_h)
            np.multiply(by_h, hun[t], out=by_r)
            by_r *= np.subtract(rt, 1, out=one)  # ``hun`` is kept negative
            d += dh
            by *= d
            for k, by_gate in enumerate((by_z, by_r, by_h)):
                np.multiply(by_gate, d, out=gates[:, t, :, k])
            np.multiply(d, zt, out=dh)
            dh += np.matmul(g[:, t], u, out=share)
            if not whole[t]:
                dh *= live[t]
        rows = g.reshape(m, steps * n, 3 * HIDDEN)
        du = np.matmul(np.ascontiguousarray(h.swapaxes(0, 1)).reshape(m, -1, HIDDEN).swapaxes(1, 2), rows)
        gates[:, :, :, 2] = by_c.swapaxes(0, 1)  # The inputs' share of the candidate has no reset gate.
        db = np.matmul(np.ones((1, steps * n), np.float32), rows)[:, 0]
        ids, dwx = _sums(self.rows(inputs).swapaxes(0, 1).reshape(-1), rows.reshape(-1, 3 * HIDDEN))
        return {"rows": ids, "wx": dwx, "u": du, "b": db}

    def step(self, grads: dict) -> None:
        """One step of Adagrad for each model; a row of ``wx``, or a class, without a gradient stays."""
        rows, classes = grads.pop("rows"), grads.pop("classes")
        for k, g in grads.items():
            if not len(g):  # no word of a class was read
                continue
            at, each = (rows, SHORT + 2) if k == "wx" else (classes, CLASSES) if k in ("wo", "bo") else (None, 1)
            model = np.arange(self.n) if at is None else at // each
            shape = (-1, *g.shape[1:])
            w, memory = self.w[k].reshape(shape), self.memory[k].reshape(shape)
            square = g * g
            sums = square.reshape(len(g), -1) @ np.ones(g[0].size, np.float32)
            norm = np.sqrt(np.bincount(model, weights=sums, minlength=self.n))
            if norm.max() > CLIP:
                cut = (CLIP / np.maximum(norm, CLIP)).astype(np.float32)[model].reshape(-1, *[1] * (g.ndim - 1))
                g *= cut
                square *= cut * cut
            if at is None:
                memory += square
                np.sqrt(memory, out=square)
            else:
                square += memory.take(at, axis=0)
                memory[at] = square
                np.sqrt(square, out=square)
            g *= RATE
            g /= square
            if at is None:
                w -= g
            else:
                w[at] = np.subtract(w.take(at, axis=0), g, out=g)


def _steep(logits: np.ndarray) -> bool:
    """Whether exp of these could leave the range of its type."""
    return logits.size > 0 and max(logits.max(), -logits.min()) > 60


def _gates(x: np.ndarray) -> list[np.ndarray]:
    """Views of what belongs to update, reset and candidate along the last axis."""
    return [x[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3)]


def _tiers(kind: np.ndarray) -> tuple:
    """Rows by class, at places that let few products do all classes.

    Gives the classes, runs of them (places of each, classes from and to, places from and to), the order of the
    rows, their places, and the number of places.  A class of up to 64 rows has a power of two of places, 8 at
    least; a larger one as many as rows.
    """
    count = np.bincount(kind)
    classes = np.flatnonzero(count)
    size = count[classes]
    size = np.where(size > 64, size, _POWERS[np.minimum(size, 64)])
    by = np.argsort(size, kind="stable")
    classes, size = classes[by], size[by]
    ends = np.cumsum(size)
    place = np.zeros(len(count), np.int64)
    place[classes] = ends - size
    order = np.argsort(kind, kind="stable")
    first = np.cumsum(count) - count
    kind = kind[order]
    place = place[kind] + np.arange(len(kind)) - first[kind]
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(size)] if len(size) else [0]
    ends = [0, *ends.tolist()]
    return classes, [(int(size[i]), i, j, ends[i], ends[j]) for i, j in zip(cuts, cuts[1:])], order, place, ends[-1]


#: Places of a class by its rows.
_POWERS = np.array([max(8, 1 << (n - 1).bit_length()) if n else 0 for n in range(65)])


def _sums(ids: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, sums of their rows of ``g``)."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    ids, g = ids[order], g.take(order, axis=0)
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    count = np.concatenate([first[1:], [len(ids)]]) - first
    # Frequent ids are sums over runs; of all others, every one's first row is added, then every one's second, ...
    by = np.argsort(-np.minimum(count, LAYERS + 1), kind="stable")
    first, count = first[by], count[by]
    out = g.take(first, axis=0)
    many, *more = [int((count > k).sum()) for k in (LAYERS, *range(1, LAYERS))]
    one = np.ones(len(ids), g.dtype)
    for i, (a, k) in enumerate(zip(first[:many].tolist(), count[:many].tolist())):
        out[i] = one[:k] @ g[a : a + k]
    for k, n in enumerate(more, 1):
        if n > many:
            out[many:n] += g.take(first[many:n] + k, axis=0)
    return ids[first], out


def train(models: list[Gru], docs: list[list[np.ndarray]]) -> list[int]:
    """Adagrad over each model's own documents once, side by side; the tokens each has learnt from."""
    seen = [sum(map(len, d)) for d in docs]
    # Models with the most windows first: those at work are always the first ones.
    runs = [windows(d, TRAIN_STREAMS, TRAIN_STEPS) for d in docs]
    now = [next(run, None) for run in runs]
    by = sorted((i for i, w in enumerate(now) if w), key=lambda i: -now[i][3]["longest"])
    stack, now = Replicas([models[i] for i in by]), [now[i] for i in by]
    while now:
        m, steps, n = len(now), *(max(w[0].shape[k] for w in now) for k in range(2))
        inputs, target = np.full((steps, m, n), END, np.int64), np.full((steps, m, n), END, np.int64)
        some, h = np.zeros((m, steps, n), bool), np.zeros((m, n, HIDDEN), np.float32)
        for j, (i, t, owner, state) in enumerate(now):
            a, b = i.shape
            inputs[:a, j, :b], target[:a, j, :b], some[j, :a, :b], h[j, :b] = i, t, owner >= 0, state["h"]
        part = stack if m == stack.n else stack.first(m)
        s, last, trace, live = part.states(inputs, h, keep=True)
        for j, w in enumerate(now):
            w[3]["h"] = last[j, : w[0].shape[1]]
        model, t, lane = np.nonzero(some)
        at = (t * m + model) * n + lane
        # Each token weighs alike: a window with few streams left, the end of a long text, moves the model less.
        _, grads, ds = part.log_p(s.reshape(-1, HIDDEN).take(at, axis=0), target.reshape(-1)[at], model, 1 / (TRAIN_STREAMS * TRAIN_STEPS))
        d_out = np.zeros_like(s)
        d_out.reshape(-1, HIDDEN)[at] = ds
        part.step(grads | part.back(inputs, trace, live, d_out))
        now = [w for i in by[:m] if (w := next(runs[i], None))]
    return seen


def windows(docs: list[np.ndarray], streams: int, steps: int) -> Iterator[tuple]:
    """Documents dealt to parallel streams, longest first, and cut in windows.

    Yields (inputs, targets, owner, state): inputs are the tokens before, END at a
    document's start; owner is -1 where a stream has ended; ``state["h"]`` is
    carried by the caller, ``state["longest"]`` counts the tokens of the longest stream.  Takes the tokens once, and a window at a time.
    """
    if not docs:
        return
    lanes: list[list[int]] = [[] for _ in range(min(streams, len(docs)))]
    heap = [(0, i) for i in range(len(lanes))]
    for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
        n, i = heapq.heappop(heap)
        lanes[i].append(d)
        heapq.heappush(heap, (n + len(docs[d]), i))
    lanes.sort(key=lambda lane: -sum(len(docs[d]) for d in lane))
    size = np.array([sum(len(docs[d]) for d in lane) for lane in lanes])
    begin = np.cumsum(size) - size
    order = [d for lane in lanes for d in lane]
    flat = np.concatenate([docs[d] for d in order])
    whose = np.repeat(np.array(order, np.int32), [len(docs[d]) for d in order])
    state = {"h": np.zeros((len(lanes), HIDDEN), np.float32), "longest": int(size[0])}
    before = np.full(len(lanes), END, np.int64)
    for a in range(0, int(size[0]), steps):
        n = int((size > a).sum())
        at = np.arange(a, min(a + steps, int(size[0])))[:, None]
        live = at < size[:n]
        at = np.minimum(begin[:n] + at, len(flat) - 1)
        target, owner = np.where(live, flat[at], END).astype(np.int64), np.where(live, whose[at], -1)
        inputs = np.concatenate([before[None, :n], target[:-1]])
        before = target[-1]
        state["h"] = state["h"][:n]
        yield inputs, target, owner, state


def _encode(lexicon):
    """(doc_id, held_out, key, text) to token numbers, END last, two bytes each, and all of a row's results that need no model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text"), SLICE):
                part = batch.slice(lo, hi - lo)
                w = _words(part.column("text"))
                n, doc, (count, rank) = len(part), w.doc(), lex.lookup(w.hash)
                known, short = count >= 0, (rank >= 0) & (rank < SHORT)
                tail = known & ~short
                ids = np.insert(np.where(short, rank, TAIL).astype("<u2"), w.first[1:], END)
                rare = np.flatnonzero(~known)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in ("doc_id", "held_out", "key")),
                        _lists(ids, w.first + np.arange(n + 1)),
                        pa.array(w.count + 1),
                        pa.array(np.bincount(doc[known], minlength=n) + int(lex.docs > 0)),
                        pa.array(np.bincount(doc[known], weights=lex.base(count[known]), minlength=n) + lex.base(lex.docs)),
                        pa.array(np.bincount(doc[tail], weights=np.log10((count[tail] + 0.5) / lex.tail), minlength=n).astype(np.float64)),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, w.first).astype(np.int32)), pa.array(w.hash[rare].view(np.int64))),
                    ],
                    _TOKEN_COLUMNS,
                )

    return run


_TOKENS = "doc_id bigint, held_out boolean, key bigint, ids binary, n_tokens bigint, n_known bigint, base_score double, tail double, rare array<bigint>"
_TOKEN_COLUMNS = [column.split()[0] for column in _TOKENS.split(", ")]


def _lists(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of two-byte numbers as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * 2).astype(np.int32)), pa.py_buffer(ids)])


def _train(lexicon, weights):
    """(replica, ids), sorted, to a row (replica, weights, tokens) for each replica of a task; its replicas learn side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, models, seen, docs, held = lexicon.value, {}, {}, {}, 0

        def learn() -> None:
            for replica, n in zip(docs, train([models[r] for r in docs], list(docs.values()))):
                seen[replica] += n
            docs.clear()

        for batch in batches:
            for replica, ids in zip(batch.column("replica").to_pylist(), batch.column("ids")):
                if replica not in models:
                    models[replica], seen[replica], held = Gru(lex).unpack(weights.value), 0, 0
                elif held >= SLICE_TOKENS:
                    learn()
                    held = 0
                docs.setdefault(replica, []).append(np.frombuffer(ids.as_buffer(), "<u2"))
                held += len(docs[replica][-1])
        learn()
        for replica, model in models.items():
            yield pa.RecordBatch.from_arrays([pa.array([replica], pa.int64()), pa.array([model.pack()], pa.binary()), pa.array([seen[replica]], pa.int64())], ["replica", "w", "n"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, replica, w, n), sorted, to a row for each group: replicas weighed by their tokens."""
    now, total, n = None, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["replica", "w", "n"])

    for batch in batches:
        for group, w, k in zip(batch.column("group").to_pylist(), batch.column("w"), batch.column("n").to_pylist()):
            if group != now:
                if now is not None:
                    yield row()
                now, total, n = group, 0.0, 0
            total, n = total + np.frombuffer(w.as_buffer(), np.float32).astype(np.float64) * k, n + k
    if now is not None:
        yield row()


_REPLICA = "replica bigint, w binary, n bigint"


def lexicon_of(docs: DataFrame) -> tuple[Lexicon, DataFrame]:
    """The lexicon of the training documents, and the stored table (h, c) of all counts."""
    learn = docs.where(~held_out())
    counts = learn.select("text").mapInArrow(_count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))
    counts = common.stored(counts, "counts")
    common.release(docs.sparkSession)
    n_docs = learn.select("doc_id").count()
    # Frequent words: whole zones of counts, and of the zone that is too large its words of the least hashes.
    zone = F.floor(F.log2("c") * 16).cast("int")
    zones = sorted((tuple(r) for r in counts.groupBy(zone.alias("zone")).agg(F.count(F.lit(1)), F.sum("c")).collect()), reverse=True)
    last, share, room = None, 1.0, HEAD
    for z, words, _ in zones:
        last, share = z, min(1.0, 0.98 * room / words)
        room -= words
        if room <= 0:
            break
    spot = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    head = counts.where((zone > last) | ((zone == last) & (spot < share)) if zones else F.lit(False)).toArrow()
    h, c = (head.column(i).to_numpy() for i in range(2))
    return Lexicon(h.astype(np.int64).view(np.uint64), c, sum(z[2] for z in zones), sum(z[1] for z in zones), n_docs), counts


def replicas_of(tokens: int) -> int:
    return max(1, min(MOST_REPLICAS, -(-tokens // (ROUNDS * REPLICA_TOKENS))))


def tokens_of(docs: DataFrame, lexicon) -> DataFrame:
    """The stored table of all rows as token numbers, with the round (-1: held out) and the replica that learn from each."""
    replicas = replicas_of(lexicon.value.n)
    key = F.xxhash64(F.coalesce("doc_id", F.lit(common.NO_ID)), F.coalesce("text", F.lit("")), F.lit(SEED))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), key.alias("key"), "text").mapInArrow(_encode(lexicon), _TOKENS)
    place = F.pmod("key", F.lit(ROUNDS * replicas))
    turn = F.when(F.col("held_out"), -1).otherwise(place % ROUNDS).cast("int")
    ids = ids.withColumns({"turn": turn, "replica": F.floor(place / ROUNDS).cast("bigint")})
    return common.stored(ids.sortWithinPartitions("turn"), "tokens")  # in runs of a round, which its scan finds by their statistics


def fit(docs: DataFrame, lexicon) -> Gru:
    """The model of all training documents."""
    ids = tokens_of(docs, lexicon)
    model = fit_tokens(ids, lexicon)
    common.discard(ids)
    return model


def fit_tokens(ids: DataFrame, lexicon) -> Gru:
    """Rounds of replica training and averaging over all training documents."""
    spark = ids.sparkSession
    model = Gru(lexicon.value)
    replicas = replicas_of(lexicon.value.n)
    together = min(TOGETHER, -(-replicas // 12))  # a dozen tasks first
    common.release(spark)
    for i in range(ROUNDS):
        weights = spark.sparkContext.broadcast(model.pack())
        task = F.floor(F.col("replica") / together).cast("int")
        part = ids.where(F.col("turn") == i).select("replica", "key", "ids").repartitionById(-(-replicas // together), task)
        rows = part.sortWithinPartitions("replica", "key").select("replica", "ids").mapInArrow(_train(lexicon, weights), _REPLICA)
        n = replicas
        while n > FAN // 2:
            n = -(-n // FAN)
            rows = rows.withColumn("group", F.floor(F.col("replica") / FAN).cast("bigint")).repartitionById(n, F.col("group").cast("int"))
            rows = rows.sortWithinPartitions("group", "replica").select("group", "w", "n").mapInArrow(_average, _REPLICA)
        parts = sorted((r["replica"], bytes(r["w"]), r["n"]) for r in rows.collect())  # FAN / 2 rows at most
        if parts:
            total = sum(n for _, _, n in parts)
            model.unpack(sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for _, w, n in parts))
        weights.unpersist()
    return model


def _score(lexicon, weights):
    """(..., ids) to the score of all but rare words, in the place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Gru(lexicon.value).unpack(weights.value)
        for batch in batches:
            ends = np.cumsum(batch.column("n_tokens").to_numpy())
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SCORE_TOKENS, side="right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                score = model.score([np.frombuffer(ids.as_buffer(), "<u2") for ids in part.column("ids")]) / LN10
                yield part.set_column(part.schema.get_field_index("ids"), "score", pa.array(score + part.column("tail").to_numpy())).drop_columns(["tail"])
            kernels.tidy()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lex, counts = lexicon_of(docs)
    lexicon = spark.sparkContext.broadcast(lex)
    tokens = tokens_of(docs, lexicon)
    weights = spark.sparkContext.broadcast(fit_tokens(tokens, lexicon).pack())
    schema = "doc_id bigint, held_out boolean, score double, n_tokens bigint, n_known bigint, base_score double, rare array<bigint>"
    rows = tokens.select("doc_id", "held_out", "ids", "n_tokens", "n_known", "base_score", "tail", "rare").mapInArrow(_score(lexicon, weights), schema)
    rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    common.discard(tokens)
    common.release(spark)
    # Rare words: their counts by hash, a partial sum per document and task.
    c = F.coalesce("c", F.lit(0))
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").groupBy("row")
    rare = rare.agg(
        F.count("c").alias("known"),
        F.sum(F.log10((c + 0.5) / float(lex.n + 0.5 * (lex.v + 1)))).alias("base"),
        F.sum(F.log10((c + 0.5) / float(lex.tail))).alias("tail"),
    )
    both = rows.drop("rare").join(rare, "row", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.n).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("tail", F.lit(0.0)) if lex.n else F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("score"),
    )


def op8_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
