"""Pixel-lane scalars over row-major gray arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ten characters from dark to light.
RAMP = " .:-=+*#%@"
#: Change of a pixel, and shares that name a region's shape.
PIXEL_DELTA, FULL, BAND, LOCAL = 25, 0.45, 0.5, 0.08
BINS = 64
#: Pixels of a cursor at least, and at most as a share of the frame.
LEAST_AREA, MOST_AREA = 4, 0.01


def motion_score(prev: Column, cur: Column) -> Column:
    """Mean absolute difference over 255."""
    total = F.aggregate(F.zip_with(prev, cur, lambda a, b: F.abs(a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(cur) / 255.0


def histogram(gray: Column, bins: int = BINS) -> Column:
    """Counts of all bins, empty ones too."""
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(gray, lambda v: F.floor(v * bins / 256) == b)).cast("double"))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Pearson correlation of two histograms, at least 0; of a flat one only equality counts."""
    n = F.size(a).cast("double")

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    sa, sb = total(a), total(b)
    va = total(F.transform(a, lambda v: v * v)) - sa * sa / n
    vb = total(F.transform(b, lambda v: v * v)) - sb * sb / n
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) - sa * sb / n
    return F.when(a == b, 1.0).when((va <= 0) | (vb <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), cov / F.sqrt(va * vb)))


def changed_region(prev: Column, cur: Column, width: Column, height: Column, delta: int = PIXEL_DELTA) -> Column:
    """struct(box [x, y, w, h], coverage, shape), NULL without a change or with frames of different size.

    The box and the number of changed pixels come from one pass in an Arrow function; what they are called is an expression.
    """

    def run(before: pa.Array, now: pa.Array, widths: pa.Array) -> pa.Array:
        (a, at_a, no_a), (b, at_b, no_b) = _lists(before), _lists(now)
        width, size = widths.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at_b)
        boxes, hits = np.zeros((len(no_a), 4), np.int32), np.zeros(len(no_a), np.int32)
        for rows, n, w in _alike(size, width, ~no_a & ~no_b & (np.diff(at_a) == size)):
            i = np.arange(n)
            hit = np.abs(a[at_a[rows, None] + i] - b[at_b[rows, None] + i]) > delta
            hit = np.pad(hit, ((0, 0), (0, -n % w))).reshape(len(rows), -1, w)
            xs, ys = hit.any(axis=1), hit.any(axis=2)
            x0, y0 = xs.argmax(axis=1), ys.argmax(axis=1)
            boxes[rows] = np.stack([x0, y0, w - xs[:, ::-1].argmax(axis=1) - x0, ys.shape[1] - ys[:, ::-1].argmax(axis=1) - y0], axis=1)
            hits[rows] = hit.sum(axis=(1, 2))
        box = pa.ListArray.from_arrays(pa.array(np.arange(0, boxes.size + 1, 4, np.int32)), pa.array(boxes.reshape(-1)))
        return pa.StructArray.from_arrays([box, pa.array(hits)], ["box", "hits"], mask=pa.array(hits == 0))

    found = F.arrow_udf(run, "struct<box:array<int>,hits:int>")(prev, cur, width)
    coverage = found["hits"] / F.size(cur)
    shape = region_shape(coverage, found["box"][2] / width, found["box"][3] / height)
    return F.when(found.isNotNull(), F.struct(found["box"].alias("box"), F.round(coverage, 4).alias("coverage"), shape.alias("shape")))


def region_shape(coverage: Column, w_share: Column, h_share: Column) -> Column:
    """First match wins; coverage is not rounded here."""
    return F.when(coverage >= FULL, "full").when((h_share >= BAND) & (w_share >= BAND), "band").when(coverage <= LOCAL, "local").otherwise("overlay")


def ascii_frame(gray: Column, width: int, height: int, ramp: str = RAMP) -> Column:
    marks = F.transform(gray, lambda v: F.substring(F.lit(ramp), F.lit(1) + F.floor(v * (len(ramp) - 1) / 255).cast("int"), F.lit(1)))
    rows = [F.array_join(F.slice(marks, 1 + y * width, width), "") for y in range(height)]
    return F.concat_ws("\n", *rows)


def auto_rows(width: Column, height: Column, cols: int, aspect: float = 2.0) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(cols) * (height / width) / aspect).cast("int"))


def clamp_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """[x0, y0, x1, y1] inside the frame; NULL if nothing of it is."""
    x0, y0 = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    x1, y1 = F.least(x + w, width), F.least(y + h, height)
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def _frames(gray: pd.Series, width: pd.Series):
    for g, w in zip(gray, width):
        yield np.asarray(g, np.float64).reshape(-1, int(w))


def _edge(gray: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for f in _frames(gray, width):
        dy, dx = (np.gradient(f, axis=k) if f.shape[k] > 1 else np.zeros_like(f) for k in (0, 1))
        m = np.sqrt(dx * dx + dy * dy)
        out.append((m * (255.0 / m.max()) if m.max() > 0 else m).astype(np.uint8).reshape(-1).astype(np.int32))
    return pd.Series(out)


def _sharpness(gray: pa.Array, width: pa.Array) -> pa.Array:
    values, at, none = _lists(gray)
    out = np.zeros(len(none))
    for rows, n, w in _alike(np.diff(at), width.to_numpy(zero_copy_only=False).astype(np.int64), ~none):
        f = values[at[rows, None] + np.arange(n)].reshape(len(rows), -1, w).astype(np.float64)
        p = np.pad(f, ((0, 0), (1, 1), (1, 1)), mode="reflect" if min(f.shape[1:]) > 1 else "edge")
        out[rows] = (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:] - 4 * f).reshape(len(rows), -1).var(axis=1)
    return pa.array(out, mask=none)


def _shrunk(gray: pd.Series, width: pd.Series, cols: pd.Series, rows: pd.Series) -> pd.Series:
    """Area means on a grid of rows x cols."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        cell = np.arange(n)
        return np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, 1) * m / n

    return pd.Series([np.rint(weights(f.shape[0], int(r)) @ f @ weights(f.shape[1], int(c)).T).astype(np.int32).reshape(-1) for f, c, r in zip(_frames(gray, width), cols, rows)])


def _labels(mask: np.ndarray) -> np.ndarray:
    """``_labels_of`` one mask (height x width)."""
    return _labels_of(mask[None])[0]


def _labels_of(mask: np.ndarray) -> np.ndarray:
    """8-connected parts of masks (pictures x height x width): the least place, row by row and picture by picture, of each pixel's part; -1 outside.

    All pixels take the least label around them, then the label of that label, so
    a part of any shape is done in about as many rounds as its extent has bits.
    """
    far, (_, height, width) = mask.size, mask.shape
    label = np.where(mask, np.arange(far).reshape(mask.shape), far)
    while True:
        wide = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=far)
        near = np.minimum(np.minimum(wide[:, :-2], wide[:, 1:-1]), wide[:, 2:])
        near = np.minimum(np.minimum(near[:, :, :width], near[:, :, 1 : width + 1]), near[:, :, 2:])
        step = np.append(np.where(mask, near, far).reshape(-1), far)
        # Hooks: the root that a pixel had takes the least label that any pixel of it met.
        at = label.reshape(-1)[mask.reshape(-1)]
        np.minimum.at(step, at, step[:-1][mask.reshape(-1)])
        step = step[step][:-1].reshape(mask.shape)
        if (step == label).all():
            return np.where(mask, label, -1)
        label = step


#: Pixels that are compared at once, about.
AT_ONCE = 1 << 20


def cursors_between(prev: np.ndarray, cur: np.ndarray) -> list[tuple[int, int] | None]:
    """Of each pair of pictures (n x height x width): centre (x, y) of the largest small 8-connected part of changed pixels, the first of equals; None without one."""
    out: list = [None] * len(cur)
    changed = np.abs(cur - prev) > PIXEL_DELTA
    some = np.flatnonzero(changed.any(axis=(1, 2)))
    if not len(some):
        return out
    label = _labels_of(changed[some])
    size = label[0].size
    names, part, area = np.unique(label[label >= 0], return_inverse=True, return_counts=True)
    y, x = np.nonzero(label >= 0)[1:]
    xs, ys = np.bincount(part, x) / area, np.bincount(part, y) / area
    fits = np.flatnonzero((area >= LEAST_AREA) & (area <= MOST_AREA * size))
    order = fits[np.lexsort((names[fits], -area[fits], names[fits] // size))]
    owner = names[order] // size
    for j in np.flatnonzero(np.diff(owner, prepend=-1)):
        out[some[owner[j]]] = int(xs[order[j]]), int(ys[order[j]])
    return out


def cursor_between(prev: np.ndarray, cur: np.ndarray) -> tuple[int, int] | None:
    """``cursors_between`` of one pair."""
    return cursors_between(prev[None], cur[None])[0]


def _cursor(prev: pd.Series, cur: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = [cursor_between(a, b) or (None, None) for a, b in zip(_frames(prev, width), _frames(cur, width))]
    return pd.DataFrame(out, columns=["x", "y"]).astype("Int32")


#: Kernels of three, five and seven, in parts of one.
_SMALL_KERNELS = {3: (0.25, 0.5, 0.25), 5: (0.0625, 0.25, 0.375, 0.25, 0.0625), 7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125)}


def gaussian_kernel(size: int) -> np.ndarray:
    """Weights of an odd number of neighbours: the deviation follows from the size."""
    if size in _SMALL_KERNELS:
        return np.array(_SMALL_KERNELS[size])
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def _mirrored(n: int, reach: int) -> np.ndarray:
    """Places -reach .. n + reach - 1, mirrored at the first and the last one, which are not repeated."""
    if n == 1:
        return np.zeros(2 * reach + 1, np.int64)
    at = np.abs(np.arange(-reach, n + reach)) % (2 * n - 2)
    return np.where(at < n, at, 2 * n - 2 - at)


def _blur(part: np.ndarray) -> np.ndarray:
    """Pictures of one size (n x height x width), blurred by a kernel as wide as their lesser side allows."""
    size = max(3, min(part.shape[1:]) // 2 * 2 + 1)
    kernel, reach = gaussian_kernel(size), size // 2
    # One axis, then the other: a sum of shifted rows, so a box costs its pixels times its kernel's side.
    for _ in range(2):
        height = part.shape[1]
        rows = part[:, _mirrored(height, reach)]
        part = sum(k * rows[:, i : i + height] for i, k in enumerate(kernel)).transpose(0, 2, 1)
    return np.floor(part + 0.5)


def blur_boxes(frame: np.ndarray, boxes) -> np.ndarray:
    """``frame`` with each box [x, y, w, h] blurred in turn, by itself: no pixel outside is read or changed."""
    out = frame.copy()
    height, width = frame.shape
    for x, y, w, h in boxes:
        x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
        if x1 <= x0 or y1 <= y0:
            continue
        out[y0:y1, x0:x1] = _blur(out[None, y0:y1, x0:x1].astype(np.float64))[0]
    return out


def _blurred(gray: pa.Array, width: pa.Array, boxes: pa.Array) -> pa.Array:
    """``blur_boxes`` of each picture: the first boxes of all, then the second ones, and equal boxes of pictures of one width together."""
    gray, boxes = _whole(gray), _whole(boxes)
    values, at, none = _lists(gray, np.int32)
    out, size, w = values.copy(), np.diff(at), width.to_numpy(zero_copy_only=False).astype(np.int64)
    many = boxes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    x, y, wide, high = boxes.flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4).T
    edges = np.stack([nth, w[own], np.maximum(0, x), np.maximum(0, y), np.minimum(w[own], x + wide), np.minimum(size[own] // w[own], y + high)], axis=1)
    inside = (edges[:, 4] > edges[:, 2]) & (edges[:, 5] > edges[:, 3])
    edges, own = edges[inside], own[inside]
    kinds, kind = np.unique(edges, axis=0, return_inverse=True)  # in the order of ``nth``
    order, ends = np.argsort(kind.reshape(-1), kind="stable"), np.cumsum(np.bincount(kind.reshape(-1), minlength=len(kinds)))
    for (_, w0, x0, y0, x1, y1), first, end in zip(kinds.tolist(), [0, *ends.tolist()], ends.tolist()):
        step = max(1, AT_ONCE // ((y1 - y0) * (x1 - x0)))
        for j in range(first, end, step):
            start = at[own[order[j : min(end, j + step)]]]
            place = start[:, None, None] + (np.arange(y0, y1)[:, None] * w0 + np.arange(x0, x1))
            out[place] = _blur(out[place].astype(np.float64))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(out), mask=pa.array(none) if none.any() else None)


def blurred(gray: Column, width: Column, boxes: Column) -> Column:
    """The picture with all ``boxes`` (array<array<int>>, clamped to it) blurred, one after the other."""
    return F.arrow_udf(_blurred, "array<int>")(gray, width, boxes)


def _whole(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(column: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, is null) of a list column, without a Python object for each."""
    column = _whole(column)
    null = column.is_null().to_numpy(zero_copy_only=False)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.concatenate([[0], np.cumsum(size)]), null


def _alike(size: np.ndarray, width: np.ndarray, fits: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, pixels, width) of pictures of one size and width, some at a time; empty ones, and rows that do not fit, are left out."""
    fits = fits & (size > 0)
    for n, w in np.unique(np.stack([size[fits], width[fits]], axis=1), axis=0).tolist():
        rows, step = np.flatnonzero(fits & (size == n) & (width == w)), max(1, AT_ONCE // n)
        for j in range(0, len(rows), step):
            yield rows[j : j + step], n, w


def gray_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all pixels, where each picture begins and the last one ends) of a column of pictures."""
    values, ends, _ = _lists(column)
    return values.astype(np.int16), ends


def _compared(prev: pa.Array, cur: pa.Array) -> pa.Array:
    (a, at_a, no_a), (b, at_b, no_b) = _lists(prev), _lists(cur)
    score, alike = np.zeros(len(no_a)), np.zeros(len(no_a))
    for i in np.flatnonzero(~no_a & ~no_b).tolist():
        x, y = a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]]
        score[i] = float(np.abs(x - y).mean()) / 255.0 if len(x) == len(y) and len(x) else 1.0
        alike[i] = _correlation(np.bincount(x * BINS // 256, minlength=BINS).astype(float), np.bincount(y * BINS // 256, minlength=BINS).astype(float), len(x) == len(y) and bool((x == y).all()))
    none = no_a | no_b
    return pa.StructArray.from_arrays([pa.array(score, mask=none), pa.array(alike, mask=none)], ["score", "similarity"])


def _correlation(a: np.ndarray, b: np.ndarray, same: bool) -> float:
    if same or (a == b).all():
        return 1.0
    n = len(a)
    va, vb = (a * a).sum() - a.sum() ** 2 / n, (b * b).sum() - b.sum() ** 2 / n
    return 0.0 if va <= 0 or vb <= 0 else max(0.0, float(((a * b).sum() - a.sum() * b.sum() / n) / np.sqrt(va * vb)))


def compared(prev: Column, cur: Column) -> Column:
    """struct(score, similarity) of two pictures: mean absolute difference and histogram correlation, one pass over the pixels.

    NULL beside a missing picture; pictures of different size differ wholly.
    """
    return F.arrow_udf(_compared, "struct<score:double,similarity:double>")(prev, cur)


def edge_magnitude(gray: Column, width: Column) -> Column:
    return F.pandas_udf(_edge, "array<int>")(gray, width)


def sharpness(gray: Column, width: Column) -> Column:
    """Variance of the Laplacian, border mirrored."""
    return F.arrow_udf(_sharpness, "double")(gray, width)


def shrunk(gray: Column, width: Column, cols: Column, rows: Column) -> Column:
    return F.pandas_udf(_shrunk, "array<int>")(gray, width, cols, rows)


def with_ascii(frames: DataFrame, width: int, height: int, cols: int, edge: bool = False, ramp: str = RAMP) -> DataFrame:
    """``frames`` (gray) with ``ascii``: shrunk to ``cols`` by the rule of ``auto_rows``, edges if asked for, then a mark for each cell."""
    rows = max(1, round(cols * (height / width) / 2.0))
    small = shrunk(F.col("gray"), F.lit(width), F.lit(cols), F.lit(rows))
    out = frames.withColumn("small", small)
    if edge:
        out = out.withColumn("small", edge_magnitude(F.col("small"), F.lit(cols)))
    return out.withColumn("ascii", ascii_frame(F.col("small"), cols, rows, ramp)).drop("small")


def blur_kernel(box: Column) -> Column:
    """Side of the kernel that blurs a clamped box [x0, y0, x1, y1]: odd, three at least."""
    side = F.least(box[2] - box[0], box[3] - box[1])
    return F.greatest(F.lit(3), (F.floor(side / 2) * 2 + 1).cast("int"))


def estimate_cursor(prev: Column, cur: Column, width: Column) -> Column:
    return F.pandas_udf(_cursor, "x int, y int")(prev, cur, width)
