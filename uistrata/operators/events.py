"""Typed events, labels and hotspots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text

NAVIGATE_SHARE, NEAR_SHARE, DWELL = 0.6, 0.15, 5


def hotspot(xs: Column, ys: Column) -> Column:
    """Upper medians of the last five positions, each axis by itself; NULL without one."""
    def mid(a: Column) -> Column:
        tail = F.array_sort(F.slice(a, F.greatest(F.lit(1), F.size(a) - DWELL + 1), F.lit(DWELL)))
        return F.get(tail, F.floor(F.size(tail) / 2).cast("int"))

    return F.when(F.size(xs) > 0, F.struct(mid(xs).alias("x"), mid(ys).alias("y")))


def nearest_label(x: Column, y: Column, boxes: Column, width: Column, height: Column, share: float = NEAR_SHARE) -> Column:
    """Text of the box whose centre is nearest, ties to the first; NULL beyond a share of the diagonal."""
    def far(b: Column, i: Column) -> Column:
        dx, dy = b["box"][0] + b["box"][2] / 2.0 - x, b["box"][1] + b["box"][3] / 2.0 - y
        return F.struct((dx * dx + dy * dy).alias("d"), i.alias("i"), b["text"].alias("text"))

    best = F.array_min(F.transform(boxes, far))
    return F.when(F.sqrt(best["d"]) <= share * F.sqrt((width * width + height * height).cast("double")), best["text"])


def field_for(line: Column, prev_lines: Column, boxes: Column) -> Column:
    """Label of the field that an added line fills: the nearest box not below it whose text was there before.

    Normalised texts and the line's own box are held in arrays of one, so each is made once, not for every box anew.
    """
    each = F.transform(boxes, lambda b, i: F.struct(i.alias("i"), text.normalize_line(b["text"]).alias("norm"), b["text"].alias("text"), b["box"].alias("box")))
    held = F.struct(text.normalize_line(line).alias("norm"), text.normalize_lines(prev_lines).alias("known"), each.alias("each"))

    def nearest(h: Column, target: Column) -> Column:
        def near(b: Column) -> Column:
            dx, dy = b["box"][0] - target["box"][0], b["box"][1] - target["box"][1]
            fits = (b["i"] != target["i"]) & (b["box"][1] <= target["box"][1] + target["box"][3]) & F.array_contains(h["known"], b["norm"])
            return F.when(fits, F.struct((dx * dx + dy * dy).alias("d"), b["i"].alias("i"), b["text"].alias("text")))

        return F.array_min(F.filter(F.transform(h["each"], near), lambda z: z.isNotNull()))["text"]

    def found(h: Column) -> Column:
        own = F.slice(F.filter(h["each"], lambda b: b["norm"] == h["norm"]), 1, 1)
        return F.get(F.transform(own, lambda target: nearest(h, target)), 0)

    return F.when(line.isNotNull(), F.get(F.transform(F.array(held), found), 0))


def classify_event(prev_lines: Column, added: Column, removed: Column, shape: Column, field: Column | None = None, clicked: Column | None = None, label: Column | None = None) -> Column:
    """struct(type, confidence, label, field, value) of a transition, NULL if none fits; first match wins."""
    none = F.lit(None).cast("string")
    error = text.first_error(added)
    share = F.when(F.size(prev_lines) > 0, F.size(removed) / F.size(prev_lines)).otherwise(0.0)
    field = none if field is None else field
    clicked = F.lit(False) if clicked is None else clicked
    label = none if label is None else label
    first = F.get(added, 0)

    def made(kind: str, confidence: float, label: Column = none, field: Column = none, value: Column = none) -> Column:
        keep = lambda c: F.nullif(c, F.lit(""))
        return F.struct(F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), keep(label).alias("label"), keep(field).alias("field"), keep(value).alias("value"))

    return (
        F.when(error.isNotNull(), made("error", 0.8, label=error))
        .when((F.coalesce(shape, F.lit("")) == "full") | (share >= NAVIGATE_SHARE), made("navigate", 0.7, value=text.first_url(added)))
        .when((shape == "overlay") & (F.size(added) > 0), made("open_dialog", 0.6, label=first))
        .when(shape == "band", made("scroll", 0.5))
        .when((F.size(added) > 0) & (F.coalesce(field, F.lit("")) != ""), made("type", 0.6, field=field, value=first))
        .when(clicked & (shape.isNull() | (shape == "local")), made("click", 0.6, label=label))
        .when((F.size(added) > 0) | (F.size(removed) > 0) | (shape == "local"), made("edit", 0.4))
    )
