"""Text-lane scalars as Column expressions: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keyword lists of the question buckets, in test order count, action, visual.
COUNT_WORDS = ("how many", "number of", "count", "how much")
ACTION_WORDS = ("click", "type", "press", "open", "navigate", "select", "drag", "scroll", "tap", "enter", "submit", "do", "perform", "action", "next")
VISUAL_WORDS = ("color", "colour", "icon", "where", "position", "located", "appear", "layout", "look", "visible", "shown", "displayed")
MOBILE = ("ios", "android")
#: Words that mark an error line, and what counts as a URL.
ERROR_PATTERN = r"(?i)\b(error|errors|failed|failure|exception|invalid|denied|forbidden|unauthorized|cannot|unable|traceback)\b"
URL_PATTERN = r"(?i)(https?://\S+|www\.\S+|[\w-]+\.(?:com|org|io|net|dev|app|gov|edu)\b\S*)"


def normalize_line(s: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), "[^0-9a-z]+", " "))


def normalize_lines(lines: Column) -> Column:
    return F.transform(lines, normalize_line)


def line_set(lines: Column) -> Column:
    """Distinct normalised lines that are not blank."""
    return F.array_distinct(F.filter(normalize_lines(lines), lambda x: x != ""))


def similarity_of_sets(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)


def text_similarity(a: Column, b: Column) -> Column:
    """Jaccard index of the line sets; 1 if both are empty, 0 if one is."""
    return similarity_of_sets(line_set(a), line_set(b))


def _numbered(norms: Column) -> Column:
    """struct(x, nth) of each value in sorted order with its place ``i``: equal values are numbered in their order.

    Runs of equal values are as many numbers as they are long, so nothing is
    counted value by value: the cost is that of a sort.
    """

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda z, j: F.when((j == 0) | (F.get(s, j - 1)["x"] != z["x"]), j)), lambda j: j.isNotNull())
        held = F.array(heads)
        nth = F.flatten(F.flatten(F.transform(held, lambda h: F.transform(h, lambda j, k: F.sequence(F.lit(0), F.coalesce(F.get(h, k + 1), F.size(s)) - j - 1)))))
        return F.zip_with(s, nth, lambda z, n: F.struct(z["x"].alias("x"), n.alias("nth"), z["i"].alias("i")))

    held = F.array(F.sort_array(F.transform(norms, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    return F.flatten(F.transform(held, runs))


#: Lines of which each may be looked up among the others, rather than sorted.
FEW_LINES = 64


def surplus(lines: Column, other: Column, norms: Column | None = None, other_norms: Column | None = None) -> Column:
    """Lines beyond their number in ``other`` by normalised form: later duplicates first to go, order and text kept.

    Equal lines are numbered on both sides and the sides are sorted together; a
    line that has its like stands right behind it.  A few sorts, however many lines.
    Of a few lines without duplicates those stay that the other side does not have.
    ``norms``, ``other_norms``: the normalised lines of both, where they are known.
    """

    def sided(norms: Column, k: int) -> Column:
        return F.transform(_numbered(norms), lambda z: F.struct(z["x"].alias("x"), z["nth"].alias("nth"), F.lit(k).alias("side"), z["i"].alias("i")))

    def kept(both: Column) -> Column:
        def beyond(z: Column, j: Column) -> Column:
            before = F.get(both, j - 1)
            paired = F.coalesce((before["x"] == z["x"]) & (before["nth"] == z["nth"]), F.lit(False))
            return F.when((z["side"] == 1) & (z["x"] != "") & ~paired, z["i"])

        return F.filter(F.transform(both, beyond), lambda i: i.isNotNull())

    def sorted_together(h: Column) -> Column:
        held = F.array(F.sort_array(F.concat(sided(h["theirs"], 0), sided(h["own"], 1))))
        places = F.array_sort(F.flatten(F.transform(held, kept)))
        return F.transform(places, lambda i: F.get(lines, i))

    def looked_up(h: Column) -> Column:
        beyond = F.array(F.array_remove(F.array_except(h["own"], h["theirs"]), ""))
        return F.get(F.transform(beyond, lambda b: F.when(F.size(b) == 0, F.slice(lines, 1, 0)).otherwise(F.filter(lines, lambda x, i: F.array_contains(b, F.get(h["own"], i))))), 0)

    def either(h: Column) -> Column:
        full = F.array_remove(h["own"], "")
        few = (F.size(h["own"]) <= FEW_LINES) & (F.size(F.array_distinct(full)) == F.size(full))
        return F.when(few, looked_up(h)).otherwise(sorted_together(h))

    own, theirs = (normalize_lines(a) if n is None else n for a, n in ((lines, norms), (other, other_norms)))
    held = F.array(F.struct(own.alias("own"), theirs.alias("theirs")))
    return F.when(lines.isNotNull() & other.isNotNull(), F.get(F.transform(held, either), 0))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def token_estimate(text: Column, rounded: bool = True) -> Column:
    """Characters by four: rounded half to even for costs, floored for accuracy reports."""
    return F.bround(F.length(text) / 4.0).cast("bigint") if rounded else F.floor(F.length(text) / 4).cast("bigint")


def strip_choice_label(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s*[A-Za-z][).:]\s*", "")


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def classify_bucket(question: Column) -> Column:
    """count, action, visual or state by substring, first match wins."""
    q = F.lower(question)
    return F.when(_any_in(q, COUNT_WORDS), "count").when(_any_in(q, ACTION_WORDS), "action").when(_any_in(q, VISUAL_WORDS), "visual").otherwise("state")


def domain_of(system: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(system, F.lit("")))).isin(*MOBILE), "mobile").otherwise("desktop")


def normalize_options(options: Column) -> Column:
    """JSON text of a list or an object to choices; NULL under two of them."""
    as_list = F.from_json(options, "array<string>")
    as_map = F.transform(F.array_sort(F.map_entries(F.from_json(options, "map<string,string>"))), lambda e: F.concat(e["key"], F.lit(") "), e["value"]))
    raw = F.when(F.ltrim(options).startswith("{"), as_map).when(F.ltrim(options).startswith("["), as_list)
    clean = F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(clean) >= 2, clean)


def is_correct(pick: Column, choices: Column, answer: Column) -> Column:
    """Whether choice number ``pick`` (from 0) is the answer: by letter, by label-free text, or the answer is part of it."""
    a = F.trim(answer)
    choice = F.get(choices, pick)
    inside = (pick >= 0) & (pick < F.size(choices))
    letter = F.length(a) == 1
    by_letter = F.upper(a) == F.char(F.lit(65) + pick)
    same = F.lower(F.trim(strip_choice_label(choice))) == F.lower(F.trim(strip_choice_label(a)))
    part = F.contains(F.lower(choice), F.lower(a))
    return F.coalesce(inside & F.when(letter & a.rlike("^[A-Za-z]$"), by_letter).otherwise(same | part), F.lit(False))


def first_error(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda x: x.rlike(ERROR_PATTERN)), 0)


def first_url(lines: Column) -> Column:
    found = F.transform(lines, lambda x: F.regexp_extract(x, URL_PATTERN, 1))
    return F.get(F.filter(found, lambda x: x != ""), 0)


def clock(seconds: Column) -> Column:
    """m:ss, minutes not wrapped."""
    s = F.bround(seconds).cast("bigint")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def timestamp(seconds: Column, sep: str) -> Column:
    """HH:MM:SS and milliseconds, not below zero."""
    ms = F.bround(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
