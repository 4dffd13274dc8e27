"""Secrets in lines: kinds, spans, masks.  All on the JVM: offsets follow from the pieces between matches."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and patterns in priority order.
PATTERNS = (
    ("private_key", r"-----BEGIN[A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("api_key", r"\b(?:sk|pk|rk|ghp|gho|ghu|ghs|xox[baprs]|AIza)[-_][A-Za-z0-9-_]{8,}\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("credit_card", r"\b(?:\d[ -]?){13,16}\b"),
)
#: Marks around a token, its least length and least entropy.
EDGE_MARKS = ".,;:!?()[]{}'\""
LEAST_LENGTH, LEAST_ENTROPY = 20, 3.5
_SPAN = "array<struct<start:int,end:int,kind:string>>"
_MATCH = "array<struct<start:int,back:int,rank:int,kind:string,end:int,text:string>>"
#: Decimal digits of all scripts, and what they count.
_DIGITS = "".join(c for c in map(chr, range(0x1FC00)) if c.isdecimal())
_VALUES = "".join(str(int(c)) for c in _DIGITS)


def shannon_entropy(s: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda z: z == c)) / n)
    return F.when(n > 0, -F.aggregate(parts, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(0.0)


def luhn_ok(s: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in 0; other characters are passed over."""
    digits = F.reverse(F.regexp_extract_all(F.translate(s, _DIGITS, _VALUES), F.lit(r"\d"), F.lit(0)))

    def part(d: Column, i: Column) -> Column:
        v = d.cast("int")
        return F.when(i % 2 == 0, v).when(v < 5, v * 2).otherwise(v * 2 - 9)

    total = F.aggregate(F.transform(digits, part), F.lit(0), lambda a, x: a + x)
    return F.size(digits).between(13, 19) & (total % 10 == 0)


def _looks_secret(token: Column) -> Column:
    core = F.btrim(token, F.lit(EDGE_MARKS))
    return (F.length(core) >= LEAST_LENGTH) & core.rlike(r"\p{L}") & core.rlike(r"\p{Nd}") & (shannon_entropy(core) >= LEAST_ENTROPY)


def secret_tokens(line: Column) -> Column:
    """White-space separated tokens that look like credentials."""
    return F.filter(F.regexp_extract_all(line, F.lit(rf"(?U)\S{{{LEAST_LENGTH},}}"), F.lit(0)), _looks_secret)


def _matches(line: Column, pattern: str, rank: int, kind: str) -> Column:
    """Matches of a pattern as struct(start, back, rank, kind, end, text): places add up from the pieces between them."""
    found, between = F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), F.split(line, pattern, -1)
    none = F.array().cast(_MATCH)

    def step(a: Column, z: Column) -> Column:
        start = a["at"] + F.length(z["between"])
        end = start + F.length(z["found"])
        row = F.struct(start.alias("start"), (-end).alias("back"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), z["found"].alias("text"))
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(row)).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, f: F.struct(b.alias("between"), f.alias("found")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])


def _may_have(line: Column) -> dict[str, Column]:
    """What a line must have for a match of each kind: literals and lengths first, then a pattern.  A digit of any script counts."""
    has = lambda *parts: reduce(or_, [F.contains(line, F.lit(p)) for p in parts])
    return {
        "private_key": has("-----BEGIN"),
        "jwt": has("eyJ"),
        "aws_key": has("AKIA", "ASIA"),
        "api_key": has("-", "_") & line.rlike(r"(?:sk|pk|rk|gh[pous]|xox[baprs]|AIza)[-_]"),
        "email": has("@"),
        "ssn": has("-") & line.rlike(r"(?U)\d{3}-\d{2}-"),
        "credit_card": (F.length(line) >= 13) & line.rlike(r"(?U)(?:\d[ -]?){13}"),
        "secret": (F.length(line) >= LEAST_LENGTH) & line.rlike(rf"(?U)\S{{{LEAST_LENGTH}}}"),
    }


def _may_have_any(line: Column) -> Column:
    return reduce(or_, _may_have(line).values())


def find_secrets(line: Column) -> Column:
    """Spans in code points that do not overlap: the earliest, then the longest, then the kind of higher priority stays."""
    may, every = _may_have(line), []

    def matches(pattern: str, rank: int, kind: str, fits=None) -> Column:
        found = _matches(line, pattern, rank, kind)
        found = found if fits is None else F.filter(found, lambda m: fits(m["text"]))
        return F.when(may[kind], found).otherwise(F.array().cast(_MATCH))

    for rank, (kind, pattern) in enumerate(PATTERNS):
        every.append(matches(f"(?U){pattern}", rank, kind, luhn_ok if kind == "credit_card" else None))
    # Tokens too short to be a credential are no matches, so a long line of words costs one scan.
    every.append(matches(rf"(?U)\S{{{LEAST_LENGTH},}}", len(PATTERNS), "secret", _looks_secret))
    start = F.struct(F.lit(0).alias("last"), F.array().cast(_SPAN).alias("out"))

    def step(a: Column, m: Column) -> Column:
        span = F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))
        longer = F.struct(m["end"].alias("last"), F.concat(a["out"], F.array(span)).alias("out"))
        return F.when(m["start"] >= a["last"], longer).otherwise(a)

    spans = F.aggregate(F.sort_array(F.concat(*every)), start, step, lambda a: a["out"])
    return F.when(_may_have_any(line), spans).otherwise(F.array().cast(_SPAN))


def redact_line(line: Column, spans: Column, mask: str = "[REDACTED:{kind}]") -> Column:
    """The line with each span replaced by its mask: a fold over the spans, on the JVM."""
    head, tail = mask.split("{kind}") if "{kind}" in mask else (mask, None)
    made = lambda s: F.concat(F.lit(head), s["kind"], F.lit(tail)) if tail is not None else F.lit(head)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(line, a["at"] + 1, s["start"] - a["at"]), made(s)).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(line, a["at"] + 1, F.length(line))))


def masked(line: Column, mask: str = "[REDACTED:{kind}]") -> Column:
    """The line with its secrets masked; lines without any are passed on as they are."""
    return F.when(_may_have_any(line), redact_line(line, find_secrets(line), mask)).otherwise(line)


def masked_lines(lines: Column) -> Column:
    return F.transform(lines, lambda x: masked(x))


def has_secret(spans: Column) -> Column:
    return F.size(spans) > 0
