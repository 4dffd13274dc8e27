"""License scan: exact phrases, and fuzzy short notices by pigeonhole seeds.

Base labels: the words of a phrase stand one after the other.  Fuzzy labels: a
notice of ``e`` allowed edits is cut into e + 1 pieces, one of which any text
within those edits holds unchanged (pigeonhole).  Pieces are sought as plain
substrings; only around a hit does the ``regex`` library match the whole notice
with bounded errors, verify the edits and give the span.

Work is map-side only: no shuffle, memory of a slice of a batch.

Defined results: null text counts as empty; spans in code points of the text as
it is; a text without findings has score 0 and empty labels; notices that
overlap or lie in one another all stay, but of those that exclude each other (by-nc
and by-sa) the likelier do, equally likely ones all; repeated rows are rows;
time grows with the length of a text and the number of its findings; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

#: Phrase words and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices, lower case and single spaces, and their labels.
NOTICES = (
    ("licensed under the apache license, version 2.0", "apache-2.0"),
    ("released under the mit license", "mit-notice"),
    ("licensed under the gnu general public license", "gpl-notice"),
    ("gnu general public license, version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by-nc 4.0", "cc-by-nc-4.0"),
    ("licensed under cc by-sa 4.0", "cc-by-sa-4.0"),
    ("creative commons attribution", "cc-notice"),
    ("mozilla public license", "mpl"),
    ("bsd 3-clause license", "bsd-3-clause"),
    ("all rights reserved", "proprietary"),
)
#: Notices of one group are the same words but for a few letters: a place is one of them only.
EXCLUSIVE = {"cc-by-nc-4.0": "cc-by", "cc-by-sa-4.0": "cc-by"}
#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 12
_WORD = rb"[0-9a-z\x80-\xff]"
_GAP = rb"[^0-9a-z\x80-\xff]+"


def pieces(notice: str) -> tuple[int, list[tuple[int, str]]]:
    """(allowed edits, [(offset, piece)]): edits + 1 pieces of about one length."""
    edits = max(1, len(notice) // CHARS_PER_EDIT)
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return edits, [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled phrases, seeds and bounded-error patterns."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.phrases = [(words.split()[-1].encode(), re.compile(rb"(?<!" + _WORD + rb")" + _GAP.join(w.encode() for w in words.split()) + rb"(?!" + _WORD + rb")"), label) for words, label in phrases]
        self.notices = []
        for notice, label in notices:
            edits, parts = pieces(notice)
            # White space of any length counts as one character: texts are folded before the search.
            self.notices.append((notice, label, edits, parts, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}")))

    def base(self, low: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of every place of a phrase."""
        found = []
        for rare, pattern, label in self.phrases:
            if rare in low:
                found += [(m.start(), label) for m in pattern.finditer(low)]
        return found

    def matches(self, text: str) -> Iterator[list[tuple[int, int, str, float]]]:
        """Per notice, the (start, end, label, likeness) found in the folded text; those that overlap are one."""
        for notice, label, edits, parts, pattern in self.notices:
            spots = set()
            for offset, piece in parts:
                at = text.find(piece)
                while at >= 0:
                    spots.add(at - offset)
                    at = text.find(piece, at + 1)
            spans = set()
            for spot in spots:
                if m := pattern.search(text, max(0, spot - edits), spot + len(notice) + edits):
                    spans.add((m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(notice)))
            # Every seed is searched; of spans of one notice that overlap, the best stays.
            kept = []
            for span in sorted(spans, key=lambda f: (-f[3], f[0], f[1])):
                at = bisect.bisect(kept, span)
                if (not at or kept[at - 1][1] <= span[0]) and (at == len(kept) or span[1] <= kept[at][0]):
                    kept.insert(at, span)
            yield kept

    def fuzzy(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, likeness) of notices within their edits, in the folded text.

        Of notices that exclude each other and overlap, the likelier stay.
        """
        out, rivals = [], {}
        for kept in self.matches(text):
            for f in kept:
                rivals.setdefault(EXCLUSIVE[f[2]], []).append(f) if f[2] in EXCLUSIVE else out.append(f)
        for found in rivals.values():
            out += likeliest(found)
        return sorted(out)


def likeliest(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Spans that overlap no likelier one."""
    found = sorted(found, key=lambda f: (-f[3], f[0], f[1], f[2]))
    starts, ends, out = [], [], []  # what likelier notices cover, as ranges apart from one another
    for _, equal in groupby(found, key=lambda f: f[3]):
        equal = list(equal)
        for f in equal:
            at = bisect.bisect_left(starts, f[1])
            if not at or ends[at - 1] <= f[0]:
                out.append(f)
        for a, b, *_ in equal:
            lo, hi = bisect.bisect_left(ends, a), bisect.bisect_right(starts, b)
            if lo < hi:
                a, b = min(a, starts[lo]), max(b, ends[hi - 1])
            starts[lo:hi], ends[lo:hi] = [a], [b]
    return out


_BLANK = re.compile(r"[\x00-\x20]+")


def unfolded(text: str, spans: list[tuple]) -> list[tuple]:
    """Spans of a text with its runs of blanks folded, in places of the text itself."""
    folded, more, gone = [], [], 0
    for m in _BLANK.finditer(text):
        folded.append(m.start() - gone)
        gone += m.end() - m.start() - 1
        more.append(gone)

    def place(at: int) -> int:
        i = bisect.bisect_left(folded, at)
        return at + (more[i - 1] if i else 0)

    return [(place(s), place(e - 1) + 1, *rest) for s, e, *rest in spans]


_scanner: Scanner | None = None


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _scanner
    _scanner = _scanner or Scanner()
    for batch in batches:
        for lo, hi in kernels.slices(batch.column("text")):
            data, off = kernels.column_bytes(batch.column("text").slice(lo, hi - lo))
            low = kernels.LOWER[data]
            start, _ = kernels.word_spans(low, off, kernels.NOT_ALNUM)
            first = np.searchsorted(start, off)
            n_base, first_word, last_word, base_labels, labels, scores, spans = [], [], [], [], [], [], []
            raw = low.tobytes()
            for i, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist())):
                text = raw[a:b]
                base = _scanner.base(text)
                whole = text.decode()
                found = _scanner.fuzzy(_BLANK.sub(" ", whole))
                found = unfolded(whole, found) if found else found
                at = np.searchsorted(start, a + np.array([x for x, _ in base], np.int64)) - first[i]
                names = {label for _, label in base}
                n_base.append(len(base))
                first_word.append(int(at.min()) if base else None)
                last_word.append(int(at.max()) if base else None)
                base_labels.append(",".join(sorted(names)))
                labels.append(",".join(sorted(names | {label for _, _, label, _ in found})))
                scores.append(1.0 if base else max((s for _, _, _, s in found), default=0.0))
                spans.append([{"start": s, "end": e, "label": label, "likeness": like} for s, e, label, like in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(n_base, pa.int64()),
                    pa.array(first_word, pa.int64()),
                    pa.array(last_word, pa.int64()),
                    pa.array(base_labels, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, _SPANS),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"],
            )


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("likeness", pa.float64())]))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row per document: base places, labels, and ``notices``, the fuzzy spans found, in code points of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, notices array<struct<start:bigint,end:bigint,label:string,likeness:double>>"
    return docs.select("doc_id", "text").mapInArrow(_scan, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.documents(spark, sf_dir)).withColumn("notices", F.to_json("notices"))
