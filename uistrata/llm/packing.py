"""Packing by lexical retrieval: a sharded BM25 index fills each window with neighbours.

Documents become token ids with one end id each.  A shard is a run of a task's
documents of about ``SHARD_TOKENS`` tokens: it has its own inverted index, so
memory is bounded and no text is shuffled.  In a shard, the first unused
document is a seed: its heaviest terms are looked up, unused neighbours follow
by BM25 score and greedily fill the window, and the last one is cut where the
window is full; what is left of it seeds the next window.  The rest of a shard
that fills no window is cut into powers of two, which need no padding: nothing
is padded at all.

Tokens are looked up by white-space separated chunk: a tokenizer that lower-cases
and splits at white space never joins across it, so a chunk has the same ids
anywhere, and a bounded cache holds the chunks seen.  A text that holds an added
token of the file, in whatever case, is encoded whole; with a tokenizer of
another kind (``chunked`` reads its file) every text is.

Defined results: null and empty texts are the end id alone; rows are documents,
repeated or not; special-token strings are read as the tokenizer file has it; a
text longer than a window is cut, a text longer than a shard is a shard of its
own; equal scores go by place in the shard; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

WINDOW, END_ID = 4096, 2
SHARD_TOKENS = 1 << 19
#: Bytes of text that are cut into chunks at once.
SLICE = 1 << 20
QUERY_TERMS = 16
K1, B = 1.2, 0.75
#: Entries of the chunk cache of a worker; when full, it keeps those seen often.
CACHE = 250_000


#: Letters whose lower case and composed form are single characters.
_LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: A byte-level vocabulary writes the bytes that do not print as the characters from 256 on, in order.
_PRINT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}


class _Index(dict):
    """Chunk to number; unknown chunks get the next number and are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.new.append(chunk)
        return n


def plain(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bytes to split at blanks, number of chunks of each text), with the same tokens and fewer distinct chunks.

    The tokenizer lower-cases, and it starts a new piece between a letter or digit
    and a mark; so A-Z are lowered, and a comma or full stop that ends a chunk is
    set apart if a-z, 0-9 or a letter of U+00C0 to U+00FF stands before it.
    """
    text = np.insert(kernels.LOWER[data], off[1:], np.uint8(10))  # a line feed ends each text
    mark = np.flatnonzero((text == 0x2C) | (text == 0x2E))
    mark = mark[(mark > 1) & kernels.BLANK[text[np.minimum(mark + 1, len(text) - 1)]]]
    before, second = text[mark - 1], text[mark - 2]
    letter = ((before >= 0x61) & (before <= 0x7A)) | ((before >= 0x30) & (before <= 0x39))
    letter |= (second == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    out = np.insert(text, mark[letter], 32)
    ends = off[1:] + np.arange(1, len(off))
    ends = ends + np.searchsorted(mark[letter], ends)
    start, _ = kernels.word_spans(out, np.array([0, len(out)]))
    return out.tobytes(), np.diff(np.searchsorted(start, ends), prepend=0)


#: The split of a tokenizer whose chunks ``plain`` may prepare.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def chunked(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases and splits as ``plain`` and ``Chunks`` take for granted."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    plain_bytes = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex")
    split = plain_bytes and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True
    return bool(split and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and spec["model"].get("type") == "BPE")


class Chunks:
    """Token ids of texts by chunk, with a bounded cache."""

    def __init__(self, path: str, size: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core a task
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = chunked(spec)
        #: Added tokens are found before the text is lower-cased, so their texts must not be.
        self.added = [kernels.LOWER[np.frombuffer(t["content"].encode(), np.uint8)].tobytes() for t in spec.get("added_tokens", [])]
        self.tokenizer, self.size = Tokenizer.from_file(path), size
        #: Ids of all chunks one after the other, where each chunk's begin and how many it has; arrays grow by doubling.
        self.index, self.ids, self.used = _Index(), np.zeros(1 << 16, np.uint32), 0
        self.first, self.length, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _fresh(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks.  Words of Latin-1 letters are one piece to the tokenizer, so its model takes them directly."""
        tokenize, table = self.tokenizer.model.tokenize, _BYTE_LETTERS
        got, other = [], []
        for i, c in enumerate(chunks):
            if _LETTERS.fullmatch(c):
                if not c.isascii():
                    c = c.lower().encode().decode("latin-1").translate(table)
                got.append([t.id for t in tokenize(c)])
            else:
                other.append(i)
                got.append([])
        for i, x in zip(other, self.tokenizer.encode_batch([chunks[i] for i in other], add_special_tokens=False)):
            got[i] = x.ids
        return got

    def _shrink(self) -> None:
        """Keep chunks seen three times or more, then the counts anew."""
        n = len(self.index)
        kept = np.flatnonzero(self.hits[:n] > 2)
        if len(kept) > self.size // 2:
            kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")[: self.size // 2]])
        names = list(self.index)
        ids, length = self.ids[kernels.ranges(self.first[kept], self.length[kept])], self.length[kept]
        self.index, self.used = _Index(), 0
        self.index.update((names[k], i) for i, k in enumerate(kept.tolist()))
        self.hits[:] = 0
        self._add(0, ids, length)

    def _add(self, n: int, ids: np.ndarray, length: np.ndarray) -> None:
        """Note the ids of the chunks from number n on."""
        if len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        if len(self.first) < n + len(length):
            more = max(len(self.first), len(length))
            self.first, self.length, self.hits = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.first, self.length, self.hits))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[n : n + len(length)] = self.used + np.cumsum(length) - length
        self.length[n : n + len(length)] = length
        self.used += len(ids)

    def whole(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Numbers of the texts that go to the tokenizer as they are."""
        if not self.chunked:
            return np.arange(len(off) - 1)
        low, spots = kernels.LOWER[data].tobytes() if self.added else b"", []
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                spots.append(at)
                at = low.find(token, at + 1)
        # A spot that runs from one text into the next does no harm: both ways give the same ids.
        return np.unique(np.searchsorted(off, spots, side="right") - 1) if spots else np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text, END_ID last."""
        out = self._by_chunk(data, off) if self.chunked else [None] * (len(off) - 1)
        for i in self.whole(data, off).tolist():
            ids = self.tokenizer.encode(data[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids
            out[i] = np.array([*ids, END_ID], np.uint32)
        return out

    def _by_chunk(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        if len(self.index) > self.size:
            self._shrink()
        raw, counts = plain(data, off)
        chunks = raw.split()
        number = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        del raw, chunks  # a third of what a slice takes
        if self.index.new:
            got = self._fresh([c.decode() for c in self.index.new])
            n = len(self.index) - len(self.index.new)
            self.index.new.clear()
            self._add(n, np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))
        seen = np.bincount(number)
        self.hits[: len(seen)] += seen
        length = self.length[number]
        flat = self.ids[kernels.ranges(self.first[number], length)]
        ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
        flat = np.insert(flat, ends, END_ID)
        return np.split(flat, (ends + np.arange(1, len(ends) + 1))[:-1])


_worker: dict[str, Chunks] = {}


class Bm25:
    """Inverted index of a shard."""

    def __init__(self, docs: list[np.ndarray]):
        n = len(docs)
        size = np.array([len(d) for d in docs], np.float64)
        owner = np.repeat(np.arange(n, dtype=np.uint64), size.astype(np.int64))
        pair, tf = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(32)) | owner, return_counts=True)
        self.doc = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        term = (pair >> np.uint64(32)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        self.start, self.count = head, np.diff(np.append(head, len(term)))
        idf = np.log(1 + (n - self.count + 0.5) / (self.count + 0.5))
        self.weight = np.repeat(idf, self.count) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.doc] / size.mean()))
        # Heaviest terms of each document among those that another document has.
        list_of = np.repeat(np.arange(len(head)), self.count)
        shared = np.flatnonzero(self.count[list_of] > 1)
        order = shared[np.lexsort((-self.weight[shared], self.doc[shared]))]
        self.terms, self.first, self.n = list_of[order], np.searchsorted(self.doc[order], np.arange(n + 1)), n

    def neighbours(self, doc: int, free: np.ndarray) -> np.ndarray:
        """Free documents that share a query term with ``doc``, best first."""
        terms = self.terms[self.first[doc] : min(self.first[doc] + QUERY_TERMS, self.first[doc + 1])]
        if not len(terms):
            return terms
        at = kernels.ranges(self.start[terms], self.count[terms])
        score = np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        found = np.flatnonzero((score > 0) & free)
        return found[np.lexsort((found, -score[found]))]


def pack(docs: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of a shard."""
    index = Bm25(docs)
    free = np.ones(len(docs), bool)
    out, sequence, room, offset = [], 0, window, 0
    #: Lengths of the sequences to come once less than a window is left.
    left = sum(map(len, docs))
    seed, at = 0, 0
    queue: list[int] = []
    room = _next_room(left, window)
    while left:
        if at == 0:
            free[seed] = False
        n = min(room, len(docs[seed]) - at)
        out.append((seed, at, n, sequence, offset))
        at, offset, room, left = at + n, offset + n, room - n, left - n
        if not room:
            sequence, offset, room, queue = sequence + 1, 0, _next_room(left, window), []
        if at == len(docs[seed]):
            # Within a window the next neighbour of its seed, else the first free document.
            if offset and not queue:
                queue = index.neighbours(seed, free)[::-1].tolist()
            while queue and not free[queue[-1]]:
                queue.pop()
            at = 0
            if queue:
                seed = queue.pop()
            elif left:
                seed = int(np.argmax(free))
        # else: the rest of a cut document goes on in the next window, as its seed.
    return out


def _next_room(left: int, window: int) -> int:
    return window if left >= window else 1 << (left.bit_length() - 1) if left else window


def _shards(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Kept for the tasks to come: a cache changes the time a task takes, not its rows.
        if path not in _worker:
            _worker[path] = Chunks(path)
        chunks = _worker[path]
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        ids, docs, total = [], [], 0

        def flush():
            nonlocal sequence
            pieces = pack(docs)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
            crc = [zlib.crc32(docs[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            size = np.array([len(d) for d in docs], np.int64)
            out = pa.RecordBatch.from_arrays(
                [pa.array(ids).take(pa.array(doc)).cast(pa.int64()), *map(pa.array, (start, length, np.array(crc, np.int64), size[doc], seq + sequence, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += int(seq.max()) + 1
            return out

        for batch in batches:
            for lo, hi in kernels.slices(batch.column("text"), SLICE):
                data, off = kernels.column_bytes(batch.column("text").slice(lo, hi - lo))
                encoded = chunks.encode(data, off)
                ids += batch.column("doc_id").slice(lo, hi - lo).to_pylist()
                docs += encoded
                total += sum(map(len, encoded))
                if total >= SHARD_TOKENS:
                    yield flush()
                    ids, docs, total = [], [], 0
        if docs:
            yield flush()

    return run


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per piece.  ``tokenizer``: path of a vocabulary file on every executor."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_shards(str(tokenizer)), _PIECE)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
