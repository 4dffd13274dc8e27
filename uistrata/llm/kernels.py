"""Vectorised text kernels over Arrow string buffers.

Every kernel works on the raw UTF-8 bytes of a whole Arrow column, so a batch
of documents costs a handful of numpy passes instead of a Python loop over
words.  All word definitions used by the operators separate on ASCII bytes
only, which never occur inside a multi-byte UTF-8 sequence; splitting and
ASCII lower-casing bytes is therefore the same as doing it on code points.

Memory: words are hashed ``CHUNK`` at a time, so temporaries beyond a few arrays of
a document's words are bounded.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Workers live on between tasks: what a batch took goes back to the system, not to a pool.
pa.set_memory_pool(pa.system_memory_pool())
_libc = ctypes.CDLL(None)


def tidy() -> None:
    """Give free heap pages back, where the C library can."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


U64 = np.uint64

#: [^\x20\x09-\x0D]+ : everything but ASCII white space belongs to a word.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and all non-ASCII bytes.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[0x00:0x30] = True
NOT_ALNUM[0x3A:0x61] = True
NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Bits of the first k bytes of a lane.
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
#: Bytes beyond which a word is hashed by itself; words hashed at once.
LONG, CHUNK = 64, 1 << 17
#: Seeds of two hashes that know nothing of each other.
SEEDS = (0x9E3779B97F4A7C15, 0x3C79AC492BA7B653)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """64-bit hash of ``data[start:end]`` for every span: lanes of eight bytes, each mixed before the next; long spans by BLAKE2.

    Every step is a bijection, so spans of one length up to eight bytes never
    share a hash, and longer ones do no more often than random numbers.
    """
    lanes = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = np.empty(len(start), U64)
    for lo in range(0, len(start), CHUNK):
        s, size = start[lo : lo + CHUNK], (end - start)[lo : lo + CHUNK]
        h = mix(size.astype(U64) ^ U64(seed))
        some = np.arange(len(s))
        for at in range(0, min(int(size.max()), LONG), 8):
            some = some[size[some] > at] if at else some
            h[some] = mix(h[some] ^ (lanes[s[some] + at] & _LANE[np.minimum(size[some] - at, 8)]))
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[s[i] : s[i] + size[i]].tobytes(), digest_size=8, key=seed.to_bytes(8)).digest())
        out[lo : lo + CHUNK] = h
    return out


class Words:
    """Words of a run of documents.

    ``start`` and ``end`` are byte offsets into ``data``, ``hash`` a 64-bit
    hash of the (mapped) word, ``again`` an independent one (or None), and
    ``first[i]:first[i + 1]`` the words of document ``i``.
    """

    __slots__ = ("data", "start", "end", "hash", "first", "again")

    def __init__(self, data, start, end, hashes, first, again=None):
        self.data, self.start, self.end, self.hash, self.first, self.again = data, start, end, hashes, first, again

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word: words from it to the end of its document, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.hash))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``limit`` bytes each (one document at least)."""
    if not len(column):
        return
    _, off = column_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, len(column))
        lo = hi
    tidy()


def word_spans(data: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of starts and ends of all words; documents end words too."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~sep[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    begin[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = word[tails]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray = BLANK, table: np.ndarray | None = None, twice: bool = False) -> Words:
    """Words and their hashes (a second one too if ``twice``); ``table`` maps bytes first (LOWER: ASCII lower case)."""
    start, end = word_spans(data, off, sep)
    mapped = data if table is None else table[data]
    found = [span_hashes(mapped, start, end, seed) for seed in SEEDS[: 1 + twice]]
    return Words(data, start, end, found[0], np.searchsorted(start, off, side="left"), found[1] if twice else None)


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two consecutive pieces from their hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + (b ^ U64(0xA0761D6478BD642F)))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries, by doubling; length n-k+1."""
    if len(h) < k:
        return h[:0]
    out, have, piece, size = None, 0, h, 1
    rest = k
    while rest:
        if rest & 1:
            out, have = (piece, size) if out is None else (join(out[: len(h) - have - size + 1], piece[have : len(h) - size + 1]), have + size)
        rest >>= 1
        if rest:
            piece, size = join(piece[: len(h) - 2 * size + 1], piece[size : len(h) - size + 1]), size * 2
    return out[: len(h) - k + 1]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then the next run."""
    count = np.asarray(count, dtype=np.int64)
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(np.asarray(first, dtype=np.int64) - (ends - count), count)
