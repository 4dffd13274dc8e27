"""Gray pictures as files: PNG without loss, baseline JPEG by quality."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the JPEG standard's annex K, row by row: quantisation of brightness at quality 50.
_QUANT = np.array(
    """16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
       18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99""".split(),
    np.float64,
).reshape(8, 8)
#: Fixed values of the same annex: codes of each length from 1 to 16 bits, and what they stand for (DC, then AC of brightness).
_DC = ("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "00 01 02 03 04 05 06 07 08 09 0a 0b")
_AC = (
    "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
    """01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a
       34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a
       92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da
       e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa""",
)


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block along its diagonals, in turn up and down."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()
_WAVES = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(table: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(code, bits) by symbol, and the table as a file has it: codes count up within a length and double into the next."""
    lengths, symbols = [int(x) for x in table[0].split()], [int(x, 16) for x in table[1].split()]
    code, bits, value, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for size, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            code[s], bits[s], value = value, size, value + 1
        at, value = at + n, value << 1
    return code, bits, bytes([*lengths, *symbols])


def quantisation(quality: int) -> np.ndarray:
    """Steps of the 64 waves at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((_QUANT * scale + 50) // 100, 1, 255)


def _size(values: np.ndarray) -> np.ndarray:
    """Bits of the size of whole numbers."""
    return np.ceil(np.log2(np.abs(values) + 1)).astype(np.int64)


def _packed(code: np.ndarray, bits: np.ndarray) -> bytes:
    """Codes one after the other, filled up with ones; a byte of ones is followed by an empty one."""
    first = np.cumsum(bits) - bits
    at = np.arange(int(bits.sum())) - np.repeat(first, bits)
    stream = (np.repeat(code, bits) >> (np.repeat(bits, bits) - 1 - at)) & 1
    stream = np.concatenate([stream, np.ones(-len(stream) % 8, np.int64)])
    return np.packbits(stream.astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def jpeg(gray: np.ndarray, quality: int = 90) -> bytes:
    """A gray picture (height x width, bytes) as a baseline JPEG file."""
    height, width = gray.shape
    steps = quantisation(quality)
    full = np.pad(gray.astype(np.float64) - 128, ((0, -height % 8), (0, -width % 8)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
    waves = np.rint(_WAVES @ blocks @ _WAVES.T / steps).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
    (dc_code, dc_bits, dc_file), (ac_code, ac_bits, ac_file) = _codes(_DC), _codes(_AC)

    def extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(v < 0, v + (1 << size) - 1, v)

    # A symbol for each block's change of mean, each other wave and the zeros before it, and the end of a block.
    change = np.diff(waves[:, 0], prepend=0)
    size = _size(change)
    n = np.arange(len(waves))
    place, code, bits = [n * 1024], [(dc_code[size] << size) | extra(change, size)], [dc_bits[size] + size]
    block, k = np.nonzero(waves[:, 1:])
    k = k + 1
    new = np.diff(block, prepend=-1) != 0
    zeros = k - 1 - np.where(new, 0, np.concatenate([[0], k[:-1]]))
    value = waves[block, k]
    size = _size(value)
    symbol = (zeros % 16) * 16 + size
    place.append(block * 1024 + k * 8 + 7)
    code.append((ac_code[symbol] << size) | extra(value, size))
    bits.append(ac_bits[symbol] + size)
    long = zeros // 16
    place.append(np.repeat(block * 1024 + k * 8, long))
    code.append(np.full(int(long.sum()), ac_code[0xF0]))
    bits.append(np.full(int(long.sum()), ac_bits[0xF0]))
    open_ = np.flatnonzero(waves[:, 63] == 0)
    place.append(open_ * 1024 + 1000)
    code.append(np.full(len(open_), ac_code[0]))
    bits.append(np.full(len(open_), ac_bits[0]))
    order = np.argsort(np.concatenate(place), kind="stable")
    body = _packed(np.concatenate(code)[order], np.concatenate(bits)[order])

    def part(marker: int, data: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data

    head = part(0xE0, b"JFIF\x00" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0)) + part(0xDB, b"\x00" + steps.reshape(-1)[ZIGZAG].astype(np.uint8).tobytes())
    head += part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00") + part(0xC4, b"\x00" + dc_file) + part(0xC4, b"\x10" + ac_file)
    return b"\xff\xd8" + head + part(0xDA, b"\x01\x01\x00\x00\x3f\x00") + body + b"\xff\xd9"


def png(gray: np.ndarray) -> bytes:
    """A gray picture (height x width, bytes) as a PNG file."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = gray.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), gray.astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


#: Samples of a pixel by the color type of a PNG file.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row, and steps, of the seven passes of an interlaced PNG file.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``step``: bytes of a pixel."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if not kinds.any():
        return rows
    if kinds.max() > 4:
        raise ValueError("no filter of a PNG file")
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds, rows):
        if kind == 2:
            row += above
        elif kind == 1:
            for i in range(step):
                row[i::step] = np.cumsum(row[i::step], dtype=np.uint8)
        elif kind:
            line, up = row.tolist(), above.tolist()
            for i, x in enumerate(line):
                a, b, c = (line[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                if kind == 3:
                    line[i] = (x + (a + b) // 2) & 255
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    line[i] = (x + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
            row[:] = line
        above = row
    return rows


def unpng(data: bytes) -> np.ndarray:
    """The picture of a PNG file of any kind as gray (height x width, bytes), colors weighed as by ``seams.read_pictures``; ValueError if it has none."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, parts = 8, {}
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        parts[kind] = parts.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += size + 12
    try:
        width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", parts[b"IHDR"])
        raw, n = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8), _SAMPLES[color]
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3).astype(np.float64) if color == 3 else None
    except (KeyError, struct.error, zlib.error) as e:
        raise ValueError("no picture in a PNG file") from e
    if depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("no picture in a PNG file")
    out, done = np.zeros((height, width, n), np.uint16), 0
    for x, y, dx, dy in _PASSES if laced else ((0, 0, 1, 1),):
        w, h = len(range(x, width, dx)), len(range(y, height, dy))
        if not w or not h:
            continue
        size = (w * n * depth + 7) // 8
        rows = _unfiltered(raw[done : done + h * (size + 1)].reshape(h, size + 1), max(1, n * depth // 8))
        done += h * (size + 1)
        if depth == 16:
            values = rows.view(">u2")
        elif depth == 8:
            values = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
            values = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)[:, : w * n]
        out[y::dy, x::dx] = values.reshape(h, w, n)
    if color != 3 and depth == 8 and n < 3:
        return out[:, :, 0].astype(np.uint8)
    rgb = palette[out[:, :, 0]] if color == 3 else np.rint(out * (255 / (2**depth - 1)))
    return (rgb[:, :, 0] if n < 3 and color != 3 else np.rint(rgb[:, :, :3] @ [0.299, 0.587, 0.114])).astype(np.uint8)


def encoded(gray: Column, width: Column, ending: str, quality: int = 90) -> Column:
    """The picture as the content of a file with this ending."""

    def run(grays: pa.Array, widths: pa.Array) -> pa.Array:
        out = []
        for g, w in zip(grays, widths.to_pylist()):
            x = np.asarray(g.values, np.uint8).reshape(-1, w) if g.is_valid and len(g.values) else None
            out.append(None if x is None else png(x) if ending == "png" else jpeg(x, quality))
        return pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")(gray, width)
